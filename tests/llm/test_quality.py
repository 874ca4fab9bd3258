import collections
import random
import re

from trackloom.llm import decision_list, quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_counts(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "a a a a", "a\x0bb\x0cc\rd\te\nf", "é# 漢|\n\n \né# 漢|\nx", "a b c d a b c e a b", "x y z"]
    texts += ["".join(rng.choice(["a", "b", "cc", "#", "!", "\n", " ", "\t", "É", " a b c "]) for _ in range(rng.randint(1, 200))) for _ in range(80)]
    texts += ["one two three " * 30000]
    rows = list(enumerate(texts)) + [(None, "a b"), (3, "a")]
    got = quality.statistics(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string")).collect()
    assert sorted(((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in got), key=str) == sorted(((i, *brute(t)[:5]) for i, t in rows), key=str)


def test_learned_list_separates(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(999)) for _ in range(80)]
        low = i % 4 == 0
        rows.append((i, " ".join(w + "&&&" for w in words) if low else " ".join(words), "x"))
        labels.append((i, 0 if low else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, __x string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = quality.filter_quality(docs, lab)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 4}
    assert quality.filter_quality(docs.limit(0), lab).count() == 0
    assert quality.filter_quality(docs, lab.limit(0)).count() == 400


def test_verdict_without_rules(spark):
    assert spark.range(2).where(decision_list.verdict([])).count() == 2


def test_learner_equals_brute_force(spark):
    """The grown and pruned list, found again by trying every condition on rows in plain Python."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        a, b, c = rng.randrange(6), rng.randrange(6), rng.randrange(6)
        low = a >= 4 and b < 3 or c == 0 and b >= 4
        rows.append((float(a), float(b), float(c), low if rng.random() < 0.98 else not low, i % 2))
    names = ["a", "b", "c"]
    got = decision_list.learn(spark.createDataFrame(rows, "a double, b double, c double, low boolean, part int"), names, "low")

    def holds(rule, r):
        return all(r[f] >= t if up else r[f] < t for f, up, t in rule)

    def count(rule, left, part):
        inside = [r for r in left if r[4] == part and holds(rule, r)]
        return sum(r[3] for r in inside), sum(not r[3] for r in inside)

    want, left, short = [], rows, 0
    while short < 3:
        rule, scores = [], []
        while len(rule) < 3:
            p0, n0 = count(rule, left, 0)
            if not p0 or not n0:
                break
            best = (1e-6, None)
            for f in range(3):
                cuts = [v + 0.5 for v in range(5)]
                for up in (True, False):
                    for t in cuts[::-1] if up else cuts:
                        p, n = count([*rule, (f, up, t)], left, 0)
                        g = decision_list._gain(p, n, p0, n0)
                        if g > best[0]:
                            best = (g, (f, up, t))
            if best[1] is None:
                break
            rule.append(best[1])
            p, n = count(rule, left, 1)
            scores.append(((p + 1) / (p + n + 2), p, len(rule)))
        if not rule:
            break
        good, p, length = max(scores, key=lambda s: (round(s[0], 3), -s[2]))
        short = short + 1 if good < 0.9 or p < 8 else 0
        if not short:
            want.append(rule[:length])
        left = [r for r in left if not holds(rule[:length], r)]
    assert len(want) >= 2
    assert [[(names.index(c.feature), c.at_least, c.threshold) for c in rule] for rule in got] == want
