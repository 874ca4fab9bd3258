import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(t):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            odd = [int(c) for c in d[-1::-2]] + [sum(divmod(2 * int(c), 10)) for c in d[-2::-2]]
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")) or k == "card" and not (12 <= len(d) <= 19 and sum(odd) % 10 == 0) or k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


@settings(max_examples=2000, deadline=None)
@given(st.text(st.sampled_from("a.@-+%0 1()é\n95_"), max_size=40) | st.lists(st.sampled_from(["1", "255.", "256", ".0.0.1", "@a.b", "a@", "c.d", "+1 (0", "555-", "4539578763621486", " ", "-", "."]), max_size=14).map("".join))
def test_base_equals_patterns(text):
    assert pii.base_spans(text) == brute(text)


@pytest.fixture(scope="module")
def model():
    return pii.SemiMarkov().fit(pii.training_examples([]))


def test_model_on_unseen_windows(model):
    hit = wanted = false = 0
    for text, spans in pii.training_examples([], seed=99):
        got = {s for t in pii.windows(text) for s in model.decode(text, t, [])}
        hit, wanted, false = hit + len(got & set(spans)), wanted + len(spans), false + len(got - set(spans))
    assert hit >= 0.85 * wanted and false <= 0.08 * wanted


def test_joint_choice(model):
    text = "pay 7536784127813050 4845168114407329 now, or call (017) 555-7713 and write jo12 [at] mail3 [dot] example [dot] com but not 2024-01-12"
    base, every = pii.find_spans(text, model)
    assert base == []
    assert [(k, text[s:e]) for s, e, k in every] == [("card", "7536784127813050"), ("card", "4845168114407329"), ("phone", "(017) 555-7713"), ("email", "jo12 [at] mail3 [dot] example [dot] com")]


def test_query(spark):
    texts = [None, "", "mail a.b@c.org or +1 (017) 555-7713", "é" * 5 + " 10.0.0.1", "x " * 60000 + "q@r.st " + "9" * 60000]
    rows = list(enumerate(texts)) + [(None, texts[2]), (2, texts[2])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string")
    got = pii.pii_spans(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = dict(rows[:-2]).get(r.doc_id, texts[2]) or ""
        b = brute(t)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in b) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in b).encode()).hexdigest()
        assert set(f"{k}:{s}:{e}" for s, e, k in b) <= set(r.spans.split(","))
    assert pii.pii_spans(docs.limit(0)).count() == 0


def test_redact(spark):
    docs = spark.createDataFrame([(1, "to a.b@c.org!", 13, None), (2, "clean", 5, "x"), (3, None, None, "y")], "doc_id long, text string, n_chars long, spans string")
    assert sorted(map(tuple, pii.redact(docs).collect())) == [(1, "to [EMAIL]!", 11, None), (2, "clean", 5, "x"), (3, None, None, "y")]
    assert pii.masked("abcdef", [(1, 3, "card"), (2, 4, "ip"), (5, 6, "email")]) == "a[CARD]e[EMAIL]"


WINDOWS = st.lists(st.sampled_from(["12", "345-", "6789 ", "+1 (", ") ", "a1", "beef", "10.", "0.0.1 ", "@", " at ", " (at) ", "[dot] ", " dot ", "x", "card ", "tel: ", "/", "\n", "é", "4539578763621486", ", ", "    "]), min_size=1, max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(WINDOWS)
def test_scores_equal_features(text):
    """The sums over characters score a span as its features do, one by one."""
    rng = np.random.default_rng(5)
    w = rng.normal(size=(len(pii.KINDS), len(pii.NAMES)))
    for tokens in pii.windows(text):
        i, j = pii.candidates(text, tokens, ([], []))
        if len(i):
            got = pii.Scorer(text, tokens).scores(i, j, w)
            want = np.array([w[:, list(set(pii.features(text, tokens[a][0], tokens[b - 1][1], int(b - a))))].sum(axis=1) for a, b in zip(i, j)])
            assert np.allclose(got, want)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["12", "6789", "+1", "@", "at", "a", ".", "-"]), min_size=1, max_size=6).map(" ".join), st.integers(0, 5))
def test_decoder_equals_all_segmentations(text, seed):
    """The best path is the best of all ways to cut a window into candidate segments of every type and background."""
    rng = np.random.default_rng(seed)
    m = pii.SemiMarkov()
    m.w, m.t = rng.normal(size=m.w.shape), rng.normal(size=m.t.shape)
    for tokens in pii.windows(text):
        i, j = pii.candidates(text, tokens, ([], []))
        score = dict(zip(zip(i.tolist(), j.tolist()), pii.Scorer(text, tokens).scores(i, j, m.w) if len(i) else []))

        def paths(at, y):
            if at == len(tokens):
                yield 0.0, ()
                return
            for rest, spans in paths(at + 1, 0):
                yield m.t[y, 0] + rest, spans
            for (a, b), s in score.items():
                if a == at and s.max() + m.t.max() * 2 > 0:
                    for k in range(len(pii.KINDS)):
                        for rest, spans in paths(b, k + 1):
                            yield m.t[y, k + 1] + s[k] + rest, ((tokens[a][0], tokens[b - 1][1], pii.KINDS[k]), *spans)

        best = max(p[0] for p in paths(0, 0))
        got = tuple(m.decode(text, tokens, []))
        assert any(abs(v - best) < 1e-9 and spans == got for v, spans in paths(0, 0))


def test_dense_digits_take_linear_time(model):
    """A table of figures: time grows with its length and stays small."""
    rng = random.Random(4)
    took = []
    for n in (4000, 16000):
        text = " ".join(str(rng.randrange(100, 99999)) for _ in range(n))
        start = time.process_time()
        pii.find_spans(text, model)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] and took[1] < 8.0
