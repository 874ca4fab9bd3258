"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

Voters are lexicon entries (a word occurs), stem patterns (a four-letter stem occurs at least k times) and fixed
surface patterns. Entries and stems are mined from labelled documents outside the held-out fold, at most ``MAX_DOCS`` of
them, those with the smallest hashes of their ids. A voter that fires votes for toxic; otherwise it abstains.

The label model knows no labels: it sees how often each combination of votes occurs over all documents. It fits, by
expectation maximisation, the class balance and each voter's accuracy (the chance of toxic where it fires), anchored at
the labelled rates; an abstention says nothing, but the silence of all votes for clean. From the posterior it estimates the voters' correlations within each class, and a voter whose votes come with
others' counts for less in the next fit. Sums are Spark aggregates over the table of combinations; the driver gets one
number for each voter or pair of voters.

A logistic regression on log-scaled rates and presences of the voters learns the posterior as soft labels from at most
``MAX_DOCS`` documents, half of them with votes, and scores every document.

Defined results: a null or empty text has no votes and gets the score of that; without labels (or one class only) there
is no voter but the surface patterns and the score is the share of toxic labels, 0 without any; a null ``doc_id`` is
scored and counts as outside the held-out fold; repeated rows each get a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import common

WORD = re.compile(r"[^\W\d_]+")
STEM, LEVELS = 4, (1, 2, 3)
MAX_DOCS, MAX_VOTERS, MIN_HITS, MIN_PRECISION = 20_000, 56, 8, 0.5
#: Surface patterns: (name, expression); few marks say much, so the label model weighs them by what they agree with.
SURFACE = [("shouting", re.compile(r"(?:\b[A-Z]{3,}\b\W+){4}")), ("marks", re.compile(r"[!?]{3,}")), ("address", re.compile(r"(?i)\byou(?:'re| are)? (?:a|an|all)\b"))]


@dataclass(frozen=True)
class Voters:
    words: tuple[str, ...]
    stems: tuple[tuple[str, int], ...]

    def __len__(self) -> int:
        return len(self.words) + len(self.stems) + len(SURFACE)

    def counts(self, text: str) -> tuple[list[int], list[bool], int]:
        """Hits and vote of each voter, and the number of words."""
        words = WORD.findall(text.lower())
        of = Counter(words)
        wanted = {s for s, _ in self.stems}
        stems: Counter = Counter()
        for w, n in of.items():
            if w[:STEM] in wanted:
                stems[w[:STEM]] += n
        hits = [of.get(w, 0) for w in self.words] + [stems[s] for s, _ in self.stems] + [sum(1 for _ in p.finditer(text)) for _, p in SURFACE]
        least = [1] * len(self.words) + [k for _, k in self.stems] + [1] * len(SURFACE)
        return hits, [h >= k for h, k in zip(hits, least)], len(words)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def mine_voters(docs: DataFrame, labels: DataFrame) -> Voters:
    """``labels``: (doc_id, toxic) outside the held-out fold, bounded."""

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                of = Counter(WORD.findall(text.lower()))
                stems: Counter = Counter()
                for w, n in of.items():
                    total["w", w, 1, toxic] += 1
                    if len(w) > STEM:
                        stems[w[:STEM]] += n
                for s, n in stems.items():
                    for k in LEVELS:
                        if n >= k:
                            total["s", s, k, toxic] += 1
        rows = list(total.items())
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k, _ in part], t) for j, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))] + [pa.array([n for _, n in part], pa.int64())], ["kind", "of", "least", "toxic", "n"])

    rows = docs.join(F.broadcast(labels), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))  # MAX_DOCS labels at most
    stats = rows.mapInArrow(found, "kind string, of string, least int, toxic int, n long").groupBy("kind", "of", "least").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("n"))
    good = stats.where((F.col("p") >= MIN_HITS) & (F.col("p") >= MIN_PRECISION * F.col("n")))
    good = good.orderBy(F.desc(F.col("p") * F.col("p") / F.col("n")), "kind", "of", "least").limit(4 * MAX_VOTERS).collect()
    words, stems = [], {}
    for r in good:
        if r.kind == "w" and len(words) < MAX_VOTERS // 2:
            words.append(r.of)
        elif r.kind == "s" and r.of not in stems and len(stems) < MAX_VOTERS - MAX_VOTERS // 2:
            stems[r.of] = r.least  # a stem's best level comes first
    return Voters(tuple(words), tuple(stems.items()))


def vote(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, votes long as bits, x array<double> for the classifier) per row, written out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, xs = [], []
            for text in batch.column("text").to_pylist():
                hits, votes, n = voters.counts(text)
                bits.append(sum(1 << j for j, v in enumerate(votes) if v))
                h = np.array(hits, float)
                xs.append(np.concatenate([np.array(votes, float), np.log1p(100 * h / max(20, n))]))
            flat = np.concatenate(xs) if xs else np.zeros(0)
            edges = np.arange(len(xs) + 1, dtype=np.int32) * 2 * len(voters)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], ["doc_id", "votes", "x"])

    return common.materialize(docs.mapInArrow(run, "doc_id long, votes long, x array<double>"), "votes")


def _bit(j: int) -> Column:
    return F.getbit("votes", F.lit(j)).cast("double")


@dataclass
class LabelModel:
    prior: float
    accuracy: np.ndarray  # P(toxic | the voter fires)
    silent: float  # P(toxic | no voter fires): silence as a whole votes for clean, a single abstention says nothing
    weight: np.ndarray  # what correlation leaves of a voter's evidence
    correlation: np.ndarray  # voters x voters, within classes

    def posterior(self) -> Column:
        """P(toxic | votes) as an expression on the column ``votes``."""
        base = _logit(self.prior)
        score = F.lit(base)
        for j, a in enumerate(self.accuracy):
            score = score + _bit(j) * float((_logit(a) - base) * self.weight[j])
        return F.when(F.col("votes") == 0, F.lit(float(self.silent))).otherwise(1 / (1 + F.exp(-score)))


def _logit(p: float) -> float:
    p = min(max(float(p), 1e-3), 1 - 1e-3)
    return math.log(p) - math.log1p(-p)


def fit_label_model(votes: DataFrame, m: int, prior: float, start: np.ndarray, silent: float, rounds: int = 3, correlated: int = 2) -> LabelModel:
    """Expectation maximisation over the combinations of votes, with estimates of the correlations between.

    ``start`` and ``silent`` are accuracies seen on labelled rows; as priors they weigh as much as the data at any size,
    so voters that never meet others stay anchored.
    """
    table = common.materialize(votes.groupBy("votes").agg(F.count("*").cast("double").alias("n")), "combinations")
    model = LabelModel(prior, start.copy(), silent, np.ones(m), np.zeros((m, m)))
    fired = F.filter(F.array(*(F.when(F.getbit("votes", F.lit(j)) == 1, F.lit(j)) for j in range(m))), lambda x: x.isNotNull())
    for step in range(correlated + 1):
        for _ in range(rounds if step else 1):
            on = [F.sum(F.col("n") * _bit(j)) for j in range(m)]
            toxic = [F.sum(F.col("n") * F.col("p") * _bit(j)) for j in range(m)]
            r = table.withColumn("p", model.posterior()).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("t"), F.array(*on).alias("on"), F.array(*toxic).alias("toxic")).first()
            if not r.n:
                return model
            hits, hits_toxic = np.array(r.on), np.array(r.toxic)
            model.accuracy = np.where(hits > 0, (hits_toxic / np.maximum(hits, 1) + start) / 2, start)
            model.prior = (r.t / r.n + prior) / 2
        if step == correlated:
            return model
        pairs = table.where("votes <> 0").select("n", model.posterior().alias("p"), fired.alias("f")).select("n", "p", "f", F.explode("f").alias("j")).select("n", "p", "j", F.explode("f").alias("k")).where("j < k")
        both = pairs.groupBy("j", "k").agg(F.sum(F.col("n") * F.col("p")).alias("t"), F.sum(F.col("n") * (1 - F.col("p"))).alias("c")).collect()
        totals = np.array([r.n - r.t, r.t])
        rates = np.clip(np.array([hits - hits_toxic, hits_toxic]) / np.maximum(totals, 1.0)[:, None], 1e-6, 1 - 1e-3)
        corr = np.zeros((m, m))
        for x in both:
            for joint, y in ((x.c, 0), (x.t, 1)):
                a, b = rates[y, x.j], rates[y, x.k]
                rho = (joint / max(totals[y], 1.0) - a * b) / math.sqrt(a * (1 - a) * b * (1 - b))
                corr[x.j, x.k] += max(-1.0, min(1.0, rho)) / 2
            corr[x.k, x.j] = corr[x.j, x.k]
        model.correlation = np.clip(corr, -1, 1)
        model.weight = 1 / (1 + np.clip(model.correlation, 0, 1).sum(axis=1))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text); ``labels``: (doc_id, toxic)."""
    common.small_batches(docs.sparkSession)
    docs = common.texts(docs)
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCS)
    known = common.materialize(known, "known")
    n, t = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    voters = mine_voters(docs, known) if 0 < t < n else Voters((), ())
    votes, m = vote(docs, voters), len(voters)
    fold = held_out(F.col("doc_id"))
    if not 0 < t < n or votes.isEmpty():
        share = F.lit(float(t) / max(n, 1))
        return votes.select("doc_id", fold.alias("held_out"), share.alias("score"), (share >= 0.5).cast("int").alias("predicted"))
    seen = votes.join(F.broadcast(known), "doc_id").agg(*(F.sum(_bit(j)).alias(f"n{j}") for j in range(m)), *(F.sum(_bit(j) * F.col("toxic")).alias(f"t{j}") for j in range(m)), F.count_if(F.col("votes") == 0).alias("quiet"), F.sum(((F.col("votes") == 0) & (F.col("toxic") == 1)).cast("int")).alias("quiet_toxic")).first()
    start = np.array([((seen[f"t{j}"] or 0) + 0.5) / ((seen[f"n{j}"] or 0) + 1) for j in range(m)])
    model = fit_label_model(votes, m, t / n, start, ((seen.quiet_toxic or 0) + 0.5) / (seen.quiet + 1))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = votes.where("votes <> 0").orderBy(*order).limit(MAX_DOCS // 2).union(votes.where("votes = 0").orderBy(*order).limit(MAX_DOCS // 2))
    soft = common.materialize(picked.select("x", model.posterior().alias("p")), "soft")
    rows = soft.select(array_to_vector("x").alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("y")).select("features", "y.*")
    linear = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=40).fit(rows)
    scored = linear.transform(votes.select("doc_id", array_to_vector("x").alias("features")))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", fold.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op9_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    return score_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
