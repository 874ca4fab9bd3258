"""Sequential covering: ordered threshold conjunctions learned from counts that Spark aggregates.

The learner never sees rows. For each step Spark counts labelled rows by (feature, bin, class, part), a table of at
most features x bins x 4 rows. Rows are halved by a hash into a growing and a pruning part. A rule grows by the
condition of largest FOIL gain, is cut back to its best prefix on the pruning part, and joins the list if it is precise
enough there; the rows that it covers leave, and the next rule is grown from the rest. The rows of a rule that falls short
leave too, without a rule. Learning ends when no condition gains anything, or ``patience`` rules in a row fell short.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm import common


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, value: Column) -> Column:
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, of=F.col) -> Column:
    return reduce(lambda a, b: a & b, (c.holds(of(c.feature)) for c in rule))


def verdict(rules: list[Rule], of=F.col) -> Column:
    """True (kept) unless some rule of the list fires: one conditional expression, in the list's order."""
    out = None
    for rule in rules:
        out = F.when(covers(rule, of), F.lit(False)) if out is None else out.when(covers(rule, of), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9)))


def learn(rows: DataFrame, features: list[str], target: str, bins: int = 32, patience: int = 3, max_conditions: int = 3, precision: float = 0.9, cover: int = 8) -> list[Rule]:
    """The rules for ``target`` = true. ``rows``: the features (double), ``target`` (boolean) and ``part`` (0 or 1).

    No labelled row, or one class only: no rule. Null features fall into no rule.
    """
    levels = [k / bins for k in range(1, bins)]
    cuts_row = rows.agg(*(F.percentile_approx(f, levels, 10_000).alias(f) for f in features)).first()
    ends_row = rows.agg(*(F.max(f).alias(f) for f in features)).first()
    cuts = {f: sorted({x for x in [*(cuts_row[f] or []), ends_row[f]] if x is not None}) for f in features}
    cuts = {f: [(a + b) / 2 for a, b in zip(c, c[1:])] for f, c in cuts.items()}  # between values, so ties fall on one side
    bin_of = [F.when(F.col(f).isNotNull(), sum((F.col(f) >= x).cast("int") for x in cuts[f]) if cuts[f] else F.lit(0)).alias(f"b_{f}") for f in features]
    table = common.materialize(rows.select(*features, F.col(target).alias("hit"), "part", *bin_of), "rule-rows")

    def counts(left: DataFrame) -> dict:
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in features))).alias("x")
        got = left.select("hit", "part", pairs).groupBy("x.f", "x.b", "hit", "part").count().collect()
        return {(r.f, r.b, r.hit, r.part): r["count"] for r in got if r.b is not None}

    def totals(left: DataFrame, part: int) -> tuple[int, int]:
        r = left.where(F.col("part") == part).agg(F.count_if("hit").alias("p"), F.count_if(~F.col("hit")).alias("n")).first()
        return r.p, r.n

    rules, left, short = [], table, 0
    while short < patience:
        rule, inside, scores = [], left, []
        p0, n0 = totals(left, 0)
        while len(rule) < max_conditions and n0 and p0:
            c, best = counts(inside), (1e-6, None)
            for f in features:
                for up in (True, False):
                    p = n = 0
                    for k in range(len(cuts[f])):
                        b = len(cuts[f]) - k if up else k
                        p, n = p + c.get((f, b, True, 0), 0), n + c.get((f, b, False, 0), 0)
                        best = max(best, (_gain(p, n, p0, n0), Condition(f, up, cuts[f][b - 1 if up else b])), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
            inside = left.where(covers(tuple(rule)))
            p0, n0 = totals(inside, 0)
            p, n = totals(inside, 1)
            scores.append(((p + 1) / (p + n + 2), p, len(rule)))
        if not rule:
            break
        good, p, length = max(scores, key=lambda s: (round(s[0], 3), -s[2]))
        done = tuple(rule[:length])
        short = short + 1 if good < precision or p < cover else 0
        if not short:
            rules.append(done)
        left = left.where(~F.coalesce(covers(done), F.lit(False)))
    return rules
