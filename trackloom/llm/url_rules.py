"""URL filtering: fixed host-and-path rules first, then association rules mined by Spark FP-growth from labels.

A url's items are its host's names, also split at hyphens, its last two names together, path parts (digits as ``#``) and
query keys. FP-growth runs over the items of labelled urls with the label, block or allow, as one more item. Labels are the
quality of the page's document, nothing else. Rules for both labels are pruned by support, by confidence, by lift over the
label's share of all rows, by shorter rules that are as sure, and last by a held-out third of the labelled urls, on which a
rule must be as sure again. Where nothing in the urls goes with the labels, no rule survives and every verdict without a fixed
rule is allow. A url that rules for both labels fit gets the surer one's, block if they are equal.

Items that stand in exactly the same urls are one class to FP-growth, so k of them give one set and not 2^k; a url holds a
class if it holds one of its members. Matching goes through an inverted index: each rule stands under its rarest class, so a
url meets only rules whose rarest class it holds, and then all of a rule's classes are looked for. Only built-in expressions
run on executors.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict allow; a null
``page_id`` is kept; repeated rows each get a row; without labels no rule is mined; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm import common

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's; the longest wins.
FIXED = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
LABELS = {True: "label=block", False: "label=allow"}
BROADCAST_ROWS, MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MIN_ROWS = 20_000, 0.002, 0.6, 1.1, 8
#: One of so many labelled urls, by hash, is held out to prune rules.
HOLD_OUT = 3


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def items(url: Column) -> Column:
    """The distinct items of a url; none without a host."""
    names, words = F.split(host(url), r"\."), F.split(host(url), "[.-]")
    query = F.regexp_extract(url, r"(?s)\A.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.concat(F.lit("q:"), F.substring_index(p, "=", 1)))
    parts = F.transform(F.split(path(url), "/"), lambda p: F.concat(F.lit("p:"), F.regexp_replace(p, "[0-9]+", "#")))
    both = F.concat(F.transform(F.array_union(names, words), lambda n: F.concat(F.lit("h:"), n)), F.array(F.concat(F.lit("d:"), F.array_join(F.slice(names, F.greatest(F.size(names) - 1, F.lit(1)), 2), "."))), parts, keys)
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(both, lambda x: ~x.isin("h:", "p:", "q:", "d:"))))


def _uncovered(rules: DataFrame) -> DataFrame:
    """The rows of ``rules`` (label, items, n, sure, ...) without those that a smaller set of some of their items is as sure as.

    With every set, all its subsets are in ``rules``. So a set's surest subset is the surest of what the sets with one item
    less are or have in them: a round a size, and each round joins a set only with the sets that lack one of its items.
    """
    spark = rules.sparkSession
    longest = rules.agg(F.max("n")).first()[0] or 0
    kept = below = None
    for n in range(1, longest + 1):
        own = rules.where(F.col("n") == n)
        if below is None:
            met = own.withColumn("best", F.lit(0.0))
        else:
            less = own.select("label", "items", F.explode("items").alias("of")).select("label", "items", F.array_remove("items", F.col("of")).alias("part"))
            best = less.join(below, ["label", "part"]).groupBy("label", "items").agg(F.max("best").alias("best"))
            met = common.materialize(own.join(best, ["label", "items"]), "covered")
        below = met.select("label", F.col("items").alias("part"), F.greatest("sure", "best").alias("best"))
        new = met.where("sure > best").drop("best")
        kept = new if kept is None else kept.union(new)
    return kept if kept is not None else spark.createDataFrame([], rules.schema)


def mine(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (items, label, key, confidence, support) from ``labelled`` (url, blocked), whose items are classes, and the classes
    (of, class, freq) of all frequent items; both written out. Not yet pruned on held-out urls."""
    spark = labelled.sparkSession
    schema = "items array<string>, label string, key string, confidence double, support double"
    rows = labelled.where("blocked is not null").select(items(F.col("url")).alias("has"), "blocked").where("size(has) > 0")
    rows = common.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "baskets")
    n = rows.count()
    if n < MIN_ROWS:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "of string, class string, freq long")
    least = max(MIN_SUPPORT, MIN_ROWS / n)
    # what stands in under the least number of baskets is in no frequent set; so the table of items is bounded by items a url / MIN_SUPPORT
    single = rows.select("row", F.explode("has").alias("of")).groupBy("of").agg(F.count("*").alias("freq"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 31))).alias("y"))
    single = common.materialize(single.where(F.col("freq") >= F.ceil(F.lit(least * n) - 1e-9)).select("of", F.min("of").over(Window.partitionBy("freq", "x", "y")).alias("class"), "freq"), "items")
    label = F.when(F.col("blocked"), LABELS[True]).otherwise(LABELS[False])
    baskets = rows.join(_classes(rows.select("row", "has"), single, "row"), "row", "left").select(F.concat(F.coalesce("classes", F.array().cast("array<string>")), F.array(label)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=MIN_CONFIDENCE).fit(common.materialize(baskets, "classes"))
    sets = common.materialize(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    bad = rows.where("blocked").count() / n
    names = F.array(*map(F.lit, LABELS.values()))
    led = sets.where(F.arrays_overlap("items", names) & (F.size("items") > 1))  # a url has one label, so no set has two
    led = led.select(F.array_except("items", names).alias("items"), F.element_at(F.array_intersect("items", names), 1).alias("label"), F.col("freq").alias("both"))
    sure = common.materialize(led.join(sets, "items").select("label", "items", F.size("items").alias("n"), (F.col("both") / F.col("freq")).alias("sure"), (F.col("both") / n).alias("support")), "rules")
    enough = F.greatest(F.lit(MIN_CONFIDENCE), MIN_LIFT * F.when(F.col("label") == LABELS[True], bad).otherwise(1 - bad))
    kept = sure.limit(0) if sure.where(F.col("sure") >= enough).isEmpty() else _uncovered(sure).where(F.col("sure") >= enough)
    kept = kept.withColumnRenamed("sure", "confidence")
    # the rarest class by its frequency among the baskets
    freq = single.select(F.col("class").alias("of"), "freq").distinct()
    keyed = kept.select("*", F.explode("items").alias("of")).join(freq, "of").groupBy("items", "label", "confidence", "support").agg(F.min_by("of", F.struct("freq", "of")).alias("key"))
    return common.materialize(keyed.select("items", "label", "key", "confidence", "support"), "rules"), single


def _few(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast if its counted rows allow it, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _classes(rows: DataFrame, single: DataFrame, by: str) -> DataFrame:
    """(by, classes): the classes that the items ``has`` of each row belong to."""
    return rows.select(by, F.explode("has").alias("of")).join(_few(single.select("of", "class")), "of").groupBy(by).agg(F.collect_set("class").alias("classes"))


def fitting(urls: DataFrame, rules: DataFrame, single: DataFrame) -> DataFrame:
    """(url, items, label, confidence): the rules that fit each distinct ``url``."""
    held = _classes(urls.where("url is not null").select("url").distinct().select("url", items(F.col("url")).alias("has")), single, "url")
    met = held.select("*", F.explode("classes").alias("key")).join(_few(rules), "key")
    return met.where(F.size(F.array_except("items", "classes")) == 0).select("url", "items", "label", "confidence")


def confirmed(rules: DataFrame, single: DataFrame, held_out: DataFrame) -> DataFrame:
    """The ``rules`` that are sure, and surer than the label's share of rows, on ``held_out`` (url, blocked) too."""
    total = held_out.where("blocked is not null").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad")).first()
    share = F.when(F.col("label") == LABELS[True], total.bad / max(total.n, 1)).otherwise(1 - total.bad / max(total.n, 1))
    met = fitting(held_out.select("url"), rules, single).join(held_out.where("blocked is not null"), "url")
    right = F.avg((F.when(F.col("blocked"), LABELS[True]).otherwise(LABELS[False]) == F.col("label")).cast("double"))
    good = met.groupBy("items", "label").agg(right.alias("right")).where((F.col("right") >= MIN_CONFIDENCE) & (F.col("right") >= MIN_LIFT * share))
    return common.materialize(rules.join(good.select("items", "label"), ["items", "label"], "left_semi"), "confirmed")


def learn(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules mined from two thirds of the ``labelled`` urls and confirmed on the rest, and the classes of items. All rows of a url
    are on one side."""
    side = F.pmod(F.xxhash64("url"), F.lit(HOLD_OUT)) == 0
    rules, single = mine(labelled.where(~side))
    return confirmed(rules, single, labelled.where(side)), single


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url); ``labels``: (doc_id, quality), quality 0 for pages to be blocked."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    h, p = host(F.col("url")), path(F.col("url"))
    rule = verdict = F.when(F.lit(False), F.lit(None).cast("string"))
    for rh, rp, v in sorted(FIXED, key=lambda r: -len(r[0] + r[1])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule, verdict = rule.when(fits, rh + rp), verdict.when(fits, v)
    marked = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("page_id"), (F.col("quality") == 0).alias("blocked"))
    rules, single = learn(rows.where("url is not null").join(marked, "page_id").select("url", "blocked"))
    surest = lambda name: F.coalesce(F.max(F.when(F.col("label") == name, F.col("confidence"))), F.lit(0.0))
    found = fitting(rows.where(verdict.isNull()).select("url"), rules, single).groupBy("url").agg(surest(LABELS[True]).alias("block"), surest(LABELS[False]).alias("allow"))
    bad = common.materialize(found.where("block > 0 and block >= allow").select("url"), "blocked").withColumn("bad", F.lit(True))
    out = rows.join(bad, "url", "left")
    return out.select("page_id", h.alias("host"), p.alias("path"), rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op6_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, fixed rule and verdict."""
    return judge(common.table(spark, sf_dir, "pages"), common.table(spark, sf_dir, "labels"))
