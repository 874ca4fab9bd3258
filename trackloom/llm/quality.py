"""Quality rules: text statistics as built-in expressions, and a learned decision list over them.

Everything on the main path is a DataFrame expression on one row: no Python on executors, no shuffle of texts or words.
A word is a run of characters other than ASCII white space. Repeated 3-word windows are found by sorting the 64-bit
hashes of a text's windows with their places; two windows of a text count as equal if their hashes are.

Defined results: a null or empty text has zero words and fails the base rule; a null ``doc_id`` or a document without
label is judged but not learned from; several labels of one document each count; no labels at all: the base rule alone
decides; an empty table gives an empty result; other columns are ignored, or kept as they are by ``filter_quality``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import common, decision_list

SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["words", "mean_word", "symbol_rate", "upper_rate", "bang_rate", "dup_line_rate", "repeat_rate"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row, so that the optimizer doesn't copy an expression into each of its uses (inside a lambda: once per element)."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_statistics(df: DataFrame, text: str, keep: str | Column = "*") -> DataFrame:
    """(doc, stats): what to ``keep`` of each row as a struct, and the struct of COUNTS and FEATURES of the column ``text``."""
    df = _step(df.select(F.struct(keep).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t")), w=F.filter(F.split("t", SPACE), lambda x: x != ""), l=F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("w")
    window = F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    df = _step(df, n=n, h=window)
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    df = _step(df, s=F.when(repeats, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, j: e["h"] == F.get("s", j)["h"]
    df = _step(df, p=F.sort_array(F.transform(F.filter("s", lambda e, j: F.coalesce(same(e, j - 1), F.lit(False)) | F.coalesce(same(e, j + 1), F.lit(False))), lambda e: e["i"])))
    step = F.transform("p", lambda p, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("p", j - 1))))
    df = _step(
        df,
        c=F.struct(
            F.col("n").cast("long").alias("n_words"),
            _removed(F.col("t"), r"[^\x20\x09-\x0D]+").cast("long").alias("word_chars"),
            _removed(F.col("t"), r"[#*$%&|<>]").cast("long").alias("n_symbols"),
            (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
            F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("l").alias("lines"),
            _removed(F.col("t"), r"\p{Lu}+").alias("upper"),
            _removed(F.col("t"), "!").alias("bangs"),
        ),
    )
    c, words = F.col("c"), F.greatest(F.col("c.n_words"), F.lit(1))
    features = {
        "words": c.n_words,
        "mean_word": c.word_chars / words,
        "symbol_rate": c.n_symbols / words,
        "upper_rate": c.upper / F.greatest(c.word_chars, F.lit(1)),
        "bang_rate": c.bangs / words,
        "dup_line_rate": c.n_dup_lines / F.greatest(c.lines, F.lit(1)),
        "repeat_rate": c.n_repeat_words / words,
    }
    stats = F.struct(*(c[k].alias(k) for k in COUNTS), *(v.cast("double").alias(k) for k, v in features.items()))
    return df.select("doc", stats.alias("stats"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, FEATURES), written to the shared folder: texts are read once."""
    got = with_statistics(docs, "text", F.col("doc_id").cast("long").alias("doc_id"))
    return common.materialize(got.select("doc.doc_id", "stats.*"), "quality")


def learn_rules(stats: DataFrame, labels: DataFrame) -> list[decision_list.Rule]:
    """A decision list for labels.quality = 0, from all labelled documents that pass the base rule."""
    marked = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).alias("low"))
    rows = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(marked, "doc_id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    return decision_list.learn(rows, FEATURES, "low")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Rows are written once with their statistics and read back,
    so texts are looked through once whatever the rules turn out to be."""
    got = common.materialize(with_statistics(docs, "text"), "quality")
    stats = got.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "stats.*")
    return got.where(_kept(learn_rules(stats, labels), lambda f: F.col("stats")[f])).select("doc.*")


def _kept(rules: list, of) -> Column:
    return ~base_failed(of("n_words"), of("n_repeat_words")) & decision_list.verdict(rules, of)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base counts, whether the base rule fails, and whether the document is kept."""
    stats = statistics(common.table(spark, sf_dir, "documents"))
    rules = learn_rules(stats, common.table(spark, sf_dir, "labels"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return stats.select("doc_id", *COUNTS, failed.alias("base_failed"), _kept(rules, F.col).alias("kept"))
