"""Token counts by a two-tier lookup on the map side: no pre-token is ever shuffled.

A sentencepiece model without pieces that hold a white-space marker after another character encodes a text word by
word: a word is a run of markers and what follows up to the next marker. So the count of a text is the sum over its
words. Tier one is a broadcast table of the most frequent words' counts. They come from one pass over all texts with
``approx_top_k``, an aggregate of bounded size: each task sends one sketch, sketches are merged in ``GROUPS`` groups,
and those in a last step, so no task gets more sketches than about a GROUPS-th of the tasks. The last step has a group
key too, as the aggregate can't take an input partition without rows. Tier two
is a cache in each Python worker; words in neither go through the library, a batch at a time. The table only saves
time: any word's count is the library's, whichever tier gives it.

Defined results: a null or empty text has 0 tokens; a null ``doc_id`` stays null; repeated rows are each counted; an
empty table gives an empty result; other columns are ignored. Texts of any length are counted whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import common

MARK = "▁"
GROUPS = 64
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class WordCounter:
    """Counts tokens of texts with one model: ``table`` is the first tier, ``seen`` the worker's cache behind it."""

    def __init__(self, path: str, table: dict[str, int], cached: int = 200_000):
        import sentencepiece

        class Tiers(dict):
            def __missing__(tiers, word: str) -> int:
                return self.seen[word]

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.vocab_size())]
        probe = " a  b\tcéﬁＡ "
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces) and self.lib.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.marks = [0] + [sum(1 for _ in self._run(k)) for k in range(1, 3)]
        self.tiers, self.seen, self.cached = Tiers(table), {}, cached

    def _run(self, k: int) -> list:
        """Pieces of k markers that end a text: the library adds one to the blanks it is given, if it is given any."""
        return self.lib.encode(" " * (k - 1)) if k > 1 else self.lib.encode("a ", out_type=str)[1:]

    def _library(self, words: list[str]) -> None:
        """Words are kept without their first marker, which the library adds; a lone marker is the empty word."""
        full = [w for w in words if w]
        for k in range(0, len(full), 4096):
            part = full[k : k + 4096]
            self.seen.update(zip(part, map(len, self.lib.encode(part, num_threads=1))))
        self.seen[""] = self.marks[1]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(x) for x in self.lib.encode(texts, num_threads=1)]
        words = []
        for t in texts:
            if "  " in t or MARK in t or t[:1] == " ":
                words.append([w[1:].replace(MARK, " ") for w in WORDS.findall(MARK + t.replace(" ", MARK))])
            else:
                words.append(t.split(" ") if t else [])
        if len(self.seen) > self.cached:
            self.seen = {}
        new = set().union(*words).difference(self.tiers).difference(self.seen)
        if new:
            self._library(list(new))
        get = self.tiers.__getitem__
        return [sum(map(get, w)) for w in words]


def frequent_words(docs: DataFrame, k: int = 4000, tracked: int = 8192) -> list[str]:
    """The ``k`` most frequent blank-separated words of all texts, about; at most ``k`` short strings reach the driver."""
    words = common.texts(docs).select(F.explode(F.split("text", " ")).alias("w")).where(F.length("w").between(1, 24))
    groups = words.groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS))).agg(F.expr(f"approx_top_k_accumulate(w, {tracked})").alias("s"))
    last = groups.groupBy(F.col("s").isNull()).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {tracked}), {k})").alias("top"))
    row = last.select("top.item").first()
    return [w for w in (row[0] or [] if row else []) if w is not None and MARK not in w]


def token_counts(docs: DataFrame, model: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of ``docs`` and the columns ``keep``, one row per input row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    words = frequent_words(docs)
    counter = WordCounter(model, {})
    table = spark.sparkContext.broadcast(dict(zip(words, counter.count(words))) if counter.by_word else {})  # at most k entries
    key = uuid.uuid4().hex

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = common.worker_state(key, lambda: WordCounter(model, table.value))
        for batch in batches:
            n = pa.array(counter.count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), n], [*names, "n_tokens"])

    rows = common.texts(docs, *keep).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kept = rows.drop("text")
    names = kept.columns
    return rows.mapInArrow(counted, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kept.schema)}, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether it has more than 4096."""
    import public_tokenizers

    got = token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.withColumn("over_limit", F.col("n_tokens") > 4096)
