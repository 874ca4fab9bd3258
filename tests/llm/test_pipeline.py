import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from trackloom.llm import decontaminate, near_dedup, pii, quality

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, DATA).cache()
        seen[name] = (before, docs)
        if name != "token_ids":
            assert docs.schema == before.schema
    before, after = seen["quality_rules"]
    assert after.count() < before.count()
    before, after = seen["near_duplicates"]
    assert near_dedup.near_duplicates(after).where("not kept").isEmpty()
    before, after = seen["benchmark_decontamination"]
    assert decontaminate.find_leaks(after, spark.read.parquet(f"{DATA}/benchmark.parquet")).isEmpty()
    before, after = seen["personal_data"]
    assert after.count() == before.count()
    assert all(not pii.base_spans(r.text) for r in after.select("text").collect())
    before, after = seen["token_ids"]
    assert after.count() == before.count() and after.where("not round_trip").isEmpty()
    assert quality.with_statistics(after, "text").count() == after.count()


def test_stages_on_odd_rows_and_columns(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, columns named like an operator's own, an empty table."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    leak = text(40) + ". " + text(6) + "."
    same = text(120)
    rows = [(i, text(rng.randint(60, 200))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "too short"), (None, text(80)), (103, same), (104, same), (103, same), (105, text(70) + " " + leak + " " + text(70)), (106, text(60) + " write to a.b@c.org or +1 (017) 555-7713"), (107, text(60_000))]
    names = ["ids", "n_ids", "decoded", "round_trip", "doc", "stats", "id", "a.b", "__t", "key", "part"]
    docs = spark.createDataFrame([(i, t, *([None] * 5), *(f"{k}{i}" for k in range(6))) for i, t in rows], StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *(StructField(n, StringType()) for n in names)]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(None, None, None), (102, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    kept = [r.doc_id for r in got]
    assert sorted(k for k in kept if k is not None) == sorted([*range(60), 103, 103, 106, 107]) and kept.count(None) == 1
    assert [c for c in out.columns if c not in ("ids", "n_ids", "n_byte_ids", "ids_crc32", "round_trip")] == [c for c in docs.columns if c not in ("ids", "n_ids", "round_trip")]
    by = {r.doc_id: r for r in got}
    assert by[106].text.endswith("write to [EMAIL] or [PHONE]") and by[107]["a.b"] == "2107" and by[107].n_ids == len(by[107].ids) > 60_000
    assert all(r.round_trip for r in got)
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(empty / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
