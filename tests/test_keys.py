"""Golden cases of the scalar functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trackloom.functions import keys


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    kinds = ", ".join(f"{n} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for n, v in zip(names, values))
    return spark.createDataFrame([values], kinds).select(make(*map(F.col, names))).first()[0]


@pytest.mark.parametrize(("ms", "tol"), [(60000, 5.0), (180000, 9.0), (360000, 18.0), (900000, 20.0)])
def test_length_bounds(spark, ms, tol):
    assert one(spark, keys.tolerance, ms) == tol
    for s, want in ((ms / 1000 + tol, "match"), (ms / 1000 - tol, "match"), (ms / 1000 + tol + 0.01, "mismatch"), (ms / 1000 - tol - 0.01, "mismatch"), (0.0, "missing-candidate"), (-1.0, "missing-candidate"), (float("nan"), "missing-candidate"), (float("inf"), "missing-candidate")):
        assert one(spark, keys.length_reason, ms, s) == want
    assert one(spark, keys.length_reason, 0, 5.0) == "missing-source"


def test_texts(spark):
    assert one(spark, keys.normalize_title, "  Ｂｅyoncé — ﬁne! ") == "beyonce fine"
    assert one(spark, keys.normalize_identity, " Ｋ  Scope\t ") == "k scope"
    assert one(spark, keys.base_title, "Song - 2011 Remastered Version") == "Song"
    assert one(spark, keys.base_title, "Song (Remaster)") == "Song"
    assert one(spark, keys.primary_artist, "A feat. B") == "A" and one(spark, keys.primary_artist, "A, B") == "A"
    assert one(spark, keys.artist_set, "B & a feat. C x D") == ["a", "b", "c", "d"]
    assert one(spark, keys.edition_flags, "Live at X (Sped-up Remix)") == ["live", "remix", "sped up"]
    ten = ", ".join("abcdefghij")
    assert one(spark, keys.credits_match, ten, ten + ", k") and not one(spark, keys.credits_match, "a", "a, b")
    assert one(spark, keys.public_text, " \x01 ") is None


def test_file_base(spark):
    assert one(spark, keys.file_base, "A", "x/y/z?") == "A - xy-z-"
    assert one(spark, keys.file_base, "", "") == "unknown_artist - unknown_track"
    full = "A - " + "é" * 200
    got = one(spark, keys.file_base, "A", "é" * 200)
    assert got == "A - " + "é" * 117 + "-" + hashlib.sha256(full.lower().encode()).hexdigest()[:12]
    assert len(got.encode()) <= 251


def test_ids(spark):
    i = "1234567890123456789012"
    for t in (i, f"spotify:track:{i}", f"https://open.spotify.com/track/{i}?si=1", f"https://open.spotify.com/intl-de/track/{i}"):
        assert one(spark, keys.source_id, t) == i
    assert one(spark, keys.source_id, "x" + i) is None
    assert one(spark, keys.source_key, i, "A", "B") == f"spotify:{i}"


@pytest.mark.parametrize(("x", "want"), [(120.0, 120.0), (60.0, 120.0), (21.0, 168.0), (200.0, 100.0), (700.0, 87.5), (0.0, 100.0), (-1.0, 100.0), (85.0, 85.0), (170.0, 170.0)])
def test_fold_tempo(spark, x, want):
    assert one(spark, keys.fold_tempo, x) == pytest.approx(want)


def test_wheel(spark):
    assert one(spark, keys.camelot, "A", "minor") == "8A" and one(spark, keys.camelot, "Db", "major") == "3B" and one(spark, keys.camelot, "H", "major") == "?"
    for a, b, d in (("8A", "8A", 0), ("8A", "8B", 1), ("12A", "1A", 1), ("1A", "7B", 7), ("?", "1A", 6)):
        assert one(spark, keys.camelot_distance, a, b) == d
