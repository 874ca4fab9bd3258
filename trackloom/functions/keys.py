"""Scalar expressions: names, keys, lengths, tempo and key codes. All are built-in column expressions but two text forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Edition words, illegal file characters, length bounds, error classes.
EDITIONS = ["cover", "karaoke", "live", "remix", "instrumental", "acoustic", "sped up", "slowed"]
ILLEGAL = '/\\?%*:|"<>'
TOLERANCE_SHARE, TOLERANCE_LEAST, TOLERANCE_MOST, SLACK = 0.05, 5.0, 20.0, 1e-6
FILE_BYTES, CUT_BYTES = 251, 238


@F.pandas_udf(StringType())
def _nfkd_without_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.category(c).startswith("M")))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_nfkd_without_marks(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", " "))


def normalize_identity(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_nfkc(F.coalesce(c, F.lit("")))), r"(?U)\s+", " "))


def base_title(c: Column) -> Column:
    """Without remaster notes, bracketed or after a dash, with or without their year."""
    return F.trim(F.regexp_replace(c, r"(?i)\s*[-(\[]\s*(?:\d{4}\s+)?remaster(?:ed)?[^)\]]*[)\]]?", ""))


def primary_artist(c: Column) -> Column:
    return F.split(c, r"(?i),|\s+(?:feat\.?|ft\.?)\s+")[0]


def artist_set(c: Column) -> Column:
    parts = F.split(F.lower(c), r"\s*(?:,|&|\bfeat\.?|\bft\.?|\sx\s)\s*")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")))


def credits_match(saved: Column, current: Column) -> Column:
    """Equal, or ``saved`` was cut at ten credits and starts ``current``."""
    return (saved == current) | ((F.size(F.split(saved, ", ")) == 10) & current.startswith(F.concat(saved, F.lit(", "))))


def edition_flags(c: Column) -> Column:
    return F.filter(F.array(*(F.lit(e) for e in EDITIONS)), lambda e: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), e, F.lit(" "))))


def file_base(artist: Column, name: Column) -> Column:
    """``artist - name`` as a file name; over-long ones are cut at a character and end in a hash of the whole."""
    artist = F.when(F.coalesce(artist, F.lit("")) == "", "unknown_artist").otherwise(artist)
    name = F.when(F.coalesce(name, F.lit("")) == "", "unknown_track").otherwise(name)
    at = F.instr(name, "/")
    name = F.when(at > 0, F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.length(name)))).otherwise(name)
    full = F.translate(F.concat(artist, F.lit(" - "), name), ILLEGAL, "-" * len(ILLEGAL))
    start = F.struct(F.lit("").alias("kept"), F.lit(False).alias("full"))
    cut = F.aggregate(F.split(F.substring(full, 1, CUT_BYTES + 1), ""), start, lambda a, c: F.struct(F.when(a["full"] | (F.octet_length(F.concat(a["kept"], c)) > CUT_BYTES), a["kept"]).otherwise(F.concat(a["kept"], c)).alias("kept"), (a["full"] | (F.octet_length(F.concat(a["kept"], c)) > CUT_BYTES)).alias("full")), lambda a: a["kept"])
    return F.when(F.octet_length(full) <= FILE_BYTES, full).otherwise(F.concat(cut, F.lit("-"), F.substring(F.sha2(F.lower(full), 256), 1, 12)))


def source_id(c: Column) -> Column:
    """The 22-character id of an address, a short form or bare text; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"^(?:https://open\.spotify\.com/(?:intl-[^/]+/)?track/|spotify:track:)?([A-Za-z0-9]{22})(?:[?#].*)?$", 1), F.lit(""))


def source_key(id_: Column, artist: Column, name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("spotify:"), id_), F.lower(file_base(artist, name)))


def tolerance(expected_ms: Column) -> Column:
    """Seconds that a length may be off; null without a known length."""
    return F.when(expected_ms > 0, F.greatest(F.lit(TOLERANCE_LEAST), F.least(F.lit(TOLERANCE_MOST), expected_ms / 1000 * TOLERANCE_SHARE)))


def length_reason(expected_ms: Column, seconds: Column) -> Column:
    """match, mismatch, missing-source or missing-candidate: unknown, not finite or not positive never passes."""
    known = lambda c: F.coalesce(~F.isnan(c.cast("double")) & (c > 0) & (c.cast("double") < float("inf")), F.lit(False))
    near = F.abs(expected_ms / 1000 - seconds) <= tolerance(expected_ms) + SLACK
    return F.when(~known(expected_ms), "missing-source").when(~known(seconds), "missing-candidate").when(near, "match").otherwise("mismatch")


def micros(t: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC whatever the session's zone."""
    t = F.col(t) if isinstance(t, str) else t
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), t.cast("timestamp_ntz")).cast("timestamp"))


def public_text(c: Column, longest: int = 500) -> Column:
    return F.nullif(F.substring(F.trim(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " ")), 1, longest), F.lit(""))


def fold_tempo(c: Column) -> Column:
    """Doubled or halved into 85 to 170; 100 if not positive."""
    up = c * F.pow(F.lit(2.0), F.ceil(F.log2(F.lit(85.0) / c)))
    down = c / F.pow(F.lit(2.0), F.ceil(F.log2(c / F.lit(170.0))))
    return F.when(F.coalesce(c, F.lit(0.0)) <= 0, 100.0).when(c < 85, up).when(c > 170, down).otherwise(c)


#: Wheel codes by scale and key.
CAMELOT = {
    "minor": dict(zip(["G#", "D#", "A#", "F", "C", "G", "D", "A", "E", "B", "F#", "C#"], range(1, 13))),
    "major": dict(zip(["B", "F#", "C#", "G#", "D#", "A#", "F", "C", "G", "D", "A", "E"], range(1, 13))),
}
ENHARMONIC = {"Ab": "G#", "Bb": "A#", "Cb": "B", "Db": "C#", "Eb": "D#", "Gb": "F#"}


def camelot(key: Column, scale: Column) -> Column:
    same = F.create_map(*(F.lit(x) for p in ENHARMONIC.items() for x in p))
    code = F.create_map(*(F.lit(x) for s, t in CAMELOT.items() for k, n in t.items() for x in (f"{s}:{k}", f"{n}{'A' if s == 'minor' else 'B'}")))
    return F.coalesce(code[F.concat(scale, F.lit(":"), F.coalesce(same[key], key))], F.lit("?"))


def camelot_distance(a: Column, b: Column) -> Column:
    """Steps round the wheel of twelve, one more if the letters differ; 6 if either is unknown."""
    n = lambda c: F.regexp_extract(c, r"^(\d+)", 1).cast("int")
    gap = F.abs(n(a) - n(b))
    return F.when((a == "?") | (b == "?"), 6).otherwise(F.least(gap, 12 - gap) + F.when(F.right(a, F.lit(1)) != F.right(b, F.lit(1)), 1).otherwise(0))
