"""Scalar expressions over messages and labels: error classes, attributions, kinds of items, chapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a rate limit and a dead local network look like, and the ordered classes of all other messages.
LOCAL_NETWORK = "no route to host|network is unreachable|nodename nor servname|errno (?:51|65)"
RATE_LIMIT = r"not a bot|too many requests|http error 429|status code 429|\b429\b(?!\.\d)|quota exceeded|precondition check failed|unable to download api page|youtube rate limit or bot check"
CLASSES = [
    ("timed out|timeout", "YouTube operation timed out"),
    ("sign in.*age|age.restricted|confirm your age|use --cookies", "YouTube age verification requires cookies"),
    ("MP3 codec/duration verification|ffprobe unavailable", "Output failed MP3 codec/duration verification"),
    ("MP3 tags could not be written", "MP3 tags could not be written"),
    ("ENOSPC|SQLITE_FULL|no space left", "Local disk is full"),
    ("SQLITE_BUSY|database is locked", "Local database temporarily busy"),
    ("requested format is not available", "Requested audio format unavailable"),
    ("403|forbidden", "Media URL rejected (403)"),
    ("private video|video unavailable|removed|not available in your country", "Selected YouTube video unavailable"),
    ("cookies file", "Recovery cookies file unavailable"),
]
CANCELLED, LIMITED, OFFLINE, UNKNOWN = "CLI admission cancelled", "YouTube rate limit or bot check", "Local network unavailable", "YouTube attempt did not produce a verified result"
PROGRESS = r"(?im)^[\t ]*\[download\].*$"


def has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def is_rate_limit(c: Column) -> Column:
    """A rate limit is named outside progress lines, and the local network isn't what failed."""
    return ~has(c, LOCAL_NETWORK) & has(F.regexp_replace(c, PROGRESS, ""), RATE_LIMIT)


def error_class(c: Column) -> Column:
    """The first class that a message fits; classes are their own class, and null is the last one."""
    known = [CANCELLED, LIMITED, OFFLINE, UNKNOWN, *(name for _, name in CLASSES)]
    first = F.when(c.isin(known), c).when(has(c, "CLI stopping|YouTube admission cancelled|CLI admission cancelled"), CANCELLED).when(is_rate_limit(c), LIMITED).when(has(c, LOCAL_NETWORK), OFFLINE)
    return reduce(lambda out, x: out.when(has(c, x[0]), x[1]), CLASSES, first).otherwise(UNKNOWN)


def attribution(owner: Column, subtitle: Column) -> Column:
    """(owner, source, made_for) of a structured owner's name and a subtitle like ``Playlist • X``; the structured one wins."""
    label = F.nullif(F.trim(F.regexp_extract(subtitle, r"(?i)^Playlist\s*[•·]\s*(.+)$", 1)), F.lit(""))
    made_for = F.nullif(F.trim(F.regexp_extract(label, r"(?i)^Made for\s+(.+)$", 1)), F.lit(""))
    given = F.nullif(F.trim(owner), F.lit(""))
    named = F.when(made_for.isNull(), label)
    return F.struct(F.coalesce(given, named).alias("owner"), F.when(given.isNotNull(), "structured").when(named.isNotNull(), "saved-subtitle").alias("source"), made_for.alias("made_for"))


def item_kind(uri: Column, name: Column, subtitle: Column) -> Column:
    u, n = F.coalesce(uri, F.lit("")), F.coalesce(name, F.lit(""))
    radio = u.contains("station") | F.lower(u).contains("radio") | n.endswith(" Radio")
    mix = F.lower(n).contains("daily mix") | F.coalesce(subtitle.startswith("Made for"), F.lit(False))
    return (
        F.when(u.startswith("spotify:playlist:"), "playlist")
        .when(u.contains("collection:tracks") | (n == "Liked Songs"), "liked_songs")
        .when(u.startswith("spotify:album:"), "album")
        .when(u.startswith("spotify:artist:"), "artist")
        .when(radio, "radio")
        .when(mix, "mix")
        .when(u.startswith("spotify:collection:"), "collection")
        .otherwise("other")
    )


def chapters_valid(chapters: Column, total: Column, most: int = 200) -> Column:
    """Of the first ``most`` chapters (start, end) those with 0 <= start < end, and end within a second of a known ``total``."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fits = lambda c: finite(c["start"]) & finite(c["end"]) & (c["start"] >= 0) & (c["end"] > c["start"]) & (total.isNull() | (c["end"] <= total + 1))
    return F.filter(F.slice(chapters, 1, most), fits)
