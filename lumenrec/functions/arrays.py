"""Columns from arrays of named entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default genre vocabulary. Any other is a parameter of multi_hot().
GENRES = (
    "Action", "Adult Cast", "Adventure", "Anthropomorphic", "Avant Garde", "Award Winning", "Boys Love", "CGDCT", "Childcare",
    "Combat Sports", "Comedy", "Crossdressing", "Delinquents", "Detective", "Drama", "Ecchi", "Educational", "Erotica", "Fantasy",
    "Gag Humor", "Girls Love", "Gore", "Gourmet", "Harem", "Hentai", "High Stakes Game", "Historical", "Horror", "Idols (Female)",
    "Idols (Male)", "Isekai", "Iyashikei", "Josei", "Kids", "Love Polygon", "Love Status Quo", "Magical Sex Shift", "Mahou Shoujo", "Martial Arts", "Mecha",
    "Medical", "Military", "Music", "Mystery", "Mythology", "Organized Crime", "Otaku Culture", "Parody", "Performing Arts", "Pets",
    "Psychological", "Racing", "Reincarnation", "Reverse Harem", "Romance", "Romantic Subtext", "Samurai", "School", "Sci-Fi", "Seinen",
    "Shoujo", "Shounen", "Showbiz", "Slice of Life", "Space", "Sports", "Strategy Game", "Super Power", "Supernatural", "Survival",
    "Suspense", "Team Sports", "Time Travel", "Urban Fantasy", "Vampire", "Video Game", "Visual Arts", "Workplace",
)


def names(entries: Column) -> Column:
    """The names of an array of (id, name), repeats and all."""
    return F.transform(entries, lambda e: e["name"])


def distinct_names(entries: Column) -> Column:
    return F.array_distinct(names(entries))


def multi_hot(labels: Column, vocabulary) -> Column:
    """1 or 0 for each word of vocabulary in sorted order; labels outside it count for nothing."""
    words = F.array(*[F.lit(v) for v in sorted(vocabulary)])
    return F.transform(words, lambda v: F.when(F.array_contains(labels, v), F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"))
