"""Guesses of which known name is meant by another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guess(asked: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """(old, new) of asked(old): the equal known(known) name, else one that differs in case and punctuation alone, else the nearest within `most` edits; or null.

    The last step compares each name that is left with those of nearly its
    length: a join on the length.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    exact = known.select(F.col("known").alias("old"), F.col("known").alias("exact"))
    alike = known.groupBy(plain("known").alias("key")).agg(F.min("known").alias("alike"))
    rows = asked.join(exact, "old", "left").withColumn("key", plain("old")).join(alike, "key", "left")
    found = rows.withColumn("new", F.coalesce("exact", "alike")).select("old", "new")
    rest = found.where("new is null").select("old", F.explode(F.sequence(F.length("old") - most, F.length("old") + most)).alias("size"))
    near = rest.join(known.withColumn("size", F.length("known")), "size").withColumn("d", F.levenshtein("old", "known", most)).where("d >= 0")
    best = near.groupBy("old").agg(F.min(F.struct("d", "known"))["known"].alias("near"))
    return found.join(best, "old", "left").select("old", F.coalesce("new", "near").alias("new"))
