"""Canonical order and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint() -> Column:
    """A hash of an event's content: not its id, observed time or provenance; nulls of actor and device count as absent."""
    attributes = F.array_join(F.transform(F.array_sort(F.map_keys("attributes")), lambda k: F.concat(F.length(k).cast("string"), F.lit(":"), k, F.lit("="), F.coalesce(F.to_json(F.col("attributes")[k]), F.lit("null")))), "|")
    return F.sha2(F.concat_ws("\x1f", F.to_json(F.struct("event_type", "event_us", "actor", "device")), attributes), 256)


def prepare(events: DataFrame, dedup: str = "event_id") -> DataFrame:
    """Each event once: of one event_id (or one content, dedup='fingerprint') the first by event time, then id.

    One shuffle on the key. Ties of time and id go to the smaller fingerprint, so the result doesn't depend on the
    order of arrival.
    """
    if dedup not in ("event_id", "fingerprint"):
        raise ValueError(f"unknown strategy: {dedup!r}")
    if dedup == "fingerprint":
        marked = events.withColumn("__fp", fingerprint())
        key = "__fp"
    else:  # content decides only between events that share an id, so only theirs is hashed
        several = F.count("*").over(Window.partitionBy("event_id")) > 1
        marked = events.withColumn("__several", several).withColumn("__fp", F.when(F.col("__several"), fingerprint())).drop("__several")
        key = "event_id"
    w = Window.partitionBy(key).orderBy("event_us", "event_id", "__fp")
    return marked.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__fp")


def first_seen(events: DataFrame, by: list[Column], name: str = "is_first_seen") -> DataFrame:
    """Marks the first event of each combination, for rules on first-seen access."""
    w = Window.partitionBy(*by).orderBy("event_us", "event_id")
    return events.withColumn(name, F.row_number().over(w) == 1)
