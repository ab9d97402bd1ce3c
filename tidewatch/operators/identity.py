"""Identity resolution: components of linked atoms, scored by the best path from the component's anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.components import connected_components
from tidewatch.storage import stage

HOPS = 6


def path_confidence(column: str | Column) -> Column:
    return F.coalesce(F.product(column), F.lit(1.0))


def noisy_or(column: str) -> Column:
    return 1 - F.coalesce(F.product(1 - F.col(column)), F.lit(1.0))


def nodes(assertions: DataFrame) -> DataFrame:
    """atom, type, value, confidence, sources of each asserted (type, value)."""
    made = assertions.groupBy("type", "value").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"))
    return made.withColumn("atom", F.concat_ws("\x1f", "type", "value"))


def edges(links: DataFrame, merge: str = "last") -> DataFrame:
    """a, b, confidence of undirected links (left_type, left_value, right_type, right_value, confidence, seq); of a
    repeated pair the last by seq, or with merge='noisy_or' their combination."""
    left, right = F.concat_ws("\x1f", "left_type", "left_value"), F.concat_ws("\x1f", "right_type", "right_value")
    pairs = links.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), "confidence", "seq").where("a <> b")
    how = noisy_or("confidence") if merge == "noisy_or" else F.max(F.struct("seq", "confidence"))["confidence"]
    return pairs.groupBy("a", "b").agg(how.alias("confidence"))


def components(atoms: DataFrame, links: DataFrame) -> DataFrame:
    """atom, component (its least atom)."""
    found = connected_components(links, "a", "b")
    return atoms.join(found, F.col("atom") == F.col("node"), "left").select("atom", F.coalesce("component", "atom").alias("component"))


def best_paths(placed: DataFrame, links: DataFrame, hops: int = HOPS) -> DataFrame:
    """atom, path: the largest product of confidences from the anchor over `hops` links at most, 0 beyond."""
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y"), "confidence").union(links.select("b", "a", "confidence"))
    reach = placed.where("atom = anchor").select("atom", F.lit(1.0).alias("path"))
    for _ in range(hops):
        step = reach.join(both, F.col("atom") == F.col("x")).select(F.col("y").alias("atom"), (F.col("path") * F.col("confidence")).alias("path"))
        reach = reach.union(step).groupBy("atom").agg(F.max("path").alias("path"))
    return reach


def resolve(assertions: DataFrame, links: DataFrame, merge: str = "last") -> DataFrame:
    """principal_id, type, value, confidence, sources of every asserted atom. A link to an atom that isn't asserted, or a
    confidence outside 0 to 1, is an error."""
    atoms, pairs = stage(nodes(assertions), "atoms"), stage(edges(links, merge), "links")
    ends = pairs.select(F.col("a").alias("atom")).union(pairs.select("b"))
    if not ends.join(atoms, "atom", "left_anti").isEmpty():
        raise ValueError("a link names an atom that no assertion has")
    if not atoms.select("confidence").union(pairs.select("confidence")).where("NOT confidence BETWEEN 0 AND 1").isEmpty():
        raise ValueError("confidences are from 0 to 1")
    placed = stage(atoms.join(components(atoms, pairs), "atom"), "placed")
    anchors = placed.groupBy("component").agg(F.max(F.struct("confidence", "type", "value", "atom"))["atom"].alias("anchor"), principal_id().alias("principal_id"))
    anchored = stage(placed.join(anchors, "component"), "anchored")
    scored = anchored.join(best_paths(anchored, pairs), "atom", "left")
    return scored.select("principal_id", "type", "value", (F.col("confidence") * F.coalesce("path", F.lit(0.0))).alias("confidence"), "sources")


def principal_id() -> Column:
    """person- and six digits of a hash of the component's atoms."""
    texts = F.transform(F.array_sort(F.collect_set(F.struct("type", "value"))), lambda x: F.concat(x["type"], F.lit(":"), x["value"]))
    return F.concat(F.lit("person-"), F.substring(F.sha2(F.array_join(texts, "|"), 256), 1, 6))


def stamp(events: DataFrame, resolved: DataFrame, kind: str) -> DataFrame:
    """events with actor.principal_id filled from atoms of one type that equal actor.user_id."""
    w = Window.partitionBy("value").orderBy("principal_id")
    ids = resolved.where(F.col("type") == kind).withColumn("__n", F.row_number().over(w)).where("__n = 1").select(F.col("value").alias("__user"), F.col("principal_id").alias("__principal"))
    joined = events.join(ids, F.col("actor.user_id") == F.col("__user"), "left")
    return joined.withColumn("actor", F.col("actor").withField("principal_id", F.coalesce("__principal", "actor.principal_id"))).drop("__user", "__principal")
