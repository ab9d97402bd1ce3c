"""Mixing sources to target weights, by capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.storage import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
BUCKET_DIGITS = 3
#: A table of sources up to this many rows (some 200 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def size_of(text: str = "text"):
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw_key(seed: str):
    """A seeded hash of the document's id and text, as 32 hexadecimal digits: documents take their extra repetition in its
    order, so rows that share an id, or have none, are drawn one by one."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))))


def tie_key():
    """16 hexadecimal digits for each row: the order of rows that repeat each other, which are interchangeable."""
    return F.lpad(F.lower(F.hex(F.xxhash64(F.monotonically_increasing_id()))), 16, "0")


def water_fill(sources: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size) with weight and target.

    Clamping sources at max_epochs times their size and resharing the excess by weight until none is above ends at one
    water level: a source gets level * weight, or its cap if that is less. In order of cap / weight the level after the
    first k caps is (total - those caps) / (the remaining weights), and the first k whose next source is not above its
    cap gives the answer, so the fixed point is found by two running sums in place of a loop.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(w) - 1
    named = sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (n % len(weights) + 1).cast("int")))
    named = named.withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = (
        named.withColumn("total", F.sum("source_size").over(every))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("level_here", (F.col("total") - F.col("caps_before")).cast("double") / F.col("weights_left"))
    )
    level = F.min(F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "level_here"))).over(every)["level_here"]
    return filled.withColumn("level", level).select(
        "source", "source_size", "weight",
        F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"),
    )


def keyed(docs: DataFrame, seed: str) -> DataFrame:
    """source, size and a row's key in four parts: head and rest of its draw, head and rest of its tie."""
    d = docs.select("source", draw_key(seed).alias("key"), tie_key().alias("tie"), size_of().alias("size"))
    n = BUCKET_DIGITS
    return d.select("source", "size", F.substring("key", 1, n).alias("head"), F.substring("key", n + 1, 32).alias("rest"), F.substring("tie", 1, n).alias("tie_head"), F.substring("tie", n + 1, 16).alias("tie_rest"))


def sums_inside(rows: DataFrame, at: DataFrame, known: list[str], part: str) -> DataFrame:
    """Sums of size, and rows, for each value of `part` among a source's rows whose known parts are at.edge."""
    e = bounded(at).alias("e")
    own = F.concat(*[F.col(f"s.{x}") for x in known]) == F.col("e.edge")
    met = rows.alias("s").join(e, F.col("s.source").eqNullSafe(F.col("e.source")) & own)
    return met.groupBy(F.col("e.source").alias("source"), "edge", "room", F.col(f"s.{part}").alias("part")).agg(F.sum("s.size").alias("words"), F.count("*").alias("n"))


def with_ends(sums: DataFrame) -> DataFrame:
    return sums.withColumn("end", F.sum("words").over(Window.partitionBy("source").orderBy("part")))


def cut_at(sums: DataFrame) -> DataFrame:
    """source, edge, room, n: the first part whose sum goes beyond room, put behind edge, and what room is left before it."""
    over = with_ends(sums).where("end > room").groupBy("source", "edge").agg(F.min(F.struct("part", (F.col("room") - F.col("end") + F.col("words")).alias("room"), "n")).alias("c"))
    return over.select("source", F.concat("edge", "c.part").alias("edge"), F.col("c.room").alias("room"), F.col("c.n").alias("n"))


def nearest_end(sums: DataFrame) -> DataFrame:
    """source, cutoff: edge with the last part that ends nearer to room than the part before, edge alone if none does.
    Keys are compared as texts, so what begins with edge is above edge alone, and `g` is above all digits."""
    last = F.max(F.when(F.col("end") - F.col("words") / 2 <= F.col("room"), F.concat("part", F.lit("g"))))
    return with_ends(sums).groupBy("source", "edge").agg(last.alias("last")).select("source", F.concat("edge", F.coalesce("last", F.lit(""))).alias("cutoff"))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """For each source: source, source_size, target, whole (repetitions that every document takes) and cutoff.

    What is left of the target goes to whole documents in order of their keys, up to the cutoff, after which the words
    taken are nearest to the target. Sums of 16^BUCKET_DIGITS buckets of draws a source, added up by the scan's own
    tasks, show the bucket in which the cutoff lies, then sums of that bucket's draws the draw. Where several rows have
    that draw, since they repeat each other, their ties are narrowed down in the same way; so no task gets more than the
    values of one level, however many copies a row has.
    """
    rows = keyed(docs, seed)
    buckets = stage(rows.groupBy("source", "head").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "buckets")
    sources = water_fill(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    need = sources.withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long"))
    need = stage(need.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "need")
    b, n = buckets.alias("b"), need.where("left > 0").alias("n")
    first = b.join(n, F.col("b.source").eqNullSafe(F.col("n.source"))).select("b.source", F.lit("").alias("edge"), F.col("n.left").alias("room"), F.col("b.head").alias("part"), "b.words", "b.n")
    draws = stage(sums_inside(rows, cut_at(first), ["head"], "rest"), "draws")
    repeated = stage(cut_at(draws).where("n > 1"), "repeated")
    ends = nearest_end(draws).withColumn("deep", F.lit(0))
    if not repeated.isEmpty():
        ties = cut_at(sums_inside(rows, repeated, ["head", "rest"], "tie_head"))
        ends = ends.union(nearest_end(sums_inside(rows, ties, ["head", "rest", "tie_head"], "tie_rest")).withColumn("deep", F.lit(1)))
    r = ends.groupBy("source").agg(F.max(F.struct("deep", "cutoff"))["cutoff"].alias("cutoff")).alias("r")
    n = need.alias("n")
    cutoff = F.when(F.col("n.left") <= 0, F.lit("")).otherwise(F.coalesce("r.cutoff", F.lit("g")))
    return n.join(r, F.col("n.source").eqNullSafe(F.col("r.source")), "left").select("n.source", "n.source_size", "n.target", "n.whole", cutoff.alias("cutoff"))


def bounded(sources: DataFrame) -> DataFrame:
    """The table itself, written out; marked for broadcast if it has BROADCAST_SOURCES rows at most."""
    kept = stage(sources, "sources")
    return F.broadcast(kept) if kept.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else kept


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, copies (repetitions that the mix takes) and taken (copies * size).

    Sources by code point, null last, get the weights in turn. Reruns agree: a document's draw depends on its id, text
    and the seed alone, and which of several rows that repeat each other in these is taken once more makes no difference.
    A null or blank text has size 0 and is repeated as its source is, a text of any length counts whole; a source without
    words has target 0. Empty tables give no rows. Columns with these names are replaced.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    p = bounded(plan(docs, weights, max_epochs, seed)).alias("p")
    d = docs.withColumns({"size": size_of(), "__key": F.concat(draw_key(seed), tie_key())}).alias("d")
    copies = F.col("p.whole") + F.when(F.col("d.__key") <= F.col("p.cutoff"), 1).otherwise(0)
    joined = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source")))
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("d.size"), F.col("p.source_size"), F.col("p.target"), copies.cast("long").alias("copies"), (copies * F.col("d.size")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    m = mix(docs, weights, max_epochs, seed).where("copies > 0")
    return m.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_report(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "source_size", "target", "taken")


#: The same by plain SQL: the water level by running sums, the cutoff by running sums over all documents.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(concat('{SEED}|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
f AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
             CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER o, 0) AS DOUBLE)
             / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS here
      FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT here AS level FROM f WHERE here <= ratio ORDER BY ratio, here LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR ratio < level THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM f LEFT JOIN l ON true),
n AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / CAST(source_size AS DOUBLE)) AS BIGINT) END AS whole FROM t),
m AS (SELECT d.*, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS room,
             sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, source, size, source_size, target, CAST((whole + CASE WHEN room > 0 AND middle <= room THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM m
"""
