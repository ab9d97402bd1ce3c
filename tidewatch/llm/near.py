"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

Documents with equal shingle sets are one class; a class is sketched once. Classes that share a band are candidates, and
every candidate pair is either checked on the full sets or already connected by checked pairs:

1. each class with the least pivot (smallest member) of its bands;
2. each class with the other pivots of its bands, unless connected by now;
3. in bands whose members are still in several components, the members outside the largest one against all others.

The first two steps are linear in the classes; copies by the thousand are connected by them. Step 3 has no cap: blocks
of some hundred members outside the largest component meet blocks of the band's other members in a task, first by their
sketches, then, where those are near, by their full sets, and only links are returned. So no link between different
texts is lost but by the sketch: with 128 coordinates in bands of four a pair at the threshold of 0.8 shares no band
once in 2 * 10^7 times, and agrees in fewer than 60 % of the coordinates once in 10^7 times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import give_back, row_groups, text_bytes
from tidewatch.llm.words import band_hashes, fast_sketch, shingle_sets, word_hashes
from tidewatch.operators.components import connected_components
from tidewatch.storage import stage, sweep, unstage

SIZE = 128
BAND = 4
PERCENT = 80
GROUP_BYTES = 1 << 20
SALT_SHINGLES = 1 << 17
FILTER_BITS = 1 << 24
BLOCK = 768
AGREE = 77  # of SIZE coordinates: pairs that agree in fewer are not near the threshold


def batch_sets(b: pa.RecordBatch, k: int, rows: np.ndarray | None = None) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets of the rows from there on), a few megabytes of text at a time."""
    column = b.column("text") if rows is None else b.column("text").take(pa.array(rows))
    body, at = text_bytes(column)
    for i, j in row_groups(at, GROUP_BYTES):
        yield i, shingle_sets(*word_hashes(body[at[i] : at[j]], at[i : j + 1] - at[i]), k)


class Sketcher:
    """mapInArrow function: (doc_id, text) to (doc_id, n, set_key, bands, sketch), the sketch with a byte a coordinate."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, sets in batch_sets(b, self.k):
                n = np.array([len(s) for s in sets], np.int64)
                sketch = fast_sketch(sets, SIZE)
                bands, lean = band_hashes(sketch, BAND), sketch.astype(np.uint8)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands.shape[1], pa.int32()), pa.array(bands.ravel()))
                yield pa.record_batch([b.column("doc_id").slice(i, len(sets)), pa.array(n), pa.array(keys, pa.binary()), lists, pa.array([x.tobytes() for x in lean], pa.binary())], names=["doc_id", "n", "set_key", "bands", "sketch"])
        give_back()


class SetMaker:
    """mapInArrow function: the shingle sets of the documents whose slot is in the filter (and of some others)."""

    def __init__(self, k: int, bitmap):
        self.k, self.bitmap = k, bitmap

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(self.bitmap.value, "<i8")
        for b in batches:
            slot = b.column("slot").to_numpy()
            rows = np.flatnonzero(bitmap[slot >> 6] >> (slot & 63) & 1)
            ids = b.column("doc_id").take(pa.array(rows))
            for i, sets in batch_sets(b, self.k, rows):
                yield pa.record_batch([ids.slice(i, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])
        give_back()


class Verifier:
    """mapInArrow function over rows sorted by (pivot, salt, not own): checks each member against the pivot's sets."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivots = None, []
        for b in batches:
            member, pivot, salt = (b.column(c).to_numpy() for c in ("member", "pivot", "salt"))
            body, at = text_bytes(b.column("shingles"))
            src, dst = [], []
            for i in range(b.num_rows):
                if (pivot[i], salt[i]) != group:
                    group, pivots = (pivot[i], salt[i]), []
                s = np.frombuffer(body[at[i] : at[i + 1]].tobytes(), np.uint64)
                if member[i] == pivot[i]:
                    pivots.append(s)
                elif any(linked(s, p, self.percent) for p in pivots):
                    src.append(member[i])
                    dst.append(pivot[i])
            yield pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, as sorted numbers, have a Jaccard similarity of `percent` or more."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


class BlockPairs:
    """mapInArrow function over rows sorted by (band, s, t, role): a block's outsiders (role 0) are held, its other rows
    stream past them. Without sets it returns the ids that have a near partner by sketch, with sets the links."""

    def __init__(self, percent: int, with_sets: bool):
        self.percent, self.with_sets = percent, with_sets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, done = None, [], set()
        for b in batches:
            band, s, t, role, index, rep, n, component = (b.column(c).to_numpy() for c in ("band", "s", "t", "role", "b", "rep", "n", "component"))
            lean = np.frombuffer(text_bytes(b.column("sketch"))[0], np.uint8).reshape(-1, SIZE)
            bands = b.column("bands").flatten().to_numpy().reshape(-1, SIZE // BAND)
            body, at = text_bytes(b.column("shingles")) if self.with_sets else (None, None)
            src, dst = [], []
            for i in range(b.num_rows):
                if (band[i], s[i], t[i]) != group:
                    group, held, block, done = (band[i], s[i], t[i]), [], None, set()
                own = np.frombuffer(body[at[i] : at[i + 1]].tobytes(), np.uint64) if self.with_sets else None
                if role[i] == 0:
                    held.append((rep[i], n[i], component[i], lean[i], bands[i], own))
                    continue
                if not held:
                    continue
                if block is None:
                    block = tuple(np.array([h[k] for h in held]) for k in range(5))
                reps, sizes, components, leans, lists = block
                near = (components != component[i]) & (100 * np.minimum(sizes, n[i]) >= self.percent * np.maximum(sizes, n[i]))
                near = np.flatnonzero(near)
                if not len(near):
                    continue
                same = leans[near] == lean[i]
                first = (lists[near] == bands[i]).argmax(axis=1)
                near = near[(first == index[i]) & (same.sum(axis=1) >= AGREE)]  # each pair in the first band it shares
                for k in near:
                    if not self.with_sets:
                        src.append(reps[k])
                    elif (pair := (reps[k], component[i])) not in done and linked(held[k][5], own, self.percent):
                        done.add(pair)
                        src.append(reps[k])
                        dst.append(rep[i])
                if len(near) and not self.with_sets:
                    src.append(rep[i])
            if self.with_sets:
                yield pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
            else:
                yield pa.record_batch([pa.array(sorted(set(src)), pa.int64())], names=["rep"])


def slot_of(column: str):
    return F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of the documents with these ids, and of some others.

    The sets are made anew from the texts. A filter of FILTER_BITS bits, two megabytes at any input size, lets the texts
    of most other documents go by; the join that follows is exact.
    """
    spark = docs.sparkSession
    words = ids.select(slot_of("id").alias("slot")).groupBy(F.expr("slot >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS >> 6, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").withColumn("slot", slot_of("doc_id")).mapInArrow(SetMaker(k, shared), "doc_id long, shingles binary")


def verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (member, pivot, n) whose full sets are similar enough, as (src, dst).

    A pivot with many members is repeated for each salt, so no task gets more than a share of them, and rows stream
    past: no group is held.
    """
    sets = sets_of(docs, pairs.select(F.col("member").alias("id")).union(pairs.select("pivot")), k)
    salts = pairs.groupBy("pivot").agg(F.ceil(F.sum("n") / SALT_SHINGLES).cast("int").alias("salts"))
    members = pairs.join(salts, "pivot").select("member", "pivot", F.pmod(F.xxhash64("member"), F.greatest("salts", F.lit(1))).cast("int").alias("salt"))
    own = salts.select(F.col("pivot").alias("member"), "pivot", F.explode(F.sequence(F.lit(0), F.greatest("salts", F.lit(1)) - 1)).alias("salt"))
    rows = sets.join(members.union(own), F.col("doc_id") == F.col("member")).select("member", "pivot", "salt", "shingles")
    dealt = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("member") != F.col("pivot"))
    return dealt.mapInArrow(Verifier(percent), "src long, dst long")


def labels_of(edges: DataFrame) -> DataFrame:
    return stage(connected_components(edges), "labels")


def labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """rows with the component of `node`; a node without edges is its own."""
    named = labels.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    return rows.join(named, F.col(node) == F.col("__node"), "left").withColumn(name, F.coalesce("__component", node)).drop("__node", "__component")


def across(docs: DataFrame, inside: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different components of a band's members: (src, dst), one for each outsider and component at least.

    A band of m members of which l are outside its largest component becomes m / BLOCK by l / BLOCK blocks, each a task's
    worth of rows however large the band is.
    """
    sizes = inside.groupBy("band", "component").count()
    blocks = sizes.groupBy("band").agg(F.max(F.struct("count", "component")).alias("main"), F.sum("count").alias("m"))
    blocks = blocks.select("band", F.col("main.component").alias("main"), F.ceil(F.col("m") / BLOCK).cast("int").alias("ms"), F.ceil((F.col("m") - F.col("main.count")) / BLOCK).cast("int").alias("ls"))
    rows = inside.join(blocks, "band").withColumn("s", F.pmod(F.xxhash64("rep"), F.col("ms")).cast("int")).withColumn("t", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("ls")).cast("int"))
    kept = ["band", "b", "rep", "n", "component"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = rows.where("component <> main").select(*kept, each("ms").alias("s"), "t", F.lit(0).alias("role"))
    placed = outside.union(rows.select(*kept, "s", each("ls").alias("t"), F.lit(1).alias("role")))
    lean = placed.join(classes.select("rep", "sketch", "bands"), "rep")
    deal = lambda df: df.repartition("band", "s", "t").sortWithinPartitions("band", "s", "t", "role")
    active = stage(deal(lean).mapInArrow(BlockPairs(percent, False), "rep long").distinct(), "active")
    full = lean.join(active, "rep", "left_semi").join(sets_of(docs, active.select(F.col("rep").alias("id")), k), F.col("rep") == F.col("doc_id")).drop("doc_id")
    return deal(full).mapInArrow(BlockPairs(percent, True), "src long, dst long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id long, text).

    Words are runs of characters other than ASCII white space, A-Z in small letters; shingles have k words, a text of
    fewer words is one shingle, and texts without words are linked with nothing. Two texts are linked if their sets'
    Jaccard similarity is percent or more; component_id is the smallest doc_id that links reach, and kept rows are
    those with that id. Rows that share a doc_id are one node; rows without one take their class's component, or null.
    An empty table gives no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    rows = stage(docs.mapInArrow(Sketcher(k), "doc_id long, n long, set_key binary, bands array<long>, sketch binary"), "sketches")
    classes = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min(F.struct("bands", "sketch")).alias("s")).select("set_key", "rep", "n", "s.bands", "s.sketch")
    classes = stage(classes.where("rep IS NOT NULL"), "classes")
    banded = classes.select("rep", "n", F.posexplode("bands").alias("b", "band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("most")).where("pivot < most").select("band", "pivot")
    members = stage(banded.join(shared, "band").select("band", "b", "rep", "n", "pivot"), "members")

    pairs = members.where("rep <> pivot").select(F.col("rep").alias("member"), "pivot", "n").distinct()
    first = stage(pairs.groupBy("member").agg(F.min("pivot").alias("pivot"), F.max("n").alias("n")), "pairs")
    edges = stage(verify(docs, first, k, percent), "edges")
    labels = labels_of(edges)

    open_ = labelled(labelled(pairs, labels, "member", "a"), labels, "pivot", "b").where("a <> b").select("member", "pivot", "n")
    second = stage(open_.join(first, ["member", "pivot"], "left_anti"), "pairs")
    if not second.isEmpty():
        edges = stage(edges.union(verify(docs, second, k, percent)), "edges")
        labels = labels_of(edges)

    placed = labelled(members, labels, "rep", "component")
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    inside = stage(placed.join(mixed, "band", "left_semi").select("band", "b", "rep", "n", "component"), "members")
    if not inside.isEmpty():
        edges = stage(edges.union(across(docs, inside, classes, k, percent)), "edges")
        labels = labels_of(edges)

    found = labelled(classes.select("set_key", "rep"), labels, "rep", "component").select("set_key", "component")
    out = rows.join(found, "set_key", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id, null last, then by a hash.

    A row is known by its doc_id and text together, so rows that share an id but not the text are different documents,
    and of rows that repeat both, or have no id, one stays as of any copies. Rows without words are in no group and all
    stay, whatever repeats. Texts of any length count whole; an empty table gives no rows; all other columns are kept as
    they are, under any name.
    """
    names = docs.columns
    own = {c: f"c{i}" for i, c in enumerate(names)}
    rows = docs.select(*[F.col(f"`{c}`").alias(v) for c, v in own.items()])
    node = F.xxhash64(own["doc_id"], own["text"])
    found = stage(near_duplicates(rows.select(node.alias("doc_id"), F.col(own["text"]).alias("text")), k, percent).where("n_shingles > 0").select(F.col("doc_id").alias("node"), "component_id"), "found")
    ids = rows.select(node.alias("node"), F.col(own["doc_id"]).alias("id")).join(found.groupBy("node").agg(F.min("component_id").alias("component"), F.count("*").alias("n")), "node")
    first = F.min(F.struct(F.col("id").isNull().alias("lacks"), "id", "node"))["node"]
    nodes = stage(ids.groupBy("node", "component", "n").agg(F.min("id").alias("id")), "nodes")
    kept = nodes.groupBy("component").agg(first.alias("node"))
    gone = nodes.join(kept, ["component", "node"], "left_anti").select("node")
    left = rows.withColumn("node", node).join(stage(gone, "gone"), "node", "left_anti")
    several = stage(nodes.where("n > 1").join(kept.select("node"), "node", "left_semi").select("node"), "several")
    once = left.join(several, "node", "left_anti")
    if not several.isEmpty():
        once = once.unionByName(left.join(several, "node", "left_semi").dropDuplicates(["node"]))
    unstage(found)
    return once.select(*[F.col(v).alias(c) for c, v in own.items()])
