"""Fuzzy line dedup by MinHash, with DataFrame functions alone.

Lines are the parts of a text between line feeds; those of MIN_CHARS characters or more take part. Equal lines are one
by a 64-bit hash. A line's signature comes from all its character shingles, the same that are compared later: a hash
deals each shingle to one of COORDINATES bins and gives it a rank, a bin keeps its least rank, and an empty bin takes
that of the next one that isn't. Of a line of n shingles those ranked among about PER_BIN * COORDINATES / n are counted; the others
would hardly be a bin's least, and whether they are depends on the line's set alone. Bands share coordinates, two of
them one at most. Lines that share a band are candidates if their signatures agree in AGREE coordinates, which a pair
at the threshold misses less than once in 10^3 times; pairs are verified by the exact Jaccard similarity of all their
character shingles, components come from distributed rounds of star contraction, and the first line of each stays.

At a similarity of exactly 0.8 a pair shares a band 99 times in 100 (tests/llm/test_lines.py measures it), above 0.85
999 times in 1000.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.components import connected_components
from tidewatch.storage import stage, sweep, unstage

SHINGLE = 5  # characters of a shingle
MIN_CHARS = SHINGLE  # shorter lines hold no shingle
COORDINATES, BANDS = 40, 24
RULER = (0, 1, 4, 10, 12, 17)  # a band's coordinates from its first on; no difference occurs twice
PER_BIN = 2
TOGETHER = 8  # bins whose least ranks are found in one row
AGREE = 17
PERCENT = 80
FILTER_BITS = 1 << 24
BLOCK = 512


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), no, lid, line of every line that takes part."""
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")  # once a text, not once a line
    rows = marked.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return rows.where(F.char_length("line") >= MIN_CHARS).withColumn("lid", F.xxhash64("line"))


def signatures(docs: DataFrame) -> DataFrame:
    """lid and sig (COORDINATES numbers of 16 bits) of each different line.

    A line is shuffled once, and a row for each shingle lives between two compiled steps of one task. The least ranks are
    taken TOGETHER bins at a time, for each costs time in every row, and then put side by side.
    """
    once = line_rows(docs).groupBy("lid").agg(F.min("line").alias("line"))
    wide = once.select("lid", F.encode("line", "UTF-32").alias("wide"))  # where a character has its place
    places = wide.select("lid", "wide", F.explode(F.expr(f"sequence(1, octet_length(wide) - {4 * SHINGLE - 1}, 4)")).alias("at"))
    hashed = places.select("lid", F.expr(f"octet_length(wide) div 4 - {SHINGLE - 1}").alias("n"), F.expr(f"xxhash64(substring(wide, at, {4 * SHINGLE}))").alias("h"))
    ranked = hashed.select("lid", "n", F.expr(f"shiftrightunsigned(shiftrightunsigned(h, 32) * {COORDINATES}, 32)").alias("bin"), F.expr("h & 4294967295").alias("rank"))
    kept = ranked.where(f"rank * n < {PER_BIN * COORDINATES << 32}")
    some = kept.groupBy("lid", F.expr(f"bin div {TOGETHER}").alias("q")).agg(*[F.min(F.expr(f"CASE WHEN bin % {TOGETHER} = {j} THEN rank END")).alias(f"p{j}") for j in range(TOGETHER)])
    least = some.groupBy("lid").agg(*[F.min(F.expr(f"CASE WHEN q = {k // TOGETHER} THEN p{k % TOGETHER} END")).alias(f"m{k}") for k in range(COORDINATES)])
    near = lambda k: ", ".join(f"m{(k + j) % COORDINATES}" for j in range(4))
    later = lambda k: f"get(filter(array({', '.join(f'm{(k + j) % COORDINATES}' for j in range(4, COORDINATES))}), x -> x IS NOT NULL), 0)"
    full = [F.expr(f"CAST((coalesce({near(k)}, {later(k)}) & 65535) - 32768 AS SMALLINT)") for k in range(COORDINATES)]
    return least.select("lid", F.array(*full).alias("sig"))


def band_hash(band, at, ring):
    """A hash of a band's coordinates from `at` on, of 48 bits: what a chance meeting adds is compared and goes."""
    return F.xxhash64(*[F.get(ring, at + r) for r in RULER], band).bitwiseAND(F.lit((1 << 48) - 1))


def ring_of():
    """The coordinates, and the first ones again for the bands that go round."""
    return F.concat("sig", F.slice("sig", 1, max(RULER)) if max(RULER) else F.array().cast("array<short>"))


def starts():
    """Where each band starts."""
    return F.array(*[F.lit(b * COORDINATES // BANDS) for b in range(BANDS)])


def banded(lines: DataFrame) -> DataFrame:
    """lid, b, band: a row for each band of each line."""
    return lines.select("lid", ring_of().alias("ring")).select("lid", "ring", F.posexplode(starts()).alias("b", "at")).select("lid", "b", band_hash(F.col("b"), F.col("at"), F.col("ring")).alias("band"))


def bands_of():
    """All bands of a line, as an array."""
    return F.transform(F.array(ring_of()), lambda ring: F.transform(starts(), lambda at, b: band_hash(b, at, ring)))[0]


def passing(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """rows whose `column` is among the wanted ids, and some others: a filter of FILTER_BITS bits, broadcast as 2^18
    words of 64 bits whatever the input's size, that spares the shuffle most rows before an exact join."""
    slot = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(17)), F.lit(FILTER_BITS))
    words = wanted.select(slot(wanted.columns[0]).alias("slot")).groupBy(F.expr("slot >> 6").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("__bits"))
    marked = rows.withColumn("__slot", slot(column))
    hit = marked.join(F.broadcast(words), F.expr("__slot >> 6") == F.col("__word")).where(F.expr("getbit(__bits, CAST(__slot & 63 AS INT)) = 1"))
    return hit.drop("__slot", "__word", "__bits")


def packed(lines: DataFrame) -> DataFrame:
    """lines with words, the signature's low bytes seven to a number, for comparisons that the JVM compiles."""
    word = lambda i: F.expr(" + ".join(f"shiftleft(CAST(get(sig, {k}) & 255 AS BIGINT), {8 * (k - i)})" for k in range(i, min(i + 7, COORDINATES))))
    return lines.select("*", *[word(i).alias(f"w{i // 7}") for i in range(0, COORDINATES, 7)])


WORDS = -(-COORDINATES // 7)


def agree(x: str, y: str) -> str:
    """A condition: AGREE coordinates or more have the same low byte. A byte of the exclusive or is not zero if its low
    seven bits plus 127, or itself, set its top bit."""
    low, top = sum(127 << 8 * i for i in range(7)), sum(128 << 8 * i for i in range(7))
    apart = [f"bit_count((({x}{k} ^ {y}{k}) | ((({x}{k} ^ {y}{k}) & {low}) + {low})) & {top})" for k in range(WORDS)]
    return f"{' + '.join(apart)} <= {COORDINATES - AGREE}"


def hashes(line):
    """A hash of each run of SHINGLE characters: slices of the text in UTF-32, where a character has its place."""
    start = lambda wide: F.sequence(F.lit(1), F.octet_length(wide) - 4 * SHINGLE + 1, F.lit(4))
    once = F.array(F.encode(line, "UTF-32"))  # an array of one, for its element is then computed once
    return F.transform(once, lambda wide: F.transform(start(wide), lambda i: F.xxhash64(F.substring(wide, i, F.lit(4 * SHINGLE)))))[0]


MAP_WORDS = 32  # of 64 bits, in a line's map


def maps_of(texts: DataFrame) -> DataFrame:
    """lid, n (the number of different shingles), bits (a map with a bit for each) and spare, by how many n exceeds them."""
    shingles = texts.select("lid", F.explode(F.array_distinct(hashes(F.col("line")))).alias("h"))
    some = shingles.groupBy("lid", F.expr(f"(h >> 6) & {MAP_WORDS - 1}").alias("k")).agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("w"))
    words = F.array(*[F.coalesce(F.max(F.expr(f"CASE WHEN k = {k} THEN w END")), F.lit(0).cast("long")) for k in range(MAP_WORDS)])
    maps = some.groupBy("lid").agg(F.sum("n").alias("n"), words.alias("bits"))
    return maps.withColumn("spare", F.expr("n - aggregate(bits, 0L, (s, w) -> s + bit_count(w))"))


def possible(percent: int) -> str:
    """A condition that no similar pair x, y fails: a bit that only one line has stands for a shingle that only it has, so
    the bits of both and the lesser spare bound the shared shingles from above."""
    both = "aggregate(zip_with(x.bits, y.bits, (p, q) -> p & q), 0L, (s, w) -> s + bit_count(w))"
    return f"100L * least(x.n, y.n) >= {percent}L * greatest(x.n, y.n) AND {100 + percent}L * (least(x.spare, y.spare) + {both}) >= {percent}L * (x.n + y.n)"


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose lines' shingle sets are similar enough, as (src, dst)."""
    line = lambda c: texts.select(F.col("lid").alias(c), F.col("line").alias(f"line_{c}"))
    both = F.array(F.struct(hashes(F.col("line_a")).alias("x"), hashes(F.col("line_b")).alias("y")))
    sets = pairs.join(line("b"), "b").join(line("a"), "a").select("a", "b", F.inline(both))  # made once: no condition passes a generator
    similar = f"{100 + percent}L * size(array_intersect(x, y)) >= {percent}L * (size(array_distinct(x)) + size(array_distinct(y)))"
    return sets.where(similar).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def placed(members: DataFrame, labels: DataFrame | None, column: str, name: str) -> DataFrame:
    """members with the component of `column`; a line without links is its own."""
    if labels is None:
        return members.withColumn(name, F.col(column))
    named = labels.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    return members.join(named, F.col(column) == F.col("__node"), "left").withColumn(name, F.coalesce("__component", column)).drop("__node", "__component")


def agreeing(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose signatures agree well enough."""
    words = lambda c: held.select(F.col("lid").alias(c), *[F.col(f"w{k}").alias(f"{c}w{k}") for k in range(WORDS)])
    return pairs.join(words("a"), "a").join(words("b"), "b").where(agree("aw", "bw")).select("a", "b")


def across(members: DataFrame, held: DataFrame, texts: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one band that are in different components and may be similar by signature and map.

    Members outside a band's largest component meet all others in blocks of BLOCK by BLOCK rows, a key of the join each,
    so no band is one task's; each pair is taken in the first band that it shares. The bounds are part of the join's
    condition: pairs that fail them never become rows. Of a band of two the only pair is a pivot's, and known.
    """
    here = placed(members.select("band", "b", "lid"), labels, "lid", "component")
    sizes = here.groupBy("band", "component").agg(F.count("*").alias("k"))
    blocks = sizes.groupBy("band").agg(F.max(F.struct("k", "component")).alias("main"), F.sum("k").alias("m"), F.count("*").alias("parts")).where("parts > 1 AND m > 2")
    blocks = blocks.select("band", F.col("main.component").alias("main"), F.expr(f"CAST(ceil(m / {BLOCK}) AS INT)").alias("ms"), F.expr(f"CAST(ceil((m - main.k) / {BLOCK}) AS INT)").alias("ls"))
    inside = stage(here.join(blocks, "band"), "inside")
    maps = stage(maps_of(texts.join(inside.select("lid").distinct(), "lid", "left_semi")), "maps")
    rows = inside.join(held, "lid").join(maps, "lid").withColumn("bands", bands_of())
    rows = rows.withColumn("s", F.pmod(F.xxhash64("lid"), F.col("ms")).cast("int")).withColumn("t", F.pmod(F.xxhash64("lid", F.lit(1)), F.col("ls")).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["band", "b", "lid", "component", "bands", "n", "bits", "spare", *[f"w{k}" for k in range(WORDS)]]
    x = rows.where("component <> main").select(*kept, each("ms").alias("s"), "t").alias("x")
    y = rows.select(*kept, "s", each("ls").alias("t")).alias("y")
    first = "NOT arrays_overlap(slice(x.bands, 1, x.b), slice(y.bands, 1, y.b))"
    met = x.join(y, F.expr(f"x.band = y.band AND x.s = y.s AND x.t = y.t AND x.component <> y.component AND {agree('x.w', 'y.w')} AND {possible(percent)} AND {first}"))
    return met.select(F.greatest("x.lid", "y.lid").alias("a"), F.least("x.lid", "y.lid").alias("b")).distinct()


def line_components(docs: DataFrame, lines: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(node, component) of the different lines that are similar to others; None if none is.

    Each line is verified against the least line of all its bands, then, unless it is connected by now, against the least
    of every other band, and at last every agreeing pair of a band that is still in different components.
    """
    bands = banded(lines)
    shared = stage(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "bands")
    sweep(docs.sparkSession)
    members = stage(passing(bands, "band", shared).join(shared, "band"), "members")
    lows = members.groupBy("band").agg(F.min("lid").alias("low"))
    pivots = stage(members.join(lows, "band").where("lid <> low").select(F.col("lid").alias("a"), F.col("low").alias("b")).distinct(), "pivots")
    wanted = stage(members.select("lid").distinct(), "wanted")
    held = stage(packed(passing(lines, "lid", wanted).join(wanted, "lid")), "held")
    texts = stage(passing(line_rows(docs).select("lid", "line"), "lid", wanted).groupBy("lid").agg(F.min("line").alias("line")), "texts")
    sweep(docs.sparkSession)
    edges, labels, done = [], None, []
    for step in ("least", "low", "rest"):
        if step == "rest":
            pairs = across(members, held, texts, labels, percent)
        else:
            pairs = pivots.groupBy("a").agg(F.min("b").alias("b")) if step == "least" else pivots
            if labels is not None:
                pairs = placed(placed(pairs, labels, "a", "x"), labels, "b", "y").where("x <> y").select("a", "b")
            pairs = agreeing(pairs, held)
        if done:
            pairs = pairs.join(reduce(DataFrame.union, done), ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        done.append(pairs)
        if pairs.isEmpty():
            continue
        edges.append(stage(verified(pairs, texts, percent), "links"))
        if labels is not None:
            unstage(labels)
        labels = stage(connected_components(reduce(DataFrame.union, edges)), "labels")
    for x in (shared, members, pivots, wanted, held, texts, *done, *edges):
        unstage(x)
    sweep(docs.sparkSession)
    return labels


def dropped_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark and dropped (numbers, in order) of the texts that lose lines."""
    rows = stage(line_rows(docs).select("doc_id", "mark", "no", "lid"), "rows")
    lines = stage(signatures(docs), "lines")
    sweep(docs.sparkSession)
    labels = line_components(docs, lines, percent)
    unstage(lines)
    several = rows.groupBy("lid").agg(F.count("*").alias("n")).where("n > 1").select("lid")
    if labels is not None:
        several = several.union(labels.select(F.col("node").alias("lid"))).distinct()
    several = stage(placed(several, labels, "lid", "component"), "several")
    found = stage(passing(rows, "lid", several.select("lid")).join(several, "lid").select("doc_id", "mark", "no", "component"), "found")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "mark", "no")).alias("keep"))
    gone = found.join(first, "component").where(~F.struct("doc_id", "mark", "no").eqNullSafe(F.col("keep")))
    out = stage(gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("no")).alias("dropped")), "dropped")
    for x in (rows, several, found, *([] if labels is None else [labels])):
        unstage(x)
    sweep(docs.sparkSession)
    return out


def with_dropped(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs with `dropped`, the numbers of the lines that go (an empty list where none does)."""
    own = docs.withColumn("__mark", F.xxhash64("text"))
    d, g = own.alias("d"), dropped.select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__m"), "dropped").alias("g")
    joined = d.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.__doc")) & (F.col("d.__mark") == F.col("g.__m")), "left")
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns if c != "dropped"], F.coalesce("g.dropped", F.array().cast("array<int>")).alias("dropped"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id long, text) with n_lines, dropped, and text without the dropped lines.

    A line of MIN_CHARS characters or more goes if a similar one (Jaccard similarity of character shingles, percent or
    more, directly or over others) comes first by (doc_id, hash of the text, line number), null ids before all; shorter
    lines stay. Lines of any length count whole. Null texts stay null with no line. Rows that share an id but not the
    text are different places; rows that repeat each other's id and text are one, and treated alike. An empty table
    gives no rows; other columns pass through; columns named n_lines or dropped are replaced.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("n_lines", "dropped")])
    marked = with_dropped(docs, dropped_lines(docs.select("doc_id", "text"), percent))
    split = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("dropped"))
    kept = F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")
    return marked.withColumn("n_lines", F.coalesce(F.size(split), F.lit(0))).withColumn("text", F.when(F.size("dropped") == 0, F.col("text")).otherwise(kept))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and the dropped lines' numbers, of every document; texts are not shuffled for this."""
    docs = docs.select("doc_id", "text")
    thin = docs.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"))
    dropped = dropped_lines(docs)
    own = thin.select("doc_id", F.xxhash64("text").alias("mark"), "n_lines").alias("d")
    joined = own.join(dropped.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.mark") == F.col("g.mark")), "left")
    gone = F.coalesce("g.dropped", F.array().cast("array<int>"))
    return joined.select("d.doc_id", "d.n_lines", (F.col("d.n_lines") - F.size(gone)).alias("n_kept"), F.array_join(gone.cast("array<string>"), ",").alias("dropped"))
