import random

from pyspark.sql import functions as F

from tidewatch.llm import lines
from tidewatch.llm.lines import MIN_CHARS, bands_of, dedup_lines, line_components, line_report, signatures


def grams(line):
    return {line[i : i + 5] for i in range(len(line) - 4)}


def brute(rows):
    """Kept line numbers of each row, by all pairs of different lines."""
    seen = {}
    for d, t in rows:
        for no, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(line) >= MIN_CHARS:
                seen.setdefault(line, []).append((-1 if d is None else d, no))
    names = sorted(seen)
    up = {x: x for x in names}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {x: grams(x) for x in names}
    for i, x in enumerate(names):
        for y in names[:i]:
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                up[find(x)] = find(y)
    first = {}
    for x in names:
        first[find(x)] = min(min(seen[x]), first.get(find(x), min(seen[x])))
    out = []
    for d, t in rows:
        parts = t.split("\n") if t is not None else []
        gone = [no for no, x in enumerate(parts) if len(x) >= MIN_CHARS and first[find(x)] != (-1 if d is None else d, no)]
        out.append((d, len(parts), ",".join(map(str, gone)), None if t is None else "\n".join(x for no, x in enumerate(parts) if no not in gone)))
    return out


def corpus():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 8, 30]))) for _ in range(60)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.choice([2, 10, 40])))
            if rng.random() < 0.4 and len(line) > 60:
                at = rng.randrange(len(line))
                line = line[:at] + "X" + line[at + 1 :]
            parts.append(line)
        rows.append((d, "\n".join(parts)))
    common = "this passage stands in a great many of all the documents that there are"
    rows += [(1000 + i, f"{common}\nown line {i}") for i in range(60)]
    return rows + [(5000, None), (5001, ""), (5002, "\n\n"), (None, common), (5003, "z" * 200_000), (5004, "z" * 200_000), (5005, "日本語" * 20), (5006, "日本語" * 20 + "。")]


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, dropped int").repartition(3)
    want = brute(rows)
    got = line_report(df).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["dropped"]) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    assert all(r["n_kept"] == r["n_lines"] - len([x for x in r["dropped"].split(",") if x]) for r in got)
    texts = dedup_lines(df)
    assert sorted(((r["doc_id"], r["text"]) for r in texts.collect()), key=str) == sorted(((w[0], w[3]) for w in want), key=str)
    assert line_report(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a line that is long enough to take part\nshort")] * 2, "doc_id long, text string")
    assert "Python" not in line_report(df)._jdf.queryExecution().toString()


def shifted(rng, line, percent):
    """A copy without the first and with other last characters, at or just above the similarity."""
    k = max(j for j in range(len(line) - 4) if 100 * (len(line) - 4 - j) >= percent * (len(line) - 4 + j))
    return line[k:] + "".join(rng.choice("ABCDEFGHIJ") for _ in range(k))


def share_meeting(spark, pairs):
    """The share of the pairs that meet in a band."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sum(map(list, pairs), []))], "doc_id long, text string")
    named = signatures(df).select("lid", bands_of().alias("bands")).join(df.select("doc_id", F.xxhash64("text").alias("lid")), "lid")
    found = {r["doc_id"]: set(r["bands"]) for r in named.collect()}
    return sum(bool(found[2 * i] & found[2 * i + 1]) for i in range(len(pairs))) / len(pairs)


def test_pairs_near_the_threshold_meet(spark):
    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    scripts = [lambda: "".join(chr(rng.randrange(a, b)) for _ in range(90)) for a, b in ((0x1780, 0x17B0), (0x4E00, 0x5E00), (0x0E81, 0x0EB0), (97, 123))]
    made = [say(n) for n in (6, 9, 16, 33, 120) for _ in range(300)] + [f() for f in scripts for _ in range(200)]
    assert share_meeting(spark, [(x, shifted(rng, x, 80)) for x in made]) >= 0.985
    assert share_meeting(spark, [(x, shifted(rng, x, 86)) for x in made]) >= 0.997


def test_lines_without_blanks_meet_beyond_their_start(spark):
    rng = random.Random(8)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(200)) for _ in range(100)]
    tabs = ["\t".join("".join(rng.choice("ghijklmnop") for _ in range(6)) for _ in range(28)) for _ in range(100)]
    lao = ["".join(chr(rng.randrange(0x0E81, 0x0EB0)) for _ in range(200)) for _ in range(100)]
    pairs = [(x, "#" + x[1:]) for x in hexes + tabs + lao]
    assert share_meeting(spark, pairs) == 1


def test_short_lines_take_part(spark):
    rows = [(1, "All rights reserved.\nMenu\nfirst words"), (2, "All rights reserved.\nMenu\nShare this article"), (3, "Share this article\nabcdefgh"), (4, "abcdefgh\nabcdefghi")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["dropped"] for r in line_report(df).collect()}
    assert got == {1: "", 2: "0", 3: "0", 4: "0,1"}  # the last: 4 of 5 shingles are shared; "Menu" is shorter than a shingle


def test_last_step_finds_what_pivots_miss(spark, monkeypatch):
    monkeypatch.setattr(lines, "AGREE", 6)
    rng = random.Random(9)
    chains = []
    for i in range(300):
        line = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)]
        for at in (None, 10, 30, 50):  # neighbours share 51 of 61 shingles, others 46 of 66 or less
            line = line if at is None else [*line[:at], "#", *line[at + 1 :]]
            chains.append((i, at or 0, "".join(line)))
    rows = spark.createDataFrame(chains, "i long, at long, line string").withColumn("lid", F.xxhash64("line")).orderBy("i", "at").collect()
    chain = next(c for c in (rows[k : k + 4] for k in range(0, len(rows), 4)) if [r["lid"] for r in c] == sorted(r["lid"] for r in c))

    def sig(own, *bands):  # the bands named share their coordinates with all that name them, the others are the line's own
        out = [own * 100 + k for k in range(lines.COORDINATES)]
        for b in bands:
            for r in lines.RULER:
                out[(b * lines.COORDINATES // lines.BANDS + r) % lines.COORDINATES] = -1000 - b * 10 - r
        return out

    low, m1, m2, high = (r["lid"] for r in chain)
    made = spark.createDataFrame([(low, sig(1, 0)), (m1, sig(2, 0)), (m2, sig(3, 0)), (high, sig(4, 0, 13))], "lid long, sig array<short>")
    docs = spark.createDataFrame([(k, r["line"]) for k, r in enumerate(chain)], "doc_id long, text string")
    assert {r["component"] for r in line_components(docs, made).collect()} == {low}


def test_large_band_in_blocks(spark, monkeypatch):
    """Many lines that begin alike fall into few bands; blocks of two rows find the same links as brute force."""
    monkeypatch.setattr(lines, "BLOCK", 2)
    monkeypatch.setattr(lines, "RULER", (0,))
    monkeypatch.setattr(lines, "AGREE", 10)
    rng = random.Random(4)
    stem = "".join(rng.choice("abcdefghij") for _ in range(120))
    rows = [(i, stem[: 120 - 12 * (i % 5)] + "".join(rng.choice("klmnop") for _ in range(12 * (i % 5) + i % 3))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["dropped"] for r in line_report(df).collect()} == {w[0]: w[2] for w in brute(rows)}


def test_rows_that_share_an_id(spark):
    line = "the very same line, long enough to count"
    rows = [(1, f"{line}\none tail here"), (1, f"{line}\nother end there"), (1, f"{line}\nother end there"), (None, None), (None, None)]
    got = sorted((r["n_lines"], r["dropped"]) for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got in ([(0, ""), (0, ""), (2, ""), (2, "0"), (2, "0")], [(0, ""), (0, ""), (2, ""), (2, ""), (2, "0")])


def test_band_hashes_are_short(spark):
    df = spark.createDataFrame([(1, "a line that is long enough to take part"), (2, "another one that is quite different")], "doc_id long, text string")
    found = lines.banded(signatures(df)).collect()
    assert len({r["band"] for r in found}) == 2 * lines.BANDS and all(0 <= r["band"] < 1 << 48 for r in found)
