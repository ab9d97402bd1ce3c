from tidewatch.llm.mixing import mix, mixed_rows, water_fill


def fill_by_rounds(sizes, weights=(5, 2, 1), epochs=3):
    """Clamp and reshare until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > epochs * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
            open_.discard(s)
    return target


def test_water_fill_is_the_fixed_point(spark):
    for sizes in ({"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, None: 3}, {"a": 0, "b": 7, "c": 1, "d": 500, "é": 2, "z": 40}, {"a": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in water_fill(df).collect()}
        want = fill_by_rounds(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want), (got, want)


def test_mix(spark):
    rows = [(i, f"s{i % 4}" if i % 4 else None, "w " * (1 + i % 37), "x") for i in range(3000)] + [(None, "s1", None, "y"), (7, "s1", " \n", None), (7, "s1", " \n", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target string")
    out = mix(df).collect()
    assert len(out) == len(rows)
    for s in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 20
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    again = mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixed_rows(df).count() == sum(r["copies"] for r in out)
    assert mixed_rows(df).columns == df.columns
    assert mix(df.limit(0)).count() == 0


def test_rows_with_one_id_or_none_are_drawn_apart(spark):
    """Half of the rows lack an id, a source is one row repeated, another one text under many ids."""
    rows = [(None if i % 2 else i, "s1", f"{'w ' * (1 + i % 7)}{i}") for i in range(1500)]
    rows += [(7, "s2", "the very same row")] * 1001 + [(i, "s3", "one text, many ids") for i in range(400)] + [(None, "s4", f"x{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    runs = [mix(x).collect() for x in (df, df.repartition(3))]
    assert len({tuple(sorted(map(str, r))) for r in runs}) == 1
    for s in ("s1", "s2", "s3", "s4"):
        own = [r for r in runs[0] if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 8, s
