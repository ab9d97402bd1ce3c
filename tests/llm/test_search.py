import numpy as np

from tidewatch.llm import search
from tidewatch.llm.forest import nearest
from tidewatch.llm.topk import exact_top

NAN, INF = float("nan"), float("inf")


def rows(n, width, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[rng.random(x.shape) < 0.1] = 0
    x[n // 3 : 2 * n // 3] = x[0]  # one vector makes a third of all
    return [(i, v.tolist()) for i, v in enumerate(x)]


EDGES = [(None, [1.0] * 8), (50, None), (100, [None] * 8), (150, [NAN] * 8), (200, [INF] * 8), (250, []), (300, [0.0] * 8), (350, [3e38] * 8), (400, [-2.0, 1.0])]


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<float>, rank int")


def brute(data, every, k, scale):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ok = [(i, scale(np.pad(v, (0, 8 - len(v))))) for i, v in ok]
    out = {}
    for i, v in ok:
        if i % every == 0:
            s = sorted(((-float((v * w).sum()), j) for j, w in ok if j != i))[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_exact(spark, monkeypatch):
    data = [(i, v) for i, v in rows(600, 8) if i not in {e[0] for e in EDGES}] + [e for e in EDGES if e[0] != 350]
    want = brute(data, 50, 5, lambda v: np.floor(256 * v))
    for block in (search.BLOCK_ROWS, 64):
        monkeypatch.setattr(search, "BLOCK_ROWS", block)
        assert result(exact_top(frame(spark, data).repartition(3))) == want
    assert exact_top(frame(spark, EDGES)).count() > 0
    assert exact_top(frame(spark, EDGES).limit(0)).count() == 0


def test_forest(spark):
    data = [(i, v) for i, v in rows(4000, 8, 2) if i not in {e[0] for e in EDGES}] + EDGES
    got = result(nearest(frame(spark, data).repartition(2)))
    want = brute([d for d in data if d[1] and any(d[1])], 20, 20, lambda v: v)
    assert got.keys() == want.keys()
    hit = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    exact = {i: dict(w) for i, w in brute([d for d in data if d[1] and any(d[1])], 20, 10**6, lambda v: v).items()}
    assert all(abs(exact[i][j] - s) <= 1e-9 * max(1, abs(s)) for i in got for j, s in got[i])
    assert [j for j, _ in got[0]] == [j for j, _ in want[0]]  # a third of all rows tie
    assert nearest(frame(spark, EDGES).limit(0)).count() == 0


def test_exact_with_large_components(spark):
    big, huge = float(1 << 21), float(1 << 22)
    data = [(i, v) for i, v in rows(120, 8)] + [(200, [big, 3.0] + [0.0] * 6), (201, [huge, 1.0] + [0.0] * 6), (202, [-huge, 5.0] + [0.0] * 6), (250, [3e38] * 8)]
    got = result(exact_top(frame(spark, data).repartition(2)))
    for i in (0, 50, 100, 200, 250):
        q = [int(np.floor(256 * float(np.float32(x)))) for x in dict(data)[i]]
        exact = {j: sum(a * int(np.floor(256 * float(np.float32(b)))) for a, b in zip(q, v, strict=True)) for j, v in data if j != i}
        exact = {j: min(2**63 - 1, max(1 - 2**63, s)) for j, s in exact.items()}
        assert got[i] == sorted(exact.items(), key=lambda x: (-x[1], x[0]))[:5]


def test_forest_recall_on_the_tables(spark):
    """At the width and on the rows of `embeddings`, against brute force over all queries."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = table.transform(nearest).toPandas()
    vectors = table.where("embedding IS NOT NULL").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x, ids = np.stack(vectors["embedding"].to_numpy()).astype(float), vectors["vec_id"].to_numpy()
    hit = total = 0
    for query, found in got.groupby("query_id"):
        score = x @ x[np.searchsorted(ids, query)]
        score[np.searchsorted(ids, query)] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]])
        hit, total = hit + len(best & set(found["vec_id"])), total + len(best)
    assert total == 20 * got["query_id"].nunique() and hit >= 0.9 * total
