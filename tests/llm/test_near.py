import random
import re

import numpy as np
import pyarrow as pa

from tidewatch.llm import words
from tidewatch.llm.near import BlockPairs, near_duplicates, without_near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k):
    sets = [(d, shingles(t, k)) for d, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i), d)) for i, (d, s) in enumerate(sets)), key=str)


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 40, 200]))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            t = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.02, 0.05, 0.08]) else w for w in base]
            rows.append(rng.choice([" ", "\n", " \t "]).join(x.upper() if rng.random() < 0.1 else x for x in t))
    base = [rng.choice(vocabulary) for _ in range(100)]
    for _ in range(80):  # a group whose members are near the threshold of each other
        rows.append(" ".join(rng.choice(vocabulary) if rng.random() < 0.05 else w for w in base))
    rows += ["", None, " \n ", "x" * 3_000_000, "x" * 3_000_000, "É a", "é a", "same same same same same same same"] * 2
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    text = "Alpha beta gamma ALPHA " + "y" * 5000 + " beta"
    for chunk in (1 << 20, 64):
        monkeypatch.setattr(words, "CHUNK", chunk)
        words.tables.cache_clear()
        body = np.frombuffer((text + text).encode(), np.uint8)
        h, n = words.word_hashes(body, np.array([0, len(text), 2 * len(text)]))
        assert n.tolist() == [6, 6] and (h[:6] == h[6:]).all() and h[0] == h[3] and h[1] == h[5] and len(set(h.tolist())) == 4
        keep = h if chunk > 64 else keep  # noqa: F821
    words.tables.cache_clear()


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for size in (1, 3, 50, 2000):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        s = words.fast_sketch([a, a.copy()], 128)
        assert (s[0] == s[1]).all() and (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    x = rng.integers(0, 2**63, 1500).astype(np.uint64)
    got = [np.equal(*words.fast_sketch([np.sort(p[:1000]), np.sort(p[500:])], 128)).mean() for p in (rng.permutation(x) for _ in range(30))]
    assert abs(np.mean(got) - 1 / 3) < 0.04


def test_groups_equal_brute_force(spark):
    for k in (2, 5):
        rows = corpus(seed=k)
        df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, n string").repartition(5)
        got = near_duplicates(df, k).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, k)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
        assert sorted(r["doc_id"] for r in without_near_duplicates(df, k).collect()) == sorted(r["doc_id"] for r in got if r["kept"])


def test_edges(spark):
    rows = [(None, "a b c d e f"), (None, "lone words here now and then"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A  b c d E f"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(None, 2, False), (None, None, True), (4, 2, False), (4, 2, False), (2, 2, True), (3, 3, True)], key=str)
    assert near_duplicates(df.limit(0), 2).count() == 0


def test_blocks_meet_pairs_whose_earlier_bands_agree_in_low_bytes_only():
    sketch = np.ones((2, 128), np.uint64)
    sketch[1, 0] += np.uint64(256)  # band 0 differs, though not in the low byte; band 1 is the first that is shared
    bands = words.band_hashes(sketch, 4)
    one, zero = pa.array([1, 1], pa.int32()), pa.array([0, 0], pa.int32())
    rows = {
        "band": pa.array([int(bands[0, 1])] * 2), "s": zero, "t": zero, "role": pa.array([0, 1], pa.int32()), "b": one, "rep": pa.array([10, 20]), "n": pa.array([3, 3]), "component": pa.array([10, 20]),
        "sketch": pa.array([x.astype(np.uint8).tobytes() for x in sketch], pa.binary()), "bands": pa.array(bands.tolist(), pa.list_(pa.int64())), "shingles": pa.array([np.arange(3, dtype=np.uint64).tobytes()] * 2, pa.binary()),
    }
    batch = pa.record_batch(list(rows.values()), names=list(rows))
    assert next(BlockPairs(80, False)(iter([batch]))).column("rep").to_pylist() == [10, 20]
    assert next(BlockPairs(80, True)(iter([batch]))).to_pylist() == [{"src": 10, "dst": 20}]


def test_one_row_of_each_group_stays(spark):
    text, other = "a b c d e f g h", "another text that has some words"
    rows = [(4, text), (4, text), (9, text), (None, text), (None, text), (None, other), (None, other), (7, "one id"), (7, "with two texts"), (None, None), (None, None), (3, ""), (3, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, node int")
    got = without_near_duplicates(df, 2)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(4, text), (None, other), (7, "one id"), (7, "with two texts"), (None, None), (None, None), (3, ""), (3, "")], key=str)
    assert without_near_duplicates(df.limit(0), 2).count() == 0
