import random

import corpus_pipeline
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_mixing import fill_by_rounds
from tests.llm.test_near import brute as brute_groups
from tests.llm.test_near import WORD
from tidewatch.llm.packing import piece_lengths
from tidewatch.llm.tokens import tokenizer_file

SYLLABLES = {"en": "th er on an re he in ed nd ha at en", "es": "os ar ue ra de co qu ci do as mi el"}


def corpus():
    rng = random.Random(4)
    rows = []
    for d in range(240):
        lang = rng.choice(["en", "es"])
        say = lambda n: " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))  # noqa: E731, B023
        rows.append([d, "\n".join(say(rng.choice([3, 12, 40])) for _ in range(rng.randint(1, 4))), lang if d % 9 else None, f"s{d % 5}" if d % 11 else None])
    for d in range(240, 300):
        text = rows[d - 200][1]
        rows.append([d, text if d % 2 else text.replace(" th", " er", 1), rows[d - 200][2], "s1"])
    rows += [[300, None, "en", "s0"], [301, "123 456", "en", "s0"], [302, "", None, None]]
    return [(*r, len(r[1] or "")) for r in rows]


def test_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(d, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t)]
    lines = [(d, t) for d, n, gone, t in brute_lines(kept) if not n or len([x for x in gone.split(",") if x]) < n]
    groups = {d: c for d, _, c in brute_groups(lines, 5)}
    docs = {d: t for d, t in lines if groups[d] == d}
    source = {r[0]: r[3] for r in rows}
    sizes = {}
    for d, t in docs.items():
        sizes[source[d]] = sizes.get(source[d], 0) + len(WORD.findall(t))
    target = fill_by_rounds(sizes)
    tokenizer = Tokenizer.from_file(tokenizer_file())
    taken, longest = {}, 0
    for d in {r["doc_id"] for r in got}:
        pieces = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == d)
        want = piece_lengths(len(tokenizer.encode(docs[d], add_special_tokens=False).ids) + 1)
        copies = len(pieces) // len(want)
        assert sorted(p[1] for p in pieces) == sorted(want * copies) and 1 <= copies <= 3
        n = len(WORD.findall(docs[d]))
        taken[source[d]], longest = taken.get(source[d], 0) + copies * n, max(longest, n)
    assert all(abs(taken.get(s, 0) - target[s]) <= longest for s in target)
    assert len({r["sequence_id"] for r in got}) == len(got)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs.limit(0), "").columns == docs.columns
    assert corpus_pipeline.STAGES[0][1](spark, docs, "").where("lang IS NULL").count() == 0


def test_stages_with_edge_rows(spark):
    """Nulls, repeats, shared ids, one long text and columns that are named as results."""
    long = "word " * 60_000
    rows = [(None, None, None, None, None), (None, "", "en", "s", 0), (1, "the same text here and there", "en", None, 28), (1, "the same text here and there", "en", None, 28), (None, "the same text here and there", None, "s", 28), (2, long, "en", "s", None), (3, "99", "en", "s", 2)]
    docs = spark.createDataFrame([(*r, "x", 0.5, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, size int")
    kept = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, kept, "")
        assert out.columns == docs.columns
        kept = spark.createDataFrame(out.collect(), docs.schema)
    assert {r["lang_pred"] for r in kept.collect()} == {"x"}
    texts = {r["text"] for r in kept.collect()}
    assert long in texts and None not in texts and "99" not in texts
    out = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    assert {r["doc_id"] for r in out} >= {2}


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9), (2, "12", None, "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
