import random

from pyspark.sql import functions as F

from tidewatch.llm.language import fit, held_out, identify, predict

SYLLABLES = {"en": "th er on an re he in ed nd ha at en", "es": "os ar ue ra de co qu ci do as mi el", "fr": "ou ai eau é le tre ment la ç è", "日": "日 本 語 の は 東 京"}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=700):
    rng = random.Random(6)
    rows = []
    for d in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((d, say(rng, lang, rng.choice([4, 30, 200])), lang if d % 10 else None))
    return rows


def test_held_out_accuracy(spark):
    """Held-out rows are told without their label, source or id; on sf0.1's documents the same measure is 0.999."""
    rows = corpus()
    truth = {d: lang for d, _, lang in rows if lang}
    out = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows) and {r["lang_pred"] for r in out} == set(SYLLABLES)
    asked = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(asked) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in asked) > 0.95 * len(asked)
    assert all(0 < r["score"] <= 1 for r in out)


def test_draw_does_not_hang_on_ids_or_partitions(spark):
    rows = corpus(300)
    frames = [spark.createDataFrame([(i, t, x) for _, t, x in rows], "doc_id long, text string, lang string") for i in (None, 7)]
    for df in (*frames, frames[0].repartition(5)):
        net = fit(df)
        assert net.langs == sorted(SYLLABLES)
        assert {r["lang_pred"] for r in predict(df, net).collect()} == set(SYLLABLES)
    a, b = fit(frames[0]), fit(frames[0].repartition(5))
    assert (a.filters == b.filters).all()


def test_every_language_is_learned(spark):
    df = spark.createDataFrame([(i, f"text {i}" if i % 3 else "the same text", f"l{i % 290:03d}") for i in range(1200)], "doc_id long, text string, lang string")
    assert len(fit(df, max_docs=600).langs) == 290
    same = spark.createDataFrame([(1, "all of these rows are one", "en")] * 400, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in predict(same, fit(same, max_docs=1)).collect()} == {"en"}


def test_edges(spark):
    rows = [*corpus(60), (None, None, "en"), (900, "", "en"), (901, "123 !?", "es"), (902, "x" * 300_000, None), (903, "y", None), (903, "y", None)]
    df = spark.createDataFrame([(*r, "kept", 5) for r in rows], "doc_id long, text string, lang string, lang_pred string, has_letter int")
    net = fit(df.where(~held_out()))
    out = predict(df, net)
    assert out.columns == ["doc_id", "text", "lang", "has_letter", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows) and {r["has_letter"] for r in got} == {5}
    assert all((r["lang_pred"] == "und" and r["score"] == 0) == (not r["text"] or not any(c.isalpha() for c in r["text"])) for r in got)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 903}) == 1
    assert predict(df.limit(0), net).count() == 0 and identify(df.limit(0)).count() == 0
    assert fit(df.where("lang IS NULL")) is None and {r["lang_pred"] for r in predict(df, None).collect()} == {"und"}
    assert df.where(F.col("doc_id") == 902).count() == 1
