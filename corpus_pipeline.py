"""From raw documents to packed sequences: language ID, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import ship
from tidewatch.llm.language import UNKNOWN, fit, held_out, predict
from tidewatch.llm.lines import dedup_lines
from tidewatch.llm.mixing import mixed_rows
from tidewatch.llm.near import without_near_duplicates
from tidewatch.llm.packing import pack_report
from tidewatch.storage import stage


LEAST_SCORE, SURE_SCORE = 0.3, 0.9


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: without text or a letter in it, or with a score below LEAST_SCORE. The
    predicted language fills a missing lang, and takes the place of another one from SURE_SCORE on.

    The network learns from labelled rows (a bounded sample, see fit); if there is none, only documents without a letter
    go. All windows of a text count, however long; repeated rows fare alike; other columns stay as they are, under any
    name; an empty table gives no rows.
    """
    ship(spark)
    net = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    found = predict(docs.select(*[F.col(f"`{c}`").alias(v) for c, v in own.items()]), net)
    lang = F.when(F.col(own["lang"]).isNull() | (F.col("score") >= SURE_SCORE), F.col("lang_pred")).otherwise(F.col(own["lang"]))
    told = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return told.select(*[(lang if c == "lang" else F.col(v)).alias(c) for c, v in own.items()])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents that consisted of them. n_chars follows the text. Null and empty texts, short
    lines and rows that repeat each other are treated as dedup_lines says; other columns stay as they are."""
    ship(spark)
    out = dedup_lines(docs).where("size(dropped) < n_lines OR n_lines = 0")
    chars = F.when(F.size("dropped") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long")).alias("n_chars")
    return out.select(*[chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays; rows without words, with
    null or shared ids and repeated rows are treated as without_near_duplicates says."""
    ship(spark)
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null sources, texts and ids and repeated rows as in mix."""
    ship(spark)
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of power-of-two lengths; null, empty and long texts and repeats as in pack."""
    ship(spark)
    return pack_report(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Language ID, banding and byte-pair encoding have no SQL form; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
