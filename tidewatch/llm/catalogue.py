"""The opN_ queries and the pipeline, with their SQL where there is any."""

from __future__ import annotations

import importlib

from tidewatch.llm import mixing, topk
from tidewatch.llm.common import table
from tidewatch.llm.forest import nearest
from tidewatch.llm.html import page_texts
from tidewatch.llm.language import identify
from tidewatch.llm.lines import line_report
from tidewatch.llm.near import near_duplicates
from tidewatch.llm.packing import pack_report
from tidewatch.llm.sstable import sstable_report
from tidewatch.llm.warc import archive_report


def op1_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark, sf_dir):
    return page_texts(table(spark, sf_dir, "pages"))


def op3_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark, sf_dir):
    return topk.exact_top(table(spark, sf_dir, "embeddings"))


def op5_warc(spark, sf_dir):
    return archive_report(table(spark, sf_dir, "pages"))


def op6_packing(spark, sf_dir):
    return pack_report(table(spark, sf_dir, "documents"))


def op7_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op8_line_dedup(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents"))


def op9_token_shards(spark, sf_dir):
    return sstable_report(table(spark, sf_dir, "documents"))


def op10_hash_forest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    pipeline = importlib.import_module("corpus_pipeline")
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE, "op4_exact_topk": topk.ORACLE}
