"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pedigree.llm import chosen_path, chroma, context_mixing, conversation_repair, decontaminate, html_extract, license_scan, mixing, periodic_runs, quality, secret_scan, substring_dedup, toxicity
from pedigree.llm.common import cut, table


#: Target weights of the production mix; sources that are not named share the last one.
MIX_WEIGHTS = {f"src{i}": 20 + 5 * (i % 7) for i in range(20)}
MIX_OTHER, MIX_BLOCK = 25, 32


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents", "doc_id", "source"), MIX_WEIGHTS, MIX_OTHER, MIX_BLOCK).drop("source")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept_text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op6_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio: each vector is rendered as a recording, and queries are the rows whose id 50 divides."""
    prints = cut(chroma.fingerprints(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", chroma.render))
    return chroma.identify(prints)


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audited(conversation_repair.damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pfair_mix": op1_pfair_mix,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_cotraining": op5_quality_cotraining,
    "op6_chroma_fingerprints": op6_chroma_fingerprints,
    "op7_chosen_path": op7_chosen_path,
    "op8_context_mixing": op8_context_mixing,
    "op9_decontaminate": op9_decontaminate,
    "op10_html_extract": op10_html_extract,
    "op11_license_scan": op11_license_scan,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_pfair_mix": mixing.oracle(MIX_WEIGHTS, MIX_OTHER, MIX_BLOCK),
    "op2_substring_dedup": substring_dedup.oracle(),
}
