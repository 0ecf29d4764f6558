"""The thin queries of the ten operators over the driver's tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import digests, format_conversations
from .decontamination import find_contamination
from .html_extract import extract_main_text
from .language_id import fit, identify
from .lm_scoring import score_texts
from .mixing import mix_sources
from .pii import sanitise, span_digests
from .quality_rules import score_quality
from .simhash_dedup import near_duplicates
from .substring_dedup import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "source", "size", "source_size", "target", "taken")


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op2_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return digests(format_conversations(turns.unionByName(control)))


def op3_find_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), reject_toxic=True)


def op5_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_sanitise_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(sanitise(table(spark, sf_dir, "documents")))


def fold(id_col: str = "doc_id"):
    """The fold of an id; that of a null id is that of an empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5


def op9_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, training=fold() != 0))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "margin", "ambiguous")


def op10_score_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), training=fold() != 1)
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_format_chat, op3_find_contamination, op4_quality_rules, op5_extract_html, op6_remove_repeats, op7_near_duplicates, op8_sanitise_pii, op9_identify_language, op10_score_lm)
}

def _escaped(column: str, *more: str) -> str:
    """Length of an escaped string: one more for each special character."""
    return f"(length({column}) + " + " + ".join(f"(length({column}) - length(replace({column}, {c}, '')))" for c in ("'<'", "'['", "chr(92)", *more)) + ")"


ORACLE_SQL = {
    "op2_format_chat": f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(7 + sum(14 + {_escaped("role", "']'")} + {_escaped("text")}) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id""",
}
