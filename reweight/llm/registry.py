"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import reweight
from reweight.llm import audit, interpolation, mixing, neighbours, packing, parsing, passages, pii, simhash, slots, tokens, toxicity, variants


def over(op, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    """The operator's query over whole tables of a folder."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        reweight.attach(spark)
        return op(spark, *[spark.read.parquet(f"{sf}/{t}.parquet") for t in tables])

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_multiprobe_neighbours": over(neighbours.query, "embeddings"),
        "op2_parse_fingerprints": over(parsing.query, "documents"),
        "op3_personal_data": over(pii.query, "documents"),
        "op4_token_counts": over(tokens.query, "documents"),
        "op5_source_mixing": over(mixing.query, "documents"),
        "op6_repeated_passages": over(passages.query, "documents"),
        "op7_simhash": over(simhash.query, "documents"),
        "op8_toxicity": over(toxicity.query, "documents", "labels"),
        "op9_packing": over(packing.query, "documents"),
        "op10_virtual_slots": over(slots.query, "documents"),
        "op11_filter_audit": over(audit.query, "documents", "labels"),
        "op12_interpolated_scores": over(interpolation.query, "documents"),
        "op13_spelling_variants": over(variants.query, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_source_mixing": mixing.sql(), "op11_filter_audit": audit.sql()}
