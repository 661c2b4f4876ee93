"""Queries of the text problems, pN_..., and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import mixing, reading, tokens

Query = Callable[[SparkSession, str], DataFrame]


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(p8_selection(spark, d), table(spark, d, "mix_targets"))


def p8_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Targets of sources, languages and topics with the shares reached, and how the raking ended."""
    mix = mixing.raked_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.reached_marginals(mix, mixing.draw(mix))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).select("doc_id", "level")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels with the measures of surprisal they come from."""
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p7_ids, p8_selection, p8_shares, p8_marginals, p9_found, p9_levels)}
SQL: dict[str, str] = {}
