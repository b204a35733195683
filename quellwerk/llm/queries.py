"""Queries of the training-data operators and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quellwerk.llm.encode import token_ids
from quellwerk.llm.language import language_cases
from quellwerk.llm.mixing import mix
from quellwerk.llm.neardup import same_article_groups, same_article_pairs
from quellwerk.llm.pages import furniture
from quellwerk.llm.residue import residue
from quellwerk.llm.sentences import sentences
from quellwerk.llm.store import near_rows, repeated_rows
from quellwerk.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat an article accepted before."""
    return repeated_rows(table(spark, sf_dir, "uebersetzungen"))


def p1_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text is a near copy of one accepted before, by the bits of its fingerprint."""
    return near_rows(table(spark, sf_dir, "uebersetzungen"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that are page furniture."""
    return furniture(table(spark, sf_dir, "uebersetzungen"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with template residue, filler, error messages or script notices."""
    return residue(table(spark, sf_dir, "uebersetzungen"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows with the same article."""
    pages = table(spark, sf_dir, "uebersetzungen")
    return same_article_pairs(pages, residue(pages))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its class of exact copies and the number of classes with the same article."""
    pages = table(spark, sf_dir, "uebersetzungen")
    return same_article_groups(pages, residue(pages))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a missing or wrong label, and paragraphs in another language than their row's."""
    return p6_languages(spark, sf_dir).drop("konfidenz")


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the confidence of each."""
    pages = table(spark, sf_dir, "uebersetzungen")
    return language_cases(pages, table(spark, sf_dir, "sprachproben"), residue(pages))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return token_ids(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in the mix."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mischziele"))[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mischziele"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document."""
    return sentences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_near, p2_found, p4_found, p5_found, p5_groups, p6_found, p6_languages, p7_ids, p8_mix, p8_report, p9_found)}


def oracle_sql() -> dict[str, str]:
    return {}
