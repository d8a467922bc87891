"""Queries of the training-data operators, and the SQL some of them are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segno.llm.bpe import encode_corpus
from segno.llm.entities import album_matches
from segno.llm.language import fit, language_stretches, page_languages, wrong_labels
from segno.llm.leaks import find_leaks
from segno.llm.lookalike import disguised_names
from segno.llm.runs import repeated_plays
from segno.llm.together import all_artists_together, artists_together
from segno.llm.top_n import top_artists_by_month
from segno.sources.tables import table

#: Where the public vocabulary file lies on this machine; a parameter of p8_ids.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return repeated_plays(table(spark, d, "plays"), table(spark, d, "artists"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_runs(spark, d).select("username", "first_uts", "last_uts")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return all_artists_together(table(spark, d, "plays"), table(spark, d, "artists")).withColumnsRenamed({"a": "artist_id_a", "b": "artist_id_b"})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return artists_together(table(spark, d, "plays"), table(spark, d, "artists")).select(F.col("a").alias("artist_id_a"), F.col("b").alias("artist_id_b"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return top_artists_by_month(table(spark, d, "plays"), table(spark, d, "artists")).select("username", "play_month", "place", "artist_id")


def p4_names(spark: SparkSession, d: str) -> DataFrame:
    return disguised_names(table(spark, d, "plays"), table(spark, d, "releases"), table(spark, d, "critic_lists"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_names(spark, d).select("source_table", "row_id", "item_no")


def p8_ids(spark: SparkSession, d: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), vocabulary)


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p10_stretches(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return language_stretches(documents, fit(documents))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_labels(page_languages(p10_stretches(spark, d))).select("doc_id", "lang")


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    return album_matches(table(spark, d, "plays"), table(spark, d, "critic_lists"), table(spark, d, "releases"), table(spark, d, "artists"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).select("source_table", "artist", "title", "release_id")


QUERIES = {"p1_found": p1_found, "p1_runs": p1_runs, "p2_found": p2_found, "p2_pairs": p2_pairs, "p4_found": p4_found, "p4_names": p4_names, "p5_found": p5_found, "p5_matches": p5_matches, "p6_found": p6_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_stretches": p10_stretches}
SQL: dict[str, str] = {}
