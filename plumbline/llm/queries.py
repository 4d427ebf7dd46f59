"""The pN_ queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import answer_defects, bpe, mixing, neighbours, offensive, pieces, repeated_lines, scan_noise, splits
from plumbline.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return scan_noise.scan_noise(table(spark, sf, "chunks"))


def p1_text(spark: SparkSession, sf: str) -> DataFrame:
    return scan_noise.readable_text(table(spark, sf, "chunks"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.tied_questions(table(spark, sf, "golden_generated"))


def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_questions(table(spark, sf, "golden_generated"))


def p2_split_shares(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_report(table(spark, sf, "golden_generated"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.oversized(table(spark, sf, "chunks"))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.oversized_pieces(table(spark, sf, "chunks"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf, "chunk_vectors"))


def p4_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "chunk_vectors"))


def p4_recall(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.search_recall(table(spark, sf, "chunk_vectors"))


def p4_links(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.linked_chunks(table(spark, sf, "chunk_vectors"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, sf, "chunks"))


def p5_templates(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines.line_templates(table(spark, sf, "chunks"))


def p5_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, sf, "chunks"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return answer_defects.first_defect(table(spark, sf, "gate_scores_v3_14b"), table(spark, sf, "golden_generated"))


def p6_labels(spark: SparkSession, sf: str) -> DataFrame:
    return answer_defects.all_labels(table(spark, sf, "gate_scores_v3_14b"), table(spark, sf, "golden_generated"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf, "documents"))


def p7_token_totals(spark: SparkSession, sf: str) -> DataFrame:
    sized = bpe.count_tokens(spread(table(spark, sf, "documents").select("source", "text")), ["source"])
    return sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return offensive.offensive_documents(table(spark, sf, "documents"), table(spark, sf, "doc_labels"))


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return offensive.score_documents(table(spark, sf, "documents"), table(spark, sf, "doc_labels"))


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return offensive.rates_by_source(table(spark, sf, "documents"), table(spark, sf, "doc_labels"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
