"""The pN_ queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import boilerplate, mix, mojibake, pieces, residue, sentences, stuffing, tokens, truncation
from spanloom.sources.tables import table

RECORD = ["case_id", "document_id"]


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "case_documents").select(*RECORD, "text", "title", "url", "publisher")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.find_boilerplate(_pages(spark, d), RECORD)


def p1_main(spark: SparkSession, d: str) -> DataFrame:
    """The main content of every record, once."""
    return boilerplate.extract_main(_pages(spark, d), RECORD).groupBy(*RECORD).agg(F.first("main").alias("main"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(_pages(spark, d), RECORD)


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    """``field_name, case_id, document_id, restored`` of all affected values of both fields, copies included."""
    texts = table(spark, d, "case_documents").select(*RECORD, F.col("text").alias("value"))
    listed = table(spark, d, "catalog").select("case_id", F.explode("documents").alias("x"))
    titles = listed.select("case_id", F.col("x.id").alias("document_id"), F.col("x.title").alias("value"))
    stats = mojibake.associations(texts.select("value").unionByName(titles.select("value")), "value")
    found = [mojibake.repair_values(v, RECORD, "value", stats, cut).withColumn("field_name", F.lit(n)) for n, v, cut in (("text", texts, True), ("title", titles, False))]
    return found[0].unionByName(found[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("field_name", *RECORD).distinct()


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected values with the original text, null where bytes were lost."""
    return _garbled(spark, d).groupBy("field_name", *RECORD).agg(F.first("restored").alias("restored"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "case_documents").select(*RECORD, "layout", "text")
    found = pieces.split_oversized(documents, table(spark, d, "piece_limits"), RECORD, with_text=False)
    return found.where("n_pieces > 1").select(*RECORD).distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all records, with their text."""
    documents = table(spark, d, "case_documents").select(*RECORD, "layout", "text")
    found = pieces.split_oversized(documents, table(spark, d, "piece_limits"), RECORD)
    return found.dropDuplicates([*RECORD, "piece_no"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


def p6_cases(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of the case documents, once per record."""
    rows = table(spark, d, "case_documents").select(F.struct(*RECORD).alias("record"), "text", "lang")
    found = sentences.sentence_units(rows, "record")
    return found.select("record.*", "start_off", "end_off").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.score_records(_pages(spark, d), RECORD).where("is_cut").select(*RECORD).distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Records and cut records per publisher."""
    records = truncation.score_records(_pages(spark, d), RECORD).groupBy(*RECORD).agg(F.first("publisher").alias("publisher"), F.max("is_cut").alias("is_cut"))
    return records.groupBy("publisher").agg(F.count("*").alias("n_records"), F.count_if("is_cut").alias("n_cut")).withColumn("cut_rate", F.round(F.col("n_cut") / F.col("n_records"), 6))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document with their code-point spans, and whether decoding restored the text."""
    return tokens.encode_with_offsets(table(spark, d, "documents")).select("doc_id", F.size("ids").alias("n_tokens"), "starts", "ends", "restored")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix, as long as the documents with targets are together."""
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached and reasons for shortfalls."""
    return mix.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.find_stuffed(table(spark, d, "documents"))


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    """Pages by script and kind of spam, with mean compression ratios."""
    scored = stuffing.score_pages(table(spark, d, "documents"))
    return scored.groupBy("script", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n_pages"), F.round(F.avg("ratio"), 4).alias("mean_ratio"), F.round(F.avg("redundancy"), 3).alias("mean_redundancy"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_main, p2_found, p4_found, p4_restored, p5_found, p5_pieces, p6_found, p6_cases, p7_found, p7_report, p8_ids, p8_offsets, p9_mix, p9_shares, p10_found, p10_report)
}

ORACLE_SQL = {
    "p5_found": """
        SELECT DISTINCT c.case_id, c.document_id FROM case_documents c
        JOIN (SELECT layout, min(max_chars) AS max_chars FROM piece_limits GROUP BY layout) l ON c.layout = l.layout
        WHERE length(c.text) > l.max_chars""",
}
