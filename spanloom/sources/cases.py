"""Case bundles as JSON: scans with a declared schema, digests, and a sink that leaves nothing stale behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "struct<id:string,title:string,url:string,layout:string,publisher:string,retrievedAt:string,sourceType:string,sourceDescriptor:string,excerptSha256:string,sourceSha256:string,text:string>"
CASE = f"id string, claim string, label string, displayTitle string, topics array<string>, challenges array<string>, featured boolean, origin string, category string, demoFocus string, documents array<{DOCUMENT}>, _corrupt_record string"


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cases of one JSON list or of files with one case each: the readable ones, and files that don't parse, by name."""
    rows = spark.read.schema(CASE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("_file", F.input_file_name())
    return rows.where("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record", "_file"), rows.where("_corrupt_record IS NOT NULL OR id IS NULL").select("_file", F.lit("UNREADABLE").alias("reason"))


def summaries(cases: DataFrame) -> DataFrame:
    """Cases without the text of their documents."""
    return cases.withColumn("documents", F.transform("documents", lambda x: x.dropFields("text")))


def documents(cases: DataFrame) -> DataFrame:
    """``case_id, doc_ord`` and the fields of each document."""
    return cases.select(F.col("id").alias("case_id"), F.posexplode("documents").alias("doc_ord", "x")).select("case_id", "doc_ord", "x.*")


def rejects(cases: DataFrame, markers: tuple[str, ...] = ()) -> DataFrame:
    """``case_id, reason`` of cases that break the contract: blank claims, no documents or more than eight, repeated ids, marked texts."""
    checks = {
        "BLANK_CLAIM": F.length(F.trim(F.coalesce("claim", F.lit("")))) == 0,
        "DOCUMENT_COUNT": ~F.coalesce(F.size("documents"), F.lit(0)).between(1, 8),
        "DUPLICATE_DOCUMENT": F.size(F.array_distinct(F.transform("documents", lambda x: x["id"]))) < F.size("documents"),
        "ANNOTATION_LEAK": F.exists("documents", lambda x: _any(x["text"], markers)),
    }
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    twice = cases.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("case_id"), F.lit("DUPLICATE_CASE").alias("reason"))
    return cases.select(F.col("id").alias("case_id"), F.explode(flags).alias("reason")).unionByName(twice)


def _any(text, markers: tuple[str, ...]):
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.coalesce(F.contains(text, F.lit(m)), F.lit(False))
    return hit


def bundle_digest(spark: SparkSession, folder: str, glob: str = "*.json") -> str:
    """SHA-256 over (name, NUL, digest of the bytes, NUL) of a bundle's files in the order of their names. Files are hashed where they are read; only their digests meet."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    names = rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("digest"))
    joined = names.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda x: F.concat(x["name"], F.lit("\0"), x["digest"], F.lit("\0"))), ""), 256))
    return joined.first()[0]


def write_cases(cases: DataFrame, folder: str) -> None:
    """One JSON line per case under ``id=...`` folders; an overwrite of the whole, so no earlier case stays behind."""
    cases.withColumn("case", F.col("id")).write.mode("overwrite").partitionBy("case").json(folder)


def manifest(cases: DataFrame) -> DataFrame:
    """``id, digest`` of every case's canonical JSON."""
    return cases.select("id", F.sha2(F.to_json(F.struct(*sorted(cases.columns))), 256).alias("digest"))
