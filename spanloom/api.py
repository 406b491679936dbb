"""The engine's entry points, one per request of a claim-checking service, over tables of any number of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import __version__
from spanloom.functions import text as T
from spanloom.operators import cascade, retrieval, rules, verdict
from spanloom.operators import decompose as D
from spanloom.sources.tables import table


def engine_status(spark: SparkSession) -> dict:
    return {"engine": __version__, "spark": spark.version, "rules": sorted(rules.REGISTRY)}


def case_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "catalog").drop("documents").dropDuplicates(["case_id"]).orderBy("case_id")


def case(spark: SparkSession, folder: str, case_id: str) -> DataFrame:
    return table(spark, folder, "catalog").where(F.col("case_id") == case_id)


def retrieve(documents: DataFrame, atoms: DataFrame, method: str = "LEXICAL", budget: int = 6, vectors: DataFrame | None = None) -> DataFrame:
    """Evidence of each atom. ``documents``: case_id, document_id, text; ``atoms``: case_id, atom_id, query; ``vectors`` (for SEMANTIC and HYBRID):
    case_id, atom_id, document_id, ordinal, dense."""
    if method not in ("LEXICAL", "SEMANTIC", "HYBRID") or not 1 <= budget <= 12:
        raise ValueError("method must be LEXICAL, SEMANTIC or HYBRID, and the budget 1 to 12")
    if method != "LEXICAL" and vectors is None:
        raise ValueError(f"{method} needs vector scores")
    spans = T.sentences(documents, ["case_id", "document_id"]).where(T.eligible(F.col("sentence")))
    by, tail = ["case_id", "atom_id"], [F.asc("document_id"), F.asc("ordinal")]
    if method == "SEMANTIC":
        return retrieval.capped_top(vectors, by, "document_id", [F.desc("dense"), *tail], budget)
    lexical = retrieval.bm25(retrieval.passage_tokens(spans, "case_id", ["document_id", "ordinal"]), atoms, "case_id", ["document_id", "ordinal"], "atom_id")
    if method == "LEXICAL":
        return retrieval.capped_top(lexical, by, "document_id", [F.desc("score"), *tail], budget)
    both = lexical.withColumnRenamed("score", "lexical").join(vectors, [*by, "document_id", "ordinal"])
    ranked = both.withColumn("dr", retrieval.competition_rank(by, "dense")).withColumn("lr", retrieval.competition_rank(by, "lexical"))
    fused = ranked.withColumn("fused", retrieval.fused(F.col("dr"), F.col("lr"), F.col("lexical")))
    return retrieval.capped_top(fused, by, "document_id", [F.desc("fused"), F.desc("lexical"), *tail], budget, least=3)


REPLY = "struct<atoms:array<struct<text:string,sourceText:string,role:string>>,composition:string>"
MOST_ATOMS = 12


def decompose(claims: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms out of a model's replies (case_id, reply: JSON), grounded in their claims (case_id, claim), and the replies that give none: ``case_id, atom_id, text, source_text, role,
    start_u16, end_u16, composition``, and ``case_id, reason``. A case is rejected as a whole if an atom has no text or no place in the claim."""
    rows = claims.join(replies, "case_id").withColumn("r", F.from_json("reply", REPLY))
    n = F.size(F.coalesce("r.atoms", F.array().cast("array<struct<text:string,sourceText:string,role:string>>")))
    shape = F.when(F.col("r").isNull() | F.col("r.atoms").isNull(), "MALFORMED_REPLY").when(n == 0, "NO_ATOMS").when(n > MOST_ATOMS, "TOO_MANY_ATOMS").when(F.exists("r.atoms", lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) == ""), "EMPTY_ATOM")
    rows = rows.withColumn("reason", shape)
    atoms = rows.where("reason IS NULL").select("case_id", "claim", F.coalesce("r.composition", F.lit("SINGLE")).alias("composition"), F.posexplode("r.atoms").alias("i", "x"))
    atoms = atoms.select("case_id", "claim", "composition", F.concat(F.lit("atom-"), (F.col("i") + 1).cast("string")).alias("atom_id"), F.trim("x.text").alias("text"), F.coalesce("x.sourceText", "x.text").alias("source_text"), D.normalized_role(F.coalesce("x.role", F.lit("CORE")), F.col("x.text")).alias("role"))
    placed = D.ground(atoms.select("case_id", "atom_id", "source_text"), claims)
    lost = placed.where("NOT grounded").select("case_id").distinct().withColumn("reason", F.lit("UNGROUNDED_ATOM"))
    sound = atoms.drop("claim").join(placed.select("case_id", "atom_id", "start_u16", "end_u16"), ["case_id", "atom_id"]).join(lost, "case_id", "left_anti")
    return sound, rows.where("reason IS NOT NULL").select("case_id", "reason").unionByName(lost)


def assess(answers: DataFrame, atoms: DataFrame, spans: DataFrame, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Assessments after all checks, and the answers that were rejected with the reason (see ``operators.cascade``). ``spans`` with ``title`` and ``host`` are checked for scope, too."""
    scopes = rules.scope_checks(atoms, spans) if {"title", "host"} <= set(spans.columns) else None
    return cascade.assess(answers, atoms, spans, scopes, documents), cascade.rejects(answers, atoms, spans)


def reason(atoms: DataFrame, premises: DataFrame) -> DataFrame:
    """All rules that the atoms qualify for, over their premises; nothing is run for atoms without a candidate."""
    return rules.run_rules(rules.candidates(atoms), premises)


def aggregate_verdict(assessments: DataFrame, cases: DataFrame, proofs: DataFrame | None = None) -> DataFrame:
    return verdict.verdicts(verdict.obligation_states(assessments, proofs), cases)
