"""Queries on text: tokens, numbers, sentences, offsets, cleaning, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions import urls as U
from spanloom.sources.tables import table

SPAN_SQL = r"""
    parts AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*\s*|[.!?\n]\s*')) AS sentence, generate_subscripts(regexp_extract_all(text, '[^.!?\n]+[.!?]*\s*|[.!?\n]\s*'), 1) - 1 AS ordinal FROM documents WHERE text <> ''),
    spans AS (SELECT doc_id, ordinal, sentence, CAST(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY ordinal) AS INTEGER) AS end_off FROM parts)"""


def canonical_sql(token: str) -> str:
    """``token`` in its canonical form, as SQL over an expression: split at separators, put together by what these are."""
    b = f"rtrim({token}, '%')"
    last = f"regexp_extract({b}, '.*([.,])', 1)"
    dotted = f"""CASE WHEN contains({b}, ',') AND contains({b}, '.') THEN CASE {last} WHEN ',' THEN array_to_string(string_split(array_to_string(string_split({b}, '.'), ''), ','), '.') ELSE array_to_string(string_split({b}, ','), '') END
         WHEN len(string_split({b}, ',')) > 1 AND length(string_split({b}, ',')[1]) <= 3 AND len(list_filter(string_split({b}, ',')[2:], lambda g: length(g) <> 3)) = 0 THEN array_to_string(string_split({b}, ','), '')
         WHEN len(string_split({b}, ',')) = 2 THEN array_to_string(string_split({b}, ','), '.') ELSE {b} END"""
    whole = f"CASE WHEN ltrim(split_part({dotted}, '.', 1), '0') = '' THEN '0' ELSE ltrim(split_part({dotted}, '.', 1), '0') END"
    part = f"rtrim(array_to_string(string_split({dotted}, '.')[2:], '.'), '0')"
    return f"'#number:' || {whole} || CASE WHEN {part} <> '' THEN '.' || {part} ELSE '' END || CASE WHEN right({token}, 1) = '%' THEN '%' ELSE '' END"


def token_sql(text: str) -> str:
    """Tokens of an expression, as SQL. A number that runs on into letters is marked before, as the expressions know no look-ahead."""
    marked = f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{N}}_’''-]|(?:^|[^\\p{{L}}\\p{{N}}])[’''-])([0-9]+[\\p{{L}}_])', '\\1' || chr(57344) || '\\2', 'g')"
    found = f"regexp_extract_all({marked}, '\\x{{E000}}[\\p{{L}}\\p{{N}}]+(?:[’''-][\\p{{L}}\\p{{N}}]+)*|[0-9]+(?:[.,][0-9]+)*%?|[\\p{{L}}\\p{{N}}]+(?:[’''-][\\p{{L}}\\p{{N}}]+)*')"
    return f"list_transform({found}, lambda w: replace(replace(lower(ltrim(w, chr(57344))), 'ß', 'ss'), 'ς', 'σ'))"


def tokens_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens of every document with their counts."""
    return table(spark, d, "documents").select("doc_id", F.explode(T.lexical_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def number_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct number of the documents, as written and in its one form."""
    found = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:[.,][0-9]+)*%?"), F.lit(0))).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return found.select("raw", T.canonical_number(F.col("raw")).alias("canonical"), "n")


HARD_NUMBERS = ("1,234.567,8", "1.234,567.8", "1,23,456", "1,234,567", "12,5", "0012.500", "1.234.567", "0,000", "000", "7%", "1,234%", "12.50%", "1,2345", "1234,567", "0.0", "00,10%")
HARD_TEXTS = ("12abc 2nd 1990s 5G", "3.5abc costs 3.5 and 1,000 or 12_a", "x-3d -3d a_12 _12", "Straße FLUẞ ΣΟΦΟΣ", "5%abc 7% covid-19 19-year", "It's 1,234.567,8 of 1,23,456", "don’t re-use 2nd-hand’s")


def number_forms(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that are grouped in every way, for every case: the hard forms beside the case's count of atoms."""
    rows = table(spark, d, "atoms").groupBy("case_id").agg(F.count("*").cast("string").alias("n"))
    raw = F.explode(F.array(*[F.lit(x) for x in HARD_NUMBERS], F.concat("n", F.lit(",50"))))
    return rows.select("case_id", raw.alias("raw")).select("case_id", "raw", T.canonical_number(F.col("raw")).alias("canonical"))


def token_borders(spark: SparkSession, d: str) -> DataFrame:
    """Tokens where digits run into letters, after the text of every atom."""
    rows = table(spark, d, "atoms").select("case_id", "atom_id", F.posexplode(F.array(*[F.lit(x) for x in HARD_TEXTS])).alias("no", "hard"), "text")
    found = rows.select("case_id", "atom_id", "no", F.explode(T.lexical_tokens(F.concat("text", F.lit(" "), "hard"))).alias("term"))
    return found.groupBy("case_id", "atom_id", "no", "term").agg(F.count("*").alias("n"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return T.sentences(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])


def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_id", "ordinal", "start_off", "end_off", F.sha2("sentence", 256).alias("digest"))


def utf16_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Sentences whose offsets in code units differ from those in code points."""
    from pyspark.sql import Window

    upto = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = _spans(spark, d).withColumn("end_u16", F.sum(T.utf16_length(F.col("sentence"))).over(upto).cast("int"))
    return rows.withColumn("start_u16", F.col("end_u16") - T.utf16_length(F.col("sentence"))).where("end_u16 <> end_off").select("doc_id", "ordinal", "start_off", "end_off", "start_u16", "end_u16")


def utf16_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut by code units at a third of their length and put together again."""
    rows = table(spark, d, "documents").where("text <> ''").withColumn("n_u16", T.utf16_length(F.col("text"))).withColumn("cut", T.utf16_length(F.substring("text", F.lit(1), (F.length("text") / 3).cast("int"))))
    joined = F.concat(T.utf16_slice(F.col("text"), F.lit(0), F.col("cut")), T.utf16_slice(F.col("text"), F.col("cut"), F.col("n_u16")))
    return rows.select("doc_id", "n_u16", (joined == F.col("text")).alias("same"))


def eligible_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Candidates per document: sentences not too long that read as sentences."""
    return _spans(spark, d).where(T.eligible(F.col("sentence"))).groupBy("doc_id").agg(F.count("*").alias("n_eligible"), F.sum(F.length("sentence")).alias("n_chars"))


def reading_context(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that need a neighbour to be understood."""
    found = T.reading_context(_spans(spark, d), ["doc_id"])
    return found.where("previous_ordinal IS NOT NULL OR next_ordinal IS NOT NULL").select("doc_id", "ordinal", "previous_ordinal", "next_ordinal", F.length("context").alias("n_context"))


def list_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Atoms that ask about a list, and sentences of documents that begin as entries, by role and by source."""
    atoms = table(spark, d, "atoms").groupBy(F.col("role").alias("kind")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("text").rlike(T.LIST_QUERY)).alias("n_list"))
    lines = T.sentences(table(spark, d, "documents").select("doc_id", "source", "text"), ["doc_id", "source"]).groupBy(F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("kind")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("sentence").rlike(T.LIST_PREFIX)).alias("n_list"))
    return atoms.unionByName(lines)


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(T.clean_text(F.col("text")), 256).alias("digest"), F.length(T.clean_text(F.col("text"))).alias("n_clean"))


def min_words(spark: SparkSession, d: str) -> DataFrame:
    """Documents of at least 175 words."""
    n = F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    return table(spark, d, "documents").where(n >= 175).select("doc_id", n.alias("n_words"))


MARKERS = ("lorem ipsum", "{{", "Page not found")


def leak_markers(spark: SparkSession, d: str) -> DataFrame:
    """Records whose text has a marker that must not be there."""
    hit = F.lit(False)
    for m in MARKERS:
        hit = hit | F.col("text").contains(m)
    return table(spark, d, "case_documents").where(hit).select("case_id", "document_id").distinct()


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "case_documents").select("case_id", "document_id", U.canonical_url(F.col("url")).alias("identity")).distinct()


def duplicate_sources(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that several documents of one case share."""
    rows = table(spark, d, "case_documents").select("case_id", "document_id", U.canonical_url(F.col("url")).alias("identity")).distinct()
    return rows.groupBy("case_id", "identity").agg(F.count("*").alias("n")).where("n > 1")


def archive_urls(spark: SparkSession, d: str) -> DataFrame:
    """Archived addresses rendered from documents: as received, and the page's own identity."""
    made = F.concat(F.lit("https://web.archive.org/web/"), F.date_format("fetched_at", "yyyyMMddHHmmss"), F.lit("/"), F.regexp_replace("url", "^https://", "http://"))
    rows = table(spark, d, "documents").where("url IS NOT NULL").select("doc_id", made.alias("archived"))
    return rows.select("doc_id", U.raw_archive_url(F.col("archived")).alias("raw_url"), U.source_identity(F.col("archived")).alias("identity"))


def host_scope(spark: SparkSession, d: str) -> DataFrame:
    """Documents per host."""
    return table(spark, d, "documents").groupBy(U.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n_docs"))


def sha256_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.left(F.sha2(F.coalesce("url", F.lit("")), 256), F.lit(12)).alias("source_id"))


def html_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles out of pages rendered from the documents."""
    escaped = F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("'"), F.lit("&#39;"))
    page = F.concat(F.lit("<html><head><title class='x'>\n  "), escaped, F.lit("\n</title></head><body></body></html>"))
    return table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", T.html_title(page).alias("title"))


def symbol_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Distinct plain tokens of the atoms."""
    return table(spark, d, "atoms").select("case_id", "atom_id", F.explode(T.symbol_tokens(F.col("text"))).alias("token"))


def word_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts rendered with one word on each line, and joined again."""
    one = F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), " ", "\n")
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("line"), one.alias("broken"))
    return rows.where(T.is_word_per_line(F.col("broken"))).select("doc_id", (T.reflow(F.col("broken")) == F.col("line")).alias("joined"))


QUERIES = {
    f.__name__: f
    for f in (tokens_lexical, number_canonical, sentence_spans, utf16_offsets, utf16_roundtrip, eligible_sentences, reading_context, list_relevance, clean_text, min_words, leak_markers, canonical_urls, duplicate_sources, archive_urls, host_scope, sha256_digest, html_titles, symbol_tokens, word_lines, number_forms, token_borders)
}

_T = "trim(regexp_replace(sentence, '\\s+', ' ', 'g'))"
LIKE_SQL = rf"""CASE WHEN {_T} = '' THEN false WHEN regexp_matches({_T}, '(?i)^myth\s*:') THEN false
      WHEN len(regexp_extract_all({_T}, '[\p{{L}}\p{{N}}]+(?:[’''-][\p{{L}}\p{{N}}]+)*')) >= 5 OR regexp_matches({_T}, '[.?!]$') THEN true
      WHEN len(regexp_extract_all({_T}, '[\p{{L}}\p{{N}}]+(?:[’''-][\p{{L}}\p{{N}}]+)*')) >= 3 AND regexp_matches({_T}, '[0-9]') AND regexp_matches({_T}, '{T.FACT_CUES}') THEN true
      ELSE regexp_matches({_T}, '{T.LIST_PREFIX}') END"""
_CANON = r"""'https://' || lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1))
      || CASE WHEN regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) END
      || CASE WHEN regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1) = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&')), '&') END"""
_CLEAN = r"""regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^ | $', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"""

ORACLE_SQL = {
    "tokens_lexical": f"""
      WITH t AS (SELECT doc_id, unnest({token_sql("text")}) AS w FROM documents),
      k AS (SELECT doc_id, CASE WHEN regexp_full_match(w, '[0-9]+(?:[.,][0-9]+)*%?') THEN {canonical_sql("w")} ELSE w END AS term FROM t WHERE length(w) > 2 OR regexp_full_match(w, '[0-9]+(?:[.,][0-9]+)*%?'))
      SELECT doc_id, term, count(*) AS n FROM k GROUP BY 1, 2""",
    "number_canonical": f"WITH t AS (SELECT unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*%?')) AS raw FROM documents) SELECT raw, {canonical_sql('raw')} AS canonical, count(*) AS n FROM t GROUP BY raw",
    # written from what the forms mean: every hard number with its value, worked out by hand
    "number_forms": """WITH h(raw, canonical) AS (VALUES ('1,234.567,8', '#number:1.234567.8'), ('1.234,567.8', '#number:1.234567.8'), ('1,23,456', '#number:1,23,456'), ('1,234,567', '#number:1234567'), ('12,5', '#number:12.5'), ('0012.500', '#number:12.5'), ('1.234.567', '#number:1.234.567'),
        ('0,000', '#number:0'), ('000', '#number:0'), ('7%', '#number:7%'), ('1,234%', '#number:1234%'), ('12.50%', '#number:12.5%'), ('1,2345', '#number:1.2345'), ('1234,567', '#number:1234.567'), ('0.0', '#number:0'), ('00,10%', '#number:0.1%'))
      SELECT DISTINCT case_id, raw, canonical FROM atoms CROSS JOIN h UNION ALL SELECT case_id, count(*) || ',50', '#number:' || count(*) || '.5' FROM atoms GROUP BY case_id""",
    "token_borders": f"""WITH h(no, hard) AS (VALUES {', '.join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(HARD_TEXTS))}),
      t AS (SELECT case_id, atom_id, no, unnest({token_sql("text || ' ' || hard")}) AS w FROM atoms CROSS JOIN h),
      k AS (SELECT case_id, atom_id, no, CASE WHEN regexp_full_match(w, '[0-9]+(?:[.,][0-9]+)*%?') THEN {canonical_sql("w")} ELSE w END AS term FROM t WHERE length(w) > 2 OR regexp_full_match(w, '[0-9]+(?:[.,][0-9]+)*%?'))
      SELECT case_id, atom_id, CAST(no AS INTEGER) AS no, term, count(*) AS n FROM k GROUP BY ALL""",
    "sentence_spans": f"WITH {SPAN_SQL} SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, end_off - CAST(length(sentence) AS INTEGER) AS start_off, end_off, sha256(sentence) AS digest FROM spans",
    "utf16_offsets": f"""WITH {SPAN_SQL}, u AS (SELECT *, length(sentence) + len(regexp_extract_all(sentence, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS n16 FROM spans),
      v AS (SELECT *, CAST(sum(n16) OVER (PARTITION BY doc_id ORDER BY ordinal) AS INTEGER) AS end_u16 FROM u)
      SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, end_off - CAST(length(sentence) AS INTEGER) AS start_off, end_off, end_u16 - CAST(n16 AS INTEGER) AS start_u16, end_u16 FROM v WHERE end_u16 <> end_off""",
    "utf16_roundtrip": r"SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) AS INTEGER) AS n_u16, true AS same FROM documents WHERE text <> ''",
    "eligible_sentences": f"WITH {SPAN_SQL} SELECT doc_id, count(*) AS n_eligible, CAST(sum(length(sentence)) AS BIGINT) AS n_chars FROM spans WHERE length(sentence) <= 1000 AND ({LIKE_SQL}) GROUP BY doc_id",
    "reading_context": rf"""
      WITH {SPAN_SQL}, n AS (SELECT *, lag(sentence) OVER w AS p, lead(sentence) OVER w AS f FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
      c AS (SELECT *, regexp_replace(sentence, '^\s+|\s+$', '', 'g') AS own,
        p IS NOT NULL AND length(p) <= 1000 AND NOT regexp_matches(right(p, 4) || left(sentence, 4), '\n\s*\n') AND (regexp_matches(regexp_replace(sentence, '^\s+|\s+$', '', 'g'), '{T.BACKWARD}') OR regexp_matches(regexp_replace(sentence, '^\s+|\s+$', '', 'g'), '{T.DEPENDENT}') OR regexp_matches(regexp_replace(sentence, '^\s+|\s+$', '', 'g'), '^["“‘'']')) AS back,
        f IS NOT NULL AND length(f) <= 1000 AND NOT regexp_matches(right(sentence, 4) || left(f, 4), '\n\s*\n') AND (regexp_matches(regexp_replace(sentence, '^\s+|\s+$', '', 'g'), '{T.FORWARD}') OR regexp_matches(regexp_replace(f, '^\s+|\s+$', '', 'g'), '{T.BACKWARD}')) AS ahead FROM n)
      SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN back THEN CAST(ordinal - 1 AS INTEGER) END AS previous_ordinal, CASE WHEN ahead THEN CAST(ordinal + 1 AS INTEGER) END AS next_ordinal,
        CAST(least(4000, length(own) + CASE WHEN back THEN length(regexp_replace(p, '^\s+|\s+$', '', 'g')) + 1 ELSE 0 END + CASE WHEN ahead THEN length(regexp_replace(f, '^\s+|\s+$', '', 'g')) + 1 ELSE 0 END) AS INTEGER) AS n_context FROM c WHERE back OR ahead""",
    "list_relevance": f"WITH {SPAN_SQL} SELECT role AS kind, count(*) AS n_rows, count(*) FILTER (WHERE regexp_matches(text, '" + T.LIST_QUERY.replace("'", "''") + "')) AS n_list FROM atoms GROUP BY role UNION ALL SELECT 'source:' || coalesce(source, ''), count(*), count(*) FILTER (WHERE regexp_matches(sentence, '" + T.LIST_PREFIX + "')) FROM spans JOIN documents USING (doc_id) GROUP BY 1",
    "clean_text": f"SELECT doc_id, sha256({_CLEAN}) AS digest, CAST(length({_CLEAN}) AS INTEGER) AS n_clean FROM documents WHERE text IS NOT NULL",
    "min_words": "SELECT doc_id, CAST(len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS INTEGER) AS n_words FROM documents WHERE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) >= 175",
    "leak_markers": "SELECT DISTINCT case_id, document_id FROM case_documents WHERE " + " OR ".join(f"contains(text, '{m}')" for m in MARKERS),
    "canonical_urls": f"SELECT DISTINCT case_id, document_id, {_CANON} AS identity FROM case_documents",
    "duplicate_sources": f"WITH r AS (SELECT DISTINCT case_id, document_id, {_CANON} AS identity FROM case_documents) SELECT case_id, identity, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) > 1",
    "archive_urls": f"""WITH m AS (SELECT doc_id, strftime(fetched_at, '%Y%m%d%H%M%S') AS ts, regexp_replace(url, '^https://', 'http://') AS url FROM documents WHERE url IS NOT NULL), k AS (SELECT doc_id, ts, url AS page, {_CANON} AS c FROM m)
      SELECT doc_id, 'https://web.archive.org/web/' || ts || 'id_/' || page AS raw_url, regexp_extract(c, '^(https://[^/]*)', 1) || regexp_replace(regexp_extract(c, '^https://[^/]*([^?]*)', 1), '/{{2,}}', '/', 'g') || regexp_extract(c, '(\\?.*)?$', 1) AS identity FROM k""",
    "host_scope": "SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, count(*) AS n_docs FROM documents GROUP BY 1",
    "sha256_digest": "SELECT doc_id, sha256(coalesce(text, '')) AS digest, left(sha256(coalesce(url, '')), 12) AS source_id FROM documents",
    "html_titles": "SELECT doc_id, left(trim(regexp_replace(title, '\\s+', ' ', 'g')), 300) AS title FROM documents WHERE title IS NOT NULL",
    "symbol_tokens": r"SELECT case_id, atom_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(text, '[\p{S}]', ' ', 'g')), '[a-z][a-z0-9''-]*'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")))) AS token FROM atoms",
    "word_lines": "SELECT doc_id, true AS joined FROM documents WHERE len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) >= 100",
}
