"""Text expressions on columns: sentences, tokens, numbers, offsets, cleaning. All stay inside the JVM."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The forms of tokens, list prefixes, queries about lists, facts and dependent sentences.
SENTENCE = r"[^.!?\n]+[.!?]*\s*|[.!?\n]\s*"
TOKEN = r"[0-9]+(?:[.,][0-9]+)*(?:%|(?![\p{L}\p{N}_]))|[\p{L}\p{N}]+(?:[’'-][\p{L}\p{N}]+)*"
PLAIN_TOKEN = r"[0-9]+(?:[.,][0-9]+)*(?:%|(?![a-z0-9_]))|[a-z0-9]+(?:['-][a-z0-9]+)*"  # of lower-case ASCII
WORD = r"[\p{L}\p{N}]+(?:[’'-][\p{L}\p{N}]+)*"
NUMBER = r"^[0-9]+(?:[.,][0-9]+)*%?$"
LIST_PREFIX = r"^(?:[-*•]|[0-9]+[.)])\s+"
LIST_QUERY = r"(?i)\b(?:list(?:ed|s|ing)?|member(?:s|ship)?\s+of|included\s+(?:in|on|among)|designated\s+(?:as|by)|belongs?\s+to|on\s+(?:the\s+)?(?:[\w'-]+\s+){0,6}(?:board|committee|council|register|roster))\b"
FACT_CUES = r"(?i)\b(?:awarded|award|born|date|died|joined|member|population|prize|sale)\b"
BACKWARD = r"(?i)^(?:however|but|and|also|instead|meanwhile|therefore|thus|accordingly|consequently|similarly|this|that|these|those|such|he|she|it|they|his|her|its|their|the former|the latter)(?:$|[^\p{L}\p{N}_])"
FORWARD = r"(?i)(?:as follows|the following|these are|listed below)\s*[:.]?$"
DEPENDENT = r"(?i)(?:^|[^\p{L}\p{N}_])(?:he|she|it|they|this|that|these|those|former|latter|above|below)(?:$|[^\p{L}\p{N}_])"
MAX_SENTENCE, LEAST_WORDS, MAX_CONTEXT = 1000, 5, 4000
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with")
GENERIC_WORDS = ("complete", "designated", "designation", "entities", "entity", "financial", "group", "groups", "included", "index", "list", "membership", "official", "sanctions", "target", "targets", "terrorist")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, ordinal, sentence, start_off, end_off``: a split that loses nothing, with offsets in code points."""
    rows = df.select(*keys, F.posexplode(_all(F.col(text), SENTENCE)).alias("ordinal", "sentence"))
    upto = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end_off", F.sum(F.length("sentence")).over(upto).cast("int")).withColumn("start_off", (F.col("end_off") - F.length("sentence")).cast("int"))


def canonical_number(token: Column) -> Column:
    """One form for a number however it groups digits: of two kinds of separator the last is the decimal one, wherever it stands; commas before
    three digits each group; a single other comma is decimal; several others stay. Zeros that say nothing are dropped; a percent sign stays."""
    body = F.regexp_replace(token, "%$", "")
    percent = F.when(token.endswith("%"), "%").otherwise("")
    both = body.contains(",") & body.contains(".")
    comma_last = body.rlike(r",[^.]*$")
    dotted = (
        F.when(both & comma_last, F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both | body.rlike(r"^[0-9]{1,3}(,[0-9]{3})+$"), F.replace(body, F.lit(","), F.lit("")))
        .when(body.rlike(r"^[^,]*,[^,]*$"), F.replace(body, F.lit(","), F.lit(".")))
        .otherwise(body)
    )
    whole = F.regexp_replace(F.regexp_replace(F.regexp_extract(dotted, r"^([^.]*)", 1), r"^0+", ""), "^$", "0")
    part = F.regexp_replace(F.regexp_extract(dotted, r"^[^.]*\.(.*)$", 1), r"0+$", "")
    return F.concat(F.lit("#number:"), whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""), percent)


# Letters whose folded form is not their lower case.
FOLDED = (("ß", "ss"), ("ẞ", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def folded(text: Column) -> Column:
    """Text without differences of case, in the full sense: sharp s and ligatures as their letters, one sigma, one s."""
    text = F.translate(F.lower(text), "ςſ", "σs")
    for c, plain in FOLDED:
        text = F.replace(text, F.lit(c), F.lit(plain))
    return text


def lexical_tokens(text: Column) -> Column:
    """Folded tokens in order, repeats kept: words of more than two letters, and numbers in one form. A number that runs on into letters is a word."""
    found = F.transform(_all(text, TOKEN), folded)
    kept = F.filter(found, lambda t: t.rlike(NUMBER) | (F.length(t) > 2))
    return F.transform(kept, lambda t: F.when(t.rlike(NUMBER), canonical_number(t)).otherwise(t))


def shared_tokens(text: Column, among: Column) -> Column:
    """Those of ``among``, an array of ``lexical_tokens``, that are tokens of the text. Much cheaper than all its tokens: the text is folded as a whole, which moves the borders of no token
    but where a letter falls apart (İ), and only numbers are brought into their form."""
    plain = F.octet_length(text) == F.length(text)  # ASCII alone
    low = F.when(text.rlike(r"[Σςſßẞﬀ-ﬆ]"), folded(text)).otherwise(F.lower(text))
    tokens = F.when(plain, _all(F.lower(text), PLAIN_TOKEN)).otherwise(_all(low, TOKEN))
    whole = lambda t: F.when(t.rlike("^[1-9][0-9]*$"), F.concat(F.lit("#number:"), t)).otherwise(canonical_number(t))
    found = F.when(text.rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike(NUMBER), whole(t)).otherwise(t))).otherwise(tokens)
    return F.array_intersect(F.when(text.contains("İ"), lexical_tokens(text)).otherwise(found), among)


@functools.lru_cache(maxsize=1)
def _compatible() -> tuple[str, str]:
    """Characters that compatibility turns into one ASCII letter or digit, and what they become; ligatures are folded, other digraphs left."""
    pairs = ((c, unicodedata.normalize("NFKC", c).casefold()) for c in map(chr, range(0x80, 0x1FC00)) if unicodedata.category(c)[0] in "LN")
    one = {c: plain for c, plain in pairs if len(plain) == 1 and plain.isascii()}
    return "".join(one), "".join(one.values())


def normalized(text: Column) -> Column:
    """Folded text with compatible characters as ASCII and letters under combining marks as composed ones, which are no ASCII letters."""
    one, plain = _compatible()
    return F.regexp_replace(folded(F.translate(text, one, plain)), r"[aceghijklnoprstuwyz][\u0300-\u036f]+", "é")


def symbol_tokens(text: Column) -> Column:
    """Distinct plain tokens without stop words."""
    plain = normalized(F.regexp_replace(text, r"[\p{S}]", " "))
    return F.array_distinct(F.filter(_all(plain, r"[a-z][a-z0-9'-]*"), lambda t: ~t.isin(*STOP_WORDS)))


def identity_tokens(text: Column) -> Column:
    """The same without words that any list has, and with acronyms without their periods."""
    acronyms = F.transform(_all(text, r"\b(?:[A-Za-z]\.){2,}|\b[A-Z]{2,}\b"), lambda t: F.lower(F.regexp_replace(t, "[^A-Za-z0-9]", "")))
    return F.filter(F.array_union(symbol_tokens(text), acronyms), lambda t: ~t.isin(*GENERIC_WORDS) & (t != ""))


def word_count(text: Column) -> Column:
    return F.size(_all(text, WORD))


def is_sentence_like(text: Column) -> Column:
    """Whether a candidate reads as a sentence, by the first rule that applies."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = word_count(t)
    return (
        F.when(t == "", False)
        .when(t.rlike(r"(?i)^myth\s*:"), False)
        .when((words >= LEAST_WORDS) | t.rlike(r"[.?!]$"), True)
        .when((words >= 3) & t.rlike("[0-9]") & t.rlike(FACT_CUES), True)
        .otherwise(t.rlike(LIST_PREFIX))
    )


def eligible(sentence: Column) -> Column:
    return (F.length(sentence) <= MAX_SENTENCE) & is_sentence_like(sentence)


def utf16_length(text: Column) -> Column:
    """Code units, as many interfaces count offsets."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def utf16_slice(text: Column, begin: Column, end: Column) -> Column:
    """The text between two offsets in code units, which must not split a character."""
    return F.decode(F.substring(F.encode(text, "UTF-16LE"), begin * 2 + 1, (end - begin) * 2), "UTF-16LE")


def reading_context(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbours a sentence can't do without: ``previous_ordinal``, ``next_ordinal`` and the text of all, in order."""
    order = Window.partitionBy(*keys).orderBy("ordinal")
    rows = spans.withColumn("before", F.lag("sentence").over(order)).withColumn("after", F.lead("sentence").over(order))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    own = bare(F.col("sentence"))
    joined = lambda a, b: ~F.concat(F.right(a, F.lit(4)), F.left(b, F.lit(4))).rlike(r"\n\s*\n")
    usable = lambda n: n.isNotNull() & (F.length(n) <= MAX_SENTENCE)
    back = usable(F.col("before")) & joined(F.col("before"), F.col("sentence")) & (own.rlike(BACKWARD) | own.rlike(DEPENDENT) | own.rlike("^[\"“‘']"))
    ahead = usable(F.col("after")) & joined(F.col("sentence"), F.col("after")) & (own.rlike(FORWARD) | bare(F.col("after")).rlike(BACKWARD))
    parts = F.array_compact(F.array(F.when(back, bare(F.col("before"))), own, F.when(ahead, bare(F.col("after")))))
    return rows.select(
        *keys, "ordinal", F.when(back, F.col("ordinal") - 1).alias("previous_ordinal"), F.when(ahead, F.col("ordinal") + 1).alias("next_ordinal"), F.left(F.array_join(parts, " "), F.lit(MAX_CONTEXT)).alias("context")
    )


def clean_text(text: Column) -> Column:
    """Lines without doubled blanks and ends, and at most one blank line in a row."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^ | $", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def is_word_per_line(text: Column) -> Column:
    """Whether a text came with one word on each line: a hundred lines at least, 80 % of one word, 95 % of two at most."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    count = lambda k: F.size(F.filter(lines, lambda x: F.size(F.split(x, r"\s+")) <= k))
    return (F.size(lines) >= 100) & (count(1) >= 0.8 * F.size(lines)) & (count(2) >= 0.95 * F.size(lines))


def reflow(text: Column) -> Column:
    """Such a text with the words of a paragraph on one line; any other as it is."""
    paragraphs = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " ")))
    return F.when(is_word_per_line(text), F.array_join(paragraphs, "\n\n")).otherwise(text)


def compact(text: Column, limit: int) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(limit))


def html_title(page: Column) -> Column:
    """A page's title element: unescaped, in one line, 300 characters at most."""
    raw = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return compact(raw, 300)
