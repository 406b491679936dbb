"""Problem 10: keyword-stuffed pages and link lists.

Each text is cut into blocks of ``BLOCK_BYTES`` which are compressed one by one, every link and tag reduced to one mark. The ratio to
the text's bytes is set against what its language and length lead to expect: the median and spread of all texts of the same language
(tag and script) and length class. How far it lies below, together with the shares of the top word, links and tags, is the page's redundancy. An
extremely redundant page is flagged if low density of sentence punctuation confirms it: the ends of sentences that inform, which are those
that don't turn on the page's top word. Rolls, registers, chronologies and source lists have entries that differ, and stay.

Defined results: null and blank texts are no spam; texts of any length are judged, over all their blocks; copies count one by one;
a corpus of few pages has too little to compare with and takes a usual spread; an empty table has no spam.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import materialize

BLOCK_BYTES = 2048
#: Spreads are taken as this much at least, where a class is too uniform or too small to tell.
LEAST_SPREAD = 0.015
#: Classes with fewer pages take the median of their script and length class, or a usual spread.
LEAST_PAGES, USUAL_SPREAD = 20, 0.045
LENGTH_CLASSES = (300, 600, 1200, 2400, 4800, 9600)
#: Redundancy is how many spreads the ratio lies below what is expected, and what the share of the top word, of links in characters and of tags among words adds.
TOP_WEIGHT, LINK_WEIGHT, TAG_WEIGHT = 14, 6, 25
#: Above this a page is extremely redundant; below this part of the usual density of sentence ends that is confirmed.
REDUNDANT, INFORMS = 5.5, 0.2
#: A page turns on its top word from this share on, and sentences with it don't inform; neither do ones of fewer characters.
TURNING, LEAST_SENTENCE = 0.08, 12
FEATURES = "script string, language string, len_class int, ratio double, punct double, informing double, links double, tags double, top double"

_END = re.compile(r"[.!?…]+(?=[\s\"'”’»)\]]|$)|[。\uff01\uff1f।؟۔]|(?<=[ก-๛]) +(?=[ก-๛])")
_LINK = re.compile(r"\[[^\]\n]*\]\([^)\s]+\)|\[url=[^\]\n]*\][^\[\n]*\[/url\]|<a\s[^>\n]*>[^<\n]*</a>|(?:https?://|www\.)\S+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}/\S*", re.I)
_CHAIN = re.compile(r"[^\s»›>|/]\s[»›>]\s")
#: One set of first characters, which lets the search skip all others.
_TAG = re.compile(r"[#SXML$€£](?:(?<=#)(?<!\w#)\w+|(?<=S)(?<!\wS)KU\b[\s:#-]*\S+|(?<=[$€£])\s?\d+(?:[.,]\d+)?|(?<=X)(?<!\wX)(?:S|L|XL)\b|(?<=[SML])(?<!\w[SML]) (?=[a-z]))")
_WORD = re.compile(r"[^\W_]+", re.UNICODE)
_SCRIPTS = (("thai", "฀", "๿"), ("deva", "ऀ", "ॿ"), ("arab", "؀", "ۿ"), ("cyrl", "Ѐ", "ӿ"), ("cjk", "぀", "鿿"), ("hang", "가", "힣"), ("grek", "Ͱ", "Ͽ"), ("hebr", "֐", "׿"))


def script_of(text: str) -> str:
    """The script of most letters; texts outside the listed ones count as Latin."""
    if text.isascii() or len(text) < 1.25 * len(text.encode("ascii", "ignore")):
        return "latn"
    counts = Counter()
    for c, n in Counter(text).items():
        if c > "ʯ":
            for name, a, b in _SCRIPTS:
                if a <= c <= b:
                    counts[name] += n
                    break
    if not counts:
        return "latn"
    name, n = counts.most_common(1)[0]
    return name if n * 4 > sum(c.isalpha() for c in text) else "latn"


def block_ratio(text: str, size: int) -> float:
    """Compressed bytes of all blocks, for each of ``size`` bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
    if len(blocks) > 1 and len(blocks[-1]) < BLOCK_BYTES // 2:
        blocks[-2:] = [blocks[-2] + blocks[-1]]
    return sum(len(zlib.compress(b, 1)) for b in blocks) / max(1, size)


def page_features(text: str, tag: str | None = None) -> tuple:
    """One row of ``FEATURES`` for a text and its language tag."""
    script, n = script_of(text), len(text)
    low = text.lower()
    bare, links = text, 0.0
    if "/" in text:
        parts = _LINK.split(text)
        links = (n - sum(map(len, parts))) / n
        bare, low = "\x01".join(parts), " ".join(parts).lower()
    if "»" in text or "›" in text or " > " in text:
        links += len(_CHAIN.findall(text)) * 12 / n
    words = _WORD.findall(low)
    total = max(1, len(words))
    bare, marks = _TAG.subn("\x02", bare)
    least = 4 if script in ("latn", "cyrl", "grek") else 2
    top, most = "", 0
    for w, k in Counter(words).items():  # the first of the most frequent
        if k > most and len(w) >= least and not w.isdigit():
            top, most = w, k
    most = max(0, most - 1)  # repetitions
    # links and tags count as one mark each: they are redundant however they are spelt
    ratio = block_ratio(bare, len(text.encode("utf-8", "surrogatepass")))
    ends = informing = at = 0
    turning = most >= TURNING * total
    for m in _END.finditer(low):
        ends += 1
        stop = m.start()
        informing += stop - at >= LEAST_SENTENCE and not (turning and low.find(top, at, stop) >= 0)
        at = m.end()
    own = (tag or "").strip().lower()[:2]
    return script, script + "-" + own if own.isalpha() else script, sum(n >= x for x in LENGTH_CLASSES), ratio, ends / n, informing / n, links, marks / total, most / total


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col`` and ``FEATURES`` of every text that isn't blank."""

    def scan(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for pdf in pdfs:
            out = pd.DataFrame([page_features(t, x) for t, x in zip(pdf["_text"], pdf["_lang"])], columns=names)
            out.insert(0, "_id", pdf["_id"].to_numpy())
            yield out

    kind = df.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col).cast("string") if lang_col in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), lang.alias("_lang")).where(F.length(F.trim("_text")) > 0)
    return rows.mapInPandas(scan, f"_id {kind}, {FEATURES}").withColumnRenamed("_id", id_col)


def expected_ratios(features: DataFrame) -> DataFrame:
    """Median and spread (scaled median deviation) of the compression ratio, and median density of sentence ends, per language and length
    class: at most languages x length classes rows. Classes with few pages take the values of their script."""
    middle = lambda c: F.percentile_approx(c, 0.5, 1000)
    classes, scripts = ["script", "language", "len_class"], ["script", "len_class"]
    features = features.select(*classes, "ratio", "punct", "informing", "top").distinct()  # copies, which may be most of a class, count once
    own = features.groupBy(*classes).agg(middle("ratio").alias("own"), F.count("*").alias("n"))
    # tags are often wrong: a language is written in the script of most of its texts, and counts for itself only there
    tag = F.substring_index("language", "-", -1)
    written = own.groupBy("script", "language").agg(F.sum("n").alias("n_written"))
    tagged = written.groupBy(tag.alias("tag")).agg(F.sum("n_written").alias("n_tagged"))
    proper = written.join(tagged, tag == F.col("tag")).where(F.col("n_written") * 2 > F.col("n_tagged")).select("script", "language", F.lit(True).alias("proper"))
    own = own.join(proper, ["script", "language"], "left").withColumn("n", F.when(F.col("proper"), F.col("n")).otherwise(0)).drop("proper")
    every = features.groupBy(*scripts).agg(middle("ratio").alias("of_class"), F.count("*").alias("n_class"))
    script = features.groupBy("script").agg(middle("ratio").alias("of_script"), middle("punct").alias("usual_punct"))
    mid = own.join(every, scripts).join(script, "script")
    median = F.when(F.col("n") >= LEAST_PAGES, F.col("own")).when(F.col("n_class") >= LEAST_PAGES, F.col("of_class")).otherwise(F.greatest("own", "of_script"))
    mid = mid.select(*classes, median.alias("median"), "usual_punct", "n", "n_class")
    off = features.join(F.broadcast(mid), classes).withColumn("off", F.abs(F.col("ratio") - F.col("median")))
    spread = off.groupBy(*classes).agg((1.4826 * middle("off")).alias("spread"))
    wide = off.groupBy(*scripts).agg((1.4826 * middle("off")).alias("class_spread"))
    used = F.when(F.col("n") >= LEAST_PAGES, F.col("spread")).when(F.col("n_class") >= LEAST_PAGES, F.col("class_spread")).otherwise(USUAL_SPREAD)
    return mid.join(spread, classes).join(wide, scripts).select(*classes, "median", "usual_punct", used.alias("spread"))


def score_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every page with ``z`` (spreads from the expected ratio), ``redundancy``, ``informs`` (density of the ends of informing sentences
    against the script's usual density of ends) and ``kind`` of spam, null for other pages."""
    features = materialize(measure(df, id_col, text_col, lang_col), "page-features")
    scored = features.join(F.broadcast(expected_ratios(features)), ["script", "language", "len_class"]).withColumn("z", (F.col("ratio") - F.col("median")) / F.greatest("spread", F.lit(LEAST_SPREAD)))
    scored = scored.withColumn("redundancy", -F.col("z") + TOP_WEIGHT * F.col("top") + LINK_WEIGHT * F.col("links") + TAG_WEIGHT * F.col("tags"))
    scored = scored.withColumn("informs", F.coalesce(F.col("informing") / F.nullif("usual_punct", F.lit(0.0)), F.lit(0.0)))
    flagged = (F.col("redundancy") > REDUNDANT) & (F.col("informs") < INFORMS)
    shown = F.when(F.col("links") * LINK_WEIGHT >= F.greatest(F.col("top") * TOP_WEIGHT, F.col("tags") * TAG_WEIGHT), "links").when(F.col("tags") * TAG_WEIGHT > F.col("top") * TOP_WEIGHT, "tags").otherwise("keywords")
    return scored.withColumn("kind", F.when(flagged, shown))


def find_stuffed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col`` of the spam pages."""
    return score_pages(df, id_col, text_col, lang_col).where("kind IS NOT NULL").select(id_col).distinct()
