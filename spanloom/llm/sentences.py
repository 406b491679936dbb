"""Problem 6: sentence units of documents in any language.

First pass: for every language, counts of words with and without a period, of what follows a period, and of capitalised words at
sure beginnings and elsewhere. From these, log-likelihood ratios give the abbreviations (words bound to their period), the
sentence starters (capitalised words bound to beginnings) and the collocations over a period (a next word bound to the word or
number before it); abbreviations that starters follow may also end a sentence. Second pass: every period is classified with the
statistics of the text's language and the word after it; other marks need none. The language is the tag's, unless the text's words are
another's; the sets of all languages together serve texts without a known one. Quotations and parentheses never end the sentence around them. In Thai, a space between clauses ends a unit, and so does a learned beginning after a learned end.

Defined results: null, empty and blank texts have no units; every non-blank character is in exactly one; a line break of any kind
ends a unit; texts of any length are cut whole; copies are cut one by one; other columns are ignored. A corpus too small
to learn from still knows single letters as initials.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ABBREVIATION_CHARS = 8
#: An abbreviation needs this score, and one of this many tokens to be it; so there are at most TOKEN_SHARE of them.
ABBREVIATION_SCORE, TOKEN_SHARE, LEAST_COUNT = 0.3, 500_000, 3
STARTER_LEAST = 5
#: Log-likelihood at which a word is a sentence starter, or bound to the word before a period.
STARTER_SCORE, COLLOCATION_SCORE = 30, 7.88
#: So many of a language's most frequent words tell it.
COMMON_WORDS = 40
#: Stands for numbers of one or two digits before a period.
NUMBER = "0"
FLUSH_TOKENS = 200_000
#: So many pieces between spaces are kept with what they say of the language, each of at most so many characters.
KEPT_PIECES, PIECE_CHARS = 200_000, 40
#: Texts with longer pieces than this on average (without spaces between words) are counted by token at once.
MEAN_PIECE = 20

_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?")
#: Of a text with a line break put before it.
_START = re.compile(r"(?:\n[ \t ]*|!\s+|\?\s+)[“\"«„¿¡(]*([^\W\d_]+)")
_DOT = re.compile(r"\.(?=\s+[“\"«„(]*([^\W_]+)|([,;:)\]])|\s*$)", re.M)
_THAI = "ก-๛"
_CLOSERS = "\"'”’»›)\\]」』)】〉》"
#: A terminator with what closes after it; French marks stand apart. Periods that text goes on after in small letters or digits end nothing and are passed over; each mark stands by itself, as
#: alternatives of single characters are searched for faster.
_LOWER = "a-zß-öø-ÿа-яё"
_END = re.compile(rf"(?:\.(?![0-9{_LOWER}]| [{_LOWER}][{_LOWER} ,;:.'’-])|!|\?|…|。|\uff01|\uff1f|\uff0e|\uff61|।|॥|؟|۔)[.!?…。\uff01\uff1f\uff0e\uff61।॥؟۔]*(?:[{_CLOSERS}]|“(?=[\s,;:.)]|$)|[   ](?=»)»|[   ](?:»))*")
_THAI_LETTER = re.compile(f"[{_THAI}]")
_HAS_END = re.compile(r"[.!?…。\uff01\uff1f\uff0e\uff61।॥؟۔]")
_THAI_SPACE = re.compile(rf"(?<=[{_THAI}0-9”\"])[  ]+(?=[{_THAI}“\"])")
_OPENERS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "(": ")", "(": ")", "[": "]", "《": "》", "‚": "‘’", "‹": "›"}
_MARKS = re.compile(r"[“”«»„「」『』()()\[\]《》\"‹›]")
_WORD_BEFORE = re.compile(r"[^\W_]+(?:[.'’-][^\W_]+)*$")
_LAST_PART = re.compile(r"[.'’-]")
_WORD_AFTER = re.compile(r"[\s“\"«„¿¡(\[「『‘']*([^\W_]+)")
_MARKER = re.compile(r"^\W*(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)](?=\s)")
_JA_GOES_ON = "とってのはがをにでもなやか、,"
_NAMES = re.compile(r"[ऀ-ॿ]")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_URLISH = re.compile(r"://|www\.|@|\w\.\w{2,}/|/\w+\.\w", re.I)


class Votes(dict):
    """The languages that the words of a piece between spaces are frequent in, each as a character; no word goes over a space."""

    def __init__(self, common: dict[str, tuple[str, ...]]) -> None:
        super().__init__()
        self.common = common
        self.signs = {x: chr(k) for k, x in enumerate(sorted({x for langs in common.values() for x in langs}))}

    def __missing__(self, piece: str) -> str:
        said = "".join(self.signs[x] for w in _TOKEN.findall(piece) for x in self.common.get(w, ()))
        if len(piece) <= PIECE_CHARS:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = said
        return said

    def __reduce__(self) -> tuple:  # what is kept stays with its worker
        return Votes, (self.common,)


class Statistics:
    """What a corpus taught: abbreviations, those that may end a sentence, sentence starters, Thai ends and beginnings, and collocations
    over a period. ``languages`` has the same for each language, with its abbreviations known from others alone in
    ``foreign``; ``common`` has the languages that a word is frequent in."""

    def __init__(self, abbreviations: frozenset[str] = frozenset(), final: frozenset[str] = frozenset(), starters: frozenset[str] = frozenset(), thai_begin: frozenset[str] = frozenset(), thai_end: frozenset[str] = frozenset(), collocations: frozenset[tuple[str, str]] = frozenset()) -> None:
        self.abbreviations, self.final, self.starters, self.thai_begin, self.thai_end, self.collocations = abbreviations, final, starters, thai_begin, thai_end, collocations
        self.foreign: frozenset[str] = frozenset()
        self.languages: dict[str, Statistics] = {}
        self.common: dict[str, tuple[str, ...]] = {}
        self.votes = Votes(self.common)

    def of(self, text: str, tag: str | None) -> Statistics:
        """The statistics of a text's language; tags are often missing or wrong, so the text's own words count more: all of them, as a beginning may be a title, a menu or a quotation."""
        lang = language_of(tag)
        if self.votes.common is not self.common:
            self.votes = Votes(self.common)
        said = "".join(map(self.votes.__getitem__, text.split()))
        if said:
            seen = {x: said.count(sign) for x, sign in self.votes.signs.items()}
            most = max(seen.values())
            if most >= seen.get(lang, 0) + 3:
                lang = min(x for x, n in seen.items() if n == most)
        return self.languages.get(lang, self)


def language_of(tag: str | None) -> str:
    return (tag or "").strip().lower()[:2] or "?"


THAI_GRAM = 7


def count_tokens(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``kind, lang, a, b, n``. Kinds: 0 tokens, with or without period; 1 words at sure beginnings; 2 what follows short words with
    a period (or NUMBER): the next word, or its class; 3, 4 first and last characters of Thai clauses. Partial counts leave a worker, not tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, tokens, begins, follows, thai = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for text, tag in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    lang = language_of(tag)
                    own = text.split()
                    if len(own) * MEAN_PIECE >= len(text):
                        pieces[lang].update(own)
                    else:
                        tokens[lang].update(_TOKEN.findall(text))
                    begins[lang].update(_START.findall("\n" + text))
                    if "." in text:
                        follows[lang].update(dotted_words(text))
                    if not text.isascii() and _THAI_LETTER.search(text):
                        for line in _BREAK.split(text):
                            for clause in _THAI_SPACE.split(line.strip()):
                                if len(clause) > 3 * THAI_GRAM and "ก" <= clause[0] <= "๛":
                                    thai[3, clause[:THAI_GRAM]] += 1
                                    thai[4, clause[-THAI_GRAM:]] += 1
                if sum(map(len, pieces.values())) > FLUSH_TOKENS:
                    _count_pieces(pieces, tokens)
                if sum(map(len, tokens.values())) + sum(map(len, follows.values())) > FLUSH_TOKENS:
                    _count_pieces(pieces, tokens)
                    yield _rows(tokens, begins, follows, thai)
                    tokens, begins, follows, thai = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), Counter()
        _count_pieces(pieces, tokens)
        yield _rows(tokens, begins, follows, thai)

    rows = documents.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t IS NOT NULL")
    return rows.mapInArrow(scan, "kind int, lang string, a string, b string, n bigint").groupBy("kind", "lang", "a", "b").agg(F.sum("n").alias("n"))


def _count_pieces(pieces: dict[str, Counter], tokens: dict[str, Counter]) -> None:
    """Count the tokens of pieces between spaces, each different piece once; ``pieces`` is empty after."""
    for lang, counted in pieces.items():
        own = tokens[lang]
        for piece, n in counted.items():
            for w in _TOKEN.findall(piece):
                own[w] += n
    pieces.clear()


def dotted_words(text: str) -> Iterator[tuple[str, str, str]]:
    """Words of at most ABBREVIATION_CHARS letters, and NUMBER, before periods, each with the word or mark after the period."""
    for m in _DOT.finditer(text):
        at = m.start()
        if text[at - 1 : at].isdigit():
            begin = at - 2 if text[at - 2 : at - 1].isdigit() else at - 1
            if m.group(1) and begin > 0 and text[begin - 1] in " (":  # not the marker of a line
                yield NUMBER, m.group(1), ""
            continue
        word = text[max(0, at - ABBREVIATION_CHARS - 1) : at]
        word = word[word.rfind(" ") + 1 :]
        if not word.isalpha():
            begin = len(word)
            while begin and word[begin - 1].isalpha():
                begin -= 1
            word = word[begin:]
        if 0 < len(word) <= ABBREVIATION_CHARS:
            yield word, m.group(1) or "", m.group(2) or ""


def _rows(tokens: dict[str, Counter], begins: dict[str, Counter], follows: dict[str, Counter], thai: Counter) -> pa.RecordBatch:
    out = [(0, lang, w, "", n) for lang, c in tokens.items() for w, n in c.items()]
    out += [(1, lang, w, "", n) for lang, c in begins.items() for w, n in c.items()]
    out += [(2, lang, w, word or mark or "$", n) for lang, c in follows.items() for (w, word, mark), n in c.items()]
    out += [(kind, "th", w, "", n) for (kind, w), n in thai.items()]
    columns = zip(*out) if out else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=["kind", "lang", "a", "b", "n"])


def _log_likelihood(a: float, b: float, ab: float, n: float) -> float:
    """Dunning's ratio of a word and the period being bound against independent, of counts of the word, of periods, and both."""
    p1, p2 = b / n, 0.99
    null = ab * math.log(p1) + (a - ab) * math.log(1 - p1 + 1e-8)
    alternative = ab * math.log(p2) + (a - ab) * math.log(1 - p2)
    return -2 * (null - alternative)


def _association(a: float, b: float, ab: float, n: float) -> float:
    """Dunning's ratio of two events, of their counts, of both together and of all; 0 where they meet no more often than by chance."""
    if ab * n <= a * b:
        return 0.0

    def likelihood(k: float, m: float, p: float) -> float:
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (m - k) * math.log(1 - p)

    p, p1, p2 = b / n, ab / a, (b - ab) / max(1, n - a)
    return 2 * (likelihood(ab, a, p1) + likelihood(b - ab, n - a, p2) - likelihood(ab, a, p) - likelihood(b - ab, n - a, p))


def learn(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Statistics:
    """Statistics of a corpus. Candidates are filtered by their share of tokens before they come to the driver, so their number is
    bounded whatever the corpus."""
    from spanloom.session import materialize

    counts = materialize(count_tokens(documents, text_col, lang_col), "token-counts")
    tokens = counts.where("kind = 0")
    dotted_n = F.when(F.col("a").endswith("."), F.col("n")).otherwise(0)
    capital_n = F.when(~F.col("a").endswith(".") & (F.col("a") != F.lower("a")), F.col("n")).otherwise(0)
    sizes = {r["lang"]: (r["n"], r["dots"], r["capitals"]) for r in tokens.groupBy("lang").agg(F.sum("n").alias("n"), F.sum(dotted_n).alias("dots"), F.sum(capital_n).alias("capitals")).collect()}
    total = sum(x[0] for x in sizes.values()) or 1
    least = max(LEAST_COUNT, total // TOKEN_SHARE)
    bare = F.regexp_replace("a", r"\.$", "")
    every_word = tokens.groupBy("lang", F.lower(bare).alias("w")).agg(F.sum(dotted_n).alias("with_dot"), F.sum("n").alias("all"))
    words = every_word.where((F.col("with_dot") >= least) & (F.length("w") <= ABBREVIATION_CHARS)).collect()
    cased = tokens.where(~F.col("a").endswith(".")).select("lang", F.col("a").alias("w"), "n")
    begins = counts.where("kind = 1").select("lang", F.col("a").alias("w"), F.col("n").alias("n_start"))
    begun_all = {r["lang"]: r["n"] for r in begins.where(F.col("w") != F.lower("w")).groupBy("lang").agg(F.sum("n_start").alias("n")).collect()}
    lower = cased.groupBy("lang", F.lower("w").alias("lw")).agg(F.sum(F.when(F.col("w") == F.lower("w"), F.col("n")).otherwise(0)).alias("n_lower"))
    begun = begins.join(cased, ["lang", "w"], "left").withColumn("lw", F.lower("w")).join(lower, ["lang", "lw"], "left").na.fill(0, ["n", "n_lower"])
    floor = max(STARTER_LEAST, total // TOKEN_SHARE)
    begun = begun.where((F.col("n_start") >= floor) & (F.col("w") != F.col("lw"))).select("lang", "w", "n_start", "n", "n_lower").collect()
    starters: dict[str, set[str]] = defaultdict(set)
    for r in begun:  # bound to beginnings among capitalised words, or capitalised for its place alone
        score = _association(max(r["n"], r["n_start"]), begun_all[r["lang"]], r["n_start"], max(sizes[r["lang"]][2], begun_all[r["lang"]]))
        if score >= STARTER_SCORE or r["n_lower"] > r["n"]:
            starters[r["lang"]].add(r["w"])
    pairs = counts.where("kind = 2").groupBy("lang", F.lower("a").alias("w"), "b").agg(F.sum("n").alias("n"))
    followed = pairs.where(~F.col("b").isin(*",;:)]$"))
    follow: dict[tuple[str, str], Counter] = {}
    for r in pairs.where(F.col("n") >= max(2, least // 4)).collect():
        follow.setdefault((r["lang"], r["w"]), Counter())[r["b"]] += r["n"]
    any_starter = set().union(*starters.values())  # a language with few texts has few of its own
    # single letters that have a period more often than not are initials, which begin lines but no sentences
    letters = every_word.where(F.length("w") == 1).groupBy("w").agg(F.sum("with_dot").alias("dotted"), F.sum("all").alias("all")).where(F.col("dotted") * 2 > F.col("all")).collect()  # an alphabet
    initials = {r["w"].upper() for r in letters}
    any_starter -= initials
    for own in starters.values():
        own -= initials
    abbreviations: dict[str, set[str]] = defaultdict(set)
    for r in words:
        lang, w, dotted, every = r["lang"], r["w"], r["with_dot"], r["all"]
        n, dots, _ = sizes[lang]
        next_ = follow.get((lang, w), Counter())
        known = sum(next_.values())
        goes_on = sum(k for b, k in next_.items() if b in ",;:" or b[:1].islower() or b[:1].isdigit())
        starts = sum(k for b, k in next_.items() if b in any_starter)
        others = known - starts - next_.get("$", 0) - goes_on
        score = _log_likelihood(every, max(1, dots), dotted, max(2, n)) * math.exp(-len(w)) * math.pow(len(w), -(every - dotted))
        bound = dotted / every
        has_case = w[0] != w[0].upper()
        # single letters; words bound to their period that text goes on after; words before names only
        if len(w) == 1 or has_case and known >= 3 and ((score >= ABBREVIATION_SCORE or bound > 0.8) and goes_on > 0.25 * known or bound > 0.4 and goes_on + others > 0.55 * known and starts < 0.1 * known):
            abbreviations[lang].add(w)
    names = set().union(*abbreviations.values())
    seen = {(r["lang"], r["w"]): r["all"] for r in every_word.join(F.broadcast(documents.sparkSession.createDataFrame([(w,) for w in sorted(names)], "w string")), "w", "left_semi").collect()} if names else {}
    sums = {(r["lang"], r["w"]): r["n"] for r in followed.where((F.col("w") == NUMBER) | (F.length("w") > 1)).groupBy("lang", "w").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}
    after = {(r["lang"], r["b"]): r["n"] for r in followed.groupBy("lang", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}
    every_b = {(r["lang"], r["w"]): r["n"] for r in cased.join(followed.where((F.col("w") == NUMBER) & (F.col("n") >= least)).select("lang", F.col("b").alias("w")), ["lang", "w"], "left_semi").collect()}
    periods = {r["lang"]: r["n"] for r in followed.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    finals, collocations, starting = {}, defaultdict(set), {}
    for lang in sizes:
        own = abbreviations[lang]
        starting[lang] = {w for w in starters[lang] if w.lower() not in own}
        finals[lang] = set()
        for w in own:
            next_ = follow.get((lang, w), Counter())
            starts = sum(k for b, k in next_.items() if b in starting[lang])
            if len(w) > 1 and starts >= 3 and starts > 0.008 * sum(next_.values()):
                finals[lang].add(w)
    for (lang, w), next_ in follow.items():
        if w != NUMBER and w not in abbreviations[lang] or (lang, w) not in sums:
            continue
        for b, k in next_.items():
            if k < least or b in starting[lang] or not b[:1].isupper() or (lang, b) not in after:
                continue
            if w == NUMBER and not k <= every_b.get((lang, b), 0) < 2 * k:
                continue  # a name that stands elsewhere too, and begins sentences also after those that end in a number
            if _association(sums[lang, w], after[lang, b], k, periods[lang]) >= COLLOCATION_SCORE:
                collocations[lang].add((w, b))
    thai = counts.where("kind IN (3, 4)").where(F.col("n") >= max(LEAST_COUNT, total // TOKEN_SHARE)).select("kind", "a").collect()
    thai_begin, thai_end = (frozenset(r["a"] for r in thai if r["kind"] == k) for k in (3, 4))
    begin_words = {w for x in starters.values() for w in x if w.lower() not in names}
    out = Statistics(frozenset(names), frozenset().union(*finals.values()), frozenset(begin_words), thai_begin, thai_end, frozenset().union(*collocations.values()))
    for lang in sizes:
        if lang == "?":
            continue
        # abbreviations of other languages that this one has too few of to judge; its own starters show where they end a sentence
        unjudged = {w for w in names - abbreviations[lang] if seen.get((lang, w), 0) < least}
        out.languages[lang] = Statistics(frozenset(abbreviations[lang] | unjudged), frozenset(finals[lang] | unjudged & out.final), frozenset(starting[lang]), thai_begin, thai_end, frozenset(collocations[lang]))
        out.languages[lang].foreign = frozenset(w for w in unjudged if len(w) > 1)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    common: dict[str, list[str]] = defaultdict(list)
    for r in cased.where((F.col("lang") != "?") & (F.col("w") == F.lower("w")) & (F.length("w") <= ABBREVIATION_CHARS) & (F.col("n") >= least) & (F.upper("w") != F.col("w"))).withColumn("r", rank).where(F.col("r") <= COMMON_WORDS).select("lang", "w").collect():
        common[r["w"]].append(r["lang"])
    out.common = {w: tuple(sorted(x)) for w, x in common.items()}
    return out


def _enclosed(line: str) -> list[tuple[int, int]]:
    """Spans of quotations and parentheses, outermost only, from mark to mark; those that never close are ignored."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[int, str]] = []
    for m in _MARKS.finditer(line):
        c, at = m.group(), m.start()
        if stack and c in stack[-1][1]:
            begin, _ = stack.pop()
            if not stack:
                out.append((begin, at))
        elif c == '"':
            stack.append((at, '"'))
        elif c in _OPENERS:
            if c == "“" and any("“" in x for _, x in stack):
                while stack and "“" not in stack[-1][1]:
                    stack.pop()
                begin, _ = stack.pop()
                if not stack:
                    out.append((begin, at))
            else:
                stack.append((at, _OPENERS[c]))
        elif any(c in x for _, x in stack):
            while c not in stack[-1][1]:
                stack.pop()
            begin, _ = stack.pop()
            if not stack:
                out.append((begin, at))
    if stack:  # the outermost never closes: what lies inside counts by itself
        out += [(a + stack[0][0] + 1, b + stack[0][0] + 1) for a, b in _enclosed(line[stack[0][0] + 1 :])]
    return out


def _thai_breaks(line: str, stats: Statistics) -> list[int]:
    cuts = [m.end() for m in _THAI_SPACE.finditer(line)]
    if stats.thai_begin:
        g = THAI_GRAM
        for i in range(2 * g, len(line) - 2 * g):
            if line[i : i + g] in stats.thai_begin and line[i - g : i] in stats.thai_end and not ("ั" == line[i] or "ิ" <= line[i] <= "ฺ" or "็" <= line[i] <= "๎"):
                cuts.append(i)
    return sorted(set(cuts))


def split_line(line: str, stats: Statistics) -> list[int]:
    """Offsets in ``line`` at which a new unit begins, beside its own beginning."""
    cuts: list[int] = []
    if not line.isascii() and _THAI_LETTER.search(line) and sum("ก" <= c <= "๛" for c in line) * 3 > len(line):
        cuts = _thai_breaks(line, stats)
    marked = "(" in line or '"' in line or "[" in line if line.isascii() else _MARKS.search(line)
    spans = _enclosed(line) if marked else []
    start, n = 0, len(line)
    marker = _MARKER.match(line)
    k = 0
    for m in _END.finditer(line, marker.end() if marker else 0):
        at, end = m.start(), m.end()
        if end >= n:
            break
        while k < len(spans) and spans[k][1] < at:
            k += 1
        quote = None
        if k < len(spans) and spans[k][0] < at:
            if spans[k][1] >= end:
                continue  # inside a quotation or parenthesis
            quote = spans[k]
        if _begins_new(line, at, end, start, quote, stats):
            while end < n and line[end].isspace():
                end += 1
            if end >= n:
                break
            cuts.append(end)
            start = end
    return sorted(set(cuts)) if cuts else cuts


def _begins_new(line: str, at: int, end: int, start: int, quote: tuple[int, int] | None, stats: Statistics) -> bool:
    """Whether a unit ends with the mark at ``line[at:end]``, which is not inside an enclosure unless it closes it (``quote``)."""
    mark, following = line[at], line[end]
    if mark == "." and following == " " and end == at + 1:  # most marks: a word or number, a period, a space and a capital or digit
        head, token = line[end + 1 : end + 2], line[line.rfind(" ", 0, at) + 1 : at]
        if 1 < len(token) <= 40 and ("0" <= head <= "9" or head.isupper() and head.isalpha()):
            if token.isalpha():
                short = token.lower()
                if quote or short not in stats.abbreviations:
                    return True
                return _after_abbreviation(short, _WORD_AFTER.match(line, end).group(1), head, head, stats)
            if len(token) > 2 and token.isdigit():
                return True
    spaced = following.isspace()
    after = _WORD_AFTER.match(line, end)
    word = after.group(1) if after else ""
    head = word[:1]
    rest = line[end:].lstrip()
    if not rest:
        return False
    first = rest[0]
    if first in ",;:)]、,;:" or first in "–—-" and (len(rest) < 2 or rest[1].isspace()) and quote:
        return False
    if mark in "。\uff01\uff1f\uff0e\uff61" or (mark in "!?" and _CJK.match(line[at - 1 : at] or " ")):
        if quote:
            if first in _JA_GOES_ON and _CJK.match(first):
                return False
            return line[start : quote[0]].strip() != ""  # a quotation at the beginning is followed by its speaker
        return True
    if mark in "।॥؟۔":
        return line[start : quote[0]].strip() != "" if quote else True
    if mark == "…" or line.startswith("...", at) or line[at : at + 2] == "..":
        if _CJK.match(line[at - 1 : at] or " ") or line[at : at + 2] == "……":
            return False
        if line[at : at + 2] == ".." and line[at : at + 3] != "...":
            return head.isupper() or not head.islower()
        return bool(head) and not head.islower() and not head.isdigit() or first in "“«„¿¡"
    if mark in "!?":
        if not spaced:
            token = line[line.rfind(" ", 0, at) + 1 : end + 1]
            return (head.isupper() or first in "“«„¿¡(" or bool(_CJK.match(first))) and not _URLISH.search(token)
        if quote and head.islower():
            return False
        return not head.islower() or first in "“«„¿¡"
    # a period
    if head.islower() and word[1:2].isupper():
        head = head.upper()  # a name written like iName
    if head and "ऀ" <= head <= "ॿ":
        return False
    if not spaced:
        if at + 1 != end and line[end - 1] in "”»’\")":
            pass
        elif not (head.isupper() and first == head and (line[at - 1 : at].islower() or line[at - 1 : at].isdigit() or line[at - 1 : at] in "”»)%")) and not (first in "“«„¿¡" or head and "؀" <= head <= "ۿ"):
            return False
        token = line[line.rfind(" ", 0, at) + 1 : end]
        if _URLISH.search(token) or "." in token[: at - line.rfind(" ", 0, at) - 1] and not token[0].isdigit():
            return False
        if len(word) < 2 and (not word.isupper() or line[end + 1 : end + 2] == "."):
            return False  # letters of one abbreviation
    if spaced and _URLISH.search(line[line.rfind(" ", 0, at) + 1 : at]):
        return not head.islower()
    near = line[max(start, at - 40) : at]
    before = _WORD_BEFORE.search(near[near.rfind(" ") + 1 :])
    last = before.group() if before else ""
    if quote or not last:
        return not head.islower() or first in "¿¡"
    short = _LAST_PART.split(last)[-1].lower()
    whole = last.lower()
    if head.islower():
        return False
    if last.isdigit():
        if len(last) <= 2 and spaced and (NUMBER, word) in stats.collocations:
            return False
        return True
    if len(short) == 1 and short.isalpha() and (len(whole) == 1 or "." in whole):
        if len(whole) > 1:  # letters with periods between, as of the clock or states
            joined = whole.replace(".", "")
            if joined in ("am", "pm") or word in stats.starters:
                return bool(head) and not head.isdigit() and (head.isupper() or not head.isalpha())
            return False
        if head.isdigit():
            return False
        if "а" <= short <= "я":
            # a year or amount before it: the unit may end; else it stands before a name
            prior = line[max(0, at - 8) : at - 1].rstrip()
            return prior[-1:].isdigit() and word in stats.starters
        return False
    if short in stats.abbreviations or whole in stats.abbreviations:
        return _after_abbreviation(short, word, head, first, stats)
    return True


def _after_abbreviation(short: str, word: str, head: str, first: str, stats: Statistics) -> bool:
    """Whether a unit ends with the abbreviation ``short`` before ``word``; ``first`` is what follows the space, marks included."""
    if head.isdigit() or not word:
        return first in "“«„¿¡" and short in stats.final
    if (short, word) in stats.collocations:
        return False
    if short in stats.final:
        return head.isupper() and word.lower() not in stats.final
    return short in stats.foreign and word in stats.starters


def units(text: str | None, stats: Statistics, tag: str | None = None) -> tuple[array, array]:
    """Starts and ends of a text's units, in code points, by the statistics of its language."""
    starts, ends = array("i"), array("i")
    if not text:
        return starts, ends
    if stats.languages and "." in text:
        stats = stats.of(text, tag)
    at = 0
    for line in text.splitlines(keepends=True):  # at the breaks of _BREAK
        body = line.strip()
        if body:
            a = at + len(line) - len(line.lstrip()) if line[0].isspace() else at
            b = a + len(body)
            cuts = split_line(body, stats) if len(body) > 3 and (body.find(".", 0, -1) >= 0 or _HAS_END.search(body, 0, len(body) - 1) or not body.isascii() and "ก" <= max(body) and _THAI_SPACE.search(body) or stats.thai_begin and "ก" <= body[0] <= "๛") else ()
            begin = a
            for c in cuts:
                end = a + c
                while text[end - 1].isspace():
                    end -= 1
                if end > begin:
                    starts.append(begin)
                    ends.append(end)
                begin = a + c
            if b > begin:
                starts.append(begin)
                ends.append(b)
        at += len(line)
    return starts, ends


def sentence_units(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", stats: Statistics | None = None) -> DataFrame:
    """``id_col, start_off, end_off`` of all units."""
    own = stats or learn(documents, text_col, lang_col)
    kind = documents.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                index, starts, ends = [], array("i"), array("i")
                for text, tag in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    a, b = units(text, own, tag)
                    index.append(len(a))
                    starts.extend(a)
                    ends.extend(b)
                rows = pa.array(np.repeat(np.arange(len(index)), index))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(np.frombuffer(starts, np.int32) if len(starts) else np.empty(0, np.int32)), pa.array(np.frombuffer(ends, np.int32) if len(ends) else np.empty(0, np.int32))], names=["k", "start_off", "end_off"])

    rows = documents.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t IS NOT NULL")
    return rows.mapInArrow(scan, f"k {kind}, start_off int, end_off int").withColumnRenamed("k", id_col)
