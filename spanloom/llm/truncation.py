"""Problem 7: texts cut off by a field limit or a broken transfer.

Intact values are cut artificially: inside sentences and words for positive examples, at the ends of lines (headings, entries,
footers) for negative ones. A logistic regression over hashed features of the closing characters, the punctuation, the last
line's form, what was left of the cut and the length's distance to common limits learns from both, and scores every record.

The classifier is fitted on at most ``TRAIN_TEXTS`` texts of at most ``TRAIN_CHARS`` characters, those with the lowest hash. Counts of words and lengths
that features use cover all records. Defined results: null, empty and blank texts are no cases; a redelivered row is the same
record; texts of any length are scored, by their length and their end; other columns are ignored; without texts there are no cases.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.lines import _BULLET, furniture_kind, shape_of, title_statistics
from spanloom.llm.residue import shows_message
from spanloom.session import materialize

TRAIN_TEXTS, TRAIN_CHARS = 2000, 20_000
DIMENSIONS = 1 << 15
WORD_SLOTS = 1 << 18
#: A length is a limit if one record in so many has it and it is so many times as common as its neighbours.
LIMIT_SHARE, LIMIT_FACTOR, LIMIT_LEAST = 2000, 6, 5
THRESHOLD, SURE = 0.5, 0.9
#: An end of a line in Thai is one of a clause if at least this share of all such lines has it, and two of them.
ENDS_SHARE, ENDS_LEAST = 1e-4, 2

#: What a cut leaves behind it.
TRACE = re.compile(r"(?:\s*(?:\[\s*[+＋]\s*\d[\d., ]*\s*(?:chars?|characters|more|zeichen|caracteres|caractères|字)?\s*\]|\[(?:…|\.\.\.|truncated|cut|gekürzt|more)\]|\((?:…|\.\.\.|more|truncated)\)|<truncated>|(?:read|see|show) more\s*[»›>→]?|continue reading\s*[»›>→]?|weiterlesen|leer más|lire la suite|ler mais|(?-i:&[a-z#]{1,5}\d{0,4};?|</?[a-z]{0,10})|…|\.\.\.|�))+\s*$", re.I)
_CERTAIN = re.compile(r"\[\s*[+＋]\s*\d[\d., ]*\s*\w*\s*\]|\[(?:truncated|…|\.\.\.)\]|\((?:truncated)\)|<truncated>", re.I)
#: Entries of lists and sources: what ends in a number, a date or a quoted title after a comma or colon, or in an address.
_ENTRY = re.compile(r"(?:[:,–—]\s*\d[\d.,   ]*|[,–—]\s*(?:\d{1,2}\.?\s)?[^\W\d_]+\.?\s(?:\d{1,2},\s)?\d{4}|,\s[“«„][^”»“]+[”»“]|(?:https?://|www\.)\S+)$")
_PLACED = re.compile(r"^(?:[^\W\d_][\w.'’-]*\s?){1,7},\s[^\W\d_][\w.'’-]*(?:\s[^\W\d_][\w.'’-]*){0,2}$")
_CLOSED = re.compile(r"[.!?…。\uff01\uff1f।؟۔:;][\"'”’»」』)\]*_]*$")
_TOKEN = re.compile(r"[^\W_]+(?:[-'’.][^\W_]+)*|[^\w\s]")
#: How lines in Thai end; as no mark ends its clauses, an end that no other line has tells of a cut.
_THAI_END = re.compile(r"([ก-๛]{4})[ \t\r]*$", re.M)
_PAIR = re.compile(r"^[^.,!?\u3002\uff01\uff1f]{2,40},\s[^.,!?\u3002\uff01\uff1f]{2,30}$")
_LETTER = re.compile(r"[^\W\d_]+")
_ABBREVIATED = re.compile(r"(?:^|[\s(“\"«„])(?:[^\W\d_]\.|(?:[Dd]r|Mr|Mrs|Ms|Prof|Gen|Sen|Rep|Capt|Judge|St|Mt|Nr|No|Nos|Art|Abs|Sec|Reg|Fig|Vol|approx|incl|e\.g|i\.e|cf|vs|ca|bzw|d\. h|z\. B|u\. a|Hr|Fr|Sr|Sra|Dra|Mme|M|Mlle|núm|pág|p\. ex|n\.º|art|стр|см|т\. е|др|проф|г|руб|тыс|д-р|प्रो|डॉ|रु|د|أ)\.)$")


def script_class(text: str) -> str:
    for name, a, b in (("thai", "ก", "๛"), ("deva", "ऀ", "ॿ"), ("arab", "؀", "ۿ"), ("cyrl", "Ѐ", "ӿ"), ("cjk", "぀", "鿿")):
        if sum(a <= c <= b for c in text) * 3 > len(text):
            return name
    return "latn"


class Corpus:
    """Counts over all records: words, limits of length, and the forms of titles."""

    def __init__(self, words: np.ndarray, limits: frozenset[int], byte_limits: frozenset[int], frequent: frozenset[str], shapes: frozenset[str], n_texts: int = 0, ends: frozenset[str] = frozenset()) -> None:
        self.words, self.limits, self.byte_limits, self.frequent, self.shapes, self.n_texts, self.ends = words, limits, byte_limits, frequent, shapes, n_texts, ends

    def word_count(self, word: str) -> int:
        return int(self.words[_slot(word)])


def _slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_SLOTS


def end_of(text: str) -> tuple[str, str, int]:
    """The text without what a cut left behind it, that trace, and the length of the rest."""
    body = text.rstrip()
    m = TRACE.search(body[-160:])
    if not m:
        return body, "", len(body) if body == text else len(text)
    cut = len(body) - len(body[-160:]) + m.start()
    return body[:cut].rstrip(), body[cut:].strip(), cut


def features(text: str, corpus: Corpus) -> list[str]:
    """The features of a record's end, as strings to be hashed."""
    body, trace, size = end_of(text)
    at = body.rfind("\n") + 1
    line = body[at:].strip()
    before = body[:at].rstrip()
    previous = before[before.rfind("\n") + 1 :].strip()
    tail = line[-160:]
    tokens = _TOKEN.findall(tail)
    last = tokens[-1] if tokens else ""
    letters = _LETTER.findall(tail)
    word = letters[-1].lower() if letters and tail.endswith(letters[-1]) else ""
    script = script_class(tail)
    closed = bool(_CLOSED.search(tail))
    abbreviated = closed and bool(_ABBREVIATED.search(tail[-16:]))
    kind = furniture_kind(line) if len(line) <= 200 else None
    bullet = bool(_BULLET.match(line))
    shaped = len(line) <= 160 and shape_of(line, corpus.frequent) in corpus.shapes
    raw = len(text.encode("utf-8", "surrogatepass"))
    limit = "at" if size in corpus.limits or len(text) in corpus.limits or size + 1 in corpus.limits else "byte" if raw in corpus.byte_limits else "no"
    known = corpus.word_count(word) if word else -1
    form = "none" if not word else "new" if known <= 2 else "rare" if known <= 8 else "some" if known <= 60 else "common"
    sentences = len(re.findall(r"[.!?。\uff01\uff1f।؟]\s", line))
    long = "long" if len(line) > 140 else "mid" if len(line) > 70 else "short" if len(line) > 25 else "tiny"
    end = "open" if not closed else "abbr" if abbreviated else "closed"
    quotes = line.count("“") != line.count("”") or line.count("«") != line.count("»") or line.count("(") > line.count(")")
    mark = "sure" if _CERTAIN.search(trace) else "dots" if "…" in trace or "..." in trace else "lost" if "�" in trace else "more" if trace else "none"
    opening = " ".join(t.lower() for t in _TOKEN.findall(line[:60])[:2])
    style = "furniture" if kind in ("furniture", "head") else "subhead" if kind else "bullet" if bullet else "title" if shaped else "text"
    out = [
        "bias", f"end={end}", f"script={script}", f"end={end},script={script}", f"limit={limit}", f"limit={limit},end={end}", f"trace={mark}", f"trace={mark},end={end}", f"style={style}", f"style={style},end={end}",
        f"form={form},script={script}", f"form={form},end={end},style={style}", f"len={long},end={end},style={style}", f"sent={min(sentences, 3)},end={end}", f"quotes={quotes},end={end}", f"last={last.lower()},{end}", f"close={tail[-2:]}", f"close4={tail[-4:]},{script}", f"open={opening},{end}", f"first={opening.split(' ')[0]},{end}",
        f"comma={',' in line},{end},{style}", f"digit={tail[-1:].isdigit()},{end},{style},{long}", f"upper={line[:1].isupper()},{end}", f"prev={previous[-1:] in '.!?。'},{end},{style}", f"colon={':' in line},{end}",
    ]
    return out


def _hashed(names: list[str]) -> np.ndarray:
    return np.fromiter((_slot(x) % DIMENSIONS for x in names), dtype=np.int64, count=len(names))


def artificial(text: str, rng: random.Random) -> list[tuple[str, int]]:
    """Examples made of an intact text: cuts inside its lines (1), and at their ends (0)."""
    lines = text.split("\n")
    starts = np.cumsum([0, *(len(x) + 1 for x in lines)])
    out = [(text, 0)]
    inner = [i for i, x in enumerate(lines) if len(x.strip()) > 45 and furniture_kind(x.strip()) is None]
    ends = [i for i, x in enumerate(lines) if x.strip()]
    for _ in range(3):
        if inner:
            i = rng.choice(inner)
            cut = text[: starts[i] + rng.randrange(8, max(9, len(lines[i]) - 4))]
            if _CLOSED.search(cut.rstrip()) and not cut.endswith(" "):
                continue
            out.append((cut + rng.choice(["", "", "", "", "…", "...", " […]", " …", f"… [+{rng.randrange(20, 4000)} chars]"]), 1))
        i = rng.choice(ends)
        out.append((text[: starts[i] + len(lines[i])], 0))
    return out


def fit(texts: list[str], corpus: Corpus, seed: int = 7, rounds: int = 8) -> tuple[np.ndarray, float]:
    """Weights over hashed features, and the share of held-out artificial examples (a fifth) that they get right."""
    rng = random.Random(seed)
    examples = [x for t in texts for x in artificial(t, rng)]
    rng.shuffle(examples)
    rows = [_hashed(features(t, corpus)) for t, _ in examples]
    if not rows:
        return np.zeros(DIMENSIONS, np.float32), 0.0
    x, y = np.stack(rows), np.array([k for _, k in examples], dtype=np.float64)
    held = max(1, len(y) // 5)
    w, g2 = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6)
    for _ in range(rounds):
        for at in range(held, len(y), 64):
            xs, ys = x[at : at + 64], y[at : at + 64]
            error = 1 / (1 + np.exp(-w[xs].sum(1))) - ys
            gradient = np.zeros(DIMENSIONS)
            np.add.at(gradient, xs, error[:, None])
            touched = np.unique(xs)
            gradient[touched] += 1e-2 * w[touched]
            g2[touched] += gradient[touched] ** 2
            w[touched] -= 0.3 * gradient[touched] / np.sqrt(g2[touched])
    right = ((w[x[:held]].sum(1) > 0) == (y[:held] > 0.5)).mean()
    return w.astype(np.float32), float(right)


def corpus_counts(pages: DataFrame) -> Corpus:
    """``Corpus`` of all records (``text, title, publisher``); what comes to the driver has a fixed bound."""

    def scan(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, chars, sizes, ends = Counter(), Counter(), Counter(), Counter()
        met: set[int] = set()  # the length of a text that many rows have is no limit
        for pdf in pdfs:
            for t in pdf["text"]:
                if hash(t) in met:
                    continue
                met.add(hash(t))
                _, _, n = end_of(t)
                chars[n] += 1
                sizes[len(t.encode("utf-8", "surrogatepass"))] += 1
                words.update(_LETTER.findall(t.lower()))
                if not t.isascii() and _THAI_END.search(t):
                    ends.update(_THAI_END.findall(t[: t.rstrip().rfind("\n") + 1]))
            if len(words) > 200_000:
                yield _counted(words, chars, sizes)
                words, chars, sizes = Counter(), Counter(), Counter()
        yield _counted(words, chars, sizes)
        yield _counted(Counter(), Counter(), Counter(), ends)

    counts = pages.where("text IS NOT NULL").select("text").mapInPandas(scan, "kind int, value bigint, word string, n bigint").groupBy("kind", "value", "word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "length-counts")  # several parts of the plan below read it
    lengths = counts.where("kind IN (1, 2)").withColumn("near", F.floor(F.col("value") / 50))
    around = lengths.groupBy("kind", "near").agg(F.sum("n").alias("all"), F.count("*").alias("of"))
    total = lengths.groupBy("kind").agg(F.sum("n").alias("total"))
    limits = (
        lengths.join(around, ["kind", "near"])
        .join(F.broadcast(total), "kind")  # two rows
        .where((F.col("n") >= LIMIT_LEAST) & (F.col("n") * LIMIT_SHARE >= F.col("total")) & (F.col("n") * 50 >= LIMIT_FACTOR * (F.col("all") - F.col("n") + 1)))
        .select("kind", "value", "n")
    )
    texts = total.where("kind = 1").select(F.lit(3).alias("kind"), F.lit(0).cast("bigint").alias("value"), F.col("total").alias("n"))
    rows = counts.where("kind = 0").select("kind", "value", "n").unionByName(limits).unionByName(texts).toPandas()  # at most WORD_SLOTS + 2 x LIMIT_SHARE + 1 rows
    words = np.zeros(WORD_SLOTS, np.int64)
    own = rows[rows["kind"] == 0]
    words[own["value"].to_numpy()] = own["n"].to_numpy()
    frequent, shapes = title_statistics(pages)
    n_texts = int(rows[rows["kind"] == 3]["n"].sum())
    lines = counts.where("kind = 4")
    least = max(ENDS_LEAST, math.ceil(ENDS_SHARE * (lines.agg(F.sum("n")).first()[0] or 0)))
    ends = frozenset(r["word"] for r in lines.where(F.col("n") >= least).select("word").collect())  # at most 1 / ENDS_SHARE
    return Corpus(words, *(frozenset(rows[rows["kind"] == k]["value"].tolist()) for k in (1, 2)), frequent, shapes, n_texts, ends)


def _counted(words: Counter, chars: Counter, sizes: Counter, ends: Counter | None = None) -> pd.DataFrame:
    slots: Counter = Counter()
    for w, n in words.items():
        slots[_slot(w)] += n
    rows = [(k, v, None, n) for k, c in enumerate((slots, chars, sizes)) for v, n in c.items()] + [(4, 0, w, n) for w, n in (ends or {}).items()]
    return pd.DataFrame(rows, columns=["kind", "value", "word", "n"]).astype({"kind": "int32", "value": "int64", "word": object, "n": "int64"})


def training_texts(pages: DataFrame, limits: frozenset[int], n_texts: int) -> list[str]:
    """At most TRAIN_TEXTS intact texts: those that end with a sentence or in Thai script, bear no trace of a cut, and are not as long as a limit."""
    # only hashes that some three times TRAIN_TEXTS have are looked at, so tasks send few texts, however many there are
    share = min(1.0, 3 * TRAIN_TEXTS / max(1, n_texts))
    few = pages.select("text", F.xxhash64("text").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    few = few.where((F.length("text") <= TRAIN_CHARS) & (F.length("text") >= 200) & F.col("text").rlike("[.!?。\uff01\uff1f।؟][\"'”’»」』)]*\\s*$|[ก-๛]\\s*$"))
    few = few.groupBy("h").agg(F.first("text").alias("text"))  # copies count once
    rows = few.orderBy("h").limit(TRAIN_TEXTS).select("text").collect()
    return [r[0] for r in rows if not TRACE.search(r[0][-160:]) and len(r[0]) not in limits]


class Classifier:
    def __init__(self, pages: DataFrame) -> None:
        self.corpus = corpus_counts(pages)
        self.weights, self.held_out = fit(training_texts(pages, self.corpus.limits, self.corpus.n_texts), self.corpus)

    def score(self, text: str | None) -> float:
        if not text or not text.strip():
            return 0.0
        return float(1 / (1 + np.exp(-self.weights[_hashed(features(text, self.corpus))].sum())))

    def is_cut(self, text: str | None) -> bool:
        """The classifier's decision, and what it can't know: furniture is no article, and a script without full stops, or a heading
        or entry, shows a cut only by its trace or a limit."""
        if not text or not text.strip():
            return False
        body, trace, size = end_of(text)
        line = body[body.rfind("\n") + 1 :].strip()
        thai = script_class(line[-160:]) == "thai"
        if thai and (m := _THAI_END.search(line)) and m.group(1) not in self.corpus.ends and "\n" in body:
            return True
        if self.score(text) < THRESHOLD:
            return False
        if _CERTAIN.search(trace):
            return True
        if len(line) <= 200 and (furniture_kind(line) is not None or shows_message(line)):
            return False
        at_limit = size in self.corpus.limits or len(text) in self.corpus.limits or len(text.encode("utf-8", "surrogatepass")) in self.corpus.byte_limits
        if at_limit or trace:
            return True
        if thai:
            return self.score(text) > SURE
        entry = _BULLET.sub("", line)
        if len(line) <= 75 and _PAIR.match(entry) and (entry != line or script_class(line) == "cjk"):
            return False
        if _entry_like(line):
            # words with a comma may as well be the beginning of a sentence: among entries they are one, else a high score says that they aren't
            above = [x for x in map(str.strip, body[: body.rfind("\n") + 1].split("\n")) if x][-1:]
            if any(_BULLET.match(x) or _entry_like(x) for x in above) or self.score(text) < SURE:
                return False
        return len(line) > 160 or shape_of(line, self.corpus.frequent) not in self.corpus.shapes


def _entry_like(line: str) -> bool:
    return len(line) <= 110 and bool(_ENTRY.search(line)) or len(line) <= 60 and bool(_PLACED.match(line))


def score_records(pages: DataFrame, keys: list[str], classifier: Classifier | None = None) -> DataFrame:
    """``keys, publisher, is_cut`` of every row."""
    own = classifier or Classifier(pages)
    shared = pages.sparkSession.sparkContext.broadcast(own)  # tables of fixed size

    @F.pandas_udf("boolean")
    def cut(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.is_cut(t) for t in text], dtype=bool)

    return pages.select(*keys, "publisher", cut("text").alias("is_cut"))
