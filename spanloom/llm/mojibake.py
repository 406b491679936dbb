"""Problem 4: text decoded with the wrong character encoding.

Adjacent character pairs with a character outside ASCII are counted over the whole corpus, in a table of fixed size. A pair's
association is its discounted pointwise mutual information: near nothing for pairs that are rare in the corpus, however
closely their characters keep together. Runs of improbable pairs are isolated as maximum-scoring segments, and only inside
those are inverse mappings tried: the characters go back to bytes by the encoding that was wrongly used, and are read by the
one that was meant. A mapping holds if the bytes make whole characters that the corpus knows better.

Defined results: null and empty values are sound; U+FFFD marks are a case unless they only end a cut text; a value of any length
is searched whole and copies of it count as one record; other columns are ignored; an empty table has no cases.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the tables of pair and character counts, whatever the corpus.
PAIR_SLOTS, CHAR_SLOTS = 1 << 20, 1 << 16
#: At most so many values have so large a share of all rows.
HEAVY_COPIES = 1000
#: A pair needs this share of all counted pairs for half of its mutual information to count.
DISCOUNT_SHARE = 3e-3
#: More mutual information counts as this much: characters seen only together are no better than common pairs.
MOST_BITS = 5.0
#: Pairs with less association than this are improbable; a segment needs this much in sum.
IMPROBABLE, SEGMENT = 0.6, 0.5
#: Two improbable stretches with at most so many ASCII pairs between them may be one segment; each costs PLAIN_COST.
PLAIN_COST = 0.25

#: A mapping must raise the summed association, less what is improbable, by this much.
GAIN = 0.15
#: Characters that bind to nothing.
_INVISIBLE = "\ufeff\xa0\xad\u200b\u200e\u200f\u2009\u202f"
_HIGH = re.compile(r"[^\x00-\x7f]+")
#: Control characters that only wrong decoding leaves in a text.
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
#: Beginnings of sequences read byte by byte; what is left of them where the other bytes were lost can't be restored.
_LEFTOVER = re.compile("â€|ï¿½|Ã[\xa1-\xbf]|Â[\xa1-\xbf]")
_MARK_AT_END = re.compile(r"�+[\s.…]*(?:\[[^\]\n]{0,40}\])?\s*$")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")

#: Single-byte encodings that are used by mistake for UTF-8, and for one another.
WRONG = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp1250")
#: Double-byte encodings used by mistake for UTF-8; their leftovers may be lost.
WRONG_WIDE = ("gbk", "shift_jis", "big5", "euc_kr")
#: Encodings of other scripts that are read as Western ones.
MEANT = ("cp1251", "koi8_r", "cp866", "cp1253", "cp1255", "cp1256", "cp874", "shift_jis", "euc_jp", "gbk", "big5", "euc_kr", "mac_cyrillic", "iso8859_5")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
WESTERN = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437")


@functools.lru_cache(maxsize=None)
def to_byte(encoding: str) -> dict[str, int]:
    """Characters to bytes; bytes without a character stand for themselves, as many programs read them."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    if encoding == "cp1252":
        table |= {chr(b): b for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    return table


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((a.astype(np.uint64) * np.uint64(0x9E3779B1)) ^ (b.astype(np.uint64) * np.uint64(0x85EBCA77))) >> np.uint64(7)).astype(np.int64) & (PAIR_SLOTS - 1)


def _char_slots(a: np.ndarray) -> np.ndarray:
    return np.where(a < 0xC000, a, 0xC000 + a % 0x4000).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def high_pairs(points: np.ndarray) -> np.ndarray:
    """Positions i whose pair (i, i + 1) has a character outside ASCII."""
    high = points >= 0x80
    return np.flatnonzero(high[:-1] | high[1:])


def count_pairs(values: DataFrame, col: str) -> DataFrame:
    """``kind, slot, n``: counts of pairs (kind 0) and of their first (1) and second (2) characters; a fixed number of rows. A value
    that makes up one in HEAVY_COPIES of all rows counts once, as its copies say nothing new."""
    rows = values.select(F.col(col).alias("v")).where("v IS NOT NULL").withColumn("h", F.xxhash64("v"))
    copies = rows.groupBy("h").agg(F.count("*").alias("n"))
    total = copies.agg(F.sum("n")).first()[0] or 0
    heavy = {r["h"]: r["n"] for r in copies.where((F.col("n") > 1) & (F.col("n") * HEAVY_COPIES >= total)).collect()}  # at most HEAVY_COPIES

    def scan(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, first, second = np.zeros(PAIR_SLOTS), np.zeros(CHAR_SLOTS), np.zeros(CHAR_SLOTS)
        met: dict[int, list] = {}  # copies of heavy values in this part

        def add(texts: list[str], weight: float = 1.0) -> None:
            p = _points("\x00".join(texts))
            i = high_pairs(p)
            a, b = p[i], p[i + 1]
            for counts, slots in ((pairs, _slots(a, b)), (first, _char_slots(a)), (second, _char_slots(b))):
                np.add(counts, np.bincount(slots, minlength=len(counts)) * weight if weight != 1 else np.bincount(slots, minlength=len(counts)), out=counts)

        for pdf in pdfs:
            texts = []
            for t, h in zip(pdf["v"], pdf["h"]):
                if t and not t.isascii():
                    if h in heavy:
                        met.setdefault(h, [t, 0])[1] += 1
                    else:
                        texts.append(t)
            for at in range(0, len(texts), 256):
                add(texts[at : at + 256])
        for h, (t, n) in met.items():
            add([t], n / heavy[h])
        for kind, counts in enumerate((pairs, first, second)):
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"kind": np.full(len(at), kind, np.int32), "slot": at.astype(np.int32), "n": counts[at]})

    return rows.mapInPandas(scan, "kind int, slot int, n double").groupBy("kind", "slot").agg(F.sum("n").alias("n"))


class Associations:
    """The corpus's pair statistics, small enough for any worker."""

    def __init__(self, counts: pd.DataFrame) -> None:
        arrays = []
        for kind, size in enumerate((PAIR_SLOTS, CHAR_SLOTS, CHAR_SLOTS)):
            rows, out = counts[counts["kind"] == kind], np.zeros(size, np.float32)
            out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
            arrays.append(out)
        self.pairs, self.first, self.second = arrays
        self.total = max(1.0, float(self.pairs.sum()))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Discounted mutual information of pairs."""
        n = self.pairs[_slots(a, b)]
        expected = self.first[_char_slots(a)] * self.second[_char_slots(b)] / self.total
        return n / (n + DISCOUNT_SHARE * self.total) * np.minimum(np.log2(1 + n / np.maximum(expected, 1e-3)), MOST_BITS)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "cache"}

    def pair(self, two: str) -> float:
        """The association of one pair; that of plain ASCII is no evidence and counts as neutral."""
        cache = self.__dict__.setdefault("cache", {})
        found = cache.get(two)
        if found is None:
            if len(cache) > 200_000:
                cache.clear()
            p = _points(two)
            found = cache[two] = IMPROBABLE if two.isascii() else float(self.of(p[:1], p[1:])[0])
        return found

    def excess(self, text: str) -> float:
        """The sum by which the pairs of a text are more than improbable."""
        return sum(self.pair(text[i : i + 2]) for i in range(len(text) - 1)) - IMPROBABLE * (len(text) - 1)

    def mean(self, text: str) -> float:
        return self.excess(text) / max(1, len(text) - 1) + IMPROBABLE

    def familiar(self, text: str) -> float:
        """How often characters outside ASCII occur, as the mean of logarithms."""
        logs = [math.log1p(self.known(c)) for c in text if c > "\x7f" and c != "�"]
        return sum(logs) / max(1, len(logs))

    def known(self, char: str) -> float:
        """How often the character occurs, in counted pairs."""
        cache = self.__dict__.setdefault("cache", {})
        found = cache.get(char)
        if found is None:
            s = _char_slots(_points(char))
            found = cache[char] = float(max(self.first[s[0]], self.second[s[0]]))
        return found


def improbable_segments(text: str, stats: Associations) -> list[tuple[int, int]]:
    """Disjoint maximum-scoring segments of ``text`` over its pair scores, as spans of characters."""
    p = _points(text)
    i = high_pairs(p)
    if not len(i):
        return []
    score = IMPROBABLE - stats.of(p[i], p[i + 1])
    out: list[tuple[int, int]] = []
    best = total = 0.0
    start = end = last = -1
    for at, s in zip(i.tolist(), score.tolist()):
        total -= PLAIN_COST * (at - last - 1) if start >= 0 else 0
        last = at
        if start >= 0 and total <= 0 or start >= 0 and total < best - 2 * SEGMENT:
            if best >= SEGMENT:
                out.append((start, end))
            start, total, best = -1, 0.0, 0.0
        if start < 0:
            if s <= 0:
                continue
            start, total, best = at, 0.0, 0.0
        total += s
        if total > best:
            best, end = total, at + 2
    if start >= 0 and best >= SEGMENT:
        out.append((start, end))
    return out


@functools.lru_cache(maxsize=None)
def _sequence(encoding: str) -> re.Pattern:
    """Characters that, as bytes, begin and continue a UTF-8 sequence."""
    table = to_byte(encoding)
    lead = "".join(re.escape(c) for c, b in table.items() if 0xC2 <= b <= 0xF4)
    more = "".join(re.escape(c) for c, b in table.items() if 0x80 <= b <= 0xBF)
    return re.compile(f"[{lead}][{more}]")


def _from_single(run: str, encoding: str, stats: Associations, left: str = "", right: str = "", again: int = 2) -> str | None:
    """The run with every UTF-8 sequence in it put right, or None if that gives nothing the corpus knows better."""
    table = to_byte(encoding)
    raw = bytes(table.get(c, 0) for c in run)
    found = list(_UTF8.finditer(raw))
    if sum(m.end() - m.start() for m in found) * 2 < len(run) or not found:
        return None  # chance, in letters of another encoding
    out, at, known = [], 0, 0
    for m in found:
        c = m.group().decode("utf-8")
        known += c in _INVISIBLE or stats.known(c) >= 2
        out += [run[at : m.start()], c]
        at = m.end()
    out.append(run[at:])
    text = "".join(out)
    if known < len(found) and (len(found) < 3 or known * 2 < len(found)):
        # decoded wrongly more than once, perhaps, with a step between that the corpus never shows
        return _from_single(text, encoding, stats, left, right, again - 1) if again else None
    if all(c in _INVISIBLE for c in text) or stats.excess(left + text + right) > stats.excess(left + run + right) + GAIN:
        return text
    return None


def _strict(run: str, encoding: str, stats: Associations) -> str | None:
    """A run that is nothing but UTF-8 sequences of known characters."""
    table = to_byte(encoding)
    if len(run) < 2 or not all(c in table for c in run):
        return None
    try:
        text = bytes(table[c] for c in run).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if all(c in _INVISIBLE or stats.known(c) >= 2 for c in set(text)) else None


def _from_wide(run: str, encoding: str, stats: Associations) -> tuple[str, bool] | None:
    """The run read back through a double-byte encoding; False if bytes were lost."""
    raw = run.replace("�", "?").encode(encoding, "replace")
    sequences = _UTF8.findall(raw)
    known = sum(stats.known(s.decode()) >= 2 for s in sequences)
    gaps = raw.count(b"?")  # lost bytes, each beside at most two that are left of its character
    if not sequences or sum(map(len, sequences)) + 3 * gaps < len(raw) or known * 4 < len(sequences) * 3 or (len(sequences) < 2 and len(run) > 2 + gaps):
        return None
    back = "".join(s.decode() for s in sequences)
    # characters that wrong decoding makes are rarer than those they stand for, whatever the corpus consists of
    if stats.familiar(back) <= stats.familiar(run) or stats.excess(back) <= stats.excess(run) + GAIN:
        return None
    text = raw.decode("utf-8", "replace")
    return text, "�" not in text and "?" not in text


_WIDE = re.compile("[⺀-鿿ｦ-ﾟ가-힣]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
#: What wrongly read Cyrillic has and words of Cyrillic languages hardly have: capitals after small letters, frames, stray symbols.
_ODD_CYRILLIC = re.compile("[а-яё][А-ЯЁ]|[\u2190-\u25ff]|[ЂЃѓЉЊЌЋЏђљњќћџ]|[Ѐ-ӿ][\xa1-\xb0\xb1-\xb6\xb8-\xba\xbc-\xbf]")
#: Without any of these a segment is plain text of one of the other scripts.
_SUSPECT = re.compile("[\x80-\x9f\xa1-\u058f\u2039-\u203a\u20ac-\u2bff⺀-\u303f㐀-鿿\uf000-\uffff]|[\xa0\u2010-\u2038][^\x00-\x7f]")
_SCRIPT = re.compile(r"[Ѐ-ӿ]+|[Ͱ-Ͽ]+|[֐-׿]+|[؀-ۿ]+|[฀-๿]+|[぀-ヿ一-鿿ｦ-ﾟ]+|[가-힣]+")


def _from_other(run: str, stats: Associations) -> tuple[str, tuple[str, str]] | None:
    """Words of another script whose bytes were read as Western letters, with the encodings used and meant."""
    best, found = stats.mean(run) + 0.12, None
    for wrong in WESTERN:
        table = to_byte(wrong)
        if not all(c in table for c in run):
            continue
        raw = bytes(table[c] for c in run)
        for meant in MEANT:
            try:
                text = raw.decode(meant)
            except UnicodeDecodeError:
                continue
            if sum(map(len, _SCRIPT.findall(text))) * 10 < len(text) * 9 or text.isupper() != run.isupper() and text.swapcase().istitle():
                continue
            if (score := stats.mean(text)) > best:
                best, found = score, (text, (wrong, meant))
    return found


def reread(text: str, wrong: str, meant: str) -> str | None:
    """A whole text back to bytes by one encoding and read by another; None if a character or byte doesn't fit."""
    table = to_byte(wrong)
    try:
        return bytes(ord(c) if c < "\x80" else table[c] for c in text).decode(meant)
    except (KeyError, UnicodeDecodeError):
        return None


def _from_cyrillic(run: str, stats: Associations) -> tuple[str, tuple[str, str]] | None:
    """Words of Cyrillic read by another Cyrillic encoding."""
    best, found = stats.mean(run) + 0.3, None
    for wrong in CYRILLIC:
        table = to_byte(wrong)
        if not all(c in table for c in run):
            continue
        raw = bytes(table[c] for c in run)
        for meant in CYRILLIC:
            try:
                text = raw.decode(meant) if meant != wrong else ""
            except UnicodeDecodeError:
                continue
            if text and (score := stats.mean(text)) > best:
                best, found = score, (text, (wrong, meant))
    return found


def repair(text: str | None, stats: Associations, may_be_cut: bool = True) -> tuple[bool, str | None]:
    """Whether the text holds wrongly decoded characters, and the text restored, or None where bytes were lost."""
    if not text or text.isascii():
        return False, None
    lost = "�" in text and "�" in (_MARK_AT_END.sub("", text) if may_be_cut else text)
    fixed = text
    case = lost
    for _ in range(6):  # some were decoded wrongly more than once
        pieces, at = [], 0
        used: dict[str | tuple[str, str], int] = {}
        for a, b in improbable_segments(fixed, stats):
            a, b = max(a, at), b
            if b - a < 1:
                continue
            # characters cut off at the ends of a run outside ASCII belong to it
            for _ in range(6):
                if a > at and fixed[a - 1] > "\x7f":
                    a -= 1
                if b < len(fixed) and fixed[b] > "\x7f":
                    b += 1
            segment = fixed[a:b]
            if not _SUSPECT.search(segment):
                continue
            if _LEFTOVER.search(segment):
                case = True
            better, gone, encoding = _repair_segment(segment, stats, fixed[a - 1 : a] if a else "", fixed[b : b + 1])
            lost |= gone
            if encoding:
                used[encoding] = used.get(encoding, 0) + b - a
            if better is not None and better != segment:
                pieces += [fixed[at:a], better]
                at = b
        if not pieces:
            break
        case = True
        whole = fixed
        pairs = [e for e in used if isinstance(e, tuple)]
        again = [t for e in pairs if (t := reread(fixed, *e)) is not None]
        if again:  # a value in another encoding is so as a whole
            return True, None if lost else max([*again, "".join(pieces) + fixed[at:]], key=stats.excess)
        if used and not pairs:  # the encoding went through the rest of the text, too
            encoding = max(used, key=used.get)
            whole = _HIGH.sub(lambda m: _strict(m.group(), encoding, stats) or m.group(), fixed)
        fixed = whole if whole != fixed else "".join(pieces) + fixed[at:]
    if _CONTROL.search(fixed):
        # bytes of double-byte encodings lie among ASCII, where runs are too short to tell
        again = [t for wrong in ("latin-1", "cp1252") for meant in ("shift_jis", "gbk", "big5", "euc_jp", "euc_kr") if (t := reread(text, wrong, meant)) is not None and not _CONTROL.search(t)]
        best = max(again, key=stats.excess, default=None)
        if best is not None and stats.mean(best) > stats.mean(text) + GAIN and not lost:
            return True, best
        lost = True
    return case or lost, (None if lost or fixed == text else fixed) if case or lost else None


def _repair_segment(segment: str, stats: Associations, left: str = "", right: str = "") -> tuple[str | None, bool, str | tuple[str, str] | None]:
    """The segment put right, or None; whether characters of it are lost; and the encoding used for UTF-8, or the encodings used and meant for another."""
    runs = list(_HIGH.finditer(segment))
    sides = [(segment[m.start() - 1] if m.start() else left, segment[m.end()] if m.end() < len(segment) else right) for m in runs]
    best, chosen, named = 0, None, None
    for encoding in WRONG:
        if not _sequence(encoding).search(segment):
            continue
        back = [_from_single(m.group(), encoding, stats, x, y) if m.end() - m.start() > 1 else None for m, (x, y) in zip(runs, sides)]
        n = sum(m.end() - m.start() for m, t in zip(runs, back) if t is not None)
        if n > best:
            best, chosen, named = n, back, encoding
    if chosen is None:
        chosen, gone = [None] * len(runs), False
        if _WIDE.search(segment):
            for encoding in WRONG_WIDE:
                back = [_from_wide(m.group(), encoding, stats) if _WIDE.search(m.group()) else None for m in runs]
                if any(back):
                    chosen, gone = [x and x[0] for x in back], not all(x and x[1] for x in back)
                    break
        else:
            other = lambda r: (_from_cyrillic if _CYRILLIC.search(r) else _from_other)(r, stats)
            if _CYRILLIC.search(segment) and not _ODD_CYRILLIC.search(segment):
                return None, False, None
            pairs = [other(m.group()) if m.end() - m.start() >= 4 and stats.mean(m.group()) < IMPROBABLE else None for m in runs]
            if any(pairs):  # short words beside those that are certain
                named = next(p for p in pairs if p)[1]
                pairs = [p or other(m.group()) for m, p in zip(runs, pairs)]
            chosen = [p and p[0] for p in pairs]
        if not any(chosen):
            return None, False, None
    else:
        gone = False
    out, at = [], 0
    for m, t in zip(runs, chosen):
        out += [segment[at : m.start()], m.group() if t is None else t]
        at = m.end()
    return "".join(out) + segment[at:], gone, named


def associations(values: DataFrame, col: str) -> Associations:
    return Associations(count_pairs(values, col).toPandas())  # at most PAIR_SLOTS + 2 x CHAR_SLOTS rows


def repair_values(values: DataFrame, keys: list[str], col: str, stats: Associations | None = None, may_be_cut: bool = True) -> DataFrame:
    """``keys, restored`` of the affected values; ``restored`` is null where bytes were lost. ``may_be_cut``: marks that only end a
    value are what a cut left, not a wrong decoding."""
    own = stats or associations(values, col)
    shared = values.sparkSession.sparkContext.broadcast(own)  # a table of fixed size

    def scan(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = [repair(t, shared.value, may_be_cut) for t in pdf["_v"]]
            hit = np.array([x for x, _ in out], dtype=bool)
            yield pd.DataFrame({**{k: pdf[k][hit].to_numpy() for k in keys}, "restored": pd.Series([y for x, y in out if x], dtype=object)})

    schema = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys) + ", restored string"
    return values.select(*keys, F.col(col).alias("_v")).where("_v IS NOT NULL").mapInPandas(scan, schema)


