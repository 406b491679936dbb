"""Page furniture that a corpus teaches: lines that repeat over a site's or the whole corpus's pages outside their text.

Every page is read as a curve of line lengths. Its core are the lines at which sums over windows of WINDOW lines surge; a line
before the first of them stands in the head, behind the last in the tail. Lines with the same key (``lines.key_of``) are counted per site
and over all pages: on how many pages they stand, in the head, in the tail, as the last line, and with a line in a title's form after them. Furniture are
keys that repeat and stand outside the core, heads of teasers those that titles follow. A key that repeats inside the core is
furniture only if an exact check finds a word of services in it (``SERVICE``), as subheads repeat there, too.

Nothing is written down of the lines themselves: other sites and languages teach their own. Site keys are joined by site or,
while there are at most ``BROADCAST_KEYS`` of them, sent as a sorted table of 64-bit hashes; both give the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.lines import _BULLET, TEXT_CHARS, key_of, shape_of, title_statistics
from spanloom.session import materialize

#: A surge: so many bytes in a window of three lines, a third of them in the line itself.
SURGE = 300
#: A key must be on one of so many pages of its site, or of all pages; and in so many different texts, as copies repeat everything.
SITE_SHARE, SITE_TEXTS, CORPUS_SHARE, CORPUS_TEXTS = 40, 3, 1500, 5
#: Keys this frequent are furniture even in the form of titles or numbered entries.
STRONG_SITE, STRONG_CORPUS = 12, 120
#: Shares of a key's pages: in the head; in head or tail; at most as the last line, where articles end; before a title, which
#: heads of teasers are also in the core.
IN_HEAD, OUTSIDE, MOST_LAST, BEFORE_TITLES, ALWAYS_OUTSIDE = 0.7, 0.85, 0.8, 0.6, 0.97
#: A key inside the core must be on one of so many pages.
INSERT_SHARE = 150
FLUSH_KEYS = 100_000
#: So many pages are remembered, to count copies once.
MOST_MET = 1_000_000
#: Keys with a part that varies have so many forms, and this share of their pages in head or tail, at most that share right beside the core.
FRAME_FORMS, FRAME_OUTSIDE, FRAME_NEAR = 4, 0.95, 0.5
#: Site keys are sent to all workers up to this number (16 bytes each), else joined.
BROADCAST_KEYS = 2_000_000
#: Longer lines behind bullets are entries of articles' lists.
ENTRY_CHARS = 30
FURNITURE, HEAD, CONTENT = 1, 2, 3
#: Repeated keys with this share of their pages inside the core, as subheads, are content.
INSIDE = 0.4

# What pages offer their readers, by stems; the exact check of repeated lines inside articles.
SERVICE = (
    r"advert|werbung|anzeige|publicid|publicit|реклам|广告|広告|comment|kommentar|comentari|comentári|коммент|评论|コメント|photo gallery|bilderstrecke|galer[ií]a|browser|audio|podcast|\bapp\b|phone|newsletter|inbox|e-?mail|subscri|abonn|suscr|assin|подпис|订阅|購読"
    r"|\bshare\b|teilen|compart|partager|поделит|分享|シェア|\[[^\]]+\]|story continues|continues below|read on|support (?:us|our|independent)|donat|spende|apoy|apoi|souten|sign (?:up|in)|log ?in|cookie|download|poll\b|vote below|listen to"
)
_SERVICE = re.compile(SERVICE, re.I)
_NOT_ASCII = re.compile(r"\s*[^\x00-\x7f]+\s*")
_MARKUP = re.compile(r"<(?:/?[a-zA-Z][^<>]*|!--.*?--)>")
_HOST = re.compile(r"^\w+://([^/?#]+)")


def site_of(url: str | None, publisher: str | None) -> str:
    """The host of the address, else the publisher."""
    m = _HOST.match(url) if url else None
    return m.group(1).lower() if m else publisher or ""


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def byte_length(line: str) -> int:
    return len(line) if line.isascii() else len(line.encode("utf-8", "surrogatepass"))


def page_lines(text: str) -> list[tuple[int, str]]:
    """Numbers and contents of the lines that aren't blank, without mark-up."""
    out = []
    for i, line in enumerate(text.split("\n")):
        s = line.strip()
        if s:
            if "<" in s:
                s = _MARKUP.sub(" ", s).strip()
            out.append((i, s))
    return out


def core_lines(weights: list[int], surge: int = SURGE) -> list[int]:
    """The lines that take part in a surge of the page's curve."""
    return [i for i, w in enumerate(weights) if 3 * w >= surge and (sum(weights[i : i + 3]) >= surge or sum(weights[max(0, i - 2) : i + 1]) >= surge)]


def skeleton(key: str) -> str | None:
    """What wrong decoding leaves alike of a key: its ASCII parts, if they are enough to tell it."""
    if len(key) > TEXT_CHARS or key.isascii():
        return None
    out = _NOT_ASCII.sub(" ", key).strip()
    return out if len(out) >= 5 and sum(map(str.isalpha, out)) >= 5 else None


def menu_parts(key: str) -> list[str]:
    """The entries of a key that is a menu, or an entry of one behind its bullet; none of other keys."""
    body = key if key[:1].isalpha() else _BULLET.sub("", key)
    parts = body.split(" | ")
    return parts if len(parts) > 1 or len(body) < len(key) and len(body) <= ENTRY_CHARS and "0" not in body else []


def line_counts(pages: DataFrame, frequent: frozenset[str], shapes: frozenset[str], surge: int = SURGE) -> DataFrame:
    """Counts per site and key over pages with a core (``text, title, url, publisher``). Partial counts leave a worker, not lines.
    A row with ``h`` null has the number of such pages of its site. ``texts`` is a bitmap of 64 classes of texts."""

    def scan(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[int, str | None], list] = {}
        shaped: dict[str, bool] = {}
        met: set[int] = set()  # copies of a page say nothing new; so of a text that a third of all rows have, each part counts one
        for pdf in pdfs:
            for text, title, url, publisher in zip(pdf["text"], pdf["title"], pdf["url"], pdf["publisher"]):
                lines = [s for _, s in page_lines(text)]
                core = core_lines([byte_length(s) for s in lines], surge)
                if not core:
                    continue
                site, own = digest(site_of(url, publisher)), digest(text)
                if own ^ site in met:
                    continue
                met.add(own ^ site)
                bit = 1 << (own & 63)
                _add(counts, (site, None), False, [1, 0, 0, 0, 0, 0], bit)
                titled = title.strip() if title else None
                keys = [key_of(s, publisher) for s in lines]
                entries = [menu_parts(k) for k in keys]
                for k, s in zip(keys, lines):
                    if k not in shaped:
                        shaped[k] = len(k) <= TEXT_CHARS and not _BULLET.match(k) and shape_of(s, frequent) in shapes
                first, last, n, seen = core[0], core[-1], len(lines), set()
                for j, k in enumerate(keys):
                    if k in seen or lines[j] == titled or core == [j]:  # nothing tells on which side of the text its only line stands
                        continue
                    seen.add(k)
                    # of a core line, the others count
                    a = first if first != j else core[1]
                    z = last if last != j else core[-2]
                    before_title = j + 1 < n and shaped[keys[j + 1]] and lines[j + 1] != titled
                    row = [1, int(j < a), int(j > z), int(j == n - 1), int(before_title), int(j in (a - 1, z + 1))]
                    _add(counts, (site, k), shaped[k], row, bit)
                    for p in () if shaped[k] else entries[j]:
                        if p not in seen:
                            seen.add(p)
                            _add(counts, (site, p), False, [*row[:4], 0, row[5]], bit)
            if len(counts) > FLUSH_KEYS:
                yield _frame(counts)
                counts, shaped = {}, {}
            if len(met) > MOST_MET:
                met.clear()
        yield _frame(counts)

    return pages.select("text", "title", "url", "publisher").mapInPandas(scan, "site bigint, h bigint, key string, shaped boolean, pages bigint, head bigint, tail bigint, last bigint, titles bigint, near bigint, texts bigint")


def _add(counts: dict, at: tuple, shaped: bool, row: list[int], bit: int) -> None:
    own = counts.get(at)
    if own is None:
        counts[at] = [*row, bit, shaped]
    else:
        own[0] += row[0]
        own[1] += row[1]
        own[2] += row[2]
        own[3] += row[3]
        own[4] += row[4]
        own[5] += row[5]
        own[6] |= bit


def _frame(counts: dict) -> pd.DataFrame:
    """Rows of Spark's signed numbers."""
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    keys = [k for _, k in counts]
    numbers = list(zip(*counts.values())) or [()] * 8
    columns = {"site": [signed(s) for s, _ in counts], "h": pd.array([None if k is None else signed(digest(k)) for k in keys], dtype="Int64"), "key": [k if k is not None and len(k) <= TEXT_CHARS else None for k in keys], "shaped": list(numbers[7])}
    columns |= {c: list(numbers[i]) for i, c in enumerate(("pages", "head", "tail", "last", "titles", "near"))} | {"texts": [signed(x) for x in numbers[6]]}
    return pd.DataFrame(columns).astype({"key": object, "shaped": bool})


def _kind(least_texts: int, share: int, strong: int, insert: int) -> Column:
    """FURNITURE, HEAD, CONTENT or null of a row of counts beside its ``total``."""
    n, total = F.col("pages"), F.col("total")
    is_strong = n * strong >= total
    numbered = F.col("key").contains("0") & F.col("key").rlike(r"^(?:[-*•–—‣▪]|\d{1,3}[.)])\s")
    may = (F.bit_count("texts") >= least_texts) & (n * share >= total) & (is_strong | ~(F.col("shaped") | F.coalesce(numbered, F.lit(False))))
    outside = (F.col("head") >= IN_HEAD * n) | (F.col("head") + F.col("tail") >= OUTSIDE * n) & (F.col("last") <= MOST_LAST * n)
    service = (n * insert >= total) & F.coalesce(F.col("key").rlike("(?i)" + SERVICE), F.lit(False))
    inside = (F.bit_count("texts") >= least_texts) & (n * share >= total) & (F.col("head") + F.col("tail") <= (1 - INSIDE) * n) & ~F.col("shaped")
    found = F.when(may, F.when((F.col("titles") >= BEFORE_TITLES * n) & (F.col("head") + F.col("tail") < ALWAYS_OUTSIDE * n) & ~F.col("shaped") & F.col("key").isNotNull(), HEAD).when(outside | service, FURNITURE))
    return F.coalesce(found, F.when(inside, CONTENT))


_TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[^\w\s]")


def frames_of(key: str) -> list[str]:
    """What a key with a part that varies has fixed: its first words and marks, with its last ones or without."""
    t = _TOKEN.findall(_BULLET.sub("", key))
    if len(t) < 5:
        return ["_ " + " ".join(t[-3:])] if len(t) == 4 else []
    return [" ".join(t[:2]) + " _ " + " ".join(t[-2:]), " ".join(t[:3]) + " _", " ".join(t[:2]) + " _ " + t[-1], "_ " + " ".join(t[-3:])]


class Furniture:
    """What a corpus teaches about lines: ``corpus`` keys of all sites by digest, ``parts`` of menus, ``skeletons``, the words and
    shapes of titles; ``sites`` is the table of site keys (``site, h, kind``), or ``site_keys`` its hashes where they are few; ``line_pages`` has the pages with a core of every line (``h, pages``)."""

    def __init__(self, frequent: frozenset[str] = frozenset(), shapes: frozenset[str] = frozenset(), keys: list[tuple[str | None, int, int]] = (), frames: frozenset[str] = frozenset()) -> None:
        self.frequent, self.shapes, self.frames = frequent, shapes, frames
        self.bare_shapes = frozenset(x.lstrip("_ ") for x in shapes)
        self.corpus = {h & 0xFFFFFFFFFFFFFFFF: kind for _, h, kind in keys}
        named = [(k, kind) for k, _, kind in keys if k]
        self.heads = frozenset(k for k, kind in named if kind == HEAD)
        self.skeletons = {s: kind for k, kind in named if kind != CONTENT and (s := skeleton(k))}
        self.site_keys: tuple[np.ndarray, np.ndarray, np.ndarray] | None = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int8))
        self.sites: DataFrame | None = None
        self.line_pages: DataFrame | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("sites", "line_pages", "cache")}

    def keys_of(self, site: int) -> dict[int, int]:
        """Digests and kinds of a site's keys, of those sent to the workers; the sites met last are kept."""
        cache = self.__dict__.setdefault("cache", {})
        found = cache.get(site)
        if found is None:
            if len(cache) > 1000:
                cache.clear()
            sites, hashes, kinds = self.site_keys
            a, b = np.searchsorted(sites, np.uint64(site)), np.searchsorted(sites, np.uint64(site), side="right")
            found = cache[site] = dict(zip(hashes[a:b].tolist(), kinds[a:b].tolist()))
        return found

    def kind(self, key: str, own: dict[int, int]) -> int:
        """FURNITURE, HEAD, CONTENT or 0 of a line's key, with the keys of its site."""
        h = digest(key)
        found = self.corpus.get(h) or own.get(h)
        if found is not None or len(key) > TEXT_CHARS:
            return found or 0
        if (s := skeleton(key)) is not None and s in self.skeletons:
            return self.skeletons[s]
        if parts := menu_parts(key):
            known = 0
            for p in parts:
                h = digest(p)
                known += (self.corpus.get(h) or own.get(h)) == FURNITURE
            if known * 2 > len(parts):
                return FURNITURE
        if ":" in key:
            before, _, after = key.partition(":")
            if before.strip() in self.heads and after.strip():
                return FURNITURE
        return 0

    def framed(self, key: str) -> bool:
        return len(key) <= TEXT_CHARS and bool(self.frames) and not self.frames.isdisjoint(frames_of(key))


def learn(pages: DataFrame, broadcast_keys: int = BROADCAST_KEYS, surge: int = SURGE) -> Furniture:
    """The furniture of a corpus of pages (``text, title, url, publisher``). To the driver come keys on one page in CORPUS_SHARE:
    at most that many times the lines of a page, and the site keys if they are few."""
    pages = pages.where("text IS NOT NULL")
    frequent, shapes = title_statistics(pages)
    sums = [F.sum(c).alias(c) for c in ("pages", "head", "tail", "last", "titles", "near")] + [F.bit_or("texts").alias("texts"), F.max("shaped").alias("shaped")]
    # a digest has one key; numbers alone are aggregated, as strings would have to be sorted
    per_site = materialize(line_counts(pages, frequent, shapes, surge).groupBy("h", "key", "site").agg(*sums), "line-counts")
    totals = per_site.where("h IS NULL").select("site", F.col("pages").alias("total"))
    total = totals.agg(F.sum("total")).first()[0] or 0
    corpus = per_site.where("h IS NOT NULL").groupBy("h", "key").agg(*sums).withColumn("total", F.lit(total))
    rows = corpus.withColumn("kind", _kind(CORPUS_TEXTS, CORPUS_SHARE, STRONG_CORPUS, INSERT_SHARE)).where("kind IS NOT NULL").select("key", "h", "kind").collect()
    out = Furniture(frequent, shapes, [tuple(r) for r in rows], learn_frames(per_site, total))
    out.line_pages = corpus.select("h", "pages")
    often = per_site.where(F.col("h").isNotNull() & (F.col("pages") >= SITE_TEXTS) & (F.bit_count("texts") >= SITE_TEXTS)).join(totals, "site")
    sites = materialize(often.withColumn("kind", _kind(SITE_TEXTS, SITE_SHARE, STRONG_SITE, SITE_SHARE)).where("kind IS NOT NULL").select("site", "h", "kind"), "site-furniture")
    if sites.limit(broadcast_keys + 1).count() <= broadcast_keys:
        own = sites.toPandas()
        site = own["site"].to_numpy().astype(np.uint64)
        order = np.argsort(site, kind="stable")
        out.site_keys = (site[order], own["h"].to_numpy().astype(np.uint64)[order], own["kind"].to_numpy().astype(np.int8)[order])
    else:
        out.site_keys, out.sites = None, sites
    return out


def learn_frames(per_site: DataFrame, total: int) -> frozenset[str]:
    """Frames of keys that stand outside the core in enough pages and in different forms, or of which the exact check finds a service: at
    most CORPUS_SHARE times the lines of a page."""
    outside, service = (F.col("head") + F.col("tail") >= FRAME_OUTSIDE * F.col("pages")) & (F.col("last") <= MOST_LAST * F.col("pages")) & (F.col("near") <= FRAME_NEAR * F.col("pages")), F.col("pages") * INSERT_SHARE >= total

    @F.pandas_udf("array<string>")
    def frames(key: pd.Series, outer: pd.Series) -> pd.Series:
        # inside the core only frames count that can serve, so dated keys, which can't, are not taken apart
        return pd.Series([frames_of(k) if o else [f for f in frames_of(k)[:1] if _serves(f)] if "0" not in k else [] for k, o in zip(key, outer)])

    keys = per_site.where("h IS NOT NULL AND key IS NOT NULL").withColumn("form", F.expr("shiftleft(1L, int(pmod(h, 64)))"))
    numbers = ["pages", "head", "tail", "last", "near"]
    sums = [F.sum(c).alias(c) for c in numbers] + [F.bit_or("texts").alias("texts"), F.bit_or("form").alias("form")]
    often = (F.col("pages") * CORPUS_SHARE >= total) & (F.bit_count("texts") >= CORPUS_TEXTS) & (F.bit_count("form") >= FRAME_FORMS)
    # first those of keys that stand outside (or pass the check of keys inside the core), then, of these frames, all keys
    first = keys.select("form", "texts", *numbers, F.explode(frames("key", outside)).alias("frame")).groupBy("frame").agg(*sums).where(often).select("frame").collect()
    found = frozenset(r[0] for r in first)
    if not found:
        return found

    @F.pandas_udf("array<string>")
    def known(key: pd.Series) -> pd.Series:
        return key.map(lambda k: [f for f in frames_of(k) if f in found] if _may_have(k, firsts, lasts) else [])

    firsts = frozenset(f.split(" ", 1)[0] for f in found if f[0] != "_")
    lasts = frozenset(f.rsplit(" ", 1)[1] for f in found if f[0] == "_")
    rows = keys.select("form", "texts", *numbers, F.explode(known("key")).alias("frame")).groupBy("frame").agg(*sums).where(often).withColumn("outside", outside).where(outside | service).select("frame", "outside").collect()
    return frozenset(r["frame"] for r in rows if r["outside"] or _serves(r["frame"]))


def _may_have(key: str, firsts: frozenset[str], lasts: frozenset[str]) -> bool:
    """Whether a key begins or ends as some frame does; most don't, and need not be taken apart."""
    m = _TOKEN.search(key if key[:1].isalpha() else _BULLET.sub("", key))
    if m is None or m.group() in firsts:
        return m is not None
    ends = _TOKEN.findall(key.rsplit(None, 1)[-1])
    return bool(ends) and ends[-1] in lasts


def _serves(frame: str) -> bool:
    """The exact check of what repeats inside the core, for a frame that has both ends; dated sentences are none."""
    return frame.count(" ") == 4 and " _ " in frame and "0" not in frame and bool(_SERVICE.search(frame))


def with_site_keys(pages: DataFrame, furniture: Furniture, salts: int = 32) -> DataFrame:
    """``pages`` with the keys of their site as ``own`` (array of ``h, kind``), null where they were sent to the workers. A site has
    at most SITE_SHARE times the lines of a page; pages of large sites are spread over ``salts`` parts."""
    kind = "array<struct<h:bigint,kind:int>>"
    if furniture.sites is None:
        return pages.withColumn("own", F.lit(None).cast(kind))

    @F.pandas_udf("bigint")
    def site(url: pd.Series, publisher: pd.Series) -> pd.Series:
        return pd.Series([digest(site_of(u, p)) for u, p in zip(url, publisher)], dtype="uint64").astype("int64")

    own = furniture.sites.groupBy("site").agg(F.collect_list(F.struct("h", "kind")).alias("own")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = pages.withColumn("site", site("url", "publisher")).withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(salts)).cast("int"))
    return rows.join(own, ["site", "salt"], "left").drop("site", "salt").withColumn("own", F.coalesce("own", F.array().cast(kind)))
