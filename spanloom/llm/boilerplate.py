"""Problem 1: the main content of web pages.

Line-block distribution: mark-up is stripped, each line weighs its bytes, and weights are summed over sliding windows of
neighbouring lines. Over the corpus this curve gives every page's core; lines that repeat outside the core, per site or over all pages,
are learned as furniture (``furniture``). On each page these then weigh nothing, as do teasers below learned heads, the windows are summed again, and
where the sum surges text begins, where it dives text ends: lines between surge and dive that weigh something are kept, all others go.

Defined results: blank lines are never reported; null and empty texts give no rows; a text that is furniture only loses all its
lines; lines of any length may be furniture; repeated rows give the same rows once; other columns are ignored.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.furniture import CONTENT, HEAD, Furniture, byte_length, digest, learn, page_lines, site_of, with_site_keys
from spanloom.llm.lines import SENTENCE_END, TEXT_CHARS, _BULLET, key_of, shape_of

#: Lines on either side that a window takes in, and the bytes at which its sum surges. Sentences and entries weigh a surge: they are text wherever they stand.
REACH = 2
SURGE = 40

#: A line that points to another page.
_POINTED = re.compile(r"^[→»➜➔]\s+\S")
_RUNTIME = re.compile(r"\s*\([\d: ]+\)$")
_LISTED = re.compile(r"\d|[,;]\s")


def _teaser(line: str, furniture: Furniture) -> bool:
    """Whether a line under a head of teasers is one: it has the shape of a title, or at least not that of text or entries."""
    if _BULLET.match(line):
        return False
    return shape_of(line, furniture.frequent) in furniture.shapes or not SENTENCE_END.search(line[-8:]) and not _LISTED.search(line)


def _pointer(line: str, furniture: Furniture) -> bool:
    """Whether a line points to another page: an arrow, or a few words and a colon, before what has the shape of a title."""
    if _POINTED.match(line):
        return shape_of(line, furniture.frequent).lstrip("_ ") in furniture.bare_shapes
    if ": " not in line or len(line) > TEXT_CHARS:
        return False
    before, _, after = line.partition(": ")
    if before.count(" ") > 1 or not before.replace(" ", "").isalpha() or shape_of(line, furniture.frequent) in furniture.shapes:
        return False
    return shape_of(_RUNTIME.sub("", after), furniture.frequent) in furniture.shapes


def label_lines(text: str, title: str | None, url: str | None, publisher: str | None, furniture: Furniture, own: dict[int, int] | None = None) -> list[bool | None]:
    """For every line whether it is main content; None for blank lines."""
    out: list[bool | None] = [None] * (text.count("\n") + 1)
    lines = page_lines(text)
    titled = title.strip() if title else None
    own = furniture.keys_of(digest(site_of(url, publisher))) if own is None else own
    weights: list[int] = []
    teasers = seen_title = False
    for _, s in lines:
        weight = byte_length(s)
        if s == titled and not (teasers and seen_title):
            teasers, seen_title = False, True
        else:
            key = key_of(s, publisher)
            kind = furniture.kind(key, own)
            if kind == CONTENT:
                teasers = False
            elif kind:
                weight, teasers = 0, kind == HEAD
            elif teasers and _teaser(s, furniture) or _pointer(s, furniture):
                weight = 0
            elif furniture.framed(key):
                weight, teasers = 0, False
            else:
                teasers = False
                if SENTENCE_END.search(s[-8:]) or _BULLET.match(s) or _LISTED.search(s):
                    weight = max(weight, SURGE)
        if s == titled:
            weight = max(weight, SURGE)
        weights.append(weight)
    n = len(lines)
    sums = [0] * (n + 1)
    for i, w in enumerate(weights):
        sums[i + 1] = sums[i] + w
    for j, (i, _) in enumerate(lines):
        out[i] = weights[j] > 0 and sums[min(n, j + REACH + 1)] - sums[max(0, j - REACH)] >= SURGE
    return out


def prepared(pages: DataFrame, keys: list[str], furniture: Furniture) -> DataFrame:
    return with_site_keys(pages.select(*keys, F.coalesce("text", F.lit("")).alias("text"), "title", "url", "publisher"), furniture)


def own_keys(cell) -> dict[int, int] | None:
    return None if cell is None else {x["h"] & 0xFFFFFFFFFFFFFFFF: x["kind"] for x in cell}


def find_boilerplate(pages: DataFrame, keys: list[str], furniture: Furniture | None = None) -> DataFrame:
    """``keys, line_no`` of every non-blank line outside the main content, of records (``text, title, url, publisher``) that hold
    content at all: those of problem 2 give no rows."""
    from spanloom.llm.residue import examine, residue_cases

    taught = furniture or learn(pages)
    found = examine(pages, keys, taught)
    cases = residue_cases(found, keys, taught)
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    sound = found.where("size(line_nos) > 0").alias("f").join(cases.alias("c"), same, "left_anti")
    # copies of a record have the same lines: one row per record is kept before lines are spread
    return sound.groupBy(*keys).agg(F.first("line_nos").alias("line_nos")).select(*keys, F.explode("line_nos").alias("line_no"))


def extract_main(pages: DataFrame, keys: list[str], furniture: Furniture | None = None) -> DataFrame:
    """``keys, main``: the main content of every record, its lines and the blank lines between them as they were."""
    taught = furniture or learn(pages)
    pages = prepared(pages, keys, taught)

    @F.pandas_udf("string")
    def main(text: pd.Series, title: pd.Series, url: pd.Series, publisher: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for t, h, u, p, cell in zip(text, title, url, publisher, own):
            labels, rows = label_lines(t, h, u, p, taught, own_keys(cell)), t.split("\n")
            kept = [i for i, x in enumerate(labels) if x]
            out.append("\n".join(rows[i] for i in range(kept[0], kept[-1] + 1) if labels[i] is not False) if kept else "")
        return pd.Series(out, dtype=object)

    return pages.select(*keys, main("text", "title", "url", "publisher", "own").alias("main"))
