"""Problem 5: cut oversized items at natural boundaries, with an overlap.

Workers look for boundaries in ranges of ``RANGE_CHARS`` (or ``RANGE_BYTES`` of a file), each read with a halo so that
a boundary on a seam is seen whole and by one range only. A range gives a small table: its length, its paragraph, line
and sentence ends, and where two of those are far apart the last word end in each ``WORD_STEP``. Stitching adds up the
lengths of the ranges before (a prefix sum) and walks the joined tables once to choose cuts; pieces come out by offset.

* ``split_oversized`` does this for a text column. Texts of at most ``INLINE_CHARS`` have all their ranges in one row's
  task; longer ones have their ranges spread over tasks, and only boundary tables meet again.
* ``split_files`` does it for files on any file system that pyarrow opens: no task ever holds more than a range or a piece.

A piece ends at the last paragraph end within the limit, or else line, sentence or word end, or else between two characters
that may part, provided the piece is then longer than ``LEAST_FILL`` of the limit (words: than the overlap). The next piece begins
``overlap`` code points earlier, so each shares exactly that much with the one before.

Defined results: texts within the limit, empty texts and rows without a limit are one piece; null texts give no piece; an
overlap of half the limit or more is reduced to just under half; repeated rows give repeated pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.boundaries import LINE, PARAGRAPH, SENTENCE, WORD, clusters_break

RANGE_CHARS = 65_536
RANGE_BYTES = 8 << 20
HALO = 256
INLINE_CHARS = 1 << 22
WORD_STEP = 64
LEAST_FILL = 0.5
#: Strength of a boundary: a higher one within reach wins over a later one.
ANYWHERE, WORDS, SENTENCES, LINES, PARAGRAPHS = 0, 1, 2, 3, 4


def mark_step(limit: int) -> int:
    """How far apart word marks may be: every window that a cut is sought in must hold some."""
    return max(1, min(WORD_STEP, limit // 8))


def range_boundaries(text: str, begin: int, end: int, step: int = WORD_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of ``text[begin:end]``, as offsets after which to cut in ``(begin, end]``, and their strengths.

    Characters outside are the halo: they are looked at, but boundaries there belong to the neighbours.
    """
    found: dict[int, int] = {}
    for pattern, strength in ((SENTENCE, SENTENCES), (LINE, LINES), (PARAGRAPH, PARAGRAPHS)):
        for m in pattern.finditer(text, max(0, begin - HALO), min(len(text), end + HALO)):
            if begin < m.end() <= end and found.get(m.end(), 0) < strength:
                found[m.end()] = strength
    strong = sorted(found)
    for a, b in zip([begin, *strong], [*strong, end]):
        if b - a > 2 * step:
            bucket, last = -1, None
            for m in WORD.finditer(text, a, min(len(text), b + HALO)):
                if m.end() > b:
                    break
                if m.end() // step != bucket and last is not None:
                    found.setdefault(last, WORDS)
                bucket, last = m.end() // step, m.end()
            if last is not None:
                found.setdefault(last, WORDS)
    marks = sorted(found)
    for a, b in zip([begin, *marks], [*marks, end]):
        for x in range(a + step, b, step):
            found.setdefault(next((y for y in range(x, max(a, x - WORD_STEP // 2), -1) if clusters_break(text, y)), x), ANYWHERE)
    at = np.array(sorted(found), dtype=np.int64)
    return at, np.array([found[x] for x in at.tolist()], dtype=np.int8)


def choose_cuts(length: int, at: np.ndarray, strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of an item of ``length``, walking its boundary table once."""
    if length <= limit or limit <= 0:
        return [(0, length)]
    overlap = max(0, min(overlap, (limit - 1) // 2))
    out, start = [], 0
    while length - start > limit:
        top = start + limit
        cut = 0
        hi = int(np.searchsorted(at, top, side="right"))
        for least, floor in ((PARAGRAPHS, start + int(limit * LEAST_FILL)), (LINES, start + int(limit * LEAST_FILL)), (SENTENCES, start + int(limit * LEAST_FILL)), (WORDS, start + overlap), (ANYWHERE, start + overlap)):
            lo = int(np.searchsorted(at, max(floor, start + overlap), side="right"))
            ok = np.flatnonzero(strength[lo:hi] >= least)
            if len(ok):
                cut = int(at[lo + ok[-1]])
                break
        if not cut:
            cut = top
        out.append((start, cut))
        start = cut - overlap
    out.append((start, length))
    return out


def _cut_inline(text: str, limit: int, overlap: int, range_chars: int) -> list[tuple[int, int]]:
    if len(text) <= limit:
        return [(0, len(text))]
    tables = [range_boundaries(text, b, min(len(text), b + range_chars), mark_step(limit)) for b in range(0, len(text), range_chars)]
    at, strength = (np.concatenate(x) for x in zip(*tables))
    return choose_cuts(len(text), at, strength, limit, overlap)


def split_oversized(df: DataFrame, limits: DataFrame, keys: list[str], text_col: str = "text", class_col: str = "layout", inline_chars: int = INLINE_CHARS, range_chars: int = RANGE_CHARS, with_text: bool = True) -> DataFrame:
    """``keys, piece_no, n_pieces, start_off, end_off`` and, where wanted, ``piece`` of every item.

    ``limits`` has one row per class (``class_col``, ``max_chars``, ``overlap_chars``).
    """
    caps = limits.groupBy(F.col(class_col).alias("_class")).agg(F.min("max_chars").alias("_max"), F.min("overlap_chars").alias("_overlap"))
    rows = df.select(*[F.col(k) for k in keys], F.col(class_col).alias("_class"), F.col(text_col).cast("string").alias("_text")).where("_text IS NOT NULL")
    rows = rows.join(caps, "_class", "left").withColumn("_len", F.length("_text"))  # Spark broadcasts the limits if they are small
    fits = F.col("_max").isNull() | (F.col("_len") <= F.col("_max"))
    cols = [*keys, "piece_no", "n_pieces", "start_off", "end_off", *(["piece"] if with_text else [])]
    whole = rows.where(fits).select(*keys, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_off"), F.col("_len").alias("end_off"), F.col("_text").alias("piece")).select(*cols)

    @F.pandas_udf("array<struct<piece_no:int,n_pieces:int,start_off:int,end_off:int>>")
    def cuts(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
        out = []
        for t, m, o in zip(text, limit, overlap):
            spans = _cut_inline(t, int(m), 0 if pd.isna(o) else int(o), range_chars)
            out.append([{"piece_no": i, "n_pieces": len(spans), "start_off": a, "end_off": b} for i, (a, b) in enumerate(spans)])
        return pd.Series(out)

    inline = rows.where(~fits & (F.col("_len") <= inline_chars)).select(*keys, "_text", F.explode(cuts("_text", "_max", "_overlap")).alias("_p"))
    inline = inline.select(*keys, "_p.*", F.expr("substring(_text, _p.start_off + 1, _p.end_off - _p.start_off)").alias("piece")).select(*cols)
    giant = _split_spread(rows.where(~fits & (F.col("_len") > inline_chars)), keys, range_chars).select(*cols)
    return whole.unionByName(inline).unionByName(giant)


def _split_spread(rows: DataFrame, keys: list[str], range_chars: int) -> DataFrame:
    """The same for items too long for one task: their ranges are separate rows, of which only boundary tables meet."""
    rows = rows.withColumn("_item", F.xxhash64(*keys, "_text"))
    copies = rows.groupBy("_item").agg(F.count("*").alias("_copies"))
    # ranges are made before they become rows, so that no row carries the whole text beside its range
    cut = F.expr(f"transform(sequence(0, _len - 1, {range_chars}), b -> struct(b AS _begin, substring(_text, greatest(b - {HALO}, 0) + 1, {range_chars} + least({HALO}, b) + {HALO}) AS _part))")
    parts = rows.select(*keys, "_item", "_len", "_max", "_overlap", cut.alias("_ranges")).select(*keys, "_item", "_len", "_max", "_overlap", F.explode("_ranges").alias("_r"))
    parts = parts.select(*keys, "_item", "_len", "_max", "_overlap", "_r._begin", F.least(F.lit(HALO), F.col("_r._begin")).alias("_left"), "_r._part")

    @F.pandas_udf("struct<at:array<bigint>,strength:array<tinyint>>")
    def table(part: pd.Series, begin: pd.Series, left: pd.Series, limit: pd.Series) -> pd.DataFrame:
        out = []
        for p, b, h, m in zip(part, begin, left, limit):
            at, strength = range_boundaries(p, int(h), min(len(p), int(h) + range_chars), mark_step(int(m)))
            out.append(((at - int(h) + int(b)).tolist(), strength.tolist()))
        return pd.DataFrame(out, columns=["at", "strength"])

    tables = parts.select(*keys, "_item", "_len", "_max", "_overlap", "_begin", table("_part", "_begin", "_left", "_max").alias("_t"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _item bigint, piece_no int, n_pieces int, start_off int, end_off int"

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_begin").drop_duplicates("_begin")
        at = np.concatenate([np.asarray(x["at"], dtype=np.int64) for x in pdf["_t"]])
        strength = np.concatenate([np.asarray(x["strength"], dtype=np.int8) for x in pdf["_t"]])
        first = pdf.iloc[0]
        overlap = 0 if pd.isna(first["_overlap"]) else int(first["_overlap"])
        spans = choose_cuts(int(first["_len"]), at, strength, int(first["_max"]), overlap)
        out = pd.DataFrame([(i, len(spans), a, b) for i, (a, b) in enumerate(spans)], columns=["piece_no", "n_pieces", "start_off", "end_off"])
        for k in [*keys, "_item"]:
            out[k] = first[k]
        return out[[*keys, "_item", "piece_no", "n_pieces", "start_off", "end_off"]]

    spans = tables.groupBy("_item").applyInPandas(stitch, schema)
    # a piece is put together from the ranges it touches, of which there are limit / range_chars + 2 at most
    touched = spans.withColumn("_begin", F.explode(F.expr(f"sequence(start_off - start_off % {range_chars}, greatest(end_off - 1, start_off) - greatest(end_off - 1, start_off) % {range_chars}, {range_chars})")))
    own = parts.select("_item", "_begin", F.expr(f"substring(_part, _left + 1, {range_chars})").alias("_own")).dropDuplicates(["_item", "_begin"])
    cut = touched.join(own, ["_item", "_begin"]).withColumn("_seg", F.expr("substring(_own, greatest(start_off - _begin, 0) + 1, end_off - greatest(start_off, _begin))"))
    whole = cut.groupBy(*keys, "_item", "piece_no", "n_pieces", "start_off", "end_off").agg(F.sort_array(F.collect_list(F.struct("_begin", "_seg"))).alias("_segs"))
    # repeated rows give repeated pieces, as they do where a text stays in one task
    whole = whole.join(copies, "_item").withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)")))
    return whole.select(*keys, "piece_no", "n_pieces", "start_off", "end_off", F.expr("concat_ws('', transform(_segs, x -> x._seg))").alias("piece"))


def split_files(spark: SparkSession, path: str, max_chars: int, overlap_chars: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, piece_no, n_pieces, start_off, end_off, piece`` of UTF-8 files, offsets in code points.

    Sizes come from the file listing; each task reads byte ranges with halos through pyarrow's file systems, then pieces by
    byte offset. Bytes that are no UTF-8 read as U+FFFD, one for each byte.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))).alias("begin"))
    ranges = ranges.repartition(F.col("path"), F.col("begin"))

    def scan(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for name, length, begin in zip(pdf["path"], pdf["length"], pdf["begin"]):
                end = min(length, begin + range_bytes)
                left, right = max(0, begin - 4 * HALO), min(length, end + 4 * HALO)
                raw = _read(name, left, right)
                a, b = _aligned(raw, begin - left), _aligned(raw, end - left)
                before, own, after = (x.decode("utf-8", errors="surrogateescape") for x in (raw[_aligned(raw, 0) : a], raw[a:b], raw[b : _aligned(raw, len(raw), back=True)]))
                at, strength = range_boundaries(before + own + after, len(before), len(before) + len(own), mark_step(max_chars))
                sizes = np.concatenate([[0], np.cumsum([_width(c) for c in own])]) if not own.isascii() else None
                rel = at - len(before)
                byte = rel if sizes is None else sizes[rel]
                out.append((name, begin, len(own), rel.tolist(), (byte + left + a).tolist(), strength.tolist(), int(left + b)))
            yield pd.DataFrame(out, columns=["path", "begin", "n_chars", "at", "byte", "strength", "byte_end"])

    tables = ranges.mapInPandas(scan, "path string, begin bigint, n_chars bigint, at array<bigint>, byte array<bigint>, strength array<tinyint>, byte_end bigint")

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("begin")
        base = np.concatenate([[0], np.cumsum(pdf["n_chars"].to_numpy())])
        at = np.concatenate([np.asarray(x, dtype=np.int64) + o for x, o in zip(pdf["at"], base)])
        strength = np.concatenate([np.asarray(x, dtype=np.int8) for x in pdf["strength"]])
        spans = choose_cuts(int(base[-1]), at, strength, max_chars, overlap_chars)
        # a known byte at or before each start, from which the piece is read
        marks = np.concatenate([[0], base[1:], at])
        bytes_ = np.concatenate([[0], pdf["byte_end"].to_numpy(), *[np.asarray(x, dtype=np.int64) for x in pdf["byte"]]]).astype(np.int64)
        order = np.argsort(marks, kind="stable")
        marks, bytes_ = marks[order], bytes_[order]
        out = []
        for i, (a, b) in enumerate(spans):
            k = int(np.searchsorted(marks, a, side="right")) - 1
            out.append((pdf["path"].iloc[0], i, len(spans), a, b, int(bytes_[k]), a - int(marks[k])))
        return pd.DataFrame(out, columns=["path", "piece_no", "n_pieces", "start_off", "end_off", "_byte", "_skip"])

    spans = tables.groupBy("path").applyInPandas(stitch, "path string, piece_no int, n_pieces int, start_off bigint, end_off bigint, _byte bigint, _skip bigint")

    def emit(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            pieces = []
            for r in pdf.itertuples():
                n = r.end_off - r.start_off
                raw = _read(r.path, r[6], r[6] + 4 * (r[7] + n) + 4)
                pieces.append(_text(raw)[r[7] : r[7] + n])
            yield pdf[["path", "piece_no", "n_pieces", "start_off", "end_off"]].assign(piece=pieces)

    return spans.repartition(F.col("path"), F.col("piece_no")).mapInPandas(emit, "path string, piece_no int, n_pieces int, start_off bigint, end_off bigint, piece string")


def _read(uri: str, begin: int, end: int) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    with system.open_input_file(path) as f:
        f.seek(int(begin))
        return f.read(int(end - begin))


def _aligned(raw: bytes, at: int, back: bool = False) -> int:
    """The next character start at or after ``at`` (``back``: at or before), looking three bytes far."""
    if back:
        for k in range(1, 4):
            if at - k >= 0 and raw[at - k] >= 0xC0:
                need = 2 if raw[at - k] < 0xE0 else 3 if raw[at - k] < 0xF0 else 4
                return at - k if need > k else at
        return at
    for k in range(4):
        if at + k >= len(raw) or raw[at + k] & 0xC0 != 0x80:
            return min(len(raw), at + k)
    return at


def _text(raw: bytes) -> str:
    """Bytes as text; those that are no UTF-8 as U+FFFD, one for each, so that offsets add up."""
    return raw.decode("utf-8", errors="surrogateescape").translate({0xDC80 + i: 0xFFFD for i in range(128)})


def _width(c: str) -> int:
    return 1 if c < "\x80" or "\udc80" <= c <= "\udcff" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
