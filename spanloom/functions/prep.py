"""Preparation of source texts: structured lists, layouts, excerpts, page residues of exports."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_NAMES, COMPONENT_LINES = 20, 16
COMPACTED = "Names in the list:"


def compact_list(text: str) -> str | None:
    """The names of a list whose entries give a name in numbered parts (``Name 6:`` and after it ``1:`` to ``5:``): joined, each once, in order;
    None for texts with fewer than twenty."""
    lines = [x.strip() for x in text.split("\n")]
    names = []
    for i, line in enumerate(lines):
        if not (m := re.match(r"Name 6:\s*(.*)$", line)):
            continue
        parts = {6: m.group(1)}
        for later in lines[i + 1 : i + 1 + COMPONENT_LINES]:
            if later.startswith("Name 6:"):
                break
            if (p := re.match(r"([1-5]):\s*(.*)$", later)):
                parts.setdefault(int(p.group(1)), p.group(2))
        words = [parts[k] for k in (1, 2, 3, 4, 5, 6) if parts.get(k) and parts[k].lower() not in ("n/a", "na", "-")]
        if words:
            names.append(" ".join(words))
    names = list(dict.fromkeys(names))
    return COMPACTED + "\n" + "\n".join("- " + n for n in names) if len(names) >= LEAST_NAMES else None


def grow_excerpt(sentences: list[str], focus: int, least: int, most: int) -> tuple[int, int] | None:
    """The sentences around ``focus`` with at least so many words, taken from both sides in turn; None if they are more than ``most`` then."""
    a = b = focus
    count = lambda: sum(len(s.split()) for s in sentences[a : b + 1])
    left = True
    while count() < least and (a > 0 or b < len(sentences) - 1):
        if left and a > 0 or b == len(sentences) - 1:
            a -= 1
        else:
            b += 1
        left = not left
    return (a, b) if least <= count() <= most else None


def strip_export(text: str) -> str:
    """Text out of an export in mark-up: links as their words, hyphens at line ends joined."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return re.sub(r"(\w)-\n(\w)", r"\1\2", text)


def compact_list_in(text: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([compact_list(t) if t else None for t in s], dtype=object), "string")(text)


def layout_of(layout: Column, text: Column) -> Column:
    """A list if the source says so, or if the text was compacted to one."""
    return F.when((layout == "STRUCTURED_LIST") | F.startswith(text, F.lit(COMPACTED)), "STRUCTURED_LIST").otherwise("PROSE")
