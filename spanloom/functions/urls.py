"""Identities of web sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_url(url: Column) -> Column:
    """The address without what doesn't tell sources apart: scheme https, lower-case host, port kept, path at least ``/``,
    query parts sorted with blank ones kept, no fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")), "&")
    return F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def source_identity(url: Column) -> Column:
    """The canonical address of the page itself: out of web archives, and with doubled slashes in the path as one."""
    inner = F.regexp_extract(url, r"(?i)^https?://web\.archive\.org/web/[0-9]+[a-z_]*/(.+)$", 1)
    page = F.when(inner == "", url).otherwise(F.when(inner.rlike("(?i)^https?://"), inner).otherwise(F.concat(F.lit("https://"), inner)))
    clean = canonical_url(page)
    return F.concat(F.regexp_extract(clean, r"^(https://[^/]*)", 1), F.regexp_replace(F.regexp_extract(clean, r"^https://[^/]*([^?]*)", 1), "/{2,}", "/"), F.regexp_extract(clean, r"(\?.*)?$", 1))


def raw_archive_url(url: Column) -> Column:
    """The archive's address of the page as it was received, without the archive's frame."""
    return F.regexp_replace(url, r"^(https?://web\.archive\.org/web/[0-9]+)/", "$1id_/")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def host_in(host: Column, suffix: str) -> Column:
    return (host == suffix) | host.endswith("." + suffix)
