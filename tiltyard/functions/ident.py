"""Deterministic identifiers: prefixes and digests that must be equal wherever they are computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex16(c: Column) -> Column:
    """The first 16 hex digits of a SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def canonical_url(url: Column, hosts: dict[str, str]) -> Column:
    """A URL whose host is replaced by its canonical name; all else is kept."""
    out = url
    for alias, host in hosts.items():
        out = F.regexp_replace(out, rf"^(https?://){alias.replace('.', '[.]')}(?=[/:?#]|$)", "$1" + host)
    return out


def document_id(url: Column, hosts: dict[str, str] | None = None) -> Column:
    return F.concat(F.lit("doc_"), hex16(F.lower(canonical_url(url, hosts or {}))))


def chunk_id(machine: Column, doc: Column, start: Column, end: Column, idx: Column) -> Column:
    key = F.concat(F.coalesce(machine, F.lit("")), F.lit("|"), doc, F.lit("|"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("#"), idx.cast("string"))
    return F.concat(F.lit("chk_"), hex16(key))


def cache_key(question: Column, version: Column) -> Column:
    return F.substring(F.sha2(F.concat(question, F.lit("::"), version), 256), 1, 32)


def run_id(source: Column, at: Column) -> Column:
    return F.concat(source, F.lit("_"), F.date_format(at, "yyyyMMddHHmmssSSS"), F.lit("Z"))


def joined_id(prefix: str, *cs: Column) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws("_", *cs))
