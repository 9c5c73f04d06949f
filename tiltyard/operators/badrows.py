"""Rows that fail to parse: bulk parsing of record blocks, bisection of failing blocks, strict diagnosis of single lines.

A block of lines takes the columnar path: one vectorised check of the shape of its lines, one Arrow CSV parse, vectorised value
checks. Each check judges all lines of the block at once, so the lines that fail it are known without parsing halves again; a
block that the bulk parser refuses as a whole is halved until the line it can't read stands alone. Only such single lines go
to the strict parser, which names the reason.
"""

from __future__ import annotations

import datetime
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltyard.session import spread


@dataclass(frozen=True)
class Field:
    """A field of a record: its name, its SQL type, an RE2 pattern its trimmed value must match in full, and the reason given if not.

    reason None: the value is kept as it is and never fails.
    """

    name: str
    type: str = "string"
    pattern: str | None = None
    reason: str | None = None
    date: bool = False


@dataclass(frozen=True)
class RecordSpec:
    fields: tuple[Field, ...]
    header_first: str
    block: int = 4096

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


#: Reasons in the order in which they are tested: the shape of the line first, then fields from left to right.
SHAPE_REASONS = ("quoting", "columns")

# A field as the bulk parser reads it: plain (no quote), or enclosed without blanks around it.
_FIELD = r'(?:[^",\r\n]*|"(?:[^"\r\n]|"")*")'


def split_record(line: str) -> list[str] | None:
    """The fields of one line, or None where its quoting is broken."""
    out, i, n = [], 0, len(line)
    while True:
        j = i
        while j < n and line[j] in " \t":
            j += 1
        if j < n and line[j] == '"':
            j += 1
            buf = []
            while True:
                k = line.find('"', j)
                if k < 0:
                    return None
                buf.append(line[j:k])
                if line[k + 1 : k + 2] == '"':
                    buf.append('"')
                    j = k + 2
                    continue
                j = k + 1
                break
            while j < n and line[j] in " \t":
                j += 1
            if j < n and line[j] != ",":
                return None
            out.append("".join(buf))
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None
            out.append(line[i:j])
        if j >= n:
            return out
        i = j + 1


def _is_date(v: str) -> bool:
    try:
        datetime.date.fromisoformat(v)
        return True
    except ValueError:
        return False


def diagnose(line: str, spec: RecordSpec, patterns: dict[str, re.Pattern]) -> tuple[str | None, list[str] | None]:
    """(reason, fields): the first reason for which the line fails, None for a valid line."""
    parts = split_record(line)
    if parts is None:
        return "quoting", None
    if len(parts) != len(spec.fields):
        return "columns", None
    for f, v in zip(spec.fields, parts):
        v = v.strip()
        if f.reason and (not patterns[f.name].search(v) or f.date and v and not _is_date(v)):
            return f.reason, None
    return None, parts


def _bulk(lines: pa.Array, spec: RecordSpec) -> list[pa.Array] | None:
    """The columns of a block in one parse; None where the parser refuses it."""
    try:
        t = csv.read_csv(
            io.BytesIO("\n".join(lines.to_pylist()).encode("utf-8", "surrogatepass")),
            csv.ReadOptions(column_names=spec.names, use_threads=False, block_size=1 << 26),
            csv.ParseOptions(ignore_empty_lines=False),
            csv.ConvertOptions(column_types={n: pa.string() for n in spec.names}, strings_can_be_null=False),
        )
    except (pa.ArrowInvalid, UnicodeError):
        return None
    return [t[n].combine_chunks() for n in spec.names] if t.num_rows == len(lines) else None


def _dates(v: pa.Array) -> pa.Array:
    """Which of the strings yyyy-mm-dd are dates; the empty one counts as one. Impossible days come back as other days, or not at all."""
    kinds = v.dictionary_encode()
    good = pa.array([x == "" or _is_date(x) for x in kinds.dictionary.to_pylist()], pa.bool_())
    return good.take(kinds.indices)


def _valid(cols: list[pa.Array], spec: RecordSpec) -> pa.Array:
    """Which rows of a parsed block have valid values in all fields."""
    ok = pa.array([True] * len(cols[0]), pa.bool_())
    for f, c in zip(spec.fields, cols):
        if f.reason:
            v = pc.utf8_trim_whitespace(c)
            good = pc.match_substring_regex(v, f.pattern)
            ok = pc.and_(ok, pc.and_(good, _dates(pc.if_else(good, v, ""))) if f.date else good)
    return ok


def _parse_block(ids: pa.Array, lines: pa.Array, spec: RecordSpec, out: list, strict: list) -> None:
    """Appends (ids, columns) of the valid lines to out, and (ids, lines) of the single ones that fail to strict."""
    shape = rf"^{_FIELD}(?:,{_FIELD}){{{len(spec.fields) - 1}}}$"
    sound = pc.match_substring_regex(lines, shape)
    strict.append((ids.filter(pc.invert(sound)), lines.filter(pc.invert(sound))))
    todo = [(ids.filter(sound), lines.filter(sound))]
    while todo:
        i, x = todo.pop()
        if not len(x):
            continue
        cols = _bulk(x, spec)
        if cols is not None:
            ok = _valid(cols, spec)
            out.append((i.filter(ok), [c.filter(ok) for c in cols]))
            strict.append((i.filter(pc.invert(ok)), x.filter(pc.invert(ok))))
        elif len(x) == 1:
            strict.append((i, x))
        else:
            h = len(x) // 2
            todo += [(i[:h], x[:h]), (i[h:], x[h:])]


def parse_records(df: DataFrame, id_col: str, line_col: str, spec: RecordSpec) -> DataFrame:
    """One row per record line: (id, reason, the spec's fields as strings); reason is null for valid rows.

    Header lines (first field equals spec.header_first) and blank or null lines give no row. Lines are unbounded in
    length; repeated lines give repeated rows; an empty table gives an empty result. Other columns of df, whatever their
    names, are not read.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, reason string, " + ", ".join(f"f{k} string" for k in range(len(spec.fields)))
    head = spec.header_first.lower()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {f.name: re.compile(f.pattern.replace(r"\p{L}", r"[^\W\d_]")) for f in spec.fields if f.reason}
        for b in batches:
            ids, lines = b.column(0), b.column(1)
            first = pc.utf8_lower(pc.utf8_trim(lines, characters='﻿" \t'))
            keep = pc.and_(pc.not_equal(pc.utf8_trim_whitespace(lines), ""), pc.invert(pc.starts_with(first, head)))
            keep = pc.fill_null(keep, False)
            ids, lines = ids.filter(keep), lines.filter(keep)
            out: list = []
            strict: list = []
            for at in range(0, len(lines), spec.block):
                _parse_block(ids[at : at + spec.block], lines[at : at + spec.block], spec, out, strict)
            names = ["id", "reason"] + [f"f{k}" for k in range(len(spec.fields))]
            for i, cols in out:
                if len(i):
                    yield pa.RecordBatch.from_arrays([i, pa.nulls(len(i), pa.string()), *cols], names)
            for i, x in strict:
                if len(i):
                    got = [diagnose(v, spec, patterns) for v in x.to_pylist()]
                    yield pa.RecordBatch.from_arrays([i, pa.array([r for r, _ in got], pa.string()), *(pa.array([p[k] if p else None for _, p in got], pa.string()) for k in range(len(spec.fields)))], names)

    return spread(df.select(F.col(id_col).alias("id"), F.col(line_col).alias("line")), "id").mapInArrow(run, schema)


def typed(parsed: DataFrame, spec: RecordSpec, id_name: str) -> DataFrame:
    """The valid rows with each field cast to its type; an empty value of a non-string field is null.

    unread names the fields, in order, whose value is not of their type and stands as null; null where there are none. (A field
    without a rule does not make its row fail.)
    """
    value = lambda k: F.nullif(F.trim(F.col(f"f{k}")), F.lit(""))
    cast = lambda k, f: F.trim(F.col(f"f{k}")).alias(f.name) if f.type == "string" else value(k).try_cast(f.type).alias(f.name)
    lost = [F.when(value(k).isNotNull() & value(k).try_cast(f.type).isNull(), f.name) for k, f in enumerate(spec.fields) if f.type != "string"]
    return parsed.filter("reason is null").select(F.col("id").alias(id_name), *(cast(k, f) for k, f in enumerate(spec.fields)), F.nullif(F.concat_ws(",", *lost), F.lit("")).alias("unread"))


def rejected(parsed: DataFrame, id_name: str) -> DataFrame:
    """(id, reason) of the lines that fail."""
    return parsed.filter("reason is not null").select(F.col("id").alias(id_name), "reason")


#: The fields of a ratings export, in order.
RATINGS = RecordSpec(
    (
        Field("name", "string", r"\p{L}", "name"),
        Field("user_id", "bigint"),
        Field("ifpa_id", "bigint", r"^(?:|0*[1-9][0-9]*)$", "ifpa_id"),
        Field("rating", "double", r"^[0-9]+(?:\.[0-9]+)?$", "rating"),
        Field("rd", "double"),
        Field("lower_bound", "double"),
        Field("last_rating_period", "date", r"^(?:|[0-9]{4}-[0-9]{2}-[0-9]{2})$", "last_rating_period", True),
        Field("rating_class", "int"),
    ),
    "name,user id,",
)
