"""Filters built from values: all are Column expressions that Catalyst can push to the scan where the source allows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_equal(values: Mapping[str, object]) -> Column:
    """Conjunction of equalities over the values that are given; none given: true."""
    parts = [F.col(c) == F.lit(v) for c, v in values.items() if v is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def in_list(c: str, values: Iterable[object]) -> Column:
    """IN; an empty list matches nothing."""
    vs = list(values)
    return F.col(c).isin(*vs) if vs else F.lit(False)


def equal_ci(c: Column, v: Column) -> Column:
    return F.lower(c) == F.lower(v)


def contains_either_way(a: Column, b: Column) -> Column:
    """One text contains the other, without regard to case; an empty filter matches."""
    la, lb = F.lower(a), F.lower(b)
    return (b == "") | F.contains(la, lb) | F.contains(lb, la)


def source_pattern(pattern: str, url: Column, kind: Column) -> Column:
    """'url|type': both must hold; without a bar the pattern is part of the URL or equals the type."""
    left, bar, right = pattern.partition("|")
    if bar:
        return F.contains(F.lower(url), F.lit(left.lower())) & (F.lower(kind) == right.lower())
    return F.contains(F.lower(url), F.lit(left.lower())) | (F.lower(kind) == left.lower())


def prefix_range(c: str, prefix: str) -> Column:
    """>= prefix and < the next prefix: a range that prunes row groups."""
    return (F.col(c) >= prefix) & (F.col(c) < prefix[:-1] + chr(ord(prefix[-1]) + 1))


def grid(column: str, operator: str, value: str) -> Column:
    """One condition of a data grid. Ordered operators compare as numbers where both sides are, else as times; a null matches only equals ''."""
    c, text = F.col(column), F.col(column).cast("string")
    if operator == "contains":
        return F.coalesce(F.contains(F.lower(text), F.lit(value.lower())), F.lit(False))
    if operator == "equals":
        return (c.isNull() | (text == "")) if value == "" else F.coalesce(F.lower(text) == value.lower(), F.lit(False))
    op = {"gt": Column.__gt__, "lt": Column.__lt__, "ge": Column.__ge__, "le": Column.__le__}[operator]
    n, v = text.try_cast("double"), F.lit(value).try_cast("double")
    return F.coalesce(op(n, v), op(F.try_to_timestamp(text), F.try_to_timestamp(F.lit(value))), F.lit(False))


def any_text(df: DataFrame, query: str) -> Column:
    """A text column contains the query."""
    cols = [f for f, t in df.dtypes if t == "string"]
    return F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(query.lower()))


def completeness(*cs: Column) -> Column:
    """How many attributes are filled."""
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("int"), F.lit(0)) for c in cs])


#: Link text and URL rules of document types, first match wins.
TEXT_RULES = (
    ("feature matrix", "FeatureMatrix"),
    ("service bulletin", "ServiceBulletin"),
    ("game code", "Firmware"),
    ("promotional", "Flyer"),
    ("electronics", "Schematic"),
    ("manual", "Manual"),
    ("schematic", "Schematic"),
    ("firmware", "Firmware"),
    ("bulletin", "ServiceBulletin"),
    ("flyer", "Flyer"),
    ("feature", "Flyer"),
    ("spec", "SpecSheet"),
    ("rulesheet", "Rulesheet"),
    ("rule sheet", "Rulesheet"),
    ("rulebook", "Rulesheet"),
    ("rules", "Rulesheet"),
)
URL_RULES = (("manual", "Manual"), ("quick-reference-guide", "Manual"), ("schematic", "Schematic"), (".zip", "Firmware"), (".spk", "Firmware"), ("rulesheet", "Rulesheet"))


def document_type(text: Column, url: Column) -> Column:
    """The type of a document by its first matching rule: link text, then URL, else Other."""
    out = None
    for side, rules in ((F.lower(text), TEXT_RULES), (F.lower(url), URL_RULES)):
        for needle, label in rules:
            cond = F.contains(side, F.lit(needle))
            out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("Other")


def action_type(url: Column) -> Column:
    """What a link does, by its file extension."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"\.([A-Za-z0-9]{1,5})$", 1))
    return F.when(ext == "pdf", "view").when(ext.isin("zip", "spk", "exe", "bin"), "download").when(ext.isin("jpg", "png", "gif"), "image").when(ext == "", "page").otherwise("other")


def maker_key(c: Column, rules: Iterable[tuple[str, str]] = ()) -> Column:
    """Key of a maker: the first rule whose part it contains, else letters and digits only, else 'unknown'."""
    low = F.lower(c)
    out = F.when(c.isNull(), "unknown")
    for needle, key in rules:
        out = out.when(F.contains(low, F.lit(needle)), key)
    bare = F.regexp_replace(low, "[^a-z0-9]", "")
    return out.otherwise(F.when(bare == "", "unknown").otherwise(bare))
