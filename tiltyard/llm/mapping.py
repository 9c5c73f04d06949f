"""Mapping free-entered values to a canonical list: distinct values, an n-gram inverted index, weighted cosine, threshold and margin.

The score is a soft weighted cosine over words (see strings.likeness), to which the cosine over character n-grams adds a
fiftieth. Entries are compared in the order of what they could score at most, by the n-gram index and the bound of the soft
cosine, until none left could be the best or within the margin of it.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltyard.llm.strings import Bounds, Weights, grams, likeness, words
from tiltyard.session import spread

UNMATCHED = "unmatched"


@dataclass(frozen=True)
class ListRules:
    """How values of one list are typed: words without weight, decorations to cut, usual short forms, and what counts as a match."""

    light: frozenset[str] = frozenset()
    decoration: str = r"$^"
    short_forms: tuple[tuple[str, str], ...] = ()
    initials: bool = False
    typed_keys: bool = True  # keys are words that people type, with errors
    head_names: bool = False
    ordinals: bool = False  # ordinals (of an anniversary) are light where the list has no such word
    accept: float = 0.8
    margin: float = 0.02


#: Company forms and words for a line of business; words for a product variant or its kind; the two-letter names of editions.
RULES = {
    "manufacturer": ListRules(frozenset("ltd inc gmbh co international corp llc company limited the pinball amusement amusements games coin works manufacturing entertainment".split()), accept=0.78),
    "edition": ListRules(
        frozenset("edition ed model version rerun re run new in box eu use inclusive w with day pre production base the".split()),
        r"(?:\s*(?:#\s*\d+|/\s*eu|/\s*us|\(\s*\d\w\w run\s*\)|-\s*new in box))+\s*$",
        (("le", "limited"), ("ce", "collector"), ("collectors", "collector"), ("founder", "founders")),
        ordinals=True,
        accept=0.78,
    ),
    "group": ListRules(frozenset("the and of a pinball machine pin game".split()), r"\s+(?:pinball(?: machine)?|pro|premium|le|ce|limited(?: edition)?)\s*$", initials=True, typed_keys=False, head_names=True, accept=0.81, margin=0.02),
}
_HEAD = re.compile(r"^(.+?)(?:\s*:\s+|\s+-\s+)")


Entry = tuple[str, str, str | None]


def _drawn_together(ws: list[str]) -> list[str]:
    """Words with each run of single letters as one word."""
    out: list[str] = []
    for single, run in groupby(ws, key=lambda w: len(w) == 1 and w.isalpha()):
        out += ["".join(run)] if single else list(run)
    return out


def surface_forms(entries: list[Entry], rules: ListRules) -> dict[tuple[str, ...], dict[str, float]]:
    """The ways in which each entry is written: form -> {key: cost}."""
    forms: dict[tuple[str, ...], dict[str, float]] = defaultdict(dict)
    for key, label, _ in entries:
        for ws in (words(label), words(key)) if rules.typed_keys else (words(label),):
            if ws:
                forms[tuple(ws)][key] = 0.0
        if rules.head_names and (m := _HEAD.match(label)) and (ws := words(m[1])):
            forms[tuple(ws)].setdefault(key, 0.06)
    known = {k for k, _, _ in entries}
    for short, key in rules.short_forms:
        if key in known:
            forms[tuple(short.split())].setdefault(key, 0.0)
    return forms


def list_weights(entries: list[Entry], rules: ListRules) -> tuple[Weights, dict[str, float]]:
    """(word weights, idf of n-grams) of a whole list: the same for each of its blocks."""
    forms = surface_forms(entries, rules)
    df = Counter(g for ws in forms for g in set(grams(list(ws))))
    return Weights([words(label) for _, label, _ in entries], rules.light), {g: math.log(1 + len(forms) / c) for g, c in df.items()}


class Index:
    """Inverted index of the n-grams of the surface forms of a list, or of a block of it with the weights of the whole."""

    def __init__(self, entries: list[Entry], rules: ListRules, whole: tuple[Weights, dict[str, float]] | None = None):
        self.rules = rules
        self.exact_initials: dict[str, set[str]] = defaultdict(set)
        self.manufacturers: dict[str, set[str | None]] = defaultdict(set)
        self.keys: dict[str, set[str]] = defaultdict(set)
        for key, label, m in entries:
            self.manufacturers[key].add(m)
            self.keys[key.lower()].add(key)
            lw = words(label)
            if rules.initials and len(lw) >= 2:
                for ws in (lw, [w for w in lw if w not in ("the", "and", "of", "a")]):
                    if len(ws) >= 2:
                        self.exact_initials["".join(w[0] for w in ws)].add(key)
        self.forms = [(list(ws), keys) for ws, keys in surface_forms(entries, rules).items()]
        self.weights, self.idf = whole or list_weights(entries, rules)
        self.bounds = Bounds([ws for ws, _ in self.forms], self.weights)
        self.postings: dict[str, dict[int, float]] = defaultdict(dict)
        for i, (ws, _) in enumerate(self.forms):
            v = {g: c * self.idf[g] for g, c in grams(ws).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            for g, x in v.items():
                self.postings[g][i] = x / norm
        self._read: dict[tuple[str, ...], dict[str, float]] = {}

    def cosines(self, ws: list[str], ids: list[int] | None = None) -> list[float]:
        """The weighted n-gram cosine of some forms, or of all, by the postings of the value's n-grams."""
        ids = list(range(len(self.forms))) if ids is None else ids
        v = {g: c * self.idf.get(g, 1.0) for g, c in grams(ws).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        lists = [(x / norm, p) for g, x in v.items() if (p := self.postings.get(g))]
        return [sum(x * p[i] for x, p in lists if i in p) for i in ids]

    def _scored(self, ws: list[str]) -> dict[str, float]:
        """key -> score of the entries that are the best for one reading of a value, or within the margin of it.

        Forms are compared in the order of what they could score at most, until none left could be the best or near it. Values
        that are read as the same words share the work.
        """
        key = tuple(ws)
        got = self._read.get(key)
        if got is not None:
            return got
        most = 0.98 * self.bounds.upper(ws) + 0.02
        least = self.rules.accept - self.rules.margin
        best: dict[str, float] = {}
        top = 0.0
        high = np.flatnonzero(most > least)
        rounds = [high[np.argsort(-most[high], kind="stable")]]
        for order in rounds:
            if len(order):
                cos = dict(zip(order.tolist(), self.cosines(ws, order.tolist()))) if len(order) <= 64 else None
                for i in order.tolist():
                    # a form that can't come within the margin of acceptance matters only as the best score of an unmatched value
                    if most[i] <= (top - self.rules.margin if most[i] > least else max(top, 0.02 + 1e-8)):
                        break
                    form, keys = self.forms[i]
                    s = 0.98 * likeness(ws, form, self.weights) + 0.02 * (cos[i] if cos else self.cosines(ws, [i])[0])
                    for k, cost in keys.items():
                        best[k] = max(best.get(k, 0.0), s - cost)
                        top = max(top, best[k])
            if len(rounds) == 1 and top < self.rules.accept:
                rounds.append(np.argsort(-np.where(most > least, -1.0, most), kind="stable")[: len(most) - len(high)])
        got = {k: s for k, s in best.items() if s > top - self.rules.margin}
        if len(self._read) >= 50_000:
            self._read.clear()
        self._read[key] = got
        return got

    def _variants(self, value: str) -> list[list[str]]:
        out = [words(value)]
        cut = re.sub(self.rules.decoration, "", value, flags=re.I)
        if cut != value and cut.strip():
            out.append(words(cut))
        if self.rules.ordinals:
            out += [[w for w in ws if w in self.weights or not re.fullmatch(r"\d+(?:st|nd|rd|th)", w)] for ws in list(out)]
        # letters typed apart are one word
        out += [_drawn_together(ws) for ws in out if sum(len(w) == 1 for w in ws) > 1]
        return [w for k, w in enumerate(out) if w and w not in out[:k]]

    def candidates(self, value: str, hint: str | None = None) -> list[tuple[str, str, float, bool]]:
        """(kind, key, score, made by hint) of the entries that could be meant: 'exact' the key itself, 'name' the best by name and
        all within the margin of it, 'letters' those with these initials."""
        bare = value.strip()
        if bare.lower() in self.keys:
            return [("exact", k, 1.0, False) for k in self.keys[bare.lower()]]
        best: dict[str, float] = {}
        for ws in self._variants(value):
            for k, s in self._scored(ws).items():
                best[k] = max(best.get(k, 0.0), s)
        top = max(best.values(), default=0.0)
        out = [("name", k, s) for k, s in best.items() if s > top - self.rules.margin]
        if self.rules.initials and bare.isupper():
            out += [("letters", k, 0.9) for k in self.exact_initials.get(bare.replace(".", "").lower(), ())]
        return [(kind, k, s, hint is not None and hint in self.manufacturers[k]) for kind, k, s in out]

    def resolve(self, value: str, hint: str | None = None) -> tuple[str, float]:
        """(key, score) of the entry meant, or unmatched with the best score."""
        return decide(value, self.candidates(value, hint), self.rules)


def decide(value: str, found: list[tuple[str, str, float, bool]], rules: ListRules) -> tuple[str, float]:
    """(key, score) of the entry meant among the candidates of all blocks of a list, or unmatched with the best score.

    Score of an entry: the soft weighted cosine of its nearest form, a fiftieth of it from the n-gram cosine. The
    entry is taken where its score is accepted and stands out from the next by the margin; entries that can't be told
    apart by name are told apart by hint (the manufacturer), else left unmatched.
    """
    exact = [k for kind, k, _, _ in found if kind == "exact"]
    if exact:
        return min(exact, key=lambda k: (k != value.strip(), k)), 1.0
    best: dict[str, float] = {}
    made: dict[str, bool] = {}
    named = max((s for kind, _, s, _ in found if kind == "name"), default=0.0)
    for kind, k, s, own in found:
        if kind == "name" or named < rules.accept:
            best[k] = max(best.get(k, 0.0), s)
            made[k] = made.get(k, False) or own
    if not best:
        return UNMATCHED, 0.0
    ranked = sorted(((s, k) for k, s in best.items()), key=lambda x: (-x[0], x[1]))
    top = ranked[0][0]
    if top < rules.accept:
        return UNMATCHED, top
    near = [k for s, k in ranked if s > top - rules.margin]
    if len(near) > 1:
        own = [k for k in near if made[k]]
        near = own if len(own) == 1 else near
    return (near[0], top) if len(near) == 1 else (UNMATCHED, top)


def map_values(values: DataFrame, canon: list[tuple[str, str, str | None]], rules: ListRules, value: str = "value", hint: str | None = None, block: int = 50_000) -> DataFrame:
    """(value, [hint], canon_key, score) per distinct value (and hint). canon: (key, label, manufacturer) of the list.

    Values are deduplicated first, so the work follows their distinct spellings. The index of at most `block` entries goes to
    the workers; a longer list is taken block by block, with the weights of the whole list, and threshold, margin and hint are
    applied once to the candidates of all blocks, so blocks change no result. Null values give no row; blank ones are unmatched.
    """
    cols = [value] + ([hint] if hint else [])
    distinct = spread(values.filter(F.col(value).isNotNull()).select(*cols).distinct(), *cols)
    schema = ", ".join(f"`{c}` string" for c in cols)
    resolved = schema + ", canon_key string, score double"
    if len(canon) <= block:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index(canon, rules)
            for f in frames:
                got = [index.resolve(r[0], r[1] if hint else None) for r in f.itertuples(index=False)]
                yield f.assign(canon_key=[g[0] for g in got], score=[g[1] for g in got])

        return distinct.mapInPandas(run, resolved)
    whole = list_weights(canon, rules)

    def one(part: list[Entry]) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index(part, rules, whole)
            for f in frames:
                yield f.assign(found=[json.dumps(index.candidates(r[0], r[1] if hint else None)) for r in f.itertuples(index=False)])

        return distinct.mapInPandas(run, schema + ", found string")

    out = None
    for at in range(0, len(canon), block):
        d = one(canon[at : at + block])
        out = d if out is None else out.unionByName(d)

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [decide(v, [tuple(c) for part in parts for c in json.loads(part)], rules) for v, parts in zip(f[value], f["found"])]
            yield f[cols].assign(canon_key=[g[0] for g in got], score=[g[1] for g in got])

    return out.groupBy(*cols).agg(F.collect_list("found").alias("found")).mapInPandas(settle, resolved)


def canon_list(table: DataFrame, name: str) -> list[tuple[str, str, str | None]]:
    """The entries of one list: a small reference table, read to the driver block by block of map_values."""
    return [(r[0], r[1], r[2]) for r in table.filter(F.col("list_name") == name).select("canon_key", "label", "manufacturer_key").distinct().collect()]


def p6(aliases: DataFrame, stats: DataFrame, canon: DataFrame) -> DataFrame:
    """(table_name, field_name, row_id, value, canon_key, score) of every typed value that is no entry of its list as it stands."""
    lists = {n: canon_list(canon, n) for n in ("manufacturer", "edition", "group")}

    def listed(c: str, name: str) -> DataFrame:
        known = canon.filter(F.col("list_name") == name)
        return known.select(F.col("canon_key").alias(c)).unionByName(known.select(F.col("label").alias(c))).filter(F.col(c).isNotNull()).distinct()

    def typed(df: DataFrame, c: str, name: str) -> DataFrame:
        return df.filter(F.col(c).isNotNull()).join(listed(c, name), c, "left_anti")

    makers = map_values(aliases, lists["manufacturer"], RULES["manufacturer"], "manufacturer_key").withColumnRenamed("canon_key", "maker")
    a = aliases.select("alias_id", "alias", "manufacturer_key", "opdb_group_id", "machine_id")
    m = typed(a, "manufacturer_key", "manufacturer").join(makers.withColumnRenamed("maker", "canon_key"), "manufacturer_key")
    out = m.select(F.lit("alias_entries").alias("table_name"), F.lit("manufacturer_key").alias("field_name"), F.col("alias_id").alias("row_id"), F.col("manufacturer_key").alias("value"), "canon_key", "score")
    g = typed(a.filter("opdb_group_id is null and machine_id is null"), "alias", "group").join(makers.select("manufacturer_key", F.nullif("maker", F.lit(UNMATCHED)).alias("maker")), "manufacturer_key", "left")
    groups = map_values(g, lists["group"], RULES["group"], "alias", "maker")
    g = g.join(groups, (g["alias"] == groups["alias"]) & g["maker"].eqNullSafe(groups["maker"])).select(
        F.lit("alias_entries").alias("table_name"), F.lit("alias").alias("field_name"), F.col("alias_id").alias("row_id"), g["alias"].alias("value"), "canon_key", "score"
    )
    s = typed(stats.select("stat_id", "edition_label"), "edition_label", "edition")
    e = s.join(map_values(s, lists["edition"], RULES["edition"], "edition_label"), "edition_label").select(
        F.lit("doc_stats").alias("table_name"), F.lit("edition_label").alias("field_name"), F.col("stat_id").alias("row_id"), F.col("edition_label").alias("value"), "canon_key", "score"
    )
    return out.unionByName(g).unionByName(e).dropDuplicates(["table_name", "field_name", "row_id"])
