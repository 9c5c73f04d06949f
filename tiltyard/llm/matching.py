"""Matching records across sources without keys.

Walks over a record - attribute - token graph give the vectors of the tokens (words and character trigrams): what random
directions a walk from the token meets, as the expectation over all walks and all records. Records are weighted means of their
tokens. Several tables of random hyperplanes give each record its blocks; candidates of a block get their exact cosine and, all
of them that could reach the least confidence by a bound of it, their soft weighted cosine over words; a logistic model, fitted
on all labelled rows, calibrates both cosines, with the agreement of maker and year, to a confidence.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltyard.llm.mapping import RULES
from tiltyard.llm.strings import Bounds, Weights, likeness, word_likeness, words
from tiltyard.session import cut, spread

_YEAR = re.compile(r"[\[(]?\s*(?:'(\d\d)|\b((?:19|20)\d\d))\b\s*[\])]?")
_NUMERALS = {"2": "ii", "3": "iii", "4": "iv", "5": "v"}
_LIGHT = frozenset("the and of a".split())
_MAKER_LIGHT = RULES["manufacturer"].light
#: Sums over rows are taken in whole numbers of one part in this, so they don't depend on the order of the rows.
_UNIT = 1 << 30


@dataclass(frozen=True)
class Config:
    """window: steps of the walks that count.

    least: the confidence below which a title says nothing for a group. sample and labelled are not read any more (callers still
    give them): vectors and confidence are fitted on all rows.
    """

    sample: int = 2500
    labelled: int = 700
    window: int = 2
    dim: int = 48
    tables: int = 24
    bits: int = 8
    least: float = 0.02
    accept: float = 0.3
    margin: float = 0.01
    seed: int = 7
    block: int = 50_000


def parse_title(title: str) -> tuple[str, int | None]:
    """(title, year): a year that stands in the title is taken out of it."""
    m = None
    for m in _YEAR.finditer(title):
        pass
    if m is None or m.start() == 0:
        return title, None
    year = int(m[2]) if m[2] else 1900 + int(m[1]) if int(m[1]) > 40 else 2000 + int(m[1])
    return (title[: m.start()] + " " + title[m.end() :]).strip(" ,-"), year


def added_words(titles: DataFrame, title: str, catalogue: list[str], least: int = 5, share: float = 0.002, over: float = 10.0) -> frozenset[str]:
    """Words that sources add behind titles: among the last two words of at least `least` typed titles and `share` of them, and that
    `over` times as often as of the catalogue's.

    Counted over all different titles with partial sums; a word with `share` of the titles comes to the driver, so at most 2 / share.
    """
    ws = F.split(F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}']+", " ")), " ")
    ws = F.filter(ws, lambda w: ~w.rlike(r"^'?\d*$"))
    t = titles.select(F.slice(ws, F.greatest(F.lit(2), F.size(ws) - 1), 2).alias("w"))
    n = titles.count()
    got = {r["w"]: r["n"] for r in t.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= max(least, share * n)).collect()}
    own = Counter(w for x in catalogue for w in set(words(x)[-2:]))
    return frozenset(w for w, c in got.items() if c / max(1, n) >= over * own[w] / max(1, len(catalogue)))


def variants(title: str, maker_words: set[str], added: frozenset[str] = frozenset()) -> list[list[str]]:
    """The ways to read a title: as typed, joined words parted at capitals, without a leading maker, without added words."""
    t = re.sub(r"^(.*),\s*the\b\s*(.*)$", r"the \1 \2", title, flags=re.I)
    first = [[_NUMERALS.get(w, w) for w in words(t)]]
    parted = words(re.sub(r"(?<=[a-z]{2})(?=[A-Z][a-z])", " ", t))
    if parted != first[0]:
        first.append(parted)
    out = []
    for ws in first:
        out.append(ws)
        for drop in (1, 2):
            if len(ws) - drop >= 2 and any(word_likeness(ws[0], w) > 0.8 for w in maker_words):
                out.append(ws[drop:])
    for ws in list(out):
        cut = list(ws)
        while len(cut) > 1 and cut[-1] in added:
            cut.pop()
        if len(cut) < len(ws):
            out.append(cut)
    return [w for w in out if w]


def features(title_words: list[str]) -> Counter:
    """The tokens of a record: its words and their character trigrams."""
    out = Counter("w:" + w.rstrip(".") for w in title_words)
    t = " " + " ".join(w.rstrip(".") for w in title_words) + " "
    out.update("g:" + t[i : i + 3] for i in range(len(t) - 2))
    return out


Record = tuple[list[str], str | None, int | None]


def chances(title_words: list[str], maker: str | None, year: int | None) -> dict[str, float]:
    """The tokens that a walk goes to from a record, with their chances: 0.7 its title, else maker or year; of these any token."""
    rest = [ts for ts in ([f"w:{w}" for w in words(maker or "")], [f"y:{year}"] if year else []) if ts]
    out: dict[str, float] = defaultdict(float)
    for share, ts in [(0.7 if rest else 1.0, sorted(features(title_words))), *((0.3 / len(rest), ts) for ts in rest)]:
        for t in ts:
            out[t] += share / len(ts)
    return out


def visits(records: Iterable[Record]) -> Counter:
    """How often walks that start at each record once meet each token, in units."""
    out: Counter = Counter()
    for r in records:
        for t, z in chances(*r).items():
            out[t] += round(z * _UNIT)
    return out


def walk(records: Iterable[Record], ids: dict[str, int], x: np.ndarray, size: int = 2_000) -> np.ndarray:
    """One step token - record - token: for each token the sum, over the records that hold it, of what x is at the record's tokens, in units."""
    out = np.zeros(x.shape, np.int64)
    it = iter(records)
    while block := [chances(*r) for _, r in zip(range(size), it)]:
        t = np.array([ids[k] for z in block for k in z], np.int64)
        z = np.array([p for z in block for p in z.values()])[:, None]
        n = np.array([len(b) for b in block])
        at = np.add.reduceat(z * x[t], np.cumsum(n) - n, axis=0)
        got = np.rint(z * np.repeat(at, n, axis=0) * _UNIT).astype(np.int64)
        order = np.argsort(t, kind="stable")
        some, first = np.unique(t[order], return_index=True)
        out[some] += np.add.reduceat(got[order], first, axis=0)
    return out


def token_vectors(met: dict[str, int], step: Callable[[dict[str, int], np.ndarray], np.ndarray], c: Config) -> tuple[dict[str, int], np.ndarray]:
    """(number of each token, vectors): its own direction, and the mean directions of what walks from it meet after 1 to c.window steps.

    met: visits of all records; step: walk over all records. The directions of tokens met everywhere tell nothing apart: each
    counts by the inverse square root of its visits, and the mean over all visits is taken off.
    """
    ids = {t: i for i, t in enumerate(sorted(met))}
    if not ids:
        return ids, np.zeros((0, c.dim), np.float32)
    d = np.array([met[t] for t in ids], float)[:, None] / _UNIT
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    own = np.array([_direction(t, c.dim) for t in ids], float)
    out, x = own.copy(), own / np.sqrt(np.maximum(d, 1.0))
    for _ in range(c.window):
        x = step(ids, x) / _UNIT / d
        x -= (d * x).sum(axis=0) / d.sum()
        out += unit(x)
    return ids, unit(out).astype(np.float32)


@lru_cache(maxsize=50_000)
def _direction(token: str, dim: int) -> np.ndarray:
    """A fixed random direction for a token without a vector."""
    x = np.random.default_rng(zlib.crc32(token.encode("utf-8", "surrogatepass"))).standard_normal(dim)
    return (x / np.linalg.norm(x)).astype(np.float32)


@dataclass
class Model:
    ids: dict[str, int]
    vectors: np.ndarray
    idf: dict[str, float]
    planes: np.ndarray
    config: Config
    coef: np.ndarray = field(default_factory=lambda: np.zeros(5))
    added: frozenset[str] = frozenset()

    def embed(self, title_words: list[str]) -> np.ndarray:
        """Weighted mean of the token vectors; tokens never seen get a fixed random direction each, so they tell records apart."""
        out = np.zeros(self.config.dim, np.float32)
        for t, n in features(title_words).items():
            i = self.ids.get(t)
            x = _direction(t, self.config.dim) if i is None else self.vectors[i]
            out += n * self.idf.get(t, 1.0) * x
        norm = float(np.linalg.norm(out))
        return out / norm if norm else out

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        c = self.config
        signs = (x @ self.planes.T > 0).reshape(*x.shape[:-1], c.tables, c.bits)
        return signs @ (1 << np.arange(c.bits))


Row = tuple[str, str, str | None, str | None, int | None]


def forms(title: str | None) -> list[tuple[list[str], float]]:
    """(words, cost) of the forms of a catalogue title: whole, and what stands before a colon or dash."""
    head = re.match(r"^(.+?)(?:\s*:\s+|\s+-\s+)", title or "")
    return [(ws, cost) for ws, cost in ((words(title or ""), 0.0), (words(head[1]) if head else [], 0.06)) if ws]


class Names:
    """What is counted over the whole catalogue, however it is parted: weights of words, makers and their words."""

    def __init__(self, rows: list[Row]):
        whole = {(key, tuple(ws)): cost for key, title, *_ in reversed(rows) for ws, cost in reversed(forms(title))}
        self.weights = Weights([list(ws) for (_, ws), cost in whole.items() if not cost], _LIGHT)
        self.makers = {m: words(m) for _, _, maker, maker_key, _ in rows for m in (maker, maker_key) if m}
        self.maker_words = {w for ws in self.makers.values() for w in ws if len(w) > 3 and w not in _MAKER_LIGHT}
        self.maker_w = Weights([*self.makers.values()], _MAKER_LIGHT)


class Catalogue:
    """The records of the reference side, or of a part of it with the names of the whole: vectors, blocks and words."""

    def __init__(self, rows: list[Row], model: Model, names: Names | None = None):
        self.model = model
        names = names or Names(rows)
        self.keys: list[str] = []
        self.words: list[list[str]] = []
        self.cost: list[float] = []
        self.maker: list[tuple[str, ...]] = []
        self.years: dict[str, set[int]] = defaultdict(set)
        seen: dict[tuple[str, tuple[str, ...]], int] = {}
        for key, title, maker, maker_key, year in rows:
            mk = tuple(x for x in (maker, maker_key) if x)
            if year:
                self.years[key].add(year)
            for ws, cost in forms(title):
                if (key, tuple(ws)) not in seen:
                    seen[key, tuple(ws)] = len(self.keys)
                    self.keys.append(key)
                    self.words.append(ws)
                    self.cost.append(cost)
                    self.maker.append(mk)
        self.weights, self.makers, self.maker_words, self.maker_w = names.weights, names.makers, names.maker_words, names.maker_w
        self.x = np.array([model.embed(w) for w in self.words], np.float32).reshape(-1, model.config.dim)
        self.tables: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(model.config.tables)]
        if len(self.x):
            for i, bs in enumerate(model.buckets(self.x)):
                for t, b in enumerate(bs):
                    self.tables[t][int(b)].append(i)
        self._agree: dict[tuple[str, str], float] = {}
        self.bounds = Bounds(self.words, self.weights)
        self.costs = np.array(self.cost)
        groups: dict[str, int] = {}
        self.group = np.array([groups.setdefault(k, len(groups)) for k in self.keys], np.int64)
        self.groups = list(groups)
        first: dict[tuple[str, ...], int] = {}
        for i, mk in enumerate(self.maker):
            first.setdefault(mk, i)
        self.maker_first = list(first.values())
        order = {mk: n for n, mk in enumerate(first)}
        self.maker_id = np.array([order[mk] for mk in self.maker], np.int64)
        self._by_maker: dict[str | None, np.ndarray] = {}
        self._by_year: dict[int, np.ndarray] = {}

    def maker_agreement(self, typed: str | None, i: int) -> float:
        """1 the same maker, -1 another, 0 unknown."""
        if not typed or not self.maker[i]:
            return 0.0
        best = 0.0
        for m in self.maker[i]:
            k = (typed, m)
            if k not in self._agree:
                ws = words(typed)
                self._agree[k] = max(likeness(ws, self.makers[m], self.maker_w), likeness(["".join(w.rstrip(".") for w in ws)], ["".join(self.makers[m])], self.maker_w))
            best = max(best, self._agree[k])
        if best >= 0.72:
            return 1.0
        known = max((likeness(words(typed), ws, self.maker_w) for ws in self.makers.values()), default=0) if (typed, "") not in self._agree else self._agree[typed, ""]
        self._agree[typed, ""] = known
        return -1.0 if known >= 0.72 else -0.3

    def agreement(self, maker: str | None, year: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(maker agreement, year agreement) of each form."""
        if maker not in self._by_maker:
            if len(self._by_maker) > 5_000:
                self._by_maker.clear()
            self._by_maker[maker] = np.array([self.maker_agreement(maker, i) for i in self.maker_first])
        if not year:
            return self._by_maker[maker][self.maker_id], np.zeros(len(self.keys))
        if year not in self._by_year:
            ys = [self.years.get(k) for k in self.groups]
            self._by_year[year] = np.array([0 if not y else 1 if any(abs(year - x) <= 1 for x in y) else -1 for y in ys], np.int8)
        return self._by_maker[maker][self.maker_id], self._by_year[year][self.group].astype(float)

    def hits(self, title: str, brute: bool = False) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """(readings, forms that share a block with any reading of the title, cosine of each reading and form)."""
        reads = variants(title, self.maker_words, self.model.added)
        if not reads or not len(self.x):
            return reads, np.zeros(0, np.int64), np.zeros((len(reads), 0))
        x = np.array([self.model.embed(ws) for ws in reads], np.float32)
        if brute:
            ids = np.arange(len(self.x))
        else:
            hit: set[int] = set()
            for bs in self.model.buckets(x):
                for t, b in enumerate(bs):
                    hit.update(self.tables[t].get(int(b), ()))
            ids = np.fromiter(sorted(hit), np.int64, len(hit))
        return reads, ids, x @ self.x[ids].T

    def candidates(self, title: str, brute: bool = False) -> list[tuple[int, float, list[str]]]:
        """(form, cosine, reading) of all forms that share a block with any reading of the title, by the nearest reading."""
        reads, ids, cos = self.hits(title, brute)
        return [(int(i), float(cos[r, k]), reads[r]) for k, (i, r) in enumerate(zip(ids, cos.argmax(axis=0) if len(ids) else ()))]

    def _bounded(self, title: str, brute: bool = False) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """(readings, forms, cosine, what the likeness can be at most) of the forms that share a block with the title."""
        reads, ids, cos = self.hits(title, brute)
        if not len(ids):
            return reads, ids, np.zeros(0), np.zeros(0)
        return reads, ids, cos.max(axis=0).astype(float), np.maximum.reduce([self.bounds.upper(ws) for ws in reads])[ids] - self.costs[ids]

    def _likeness(self, reads: list[list[str]], i: int) -> float:
        return max(likeness(ws, self.words[i], self.weights) for ws in reads) - self.cost[i]

    def nearest(self, title: str, maker: str | None, year: int | None, of: str | None = None, without: str | None = None) -> np.ndarray | None:
        """Features (1, cosine, likeness, maker agreement, year agreement) of the likest form, of one key or of all but one."""
        reads, ids, cos, most = self._bounded(title)
        ma, ya = self.agreement(maker, year)
        best: tuple[float, float, int] | None = None
        for o in np.argsort(-most, kind="stable"):
            i = int(ids[o])
            if best and most[o] < best[0]:
                break
            if self.keys[i] != without and (of is None or self.keys[i] == of):
                got = (self._likeness(reads, i), float(cos[o]), i)
                best = got if best is None or got[:2] > best[:2] else best
        return None if best is None else np.array([1.0, best[1], best[0], ma[best[2]], ya[best[2]]])

    def resolve(self, title: str, maker: str | None, year: int | None, brute: bool = False) -> list[tuple[str, float]]:
        """(key, confidence) of all keys of the least confidence or more, best first: no form of the blocks is left unseen that could reach it."""
        reads, ids, cos, most = self._bounded(title, brute)
        ma, ya = self.agreement(maker, year)
        w, c = self.model.coef, self.model.config
        rest = w[0] + w[1] * cos + w[3] * ma[ids] + w[4] * ya[ids]
        could = rest + w[2] * (most if w[2] > 0 else -self.costs[ids])
        least = math.log(c.least / (1 - c.least))
        out: dict[str, float] = {}
        for o in np.flatnonzero(could >= least):
            i = int(ids[o])
            z = rest[o] + w[2] * self._likeness(reads, i)
            if z >= max(least, out.get(self.keys[i], least)):
                out[self.keys[i]] = float(z)
        return sorted(((k, float(1 / (1 + np.exp(-z)))) for k, z in out.items()), key=lambda x: (-x[1], x[0]))


def _noisy(title: str, rng: np.random.Generator) -> str:
    """A title with a typing error or two: how the confidence learns what errors look like."""
    t = list(title)
    for _ in range(int(rng.integers(0, 3))):
        if len(t) < 4:
            break
        i, kind = int(rng.integers(1, len(t) - 1)), int(rng.integers(4))
        if kind == 0:
            del t[i]
        elif kind == 1:
            t[i], t[i + 1] = t[i + 1], t[i]
        elif kind == 2:
            t[i] = chr(97 + int(rng.integers(26)))
        else:
            t.insert(i, t[i])
    return "".join(t)


def examples(index: Catalogue, labelled: Iterable[tuple[str, str | None, str]]) -> Iterator[tuple[tuple[str, str | None, str], float, np.ndarray]]:
    """(labelled row, 1 its own key or 0 another, features): what the confidence learns from.

    Each labelled (title, maker, key) gives its key as a positive, with and without typing errors, and the nearest other key,
    once its own is left out, as a negative: what a title that describes nothing in the catalogue would be matched to.
    """
    for row in labelled:
        title, maker, key = row
        rng = np.random.default_rng([index.model.config.seed, zlib.crc32("\0".join(x or "" for x in row).encode("utf-8", "surrogatepass"))])
        t, y = parse_title(title)
        mk = maker if rng.random() < 0.7 else None
        for label, got in ((1.0, index.nearest(_noisy(t, rng), mk, y, of=key)), (0.0, index.nearest(_noisy(t, rng), mk, y, without=key))):
            if got is not None:
                yield row, label, got


#: Logistic regression is drawn towards what typed names are like where labels say nothing (labelled titles carry no years).
_PRIOR, _STRENGTH = np.array([-17.0, 2.0, 18.0, 1.0, 2.0]), np.array([0.05, 0.5, 0.05, 1.0, 4.0])


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Coefficients of the logistic model. sums(w): gradient and Hessian of all examples at w."""
    w = _PRIOR.copy()
    for _ in range(50):
        g, h = sums(w)
        step = np.linalg.solve(h + np.diag(_STRENGTH), g + _STRENGTH * (w - _PRIOR))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _model(ids: dict[str, int], vectors: np.ndarray, titles: list[str], c: Config, added: frozenset[str]) -> Model:
    """The model without its confidence; idf from the titles of the whole catalogue."""
    df = Counter(f for t in titles for f in features(words(t)))
    idf = {t: math.log(1 + len(titles) / n) for t, n in df.items()}
    planes = np.random.default_rng(c.seed).standard_normal((c.tables * c.bits, c.dim)).astype(np.float32)
    return Model(ids, vectors, idf, planes, c, added=added)


def train(catalogue: list[Row], typed: list[tuple[str, str | None]], labelled: list[tuple[str, str | None, str]], c: Config, whole: list[Row] | None = None, added: frozenset[str] = frozenset()) -> Model:
    """The model of rows at hand: vectors from the walks over both sides' records, idf from the whole catalogue; the confidence from labelled rows."""
    recs = [(words(t or ""), m, y) for _, t, m, _, y in catalogue]
    recs += [(words(parse_title(t)[0]), m, parse_title(t)[1]) for t, m in typed]
    recs = [r for r in recs if r[0]]
    ids, vectors = token_vectors(visits(recs), lambda ids, x: walk(recs, ids, x), c)
    model = _model(ids, vectors, [t for _, t, *_ in (catalogue if whole is None else whole) if t], c, added)
    got = [(x, y) for _, y, x in examples(Catalogue(catalogue, model), labelled)]
    x, y = np.array([x for x, _ in got]).reshape(-1, 5), np.array([y for _, y in got])

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-x @ w))
        return x.T @ (p - y), (x * np.maximum(p * (1 - p), 1e-3)[:, None]).T @ x

    model.coef = newton(sums)
    return model


def _records(frames: Iterable[pd.DataFrame]) -> Iterator[Record]:
    """The records of frames (title, maker, year, typed): typed titles hold their year."""
    for f in frames:
        for title, maker, year, typed in f.itertuples(index=False):
            title, own = parse_title(title) if typed else (title, None if year is None or year != year else int(year))
            ws = words(title)
            if ws:
                yield ws, maker, own


def _sums(df: DataFrame, exprs: list) -> list[int]:
    """Sums of doubles over all rows, in units."""
    r = df.agg(*(F.sum(F.round(e * _UNIT).cast("bigint")).alias(f"s{i}") for i, e in enumerate(exprs))).first()
    return [x or 0 for x in r]


_index: dict[tuple[str, int], Catalogue] = {}


def _part(name: str, i: int, rows: list[Row], model: Model, names: Names) -> Catalogue:
    """The index of a part of the catalogue: a worker keeps the last one it made for its next tasks."""
    if (name, i) not in _index:
        _index.clear()
        _index[name, i] = Catalogue(rows, model, names)
    _index[name, i].model = model
    return _index[name, i]


def fit(catalogue: DataFrame, typed: DataFrame, labelled: DataFrame, blocks: list[list[Row]], added: frozenset[str], c: Config, name: str) -> tuple[Model, Names]:
    """The model of whole tables: catalogue and typed (title, maker, year), labelled (title, maker, group_id).

    Visits and walks are sums over all records, the confidence sums over all labelled rows, taken where the rows are: what comes
    to the driver is a number and a vector for each token of the vocabulary, and 20 sums for each step of the regression.
    """
    recs = catalogue.select("title", "maker", "year", F.lit(False).alias("typed")).unionByName(typed.select("title", "maker", F.lit(None).cast("int").alias("year"), F.lit(True).alias("typed")))
    recs = cut(spread(recs, "title", "maker", "year"), "p2-records")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(visits(_records(frames)).items(), columns=["t", "n"]).astype({"t": str, "n": "int64"})

    met = {r["t"]: r["n"] for r in recs.mapInPandas(meet, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    cols = [f"d{i}" for i in range(c.dim)]

    def step(ids: dict[str, int], x: np.ndarray) -> np.ndarray:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = walk(_records(frames), ids, x)
            at = np.flatnonzero(got.any(axis=1))
            yield pd.DataFrame(got[at], columns=cols).assign(t=at)[["t", *cols]]

        sums = recs.mapInPandas(run, "t long, " + ", ".join(f"{d} long" for d in cols)).groupBy("t").agg(*(F.sum(d).alias(d) for d in cols)).toPandas()
        out = np.zeros(x.shape, np.int64)
        out[sums["t"].to_numpy(np.int64)] = sums[cols].to_numpy(np.int64)
        return out

    ids, vectors = token_vectors(met, step, c)
    every = [r for b in blocks for r in b]
    model, names = _model(ids, vectors, [t for _, t, *_ in every if t], c, added), Names(every)

    feats = ["likeness", "cosine", "maker_says", "year_says"]
    rows, found = cut(spread(labelled, "title", "maker", "group_id"), "p2-labelled"), None
    for i, part in enumerate(blocks):
        def run(frames: Iterator[pd.DataFrame], i: int = i, part: list = part) -> Iterator[pd.DataFrame]:
            for f in frames:
                got = examples(_part(name, i, part, model, names), f.itertuples(index=False, name=None))
                yield pd.DataFrame([(*r, y, x[2], x[1], x[3], x[4]) for r, y, x in got], columns=["title", "maker", "group_id", "label", *feats])

        d = rows.mapInPandas(run, "title string, maker string, group_id string, label double, " + ", ".join(f"{k} double" for k in feats))
        found = d if found is None else found.unionByName(d)
    if len(blocks) > 1:  # the likest of all parts
        found = found.groupBy("title", "maker", "group_id", "label").agg(F.max(F.struct(*feats)).alias("x")).select("label", "x.*")
    found = cut(found.select("label", *feats), "p2-examples")
    x = [F.lit(1.0), *(F.col(k) for k in ("cosine", "likeness", "maker_says", "year_says"))]
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = sum((F.lit(float(a)) * b for a, b in zip(w, x)), F.lit(0.0))
        p = found.withColumn("p", 1 / (1 + F.exp(-z))).withColumn("v", F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-3)))
        got = np.array(_sums(p, [(F.col("p") - F.col("label")) * a for a in x] + [F.col("v") * x[i] * x[j] for i, j in pairs]), float) / _UNIT
        h = np.zeros((5, 5))
        for (i, j), s in zip(pairs, got[5:]):
            h[i, j] = h[j, i] = s
        return got[:5], h

    model.coef = newton(sums)
    return model, names


def match_documents(changes: DataFrame, machines: DataFrame, c: Config = Config()) -> DataFrame:
    """(document_id, group_id, confidence) of documents that were never resolved and whose titles describe a game of the catalogue.

    Titles and makers of a document's changes are put together; distinct (title, maker, year) are matched once. Null and blank
    titles describe nothing. A title that several groups share is told apart by maker and year; where these don't tell, the
    document does not appear. Documents without a confident match do not appear. Repeated rows change nothing. The catalogue
    goes to the workers in blocks of at most c.block records, so what is sent is bounded and no record is left out. Vectors,
    weights and confidence are of all records and all labelled rows (fit).
    """
    spark = changes.sparkSession
    ch = changes.select("document_id", "machine_id", F.nullif(F.trim("machine_title"), F.lit("")).alias("title"), F.nullif(F.trim("manufacturer"), F.lit("")).alias("maker")).filter("document_id is not null")
    state = ch.groupBy("document_id").agg(F.count("machine_id").alias("known"))
    per = ch.groupBy("document_id", "title", "maker").agg(F.count("*").alias("n"))
    open_docs = per.join(state.filter("known = 0").select("document_id"), "document_id", "left_semi")

    rows = machines.filter("group_id is not null and title is not null").select("group_id", "title", "manufacturer", "manufacturer_key", "year").distinct()
    cat = [tuple(r) for r in rows.orderBy("group_id", "title", "year").limit(c.block + 1).collect()]
    if len(cat) > c.block:
        blocks = [[tuple(r) for r in rows.filter(F.pmod(F.xxhash64("group_id"), F.lit(n)) == i).collect()] for n in [-(-rows.count() // c.block) * 2] for i in range(n)]
    else:
        blocks = [cat]
    typed = open_docs.filter("title is not null").select("title", "maker").distinct()
    lab = ch.filter("title is not null and machine_id is not null").select("title", "maker", "machine_id").join(machines.select(F.col("opdb_id").alias("machine_id"), "group_id").distinct(), "machine_id")
    labelled = lab.filter("group_id is not null").select("title", "maker", "group_id").distinct()
    added = added_words(ch.filter("title is not null").select("title").distinct(), "title", list({t for b in blocks for _, t, *_ in b}))
    name = uuid.uuid4().hex
    model, names = fit(rows.select("title", F.col("manufacturer").alias("maker"), "year"), typed, labelled, blocks, added, c, name)

    # what all changes of a document say about maker and year
    said = open_docs.filter("maker is not null").groupBy("document_id").agg(F.max(F.struct("n", "maker")).getField("maker").alias("doc_maker"))
    year_of = F.coalesce(F.regexp_extract("title", r"\b((?:19|20)\d\d)\b", 1).try_cast("int"), (F.regexp_extract("title", r"'(\d\d)\b", 1).try_cast("int") + 1900))
    years = open_docs.filter("title is not null").groupBy("document_id").agg(F.max(year_of).alias("doc_year"))
    titles = open_docs.filter("title is not null").select("document_id", "title", "maker").distinct().join(said, "document_id", "left").join(years, "document_id", "left")
    titles = titles.select("document_id", "title", F.coalesce("maker", "doc_maker").alias("maker"), F.col("doc_year").alias("year")).distinct()
    todo = spread(titles.select("title", "maker", "year").distinct(), "title", "maker")

    out = None
    for i, part in enumerate(blocks):
        def run(frames: Iterator[pd.DataFrame], i: int = i, part: list = part) -> Iterator[pd.DataFrame]:
            index = _part(name, i, part, model, names)
            for f in frames:
                got = []
                for t, m, y in f.itertuples(index=False):
                    title, own = parse_title(t)
                    yr = own or (None if y is None or y != y else int(y))
                    got += [(t, m, y, k, p) for k, p in index.resolve(title, m, yr)]
                yield pd.DataFrame(got, columns=["title", "maker", "year", "group_id", "p"]).astype({"year": "Int32"})

        d = todo.mapInPandas(run, "title string, maker string, year int, group_id string, p double")
        out = d if out is None else out.unionByName(d)
    found = titles.alias("t").join(out.alias("o"), (F.col("t.title") == F.col("o.title")) & F.col("t.maker").eqNullSafe(F.col("o.maker")) & F.col("t.year").eqNullSafe(F.col("o.year")))
    by_group = found.groupBy("t.document_id", "o.group_id").agg(F.max("o.p").alias("p"), F.sum("o.p").alias("s"))
    best = by_group.groupBy("document_id").agg(F.max(F.struct("p", "s", "group_id")).alias("b"))
    near = by_group.join(best, "document_id").filter((F.col("p") > F.col("b.p") - c.margin) & (F.col("s") > F.col("b.s") - 2 * c.margin)).groupBy("document_id").agg(F.count("*").alias("near"))
    return best.join(near, "document_id").filter((F.col("near") == 1) & (F.col("b.p") >= c.accept)).select("document_id", F.col("b.group_id").alias("group_id"), F.round("b.p", 4).alias("confidence"))
