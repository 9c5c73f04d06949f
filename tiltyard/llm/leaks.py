"""Evaluation texts leaking into training text: a BM25 index of the test items, block-max WAND for every passage, verification.

The index is over the items, the passages of all documents are the queries. The score that a passage must reach is what the
poorest run of `run` words of an item scores, so retrieval loses no document that holds such a run; word runs are then
compared exactly.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltyard.session import spread

_WORD = re.compile(r"[A-Za-z0-9]+")
K1, B = 1.2, 0.75


def tokenize(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower case. (Lower case of other letters may be ASCII: they must part words first.)"""
    return _WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]


class Postings:
    """Items of one word in order, their impacts, and the greatest impact of each block of 32."""

    __slots__ = ("ids", "impacts", "block_last", "block_max", "top")

    def __init__(self, rows: list[tuple[int, float]], size: int = 32):
        self.ids = [i for i, _ in rows]
        self.impacts = [x for _, x in rows]
        self.block_last = [self.ids[min(k + size, len(rows)) - 1] for k in range(0, len(rows), size)]
        self.block_max = [max(self.impacts[k : k + size]) for k in range(0, len(rows), size)]
        self.top = max(self.impacts)


class ItemIndex:
    def __init__(self, items: list[tuple[int, str]], run: int):
        self.run = run
        self.keys = [k for k, _ in items]
        words = [tokenize(t or "") for _, t in items]
        n, mean = len(items), max(1.0, sum(map(len, words)) / max(1, len(items)))
        df = Counter(w for ws in words for w in set(ws))
        idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
        rows: dict[str, list[tuple[int, float]]] = {}
        #: what any passage that holds a run of the item scores at least
        self.least = [math.inf] * n
        self.runs: list[set[tuple[str, ...]]] = []
        for i, ws in enumerate(words):
            norm = K1 * (1 - B + B * len(ws) / mean)
            impact = {w: idf[w] * c * (K1 + 1) / (c + norm) for w, c in Counter(ws).items()}
            for w, x in impact.items():
                rows.setdefault(w, []).append((i, x))
            self.runs.append({tuple(ws[k : k + run]) for k in range(len(ws) - run + 1)})
            if self.runs[-1]:
                self.least[i] = min(sum(impact[w] for w in set(g)) for g in self.runs[-1]) - 1e-9
        self.postings = {w: Postings(r) for w, r in rows.items()}
        self.threshold = min(self.least, default=math.inf)

    def wand(self, query: set[str]) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of all items that score at least the threshold."""
        theta = self.threshold
        lists = [p for w in query if (p := self.postings.get(w))]
        if sum(p.top for p in lists) < theta:
            return []
        cur = [[p.ids[0], 0, p] for p in lists]
        out = []
        while cur:
            cur.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cur):
                bound += c[2].top
                if bound >= theta:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cur[pivot][0]
            while pivot + 1 < len(cur) and cur[pivot + 1][0] == doc:
                pivot += 1
            # the same bound with the maxima of the blocks that would hold the pivot
            blocks, ahead = 0.0, math.inf
            for c in cur[: pivot + 1]:
                b = bisect_left(c[2].block_last, doc)
                if b < len(c[2].block_last):
                    blocks += c[2].block_max[b]
                    ahead = min(ahead, c[2].block_last[b] + 1)
            if blocks < theta:
                goal = min(ahead, cur[pivot + 1][0] if pivot + 1 < len(cur) else math.inf)
                goal = max(goal, doc + 1) if goal != math.inf else math.inf
                moved = cur[: pivot + 1]
            elif cur[0][0] == doc:
                score = sum(c[2].impacts[c[1]] for c in cur[: pivot + 1])
                if score >= theta:
                    out.append((doc, score))
                goal, moved = doc + 1, cur[: pivot + 1]
            else:
                goal, moved = doc, [c for c in cur[: pivot + 1] if c[0] < doc]
            for c in moved:
                c[1] = bisect_left(c[2].ids, goal, c[1]) if goal != math.inf else len(c[2].ids)
                c[0] = c[2].ids[c[1]] if c[1] < len(c[2].ids) else math.inf
            cur = [c for c in cur if c[0] != math.inf]
        return out

    def _stretches(self, ws: list[str]) -> Iterator[tuple[int, int]]:
        """(first, last) of the stretches of `run` or more words that all have postings: no other passage can hold a run."""
        known, run = self.postings, self.run
        at, n = 0, len(ws)
        while at + run <= n:
            # the last word of the next possible run decides first, so that most words are never looked at
            k = at + run - 1
            while k >= at and ws[k] in known:
                k -= 1
            if k >= at:
                at = k + 1
                continue
            end = at + run
            while end < n and ws[end] in known:
                end += 1
            yield at, end
            at = end + 1

    def leaked(self, text: str, window: int = 64) -> dict[int, tuple[float, int]]:
        """item -> (best passage score, leaked runs) of the items of which the text holds `run` consecutive words.

        Passages overlap by run - 1 words, so that each run lies in one passage whole.
        """
        ws = tokenize(text)
        out: dict[int, tuple[float, int]] = {}
        step = window - self.run + 1
        for first, last in self._stretches(ws):
            for at in range(first, last - self.run + 1, step):
                part = ws[at : min(at + window, last)]
                hits = self.wand(set(part))
                if not hits:
                    continue
                grams = {tuple(part[k : k + self.run]) for k in range(len(part) - self.run + 1)}
                for i, score in hits:
                    if score >= self.least[i] and (n := len(grams & self.runs[i])):
                        best, had = out.get(i, (0.0, 0))
                        out[i] = (max(best, score), had + n)
        return {self.keys[i]: v for i, v in out.items()}


def find_leaks(docs: DataFrame, items: DataFrame, doc: str, text: str, item: str, item_text: str, run: int = 13, block: int = 20_000) -> DataFrame:
    """(item, doc, score, runs) for each item of which a document holds `run` consecutive words.

    All passages of all documents are queried. The items' index goes to the workers in blocks of at most `block` items, so what
    is sent is bounded and no item is left out. Null and short texts hold no run; repeated rows give one row.
    """
    it = items.filter(F.col(item_text).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("x")).distinct()
    n = max(1, -(-it.count() // block))
    d = spread(docs.filter(F.col(text).isNotNull()).select(F.col(doc).alias("d"), F.col(text).cast("string").alias("t")), "d")
    schema = f"i {items.schema[item].dataType.simpleString()}, d {docs.schema[doc].dataType.simpleString()}, score double, runs int"
    out = None
    for k in range(n):
        part = [(r[0], r[1]) for r in (it if n == 1 else it.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k)).collect()]

        def run_(frames: Iterator[pd.DataFrame], part: list = part) -> Iterator[pd.DataFrame]:
            index = ItemIndex(part, run)
            for f in frames:
                rows = [(i, dd, s, c) for dd, t in f.itertuples(index=False) for i, (s, c) in index.leaked(t).items()]
                yield pd.DataFrame(rows, columns=["i", "d", "score", "runs"])

        part_out = d.mapInPandas(run_, schema)
        out = part_out if out is None else out.unionByName(part_out)
    best = out.groupBy("i", "d").agg(F.max("score").alias("score"), F.max("runs").alias("runs"))
    return best.select(F.col("i").alias(item), F.col("d").alias(doc), "score", "runs")
