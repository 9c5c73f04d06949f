"""Normalising and comparing short names: shared by matching and mapping."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np

_SPLIT = re.compile(r"[^\w.'#]+|_+")
_ROMAN = re.compile(r"^i{1,4}$|^i?v$|^vi{0,3}$")


def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


def words(s: str) -> list[str]:
    """The words of a name: folded, apostrophes dropped, '&' as 'and', a dot kept where it ends a word (an abbreviation)."""
    t = fold(s).replace("’", "'").replace("'", "").replace("&", " and ")
    out = []
    for w in _SPLIT.split(t):
        w = w.strip("#")
        if w.count(".") > 1 and len(w.replace(".", "")) <= 5:
            w = w.replace(".", "")
        core = w.rstrip(".")
        if core:
            out.extend(x + ("." if w.endswith(".") and k == len(core.split(".")) - 1 else "") for k, x in enumerate(core.split(".")) if x)
    return out


def osa(a: str, b: str, most: int) -> int:
    """Edits (insertion, deletion, replacement, swap of neighbours) that turn a into b, or most + 1 where there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _subsequence(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


@lru_cache(maxsize=200_000)
def word_likeness(v: str, w: str) -> float:
    """How far a typed word stands for a word of the list: 1 equal, less for typing errors and abbreviations, 0 for another word."""
    if v == w:
        return 1.0
    dot = v.endswith(".")
    v = v.rstrip(".")
    if v == w:
        return 0.99
    if _ROMAN.match(v) or _ROMAN.match(w):
        return 0.7 if {*v.replace("t", "i").replace("l", "i")} == {*w} == {"i"} and abs(len(v) - len(w)) < 2 else 0.0
    if v.isdigit() or w.isdigit():
        return 0.0
    if dot and len(v) >= 2 and w.startswith(v):
        return 0.93
    if len(v) >= 3 and w.startswith(v) and len(v) >= 0.3 * len(w):
        return 0.9 if len(v) >= len(w) - 2 or len(v) <= 5 else 0.85
    if 2 < len(v) <= 5 and v[0] == w[0] and len(w) >= 5 and not re.search("[aeiou]", v[1:]) and _subsequence(v, w):
        return 0.85
    n = max(len(v), len(w))
    most = 0 if n <= 2 else 1 if n <= 4 else 2 if n <= 7 else 3
    d = osa(v, w, most)
    return 0.0 if d > most else 1.0 - d / (n + 1.0)


class Weights(dict):
    """Inverse document frequencies of words over the names of a list; unknown words weigh as much as the rarest, light words and
    what abbreviates them next to nothing."""

    def __init__(self, names: list[list[str]], light: frozenset[str] = frozenset()):
        df = Counter(w for n in names for w in set(n))
        self.light, top = light, math.log(1 + len(names))
        super().__init__({w: math.log(1 + len(names) / c) for w, c in df.items()})
        self.top = top
        self._short: dict[str, bool] = {}

    def __missing__(self, w: str) -> float:
        return self.top

    def of(self, w: str) -> float:
        bare = w.rstrip(".")
        if bare in self.light:
            return 0.15
        if bare in self or w in self:
            return self[w] if w in self else self[bare]
        got = self._short.get(w)
        if got is None:
            if len(self._short) > 100_000:
                self._short.clear()
            got = self._short[w] = len(bare) > 2 and any(word_likeness(w, x) >= 0.85 for x in self.light if len(x) > len(bare))
        return 0.15 if got else self.top


def likeness(value: list[str], form: list[str], weights: Weights) -> float:
    """Soft weighted cosine of two names. 1: the same name.

    Names are vectors over words with the square roots of the words' weights as components, so that a name's squared length is
    the sum of its weights. A typed word counts for the word of the list that it stands for, by its likeness to it; words are
    taken for each other one to one, best first. Where words were split or joined, the letters of both are compared as one word.
    """
    if not value or not form:
        return 0.0
    pairs = sorted(((word_likeness(v, w), -abs(i - j), i, j) for i, v in enumerate(value) for j, w in enumerate(form)), reverse=True)
    left, right, dot = set(range(len(value))), set(range(len(form))), 0.0
    total_f = sum(weights.of(w) for w in form)
    used_v = dict.fromkeys(range(len(value)), 0.0)
    for s, _, i, j in pairs:
        if s <= 0:
            break
        if i in left and j in right:
            left.discard(i)
            right.discard(j)
            dot += s * weights.of(form[j])
            used_v[i] = weights.of(form[j])
    total_v = sum(used_v[i] or weights.of(v) for i, v in enumerate(value))
    # words split or joined by mistake
    whole = 0.0
    if left or right:
        a, b = "".join(w.rstrip(".") for w in value), "".join(form)
        n = max(len(a), len(b))
        d = osa(a, b, n // 6) if n >= 5 else n
        whole = 1 - d / n - 0.03 if d <= n // 6 and (d == 0 or not _digits(value) ^ _digits(form)) else 0.0
    return max(dot / math.sqrt(total_v * total_f) if total_v and total_f else 0.0, whole)


def _digits(ws: list[str]) -> set[str]:
    return {w for w in ws if w.isdigit() or _ROMAN.match(w)}


def grams(ws: list[str], sizes: tuple[int, ...] = (2, 3)) -> Counter:
    """Character n-grams of a name, with blanks at word limits."""
    t = " " + " ".join(w.rstrip(".") for w in ws) + " "
    return Counter(t[i : i + n] for n in sizes for i in range(len(t) - n + 1))


def _bag(s: str) -> np.ndarray:
    """Counts of a text's characters in 32 classes."""
    return np.bincount(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) % 32, minlength=32).astype(np.int32)


def _apart(bags: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters of each row that bag lacks, characters of bag that each row lacks): edits are at least the greater one."""
    d = bags - bag
    more = np.maximum(d, 0).sum(axis=1)
    return more, more - d.sum(axis=1)


class Bounds:
    """What likeness(value, form, weights) can be at most, for all forms of a list at once.

    Words that are alike are found by the counts of their characters, which no edit changes by more than one each way, and then
    compared exactly. A form word is worth at most its likeness to the nearest word of the value, and words of the value that
    are like none of the form count against it. So a form below a threshold by its bound is below it by its likeness.
    """

    def __init__(self, forms: list[list[str]], weights: Weights):
        self.weights, self.size = weights, len(forms)
        self.ids: dict[str, int] = {}
        holders: list[list[int]] = []
        for i, f in enumerate(forms):
            for w in f:
                k = self.ids.setdefault(w, len(self.ids))
                if k == len(holders):
                    holders.append([])
                holders[k].append(i)
        self.vocab = list(self.ids)
        self.holders = [np.array(h, np.int64) for h in holders]
        self.weight = np.array([weights.of(w) for w in self.vocab])
        self.bags = np.array([_bag(w) for w in self.vocab], np.int32).reshape(-1, 32)
        self.lengths = np.array([len(w) for w in self.vocab], np.int64)
        self.roman = np.array([bool(_ROMAN.match(w)) for w in self.vocab], bool)
        self.total = np.array([max(1e-9, sum(weights.of(w) for w in f)) for f in forms])
        whole = ["".join(f) for f in forms]
        self.whole = np.array([_bag(x) for x in whole], np.int32).reshape(-1, 32)
        self.whole_n = np.array([len(x) for x in whole], np.int64)
        self._alike: dict[str, tuple[list[tuple[int, float]], np.ndarray]] = {}

    def alike(self, v: str) -> tuple[list[tuple[int, float]], np.ndarray]:
        """((word of the list, likeness) of all words that v can stand for, the forms that hold any of them)."""
        got = self._alike.get(v)
        if got is None:
            if len(self._alike) > 20_000:
                self._alike.clear()
            bare = v.rstrip(".")
            more, less = _apart(self.bags, _bag(bare))
            n = np.maximum(self.lengths, len(bare))
            most = np.select([n <= 2, n <= 4, n <= 7], [0, 1, 2], 3)
            # edits; beginnings and abbreviations, whose letters all stand in the word; numerals
            near = (np.maximum(more, less) <= most) | ((less == 0) & (len(bare) > 1)) | self.roman
            if _ROMAN.match(bare):
                near[:] = True
            if v in self.ids:
                near[self.ids[v]] = True
            pairs = [(int(k), s) for k in np.flatnonzero(near) if (s := word_likeness(v, self.vocab[k])) > 0]
            held = np.unique(np.concatenate([self.holders[k] for k, _ in pairs])) if pairs else np.zeros(0, np.int64)
            got = self._alike[v] = (pairs, held)
        return got

    def upper(self, value: list[str]) -> np.ndarray:
        """The bound of each form."""
        out = np.zeros(self.size)
        if not value or not self.size:
            return out
        best: dict[int, float] = {}
        count = Counter(value)
        alone = np.full(self.size, sum(n * self.weights.of(v) for v, n in count.items()))
        for v, n in count.items():
            pairs, held = self.alike(v)
            alone[held] -= n * self.weights.of(v)
            for k, s in pairs:
                if s > best.get(k, 0.0):
                    best[k] = s
        if best:
            at = np.concatenate([self.holders[k] for k in best])
            got = np.bincount(at, np.repeat([s * self.weight[k] for k, s in best.items()], [len(self.holders[k]) for k in best]), self.size)
            out = np.divide(got, np.sqrt((got + np.maximum(alone, 0.0)) * self.total), out=np.zeros(self.size), where=got > 0)
        a = "".join(w.rstrip(".") for w in value)
        n = np.maximum(self.whole_n, len(a))
        ids = np.flatnonzero((n >= 5) & (np.abs(self.whole_n - len(a)) <= n // 6))
        if len(ids):
            d = np.maximum(*_apart(self.whole[ids], _bag(a)))
            out[ids] = np.maximum(out[ids], np.where(d <= n[ids] // 6, 0.97 - d / n[ids], 0.0))
        return out + 1e-9
