"""Noise in text from scanned pages: page numbers, running headers, hyphens at line ends, misrecognised characters.

The corpus gives the model: word counts, corrections (rare forms that differ from a frequent word only by confusable
characters) and running lines (line patterns that most lines with their beginning follow and that name the title of their
document). Each chunk is decoded as one stream of tokens without its lines: the best path through a lattice whose edges keep,
correct, split or merge words, join what a hyphen parted over a line end, or skip a whole running line or page number.
Paragraph boundaries are placed by dynamic programming.
"""

from __future__ import annotations

import atexit
import math
import re
import shutil
import sqlite3
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltyard.session import cut, distinct_by, spread

#: Characters that recognition confuses, each group with one representative.
SEVERAL = (("rn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("li", "h"))
SINGLE = str.maketrans({"0": "o", "1": "l", "|": "l", "!": "l", "i": "l", "@": "a", "5": "s", "$": "s", "c": "e", "b": "h", "f": "t", "q": "g", "v": "y", "€": "e", "ß": "b", "8": "b"})
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
HYPHENS = "-¬­‐‑"

_CORE = re.compile(r"^([(\[{\"'“„«‘]*)(.*?)([)\]}\"'”»’.,;:!?…]*)$", re.S)
_ODD = re.compile(r"[^\W\d_][01@|$€][^\W\d_]|[ﬀﬁﬂﬃﬄ]")
_DIGIT_RUN = re.compile(r"\d+")
_LETTERS = re.compile(r"[^\W\d_]")
_PAGE = re.compile(r"^[\s\-–—.\[(|]*(?:page|pg\.?|p\.|seite|s\.|pag\.?)?\s*(\d{1,5}|[ivxlc]{1,6})\s*(?:(?:of|/|von|de|sur)\s*\d{1,5})?[\s\-–—\])|]*$", re.I)
_PAGE_NAMED = re.compile(r"^\s*(\d{1,5})\s*[|·•]\s*[^\W\d][\w ]{1,30}$|^\s*[^\W\d][\w ]{1,30}\s*[|·•]\s*(\d{1,5})\s*$")
_RIGHTS = re.compile(r"^(?:\(c\)|©|copyright\b)", re.I)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def _roman(s: str) -> int:
    v = [_ROMAN[c] for c in s.lower()]
    return sum(-a if a < b else a for a, b in zip(v, v[1:] + [0]))


def skeletons(w: str) -> set[str]:
    """Forms of a word in which confusable characters are equal: character by character, and with pairs drawn together."""
    s = w.translate(SINGLE)
    m = w
    for a, b in SEVERAL:
        m = m.replace(a, b)
    return {s, m.translate(SINGLE)}


def unligature(w: str) -> str:
    for a, b in LIGATURES.items():
        w = w.replace(a, b)
    return w


def core(token: str) -> tuple[str, str, str]:
    """(opening marks, word, closing marks) of a token."""
    m = _CORE.match(token)
    return (m[1], m[2], m[3]) if m else ("", token, "")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(w, n, noisy): lower-case words of all texts, whole compounds and their parts; fragments at line ends are left out.

    noisy: how many of them stand in texts that hold a foreign character inside a word. Each batch counts first, so the
    shuffle carries distinct words.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}

        def words_of(tok: str) -> list[str]:
            if len(known) > 1_000_000:
                known.clear()
            w = core(tok)[1].lower()
            ok = w and _LETTERS.search(w)
            known[tok] = out = ([w, *(p for p in w.split("-") if p)] if "-" in w else [w]) if ok else []
            return out

        for f in frames:
            n, noisy = Counter(), Counter()
            for t in f["t"]:
                skip = False
                here: list[str] = []
                for line in (t or "").split("\n"):
                    ws = line.split()
                    if not ws:
                        continue
                    broken = ws[-1][-1] in HYPHENS
                    for tok in ws[skip : len(ws) - broken]:
                        here += known[tok] if tok in known else words_of(tok)
                    skip = broken
                n.update(here)
                if _ODD.search(t or ""):
                    noisy.update(here)
            yield pd.DataFrame({"w": list(n), "n": list(n.values()), "noisy": [noisy[w] for w in n]})

    counts = df.select(F.col(text).cast("string").alias("t")).mapInPandas(run, "w string, n long, noisy long")
    return counts.groupBy("w").agg(F.sum("n").alias("n"), F.sum("noisy").alias("noisy"))


def corrections(words: DataFrame, ratio: float = 0.1, least: int = 5) -> DataFrame:
    """(bad, good): forms that a frequent word with the same skeleton explains.

    Joined on skeletons, so no pair of unlike words meets. A form with a foreign character inside letters needs a good word
    seen twice; one of letters alone must be at most `ratio` as frequent as a word seen `least` times and, where it is seen often
    enough to tell, keep company with foreign characters, which real words don't.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for w, n, c in zip(f["w"], f["n"], f["noisy"]):
                u = unligature(w)
                odd = u != w or any(not c.isalpha() for c in w if c not in "-'’")
                rows += [(w, n, c, odd, k) for k in skeletons(u)]
            yield pd.DataFrame(rows, columns=["w", "n", "noisy", "odd", "k"])

    k = words.filter(F.length("w") >= 3).mapInPandas(run, "w string, n long, noisy long, odd boolean, k string")
    top = k.filter(~F.col("odd")).groupBy("k").agg(F.max(F.struct("n", "w")).alias("g"))
    j = k.join(top, "k").filter(F.col("g.w") != F.col("w"))
    ok = (F.col("odd") & (F.col("g.n") >= 2)) | (
        ~F.col("odd") & (F.col("g.n") >= least) & (F.col("n") <= ratio * F.col("g.n")) & ((F.col("n") < 8) | (F.col("noisy") >= 0.45 * F.col("n")))
    )
    return j.filter(ok).groupBy(F.col("w").alias("bad")).agg(F.max("g").alias("g")).select("bad", F.col("g.w").alias("good"))


def line_pattern(line: str, title: str | None, maker: str | None, fix: dict[str, str] | _Part | None = None) -> str:
    """A line with its document's title, its maker and digits masked. maker is a key: the first letters of the printed name."""
    s = " ".join(line.split()).lower()
    if fix is not None:
        s = " ".join(a + fix.get(w, w) + b for a, w, b in map(core, s.split(" ")))
    if title and title.strip():
        s = s.replace(" ".join(title.split()).lower(), "<t>")
    if maker:
        ws = s.split(" ")
        for i in range(len(ws)):
            joined = ""
            for j in range(i, min(i + 3, len(ws))):
                joined += re.sub(r"\W", "", ws[j])
                if joined == maker.lower():
                    end = j + 1
                    ws = [*ws[:i], "<m>", *ws[end:]]
                    break
            else:
                continue
            break
        s = " ".join(ws)
    return re.sub(r"\d+", "#", s)


_CLOSED = tuple(".,;:!?")  # what running lines don't end with


def running_lines(df: DataFrame, text: str, doc: str, title: str, maker: str, least: int = 3, purity: float = 0.5) -> DataFrame:
    """(pattern, docs) of running lines: lines that name the title of their document, begin with no small letter, are seen in
    several documents, and end where most lines that begin like them end, which wrapped prose doesn't.

    A line's beginning is its first two words, with the title as one word, or its first three.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n: Counter = Counter()
            heads: Counter = Counter()
            for t, d, ti, mk in f.itertuples(index=False):
                here, first = set(), set()
                name, key = " ".join((ti or "").split()).lower(), (mk or "").lower()
                for x in (t or "").split("\n"):
                    x = x.strip()
                    if len(x) <= 3:
                        continue
                    low = x.lower()
                    if name and name in low or key and key[:4] in low:
                        p = line_pattern(x, ti, mk)
                        if "<t>" in p and p != "<t>" and not x[0].islower() and not p.endswith(_CLOSED):
                            here.add(p)
                        first.update(_heads(p))
                    else:
                        first.update(_heads(_DIGIT_RUN.sub("#", " ".join(low.split(None, 3)[:3]))))
                n.update((p, d) for p in here)
                heads.update(first)
            rows = [(p, None, d, c) for (p, d), c in n.items()] + [(None, h, None, c) for h, c in heads.items()]
            yield pd.DataFrame(rows, columns=["pattern", "head", "doc", "n"])

    lines = df.select(F.col(text).cast("string").alias("t"), F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("d"), F.col(title).alias("ti"), F.col(maker).alias("mk"))
    p = cut(lines.mapInPandas(run, "pattern string, head string, doc string, n long"), "lines")
    docs = p.filter("pattern is not null").groupBy("pattern", "doc").agg(F.sum("n").alias("n")).groupBy("pattern").agg(F.count("*").alias("docs"), F.sum("n").alias("chunks")).filter(F.col("docs") >= least)
    heads = p.filter("pattern is null").groupBy("head").agg(F.sum("n").alias("all"))
    ws = F.split("pattern", " ")
    begun = docs.withColumn("head", F.explode(F.array(*(F.concat(F.lit(f"{k} "), F.array_join(F.slice(ws, 1, k), " ")) for k in (2, 3)))))
    return begun.join(heads, "head").filter(F.col("chunks") >= purity * F.col("all")).groupBy("pattern").agg(F.max("docs").alias("docs"))


def _heads(line: str) -> tuple[str, ...]:
    """The beginnings of a line of two and of three words."""
    ws = line.split(" ", 3)
    return tuple(f"{k} " + " ".join(ws[:k]) for k in (2, 3))


def _shapes(patterns: Iterable[str]) -> re.Pattern:
    """Lines of any of the patterns, with any name for title and maker."""
    any_name = lambda p: re.escape(p).replace("<t>", r"[^.!?]{2,60}").replace("<m>", r"\S+(?: \S+)?").replace(r"\#", "#")
    return re.compile("|".join(f"(?:{any_name(p)})" for p in patterns))


def _ends(s: str) -> tuple[str, str]:
    """First and last word of a pattern, '' where a name stands there: a line of this pattern has the same."""
    ws = s.split(" ")
    return tuple("" if "<t>" in w or "<m>" in w else w for w in (ws[0], ws[-1]))


class Store:
    """The model as an indexed file that Spark copies to every node: words are looked up on disk, so it is whole whatever its
    size, and workers keep no more than `kept` words and patterns in memory."""

    def __init__(self, name: str, kept: int = 300_000):
        self.name, self.kept = name, kept
        self._open()

    def _open(self) -> None:
        self.db: sqlite3.Connection | None = None
        self.seen: dict[str, tuple[int | None, str | None]] = {}
        self.lines: dict[str, bool] = {}
        self.ends: dict[tuple[str, str], re.Pattern | None] = {}

    def __getstate__(self) -> dict:
        return {"name": self.name, "kept": self.kept}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    @classmethod
    def write(cls, words: DataFrame, patterns: DataFrame) -> Store:
        """words: (w, n, good); patterns: (pattern). Rows pass through the driver one partition at a time."""
        folder, name = tempfile.mkdtemp(prefix="tiltyard-model-"), f"scanned-{uuid.uuid4().hex[:12]}.db"
        atexit.register(shutil.rmtree, folder, True)
        db = sqlite3.connect(f"{folder}/{name}")
        db.execute("create table words (w text primary key, n integer, good text) without rowid")
        db.execute("create table lines (p text primary key, first text, last text) without rowid")
        db.executemany("insert into words values (?, ?, ?)", ((r["w"], r["n"], r["good"]) for r in words.select("w", "n", "good").toLocalIterator()))
        db.executemany("insert into lines values (?, ?, ?)", ((r["pattern"], *_ends(r["pattern"])) for r in patterns.toLocalIterator()))
        db.execute("create index ends on lines (first, last)")
        db.commit()
        db.close()
        words.sparkSession.sparkContext.addFile(f"{folder}/{name}")
        return cls(name)

    def _ask(self, sql: str, *by: str) -> sqlite3.Cursor:
        if self.db is None:
            self.db = sqlite3.connect(f"file:{SparkFiles.get(self.name)}?mode=ro&immutable=1", uri=True)
        return self.db.execute(sql, by)

    def total(self) -> int:
        return self._ask("select coalesce(sum(n), 0) from words").fetchone()[0]

    def word(self, w: str) -> tuple[int | None, str | None]:
        """(count, correction) of a word."""
        got = self.seen.get(w)
        if got is None:
            if len(self.seen) >= self.kept:
                self.seen.clear()
            got = self.seen[w] = self._ask("select n, good from words where w = ?", w).fetchone() or (None, None)
        return got

    def __contains__(self, pattern: str) -> bool:
        got = self.lines.get(pattern)
        if got is None:
            if len(self.lines) >= self.kept:
                self.lines.clear()
            got = self.lines[pattern] = self._ask("select 1 from lines where p = ?", pattern).fetchone() is not None
        return got

    def fits(self, line: str, most: int = 500) -> bool:
        """A pattern fits the line with any name: only those with its first and last word, or a name there, are tried."""
        ws = line.split(" ")
        for ends in {(a, b) for a in (ws[0], "") for b in (ws[-1], "")}:
            if ends in self.ends:
                shape = self.ends[ends]
                if shape and shape.fullmatch(line):
                    return True
                continue
            rows = self._ask("select p from lines where first = ? and last = ? order by p", *ends)
            block = [r[0] for r in rows.fetchmany(most)]
            if len(block) < most:
                if len(self.ends) >= 2_000:
                    self.ends.clear()
                self.ends[ends] = _shapes(block) if block else None
            # patterns with names at both ends may be a great many: those are read anew, block by block
            while block:
                if _shapes(block).fullmatch(line):
                    return True
                block = [r[0] for r in rows.fetchmany(most)]
        return False


@dataclass(frozen=True)
class _Part:
    """One column of the words of a store, read like a dict."""

    store: Store
    at: int

    def get(self, w: str, default=None):  # noqa: ANN001, ANN201
        got = self.store.word(w)[self.at]
        return default if got is None else got

    def __contains__(self, w: str) -> bool:
        return self.store.word(w)[self.at] is not None


@dataclass
class Model:
    counts: dict[str, int] | _Part
    fix: dict[str, str] | _Part
    running: frozenset[str] | Store
    plain: dict[str, bool] = field(default_factory=dict)
    fixed: dict[str, bool] = field(default_factory=dict)
    total: int = 0

    def fits(self, line: str) -> bool:
        """The line is of a running pattern with any name."""
        if isinstance(self.running, Store):
            return self.running.fits(line)
        return bool(self.running) and _shapes(sorted(self.running)).fullmatch(line) is not None

    def is_running(self, line: str, title: str | None, maker: str | None) -> bool:
        """The line is a running one of the corpus: with the chunk's own title and maker, or, where it has none, with any name."""
        if _RIGHTS.match(line):
            return True
        # patterns begin and end otherwise
        if line.endswith(_CLOSED) or line[:1].islower():
            return False
        name = " ".join((title or "").split()).lower()
        low = " ".join(line.split()).lower()
        repairable = any(map(self.is_fixed, low.split(" ")))
        # all patterns hold the title: without it, and without a word to correct, a line is none
        if name and name in low and line_pattern(line, title, maker) in self.running:
            return True
        if name and repairable and line_pattern(line, title, maker, self.fix) in self.running:
            return True
        if title and maker or not line[:1].isupper():
            return False
        return self.fits(line_pattern(line, title, maker, self.fix))

    def skip_cost(self, line: str, before: str, title: str | None, maker: str | None, start: int | None, end: int | None) -> tuple[float, str] | None:
        """(cost, noise) of skipping a line, if it may be skipped: less than reading any word costs."""
        if is_page_number(line, before, start, end):
            return 1.0, "page_number"
        if len(line) > 3 and self.is_running(line, title, maker):
            return 1.0, "header"
        return None

    def is_fixed(self, token: str) -> bool:
        """A token that has a correction."""
        got = self.fixed.get(token)
        if got is None:
            if len(self.fixed) > 500_000:
                self.fixed.clear()
            got = self.fixed[token] = core(token)[1] in self.fix
        return got

    def is_plain(self, token: str) -> bool:
        """A token that decoding would keep as it is: a word of the corpus, or no word at all."""
        got = self.plain.get(token)
        if got is None:
            if len(self.plain) > 500_000:
                self.plain.clear()
            w = core(token)[1].lower()
            got = self.plain[token] = not _LETTERS.search(w) or self.counts.get(w, 0) > 0 and w not in self.fix and "-" not in w
        return got

    def cost(self, w: str) -> float:
        n = self.counts.get(w, 0)
        return math.log(self.total / n) if n else 14.0 + len(w)


def is_page_number(line: str, before: str, start: int | None, end: int | None) -> bool:
    """The line gives the number of the page: a number of the chunk's pages, bare or framed. A value under its label is none."""
    s = line.strip()
    m = _PAGE.match(s)
    named = None if m else _PAGE_NAMED.match(s)
    if not m and not named:
        return False
    v = m[1] if m else named[1] or named[2]
    n = int(v) if v.isdigit() else _roman(v) if v.islower() else 0
    framed = bool(named) or not (s.isdigit() or s.isalpha())
    if start is None and end is None:
        return framed and n > 0
    lo, hi = (start if start is not None else end), (end if end is not None else start)
    if not lo <= n <= hi:
        return False
    return framed or not re.match(r"^[^\W\d][\w ]{0,24}\s\d+$", before.strip())


def _own_hyphen(a: str, b: str, mark: str, m: Model) -> bool:
    """Whether a compound was broken at its own hyphen, rather than a word split by a mark."""
    if mark not in "-‑":
        return False
    la, lb = core(a)[1].lower(), core(b)[1].lower()
    fa, fb = m.fix.get(la, la), m.fix.get(lb, lb)
    joined = max(m.counts.get(x, 0) for x in (la + lb, fa + fb, m.fix.get(la + lb, la + lb)))
    compound = max(m.counts.get(f"{x}-{y}", 0) for x in (la, fa) for y in (lb, fb))
    # a part of a longer compound: end-of-stroke broken after end-of-
    if joined or compound:
        return compound >= joined
    tail = la.split("-")[-1]
    whole = m.counts.get(tail + lb.split("-")[0], 0)
    if whole:
        return False
    return ("-" in la or "-" in lb or m.counts.get(fa, 0) > 2) and m.counts.get(fb.split("-")[0], 0) > 2


def _edges(tok: str, follow: str | None, m: Model) -> list[tuple[int, float, list[str], tuple[str, ...]]]:
    """(tokens read, cost, words, noise) of the ways to read a token: kept, corrected, split in two, or merged with the next."""
    a, w, z = core(tok)
    l = w.lower()  # noqa: E741
    out = [(1, m.cost(l), [tok], ())]
    parts = [m.fix.get(p, p) for p in l.split("-")] if "-" in l else None
    good = m.fix.get(l) or ("-".join(parts) if parts and "-".join(parts) != l else None)
    if good:
        out.append((1, min(m.cost(good), 12.0) + 1.0, [a + _recase(w, good) + z], ("chars",)))
    if not m.counts.get(l) and len(l) > 5 and not z and l.isalpha():
        for k in range(2, len(l) - 1):
            if m.counts.get(l[:k], 0) > 3 and m.counts.get(l[k:], 0) > 3:
                out.append((1, m.cost(l[:k]) + m.cost(l[k:]) + 6.0, [a + w[:k], w[k:]], ()))
    if follow is not None and not z:
        a2, w2, z2 = core(follow)
        j = (w + w2).lower()
        if not a2 and m.counts.get(j, 0) > 3 and not (m.counts.get(l, 0) > 3 and m.counts.get(w2.lower(), 0) > 3):
            out.append((2, m.cost(j) + 4.0, [a + w + w2 + z2], ()))
    return out


class Stream:
    """The tokens of a chunk in one row, with the line of each, and the lines that may be skipped."""

    def __init__(self, lines: list[str], skips: dict[int, tuple[float, str]]):
        self.tokens: list[str] = []
        self.line: list[int] = []
        self.ends: dict[int, int] = {}  # first token of a line -> token after it
        self.skip: dict[int, tuple[int, float, str]] = {}  # first token of a line -> (token after it, cost, noise)
        for i, x in enumerate(lines):
            ts = x.split()
            if ts:
                self.ends[len(self.tokens)] = len(self.tokens) + len(ts)
            if i in skips and ts:
                self.skip[len(self.tokens)] = (len(self.tokens) + len(ts), *skips[i])
            self.tokens += ts
            self.line += [i] * len(ts)

    def hyphen(self, i: int, m: Model) -> tuple[int, str, tuple[str, ...], float] | None:
        """(next position, word, noise, cost of skipped lines): the word that token i, which ends a line in a hyphen, begins.

        Lines that may be skipped stand between the parts at times; the rest may itself end its line in a hyphen.
        """
        ts, tok, at, noise, cost = self.tokens, self.tokens[i], i + 1, set(), 0.0
        while at < len(ts) and self.line[at] != self.line[at - 1] and len(tok) > 1 and tok[-1] in HYPHENS and tok[-2].isalnum():
            to = at
            while to in self.skip:
                noise.add(self.skip[to][2])
                cost += self.skip[to][1]
                to = self.skip[to][0]
            if to >= len(ts) or not ts[to][:1].isalnum():
                break
            if _own_hyphen(tok[:-1], ts[to], tok[-1], m):
                tok = tok[:-1] + "-" + ts[to]
            else:
                tok = tok[:-1] + ts[to]
                noise.add("hyphen")
            at = to + 1
        return None if at == i + 1 else (at, tok, tuple(sorted(noise)), cost)


def best_path(s: Stream, m: Model) -> tuple[list[tuple[int, str]], set[str]]:
    """((line, word), noise) of the best path through the lattice over the whole stream.

    A plain token has one edge, and where no edge passes over it all paths meet: there the path is settled, so that a chunk
    without noise costs one look at each token.
    """
    out: list[tuple[int, str]] = []
    found: set[str] = set()
    n, i, ts = len(s.tokens), 0, s.tokens
    joined: dict[int, tuple[int, str, tuple[str, ...], float] | None] = {}

    def broken(k: int) -> bool:
        if ts[k][-1] not in HYPHENS or k + 1 >= n or s.line[k] == s.line[k + 1]:
            return False
        if k not in joined:
            joined[k] = s.hyphen(k, m)
        return joined[k] is not None

    known, skip, ends = m.plain.get, s.skip, s.ends
    while i < n:
        if i not in skip:
            to = ends.get(i)
            if to and ts[to - 1][-1] not in HYPHENS and all(map(known, ts[i:to])):
                # a line of plain tokens
                line = s.line[i]
                out += [(line, t) for t in ts[i:to]]
                i = to
                continue
            if m.is_plain(ts[i]) and not broken(i):
                out.append((s.line[i], ts[i]))
                i += 1
                continue
        best: dict[int, tuple[float, int, list[tuple[int, str]], tuple[str, ...]]] = {i: (0.0, i, [], ())}
        k = far = i
        while k < n and (k <= far and not (k == far and k > i and k not in s.skip and m.is_plain(ts[k]) and not broken(k))):
            if k not in best:
                k += 1
                continue
            c0 = best[k][0]
            ways: list[tuple[int, float, list[str], tuple[str, ...]]] = []
            if k in s.skip:
                to, cost, noise = s.skip[k]
                ways.append((to, cost, [], (noise,)))
            if broken(k):
                to, word, noise, cost = joined[k]
                # what was joined is read like a token of its own
                ways += [(to, cost + c, ws, (*noise, *x)) for _, c, ws, x in _edges(word, None, m)]
            else:
                # words are merged over a line end too, where it dropped the hyphen
                ways += [(k + step, c, ws, x) for step, c, ws, x in _edges(ts[k], ts[k + 1] if k + 1 < n else None, m)]
            for to, cost, ws, noise in ways:
                far = max(far, to)
                if to not in best or c0 + cost < best[to][0]:
                    best[to] = (c0 + cost, k, [(s.line[k], w) for w in ws], noise)
            k += 1
        k = far
        steps = []
        while k > i:
            steps.append(best[k])
            k = best[k][1]
        for _, _, ws, noise in reversed(steps):
            out += ws
            found.update(noise)
        i = far
    return out, found


def decode(tokens: list[str], m: Model) -> tuple[list[str], bool]:
    """(words, corrected?) of the best path over tokens of one line."""
    words, noise = best_path(Stream([" ".join(tokens)], {}), m)
    return [w for _, w in words], "chars" in noise


def _recase(old: str, new: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() or old[:1] in "01" and new != new.lower() else new


def _paragraphs(lines: list[str]) -> list[list[str]]:
    """Groups lines to paragraphs: the cheapest choice of boundaries, each boundary and each joint priced by what stands around it."""
    width = max((len(x) for x in lines), default=0)
    # state: whether a boundary stands before line i; costs are local, so the best choice is kept per state
    cost = [0.0, math.inf]
    back: list[list[int]] = []
    for i in range(1, len(lines)):
        a, b = lines[i - 1], lines[i]
        if not a or not b:
            split, join = (0.0, 3.0) if not a else (1.0, 0.0)
        else:
            ends, low = a[-1] in ".!?:", b[:1].islower()
            short = len(a) < 0.6 * width
            split = (0.0 if ends and short else 2.0 if ends or short and not low else 5.0) + (3.0 if low else 0.0)
            join = (3.0 if short and ends else 2.0 if short and not low else 0.3) + (0.0 if low else 0.5)
        new, prev = [], []
        for price in (join, split):
            k = 0 if cost[0] <= cost[1] else 1
            new.append(cost[k] + price)
            prev.append(k)
        back.append(prev)
        cost = new
    state = 0 if cost[0] <= cost[1] else 1
    marks = [False] * len(lines)
    for i in range(len(lines) - 1, 0, -1):
        marks[i] = state == 1
        state = back[i - 1][state]
    out: list[list[str]] = []
    for i, x in enumerate(lines):
        if i == 0 or marks[i]:
            out.append([])
        if x:
            out[-1].append(x)
    return [p for p in out if p]


def repair(content: str | None, title: str | None, maker: str | None, start: int | None, end: int | None, m: Model) -> tuple[list[str], str]:
    """(kinds of noise found, repaired text) of one chunk. Null and blank texts hold no noise."""
    lines = [x.strip() for x in (content or "").split("\n")]
    skips: dict[int, tuple[float, str]] = {}
    before = ""
    for i, x in enumerate(lines):
        if x:
            cost = m.skip_cost(x, before, title, maker, start, end)
            if cost is not None:
                skips[i] = cost
            else:
                before = x
    words, found = best_path(Stream(lines, skips), m)
    by: dict[int, list[str]] = {}
    for i, w in words:
        by.setdefault(i, []).append(w)
    # lines that were skipped or drawn to the one before are gone; blank ones part paragraphs, but not within a word
    kept = [" ".join(by[i]) if i in by else "" for i, x in enumerate(lines) if i in by or not x]
    return sorted(found), "\n\n".join(" ".join(p) for p in _paragraphs(kept))


def fit(chunks: DataFrame) -> Model:
    """The model from all chunks: every word seen twice, every correction and every running pattern, as a file (see Store)."""
    c = spread(chunks.select("chunk_id", "document_id", "machine_title", "manufacturer", "content"), "chunk_id")
    words = cut(word_counts(c, "content"), "words")
    fix = corrections(words).select(F.col("bad").alias("w"), "good")
    # a form that is corrected counts as no word
    known = words.filter("n > 1").select("w", "n").join(fix, "w", "full").select("w", F.when(F.col("good").isNull(), F.col("n")).alias("n"), "good")
    store = Store.write(known, running_lines(c, "content", "document_id", "machine_title", "manufacturer").select("pattern"))
    return Model(_Part(store, 0), _Part(store, 1), store, total=max(1, store.total()))


def repaired(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """(chunk_id, noise array<string>, text) per chunk. Rows stored twice give one row; extra columns are not read."""
    m = model or fit(chunks)
    cols = ["chunk_id", "content", "machine_title", "manufacturer", "page_start", "page_end"]
    one = distinct_by(chunks.select(*cols), "chunk_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        num = lambda x: None if x is None or x != x else int(x)
        for f in frames:
            got = [repair(c, t, k, num(a), num(b), m) for _, c, t, k, a, b in f.itertuples(index=False)]
            yield pd.DataFrame({"chunk_id": f["chunk_id"], "noise": [g[0] for g in got], "text": [g[1] for g in got]})

    id_type = chunks.schema["chunk_id"].dataType.simpleString()
    return one.mapInPandas(run, f"chunk_id {id_type}, noise array<string>, text string")
