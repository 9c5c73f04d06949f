"""Does a text end, or does it break off? Statistics of what follows the last words elsewhere in the corpus.

For each run of two to four tokens (digits masked) the whole corpus gives how often it occurs, how often a full stop follows,
and how often a line or the text ends after it without one. A text that stops after words which elsewhere always go on was
cut; one that stops after words which elsewhere end lines (sign-offs, list items, links) was not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"https?://[^\s)>\]]+|\.{2,}|[\w#]+(?:[-'’/.,][\w#]+)*|\n|[^\w\s]")
_WRAP = re.compile(r"(?<=\S)\n(?!https?:)(?=[a-zß-ÿ])")
_LINK = re.compile(r"https?://[^\s)>\]]+")
_CITATION = re.compile(r"(?:\s*(?:\[[^\[\]]{1,60}\]|\([^()]{1,60}\)))+$")
_DIGITS = re.compile(r"\d+")
TERMINALS = frozenset(".!?。！？")
#: What a reader is shown in place of the rest of a text.
MARKERS = re.compile(r"\s*(?:\[\s*more\s*\]|\(\s*more\s*\)|\bread more|\bcontinue reading|\bshow more|\(…\)|\[…\]|\(\.\.\.\)|\[\.\.\.\]|\[truncated\]|>>|»)\s*$", re.I)
DOTS = re.compile(r"\s*(?:\.\.\.+|…|&hellip;)\s*$")
CLOSERS = "\"'”’»)]}*_`"

# Multipliers of the rolling hash: odd 64-bit constants.
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_SLICE = 1_000_000  # tokens counted at a time, so that long texts don't fill a worker's memory
_LEAST_BITS, _MOST_BITS = 22, 27  # size of the candidate filter: 512 KB to 16 MB, about 16 bits for each text that asks


def tokens(text: str) -> list[str]:
    """Words, links, punctuation marks (dots in a row are one, and no full stop) and line ends; digits masked; a line end before a small letter is a wrapped line."""
    t = _WRAP.sub(" ", text)
    if "://" in t:
        t = _LINK.sub(_link_shape, t)
    return _TOKEN.findall(_DIGITS.sub("#", t))


def _link_shape(m: re.Match) -> str:
    """A link with each segment that holds a digit or capital replaced by its length."""
    return "/".join(f"#{len(p)}".replace("#", "0") if i > 2 and any(c.isdigit() or c.isupper() for c in p) else p for i, p in enumerate(m[0].split("/")))


class _Hashes(dict):
    def __missing__(self, t: str) -> int:
        h = self[t] = xxhash.xxh64_intdigest(t)
        return h


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros_like(parts[0])
    for m, p in zip(_M, parts):
        out = (out ^ (p * m)) * _M[1]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


_MASK = (1 << 64) - 1
_MULTS = tuple(int(m) for m in _M)


def _mix_one(*parts: int) -> int:
    """_mix of single keys."""
    out = 0
    for m, p in zip(_MULTS, parts):
        out = ((out ^ (p * m & _MASK)) * _MULTS[1]) & _MASK
        out ^= out >> 29
    return out - (1 << 64) if out >> 63 else out


def last_tokens(text: str, least: int = 2000) -> list[str]:
    """The tokens of the last unit of a text, however long it is, with at least five tokens and what stands before it.

    The tail that is looked at begins at a blank and grows until it holds the start of the unit, so its tokens are those of the text.
    """
    n = least
    while n < len(text):
        m = re.search(r"\s", text[-n:])
        t = tokens(text[-n:][m.start() :]) if m else []
        if len(t) > 6 and any(x == "\n" or x in TERMINALS for x in t[1:-1]):
            return t
        n *= 4
    return tokens(text)


def keys_of_end(text: str, hashes: _Hashes) -> list[int]:
    """Keys of the last two tokens, the last three, the last five, and the first two of the last unit: what stands after the last line end or full stop."""
    t = last_tokens(text)
    cut = next((i for i in range(len(t) - 1, -1, -1) if t[i] == "\n" or t[i] in TERMINALS and i < len(t) - 1), -1)
    last = t[cut + 1 :]
    h = [hashes[x] for x in (["\n"] * 4 + t)[-5:]]
    head = [hashes[x] for x in [*last, "\n", "\n"][:2]]
    k5 = _mix_one(_mix_one(h[0], h[1], h[2]) & _MASK, h[3], h[4])
    return [_mix_one(h[3], h[4]), _mix_one(h[2], h[3], h[4]), k5, _mix_one(head[0], head[1], 1, 2)]


def candidate_bits(ends: DataFrame, keys: str) -> bytes:
    """A filter of the keys that will be asked for, sized by the number of texts that ask; at most 16 MB on the driver, beyond
    which more runs pass it than are asked for, and the join drops them."""
    n = max(1, ends.count()).bit_length() + 4
    bits = max(_LEAST_BITS, min(_MOST_BITS, n))
    k = ends.select(F.explode(keys).alias("k")).select(F.expr(f"cast((k & {(1 << bits) - 1}) div 32768 as int)").alias("part"), F.expr("cast((k & 32767) as bigint)").alias("bit"))
    rows = k.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = bytearray((1 << bits) // 8)
    for r in rows:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    return bytes(out)


def follow_counts(df: DataFrame, text: str, wanted: bytes) -> DataFrame:
    """(k, n, term, line) per run of tokens inside the texts: occurrences, followed by a full stop, at the end of a line.

    For the first two tokens of a unit (what stands between line ends and full stops): units, those that a full stop ends, those
    that a line end ends. The last line end of
    a text is left out: with_rates counts it, once for all copies of a text. Only runs that pass the filter are counted; each
    batch counts its own, so the shuffle carries one row per wanted run and batch. Null texts count nothing.
    """

    def count(col: list[int], hashes: _Hashes) -> pa.RecordBatch:
        bits = np.frombuffer(wanted, np.uint8)
        mask = 8 * len(bits) - 1
        stops = np.array([hashes[t] for t in sorted(TERMINALS)], np.uint64)
        nl = np.uint64(hashes["\n"])
        h = np.array(col, np.uint64)
        eot = h == np.uint64(hashes["\x00"])
        stop, line = np.isin(h, stops), h == nl
        k2, k3 = _mix(h[:-1], h[1:]), _mix(h[:-2], h[1:-1], h[2:])
        k5 = _mix(k3[:-2].view(np.uint64), h[3:-1], h[4:])
        nxt_stop, nxt_line, nxt_eot = (np.append(x[1:], False) for x in (stop, line, eot))
        one, two = np.full(len(h), 1, np.uint64), np.full(len(h), 2, np.uint64)
        at = np.flatnonzero(line | stop)
        ends = np.append(at[1:], len(h))
        # units of two tokens or more which a full stop or a line end closes
        ok = (ends < len(h)) & (ends - at > 2)
        at, ends = at[ok], ends[ok]
        seen = np.append(0, np.cumsum(eot))
        inner = seen[ends] == seen[at + 1]
        at, ends = at[inner], ends[inner]
        kh = _mix(h[at + 1], h[at + 2], one[: len(at)], two[: len(at)]) if len(at) else np.zeros(0, np.int64)
        hs = stop[ends] | stop[ends - 1] if len(at) else np.zeros(0, bool)
        k = np.concatenate([k2, k3, k5, kh])
        term = np.concatenate([nxt_stop[1:], nxt_stop[2:], nxt_stop[4:], hs])
        ln = np.concatenate([nxt_line[1:], nxt_line[2:], nxt_line[4:], ~hs])
        last = np.concatenate([nxt_eot[1:], nxt_eot[2:], nxt_eot[4:], np.zeros(len(kh), bool)])
        q = k & mask
        keep = ((bits[q >> 3] >> (q & 7).astype(np.uint8)) & 1).astype(bool) & ~last
        k, term, ln = k[keep], term[keep], ln[keep]
        u, inv = np.unique(k, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(u), *(pa.array(np.bincount(inv, w, len(u)).astype(np.int64)) for w in (np.ones(len(k)), term, ln))],
            ["k", "n", "term", "line"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            if len(hashes) > 2_000_000:
                hashes = _Hashes()
            col: list[int] = []
            for t in b.column(0).to_pylist():
                if t:
                    col.append(hashes["\n"])
                    t = t.strip()
                    # what stands before closing dots is a text's end, and is left out like that of others
                    col += [hashes[x] for x in tokens(DOTS.sub("", t) if t.endswith(("...", "…", "&hellip;")) else t)]
                    col.append(hashes["\x00"])
                if len(col) > _SLICE:
                    yield count(col + [hashes["\x00"]] * 5, hashes)
                    col = []
            if col:
                yield count(col + [hashes["\x00"]] * 5, hashes)

    counts = df.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "k long, n long, term long, line long")
    return counts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("term").alias("term"), F.sum("line").alias("line"))


def with_rates(ends: DataFrame, texts: DataFrame, text: str, row: str) -> DataFrame:
    """Adds line_rate, stop_rate, head_rate, dots_rate, word_rate to ends (row, kind, text_hash, keys).

    Of the longest run of last words seen often enough elsewhere: the share of its other occurrences that end a line, and the
    share that a full stop follows. head_rate: of the other units that start like the last one, the share that end without a full stop. dots_rate: of these
    units and the other texts whose last one starts so, the share that end in dots ("More next week...").
    Null where nothing like it is seen elsewhere. Copies of a text count once for its end.
    """
    counts = follow_counts(texts, text, candidate_bits(ends.filter("kind in ('open', 'dots')"), "keys"))
    e = ends.select(row, "kind", "text_hash", F.posexplode("keys").alias("g", "k"))
    once = e.dropDuplicates(["k", "text_hash"])
    fin = once.groupBy("k").agg(F.count_if(F.col("kind") != "dots").alias("fn"), F.count_if(F.col("kind") == "open").alias("fo"), F.count_if(F.col("kind") == "dots").alias("fd"))
    asked = e.filter("kind in ('open', 'dots')")
    c = asked.select("k").distinct().join(counts, "k", "left").join(fin, "k", "left").na.fill(0)
    c = c.select("k", (F.col("n") + F.col("fn")).alias("n"), "term", (F.col("line") + F.col("fo")).alias("line"), "fd")
    own = (F.col("kind") == "open").cast("int")
    j = asked.join(c, "k").select(row, "g", (F.col("n") - own).alias("n"), (F.col("line") - own).alias("line"), "term", (F.col("fd") - (F.col("kind") == "dots").cast("int")).alias("fd"))
    enough = (F.col("g").isin(1, 2) & (F.col("n") >= 4)) | ((F.col("g") == 0) & (F.col("n") >= 1))
    best = j.groupBy(row).agg(F.max(F.when(enough, F.struct("g", "n", "line", "term"))).alias("b"), F.max(F.when(F.col("g") == 3, F.struct("n", "line", "fd"))).alias("h"), F.max(F.when(F.col("g") == 0, F.struct("n", "line", "term"))).alias("w"))
    share = lambda a, n: F.when(F.col(n) > 0, a / F.col(n))
    rates = best.select(
        row,
        share(F.col("b.line"), "b.n").alias("line_rate"),
        share(F.col("b.term"), "b.n").alias("stop_rate"),
        share(F.col("h.line"), "h.n").alias("head_rate"),
        F.when(F.col("h.fd") > 1, F.col("h.fd") / (F.col("h.n") + F.col("h.fd"))).alias("dots_rate"),
        share(F.col("w.line") + F.col("w.term"), "w.n").alias("word_rate"),
    )
    return ends.join(rates, row, "left")


def finished(text: str) -> tuple[str, str]:
    """(kind, rest): how a text ends - 'blank', 'stop' (full stop), 'marker', 'dots', 'markup' (inside a tag or entity), 'open'.

    rest is the text before a marker or dots, else the text without trailing blanks.
    """
    t = text.rstrip()
    if not t:
        return "blank", t
    # each pattern is tried only on texts that end in a character with which it can end
    m = MARKERS.search(t) if t[-1] in ")]>»eEgG" else None
    if m:
        rest = t[: m.start()].rstrip()
        return ("stop" if rest[-1:] in TERMINALS else "marker"), rest
    m = DOTS.search(t) if t.endswith(("...", "…", "&hellip;")) else None
    if m:
        return "dots", t[: m.start()].rstrip()
    tag = t.rfind("<")
    if tag >= 0 and (tag == len(t) - 1 or t.find(">", tag) < 0 and (t[tag + 1] == "/" or t[tag + 1].isalnum() or t[tag + 1] == "_")) or re.search(r"&#?\w{0,7}$", t[-9:]):
        return "markup", t
    if t.rstrip(CLOSERS)[-1:] in TERMINALS or t[-1] in ")]" and _CITATION.sub("", t).rstrip(CLOSERS)[-1:] in TERMINALS:
        return "stop", t
    return "open", t
