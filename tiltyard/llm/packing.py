"""Filling fixed-capacity containers with texts: harmonic packing.

A text of s tokens belongs to class k where capacity/(k+1) < s <= capacity/k, and k texts of class k fill a container. Workers
fill containers of their own texts independently, large classes first; texts of the smaller classes go first, by best fit, to
the space that larger ones leave, those of the last class (at most capacity/classes) altogether. Containers that a worker can't fill are packed again with those of other workers, in rounds over groups
of workers, so that no task holds more than its share.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltyard.session import cut, spread

PER_WORKER = 20_000  # texts of one packing worker, about, of which it holds ids and sizes
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):  # noqa: ANN201
    """The tokenizer of a vocabulary file, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, row: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row, size): tokens of each text; null and empty texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for f in frames:
            yield pd.DataFrame({row: f[row], "size": [len(enc.encode_ordinary(t)) if t else 0 for t in f["_t"]]})

    d = spread(df.select(row, F.col(text).cast("string").alias("_t")), row)
    return d.mapInPandas(run, f"`{row}` {df.schema[row].dataType.simpleString()}, size long")


def harmonic(items: list[tuple], sizes: list[int], capacity: int, classes: int, last: bool) -> tuple[list[tuple[int, int]], list[int]]:
    """((item position, bin) of the filled bins, positions of the texts that remain).

    last: fill bins that stay open, too, each class's rest joining the free space of other bins where it fits.
    """
    by: dict[int, list[int]] = defaultdict(list)
    for p, s in enumerate(sizes):
        by[min(classes, capacity // s) if s else classes].append(p)
    out: list[tuple[int, int]] = []
    free: list[tuple[int, int]] = []  # (free space, bin), ascending
    n = 0
    rest: list[int] = []
    for k in range(1, classes):
        ps = sorted(by.get(k, []), key=lambda p: (-sizes[p], p))
        if free and k > 1:
            # what fits into the space that larger classes leave goes there
            left = []
            for p in ps:
                at = bisect_left(free, (sizes[p], -1))
                if at < len(free):
                    space, b = free.pop(at)
                    out.append((p, b))
                    insort(free, (space - sizes[p], b))
                else:
                    left.append(p)
            ps = left
        full = len(ps) // k * k
        for at in range(0, full, k):
            chosen = ps[at : at + k]
            out += [(p, n) for p in chosen]
            insort(free, (capacity - sum(sizes[p] for p in chosen), n))
            n += 1
        rest += ps[full:]
    small = sorted(by.get(classes, []), key=lambda p: (-sizes[p], p))
    todo = sorted(rest, key=lambda p: (-sizes[p], p)) + small if last else small
    used: dict[int, int] = defaultdict(int)
    opened: set[int] = set()
    for p in todo:
        j = bisect_left(free, (sizes[p], -1))
        if j < len(free):
            space, b = free.pop(j)
        else:
            space, b = capacity, n
            opened.add(n)
            n += 1
        out.append((p, b))
        used[b] += 1
        if space > sizes[p] or not sizes[p]:
            insort(free, (space - sizes[p], b))
    if not last:
        # bins of small texts that are less than full go to the next round with what remains of the classes
        loose = {b for s, b in free if b in opened and s > capacity // classes}
        rest += [p for p, b in out if b in loose]
        out = [(p, b) for p, b in out if b not in loose]
    return out, rest


def pack(df: DataFrame, row: str, text: str, capacity: int = 2048, classes: int = 6, group: int = 32, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row, part, container, size): the container of every text.

    A text of more than capacity tokens is cut into parts of capacity tokens and a rest, which is packed like a text; no other
    text is split (part 0). Null and empty texts take no space and have a container. Rows given twice are packed twice.
    """
    sized = cut(token_sizes(df, row, text, vocabulary), "sizes")
    whole = F.floor((F.greatest(F.col("size"), F.lit(1)) - 1) / capacity).cast("int")
    parts = sized.select(row, F.explode(F.sequence(F.lit(0), whole)).alias("part"), "size")
    parts = parts.select(row, "part", F.when((F.col("part") + 1) * capacity <= F.col("size"), capacity).otherwise(F.col("size") - F.col("part") * capacity).cast("long").alias("size"))
    row_type = df.schema[row].dataType.simpleString()
    schema = f"`{row}` {row_type}, part int, size long, worker int, container string"
    full = parts.filter(F.col("size") == capacity).select(row, "part", "size", F.lit(-1).alias("worker"), F.concat_ws("-", F.lit("f"), F.col(row).cast("string"), F.col("part").cast("string"), F.monotonically_increasing_id().cast("string")).alias("container"))
    todo = parts.filter(F.col("size") < capacity)
    # the workers follow the number of texts alone: the same table is packed the same way on any cluster
    workers = max(1, -(-sized.count() // PER_WORKER))
    todo = todo.select(row, "part", "size", F.pmod(F.xxhash64(row, "part"), F.lit(workers)).cast("int").alias("worker"))

    def packer(step: int, last: bool):  # noqa: ANN202
        def run(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values([row, "part"], kind="stable").reset_index(drop=True)
            w = int(f["worker"].iloc[0])
            got, _ = harmonic(list(f.index), f["size"].tolist(), capacity, classes, last)
            ids = pd.Series([None] * len(f), dtype=object)
            for p, b in got:
                ids[p] = f"{step}-{w}-{b}"
            return f.assign(container=ids)[[row, "part", "size", "worker", "container"]]

        return run

    out, step = full, 0
    while True:
        last = workers <= 1
        # a partition of its own for each worker, which AQE would draw together
        packed = todo.repartition(workers, "worker").groupBy("worker").applyInPandas(packer(step, last), schema)
        packed = packed if last else cut(packed, "packed")
        out = out.unionByName(packed.filter("container is not null"))
        if last:
            return out.select(row, "part", "container", "size")
        workers, step = -(-workers // group), step + 1
        todo = packed.filter("container is null").select(row, "part", "size", F.floor(F.col("worker") / group).cast("int").alias("worker"))
