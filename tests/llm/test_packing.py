import random

import pytest

from tiltyard.llm import packing


def test_harmonic_keeps_all_and_fits():
    rng = random.Random(0)
    sizes = [rng.choice([0, 1, 5, 30, 60, 90, 99]) for _ in range(500)]
    for last in (False, True):
        got, rest = packing.harmonic(list(range(500)), sizes, 100, 6, last)
        done = [p for p, _ in got]
        assert sorted(done + ([] if last else rest)) == list(range(500))
        fill = {}
        for p, b in got:
            fill[b] = fill.get(b, 0) + sizes[p]
        assert max(fill.values()) <= 100
    assert len(fill) <= 1.15 * sum(sizes) / 100 + 20


def test_pack(spark):
    rng = random.Random(1)
    texts = [" ".join(["word"] * rng.randint(0, 60)) for _ in range(400)] + ["word " * 1000, None, ""]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "id long, text string, container string, part int")
    got = packing.pack(df, "id", "text", capacity=64, group=2).collect()
    fill, parts = {}, {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.size
        parts.setdefault(r.id, []).append((r.part, r.size))
    assert max(fill.values()) <= 64 and set(parts) == set(range(len(texts)))
    sizes = {r.id: r.size for r in packing.token_sizes(df, "id", "text").collect()}
    for i, ps in parts.items():
        assert sorted(p for p, _ in ps) == list(range(len(ps))) and sum(s for _, s in ps) == sizes[i]
        assert len(ps) == 1 or sizes[i] > 64
    assert sum(fill.values()) / (64 * len(fill)) > 0.93
    assert packing.pack(df.limit(0), "id", "text").count() == 0


def test_tokens_round_trip():
    pytest.importorskip("tiktoken")
    enc = packing.encoding(packing.VOCABULARY)
    for t in ("Hello, wörld! 123  <|endoftext|>\n\n x", "  ", "a" * 3000):
        assert enc.decode(enc.encode_ordinary(t)) == t
