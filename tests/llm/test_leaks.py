import random

from tiltyard.llm import leaks

V = [f"w{i}" for i in range(60)] + ["the", "of", "and"]


def brute(docs, items, run=13):
    g = lambda t: {tuple(w[k : k + run]) for w in [leaks.tokenize(t or "")] for k in range(len(w) - run + 1)}
    ig = {i: g(t) for i, t in items}
    return {(i, d) for d, t in docs for gd in [g(t)] for i in ig if gd & ig[i]}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(V) for _ in range(n))
    items = [(i, text(rng.randint(5, 60))) for i in range(40)] + [(98, None), (99, "")]
    docs = []
    for d in range(150):
        t = text(rng.randint(0, 200))
        if rng.random() < 0.6:
            i = rng.randrange(40)
            ws = items[i][1].split()
            n = rng.randint(11, 16)
            at = rng.randrange(max(1, len(ws) - n))
            piece = ", ".join(ws[at : at + n]).upper()
            cut = rng.randint(0, len(t))
            t = t[:cut] + " " + piece + " " + t[cut:]
        docs.append((d, t))
    docs += [(900, None), (901, ""), (902, "x" * 300_000), (903, "K " + items[0][1])]
    want = brute(docs, items)
    df = spark.createDataFrame([(*r, "c") for r in docs + docs[:5]], "doc long, text string, item string")
    it = spark.createDataFrame([(*r, 1) for r in items + items[:3]], "item long, text string, doc int")
    for block in (1000, 7):
        got = {(r.item, r.doc) for r in leaks.find_leaks(df, it, "doc", "text", "item", "text", block=block).collect()}
        assert got == want and len(want) > 10
    assert leaks.find_leaks(df.limit(0), it, "doc", "text", "item", "text").count() == 0
    assert leaks.find_leaks(df, it.limit(0), "doc", "text", "item", "text").count() == 0


def test_wand_equals_full_scoring():
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(V) for _ in range(40))) for i in range(300)]
    x = leaks.ItemIndex(items, 13)
    for _ in range(60):
        q = set(rng.sample(V, 25))
        full = {}
        for w in q:
            p = x.postings[w]
            for i, s in zip(p.ids, p.impacts):
                full[i] = full.get(i, 0) + s
        want = {i for i, s in full.items() if s >= x.threshold}
        assert {i for i, _ in x.wand(q)} == want
