import datetime as dt
import random

import numpy as np

from tiltyard.llm import matching

A = "Crimson Velvet Wooden Crystal Shadow Thunder Howling Gilded Opal Umbral".split()
B = "Harbor Quarry Pyramid Emperor Lantern Voyage Kingdom Otters Serpents Comet".split()
TITLES = [f"{a} {b}" for i, a in enumerate(A) for j, b in enumerate(B) if (i + 2 * j) % 3]
MK = [("Quillon Coin Works", "quillon"), ("Brasswick Pinball", "brasswick")]


def catalogue():
    return [(f"G{i:03d}", t, *MK[i % 2], 1980 + i % 40) for i, t in enumerate(TITLES)]


def test_parse_and_variants():
    assert matching.parse_title("Star Race (2000)") == ("Star Race", 2000) and matching.parse_title("Star Race ['92]") == ("Star Race", 1992) and matching.parse_title("1984") == ("1984", None)
    assert ["star", "race"] in matching.variants("StarRace LE", set(), frozenset({"le"})) and ["the", "star"] in matching.variants("Star, The", set())


def test_recall_of_blocks_against_brute_force():
    c = matching.Config(sample=300, tables=24)
    m = matching.train(catalogue(), [], [], c)
    k = matching.Catalogue(catalogue(), m)
    rng = np.random.default_rng(0)
    hit = n = 0
    for t in TITLES:
        q = matching._noisy(t, rng)
        got = {i for i, _, _ in k.candidates(q)}
        best = sorted(k.candidates(q, True), key=lambda x: -x[1])[:1]
        hit += sum(i in got for i, _, _ in best)
        n += len(best)
    assert hit / n >= 0.9


def test_documents(spark):
    rng = np.random.default_rng(1)
    t0 = dt.datetime(2025, 1, 1)
    cat = catalogue()
    machines = spark.createDataFrame([(f"{g}-M1", g, t, m, k, y, t0) for g, t, m, k, y in cat] * 2, "opdb_id string, group_id string, title string, manufacturer string, manufacturer_key string, year int, first timestamp")
    rows = [(f"r{i}", f"{g}-M1", t, k) for i, (g, t, m, k, y) in enumerate(cat)]
    want = {}
    for i, (g, t, m, k, y) in enumerate(cat[:30]):
        rows += [(f"u{i}", None, matching._noisy(t, rng), m), (f"u{i}", None, f"{t} ({y})", None), (f"u{i}", None, None, None)]
        want[f"u{i}"] = g
    absent = [f"{a} {b}" for i, a in enumerate(A) for j, b in enumerate(B) if not (i + 2 * j) % 3]
    rows += [(f"x{i}", None, t, MK[i % 2][0]) for i, t in enumerate(absent)] + [("n1", None, None, None), ("n2", None, " ", "x"), (None, None, cat[0][1], None), ("long", None, "word " * 20000, None)]
    random.Random(0).shuffle(rows)
    ch = spark.createDataFrame([(*r, "clash") for r in rows], "document_id string, machine_id string, machine_title string, manufacturer string, title string")
    got = {r.document_id: r.group_id for r in matching.match_documents(ch, machines).collect()}
    assert sum(got.get(k) == v for k, v in want.items()) >= 28
    assert sum(k not in want for k in got) <= 1
    assert matching.match_documents(ch.limit(0), machines).count() == 0


def test_a_shared_title_is_told_apart_by_year_however_many_share_it():
    cat = [*catalogue(), *((f"S{i:03d}", "Whimsical Harbor", *MK[i % 2], 1950 + 2 * i) for i in range(35))]
    k = matching.Catalogue(cat, matching.train(cat, [], [], matching.Config(sample=300)))
    k.model.coef = np.array([-17.0, 2.0, 18.0, 1.0, 2.0])
    for i in range(35):
        got = k.resolve("Whimsical Harbor", MK[i % 2][0], 1950 + 2 * i)
        assert got[0][0] == f"S{i:03d}" and {g for g, _ in got} >= {f"S{j:03d}" for j in range(35)}, i


def test_bounds_lose_nothing():
    k = matching.Catalogue(catalogue(), matching.train(catalogue(), [], [], matching.Config(sample=300)))
    k.model.coef = np.array([-17.0, 2.0, 18.0, 1.0, 2.0])
    rng = np.random.default_rng(3)
    for t in [*(matching._noisy(t, rng) for t in TITLES[:30]), "CrimsonHarbour II", "Th. Emp.", "hwlng", "ii", "", "opal"]:
        for reads in matching.variants(t, k.maker_words):
            up = k.bounds.upper(reads)
            assert all(matching.likeness(reads, f, k.weights) <= u for f, u in zip(k.words, up)), t
        reads, ids, cos, _ = k._bounded(t)
        ma, ya = k.agreement(MK[0][0], 1985)
        want: dict = {}
        for i, x in zip(ids, cos):
            p = 1 / (1 + np.exp(-np.array([1, x, k._likeness(reads, i), ma[i], ya[i]]) @ k.model.coef))
            if p >= 0.02:
                want[k.keys[i]] = max(want.get(k.keys[i], 0), p)
        assert dict(k.resolve(t, MK[0][0], 1985)).keys() == want.keys()


def test_tokens_never_seen_have_directions_and_idf_is_of_the_whole_catalogue():
    m = matching.train(catalogue()[:10], [], [], matching.Config(sample=300), catalogue())
    a, b = m.embed(["zyxwv"]), m.embed(["qqkkj"])
    assert abs(np.linalg.norm(a) - 1) < 1e-5 and (a == m.embed(["zyxwv"])).all() and abs(a @ b) < 0.8 and m.buckets(a[None]).any()
    assert set(m.idf) >= {"w:" + w.lower() for w in A + B}


def test_added_words_are_those_of_sources_not_of_titles(spark):
    rows = [(f"{t} {x}".strip(),) for i, t in enumerate(TITLES) for x in ("", "Service Bulletin" if i % 3 else "Rules")] + [("",), ("1984",)]
    got = matching.added_words(spark.createDataFrame(rows, "title string"), "title", TITLES)
    assert got == {"service", "bulletin", "rules"}
    assert matching.added_words(spark.createDataFrame([], "title string"), "title", []) == frozenset()


def _open_documents(spark, noisy=40):
    rng = np.random.default_rng(5)
    t0 = dt.datetime(2025, 1, 1)
    cat = catalogue()
    machines = spark.createDataFrame([(f"{g}-M1", g, t, m, k, y, t0) for g, t, m, k, y in cat], "opdb_id string, group_id string, title string, manufacturer string, manufacturer_key string, year int, first timestamp")
    rows = [(f"r{i}", f"{g}-M1", t, k) for i, (g, t, m, k, y) in enumerate(cat)] + [(f"u{i}", None, matching._noisy(t, rng), m) for i, (g, t, m, k, y) in enumerate(cat[:noisy])]
    return spark.createDataFrame(rows, "document_id string, machine_id string, machine_title string, manufacturer string"), machines


def test_nothing_is_fitted_on_a_part_of_the_rows(spark):
    changes, machines = _open_documents(spark)
    run = lambda c: {r.document_id: (r.group_id, r.confidence) for r in matching.match_documents(changes, machines, c).collect()}
    whole = run(matching.Config())
    assert len(whole) >= 36
    for c in (matching.Config(sample=2, labelled=2), matching.Config(block=20)):
        got = run(c)
        assert got.keys() == whole.keys() and all(got[k][0] == g and abs(got[k][1] - p) < 3e-4 for k, (g, p) in whole.items()), c


def test_tables_give_the_model_of_their_rows_however_parted(spark):
    cat = catalogue()
    typed = [(f"{matching._noisy(t, np.random.default_rng(i))} Zq{i}", m if i % 3 else None) for i, (_, t, m, *_) in enumerate(cat)] + [("Opal Comet (1999)", None), ("1984", None), ("...", "x"), (" ".join(f"w{i}" for i in range(5000)), None)]
    lab = [(t, k if i % 2 else None, g) for i, (g, t, m, k, y) in enumerate(cat)]
    c = matching.Config(sample=2, labelled=2)
    want = matching.train(cat, typed, lab, c)
    assert {f"w:zq{i}" for i in range(len(cat))} | {"w:w4999", "y:1999"} <= want.ids.keys()
    for n in (1, 7):
        rows = spark.createDataFrame([(t, m, y) for _, t, m, _, y in cat], "title string, maker string, year int").repartition(n)
        got, _ = matching.fit(rows, spark.createDataFrame(typed, "title string, maker string").repartition(n), spark.createDataFrame(lab, "title string, maker string, group_id string").repartition(n), [cat], frozenset(), c, f"t{n}")
        assert got.ids == want.ids and (got.vectors == want.vectors).all() and np.abs(got.coef - want.coef).max() < 1e-3
