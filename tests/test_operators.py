import datetime as dt

from pyspark.sql import functions as F

from tiltyard.operators import answers, chunker, linker, predicates, relational, retrieval, rollup, sinks
from tiltyard.streaming import feed

T0 = dt.datetime(2025, 1, 1)


def test_grid(spark):
    d = spark.createDataFrame([("10", "2024-01-02"), ("9", None), (None, "x")], "a string, b string")
    ids = lambda c: d.filter(c).count()
    assert ids(predicates.grid("a", "gt", "9.5")) == 1 and ids(predicates.grid("b", "ge", "2024-01-01")) == 1
    assert ids(predicates.grid("a", "equals", "")) == 1 and ids(predicates.grid("b", "contains", "X")) == 1 and ids(predicates.in_list("a", [])) == 0


def test_windows_tail_and_cover(spark):
    for n, want in {0: [], 5: [(0, 5)], 10: [(0, 10)], 12: [(0, 12)], 16: [(0, 10), (8, 16)], 26: [(0, 10), (8, 18), (16, 26)]}.items():
        d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "id int, text string")
        w = [(r.tok_start, r.tok_end) for r in chunker.windows(d, ["id"], "text", 10, 2, 5).orderBy("idx").collect()]
        assert w == want, (n, w)


def test_chunker_drops_running_lines_and_attributes_pages(spark):
    pages = [(1, p, f"HEAD\n{' '.join(f'p{p}w{i}' for i in range(8))}\nFOOT") for p in (1, 2, 3)] + [(2, 1, "only one page")]
    d = spark.createDataFrame(pages, "doc int, page int, text string")
    c = chunker.chunk(d, "doc", "page", "text", size=10, overlap=2, tail=3).orderBy("doc", "chunk_index").collect()
    assert "HEAD" not in " ".join(r.body for r in c) and "FOOT" not in " ".join(r.body for r in c)
    one = [r for r in c if r.doc == 1]
    assert [(r.page_start, r.page_end) for r in one] == [(1, 2), (2, 3), (3, 3)] or one[0].page_start == 1 and one[-1].page_end == 3
    outline = spark.createDataFrame([(1, "A", 2, 0), (1, "B", 2, 1), (1, "C", 3, 2)], "doc int, title string, page int, pos int")
    s = chunker.chunk(d, "doc", "page", "text", outline, 10, 2, 3)
    assert {r.heading for r in s.filter("doc = 1").collect()} == {"", "B", "C"}


def test_resolve(spark):
    m = spark.createDataFrame([("1", "Star Race", "g1"), ("2", "Star Race", "g1"), ("3", "Moon: Base", "g2"), ("4", "Twin", "g3"), ("5", "Twin", "g4")], "id string, title string, g string")
    q = spark.createDataFrame([(1, "star-race"), (2, "Star Race Pinball"), (3, "the great Moon Base manual"), (4, "twin"), (5, "nothing"), (6, None), (7, "")], "q int, t string")
    got = {r.q: (r.status, r.stage, r.ids) for r in relational.resolve_titles(q, "q", "t", m, "id", "title", "g").collect()}
    assert got[1] == ("Family", 0, ["1", "2"]) and got[2] == ("Family", 1, ["1", "2"]) and got[3] == ("Resolved", 2, ["3"])
    assert got[4][0] == "Ambiguous" and got[5][0] == got[6][0] == got[7][0] == "NoMatch"
    links = linker.link(q, "q", {"name": "t"}, m, "id", "title", "g")
    st = {r.q: r.status for r in links.collect()}
    assert st[1] == "linked" and st[4] == "needs_review" and st[5] == "not_in_catalog"
    f = linker.fan_out(links, "q", m.filter("id <> '2'"), "id")
    assert {r.q: r.status for r in f.collect()} == {1: "failed", 2: "failed", 3: "linked"}


def test_superset_and_fixpoint(spark):
    m = spark.createDataFrame([("Star", "a"), ("Star: Two", "b"), ("Star - Three", "a"), ("Starry: X", "c"), (None, "d")], "t string, g string")
    assert {(r.short_title, r.long_title) for r in relational.superset_titles(m, "t", "g").collect()} == {("Star", "Star: Two")}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "s int, d int")
    got = {(r.node, r["pass"]) for r in relational.fixpoint(spark.createDataFrame([(1,)], "n int"), e, "s", "d").collect()}
    assert got == {(1, 0), (2, 1), (3, 2)}


def test_anchored_windows(spark):
    d = spark.createDataFrame([("u", T0 + dt.timedelta(minutes=m), i) for i, m in enumerate([0, 10, 59, 61, 70, 121, 130])], "k string, at timestamp, id int")
    ok = [r.allowed for r in relational.anchored_windows(d, "k", "at", 3600, 2).orderBy("id").collect()]
    assert ok == [True, True, False, True, True, True, True]


def test_knn_and_fusion(spark):
    e = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(99, None)], "id int, v array<float>")
    k = retrieval.knn(e.filter("id = 0"), e, "id", "v", 2).orderBy("rank").collect()
    assert [(r.id, round(r.score, 6)) for r in k] == [(3, 1.0), (6, 1.0)]
    a = spark.createDataFrame([("x", 1), ("y", 2)], "d string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "d string, rank int")
    assert retrieval.fuse(a, b, "d").orderBy(F.desc("score")).first().d == "y"


def test_answers(spark):
    d = spark.createDataFrame([("a [[cite:7]] b [[cite:9]] c [[cite:5]].", [5, 7]), ("none", [1])], "t string, o array<int>")
    assert [r.x for r in d.select(answers.renumber_markers(F.col("t"), F.col("o")).alias("x")).collect()] == ["a [2] b  c [1].", "none"]
    c = spark.createDataFrame([(1, "U", 3, False, "web"), (1, "u", 5, True, "chunk"), (1, "v", 4, False, "web")], "a int, url string, pos int, ch boolean, src string")
    got = {(r.url, r.pos, r.src) for r in answers.ordered_citations(c, "a", "url", "pos", "ch").collect()}
    assert got == {("u", 3, "chunk"), ("v", 4, "web")}
    p = spark.createDataFrame([("Ann Lee", 1, None, 1500.0), ("Bob Lee", 2, 77, 1600.0)], "name string, user_id long, ifpa_id long, rating double")
    assert [r.user_id for r in answers.player_lookup(p, "lee").collect()] == [2, 1] or len(answers.player_lookup(p, "lee").collect()) == 2
    assert answers.player_lookup(p, "77").first().user_id == 2 and answers.player_lookup(p, "ann lee").first().user_id == 1


def test_sinks_and_rollups(spark):
    old = spark.createDataFrame([("a", "s1", "t", "linked"), ("b", "s", "t", "manual"), ("c", "s", "t", "linked")], "id string, slug string, kind string, st string")
    new = spark.createDataFrame([("a", "s2", "t", None), ("b", "s9", "t", None), ("d", "s", "t", None)], "id string, slug string, kind string, st string")
    r = {x.id: (x.slug, x.st) for x in sinks.merge_fields(old, new, "id", ["slug", "kind"], ("st", ["slug", "kind"], "pending"), "manual").collect()}
    assert r == {"a": ("s2", "pending"), "b": ("s9", "manual"), "c": ("s", "linked"), "d": ("s", "pending")}
    ix = spark.createDataFrame([("d", None, 1), ("d", "m", 2)], "doc string, m string, n int")
    assert {x.n for x in sinks.replace_chunks(ix, spark.createDataFrame([("d", None, 9)], ix.schema), "doc", "m").collect()} == {2, 9}
    n = rollup.nested(spark.createDataFrame([("m", "x", "Manual"), ("m", "x", "manual"), ("m", "y", "Flyer")], "mk string, id string, kind string"), "mk", "id", "kind").first()
    assert [(e["id"], e["doc_count"], e["has_manual"]) for e in n.members] == [("x", 2, True), ("y", 1, False)]


def test_ingest_outcomes(spark):
    b = spark.createDataFrame([("a", "h", "Manual"), ("b", "h2", "Manual"), ("c", "h", "Manual"), ("d", "h", "Flyer"), (None, "h", "Manual"), ("e", None, "Manual")], "id string, hash string, kind string")
    s = spark.createDataFrame([("a", "h", 0), ("b", "h", 1), ("c", "x", 3)], "id string, last_hash string, attempts int")
    got = {r.id: r.outcome for r in feed.ingest_outcomes(b, s, "id", "hash", "kind", ["Manual"]).collect()}
    assert got == {"a": "hash_unchanged", "b": "process", "c": "over_budget", "d": "type_filtered", None: "empty_id", "e": "process"}
