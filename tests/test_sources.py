import pytest
from pyspark.sql import functions as F

from tiltyard.sources import files, html


def df(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "j string")


def test_catalog_export(spark):
    j = '{"machineGroups":[],"machines":[{"opdbId":"G1-M1","isMachine":true,"name":"A"}],"aliases":[{"opdbId":"G1-M1-A1","isAlias":true,"name":"A (LE)"}]}'
    got = [(r.kind, r.opdbId, r.name) for r in files.catalog_export(df(spark, j), "j").collect()]
    assert got == [("machine", "G1-M1", "A"), ("alias", "G1-M1-A1", "A (LE)")]
    with pytest.raises(Exception, match="no machines"):
        files.catalog_export(df(spark, '{"machines":[],"aliases":[]}'), "j").collect()


def test_tips(spark):
    j = '[{"tipId":1,"opdbId":"G1","text":" x "},{"tipId":"z","opdbId":"G1","text":"y"},{"tipId":3,"opdbId":" ","text":"y"},{"tipId":4,"opdbId":"G2","voteTotal":7,"category":"skill","text":"z"}]'
    assert [tuple(r) for r in files.tips(df(spark, j), "j").collect()] == [(1, "G1", "general", 0, "x"), (4, "G2", "skill", 7, "z")]


def test_enrichment_last_wins(spark):
    j = '{"entries":[{"id":"a","type":"machine","people":[{"name":"Q","role":"design","index":2},{"name":"P","role":"design","index":1},{"name":"R","role":"art","index":0}],"images":[{"primary":false,"urls":{"medium":"m1"}},{"primary":true,"urls":{"medium":"m2","large":"l2"}}]},{"id":"b","type":"group"}]}'
    r = files.enrichment(df(spark, j), "j").collect()
    assert [(x.id, x.designers, x.image) for x in r] == [("a", ["P", "Q"], "l2")]


def test_json_lines(spark):
    d = df(spark, "# note", "", '{"id":"1"}', '  {"id":"2"}')
    assert [r.id for r in files.json_lines(d, "j", "id string").collect()] == ["1", "2"]
    with pytest.raises(Exception):
        files.json_lines(df(spark, "{bad"), "j", "id string").collect()


def test_seed_problems(spark):
    s = spark.createDataFrame([("1", "m1", None), ("1", "m2", "x"), ("2", None, None), ("3", "m9", None)], "id string, machine string, other string")
    p = spark.createDataFrame([("m1",), ("m2",)], "id string")
    got = {tuple(r) for r in files.seed_problems(s, "id", {"machine": p}, ["machine", "other"]).collect()}
    assert got == {("duplicate", "1"), ("reference:machine", "3"), ("exactly_one", "1"), ("exactly_one", "2")}


def test_ratings_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Name,User ID,IFPA ID,Rating,RD,Lower Bound,Last Rating Period,Rating class\n"Lee, ""A""",1,,1500.5,30,1400,2024-01-02,2\nBad,x\n')
    r = files.ratings_csv(spark, str(tmp_path)).collect()
    assert [(x.name, x.user_id, x.rating) for x in r] == [('Lee, "A"', 1, 1500.5)]
    (tmp_path / "r.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.ratings_csv(spark, str(tmp_path))


def test_sitemap(spark):
    x = '<?xml version="1.0"?><urlset xmlns="http://x"><url><loc> https://a/p/1?x=1&amp;y=2 </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://a/q/2</loc></url></urlset>'
    e = files.sitemap(df(spark, x), "j", "/p/")
    assert [r.loc for r in e.collect()] == ["https://a/p/1?x=1&y=2"]
    assert files.newest(e, F.lit("2024-01-01").cast("timestamp"), 5).count() == 1 and files.newest(e, F.lit("2025-01-01").cast("timestamp"), 5).count() == 0


def test_shop_lighthouse_alert_status(spark):
    p = files.shop_products(df(spark, '{"products":[{"handle":"h","title":"T","vendor":"V","variants":[{"price":"12.50","available":false},{"price":"9","available":true}]}]}'), "j").first()
    assert (p.handle, p.price, p.available) == ("h", 9.0, True)
    r = files.lighthouse(df(spark, '{"finalUrl":"u","categories":{"performance":{"score":0.9}}}'), "j").first()
    assert (r.url, r.performance, r.seo) == ("u", 90.0, None)
    j = '{"data":{"essentials":{"alertRule":"R","firedDateTime":"2024-01-02T03:04:05Z"},"alertContext":{"condition":{"allOf":[{"dimensions":[{"name":"job","value":"sync"}]}]}}}}'
    a = files.alert_webhook(df(spark, j, j, "{}"), "j").collect()
    assert a[0].rule == "R" and a[0].job == "sync" and a[0].alert_id == a[1].alert_id and len(a[0].alert_id) == 16 and a[2].rule == "unknown"
    s = [spark.range(1).select(files.extraction_status(F.lit(t), F.lit(e), F.lit(n)).alias("s")).first().s for t, e, n in [("x" * 40, False, 1), ("x", False, 1), ("", True, 1), ("x" * 40, False, 10**9)]]
    assert s == ["Success", "OcrRequired", "Encrypted", "SizeExceeded"]


def test_robots(spark):
    body = "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /x/ok\n\nUser-agent: *\nDisallow: /*.pdf$\n"
    rules = files.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"), "host", "body")
    urls = spark.createDataFrame([("h", p) for p in ("/x/1", "/x/ok/1", "/y.pdf", "/y.pdf?z", "/")], "host string, path string")
    a = {r.path: r.allowed for r in files.robots_allowed(urls, "host", "path", rules, "A").collect()}
    assert a == {"/x/1": False, "/x/ok/1": True, "/y.pdf": True, "/y.pdf?z": True, "/": True}
    o = {r.path: r.allowed for r in files.robots_allowed(urls, "host", "path", rules, "other").collect()}
    assert o == {"/x/1": True, "/x/ok/1": True, "/y.pdf": False, "/y.pdf?z": True, "/": True}


PAGE = """<html><head><title> T </title><meta property="og:title" content="OG"><link rel="canonical" href="https://a/c">
<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"@type":["Thing","Product"],"name":"P","offers":[{"priceSpecification":{"price":"9.5"}}],"x":{"datePublished":"2024"}}]}</script></head>
<body><h2>Head</h2><p>One <b>two</p><a href="/d/x.PDF">Doc</a><a href="/d/x.pdf">Again</a><a href="mailto:x">m</a><a href="?variant=Pro">v</a><script>"</p>"</script></body></html>"""


def test_html(spark):
    d = spark.createDataFrame([(1, "https://a/b/", PAGE), (2, None, None), (3, "https://a", "<p>unclosed <b")], "id int, url string, html string")
    m = {r.id: r for r in html.metadata(d, "id", "html").collect()}
    assert (m[1].title, m[1].canonical, m[1].product, m[1].price, m[1].published, m[1].editions) == ("OG", "https://a/c", "P", 9.5, "2024", ["Pro"])
    assert m[1].body.startswith("## Head\n\nOne two") and m[2].title is None
    links = [(r.id, r.href, r.text) for r in html.links(d, "id", "url", "html", (".pdf",)).collect()]
    assert links == [(1, "https://a/d/x.PDF", "Doc")]
