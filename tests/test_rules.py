from pyspark.sql import functions as F

from tiltyard.operators import rules as R


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def token(spark, f, p=None, l=None):  # noqa: E741
    lit = lambda v: F.lit(v).cast("string")
    return one(spark, R.edition_token(lit(f), lit(p), lit(l)))


def test_edition_tokens(spark):
    assert [token(spark, f) for f in ("x_le_y.pdf", "x_pro_vault_y.pdf", "x_brk_y.pdf", "x_sle_y.pdf", "x_ve_y.pdf", "a-70th-b.pdf", "x_premium.pdf", "plain.pdf", None)] == ["le", "vault", "brk", "sle", "ve", "70th", "premium", None, None]
    assert token(spark, "x_pro_y.pdf", "LE Manual") == "le" and token(spark, "x.pdf", None, "Game Pro Flyer") == "pro" and token(spark, "x.pdf", None, "galaxy") is None
    assert token(spark, "x_pro_rulesheet.pdf") is None and token(spark, "x_pro_y.pdf", None, "Feature Matrix") is None


def test_editions_and_eras(spark):
    rows = [(1, "a", ["pro"], False, "pro"), (1, "b", ["pro", "vault"], False, "pro"), (2, "a", ["pro"], False, "le"), (2, "b", ["premium"], False, "le"), (3, "a", ["pro"], True, None), (3, "b", ["le"], True, None), (4, "z", [], False, None), (5, "a", ["le"], False, "le"), (5, "b", ["le"], False, "le"), (5, "b", ["le"], False, "le")]
    c = spark.createDataFrame(rows, "d long, m string, t array<string>, w boolean, k string")
    got = {r.d: (r.status, r.scope, r.ids) for r in R.choose_edition(c, "d", "m", "t", "w", "k").collect()}
    assert got == {1: ("single", "single-edition", ["a"]), 2: ("unresolved", "franchise-wide", []), 3: ("fan_out", "franchise-wide", ["a", "b"]), 4: ("single", "single-edition", ["z"]), 5: ("unresolved", "franchise-wide", [])}
    e = spark.createDataFrame([(1, "g1", 1990, 1990, ["pro"], []), (1, "g2", 2001, 1990, ["le"], []), (2, "g1", 1990, 1990, ["pro"], ["le"]), (2, "g2", 2001, 1990, ["le"], ["le"]), (3, "g1", None, None, ["le"], ["le"]), (3, "g2", None, None, ["le"], ["le"])], "d long, g string, y int, w int, t array<string>, n array<string>")
    assert [(r.d, r.g) for r in R.choose_era(e, "d", "g", "y", "w", "t", "n").collect()] == [(1, "g1")]


def test_small_rules(spark):
    assert one(spark, R.classify_document(F.lit("x"), F.lit("Rules Manual"), F.lit("Electronics"), F.lit(None).cast("string"), {})) == "Schematic"
    assert one(spark, R.maker_of(F.lit("t"), F.lit("https://x.acme.example.evil/a"), {"t": "own"}, {"acme.example": "acme"})) == "own"
    assert one(spark, R.outermost_object(F.lit("a {b {c} d} e"))) == "{b {c} d}" and one(spark, R.outermost_object(F.lit("none"))) is None
    assert [one(spark, R.scheduled_run(F.lit("job-a"), F.lit(r))) for r in ("JOB-a-12", "job-a-", "job-a-x1", "job-a12")] == [True, False, False, False]
    assert one(spark, R.machine_id_coverage(F.array(F.struct(F.lit("s").alias("tool"), F.lit(" ").alias("machine_id"))), "s")) == 0.0
    assert one(spark, R.result_shape(F.lit('{"hits":1,"attributionUrl":2}'))) == "corpus" and one(spark, R.result_shape(F.lit("[1]"))) is None
    assert one(spark, R.suggest_words(F.lit("the game"))) == ["game"] and one(spark, R.suggest_words(F.lit("Pinball rules"))) == ["pinball"] and one(spark, R.suggest_words(F.lit(""))) == []


def test_a_log_that_is_just_long_enough_is_not_truncated(spark):
    df = spark.range(5)
    assert {r.truncated for r in R.log_tail(df, ["id"], 5).collect()} == {False} and [r.id for r in R.log_tail(df, ["id"], 4).collect()] == [0, 1, 2, 3] and R.log_tail(df.limit(0), ["id"], 4).count() == 0


def test_empty_and_null_inputs(spark):
    m = spark.createDataFrame([], "opdb_id string, title string, group_id string")
    q = spark.createDataFrame([(1, None), (2, "")], "q long, t string")
    assert R.suggest_all(q, "q", "t", m, "opdb_id", "title", "group_id").count() == 0
    t = spark.createDataFrame([(1, None), (2, " "), (3, "G1-M9")], "i long, t string")
    assert R.tip_targets(t, "i", "t", m, "opdb_id", "group_id").count() == 0
    u = R.uploads(spark.createDataFrame([(None, "x"), ("a", None), ("b", "xx"), ("b", "xx")], "k string, c string"), "k", "c", 1)
    assert sorted((r.k or "", r.error) for r in u.collect()) == [("", "no_key"), ("a", "no_content"), ("b", "too_large"), ("b", "too_large")]
