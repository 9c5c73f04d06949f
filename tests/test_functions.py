from pyspark.sql import functions as F

from tiltyard.functions import ident
from tiltyard.functions import metrics as M
from tiltyard.functions import text as X


def one(spark, c, value=""):
    return spark.createDataFrame([(value,)], "x string").select(c.alias("y")).first().y


def test_title_key(spark):
    for a, b in {"JamesBond007Special": "james bond 007 special", "Löwe's Nest & Co.": "lowes nest and co", "ABCar": "ab car", "": "", "!!": ""}.items():
        assert one(spark, X.title_key(F.col("x")), a) == b
    assert one(spark, X.title_tokens(F.col("x")), "!!") == []


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, X.compact_key(x), "Star Race Limited Edition") == "starrace"
    assert one(spark, X.compact_key(x), "Edition") == "edition"
    assert one(spark, X.franchise_key(x), "Star Race (2004)") == "starrace"
    assert one(spark, X.franchise_head(x), "Star Race: The Return - II") == "Star Race"
    assert one(spark, X.strip_qualifiers(x), "star race vault edition pinball") == "star race"
    assert one(spark, X.strip_qualifiers(x), "pinball") == "pinball"
    assert one(spark, X.query_words(x), "what is the Lion's roar") == ["lion", "roar"]
    assert one(spark, X.query_words(x), "what is the") == ["what", "is", "the"]
    assert one(spark, X.last_parentheses(x), "A (b) c (Pro LE)") == "Pro LE"
    assert one(spark, X.label_tokens(x), "The Pro  Edition Pro") == ["pro"]
    assert one(spark, X.url_filename(x), "https://a.b/c/d.pdf?x=1#y") == "d.pdf"
    assert one(spark, X.url_slug(x, "game"), "https://a.b/game/star-race/") == "star-race"
    assert one(spark, X.lookup_key(x), " A/b?c#D ") == "a_b_c_d"
    assert one(spark, X.strip_markdown_links(x), "see [this](http://x) now") == "see this now"
    assert one(spark, X.strip_html(x), "<p>a<script>b</script> <b>c</b></p>") == "a c"
    assert one(spark, X.strip_chrome(x, ["shop", "home"]), "Star Race | Shop - Home") == "Star Race"
    assert one(spark, X.edge_ngrams(x), "abcd") == ["ab", "abc", "abcd"]
    assert one(spark, X.edge_ngrams(x), "a") == []
    assert one(spark, X.slug_title(x), "star-race") == "Star Race"
    assert one(spark, X.is_follow_up(x), "What about it?") and not one(spark, X.is_follow_up(x), "Which fuse?")
    assert one(spark, X.whole_word_any(x, F.lit("LE/Pro")), "The pro model") and not one(spark, X.whole_word_any(x, F.lit("LE/Pro")), "The prow")
    assert one(spark, X.lenient_year(x), "2004-05-06") == 2004 and one(spark, X.lenient_year(x), "ca. 1999?") == 1999 and one(spark, X.lenient_year(x), "none") is None
    assert one(spark, X.drop_paragraphs(x, ["cookie"]), "a\n\nWe use Cookies\n\nb") == "a\n\nb"


def test_identity(spark):
    u = F.lit("https://old.example/A.pdf")
    assert one(spark, ident.canonical_url(u, {"old.example": "new.example"})) == "https://new.example/A.pdf"
    assert one(spark, ident.document_id(u)) == one(spark, ident.document_id(F.lower(u))) and len(one(spark, ident.document_id(u))) == 20


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def test_metric_conventions(spark):
    v = lambda c: one(spark, c)
    assert v(M.precision(arr(), arr())) == 1 and v(M.precision(arr(), arr("a"))) == 0 and v(M.precision(arr("A", "a", "b"), arr("a"))) == 0.5
    assert v(M.recall(arr("a"), arr())) == 1 and v(M.recall(arr("b"), arr("a", "b"))) == 0.5
    assert v(M.recall_at(arr("x", "a", "b"), arr("a", "b"), 2)) == 0.5
    assert v(M.reciprocal_rank(arr("x", "A"), arr("a"))) == 0.5 and v(M.reciprocal_rank(arr("x"), arr("a"))) == 0 and v(M.reciprocal_rank(arr("x"), arr())) == 1
    g = F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(1))
    assert abs(v(M.ndcg(arr("a", "b"), g, 10)) - 1) < 1e-12
    # a repeated id counts once and keeps its place occupied
    assert abs(v(M.ndcg(arr("a", "a", "b"), g, 10)) - (3 + 1 / 2) / (3 + 1 / 1.584962500721156)) < 1e-9
    assert v(M.ndcg(arr("a"), F.create_map(F.lit("a"), F.lit(0)), 10)) == 1
    assert abs(v(M.confidence(F.lit("x"), F.lit(0))) - (0.5 * 0.85 * 0.05) ** (1 / 3)) < 1e-9
    assert abs(v(M.confidence(F.lit("a\n\nb"), F.lit(1))) - 0.85 ** (1 / 3)) < 1e-9
    assert v(M.refusal_category(F.lit("x"), F.lit(0))) == "OutOfScope" and v(M.refusal_category(F.lit("x"), F.lit(1))) is None
    assert v(M.refusal_correct(F.lit(True), F.lit(True), F.lit(False))) is None and v(M.refusal_correct(F.lit(True), F.lit(False), F.lit(True))) == 1
