"""Sources of records in JSON, CSV, JSON lines and XML, parsed with Spark's readers and expressions."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltyard.functions import text as X
from tiltyard.session import committed

CATALOG_ENTRY = """opdbId string, isMachine boolean, isAlias boolean, name string, commonName string, manufacturer struct<manufacturerId:int,name:string,fullName:string>, manufactureDate string,
    type string, designers array<struct<personId:int,name:string>>, keywords array<string>, features array<string>, updatedAt string, ipdbId int"""
CATALOG = f"machineGroups array<struct<opdbId:string,name:string>>, machines array<struct<{CATALOG_ENTRY.replace(' string', ':string').replace(' boolean', ':boolean').replace(' int', ':int').replace(' struct', ':struct').replace(' array', ':array')}>>, aliases array<struct<{CATALOG_ENTRY.replace(' string', ':string').replace(' boolean', ':boolean').replace(' int', ':int').replace(' struct', ':struct').replace(' array', ':array')}>>"


def catalog_export(df: DataFrame, json: str) -> DataFrame:
    """Rows of an envelope {machineGroups, machines, aliases}: machines first, then aliases, with kind and ordinal.

    Fails where an envelope holds neither machines nor aliases, so that an empty download can't empty the catalogue.
    """
    d = df.select(F.from_json(json, CATALOG).alias("j")).select("j.*")
    n = F.coalesce(F.size("machines"), F.lit(0)) + F.coalesce(F.size("aliases"), F.lit(0))
    checked = d.withColumn("_ok", F.when(n > 0, F.lit(True)).otherwise(F.raise_error(F.lit("the export holds no machines and no aliases")).cast("boolean"))).filter("_ok")
    one = lambda c, k: checked.select(F.posexplode(c).alias("ordinal", "r")).select(F.lit(k).alias("kind"), "ordinal", "r.*")
    return one("machines", "machine").unionByName(one("aliases", "alias"))


def tips(df: DataFrame, json: str) -> DataFrame:
    """Tips from arrays of {tipId, opdbId, category, voteTotal, text}: rows without a whole id, opdbId or text are skipped; category 'general', votes 0 by default."""
    a = df.select(F.explode(F.from_json(json, "array<struct<tipId:string,opdbId:string,category:string,voteTotal:string,text:string>>")).alias("t")).select("t.*")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = a.select(F.col("tipId").try_cast("int").alias("tip_id"), blank("opdbId").alias("opdb_id"), F.coalesce(blank("category"), F.lit("general")).alias("category"), F.coalesce(F.col("voteTotal").try_cast("int"), F.lit(0)).alias("votes"), blank("text").alias("text"))
    return out.filter("tip_id is not null and opdb_id is not null and text is not null")


def enrichment(df: DataFrame, json: str) -> DataFrame:
    """Enrichment entries: people of a role in order of their index, distinct; the primary image, else the first, large before medium before small; the last entry of an id wins."""
    schema = "entries array<struct<id:string,type:string,people:array<struct<name:string,role:string,index:int>>,images:array<struct<primary:boolean,urls:struct<large:string,medium:string,small:string>>>>>"
    e = df.select(F.posexplode(F.from_json(json, schema)["entries"]).alias("pos", "e")).filter("e.type = 'machine' and e.id is not null")
    people = F.array_distinct(F.transform(F.array_sort(F.transform(F.filter("e.people", lambda p: p["role"] == "design"), lambda p: F.struct(p["index"], p["name"]))), lambda p: p["name"]))
    image = F.coalesce(F.try_element_at(F.filter("e.images", lambda i: i["primary"]), F.lit(1)), F.try_element_at("e.images", F.lit(1)))["urls"]
    r = e.select(F.col("e.id").alias("id"), "pos", people.alias("designers"), F.coalesce(image["large"], image["medium"], image["small"]).alias("image"))
    return r.groupBy("id").agg(F.max_by(F.struct("designers", "image"), "pos").alias("r")).select("id", "r.*")


def json_lines(df: DataFrame, line: str, schema: str) -> DataFrame:
    """Records of JSON lines with comments (#) and blank lines; a malformed line fails the read."""
    t = df.filter((F.trim(line) != "") & ~F.startswith(F.ltrim(line), F.lit("#")))
    return t.select(F.from_json(line, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def seed_problems(df: DataFrame, key: str, refs: dict[str, DataFrame] | None = None, exactly_one: list[str] | None = None) -> DataFrame:
    """(problem, key) of a seed table: repeated keys, references to no record, rows without exactly one of some fields."""
    out = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).filter("n > 1 or key is null").select(F.lit("duplicate").alias("problem"), "key")
    for c, parent in (refs or {}).items():
        p = parent.select(F.col(parent.columns[0]).alias(c)).distinct()
        out = out.unionByName(df.filter(F.col(c).isNotNull()).join(p, c, "left_anti").select(F.lit(f"reference:{c}").alias("problem"), F.col(key).cast("string").alias("key")))
    if exactly_one:
        n = sum((F.col(c).isNotNull().cast("int") for c in exactly_one), F.lit(0))
        out = out.unionByName(df.filter(n != 1).select(F.lit("exactly_one").alias("problem"), F.col(key).cast("string").alias("key")))
    return out


def ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ratings exports as typed rows; the header must name 'User ID', and a file set without rows is an error."""
    schema = "name string, user_id long, ifpa_id long, rating double, rd double, lower_bound double, last_rating_period date, rating_class int"
    head = spark.read.text(path).filter(F.col("value").contains("User ID")).limit(1).count()
    if not head:
        raise ValueError("no header with 'User ID'")
    df = spark.read.csv(path, schema=schema, header=True, escape='"', mode="DROPMALFORMED", enforceSchema=True)
    return df.filter("user_id is not null")


def sitemap(df: DataFrame, xml: str, contains: str = "") -> DataFrame:
    """(loc, lastmod) of the entries of sitemaps or sitemap indexes, in order, whose address contains a part."""
    body = F.regexp_replace(xml, r"xmlns(:\w+)?=\"[^\"]*\"", "")
    item = F.regexp_extract_all(body, F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))
    e = df.select(F.posexplode(item).alias("pos", "x"))
    loc = F.trim(F.regexp_extract("x", r"(?s)<loc>\s*(.*?)\s*</loc>", 1))
    loc = F.replace(loc, F.lit("&amp;"), F.lit("&"))
    out = e.select("pos", loc.alias("loc"), F.try_to_timestamp(F.nullif(F.regexp_extract("x", r"(?s)<lastmod>\s*(.*?)\s*</lastmod>", 1), F.lit(""))).alias("lastmod"))
    return out.filter((F.col("loc") != "") & F.col("loc").contains(contains))


def with_handles(entries: DataFrame, handles: DataFrame) -> DataFrame:
    """Entries whose last path segment is one of the handles (first column, compared without regard to case)."""
    h = handles.select(F.lower(F.col(handles.columns[0])).alias("_h")).filter("_h is not null").distinct()
    last = F.lower(F.regexp_extract("loc", r"([^/?#]+)/?(?:[?#].*)?$", 1))
    return entries.withColumn("_h", last).join(h, "_h", "left_semi").drop("_h")


def newest(entries: DataFrame, since: Column, n: int) -> DataFrame:
    """Entries modified at or after a time, newest first, n of them."""
    return entries.filter(F.col("lastmod") >= since).orderBy(F.desc("lastmod"), "loc").limit(n)


def wordpress_category(df: DataFrame, json: str, slug: str) -> DataFrame:
    """(id) of the category of a slug in a response of categories; no row where there is none."""
    c = df.select(F.inline(F.from_json(json, "array<struct<id:int,slug:string>>")))
    return c.filter((F.lower("slug") == slug.lower()) & F.col("id").isNotNull()).select("id").distinct()


def further_pages(total: Column) -> Column:
    """The pages still to fetch after the first, by the header with their number; none where it is missing or no number."""
    n = F.coalesce(F.trim(total).try_cast("int"), F.lit(1))
    return F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))


def wordpress_pages(df: DataFrame, json: str) -> DataFrame:
    """(id, slug, link) of responses of pages or posts; entries without a link are skipped."""
    return df.select(F.inline(F.from_json(json, "array<struct<id:int,slug:string,link:string>>"))).filter("link is not null")


def shop_products(df: DataFrame, json: str) -> DataFrame:
    """Products of a shop's JSON with their lowest price."""
    p = df.select(F.explode(F.from_json(json, "products array<struct<handle:string,title:string,vendor:string,variants:array<struct<title:string,price:string,available:boolean>>>>")["products"]).alias("p")).select("p.*")
    return p.select("handle", "title", "vendor", F.array_min(F.transform("variants", lambda v: v["price"].try_cast("double"))).alias("price"), F.exists("variants", lambda v: F.coalesce(v["available"], F.lit(False))).alias("available"))


def store_products(df: DataFrame, json: str) -> DataFrame:
    """Products of a store interface: slug from the last segment of the address, price in units of its currency (null where it is
    not positive), text of the description without markup; products without an address are skipped."""
    schema = "array<struct<name:string,permalink:string,is_in_stock:boolean,short_description:string,description:string,prices:struct<price:string,currency_minor_unit:int>,images:array<struct<src:string>>>>"
    p = df.select(F.inline(F.from_json(json, schema))).filter("permalink is not null")
    raw = F.col("prices.price").try_cast("double")
    slug = F.regexp_extract("permalink", r"([^/]+)/*$", 1)
    text = X.strip_html(F.coalesce("short_description", "description"))
    images = F.filter(F.transform("images", lambda i: F.trim(i["src"])), lambda x: x != "")
    price = F.when(raw > 0, F.round(raw / F.pow(F.lit(10.0), F.coalesce("prices.currency_minor_unit", F.lit(0))), 2))
    return p.select(slug.alias("slug"), F.col("name").alias("title"), "permalink", price.alias("price"), F.coalesce("is_in_stock", F.lit(False)).alias("available"), text.alias("description"), images.alias("images"))


def lighthouse(df: DataFrame, json: str) -> DataFrame:
    """Scores of a page report, out of 100."""
    score = lambda c: F.round(F.get_json_object(json, f"$.categories.{c}.score").cast("double") * 100, 2)
    return df.select(F.get_json_object(json, "$.finalUrl").alias("url"), score("performance").alias("performance"), score("accessibility").alias("accessibility"), score("seo").alias("seo"))


def alert_webhook(df: DataFrame, json: str) -> DataFrame:
    """Alerts from webhook payloads: first rule name that is given, dimension looked up in nested arrays, an id of 16 hex digits that a repeat shares."""
    get = lambda p: F.get_json_object(json, p)
    rule = F.coalesce(get("$.data.essentials.alertRule"), get("$.data.alertContext.name"), get("$.data.context.name"), F.lit("unknown"))
    dims = F.from_json(get("$.data.alertContext.condition.allOf[0].dimensions"), "array<struct<name:string,value:string>>")
    dim = F.try_element_at(F.filter(dims, lambda x: x["name"] == "job"), F.lit(1))["value"]
    fired = F.coalesce(get("$.data.essentials.firedDateTime"), F.lit(""))
    return df.select(rule.alias("rule"), dim.alias("job"), F.try_to_timestamp(fired).alias("fired_at"), F.substring(F.sha2(F.concat_ws("|", rule, F.coalesce(dim, F.lit("")), fired), 256), 1, 16).alias("alert_id"))


def extraction_status(text: Column, encrypted: Column, size: Column, cap: int = 50_000_000, least: int = 32) -> Column:
    """How the extraction of a document ended: too large, encrypted, malformed (no text at all), in need of OCR (hardly any), or fine."""
    return F.when(size > cap, "SizeExceeded").when(encrypted, "Encrypted").when(text.isNull(), "Malformed").when(F.length(F.trim(text)) < least, "OcrRequired").otherwise("Success")


def with_fallback(status: Column, text: Column, other_status: Column, other_text: Column) -> Column:
    """struct(status, text, by): the first extraction, or the second where the first says that it needs OCR."""
    need = F.coalesce(status == "OcrRequired", F.lit(False))
    return F.struct(F.when(need, other_status).otherwise(status).alias("status"), F.when(need, other_text).otherwise(text).alias("text"), F.when(need, "fallback").otherwise("primary").alias("by"))


def page_texts(pages: Column) -> Column:
    """array<struct<page_number,text>> of the texts of pages in order."""
    return F.transform(pages, lambda t, i: F.struct((i + 1).alias("page_number"), F.coalesce(t, F.lit("")).alias("text")))


def flat_outline(outline: Column) -> Column:
    """An outline of two levels, array<struct<title,page,items:array<struct<title,page>>>>, as array<struct<title,page_number,level>>, in
    order; entries without a title are skipped."""
    one = lambda x, n: F.struct(F.trim(x["title"]).alias("title"), x["page"].alias("page_number"), F.lit(n).alias("level"))
    flat = F.flatten(F.transform(outline, lambda o: F.concat(F.array(one(o, 0)), F.transform(F.coalesce(o["items"], F.array().cast("array<struct<title:string,page:int>>")), lambda i: one(i, 1)))))
    return F.filter(flat, lambda x: F.coalesce(x["title"], F.lit("")) != "")


def cached(spark: SparkSession, path: str, seconds: float, load: Callable[[], DataFrame], now: float | None = None) -> tuple[DataFrame, bool]:
    """(table, taken from the cache): the last complete copy under path where it is younger than `seconds`, else a new one made by load.

    Copies are named by the time they were made; a copy that was not written to the end does not count.
    """
    t = time.time() if now is None else now
    done = committed(spark, path)
    if done and t - done[-1] / 1000 < seconds:
        return spark.read.parquet(f"{path}/v={done[-1]}"), True
    at = f"{path}/v={int(t * 1000)}"
    load().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at), False


def robots_rules(df: DataFrame, host: str, body: str) -> DataFrame:
    """(host, agent, allow, pattern) of robots.txt bodies; a group of agent lines shares the rules below it."""
    lines = df.select(host, F.posexplode(F.split(body, r"\r?\n")).alias("pos", "l"))
    kv = lines.select(host, "pos", F.lower(F.trim(F.split_part(F.col("l"), F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(F.regexp_extract("l", r"^[^:]*:(.*)$", 1), "#.*$", "")).alias("v")).filter(F.col("k").isin("user-agent", "allow", "disallow"))
    from pyspark.sql import Window as W

    w = W.partitionBy(host).orderBy("pos")
    start = ((F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")).cast("int")
    g = kv.withColumn("_s", start).withColumn("g", F.sum("_s").over(w))
    agents = g.filter("k = 'user-agent'").select(host, "g", F.lower("v").alias("agent"))
    rules = g.filter("k <> 'user-agent' and v <> ''").select(host, "g", (F.col("k") == "allow").alias("allow"), F.col("v").alias("pattern"))
    return agents.join(rules, [host, "g"]).select(host, "agent", "allow", "pattern")


def robots_allowed(urls: DataFrame, host: str, path: str, rules: DataFrame, agent: str) -> DataFrame:
    """urls with allowed: the longest matching rule decides, allow on ties; rules for the agent replace those for *; no rule allows."""
    own = rules.filter(F.col("agent") == agent.lower()).select(host).distinct()
    use = rules.filter(F.col("agent") == agent.lower()).unionByName(rules.filter("agent = '*'").join(own, host, "left_anti"))
    rx = F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*"), r"(?<!\$)$", "")
    rx = F.concat(F.lit("^"), rx)
    u = urls.join(use.withColumn("_rx", rx), host, "left").withColumn("_hit", F.coalesce(F.rlike(F.col(path), F.col("_rx")), F.lit(False)))
    g = u.groupBy(host, path).agg(F.max_by("allow", F.when(F.col("_hit"), F.struct(F.length("pattern").alias("n"), F.col("allow").alias("a")))).alias("allowed"))
    return g.select(host, path, F.coalesce("allowed", F.lit(True)).alias("allowed"))
