"""Queries of the sources: payloads are made of the tables, written to the shared folder as files, and read through the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltyard.plans.registry import Registry
from tiltyard.session import scratch
from tiltyard.session import table as T
from tiltyard.sources import files, html

q = Registry()


def _captured(s: SparkSession, df: DataFrame, c: str) -> DataFrame:
    """The texts of a column as lines of files, read back: one payload per row."""
    at = scratch(s, "captured")
    df.select(F.col(c).cast("string").alias("value")).write.text(at)
    return s.read.text(at)


def _esc(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def _cat(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@q("select case when edition_label is null then 'machine' else 'alias' end as kind, opdb_id, title from (select distinct opdb_id, title, manufacturer_key, edition_label from machines)")
def source_catalog_export(s: SparkSession, d: str) -> DataFrame:
    """Exports of a maker each: an envelope of machines and aliases."""
    m = T(s, d, "machines").select("opdb_id", "title", "manufacturer_key", "edition_label").distinct()
    alias = F.col("edition_label").isNotNull()
    e = F.struct(F.col("opdb_id").alias("opdbId"), (~alias).alias("isMachine"), alias.alias("isAlias"), F.col("title").alias("name"))
    env = F.struct(F.array().cast("array<string>").alias("machineGroups"), F.collect_list(F.when(~alias, e)).alias("machines"), F.collect_list(F.when(alias, e)).alias("aliases"))
    p = m.groupBy("manufacturer_key").agg(F.to_json(env).alias("j"))
    return files.catalog_export(_captured(s, p, "j"), "value").select("kind", F.col("opdbId").alias("opdb_id"), F.col("name").alias("title"))


@q("""select opdb_id as id, array_to_string(list_filter(designers, lambda x, i: list_position(designers, x) = i), '|') as designers, case when year is null then 'S' || opdb_id when year % 2 = 0 then 'L' || opdb_id else 'M' || opdb_id end as image
    from (select distinct opdb_id, designers, year from machines)""")
def source_enrichment(s: SparkSession, d: str) -> DataFrame:
    """Enrichment entries with people out of order and images of several sizes; an older entry of the same id comes first."""
    m = T(s, d, "machines").select("opdb_id", "designers", "year").distinct()
    people = F.reverse(F.transform("designers", lambda x, i: F.struct(x.alias("name"), F.lit("design").alias("role"), i.alias("index"))))
    art = F.array(F.struct(F.lit("Someone Else").alias("name"), F.lit("art").alias("role"), F.lit(0).alias("index")))
    url = lambda x, cond: F.when(cond, _cat(x, F.col("opdb_id")))
    y = F.col("year")
    urls = lambda a, b, c: F.struct(a.alias("large"), b.alias("medium"), c.alias("small")).alias("urls")
    other = F.struct(F.lit(False).alias("primary"), urls(F.lit("other"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    img = F.array(other, F.struct(F.lit(True).alias("primary"), urls(url("L", y % 2 == 0), url("M", y.isNotNull()), url("S", F.lit(True)))))
    one = F.struct(F.col("opdb_id").alias("id"), F.lit("machine").alias("type"), F.concat(art, people).alias("people"), img.alias("images"))
    old = F.struct(F.col("opdb_id").alias("id"), F.lit("machine").alias("type"))
    p = m.select(_cat('{"entries":[', F.to_json(old), ",", F.to_json(one), "]}").alias("j"))
    r = files.enrichment(_captured(s, p, "j"), "value")
    return r.select("id", F.array_join(F.coalesce("designers", F.array().cast("array<string>")), "|").alias("designers"), "image")


@q("""select alias_id::int as tip_id, trim(opdb_group_id) as opdb_id, coalesce(nullif(trim(manufacturer_key), ''), 'general') as category, case when alias_id % 2 = 0 then length(alias) else 0 end as votes, trim(alias) as text
    from alias_entries where alias_id % 7 <> 0 and trim(coalesce(opdb_group_id, '')) <> '' and trim(coalesce(alias, '')) <> ''""")
def source_tips(s: SparkSession, d: str) -> DataFrame:
    """Tips with ids that are no numbers, blank fields, and categories and votes left out."""
    a = T(s, d, "alias_entries")
    tip = F.when(F.col("alias_id") % 7 == 0, _cat("x", F.col("alias_id").cast("string"))).otherwise(F.col("alias_id").cast("string"))
    one = F.struct(tip.alias("tipId"), F.col("opdb_group_id").alias("opdbId"), F.col("manufacturer_key").alias("category"), F.when(F.col("alias_id") % 2 == 0, F.length("alias")).alias("voteTotal"), F.col("alias").alias("text"))
    return files.tips(_captured(s, a.select(F.to_json(F.array(one)).alias("j")), "j"), "value")


@q("""select c_name || ', "' || c_mktsegment || '"' as name, c_custkey as user_id, case when c_custkey % 3 = 0 then null else c_nationkey end::bigint as ifpa_id, c_acctbal as rating from customer where c_custkey % 10 <> 0""")
def source_ratings_csv(s: SparkSession, d: str) -> DataFrame:
    """Ratings exports with quoted names; rows whose rating is no number are dropped."""
    c = T(s, d, "customer")
    rating = F.when(F.col("c_custkey") % 10 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    cols = {"Name": _cat(F.col("c_name"), ', "', F.col("c_mktsegment"), '"'), "User ID": F.col("c_custkey"), "IFPA ID": F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")), "Rating": rating, "RD": F.lit(30), "Lower Bound": F.lit(1), "Last Rating Period": F.lit("2024-01-02"), "Rating class": F.lit(1)}
    at = scratch(s, "ratings")
    c.select(*(v.alias(k) for k, v in cols.items())).write.csv(at, header=True, escape='"')
    return files.ratings_csv(s, at).select("name", "user_id", "ifpa_id", "rating", "rating_class").drop("rating_class")


def _sitemaps(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d, "documents")
    at = F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    x = _cat('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://docs.example/', F.col("source"), "/", F.col("doc_id").cast("string"), "?a=1&amp;b=2 </loc>", F.coalesce(_cat("<lastmod>", at, "</lastmod>"), F.lit("")), "</url></urlset>")
    return _captured(s, t.select(x.alias("x")), "x")


@q("""select 'https://docs.example/' || source || '/' || doc_id || '?a=1&b=2' as loc, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') as lastmod from documents where source = 'manual_archive' and lang = 'en'""")
def source_sitemap(s: SparkSession, d: str) -> DataFrame:
    """Sitemaps, one part of the site, and of it the addresses whose last part is a known handle."""
    known = T(s, d, "documents").filter("lang = 'en'").select(F.col("doc_id").cast("string").alias("h"))
    e = files.with_handles(files.sitemap(_sitemaps(s, d), "value", "/manual_archive/"), known)
    return e.select("loc", F.date_format("lastmod", "yyyy-MM-dd HH:mm:ss").alias("lastmod"))


@q("""select 'https://docs.example/' || source || '/' || doc_id || '?a=1&b=2' as loc from documents where scraped_at >= timestamp '2024-06-01' order by date_trunc('second', scraped_at) desc, loc limit 25""")
def source_newest(s: SparkSession, d: str) -> DataFrame:
    """The newest entries since a day."""
    e = files.sitemap(_sitemaps(s, d), "value")
    return files.newest(e, F.lit("2024-06-01").cast("timestamp"), 25).select("loc")


@q("""select year as id, lower(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g')) as slug, opdb_source_url as link from (select distinct opdb_id, title, year, opdb_source_url from machines) where opdb_source_url is not null""")
def source_wordpress_pages(s: SparkSession, d: str) -> DataFrame:
    m = T(s, d, "machines").select("opdb_id", "title", "year", "opdb_source_url").distinct()
    one = F.struct(F.col("year").alias("id"), F.lower(F.regexp_replace("title", "[^A-Za-z0-9]+", "-")).alias("slug"), F.col("opdb_source_url").alias("link"), F.lit("x").alias("more"))
    return files.wordpress_pages(_captured(s, m.select(F.to_json(F.array(one)).alias("j")), "j"), "value")


@q("""select p_partkey as response, p_size as category, array_to_string(range(2, case when p_partkey % 5 = 0 then 1 else p_size % 4 end + 1), ',') as pages from part""")
def source_wordpress_paging(s: SparkSession, d: str) -> DataFrame:
    """The id of a category, and the pages that a response's header leaves to fetch."""
    p = T(s, d, "part")
    one = lambda i, x: F.struct(i.alias("id"), F.lit(x).alias("slug"))
    j = p.select("p_partkey", F.to_json(F.array(one(F.lit(-1), "news"), one(F.col("p_size"), "Games"))).alias("j"), F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(_cat(" ", (F.col("p_size") % 4).cast("string"))).alias("total"))
    ids = j.select("p_partkey", F.filter(F.from_json("j", "array<struct<id:int,slug:string>>"), lambda c: F.lower(c["slug"]) == "games")[0]["id"].alias("category"))
    assert files.wordpress_category(j.limit(1), "j", "games").count() == 1
    return j.join(ids, "p_partkey").select(F.col("p_partkey").alias("response"), "category", F.array_join(F.transform(files.further_pages(F.col("total")), lambda n: n.cast("string")), ",").alias("pages"))


@q("""select p_partkey::varchar as handle, p_name as title, p_brand as vendor, p_retailprice as price, p_size % 2 = 0 as available from part""")
def source_shop_products(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "part")
    v = lambda c, a: F.struct(c.cast("string").alias("price"), a.alias("available"))
    one = F.struct(F.col("p_partkey").cast("string").alias("handle"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), F.array(v(F.col("p_retailprice") + 10, F.lit(False)), v(F.col("p_retailprice"), F.col("p_size") % 2 == 0)).alias("variants"))
    return files.shop_products(_captured(s, p.select(F.to_json(F.struct(F.array(one).alias("products"))).alias("j")), "j"), "value")


@q("""select 'p' || p_partkey as slug, p_name as title, case when p_size % 9 = 0 then null else round(p_retailprice, 2) end as price, p_size % 2 = 0 as available, 'Made by ' || p_brand as description from part""")
def source_store_products(s: SparkSession, d: str) -> DataFrame:
    """Products of a store interface: prices in minor units, none where they are zero; descriptions in markup."""
    cents = F.when(F.col("p_size") % 9 == 0, F.lit("0")).otherwise(F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string"))
    one = F.struct(F.col("p_name").alias("name"), _cat("https://shop.example/product/p", F.col("p_partkey").cast("string"), "/").alias("permalink"), (F.col("p_size") % 2 == 0).alias("is_in_stock"), _cat("<p>Made by <b>", F.col("p_brand"), "</b></p>").alias("description"), F.struct(cents.alias("price"), F.lit(2).alias("currency_minor_unit")).alias("prices"))
    j = _captured(s, T(s, d, "part").select(F.to_json(F.array(one)).alias("j")), "j")
    return files.store_products(j, "value").select("slug", "title", "price", "available", "description")


def _pages(s: SparkSession, d: str) -> DataFrame:
    """(id, url, html): a page per machine with structured data, metadata, links, videos and prose."""
    m = T(s, d, "machines").groupBy("opdb_id").agg(F.first("title").alias("title"), F.max("year").alias("year"), F.max("manufacturer").alias("maker"))
    goods = F.struct(F.array(F.lit("Thing"), F.lit("Product")).alias("@type"), F.col("title").alias("name"), F.array(F.struct(F.array(F.struct(F.col("year").cast("string").alias("price"))).alias("priceSpecification"))).alias("offers"))
    product = _cat('{"@graph":[{"@type":"WebPage","datePublished":"2021-02-03"},', F.to_json(goods), "]}")
    t = _esc(F.col("title"))
    head = _cat("<html><head><title>Fallback</title>", F.when(F.col("year").isNotNull(), _cat('<meta property="og:title" content="', t, ' page">')).otherwise(F.lit("")), '<meta name="twitter:title" content="Bird ', t, '"><link rel="canonical" href="https://games.example/', F.col("opdb_id"), '"><script type="application/ld+json">{broken</script><script type="application/ld+json">', product, "</script></head>")
    body = _cat("<body><nav><p>We use cookies to make this site better for all of its visitors.</p></nav><main><h2>About ", t, "</h2><p>", t, " was made by ", _esc(F.col("maker")), " and is a game of skill for one to four players.</p><p>Short.</p><p>By going on you accept every cookie that this site may send to you.</p>")
    links = _cat('<iframe src="https://www.youtube.com/embed/', F.rpad(F.regexp_replace("opdb_id", "[^A-Za-z0-9]", "_"), 11, "x"), '?rel=0"></iframe><a href="/files/', F.col("opdb_id"), '.PDF">Manual</a><a href="/files/', F.col("opdb_id"), '.pdf">Again</a><a href="/', F.col("opdb_id"), '/pro/">Pro</a><a href="?variant=Premium">v</a>')
    shop = _cat('<a href="https://shop.example/collections/', F.col("opdb_id"), '">All</a><a href="https://shop.example/products/topper"><img src="t.png"><span>$99</span><span>Topper</span></a><a href="https://shop.example/products/topper"><span>Twice</span></a><a href="https://shop.example/products/none"><span></span></a></main><p>A footer paragraph that stands outside of the main element of the page.</p></body></html>')
    p = m.select(F.to_json(F.struct(F.col("opdb_id").alias("id"), _cat("https://games.example/", F.col("opdb_id")).alias("url"), _cat(head, body, links, shop).alias("html"))).alias("j"))
    return _captured(s, p, "j").select(F.from_json("value", "id string, url string, html string").alias("p")).select("p.*")


_M = "(select opdb_id, first(title) title, max(year) as year, max(manufacturer) maker from machines group by 1)"


@q(f"""select opdb_id as id, case when year is null then 'Bird ' || title else title || ' page' end as title, '2021-02-03' as published, 'https://games.example/' || opdb_id as canonical, title as product, year::double as price, 'Premium' as editions from {_M}""")
def source_page_metadata(s: SparkSession, d: str) -> DataFrame:
    """Title, date, address and the first product of structured data of captured pages; broken scripts are passed over."""
    return html.metadata(_pages(s, d), "id", "html").select("id", "title", "published", "canonical", "product", "price", F.array_join("editions", ",").alias("editions"))


@q(f"""select opdb_id as id, title || ' was made by ' || maker || ' and is a game of skill for one to four players.' as overview, 'https://www.youtube.com/watch?v=' || rpad(regexp_replace(opdb_id, '[^A-Za-z0-9]', '_', 'g'), 11, 'x') as trailer,
    'https://shop.example/collections/' || opdb_id as shop_link, 'Topper $99 t.png' as accessories, 'pro' as subpages from {_M}""")
def source_game_content(s: SparkSession, d: str) -> DataFrame:
    """Prose, video, shop link, accessories and sub-pages of captured pages."""
    g = html.game_content(_pages(s, d), "id", "html", "shop.example", "id")
    goods = F.array_join(F.transform("accessories", lambda a: F.concat_ws(" ", a["name"], a["price"], a["image"])), ",")
    return g.select("id", "overview", "trailer", "shop_link", goods.alias("accessories"), F.array_join("subpages", ",").alias("subpages"))


@q(f"select opdb_id as id, 'https://games.example/files/' || opdb_id || '.PDF' as href, 'Manual' as text from {_M}")
def source_page_links(s: SparkSession, d: str) -> DataFrame:
    """Documents that pages link to, absolute, of the allowed host, once."""
    return html.links(_pages(s, d), "id", "url", "html", (".pdf",), ("games.example",)).select("id", "href", "text")


@q(f"""select opdb_id as id, '# ' || title || chr(10) || chr(10) || 'By ' || maker || chr(10) || chr(10) || 'Source: https://games.example/' || opdb_id || chr(10) || chr(10) || 'We use cookies to make this site better for all of its visitors.' || chr(10) || chr(10) || '## About ' || title || chr(10) || chr(10)
    || title || ' was made by ' || maker || ' and is a game of skill for one to four players.' as start from {_M}""")
def source_article(s: SparkSession, d: str) -> DataFrame:
    """Articles as attributed text with their headings marked; here, all up to the end of the first sentence of prose."""
    m = T(s, d, "machines").groupBy(F.col("opdb_id").alias("id")).agg(F.first("title").alias("name"), F.max("manufacturer").alias("maker"))
    b = html.metadata(_pages(s, d), "id", "html").join(m, "id")
    text = html.attributed(F.col("name"), F.col("maker"), F.col("canonical"), F.col("body"))
    return b.select("id", F.regexp_extract(text, r"(?s)^(.*?one to four players\.)", 1).alias("start"))


@q("""with c as (select chunk_id, content a, coalesce(section_heading, '') || coalesce(content, '') b, token_count from chunks), s as (select *, case when token_count > 250 then 'SizeExceeded' when a is null then 'Malformed' when length(trim(a)) < 300 then 'OcrRequired' else 'Success' end st from c)
    select distinct chunk_id, case when st = 'OcrRequired' then 'Success' else st end as status, case when st = 'OcrRequired' then b else a end as text, case when st = 'OcrRequired' then 'fallback' else 'primary' end as extractor from s""")
def source_extraction(s: SparkSession, d: str) -> DataFrame:
    """How extractions ended, and the second extractor's text where the first found hardly any (here: less than 300 characters)."""
    c = T(s, d, "chunks")
    st = files.extraction_status(F.col("content"), F.lit(False), F.col("token_count"), 250, 300)
    other = F.concat(F.coalesce("section_heading", F.lit("")), F.coalesce("content", F.lit("")))
    r = c.select("chunk_id", files.with_fallback(st, F.col("content"), F.lit("Success"), other).alias("r")).distinct()
    return r.select("chunk_id", F.col("r.status").alias("status"), F.col("r.text").alias("text"), F.col("r.by").alias("extractor"))


@q("""with p as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from documents where text is not null), o as (select doc_id, title t, 1 page, 0 lv, 0 k from documents where text is not null union all select doc_id, document_type, 2, 1, 1 from documents where text is not null)
    select doc_id, (select count(*) from p where p.doc_id = d.doc_id)::int as pages, (select string_agg(trim(t) || '@' || page || '/' || lv, ',' order by k) from o where o.doc_id = d.doc_id and trim(coalesce(t, '')) <> '') as outline from documents d where text is not null""")
def source_pages_and_outline(s: SparkSession, d: str) -> DataFrame:
    """Pages of extracted documents (here: their lines) and their outline, flattened."""
    t = T(s, d, "documents").filter("text is not null")
    item = F.array(F.struct(F.col("document_type").alias("title"), F.lit(2).alias("page")))
    o = files.flat_outline(F.array(F.struct(F.col("title").alias("title"), F.lit(1).alias("page"), item.alias("items"))))
    shown = F.array_join(F.transform(o, lambda x: F.concat(x["title"], F.lit("@"), x["page_number"].cast("string"), F.lit("/"), x["level"].cast("string"))), ",")
    return t.select("doc_id", F.size(files.page_texts(F.split("text", "\n"))).alias("pages"), F.nullif(shown, F.lit("")).alias("outline"))


@q("select item_id as id, text from heldout_items")
def source_json_lines(s: SparkSession, d: str) -> DataFrame:
    """Records of JSON lines between comments and blank lines."""
    h = T(s, d, "heldout_items").select(F.explode(F.array(F.lit("# a comment"), F.lit("  "), F.to_json(F.struct(F.col("item_id").alias("id"), "text")))).alias("l"))
    return files.json_lines(_captured(s, h, "l"), "value", "id long, text string")


@q("""with a as (select alias_id::varchar k, opdb_group_id g, machine_id m from alias_entries) select 'duplicate' as problem, k as key from a group by k having count(*) > 1 or k is null
    union all select 'reference:opdb_group_id', k from a where g is not null and g not in (select group_id from machines where group_id is not null) union all select 'exactly_one', k from a where (g is not null)::int + (m is not null)::int <> 1""")
def source_seed_problems(s: SparkSession, d: str) -> DataFrame:
    """What a check of the curated aliases finds: repeated ids, references to no group, rows that name not exactly one target."""
    a = T(s, d, "alias_entries").select("alias_id", "opdb_group_id", "machine_id")
    g = T(s, d, "machines").filter("group_id is not null").select("group_id")
    return files.seed_problems(a, "alias_id", {"opdb_group_id": g}, ["opdb_group_id", "machine_id"])


@q("select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey, (values (1)) v(x) union all select -1, 'false,true,false'")
def source_cached(s: SparkSession, d: str) -> DataFrame:
    """A source behind a copy of limited age: made, taken from the copy, and made anew once that is too old."""
    at, load = scratch(s, "cache"), lambda: T(s, d, "customer").join(T(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")
    hit = []
    for now in (1000.0, 1050.0, 1200.0):
        r, h = files.cached(s, at, 100.0, load, now)
        hit.append(str(h).lower())
    return r.unionByName(s.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit(",".join(hit)).alias("n_name")))


@q("""with u as (select distinct '/' || source || '/' || doc_id || case when doc_id % 3 = 0 then '.pdf' when doc_id % 3 = 1 then '.pdf?x=1' else '' end p, source, doc_id from documents)
    select p as path, case when doc_id % 3 = 0 then source = 'manual_archive' else source not in ('news_scrape', 'forum_dump') or (source = 'news_scrape' and doc_id::varchar like '1%') end as allowed from u""")
def source_robots(s: SparkSession, d: str) -> DataFrame:
    """Paths that robots rules allow: the longest rule decides, wildcards and ends included."""
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /news_scrape/\nAllow: /news_scrape/1*\nDisallow: /forum_dump\nDisallow: /*.pdf$ # all\nAllow: /manual_archive/*.pdf$\nDisallow: /news_scrape/*.pdf$\n"
    rules = files.robots_rules(s.createDataFrame([("h", body)], "host string, body string"), "host", "body")
    t = T(s, d, "documents")
    i = F.col("doc_id") % 3
    path = _cat("/", F.col("source"), "/", F.col("doc_id").cast("string"), F.when(i == 0, ".pdf").when(i == 1, ".pdf?x=1").otherwise(""))
    u = t.select(F.lit("h").alias("host"), path.alias("path")).distinct()
    return files.robots_allowed(u, "host", "path", rules, "reader").select("path", "allowed")


@q("select 'https://p.example/' || event_id as url, round((user_id % 101) , 2)::double as performance, case when event_id % 4 = 0 then null else 50.0 end::double as seo from events")
def source_lighthouse(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events")
    cats = F.struct(F.struct(((F.col("user_id") % 101) / 100).alias("score")).alias("performance"), F.struct(F.when(F.col("event_id") % 4 != 0, 0.5).alias("score")).alias("seo"))
    j = e.select(F.to_json(F.struct(_cat("https://p.example/", F.col("event_id").cast("string")).alias("finalUrl"), cats.alias("categories"))).alias("j"))
    return files.lighthouse(_captured(s, j, "j"), "value").select("url", "performance", "seo")


@q("""with e as (select case event_id % 3 when 0 then event_type when 1 then 'ctx ' || event_type else 'unknown' end r, case when user_id % 2 = 0 then 'job' || user_id end j, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') f from events)
    select r as rule, j as job, substr(f, 1, 10) as day, substr(sha256(r || '|' || coalesce(j, '') || '|' || f), 1, 16) as alert_id from e""")
def source_alerts(s: SparkSession, d: str) -> DataFrame:
    """Alerts of webhook payloads: the first rule name given, a dimension by its name, an id that repeats share."""
    e = T(s, d, "events")
    k = F.col("event_id") % 3
    dims = F.array(F.struct(F.lit("region").alias("name"), F.lit("x").alias("value")), F.struct(F.when(F.col("user_id") % 2 == 0, "job").otherwise("task").alias("name"), _cat("job", F.col("user_id").cast("string")).alias("value")))
    ctx = F.struct(F.when(k == 1, _cat("ctx ", F.col("event_type"))).alias("name"), F.struct(F.array(F.struct(dims.alias("dimensions"))).alias("allOf")).alias("condition"))
    ess = F.struct(F.when(k == 0, F.col("event_type")).alias("alertRule"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("firedDateTime"))
    j = e.select(F.to_json(F.struct(F.struct(ess.alias("essentials"), ctx.alias("alertContext")).alias("data"))).alias("j"))
    a = files.alert_webhook(_captured(s, j, "j"), "value")
    return a.select("rule", "job", F.date_format("fired_at", "yyyy-MM-dd").alias("day"), "alert_id")


QUERIES, ORACLE = q.queries, q.oracle
