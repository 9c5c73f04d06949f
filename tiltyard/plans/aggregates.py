"""Queries for aggregations, text functions, evaluation metrics, retrieval and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tiltyard.functions import metrics as M
from tiltyard.functions import text as X
from tiltyard.operators import chunker, retrieval, rollup
from tiltyard.plans.registry import Registry
from tiltyard.session import table as T

q = Registry()


# ---- aggregations


@q("""select manufacturer_key, machine_id, sum(n)::int as doc_count, bool_or(k = 'manual') as has_manual, string_agg(k || '=' || n, ',' order by k) as counts
    from (select manufacturer as manufacturer_key, machine_id, lower(document_type) k, count(*) n from scraped_changes where machine_id is not null and document_type is not null group by all) group by 1, 2""")
def nested_rollup(s: SparkSession, d: str) -> DataFrame:
    """Counts per document type of each machine, nested per maker, then flattened to be compared."""
    c = T(s, d, "scraped_changes").filter("machine_id is not null and document_type is not null")
    r = rollup.nested(c.withColumnRenamed("manufacturer", "manufacturer_key"), "manufacturer_key", "machine_id", "document_type")
    e = r.select("manufacturer_key", F.explode("members").alias("m"))
    counts = F.array_join(F.transform(F.sort_array(F.map_entries("m.counts")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return e.select("manufacturer_key", "m.machine_id", "m.doc_count", "m.has_manual", counts.alias("counts"))


@q("""select manufacturer, machine_id, count(*) as docs from scraped_changes where machine_id is not null group by 1, 2""")
def incremental_rollup(s: SparkSession, d: str) -> DataFrame:
    """A rollup of the older half with the entries of touched machines recomputed: equals the rollup of all."""
    c = T(s, d, "scraped_changes").filter("machine_id is not null").select("manufacturer", "machine_id", "change_id")
    count = lambda x: x.groupBy("manufacturer", "machine_id").agg(F.count("*").alias("docs"))
    touched = c.filter("change_id % 2 = 1").select("manufacturer", "machine_id").distinct()
    key = [c["manufacturer"].eqNullSafe(touched["manufacturer"]), c["machine_id"] == touched["machine_id"]]
    return rollup.replace_entries(count(c.filter("change_id % 2 = 0")).filter("manufacturer is not null"), count(c.join(touched, key, "left_semi")), "manufacturer", "machine_id")


@q("""select coalesce(slice_name, '(unsliced)') as slice, count(*) as results, round(avg(citation_precision), 6) as mean_precision, count(citation_precision) as precision_n, round(avg(duration_ms), 6) as mean_ms, count(duration_ms) as ms_n, count(error) as errors from eval_answers group by 1
    union all select '(all)', count(*), round(avg(citation_precision), 6), count(citation_precision), round(avg(duration_ms), 6), count(duration_ms), count(error) from eval_answers""")
def means_by_slice(s: SparkSession, d: str) -> DataFrame:
    """Means with their own denominators, per slice and over all: grouping sets in one pass."""
    e = T(s, d, "eval_answers").withColumn("slice", F.coalesce("slice_name", F.lit("(unsliced)")))
    g = e.groupingSets([[F.col("slice")], []], F.col("slice")).agg(
        F.count("*").alias("results"), F.round(F.avg("citation_precision"), 6).alias("mean_precision"), F.count("citation_precision").alias("precision_n"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.count("duration_ms").alias("ms_n"), F.count("error").alias("errors"), F.grouping("slice").alias("g")
    )
    return g.withColumn("slice", F.when(F.col("g") == 1, "(all)").otherwise(F.col("slice"))).drop("g")


@q("select opdb_id, count(*) as rows from machines group by 1 having count(*) > 1")
def duplicate_ids(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "machines").groupBy("opdb_id").agg(F.count("*").alias("rows")).filter("rows > 1")


@q("select coalesce(document_type, '(none)') as document_type, count(*) as chunks, count(distinct document_id) as documents, max(last_scraped_utc) as newest from chunks group by 1")
def corpus_facets(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "chunks").groupBy(F.coalesce("document_type", F.lit("(none)")).alias("document_type")).agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"), F.max("last_scraped_utc").alias("newest"))


@q("""select manufacturer_key, count(*) as cells, count(*) filter (n > 0) as covered, count(*) filter (n = 0) as gaps from (select m.manufacturer_key, m.opdb_id, count(s.change_id) n from (select distinct manufacturer_key, opdb_id from machines) m
    left join scraped_changes s on s.machine_id = m.opdb_id group by 1, 2) group by 1""")
def coverage_report(s: SparkSession, d: str) -> DataFrame:
    m = T(s, d, "machines").select("manufacturer_key", "opdb_id").distinct()
    c = T(s, d, "scraped_changes").filter("machine_id is not null").groupBy(F.col("machine_id").alias("opdb_id")).agg(F.count("*").alias("n"))
    j = m.join(c, "opdb_id", "left")
    return j.groupBy("manufacturer_key").agg(F.count("*").alias("cells"), F.count_if(F.expr("n > 0")).alias("covered"), F.count_if(F.expr("n is null")).alias("gaps"))


@q("select coalesce(skip_reason, 'Indexed') as outcome, count(*) as documents, sum(chunk_count) as chunks from index_state group by 1")
def outcome_counters(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "index_state").groupBy(F.coalesce("skip_reason", F.lit("Indexed")).alias("outcome")).agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"))


@q("""select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as bucket, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, count(*) as n from events group by 1""")
def percentiles_by_hour(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").groupBy(F.date_format(rollup.time_bucket(F.col("ts"), "1 hour"), "yyyy-MM-dd HH:mm").alias("bucket"))
    return e.agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.count("*").alias("n"))


@q("""select strftime(time_bucket(interval '10 minutes', ts), '%Y-%m-%d %H:%M') as bucket, count(*) filter (event_type = 'error') as errors, round(count(*) filter (event_type = 'error')::double / count(*), 6) as rate from events group by 1""")
def error_rate_10min(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").groupBy(F.date_format(rollup.time_bucket(F.col("ts"), "10 minutes"), "yyyy-MM-dd HH:mm").alias("bucket"))
    return e.agg(F.count_if(F.expr("event_type = 'error'")).alias("errors"), F.round(rollup.ratio(F.count_if(F.expr("event_type = 'error'")), F.count("*")), 6).alias("rate"))


@q("""select c.event_type, coalesce(sum(e.n), 0)::bigint as n from (select unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) event_type) c left join (select event_type, count(*) n from events group by 1) e using (event_type) group by 1""")
def category_zero_fill(s: SparkSession, d: str) -> DataFrame:
    cats = s.createDataFrame([(x,) for x in ("click", "error", "purchase", "refund", "signup", "view")], "event_type string")
    return rollup.zero_filled(cats, T(s, d, "events").withColumn("one", F.lit(1).cast("bigint")), "event_type", F.col("one"), "n")


@q("""select strftime(ts, '%Y-%m-%d') as day, event_type as model, round(sum(value * case event_type when 'click' then 0.25 when 'view' then 0.5 else 0 end), 4) as cents from events group by 1, 2""")
def daily_cost(s: SparkSession, d: str) -> DataFrame:
    """Cost per day and model from a price table; unknown models cost nothing."""
    price = s.createDataFrame([("click", 0.25), ("view", 0.5)], "event_type string, price double")
    e = T(s, d, "events").join(F.broadcast(price), "event_type", "left")  # a price list of a few rows
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("model")).agg(F.round(F.sum(F.col("value") * F.coalesce("price", F.lit(0.0))), 4).alias("cents"))


@q("""select rule, round(value, 6) as value, max_allowed from (select 'p95' rule, quantile_cont(value, 0.95) value, 10.0 max_allowed from events union all select 'error_share', count(*) filter (event_type = 'error') * 100.0 / count(*), 5.0 from events
    union all select 'users', count(distinct user_id)::double, 1000000.0 from events) where value > max_allowed""")
def alert_rules(s: SparkSession, d: str) -> DataFrame:
    a = rollup.alerts(T(s, d, "events"), [("p95", F.percentile("value", F.lit(0.95)), 10), ("error_share", F.count_if(F.expr("event_type = 'error'")) * 100.0 / F.count("*"), 5), ("users", F.count_distinct("user_id"), 1e6)])
    return a.select("rule", F.round("value", 6).alias("value"), F.col("limit").alias("max_allowed"))


@q("""select suppliers, count(*) as orders from (select l_orderkey, string_agg(l_suppkey::varchar, ' vs ' order by l_suppkey::varchar) suppliers from (select distinct l_orderkey, l_suppkey from lineitem) group by 1) group by 1""")
def multiset_groups(s: SparkSession, d: str) -> DataFrame:
    o = T(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), " vs ").alias("suppliers"))
    return o.groupBy("suppliers").agg(F.count("*").alias("orders"))


@q("""select l_returnflag, l_linestatus, l_shipdate, count(*) as rows, sum(l_quantity) as qty, round(avg(l_quantity), 6) as mean_qty, count(distinct l_suppkey) as suppliers from lineitem group by 1, 2, 3 having count(*) > 1 order by rows desc, l_shipdate, l_returnflag, l_linestatus limit 10""")
def duplicate_groups_topk(s: SparkSession, d: str) -> DataFrame:
    g = T(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_shipdate").agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("qty"), F.round(F.avg("l_quantity"), 6).alias("mean_qty"), F.count_distinct("l_suppkey").alias("suppliers"))
    return g.filter("rows > 1").orderBy(F.desc("rows"), "l_shipdate", "l_returnflag", "l_linestatus").limit(10)


@q("""select bucket, count(*) as orders from (select case when n = 0 then 'none' when n = 1 then 'single' when n <= 3 then 'few' else 'many' end bucket from (select count(l_orderkey) n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)) group by 1""")
def batch_size_buckets(s: SparkSession, d: str) -> DataFrame:
    n = T(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    j = T(s, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.groupBy(F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "single").when(F.col("n") <= 3, "few").otherwise("many").alias("bucket")).agg(F.count("*").alias("orders"))


@q("""select group_id, min_by(title, opdb_id) filter (title is not null) as title, min_by(year, opdb_id) filter (year is not null) as year, (select string_agg(x, '|' order by x) from (select distinct unnest(flatten(list(designers))) x)) as designers from (select distinct group_id, opdb_id, title, year, designers from machines) group by 1""")
def first_non_null_merge(s: SparkSession, d: str) -> DataFrame:
    """Editions merged: the first value of each attribute that is not null, the union of lists."""
    m = T(s, d, "machines").select("group_id", "opdb_id", "title", "year", "designers").distinct()
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("opdb_id"))).alias(c)
    return m.groupBy("group_id").agg(first("title"), first("year"), F.nullif(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("designers")))), "|"), F.lit("")).alias("designers"))


@q("""select coalesce(region, 'all') as region, coalesce(nation, 'all') as nation, suppliers, qty from (select r_name region, n_name nation, count(distinct s_suppkey) suppliers, sum(l_quantity) qty from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
    group by rollup (r_name, n_name))""")
def region_rollup(s: SparkSession, d: str) -> DataFrame:
    n = T(s, d, "nation").join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # suppliers are summed before the dimensions are joined: lineitem shuffles one row per supplier and task
    l = T(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))  # noqa: E741
    j = l.join(T(s, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    g = j.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count_distinct("s_suppkey").alias("suppliers"), F.sum("q").alias("qty"))
    return g.select(F.coalesce("region", F.lit("all")).alias("region"), F.coalesce("nation", F.lit("all")).alias("nation"), "suppliers", "qty")


# ---- text functions


@q("""select title_key, count(*) as rows from (select trim(regexp_replace(lower(replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(machine_title), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), chr(39), ''), '’', ''), '&', ' and ', 'g'), '_', ' ')), '[^a-z0-9]+', ' ', 'g')) title_key
    from search_hits where machine_title is not null) group by 1""")
def title_tokens(s: SparkSession, d: str) -> DataFrame:
    h = T(s, d, "search_hits").filter("machine_title is not null")
    return h.groupBy(X.title_key(F.col("machine_title")).alias("title_key")).agg(F.count("*").alias("rows"))


@q("""select distinct title, case when b = '' then k else b end as compact, regexp_replace(title, '(: | - ).*$', '') as head, url_key from (select title, k, regexp_replace(k, '(merlinedition|vaultedition|limitededition|standardedition|remake|pinball|gamekit|deposit|edition)$', '') b, translate(lower(trim(title)), '/\\?#', '____') url_key
    from (select title, regexp_replace(lower(strip_accents(title)), '[^a-z0-9]', '', 'g') k from machines))""")
def title_normal_forms(s: SparkSession, d: str) -> DataFrame:
    m = T(s, d, "machines").select("title").distinct()
    return m.select("title", X.compact_key(F.col("title")).alias("compact"), X.franchise_head(F.col("title")).alias("head"), X.lookup_key(F.col("title")).alias("url_key"))


@q("""select change_id, regexp_extract(regexp_replace(document_url, '[?#].*$', ''), '([^/]*)$', 1) as file, nullif(regexp_extract(document_url, '/shared/([^/?#]+)', 1), '') as slug, split_part(machine_id, '-', 1) as grp from scraped_changes where document_url is not null and machine_id is not null""")
def url_parts(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d, "scraped_changes").filter("document_url is not null and machine_id is not null")
    return c.select("change_id", X.url_filename(F.col("document_url")).alias("file"), X.url_slug(F.col("document_url"), "shared").alias("slug"), X.id_segments(F.col("machine_id"), 1).alias("grp"))


@q("""with e as (select distinct result_id, question from eval_answers where question is not null), w as (select result_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(question), '[''’]s\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') ws from e),
    k as (select result_id, ws, list_filter(ws, lambda x: x not in ('a','an','and','are','at','by','can','do','does','for','from','how','i','in','is','it','my','of','on','or','the','to','what','when','where','which','why','with')) kept from w)
    select result_id, array_to_string(case when len(kept) = 0 then ws else kept end, ' ') as words from k""")
def query_words(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "eval_answers").filter("question is not null").select("result_id", "question").distinct()
    return e.select("result_id", F.array_join(X.query_words(F.col("question")), " ").alias("words"))


@q("""select word, list_aggregate(list_transform(generate_series(2, least(25, len(word))), lambda n: word[1:n]), 'string_agg', ',') as grams from (select distinct lower(regexp_extract(title, '^([A-Za-z]+)', 1)) word from machines) where len(word) >= 2""")
def edge_ngrams(s: SparkSession, d: str) -> DataFrame:
    m = T(s, d, "machines").select(F.lower(F.regexp_extract("title", "^([A-Za-z]+)", 1)).alias("word")).distinct().filter("length(word) >= 2")
    return m.select("word", F.array_join(X.edge_ngrams(F.col("word")), ",").alias("grams"))


@q("""select result_id, follow from (select distinct result_id, regexp_matches(' ' || regexp_replace(lower(trim(question)), '[?.!,;:]+', '', 'g') || ' ', ' (what about|how about|and what|tell me more|the same|that one|it|its|they|them|that|this|those|these|there) ') as follow from eval_answers where question is not null) where follow""")
def follow_up_questions(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "eval_answers").filter("question is not null").select("result_id", X.is_follow_up(F.col("question")).alias("follow"))
    return e.filter("follow").distinct()


@q("""select result_id, stripped, paragraphs from (select distinct result_id, regexp_replace(answer_text, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g') as stripped, len(list_filter(string_split(answer_text, chr(10) || chr(10)), lambda p: trim(p) <> ''))::int as paragraphs from eval_answers where answer_text is not null)""")
def answer_markdown(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "eval_answers").filter("answer_text is not null")
    return e.select("result_id", X.strip_markdown_links(F.col("answer_text")).alias("stripped"), F.size(X.paragraphs(F.col("answer_text"))).alias("paragraphs")).distinct()


# ---- evaluation


@q("""with e as (select distinct result_id, list_distinct(list_transform(coalesce(predicted_citation_set, []), lambda x: lower(x))) p, list_distinct(list_transform(coalesce(expected_citation_set, []), lambda x: lower(x))) e from eval_answers)
    select result_id, round(case when len(p) = 0 then case when len(e) = 0 then 1.0 else 0.0 end else len(list_intersect(p, e))::double / len(p) end, 6) as prec, round(case when len(e) = 0 then 1.0 else len(list_intersect(p, e))::double / len(e) end, 6) as rec from e""")
def set_precision_recall(s: SparkSession, d: str) -> DataFrame:
    p, e = F.col("predicted_citation_set"), F.col("expected_citation_set")
    return T(s, d, "eval_answers").select("result_id", F.round(M.precision(p, e), 6).alias("prec"), F.round(M.recall(p, e), 6).alias("rec")).distinct()


@q("""select distinct result_id, case when coalesce(acceptable_refusal, false) then null else (not coalesce(predicted_refusal, false))::int::double end as refusal_ok, coalesce(lower(trim(predicted_sub_agent)) = lower(trim(expected_sub_agent)), false)::int::double as routed from eval_answers""")
def refusal_three_state(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "eval_answers")
    return e.select("result_id", M.refusal_correct(F.col("predicted_refusal"), F.col("acceptable_refusal"), F.lit(False)).alias("refusal_ok"), M.routing_correct(F.col("predicted_sub_agent"), F.col("expected_sub_agent")).alias("routed")).distinct()


@q("""with e as (select distinct result_id, coalesce(answer_text, '') a, coalesce(len(predicted_citation_set), 0) c from eval_answers), n as (select *, len(list_filter(string_split(a, chr(10) || chr(10)), lambda p: trim(p) <> '')) n from e),
    g as (select result_id, c, case when c > 0 then 1.0 else 0.5 end r, case when c = 0 or n = 0 then 0.0 else least(1.0, c / greatest(1, ceil(n / 4.0))) end cov from n), h as (select *, pow(r * 0.85 * greatest(cov, 0.05), 1.0 / 3) f from g)
    select result_id, round(f, 6) as confidence, (f < 0.65) as refused, case when f < 0.65 then case when cov <= 0.05 and r <= 0.5 then 'OutOfScope' when r <= 0.85 and r <= cov then 'InsufficientGrounding' when 0.85 <= cov then 'LowModelConfidence' else 'InsufficientGrounding' end end as why from h""")
def confidence_composite(s: SparkSession, d: str) -> DataFrame:
    a, c = F.col("answer_text"), F.greatest(F.size(F.coalesce("predicted_citation_set", F.array().cast("array<string>"))), F.lit(0))
    f = M.confidence(a, c)
    return T(s, d, "eval_answers").select("result_id", F.round(f, 6).alias("confidence"), (f < M.REFUSE_BELOW).alias("refused"), M.refusal_category(a, c).alias("why")).distinct()


# ---- retrieval


@q("""with v as (select vec_id, label, embedding::double[] e from embeddings), s as (select a.vec_id as query, b.vec_id, round(list_cosine_similarity(a.e, b.e), 6) score, list_cosine_similarity(a.e, b.e) x from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
    select query, vec_id, score, n::int as rank from (select *, row_number() over (partition by query order by round(x, 9) desc, vec_id) n from s) where n <= 10""")
def knn_cosine(s: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of each query (ids divisible by 20), against all rows."""
    e = T(s, d, "embeddings")
    k = retrieval.knn(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)
    return k.select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


_BM25 = """with t as (select chunk_id, list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: x <> '') ws from (select distinct chunk_id, content from chunks)), n as (select count(*) n, avg(len(ws)) mean from t),
    f as (select chunk_id, len(ws) l, q.t, len(list_filter(ws, lambda x: x = q.t)) tf from t, (select unnest(['flipper', 'coil', 'fuse', 'rebuild']) t) q), h as (select * from f where tf > 0), df as (select t, count(*) df from h group by 1),
    bm as (select chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) score from h join df using (t), n group by 1)"""


@q(_BM25 + " select chunk_id, round(score, 6) as score, row_number() over (order by round(score, 6) desc, chunk_id)::int as rank from bm order by round(score, 6) desc, chunk_id limit 20")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    """The twenty best chunks for a query."""
    c = T(s, d, "chunks").select("chunk_id", "content").distinct()
    return retrieval.ranked(retrieval.bm25(c, "chunk_id", "content", ["flipper", "coil", "fuse", "rebuild"]), "chunk_id", "score", 20)


@q(_BM25 + """, a as (select chunk_id, row_number() over (order by round(score, 6) desc, chunk_id) r from bm order by round(score, 6) desc, chunk_id limit 200),
    m as (select c.chunk_id, max(round(h.score, 6)) score from (select distinct chunk_id, document_id from chunks) c join search_hits h on h.document_id = c.document_id group by 1), b as (select chunk_id, row_number() over (order by score desc, chunk_id) r from m order by score desc, chunk_id limit 200),
    fused as (select chunk_id, round(sum(1.0 / (60 + r)), 6) score from (select * from a union all select * from b) group by 1) select chunk_id, score, row_number() over (order by score desc, chunk_id)::int as rank from fused order by score desc, chunk_id limit 20""")
def hybrid_fusion(s: SparkSession, d: str) -> DataFrame:
    """A lexical ranking and one by hits' scores, fused by reciprocal ranks."""
    c = T(s, d, "chunks").select("chunk_id", "document_id", "content").distinct()
    a = retrieval.ranked(retrieval.bm25(c, "chunk_id", "content", ["flipper", "coil", "fuse", "rebuild"]), "chunk_id", "score", 200)
    best = T(s, d, "search_hits").groupBy("document_id").agg(F.max("score").alias("score"))
    m = c.join(best, "document_id").groupBy("chunk_id").agg(F.max("score").alias("score"))
    b = retrieval.ranked(m, "chunk_id", "score", 200)
    return retrieval.ranked(retrieval.fuse(a, b, "chunk_id"), "chunk_id", "score", 20)


@q("""with v as (select vec_id, label, embedding::double[] e from embeddings), s as (select a.vec_id as query, a.label ql, b.vec_id, b.label, list_cosine_similarity(a.e, b.e) x from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
    r as (select *, row_number() over (partition by query order by round(x, 9) desc, vec_id) n from s qualify n <= 10), g as (select query, min(n) filter (label = ql) first from r group by 1)
    select query, first::int as first_rank, case when first is null then 'retrieval-miss' when first <= 3 then 'easy' else 'reranker-sensitive' end as slice, round(coalesce(1.0 / first, 0), 6) as mrr from g""")
def rank_slice(s: SparkSession, d: str) -> DataFrame:
    """Rank of the first neighbour with the query's label, its slice and reciprocal rank."""
    e = T(s, d, "embeddings")
    k = retrieval.knn(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 10).join(e.select("vec_id", "label"), "vec_id")
    k = k.join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query")
    g = k.groupBy("query").agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("rank"))).alias("first_rank"))
    return g.select("query", "first_rank", F.when(F.col("first_rank").isNull(), "retrieval-miss").when(F.col("first_rank") <= 3, "easy").otherwise("reranker-sensitive").alias("slice"), F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"))


@q("""with v as (select vec_id, label, embedding::double[] e from embeddings), s as (select a.vec_id as query, a.label ql, b.vec_id, b.label, list_cosine_similarity(a.e, b.e) x from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
    r as (select *, row_number() over (partition by query order by round(x, 9) desc, vec_id) n from s qualify n <= 10), tot as (select a.vec_id as query, count(*) rel from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0 group by 1),
    g as (select query, sum((label = ql)::int / log2(n + 1)) dcg, count(*) filter (label = ql) hits from r group by 1), z as (select g.*, coalesce(rel, 0) rel, (select sum(1 / log2(i + 1)) from range(1, 11) u(i) where i <= coalesce(rel, 0)) idcg from g left join tot using (query))
    select query, round(case when rel = 0 then 1.0 else hits::double / rel end, 6) as recall_10, round(case when rel = 0 then 1.0 else dcg / idcg end, 6) as ndcg_10 from z""")
def recall_ndcg(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "embeddings")
    k = retrieval.knn(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)
    # relevant: all vectors of the query's label but itself; their number is all that the metrics need of them
    rel = e.groupBy("label").agg((F.count("*") - 1).alias("rel"))
    own = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("ql"))
    hit = (F.col("label") == F.col("ql")).cast("int")
    g = k.join(e.select("vec_id", "label"), "vec_id").join(own, "query").groupBy("query", "ql").agg(F.sum(hit).alias("hits"), F.sum(hit / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    g = g.join(rel.withColumnRenamed("label", "ql"), "ql")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.greatest(F.lit(1), F.col("rel"))).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    none = F.col("rel") == 0
    return g.select("query", F.round(F.when(none, 1.0).otherwise(F.col("hits") / F.col("rel")), 6).alias("recall_10"), F.round(F.when(none, 1.0).otherwise(F.col("dcg") / ideal), 6).alias("ndcg_10"))


# ---- chunking


_TOK = "list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda x: x <> '')"


@q(f"""with t as (select doc_id, {_TOK} t from documents where text is not null), n as (select doc_id, t, len(t) n from t where len(t) > 0), w as (select doc_id, t, n, s.s from n, unnest(generate_series(0, n, 461)) s(s) where s.s = 0 or s.s - 461 + 512 < n),
    k as (select *, row_number() over (partition by doc_id order by s) - 1 idx, count(*) over (partition by doc_id) c from w), m as (select *, max(s) over (partition by doc_id) ls from k), z as (select *, case when c > 1 and n - ls < 128 then c - 1 else c end kept from m)
    select doc_id, idx::int as idx, s::int as tok_start, (case when idx = kept - 1 then n else least(s + 512, n) end)::int as tok_end, sha256(array_to_string(t[s + 1:(case when idx = kept - 1 then n else least(s + 512, n) end)], ' ')) as body_hash from z where idx < kept""")
def chunk_windows(s: SparkSession, d: str) -> DataFrame:
    """Token windows of 512 with 51 overlapping, short tails merged."""
    w = chunker.windows(T(s, d, "documents"), ["doc_id"], "text")
    return w.select("doc_id", "idx", F.col("tok_start").cast("int").alias("tok_start"), "tok_end", F.sha2("body", 256).alias("body_hash"))


@q()
def chunk_documents(s: SparkSession, d: str) -> DataFrame:
    """Paged documents (paragraphs as pages) chunked with running lines dropped and pages attributed."""
    t = T(s, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("page", "page_text"))
    c = chunker.chunk(t.withColumn("page", F.col("page") + 1), "doc_id", "page", "page_text", size=128, overlap=16, tail=32)
    return c.select("doc_id", "chunk_index", "heading", "page_start", "page_end", "token_count", F.sha2("body", 256).alias("body_hash"))


@q("""with l as (select doc_id, trim(x) line from (select doc_id, unnest(string_split(text, chr(10))) x from documents where text is not null) where trim(x) <> ''), c as (select doc_id, line, count(*) n from l group by 1, 2 having count(*) >= 3)
    select doc_id, line, n from c qualify row_number() over (partition by doc_id order by n desc, line) = 1""")
def repeated_lines(s: SparkSession, d: str) -> DataFrame:
    """The line a document repeats most, three times or more."""
    ls = T(s, d, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).select("doc_id", F.trim("x").alias("line")).filter("line <> ''")
    c = ls.groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter("n >= 3")
    return c.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "line"))).filter("k = 1").select("doc_id", "line", "n")


QUERIES, ORACLE = q.queries, q.oracle
