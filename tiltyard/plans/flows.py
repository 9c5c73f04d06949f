"""Queries for streams, linking, answer assembly and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tiltyard.operators import answers, linker, retrieval, sinks
from tiltyard.plans.registry import Registry
from tiltyard.plans.relational import RESOLVE_SQL, title_key_sql
from tiltyard.session import scratch
from tiltyard.session import table as T
from tiltyard.streaming import feed

q = Registry()


def _stream(s: SparkSession, df: DataFrame, files: int = 4) -> tuple[DataFrame, str]:
    """df as a stream of several small batches."""
    at = scratch(s, "feed")
    df.repartition(files).write.parquet(at)
    return feed.read_feed(s, at, df.schema.simpleString()[7:-1].replace(":", " "), 1), scratch(s, "cp")


@q("select event_type, user_id, count(*) as n from events group by 1, 2")
def stream_incremental_view(s: SparkSession, d: str) -> DataFrame:
    """A view maintained batch by batch ends equal to the rollup of all events."""
    e, cp = _stream(s, T(s, d, "events").select("event_type", "user_id"))
    st = feed.count_view(s, e, ["event_type", "user_id"], cp, feed.StateTable(s, "event_type string, user_id long, n long"))
    return st.read()


@q("select user_id::varchar as key, least(count(*), 3)::bigint as attempts from events where event_type = 'error' group by 1")
def stream_retry_budget(s: SparkSession, d: str) -> DataFrame:
    e, cp = _stream(s, T(s, d, "events").select(F.col("user_id").cast("string").alias("user_id"), "event_type"))
    return feed.retry_budget(e, "user_id", F.col("event_type") == "error", cp, feed.StateTable(s, "key string, attempts long")).read()


@q("select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from events group by 1, 2")
def stream_windows(s: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of a stream in complete mode: equal to the batch buckets."""
    df = T(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e, cp = _stream(s, df, 2)
    out = scratch(s, "windows")
    w = feed.windowed_counts(e, "ts", "event_type", late="30 days")
    query = w.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", cp).trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@q("""with st as (select document_id, max_by(last_indexed_hash, (recorded_utc, first_recorded_utc)) filter (last_indexed_hash is not null) last_hash, max(failure_count) attempts from index_state group by 1)
    select change_id, case when coalesce(trim(c.document_id), '') = '' then 'empty_id' when coalesce(attempts, 0) >= 3 then 'over_budget' when not coalesce(document_type in ('Manual', 'Rulesheet', 'ServiceBulletin'), false) then 'type_filtered' when content_hash = last_hash then 'hash_unchanged' else 'process' end as outcome
    from scraped_changes c left join st on st.document_id = c.document_id""")
def ingest_outcomes(s: SparkSession, d: str) -> DataFrame:
    """What the ingestion does with each change: budget, type and hash are looked up in the index state."""
    i = T(s, d, "index_state")
    st = i.groupBy("document_id").agg(F.max_by("last_indexed_hash", F.when(F.col("last_indexed_hash").isNotNull(), F.struct("recorded_utc", "first_recorded_utc"))).alias("last_hash"), F.max("failure_count").alias("attempts"))
    return feed.ingest_outcomes(T(s, d, "scraped_changes"), st, "document_id", "content_hash", "document_type", ["Manual", "Rulesheet", "ServiceBulletin"]).select("change_id", "outcome")


_LINKED = f"""t as (select doc_id, title, case when title = 'Service Library' then 'platform_generic' end st, string_split(text, chr(10)) l, source from documents),
    tiers as (select doc_id, 1 n, title x from t union all select doc_id, 2, l[1] from t union all select doc_id, 3, l[2] from t), q as (select distinct {{'d': doc_id, 'n': n}} row, {title_key_sql("x")} k from tiers where x is not null), {RESOLVE_SQL},
    best as (select row.d d, arg_min({{'n': row.n, 'ids': ids}}, row.n) filter (status in ('Resolved', 'Family')) g, arg_max({{'n': row.n, 'ids': ids}}, row.n) filter (status = 'Ambiguous') u from resolved group by 1),
    linked as (select doc_id, case when st is not null then st when source = 'spec_export' then 'manually_linked' when source = 'code_notes' then 'platform_generic' when g is not null then 'linked' when u is not null then 'needs_review' else 'not_in_catalog' end status,
        case when st is not null then null when source in ('spec_export', 'code_notes') then 'override' else ['title', 'page_one', 'page_two'][coalesce(g, u).n] end tier,
        case when st is not null or source = 'code_notes' then null when source = 'spec_export' then [(select min(opdb_id) from machines)] else coalesce(g, u).ids end ids from t left join best on d = doc_id)"""


def _linked(s: SparkSession, d: str) -> DataFrame:
    ls = F.split("text", "\n")
    t = T(s, d, "documents").select("doc_id", "title", F.get(ls, F.lit(0)).alias("l1"), F.get(ls, F.lit(1)).alias("l2"), "source", F.when(F.col("title") == "Service Library", "platform_generic").alias("state"))
    first = T(s, d, "machines").agg(F.min("opdb_id").alias("machine"))
    o = t.filter("state is null").filter(F.col("source").isin("spec_export", "code_notes")).select("doc_id", "source").join(first.withColumn("source", F.lit("spec_export")), "source", "left").select("doc_id", "machine")
    return linker.link(t, "doc_id", {"title": "title", "page_one": "l1", "page_two": "l2"}, T(s, d, "machines"), "opdb_id", "title", "group_id", "state", o)


@q(f"with {_LINKED} select doc_id, status, tier, array_to_string(ids, ',') as ids from linked")
def link_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents linked by hand, by title, then by the lines that begin their text; those in a final state stay as they are."""
    return _linked(s, d).select("doc_id", "status", "tier", F.array_join("ids", ",").alias("ids"))


@q(f"""with {_LINKED} select doc_id, opdb_id, 'linked' as status, null as error, case when len(ids) = 1 then 'single-edition' else 'franchise-wide' end as scope from (select doc_id, ids, unnest(ids) opdb_id from linked where status in ('linked', 'manually_linked'))""")
def link_fan_out(s: SparkSession, d: str) -> DataFrame:
    """A row for each machine that a document is linked to."""
    return linker.fan_out(_linked(s, d), "doc_id", T(s, d, "machines"), "opdb_id")


@q("""select query_id, url, pos::int as pos, hit_id from (select query_id, lower(document_url) u, arg_max(document_url, (page_start is not null, -hit_id)) url, min(hit_id) pos, arg_max(hit_id, (page_start is not null, -hit_id)) hit_id from (select distinct query_id, document_url, hit_id, page_start from search_hits where document_url is not null) group by 1, 2)""")
def ordered_citations(s: SparkSession, d: str) -> DataFrame:
    """Citations of each query, one per address, its first position kept."""
    h = T(s, d, "search_hits").filter("document_url is not null").select("query_id", F.col("document_url").alias("url"), "hit_id", F.col("hit_id").alias("pos"), F.col("page_start").isNotNull().alias("chunk")).distinct()
    return answers.ordered_citations(h, "query_id", "url", "pos", "chunk").select("query_id", "url", F.col("pos").cast("int").alias("pos"), "hit_id")


@q("""with e as (select distinct result_id, coalesce(answer_text, '') a, coalesce(len(predicted_citation_set), 0) c, duration_ms from eval_answers), n as (select *, len(list_filter(string_split(a, chr(10) || chr(10)), lambda p: trim(p) <> '')) n from e),
    g as (select *, pow(case when c > 0 then 1.0 else 0.5 end * 0.85 * greatest(case when c = 0 or n = 0 then 0.0 else least(1.0, c / greatest(1, ceil(n / 4.0))) end, 0.05), 1.0 / 3) f from n)
    select result_id, case when duration_ms > 20000 then 'over_cost' when f < 0.65 then 'low_confidence' when c = 0 then 'no_citations' else 'answer' end as verdict from g""")
def answer_guardrails(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "eval_answers").select("result_id", "answer_text", F.greatest(F.size(F.coalesce("predicted_citation_set", F.array().cast("array<string>"))), F.lit(0)).alias("c"), "duration_ms").distinct()
    return answers.guardrails(e, "answer_text", "c", "duration_ms", 20000.0).select("result_id", "verdict")


@q("""select letter_id, coalesce(attempt_count, 0) + 1 as attempt_count, substr(error_class, 1, 64) as error_class, substr(error_message, 1, 1024) as error_message from dead_letters""")
def dead_letter_rows(s: SparkSession, d: str) -> DataFrame:
    return sinks.dead_letters(T(s, d, "dead_letters").withColumnRenamed("attempt_count", "prior"), "letter_id", "error_class", "error_message", "prior")


@q("""select user_id, event_id, back::int as back from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) back from events) where back <= 5""")
def turn_window(s: SparkSession, d: str) -> DataFrame:
    """The last five turns of each conversation (here: events of a user)."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return T(s, d, "events").select("user_id", "event_id", "ts").withColumn("back", F.row_number().over(w)).filter("back <= 5").select("user_id", "event_id", "back")


@q("""select user_id, arg_max(event_id, (ts, event_id)) filter (event_type = 'purchase') as last_purchase from events group by 1""")
def last_with_citations(s: SparkSession, d: str) -> DataFrame:
    """The last turn of each conversation that meets a condition."""
    at = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    return T(s, d, "events").groupBy("user_id").agg(F.max_by("event_id", at).alias("last_purchase"))


@q("""with t as (select hit_id, max(score) score, max(coalesce(page_end, 0) - coalesce(page_start, 0)) span from search_hits where score is not null group by 1), r as (select *, row_number() over (order by score desc, hit_id) r from t order by score desc, hit_id limit 50)
    select hit_id, r::int as rank, row_number() over (order by case when r <= 5 then 0 else 1 end, case when r <= 5 then -span else 0 end, r)::int as new_rank from r""")
def rerank_topn(s: SparkSession, d: str) -> DataFrame:
    """The first five of a ranking ordered anew by another score, the others behind them as they were."""
    t = T(s, d, "search_hits").filter("score is not null").groupBy("hit_id").agg(F.max("score").alias("score"), F.max(F.coalesce("page_end", F.lit(0)) - F.coalesce("page_start", F.lit(0))).cast("double").alias("span"))
    r = retrieval.ranked(t, "hit_id", "score", 50)
    return retrieval.rerank(r, "rank", "span", 5).select("hit_id", "rank", "new_rank")


@q("""select opdb_id, i::int as pos, designers[i + 1] as designer, n as machines from (select distinct opdb_id, designers from machines), unnest(range(0, len(designers))) u(i) left join (select x, count(distinct opdb_id) n from (select opdb_id, unnest(designers) x from machines) group by 1) k on k.x = designers[i + 1]""")
def array_position_join(s: SparkSession, d: str) -> DataFrame:
    """Arrays joined by position: each designer of a machine with their number of machines."""
    m = T(s, d, "machines").select("opdb_id", "designers").distinct()
    e = m.select("opdb_id", F.posexplode("designers").alias("pos", "designer"))
    return e.join(e.groupBy("designer").agg(F.count_distinct("opdb_id").alias("machines")), "designer", "left").select("opdb_id", "pos", "designer", "machines")


@q("""select title, array_to_string(list_sort(list_distinct(list_transform(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: {'n': -len(w), 'w': w})))[1:2].list_transform(lambda x: x.w), ' ') as probes from (select distinct title from machines)""")
def longest_tokens(s: SparkSession, d: str) -> DataFrame:
    """The two longest words of a title: what a fallback search probes with."""
    ws = F.split(F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " ")), " ")
    best = F.slice(F.array_sort(F.array_distinct(F.transform(ws, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))), 1, 2)
    return T(s, d, "machines").select("title").distinct().select("title", F.array_join(F.transform(best, lambda x: x["w"]), " ").alias("probes"))


@q("""select user_id, min(ts) as start, count(*) as n from (select *, sum(b) over (partition by user_id order by ts, event_id) g from (select *, (coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval '30 minutes', true))::int b from events)) group by user_id, g""")
def session_windows(s: SparkSession, d: str) -> DataFrame:
    """Sessions of events no further apart than half an hour: an extension that streams share."""
    e = T(s, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("start"), F.count("*").alias("n"))
    return e.select("user_id", "start", "n")


QUERIES, ORACLE = q.queries, q.oracle
