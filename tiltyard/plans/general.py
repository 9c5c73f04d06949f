"""Queries of the general data problems: p1 (orphan references), p4 (change feeds), p5 (rows that fail to parse)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltyard.operators import badrows, changefeed, orphans
from tiltyard.session import table

PARENTS = {
    "index_state": orphans.Parent("document_id", "first_recorded_utc", "removed_utc"),
    "machines": orphans.Parent("opdb_id", "first_seen_at", "removed_at"),
}
FOUND_EDGES = [
    orphans.Edge("search_hits", "document_id", "hit_id", "retrieved_at", "index_state"),
    orphans.Edge("search_hits", "machine_id", "hit_id", "retrieved_at", "machines"),
    orphans.Edge("dead_letters", "document_id", "letter_id", "last_attempt_utc", "index_state"),
]
#: index_state is itself a child of machines: what it orphans, its own children inherit.
ALL_EDGES = [
    orphans.Edge("index_state", "machine_id", "document_id", "first_recorded_utc", "machines"),
    *FOUND_EDGES,
    orphans.Edge("chunks", "document_id", "chunk_id", "last_scraped_utc", "index_state"),
]


def _tables(spark: SparkSession, sf: str, edges: list[orphans.Edge]) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in {e.child for e in edges} | {e.parent for e in edges}}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    c = orphans.cascade(_tables(spark, sf, ALL_EDGES), PARENTS, ALL_EDGES)
    asked = F.concat_ws(".", "table_name", "field_name").isin([f"{e.child}.{e.field}" for e in FOUND_EDGES])
    return c.filter("depth = 0").filter(asked).select("table_name", "field_name", F.col("row").cast("bigint").alias("row_id"), F.date_format("t", "yyyy-MM").alias("period"), "reason")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.report(orphans.cascade(_tables(spark, sf, ALL_EDGES), PARENTS, ALL_EDGES))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return changefeed.apply_feed(table(spark, sf, "scraped_changes"), "document_id", "op", "lsn", "last_scraped_utc", "received_at", ["content_hash"])


def p4_state(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "scraped_changes")
    return changefeed.apply_feed(c, "document_id", "op", "lsn", "last_scraped_utc", "received_at", ["content_hash", "last_scraped_utc", "document_type"])


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return badrows.parse_records(table(spark, sf, "ratings_raw"), "row_id", "raw_line", badrows.RATINGS)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return badrows.rejected(_parsed(spark, sf), "row_id")


def p5_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = badrows.typed(_parsed(spark, sf), badrows.RATINGS, "row_id")
    return r.withColumn("last_rating_period", F.date_format("last_rating_period", "yyyy-MM-dd"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p4_found, p4_state, p5_found, p5_rows)}

_P1 = """
with spans_d as (select distinct lower(trim(document_id)) k, first_recorded_utc a, removed_utc b from index_state),
     spans_m as (select distinct lower(trim(opdb_id)) k, first_seen_at a, removed_at b from machines),
     refs as (select 'search_hits' table_name, 'document_id' field_name, hit_id row_id, lower(trim(document_id)) k, retrieved_at t, 'd' p from search_hits
        union select 'search_hits', 'machine_id', hit_id, lower(trim(machine_id)), retrieved_at, 'm' from search_hits
        union select 'dead_letters', 'document_id', letter_id, lower(trim(document_id)), last_attempt_utc, 'd' from dead_letters),
     spans as (select 'd' p, * from spans_d union all select 'm', * from spans_m),
     judged as (select r.table_name, r.field_name, r.row_id, r.t, count(s.k) n, min(s.a) f, coalesce(bool_or(r.t >= s.a and (s.b is null or r.t < s.b)), false) ok
        from refs r left join spans s on r.p = s.p and r.k = s.k where r.k is not null and r.k <> '' group by all)
select table_name, field_name, row_id, strftime(t, '%Y-%m') as period, case when n = 0 then 'missing' when t < f then 'late' else 'deleted' end as reason
from judged where not ok"""

_P4 = """
with c as (select *, lower(trim(op)) in ('delete', 'd', 'tombstone', 'remove', 'del') gone, coalesce(lsn, epoch_us(last_scraped_utc)) p from scraped_changes),
     e as (select document_id, max(p) filter (gone) ended, max(p) filter (not gone) made from c group by 1)
select e.document_id{cols} from e left join c on c.document_id = e.document_id and not c.gone and c.p > coalesce(e.ended, -1)
where made is not null and (ended is null or made > ended) group by e.document_id"""

_F = r"""(?:[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)"""
_LINES = f"""
with l as (select row_id, raw_line x from ratings_raw where trim(raw_line) <> '' and not starts_with(lower(raw_line), 'name,user id,')),
     s as (select row_id, x, regexp_full_match(x, '{_F}(?:,{_F})*') as quoted from l),
     m as (select row_id, quoted, case when quoted then list_transform(regexp_extract_all(',' || x, ',({_F})', 1),
        lambda v: case when regexp_full_match(v, '[ \\t]*".*"[ \\t]*') then replace(regexp_extract(v, '^[ \\t]*"(.*)"[ \\t]*$', 1), '""', '"') else v end) end f from s),
     n as (select row_id, quoted, len(f) n, f, trim(f[1]) name, trim(f[3]) ifpa, trim(f[4]) rating, trim(f[7]) per from m),
     r as (select row_id, f, case when not quoted then 'quoting' when n <> 8 then 'columns' when not regexp_matches(name, '\\p{{L}}') then 'name'
        when not regexp_full_match(ifpa, '|0*[1-9][0-9]*') then 'ifpa_id' when not regexp_full_match(rating, '[0-9]+(\\.[0-9]+)?') then 'rating'
        when per <> '' and (not regexp_full_match(per, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') or try_cast(per as date) is null) then 'last_rating_period' end reason from n)
"""

_P1_REPORT = """
with spans as (select distinct 'd' p, lower(trim(document_id)) k, first_recorded_utc a, removed_utc b from index_state union all select distinct 'm', lower(trim(opdb_id)), first_seen_at, removed_at from machines),
     refs as (select 'index_state' table_name, 'machine_id' field_name, concat_ws('@', document_id, epoch_us(first_recorded_utc)) r, lower(trim(machine_id)) k, first_recorded_utc t, 'm' p, lower(trim(document_id)) own, first_recorded_utc born from index_state
        union all select 'search_hits', 'document_id', hit_id::varchar, lower(trim(document_id)), retrieved_at, 'd', null, null from search_hits
        union all select 'search_hits', 'machine_id', hit_id::varchar, lower(trim(machine_id)), retrieved_at, 'm', null, null from search_hits
        union all select 'dead_letters', 'document_id', letter_id::varchar, lower(trim(document_id)), last_attempt_utc, 'd', null, null from dead_letters
        union all select 'chunks', 'document_id', chunk_id, lower(trim(document_id)), last_scraped_utc, 'd', null, null from chunks),
     judged as (select r.table_name, r.field_name, r.r, r.k, r.t, r.p, r.own, r.born, count(s.k) n, min(s.a) f, coalesce(bool_or(r.t >= s.a and (s.b is null or r.t < s.b)), false) ok
        from refs r left join spans s on r.p = s.p and r.k = s.k where r.k is not null and r.k <> '' group by all),
     direct as (select table_name, field_name, r, t, own, born, case when n = 0 then 'missing' when t < f then 'late' else 'deleted' end reason from judged where not ok
        qualify row_number() over (partition by table_name, field_name, r order by t nulls first, reason) = 1),
     lost as (select distinct own, born from direct where table_name = 'index_state'),
     -- a reference is lost where all lives that hold at its time are
     held as (select j.table_name, j.field_name, j.r, j.t, count(*) lives, count(l.own) gone from judged j join spans s on s.p = 'd' and s.k = j.k and j.t >= s.a and (s.b is null or j.t < s.b)
        left join lost l on l.own = s.k and l.born = s.a where j.p = 'd' group by 1, 2, 3, 4),
     inherited as (select table_name, field_name, r, t, 'inherited' reason from held h where lives = gone
        and not exists (select 1 from direct d where d.table_name = h.table_name and d.field_name = h.field_name and d.r = h.r)
        qualify row_number() over (partition by table_name, field_name, r order by t nulls first) = 1),
     every as (select table_name, field_name, t, reason, 1 d, 0 i from direct union all select table_name, field_name, t, reason, 0, 1 from inherited)
select table_name, field_name, strftime(t, '%Y-%m') as period, reason, sum(d)::bigint as direct, sum(i)::bigint as inherited from every group by all"""

_SENT = "arg_max_null({0}, c.p) filter (lower(trim(op)) in ('insert', 'i', 'create', 'add', 'c') or {0} is not null) as {0}"

ORACLE = {
    "p1_found": _P1,
    "p1_report": _P1_REPORT,
    "p4_state": _P4.format(cols=", " + ", ".join(_SENT.format(v) for v in ("content_hash", "last_scraped_utc", "document_type"))),
    "p4_found": _P4.format(cols=", max_by(content_hash, c.p) filter (content_hash is not null) as content_hash"),
    "p5_found": _LINES + "select row_id, reason from r where reason is not null",
    "p5_rows": _LINES
    + """select row_id, f[1] as name, try_cast(trim(f[2]) as bigint) as user_id, try_cast(nullif(trim(f[3]), '') as bigint) as ifpa_id, try_cast(trim(f[4]) as double) as rating,
        try_cast(nullif(trim(f[5]), '') as double) as rd, try_cast(nullif(trim(f[6]), '') as double) as lower_bound, nullif(trim(f[7]), '') as last_rating_period,
        try_cast(nullif(trim(f[8]), '') as int) as rating_class,
        nullif(concat_ws(',', case when trim(f[2]) <> '' and try_cast(trim(f[2]) as bigint) is null then 'user_id' end, case when trim(f[3]) <> '' and try_cast(trim(f[3]) as bigint) is null then 'ifpa_id' end,
            case when try_cast(trim(f[4]) as double) is null then 'rating' end, case when trim(f[5]) <> '' and try_cast(trim(f[5]) as double) is null then 'rd' end,
            case when trim(f[6]) <> '' and try_cast(trim(f[6]) as double) is null then 'lower_bound' end, case when trim(f[8]) <> '' and try_cast(trim(f[8]) as int) is null then 'rating_class' end), '') as unread from r where reason is null""",
}
