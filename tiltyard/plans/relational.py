"""Queries for scans, filters, joins, set operations, windows and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tiltyard.functions import ident
from tiltyard.functions import text as X
from tiltyard.operators import predicates as P
from tiltyard.operators import relational as R
from tiltyard.plans.registry import Registry
from tiltyard.session import table as T

q = Registry()


def title_key_sql(c: str) -> str:
    """functions.text.title_key in SQL."""
    for pat in ("([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])", "([A-Z])([A-Z][a-z])"):
        c = f"regexp_replace({c if 'regexp' in c else 'strip_accents(' + c + ')'}, '{pat}', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(lower(replace(regexp_replace({c}, '[''’]', '', 'g'), '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"


_STRIP = "(?: (?:merlin edition|vault edition|limited edition|standard edition|remake|pinball|game kit|deposit|edition))+$"
#: q(row, k) resolved to machines: (row, status, stage, ids).
RESOLVE_SQL = f"""m as (select distinct * from (select opdb_id id, group_id g, {title_key_sql("title")} k from machines union all select opdb_id, group_id, {title_key_sql("regexp_replace(title, '(?:: | - ).*$', '')").replace("strip_accents(regexp", "(regexp")} from machines) where k <> ''),
    hits as (select row, 0 s, id, g from q join m using (k) union all select row, 1, id, g from (select row, k k1, regexp_replace(k, '{_STRIP}', '') k2 from q) join m on m.k = k2 where k1 <> k2
        union all select row, 2, id, g from (select row, id, g, len(string_split(m.k, ' ')) n from q join m on contains(' ' || q.k || ' ', ' ' || m.k || ' ') where q.k <> '' qualify n = max(n) over (partition by row))),
    firsts as (select distinct row, s, id, g from hits qualify s = min(s) over (partition by row)),
    resolved as (select row, s::int as stage, list_sort(list(distinct id)) ids, case when count(distinct id) = 1 then 'Resolved' when count(distinct g) = 1 and count(*) = count(g) then 'Family' else 'Ambiguous' end status from firsts group by 1, 2)"""



# ---- scans and filters


@q("select opdb_id, title, year from machines where manufacturer_key = 'brasswick' and opdb_id = (select min(opdb_id) from machines where manufacturer_key = 'brasswick') group by all")
def scan_point_read(s: SparkSession, d: str) -> DataFrame:
    """One record by id and partition."""
    m = T(s, d, "machines").filter(F.col("manufacturer_key") == "brasswick")
    first = m.agg(F.min("opdb_id").alias("opdb_id"))
    return m.join(F.broadcast(first), "opdb_id").select("opdb_id", "title", "year").distinct()


@q("select opdb_id, title, manufacturer_key, group_id, year from machines where manufacturer_key in ('quillon', 'nordhaven') and year >= 2000")
def scan_partition_projection(s: SparkSession, d: str) -> DataFrame:
    """A parameterised partition scan of five columns."""
    m = T(s, d, "machines").filter(P.in_list("manufacturer_key", ["quillon", "nordhaven"]) & (F.col("year") >= 2000))
    return m.select("opdb_id", "title", "manufacturer_key", "group_id", "year")


@q("select distinct machine_id from index_state where machine_id is not null and trim(machine_id) <> ''")
def scan_value_projection(s: SparkSession, d: str) -> DataFrame:
    i = T(s, d, "index_state")
    return i.filter(F.trim("machine_id") != "").select("machine_id").distinct()


@q("select hit_id, document_type, score from search_hits where document_type = 'Manual' and manufacturer is null".replace(" and manufacturer is null", "") + " group by all")
def filter_equal_conjunction(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "search_hits").filter(P.all_equal({"document_type": "Manual", "edition": None})).select("hit_id", "document_type", "score").distinct()


@q("select count(*) as rows from machines where false")
def filter_empty_in_list(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "machines").filter(P.in_list("manufacturer_key", [])).agg(F.count("*").alias("rows"))


@q("select opdb_id, title from machines where lower(title) = lower('HUNGRY YETI') group by all")
def filter_title_ci(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "machines").filter(P.equal_ci(F.col("title"), F.lit("HUNGRY YETI"))).select("opdb_id", "title").distinct()


@q("select doc_id, title from documents where title is not null and (contains(lower(title), 'yeti') or contains('yeti', lower(title)))")
def filter_contains_either_way(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "documents").filter(P.contains_either_way(F.col("title"), F.lit("yeti"))).select("doc_id", "title")


@q("""select change_id, document_type from scraped_changes where contains(lower(document_url), 'shared') and lower(document_type) = 'manual'""")
def filter_source_pattern(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "scraped_changes").filter(P.source_pattern("shared|Manual", F.col("document_url"), F.col("document_type"))).select("change_id", "document_type")


@q("select document_id, chunk_count from index_state where document_id >= 'doc-a' and document_id < 'doc-b'")
def filter_prefix_range(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "index_state").filter(P.prefix_range("document_id", "doc-a")).select("document_id", "chunk_count")


@q("select o_orderkey, o_totalprice from orders where o_totalprice > 400000 and lower(o_orderpriority) like '%urgent%'")
def filter_grid(s: SparkSession, d: str) -> DataFrame:
    """Grid conditions: numbers compare as numbers, text by substring."""
    o = T(s, d, "orders")
    return o.filter(P.grid("o_totalprice", "gt", "400000") & P.grid("o_orderpriority", "contains", "URGENT")).select("o_orderkey", "o_totalprice")


@q("select opdb_id, title from machines where year is null")
def filter_grid_null(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "machines").filter(P.grid("year", "equals", "")).select("opdb_id", "title")


@q("select p_partkey from part where contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'steel')")
def filter_any_text(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "part")
    return p.filter(P.any_text(p, "steel")).select("p_partkey")


@q("select hit_id, round(least(greatest(coalesce(score, 0) / 4.0, 0), 1), 6) as norm from search_hits where least(greatest(coalesce(score, 0) / 4.0, 0), 1) >= 0.5 group by all")
def filter_min_score(s: SparkSession, d: str) -> DataFrame:
    from tiltyard.functions.metrics import normal_score

    n = normal_score(F.coalesce("score", F.lit(0.0)))
    return T(s, d, "search_hits").select("hit_id", n.alias("n")).filter("n >= 0.5").select("hit_id", F.round("n", 6).alias("norm")).distinct()


@q("""select opdb_id, (title is not null)::int + (year is not null)::int + (edition_label is not null)::int + (opdb_source_url is not null)::int
    + (len(themes) > 0)::int + (len(designers) > 0)::int as completeness from machines""")
def completeness_score(s: SparkSession, d: str) -> DataFrame:
    full = P.completeness(*(F.col(c).isNotNull() for c in ("title", "year", "edition_label", "opdb_source_url")), F.size("themes") > 0, F.size("designers") > 0)
    return T(s, d, "machines").select("opdb_id", full.alias("completeness"))


_KINDS = "case " + " ".join(f"when contains(lower(text), '{n}') then '{v}'" for n, v in P.TEXT_RULES) + " else 'Other' end"


@q(f"select kind, count(*) as docs from (select {_KINDS} as kind from (select coalesce(title, '') || ' ' || coalesce(document_type, '') as text from documents)) group by 1")
def classify_first_match(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d, "documents").select(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("document_type", F.lit(""))).alias("text"))
    return t.select(P.document_type(F.col("text"), F.lit("")).alias("kind")).groupBy("kind").agg(F.count("*").alias("docs"))


@q("""with k as (select document_id, last_value(document_type order by change_id) old, case when contains(lower(last_value(document_url order by change_id)), 'shared') then 'Shared' else 'Own' end side
    from scraped_changes where document_url is not null and document_type is not null group by 1) select old as old_type, side as new_type, count(*) as documents from k group by all""".replace("last_value(document_type order by change_id)", "max_by(document_type, change_id)").replace("last_value(document_url order by change_id)", "max_by(document_url, change_id)"))
def reclassify_transitions(s: SparkSession, d: str) -> DataFrame:
    """How types change when a rule is applied anew: old type, new type, documents."""
    c = T(s, d, "scraped_changes").filter("document_url is not null and document_type is not null")
    k = R.latest_per_key(c.select("document_id", "change_id", "document_type", "document_url"), "document_id", "change_id")
    side = F.when(F.contains(F.lower("document_url"), F.lit("shared")), "Shared").otherwise("Own")
    return k.groupBy(F.col("document_type").alias("old_type"), side.alias("new_type")).agg(F.count("*").alias("documents"))


@q("""select change_id, case lower(regexp_extract(document_url, '[.]([A-Za-z0-9]{1,5})$', 1)) when 'pdf' then 'view' when 'zip' then 'download' when '' then 'page' else 'other' end as action
    from scraped_changes where document_url is not null""")
def classify_action(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "scraped_changes").filter("document_url is not null").select("change_id", P.action_type(F.col("document_url")).alias("action"))


@q("""select maker, count(*) as rows from (select case when manufacturer is null then 'unknown' when contains(lower(manufacturer), 'quillon') then 'quillon'
    when regexp_replace(lower(manufacturer), '[^a-z0-9]', '', 'g') = '' then 'unknown' else regexp_replace(lower(manufacturer), '[^a-z0-9]', '', 'g') end as maker from scraped_changes) group by 1""")
def normalise_maker(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d, "scraped_changes").select(P.maker_key(F.col("manufacturer"), [("quillon", "quillon")]).alias("maker"))
    return c.groupBy("maker").agg(F.count("*").alias("rows"))


@q("select opdb_id, coalesce(nullif(trim(edition_label), ''), nullif(trim(title), '')) as label, year(first_seen_at) as seen_year from machines")
def coalesce_chain(s: SparkSession, d: str) -> DataFrame:
    m = T(s, d, "machines")
    return m.select("opdb_id", X.first_non_blank(F.col("edition_label"), F.col("title")).alias("label"), X.lenient_year(F.col("first_seen_at").cast("string")).alias("seen_year"))


# ---- joins


@q("""select o_orderkey, coalesce(c_name, 'Customer ' || o_custkey) as customer, o_totalprice from orders left join customer on o_custkey = c_custkey and c_acctbal > 0""")
def join_standings(s: SparkSession, d: str) -> DataFrame:
    """Left join with a made-up name where the other side is missing."""
    c = T(s, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    j = T(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("customer"), "o_totalprice")


@q("""select alias_id, split_part(machine_id, '-', 1) as base, t.title from alias_entries a left join (select distinct group_id, title from machines) t on t.group_id = split_part(machine_id, '-', 1)
    where machine_id is not null""")
def join_alias_base(s: SparkSession, d: str) -> DataFrame:
    """Aliases joined to their base by the first segment of the id."""
    a = T(s, d, "alias_entries").filter("machine_id is not null").select("alias_id", F.split_part("machine_id", F.lit("-"), F.lit(1)).alias("base"))
    t = T(s, d, "machines").select(F.col("group_id").alias("base"), "title").distinct()
    return a.join(t, "base", "left").select("alias_id", "base", "title")


@q("""select m.opdb_id, coalesce(nullif(s.edition_label, ''), m.edition_label) as label from (select distinct opdb_id, edition_label from machines) m
    left join (select machine_id, arg_max_null(edition_label, (as_of_utc, stat_id)) edition_label from doc_stats group by 1) s on s.machine_id = m.opdb_id""")
def join_overlay(s: SparkSession, d: str) -> DataFrame:
    """Enrichment overlay: the other side's value where it has one."""
    x = R.latest_per_key(T(s, d, "doc_stats").select(F.col("machine_id").alias("opdb_id"), F.col("edition_label").alias("typed"), "as_of_utc", "stat_id"), "opdb_id", "as_of_utc", "stat_id")
    m = T(s, d, "machines").select("opdb_id", "edition_label").distinct()
    return m.join(x, "opdb_id", "left").select("opdb_id", F.coalesce(F.nullif("typed", F.lit("")), "edition_label").alias("label"))


@q("select distinct document_id from chunks c where document_id is not null and not exists (select 1 from index_state i where i.document_id = c.document_id and i.removed_utc is null)")
def anti_orphan_chunks(s: SparkSession, d: str) -> DataFrame:
    live = T(s, d, "index_state").filter("removed_utc is null").select("document_id")
    return T(s, d, "chunks").filter("document_id is not null").select("document_id").distinct().join(live, "document_id", "left_anti")


@q("select distinct lower(document_id) as document_id, machine_id from scraped_changes where machine_id is not null and not exists (select 1 from index_state i where lower(i.document_id) = lower(scraped_changes.document_id) and i.machine_id = scraped_changes.machine_id)")
def anti_stale_pairs(s: SparkSession, d: str) -> DataFrame:
    """(document, machine) pairs that the index doesn't hold."""
    keep = T(s, d, "index_state").select(F.lower("document_id").alias("document_id"), "machine_id")
    return T(s, d, "scraped_changes").filter("machine_id is not null").select(F.lower("document_id").alias("document_id"), "machine_id").distinct().join(keep, ["document_id", "machine_id"], "left_anti")


@q("""select distinct a.group_id, a.manufacturer_key as stale, b.manufacturer_key as current from machines a join (select group_id, max_by(manufacturer_key, (last_seen_at, opdb_id)) manufacturer_key from machines group by 1) b
    on a.group_id = b.group_id and a.manufacturer_key <> b.manufacturer_key""")
def stale_partition_copies(s: SparkSession, d: str) -> DataFrame:
    """Rows of an id in another partition than its latest row."""
    m = T(s, d, "machines").select("group_id", "manufacturer_key", "last_seen_at", "opdb_id")
    now = R.latest_per_key(m, "group_id", "last_seen_at", "opdb_id").select("group_id", F.col("manufacturer_key").alias("current"))
    return m.join(now, "group_id").filter("manufacturer_key <> current").select("group_id", F.col("manufacturer_key").alias("stale"), "current").distinct()


@q("""select c_custkey, round(date_diff('second', max(o_orderdate), timestamp '2000-01-01') / 3600.0, 3) as hours from customer left join orders on c_custkey = o_custkey
    group by 1 having max(o_orderdate) is null or date_diff('second', max(o_orderdate), timestamp '2000-01-01') / 3600.0 > 24 * 365""")
def overdue_schedules(s: SparkSession, d: str) -> DataFrame:
    """Expected keys never seen, or seen too long ago."""
    last = T(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    at = F.unix_micros(F.lit("2000-01-01").cast("timestamp"))
    j = T(s, d, "customer").select("c_custkey").join(last, "c_custkey", "left").withColumn("h", F.floor((at - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6) / 3600.0)
    return j.filter("last is null or h > 24 * 365").select("c_custkey", F.round("h", 3).alias("hours"))


@q("""select coalesce(i.document_id, c.document_id) as document_id, i.n as want, c.n as have, case when i.n is null then 'Unexpected' when coalesce(c.n, 0) = 0 then case when i.n = 0 then 'Match' else 'Missing' end
    when i.n = c.n then 'Match' else 'CountMismatch' end as status from (select document_id, max(chunk_count)::bigint n from index_state where removed_utc is null group by 1) i
    full join (select document_id, count(distinct chunk_id) n from chunks where document_id is not null group by 1) c on i.document_id = c.document_id""")
def drift_classify(s: SparkSession, d: str) -> DataFrame:
    """Chunk counts that the index state claims against those found."""
    i = T(s, d, "index_state").filter("removed_utc is null").groupBy("document_id").agg(F.max("chunk_count").cast("bigint").alias("want"))
    c = T(s, d, "chunks").filter("document_id is not null").groupBy("document_id").agg(F.count_distinct("chunk_id").alias("have"))
    return R.drift(i, c, "document_id", "want", "have").select("document_id", "want", "have", "status")


@q("""with t as (select distinct title t, lower(title) k, group_id g from machines where title is not null)
    select s.t as short_title, s.g as short_group, l.t as long_title, l.g as long_group from t s join t l on (starts_with(l.k, s.k || ': ') or starts_with(l.k, s.k || ' - ')) and s.g is distinct from l.g""")
def superset_titles(s: SparkSession, d: str) -> DataFrame:
    return R.superset_titles(T(s, d, "machines"), "title", "group_id")


_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@q(f"""with qs as (select distinct result_id, {_KEY.format('question')} k from eval_answers where question is not null),
    n as (select distinct {_KEY.format('title')} k from machines), m as (select k, len(string_split(k, ' ')) m from n where k <> ''),
    h as (select result_id, m.k, m from qs join m on contains(' ' || qs.k || ' ', ' ' || m.k || ' '))
    select result_id, k as title_key, m::int as words from h qualify m = max(m) over (partition by result_id)""")
def longest_containment(s: SparkSession, d: str) -> DataFrame:
    """The longest machine titles that stand in a question."""
    k = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    qs = T(s, d, "eval_answers").filter("question is not null").select("result_id", k("question").alias("qk")).distinct()
    return R.longest_containment(qs, "result_id", "qk", T(s, d, "machines").select(k("title").alias("title_key")), "title_key")


@q("""with m as (select distinct opdb_id id, group_id g, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) k from machines), a as (select alias_id, trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) k from alias_entries where alias is not null),
    st as (select alias_id, g, 0 s from a join m using (k) union all select alias_id, g, 1 from a join m on regexp_replace(a.k, ' (pinball|edition|pro|le)$', '') = m.k and a.k <> m.k)
    select alias_id, min(s) as stage, count(distinct g) as groups from (select *, min(s) over (partition by alias_id) f from st) where s = f group by 1""")
def staged_match(s: SparkSession, d: str) -> DataFrame:
    """Aliases by exact key, then without a trailing qualifier: the first stage that hits counts."""
    k = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    m = T(s, d, "machines").select(F.col("group_id").alias("g"), k("title").alias("k")).distinct()
    a = T(s, d, "alias_entries").filter("alias is not null").select("alias_id", k("alias").alias("k"))
    bare = a.withColumn("k2", F.regexp_replace("k", " (pinball|edition|pro|le)$", "")).filter("k2 <> k").select("alias_id", F.col("k2").alias("k"))
    hit = R.staged([a.join(m, "k").select("alias_id", "g"), bare.join(m, "k").select("alias_id", "g")], "alias_id")
    return hit.groupBy("alias_id").agg(F.min("stage").alias("stage"), F.count_distinct("g").alias("groups"))


@q(f"""with q as (select alias_id row, {title_key_sql("alias")} k from alias_entries), {RESOLVE_SQL} select alias_id, coalesce(status, 'NoMatch') as status, stage, array_to_string(ids, ',') as ids from alias_entries left join resolved on row = alias_id""")
def resolve_titles(s: SparkSession, d: str) -> DataFrame:
    """Aliases resolved to machines: exact, stripped, containment; Resolved, Family, Ambiguous or NoMatch."""
    r = R.resolve_titles(T(s, d, "alias_entries").select("alias_id", "alias"), "alias_id", "alias", T(s, d, "machines"), "opdb_id", "title", "group_id")
    return r.select("alias_id", "status", "stage", F.array_join("ids", ",").alias("ids"))


@q("""select r.manufacturer_key, r.group_id, r.machine_id, r.doc_count as docs, max(doc_count) over (partition by manufacturer_key, group_id) as most,
    case when r.doc_count = 0 then 'Empty' when max(doc_count) over (partition by manufacturer_key, group_id) > r.doc_count then 'EditionGap' when not r.has_manual then 'NoManual' else 'Ok' end as health
    from (select manufacturer as manufacturer_key, group_id, machine_id, max_by(doc_count, (as_of_utc, stat_id)) doc_count, max_by(has_manual, (as_of_utc, stat_id)) has_manual from doc_stats where group_id is not null group by 1, 2, 3) r""")
def health_flags(s: SparkSession, d: str) -> DataFrame:
    """Machines without documents, without a manual, or behind their group's fullest edition."""
    x = T(s, d, "doc_stats").filter("group_id is not null").groupBy(F.col("manufacturer").alias("manufacturer_key"), "group_id", "machine_id")
    r = x.agg(F.max_by(F.struct("doc_count", "has_manual"), F.struct("as_of_utc", "stat_id")).alias("l")).select("manufacturer_key", "group_id", "machine_id", F.col("l.doc_count").alias("docs"), "l.has_manual")
    most = F.max("docs").over(W.partitionBy("manufacturer_key", "group_id"))
    health = F.when(F.col("docs") == 0, "Empty").when(F.col("most") > F.col("docs"), "EditionGap").when(~F.col("has_manual"), "NoManual").otherwise("Ok")
    return r.withColumn("most", most).select("manufacturer_key", "group_id", "machine_id", "docs", "most", health.alias("health"))


@q("""select i.document_id, case when s.content_hash is null then 'missing' when s.content_hash = i.h then 'OK' else 'MISMATCH' end as status
    from (select document_id, max_by(last_indexed_hash, (recorded_utc, first_recorded_utc)) h from index_state where last_indexed_hash is not null group by 1) i
    left join (select document_id, max_by(content_hash, (received_at, change_id)) content_hash from scraped_changes where content_hash is not null group by 1) s on s.document_id = i.document_id""")
def checksum_compare(s: SparkSession, d: str) -> DataFrame:
    i = T(s, d, "index_state").filter("last_indexed_hash is not null").groupBy("document_id").agg(F.max_by("last_indexed_hash", F.struct("recorded_utc", "first_recorded_utc")).alias("h"))
    c = T(s, d, "scraped_changes").filter("content_hash is not null").groupBy("document_id").agg(F.max_by("content_hash", F.struct("received_at", "change_id")).alias("now"))
    j = i.join(c, "document_id", "left")
    return j.select("document_id", F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("h"), "OK").otherwise("MISMATCH").alias("status"))


@q("""select change_id, 'process' as action from scraped_changes c left join (select document_id, max_by(last_indexed_hash, (recorded_utc, first_recorded_utc)) h from index_state group by 1) i on i.document_id = c.document_id
    where content_hash is not null and (h is null or h <> content_hash)""")
def hash_shortcircuit(s: SparkSession, d: str) -> DataFrame:
    """Changes whose content differs from what was indexed last; an unknown former hash is processed."""
    i = T(s, d, "index_state").groupBy("document_id").agg(F.max_by("last_indexed_hash", F.struct("recorded_utc", "first_recorded_utc")).alias("h"))
    c = T(s, d, "scraped_changes").filter("content_hash is not null").select("change_id", "document_id", "content_hash")
    return c.join(i, "document_id", "left").filter(~F.col("h").eqNullSafe(F.col("content_hash"))).select("change_id", F.lit("process").alias("action"))


@q("""with e as (select distinct machine_id from doc_stats where has_manual), g as (select distinct split_part(machine_id, '-', 1) g from e) select distinct m.opdb_id, m.group_id from g join machines m on m.group_id = g.g""")
def edition_fan_out(s: SparkSession, d: str) -> DataFrame:
    """From edition ids to all siblings of their groups."""
    g = T(s, d, "doc_stats").filter("has_manual").select(F.split_part("machine_id", F.lit("-"), F.lit(1)).alias("group_id")).distinct()
    return T(s, d, "machines").select("opdb_id", "group_id").join(g, "group_id").distinct().select("opdb_id", "group_id")


# ---- set operations and provenance


@q("select key, source from (select distinct manufacturer_key as key, 'machine' as source from machines union all select distinct manufacturer, 'stats' from doc_stats) where key is not null")
def union_sources(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "machines").select(F.col("manufacturer_key").alias("key"), F.lit("machine").alias("source"))
    b = T(s, d, "doc_stats").select(F.col("manufacturer").alias("key"), F.lit("stats").alias("source"))
    return a.unionByName(b).filter("key is not null").distinct()


@q("""select result_id, len(list_distinct(list_intersect(p, e)))::int as both, len(list_distinct(p))::int as said, len(list_distinct(e))::int as wanted,
    (len(list_distinct(p)) = len(list_distinct(e)) and len(list_distinct(list_intersect(p, e))) = len(list_distinct(e))) as same
    from (select distinct result_id, list_transform(coalesce(predicted_citation_set, []), lambda x: lower(x)) p, list_transform(coalesce(expected_citation_set, []), lambda x: lower(x)) e from eval_answers)""")
def citation_set_algebra(s: SparkSession, d: str) -> DataFrame:
    from tiltyard.functions.metrics import id_set

    p, e = id_set(F.col("predicted_citation_set")), id_set(F.col("expected_citation_set"))
    n = F.size(F.array_intersect(p, e))
    return T(s, d, "eval_answers").select("result_id", n.alias("both"), F.size(p).alias("said"), F.size(e).alias("wanted"), ((F.size(p) == F.size(e)) & (n == F.size(e))).alias("same")).distinct()


@q("""select text_key, count(*) as copies, min(doc_id) as primary_id, min_by(source, doc_id) as primary_source, count(distinct source) as sources, max(machine_id) as machine_id
    from (select *, sha256(text) as text_key from documents) group by 1 having count(*) > 1""")
def merge_provenance(s: SparkSession, d: str) -> DataFrame:
    """Exact copies merged: the first row is kept, sources are counted, gaps are filled from the copies."""
    t = T(s, d, "documents").select(F.sha2("text", 256).alias("text_key"), "doc_id", "source", "machine_id")
    g = t.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("primary_id"), F.min_by("source", "doc_id").alias("primary_source"), F.count_distinct("source").alias("sources"), F.max("machine_id").alias("machine_id"))
    return g.filter("copies > 1")


@q("select coalesce(o.k, n.k) as k, coalesce(n.v, o.v) as v from (select n_nationkey k, n_name v from nation where n_nationkey < 15) o full join (select n_nationkey k, upper(n_name) v from nation where n_nationkey >= 10) n on o.k = n.k")
def merge_upsert(s: SparkSession, d: str) -> DataFrame:
    """Upsert by key, the later write wins."""
    n = T(s, d, "nation")
    old = n.filter("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"), F.lit(1).alias("at"))
    new = n.filter("n_nationkey >= 10").select(F.col("n_nationkey").alias("k"), F.upper("n_name").alias("v"), F.lit(2).alias("at"))
    return R.merge_upsert(old, new, ["k"], "at").select("k", "v")


@q("select n_nationkey, n_name from nation where n_regionkey <> 2")
def delete_by_key(s: SparkSession, d: str) -> DataFrame:
    n = T(s, d, "nation")
    return R.delete_keys(n, n.filter("n_regionkey = 2"), ["n_nationkey"]).select("n_nationkey", "n_name")


@q("""select evaluation_id, v::int as version, (v = max(v) over ()) as is_active from (select evaluation_id, row_number() over (order by min(started_at), evaluation_id) v from eval_answers group by 1)""")
def append_versions(s: SparkSession, d: str) -> DataFrame:
    """Append-only versions: numbered in order of time, the last one active. One row per version, so the window is small."""
    v = T(s, d, "eval_answers").groupBy("evaluation_id").agg(F.min("started_at").alias("at")).withColumn("version", F.row_number().over(W.orderBy("at", "evaluation_id")))
    return v.select("evaluation_id", "version", (F.col("version") == F.max("version").over(W.partitionBy())).alias("is_active"))


# ---- windows and top-k


@q("select user_id, max_by(event_id, (ts, event_id)) as event_id, max_by(event_type, (ts, event_id)) as event_type from events group by 1")
def latest_per_key(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    return R.latest_per_key(e, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@q("""select p_partkey, p_brand, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) n from part) where n = 1 order by p_retailprice desc, p_partkey limit 10""")
def collapse_groups_topk(s: SparkSession, d: str) -> DataFrame:
    return R.first_per_key(T(s, d, "part"), [F.col("p_brand")], [F.desc("p_retailprice"), F.col("p_partkey")], 10).select("p_partkey", "p_brand", "p_retailprice")


@q("""select group_id, opdb_id from (select *, row_number() over (partition by group_id order by (edition_label is not null)::int + (opdb_source_url is not null)::int desc, coalesce(year, 0) desc, opdb_id) n
    from (select distinct group_id, opdb_id, edition_label, opdb_source_url, year from machines)) where n = 1""")
def best_with_tiebreak(s: SparkSession, d: str) -> DataFrame:
    m = T(s, d, "machines").select("group_id", "opdb_id", "edition_label", "opdb_source_url", "year").distinct()
    full = P.completeness(F.col("edition_label").isNotNull(), F.col("opdb_source_url").isNotNull())
    return R.first_per_key(m, [F.col("group_id")], [F.desc(full), F.desc(F.coalesce("year", F.lit(0))), F.col("opdb_id")]).select("group_id", "opdb_id")


@q("""with c as (select group_id, opdb_id, len(string_split(title, ' ')) n from (select distinct group_id, opdb_id, title || coalesce(' ' || edition_label, '') as title from machines))
    select group_id, min(opdb_id) as opdb_id from (select *, min(n) over (partition by group_id) m from c) where n = m group by 1 having count(*) = 1""")
def most_specific_unique(s: SparkSession, d: str) -> DataFrame:
    """The candidate with fewest words of each group, where there is one."""
    m = T(s, d, "machines").select("group_id", "opdb_id", F.concat("title", F.coalesce(F.concat(F.lit(" "), "edition_label"), F.lit(""))).alias("t")).distinct()
    c = m.withColumn("n", F.size(F.split("t", " "))).groupBy("group_id", "n").agg(F.count("*").alias("k"), F.min("opdb_id").alias("o"))
    return c.groupBy("group_id").agg(F.min_by(F.struct("k", "o"), "n").alias("b")).filter("b.k = 1").select("group_id", F.col("b.o").alias("opdb_id"))


@q("""select user_id, event_id, streak::int as streak from (select *, sum(f) over (partition by user_id, g order by ts, event_id) streak from (select *, (event_type = 'error')::int f, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) g from events)) where f = 1""")
def failure_streaks(s: SparkSession, d: str) -> DataFrame:
    e = R.runs(T(s, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return e.filter("event_type = 'error'").select("user_id", "event_id", F.col("streak").cast("int").alias("streak"))


@q("""select event_id, user_id, prior::int as prior, (prior >= 3) as over_budget from (select *, count(*) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) prior from events where event_type = 'error')""")
def attempt_budget(s: SparkSession, d: str) -> DataFrame:
    """Attempts of a key before each failure; three or more are over budget."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    e = T(s, d, "events").filter("event_type = 'error'").withColumn("prior", F.count("*").over(w).cast("int"))
    return e.select("event_id", "user_id", "prior", (F.col("prior") >= 3).alias("over_budget"))


@q("""with recursive o as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) n from events),
    r as (select user_id, event_id, n, ts st, 1 used from o where n = 1 union all select o.user_id, o.event_id, o.n, case when o.ts - r.st >= interval '3600 seconds' then o.ts else r.st end, case when o.ts - r.st >= interval '3600 seconds' then 1 else r.used + 1 end from r join o on o.user_id = r.user_id and o.n = r.n + 1)
    select event_id, user_id, used <= 3 as allowed from r""")
def rate_limiter(s: SparkSession, d: str) -> DataFrame:
    """Hourly windows anchored at the first event after the last window, three events each."""
    return R.anchored_windows(T(s, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", 3600, 3).select("event_id", "user_id", "allowed")


@q("select hit_id, retrieved_at, score from (select distinct hit_id, retrieved_at, score from search_hits) order by retrieved_at desc, hit_id limit 50")
def top_recent(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "search_hits").select("hit_id", "retrieved_at", "score").distinct().orderBy(F.desc("retrieved_at"), "hit_id").limit(50)


@q("select opdb_id from (select distinct opdb_id from machines) order by opdb_id limit 20 offset 40")
def page_of_rows(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "machines").select("opdb_id").distinct().orderBy("opdb_id").offset(40).limit(20)


@q("""select document_type, hit_id, n::int as n from (select *, row_number() over (partition by document_type order by score desc, hit_id) n from (select distinct document_type, hit_id, score from search_hits where document_type is not null)) where n <= 3""")
def picks_per_category(s: SparkSession, d: str) -> DataFrame:
    h = T(s, d, "search_hits").filter("document_type is not null").select("document_type", "hit_id", "score").distinct()
    return h.withColumn("n", F.row_number().over(W.partitionBy("document_type").orderBy(F.desc("score"), "hit_id"))).filter("n <= 3").select("document_type", "hit_id", "n")


@q("""with recursive r(node, p) as (select min(opdb_id), 0 from machines union select distinct b.opdb_id, 0 from r join machines a on a.opdb_id = r.node join machines b on (a.manufacturer_key = b.manufacturer_key and a.year = b.year))
    select distinct node from r""")
def fixpoint_closure(s: SparkSession, d: str) -> DataFrame:
    """Machines linked to the first one by maker and year, until a pass adds none."""
    m = T(s, d, "machines").filter("year is not null").select("opdb_id", F.concat_ws("|", "manufacturer_key", F.col("year").cast("string")).alias("k")).distinct()
    e = m.select(F.col("opdb_id").alias("src"), F.col("k").alias("dst")).unionByName(m.select(F.col("k").alias("src"), F.col("opdb_id").alias("dst")))
    seed = T(s, d, "machines").agg(F.min("opdb_id").alias("node"))
    return R.fixpoint(seed, e, "src", "dst").join(T(s, d, "machines").select(F.col("opdb_id").alias("node")).distinct(), "node", "left_semi").select("node")


@q("select doc_id, 'doc_' || substr(sha256(lower(coalesce(document_id, '') || '/' || source)), 1, 16) as id, 'chk_' || substr(sha256(coalesce(machine_id, '') || '|' || coalesce(document_id, '') || '|' || '1' || '-' || '2' || '#' || '0'), 1, 16) as cid, substr(sha256(title || '::v1'), 1, 32) as ckey from documents")
def identity_keys(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d, "documents")
    url = F.concat(F.coalesce("document_id", F.lit("")), F.lit("/"), F.col("source"))
    return t.select("doc_id", ident.document_id(url).alias("id"), ident.chunk_id(F.col("machine_id"), F.coalesce("document_id", F.lit("")), F.lit(1), F.lit(2), F.lit(0)).alias("cid"), ident.cache_key(F.col("title"), F.lit("v1")).alias("ckey"))


QUERIES, ORACLE = q.queries, q.oracle
