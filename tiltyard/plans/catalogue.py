"""Queries for catalogue maintenance and the functions around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tiltyard.functions import jsonshape, phonetic
from tiltyard.functions import text as X
from tiltyard.operators import answers, catalog, rules
from tiltyard.operators import predicates as P
from tiltyard.plans.registry import Registry
from tiltyard.plans.relational import title_key_sql
from tiltyard.session import table as T

q = Registry()


@q("""select distinct opdb_id, token from (select opdb_id, unnest(list_filter(string_split(trim(regexp_replace(lower(coalesce(edition_label, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w not in ('', 'edition', 'the', 'of'))) as token from machines)""")
def edition_tokens(s: SparkSession, d: str) -> DataFrame:
    return catalog.edition_rows(T(s, d, "machines"), "opdb_id", "edition_label")


@q("""with v as (select distinct opdb_id, manufacturer m, unnest([title, regexp_replace(title, '\\s+[aA][nN][dD]\\s+', ' & ', 'g'), regexp_replace(title, '\\s*&\\s*', ' and ', 'g')]) t from machines)
    select distinct unnest([translate(lower(trim(t)), '/\\?#', '____'), translate(lower(trim(m || ' ' || t)), '/\\?#', '____')]) as k, opdb_id from v""")
def title_lookup_rows(s: SparkSession, d: str) -> DataFrame:
    return catalog.lookup_rows(T(s, d, "machines"), "opdb_id", "title", "manufacturer")


@q("select distinct opdb_id from machines m where removed_at is null and not exists (select 1 from doc_stats s where s.machine_id = m.opdb_id)")
def sync_stale(s: SparkSession, d: str) -> DataFrame:
    """Current machines that a full export (here: the rollup's machines) lacks."""
    export = T(s, d, "doc_stats").select(F.lit("machine").alias("kind"), F.col("machine_id").alias("opdb_id"))
    return catalog.sync(export, T(s, d, "machines").filter("removed_at is null"), "opdb_id")["stale"]


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@q(f"""with v as (select distinct opdb_id, manufacturer m, unnest([title, regexp_replace(title, '(?i)\\s+and\\s+', ' & ', 'g'), regexp_replace(title, '\\s*&\\s*', ' and ', 'g')]) t from machines),
    look as (select distinct unnest([translate(lower(trim(t)), '/\\?#', '____'), translate(lower(trim(m || ' ' || t)), '/\\?#', '____')]) k, opdb_id from v),
    qs as (select distinct alias_id, translate(lower(trim(alias)), '/\\?#', '____') k, string_split(trim(regexp_replace(regexp_replace(lower(alias), '[''’]s\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')), ' ') ws from alias_entries where alias is not null),
    w as (select alias_id, unnest(list_distinct(case when len(list_filter(ws, lambda x: x not in ({_STOP}))) = 0 then ws else list_filter(ws, lambda x: x not in ({_STOP})) end)) w from qs where ws <> ['']),
    mw as (select distinct opdb_id, f, w from (select opdb_id, (year is not null)::int + (edition_label is not null)::int + (opdb_source_url is not null)::int f, unnest(string_split({title_key_sql("title")}, ' ')) w from machines) where w not in ({_STOP})),
    sh as (select alias_id, opdb_id, count(*) n, max(f) f from w join mw using (w) group by 1, 2), hits as (select alias_id, 0 s, opdb_id from qs join look using (k) union all select alias_id, 1, opdb_id from (select alias_id, regexp_replace(k, '^\\S+\\s+', '') k from qs) join look using (k)
        union all select alias_id, 2, opdb_id from (select *, row_number() over (partition by alias_id order by n desc, f desc, opdb_id) p from sh) where p = 1)
    select alias_id, min(opdb_id) as opdb_id, s::int as stage from hits qualify true group by alias_id, s having s = (select min(s) from hits h where h.alias_id = hits.alias_id)""".replace(" qualify true", ""))
def find_titles(s: SparkSession, d: str) -> DataFrame:
    """The machine that each alias names, by the lookup cascade."""
    full = P.completeness(F.col("year").isNotNull(), F.col("edition_label").isNotNull(), F.col("opdb_source_url").isNotNull())
    a = T(s, d, "alias_entries").filter("alias is not null").select("alias_id", "alias")
    return catalog.find_title(a, "alias_id", "alias", T(s, d, "machines"), "opdb_id", "title", "manufacturer", full)


@q("""with k as (select distinct group_id g, manufacturer_key m, case when b = '' then c else b end k from (select *, regexp_replace(c, '(merlinedition|vaultedition|limitededition|standardedition|remake|pinball|gamekit|deposit|edition)$', '') b from (select *, regexp_replace(lower(strip_accents(title)), '[^a-z0-9]', '', 'g') c from machines))),
    sc as (select distinct document_id, manufacturer m, case when b = '' then c else b end k from (select *, regexp_replace(c, '(merlinedition|vaultedition|limitededition|standardedition|remake|pinball|gamekit|deposit|edition)$', '') b from (select *, regexp_replace(lower(strip_accents(machine_title)), '[^a-z0-9]', '', 'g') c from scraped_changes where machine_id is not null and machine_title is not null)))
    select document_id, case when count(distinct g) = 1 then min(g) end as group_id, count(distinct g) as groups from sc join k using (m, k) group by 1""")
def reconcile_titles(s: SparkSession, d: str) -> DataFrame:
    """Scraped titles to catalogue groups by full title within the maker."""
    c = T(s, d, "machines").select(F.col("group_id").alias("g"), F.col("manufacturer_key").alias("m"), X.compact_key(F.col("title")).alias("k")).distinct()
    x = T(s, d, "scraped_changes").filter("machine_id is not null and machine_title is not null").select("document_id", F.col("manufacturer").alias("m"), X.compact_key(F.col("machine_title")).alias("k")).distinct()
    g = x.join(c, ["m", "k"]).groupBy("document_id").agg(F.count_distinct("g").alias("groups"), F.min("g").alias("g"))
    return g.select("document_id", F.when(F.col("groups") == 1, F.col("g")).alias("group_id"), "groups")


def _compact(c: str) -> str:
    c = f"regexp_replace(lower(strip_accents({c})), '[^a-z0-9]', '', 'g')"
    return f"coalesce(nullif(regexp_replace({c}, '({'|'.join(X.TRAILING_QUALIFIERS)})$', ''), ''), {c})"


@q(f"""with c as (select distinct group_id g, manufacturer_key m, {_compact("title")} k1, {_compact("regexp_replace(title, '(?:: | - ).*$', '')")} k2 from machines), s as (select distinct document_id, manufacturer m, {_compact("machine_title")} k1, {_compact("regexp_replace(machine_title, ' *\\([^)]*\\) *$', '')")} k2 from scraped_changes where machine_title is not null),
    h as (select document_id, 0 st, g from s join c using (m, k1) union all select document_id, 1, c.g from s join c on s.m = c.m and s.k2 = c.k2), f as (select * from h qualify st = min(st) over (partition by document_id))
    select document_id, case when count(distinct g) = 1 then min(g) end as group_id, case when count(distinct g) > 1 then 'ambiguous' when st = 0 then 'title' else 'franchise' end as how from f group by document_id, st""")
def reconcile_games(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d, "scraped_changes").filter("machine_title is not null").select("document_id", F.col("machine_title").alias("title"), F.col("manufacturer").alias("manufacturer_key")).distinct()
    return catalog.reconcile(c, T(s, d, "machines"), "document_id", "title", "manufacturer_key", "opdb_id", "group_id")


@q("""select document_id, min_by(machine_title, change_id) filter (machine_title is not null) as machine_title, min_by(document_type, change_id) filter (document_type is not null) as document_type from scraped_changes c where document_id is not null and not exists (select 1 from index_state i where i.document_id = c.document_id) group by 1""")
def backfill_missing(s: SparkSession, d: str) -> DataFrame:
    return catalog.backfill(T(s, d, "scraped_changes").filter("document_id is not null"), T(s, d, "index_state"), "document_id", ["machine_title", "document_type"], "change_id")


@q("""with cells as (select m.k, t.document_type from (select distinct manufacturer_key k from machines) m cross join (select distinct document_type from chunks where document_type is not null) t),
    h as (select m.manufacturer_key k, s.document_type, min(s.hit_id) sample, bool_or(s.score >= 3.5) f from search_hits s join (select distinct opdb_id, manufacturer_key from machines) m on m.opdb_id = s.machine_id where s.document_type is not null group by 1, 2)
    select k as manufacturer_key, document_type, sample, case when sample is null then 'gap' when f then 'covered' else 'missed' end as state from cells left join h using (k, document_type)""")
def corpus_coverage(s: SparkSession, d: str) -> DataFrame:
    """Maker and document type cells: covered by a good hit, missed, or without any."""
    makers = T(s, d, "machines").select("manufacturer_key").distinct()
    kinds = [r[0] for r in T(s, d, "chunks").filter("document_type is not null").select("document_type").distinct().orderBy("document_type").limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("more than 1,000 document types: not an enumeration")
    cells = makers.withColumn("document_type", F.explode(F.array(*map(F.lit, kinds))) if kinds else F.explode(F.array().cast("array<string>")))
    h = T(s, d, "search_hits").filter("document_type is not null").join(T(s, d, "machines").select(F.col("opdb_id").alias("machine_id"), "manufacturer_key").distinct(), "machine_id")
    h = h.select("manufacturer_key", "document_type", "hit_id", F.when(F.col("score") >= 3.5, 1).otherwise(99).alias("rank"))
    return catalog.probe_coverage(h, cells, ["manufacturer_key", "document_type"], "hit_id", "rank").select("manufacturer_key", "document_type", "sample", "state")


@q("""select distinct hit_id, round(score * (1 + completeness / 6.0 + 0.5 * greatest(0, 1 - (epoch_us(timestamp '2026-09-01') - epoch_us(retrieved_at)) / 8.64e10 / 60)), 6) as boosted from (select hit_id, score, retrieved_at, (edition is not null)::int + (page_start is not null)::int + (section_heading is not null)::int as completeness from search_hits where score is not null)""")
def scoring_profile(s: SparkSession, d: str) -> DataFrame:
    """Scores boosted by completeness and freshness."""
    n = P.completeness(*(F.col(c).isNotNull() for c in ("edition", "page_start", "section_heading")))
    h = T(s, d, "search_hits").filter("score is not null")
    return h.select("hit_id", F.round(catalog.boost(F.col("score"), n, F.col("retrieved_at"), F.lit("2026-09-01")), 6).alias("boosted")).distinct()


@q("""select event_id, case when list_contains(json_keys(props), 'k') then 'counter' else 'unknown' end as shape from events""")
def json_shapes(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "events").select("event_id", jsonshape.shape_of(F.col("props"), [("tournament", ["tournamentId", "name"]), ("counter", ["K"])]).alias("shape"))


@q(f"""select change_id, case {" ".join(f"when contains(f, '{n}') then '{v}'" for n, v in rules.FILE_MARKS)} end as edition_mark, case when edition is null then 'franchise-wide' else 'single-edition' end as scope
    from (select change_id, edition, '_' || replace(lower(edition), ' ', '_') || '_' f from scraped_changes)""")
def edition_marks(s: SparkSession, d: str) -> DataFrame:
    """Edition marks of file names, first match wins."""
    f = F.concat(F.lit("_"), F.replace(F.lower("edition"), F.lit(" "), F.lit("_")), F.lit("_"))
    return T(s, d, "scraped_changes").select("change_id", X.first_marker(f, rules.FILE_MARKS).alias("edition_mark"), F.when(F.col("edition").isNull(), "franchise-wide").otherwise("single-edition").alias("scope"))


@q()
def phonetic_groups(s: SparkSession, d: str) -> DataFrame:
    """Titles that sound alike under different groups."""
    m = T(s, d, "machines").select("title", "group_id").distinct().withColumn("sound", phonetic.sounds_like(F.col("title")))
    return m.groupBy("sound").agg(F.count_distinct("group_id").alias("groups"), F.array_join(F.array_sort(F.collect_set("title")), " | ").alias("titles")).filter("groups > 1")


@q("""select result_id, n from (select distinct result_id, len(regexp_extract_all(answer_text, '\\[([0-9]+)\\]', 1))::int n from eval_answers where answer_text is not null) where n > 0""")
def citation_marks(s: SparkSession, d: str) -> DataFrame:
    """Citation marks in answers, counted."""
    e = T(s, d, "eval_answers").filter("answer_text is not null")
    return e.select("result_id", F.size(F.regexp_extract_all("answer_text", F.lit(r"\[([0-9]+)\]"), F.lit(1))).alias("n")).distinct().filter("n > 0")


@q("""select result_id, subject, named from (select distinct result_id, 'speaker panel' as subject, contains(' ' || trim(regexp_replace(lower(answer_text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' speaker panel ') as named from eval_answers where answer_text is not null) where named""")
def subject_named(s: SparkSession, d: str) -> DataFrame:
    """Answers that name a citation's subject as whole words."""
    e = T(s, d, "eval_answers").filter("answer_text is not null").select("result_id", F.lit("speaker panel").alias("subject"), "answer_text").distinct()
    return e.select("result_id", "subject", answers.subject_named(F.col("answer_text"), F.col("subject")).alias("named")).filter("named").distinct()


@q("""select query_id, place::int as place, hit_id from (select query_id, hit_id, row_number() over (partition by query_id order by score desc, hit_id) place from (select distinct query_id, hit_id, score from search_hits)) where place <= 3""")
def first_hits(s: SparkSession, d: str) -> DataFrame:
    """The three best hits of each query."""
    h = T(s, d, "search_hits").select("query_id", "hit_id", "score").distinct()
    return h.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "hit_id"))).filter("place <= 3").select("query_id", "place", "hit_id")


QUERIES, ORACLE = q.queries, q.oracle
