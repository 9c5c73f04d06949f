"""Queries of the rules over documents, machines, evaluations and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tiltyard.functions import jsonshape
from tiltyard.functions import metrics as M
from tiltyard.functions import text as X
from tiltyard.operators import rules as R
from tiltyard.operators import sinks
from tiltyard.plans.registry import Registry
from tiltyard.session import scratch
from tiltyard.session import table as T
from tiltyard.streaming import feed

q = Registry()


def _in(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_FEEDS = {"bulletin_feed": "ServiceBulletin", "manual_archive": "Manual"}


def _case(rules: tuple, by_source: dict[str, str]) -> str:
    out = "case " + " ".join(f"when source = '{s}' then '{v}'" for s, v in by_source.items())
    for side, needles, label in rules:
        c = {"url end": "ends_with(url, '{}')", "bulletin file": "contains(url, '{}') and contains(url, '.pdf')"}.get(side, "contains(" + side + ", '{}')")
        out += " when " + " or ".join(c.format(n) for n in needles) + f" then '{label}'"
    return out + " else 'Other' end"


@q(f"""select doc_id, {_case(R.DOCUMENT_RULES, _FEEDS)} as kind from (select doc_id, source, lower(coalesce(title, '')) as text, lower(coalesce(document_type, '')) as context, lower('https://x.example/' || source || '/' || coalesce(document_id, 'none') || case doc_id % 5 when 0 then '.zip' when 1 then '/sb-1.pdf' else '' end) as url from documents)""")
def document_types(s: SparkSession, d: str) -> DataFrame:
    """Types of documents by source, link text, context and address."""
    t = T(s, d, "documents")
    i = F.col("doc_id") % 5
    url = F.concat(F.lit("https://x.example/"), F.col("source"), F.lit("/"), F.coalesce("document_id", F.lit("none")), F.when(i == 0, ".zip").when(i == 1, "/sb-1.pdf").otherwise(""))
    return t.select("doc_id", R.classify_document(F.col("source"), F.col("title"), F.col("document_type"), url, _FEEDS).alias("kind"))


@q("""select p_partkey, case when p_size % 4 in (0, 1) then 'acme' when p_brand = 'Brand#11' then 'eleven' when p_brand = 'Brand#22' then null when p_brand = 'Brand#33' then 'three' end as maker from part""")
def maker_inference(s: SparkSession, d: str) -> DataFrame:
    """Makers by host, subdomains included but no names that merely hold it, then by type of source."""
    k = F.col("p_size") % 4
    url = F.when(k == 0, "https://ACME.example/a").when(k == 1, "https://s4.acme.example/b?c").when(k == 2, "https://acme.example.other/c").otherwise("https://other.example/go?to=acme.example")
    return T(s, d, "part").select("p_partkey", R.maker_of(F.col("p_brand"), url, {"Brand#11": "eleven", "Brand#22": None, "Brand#33": "three"}, {"acme.example": "acme"}).alias("maker"))


@q("""select change_id, starts_with(document_id, 'doc-a') and manufacturer in ('kestrelrow', 'quillon') as indexed, coalesce(manufacturer in ('kestrelrow', 'quillon'), false) as retrieved, starts_with(document_id, 'doc-a') as by_prefix from scraped_changes where manufacturer is not null""")
def source_recognition(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d, "scraped_changes").filter("manufacturer is not null")
    doc, mk, ms = F.col("document_id"), F.col("manufacturer"), ("kestrelrow", "quillon")
    return c.select("change_id", R.recognises(doc, mk, "doc-a", ms).alias("indexed"), R.recognises(doc, mk, "doc-a", ms, True).alias("retrieved"), R.recognises(doc, mk, "doc-a", (), True).alias("by_prefix"))


@q("""select alias_id, case when alias_id % 4 = 0 then null else 'alias' end as filter_column, case when alias_id % 4 = 0 then null else 'contains' end as operator, case when alias_id % 4 = 0 then null else alias end as value from alias_entries""")
def filters_from_text(s: SparkSession, d: str) -> DataFrame:
    """Filters read out of prose that holds a JSON object; prose without one gives none."""
    a = T(s, d, "alias_entries")
    j = F.to_json(F.struct(F.lit("alias").alias("column"), F.lit("contains").alias("operator"), F.col("alias").alias("value")))
    f = R.filter_of(F.when(F.col("alias_id") % 4 == 0, F.lit("I can't say.")).otherwise(F.concat(F.lit("Sure, this one:\n"), j, F.lit("\nAnything else?"))))
    return a.select("alias_id", f["column"].alias("filter_column"), f["operator"].alias("operator"), f["value"].alias("value"))


@q("""select distinct chunk_id, array_to_string(list_filter(string_split('We use cookies here.' || chr(10) || chr(10) || content || chr(10) || chr(10) || 'Your CONSENT matters.', chr(10) || chr(10)), lambda p: not contains(lower(p), 'cookie') and not contains(lower(p), 'consent')), chr(10) || chr(10)) as text from chunks where content is not null""")
def without_banners(s: SparkSession, d: str) -> DataFrame:
    """Texts without the paragraphs of consent banners."""
    t = F.concat(F.lit("We use cookies here.\n\n"), F.col("content"), F.lit("\n\nYour CONSENT matters."))
    return T(s, d, "chunks").filter("content is not null").select("chunk_id", X.drop_paragraphs(t, ("cookie", "consent")).alias("text")).distinct()


@q("""select event_id, regexp_full_match(n, 'job-[a-z]+-[0-9]+') and starts_with(n, 'job-' || event_type || '-') as scheduled, cron in ('0 3 * * *', '*/5 0-6 1,15 * 1') as cron_ok
    from (select event_id, event_type, case event_id % 3 when 0 then 'job-' || event_type || '-' || event_id when 1 then 'job-' || event_type || '-x' || event_id else 'job-' || event_id end n, case event_id % 4 when 0 then '0 3 * * *' when 1 then '*/5 0-6 1,15 * 1' when 2 then '* * * *' else 'daily at 3 * *' end cron from events)""")
def job_names(s: SparkSession, d: str) -> DataFrame:
    """Runs that a schedule started, by their names, and schedules that are well formed."""
    i, t = F.col("event_id"), F.concat(F.lit("job-"), F.col("event_type"))
    run = F.when(i % 3 == 0, F.concat(t, F.lit("-"), i.cast("string"))).when(i % 3 == 1, F.concat(t, F.lit("-x"), i.cast("string"))).otherwise(F.concat(F.lit("job-"), i.cast("string")))
    cron = F.when(i % 4 == 0, "0 3 * * *").when(i % 4 == 1, "*/5 0-6 1,15 * 1").when(i % 4 == 2, "* * * *").otherwise("daily at 3 * *")
    return T(s, d, "events").select("event_id", R.scheduled_run(t, run).alias("scheduled"), jsonshape.is_cron(cron).alias("cron_ok"))


@q("""with m as (select distinct opdb_id, group_id g from machines), t as (select alias_id, case when alias_id % 3 = 0 then machine_id || '-A7' else coalesce(machine_id, opdb_group_id) end x from alias_entries), k as (select * from t where trim(coalesce(x, '')) <> ''),
    h as (select alias_id, opdb_id, case when not contains(x, '-') or opdb_id = x then 0 when opdb_id = array_to_string(string_split(x, '-')[1:2], '-') then 1 end r from k join m on m.g = split_part(x, '-', 1))
    select distinct alias_id, opdb_id from h where r is not null qualify r = min(r) over (partition by alias_id)""")
def tip_targets(s: SparkSession, d: str) -> DataFrame:
    """The machines that tips are for: all of a group, the one named, or the one that a variant belongs to."""
    x = F.when(F.col("alias_id") % 3 == 0, F.concat(F.col("machine_id"), F.lit("-A7"))).otherwise(F.coalesce("machine_id", "opdb_group_id"))
    return R.tip_targets(T(s, d, "alias_entries").select("alias_id", x.alias("target")), "alias_id", "target", T(s, d, "machines"), "opdb_id", "group_id")


@q("""select alias_id, array_to_string(string_split(machine_id, '-')[1:2], '-') as base from alias_entries where machine_id is not null and array_to_string(string_split(machine_id, '-')[1:2], '-') not in (select opdb_id from machines)""")
def alias_orphans(s: SparkSession, d: str) -> DataFrame:
    """Aliases whose base machine the catalogue lacks."""
    a = T(s, d, "alias_entries").filter("machine_id is not null").select("alias_id", F.substring_index("machine_id", "-", 2).alias("base"))
    return a.join(T(s, d, "machines").select(F.col("opdb_id").alias("base")).distinct(), "base", "left_anti").select("alias_id", "base")


@q("""with l as (select document_id k, max(retrieved_at) e from search_hits group by 1) select distinct document_id, first_recorded_utc, case when removed_utc is null and failure_count > 0 and e is not null and e >= first_recorded_utc then e else removed_utc end as ended from index_state left join l on k = document_id""")
def run_ends(s: SparkSession, d: str) -> DataFrame:
    """Ends of runs filled from logs (here: life spans that failed, from their last hit), where these make sense."""
    i = T(s, d, "index_state").select("document_id", "first_recorded_utc", F.col("removed_utc").alias("ended"), "failure_count")
    return R.ended(i, "document_id", "first_recorded_utc", "ended", F.coalesce(F.col("failure_count") > 0, F.lit(False)), T(s, d, "search_hits"), "document_id", "retrieved_at").select("document_id", "first_recorded_utc", "ended").distinct()


@q("""with x as (select distinct manufacturer, split_part(document_url, '/', 4) slug, machine_id from scraped_changes where machine_id is not null and document_url is not null), m as (select distinct opdb_id, manufacturer_key from machines)
    select machine_id, array_to_string(list_sort(list(distinct manufacturer || ':' || slug)), ',') as slugs from x join m on m.opdb_id = x.machine_id and m.manufacturer_key = x.manufacturer where slug <> 'shared' group by 1""")
def slug_backfill(s: SparkSession, d: str) -> DataFrame:
    """Slugs of machines out of the addresses of their documents, distinct per maker and slug before the join."""
    x = T(s, d, "scraped_changes").filter("machine_id is not null and document_url is not null").select("manufacturer", F.split_part("document_url", F.lit("/"), F.lit(4)).alias("slug"), F.col("machine_id")).distinct()
    m = T(s, d, "machines").select(F.col("opdb_id").alias("machine_id"), F.col("manufacturer_key").alias("manufacturer")).distinct()
    j = x.filter("slug <> 'shared'").join(m, ["machine_id", "manufacturer"])
    return j.groupBy("machine_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "manufacturer", "slug"))), ",").alias("slugs"))


@q("""with o as (select split_part(document_url, '/', 3) || '|' || document_type p, array_to_string(list_sort(list(distinct machine_id))[1:2], ',') ids from scraped_changes where document_type in ('Manual', 'Flyer') and document_url is not null group by 1)
    select change_id, case when ids is null then 'manually_linked' when ids = '' then 'platform_generic' else 'manually_linked' end as status, coalesce(ids, '') as ids from scraped_changes c join o on o.p = split_part(document_url, '/', 3) || '|' || document_type""")
def link_overrides(s: SparkSession, d: str) -> DataFrame:
    """Documents that an override of their host and type links by hand (here: one that names a type's first two machines)."""
    c = T(s, d, "scraped_changes").filter("document_url is not null").withColumn("p", F.concat_ws("|", F.split_part("document_url", F.lit("/"), F.lit(3)), "document_type"))
    o = c.filter(F.col("document_type").isin("Manual", "Flyer")).select("p", "machine_id").distinct().groupBy("p").agg(F.slice(F.array_sort(F.collect_set("machine_id")), 1, 2).alias("ids"))
    status = F.when(F.size("ids") == 0, "platform_generic").otherwise("manually_linked")
    return c.join(o, "p").select("change_id", status.alias("status"), F.array_join("ids", ",").alias("ids"))


_SIMPLE = "string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '''', '', 'g'), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' ')"


@q(f"""with m as (select group_id g, min(title) t from machines group by 1), p as (select alias_id, {_SIMPLE.format("alias")} a, {_SIMPLE.format("t")} t from alias_entries join m on g = opdb_group_id where alias is not null and regexp_full_match(alias, '[a-z &'']*') and trim(alias) <> '')
    select alias_id, len(list_filter(t, lambda x: list_contains(a, x)))::int as overlap, len(list_filter(a, lambda x: len(list_filter(t, lambda y: x = y or (length(x) >= 3 and starts_with(y, x)))) > 0)) > 0 as matches, len(list_filter(a, lambda x: length(x) > 3 and list_contains(t, x))) > 0 as shares from p""")
def token_overlap(s: SparkSession, d: str) -> DataFrame:
    """Aliases in small letters against the titles of their groups: words in common, beginnings, words of four letters."""
    m = T(s, d, "machines").groupBy(F.col("group_id").alias("opdb_group_id")).agg(F.min("title").alias("t"))
    a = T(s, d, "alias_entries").filter("alias is not null and trim(alias) <> ''").filter(F.col("alias").rlike("^[a-z &']*$"))
    j = a.join(m, "opdb_group_id").select("alias_id", X.title_tokens(F.col("alias")).alias("a"), X.title_tokens(F.col("t")).alias("t"))
    long = lambda c: F.filter(c, lambda w: F.length(w) > 3)
    return j.select("alias_id", X.overlap_score(F.col("t"), F.col("a")).alias("overlap"), X.title_matches(F.col("t"), F.col("a")).alias("matches"), F.arrays_overlap(long("a"), long("t")).alias("shares"))


@q("""with r as (select manufacturer k, max(manufacturer_display_name) n, count(distinct machine_id) machines, sum(doc_count)::bigint documents from doc_stats where manufacturer is not null group by 1), s as (select upper(canon_key) i, any_value(label) l, bool_and(length(label) % 2 = 0) e from canonical_values where list_name = 'manufacturer' and canon_key < 'n' group by 1)
    select k as maker, coalesce(l, n, k) as display_name, e as enabled, i is not null as has_source, machines, documents from r left join s on lower(i) = lower(k)""")
def maker_overview(s: SparkSession, d: str) -> DataFrame:
    """Makers with the name of their source before their own, and whether that is enabled, disabled, or not known."""
    r = T(s, d, "doc_stats").filter("manufacturer is not null").groupBy(F.col("manufacturer").alias("maker")).agg(F.max("manufacturer_display_name").alias("n"), F.count_distinct("machine_id").alias("machines"), F.sum("doc_count").alias("documents"))
    c = T(s, d, "canonical_values").filter("list_name = 'manufacturer' and canon_key < 'n'").groupBy(F.upper("canon_key").alias("i")).agg(F.max("label").alias("l"), F.bool_and(F.length("label") % 2 == 0).alias("enabled"))
    j = r.join(c, F.lower("i") == F.lower("maker"), "left")
    return j.select("maker", F.coalesce("l", "n", "maker").alias("display_name"), "enabled", F.col("i").isNotNull().alias("has_source"), "machines", "documents")


@q("""with m as (select distinct opdb_id, group_id, edition_label from machines where group_id is not null), s as (select machine_id, max(doc_count) n from doc_stats group by 1)
    select group_id, opdb_id, coalesce(n, 0)::int as docs, row_number() over (partition by group_id order by lower(coalesce(edition_label, '')), opdb_id)::int as place from m left join s on machine_id = opdb_id""")
def sibling_counts(s: SparkSession, d: str) -> DataFrame:
    """The editions of a game in order of their labels, with their documents, none where the rollup lacks them."""
    m = T(s, d, "machines").filter("group_id is not null").select("opdb_id", "group_id", "edition_label").distinct()
    n = T(s, d, "doc_stats").groupBy(F.col("machine_id").alias("opdb_id")).agg(F.max("doc_count").alias("n"))
    place = F.row_number().over(W.partitionBy("group_id").orderBy(F.lower(F.coalesce("edition_label", F.lit(""))), "opdb_id"))
    return m.join(n, "opdb_id", "left").select("group_id", "opdb_id", F.coalesce("n", F.lit(0)).alias("docs"), place.alias("place"))


@q(f"""with qs as (select distinct question from eval_answers where question is not null), k as (select distinct question, unnest({_SIMPLE.format("question")}) w from qs), m as (select distinct title, unnest({_SIMPLE.format("title")}) w from machines where title is not null),
    n as (select question, title, count(*) n from k join m using (w) where length(w) > 2 and w not in ({_in(X.STOP_WORDS)}) group by 1, 2)
    select sha256(question) as question_hash, title, n as words, row_number() over (partition by question order by n desc, title)::int as place from n qualify row_number() over (partition by question order by n desc, title) <= 3""")
def related_titles(s: SparkSession, d: str) -> DataFrame:
    """The three titles that share most words with a question that got no answer."""
    qs = T(s, d, "eval_answers").filter("question is not null").select("question").distinct()
    word = (F.length("w") > 2) & ~F.col("w").isin(*X.STOP_WORDS)
    # a question's words, in its own normal form
    key = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("question"), "'", ""), "&", " and "), "[^a-z0-9]+", " "))
    k = qs.select("question", F.explode(F.array_distinct(F.split(key, " "))).alias("w")).filter(word)
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("title"), "'", ""), "&", " and "), "[^a-z0-9]+", " "))
    m = T(s, d, "machines").filter("title is not null").select("title").distinct().select("title", F.explode(F.array_distinct(F.split(t, " "))).alias("w")).filter(word)
    n = k.join(m, "w").groupBy("question", "title").agg(F.count("*").alias("words"))
    place = F.row_number().over(W.partitionBy("question").orderBy(F.desc("words"), "title"))
    return n.withColumn("place", place).filter("place <= 3").select(F.sha2("question", 256).alias("question_hash"), "title", "words", "place")


@q("""select event_id, ts from events where ts::date <= date '2024-01-20' and ts::date > date '2024-01-06' order by ts desc, event_id limit 40""")
def recent_by_day(s: SparkSession, d: str) -> DataFrame:
    """The newest forty events of fourteen days."""
    return R.recent_by_day(T(s, d, "events"), "ts", "2024-01-20", 40, ["event_id"]).select("event_id", "ts")


@q("""select event_id, (select count(*) > 100 from events where event_type = 'error') as truncated from events where event_type = 'error' order by ts, event_id limit 100""")
def log_tail(s: SparkSession, d: str) -> DataFrame:
    return R.log_tail(T(s, d, "events").filter("event_type = 'error'"), ["ts", "event_id"], 100).select("event_id", "truncated")


@q(f"""with w as (select distinct question q, list_filter({_SIMPLE.format("regexp_replace(lower(question), '''s\\b', '', 'g')").replace("&', ' and '", "&', ' '")}, lambda x: length(x) > 1 and x not in ({_in(R.SUGGEST_STOP)})) w from eval_answers where question is not null and not contains(question, chr(39)))
    select sha256(q) as question_hash, array_to_string(case when len(w) <= 1 then w when len(list_filter(w, lambda x: x not in ({_in(R.SUGGEST_INTENT)}))) > 0 then list_filter(w, lambda x: x not in ({_in(R.SUGGEST_INTENT)}))
    when len(list_filter(w, lambda x: x in ({_in(R.SUGGEST_NAMES)}))) > 0 then list_filter(w, lambda x: x in ({_in(R.SUGGEST_NAMES)})) else w end, ' ') as words from w""")
def suggest_words(s: SparkSession, d: str) -> DataFrame:
    """Questions as suggestion queries: without stop words and words of what is asked."""
    e = T(s, d, "eval_answers").filter("question is not null and not contains(question, chr(39))").select("question").distinct()
    return e.select(F.sha2("question", 256).alias("question_hash"), F.array_join(R.suggest_words(F.col("question")), " ").alias("words"))


@q(f"""with a as (select distinct alias_id, list_filter({_SIMPLE.format("alias").replace("&', ' and '", "&', ' '")}, lambda x: length(x) > 1 and x not in ({_in(R.SUGGEST_STOP)})) w from alias_entries where regexp_full_match(alias, '[A-Za-z &]+')),
    b as (select alias_id, unnest(list_distinct(case when len(w) <= 1 then w when len(list_filter(w, lambda x: x not in ({_in(R.SUGGEST_INTENT)}))) > 0 then list_filter(w, lambda x: x not in ({_in(R.SUGGEST_INTENT)})) when len(list_filter(w, lambda x: x in ({_in(R.SUGGEST_NAMES)}))) > 0 then list_filter(w, lambda x: x in ({_in(R.SUGGEST_NAMES)})) else w end)) x from a),
    m as (select coalesce('g:' || group_id, 'm:' || lower(title)) g, title, min(opdb_id) id from machines where title is not null group by 1, 2), t as (select g, title, id, unnest(list_distinct({_SIMPLE.format("title")})) y from m),
    h as (select alias_id, g, title, id, count(distinct case when x = y then x end) n from b join t on x = y or (length(x) >= 3 and starts_with(y, x)) group by 1, 2, 3, 4),
    c as (select * from h qualify row_number() over (partition by alias_id, g order by n desc, lower(title), id) = 1), r as (select *, row_number() over (partition by alias_id order by n desc, lower(title), id) p from c)
    select alias_id, id as opdb_id, title, n as score, p::int as place from r where p <= 8""")
def suggest_all(s: SparkSession, d: str) -> DataFrame:
    """Suggestions for all aliases of plain letters, as if typed into a search field."""
    a = T(s, d, "alias_entries").filter(F.col("alias").rlike("^[A-Za-z &]+$")).select("alias_id", "alias").distinct()
    return R.suggest_all(a, "alias_id", "alias", T(s, d, "machines"), "opdb_id", "title", "group_id")


def _marks(c: str, marks: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when contains({c}, '{n}') then '{v}'" for n, v in marks) + " end"


_ALL = "(" + " or ".join("contains({0}, '" + m + "')" for m in R.GROUP_MARKS) + ")"
_EDW = "list_distinct(list_concat(w, list_concat(case when list_contains(w, 'limited') then ['le'] else [] end, case when list_contains(w, 'prem') then ['premium'] else [] end)))"
_LABEL = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x not in ('', 'edition', 'the', 'of')))"


@q(f"""with d as (select distinct change_id, split_part(machine_id, '-', 1) g, lower('x_' || coalesce(replace(edition, ' ', '_'), 'none') || '_' || case when change_id % 6 = 0 then 'rulesheet' else 'y' end) f, case when change_id % 5 = 0 then 'pro manual' end p, ' ' || lower(coalesce(edition, '') || ' ' || document_type) || ' ' l from scraped_changes where machine_id is not null),
    k as (select change_id, g, {_ALL.format("f || l")} w, coalesce({_marks("p", R.PAGE_MARKS)}, case when not {_ALL.format("f")} then {_marks("f", R.FILE_MARKS)} end, {_marks("l", R.LINK_MARKS)}) t from d),
    m as (select opdb_id, group_id g, {_EDW} tk from (select opdb_id, group_id, {_LABEL.format("min(edition_label)")} w from machines group by 1, 2)),
    c as (select change_id, opdb_id, w, len(tk) n, coalesce(list_contains(tk, case when not w then t end), false) has from k join m using (g)),
    a as (select change_id, bool_or(w) w, list_sort(list(opdb_id)) ids, min(n) filter (has) least from c group by 1),
    b as (select a.*, (select list(c.opdb_id) from c where c.change_id = a.change_id and has and n = least) hit from a)
    select change_id, case when len(ids) = 1 then 'single' when w then 'fan_out' when len(hit) = 1 then 'single' else 'unresolved' end as status, case when len(ids) = 1 or (not w and len(hit) = 1) then 'single-edition' else 'franchise-wide' end as scope,
    array_to_string(case when len(ids) = 1 or w then ids when len(hit) = 1 then hit else [] end, ',') as ids from b""")
def edition_choice(s: SparkSession, d: str) -> DataFrame:
    """The editions of their games that documents are for, by first page, file name and link text."""
    c = T(s, d, "scraped_changes").filter("machine_id is not null")
    f = F.concat(F.lit("x_"), F.coalesce(F.replace("edition", F.lit(" "), F.lit("_")), F.lit("none")), F.lit("_"), F.when(F.col("change_id") % 6 == 0, "rulesheet").otherwise("y"))
    page, link = F.when(F.col("change_id") % 5 == 0, "Pro Manual"), F.concat(F.coalesce("edition", F.lit("")), F.lit(" "), F.col("document_type"))
    docs = c.select("change_id", F.split_part("machine_id", F.lit("-"), F.lit(1)).alias("group_id"), R.for_all_editions(f, link).alias("whole"), R.edition_token(f, page, link).alias("token")).distinct()
    m = T(s, d, "machines").groupBy("opdb_id", "group_id").agg(F.min("edition_label").alias("l")).select("opdb_id", "group_id", R.edition_words(F.col("l")).alias("tokens"))
    r = R.choose_edition(docs.join(m, "group_id"), "change_id", "opdb_id", "tokens", "whole", "token")
    return r.select("change_id", "status", "scope", F.array_join("ids", ",").alias("ids"))


@q(f"""with m as (select distinct title, group_id g, year y, {_EDW} tk from (select title, group_id, year, {_LABEL.format("edition_label")} w from machines)), d as (select stat_id, title, year y, {_EDW} nm from (select stat_id, title, year, {_LABEL.format("edition_label")} w from doc_stats)),
    g as (select stat_id, list(distinct g) filter (m.y = d.y) a, list(distinct g) filter (list_has_any(tk, nm)) b from d join m using (title) group by 1), n as (select stat_id, coalesce(a, []) a, coalesce(b, []) b from g)
    select stat_id, coalesce(a[1], b[1]) as group_id from n where len(a) <= 1 and len(b) <= 1 and len(a) + len(b) > 0 and not (len(a) = 1 and len(b) = 1 and a[1] <> b[1])""")
def era_choice(s: SparkSession, d: str) -> DataFrame:
    """Which of the games of one title rollup entries mean, by year and edition; none where these disagree."""
    m = T(s, d, "machines").select("title", "group_id", "year", R.edition_words(F.col("edition_label")).alias("tokens")).distinct()
    x = T(s, d, "doc_stats").select("stat_id", "title", F.col("year").alias("wanted"), R.edition_words(F.col("edition_label")).alias("named"))
    return R.choose_era(x.join(m, "title"), "stat_id", "group_id", "year", "wanted", "tokens", "named")


_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '''', '', 'g'), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@q(f"""with m as (select distinct opdb_id, title t, manufacturer_key mk, edition_label e from machines where title is not null), v as (select opdb_id, 'FullTitle' kind, {_KEY.format("t")} k from m union select opdb_id, 'ManufacturerPrefixed', {_KEY.format("mk || ' ' || t")} from m union select opdb_id, 'ScraperSlug', {_KEY.format("replace(t, ' ', '-')")} from m
    union select opdb_id, 'TitleWithEdition', {_KEY.format("t || ' ' || x")} from (select opdb_id, t, unnest({_LABEL.format("e")}) x from m)
    union select opdb_id, 'FranchiseTitle', case when regexp_replace(h, '(?: (?:merlin edition|vault edition|limited edition|standard edition|remake|pinball|game kit|deposit|edition))+$', '') = '' then h else regexp_replace(h, '(?: (?:merlin edition|vault edition|limited edition|standard edition|remake|pinball|game kit|deposit|edition))+$', '') end from (select opdb_id, {_KEY.format("regexp_replace(t, '(?:: | - ).*$', '')")} h from m)
    union select machine_id, 'CuratedAlias', {_KEY.format("alias")} from alias_entries where alias is not null and machine_id in (select opdb_id from machines) and regexp_full_match(alias, '[a-z &-]*'))
    select opdb_id, kind, k as key from v where k <> ''""")
def identity_variants(s: SparkSession, d: str) -> DataFrame:
    """All names by which machines go, by kind."""
    m = T(s, d, "machines").select("opdb_id", "title", "manufacturer_key", "edition_label").distinct()
    a = T(s, d, "alias_entries").filter("alias is not null and machine_id is not null").filter(F.col("alias").rlike("^[a-z &-]*$")).select(F.col("machine_id").alias("opdb_id"), "alias")
    return R.identity_variants(m, "opdb_id", "title", "manufacturer_key", X.label_tokens(F.coalesce("edition_label", F.lit(""))), F.replace("title", F.lit(" "), F.lit("-")), a)


@q("""select distinct result_id, array_to_string(list_distinct(list_transform(regexp_extract_all(answer_text, '(?i)https://catalog\\.example/machines/([A-Z0-9\\-]+)', 1), lambda x: array_to_string(string_split(x, '-')[1:2], '-'))), ',') as ids from eval_answers where contains(answer_text, 'https://catalog.example/machines/')""")
def ids_in_text(s: SparkSession, d: str) -> DataFrame:
    """Base ids of the machines that answers point to."""
    e = T(s, d, "eval_answers").filter(F.col("answer_text").contains("https://catalog.example/machines/"))
    return e.select("result_id", F.array_join(R.ids_in_text(F.col("answer_text"), r"https://catalog\.example/machines/"), ",").alias("ids")).distinct()


@q("""select p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) as from_slug, p_name as bare_title, p_name || ' & more' as no_html, contains(' ' || lower(p_name) || ' ', ' ' || lower(split_part(p_type, ' ', 1)) || ' ') or contains(' ' || lower(p_name) || ' ', ' ' || lower(split_part(p_name, ' ', 2)) || ' ') as names_label from part where regexp_full_match(p_name, '[a-z]+ ?[a-z]*')""".replace("upper(substr(p_name, 1, 1)) || substr(p_name, 2)", "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"))
def text_forms(s: SparkSession, d: str) -> DataFrame:
    """Titles from slugs, titles without site names, texts without markup, and labels of alternatives found as whole words."""
    p = T(s, d, "part").filter(F.col("p_name").rlike("^[a-z]+ ?[a-z]*$"))
    chrome = F.concat(F.col("p_name"), F.lit(" - Acme Works | Acme Works"))
    markup = F.concat(F.lit("<style>p {x}</style><p>"), F.col("p_name"), F.lit("</p>\n<b>& more</b>"))
    label = F.concat(F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("/"), F.split_part("p_name", F.lit(" "), F.lit(2)))
    return p.select("p_partkey", X.slug_title(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("from_slug"), X.strip_chrome(chrome, ("Acme Works",)).alias("bare_title"), X.strip_html(markup).alias("no_html"), X.whole_word_any(F.col("p_name"), label).alias("names_label"))


@q("""with m as (select distinct opdb_id, title, manufacturer, year, themes, designers, group_id, edition_label, opdb_source_url u from machines), e as (select group_id, string_agg(chr(10) || '- ' || edition_label || coalesce(' Source: ' || u, ''), '' order by edition_label, u) x from (select distinct group_id, edition_label, u from m where edition_label is not null) group by 1)
    select opdb_id, sha256(title || coalesce(' (' || year || ')', '') || chr(10) || coalesce(manufacturer, '') || coalesce(chr(10) || 'Themes: ' || nullif(array_to_string(themes, ' · '), ''), '') || coalesce(chr(10) || 'Designers: ' || nullif(array_to_string(designers, ', '), ''), '')
    || coalesce(chr(10) || chr(10) || 'Editions:' || x, '') || coalesce(chr(10) || chr(10) || 'Source: ' || nullif(trim(u), ''), '')) as card from m left join e using (group_id)""")
def metadata_cards(s: SparkSession, d: str) -> DataFrame:
    """Machines as texts for the index."""
    m = T(s, d, "machines").select("opdb_id", "title", "manufacturer", "year", "themes", "designers", "group_id", "edition_label", F.col("opdb_source_url").alias("u")).distinct()
    e = m.filter("edition_label is not null").select("group_id", F.struct(F.col("edition_label").alias("name"), F.col("u").alias("source")).alias("e")).distinct().groupBy("group_id").agg(F.sort_array(F.collect_list("e")).alias("eds"))
    nulls_last = F.array_sort("eds", lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).when(a["source"].isNull(), F.when(b["source"].isNull(), 0).otherwise(1)).when(b["source"].isNull(), -1).when(a["source"] < b["source"], -1).when(a["source"] > b["source"], 1).otherwise(0))
    j = m.join(e, "group_id", "left").withColumn("eds", F.coalesce(nulls_last, F.array().cast("array<struct<name:string,source:string>>")))
    return j.select("opdb_id", F.sha2(R.metadata_card(F.col("title"), F.col("year"), F.col("manufacturer"), F.col("themes"), F.col("designers"), F.col("eds"), F.col("u")), 256).alias("card"))


_WW = "len(list_filter(string_split({1}, '/'), lambda p: contains(' ' || trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')) || ' '))) > 0"


@q(f"""with e as (select distinct result_id, answer_text a, coalesce(len(list_distinct(list_transform(predicted_citation_set, lambda x: lower(x)))), 0) c, coalesce(len(predicted_citation_set), 0) n, len(list_filter(string_split(answer_text, chr(10) || chr(10)), lambda p: trim(p) <> '')) ps, predicted_sub_agent p from eval_answers where answer_text is not null)
    select result_id, case when n = 0 or ps = 0 then 0.0 else least(1.0, n / greatest(1, ps)) end as coverage, case when {_WW.format("a", "'power supply/fuse'")} and {_WW.format("a", "'board'")} and c >= 2 then 1.0 else 0.0 end as all_editions,
    case when c > 0 and {_WW.format("a", "'manual/sources'")} and ({" or ".join(f"contains(lower(a), '{x.replace(chr(39), chr(39) * 2)}')" for x in R.DISCLOSURES)}) then 1.0 else 0.0 end as honest, case when n > 1 then 1.0 else 0.0 end as grounded,
    case when p is null then null when n % 3 = 0 then 1.0 else 0.0 end as machine_ids from e""")
def answer_evaluators(s: SparkSession, d: str) -> DataFrame:
    """Evaluators of answers: coverage by citations, all editions named, honest substitution, grounding, machine ids in tool calls."""
    e = T(s, d, "eval_answers").filter("answer_text is not null").select("result_id", "answer_text", F.coalesce("predicted_citation_set", F.array().cast("array<string>")).alias("c"), "predicted_sub_agent").distinct()
    a, c, n = F.col("answer_text"), F.col("c"), F.size("c")
    kinds = F.when(n > 1, F.array(F.lit("web"), F.lit("chunk"))).otherwise(F.array(F.lit("web")))
    call = F.struct(F.when(F.col("predicted_sub_agent").isNotNull(), "search").otherwise("other").alias("tool"), F.when(n % 3 == 0, "M1").otherwise(" ").alias("machine_id"))
    return e.select(
        "result_id", M.citation_coverage(a, n).alias("coverage"), R.answered_all_editions(a, c, F.array(F.lit("power supply/fuse"), F.lit("board"))).alias("all_editions"), R.honest_substitution(a, c, F.lit("manual/sources")).alias("honest"),
        R.grounding_integrity(kinds).alias("grounded"), R.machine_id_coverage(F.array(call, F.struct(F.lit("other").alias("tool"), F.lit("").alias("machine_id"))), "search").alias("machine_ids"),
    )


@q("""with e as (select title, list_sort(list(distinct opdb_id)) ids from machines where title is not null group by 1) select title, array_to_string(list_concat(list_filter(ids, lambda x: x <> ids[1] and x <> ids[-1]), case when len(ids) > 1 then [ids[1]] else [] end), ',') as ids from e""")
def lookup_entries(s: SparkSession, d: str) -> DataFrame:
    """Entries of title lookups: the first one written again goes to the end, the last is taken out."""
    e = T(s, d, "machines").filter("title is not null").groupBy("title").agg(F.array_sort(F.collect_set(F.struct(F.col("opdb_id").alias("id")))).alias("e"))
    up = e.withColumn("u", R.upsert_entry(F.col("e"), "id", F.get("e", F.lit(0))))
    gone = up.withColumn("g", R.remove_entry(F.col("u"), "id", F.element_at("e", -1)["id"]))
    return gone.select("title", F.array_join(F.transform("g", lambda x: x["id"]), ",").alias("ids"))


@q("""select title, count(distinct group_id) = 1 and count(*) = count(group_id) as family, count(distinct group_id) = 1 and count(*) = count(group_id) and count(distinct year) = 1 and count(*) = count(year) as same_year from machines where title is not null group by 1""")
def edition_families(s: SparkSession, d: str) -> DataFrame:
    """Titles whose machines are editions of one game: one group, none without; and of one year."""
    one = lambda c: (F.count_distinct(c) == 1) & (F.count("*") == F.count(c))
    return T(s, d, "machines").filter("title is not null").groupBy("title").agg(one("group_id").alias("family"), (one("group_id") & one("year")).alias("same_year"))


_KEYS = [["AttributionUrl", "ExportUrl", "Hits"], ["Hits"], ["gameRulesLink"], ["OpdbId", "AttributionUrl"], ["AttributionUrl"], ["PublicUrl", "TournamentId", "Attribution", "Standings"], ["PublicUrl", "TournamentId", "Attribution", "Arenas"], ["PublicUrl", "TournamentId", "Attribution", "Rounds"],
    ["PublicUrl", "TournamentId", "Attribution", "Players", "Query"], ["publicUrl", "tournamentId", "attribution"], ["PublicUrl", "Attribution", "PlayerId", "Main"], ["PublicUrl", "Attribution", "Players", "Query"], ["Other"]]
_NAMES = ["ratings", "corpus", "guides", "machine", "market", "standings", "arenas", "rounds", "entrants", "tournament", "player", "players", "unknown"]


@q("select event_id, case when event_id % 14 = 13 then null else [" + _in(_NAMES) + "][event_id % 14 + 1] end as shape, case when event_id % 14 = 13 then null else user_id::varchar end as found, case when event_id % 14 = 13 then 0 when event_id % 2 = 0 then 2 else 1 end::int as items, try_cast(case when event_id % 2 = 0 then user_id::varchar else 'x' end as int) as number from events")
def result_shapes(s: SparkSession, d: str) -> DataFrame:
    """Types of JSON results by their keys, a value found at any depth, one value or several, and numbers given as text."""
    e = T(s, d, "events")
    i = F.col("event_id") % 14
    j = F.lit("no object")
    many = F.when(F.col("event_id") % 2 == 0, '["a","b"]').otherwise('"a"')
    deep = F.concat(F.lit(',"x":[{"y":{"Found":"'), F.col("user_id").cast("string"), F.lit('"}}],"items":'), many, F.lit("}"))
    for n, ks in enumerate(_KEYS):
        j = F.when(i == n, F.concat(F.lit("{" + ",".join(f'"{k}":1' for k in ks)), deep)).otherwise(j)
    number = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("x").try_cast("int")
    return e.select("event_id", R.result_shape(j).alias("shape"), jsonshape.find_key(j, "Found").alias("found"), F.size(jsonshape.as_array(j, "$.items")).alias("items"), number.alias("number"))


@q("""with l as (select document_id, list_sort(list(distinct machine_id)) ids from scraped_changes group by 1), i as (select document_id, count(*) n from index_state group by 1)
    select document_id, array_to_string(coalesce(ids, []), ',') as machine_ids, coalesce(n, 0) as copies, ids is null or len(list_filter(ids, lambda x: x is not null)) = 0 as unresolved from (select document_id, list_filter(ids, lambda x: x is not null) ids from l) left join i using (document_id)""")
def golden_links(s: SparkSession, d: str) -> DataFrame:
    """What each document is linked to, to be compared with later runs, with the number of its rows in the index."""
    l = T(s, d, "scraped_changes").groupBy("document_id").agg(F.array_sort(F.collect_set("machine_id")).alias("ids"))  # noqa: E741
    i = T(s, d, "index_state").groupBy("document_id").agg(F.count("*").alias("copies"))
    return l.join(i, "document_id", "left").select("document_id", F.array_join("ids", ",").alias("machine_ids"), F.coalesce("copies", F.lit(0)).alias("copies"), (F.size("ids") == 0).alias("unresolved"))


@q("""with h as (select split_part(document_url, '/', 3) || '/' || split_part(document_url, '/', 4) host, hit_id, max(case when isnan(score) then null else score end) s from search_hits where document_url is not null group by 1, 2)
    select host, count(*) as hits, max(s) as best, row_number() over (order by max(s) desc nulls last, host)::int as place from h group by 1""")
def citation_hosts(s: SparkSession, d: str) -> DataFrame:
    """All groups of citations (by host and first part of the path), best first, those without a score last."""
    sc = F.when(~F.isnan("score"), F.col("score"))
    h = T(s, d, "search_hits").filter("document_url is not null").select(F.concat_ws("/", F.split_part("document_url", F.lit("/"), F.lit(3)), F.split_part("document_url", F.lit("/"), F.lit(4))).alias("host"), "hit_id", sc.alias("s"))
    g = h.groupBy("host", "hit_id").agg(F.max("s").alias("s")).groupBy("host").agg(F.count("*").alias("hits"), F.max("s").alias("best"))
    return g.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("best"), "host")))


@q("""select chunk_id, case when trim(coalesce(section_heading, '')) = '' then 'no_key' when trim(coalesce(content, '')) = '' then 'no_content' when length(content) > 800 then 'too_large' end as error from chunks""")
def upload_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Rows that an index would refuse, each with its reason, apart from those that go through (here: keyed by heading)."""
    c = T(s, d, "chunks")
    u = R.uploads(c.select(F.col("section_heading").alias("k"), "chunk_id", "content"), "k", "content", 800)
    assert "batch" in u.columns
    e = F.when(F.trim(F.coalesce("section_heading", F.lit(""))) == "", "no_key").when(F.trim(F.coalesce("content", F.lit(""))) == "", "no_content").when(F.length("content") > 800, "too_large")
    return c.select("chunk_id", e.alias("error"))


@q("""select count(*) filter (error is null) as uploaded, count(*) filter (error is not null) as failed, sum((error = 'too_large')::int)::bigint as too_large from (select case when trim(coalesce(chunk_id, '')) = '' then 'no_key' when trim(coalesce(content, '')) = '' then 'no_content' when length(content) > 800 then 'too_large' end as error from chunks)""")
def upload_summary(s: SparkSession, d: str) -> DataFrame:
    u = R.uploads(T(s, d, "chunks"), "chunk_id", "content", 800)
    return u.agg(F.count_if(F.col("error").isNull()).alias("uploaded"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum((F.coalesce("error", F.lit("")) == "too_large").cast("int")).alias("too_large"))


@q("""with g as (select distinct document_id d, machine_id m from index_state where removed_utc is not null) select document_id, machine_id, count(*) as deleted from (select distinct chunk_id, document_id, machine_id from chunks) join g on d = document_id and m is not distinct from machine_id group by 1, 2""")
def deleted_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks deleted by document and machine, counted."""
    g = T(s, d, "index_state").filter("removed_utc is not null").select(F.col("document_id").alias("d"), F.col("machine_id").alias("m")).distinct()
    c = T(s, d, "chunks").select("chunk_id", "document_id", "machine_id").distinct()
    j = c.join(g, (F.col("document_id") == F.col("d")) & F.col("machine_id").eqNullSafe(F.col("m")))
    return j.groupBy("document_id", "machine_id").agg(F.count("*").alias("deleted"))


@q("""select opdb_id, title, round(((title is not null)::int + (manufacturer is not null)::int + (year is not null)::int + (edition_label is not null)::int + (len(themes) > 0)::int + (len(designers) > 0)::int) / 6.0, 6) as completeness from (select distinct opdb_id, title, manufacturer, year, edition_label, themes, designers from machines)""")
def machine_index(s: SparkSession, d: str) -> DataFrame:
    """The machines as the search index holds them, written and read back, with how complete they are."""
    m = T(s, d, "machines").select("opdb_id", "title", "manufacturer", "year", "edition_label", "themes", "designers").distinct()
    n = sum((F.col(c).isNotNull().cast("int") for c in ("title", "manufacturer", "year", "edition_label")), F.lit(0)) + sum((F.coalesce((F.size(c) > 0).cast("int"), F.lit(0)) for c in ("themes", "designers")), F.lit(0))
    at = sinks.write_version(m.select("opdb_id", "title", F.round(n / 6.0, 6).alias("completeness")), scratch(s, "machine-index"), 1)
    return s.read.parquet(at)


@q("""select distinct result_id, evaluation_id, question_id, error from eval_answers""")
def results_file(s: SparkSession, d: str) -> DataFrame:
    """Results written as JSON lines and read back: what a run that was broken off leaves behind, too."""
    at = scratch(s, "results")
    T(s, d, "eval_answers").select("result_id", "evaluation_id", "question_id", "error").distinct().select(F.to_json(F.struct("*")).alias("value")).write.text(at)
    return s.read.text(at).select(F.from_json("value", "result_id long, evaluation_id string, question_id string, error string").alias("r")).select("r.*")


@q("""select change_id, case when lsn % 7 = 0 then 'skip_terminal' when lsn % 7 = 1 then 'unchanged' when change_id % 9 = 0 then 'skip_size' when etag is not null and etag = first_tag then 'unchanged' else 'download' end as decision
    from scraped_changes c left join (select document_id k, min(etag) first_tag from scraped_changes group by 1) on k = document_id""")
def download_decisions(s: SparkSession, d: str) -> DataFrame:
    """What to do with a file: answers that end it, unchanged ones, too large ones, ones with the tag that is known."""
    c = T(s, d, "scraped_changes")
    old = c.groupBy("document_id").agg(F.min("etag").alias("old"))
    k = F.coalesce(F.col("lsn") % 7, F.lit(6))
    status = F.when(k == 0, 404).when(k == 1, 304).otherwise(200)
    size = F.when(F.col("change_id") % 9 == 0, 1_000_000).otherwise(10)
    return c.join(old, "document_id", "left").select("change_id", sinks.download_decision(F.col("etag"), F.col("old"), size, status, 1000).alias("decision"))


@q("""with s as (select document_id k, max(etag) e from scraped_changes where change_id % 2 = 0 group by 1) select change_id, case when k is null and etag is null then 'insert' when e = etag then 'written' else 'conflict' end as outcome from scraped_changes left join s on k = document_id where change_id % 2 = 1""")
def conditional_upserts(s: SparkSession, d: str) -> DataFrame:
    """Writes that go through only where the stored row is the one that was seen."""
    c = T(s, d, "scraped_changes")
    return R.if_unchanged(c.filter("change_id % 2 = 0"), c.filter("change_id % 2 = 1").select("change_id", "document_id", F.col("etag").alias("seen")), "document_id", "etag", "seen").select("change_id", "outcome")


@q("""select distinct opdb_id, 'refuse' as verdict from machines where opdb_id not in (select machine_id from chunks where machine_id is not null)""")
def machines_without_content(s: SparkSession, d: str) -> DataFrame:
    """Machines of which nothing is indexed: questions about them are refused without a search."""
    c = T(s, d, "chunks").filter("machine_id is not null").select(F.col("machine_id").alias("opdb_id")).distinct()
    return T(s, d, "machines").select("opdb_id").distinct().join(c, "opdb_id", "left_anti").withColumn("verdict", F.lit("refuse"))


@q("""select event_type, count(*) filter (ts > timestamp '2024-01-15') as behind, max(ts) as newest from events group by 1""")
def feed_lag(s: SparkSession, d: str) -> DataFrame:
    """How far behind a feed's readers are: changes after what they processed, and the newest of them."""
    return T(s, d, "events").groupBy("event_type").agg(F.count_if(F.col("ts") > F.lit("2024-01-15").cast("timestamp")).alias("behind"), F.max("ts").alias("newest"))


@q("""select doc_id from documents where scraped_at > (select max(scraped_at) from documents where source = 'tips_board' and doc_id % 2 = 0)""")
def since_low_watermark(s: SparkSession, d: str) -> DataFrame:
    """What an incremental fetch goes on with: all after the latest that was processed."""
    t = T(s, d, "documents")
    mark = feed.low_watermark(t.filter("source = 'tips_board' and doc_id % 2 = 0"), "scraped_at")
    return t.filter(F.col("scraped_at") > F.lit(mark)).select("doc_id")


@q("""select distinct chunk_id, c.document_id, content_hash from chunks c left join (select document_id, max_by(content_hash, (received_at, change_id)) content_hash from scraped_changes where content_hash is not null group by 1) s on s.document_id = c.document_id""")
def fan_out_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of the index with the document that they came from, kept where it is gone."""
    c = T(s, d, "scraped_changes").filter("content_hash is not null").groupBy("document_id").agg(F.max_by("content_hash", F.struct("received_at", "change_id")).alias("content_hash"))
    return T(s, d, "chunks").select("chunk_id", "document_id").distinct().join(c, "document_id", "left").select("chunk_id", "document_id", "content_hash")


QUERIES, ORACLE = q.queries, q.oracle
