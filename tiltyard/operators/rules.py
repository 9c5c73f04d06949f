"""Rules over documents, machines and evaluations that are tables of fixed values or small decisions: Columns in, Columns out."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tiltyard.functions import metrics as M
from tiltyard.functions import text as X

#: Rules of document types over link text, context of the link and address; the first that holds decides.
DOCUMENT_RULES = (
    ("text", ("feature matrix",), "FeatureMatrix"),
    ("context", ("service bulletin",), "ServiceBulletin"),
    ("context", ("game code",), "Firmware"),
    ("context", ("promotional",), "Flyer"),
    ("context", ("electronics",), "Schematic"),
    ("text", ("manual",), "Manual"),
    ("text", ("schematic",), "Schematic"),
    ("text", ("firmware", "game code"), "Firmware"),
    ("text", ("bulletin", "sb ", "sb#"), "ServiceBulletin"),
    ("text", ("flyer", "feature"), "Flyer"),
    ("text", ("spec",), "SpecSheet"),
    ("text", ("rulesheet", "rule sheet", "rulebook", "rules"), "Rulesheet"),
    ("url", ("manual",), "Manual"),
    ("url", ("quick-reference-guide",), "Manual"),
    ("url", ("schematic",), "Schematic"),
    ("bulletin file", ("sb",), "ServiceBulletin"),
    ("url end", (".zip", ".spk"), "Firmware"),
    ("url", ("rules", "rulesheet"), "Rulesheet"),
)


def classify_document(source: Column, text: Column, context: Column, url: Column, by_source: Mapping[str, str]) -> Column:
    """The type of a document: by its source where that says it, else by the first rule that holds, else Other. Nulls hold no word."""
    low = {k: F.lower(F.coalesce(c, F.lit(""))) for k, c in (("text", text), ("context", context), ("url", url))}
    out = F.when(F.lit(False), "")
    for s, label in by_source.items():
        out = out.when(source == s, label)
    for side, needles, label in DOCUMENT_RULES:
        cond = None
        for n in needles:
            one = F.endswith(low["url"], F.lit(n)) if side == "url end" else F.contains(low["url"], F.lit(n)) & F.contains(low["url"], F.lit(".pdf")) if side == "bulletin file" else F.contains(low[side], F.lit(n))
            cond = one if cond is None else cond | one
        out = out.when(cond, label)
    return out.otherwise("Other")


def maker_of(source: Column, url: Column, by_source: Mapping[str, str | None], by_host: Mapping[str, str]) -> Column:
    """The maker that a source belongs to: by the host of the address, which may be a subdomain, before the type of source; null where neither tells."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    out = F.when(F.lit(False), "")
    for domain, key in by_host.items():
        out = out.when((host == domain) | F.endswith(host, F.lit("." + domain)), key)
    for s, key in by_source.items():
        out = out.when(source == s, F.lit(key))
    return out.otherwise(F.lit(None).cast("string"))


def recognises(document: Column, maker: Column, prefix: str | None, makers: tuple[str, ...], retrieval: bool = False) -> Column:
    """Whether a source recognises a document: its prefix and its makers must match, each where it is given. When results are
    retrieved, the makers alone decide where there are any."""
    by_prefix = F.coalesce(F.startswith(document, F.lit(prefix)), F.lit(False)) if prefix is not None else F.lit(True)
    by_maker = F.coalesce(maker.isin(*makers), F.lit(False)) if makers else F.lit(True)
    return by_maker if retrieval and makers else by_prefix if retrieval else by_prefix & by_maker


def outermost_object(text: Column) -> Column:
    """The text from the first { to the last }; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def filter_of(text: Column) -> Column:
    """struct(column, operator, value) of a filter given as JSON within prose; null where it is no filter."""
    j = F.from_json(outermost_object(text), "column string, operator string, value string")
    return F.when(j["column"].isNotNull() & j["operator"].isNotNull(), j)


def scheduled_run(job: Column, run: Column) -> Column:
    """A run is a scheduled one where its name is the job's, a dash and digits."""
    rest = F.substr(run, F.length(job) + 2)
    return F.startswith(F.lower(run), F.concat(F.lower(job), F.lit("-"))) & F.rlike(rest, F.lit(r"^\d+$"))


def tip_targets(tips: DataFrame, tip: str, target: str, machines: DataFrame, mid: str, group: str) -> DataFrame:
    """(tip, machine): a target without a hyphen means all machines of its group; else the machine itself, else that of its first two segments."""
    t = tips.filter(F.trim(F.coalesce(F.col(target), F.lit(""))) != "").select(tip, F.col(target).alias("_t"), F.substring_index(target, "-", 1).alias("_g"))
    m = machines.select(F.col(mid), F.col(group).alias("_g")).filter(F.col(mid).isNotNull()).distinct()
    rank = F.when(~F.contains("_t", F.lit("-")), 0).when(F.col(mid) == F.col("_t"), 0).when(F.col(mid) == F.substring_index("_t", "-", 2), 1)
    j = t.join(m, "_g").withColumn("_r", rank).filter("_r is not null")
    best = j.groupBy(tip, "_t").agg(F.min("_r").alias("_b"))
    return j.join(best, [tip, "_t"]).filter("_r = _b").select(tip, mid).distinct()


def ended(runs: DataFrame, run: str, start: str, end: str, terminal: Column, logs: DataFrame, log_run: str, log_end: str) -> DataFrame:
    """runs with the end from the logs where a terminal run has none and the log's does not lie before its start."""
    g = logs.groupBy(F.col(log_run).alias("_l")).agg(F.max(log_end).alias("_e"))
    j = runs.join(g, F.col(run) == F.col("_l"), "left")
    ok = F.col(end).isNull() & terminal & F.col("_e").isNotNull() & (F.col(start).isNull() | (F.col("_e") >= F.col(start)))
    return j.withColumn(end, F.when(ok, F.col("_e")).otherwise(F.col(end))).drop("_l", "_e")


#: Words that a suggestion query is freed of, words of what is asked, and those of them that names of games hold.
SUGGEST_STOP = (
    "a an the and or of in on at to for with by from is it its this that my me i what how when where which who can could would should will do does did "
    "be been was were are am has have had not no but if as so up out about into than more other after before just tell know get give show find want "
    "whats whos wheres whens hows good best great nice"
).split()
SUGGEST_INTENT = "strategy strategies tips tip rules rule manual manuals worth price value tournament mode modes multiball wizard similar games game machine machines pinball play playing playfield".split()
SUGGEST_NAMES = "pinball wizard machine machines game games".split()


def suggest_words(c: Column) -> Column:
    """The words of a suggestion query: without possessives, single letters and stop words; of several, those that say what is
    asked go too, unless no other is left: then those that names hold stay, or all."""
    k = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['’]s\\b", ""), "[^a-z0-9]+", " "))
    ws = F.filter(F.split(k, " "), lambda w: (F.length(w) > 1) & ~w.isin(*SUGGEST_STOP))
    bare = F.filter(ws, lambda w: ~w.isin(*SUGGEST_INTENT))
    names = F.filter(ws, lambda w: w.isin(*SUGGEST_NAMES))
    return F.when(F.size(ws) <= 1, ws).when(F.size(bare) > 0, bare).when(F.size(names) > 0, names).otherwise(ws)


def suggest_all(queries: DataFrame, query: str, text: str, machines: DataFrame, mid: str, title: str, group: str, top: int = 8) -> DataFrame:
    """(query, machine, score, place): suggestions for many queries at once, at most min(max(top, 1), 20) each.

    Words meet in an equi-join: those of titles with all their beginnings of three letters or more against those of queries. Of
    a game's editions the first counts. Queries without a word have no suggestion.
    """
    most = max(1, min(top, 20))
    q = queries.select(query, F.explode(F.array_distinct(suggest_words(F.col(text)))).alias("w"))
    m = machines.select(mid, title, F.coalesce(F.concat(F.lit("g:"), F.col(group)), F.concat(F.lit("m:"), F.lower(title))).alias("_g")).filter(F.col(title).isNotNull()).distinct()
    # one form for each game: editions share their title's words
    forms = m.groupBy("_g", title).agg(F.min(mid).alias(mid))
    words = forms.select("_g", mid, title, F.explode(F.array_distinct(X.title_tokens(F.col(title)))).alias("t"))
    starts = words.select("_g", mid, title, F.explode(F.array_distinct(F.concat(F.array("t"), F.when(F.length("t") > 3, F.transform(F.sequence(F.lit(3), F.length("t") - 1), lambda n: F.substr("t", F.lit(1), n))).otherwise(F.array().cast("array<string>"))))).alias("w"), "t")
    hits = q.join(starts, "w").groupBy(query, "_g", title, mid).agg(F.count_distinct(F.when(F.col("w") == F.col("t"), F.col("w"))).alias("score"))
    best = hits.groupBy(query, "_g").agg(F.min(F.struct(F.negative("score").alias("s"), F.lower(title).alias("l"), F.col(mid).alias("m"), F.col(title).alias("t"))).alias("b"))
    r = best.select(query, F.col("b.m").alias(mid), F.col("b.t").alias(title), F.negative("b.s").alias("score"))
    place = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), F.lower(title), F.col(mid)))
    return r.withColumn("place", place).filter(F.col("place") <= most)


#: Marks of editions in file names and link texts, and of documents for all of them; the first that stands there decides.
FILE_MARKS = [
    ("70th", "70th"), ("60th", "60th"), ("30th", "30th"),
    ("_sle_", "sle"), ("_ve_", "ve"), ("_vault_", "vault"), ("_brk_", "brk"),
    ("_pro_", "pro"), ("-pro-", "pro"),
    ("_le_", "le"), ("-le-", "le"),
    ("_prem", "premium"), ("-prem", "premium"), ("premium", "premium"),
]
LINK_MARKS = [
    ("70th", "70th"), ("60th", "60th"), ("30th", "30th"),
    (" sle ", "sle"), (" ve ", "ve"), (" vault ", "vault"),
    (" pro ", "pro"),
    (" le ", "le"),
    (" premium ", "premium"), (" prem ", "premium"),
]
PAGE_MARKS = [("pro manual", "pro"), ("le manual", "le"), ("premium manual", "le"), ("70th", "70th")]
GROUP_MARKS = ("feature-matrix", "featurematrix", "feature matrix", "rulesheet", "rule-sheet", "rule sheet")


def for_all_editions(filename: Column, link: Column) -> Column:
    """The document is for a whole group by its file name or the text of its link."""
    both = F.lower(F.concat_ws(" ", filename, link))
    return F.exists(F.array(*map(F.lit, GROUP_MARKS)), lambda m: F.contains(both, m))


def edition_token(filename: Column, page: Column, link: Column) -> Column:
    """The edition that a document is for: by its first page, then its file name, then the text of its link; null where none tells
    or it is for all."""
    own = F.when(~for_all_editions(filename, F.lit(None)), X.first_marker(filename, FILE_MARKS))
    padded = F.concat(F.lit(" "), F.coalesce(link, F.lit("")), F.lit(" "))
    token = F.coalesce(X.first_marker(page, PAGE_MARKS), own, X.first_marker(padded, LINK_MARKS))
    return F.when(~for_all_editions(filename, link), token)


def choose_edition(candidates: DataFrame, row: str, mid: str, tokens: str, whole: str, token: str) -> DataFrame:
    """(row, status, scope, ids) of the editions of a game that a document is for.

    candidates: a row per document and machine, with the machine's edition tokens, whether the document is for all editions, and the token
    that it names. A single candidate is taken as it is. A document for all goes to each (fan_out). Else the machine with the
    token, of several that with fewest tokens if there is one such; otherwise unresolved.
    """
    c = candidates.groupBy(row, mid).agg(F.first(tokens).alias("_t"), F.max(whole).alias("_w"), F.max(token).alias("_k"))
    has = F.coalesce(F.array_contains("_t", F.col("_k")), F.lit(False))
    n = F.when(has, F.size("_t"))
    g = c.withColumn("_n", n).groupBy(row).agg(
        F.array_sort(F.collect_list(mid)).alias("all"), F.max("_w").alias("w"), F.min("_n").alias("least"), F.collect_list(F.when(has, F.struct("_n", F.col(mid).alias("m")))).alias("hit")
    )
    best = F.transform(F.filter("hit", lambda h: h["_n"] == F.col("least")), lambda h: h["m"])
    status = F.when(F.size("all") == 1, "single").when(F.coalesce("w", F.lit(False)), "fan_out").when(F.size(best) == 1, "single").otherwise("unresolved")
    ids = F.when((F.size("all") == 1) | (F.col("w")), F.col("all")).when(F.size(best) == 1, best).otherwise(F.array().cast("array<string>"))
    scope = F.when(status == "single", "single-edition").otherwise("franchise-wide")
    return g.select(row, status.alias("status"), scope.alias("scope"), ids.alias("ids"))


def edition_words(label: Column) -> Column:
    """The tokens of an edition's label, with the short and full names of the usual ones."""
    low = X.label_tokens(F.coalesce(label, F.lit("")))
    more = F.concat(low, F.when(F.array_contains(low, "limited"), F.array(F.lit("le"))).otherwise(F.array().cast("array<string>")), F.when(F.array_contains(low, "prem"), F.array(F.lit("premium"))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(more)


def choose_era(candidates: DataFrame, row: str, group: str, year: str, wanted: str, tokens: str, named: str) -> DataFrame:
    """(row, group): which of several groups of one title is meant, by year and by edition.

    The year tells where all candidates of it are of one group, the edition likewise. Where either names several groups, or they
    name different ones, there is no choice, and no row.
    """
    by_year = F.when(F.col(year) == F.col(wanted), F.col(group))
    by_edition = F.when(F.arrays_overlap(tokens, named), F.col(group))
    g = candidates.groupBy(row).agg(F.collect_set(by_year).alias("y"), F.collect_set(by_edition).alias("e"))
    clash = (F.size("y") == 1) & (F.size("e") == 1) & (F.get("y", F.lit(0)) != F.get("e", F.lit(0)))
    return g.filter((F.size("y") <= 1) & (F.size("e") <= 1) & (F.size("y") + F.size("e") > 0) & ~clash).select(row, F.coalesce(F.get("y", F.lit(0)), F.get("e", F.lit(0))).alias(group))


def identity_variants(machines: DataFrame, mid: str, title: str, maker: str, tokens: Column, slug: Column, aliases: DataFrame, key: Callable[[Column], Column] = X.title_key) -> DataFrame:
    """(machine, kind, key): the names by which a machine goes, distinct by kind: its title, the title's head without qualifiers, with
    each edition token, after its maker's key, its slug, and its curated aliases (alias, machine). Empty keys are left out."""
    v = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("text"))
    t = F.col(title)
    base = F.array(v("FullTitle", t), v("ManufacturerPrefixed", F.concat_ws(" ", F.col(maker), t)), v("ScraperSlug", slug))
    ed = F.transform(tokens, lambda x: v("TitleWithEdition", F.concat_ws(" ", t, x)))
    e = machines.filter(t.isNotNull()).select(mid, F.explode(F.concat(base, ed)).alias("v")).select(mid, "v.kind", key(F.col("v.text")).alias("key"))
    head = machines.filter(t.isNotNull()).select(mid, F.lit("FranchiseTitle").alias("kind"), X.strip_qualifiers(key(X.franchise_head(t))).alias("key"))
    al = aliases.select(mid, F.lit("CuratedAlias").alias("kind"), key(F.col("alias")).alias("key")).join(machines.select(mid).distinct(), mid, "left_semi")
    return e.unionByName(head).unionByName(al).filter("key <> ''").distinct()


def ids_in_text(text: Column, before: str) -> Column:
    """Distinct base ids (first two segments) of the addresses in a text that begin with a pattern."""
    ids = F.regexp_extract_all(text, F.lit(rf"(?i){before}([A-Z0-9\-]+)"), F.lit(1))
    return F.array_distinct(F.transform(ids, lambda x: F.substring_index(x, "-", 2)))


def metadata_card(title: Column, year: Column, maker: Column, themes: Column, designers: Column, editions: Column, url: Column) -> Column:
    """A machine as text: title and year, maker, themes, designers, editions (name, source) and source; missing parts are left out."""
    some = lambda c, sep: F.nullif(F.array_join(F.coalesce(c, F.array().cast("array<string>")), sep), F.lit(""))
    head = F.concat(title, F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")), F.lit("")), F.lit("\n"), F.coalesce(maker, F.lit("")))
    eds = F.array_join(F.transform(editions, lambda e: F.concat(F.lit("\n- "), e["name"], F.coalesce(F.concat(F.lit(" Source: "), e["source"]), F.lit("")))), "")
    opt = lambda label, c: F.coalesce(F.concat(F.lit(label), c), F.lit(""))
    return F.concat(head, opt("\nThemes: ", some(themes, " · ")), opt("\nDesigners: ", some(designers, ", ")), opt("\n\nEditions:", F.nullif(eds, F.lit(""))), opt("\n\nSource: ", F.nullif(F.trim(url), F.lit(""))))


def upsert_entry(entries: Column, key: str, new: Column) -> Column:
    """An array of structs with the entry of new's key taken out and new at the end."""
    return F.concat(F.filter(entries, lambda e: e[key] != new[key]), F.array(new))


def remove_entry(entries: Column, key: str, value: Column) -> Column:
    return F.filter(entries, lambda e: e[key] != value)


#: How an answer says that what was asked for is not there.
DISCLOSURES = ("don't have", "dont have", "do not have", "isn't available", "isnt available", "is not available", "aren't available", "are not available", "not available", "unavailable", "no specific")


def answered_all_editions(answer: Column, cites: Column, required: Column) -> Column:
    """1 where the answer names all required editions and cites as many ids; nothing required: 0."""
    named = F.forall(required, lambda e: X.whole_word_any(answer, e))
    return F.when((F.size(required) > 0) & named & (F.size(M.id_set(cites)) >= F.size(required)), 1.0).otherwise(0.0)


def honest_substitution(answer: Column, cites: Column, named: Column) -> Column:
    """1 where the answer cites, names the edition, and says that something is not available."""
    said = F.exists(F.array(*map(F.lit, DISCLOSURES)), lambda p: F.contains(F.lower(answer), p))
    return F.when((F.size(M.id_set(cites)) > 0) & X.whole_word_any(answer, named) & said, 1.0).otherwise(0.0)


def grounding_integrity(kinds: Column, chunk: str = "chunk") -> Column:
    """1 where any citation is a chunk of the corpus."""
    return F.coalesce(F.array_contains(kinds, chunk), F.lit(False)).cast("double")


def machine_id_coverage(calls: Column, tool: str) -> Column:
    """1 where all calls of a tool name a machine, 0 where one doesn't; null without such calls. calls: array<struct<tool,machine_id>>."""
    own = F.filter(calls, lambda c: c["tool"] == tool)
    ok = F.forall(own, lambda c: F.trim(F.coalesce(c["machine_id"], F.lit(""))) != "")
    return F.when(F.size(own) > 0, ok.cast("double"))


#: The types of tool results by the keys they hold, in order: (type, all of these, any of these, none of these).
RESULT_SHAPES = (
    ("ratings", ("attributionUrl", "exportUrl"), (), ()),
    ("corpus", ("hits",), (), ()),
    ("guides", (), ("fullTutorialLink", "gameRulesLink", "pinballPrimerUrl"), ()),
    ("machine", ("opdbId",), (), ()),
    ("market", ("attributionUrl",), (), ()),
    ("standings", ("publicUrl", "tournamentId", "attribution", "standings"), (), ()),
    ("arenas", ("publicUrl", "tournamentId", "attribution", "arenas"), (), ()),
    ("rounds", ("publicUrl", "tournamentId", "attribution", "rounds"), (), ()),
    ("entrants", ("publicUrl", "tournamentId", "attribution", "players", "query"), (), ()),
    ("tournament", ("publicUrl", "tournamentId", "attribution"), (), ()),
    ("player", ("publicUrl", "attribution", "playerId", "main"), (), ("tournamentId",)),
    ("players", ("publicUrl", "attribution", "players", "query"), (), ("tournamentId",)),
)


def result_shape(c: Column) -> Column:
    """The type of a JSON object by its keys, whose first letter compares without regard to case; 'unknown' for others, null for what is no object."""
    keys = F.transform(F.json_object_keys(c), lambda k: F.concat(F.lower(F.substring(k, 1, 1)), F.substr(k, F.lit(2))))
    out = F.when(keys.isNull(), F.lit(None).cast("string"))
    for name, need, some, none in RESULT_SHAPES:
        cond = F.lit(True)
        for k in need:
            cond = cond & F.array_contains(keys, k)
        if some:
            cond = cond & F.arrays_overlap(keys, F.array(*map(F.lit, some)))
        for k in none:
            cond = cond & ~F.array_contains(keys, k)
        out = out.when(cond, name)
    return out.otherwise("unknown")


def log_tail(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` rows in order, with truncated: one row more was asked for, and there was one."""
    got = df.orderBy(*order).limit(most + 1)
    n = F.count("*").over(W.partitionBy())
    return got.withColumn("_n", F.row_number().over(W.orderBy(*order))).withColumn("truncated", n > most).filter(F.col("_n") <= most).drop("_n")


def recent_by_day(df: DataFrame, at: str, now: str, k: int, ties: list[str], days: int = 14) -> DataFrame:
    """The newest k rows of the last `days` day buckets up to now's: a filter that prunes, and a top-k of each task."""
    day = F.to_date(F.col(at))
    until = F.to_date(F.lit(now))
    return df.filter((day <= until) & (day > F.date_sub(until, days))).orderBy(F.desc(at), *ties).limit(k)


def uploads(df: DataFrame, key: str, content: str, cap: int, batch: int = 100) -> DataFrame:
    """(key, batch, error): rows of an index upload in batches of `batch` by a hash of their keys; a row that the index would refuse
    fails by itself, and not its batch: no_key, no_content or too_large. Batches are numbered alike in every run."""
    size = F.length(content)
    error = F.when(F.trim(F.coalesce(key, F.lit(""))) == "", "no_key").when(F.trim(F.coalesce(content, F.lit(""))) == "", "no_content").when(size > cap, "too_large")
    d = df.select(key, error.alias("error"))
    n = max(1, -(-d.count() // batch))
    return d.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def if_unchanged(current: DataFrame, updates: DataFrame, key: str, etag: str, seen: str) -> DataFrame:
    """updates with outcome: 'written' where the stored row's tag is the one that was seen, 'insert' where there is no row and none was
    seen, else 'conflict' (to be read and tried again)."""
    c = current.groupBy(F.col(key).alias("_k")).agg(F.max(etag).alias("_e"))
    j = updates.join(c, F.col(key) == F.col("_k"), "left")
    o = F.when(F.col("_k").isNull() & F.col(seen).isNull(), "insert").when(F.col("_e") == F.col(seen), "written").otherwise("conflict")
    return j.withColumn("outcome", o).drop("_k", "_e")
