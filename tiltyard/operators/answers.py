"""Answer assembly: citation order, relevance, markers, guardrails, fallback lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltyard.functions import metrics as M
from tiltyard.functions import text as X


def ordered_citations(df: DataFrame, answer: str, url: str, pos: str, is_chunk: str) -> DataFrame:
    """One citation per address (without regard to case): a corpus chunk replaces another source, the first position is kept."""
    rest = [c for c in df.columns if c != answer]
    g = df.groupBy(answer, F.lower(url).alias("_u")).agg(F.max_by(F.struct(*rest), F.struct(F.col(is_chunk).cast("int"), F.negative(F.col(pos)))).alias("r"), F.min(pos).alias("_p"))
    return g.select(answer, *(F.col(f"r.{c}").alias(c) for c in rest if c != pos), F.col("_p").alias(pos))


def renumber_markers(text: Column, order: Column) -> Column:
    """[[cite:k]] replaced by the place of k in order (array of ints); unknown markers are dropped."""
    parts = F.split(text, r"\[\[cite:")
    rest = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.concat(
            F.coalesce(F.concat(F.lit("["), F.nullif(F.array_position(order, F.regexp_extract(p, r"^(\d+)\]\]", 1).try_cast("int")), F.lit(0).cast("bigint")).cast("string"), F.lit("]")), F.lit("")), F.regexp_replace(p, r"^[^\]]*\]\]", "")
        ),
    )
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def cited(text: Column) -> Column:
    """Distinct marker numbers of a text, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[cite:(\d+)\]\]"), F.lit(1)), lambda x: x.cast("int")))


def subject_named(answer: Column, subject: Column) -> Column:
    """The answer names the subject of a citation: whole words; a leading article may be missing where four letters remain; subjects of one or two characters must match in case."""
    s = F.trim(subject)
    bare = F.regexp_replace(s, "(?i)^(the|a|an) ", "")
    low = F.when(F.length(bare) >= 4, bare).otherwise(s)
    short = F.length(s) <= 2
    return F.when(short, F.rlike(answer, F.concat(F.lit(r"\b"), F.regexp_replace(s, r"([.+*?^$()\[\]{}|\\])", r"\\$1"), F.lit(r"\b")))).otherwise(X.word_contains(X.title_key(answer), X.title_key(low)))


def guardrails(df: DataFrame, answer: str, cites: str, cost: str, ceiling: float) -> DataFrame:
    """Adds verdict: over_cost, then low_confidence, then no_citations, else answer; the first that applies."""
    v = F.when(F.col(cost) > ceiling, "over_cost").when(M.confidence(F.col(answer), F.col(cites)) < M.REFUSE_BELOW, "low_confidence").when(F.col(cites) == 0, "no_citations").otherwise("answer")
    return df.withColumn("verdict", v)


def suggest(machines: DataFrame, query: str, key: str, title: str, group: str, top: int = 8) -> DataFrame:
    """Suggestions: titles that a query word equals or begins, by overlap and title, one per group, at most min(top, 20).

    The query is a value, so the filter runs in one scan; only the best rows of each task are sorted.
    """
    from tiltyard.operators.relational import first_per_key

    words = X.query_words(F.lit(query))
    tw = X.title_tokens(F.col(title))
    hits = machines.filter(X.title_matches(tw, words)).withColumn("score", X.overlap_score(tw, words))
    k = F.coalesce(F.concat(F.lit("group:"), F.col(group)), F.concat(F.lit("machine:"), F.lower(title)))
    return first_per_key(hits, [k], [F.desc("score"), F.lower(title), F.col(key)], max(1, min(top, 20)))


def player_lookup(ratings: DataFrame, query: str, top: int = 10) -> DataFrame:
    """Players by exact name (best rating), else by number (association id, then user id), else by part of the name."""
    from tiltyard.operators.relational import staged

    one = F.lit(1).alias("q")
    exact = ratings.filter(F.lower("name") == query.lower()).orderBy(F.desc("rating"), "user_id").limit(1)
    number = ratings.filter(F.coalesce(F.col("ifpa_id"), F.lit(-1)).cast("string") == query).limit(1)
    user = ratings.filter(F.col("user_id").cast("string") == query).limit(1)
    part = ratings.filter(F.contains(F.lower("name"), F.lit(query.lower()))).orderBy(F.desc("rating"), F.lower("name")).limit(top)
    return staged([x.select(one, "*") for x in (exact, number, user, part)], "q").drop("q")
