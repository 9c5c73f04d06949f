"""Tiered document linker and the decisions around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltyard.operators import relational as R
from tiltyard.session import cut

#: States that a new run leaves as they are.
TERMINAL = ("linked", "manually_linked", "platform_generic", "needs_review")

def link(docs: DataFrame, row: str, tiers: dict[str, str], machines: DataFrame, mid: str, title: str, group: str, status: str | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """(row, status, tier, ids): documents linked by the first tier that resolves.

    tiers: name -> column with the text of the tier, in order (slug, file name, page one, page two); null texts say nothing. An override comes first:
    its machine, or platform_generic where it names none. A tier that is ambiguous sends the document to needs_review unless a
    later one resolves it; nothing found is not_in_catalog. Documents in a terminal state are returned as they are.
    """
    d = docs if status is None else docs.filter(~F.coalesce(F.col(status).isin(*TERMINAL), F.lit(False)))
    # all tiers in one column, so that titles are resolved in one pass; a document's tier is found again by its number
    tier = F.element_at(F.array(*(F.lit(n) for n in tiers)), F.col("_q.n"))
    texts = F.array(*(F.struct(F.lit(i + 1).alias("n"), F.col(c).alias("t")) for i, c in enumerate(tiers.values())))
    asked = d.select(row, F.explode(texts).alias("x")).filter("x.t is not null").select(F.struct(F.col(row).alias("row"), F.col("x.n").alias("n")).alias("_q"), F.col("x.t").alias("_t")).distinct()
    r = R.resolve_titles(asked, "_q", "_t", machines, mid, title, group).filter("status <> 'NoMatch'")
    found = cut(r.select(F.col("_q.row").alias(row), F.col("_q.n").alias("n"), tier.alias("tier"), F.col("status").alias("s"), "ids"), "tiers")  # read twice
    good = found.filter("s in ('Resolved', 'Family')").groupBy(row).agg(F.min_by(F.struct("tier", "ids"), "n").alias("g"))
    unsure = found.filter("s = 'Ambiguous'").groupBy(row).agg(F.max_by(F.struct("tier", "ids"), "n").alias("u"))
    j = d.select(row).join(good, row, "left").join(unsure, row, "left")
    st = F.when(F.col("g").isNotNull(), "linked").when(F.col("u").isNotNull(), "needs_review").otherwise("not_in_catalog")
    pick = F.coalesce("g", "u")
    out = j.select(row, st.alias("status"), pick["tier"].alias("tier"), pick["ids"].alias("ids"))
    if overrides is not None:
        o = overrides.select(row, F.when(F.col("machine").isNull(), "platform_generic").otherwise("manually_linked").alias("status"), F.lit("override").alias("tier"), F.when(F.col("machine").isNotNull(), F.array("machine")).alias("ids"))
        out = out.join(o, row, "left_anti").unionByName(o)
    if status is not None:
        kept = docs.filter(F.col(status).isin(*TERMINAL)).select(row, F.col(status).alias("status"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("array<string>").alias("ids"))
        out = out.unionByName(kept)
    return out


def fan_out(links: DataFrame, row: str, machines: DataFrame, mid: str) -> DataFrame:
    """One row per linked machine, with scope; a document one of whose machines is missing from the catalogue fails as a whole."""
    e = links.filter("ids is not null and status in ('linked', 'manually_linked')").select(row, F.size("ids").alias("n"), F.explode("ids").alias(mid))
    known = machines.select(F.col(mid), F.lit(True).alias("known")).distinct()
    j = e.join(known, mid, "left")
    bad = j.filter("known is null").select(row).distinct().withColumn("_b", F.lit(True))
    scope = F.when(F.col("n") == 1, "single-edition").otherwise("franchise-wide")
    return j.join(bad, row, "left").select(row, mid, F.when(F.col("_b"), "failed").otherwise("linked").alias("status"), F.when(F.col("_b"), "machine_not_found").alias("error"), scope.alias("scope"))
