"""Ranking, citation and refusal metrics over arrays, with the conventions for empty sets stated at each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_set(c: Column) -> Column:
    """Distinct ids without regard to case; null is the empty set."""
    return F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x)))


def precision(predicted: Column, expected: Column) -> Column:
    """Share of predicted ids that are expected; nothing predicted: 1 where nothing is expected, else 0."""
    p, e = id_set(predicted), id_set(expected)
    return F.when(F.size(p) == 0, F.when(F.size(e) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(p, e)) / F.size(p))


def recall(predicted: Column, expected: Column) -> Column:
    """Share of expected ids that are predicted; nothing expected: 1."""
    p, e = id_set(predicted), id_set(expected)
    return F.when(F.size(e) == 0, 1.0).otherwise(F.size(F.array_intersect(p, e)) / F.size(e))


def best_of(predicted: Column, sets: Column, metric) -> Column:  # noqa: ANN001
    """The best value over several acceptable sets; without any, the value for the empty set."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.array_max(F.transform(sets, lambda s: metric(predicted, s))), metric(predicted, empty))


def recall_at(ranked: Column, expected: Column, k: int) -> Column:
    e = id_set(expected)
    return F.when(F.size(e) == 0, 1.0).otherwise(F.size(F.array_intersect(id_set(F.slice(ranked, 1, k)), e)) / F.size(e))


def reciprocal_rank(ranked: Column, expected: Column) -> Column:
    """1 / rank of the first hit; no hit 0, nothing expected 1."""
    e = id_set(expected)
    r = F.transform(ranked, lambda x: F.lower(x))
    ranks = F.filter(F.transform(r, lambda x, i: F.when(F.array_contains(e, x), i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(e) == 0, 1.0).when(F.size(ranks) == 0, 0.0).otherwise(1.0 / F.array_min(ranks))


def ndcg(ranked: Column, grades: Column, k: int) -> Column:
    """Normalised discounted gain at k. grades: map of id to grade. A repeated id counts once, later places keep their discount;
    an ideal gain of zero gives 1."""
    r = F.transform(ranked, lambda x: F.lower(x))
    gain = lambda g: F.pow(F.lit(2.0), F.greatest(F.lit(0), g)) - 1.0
    term = F.transform(F.slice(r, 1, k), lambda x, i: F.when(F.array_position(r, x) == i + 1, gain(F.coalesce(F.element_at(grades, x), F.lit(0))) / F.log2(i + 2.0)).otherwise(0.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    ideal = F.slice(F.reverse(F.array_sort(F.filter(F.map_values(grades), lambda g: g > 0))), 1, k)
    idcg = total(F.transform(ideal, lambda g, i: gain(g) / F.log2(i + 2.0)))
    return F.when(idcg <= 0, 1.0).otherwise(total(term) / idcg)


def refusal_correct(refused: Column, acceptable: Column, required: Column) -> Column:
    """1 or 0; null where a refusal is acceptable but not required, as it then says nothing."""
    r = F.coalesce(refused, F.lit(False))
    return F.when(required, r.cast("double")).when(F.coalesce(acceptable, F.lit(False)), F.lit(None).cast("double")).otherwise((~r).cast("double"))


def routing_correct(predicted: Column, expected: Column, acceptable: Column | None = None) -> Column:
    p = F.lower(F.trim(predicted))
    ok = p == F.lower(F.trim(expected))
    if acceptable is not None:
        ok = ok | F.array_contains(F.transform(acceptable, lambda x: F.lower(F.trim(x))), p)
    return F.coalesce(ok, F.lit(False)).cast("double")


def citation_coverage(answer: Column, cites: Column, per: int = 1) -> Column:
    """Citations per paragraph (per > 1: per group of paragraphs), at most 1; no citations or a blank text: 0."""
    n = F.size(F.filter(F.split(F.coalesce(answer, F.lit("")), "\n\n"), lambda p: F.trim(p) != ""))
    return F.when((cites == 0) | (n == 0), 0.0).otherwise(F.least(F.lit(1.0), cites / F.greatest(F.lit(1), F.ceil(n / F.lit(per)))))


#: The model's share of confidence, the floor of coverage, the score below which no answer is given.
MODEL_SIGNAL, COVERAGE_FLOOR, REFUSE_BELOW = 0.85, 0.05, 0.65


def confidence(answer: Column, cites: Column) -> Column:
    """Geometric mean of retrieval, model and coverage signals."""
    r = F.when(cites > 0, 1.0).otherwise(0.5)
    return F.pow(r * MODEL_SIGNAL * F.greatest(citation_coverage(answer, cites, 4), F.lit(COVERAGE_FLOOR)), F.lit(1 / 3))


def refusal_category(answer: Column, cites: Column) -> Column:
    """Why an answer is refused, by its weakest signal; null where it is not."""
    r, c = F.when(cites > 0, 1.0).otherwise(0.5), citation_coverage(answer, cites, 4)
    why = F.when((c <= COVERAGE_FLOOR) & (r <= 0.5), "OutOfScope").when((r <= MODEL_SIGNAL) & (r <= c), "InsufficientGrounding").when(F.lit(MODEL_SIGNAL) <= c, "LowModelConfidence").otherwise("InsufficientGrounding")
    return F.when(confidence(answer, cites) < REFUSE_BELOW, why)


def normal_score(score: Column, top: float = 4.0) -> Column:
    return F.least(F.greatest(score / top, F.lit(0.0)), F.lit(1.0))
