"""Row-wise business rules as column expressions, used alike on batch and streaming frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercantile.functions import dimensions as dim


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def row_count() -> Column:
    return F.count(F.lit(1))


def lookup(key: str | Column, values: Mapping[str, object], default: object = None) -> Column:
    """Value for ``key`` from a small constant mapping, else ``default``."""
    entries = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(entries, col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def canonical_segment(segment: str | Column) -> Column:
    """Segment label with aliases folded together."""
    return F.coalesce(lookup(segment, dim.SEGMENT_ALIASES), col(segment))


def by_segment(segment: str | Column, values: Mapping[str, object], default: object = None) -> Column:
    return lookup(canonical_segment(segment), values, default)


def binned(value: str | Column, upper_bounds: Sequence[tuple[float, str]], last: str | None = None) -> Column:
    """Label of the first bin whose inclusive upper bound holds ``value`` (NULL stays NULL)."""
    value = col(value)
    result = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in upper_bounds:
        result = result.when(value <= bound, F.lit(label))
    return result.otherwise(F.lit(last))


def risk_level(probability: str | Column) -> Column:
    return binned(probability, dim.RISK_LEVELS)


def ltv_level(value: str | Column) -> Column:
    return binned(value, dim.LTV_LEVELS, dim.LAST_LTV_LEVEL)


def score_segment(score: str | Column) -> Column:
    """Segment for a churn score (exclusive upper bounds)."""
    score = col(score)
    result = F.when(score.isNull(), F.lit(None).cast("string"))
    for bound, label in dim.SCORE_BANDS:
        result = result.when(score < bound, F.lit(label))
    return result.otherwise(F.lit(dim.LAST_SCORE_BAND))


def rfm_segment(r: str = "r_score", f: str = "f_score", m: str = "m_score") -> Column:
    """Segment by score columns; the first rule that holds wins."""
    return F.expr(
        f"""CASE
        WHEN {r} = 5 AND {f} >= 4 AND {m} >= 4 THEN 'Champions'
        WHEN {r} >= 4 AND {f} >= 4 AND {m} >= 3 THEN 'Loyal Customers'
        WHEN {r} = 5 AND {f} <= 2 THEN 'New Customers'
        WHEN {r} >= 4 AND {f} >= 3 THEN 'Potential Loyalists'
        WHEN {r} = 3 AND {f} >= 3 THEN 'Need Attention'
        WHEN {r} <= 2 AND {f} >= 4 AND {m} >= 4 THEN 'Lost High Value'
        WHEN {r} <= 2 THEN 'Hibernating'
        ELSE 'Others' END"""
    )


def segment_risk(segment: str | Column, recency: str | Column, kept: bool = True) -> Column:
    """Base risk of the segment, raised by up to a fifth as recency nears 180 days; ``kept`` in 0..1 unless told otherwise."""
    base = by_segment(segment, dim.BASE_RISK, dim.DEFAULT_RISK)
    aged = F.least(col(recency).cast("double"), F.lit(180.0)) / F.lit(180.0)
    risk = base * (F.lit(1.0) + aged * F.lit(0.2))
    return F.greatest(F.least(risk, F.lit(1.0)), F.lit(0.0)) if kept else risk


def simple_ltv(monetary: str | Column, frequency: str | Column) -> Column:
    """Spending so far plus a tenth of it per order."""
    return col(monetary).cast("double") * (F.lit(1.0) + col(frequency).cast("double") * F.lit(0.1))


# What a scoring request must satisfy, by field. Fixed values.
REQUEST_CHECKS = {
    "monetary": "monetary > 0",
    "frequency": "frequency >= 1",
    "avg_review_score": "avg_review_score BETWEEN 0 AND 5",
    "avg_installments": "avg_installments >= 1",
    "credit_card_rate": "credit_card_rate BETWEEN 0 AND 1",
    "late_delivery_rate": "late_delivery_rate BETWEEN 0 AND 1",
}


def failed_checks() -> Column:
    """Names of the fields that fail their check or are missing, in field order."""
    names = ", ".join(f"if(coalesce({ok}, false), NULL, '{name}')" for name, ok in REQUEST_CHECKS.items())
    return F.expr(f"array_compact(array({names}))")


def churn_score() -> Column:
    """Mean of six risk terms over the request fields, at most 1."""
    return F.expr(
        """least((
        (1D - least(CAST(monetary AS DOUBLE) / 1000D, 1D))
        + (avg_installments / 12D)
        + (1D - avg_review_score / 5D)
        + (1D - credit_card_rate)
        + late_delivery_rate
        + (1D - least(CAST(frequency AS DOUBLE) / 10D, 1D))
        ) / 6D, 1D)"""
    )


def score_confidence() -> Column:
    """Share of valid fields, then one raise and one cut.

    The raise is capped at .95, so it lowers a full score; the cut never goes below .3.
    """
    valid = " + ".join(f"if(coalesce({ok}, false), 1, 0)" for ok in REQUEST_CHECKS.values())
    share = round_to(F.expr(f"({valid}) / 6D"), 2)
    raised = F.when(F.expr("monetary > 500 AND frequency > 3"), F.least(share + 0.1, F.lit(0.95))).otherwise(share)
    cut = F.when(F.expr("late_delivery_rate > 0.3D"), F.greatest(raised - 0.1, F.lit(0.3))).otherwise(raised)
    return round_to(cut, 2)


def round_to(value: str | Column, places: int) -> Column:
    """DOUBLE rounded half away from zero after scaling, as array libraries and SQL engines do it."""
    scale = F.lit(float(10**places))
    return F.round(col(value).cast("double") * scale, 0) / scale


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole in DOUBLE, NULL when whole is 0."""
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole in DOUBLE, NULL when whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def dollars(value: str | Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(round_to(value, 2), 2))


def signed_percent(value: str | Column) -> Column:
    return F.format_string("%+.1f%%", round_to(value, 1))
