"""Right-closed bands. MLlib's Bucketizer is left-closed, so these are CASE chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from forecourt import constants as K


def band(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first edge that is >= the value; the last label is open. Null stays null."""
    out = F.when(c <= edges[0], F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:-1]):
        out = out.when(c <= edge, F.lit(label))
    return out.when(c.isNotNull(), F.lit(labels[-1]))


def band_order(c: Column, edges: Sequence[float]) -> Column:
    """1-based position of the band, for sorting reports."""
    return band(c, edges, [str(i + 1) for i in range(len(edges) + 1)]).cast("int")


def price_segment(c: Column, edges: Sequence[float] = K.PRICE_SEGMENT_EDGES) -> Column:
    """Price segment; a missing price falls into the lowest one."""
    return band(F.coalesce(c, F.lit(0.0)), edges, K.PRICE_SEGMENT_LABELS)


def owner_band(c: Column) -> Column:
    """Owners 1..5+; zero counts as one, negatives have no band."""
    return F.when(c >= 0, band(c, K.REPORT_OWNER_EDGES, K.REPORT_OWNER_LABELS))


def age_bucket(car_age: Column) -> Column:
    """Two-year buckets 0..12 as text; a missing age is bucket 0."""
    years = F.greatest(F.coalesce(car_age, F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(years / 2.0), F.lit(12)).cast("int").cast("string")
