"""Error by segment: every dimension in one pass over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from forecourt import constants as K
from forecourt.functions import bands
from forecourt.functions.numbers import finite
from forecourt.functions.text import blank_to_null
from forecourt.operators import metrics, quantiles as q
from forecourt.session import materialize, stored

# Dimension -> how many segments of it to report, most frequent first.
TOP_DIMENSIONS = {"make": 10, "city": 10}


def dimensions(
    actual: Column,
    price_edges: Sequence[float] = K.REPORT_PRICE_EDGES,
    kms_edges: Sequence[float] = K.REPORT_KMS_EDGES,
) -> Column:
    """array<struct<dimension, segment, band_order>> of the nine report dimensions."""
    text = lambda c: F.coalesce(blank_to_null(F.col(c)), F.lit(K.UNKNOWN))
    none = F.lit(None).cast("int")
    kms, owners = F.col("kms"), F.col("ownership")
    year = F.col("year").cast("int")
    rows = [
        ("price_band", bands.band(actual, price_edges, K.REPORT_PRICE_LABELS), bands.band_order(actual, price_edges)),
        ("make", text("make"), none),
        ("year", year.cast("string"), year),
        ("city", text("city"), none),
        ("kms_band", bands.band(kms, kms_edges, K.REPORT_KMS_LABELS), bands.band_order(kms, kms_edges)),
        ("ownership", bands.owner_band(owners), bands.band_order(owners, K.REPORT_OWNER_EDGES)),
        ("transmission", text("transmission"), none),
        ("fuel", text("fuel"), none),
        ("body_type", text("body_type"), none),
    ]
    return F.array(*[
        F.struct(F.lit(n).alias("dimension"), s.alias("segment"), o.alias("band_order")) for n, s, o in rows
    ])


def _exploded(df: DataFrame, actual: str, preds: Mapping[str, str], **edges) -> DataFrame:
    """(dimension, segment, band_order, ape_*, pe_*) per row and dimension; unbanded rows drop out."""
    a = finite(F.col(actual))
    rows = df.where(a != 0)
    errors = []
    for name, column in preds.items():
        p = finite(F.col(column))
        rows = rows.where(p.isNotNull())
        errors += [(F.abs(p - a) / a * 100.0).alias(f"ape_{name}"), ((p - a) / a * 100.0).alias(f"pe_{name}")]
    out = rows.select(F.explode(dimensions(a, **edges)).alias("__d"), *errors)
    return out.select("__d.*", *[c for c in out.columns if c != "__d"]).where(F.col("segment").isNotNull())


def _top_only(table: DataFrame, top: Mapping[str, int]) -> DataFrame:
    """Keep the most frequent segments of some dimensions; the window is over the aggregated table."""
    order = Window.partitionBy("dimension").orderBy(F.desc("rows"), F.asc("segment"))
    limits = F.try_element_at(F.create_map(*[F.lit(x) for kv in top.items() for x in kv]), F.col("dimension"))
    ranked = table.withColumn("__r", F.row_number().over(order))
    return ranked.where(limits.isNull() | (F.col("__r") <= limits)).drop("__r")


def error_summary(
    df: DataFrame, actual: str = "price", pred: str = "prediction", top: Mapping[str, int] = TOP_DIMENSIONS, **edges
) -> DataFrame:
    """MAPE, MPE and direction of the miss per segment of nine dimensions."""
    rows = _exploded(df, actual, {"x": pred}, **edges)
    table = rows.groupBy("dimension", "segment", "band_order").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("ape_x").alias("mape"), F.avg("pe_x").alias("mpe")
    )
    return _top_only(table, top).withColumn("direction", metrics.direction(F.col("mpe")))


def top_makes(df: DataFrame, actual: str = "price", pred: str = "prediction", n: int = 10) -> DataFrame:
    """The n most frequent makes and cities with their errors, best MAPE first."""
    table = error_summary(df, actual, pred, {"make": n, "city": n})
    return table.where(F.col("dimension").isin("make", "city")).drop("band_order").orderBy("dimension", "mape", "segment")


def base_vs_adjusted(
    df: DataFrame, actual: str = "price", base: str = "prediction", adjusted: str = "prediction_2",
    top: Mapping[str, int] = TOP_DIMENSIONS, **edges,
) -> DataFrame:
    """The same summary for two predictions side by side, still in one pass."""
    rows = _exploded(df, actual, {"base": base, "adjusted": adjusted}, **edges)
    table = rows.groupBy("dimension", "segment", "band_order").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(f"{kind}_{name}").alias(f"{out}_{name}") for name in ("base", "adjusted") for kind, out in (("ape", "mape"), ("pe", "mpe"))],
    )
    out = _top_only(table, top)
    return out.withColumn("mape_change", F.col("mape_adjusted") - F.col("mape_base"))


# Dimension -> (segments to list, rows a segment needs).
WORST = {
    "actual_price_band": (10, 20), "make": (15, 30), "model": (20, 30),
    "city": (15, 30), "fuel": (10, 20), "body_type": (10, 20),
}


def detail_rows(df: DataFrame, actual: str = "price", pred: str = "prediction", edges: Sequence[float] = K.PRICE_SEGMENT_EDGES) -> DataFrame:
    """Prediction rows with percentage errors and the band of the actual price."""
    a, p = F.col(actual), F.col(pred)
    size = F.greatest(a, F.lit(1.0))
    return df.select(
        "listing_id", "make", "model", "variant", "city", "fuel", "body_type",
        a.alias("actual_price"), p.alias("predicted_price"),
        (F.abs(p - a) / size * 100.0).alias("ape_pct"), ((p - a) / size * 100.0).alias("pe_pct"),
        bands.price_segment(a, edges).alias("actual_price_band"),
    )


def worst_segments(detail: DataFrame, rules: Mapping[str, tuple[int, int]] = WORST) -> DataFrame:
    """Segments with the highest MAPE per dimension, among those with enough rows.

    Rows are stored, as prices are hardly ever equal: counting equal ones would ship every row once for each dimension.
    Medians are looked up for the listed segments only, of which there are at most as many as ``rules`` allow.
    """
    detail = stored(detail.select(*rules, "actual_price", "predicted_price"), "detail")
    pairs = F.array(*[F.struct(F.lit(c).alias("segment_type"), F.col(c).alias("segment_value")) for c in rules])
    rows = detail.select(F.explode(pairs).alias("__s"), "actual_price", "predicted_price")
    rows = rows.select("__s.*", "actual_price", "predicted_price")
    keys = ["segment_type", "segment_value"]
    table = metrics.regression_metrics(
        rows, keys, "actual_price", "predicted_price", ["rows", "mape", "mpe", "rmse", "mae"]
    )
    limit = F.try_element_at(F.create_map(*[F.lit(x) for c, (n, _) in rules.items() for x in (c, n)]), F.col("segment_type"))
    needed = F.try_element_at(F.create_map(*[F.lit(x) for c, (_, m) in rules.items() for x in (c, m)]), F.col("segment_type"))
    order = Window.partitionBy("segment_type").orderBy(F.desc("mape"), F.desc("rows"), F.asc("segment_value"))
    worst = table.where(F.col("rows") >= needed).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    worst = materialize(worst)
    listed = rows.join(F.broadcast(worst.select(*keys)), keys, "left_semi").withColumn("__one", F.lit(1))
    medians = q.medians(listed, keys, "actual_price", "median_actual", weight="__one").drop("n")
    return worst.join(medians, keys, "left")
