"""Post-hoc calibration of predictions: segment factors, a linear step, and choosing between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from forecourt import constants as K
from forecourt.functions.numbers import clip, finite
from forecourt.operators import quantiles as q
from forecourt.operators.skew import ROWS, attach
from forecourt.session import materialize, stored

MIN_SEGMENT_ROWS = 20
FACTOR_RANGE = (0.4, 1.6)
BIAS_LIMIT = 5.0
BIAS_PENALTY = 25.0
CANDIDATES = ("identity", "global_factor", "segment_factor", "segment_factor_linear")


def _valid(df: DataFrame, actual: str, pred: str, segment: str) -> DataFrame:
    rows = df.select(
        finite(F.col(actual)).alias("actual"), finite(F.col(pred)).alias("pred"),
        F.coalesce(F.col(segment), F.lit(K.UNKNOWN)).alias("segment"),
    )
    return rows.where((F.col("pred") > 0) & (F.col("actual") > 0))


def segment_factors(df: DataFrame, actual: str = "price", pred: str = "prediction", segment: str = "segment") -> DataFrame:
    """(scope, segment, n, factor): median of actual / prediction per segment and over all rows.

    Segments with few rows take the overall factor. Factors are clipped. Ratios are hardly ever equal: they are stored
    and read again, counting once each (``weight``), as counting equal ones would ship them all.
    """
    ratio = F.col("actual") / F.greatest("pred", F.lit(1.0))
    rows = stored(_valid(df, actual, pred, segment).select("segment", ratio.alias("ratio")), "ratios")
    scopes = F.array(
        F.struct(F.lit("segment").alias("scope"), F.col("segment")),
        F.struct(F.lit("global").alias("scope"), F.lit("*").alias("segment")),
    )
    long = rows.select(F.explode(scopes).alias("s"), "ratio", F.lit(1).alias("__one")).select("s.*", "ratio", "__one")
    meds = materialize(q.medians(long, ["scope", "segment"], "ratio", "__m", weight="__one"))
    overall = meds.where("scope = 'global'").select("__m").scalar()
    enough = (F.col("scope") == "global") | (F.col("n") >= MIN_SEGMENT_ROWS)
    return meds.select(
        "scope", "segment", "n", clip(F.when(enough, F.col("__m")).otherwise(overall), *FACTOR_RANGE).alias("factor")
    )


def _with_factor(rows: DataFrame, factors: DataFrame, segment: str) -> DataFrame:
    own = factors.where(F.col("scope") == "segment").select(
        F.col("segment").alias(segment), F.col("n").alias(ROWS), F.col("factor").alias("__own")
    )
    overall = factors.where(F.col("scope") == "global").select("factor").scalar()
    out = attach(rows, own, [segment]).withColumn("__global", F.coalesce(overall, F.lit(1.0)))
    return out.withColumn("__factor", F.coalesce("__own", "__global")).drop("__own")


def linear_step(df: DataFrame, factors: DataFrame, actual: str = "price", pred: str = "prediction", segment: str = "segment") -> DataFrame:
    """One row (slope, intercept) of actual on the factor-adjusted prediction."""
    rows = _with_factor(_valid(df, actual, pred, segment), factors, "segment")
    adjusted = F.col("pred") * F.col("__factor")
    return rows.agg(
        F.coalesce(F.regr_slope(F.col("actual"), adjusted), F.lit(1.0)).alias("slope"),
        F.coalesce(F.regr_intercept(F.col("actual"), adjusted), F.lit(0.0)).alias("intercept"),
    )


def candidate_scores(
    df: DataFrame, factors: DataFrame, linear: DataFrame, actual: str = "price", pred: str = "prediction", segment: str = "segment"
) -> DataFrame:
    """(candidate, mape, mpe, objective, within_bias, chosen) for the four calibrations, in one aggregate."""
    rows = _with_factor(_valid(df, actual, pred, segment), factors, "segment")
    rows = rows.withColumn("__line", linear.select(F.struct("slope", "intercept").alias("l")).scalar())
    line = F.col("__line")
    a, p = F.col("actual"), F.col("pred")
    adjusted = p * F.col("__factor")
    outputs = (
        p,
        F.greatest(p * F.col("__global"), F.lit(1.0)),
        adjusted,
        F.greatest(line["slope"] * adjusted + line["intercept"], F.lit(1.0)),
    )
    size = F.greatest(a, F.lit(1.0))
    sums = []
    for name, out in zip(CANDIDATES, outputs):
        sums += [(F.avg(F.abs(out - a) / size) * 100.0).alias(f"{name}_mape"), (F.avg((out - a) / size) * 100.0).alias(f"{name}_mpe")]
    table = F.array(*[
        F.struct(F.lit(c).alias("candidate"), F.col(f"{c}_mape").alias("mape"), F.col(f"{c}_mpe").alias("mpe")) for c in CANDIDATES
    ])
    scored = rows.agg(*sums).select(F.posexplode(table).alias("pos", "r")).select("pos", "r.*")
    scored = scored.withColumn("objective", F.col("mape") + BIAS_PENALTY * F.greatest(F.abs("mpe") - BIAS_LIMIT, F.lit(0.0)))
    scored = scored.withColumn("within_bias", F.abs("mpe") <= BIAS_LIMIT)
    order = F.struct((~F.col("within_bias")).alias("outside"), "objective", "mape", "pos")
    best = scored.agg(F.min(order).alias("b")).scalar()
    return scored.withColumn("chosen", F.col("pos") == best["pos"]).drop("pos")


@dataclass
class Calibration:
    """Chosen calibration: segment factors and one row (slope, intercept, use_segments, global_factor)."""

    factors: DataFrame
    line: DataFrame

    def apply(self, df: DataFrame, pred: str = "prediction", segment: str = "segment", out: str = "calibrated") -> DataFrame:
        return apply_calibration(df, self.factors, self.line, pred, segment, out)


def fit_calibration(df: DataFrame, actual: str = "price", pred: str = "prediction", segment: str = "segment") -> Calibration:
    df = stored(_valid(df, actual, pred, segment), "valid")  # read by each step
    actual, pred, segment = "actual", "pred", "segment"
    factors = materialize(segment_factors(df, actual, pred, segment))
    linear = materialize(linear_step(df, factors, actual, pred, segment))
    scores = candidate_scores(df, factors, linear, actual, pred, segment)
    overall = factors.where(F.col("scope") == "global").select("factor").scalar()
    linear = linear.withColumns({"__chosen": scores.where("chosen").select("candidate").scalar(), "__overall": overall})
    chosen, overall = F.col("__chosen"), F.col("__overall")
    is_linear = chosen == CANDIDATES[3]
    line = linear.select(
        F.when(is_linear, F.col("slope")).otherwise(1.0).alias("slope"),
        F.when(is_linear, F.col("intercept")).otherwise(0.0).alias("intercept"),
        F.coalesce(chosen.isin(*CANDIDATES[2:]), F.lit(False)).alias("use_segments"),
        F.when(F.coalesce(chosen, F.lit(CANDIDATES[0])) == CANDIDATES[0], 1.0).otherwise(overall).alias("global_factor"),
        F.coalesce(chosen, F.lit(CANDIDATES[0])).alias("candidate"),
    )
    return Calibration(factors, materialize(line))


def apply_calibration(
    df: DataFrame, factors: DataFrame, line: DataFrame, pred: str = "prediction", segment: str = "segment", out: str = "calibrated"
) -> DataFrame:
    """slope * (prediction * factor) + intercept, at least 1; segments without a factor use the overall one."""
    settings = line.select(F.struct("slope", "intercept", "use_segments", "global_factor").alias("l")).scalar()
    one = F.col("__line")
    keyed = df.withColumn("__line", settings).withColumn("__segment", F.coalesce(F.col(segment), F.lit(K.UNKNOWN)))
    own = factors.where(F.col("scope") == "segment").select(
        F.col("segment").alias("__segment"), F.col("n").alias(ROWS), F.col("factor").alias("__own")
    )
    rows = attach(keyed, own, ["__segment"])
    factor = F.coalesce(F.when(one["use_segments"], F.col("__own")), one["global_factor"])
    value = F.greatest(one["slope"] * (F.col(pred) * factor) + one["intercept"], F.lit(1.0))
    return rows.withColumn(out, value).drop("__segment", "__own", "__line")
