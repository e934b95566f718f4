"""Exact order statistics and quantiles without gathering a group in one task.

``F.percentile`` / ``F.median`` keep every distinct value of a group in one buffer. Here
groups of up to ``GATHER`` rows are sorted after one exchange. Of larger ones the counts of
equal values are summed into coarse
order-preserving buckets (64 per octave, so their number has a fixed bound), and the bucket
holding each wanted rank is found. Only those few buckets are looked at more closely: their
counts are summed into ``FINER`` buckets each, and only the finer ones that hold a wanted
rank are looked at value by value. Statistics of several levels of keys (``level_quantiles``) count
the coarse buckets of the finest keys only and add these up, whatever the groups' sizes. So a task holds the coarse buckets of a group, or the finer
ones of a bucket, or the distinct values within one part in 64 * 4096 of an octave.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from forecourt.functions.numbers import finite
from forecourt.session import materialize, stored

TOTAL = "n"
COARSE, FINER = 64, 4096
GATHER = 250_000  # rows of a group that one task may sort
WANTED = 100_000  # wanted buckets of all levels that are broadcast


def _code(per_octave: int) -> str:
    """Non-decreasing integer code of a double, so many to an octave; 1600 is above 1075, the largest magnitude of log2.

    Factors that are powers of two are exact, so that codes of a finer scale nest in those of a coarser one.
    """
    shift = 1600 * per_octave
    return (
        f"CASE WHEN __v > 0 THEN CAST(floor(log2(__v) * {per_octave}) AS BIGINT) + {shift} "
        f"WHEN __v < 0 THEN -CAST(floor(log2(-__v) * {per_octave}) AS BIGINT) - {shift} ELSE 0L END"
    )


UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    ranks: Mapping[str, str],
    holdout: tuple[str, int] | None = None,
    weight: str | None = None,
    held: Sequence[str] = (),
    gather: int = GATHER,
) -> DataFrame:
    """Per key: ``n`` non-missing values, and per name the value at a 0-based rank (SQL text over ``n``).

    Null keys form a group of their own. ``weight`` names a column with how often a row's value
    counts, for rows that are counts already. ``holdout=(fold column, k)`` adds a key column ``hold``
    and answers, for each fold, over the rows of all *other* folds; ``held`` names instead one 0/1
    column per fold, whether a row counts while that fold is left out. A row has a count per
    fold, so none is copied k-1 times.

    Groups of up to ``gather`` rows are sorted by value after one exchange by their keys. Of the larger
    ones there are at most rows / ``gather``, so what is wanted of them is known to every task.
    """
    keys = list(keys)
    times = f"CAST({weight} AS BIGINT)" if weight else "1L"
    counts = {"__c": times} if not held and not holdout else {}
    counts |= {f"__f{j}": f"if({holdout[0]} <=> {j}, 0L, {times})" for j in range(holdout[1])} if holdout else {}
    counts |= {f"__f{j}": f"{times} * {c}" for j, c in enumerate(held)}
    given = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, finite(given).alias("__v"), *[F.expr(f"{e} AS {c}") for c, e in counts.items()]).where("__v IS NOT NULL")
    if not weight:  # read again below
        rows = rows.groupBy(*keys, "__v").agg(*[F.sum(c).alias(c) for c in counts])
    if not keys:
        return _bucketed(rows, keys, ranks, list(counts))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > gather)
    large = F.broadcast(sizes.select(*[F.col(k).alias(f"__k_{k}") for k in keys]))
    same = F.expr(" AND ".join(f"{k} <=> __k_{k}" for k in keys))
    small = _sorted(rows.join(large, same, "left_anti"), keys, ranks, list(counts))
    return small.unionByName(_bucketed(rows.join(large, same, "left_semi"), keys, ranks, list(counts)))


def _per_hold(counts: Sequence[str], *columns: str) -> str:
    """One row per fold left out, of columns that carry the count's name behind theirs."""
    parts = (", ".join(f"{c}{n} AS {c}" for c in columns) for n in counts)
    return f"inline(array({', '.join(f'struct({j} AS hold, {part})' for j, part in enumerate(parts))}))"


def _sorted(rows: DataFrame, keys: Sequence[str], ranks: Mapping[str, str], counts: Sequence[str]) -> DataFrame:
    """Order statistics of groups that a task can sort each: grouping and windows share the exchange by key."""
    part = f"PARTITION BY {', '.join(keys)}"
    values = rows.repartition(*keys).groupBy(*keys, "__v").agg(*[F.sum(c).alias(f"__n{c}") for c in counts])
    summed = [f"sum(__n{c}) OVER ({part}) AS {TOTAL}{c}" for c in counts] + [f"sum(__n{c}) OVER ({part} ORDER BY __v {UPTO}) AS __end{c}" for c in counts]
    values = values.selectExpr("*", *summed).selectExpr(*keys, "__v", _per_hold(counts, "__n", TOTAL, "__end")).where("__n > 0")
    groups = [*keys, *(["hold"] if counts[0] != "__c" else [])]
    found = [
        F.expr(f"max(CASE WHEN CAST({rank} AS BIGINT) >= __end - __n AND CAST({rank} AS BIGINT) < __end THEN __v END) AS {name}")
        for name, rank in ranks.items()
    ]
    return values.groupBy(*groups).agg(F.expr(f"max({TOTAL}) AS {TOTAL}"), *found)


def _bucketed(rows: DataFrame, keys: Sequence[str], ranks: Mapping[str, str], counts: Sequence[str]) -> DataFrame:
    """Order statistics of few large groups: only counts of buckets move, and the values of wanted ones."""
    coded = rows.selectExpr("*", f"{_code(COARSE)} AS __b", f"{_code(COARSE * FINER)} AS __d")
    buckets = coded.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__bc{c}") for c in counts])
    buckets, wanted_ranks, holds = _ranked(buckets, keys, ranks, counts)
    groups, held = [*keys, "hold"], " OR ".join(holds.values())

    def values_of(wanted: DataFrame, code: str) -> DataFrame:
        """The values whose ``code`` is wanted, with the group's total, the bucket's start and the ranks; null keys match."""
        on = [*keys, code]
        wanted = wanted.selectExpr(*[f"{k} AS __k_{k}" for k in on], "hold", TOTAL, "__start", *wanted_ranks)
        found = coded.join(F.broadcast(wanted), F.expr(" AND ".join(f"{k} <=> __k_{k}" for k in on)))
        return found.selectExpr(*groups, "__v", "__b", "__d", TOTAL, "__start", f"get(array({', '.join(counts)}), hold) AS __n", *wanted_ranks)

    finer = _counted(values_of(buckets.where(held), "__b"), groups, wanted_ranks, "__b", "__d")
    values = _counted(values_of(_placed(finer, groups, "__b", "__d").where(held), "__d"), groups, wanted_ranks, "__d", "__v")
    return _found(values, keys, holds, counts)


def _ranked(buckets: DataFrame, keys: Sequence[str], ranks: Mapping[str, str], counts: Sequence[str]) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Each fold's buckets (``__bc`` and the count's name) with where they start and end; the ranks' columns, and their tests."""
    buckets = buckets.selectExpr(*keys, "__b", _per_hold(counts, "__bc")).where("__bc > 0")
    # At most one row per bucket and group passes through these windows.
    part = f"PARTITION BY {', '.join([*keys, 'hold'])}"
    buckets = buckets.selectExpr(
        *keys, "hold", "__b", f"sum(__bc) OVER ({part}) AS {TOTAL}",
        f"sum(__bc) OVER ({part} ORDER BY __b {UPTO}) AS __end",
        f"sum(__bc) OVER ({part} ORDER BY __b {UPTO}) - __bc AS __start",
    ).selectExpr("*", *[f"CAST({rank} AS BIGINT) AS __r_{name}" for name, rank in ranks.items()])
    return buckets, [f"__r_{name}" for name in ranks], {name: f"(__r_{name} >= __start AND __r_{name} < __end)" for name in ranks}


def _placed(rows: DataFrame, groups: Sequence[str], within: str, order: str) -> DataFrame:
    """``__start`` and ``__end`` of each row of a bucket, from the bucket's own start."""
    inside = f"PARTITION BY {', '.join([*groups, within])} ORDER BY {order} {UPTO}"
    kept = [c for c in rows.columns if c not in ("__start", "__n")]
    return rows.selectExpr(*kept, f"__start + sum(__n) OVER ({inside}) AS __end", f"__start + sum(__n) OVER ({inside}) - __n AS __start")


def _counted(found: DataFrame, groups: Sequence[str], wanted_ranks: Sequence[str], *by: str) -> DataFrame:
    # ``first`` of what is equal within a bucket anyway.
    same = [F.first(c).alias(c) for c in (TOTAL, "__start", *wanted_ranks)]
    return found.groupBy(*groups, *by).agg(F.sum("__n").alias("__n"), *same)


def _found(values: DataFrame, keys: Sequence[str], holds: Mapping[str, str], counts: Sequence[str]) -> DataFrame:
    """The value at each rank, from counted values of finer buckets."""
    groups = [*keys, "hold"]
    values = _placed(values, groups, "__d", "__v").where(" OR ".join(holds.values()))
    found = [F.expr(f"max(CASE WHEN {test} THEN __v END) AS {name}") for name, test in holds.items()]
    return values.groupBy(*(groups if counts[0] != "__c" else keys)).agg(F.expr(f"max({TOTAL}) AS {TOTAL}"), *found)


def _joined(rows: DataFrame, wanted: DataFrame, on: Sequence[str], limit: int) -> DataFrame:
    """``rows`` with what is wanted of them (null keys match): up to about ``limit`` of the largest groups' buckets by broadcast."""
    mine = [c for c in rows.columns if c not in wanted.columns or c in on]
    found = rows.select(*mine).alias("r")
    renamed = wanted.select(*[F.col(c).alias(f"__k_{c}" if c in on else c) for c in wanted.columns])
    same = F.expr(" AND ".join(f"r.{c} <=> __k_{c}" for c in on))
    kept = [*[f"r.{c}" for c in mine], *[c for c in wanted.columns if c not in on]]
    number, total = wanted.agg(F.count(F.lit(1)), F.sum(TOTAL)).first()
    if number <= limit:
        return found.join(F.broadcast(renamed), same).select(*kept)
    large = F.col(TOTAL) > total // limit  # fewer than ``limit`` buckets are in groups of more than that
    by_task = found.join(renamed.where(~large), same).select(*kept)
    return found.join(F.broadcast(renamed.where(large)), same).select(*kept).unionByName(by_task)


def level_order_statistics(
    df: DataFrame,
    own: Sequence[str],
    keys: Sequence[str],
    by_level: Callable[..., DataFrame],
    value: Column | str,
    ranks: Mapping[str, str],
    holdout: tuple[str, int] | None = None,
    held: Sequence[str] = (),
    limit: int = WANTED,
) -> DataFrame:
    """As ``order_statistics`` for groups of several levels, of which a row is in one each.

    ``by_level(rows, *columns)`` gives the ``keys`` of all levels for rows of the finest keys ``own``, with the
    columns named. Only coarse buckets of the finest keys are counted and shuffled, and added up for the levels;
    of the rows, only those in a bucket with a wanted rank are copied to the levels.
    """
    times = {f"__f{j}": f"if({holdout[0]} <=> {j}, 0L, 1L)" for j in range(holdout[1])} if holdout else {"__c": "1L"}
    times = {f"__f{j}": f"CAST({c} AS BIGINT)" for j, c in enumerate(held)} or times
    given, counts = F.col(value) if isinstance(value, str) else value, list(times)
    facts = [*([holdout[0]] if holdout else []), *held]
    rows = stored(df.select(*own, finite(given).alias("__v"), *facts).where("__v IS NOT NULL"), "values")
    rows = rows.selectExpr(*own, "__v", *[f"{e} AS {c}" for c, e in times.items()], f"{_code(COARSE)} AS __b")

    finest = rows.groupBy(*own, "__b").agg(*[F.sum(c).alias(f"__bc{c}") for c in counts])
    summed = [f"__bc{c}" for c in counts]
    buckets = by_level(finest, "__b", *summed).groupBy(*keys, "__b").agg(*[F.sum(c).alias(c) for c in summed])
    buckets, wanted_ranks, holds = _ranked(buckets, keys, ranks, counts)
    groups, test = [*keys, "hold"], " OR ".join(holds.values())
    wanted = materialize(buckets.where(test).select(*groups, "__b", TOTAL, "__start", *wanted_ranks))

    hits = _joined(by_level(rows, "__v", "__b", *counts), wanted, [*keys, "__b"], limit)
    hits = hits.selectExpr(*groups, "__v", "__b", f"{_code(COARSE * FINER)} AS __d", TOTAL, "__start", f"get(array({', '.join(counts)}), hold) AS __n", *wanted_ranks)
    hits = stored(hits.where("__n > 0"), "hits")
    finer = _placed(_counted(hits, groups, wanted_ranks, "__b", "__d"), groups, "__b", "__d").where(test)
    finer = materialize(finer.select(*groups, "__d", TOTAL, "__start", *wanted_ranks))
    values = _joined(hits.select(*groups, "__v", "__d", "__n"), finer, [*groups, "__d"], limit)
    return _found(_counted(values, groups, wanted_ranks, "__d", "__v"), keys, holds, counts)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    probs: Mapping[str, float],
    holdout: tuple[str, int] | None = None,
    weight: str | None = None,
    held: Sequence[str] = (),
    gather: int = GATHER,
) -> DataFrame:
    """Per key: ``n`` and linearly interpolated exact quantiles."""
    ranks, values = _between(probs)
    stats = order_statistics(df, keys, value, ranks, holdout, weight, held, gather)
    return stats.selectExpr(*keys, *(["hold"] if holdout or held else []), TOTAL, *values)


def _between(probs: Mapping[str, float]) -> tuple[dict[str, str], list[str]]:
    """The ranks around each quantile, and the quantiles from the values there."""
    at = {name: f"({TOTAL} - 1) * {float(p)!r}D" for name, p in probs.items()}
    ranks = {f"{name}__lo": f"floor({pos})" for name, pos in at.items()}
    ranks |= {f"{name}__hi": f"ceil({pos})" for name, pos in at.items()}
    return ranks, [f"{name}__lo + ({name}__hi - {name}__lo) * ({pos} - floor({pos})) AS {name}" for name, pos in at.items()]


def level_medians(
    df: DataFrame, own: Sequence[str], keys: Sequence[str], by_level: Callable[..., DataFrame], value: Column | str, name: str = "median",
    holdout: tuple[str, int] | None = None, held: Sequence[str] = (), limit: int = WANTED,
) -> DataFrame:
    """Per key of every level: ``n`` and the exact median."""
    ranks, values = _between({name: 0.5})
    stats = level_order_statistics(df, own, keys, by_level, value, ranks, holdout, held, limit)
    return stats.selectExpr(*keys, *(["hold"] if holdout or held else []), TOTAL, *values)


def medians(
    df: DataFrame, keys: Sequence[str], value: Column | str, name: str = "median", holdout: tuple[str, int] | None = None,
    weight: str | None = None, held: Sequence[str] = (), gather: int = GATHER,
) -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5}, holdout, weight, held, gather)


def median_scalar(df: DataFrame, value: Column | str) -> Column:
    return medians(df, [], value).select("median").scalar()


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """One row per column name with its quantiles: all columns in one pass."""
    long = df.selectExpr(*[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in columns]).unpivot([], list(columns), "column", "__x")
    return quantiles(long, ["column"], "__x", probs)


def bounds(df: DataFrame, value: Column | str, low: float, high: float) -> Column:
    """struct(low, high) of two global quantiles as a scalar subquery: no join, no collect.

    Put it in a column once and refer to that; every further reference is planned separately.
    """
    return quantiles(df, [], value, {"low": low, "high": high}).selectExpr("struct(low, high) AS b").scalar()
