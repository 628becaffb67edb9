"""Chart-data operators: histogram, box plot, scatter and series."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.query import run_query

# --- fixed values -----------------------------------------------------------
DEFAULT_BIN_SIZE = 10.0
MIN_BIN_SIZE = 1.0
QUARTILES = (0.25, 0.5, 0.75)
# ----------------------------------------------------------------------------

BOX = ("min", "q1", "median", "q3", "max")
_BLOCK = 10_000          # bins made by one task
_BUCKETS = 1024          # parts of a bracket of values in one pass
_ACCURACY = 10_000       # of the quantile sketch: rank error is at most rows / this


def number(c: Column) -> Column:
    """Finite number of a cell, else null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _long(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """(measure, value) rows of the finite values."""
    cells = F.array(*(F.struct(F.lit(n).alias("measure"), number(c).alias("value")) for n, c in cols.items()))
    return df.select(F.inline(cells)).filter(F.col("value").isNotNull())


def _named(cols: list[str] | dict[str, str]) -> dict[str, Column]:
    pairs = cols.items() if isinstance(cols, dict) else ((c, c) for c in cols)
    return {label: F.col(f"`{field}`") for label, field in pairs}


def histogram(df: DataFrame, cols: list[str] | dict[str, str], bin_size: float = DEFAULT_BIN_SIZE,
              min_bin_size: float | None = MIN_BIN_SIZE, empty: bool = True) -> DataFrame:
    """Counts per equal-width bin, shared by all measures: measure, bin, bin_start, bin_end, count.

    Bins cover the range of all measures from a multiple of the width; the last one is closed. Empty bins
    are zero, or left out with ``empty=False``, as a very wide range wants. The range of each measure is found
    first (one row per measure reaches the driver); values are then counted per bin in
    the map tasks, so only counts are shuffled. Many tasks make a wide range of bins.
    """
    width = float(bin_size or DEFAULT_BIN_SIZE)
    if min_bin_size is not None:
        width = max(width, min_bin_size)
    if width <= 0:
        raise ValueError("bin_size must be positive")
    spark, values = df.sparkSession, _long(df, _named(cols))
    ranges = values.groupBy("measure").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    if not ranges:
        return spark.createDataFrame([], "measure string, bin long, bin_start double, bin_end double, count long")
    lo = math.floor(min(r["lo"] for r in ranges) / width)
    # a top value on an edge belongs to the bin below that edge
    hi = max(lo, math.ceil(max(r["hi"] for r in ranges) / width) - 1)
    # Bins are counted from the first one as doubles, which hold any number a value can be divided to.
    k = F.least(_floor(F.col("value") / width), F.lit(float(hi))) - F.lit(float(lo))
    counts = values.groupBy("measure", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    if empty:
        parts = min(-(-(hi - lo + 1) // _BLOCK), spark.sparkContext.defaultParallelism)
        if hi - lo >= 1 << 53:
            raise ValueError("too many bins to list the empty ones; use empty=False or wider bins")
        measures = F.explode(F.array(*(F.lit(r["measure"]) for r in ranges)))
        bins = spark.range(0, hi - lo + 1, numPartitions=parts).select(F.col("id").cast("double").alias("k"), measures.alias("measure"))
        counts = bins.join(counts, ["measure", "k"], "left")
    start = F.lit(float(lo)) + F.col("k")
    return counts.select("measure", F.col("k").try_cast("long").alias("bin"), (start * width).alias("bin_start"),
                         ((start + 1) * width).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("count"))


def _floor(x: Column) -> Column:
    """The whole double below; from 2**52 on every double is whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def boxplot(df: DataFrame, cols: list[str] | dict[str, str], exact: bool = True) -> DataFrame:
    """Minimum, quartiles (linear interpolation) and maximum per measure."""
    named = _named(cols)
    if not exact:
        return _approximate_boxes(df, named)
    return _exact_boxes(df, named)


def _approximate_boxes(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    q = F.percentile_approx("value", [0.0, *QUARTILES, 1.0], _ACCURACY)
    out = _long(df, named).groupBy("measure").agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    return out.select("measure", "n", *(F.col("q")[i].alias(c) for i, c in enumerate(BOX)))


def _exact_boxes(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Exact quartiles by selection: no sort, no window, no group of values in one task.

    Every wanted rank lies in a bracket of values, at first the whole range. Each pass cuts all open
    brackets into buckets and counts them in the map tasks; of a bucket with a wanted rank the smallest and
    largest value are the next bracket, until both are one. The range of doubles is used up after some
    ten passes, usual data after three. Up to ``_BUCKETS`` + 1 counts per open bracket reach the driver.
    """
    spark = df.sparkSession
    values = df.select(*(number(c).alias(f"v{i}") for i, c in enumerate(named.values())))
    aggs = []
    for i in range(len(named)):
        v = F.col(f"v{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    head = values.agg(*aggs).first().asDict()
    wanted = {}  # measure number -> whole and fractional part of each quartile's rank
    for i in range(len(named)):
        if head[f"n{i}"]:
            wanted[i] = [divmod((head[f"n{i}"] - 1) * p, 1) for p in QUARTILES]
    # (measure number, low, high, values below, ranks inside)
    brackets = [(i, head[f"lo{i}"], head[f"hi{i}"], 0, sorted({int(r) + d for r, part in ranks for d in ((0, 1) if part else (0,))}))
                for i, ranks in wanted.items()]
    found = {}
    while brackets:
        done = [b for b in brackets if b[1] == b[2]]
        found |= {(i, r): lo for i, lo, _, _, ranks in done for r in ranks}
        brackets = _narrowed(values, [b for b in brackets if b[1] != b[2]])
    rows = []
    for i, label in enumerate(named):
        if i in wanted:
            low = [found[i, int(r)] for r, _ in wanted[i]]
            quartiles = [x + part * (found[i, int(r) + 1] - x) if part else x for x, (r, part) in zip(low, wanted[i], strict=True)]
            rows.append((label, head[f"n{i}"], head[f"lo{i}"], *quartiles, head[f"hi{i}"]))
    return spark.createDataFrame(rows, "measure string, n long, min double, q1 double, median double, q3 double, max double")


def _narrowed(values: DataFrame, brackets: list[tuple]) -> list[tuple]:
    """The brackets of the next pass: buckets that hold a wanted rank."""
    if not brackets:
        return []
    cells = []
    for k, (i, lo, hi, _, _) in enumerate(brackets):
        v = F.col(f"v{i}")
        inside = v.between(lo, hi)
        cells.append(F.struct(F.lit(k).alias("k"), F.when(inside, v).alias("v"), F.when(inside, _bucket(v, lo, hi)).alias("bucket")))
    rows = values.select(F.inline(F.array(*cells))).where("v is not null")
    counts = rows.groupBy("k", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    out = []
    for k, (i, _, _, below, ranks) in enumerate(brackets):
        for r in sorted((r for r in counts if r["k"] == k), key=lambda r: r["bucket"]):
            inside = [x for x in ranks if below <= x < below + r["n"]]
            if inside:
                out.append((i, r["lo"], r["hi"], below, inside))
            below += r["n"]
    return out


def _bucket(v: Column, lo: float, hi: float) -> Column:
    """A number that never falls as ``v`` grows and differs between ``lo`` and ``hi``: by sign, by size where the
    bracket spans many orders of magnitude, else evenly."""
    if lo < 0 < hi:
        return F.signum(v).cast("int")
    small, large = sorted((abs(lo), abs(hi)))
    if not small:
        return (v != 0).cast("int") * (1 if hi > 0 else -1)
    if math.log(large) - math.log(small) > 1:
        share = (F.log(F.abs(v)) - F.log(F.lit(small))) / (F.log(F.lit(large)) - F.log(F.lit(small)))
        share = share if lo > 0 else 1 - share
    elif math.isfinite(hi - lo):
        share = (v - lo) / F.lit(hi - lo)
    else:
        share = (v / 2 - lo / 2) / F.lit(hi / 2 - lo / 2)
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    # Rounding must not put both ends into one bucket, or a pass would gain nothing.
    return F.when(v == lo, 0).when(v == hi, _BUCKETS).otherwise(F.least(F.floor(share * _BUCKETS).cast("int"), F.lit(_BUCKETS - 1)))


def scatter(df: DataFrame, x: str, y: str, limit: int | None = None) -> DataFrame:
    """Pairs of finite numbers."""
    out = df.select(number(F.col(f"`{x}`")).alias(x), number(F.col(f"`{y}`")).alias(y)).dropna()
    return out if limit is None else out.limit(limit)


def series_by_x(df: DataFrame, x: str, measures: list[tuple[str, str | None]] | dict[str, str | None]) -> DataFrame:
    """One point per numeric X and measure, in X order: measure, x, y.

    ``measures`` gives (field, aggregation); the aggregation defaults to AVG.
    """
    pairs = list(measures.items()) if isinstance(measures, dict) else list(measures)
    cells = F.array(*(F.struct(F.lit(f).alias("measure"), number(F.col(f"`{f}`")).alias("y")) for f, _ in pairs))
    points = df.select(number(F.col(f"`{x}`")).alias("x"), F.inline(cells)).dropna(subset=["x", "y"])
    by_name = {"SUM": F.sum("y"), "MIN": F.min("y"), "MAX": F.max("y"), "COUNT": F.count("y").cast("double")}
    kinds = sorted({(a or "AVG").upper() for _, a in pairs})
    aggs = [by_name.get(a, F.avg("y")).alias(f"__{i}") for i, a in enumerate(kinds)]
    chosen = reduce(
        lambda acc, p: acc.when(F.col("measure") == p[0], F.col(f"__{kinds.index((p[1] or 'AVG').upper())}")),
        pairs, F.when(F.lit(False), F.lit(None).cast("double")))
    return points.groupBy("measure", "x").agg(*aggs).select("measure", "x", chosen.alias("y")).orderBy("measure", "x")


def category_series(df: DataFrame, category: str, measure: str = "*", aggregation: str = "COUNT",
                    top: int | None = None) -> DataFrame:
    """Name and value per category, largest first: bars and pie slices."""
    out = run_query(df, {
        "dimensions": [category], "measures": [{"field": measure, "aggregation": aggregation, "label": "value"}],
        "sortBy": [{"field": "value", "direction": "desc"}], "seriesLimit": top})
    return out.select(F.col(f"`{category}`").alias("name"), "value")
