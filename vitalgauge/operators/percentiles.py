"""Exact linear-interpolated percentiles, whatever the size of a group.

Spark's own ``percentile`` keeps every distinct value of a group in one buffer. Here one aggregate turns the input into
cells, one for each (group, value), with the number of rows; that spreads any group over all partitions, and nothing reads
the input again. Counts, mean and range of a group follow from its cells. A value's bin is its binary logarithm in steps
of 1/1024, a fixed rising function, so a bin's values lie within 0.07 percent of each other and the number of bins follows
the spread of the data. Exact bin totals tell which bins hold the wanted ranks, and only those bins are sorted. One lazy
plan serves groups of every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rises with the value; the smallest double has the logarithm -1074.
_BIN = (
    "CASE WHEN _v = 0 THEN 0L WHEN isnan(_v) THEN 9000000L WHEN abs(_v) = double('Infinity') THEN"
    " cast(signum(_v) * 8000000 AS bigint) ELSE cast(signum(_v) AS bigint) * (floor(log2(abs(_v)) * 1024) + 1100000L) END"
)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join in which a null key matches a null key; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    condition = F.expr(" AND ".join(f"{k} <=> r_{k}" for k in keys))
    return left.join(renamed, condition, how).drop(*[f"r_{k}" for k in keys])


def value_cells(
    df: DataFrame, keys: list[str], value: str, counts: dict[str, str] | None = None, weight: str | None = None
) -> DataFrame:
    """One row for each (group, value ``_v``): rows ``_c``, and rows that meet each condition of ``counts``.

    ``weight`` names a column that says for how many rows a row stands.
    """
    stands_for = weight or "1L"
    wanted = {"_valued": f"{value} IS NOT NULL", **(counts or {})}
    cells = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.expr(f"sum({stands_for}) AS _c"),
        *[F.expr(f"sum(if({condition}, {stands_for}, 0L)) AS {name}") for name, condition in wanted.items()],
    )
    # True for every row. It names all columns, so none is pruned for one reader of the cells and kept for another: they
    # then share one exchange, and the input is read once.
    return cells.filter(" AND ".join(f"{c} >= 0" for c in ("_c", *wanted)))


def percentile_aggregates(
    df: DataFrame,
    keys: list[str],
    value: str,
    probabilities: dict[str, float],
    counts: dict[str, str] | None = None,
    moments: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """One row per group: the counts, with ``moments`` mean, minimum and maximum, and the named percentiles.

    Null values are left out of percentiles and moments, and count where a condition says so. Null keys are a group.
    """
    if not keys:
        # Always 0, but not a literal, so that the joins keep an equality key.
        one = df.withColumn("_all", F.pmod(F.hash(value), F.lit(1)))
        return percentile_aggregates(one, ["_all"], value, probabilities, counts, moments, weight).drop("_all")
    cells = value_cells(df, keys, value, counts, weight)
    totals = [F.expr(f"sum({name}) AS {name}") for name in counts or {}]
    if moments:
        totals += [
            F.expr("sum(_v * _c) / sum(_c) FILTER (WHERE _v IS NOT NULL) AS mean"),
            F.expr("max(_v) AS maximum"),
            F.expr("min(_v) AS minimum"),
        ]
    groups = cells.groupBy(*keys).agg(
        *(totals or [F.count("*").alias("_cells")])
    )
    binned = cells.filter("_valued > 0").select(*keys, "_v", "_c", F.expr(f"{_BIN} AS _bin"))
    # One row a bin from here to the rank lookup.
    group = Window.partitionBy(*keys)
    bins = (
        binned.groupBy(*keys, "_bin")
        .agg(F.sum("_c").alias("bin_rows"))
        .withColumn("_n", F.sum("bin_rows").over(group))
        .withColumn("before", F.sum("bin_rows").over(group.orderBy("_bin")) - F.col("bin_rows"))
    )
    ranks = ", ".join(
        f"named_struct('p', '{name}', 'edge', '{edge}', 'r',"
        f" cast({fn}((_n - 1) * {p}D) AS bigint), 'w', (_n - 1) * {p}D - floor((_n - 1) * {p}D))"
        for name, p in probabilities.items()
        for edge, fn in (("low", "floor"), ("high", "ceil"))
    )
    wanted = bins.select(
        *keys,
        "_bin",
        F.expr(
            f"transform(filter(array({ranks}), x -> x.r >= before AND x.r < before + bin_rows),"
            " x -> named_struct('p', x.p, 'edge', x.edge, 'r', x.r - before, 'w', x.w)) AS ranks"
        ),
    ).filter(F.size("ranks") > 0)
    inside = null_safe_join(binned, wanted, [*keys, "_bin"], "inner")
    running = F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    found = inside.withColumn("upto", running).select(
        *keys, "_v", F.expr("inline(filter(ranks, x -> x.r < upto AND x.r >= upto - _c))")
    )
    columns = []
    for name in probabilities:
        low = f"max(_v) FILTER (WHERE p = '{name}' AND edge = 'low')"
        high = f"max(_v) FILTER (WHERE p = '{name}' AND edge = 'high')"
        share = f"max(w) FILTER (WHERE p = '{name}')"
        columns.append(F.expr(f"{low} + ({high} - {low}) * {share} AS {name}"))
    return null_safe_join(groups.drop("_cells"), found.groupBy(*keys).agg(*columns), keys, "left")


def spread_percentiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Percentiles alone: one row per group with values."""
    return percentile_aggregates(df.filter(F.col(value).isNotNull()), keys, value, probabilities)
