"""Profiling: intro counts, missing shares and patterns, summary statistics,
correlations, densities. Each statistic is one aggregation pass; results
with one row per column are unpivoted from that single row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from tallystack.functions.strict import strict_agg
from tallystack.operators.ordered import ordered_prefix


def _long(df: DataFrame, ids, names, var: str, val: str) -> DataFrame:
    return df.unpivot(ids, names, var, val)


def profile_intro(df: DataFrame) -> DataFrame:
    """rows, columns, discrete / continuous / all-missing columns, missing
    cells, complete rows, total cells."""
    cols = df.columns
    stats = df.agg(F.count(F.lit(1)).alias("_rows"),
                   *[F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(cols)],
                   F.count_if(F.lit(True) if not cols else
                              F.greatest(*[F.col(c).isNull() for c in cols]) == F.lit(False)
                              if len(cols) > 1 else F.col(cols[0]).isNotNull()).alias("_complete"))
    rows = F.col("_rows")
    nn = [F.col(f"_nn{i}") for i in range(len(cols))]
    discrete = [c for c in df.schema.fields if isinstance(c.dataType, (StringType, BooleanType))]
    continuous = [c for c in df.schema.fields if isinstance(c.dataType, NumericType)]
    d_idx = [cols.index(f.name) for f in discrete]
    c_idx = [cols.index(f.name) for f in continuous]
    all_missing = sum([F.when(x == 0, 1).otherwise(0) for x in nn], F.lit(0))
    missing_cells = sum([rows - x for x in nn], F.lit(0).cast("long"))
    return stats.select(
        rows.alias("rows"), F.lit(len(cols)).cast("long").alias("columns"),
        sum([F.when(nn[i] > 0, 1).otherwise(0) for i in d_idx], F.lit(0)).cast("long").alias("discrete_columns"),
        sum([F.when(nn[i] > 0, 1).otherwise(0) for i in c_idx], F.lit(0)).cast("long").alias("continuous_columns"),
        all_missing.cast("long").alias("all_missing_columns"),
        missing_cells.cast("long").alias("missing_cells"),
        F.col("_complete").cast("long").alias("complete_rows"),
        (rows * len(cols)).cast("long").alias("total_cells"))


def profile_missing(df: DataFrame, cols=None) -> DataFrame:
    """(feature, n_missing, pct_missing) per column."""
    cols = cols or df.columns
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    lg = _long(one, ["_rows"], cols, "feature", "n_missing")
    return lg.select("feature", F.col("n_missing").cast("long").alias("n_missing"),
                     (F.col("n_missing") * 100.0 / F.col("_rows")).alias("pct_missing"))


def missing_pattern(df: DataFrame, cols=None, name: str = "pattern") -> DataFrame:
    """Distinct observed/missing patterns ('1' observed, '0' missing, in
    column order) with their row counts and number of missing cells."""
    cols = cols or df.columns
    mask = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols])
    n_miss = sum([F.when(F.col(c).isNull(), 1).otherwise(0) for c in cols], F.lit(0))
    return (df.select(mask.alias(name), n_miss.alias("n_missing_cols"))
              .groupBy(name, "n_missing_cols").agg(F.count(F.lit(1)).alias("n_rows")))


def exact_median(df: DataFrame, col: str) -> DataFrame:
    """Exact median of one column (mean of the two middle values for an even
    count) without holding the column in one task: count per distinct value
    (aggregation), order the distinct values with the two-phase prefix sum,
    then pick the value(s) covering the middle ranks. Returns one row
    (median)."""
    vals = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    per = vals.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    o = ordered_prefix(per, "v", "v", descending=False, sums={"cum": F.col("c")},
                       total_col=None)
    n = F.col("cum_total")
    k1 = F.floor((n + 1) / 2)
    k2 = F.ceil((n + 1) / 2)
    lo = F.col("cum") - F.col("c")   # ranks covered: (lo, cum]
    pick = o.select("v", F.when((k1 > lo) & (k1 <= F.col("cum")), 1).otherwise(0).alias("a"),
                    F.when((k2 > lo) & (k2 <= F.col("cum")), 1).otherwise(0).alias("b"))
    return pick.agg(((F.sum(F.col("v") * F.col("a")) + F.sum(F.col("v") * F.col("b"))) / 2.0)
                    .alias("median"))


def exact_medians(df: DataFrame, cols) -> dict:
    """Exact medians of several columns in one ordered pass: values of all
    columns in long form, counted per (column, value) (an aggregation), then
    ordered within each column by ``grouped_prefix``. Returns {col: median}."""
    from tallystack.operators.ordered import grouped_prefix
    long = (df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col(c).cast("double").alias("v"))
                                          for i, c in enumerate(cols)])).alias("s"))
              .select("s.g", "s.v").where(F.col("v").isNotNull()))
    from tallystack.session import checkpoint
    # the aggregate is read by three jobs (group stats, quantiles, result): written once
    per = checkpoint(long.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")))
    o = grouped_prefix(per, "g", "v", sums={"cum": F.col("c")})
    n = F.col("cum_total")
    k1, k2 = F.floor((n + 1) / 2), F.ceil((n + 1) / 2)
    lo = F.col("cum") - F.col("c")
    hit = lambda k: F.when((k > lo) & (k <= F.col("cum")), F.col("v")).otherwise(0.0)
    res = o.groupBy("g").agg(((F.sum(hit(k1)) + F.sum(hit(k2))) / 2.0).alias("m")).collect()
    got = {r["g"]: r["m"] for r in res}
    return {c: got.get(i) for i, c in enumerate(cols)}


def summary_stats(df: DataFrame, cols, digits: int = 3, exact: bool = True) -> DataFrame:
    """One row per column: mean, median, sd (n-1), min, max, rounded half to
    even. ``exact=False`` uses ``percentile_approx`` for the median (one
    pass over all columns)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"sd{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        if not exact:
            aggs.append(F.percentile_approx(x, 0.5, 100000).cast("double").alias(f"med{i}"))
    if exact:
        # one scalar per column, brought back as a literal (no cross join)
        meds = exact_medians(df, cols)
        aggs += [F.lit(meds[c]).cast("double").alias(f"med{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"),
                     *[F.bround(F.col(f"{s}{i}"), digits).alias(o) for s, o in
                       [("mean", "mean"), ("med", "median"), ("sd", "sd"), ("min", "min"), ("max", "max")]])
            for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def corr_long(df: DataFrame, cols, digits: int = 2, strict: bool = True) -> DataFrame:
    """Pearson correlation of every ordered pair (var1, var2, r), rounded
    half to even; ``strict``: a missing value in either column gives null.
    One aggregation: the upper triangle plus one non-null count per column;
    the lower triangle mirrors it."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(c).alias(f"_nn{i}") for i, c in enumerate(cols)]
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            aggs.append(F.corr(F.col(a).cast("double"), F.col(cols[j]).cast("double")).alias(f"c_{i}_{j}"))
    one = df.agg(*aggs)

    def cell(i, j):
        i, j = min(i, j), max(i, j)
        r = F.col(f"c_{i}_{j}")
        if strict:
            r = F.when((F.col(f"_nn{i}") == F.col("_n")) & (F.col(f"_nn{j}") == F.col("_n")), r)
        return F.bround(r, digits)
    rows = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), cell(i, j).alias("r"))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def strong_corr(corr: DataFrame, cut: float = 0.5) -> DataFrame:
    """Pairs of different variables with |r| > cut, with sign flags."""
    r = F.col("r")
    return (corr.filter((F.col("var1") != F.col("var2")) & (F.abs(r) > cut))
                .withColumn("positive", (r > 0).cast("int"))
                .withColumn("negative", (r < 0).cast("int")))


def entity_means(df: DataFrame, key: str, cols, strict: bool = True, names=None) -> DataFrame:
    names = names or [f"mean_{c}" for c in cols]
    fn = (lambda c: strict_agg(F.avg, c)) if strict else (lambda c: F.avg(c))
    return df.groupBy(key).agg(*[fn(c).alias(n) for c, n in zip(cols, names)])


def grid_density(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Counts and shares per square cell of width ``cell`` (cell index =
    floor(coordinate / cell)); rows with a missing coordinate are left out
    of the grid, and of the share's denominator."""
    pts = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) \
            .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    g = pts.groupBy(F.floor(F.col("x") / cell).alias("cell_x"),
                    F.floor(F.col("y") / cell).alias("cell_y")).agg(F.count(F.lit(1)).alias("n"))
    total = pts.count()   # scalar action; avoids a one-partition window over the cells
    return g.withColumn("share", F.col("n") / F.lit(float(total)) if total else F.lit(None).cast("double"))


def grid_density_smoothed(df: DataFrame, x: str, y: str, cell: float, radius: int = 2,
                          bandwidth: float = 1.0) -> DataFrame:
    """Cell counts smoothed with a 2-D Gaussian kernel over neighbour cells
    within ``radius`` cells (bandwidth in cells). Each occupied cell sends its
    count to the (2 radius + 1)^2 cells around it (an explode of a literal
    offset list, no join); density = weighted count / (points x total
    weight), so densities sum to 1."""
    import math
    offs = [(dx, dy, math.exp(-(dx * dx + dy * dy) / (2.0 * bandwidth * bandwidth)))
            for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)]
    wsum = sum(w for _, _, w in offs)
    g = grid_density(df, x, y, cell).select("cell_x", "cell_y", "n")
    total = g.agg(F.sum("n")).first()[0] or 0
    o = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w"))
                            for dx, dy, w in offs])).alias("o")
    sm = (g.select("cell_x", "cell_y", "n", o)
           .groupBy((F.col("cell_x") + F.col("o.dx")).alias("cell_x"), (F.col("cell_y") + F.col("o.dy")).alias("cell_y"))
           .agg(F.sum(F.col("n") * F.col("o.w")).alias("weighted")))
    return sm.withColumn("density", F.col("weighted") / F.lit(float(total * wsum)) if total
                         else F.lit(None).cast("double"))


def geo_points(df: DataFrame, x: str, y: str, cat: str) -> DataFrame:
    return df.select(x, y, cat).dropna(subset=[x, y])


def class_balance(df: DataFrame, label: str) -> DataFrame:
    from pyspark.sql import Window
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def overall_mean(df: DataFrame, col: str, name: str = "mean") -> DataFrame:
    return df.agg(F.avg(F.col(col)).alias(name))


def crosstab(df: DataFrame, pred: str, obs: str) -> DataFrame:
    return df.groupBy(pred, obs).agg(F.count(F.lit(1)).alias("n"))
