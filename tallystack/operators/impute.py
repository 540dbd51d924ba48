"""Multiple imputation: m completed versions of a table in one DataFrame
(column ``imp`` = 1..m). Random draws are md5-based uniforms of
(seed, imp, sweep, key), so they repeat on any partitioning."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystack.functions.hashing import hash_uniform


def _replicate(df: DataFrame, m: int) -> DataFrame:
    return df.withColumn("imp", F.explode(F.sequence(F.lit(1), F.lit(m))))


MAX_LEVELS = 256
#: completed rows a task of the chained sweeps holds
TASK_ROWS = 250_000


def _levels(df: DataFrame, col: str):
    """(values, cumulative counts) of the observed values in ascending order,
    or None when there are more than ``MAX_LEVELS`` of them."""
    freq = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rows = freq.orderBy("value").limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        return None
    return [r["value"] for r in rows], list(itertools.accumulate(r["n"] for r in rows))


def ranked_values(df: DataFrame, col: str, ties) -> DataFrame:
    """(rank, value, n): the observed values by ascending rank from 1, each
    rank once, and their number."""
    from tallystack.operators.ordered import ordered_prefix
    observed = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value"), *ties)
    return ordered_prefix(observed, "value", list(ties), descending=False, rank_col="rank", total_col="n").select("rank", "value", "n")


def _bisect(at: str, upto, first: int = 0) -> str:
    """Balanced CASE expression: the place of the first cumulative count above ``at``."""
    if len(upto) == 1:
        return str(first)
    mid = len(upto) // 2
    return f"CASE WHEN {at} < {upto[mid - 1]} THEN {_bisect(at, upto[:mid], first)} ELSE {_bisect(at, upto[mid:], first + mid)} END"


def _literal_array(values, kind):
    """The values as one literal; JSON where it keeps them exactly."""
    if kind.typeName() in ("string", "integer", "long", "short", "byte"):
        return F.from_json(F.lit(json.dumps(values)), T.ArrayType(kind))
    return F.array(*[F.lit(v).cast(kind) for v in values])


def impute_marginal(df: DataFrame, cols, key: str, m: int = 5, seed: int = 500,
                    replicate: bool = True) -> DataFrame:
    """Targets without predictors: each missing cell takes the observed value
    of rank floor(u n) + 1 in ascending order, u uniform by hash of (seed,
    copy, column, key). Observed cells never change. Returns m copies (column
    ``imp``).

    Up to ``MAX_LEVELS`` different values are searched by a decision tree over
    their cumulative counts inside the projection; more are fetched by an equi-join
    of the missing cells alone on the drawn rank, which one row holds. Both
    give the same values. A column without any observed value stays null."""
    out = _replicate(df, m) if replicate else df
    for c in cols:
        names, found = out.columns, _levels(df, c)
        kind = df.schema[c].dataType
        u = hash_uniform(seed, F.col("imp"), F.lit(c), key)
        if found is not None:
            values, upto = found
            if not values:
                continue
            out = out.withColumn("_at", F.when(F.col(c).isNull(), F.floor(u * upto[-1])))
            draw = _literal_array(values, kind)[F.expr(_bisect("_at", upto))]
            out = out.withColumn(c, F.when(F.col(c).isNull(), draw).otherwise(F.col(c))).select(*names)
            continue
        table = ranked_values(df, c, [key])
        n = table.agg(F.max("n")).first()[0]
        missing = out.where(F.col(c).isNull())
        drawn = missing.withColumn("_rank", F.floor(u * n) + 1).drop(c).join(
            table.select(F.col("rank").alias("_rank"), F.col("value").cast(kind).alias(c)), "_rank")
        out = out.where(F.col(c).isNotNull()).unionByName(drawn.select(*names))
    return out


def complete_k(df: DataFrame, k: int) -> DataFrame:
    """The k-th completed table."""
    return df.filter(F.col("imp") == k).drop("imp")


def pmm_draw(scored: DataFrame, target: str, pred: str, missing: str, key: str, seed, donors: int = 5):
    """Predictive mean matching inside each imputation ``imp``: a missing
    cell takes the observed value of one of the ``donors`` observed rows
    whose predictions are closest to its own (hash draw among them).

    The nearest donors in one dimension are found without pairs: the
    two-phase global order of (imp, prediction, key) gives each row the
    number of observed rows before it; a missing row's candidates are the
    ``donors`` observed ranks on either side, fetched with an equi-join on
    (imp, observed rank)."""
    return scored.join(_pmm_chosen(scored, target, pred, missing, key, seed, donors), ["imp", key], "left")


def _pmm_chosen(scored: DataFrame, target: str, pred: str, missing: str, key: str, seed, donors: int):
    """(imp, key, _draw) of the missing cells of ``pmm_draw``."""
    from pyspark.sql import Window
    from tallystack.operators.ordered import ordered_prefix
    obs = ~F.col(missing)
    o = ordered_prefix(scored.withColumn("_impd", F.col("imp").cast("double")), "_impd", [pred, key],
                       descending=False, sums={"_cobs": obs.cast("long")}, rank_col="_r", total_col=None)
    n_obs = scored.filter(obs).groupBy("imp").count().agg(F.max("count")).first()[0] or 0
    # observed rows in earlier imputations (every imputation has the same observed rows)
    o = o.withColumn("_orank", F.col("_cobs") - (F.col("imp") - 1) * F.lit(n_obs))
    donors_tab = o.filter(obs).select("imp", F.col("_orank").alias("_drank"),
                                      F.col(pred).alias("_dpred"), F.col(target).alias("_dval"),
                                      F.col(key).alias("_dkey"))
    lo = F.greatest(F.col("_orank") - (donors - 1), F.lit(1))
    hi = F.least(F.col("_orank") + donors, F.lit(n_obs))
    miss = (o.filter(F.col(missing)).select("imp", key, pred, "_orank")
             .withColumn("_drank", F.explode(F.sequence(lo, F.greatest(hi, lo)))))
    c = miss.join(donors_tab, ["imp", "_drank"]).withColumn("_dist", F.abs(F.col(pred) - F.col("_dpred")))
    w = Window.partitionBy("imp", key).orderBy("_dist", "_dkey")
    c = c.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= donors)
    pick = (F.floor(hash_uniform(seed, F.col("imp"), F.lit(target), key) *
                    F.least(F.lit(donors), F.count(F.lit(1)).over(Window.partitionBy("imp", key)))) + 1)
    return c.withColumn("_pick", pick).filter(F.col("_k") == F.col("_pick")) \
            .select("imp", key, F.col("_dval").alias("_draw"))


def _encoded(own: DataFrame, preds, cat_cols):
    """Feature stages of the predictors: one-hot for categories."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    stages, vcols = [], []
    for p in preds:
        if p in cat_cols:
            stages += [StringIndexer(inputCol=p, outputCol=f"_{p}_i", handleInvalid="keep", stringOrderType="alphabetAsc"),
                       OneHotEncoder(inputCol=f"_{p}_i", outputCol=f"_{p}_v")]
            vcols.append(f"_{p}_v")
        else:
            vcols.append(p)
    return [*stages, VectorAssembler(inputCols=vcols, outputCol="_x", handleInvalid="keep")]


def _class_sweep(own: DataFrame, t: str, preds, cat_cols, missing: str, u, keep) -> DataFrame:
    """One copy: multinomial logit of the category ``t`` fitted on the rows
    where it was observed, and a draw ``_draw`` from its probabilities."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import vector_to_array
    observed = own.filter(~F.col(missing))
    stages = [StringIndexer(inputCol=t, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep"), *_encoded(own, preds, cat_cols),
              LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", regParam=1e-4, maxIter=50)]
    model = Pipeline(stages=stages).fit(observed)
    labels = model.stages[0].labels
    pr = vector_to_array(F.col("probability"))
    # first class whose cumulative probability exceeds u
    acc, choice = F.lit(0.0), None
    for i, lab in enumerate(labels[:-1]):
        acc = acc + pr[i]
        choice = F.when(F.col("_u") < acc, F.lit(lab)) if choice is None else choice.when(F.col("_u") < acc, F.lit(lab))
    choice = F.lit(labels[-1]) if choice is None else choice.otherwise(F.lit(labels[-1]))
    return model.transform(own).withColumn("_u", u).withColumn("_draw", choice).select(*keep, "_draw")


def _dot(x: str, beta: dict):
    """Intercept plus inner product with the coefficients of the row's copy."""
    out = None
    for imp, b in sorted(beta.items()):
        term = F.lit(float(b[0])) + F.aggregate(F.zip_with(F.col(x), F.array(*[F.lit(float(v)) for v in b[1:]]), lambda p, q: p * q),
                                                F.lit(0.0), lambda s, v: s + v)
        out = F.when(F.col("imp") == imp, term) if out is None else out.when(F.col("imp") == imp, term)
    return out


def _number_sweep(work: DataFrame, t: str, encoder, missing: str, key: str, seed, sweep: int, keep,
                  method: str, donors: int) -> DataFrame:
    """All copies at once: per copy one linear model of ``t`` from the cross
    products of its observed rows, its parameters drawn from their posterior.
    ``residual``: drawn prediction plus the copy's observed residual of rank
    floor(u n) + 1, an equi-join of the missing rows on (copy, rank);
    ``normal``: plus a normal draw with the drawn deviation; ``pmm``: matching
    on predictions (estimate for observed, drawn for missing rows)."""
    from pyspark.ml.functions import vector_to_array
    from tallystack.operators.models.gram import gramian, posterior_draw
    from tallystack.operators.ordered import grouped_prefix
    x = encoder.transform(work).withColumn("_a", vector_to_array("_x")).select(*keep, "_a")
    estimate, drawn, deviation = {}, {}, {}
    for imp, g in gramian(x.filter(~F.col(missing)), "_a", [t], group="imp").items():
        digest = hashlib.sha256(f"{seed}:{sweep}:{imp}:{t}".encode()).digest()
        estimate[imp], drawn[imp], deviation[imp] = posterior_draw(g, np.random.default_rng(list(digest)))
    if not estimate:
        return work
    kind = work.schema[t].dataType
    lost = x.filter(F.col(missing)).withColumn("_draw", _dot("_a", drawn)).drop("_a")
    seen = x.filter(~F.col(missing)).withColumn("_fit", _dot("_a", estimate)).drop("_a")
    u = hash_uniform(seed, F.col("imp"), F.lit(sweep), F.lit(t), key)
    if method == "pmm":
        scored = seen.withColumnRenamed("_fit", "_draw_mean").unionByName(lost.withColumnRenamed("_draw", "_draw_mean"))
        from tallystack.session import stored
        narrow = stored(scored.select("imp", key, t, "_draw_mean", missing), "pmm")        # the search needs no other column
        lost = lost.drop("_draw").join(_pmm_chosen(narrow, t, "_draw_mean", missing, key, f"{seed}:{sweep}", donors), ["imp", key], "left")
    elif method == "normal":
        v = hash_uniform(seed, F.col("imp"), F.lit(sweep), F.lit(t), key, F.lit("v"))
        z = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.lit(np.pi) * v)
        lost = lost.withColumn("_draw", F.col("_draw") + z * F.element_at(F.create_map(*[F.lit(k) for kv in deviation.items() for k in kv]), F.col("imp").cast("long")))
    else:
        ranked = grouped_prefix(seen.select("imp", (F.col(t) - F.col("_fit")).alias("_r"), key), "imp", "_r", [key])
        n = seen.groupBy("imp").agg(F.count(F.lit(1)).alias("_n"))          # one row per copy, without the order
        lost = (lost.join(F.broadcast(n), "imp").withColumn("_rank", F.floor(u * F.col("_n")) + 1)
                .join(ranked.select("imp", F.col("rank").alias("_rank"), "_r"), ["imp", "_rank"])
                .withColumn("_draw", F.col("_draw") + F.col("_r")))
    lost = lost.withColumn(t, F.col("_draw").cast(kind)).select(*keep)
    return seen.select(*keep).unionByName(lost)


def impute_chained(df: DataFrame, mask: dict, key: str, m: int = 5, max_iter: int = 5,
                   seed: int = 500, categorical=(), checkpoint_every: int = 1,
                   numeric_method: str = "residual", donors: int = 5) -> DataFrame:
    """Chained equations. ``mask`` = {target: [predictors]}; columns with
    missing cells that are not a target with predictors get marginal draws
    first. The m copies are chains of their own: each sweep refits every
    target per copy on its currently completed predictors, using rows where
    the target was observed, then redraws the originally missing cells.

    Categorical targets are drawn from multinomial logistic probabilities.
    Numeric targets use a linear model whose coefficients and deviation are
    drawn from their posterior, plus one of the observed residuals
    (``numeric_method='residual'``) or a normal draw (``'normal'``), or take
    the observed value of one of the ``donors`` rows with the closest
    predictions (``'pmm'``). Work is linear in rows: residuals and values are
    fetched by rank. Lineage is cut with reliable checkpoints before every
    target and every ``checkpoint_every`` sweeps; the last draw is left to the
    reader of the result (who reads it more than once stores it)."""
    from pyspark.ml import Pipeline
    from tallystack.session import checkpoint

    categorical = set(categorical)
    # predictors with a single value (or none) carry no information and
    # cannot be encoded: one min/max aggregation finds them
    preds_all = sorted({p for ps in mask.values() for p in ps})
    if preds_all:
        mm = df.agg(*[x for p in preds_all for x in (F.min(p).alias(f"mn_{p}"), F.max(p).alias(f"mx_{p}"))]).first()
        constant = {p for p in preds_all if mm[f"mn_{p}"] is None or mm[f"mn_{p}"] == mm[f"mx_{p}"]}
        mask = {t: [p for p in ps if p not in constant] for t, ps in mask.items()}
    targets = [t for t, p in mask.items() if p]
    cols_with_na = [c for c in df.columns if c != key]
    orig_missing = {t: f"_miss_{t}" for t in targets}
    work = df.withColumns({v: F.col(t).isNull() for t, v in orig_missing.items()})
    # start: every column completed by draws from its observed values
    cat_cols = [c for c in cols_with_na if c in categorical or dict(df.dtypes)[c] == "string"]
    counts = df.agg(F.count(F.lit(1)), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols_with_na]).first()
    tasks = -(-counts[0] * m // TASK_ROWS)
    if tasks > 1:                  # a small compressed file is read by few tasks: the copies are made by as many as they need
        work = work.repartition(tasks)
    work = impute_marginal(work, [c for c in cols_with_na if counts[c]], key, m, seed)
    # when no target explains another, the predictors never change again: every sweep
    # draws from the same models, and the last one is the result of all
    chained = any(p in targets for t in targets for p in mask[t])
    # the levels of a completed column are its observed ones: encoders are fitted once, on the table itself
    encoders = {t: Pipeline(stages=_encoded(df, mask[t], cat_cols)).fit(df) for t in targets if t not in cat_cols}
    for sweep in range(1, max_iter + 1) if chained else [max_iter]:
        for t in targets:
            work = checkpoint(work)
            keep = list(work.columns)
            if t not in cat_cols:
                work = _number_sweep(work, t, encoders[t], orig_missing[t], key, seed, sweep, keep, numeric_method, donors)
                continue
            u, parts = hash_uniform(seed, F.col("imp"), F.lit(sweep), F.lit(t), key), []
            for k in range(1, m + 1):                  # each copy is a chain with models of its own
                own = work.filter(F.col("imp") == k)
                parts.append(_class_sweep(own, t, mask[t], cat_cols, orig_missing[t], u, keep))
            scored = functools.reduce(lambda x, y: x.unionByName(y), parts)
            work = scored.withColumn(t, F.when(F.col(orig_missing[t]), F.col("_draw").cast(dict(df.dtypes)[t]))
                                     .otherwise(F.col(t))).select(*keep)
        if checkpoint_every and sweep % checkpoint_every == 0 and sweep < max_iter:
            work = checkpoint(work)
    return work.drop(*orig_missing.values())
