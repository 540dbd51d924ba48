"""Train/evaluation split, oversampling, dummy coding, min-max scaling and
the feature description used by the models."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallystack.functions.hashing import hash_uniform
from tallystack.operators.ordered import ordered_prefix
from tallystack.session import stored


@dataclass
class FeatureSpec:
    """Target and features: ``label`` (0/1 numeric), ``label_text`` (class
    names), numeric and categorical feature names."""
    label: str
    numeric: list = field(default_factory=list)
    categorical: list = field(default_factory=list)
    label_text: str | None = None

    @classmethod
    def from_names(cls, names, categorical=(), n_targets: int = 2):
        """First ``n_targets`` names are the text and numeric target (as in
        the reference's variable list); the rest are features."""
        text, num = (names[0], names[1]) if n_targets == 2 else (None, names[0])
        feats = list(names[n_targets:])
        cat = [f for f in feats if f in set(categorical)]
        return cls(label=num, label_text=text, numeric=[f for f in feats if f not in cat],
                   categorical=cat)

    @property
    def features(self):
        return list(self.numeric) + list(self.categorical)


def shuffle_split(df: DataFrame, key: str, frac: float = 0.75, seed: int = 66,
                  exact: bool = True, name: str = "split") -> DataFrame:
    """Random permutation by md5(seed:key); the first floor(frac * n) rows
    are 'train', the rest 'eval'. ``exact=False`` cuts by the hash value
    instead (u < frac: no ordering pass, size only approximately frac)."""
    u = hash_uniform(seed, key)
    if not exact:
        return df.withColumn(name, F.when(u < frac, "train").otherwise("eval"))
    o = ordered_prefix(df.withColumn("_u", u), "_u", key, descending=False, rank_col="_r",
                       total_col="_n")
    return (o.withColumn(name, F.when(F.col("_r") <= F.floor(F.col("_n") * frac), "train")
                         .otherwise("eval")).drop("_u", "_r", "_n"))


def cut_split(df: DataFrame, key: str, frac: float = 0.75, seed: int = 66, name: str = "split", buckets: int = 1 << 16) -> DataFrame:
    """The exact ``shuffle_split`` without ordering the table, which is written
    once: counts per bucket of the hash tell in which bucket the cut falls, and
    only the rows of that bucket are ordered, on the driver (n / ``buckets``
    of them, repeated keys as one). When equal rows lie on both sides of the
    cut, the table is ordered as ``shuffle_split`` does."""
    t = stored(df.withColumn("_u", hash_uniform(seed, key)), "split")
    bucket = F.floor(F.col("_u") * buckets)
    counts = sorted(t.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["b"])
    left = math.floor(sum(r["n"] for r in counts) * frac)
    below, last = 0.0, None             # rows under ``below`` and those up to ``last`` train
    for r in counts:
        if left >= r["n"]:
            left, below = left - r["n"], (r["b"] + 1) / buckets
            continue
        for g in t.where(bucket == r["b"]).groupBy("_u", key).agg(F.count(F.lit(1)).alias("n")).orderBy("_u", F.col(key).asc_nulls_last()).collect():
            if left < g["n"]:
                break
            left, last = left - g["n"], g
        if left:
            return shuffle_split(t.drop("_u"), key, frac, seed, True, name)
        break
    train = F.col("_u") < below
    if last:
        equal = F.col(key) <= last[key] if last[key] is not None else F.lit(True)
        train = (F.col("_u") < last["_u"]) | (F.col("_u") == last["_u"]) & equal
    return t.withColumn(name, F.when(train, "train").otherwise("eval")).drop("_u")


def oversample(df: DataFrame, label: str, key: str, seed: int = 1, copy_col: str = "copy") -> DataFrame:
    """Every class is brought up to the size M of the largest class: a class
    of m rows keeps its originals (copy 0), adds floor(M/m) - 1 full copies,
    and the M mod m rows first in md5(seed:key) order once more.
    Deterministic, all originals kept."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_m"))
    cls = counts.orderBy(label).collect()           # one row per class
    M = max(r["_m"] for r in cls)
    idx = {r[label]: i for i, r in enumerate(cls)}
    info = df.sparkSession.createDataFrame(
        [(r[label], i, r["_m"], M // r["_m"], M % r["_m"]) for i, r in enumerate(cls)],
        StructType(df.select(label).schema.fields + [
            StructField("_ci", IntegerType()), StructField("_m", LongType()),
            StructField("_q", LongType()), StructField("_rem", LongType())]))
    j = df.join(F.broadcast(info), [label])
    # order inside each class by hash: one numeric score = class index + u
    sc = F.col("_ci").cast("double") + hash_uniform(seed, key)
    o = ordered_prefix(j.withColumn("_sc", sc), "_sc", key, descending=False,
                       rank_col="_gr", total_col=None)
    starts = {r[label]: 0 for r in cls}
    acc = 0
    for r in cls:
        starts[r[label]] = acc
        acc += r["_m"]
    start_expr = F.create_map(*[x for k, v in starts.items() for x in (F.lit(k), F.lit(v))])
    o = o.withColumn("_wr", F.col("_gr") - start_expr[F.col(label)])
    n_copies = F.col("_q") + F.when(F.col("_wr") <= F.col("_rem"), 1).otherwise(0)
    out = o.withColumn(copy_col, F.explode(F.sequence(F.lit(0), (n_copies - 1).cast("int"))))
    return out.drop("_ci", "_m", "_q", "_rem", "_sc", "_gr", "_wr")


def dummy_code(df: DataFrame, col: str, levels, drop_base: bool = False, sep: str = "_",
               keep_source: bool = False) -> DataFrame:
    """One 0/1 column ``col<sep>level`` per level (level list from
    ``clean.level_list``; its first entry is the base level). A missing value
    gives missing in every dummy."""
    lv = levels[1:] if drop_base else levels
    c = F.col(col)
    cols = {f"{col}{sep}{v}": F.when(c.isNull(), F.lit(None).cast("int"))
            .when(c == F.lit(v), 1).otherwise(0) for v in lv}
    out = df.withColumns(cols)
    return out if keep_source else out.drop(col)


def minmax_fit(df: DataFrame, cols) -> dict:
    """{col: (min, max)} from one aggregation; 2 numbers per column."""
    row = df.agg(*[x for c in cols for x in (F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}"))]).first()
    return {c: (row[f"mn_{c}"], row[f"mx_{c}"]) for c in cols}


def minmax_apply(df: DataFrame, ranges: dict) -> DataFrame:
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(lo), F.lit(hi) - F.lit(lo))
                           for c, (lo, hi) in ranges.items()})


def minmax(train: DataFrame, evaluate: DataFrame, cols, fit_on: str = "train"):
    """(x - min) / (max - min). ``fit_on='train'`` scales both tables with
    the training range; ``'each'`` scales each with its own range (what the
    reference does)."""
    r_train = minmax_fit(train, cols)
    r_eval = r_train if fit_on == "train" else minmax_fit(evaluate, cols)
    return minmax_apply(train, r_train), minmax_apply(evaluate, r_eval)


def assemble_vector(df: DataFrame, spec: FeatureSpec, output: str = "features",
                    drop_base: bool = True):
    """Fit indexers + one-hot encoders + assembler; returns the fitted
    ``PipelineModel`` (a sparse feature vector column ``output``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    stages, vec_cols = [], list(spec.numeric)
    for c in spec.categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__vec", dropLast=drop_base))
        vec_cols.append(f"{c}__vec")
    stages.append(VectorAssembler(inputCols=vec_cols, outputCol=output, handleInvalid="keep"))
    return Pipeline(stages=stages).fit(df)
