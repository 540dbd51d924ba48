"""Projections, recoding and null semantics (one Project after Catalyst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallystack.functions import text as T


def _string_cols(df: DataFrame, cols=None):
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return [c for c in names if cols is None or c in cols]


def strip_first(df: DataFrame, cols, tokens=("u'", "'", "'")) -> DataFrame:
    """Remove the first occurrence of each token in turn (default: ``u'``,
    then ``'`` twice), as three single substitutions."""
    return df.withColumns({c: T.strip_first_seq(c, tokens) for c in cols})


def strip_all(df: DataFrame, cols, token: str = '"') -> DataFrame:
    return df.withColumns({c: T.strip_all(c, token) for c in cols})


def add_open_hours(df: DataFrame, mapping: dict) -> DataFrame:
    """``{new_col: text_col}``: hours open per day from 'H:M-H:M' text.
    The text is parsed once per column into start/end minutes (a separate
    projection, so the parse is not repeated in every branch)."""
    mins = {}
    for new, src in mapping.items():
        s, e = T.open_minutes(src)
        mins[f"_s_{new}"], mins[f"_e_{new}"] = s, e
    out = df.withColumns(mins)
    out = out.withColumns({new: T.hours_between(f"_s_{new}", f"_e_{new}") for new in mapping})
    return out.drop(*mins)


def null_text_to_null(df: DataFrame, marker: str = "NULL", cols=None) -> DataFrame:
    """Text marker -> null on string columns only (never compares numbers
    with text, which ANSI mode rejects)."""
    return df.withColumns({c: T.null_if_text(c, marker) for c in _string_cols(df, cols)})


def fill_const(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def row_sum(df: DataFrame, cols, name: str, na_rm: bool = True) -> DataFrame:
    """Row-wise sum; with ``na_rm`` a missing cell counts as 0."""
    terms = [F.coalesce(F.col(c), F.lit(0)) if na_rm else F.col(c) for c in cols]
    return df.withColumn(name, reduce(lambda a, b: a + b, terms))


def add_sum(df: DataFrame, cols, name: str) -> DataFrame:
    """Arithmetic sum column; a missing input makes the result missing."""
    return row_sum(df, cols, name, na_rm=False)


def drop_cols(df: DataFrame, cols) -> DataFrame:
    return df.drop(*cols)


def select_cols(df: DataFrame, cols) -> DataFrame:
    return df.select(*cols)


def rename_cols(df: DataFrame, mapping: dict) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def drop_index_col(df: DataFrame, name_or_pos=0) -> DataFrame:
    """Drop an exported row-index column by name or by position."""
    name = df.columns[name_or_pos] if isinstance(name_or_pos, int) else name_or_pos
    return df.drop(name)


def recode(df: DataFrame, col: str, mapping: dict) -> DataFrame:
    """Replace listed values; other values (and nulls) stay."""
    expr = F.col(col)
    out = None
    for a, b in mapping.items():
        out = (F.when(expr == F.lit(a), F.lit(b)) if out is None
               else out.when(expr == F.lit(a), F.lit(b)))
    return df.withColumn(col, out.otherwise(expr) if out is not None else expr)


def collapse_levels(df: DataFrame, col: str, keywords, other: str = "Others",
                    name: str | None = None) -> DataFrame:
    """First keyword (in list order) contained in the text, else ``other``.
    Null stays null."""
    c = F.col(col)
    expr = None
    for k in keywords:
        cond = c.contains(F.lit(k))
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    expr = F.when(c.isNull(), F.lit(None)).otherwise(expr.otherwise(F.lit(other)))
    return df.withColumn(name or col, expr)


def to_number(df: DataFrame, cols) -> DataFrame:
    """Text -> double; text that is not a number becomes null (ANSI-safe)."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in cols})


def bool_to_num(df: DataFrame, cols, true_text: str = "TRUE") -> DataFrame:
    """'TRUE' -> 1, any other text -> 0, null stays null."""
    return df.withColumns({
        c: F.when(F.col(c).isNull(), F.lit(None).cast("int"))
            .when(F.col(c) == F.lit(true_text), F.lit(1)).otherwise(F.lit(0))
        for c in cols})


def gate_by_flag(df: DataFrame, flag: str, cols) -> DataFrame:
    """Measure -> 0 where flag is 0; missing flag gives missing."""
    f = F.col(flag)
    return df.withColumns({
        c: F.when(f.isNull(), F.lit(None)).when(f == 0, F.lit(0).cast(df.schema[c].dataType))
            .otherwise(F.col(c))
        for c in cols})


def label_text(df: DataFrame, col: str, name: str, pos: str = "ch_in",
               neg: str = "Noch_in") -> DataFrame:
    """``>= 1`` -> pos, ``== 0`` -> neg, anything else -> null."""
    c = F.col(col)
    return df.withColumn(name, F.when(c >= 1, F.lit(pos)).when(c == 0, F.lit(neg)))


def label_num(df: DataFrame, col: str, name: str, pos=1) -> DataFrame:
    """1 where ``col == pos``, else 0; null stays null."""
    c = F.col(col)
    return df.withColumn(name, F.when(c.isNull(), F.lit(None).cast("int"))
                         .when(c == F.lit(pos), F.lit(1)).otherwise(F.lit(0)))


def round_even(df: DataFrame, cols, digits: int) -> DataFrame:
    """Round half to even."""
    return df.withColumns({c: F.bround(F.col(c), digits) for c in cols})


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    """Keep rows equal to ``value`` (missing never matches)."""
    return df.filter(F.col(col) == F.lit(value))


def threshold_class(df: DataFrame, score: str, t, name: str, pos="ch_in", neg="Noch_in") -> DataFrame:
    """``score > t`` -> pos, ``score <= t`` -> neg. ``t`` may be a Column."""
    thr = t if not isinstance(t, (int, float)) else F.lit(float(t))
    s = F.col(score)
    return df.withColumn(name, F.when(s > thr, F.lit(pos)).when(s <= thr, F.lit(neg)))


def is_correct(df: DataFrame, pred: str, obs: str, name: str = "correct") -> DataFrame:
    return df.withColumn(name, F.col(pred) == F.col(obs))


# ---------------------------------------------------------------- factors

def levels_of(df: DataFrame, col: str, ref=None) -> DataFrame:
    """Level table (level, idx): distinct non-null values in ascending text
    order, or with ``ref`` moved to index 0 (relevel), ranked by the two-phase
    order: no window over all levels."""
    from tallystack.operators.ordered import ordered_prefix
    lv = df.select(F.col(col).alias("level")).where(F.col("level").isNotNull()).distinct()
    first = F.when(F.col("level") == F.lit(ref), 0).otherwise(1) if ref is not None else F.lit(1)
    o = ordered_prefix(lv.withColumn("_first", first), "_first", "level", descending=False, rank_col="_idx", total_col=None)
    return o.select("level", (F.col("_idx") - 1).cast("int").alias("idx"))


def level_list(df: DataFrame, col: str, ref=None):
    """Levels as a Python list, one per dummy column to build. Factors too
    wide for columns go to ``prep.assemble_vector`` (sparse vectors)."""
    rows = levels_of(df, col, ref).collect()
    return [r["level"] for r in sorted(rows, key=lambda r: r["idx"])]
