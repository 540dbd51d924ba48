"""The reference's own inputs and steps, composed from the operators.

For users who hold the reference's CSV extracts: explicit schemas for the
ten inputs, the business clean-up, the preparation of the daily and
sentiment tables, and the assembly of the business x day fact table with
reach, rolling reach, sentiment shares and calendar features. These read
files that are not part of the test data, so they are library functions,
not registered queries; every step is one of the tested operators.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystack.functions import calendar as C
from tallystack.functions import units as U
from tallystack.operators import clean, features, relate
from tallystack.sources.io import read_table

# The weekday prefixes of the opening-hours columns as named in
# the input (Thursday is "thr"), and the names of the derived columns.
HOUR_TEXT_DAYS = ("mon", "tue", "wed", "thr", "fri", "sat", "sun")
HOUR_COLS = ("open_hours_mon", "open_hours_tue", "open_hours_wed", "open_hours_thu",
             "open_hours_fri", "open_hours_sat", "open_hours_sun")
BOOL_TEXT_COLS = ("free_wifi", "has_tv", "caters", "for_kids", "outdoor_seating", "has_parking",
                  "has_takeout", "takes_reservations", "good_for_groups", "credit_card_acceptance")

SCHEMAS = {
    "business": ", ".join(
        ["business_id string"] + [f"{d}_open_hours string" for d in HOUR_TEXT_DAYS] +
        ["alcohol string", "noise_level string"] + [f"{c} string" for c in BOOL_TEXT_COLS] +
        ["price_range string", "categories string", "longitude double", "latitude double",
         "stars double", "review_count long"]),
    "daily_checkins": "business_id string, date_tip date, ch_in int, cum_n_tips long, "
                      "cum_max_u_elite string, cum_max_us_tip string",
    "audience_avg": "business_id string, avg_n_friends_bus double, avg_n_fans_bus double",
    "reached_fans": "business_id string, date date, n_reached_fans double",
    "reached_friends": "business_id string, date date, n_reached_friends double",
    "review_sentiment": "idx long, business_id string, date date, text string, label string, score double",
    "tip_sentiment": "idx long, business_id string, date date, text string, label string, score double",
    "photos": "business_id string, n_photo long",
    "review_stats": "business_id string, avg_stars_us double, n_reviews_us long, usefull long, "
                    "funny long, cool long",
    "weather": "date string, temp_avg double, precipitation double",
}


def read_inputs(spark: SparkSession, folder: str, names=None) -> dict:
    """{name: DataFrame} from ``<folder>/<name>.csv`` with the schemas above."""
    names = names or list(SCHEMAS)
    return {n: read_table(spark, os.path.join(folder, f"{n}.csv"), SCHEMAS[n], "csv") for n in names}


def clean_business(df: DataFrame) -> DataFrame:
    """Quote clean-up, hours open per weekday (missing -> 0) and per week,
    text NULL -> missing, category recode; the hour texts are dropped."""
    b = clean.strip_first(df, ["alcohol", "noise_level"])
    texts = [f"{d}_open_hours" for d in HOUR_TEXT_DAYS]
    b = clean.strip_all(b, texts)
    b = clean.add_open_hours(b, dict(zip(HOUR_COLS, texts)))
    b = clean.null_text_to_null(b)
    b = clean.fill_const(b, {h: 0.0 for h in HOUR_COLS})
    b = clean.row_sum(b, HOUR_COLS, "open_hours_week")
    b = clean.drop_cols(b, texts)
    return clean.recode(b, "categories", {"Latin American": "Latin_American"})


def prepare_checkins(df: DataFrame) -> DataFrame:
    """Text NULL -> missing -> number -> 0 for the two running maxima."""
    c = clean.null_text_to_null(df, cols=["cum_max_u_elite", "cum_max_us_tip"])
    c = clean.to_number(c, ["cum_max_u_elite", "cum_max_us_tip"])
    return clean.fill_const(c, {"cum_max_u_elite": 0.0, "cum_max_us_tip": 0.0})


def prepare_sentiment(df: DataFrame, prefix: str) -> DataFrame:
    """Drop the exported index, rename text / label / score with a prefix
    ('review' or 'tips')."""
    s = clean.drop_index_col(df, 0)
    return clean.rename_cols(s, {"text": f"{prefix}_text", "label": f"{prefix}_sent_label",
                                 "score": f"{prefix}_sent_score"})


def prepare_weather(df: DataFrame, fahrenheit: bool = False) -> DataFrame:
    """Date text with '/' or '-' -> date; optional unit conversion."""
    w = df.select(C.to_date_safe("date").alias("date"), "temp_avg", "precipitation")
    if fahrenheit:
        w = w.withColumns({"temp_avg": U.f_to_c("temp_avg"), "precipitation": U.in_to_mm("precipitation")})
    return w


def assemble_facts(business: DataFrame, inputs: dict, parity: bool = False,
                   day_table_max_rows: int = 100_000) -> DataFrame:
    """Business x day fact table: weather into check-ins (inner), business
    with photos and review statistics (left), check-ins (inner), reached
    fans / friends and review / tip sentiment on (business, day) (left),
    audience means (left); gate by check-in, reach, 15-row rolling reach,
    fills, sentiment shares per business, weekend and quarter.

    Default: reach and sentiment tables are aggregated to one row per
    (business, day) before joining, so no row multiplies (reach: sums;
    sentiment: label counts). ``parity=True`` joins them as they come and
    de-duplicates full rows, as the reference does."""
    key, day = "business_id", "date"
    chk = prepare_checkins(inputs["daily_checkins"]).withColumnRenamed("date_tip", day)
    chk = relate.join_on(chk, prepare_weather(inputs["weather"]), [day], "inner",
                         broadcast_max_rows=day_table_max_rows)
    fans = inputs["reached_fans"]
    friends = inputs["reached_friends"]
    rev = prepare_sentiment(inputs["review_sentiment"], "review")
    tip = prepare_sentiment(inputs["tip_sentiment"], "tips")
    if not parity:
        fans = fans.groupBy(key, day).agg(F.sum("n_reached_fans").alias("n_reached_fans"))
        friends = friends.groupBy(key, day).agg(F.sum("n_reached_friends").alias("n_reached_friends"))
        rev = rev.groupBy(key, day).agg(
            F.count_if(F.col("review_sent_label") == "POSITIVE").alias("n_pos_review_day"),
            F.count_if(F.col("review_sent_label") == "NEGATIVE").alias("n_neg_review_day"))
        tip = tip.groupBy(key, day).agg(
            F.count_if(F.col("tips_sent_label") == "POSITIVE").alias("n_pos_tip_day"),
            F.count_if(F.col("tips_sent_label") == "NEGATIVE").alias("n_neg_tip_day"))
    facts = relate.assemble(business, key, chk, day,
                            dim_left=[inputs["photos"], inputs["review_stats"]],
                            daily_left=[fans, friends, rev, tip],
                            entity_left=[inputs["audience_avg"]], parity=parity)
    facts = clean.gate_by_flag(facts, "ch_in", ["avg_n_friends_bus", "avg_n_fans_bus"])
    facts = clean.fill_const(facts, {"n_reached_fans": 0.0, "n_reached_friends": 0.0, "n_photo": 0})
    facts = clean.add_sum(facts, ["n_reached_fans", "n_reached_friends", "avg_n_fans_bus",
                                  "avg_n_friends_bus"], "reach")
    facts = features.rolling_rows(facts, key, day, "reach", 14, True, "rolling_reach_sum")
    if parity:
        share = features.sentiment_share(facts, key, "review_sent_label", "tips_sent_label")
    else:
        c = facts.groupBy(key).agg(*[F.sum(c).alias(c) for c in
                                     ("n_pos_review_day", "n_neg_review_day", "n_pos_tip_day", "n_neg_tip_day")])
        p = F.coalesce(F.col("n_pos_review_day"), F.lit(0)) + F.coalesce(F.col("n_pos_tip_day"), F.lit(0))
        n = F.coalesce(F.col("n_neg_review_day"), F.lit(0)) + F.coalesce(F.col("n_neg_tip_day"), F.lit(0))
        share = c.filter(p + n > 0).select(
            key, F.bround(F.try_divide(p, p + n), 2).alias("share_positive_feedback"),
            F.bround(F.try_divide(n, p + n), 2).alias("share_negative_feedback"))
    facts = relate.join_on(facts, share, [key], "left")
    facts = features.add_calendar(facts, day)
    return clean.fill_const(facts, {"share_positive_feedback": 0.0, "share_negative_feedback": 0.0})


# The modelling variables in the reference's order (target
# text, target number, then the features). "stars.x" there is the business
# rating, here the column "stars".
MODEL_VARS = ("ch_in_string", "ch_in", "stars", "review_count", "free_wifi", "has_tv", "caters",
              "alcohol", "noise_level", "for_kids", "outdoor_seating", "has_parking", "price_range",
              "takes_reservations", "good_for_groups", "categories", "open_hours_mon", "open_hours_tue",
              "open_hours_wed", "open_hours_thu", "open_hours_fri", "open_hours_sat", "open_hours_sun",
              "open_hours_week", "n_photo", "avg_stars_us", "n_reviews_us", "usefull", "funny", "cool",
              "cum_n_tips", "cum_max_u_elite", "cum_max_us_tip", "temp_avg", "precipitation",
              "stars_review", "rolling_reach_sum", "WE", "Quarter", "share_positive_feedback",
              "share_negative_feedback")
CATEGORICAL_VARS = ("free_wifi", "has_tv", "caters", "alcohol", "noise_level", "for_kids", "outdoor_seating",
                    "has_parking", "price_range", "takes_reservations", "good_for_groups", "categories",
                    "WE", "Quarter")


def training_tables(facts: DataFrame, key: str = "id", frac: float = 0.75, seed: int = 66, optional=("stars_review",)):
    """Label text ('ch_in' for >= 1 check-ins, 'Noch_in' for 0), a row key,
    the exact 75 / 25 hash split, the feature description (a missing variable
    is an error unless it is named in ``optional``; categorical ones as text) and the threshold = share of
    check-ins in the training table. Returns (train, evaluate, spec,
    threshold)."""
    from tallystack.operators import prep
    t = clean.label_text(facts, "ch_in", "ch_in_string")
    t = t.withColumn("ch_in", F.when(F.col("ch_in") >= 1, 1).when(F.col("ch_in") == 0, 0))
    if key not in t.columns:
        t = t.withColumn(key, F.xxhash64("business_id", F.col("date").cast("string")))
    missing = [v for v in MODEL_VARS if v not in t.columns and v not in optional]
    if missing:
        raise ValueError(f"model variables missing from the facts: {missing}")
    present = [v for v in MODEL_VARS if v in t.columns]
    cat = [v for v in CATEGORICAL_VARS if v in present]
    t = t.withColumns({c: F.col(c).cast("string") for c in cat})
    spec = prep.FeatureSpec.from_names(present, categorical=cat)
    s = prep.shuffle_split(t.select(key, *present), key, frac, seed)
    train, ev = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "eval")
    thr = train.agg(F.avg("ch_in")).first()[0]
    return train, ev, spec, thr


def impute_business(business: DataFrame, m: int = 5, max_iter: int = 50, seed: int = 500,
                    keep: int = 2, key: str = "business_id") -> DataFrame:
    """Multiple imputation of the cleaned business table as in the
    reference: every other column explains ``price_range`` (the id excluded),
    columns without predictors get marginal draws; m completed tables, the
    ``keep``-th is returned."""
    from tallystack.operators import impute
    others = [c for c in business.columns if c not in (key, "price_range")]
    cat = [c for c, t in business.dtypes if t == "string" and c != key]
    done = impute.impute_chained(business, {"price_range": others}, key, m=m, max_iter=max_iter,
                                 seed=seed, categorical=cat)
    return impute.complete_k(done, keep)
