"""Rating prediction: user means, item neighbours, boosted trees on user and business features, and their blend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.functions.scalars import clamp
from orebody.plans.durable import durable
from orebody.sources.files import COMPLIMENTS

#: The rating of an unknown user, the power of the compliments, the parameters of the two models.
UNKNOWN, POWER = 3.5, 1.2
#: Rows of a table that is sent to all tasks, at most.
SENT = 1_000_000
NARROW = ["user_avg", "user_count", "business_avg", "business_count"]
WIDE_USER = ["average_stars", "review_count", "useful", "funny", "cool", "fans", "compliments", "elite_flag"]
WIDE_BUSINESS = ["business_stars", "business_reviews", "kids", "price"]
#: Parameters of the boosted trees: 4 features, 12 features, and the blend's own.
TREES = {"trees": 300, "depth": 17, "rate": 0.02, "least": 101, "l1": 0.2765, "l2": 9.927, "columns": 0.5, "share": 0.8, "seed": 2020}
WIDE_TREES = TREES | {"columns": 0.6}
BLEND_TREES = {"trees": 200, "depth": 15, "rate": 0.05, "least": 1, "l1": 10.0, "l2": 1.0, "columns": 0.3, "share": 1.0, "seed": 2020}


def sent(rows: DataFrame, tag: str) -> DataFrame:
    """rows, to be sent to all tasks if they are few; otherwise Spark deals both sides of a join."""
    rows = durable(rows, tag)
    return F.broadcast(rows) if rows.count() <= SENT else rows


def user_features(users: DataFrame) -> DataFrame:
    """user_id and the eight user features."""
    compliments = F.aggregate(F.array(*(F.pow(F.col(f"compliment_{c}").cast("double"), F.lit(POWER)) for c in COMPLIMENTS)), F.lit(0.0), lambda a, x: a + x)
    number = [F.col(c).cast("double").alias(c) for c in WIDE_USER[:6]]
    return users.select("user_id", *number, F.round(compliments, 6).alias("compliments"), F.when(F.length("elite") > 0, F.lit(1.0)).otherwise(0.0).alias("elite_flag"))


def business_features(business: DataFrame) -> DataFrame:
    """business_id and the four business features; what is missing or no number is 0."""
    kids = F.coalesce((F.col("attributes")["GoodForKids"] == "True").cast("double"), F.lit(0.0))
    price = F.coalesce(F.expr("try_cast(attributes['RestaurantsPriceRange2'] AS int)").cast("double"), F.lit(0.0))
    return business.select("business_id", F.col("stars").cast("double").alias("business_stars"), F.col("review_count").cast("double").alias("business_reviews"), kids.alias("kids"), price.alias("price"))


def features_inner(ratings: DataFrame, users: DataFrame, business: DataFrame) -> DataFrame:
    """ratings with the features of both sides; rows without a match are dropped."""
    return ratings.join(users, "user_id").join(business, "business_id")


def features_left(ratings: DataFrame, users: DataFrame, business: DataFrame) -> DataFrame:
    """ratings with the features of both sides; 0 where a side is unknown."""
    both = ratings.join(users, "user_id", "left").join(business, "business_id", "left")
    return both.fillna(0.0, [c for c in both.columns if c not in ratings.columns])


def predict_user_mean(train: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (user_id, business_id) with the user's mean in [1, 5]; unknown users get UNKNOWN."""
    means = train.groupBy("user_id").agg(F.avg("stars").alias("mean"))
    out = pairs.join(means, "user_id", "left")
    return out.select("user_id", "business_id", F.round(F.coalesce(clamp(F.col("mean"), 1.0, 5.0), F.lit(UNKNOWN)), 6).alias("prediction"))


def predict_item_based(train: DataFrame, pairs: DataFrame, neighbours: int = 15) -> DataFrame:
    """Item-based collaborative filtering.

    The weight of two items is the correlation, over their common raters, of ratings less the raters' means. The
    prediction is the user's mean plus the weighted mean of the user's deviations on the `neighbours` items of
    largest weight (equal weights: smaller item first), in [1, 5]; without neighbours it is the user's mean, and
    UNKNOWN for unknown users. Only weights between an asked item and items its users rated are computed.
    """
    c = F.col
    user, asked = Window.partitionBy("user_id"), pairs.select("user_id", "business_id").distinct()
    rated = train.select("user_id", "business_id", "stars").repartition("user_id").groupBy("user_id", "business_id").agg(F.sum("stars").alias("total"), F.count("stars").alias("n"))
    rated = rated.withColumn("mean", F.sum("total").over(user) / F.sum("n").over(user)).withColumn("first", F.row_number().over(user.orderBy("business_id")) == 1)
    dev = durable(rated.select("user_id", c("business_id").alias("other"), (c("total") / c("n") - c("mean")).alias("other_dev"), "mean", "first"), "deviations")
    x = dev.select("user_id", c("other").alias("business_id"), c("other_dev").alias("x")).join(sent(pairs.select("business_id").distinct(), "items"), "business_id", "left_semi")
    common = dev.select("user_id", "other", c("other_dev").alias("y")).join(sent(x, "raters"), "user_id").where("business_id <> other")
    sums = common.groupBy("business_id", "other").agg(F.round(F.sum(c("x") * c("y")), 9).alias("xy"), F.round(F.sum(c("x") * c("x")), 9).alias("xx"), F.round(F.sum(c("y") * c("y")), 9).alias("yy"))
    weights = durable(sums.where("xx > 0 AND yy > 0").select("business_id", "other", F.round(c("xy") / F.sqrt(c("xx") * c("yy")), 6).alias("w")), "weights")
    # Each user has a row without an item besides: asked pairs without neighbours keep theirs, and nothing is joined to the asked pairs anew.
    row, none = F.struct("other", "other_dev"), F.lit(None)
    none = F.struct(none.cast(dev.schema["other"].dataType).alias("other"), none.cast("double").alias("other_dev"))
    rows = dev.select("user_id", "mean", F.inline(F.when(c("first"), F.array(row, none)).otherwise(F.array(row))))
    wanted = _weighted(asked.join(rows, "user_id", "left").where("other IS NULL OR business_id <> other"), weights).where("other IS NULL OR w IS NOT NULL")
    best = Window.partitionBy("user_id", "business_id").orderBy(c("w").desc_nulls_last(), c("other"))
    near = wanted.withColumn("place", F.row_number().over(best)).where((c("place") <= neighbours) | c("other").isNull())
    weight = F.sum(F.abs("w"))
    shift = F.when(weight == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.sum(c("w") * c("other_dev")), weight))  # 0 / 0 as in the SQL, where it gives 5
    out = near.groupBy("user_id", "business_id").agg(F.max("mean").alias("mean"), shift.alias("shift"))
    value = clamp(c("mean") + F.coalesce("shift", F.lit(0.0)), 1.0, 5.0)
    return out.select("user_id", "business_id", F.round(F.coalesce(value, F.lit(UNKNOWN)), 4).alias("prediction"))


def _weighted(wanted: DataFrame, weights: DataFrame) -> DataFrame:
    """wanted with the weight w of business_id and other, or null.

    The weights go to the tasks in up to four parts, so that wanted, by far the largest, stays where it is; only more weights than that deal it.
    """
    key = ["business_id", "other"]
    parts = max(1, -(-weights.count() // SENT))
    if parts > 4:
        return wanted.join(weights, key, "left")
    for i in range(parts):
        part = weights.where(F.pmod(F.xxhash64(*key), F.lit(parts)) == i).withColumnRenamed("w", f"w_{i}")
        wanted = wanted.join(F.broadcast(part), key, "left")
    names = [f"w_{i}" for i in range(parts)]
    return wanted.withColumn("w", F.coalesce(*names)).drop(*names)


def rating_map(train: DataFrame) -> DataFrame:
    """business_id and a map from user to the user's last rating (by date, then seq, then rating)."""
    last = train.groupBy("business_id", "user_id").agg(F.max(F.struct("date", "seq", "stars"))["stars"].alias("stars"))
    return last.groupBy("business_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("user_id", "stars")))).alias("ratings"))


def predict_trees(train: DataFrame, asked: DataFrame, features: list[str], label: str = "stars", **params) -> DataFrame:
    """asked with column prediction of gradient-boosted trees; the ids stay with their rows throughout."""
    from orebody.operators import boosting

    model = boosting.fit_rows(train, features, label, **(TREES | params))
    return boosting.predict_rows(model, asked, features, ["user_id", "business_id"])


def blend(model: DataFrame, neighbours: DataFrame, weight: float = 0.95) -> DataFrame:
    """weight * model + (1 - weight) * neighbours; where the latter has no row it counts as UNKNOWN."""
    other = neighbours.select("user_id", "business_id", F.col("prediction").alias("other"))
    both = model.join(other, ["user_id", "business_id"], "left")
    value = weight * F.col("prediction") + (1 - weight) * F.coalesce("other", F.lit(UNKNOWN))
    return both.select("user_id", "business_id", F.round(value, 6).alias("prediction"))


def rmse(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    both = predicted.join(truth, ["user_id", "business_id"])
    return both.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("stars"), 2))).alias("rmse"))
