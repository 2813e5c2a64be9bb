"""Statistics of items, from the data: prices, dates, conditions, places.

All of them merge: statistics by a fine key (a seller, a page) roll up to a coarse one (a place, a
source), so a large table is reduced by its own keys before it is joined to anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import jsontext, text

AMOUNT = "decimal(18,4)"
_DATES = ("first_date", "last_date")


def price_statistics(
    items: DataFrame, keys: list[str], price_text: Column, date: Column | None = None
) -> DataFrame:
    """Items, priced items, price sum and range, and the date range, by key."""
    dates = [] if date is None else [F.min(date).alias("first_date"), F.max(date).alias("last_date")]
    return (
        items.withColumn("_price", text.price(price_text).try_cast(AMOUNT))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.count("_price").alias("priced"),
            F.sum("_price").alias("price_sum"),
            F.min("_price").alias("price_min"),
            F.max("_price").alias("price_max"),
            *dates,
        )
    )


def merged_price_statistics(statistics: DataFrame, keys: list[str]) -> DataFrame:
    """Roll price statistics up to other keys, and add the mean."""
    dates = [c for c in _DATES if c in statistics.columns]
    merged = statistics.groupBy(*keys).agg(
        F.sum("items").alias("items"),
        F.sum("priced").alias("priced"),
        F.sum("price_sum").alias("price_sum"),
        F.min("price_min").cast("double").alias("price_min"),
        F.max("price_max").cast("double").alias("price_max"),
        *[(F.min(c) if c == "first_date" else F.max(c)).alias(c) for c in dates],
    )
    mean = text.ratio(F.col("price_sum").cast("double"), F.col("priced"))
    return merged.withColumn("price_mean", mean).drop("price_sum")


def counts(items: DataFrame, keys: list[str]) -> DataFrame:
    """Number of items by key, as `n`."""
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def breakdown(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Items and share of each value within its key, from counts `n`."""
    by_value = counted.groupBy(*keys, value).agg(F.sum("n").alias("items"))
    totals = by_value.groupBy(*keys).agg(F.sum("items").alias("_all"))
    return (
        by_value.join(totals, keys)
        .withColumn("share", text.ratio(F.col("items"), F.col("_all")))
        .drop("_all")
    )


def concentration(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key with its share, from counts `n`; the smaller value wins a
    tie."""
    by_value = (
        counted.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum("n").alias("_n"))
    )
    best = by_value.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("values"),
        F.sum("_n").alias("items"),
        F.min(F.struct((-F.col("_n")).alias("neg"), F.col(value).alias("value"))).alias("_best"),
    )
    top_n = -F.col("_best.neg")
    return best.select(
        *keys,
        "values",
        "items",
        F.col("_best.value").alias("top_value"),
        top_n.alias("top_items"),
        text.ratio(top_n, F.col("items")).alias("top_share"),
    )


def listing_statistics(items: DataFrame, keys: list[str], year: Column) -> DataFrame:
    """Prices, ratings, reviews, date range and most frequent place of items (`item`, an array of fields), by key.

    One pass: rows by key and rows by key and place are counted in the same shuffle, both combined map-side, so
    neither a hot key nor a hot place is ever gathered. The median is that of a mergeable quantile summary, exact up to
    some thousand prices of a key. Dates without a year are of `year`.
    """
    of = lambda name: jsontext.field_value(F.col("item"), name)
    read = items.select(
        *keys,
        text.price(of("price")).alias("_price"),
        text.magnitude(of("rating")).alias("_rating"),
        text.magnitude(of("reviews")).alias("_reviews"),
        text.listing_date(of("date"), year).alias("_date"),
        text.filled(of("place")).alias("_place"),
    )
    counted = read.groupingSets([[*map(F.col, keys)], [*map(F.col, keys), F.col("_place")]], *keys, "_place").agg(
        F.grouping("_place").alias("_whole"),
        F.count(F.lit(1)).alias("items"),
        F.count("_price").alias("priced"),
        F.min("_price").alias("price_min"),
        F.max("_price").alias("price_max"),
        F.percentile_approx("_price", 0.5, 10_000).alias("price_median"),
        F.avg("_rating").alias("avg_rating"),
        F.sum("_reviews").alias("reviews"),
        F.min("_date").alias("first_date"),
        F.max("_date").alias("last_date"),
    )
    whole = F.col("_whole") == 1
    kept = [c for c in counted.columns if c not in (*keys, "_place", "_whole")]
    place = F.when(~whole & F.col("_place").isNotNull(), F.struct((-F.col("items")).alias("rank"), F.col("_place").alias("place")))
    return (
        counted.groupBy(*keys)
        .agg(*(F.max(F.when(whole, F.col(c))).alias(c) for c in kept), F.min(place).alias("_top"))
        .withColumns({"top_place": F.col("_top.place"), "top_place_items": -F.col("_top.rank")})
        .drop("_top")
    )
