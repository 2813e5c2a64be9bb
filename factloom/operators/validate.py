"""Validation of an extraction against its profile, from the data itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions import jsontext, text
from factloom.operators.fields import count_fields, is_missing
from factloom.operators.profile import says_multiple

SUCCESS = "success"
INCOMPLETE = "extraction_incomplete"
FAILED = "extraction_failed"


def expected_number(item_count: Column) -> Column:
    """Expected items as a number; null where the profile only says there are several."""
    digits = text.filled(F.regexp_extract(item_count, r"([0-9]+)", 1)).try_cast("bigint")
    return F.when(digits.isNotNull(), digits).when(~says_multiple(item_count), F.lit(1).cast("bigint"))


def found_ratio(expected: Column, actual: Column) -> Column:
    """Found / expected. Without a number, two items fulfil `multiple` and one fulfils half of it."""
    unnumbered = F.when(actual >= 2, F.lit(1.0)).when(actual == 1, F.lit(0.5)).otherwise(F.lit(0.0))
    return F.when(expected > 0, actual / expected).otherwise(unnumbered)


def data_quality(found: Column, missing_share: Column, cfg: EngineConfig, more_blocks: Column | None = None) -> Column:
    """`more_blocks`: another layout of the page had more blocks than the one taken; such a page is not excellent."""
    whole = (found >= 1) & (missing_share <= cfg.excellent_max_missing)
    return (
        F.when(whole if more_blocks is None else whole & ~more_blocks, F.lit("excellent"))
        .when(found >= cfg.good_min_ratio, F.lit("good"))
        .when(found >= cfg.fair_min_ratio, F.lit("fair"))
        .otherwise(F.lit("poor"))
    )


def extraction_status(found: Column, cfg: EngineConfig) -> Column:
    return (
        F.when(found >= cfg.good_min_ratio, F.lit(SUCCESS))
        .when(found > 0, F.lit(INCOMPLETE))
        .otherwise(F.lit(FAILED))
    )


def _count_without(items: Column, field: str) -> Column:
    lacking = F.filter(items, lambda i: F.coalesce(is_missing(jsontext.field_value(i, field)), F.lit(True)))
    return F.size(lacking).cast("bigint")


def _values(items: Column, field: str) -> Column:
    """The filled values of a field over the items of a page, sorted."""
    values = F.transform(items, lambda i: jsontext.field_value(i, field))
    return F.array_sort(F.filter(values, lambda v: F.coalesce(~is_missing(v), F.lit(False))))


def _starts(values: str) -> Column:
    """Where each different value begins in a sorted array; a column of its own, so that it is found once."""
    places = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1))
    return F.filter(places, lambda i: (i == 0) | (F.get(F.col(values), i) != F.get(F.col(values), i - 1)))


def _tallied(values: str, starts: str) -> Column:
    """(n, value) of each different value of a sorted array."""
    end = lambda k: F.coalesce(F.get(F.col(starts), k + 1), F.size(values))
    return F.transform(starts, lambda s, k: F.struct((end(k) - s).alias("n"), F.get(F.col(values), s).alias("value")))


def validate_pages(rendered: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add status, `validation`, `insights`, `statistics`, `user_message` and `partial_summary`."""
    items = F.col("items")
    counts = count_fields(items)
    expected_text = F.coalesce(F.col("hypothesis.item_count"), F.lit("single"))
    prices = F.filter(
        F.transform(items, lambda i: text.price(jsontext.field_value(i, "price"))), lambda p: p.isNotNull()
    )
    measured = rendered.withColumns(
        {
            **{f"_{k}": c for k, c in counts.items()},
            "_expected": expected_number(expected_text),
            "_prices": F.array_sort(prices),
            "_conditions": _values(items, "condition"),
            "_places": _values(items, "place"),
            # A date without a year is put into a leap year, for its order alone.
            "_dates": F.filter(
                F.transform(
                    _values(items, "date"),
                    lambda d: F.struct(text.listing_date(d, F.lit("2000")).alias("at"), d.alias("text")),
                ),
                lambda d: d["at"].isNotNull(),
            ),
            **{f"_no_{r}": _count_without(items, r) for r in cfg.required_fields},
        }
    )
    n, missing, total = F.col("_n_items"), F.col("_missing"), F.col("_total_fields")
    measured = measured.withColumns(
        {
            "_found": found_ratio(F.col("_expected"), n),
            "_missing_share": F.coalesce(text.ratio(missing, total), F.lit(0.0)),
            "_condition_starts": _starts("_conditions"),
            "_place_starts": _starts("_places"),
        }
    )
    found, share = F.col("_found"), F.col("_missing_share")
    known = F.col("items").isNotNull()
    more_blocks = F.col("more_blocks") if "more_blocks" in rendered.columns else None
    measured = measured.withColumns(
        {
            "status": F.when(known, extraction_status(found, cfg)).otherwise(F.lit(FAILED)),
            "_gaps": F.concat_ws(
                ", ",
                *[
                    F.when(
                        F.col(f"_no_{r}") > 0, F.concat(F.col(f"_no_{r}").cast("string"), F.lit(f" items missing {r}"))
                    )
                    for r in cfg.required_fields
                ],
            ),
            "_priced": F.size("_prices"),
            "_low": F.array_min("_prices"),
            "_high": F.array_max("_prices"),
            "_median": F.get("_prices", ((F.size("_prices") - 1) / 2).cast("int")),
            "_condition_counts": _tallied("_conditions", "_condition_starts"),
            "_top_place": F.array_min(
                F.transform(
                    _tallied("_places", "_place_starts"),
                    lambda t: F.struct((-t["n"]).alias("rank"), t["value"].alias("value")),
                )
            ),
        }
    )
    good = F.col("status") == SUCCESS
    problem = F.when(
        ~good,
        F.when(~known, F.concat(F.lit("page was not processed: "), F.coalesce(F.col("reason"), F.lit("unknown"))))
        .when(n == 0, F.lit("no items were extracted"))
        .otherwise(
            F.concat(n.cast("string"), F.lit(" items were extracted, expected "), expected_text)
        ),
    )
    price_range = F.when(
        F.col("_priced") > 0,
        F.concat(
            F.lit("Price range: "), F.col("_low").cast("string"), F.lit(" - "), F.col("_high").cast("string"),
            F.lit(", median "), F.col("_median").cast("string"),
            F.lit(" ("), F.col("_priced").cast("string"), F.lit(" priced)"),
        ),
    )
    told = F.transform("_condition_counts", lambda t: F.concat(t["n"].cast("string"), F.lit(" "), t["value"]))
    conditions = F.when(F.size("_conditions") > 0, F.concat(F.lit("Conditions: "), F.array_join(told, ", ")))
    dates = F.when(
        F.size("_dates") > 0,
        F.concat(
            F.lit("Dated: "), F.array_min("_dates")["text"], F.lit(" - "), F.array_max("_dates")["text"]
        ),
    )
    place = F.when(
        F.size("_places") > 0,
        F.concat(
            F.lit("Most from: "), F.col("_top_place.value"), F.lit(" ("), (-F.col("_top_place.rank")).cast("string"),
            F.lit(" of "), F.size("_places").cast("string"), F.lit(")"),
        ),
    )
    filled = F.concat(
        F.lit("Fields: "), F.col("_populated").cast("string"), F.lit(" of "), total.cast("string"), F.lit(" filled")
    )
    validation = F.struct(
        good.alias("hypothesis_match"),
        expected_text.alias("expected_items"),
        F.coalesce(n, F.lit(0).cast("bigint")).alias("actual_items"),
        F.when(known, data_quality(found, share, cfg, more_blocks)).otherwise(F.lit("poor")).alias("data_quality"),
        F.when(good, F.lit("all items formatted")).alias("completeness"),
        problem.alias("problem"),
        F.when(good, text.filled(F.col("_gaps"))).alias("notes"),
    )
    insights = F.struct(
        F.concat(
            n.cast("string"), F.lit(" items from "), F.col("hypothesis.source"), F.lit(" ("),
            F.col("hypothesis.page_type"), F.lit(").")
        ).alias("executive_summary"),
        F.concat_ws("; ", filled, price_range, conditions, dates, place).alias("key_findings"),
        F.when(F.col("_gaps") != "", F.concat(F.lit("Complete before comparing: "), F.col("_gaps"), F.lit(".")))
        .otherwise(F.lit(""))
        .alias("recommendation"),
    )
    statistics = F.struct(
        n.cast("string").alias("total_items"), F.coalesce(price_range, filled).alias("key_metrics")
    )
    helpers = [c for c in measured.columns if c.startswith("_") and c not in rendered.columns]
    return measured.withColumns(
        {
            "validation": validation,
            "insights": F.when(good, insights),
            "statistics": F.when(good, statistics),
            "user_message": F.when(~good, F.concat(F.lit("The extraction is not complete: "), problem, F.lit("."))),
            "partial_summary": F.when(
                ~good & (n > 0), F.concat(n.cast("string"), F.lit(" items were extracted. "), filled, F.lit("."))
            ),
        }
    ).drop(*helpers)
