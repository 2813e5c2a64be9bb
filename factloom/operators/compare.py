"""Comparison of two extraction runs over the same pages, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators.fields import count_fields
from factloom.schemas import FIELD, ITEMS

ABSENT = "MISSING"
RUN_A = "a"
RUN_B = "b"
TIE = "tie"
METRICS = ("items", "total_fields", "populated", "missing", "avg_fields_per_item")


def item_counts(items: Column) -> dict[str, Column]:
    """Items and fields of one run, from the page's row."""
    counts = count_fields(items)
    return {"items": counts["n_items"], **{m: counts[m] for m in METRICS[1:]}}


def _better(a: Column, b: Column, more: bool, within: float | None = None) -> Column:
    tie = (a == b) if within is None else F.abs(a - b) < F.lit(within)
    b_wins = (b > a) if more else (b < a)
    return F.when(tie, F.lit(TIE)).when(b_wins, F.lit(RUN_B)).otherwise(F.lit(RUN_A))


def winners(pair: DataFrame) -> DataFrame:
    """Winner per metric. Run A is the cheaper one by definition and always wins on cost."""
    a, b = (lambda m: F.col(f"a_{m}")), (lambda m: F.col(f"b_{m}"))
    return pair.withColumns(
        {
            "items_winner": _better(a("items"), b("items"), True),
            "total_fields_winner": _better(a("total_fields"), b("total_fields"), True),
            "populated_winner": _better(a("populated"), b("populated"), True),
            "missing_winner": _better(a("missing"), b("missing"), False),
            "avg_fields_winner": _better(a("avg_fields_per_item"), b("avg_fields_per_item"), True, 0.1),
            "time_winner": _better(a("time_seconds"), b("time_seconds"), False, 2.0),
            "cost_winner": F.lit(RUN_A),
        }
    )


def recommendation(pair: DataFrame, pages: int = 100) -> DataFrame:
    """Populated share, gain, cost per extra field, cost of many pages, and what to use."""
    gain = F.col("b_populated") - F.col("a_populated")
    extra = F.col("b_cost").cast("double") - F.col("a_cost").cast("double")
    return pair.withColumns(
        {
            "a_populated_pct": text.ratio(F.col("a_populated"), F.col("a_total_fields")) * 100,
            "b_populated_pct": text.ratio(F.col("b_populated"), F.col("b_total_fields")) * 100,
            "quality_gain": gain,
            "cost_difference": extra,
            "cost_increase_pct": text.ratio(extra, F.col("a_cost").cast("double")) * 100,
            "cost_per_extra_field": extra / F.greatest(F.lit(1), gain),
            "a_cost_many_pages": F.col("a_cost").cast("double") * pages,
            "b_cost_many_pages": F.col("b_cost").cast("double") * pages,
            "verdict": F.when(gain > 5, F.lit("use b"))
            .when(gain > 0, F.lit("marginal"))
            .otherwise(F.lit("use a")),
        }
    )


def shown(value_type: Column, value: Column) -> Column:
    """A value as a report shows it: cut to 50 characters, `None` for null, a mark for absent."""
    text_of = text.preview(F.coalesce(value, F.lit("None")), 50)
    return F.when(value_type.isNull(), F.lit(ABSENT)).otherwise(text_of)


def same(a_type: Column, a_value: Column, b_type: Column, b_value: Column) -> Column:
    """Equal type and value; numbers by value. Absent equals nothing."""
    numeric = ("long", "double")
    numbers = a_type.isin(*numeric) & b_type.isin(*numeric)
    equal = F.when(
        numbers, a_value.try_cast("double").eqNullSafe(b_value.try_cast("double"))
    ).otherwise((a_type == b_type) & a_value.eqNullSafe(b_value))
    return F.coalesce(equal, F.lit(False))


def field_names(items: Column) -> Column:
    """The different field names of a page's items."""
    every = F.flatten(F.transform(items, lambda i: F.transform(i, lambda f: f["field"])))
    return F.coalesce(F.array_distinct(F.filter(every, lambda n: n.isNotNull())), F.array().cast("array<string>"))


def field_diff(pairs: DataFrame, a: Column, b: Column, keys: list[str]) -> DataFrame:
    """Every field of every item of either run, with both values and whether they match.

    The items of both runs lie in the page's row, so they are taken apart together and nothing is shuffled.
    """
    none = F.array().cast(f"array<{FIELD}>")
    both = F.arrays_zip(F.coalesce(a, F.array().cast(ITEMS)).alias("a"), F.coalesce(b, F.array().cast(ITEMS)).alias("b"))
    items = pairs.select(*keys, F.posexplode(both).alias("pos", "_pair")).select(
        *keys, "pos", F.coalesce("_pair.a", none).alias("_a"), F.coalesce("_pair.b", none).alias("_b")
    )
    names = F.array_union(*(F.transform(c, lambda f: f["field"]) for c in ("_a", "_b")))
    named = items.select(*keys, "pos", F.explode(names).alias("field"), "_a", "_b")
    found = [
        F.get(F.filter(c, lambda f: f["field"] == F.col("field")), F.lit(0)).alias(f"_{run}f") for run, c in ((RUN_A, "_a"), (RUN_B, "_b"))
    ]
    placed = named.select(*keys, "pos", "field", *found)
    left, right = ((F.col(f"_{r}f.value_type"), F.col(f"_{r}f.value")) for r in (RUN_A, RUN_B))
    return placed.select(
        *keys, "pos", "field", left[1].alias("a_value"), right[1].alias("b_value"), shown(*left).alias("a_shown"),
        shown(*right).alias("b_shown"), same(*left, *right).alias("match"),
    )


def item_diff(a: Column, b: Column) -> Column:
    """The same for one pair of items in one row, sorted by field; null unless both are there."""

    def names(fields: Column) -> Column:
        return F.transform(fields, lambda f: f["field"])

    def aligned(name: Column) -> Column:
        found = [F.get(F.filter(side, lambda f: f["field"] == name), F.lit(0)) for side in (a, b)]
        left, right = ((f["value_type"], f["value"]) for f in found)
        return F.struct(
            name.alias("field"),
            shown(*left).alias("a_shown"),
            shown(*right).alias("b_shown"),
            same(*left, *right).alias("match"),
        )

    return F.transform(F.array_sort(F.array_union(names(a), names(b))), aligned)


def first_item(diff: DataFrame) -> DataFrame:
    """The part of a diff that a comparison report shows."""
    return diff.where(F.col("pos") == 0)


def comparison_markdown(compared: DataFrame, a_name: str, b_name: str, original: Column) -> DataFrame:
    """Add `comparison_markdown` to rows that have winners and recommendation.

    Expects `sample`, the diff of the first items (see `item_diff`).
    """
    names = {RUN_A: a_name, RUN_B: b_name}

    def winner(column: str) -> Column:
        who = F.col(column)
        return (
            F.when(who == TIE, F.lit("Tie")).when(who == RUN_A, F.lit(a_name)).otherwise(F.lit(b_name))
        )

    def row(label: str, a: Column, b: Column, third: Column) -> Column:
        return F.concat_ws(" ", F.lit("|"), F.lit(f"**{label}**"), F.lit("|"), a, F.lit("|"), b, F.lit("|"), third, F.lit("|"))

    def count(m: str) -> tuple[Column, Column]:
        return F.col(f"a_{m}").cast("string"), F.col(f"b_{m}").cast("string")

    def number(fmt: str, m: str) -> tuple[Column, Column]:
        return tuple(F.format_string(fmt, F.col(f"{r}_{m}").cast("double")) for r in names)

    def usd(column: str, digits: int) -> Column:
        return F.format_string(f"$%.{digits}f", F.col(column).cast("double"))

    def pct(column: str, digits: int) -> Column:
        shown = F.format_string(f"%.{digits}f%%", F.col(column))
        return F.when(F.col(column).isNull(), F.lit("n/a")).otherwise(shown)

    def populated(r: str) -> Column:
        return F.concat(
            F.lit(f"- **{names[r]}:** "), F.col(f"{r}_populated").cast("string"), F.lit("/"),
            F.col(f"{r}_total_fields").cast("string"), F.lit(" fields populated ("),
            pct(f"{r}_populated_pct", 1), F.lit(")"),
        )

    gain = F.col("quality_gain").cast("string")
    increase = pct("cost_increase_pct", 0)
    verdict = (
        F.when(
            F.col("verdict") == "use b",
            F.concat(F.lit(f"Use {b_name}: "), gain, F.lit(" more fields justify a cost increase of "), increase, F.lit(".")),
        )
        .when(
            F.col("verdict") == "marginal",
            F.concat(F.lit(f"Marginal: {b_name} fills "), gain, F.lit(" more fields and costs "), increase, F.lit(" more.")),
        )
        .otherwise(F.concat(F.lit(f"Use {a_name}: no gain in quality, and it saves "), increase, F.lit(".")))
    )
    sample = F.transform(
        F.col("sample"),
        lambda s: F.concat_ws(
            " ", F.lit("|"), s["field"], F.lit("|"), s["a_shown"], F.lit("|"), s["b_shown"], F.lit("|"),
            F.when(s["match"], F.lit("✅")).otherwise(F.lit("❌")), F.lit("|"),
        ),
    )
    lines = F.concat(
        F.array(
            F.lit("# Extraction Comparison Report"),
            F.concat(F.lit("**Test File:** "), original),
            F.lit(""),
            F.lit("## Summary"),
            F.lit(f"| Metric | {a_name} | {b_name} | Winner |"),
            F.lit("|---|---|---|---|"),
            row("Items Extracted", *count("items"), winner("items_winner")),
            row("Total Fields", *count("total_fields"), winner("total_fields_winner")),
            row("Populated Fields", *count("populated"), winner("populated_winner")),
            row("Null/Missing Fields", *count("missing"), winner("missing_winner")),
            row("Avg Fields/Item", *number("%.1f", "avg_fields_per_item"), winner("avg_fields_winner")),
            row("Processing Time", *number("%.1fs", "time_seconds"), winner("time_winner")),
            row("Cost", usd("a_cost", 4), usd("b_cost", 4), winner("cost_winner")),
            row("Cost Difference", F.lit("-"), usd("cost_difference", 4), increase),
            F.lit(""),
            F.lit("## Quality Analysis"),
            populated(RUN_A),
            populated(RUN_B),
            F.lit(""),
            F.lit("## Sample Item Comparison"),
            F.lit(f"| Field | {a_name} | {b_name} | Match? |"),
            F.lit("|---|---|---|---|"),
        ),
        F.coalesce(sample, F.array().cast("array<string>")),
        F.array(
            F.lit(""),
            F.lit("## Cost-Benefit Analysis"),
            F.concat(F.lit("- Cost difference per page: "), usd("cost_difference", 4)),
            F.concat(F.lit(f"- {a_name}, 100 pages: "), usd("a_cost_many_pages", 2)),
            F.concat(F.lit(f"- {b_name}, 100 pages: "), usd("b_cost_many_pages", 2)),
            F.concat(F.lit("- Cost per additional field: "), usd("cost_per_extra_field", 4)),
            F.lit(""),
            F.lit("## Recommendation"),
            verdict,
            F.lit(""),
        ),
    )
    return compared.withColumn("comparison_markdown", F.array_join(lines, "\n"))
