"""Dominant values: the most frequent brand and model, brand, or attribute of a group of items.

The share is of all items of the group, also those without a value. Among equally frequent values
the one seen first wins. Both forms below follow the same rule; the tests hold them equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions import jsontext, text

BRAND_MODEL = "brand_model"
BRAND = "brand"


def _stripped(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\r\n"))


def brand_model(brand: Column, name: Column) -> Column:
    """Brand plus the first two longer words of the name without the brand; null if there are none."""
    rest = text.first_words(text.without(name, brand), 2, min_chars=2)
    return F.concat(text.filled(brand), F.lit(" "), text.filled(rest))


def item_values(fields: Column, pos: Column, cfg: EngineConfig) -> Column:
    """(kind, value, pos) of one item for every kind it has. Null or non-text counts as absent."""
    texts = F.filter(fields, lambda f: (f["value_type"] == "string") & (_stripped(f["value"]) != ""))

    def text_of(name: str) -> Column:
        return _stripped(jsontext.field_value(texts, name))

    brand = text_of("brand")
    name = F.coalesce(*[text_of(f) for f in ("product_name", "title", "name")])

    def entry(kind: Column, value: Column) -> Column:
        return F.struct(kind.alias("kind"), value.alias("value"), pos.alias("pos"))

    named = F.array(entry(F.lit(BRAND_MODEL), brand_model(brand, name)), entry(F.lit(BRAND), brand))
    attributes = F.filter(texts, lambda f: f["field"].isin(*cfg.attribute_fields))
    return F.concat(
        F.filter(named, lambda e: e["value"].isNotNull()),
        F.transform(attributes, lambda f: entry(f["field"], _stripped(f["value"]))),
    )


# ---- in the page's own row -------------------------------------------------------------------

_RUN = "struct<value:string,n:bigint,pos:int>"
_STATE = f"struct<run:{_RUN},best:{_RUN}>"


def _mode(entries: Column) -> Column:
    """Most frequent (kind, value, pos) entry of one kind, first seen among equals: one pass over the sorted entries."""
    start = F.lit(None).cast(_STATE)

    def step(state: Column, entry: Column) -> Column:
        same = F.coalesce(state["run"]["value"] == entry["value"], F.lit(False))
        run = F.struct(
            entry["value"].alias("value"),
            F.when(same, state["run"]["n"] + 1).otherwise(F.lit(1)).cast("bigint").alias("n"),
            F.when(same, state["run"]["pos"]).otherwise(entry["pos"]).alias("pos"),
        )
        best = state["best"]
        better = (
            best.isNull()
            | (run["n"] > best["n"])
            | ((run["n"] == best["n"]) & (run["pos"] < best["pos"]))
        )
        return F.struct(run.alias("run"), F.when(better, run).otherwise(best).alias("best")).cast(_STATE)

    return F.aggregate(F.array_sort(entries), start, step, lambda s: s["best"])


def page_dominance(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add `dominance`: one (kind, value, n, share, first_pos, dominant) per kind that occurs."""
    n_items = F.size("items")
    limits = {BRAND_MODEL: cfg.model_share, BRAND: cfg.brand_share}
    limits |= {k: cfg.attribute_share for k in cfg.attribute_fields}
    rules = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.lit(limit).alias("limit")) for k, limit in limits.items()]
    )
    entries = F.flatten(F.transform("items", lambda item, i: item_values(F.coalesce(item, jsontext.no_fields()), i, cfg)))
    df = df.withColumn("_entries", entries)

    def measured(rule: Column) -> Column:
        own = F.filter(F.col("_entries"), lambda e: e["kind"] == rule["kind"])
        return F.struct(rule.alias("rule"), F.array_min(F.transform(own, lambda e: e["pos"])).alias("first_pos"), _mode(own).alias("mode"))

    def judged(m: Column) -> Column:
        share = text.ratio(m["mode"]["n"], n_items)
        return F.struct(
            m["rule"]["kind"].alias("kind"),
            m["mode"]["value"].alias("value"),
            m["mode"]["n"].alias("n"),
            share.alias("share"),
            m["first_pos"].alias("first_pos"),
            F.coalesce((n_items >= 2) & (share >= m["rule"]["limit"]), F.lit(False)).alias("dominant"),
        )

    found = F.filter(F.transform(rules, measured), lambda m: m["mode"].isNotNull())
    return df.withColumn("dominance", F.transform(found, judged)).drop("_entries")


def dominant(dominance: Column, kind: str) -> Column:
    """The dominant value of a kind, null where none passes its threshold."""
    return F.get(F.filter(dominance, lambda r: (r["kind"] == kind) & r["dominant"]), F.lit(0))["value"]


def first_attribute(dominance: Column, cfg: EngineConfig = EngineConfig()) -> Column:
    """The dominant attribute whose field appeared first among the items."""
    order = {k: i for i, k in enumerate(cfg.attribute_fields)}
    ranked = F.transform(
        F.filter(dominance, lambda r: r["dominant"] & r["kind"].isin(*order)),
        lambda r: F.struct(
            r["first_pos"].alias("pos"),
            F.array_position(F.array(*map(F.lit, order)), r["kind"]).alias("rank"),
            r["value"].alias("value"),
        ),
    )
    return F.array_min(ranked)["value"]


# ---- over a table of items ---------------------------------------------------------------------


def dominant_values(
    items: DataFrame,
    keys: list[str],
    order: list[str],
    kinds: dict[str, Column],
    limits: dict[str, float],
) -> DataFrame:
    """One row per key: items, the order of the first item, and per kind its most frequent value,
    count, share and verdict.

    `kinds` maps a kind to the column that holds its value for one item row; `order` lists the
    columns that say which item comes first. Items of one key and equal values are counted first, with
    map-side combining, so of a hot key only its different combinations of values meet. These rows go
    to their keys once; only there are they taken apart by kind, and the best per kind is a mergeable
    minimum over the counts: no window, and no row per kind and item on the way.
    """
    # One order column is compared as it is, which keeps the counting in a hash aggregate.
    seen = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    own = {k: f"_own_{k}" for k in kinds}
    alike = (
        items.select(*keys, seen.alias("_seen"), *[c.alias(own[k]) for k, c in kinds.items()])
        .groupBy(*keys, *own.values())
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_seen").alias("_seen"))
    )
    # Rows per kind are several times these rows, so tasks are not merged by the size of what they read.
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unpivoted = alike.repartition(tasks, *keys).select(
        *keys,
        "_n",
        "_seen",
        F.explode(
            F.array(
                F.struct(F.lit("").alias("kind"), F.lit("").alias("value")),
                *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in own.items()],
            )
        ).alias("_kv"),
    ).select(*keys, "_n", "_seen", F.col("_kv.kind").alias("kind"), F.col("_kv.value").alias("value"))
    counted = (
        unpivoted.where(F.col("value").isNotNull())
        .groupBy(*keys, "kind", "value")
        .agg(F.sum("_n").alias("n"), F.min("_seen").alias("seen"))
    )
    item_row = F.col("kind") == ""
    aggregates = [
        F.max(F.when(item_row, F.col("n"))).alias("items"),
        F.min(F.when(item_row, F.col("seen"))).alias("first_item"),
    ]
    for kind in kinds:
        here = F.col("kind") == kind
        best = F.struct((-F.col("n")).alias("neg"), F.col("seen"), F.col("value"))
        aggregates.append(F.min(F.when(here, best)).alias(f"_{kind}"))
        aggregates.append(F.min(F.when(here, F.col("seen"))).alias(f"{kind}_first"))
    result = counted.groupBy(*keys).agg(*aggregates)
    for kind in kinds:
        best = F.col(f"_{kind}")
        share = text.ratio(-best["neg"], F.col("items"))
        result = result.withColumns(
            {
                f"{kind}_value": best["value"],
                f"{kind}_n": -best["neg"],
                f"{kind}_share": share,
                f"{kind}_dominant": F.coalesce(
                    (F.col("items") >= 2) & (share >= limits[kind]), F.lit(False)
                ),
            }
        ).drop(f"_{kind}")
    return result


def first_dominant(kinds: list[str]) -> Column:
    """Over a row of `dominant_values`: the dominant value among `kinds` that appeared first."""
    candidates = [
        F.when(
            F.col(f"{k}_dominant"),
            F.struct(
                F.col(f"{k}_first").alias("seen"), F.lit(i).alias("rank"), F.col(f"{k}_value").alias("value")
            ),
        )
        for i, k in enumerate(kinds)
    ]
    return F.least(*candidates)["value"] if len(candidates) > 1 else candidates[0]["value"]
