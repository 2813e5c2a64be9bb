"""Structured data that pages carry in JSON-LD script blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import jsontext

_STRINGS = "array<string>"
_NODE = "struct<`@type`:string,name:string,item:string,itemListElement:array<string>>"


def nodes(json_texts: Column) -> Column:
    """Top-level nodes, each parsed once: a block, the members of an array block, or of its graph."""

    def of_block(text: Column) -> Column:
        graph = F.from_json(text, "struct<`@graph`:array<string>>")["@graph"]
        return F.when(text.startswith("["), jsontext.elements(text)).otherwise(
            F.coalesce(graph, F.array(text))
        )

    return _parsed(F.flatten(F.transform(json_texts, of_block)))


def _parsed(texts_of_nodes: Column) -> Column:
    objects = F.filter(texts_of_nodes, lambda n: n.startswith("{"))
    return F.transform(objects, lambda n: F.struct(n.alias("text"), F.from_json(n, _NODE).alias("node")))


def _has_type(node: Column, name: str) -> Column:
    return F.coalesce(node["node"]["@type"].contains(name), F.lit(False))


def has_type(parsed: Column, name: str) -> Column:
    return F.exists(parsed, lambda n: _has_type(n, name))


def items(parsed: Column) -> Column:
    """Named entries of item lists, else the product nodes; as JSON texts."""
    lists = F.filter(parsed, lambda n: _has_type(n, "ItemList"))
    listed = _parsed(
        F.flatten(F.transform(lists, lambda n: F.coalesce(n["node"]["itemListElement"], F.array().cast(_STRINGS))))
    )
    # An entry is the item itself or holds it as `item`.
    entries = F.transform(
        listed,
        lambda n: F.when(
            n["node"]["item"].startswith("{"),
            F.struct(
                n["node"]["item"].alias("text"), F.get_json_object(n["node"]["item"], "$.name").alias("name")
            ),
        ).otherwise(F.struct(n["text"].alias("text"), n["node"]["name"].alias("name"))),
    )
    named = F.filter(entries, lambda e: F.coalesce(e["name"] != "", F.lit(False)))
    products = F.filter(parsed, lambda n: _has_type(n, "Product"))
    return F.when(F.size(named) > 0, F.transform(named, lambda e: e["text"])).otherwise(
        F.transform(products, lambda n: n["text"])
    )


def breadcrumb(parsed: Column) -> Column:
    """Name of the last breadcrumb; null where the page has none."""
    trail = F.get(F.filter(parsed, lambda n: _has_type(n, "BreadcrumbList")), F.lit(0))
    crumbs = trail["node"]["itemListElement"]
    last = F.get(crumbs, F.size(crumbs) - 1)
    return F.coalesce(F.get_json_object(last, "$.name"), F.get_json_object(last, "$.item.name"))


def item_fields(text: Column) -> Column:
    """Fields of one item: plain members in order, named members by their name, offers spread out. The text is parsed once."""
    return jsontext.bound(jsontext.members(text), _member_fields)


def _member_fields(values: Column) -> Column:
    def named(value: Column) -> Column:
        return F.coalesce(F.try_variant_get(value, "$.name", "variant"), value)

    def offer(member: str) -> Column:
        return F.coalesce(
            F.try_variant_get(values["offers"], f"$.{member}", "variant"),
            F.try_variant_get(values["offers"], f"$[0].{member}", "variant"),
        )

    stated = F.filter(jsontext.entries(values), lambda e: ~e["key"].startswith("@") & (e["key"] != "offers"))
    plain = F.transform(stated, lambda e: jsontext.pair(e["key"], named(e["value"])))
    price = F.coalesce(offer("price"), offer("lowPrice"))
    spread = F.array(
        jsontext.pair(F.lit("price"), price),
        jsontext.pair(F.lit("currency"), offer("priceCurrency")),
        jsontext.pair(F.lit("availability"), offer("availability")),
        jsontext.pair(F.lit("condition"), offer("itemCondition")),
    )
    added = F.filter(spread, lambda f: f["value"].isNotNull() & ~F.array_contains(F.map_keys(values), f["field"]))
    return F.concat(plain, added)
