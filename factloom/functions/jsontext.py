"""JSON texts as ordered, typed fields.

A variant keeps every type but sorts its keys, and an inferred struct would grow a column for every
field name ever seen. Items are therefore held as ordered arrays of (field, value, value_type).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.schemas import FIELD, ITEMS

_STRINGS = "array<string>"


# Leading word of a variant's schema -> value type; decimals and the like are double.
_TYPES = {
    "VOID": "null",
    "STRING": "string",
    "BIGINT": "long",
    "BOOLEAN": "boolean",
    "ARRAY": "array",
    "OBJECT": "object",
}


def value_type(value: Column) -> Column:
    """One of string, long, double, boolean, array, object, null."""
    word = F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("VOID"))
    known = F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, word), F.lit("double"))


def value_text(value: Column) -> Column:
    """Scalars as text, arrays and objects as JSON text, JSON null as null."""
    return F.try_variant_get(value, "$", "string")


def pair(name: Column, value: Column) -> Column:
    return F.struct(
        name.alias("field"), value_text(value).alias("value"), value_type(value).alias("value_type")
    )


def text_pair(name: str, value: Column) -> Column:
    return F.struct(
        F.lit(name).alias("field"), value.alias("value"), F.lit("string").alias("value_type")
    )


def is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def members(text: Column) -> Column:
    """JSON object text -> map of its values as variants."""
    return F.from_json(text, "map<string,variant>")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body reads it; inside lambdas nothing else does that."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entries(values: Column) -> Column:
    """(key, value) of a map in its written order; of a repeated key the last value, in its first place."""

    def of(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda e: e["key"])
        last = lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)
        different = F.array_distinct(keys)
        return F.when(F.size(different) == F.size(keys), pairs).otherwise(F.transform(different, last))

    return bound(F.map_entries(values), of)


def object_fields(text: Column) -> Column:
    """Fields of a JSON object text in their written order. The text is parsed once, however many keys it has."""
    return F.transform(entries(members(text)), lambda e: pair(e["key"], e["value"]))


def elements(text: Column) -> Column:
    """JSON array text -> array of element texts; null for anything else."""
    return F.from_json(text, _STRINGS)


def extraction_shape(text: Column) -> Column:
    """Shape of extracted data: `items`, `item` or `unexpected`."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast(_STRINGS))
    return (
        F.when(F.array_contains(keys, "items"), F.lit("items"))
        .when(F.array_contains(keys, "item"), F.lit("item"))
        .otherwise(F.lit("unexpected"))
    )


def extraction_items(text: Column) -> Column:
    """Extracted data text -> items. A listed element that is no object stays, as a null."""
    inner = F.from_json(text, "struct<items:array<string>,item:string>")
    kinds = F.from_json(text, "struct<items:array<variant>>")["items"]

    def element(e: Column) -> Column:
        known = F.coalesce(F.schema_of_variant(e["kind"]).startswith("OBJECT"), F.lit(False))
        return F.when(known, object_fields(e["text"]))

    listed = F.transform(F.arrays_zip(inner["items"].alias("text"), kinds.alias("kind")), element)
    single = F.when(is_object(inner["item"]), F.array(object_fields(inner["item"])))
    return F.coalesce(listed, single, F.array().cast(ITEMS)).cast(ITEMS)


def field_value(fields: Column, name: str) -> Column:
    """Value of one field of an item; null where the item lacks it."""
    return F.get(F.filter(fields, lambda f: f["field"] == name), F.lit(0))["value"]


def text_value(fields: Column, name: str) -> Column:
    """Value of one field if it is text; numbers and nested values count as absent."""
    found = F.filter(fields, lambda f: (f["field"] == name) & (f["value_type"] == "string"))
    return F.get(found, F.lit(0))["value"]


def no_fields() -> Column:
    return F.array().cast(f"array<{FIELD}>")


def items_json(items: Column, shape: Column) -> Column:
    """Items back to extracted-data text. Values keep their types, nulls stay, order stays."""

    def quoted(text: Column) -> Column:
        # to_json of a one-element array escapes the text; the brackets are cut off again.
        wrapped = F.to_json(F.array(text))
        return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)

    def member(f: Column) -> Column:
        value = (
            F.when(f["value"].isNull(), F.lit("null"))
            .when(f["value_type"] == "string", quoted(f["value"]))
            .otherwise(f["value"])
        )
        return F.concat(quoted(f["field"]), F.lit(":"), value)

    def one(fields: Column) -> Column:
        return F.concat(F.lit("{"), F.array_join(F.transform(fields, member), ","), F.lit("}"))

    texts = F.transform(items, lambda i: F.when(i.isNull(), F.lit("null")).otherwise(one(i)))
    return F.when(
        shape == "item", F.concat(F.lit('{"item":'), F.get(texts, F.lit(0)), F.lit("}"))
    ).otherwise(F.concat(F.lit('{"items":['), F.array_join(texts, ","), F.lit("]}")))
