"""Arguments and values of requirements, which come as JSON text, and values that stand for an object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_VALUE = "struct<text:string,number:string,boolean:string,items:array<string>,attributes:array<struct<name:string,value:string>>>"


def as_object(json: Column) -> Column:
    """The text itself where it is a JSON object, else null."""
    whole = F.get_json_object(json, "$")
    return F.when(whole.startswith("{"), whole)


def rule_arguments(arguments: Column, value: Column) -> Column:
    """The arguments if they are a JSON object, else the requirement's value, else an empty object."""
    return F.coalesce(as_object(arguments), as_object(value), F.lit("{}"))


def argument(arguments: Column, name: str) -> Column:
    """One argument as text; blank is null."""
    return F.nullif(F.get_json_object(arguments, f"$.{name}"), F.lit(""))


def candidate_values(value: Column) -> Column:
    """All that a value says: its text, number, boolean, items, and the values of its attributes, in this order."""
    parsed = F.from_json(F.coalesce(as_object(value), F.lit("{}")), _VALUE)
    single = F.array(*[F.nullif(parsed[k], F.lit("")) for k in ("text", "number", "boolean")])
    none = F.array().cast("array<string>")
    many = F.coalesce(parsed["items"], none), F.coalesce(F.transform(parsed["attributes"], lambda a: a["value"]), none)
    return F.array_compact(F.concat(single, *many))


def expected_values(arguments: Column, value: Column, name: str) -> Column:
    """The argument's values (one, or a list) where it is given, else all that the value says."""
    given = argument(rule_arguments(arguments, value), name)
    listed = F.filter(F.from_json(given, "array<string>"), lambda x: x.isNotNull() & (x != ""))
    return F.when(given.isNull(), candidate_values(value)).when(given.startswith("["), listed).otherwise(F.array(given))


def display(objects: Column, preferred: Sequence[str], most: int = 10) -> Column:
    """The first of the preferred values of each of the first objects, joined by commas."""
    shown = F.transform(F.slice(objects, 1, most), lambda o: F.coalesce(*[F.nullif(o[p], F.lit("")) for p in preferred]))
    return F.array_join(shown, ", ")
