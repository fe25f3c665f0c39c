"""Capabilities: named queries with declared inputs, bound to relation queries and run to objects and links."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relation import Filter, Page, Query, QueryError, Relation, Search, Sort, run, totals
from . import graph

_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "date": (date, str), "datetime": (datetime, str)}


@dataclass(frozen=True)
class Input:
    """An input: what it is, and the column and operator that it filters, or the columns it searches."""

    name: str
    kind: str = "string"
    required: bool = False
    default: Any = None
    column: str | None = None
    operator: str = "eq"
    searches: Sequence[str] = ()
    values: Sequence[Any] = ()
    least: Any = None
    most: Any = None

    def checked(self, value: Any) -> Any:
        if isinstance(value, bool) and self.kind != "boolean" or not isinstance(value, _KINDS[self.kind]):
            raise QueryError(f"{self.name} is no {self.kind}")
        if self.kind == "date" and isinstance(value, str):
            value = date.fromisoformat(value)
        if self.kind == "datetime" and isinstance(value, str):
            value = datetime.fromisoformat(value.replace("Z", "+00:00"))
        if self.values and value not in self.values:
            raise QueryError(f"{self.name} must be one of {list(self.values)}")
        if self.least is not None and value < self.least or self.most is not None and value > self.most:
            raise QueryError(f"{self.name} is out of range")
        return value


@dataclass(frozen=True)
class Capability:
    """A query over one relation whose rows are mapped to objects and links."""

    name: str
    relation: Relation
    mapping: graph.Mapping
    inputs: Sequence[Input] = ()
    sorts: dict[str, Sequence[Sort]] = field(default_factory=dict)
    returns: Sequence[str] = ()
    page_size: int = 20
    page_most: int = 100

    def bind(self, **given: Any) -> Query:
        """The relation query of given inputs; sort, page and page_size are inputs of every capability."""
        known = {i.name: i for i in self.inputs}
        if unknown := set(given) - set(known) - {"sort", "page", "page_size"}:
            raise QueryError(f"unknown inputs {sorted(unknown)}")
        filters, search = [], None
        for i in self.inputs:
            value = given.get(i.name, i.default)
            if value is None:
                if i.required:
                    raise QueryError(f"{i.name} is required")
                continue
            value = i.checked(value)
            if i.searches:
                search = Search(tuple(i.searches), value)
            else:
                filters.append(Filter(i.column or i.name, i.operator, value))
        sort = given.get("sort", next(iter(self.sorts), None))
        if sort is not None and sort not in self.sorts:
            raise QueryError(f"no sort {sort}")
        size = given.get("page_size", self.page_size)
        if not 1 <= size <= self.page_most:
            raise QueryError("page_size is out of range")
        return Query(filters, search, self.sorts[sort] if sort else (), Page(given.get("page", 1), size, self.relation.key[0]))

    def rows(self, spark: SparkSession, folder: str, **given: Any) -> DataFrame:
        return run(self.relation.scan(spark, folder), self.relation, self.bind(**given))

    def totals(self, spark: SparkSession, folder: str, **given: Any) -> DataFrame:
        return totals(self.relation.scan(spark, folder), self.relation, self.bind(**given))

    def objects(self, spark: SparkSession, folder: str, **given: Any) -> DataFrame:
        """Objects of the returned types; links may lead to types that are left out."""
        found = graph.objects(graph.fragments(self.rows(spark, folder, **given), self.mapping, F.lit("1")))
        return found.where(F.col("object_type").isin(*self.returns)) if self.returns else found

    def links(self, spark: SparkSession, folder: str, **given: Any) -> DataFrame:
        return graph.links(self.rows(spark, folder, **given), self.mapping)


def faults(capability: Capability) -> list[str]:
    """What is wrong with a declaration, in words; nothing if it is sound."""
    out, names = [], [i.name for i in capability.inputs]
    out += [f"input {n} twice" for n in sorted({n for n in names if names.count(n) > 1})]
    for i in capability.inputs:
        if i.kind not in _KINDS:
            out.append(f"input {i.name}: unknown kind {i.kind}")
        out += [f"input {i.name}: no field {c}" for c in (i.searches or (i.column or i.name,)) if c not in capability.relation.fields]
        if i.required and i.default is not None:
            out.append(f"input {i.name}: required and with a default")
    out += [f"sort {n}: no field {s.field}" for n, sorts in capability.sorts.items() for s in sorts if s.field not in capability.relation.fields]
    roles = {r.name: r for r in capability.mapping.roles}
    for r in capability.mapping.roles:
        out += [f"role {r.name}: no field {c}" for b in r.bindings for c in b.columns if c not in capability.relation.fields]
        out += [f"role {r.name}: no parent {p}" for p in r.parents if p not in roles]
    out += [f"link {x.link_type}: no role {e}" for x in capability.mapping.links for e in (x.source, x.target) if e not in roles]
    out += [f"returns {t}, which no role makes" for t in capability.returns if t not in {r.object_type for r in roles.values()}]
    out += [f"key {k} isn't declared" for k in capability.relation.key if k not in capability.relation.fields]
    return out
