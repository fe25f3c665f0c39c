"""Relation queries: declared columns, filters, escaped search, named order, pages."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a query without pages returns at most.
MAX_ROWS = 1000

_COMPARE = {"eq": lambda c, v: c == v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v}


class QueryError(ValueError):
    """A query that names what its relation doesn't declare."""


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any


@dataclass(frozen=True)
class Search:
    fields: Sequence[str]
    value: str | None


@dataclass(frozen=True)
class Sort:
    field: str
    direction: str = "asc"
    nulls: str | None = None


@dataclass(frozen=True)
class Page:
    page: int = 1
    size: int = 20
    root: str | None = None


@dataclass(frozen=True)
class Query:
    filters: Sequence[Filter] = ()
    search: Search | None = None
    order_by: Sequence[Sort] = ()
    page: Page | None = None


@dataclass(frozen=True)
class Relation:
    """A table with its declared columns and its primary key."""

    name: str
    fields: Sequence[str]
    key: Sequence[str]
    table: str | None = None
    sorts: dict[str, Sequence[Sort]] = field(default_factory=dict)

    def scan(self, spark: SparkSession, folder: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{self.table or self.name}.parquet").select(*self.fields)

    def known(self, name: str) -> str:
        if name not in self.fields:
            raise QueryError(f"{self.name} has no field {name}")
        return name


def escaped(value: str) -> str:
    """As part of a LIKE pattern whose escape sign is the backslash."""
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def matches(column: Column, value: str) -> Column:
    """Case-insensitive, every character of the value for itself."""
    return column.ilike(f"%{escaped(value)}%")


def ordering(relation: Relation, order_by: Sequence[Sort]) -> list[Column]:
    """The order as asked for, else the key. Nulls come last ascending and first descending, unless said otherwise."""
    out = []
    for s in order_by or [Sort(k) for k in relation.key]:
        c = F.col(relation.known(s.field))
        if s.direction not in ("asc", "desc"):
            raise QueryError(f"no direction {s.direction}")
        nulls = s.nulls or ("last" if s.direction == "asc" else "first")
        out.append(getattr(c, f"{s.direction}_nulls_{nulls}")())
    return out


def restricted(df: DataFrame, relation: Relation, query: Query) -> DataFrame:
    """Rows that pass all filters and the search; a null or blank search value is none."""
    for f in query.filters:
        if f.operator not in _COMPARE:
            raise QueryError(f"no operator {f.operator}")
        df = df.where(_COMPARE[f.operator](F.col(relation.known(f.field)), F.lit(f.value)))
    if query.search and query.search.value:
        found = F.lit(False)
        for name in query.search.fields:
            found = found | F.coalesce(matches(F.col(relation.known(name)).cast("string"), query.search.value), F.lit(False))
        df = df.where(found)
    return df


def run(df: DataFrame, relation: Relation, query: Query, max_rows: int = MAX_ROWS) -> DataFrame:
    """One page in a total order: the key breaks ties of the order that is asked for."""
    found = restricted(df, relation, query)
    order = ordering(relation, query.order_by)
    asked = {s.field for s in query.order_by}
    order += [F.col(k).asc_nulls_last() for k in relation.key if query.order_by and k not in asked]
    if query.page is None:
        return found.orderBy(*order).limit(max_rows)
    if query.page.page < 1 or query.page.size < 1:
        raise QueryError("pages and their sizes start at 1")
    return found.orderBy(*order).offset((query.page.page - 1) * query.page.size).limit(query.page.size)


def totals(df: DataFrame, relation: Relation, query: Query) -> DataFrame:
    """total_items, distinct roots, and total_pages of a query with pages."""
    page = query.page or Page()
    root = relation.known(page.root or relation.key[0])
    items = restricted(df, relation, query).agg(F.countDistinct(root).alias("total_items"))
    return items.withColumn("total_pages", F.ceil(F.col("total_items") / page.size).cast("long"))


def roots_page(df: DataFrame, relation: Relation, query: Query) -> DataFrame:
    """A page of whole roots: all rows of the roots that the page holds, so that rows and totals agree."""
    page = query.page or Page()
    root = relation.known(page.root or relation.key[0])
    found = restricted(df, relation, query)
    chosen = found.select(root).distinct().orderBy(F.col(root).asc_nulls_last()).offset((page.page - 1) * page.size).limit(page.size)
    return found.join(F.broadcast(chosen), root, "left_semi")  # page.size rows


def pages_of(total: int, size: int) -> int:
    return math.ceil(total / size) if total else 0
