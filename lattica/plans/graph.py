"""Rows to typed objects and links, with deterministic identities and provenance.

Mappings are plain declarations; each turns into projections, unions and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json


@dataclass(frozen=True)
class Binding:
    """One property of an object: a column, or a codec over columns; ``echo`` is a column of the request that stands in where the response has no value."""

    name: str
    columns: Sequence[str]
    codec: Callable[..., Column] | None = None
    echo: str | None = None

    def value(self) -> Column:
        columns = [F.col(c) for c in self.columns]
        value = F.nullif((self.codec(*columns) if self.codec else columns[0]).cast("string"), F.lit(""))
        return F.coalesce(value, F.nullif(F.col(self.echo).cast("string"), F.lit(""))) if self.echo else value


@dataclass(frozen=True)
class Role:
    """An object that each record may hold: its identity, and the roles its identity builds on."""

    name: str
    object_type: str
    identity: Sequence[str]
    bindings: Sequence[Binding]
    parents: Sequence[str] = ()
    constants: dict[str, str] = field(default_factory=dict)
    #: A property that holds the object's id, and properties that hold when it was observed; both are generated.
    id_property: str | None = None
    timestamps: Sequence[str] = ()
    #: Another ontology than the mapping's.
    ontology: str | None = None

    @property
    def generated(self) -> tuple[str, ...]:
        return (*self.timestamps, *([self.id_property] if self.id_property else []))


@dataclass(frozen=True)
class Link:
    link_type: str
    source: str
    target: str


@dataclass(frozen=True)
class Mapping:
    name: str
    operation: str
    key: Sequence[str]
    roles: Sequence[Role]
    links: Sequence[Link] = ()
    ontology: str = "default"


def identified(rows: DataFrame, mapping: Mapping, observed_at: str | None = None) -> DataFrame:
    """Adds, for each role, a struct of its id and properties; null where its identity is incomplete.

    Roles are worked out in the declared order, so a role's parents must come before it. An
    id is the hash of ontology, type and identity, in which parents always stand. Record keys
    are strings; ``observed_at`` is the value of timestamp properties.
    """
    out = rows.withColumn("_record", F.concat_ws(":", F.lit(mapping.operation), *[F.col(k).cast("string") for k in mapping.key]))
    seen: set[str] = set()
    for role in mapping.roles:
        if not set(role.parents) <= seen:
            raise ValueError(f"{role.name} comes before a parent")
        seen.add(role.name)
        values = {b.name: b.value() for b in role.bindings} | {k: F.lit(v) for k, v in role.constants.items()}
        values |= {k: F.lit(observed_at).cast("string") for k in role.timestamps}
        if not set(role.identity) <= set(values):
            raise ValueError(f"{role.name} lacks part of its identity")
        complete = F.lit(True)
        for name in role.identity:
            complete = complete & values[name].isNotNull()
        for parent in role.parents:
            complete = complete & F.col(f"role_{parent}.id").isNotNull()
        identity = {n: values[n] for n in role.identity}
        identity["parents"] = F.array(*[F.col(f"role_{p}.id") for p in role.parents]) if role.parents else F.array().cast("array<string>")
        key = F.sha2(F.concat(F.lit(f"{role.ontology or mapping.ontology}:{role.object_type}:"), canonical_json(identity)), 256)
        if role.id_property:
            values[role.id_property] = key
        properties = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _k, v: v.isNotNull())
        out = out.withColumn(f"role_{role.name}", F.when(complete, F.struct(key.alias("id"), properties.alias("properties"))))
    return out


def fragments(rows: DataFrame, mapping: Mapping, order: Column, observed_at: str | None = None) -> DataFrame:
    """object_type, object_id, properties, record_key and record_order (compared as text) of each object of each record."""
    held = identified(rows.withColumn("_order", order.cast("string")), mapping, observed_at)
    each = F.array(*[F.struct(F.lit(r.object_type).alias("object_type"), F.col(f"role_{r.name}.id").alias("object_id"), F.col(f"role_{r.name}.properties").alias("properties")) for r in mapping.roles])
    return held.select(F.explode(each).alias("f"), F.col("_record").alias("record_key"), F.col("_order").alias("record_order")).where("f.object_id is not null").select("f.*", "record_key", "record_order")


def objects(found: DataFrame) -> DataFrame:
    """One row for each object: of each property the value of the last record that has it; all its record keys, sorted.

    Among records of one order the greatest record key wins, so the result is the same on each run.
    """
    return merged(found).join(record_keys(found), ["object_type", "object_id"])


def merged(found: DataFrame) -> DataFrame:
    """object_type, object_id and properties: of each property the value of the last record that has it."""
    return counted(found).drop("n_records")


def counted(found: DataFrame) -> DataFrame:
    """``merged`` objects with n_records, the number of records that hold them.

    Records are brought together by object before their properties become rows, so that an id
    travels once for each record.
    """
    by = ["object_type", "object_id"]
    values = found.repartition(*by).select(*by, "record_key", "record_order", F.posexplode_outer("properties").alias("place", "name", "value"))
    last = values.groupBy(*by, "name").agg(F.max_by("value", F.struct("record_order", "record_key")).alias("value"), F.count_if(F.coalesce("place", F.lit(0)) == 0).alias("n"))
    entry = F.when(F.col("name").isNotNull(), F.struct("name", "value"))
    return last.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("properties"), F.sum("n").alias("n_records"))


def record_keys(found: DataFrame) -> DataFrame:
    """object_type, object_id and its record keys, sorted, each once."""
    return found.groupBy("object_type", "object_id").agg(F.array_sort(F.collect_set("record_key")).alias("record_keys"))


def property_provenance(found: DataFrame, mapping: Mapping) -> DataFrame:
    """object_type, object_id, name, kind and record_key: where each property of each object comes from.

    A value from a source names the record that it was taken from, the last that has it;
    generated properties come from the execution and name none.
    """
    values = found.select("object_type", "object_id", "record_key", "record_order", F.explode("properties").alias("name", "value"))
    last = values.groupBy("object_type", "object_id", "name").agg(F.max_by("record_key", F.struct("record_order", "record_key")).alias("record_key"))
    generated = F.lit(False)
    for role in mapping.roles:
        if role.generated:
            generated = generated | ((F.col("object_type") == role.object_type) & F.col("name").isin(*role.generated))
    kind = F.when(generated, "execution").otherwise("source")
    return last.select("object_type", "object_id", "name", kind.alias("kind"), F.when(~generated, F.col("record_key")).alias("record_key"))


def links(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """One row for each link with the number of records that state it."""
    held = identified(rows, mapping)
    each = F.array(*[F.struct(F.lit(x.link_type).alias("link_type"), F.col(f"role_{x.source}.id").alias("source_id"), F.col(f"role_{x.target}.id").alias("target_id")) for x in mapping.links])
    pairs = held.select(F.explode(each).alias("l"), "_record").where("l.source_id is not null and l.target_id is not null")
    return pairs.groupBy("l.link_type", "l.source_id", "l.target_id").agg(F.count("*").alias("n_records"))


def link_provenance(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """One row for each link and each record that states it."""
    held = identified(rows, mapping)
    each = F.array(*[F.struct(F.lit(x.link_type).alias("link_type"), F.col(f"role_{x.source}.id").alias("source_id"), F.col(f"role_{x.target}.id").alias("target_id")) for x in mapping.links])
    pairs = held.select(F.explode(each).alias("l"), F.col("_record").alias("record_key")).where("l.source_id is not null and l.target_id is not null")
    return pairs.select("l.*", "record_key").distinct()


def provenance(found: DataFrame, source: str, operation: str, mapping: str, observed_at: str) -> DataFrame:
    """What each object is known from: one struct for each source, with its record keys in order."""
    keys = record_keys(found)
    fixed = {"kind": "source", "source": source, "operation": operation, "mapping": mapping, "observed_at": observed_at}
    return keys.select("object_type", "object_id", F.array(F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()], F.col("record_keys"))).alias("provenance"))


#: What provenance is told apart by, besides its record keys.
SOURCE = ("kind", "source", "operation", "mapping", "observed_at")


def merged_provenance(rows: DataFrame) -> DataFrame:
    """provenance of each object (object_type, object_id) from rows with SOURCE and record_key.

    One struct for each source, operation, mapping and time, in that order, with its record
    keys in order, each once; a generated one has none. Any number of sources and mappings may
    speak of an object.
    """
    by = ["object_type", "object_id"]
    keys = rows.groupBy(*by, *SOURCE).agg(F.array_sort(F.collect_set("record_key")).alias("record_keys"))
    return keys.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*SOURCE, "record_keys"))).alias("provenance"))


def presented(objects: DataFrame, links: DataFrame, capability: str, order: Sequence[str], most: int = 200, page: dict[str, int] | None = None, outcome: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The objects that a result shows, and one row about it: status, capability, total_objects, total_links, truncated, page, page_size, total_items, outcome.

    Without ``page`` (page, page_size and total_items) the first ``most`` by ``order``, which
    must tell objects apart, are shown, and truncated says whether there are more; a page is
    shown whole.
    """
    shown = objects if page is not None else objects.orderBy(*order).limit(most)
    totals = objects.agg(F.count("*").alias("total_objects")).crossJoin(links.agg(F.count("*").alias("total_links")))  # one row each
    paged = [F.lit((page or {}).get(n)).cast("long").alias(n) for n in ("page", "page_size", "total_items")]
    about = totals.select(
        F.lit("success").alias("status"), F.lit(capability).alias("capability"), "total_objects", "total_links", ((F.col("total_objects") > most) if page is None else F.lit(False)).alias("truncated"), *paged, F.lit(outcome).cast("string").alias("outcome")
    )
    return shown, about


def variants(rows: DataFrame, base: Sequence[str], groups: dict[str, dict[str, str]], label: str) -> DataFrame:
    """Wide columns to one row for each labelled group: base columns, the label, and the group's own columns under common names.

    A group all of whose columns are null gives no row.
    """
    each = F.array(*[F.struct(F.lit(name).alias(label), *[F.col(c).alias(n) for n, c in columns.items()]) for name, columns in groups.items()])
    names = list(next(iter(groups.values())))
    out = rows.select(*base, F.explode(each).alias("_v")).select(*base, "_v.*")
    return out.where(F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull())


def nodes_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes, and those that only edges name, marked external."""
    named = edges.select(F.col("source_id").alias("node_id")).union(edges.select("target_id")).distinct()
    outside = named.join(nodes.select("node_id"), "node_id", "left_anti").withColumn("external", F.lit(True))
    return nodes.select("node_id").withColumn("external", F.lit(False)).union(outside)


def first_of(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")
