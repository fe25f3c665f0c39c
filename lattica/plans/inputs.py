"""What an extraction reads of a notice: documents, what can't be read, licences, regions and coverage, each child joined once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The copy that notices carry of a document, the code and name of the whole country, what says that there is no consortium.
STANDARD_COPY, NATIONWIDE_CODE, NATIONWIDE, NO_CONSORTIUM = "표준공고서", "00", "전국", ("", "(없음)", "없음")

KEY = ("notice_number", "notice_order")
_DOCUMENT = ("document_id", "file_name", "checksum", "parsed_object_key")
_UNREAD = ("document_id", "file_name", "status", "attempts", "last_error_code", "parse_status")
_LICENCE = ("restriction_group_number", "restriction_sequence", "license_restriction_name", "source_record_hash")


def readable(documents: DataFrame) -> DataFrame:
    """Parsed and active documents, one of each checksum of a notice: by name, the standard copy last, then by slot. A null checksum is a document's own."""
    usable = documents.where("parse_status = 'parsed' and storage_status = 'active' and parsed_object_key is not null")
    same = F.coalesce("checksum", F.col("document_id").cast("string"))
    w = Window.partitionBy(*KEY, same).orderBy(F.trim(F.coalesce("file_name", F.lit(""))) == STANDARD_COPY, F.coalesce("file_name", F.lit("")), "document_slot", "document_id")
    return usable.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def unreadable(documents: DataFrame) -> DataFrame:
    """Documents that aren't stored and parsed and have no sibling of their checksum that is."""
    ready = (F.col("status") == "stored") & (F.col("parse_status") == "parsed")
    usable = ready & (F.col("storage_status") == "active") & F.col("parsed_object_key").isNotNull()
    siblings = documents.where(usable & F.col("checksum").isNotNull()).select(*KEY, "checksum").distinct()
    return documents.where(~F.coalesce(ready, F.lit(False))).join(siblings, [*KEY, "checksum"], "left_anti")


def _gathered(rows: DataFrame, fields: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """One row for each notice with its rows as an array, in order."""
    one = F.struct(*[F.col(o).alias(f"_{i}") for i, o in enumerate(order)], F.struct(*fields).alias("row"))
    return rows.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["row"]).alias(name))


def extraction_inputs(notices: DataFrame, documents: DataFrame, licences: DataFrame, regions: DataFrame) -> DataFrame:
    """Per notice: documents, unavailable_documents, licenses, regions, consortiums (arrays) and coverage.

    ``notices`` have KEY, source_record_hash, consortium_method, region_code and region_name
    of their summary. Regions are the detailed ones but for the whole country, or the summary's
    where there are none; the two conflict where the summary names the whole country and the
    list doesn't, or a region that the list lacks. Coverage counts documents and structured
    requirements; with unread documents it is partial, without any api_only.

    Every child is gathered by notice in a shuffle of its own and joined once, so notices with
    many documents and many regions don't multiply. A notice's rows bound its arrays.
    """
    read, unread = _gathered(readable(documents), _DOCUMENT, ["document_slot", "document_id"], "documents"), _gathered(unreadable(documents), _UNREAD, ["document_slot", "document_id"], "unavailable_documents")
    licensed = _gathered(licences, _LICENCE, ["restriction_group_number", "restriction_sequence", "source_record_hash"], "licenses")
    named = regions.select(*KEY, F.col("restriction_sequence").alias("sequence"), F.col("participation_region_code").alias("code"), F.col("participation_region_name").alias("name"), F.col("source_record_hash").alias("source_hash"))
    listed = _gathered(named, ["sequence", "code", "name", "source_hash"], ["sequence", "source_hash"], "_regions")
    out = notices
    for part in (read, unread, licensed, listed):
        out = out.join(part, list(KEY), "left")
    kinds = {f.name: f.dataType for d in (read, unread, licensed, listed) for f in d.schema.fields if f.name not in KEY}
    out = out.withColumn("_detailed", F.col("_regions").isNotNull()).withColumns({n: F.coalesce(n, F.array().cast(t)) for n, t in kinds.items()})

    code, name = F.col("region_code"), F.col("region_name")
    limited = code.isNotNull() & ~code.isin("", NATIONWIDE_CODE)
    limiting = F.filter("_regions", lambda r: ~r["code"].eqNullSafe(F.lit(NATIONWIDE_CODE)) & ~F.trim(r["name"]).eqNullSafe(F.lit(NATIONWIDE)))
    out = out.withColumn("_limiting", limiting)
    held = F.exists("_limiting", lambda r: F.coalesce(r["code"] == code, F.lit(False)) | F.coalesce((name != "") & (r["name"] == name), F.lit(False)))
    conflict = F.col("_detailed") & F.when(code == NATIONWIDE_CODE, F.size("_limiting") > 0).otherwise(limited & ~held)
    summary = F.array(F.struct(F.lit("summary").alias("sequence"), code.alias("code"), name.alias("name"), F.col("source_record_hash").alias("source_hash")))
    method = F.trim("consortium_method")
    consortium = F.array(F.struct(F.lit("method").alias("sequence"), method.alias("name"), F.col("source_record_hash").alias("source_hash")))
    out = out.withColumns({
        "regions": F.when((F.size("_limiting") == 0) & limited, summary).otherwise(F.col("_limiting")), "_conflict": F.coalesce(conflict, F.lit(False)),
        "consortiums": F.when(method.isNotNull() & ~method.isin(*NO_CONSORTIUM), consortium).otherwise(F.filter(consortium, lambda _c: F.lit(False))),
    })
    return out.select(*KEY, "documents", "unavailable_documents", "licenses", "regions", "consortiums", _coverage(limited).alias("coverage"))


def _coverage(limited: Column) -> Column:
    read, unread = F.size("documents"), F.size("unavailable_documents")
    source = F.when(F.col("_detailed"), "detailed_api").when(F.coalesce(limited, F.lit(False)), "notice_summary").otherwise("unrestricted_or_absent")
    return F.struct(
        F.when(read + unread == 0, "api_only").when(unread > 0, "partial").otherwise("complete").alias("completeness"), ((unread > 0) | F.col("_conflict")).alias("requires_review"),
        (read + unread).alias("total_document_count"), read.alias("parsed_document_count"), unread.alias("unavailable_document_count"),
        (F.size("licenses") + F.size("regions") + F.size("consortiums")).alias("structured_requirement_count"), source.alias("participation_region_source"), F.col("_conflict").alias("participation_region_conflict"),
    )
