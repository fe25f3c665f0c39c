"""Landed provider records (operation_id, payload as JSON text, source_record_hash) to normalised relations.

A payload is read once into a struct of texts; each relation is a projection of it, and lists
inside a record become rows of their own relation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.hashing import uuid5

# Operations, what they list, codes of regions, and the fields of payloads.
NOTICE_TYPES = {
    "list_construction_bid_notices": "construction",
    "list_service_bid_notices": "service",
    "list_foreign_bid_notices": "foreign",
    "list_goods_bid_notices": "goods",
    "list_other_bid_notices": "other",
}
LICENSE_OPERATION = "list_license_restrictions"
REGION_OPERATION = "list_participation_regions"
CONTRACT_TYPES = {
    "list_goods_contracts": "goods",
    "list_construction_contracts": "construction",
    "list_service_contracts": "service",
    "list_foreign_procurement_contracts": "foreign_procurement",
}
REGION_CODES = {
    "전국": "00", "서울특별시": "11", "부산광역시": "26", "대구광역시": "27", "인천광역시": "28", "광주광역시": "29", "대전광역시": "30", "울산광역시": "31",
    "세종특별자치시": "36", "경기도": "41", "강원도": "42", "충청북도": "43", "충청남도": "44", "전라북도": "45", "전라남도": "46", "경상북도": "47",
    "경상남도": "48", "제주도": "50", "제주특별자치도": "50", "강원특별자치도": "51", "전북특별자치도": "52", "기타": "99",
}
NATIONWIDE_CODE, NATIONWIDE_NAME = "00", "전국"
STANDARD_NOTICE, SITE_EXPLANATION = "표준공고서", "현장설명서"
NOTICE_FIELDS = {
    "notice_number": "bidNtceNo", "notice_order": "bidNtceOrd", "notice_name": "bidNtceNm", "notice_kind_name": "ntceKindNm", "registration_type_name": "rgstTyNm",
    "is_re_notice": "reNtceYn", "notice_published_at": "bidNtceDt", "bid_begin_at": "bidBeginDt", "bid_deadline_at": "bidClseDt", "opening_at": "opengDt",
    "notice_organization_code": "ntceInsttCd", "notice_organization_name": "ntceInsttNm", "demand_organization_code": "dminsttCd", "demand_organization_name": "dminsttNm",
    "bid_method_name": "bidMethdNm", "contract_method_name": "cntrctCnclsMthdNm", "estimated_price": "presmptPrce", "allocated_budget": "asignBdgtAmt",
    "detail_url": "bidNtceDtlUrl", "notice_url": "bidNtceUrl", "standard_document_url": "stdNtceDocUrl", "participation_restriction_region_code": "prtcptLmtRgnCd",
    "participation_restriction_region_name": "prtcptLmtRgnNm", "source_registered_at": "rgstDt", "source_changed_at": "chgDt",
}
LICENSE_FIELDS = {
    "notice_number": "bidNtceNo", "notice_order": "bidNtceOrd", "restriction_group_number": "lmtGrpNo", "restriction_sequence": "lmtSno", "license_restriction_name": "lcnsLmtNm",
    "permitted_industry_list": "permsnIndstrytyList", "industry_main_field_list": "indstrytyMfrcFldList", "business_type_name": "bsnsDivNm", "source_registered_at": "rgstDt",
}
REGION_FIELDS = {
    "notice_number": "bidNtceNo", "notice_order": "bidNtceOrd", "restriction_sequence": "lmtSno", "participation_region_name": "prtcptPsblRgnNm",
    "business_type_name": "bsnsDivNm", "source_registered_at": "rgstDt",
}
INDUSTRY_FIELDS = {
    "industry_code": "indstrytyCd", "industry_name": "indstrytyNm", "classification_code": "indstrytyClsfcCd", "classification_name": "indstrytyClsfcNm",
    "base_law_name": "baseLawordNm", "base_law_article": "baseLawordArtclClauseNm", "base_law_url": "baseLawordUrl", "related_regulation_contents": "rltnRgltCntnts",
    "included_license_text": "inclsnLcns", "source_use_yn": "indstrytyUseYn", "source_registered_at": "indstrytyRgstDt", "source_changed_at": "indstrytyChgDt",
}
CONTRACT_FIELDS = {
    "unified_contract_number": "untyCntrctNo", "confirmed_contract_number": "dcsnCntrctNo", "contract_reference_number": "cntrctRefNo", "contract_name": "cntrctNm",
    "is_joint_contract": "cmmnCntrctYn", "long_term_continuation_type": "lngtrmCtnuDivNm", "concluded_date": "cntrctCnclsDate", "contract_date": "cntrctDate",
    "contract_period_text": "cntrctPrd", "basis_law_name": "baseLawNm", "total_amount": "totCntrctAmt", "total_amount_currency": "totCntrctAmtCrncy",
    "current_contract_amount": "thtmCntrctAmt", "current_contract_amount_currency": "thtmCntrctAmtCrncy", "guarantee_deposit_rate": "grntymnyRate",
    "payment_method_name": "payDivNm", "request_number": "reqNo", "notice_number": "ntceNo", "contract_method_name": "cntrctCnclsMthdNm",
    "contracting_organization_code": "cntrctInsttCd", "contracting_department_name": "cntrctInsttChrgDeptNm", "procurement_classification_number": "pubPrcrmntClsfcNo",
    "procurement_classification_name": "pubPrcrmntClsfcNm", "contract_information_url": "cntrctInfoUrl", "contract_detail_url": "cntrctDtlInfoUrl",
    "source_registered_at": "rgstDt", "source_changed_at": "chgDt",
}
SUPPLIER_PLACES = {
    "supplier_sequence": 0, "supplier_role_name": 1, "joint_contract_method_name": 2, "supplier_name": 3, "representative_name": 4, "nationality_name": 5,
    "participation_share_rate": 6, "creditor_name": 7, "supplier_manager_name": 8, "business_registration_number": 9,
}
DEMAND_PLACES = {"demand_organization_sequence": 0, "organization_code": 1, "department_name": 4, "manager_name": 5, "telephone_number": 6}
DEFAULT_CURRENCY = "KRW"

_CLEANERS: dict[str, Callable[[Column], Column]] = {
    **dict.fromkeys(("is_re_notice", "is_joint_contract"), codecs.yes_no),
    **dict.fromkeys(("notice_published_at", "bid_begin_at", "bid_deadline_at", "opening_at", "source_registered_at", "source_changed_at"), codecs.parse_datetime),
    **dict.fromkeys(("estimated_price", "allocated_budget", "total_amount", "current_contract_amount", "guarantee_deposit_rate", "participation_share_rate"), codecs.to_number),
    **dict.fromkeys(("concluded_date", "contract_date"), codecs.parse_date),
    **dict.fromkeys(("supplier_sequence", "demand_organization_sequence"), codecs.to_integer),
    "business_registration_number": lambda c: codecs.digits(c),
}


def _cleaned(name: str, value: Column) -> Column:
    return _CLEANERS.get(name, codecs.text)(value)


def _read(records: DataFrame, keys: set[str]) -> DataFrame:
    """The records with v, a struct of the payload's texts.

    The struct is a row of its own: else the optimiser would put the parsing in the place of
    every use of every field, and into the conditions that it moves down.
    """
    parsed = F.from_json("payload", ", ".join(f"`{k}` string" for k in sorted(keys)))
    return records.withColumn("v", F.explode(F.array(parsed)))


def _required(columns: list[str], what: str) -> Column:
    """Raises where one of the columns is null."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return F.when(missing, F.raise_error(F.lit(f"{what} without {' or '.join(columns)}"))).otherwise(F.lit(True))


def routed(records: DataFrame) -> DataFrame:
    """The records with kind: notice, license, region, contract; another operation raises."""
    op = F.col("operation_id")
    kind = F.when(op.isin(*NOTICE_TYPES), "notice").when(op == LICENSE_OPERATION, "license").when(op == REGION_OPERATION, "region").when(op.isin(*CONTRACT_TYPES), "contract")
    return records.withColumn("kind", F.coalesce(kind, F.raise_error(F.concat(F.lit("unsupported operation "), F.coalesce(op, F.lit(""))))))


def _of_notice(records: DataFrame, fields: dict[str, str], extra: set[str] = frozenset()) -> DataFrame:
    read = _read(records, set(fields.values()) | extra)
    out = read.select("operation_id", "source_record_hash", "v", *[_cleaned(n, F.col("v")[k]).alias(n) for n, k in fields.items()])
    return out.where(_required(["notice_number", "notice_order"], "a record"))


def notices(records: DataFrame) -> DataFrame:
    """One row for each notice record."""
    out = _of_notice(records, NOTICE_FIELDS, {"bdgtAmt"})
    budget = F.coalesce("allocated_budget", codecs.to_number(F.col("v.bdgtAmt")))
    return out.withColumns({"work_type": codecs.coded(F.col("operation_id"), NOTICE_TYPES), "allocated_budget": budget}).drop("v", "operation_id")


def notice_documents(records: DataFrame) -> DataFrame:
    """One row for each document slot with an address: ten specifications, the standard notice, five site explanations."""
    specs = [(f"notice_spec_{i}", f"ntceSpecFileNm{i}", f"ntceSpecDocUrl{i}") for i in range(1, 11)]
    sites = [(f"site_explanation_{i}", f"sptDscrptDocUrl{i}") for i in range(1, 6)]
    keys = {k for s in specs for k in s[1:]} | {k for _, k in sites} | {"stdNtceDocUrl"}
    read = _of_notice(records, {n: NOTICE_FIELDS[n] for n in ("notice_number", "notice_order")}, keys)
    v = F.col("v")
    slots = [(slot, codecs.text(v[name]), codecs.text(v[url])) for slot, name, url in specs]
    slots.append(("standard_notice", F.lit(STANDARD_NOTICE), codecs.text(v["stdNtceDocUrl"])))
    slots += [(slot, F.lit(f"{SITE_EXPLANATION}{slot[-1]}"), codecs.text(v[url])) for slot, url in sites]
    each = F.array(*[F.struct(F.lit(s).alias("document_slot"), n.alias("file_name"), u.alias("source_url")) for s, n, u in slots])
    rows = read.select("notice_number", "notice_order", F.explode(F.filter(each, lambda x: x["source_url"].isNotNull())).alias("d")).select("notice_number", "notice_order", "d.*")
    last = F.nullif(F.regexp_extract("source_url", r"([^/]*)/*$", 1), F.lit(""))
    name = F.concat_ws(":", F.lit("pps-bid-document"), "notice_number", "notice_order", "document_slot", "source_url")
    return rows.withColumns({"file_name": F.coalesce("file_name", last), "document_id": uuid5(name)})


def license_restrictions(records: DataFrame) -> DataFrame:
    out = _of_notice(records, LICENSE_FIELDS)
    zero = {c: F.coalesce(c, F.lit("0")) for c in ("restriction_group_number", "restriction_sequence")}
    return out.withColumns(zero).drop("v", "operation_id")


def region_code(name: Column) -> Column:
    return codecs.coded(name, REGION_CODES)


def participation_regions(records: DataFrame) -> DataFrame:
    out = _of_notice(records, REGION_FIELDS)
    return out.withColumns({"restriction_sequence": F.coalesce("restriction_sequence", F.lit("0")), "participation_region_code": region_code(F.col("participation_region_name"))}).drop("v", "operation_id")


def industries(records: DataFrame, now: Column) -> DataFrame:
    """The industries of a full snapshot; active where the source says Y."""
    read = _read(records, set(INDUSTRY_FIELDS.values()))
    fields = [F.col("v")[k].alias(n) for n, k in INDUSTRY_FIELDS.items()]
    return read.select(*fields, now.alias("first_seen_at"), now.alias("last_seen_at"), (F.coalesce(F.col("v.indstrytyUseYn"), F.lit("")) == "Y").alias("is_active"), "source_record_hash")


def _contracts(records: DataFrame) -> DataFrame:
    read = _read(records, set(CONTRACT_FIELDS.values()) | {"cnstwkNm", "corpList", "dminsttList", "cntrctInsttNm", "cntrctInsttJrsdctnDivNm"})
    return read.withColumn("unified_contract_number", codecs.text(F.col("v.untyCntrctNo"))).where(_required(["unified_contract_number"], "a contract"))


def contracts(records: DataFrame) -> DataFrame:
    """One row for each contract record; amounts without a currency are in the default one, but for foreign procurement."""
    read = _contracts(records).withColumn("contract_type", codecs.coded(F.col("operation_id"), CONTRACT_TYPES))
    out = read.select("contract_type", "source_record_hash", "v", *[_cleaned(n, F.col("v")[k]).alias(n) for n, k in CONTRACT_FIELDS.items()])
    default = F.when(F.col("contract_type") != "foreign_procurement", DEFAULT_CURRENCY)
    currencies = {c: F.coalesce(c, default) for c in ("total_amount_currency", "current_contract_amount_currency")}
    return out.withColumns({**currencies, "contract_name": F.coalesce("contract_name", codecs.text(F.col("v.cnstwkNm")))}).drop("v")


def _listed(records: DataFrame, key: str, arity: int) -> DataFrame:
    return _contracts(records).select("unified_contract_number", F.explode(codecs.bracket_list(F.col("v")[key], arity)).alias("f"))


def contract_suppliers(records: DataFrame) -> DataFrame:
    return _listed(records, "corpList", 10).select("unified_contract_number", *[_cleaned(n, F.col("f")[i]).alias(n) for n, i in SUPPLIER_PLACES.items()])


def contract_demands(records: DataFrame) -> DataFrame:
    return _listed(records, "dminsttList", 7).select("unified_contract_number", *[_cleaned(n, F.col("f")[i]).alias(n) for n, i in DEMAND_PLACES.items()])


def contract_organizations(records: DataFrame, order: Column) -> DataFrame:
    """The organisations that contracts name, one row for each code: the last by ``order``, then contract, those that demand after the one that contracts."""
    own = _contracts(records).withColumn("o", order)
    first = own.select("o", "unified_contract_number", F.lit(0).alias("at"), codecs.text(F.col("v.cntrctInsttCd")).alias("organization_code"), codecs.text(F.col("v.cntrctInsttNm")).alias("organization_name"), codecs.text(F.col("v.cntrctInsttJrsdctnDivNm")).alias("jurisdiction_type"))
    more = own.select("o", "unified_contract_number", F.posexplode(codecs.bracket_list(F.col("v.dminsttList"), 7)).alias("p", "f"))
    rest = more.select("o", "unified_contract_number", F.col("p") + 1, *[codecs.text(F.col("f")[i]) for i in (1, 2, 3)])
    every = first.union(rest).where("organization_code is not null")
    last = F.struct("organization_name", "jurisdiction_type")
    return every.groupBy("organization_code").agg(F.max_by(last, F.struct("o", "unified_contract_number", "at")).alias("l")).select("organization_code", "l.*")


def _limits() -> Column:
    code, name = F.col("participation_region_code"), F.col("participation_region_name")
    return ~code.eqNullSafe(F.lit(NATIONWIDE_CODE)) & ~name.eqNullSafe(F.lit(NATIONWIDE_NAME))


def limiting_regions(regions: DataFrame) -> DataFrame:
    """Regions that restrict: neither the code nor the name of the whole country."""
    return regions.where(_limits())


def region_conflicts(notices_: DataFrame, regions: DataFrame) -> DataFrame:
    """notice_number, notice_order, regions and region_conflict of every notice.

    The summary and the detailed list conflict if the summary says the whole country and the
    list restricts, or if the summary restricts and the list doesn't hold its region. Without
    a restricting list the summary's region stands for it.
    """
    key = ["notice_number", "notice_order"]
    one = F.struct("restriction_sequence", F.col("participation_region_code").alias("code"), F.col("participation_region_name").alias("name"))
    lists = regions.groupBy(*key).agg(F.lit(True).alias("detailed"), F.array_sort(F.collect_list(F.when(_limits(), one))).alias("list"))
    n = notices_.select(*key, F.col("participation_restriction_region_code").alias("code"), F.col("participation_restriction_region_name").alias("name")).join(lists, key, "left")
    own = F.coalesce("list", F.array().cast("array<struct<restriction_sequence:string,code:string,name:string>>"))
    limits = F.coalesce(F.col("code").isNotNull() & ~F.col("code").isin("", NATIONWIDE_CODE), F.lit(False))
    held = F.exists(own, lambda r: F.coalesce(r["code"] == F.col("code"), F.lit(False)) | F.coalesce((F.col("name") != "") & (r["name"] == F.col("name")), F.lit(False)))
    conflict = F.coalesce(F.col("detailed"), F.lit(False)) & ((F.coalesce(F.col("code") == NATIONWIDE_CODE, F.lit(False)) & (F.size(own) > 0)) | (limits & ~held))
    summary = F.array(F.struct(F.lit("summary").alias("restriction_sequence"), F.col("code").alias("code"), F.col("name").alias("name")))
    return n.select(*key, F.when((F.size(own) == 0) & limits, summary).otherwise(own).alias("regions"), conflict.alias("region_conflict"))
