"""Rules of bid notices as data: repairs of extracted requirements, and gates that bring back what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import recovery
from .facts import Repair
from .recovery import Gate, letters

MANUAL, MISSING, CONDITIONAL, INFORMATION = "manual_evidence_interpretation", "referenced_document_missing", "conditional_applicability_unknown", "informational_exclusion"

# The wording that repairs and gates look for.
BID_PRICE = r"예정(?:가격|금액)|견적(?:가격|금액)|투찰률|낙찰(?:하한율|가격)|(?:제한적\s*)?최저(?:가격|가)"
QUALIFICATIONS = ((r"벤처기업", "venture_business"), (r"이노비즈|기술혁신형\s*중소기업", "innobiz"), (r"메인비즈|경영혁신형\s*중소기업", "mainbiz"))
SOFTWARE = r"소프트웨어\s*사업자(?:\s*\([^)]*\))?"
INDUSTRY_CODE = r"업종\s*코드\s*[:：]?\s*\[?\s*(\d{4})\s*\]?"
BIDDER_CLAUSE = r"(?:본\s+용역사업.{0,80})?(?:부정당업자|부실업자).{0,100}?업체"
COMPANY_SCALES = {"소기업": "small_enterprise", "소상공인": "small_business_owner"}
SCALE_CLAUSE = r"[^\n.]{0,100}소기업\s*확인서[\s\S]{0,120}?또는[\s\S]{0,120}?소상공인\s*확인서[^\n.]{0,100}?(?:업체|자)"
FEASIBLE = r"[^\n.]{0,120}(?:연동|개발|제작|납품|이행)[^\n.]{0,120}(?:까지|내|內)[^\n.]{0,40}가능한\s*업체(?:\([^\n)]*\))?"
BULLET = r"^\s*(?:[-•·]|[가-하][.)])\s*"
MARKERS = {
    "sanction": r"부정당|입찰참가.{0,12}제한|참가자격.{0,12}제한|조세포탈|유죄|제재|처분",
    "consortium": r"공동수급|공동계약|공동도급|컨소시엄|단독이행|단독\s*참가",
}

#: A notice that consists of one sentence: industry and its code, region, certificate.
SIMPLE = (
    r"^\s*입찰참가자는\s+([^,]+?)\s*\(\s*(?:업종)?코드\s*[:：]?\s*(\d{4})\s*\)\s*등록업체로서\s+([가-힣]+(?:특별시|광역시|특별자치시|특별자치도|도))에\s+소재하고\s*,?\s*"
    r"(중소기업\s*확인서)를\s+소지하여야\s+한다[.。]?\s*$"
)

#: Java's pattern flags for what these patterns mean: classes of Unicode, lines that end at line feeds alone.
_FLAGS = "(?Ud)"


def said(pattern: str, column: str = "original_text") -> Column:
    return F.coalesce(F.col(column).rlike(_FLAGS + pattern), F.lit(False))


def is_a(*types: str) -> Column:
    return F.col("type").isin(*types)


def with_attribute(name: str, value: Column | str, *dropped: str) -> Column:
    """The attributes (array of name and value) without the dropped names, in any case, and with one more."""
    kept = F.filter(F.coalesce("attributes", F.array().cast("array<struct<name:string,value:string>>")), lambda a: ~F.lower(F.coalesce(a["name"], F.lit(""))).isin(*(dropped or (name,))))
    return F.concat(kept, F.array(F.struct(F.lit(name).alias("name"), (F.lit(value) if isinstance(value, str) else value).alias("value"))))


def _by_hand(confidence: float) -> dict[str, Column]:
    return {"comparison_mode": F.lit("manual"), "review_status": F.lit("needs_review"), "confidence": F.least("confidence", F.lit(confidence))}


def repairs() -> list[Repair]:
    """The semantic repairs, in their order.

    Rows have type, operator, holder_scope, comparison_mode, review_status, confidence,
    value_text, number, boolean, items, attributes, original_text, proposition_text and its
    places, structured (whether a structured source says it too), and missing (letters of the
    case's texts whose documents are missing).
    """
    own = letters(F.col("original_text"))
    auth = F.regexp_replace(F.concat_ws(" ", "original_text", F.coalesce("value_text", F.lit(""))), r"(?U)\s+", "")
    exception = F.exists(F.coalesce("attributes", F.array().cast("array<struct<name:string,value:string>>")), lambda a: (a["name"] == "authentication_method") & (a["value"] == "personal_certificate_exception"))
    several = F.size(F.coalesce("items", F.array().cast("array<string>"))) > 1
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(QUALIFICATIONS):
        kind = F.when(said(pattern), name).otherwise(kind)
    software = F.regexp_extract("original_text", _FLAGS + SOFTWARE, 0)
    code = F.regexp_extract("original_text", _FLAGS + INDUSTRY_CODE, 1)
    without_code = F.filter(F.coalesce("attributes", F.array().cast("array<struct<name:string,value:string>>")), lambda a: F.lower(a["name"]) != "industry_code")
    clause = F.regexp_extract("original_text", _FLAGS + BIDDER_CLAUSE, 0)
    begun = F.position(clause, F.col("original_text")) - 1
    kept = F.replace(F.coalesce("value_text", F.lit("")), F.lit(" 상실"), F.lit(" 유지"))
    return [
        Repair("bid_price", said(BID_PRICE, "proposition_text"), drop=True),
        Repair("missing_reference", ~F.coalesce("structured", F.lit(False)) & F.exists(F.coalesce("missing", F.array().cast("array<string>")), lambda m: m.contains(own) | own.contains(m)), drop=True),
        Repair(
            "reference_only_law",
            (F.col("review_status") == "needs_review") & said(r"(?:법률|시행령|시행규칙).{0,80}제\s*조") & said(r"(?:따른\s*자격요건|각\s*호에\s*해당)") & ~said(r"(?:별표|다음\s*각\s*호)\s*[:：]?\s*\n?\s*[①-⑳1-9가-하]"),
            drop=True, review=MISSING,
        ),
        Repair("legal_administration", is_a("sanction") & said(r"법정관리\s*중"), {"type": F.lit("legal_qualification"), "comparison_mode": F.lit("manual"), "attributes": with_attribute("excluded_status", "legal_administration", "sanction_type")}),
        Repair(
            "national_contract_law",
            is_a("custom") & said(r"(?:국가를\s*당사자로\s*하는\s*계약에\s*관한\s*법률|국가계약법)") & said(r"(?:시행령.{0,20}제\s*12\s*조|제12조)") & said(r"(?:소정의\s*자격|경쟁입찰\s*참가자격)"),
            {"type": F.lit("legal_qualification")},
        ),
        Repair(
            "manufacturer",
            is_a("custom") & said(r"(?:제조사|제작사|제조원).{0,24}(?:판권계약.{0,16})?(?:대리점|공급사|지사)|(?:대리점|공급사|지사).{0,24}(?:제조사|제작사|제조원)"),
            {"type": F.lit("manufacturer_status")},
        ),
        Repair(
            "retirees",
            is_a("custom") & said(r"(?:기관|진흥원|공단|연구원).{0,12}퇴직자") & said(r"(?:설립|임원|재취업).{0,30}(?:무효|제외|제한)|(?:무효|제외|제한).{0,30}(?:설립|임원|재취업)"),
            {"type": F.lit("legal_qualification")},
        ),
        Repair("institutional_debarment", said(r"부정[.\s]*당업체로\s*제재\s*중"), {"type": F.lit("sanction"), **_by_hand(0.8), "attributes": with_attribute("sanction_basis", "institutional_debarment", "excluded_status")}),
        Repair(
            "delivery_order",
            said(r"(?:업체|대상자)\s*선정\s*완료\s*후") & said(r"실제\s*납품\s*요청|납품\s*시") & said(r"주문.{0,30}(?:가능|불가능)|납품\s*대상\s*업체.{0,20}변경"),
            drop=True,
        ),
        Repair("qualification", kind.isNotNull() & is_a("business_status", "certificate", "legal_qualification", "custom"), {"type": F.lit("certificate"), "attributes": with_attribute("qualification_type", kind)}),
        Repair(
            "software_business",
            (software != "") & is_a("industry_license", "business_status", "certificate", "legal_qualification", "custom"),
            {"type": F.lit("industry_license"), "value_text": software, "attributes": F.when(code != "", with_attribute("industry_code", code)).otherwise(without_code)},
        ),
        Repair("agent", (F.col("holder_scope") == "representative") & said(r"입찰\s*대리인(?:의|인)?\s*경우"), drop=True, review=MANUAL),
        Repair(
            "personal_certificate",
            is_a("procurement_registration") & (exception | (auth.contains("지문인식신원확인") & auth.contains("곤란") & auth.contains("개인인증서") & (auth.contains("예외") | auth.contains("제출할수")))),
            drop=True,
        ),
        Repair("succession", is_a("legal_qualification") & said(r"입찰기간\s*중.{0,40}지위\s*승계") & said(r"(?:서류|증빙).{0,30}참가자격.{0,12}유지"), drop=True, review=MANUAL),
        Repair(
            "suspended_engineers",
            is_a("technical_personnel") & (F.col("holder_scope") == "bidder") & said(r"업무정지.{0,20}기술자|기술자.{0,20}업무정지") & said(r"기술자.{0,20}평가대상.{0,8}제외"),
            drop=True, review=INFORMATION, blocks=False,
        ),
        Repair(
            "rating_papers",
            is_a("credit_rating") & (F.col("operator") == "exists") & said(r"신용평가등급.{0,20}(?:기준|평가)") & said(r"(?:자료|등급).{0,20}제출|미준수.{0,12}(?:탈락|평가\s*불가)") & ~said(r"(?:등급|평점).{0,8}(?:이상|이하|[A-D][+-]?)"),
            drop=True, review=MANUAL,
        ),
        Repair(
            "rating_conduct",
            is_a("credit_rating") & said(r"(?:전송하지|요구[·ㆍ\s]*약속|이전의\s*유리한).{0,60}(?:평가자료|신용평가)") & said(r"(?:입찰을\s*무효|낙찰자에서\s*배제)"),
            drop=True, review=CONDITIONAL,
        ),
        Repair(
            "keeps_eligibility",
            is_a("sanction") & said(r"입찰참가자격.{0,20}유지") & ~said(r"부정당|조세포탈|유죄|제재|처분|업무정지|참가자격\s*제한"),
            {"type": F.lit("legal_qualification"), "operator": F.lit("valid_on"), "value_text": F.when(kept != "", kept).otherwise("입찰참가자격 유지"), "boolean": F.lit(True)},
        ),
        # Places first: the text that they are taken from is replaced last.
        Repair(
            "bidder_clause",
            is_a("sanction") & said(r"업체와.{0,40}기술자") & (clause != ""),
            {"proposition_start": begun, "proposition_end": begun + F.length(clause), "proposition_text": clause},
        ),
        Repair("several_registrations", is_a("procurement_registration") & several, _by_hand(0.7), review=MANUAL),
        Repair(
            "vague_performance",
            is_a("past_performance") & said(r"경험(?:과|\s*및)?\s*능력|실적") & F.col("number").isNull() & ~said(r"\d+\s*(?:건|회|년|개월|원|천원|만원|억원|%)"),
            _by_hand(0.7), review=MANUAL,
        ),
        Repair("several_statuses", is_a("business_status") & several, _by_hand(0.7), review=MANUAL),
        Repair("capability", is_a("custom") & said(r"(?i:(?:제작|납품|이행).{0,40}(?:능력|할\s*수)|품질보장|무상\s*(?:A/S|AS))"), _by_hand(0.7), review=MANUAL),
        Repair(
            "collusion",
            is_a("sanction") & said(r"(?:응찰|입찰).{0,30}(?:방해|담합)|입찰가격.{0,12}담합") & ~said(r"제재|제한기간|처분|유죄|확정"),
            {"type": F.lit("custom"), "operator": F.lit("custom"), **_by_hand(0.7)}, review=MANUAL,
        ),
    ]


_AUTHENTICATED = "type = 'procurement_registration' and (original_text like '%개인인증수단%' or exists(attributes, a -> a.name = 'authentication_method' and a.value = 'personal_authentication'))"
_REGISTERED = "type = 'procurement_registration' and exists(attributes, a -> a.name = 'procurement_registration_type' and a.value = 'supplier_registration')"
_ENTRY = {"holder_scope": "bidder", "reference_date_type": "bid_deadline", "assessment_stage": "bid_entry", "failure_effect": "cannot_bid", "comparison_mode": "manual"}


def _whole_number() -> Column:
    return F.col("number").cast("int").cast("string")


#: What notices say in so many words, and what it requires.
GATES = (
    Gate(
        "personal_authentication",
        _FLAGS + r"신원확인\s*입찰이\s*적용[\s\S]{0,220}?개인인증수단을\s*이용[\s\S]{0,100}?신원을\s*확인받은\s*후\s*입찰에\s*참여하여야\s*합니다",
        _ENTRY | {"type": "procurement_registration", "operator": "exists", "value_text": "나라장터 개인인증수단을 통한 신원확인", "holder_scope": "representative"},
        {"authentication_method": "personal_authentication"}, known=_AUTHENTICATED, column="joined",
    ),
    Gate(
        "equipment", _FLAGS + r"(?:「([^」]{2,60})」|([가-힣A-Za-z0-9ㆍ·‧()\s]{2,60}?))\s*(\d+)\s*대\s*이상(?:을)?\s*보유",
        _ENTRY | {"type": "equipment_ownership", "operator": "greater_than_or_equal", "comparison_mode": "structured", "value_text": lambda: F.concat("name", F.lit(" "), _whole_number(), F.lit("대 이상 보유"))},
        {"equipment_name": lambda: F.col("name")}, said="type = 'equipment_ownership'", once="text", number=3, names=(1, 2),
        heading=_FLAGS + r"(?:입찰|견적(?:서)?\s*제출?)\s*참가\s*자격|입찰참가자격",
    ),
    Gate(
        "supplier_registration",
        _FLAGS + r"(?:조달청|나라장터|국가종합전자조달시스템).{0,20}입찰참가(?:자격)?\s*(?:미\s*)?등록(?:[\s\S]{0,220}?등록하여야\s*합니다\.?|[^\n.]{0,80}?(?:업체|자)(?=[,.\s]|$))",
        _ENTRY | {"type": "procurement_registration", "operator": "exists", "value_text": "조달청 입찰참가자격 등록", "comparison_mode": "structured"},
        {"procurement_registration_type": "supplier_registration"}, known=_REGISTERED,
    ),
    Gate(
        "tax_evasion",
        _FLAGS + r"조세포탈\s*등을\s*한\s*자로서[\s\S]{0,100}?유죄판결이\s*확정된\s*날부터\s*2년이\s*지나지\s*아니한\s*자는[\s\S]{0,40}?(?:입찰|견적제출)에\s*(?:참여|참가)할\s*수\s*(?:없음|없습니다)",
        _ENTRY | {"type": "sanction", "operator": "not_exists", "value_text": "조세포탈 등 유죄판결 확정일부터 2년 미경과 상태"},
        {"lookback_unit": "years"}, known="type = 'sanction' and original_text like '%조세포탈%'",
    ),
    Gate(
        "score",
        _FLAGS + r"[^\n.]{0,100}(?:종합평점|기술능력평가(?:\s*분야)?(?:\s*점수)?)[^\n.]{0,80}?(?:100점\s*만점에\s*)?(\d{2,3})\s*(%|점)\s*이상[^\n.]{0,100}?(?:적격업체|협상적격자|협상\s*실시)",
        _ENTRY | {"type": "custom", "operator": "greater_than_or_equal", "value_text": lambda: F.col("original_text"), "reference_date_type": "none", "assessment_stage": "qualification_review", "failure_effect": "qualification_rejection"},
        {"score_unit": lambda: F.when(F.col("name") == "%", "percent").otherwise("points")},
        known="assessment_stage = 'qualification_review' and original_text rlike '적격|협상'", once="number", number=1, names=(2,),
    ),
    Gate(
        "bankruptcy_at_entry", _FLAGS + r"부도\s*또는\s*파산\s*상태에\s*있는\s*업체는.{0,30}?(?:입찰|견적제출)에\s*참가할\s*수\s*없(?:으며|습니다|음)",
        _ENTRY | {"type": "business_status", "operator": "not_exists", "value_text": "부도 또는 파산 상태", "reference_date_type": "none"},
        known="type = 'business_status' and assessment_stage = 'bid_entry' and original_text rlike '부도|파산'",
    ),
    Gate(
        "bankruptcy_at_contract", _FLAGS + r"낙찰\s*후\s*계약\s*체결\s*전에.{0,50}?부도\s*또는\s*파산\s*상태에\s*있는\s*업체.{0,30}?계약\s*체결\s*대상에서\s*제외(?:함|됩니다)",
        _ENTRY | {"type": "business_status", "operator": "not_exists", "value_text": "부도 또는 파산 상태", "reference_date_type": "contract_date", "assessment_stage": "contracting", "failure_effect": "cannot_contract"},
        known="type = 'business_status' and assessment_stage = 'contracting' and original_text rlike '부도|파산'",
    ),
    Gate(
        "borrowed_certificate", _FLAGS + r"1인이\s*수인의\s*공인인증서를\s*차용하여\s*입찰서를\s*제출할\s*경우[\s\S]{0,220}?무효인\s*입찰에\s*해당되며?",
        _ENTRY | {"type": "procurement_registration", "operator": "custom", "value_text": "타인의 공인인증서를 차용하여 입찰서를 제출하지 않아야 함", "reference_date_type": "none", "failure_effect": "invalid_bid"},
        said="true", further=True, once="text",
    ),
    Gate(
        "shared_representative",
        _FLAGS + r"(?:한\s*업체의\s*소속\s*)?대표자\s*중\s*1인이\s*다른\s*업체의\s*대표자를\s*겸임[\s\S]{0,180}?(?:동시\s*참여|동시에\s*참여)[\s\S]{0,160}?(?:모두\s*무효|입찰\s*무효)",
        _ENTRY | {"type": "custom", "operator": "not_exists", "value_text": "동일 대표자가 겸임하는 여러 업체의 동시 입찰 참여", "failure_effect": "invalid_bid"},
        {"conflict_type": "shared_representative_simultaneous_bidding"}, said="true", once="text", prunes=True,
    ),
    Gate(
        "legal_administration", _FLAGS + r"[^\n.]{0,20}법정관리\s*중이거나[\s\S]{0,140}?부정[.\s]*당업체로\s*제재\s*중인\s*업체는\s*참여할\s*수\s*없다",
        _ENTRY | {"type": "legal_qualification", "operator": "not_equals", "value_text": "법정관리 중이 아님"},
        {"excluded_status": "legal_administration"}, known=r"regexp_replace(coalesce(proposition_text, original_text), '[^\\p{L}\\p{N}]', '') like '%법정관리중%'", proposition=_FLAGS + r"법정관리\s*중",
    ),
)


def recovered(blocks: DataFrame, requirements: DataFrame, case: str, unresolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requirements that ``GATES`` recover, and the unresolved candidates (case, text) that are left with those that blocks about eligibility add.

    ``blocks`` have case, document, block_index, parent, section and text. Texts are compared as
    they stand, by letters and digits.
    """
    rows, texts = recovery.with_next(blocks, [case, "document"]), unresolved.select(case, "text")
    every = recovery.recovered(rows, requirements, GATES, case, texts)
    about = F.regexp_replace(F.coalesce("section", F.lit("")), " ", "").contains("참가자격") | F.col("text").contains("입찰 참가자격")
    told = requirements.select(case, F.col("original_text").alias("text")).union(every.select(case, "original_text")).union(texts)
    added = recovery.candidates(rows.where(about), _FLAGS + FEASIBLE, case, told, BULLET, 12)
    return every, recovery.pruned(texts, every, GATES, case).union(added.select(case, "text"))


def simple_facts(blocks: DataFrame, structured: DataFrame, case: str) -> DataFrame:
    """The three requirements of cases that are recognised whole: one document of one block that is the sentence ``SIMPLE``, and no structured requirements (case).

    Columns: case, id, type, operator, value_text, attributes, proposition_text and its places,
    original_text, document, block_index. Anything else in a case leaves it to other ways.
    """
    text, pattern = F.col("text"), _FLAGS + SIMPLE.replace("$", r"\z")
    alone = blocks.groupBy(case).agg(F.count("*").alias("_n"), F.first("document").alias("document"), F.first("block_index").alias("block_index"), F.first("text").alias("text"))
    hits = alone.where((F.col("_n") == 1) & text.rlike(pattern)).join(structured.select(case).distinct(), case, "left_anti")
    industry, code, region, certificate = (F.regexp_extract(text, pattern, i) for i in range(1, 5))

    def said(i: int, kind: str, operator: str, value: Column, head: str, attributes: dict[str, Column | str]) -> Column:
        proposition = F.regexp_extract(text, f"{_FLAGS}{head}", 0)
        start = F.position(proposition, text) - 1
        named = F.create_map(*[x for n, v in attributes.items() for x in (F.lit(n), F.lit(v) if isinstance(v, str) else v)])
        return F.struct(F.lit(f"r{i}").alias("id"), F.lit(kind).alias("type"), F.lit(operator).alias("operator"), value.alias("value_text"), named.alias("attributes"), proposition.alias("proposition_text"), start.alias("proposition_start"), (start + F.length(proposition)).alias("proposition_end"))

    each = F.array(
        said(1, "industry_license", "exists", industry, r"(?<=입찰참가자는\s)(?=\S)[^,]+?\s*\(\s*(?:업종)?코드\s*[:：]?\s*\d{4}(?:\s|\))", {"industry_name": industry, "industry_code": code}),
        said(2, "participation_region", "in", region, r"[가-힣]+(?:특별시|광역시|특별자치시|특별자치도|도)에\s+소재하고", {"region_name": region}),
        said(3, "certificate", "exists", certificate, r"중소기업\s*확인서를\s+소지하여야\s+한다", {"certificate_type": "small_business_confirmation"}),
    )
    rows = hits.select(case, "document", "block_index", text.alias("original_text"), F.explode(each).alias("_f"))
    return rows.select(case, "_f.*", "original_text", "document", "block_index")


def scale_clauses(blocks: DataFrame, case: str) -> DataFrame:
    """case, block and clause where a small enterprise or a small business owner will do, for ``recovery.alternatives`` with COMPANY_SCALES."""
    each = F.explode(F.regexp_extract_all("text", F.lit(_FLAGS + SCALE_CLAUSE), F.lit(0)))
    return blocks.select(case, F.col("block_index").alias("block"), each.alias("clause")).withColumn("clause", F.trim("clause"))
