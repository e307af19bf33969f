"""Registered queries: filing text, facts, mentions and analysis JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import text as X
from tidewatch.operators import feeds as J
from tidewatch.plans.decision_queries import _MISS, _n
from tidewatch.plans.registry import query
from tidewatch.sources import feeds as S

_ITEMS = "list_filter(l, lambda x, i: list_position(l, x) = i)"
_L = "it AS (SELECT *, regexp_extract_all(text, '(?i)Item\\s+(\\d+\\.\\d+)', 1) AS l FROM filings)"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'" if "\n" not in s else "chr(10)" if s == "\n" else "concat(chr(10), chr(10))"


def _strip(col: str) -> str:
    out = col
    for pattern, replacement in X.HTML_STEPS:
        out = f"regexp_replace({out}, {_sql_text(pattern)}, {_sql_text(replacement)}, 'g')"
    return out


@query("t1_detect_items", "filings", _L + f" SELECT accession, array_to_string({_ITEMS}, ',') AS items, CAST(len({_ITEMS}) AS INT) AS n FROM it")
def t1(t):
    items = X.detect_items(F.col("text"))
    return t.filings.select("accession", F.array_join(items, ",").alias("items"), F.size(items).alias("n"))


@query(
    "t2_item_section", "filings",
    _L + f""", s AS (SELECT accession, text, l[1] AS item, CASE WHEN len(l) > 0 THEN regexp_extract(text, concat('(?is)(Item\\s+', replace(l[1], '.', '\\.'), '[^\\d].*?)(?:Item\\s+\\d+\\.\\d+|SIGNATURES|\\z)'), 1) END AS sec FROM it)
    SELECT accession, item, left({_strip("CASE WHEN coalesce(sec, '') <> '' THEN sec ELSE text END")}, 50000) AS section FROM s""",
)
def t2(t):
    rows = t.filings.withColumn("item", F.get(X.detect_items(F.col("text")), F.lit(0)))
    return rows.select("accession", "item", X.item_section(F.col("text"), F.coalesce("item", F.lit("-"))).alias("section"))


@query("t3_strip_html", "", f"SELECT page_id, {_strip('html')} AS body FROM pages")
def t3(t):
    return t.raw("pages").select("page_id", X.strip_html(F.col("html")).alias("body"))


_G = "gs AS (SELECT accession, text, " + ", ".join(f"{_n(k)} AS n_{k}" for k in X.GUIDANCE_PATTERNS) + " FROM filings)"


def _frag(kind: str, label: str) -> str:
    p = X.GUIDANCE_PATTERNS[kind].replace("'", "''")
    return f"CASE WHEN n_{kind} > 0 THEN concat('{label}: ', trim(left(regexp_extract_all(text, '{p}')[1], 200))) END"


@query(
    "t4_guidance_status", "filings",
    _G + f""" SELECT accession, n_affirm > 0 AS has_affirmation, n_affirm_adjusted > 0 AS affirms_adjusted, n_lower > n_lower_gaap AS has_lowering, n_lower > 0 AND n_lower_gaap = n_lower AS lowers_gaap_only, n_raise > 0 AS has_raising, n_withdraw > 0 AS has_withdrawal,
    concat_ws(' | ', coalesce({_frag('affirm_adjusted', 'AFFIRMS_ADJUSTED')}, {_frag('affirm', 'AFFIRMS')}), coalesce({_frag('lower_gaap', 'LOWERS_GAAP')}, {_frag('lower', 'LOWERS')}), {_frag('raise', 'RAISES')}, {_frag('withdraw', 'WITHDRAWS')}) AS fragments FROM gs""",
)
def t4(t):
    g = S.spread_documents(t.filings.select("accession", "text")).select("accession", X.guidance_status(F.col("text")).alias("g"))
    flags = ("has_affirmation", "affirms_adjusted", "has_lowering", "lowers_gaap_only", "has_raising", "has_withdrawal")
    return g.select("accession", *[f"g.{f}" for f in flags], F.array_join("g.fragments", " | ").alias("fragments"))


@query("t5_guidance_floor", "filings", _G + " SELECT accession, (n_affirm > 0 OR n_affirm_adjusted > 0) AND n_withdraw = 0 AND NOT n_lower > n_lower_gaap AS enforce FROM gs")
def t5(t):
    g = S.spread_documents(t.filings.select("accession", "text")).select("accession", X.guidance_status(F.col("text")).alias("g"))
    return g.select("accession", X.guidance_floor(F.col("g")).alias("enforce"))


def _amounts(p: str) -> str:
    p = p.replace("'", "''")
    return (
        f"list_transform(list_zip(regexp_extract_all(text, '{p}', 1), regexp_extract_all(text, '{p}', 2)), lambda z: CAST(regexp_extract(replace(z[1], ',', ''), '^[0-9]+(\\.[0-9]+)?') AS DOUBLE) * "
        "CASE WHEN lower(z[2]) LIKE 'b%' THEN 1e9 WHEN lower(z[2]) LIKE 'm%' THEN 1e6 ELSE 1e0 END)"
    )


@query(
    "t6_reported_revenue", "filings",
    f"SELECT accession, list_max(list_filter(list_concat({_amounts(X._REVENUE_RES[0])}, {_amounts(X._REVENUE_RES[1])}), lambda v: v >= 1000000)) AS revenue FROM filings",
)
def t6(t):
    return t.filings.select("accession", X.reported_revenue(F.col("text")).alias("revenue"))


def _eps() -> str:
    parts = []
    for p in X._EPS_RES:
        v = f"TRY_CAST(nullif(regexp_extract(text, '{p}', 1), '') AS DOUBLE)"
        parts.append(f"CASE WHEN abs({v}) <= 100 THEN {v} END")
    return f"coalesce({', '.join(parts)})"


@query("t7_reported_eps", "filings", f"SELECT accession, {_eps()} AS eps FROM filings")
def t7(t):
    return t.filings.select("accession", X.reported_eps(F.col("text")).alias("eps"))


@query("t8_missing_data_facts", "filings", f"SELECT accession, len(list_filter(string_split(text, '. '), lambda x: regexp_matches(x, '{_MISS}'))) AS n FROM filings")
def t8(t):
    return t.filings.select("accession", F.size(X.missing_data_facts(F.split("text", r"\. "))).cast("bigint").alias("n"))


@query(
    "t9_mention_symbols", "mentions tickers",
    """w AS (SELECT DISTINCT external_id, unnest(list_concat(list_transform(regexp_extract_all(body, '\\$[A-Z][A-Z0-9]{0,5}\\b'), lambda x: x[2:]), regexp_extract_all(body, '\\b[A-Z][A-Z0-9]{0,5}\\b'))) AS symbol FROM mentions)
    SELECT external_id, symbol FROM w WHERE symbol IN (SELECT symbol FROM tickers)""",
)
def t9(t):
    return J.mention_symbols(t.mentions, t.tickers)


# Raw model responses of filings; some are fenced, some break a rule.
RAW_ANALYSIS = (
    "concat(CASE WHEN doc_id % 2 = 0 THEN concat('```json', chr(10)) ELSE '' END, '{\"price_impact\":{\"direction\":\"', CASE doc_id % 7 WHEN 0 THEN 'sideways' WHEN 1 THEN 'positive' ELSE 'negative' END, "
    "'\",\"magnitude\":\"high\",\"confidence\":', CAST(doc_id % 12 AS STRING), 'e-1,\"time_horizon\":\"immediate\"},\"conviction\":', CAST(doc_id % 25 AS STRING), 'e-1,\"summary\":\"', CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang END, "
    "'\",\"conclusion\":\"c\",\"key_facts\":[', CASE WHEN doc_id % 13 = 0 THEN '' ELSE '\"EPS $1.2 million\",\"exhibit not available\"' END, '],\"catalyst_type\":\"earnings\",\"requires_immediate_attention\":', CASE WHEN doc_id % 17 = 0 THEN 'null' ELSE 'true' END, '}', "
    "CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), '```') ELSE '' END, CASE WHEN doc_id % 19 = 0 THEN 'x' ELSE '' END)"
)
_RAW = f"""rw AS (SELECT doc_id, {RAW_ANALYSIS} AS raw FROM documents), st AS (SELECT doc_id, trim(regexp_replace(regexp_replace(raw, '(?i)^```json?\\s*', ''), '\\s*```$', '')) AS js FROM rw),
  js AS (SELECT doc_id, CASE WHEN json_valid(js) THEN js END AS j FROM st),
  va AS (SELECT doc_id, j, coalesce(j->>'$.price_impact.direction' IN ('positive', 'negative', 'neutral') AND CAST(j->>'$.price_impact.confidence' AS DOUBLE) BETWEEN 0 AND 1 AND CAST(j->>'$.conviction' AS DOUBLE) BETWEEN -2 AND 2
    AND length(j->>'$.summary') >= 1 AND json_array_length(j, '$.key_facts') BETWEEN 1 AND 10 AND (j->>'$.requires_immediate_attention') IS NOT NULL, false) AS valid FROM js)"""


def _analysis(t):
    return t.raw("documents").selectExpr("doc_id", f"{RAW_ANALYSIS} AS raw").withColumn("a", X.parse_analysis(F.col("raw")))


@query("t11_analysis_validation", "", _RAW + " SELECT doc_id, valid, CASE WHEN NOT valid THEN 'SKIP_INVALID_JSON' END AS action, CASE WHEN valid THEN CAST(j->>'$.conviction' AS DOUBLE) END AS conviction FROM va")
def t11(t):
    rows = _analysis(t).withColumn("valid", X.valid_analysis(F.col("a")))
    return rows.select(
        "doc_id", "valid", F.when(~F.col("valid"), "SKIP_INVALID_JSON").alias("action"), F.when(F.col("valid"), F.col("a.conviction")).alias("conviction")
    )


@query(
    "t12_json_telemetry", "",
    _RAW + """ SELECT doc_id, CAST(j->>'$.conviction' AS DOUBLE) AS conviction, j->>'$.price_impact.direction' AS direction, regexp_matches(j->>'$.key_facts', '\\$[\\d.,]+\\s*(mln|bln|mld|million|billion|%)') AS has_numbers,
    regexp_matches(j->>'$.key_facts', '(?i)exhibit not available') AS exhibit_missing FROM va WHERE valid""",
)
def t12(t):
    rows = _analysis(t).filter(X.valid_analysis(F.col("a")))
    return rows.select(
        "doc_id", "a.conviction", "a.price_impact.direction", X.fact_has_numbers(F.col("a.key_facts")).alias("has_numbers"),
        X.fact_exhibit_missing(F.col("a.key_facts")).alias("exhibit_missing"),
    )


@query(
    "t13_enrichment_candidates", "mentions",
    f"SELECT external_id, source FROM mentions WHERE (source = 'news' AND length(body) > 100) OR (source = 'stocktwits' AND length(body) > 80 AND regexp_matches(body, '{X.ENRICH_RE}'))",
)
def t13(t):
    return t.mentions.filter(X.enrichment_candidate(F.col("source"), F.col("body"))).select("external_id", "source")


XML_FLAG = "concat('<ownershipDocument><aff10b5One>', CASE o_orderstatus WHEN 'F' THEN ' 1 ' WHEN 'O' THEN 'TRUE' ELSE '0' END, '</aff10b5One><footnote>aff10b5One true</footnote></ownershipDocument>')"


@query("t14_plan_flag_xml", "", f"SELECT o_orderkey, regexp_matches({XML_FLAG}, '(?is)<aff10b5One>\\s*(1|true|y)\\s*</aff10b5One>') AS is_plan FROM orders")
def t14(t):
    return t.raw("orders").selectExpr("o_orderkey", f"{XML_FLAG} AS xml").select("o_orderkey", X.plan_flag_in_xml(F.col("xml")).alias("is_plan"))


@query(
    "t15_owner_merge", "trades",
    """SELECT trade_id, CASE WHEN insider_role IS NULL AND idx % 2 = 0 THEN 'Director' WHEN insider_role IS NULL THEN 'Director' WHEN idx % 2 = 1 THEN CASE WHEN list_contains(list_transform(string_split(insider_role, ','), lambda x: trim(x)), 'Director') THEN array_to_string(list_transform(string_split(insider_role, ','), lambda x: trim(x)), ', ') ELSE concat(array_to_string(list_transform(string_split(insider_role, ','), lambda x: trim(x)), ', '), ', Director') END
      ELSE CASE WHEN insider_role = 'Director' THEN 'Director' ELSE concat(array_to_string(list_transform(string_split(insider_role, ','), lambda x: trim(x)), ', '), ', Director') END END AS role,
    concat(insider_name, ' (co-filing z Fund, ', symbol, ')') AS name FROM trades""",
)
def t15(t):
    roles, names = F.array(F.col("insider_role"), F.lit("Director")), F.array(F.col("insider_name"), F.lit("Fund"), F.col("symbol"))
    return t.trades.select("trade_id", X.merge_owner_roles(roles).alias("role"), X.merge_owner_names(names).alias("name"))


# File names of a filing directory, built from the page URL.
_NAMES = "regexp_extract(url, '([A-Za-z]+)[^/]*$', 1)"
NAMES = [
    "concat('R1', page_id, '.htm')", "concat('exhibit', page_id % 3, '.htm')", "CASE WHEN page_id % 4 = 0 THEN concat('d', page_id, 'ex-99-1.htm') ELSE concat('d', page_id, '-index.htm') END",
    "CASE WHEN page_id % 3 = 0 THEN concat('Form', page_id, '8k.HTM') ELSE concat('doc', page_id, '.txt') END", "CASE WHEN page_id % 5 = 0 THEN concat('ex991', page_id, '.htm') ELSE concat('own', page_id, '.XML') END",
]


@query(
    "t16_document_choice", "",
    f"""d AS (SELECT page_id, [{', '.join(NAMES)}] AS n FROM pages)
    SELECT page_id, list_filter(n, lambda x: regexp_matches(lower(x), '\\.html?$') AND NOT regexp_matches(lower(x), '^r[12]') AND NOT regexp_matches(lower(x), 'exhibit|ex-|xbrl|index|-headers'))[1] AS main_doc,
    list_filter(n, lambda x: regexp_matches(lower(x), '\\.html?$') AND regexp_matches(lower(x), 'ex(hibit)?[-_]?99[-_.]?1\\b|ex(hibit)?991'))[1] AS exhibit_doc, list_filter(n, lambda x: lower(x) LIKE '%.xml')[1] AS xml_doc FROM d""",
)
def t16(t):
    d = t.raw("pages").selectExpr("page_id", f"array({', '.join(NAMES)}) AS n")
    n = F.col("n")
    return d.select("page_id", X.main_document(n).alias("main_doc"), X.exhibit_document(n).alias("exhibit_doc"), X.raw_xml_document(n).alias("xml_doc"))


@query(
    "t17_exhibit_concat", "",
    """SELECT d.doc_id, left(CASE WHEN length(b.text) > 200 THEN concat(d.text, chr(10), chr(10), '--- EXHIBIT 99.1 ---', chr(10), chr(10), b.text) ELSE d.text END, 50000) AS body
    FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
)
def t17(t):
    b = t.raw("benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("exhibit"))
    rows = t.raw("documents").select("doc_id", "text").join(b, "doc_id", "left")
    return rows.select("doc_id", X.exhibit_concat(F.col("text"), F.col("exhibit")).alias("body"))
