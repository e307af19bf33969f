"""Text and JSON rules over filing bodies, facts and messages (JVM expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Word boundary over ASCII word characters, whatever the Java version.
_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_words(pattern: str) -> str:
    return pattern.replace(r"\b", _B)


# Space characters beyond ASCII that the text rules treat as spaces.
WIDE_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def plain_spaces(text: Column) -> Column:
    """Every wide space as one ASCII space, so that places in the text stay as they are; ASCII texts pass unread."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(text, f"[{WIDE_SPACES}]", " "))


ITEM_RE = r"(?i)Item\s+(\d+\.\d+)"
SECTION_LIMIT = 50_000  # the section length a consumer of item texts accepts


def detect_items(text: Column) -> Column:
    """Distinct item numbers in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(plain_spaces(text), F.lit(ITEM_RE), F.lit(1)))


# Tag and entity substitutions, applied in this order.
HTML_STEPS = (
    (r"(?i)<div[^>]*display:\s*none[^>]*>[\s\S]*?</div>", ""),
    (r"(?i)<ix:header>[\s\S]*?</ix:header>", ""),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</(p|div|tr|li)>", "\n"),
    (r"<[^>]+>", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&#160;", " "),
    ("&#8217;", "'"),
    ("&#8220;", '"'),
    ("&#8221;", '"'),
    (r"&#\d+;", " "),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
    (r"^[\s\x{00A0}\x{FEFF}\x{2000}-\x{200A}\x{202F}\x{3000}]+|[\s\x{00A0}\x{FEFF}\x{2000}-\x{200A}\x{202F}\x{3000}]+$", ""),
)


def strip_html(html: Column) -> Column:
    out = html
    for pattern, replacement in HTML_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def item_section(text: Column, item: Column, limit: int = SECTION_LIMIT) -> Column:
    """Text from the item heading to the next heading or the signatures; whole text if absent."""
    pattern = F.concat(F.lit(r"(?i)Item\s+"), F.replace(item, F.lit("."), F.lit(r"\.")), F.lit(r"[^\d]"))
    plain = plain_spaces(text)
    start = F.regexp_instr(plain, pattern)
    head = F.length(F.regexp_substr(plain, pattern))
    rest = F.substr(plain, start + head)
    stop = F.regexp_instr(rest, F.lit(r"(?i)Item\s+\d+\.\d+|SIGNATURES"))
    section = F.when(stop > 0, F.substr(text, start, head + stop - 1)).otherwise(F.substr(text, start))
    found = F.coalesce(start, F.lit(0)) > 0
    return F.substring(strip_html(F.when(found, section).otherwise(text)), 1, limit)


# Vocabulary of the guidance patterns.
_AFFIRM = r"(?:affirms?|reaffirms?|maintains?|reiterates?|reconfirms?|continues?\s+to\s+expect)"
_LOWER = r"(?:lowers?|reduces?|cuts?|trims?|decreases?|narrows?\s+down)"
_RAISE = r"(?:raises?|increases?|boosts?|lifts?|expands?|narrows?\s+up)"
_WITHDRAW = r"(?:withdraws?|suspends?|pulls?|removes?)"
_TARGET = r"\b(?:guidance|outlook|forecast|guidance\s+range|target|expectations?)\b"
_ADJUSTED = r"(?:adjusted|adj\.?|non[\s-]gaap)"
_GAAP = r"\bgaap\b"
_FAR, _NEAR = r"[^.\n]{0,200}", r"[^.\n]{0,80}"
GUIDANCE_PATTERNS = {
    "affirm": f"(?i){_AFFIRM}{_FAR}{_TARGET}",
    "affirm_adjusted": f"(?i){_AFFIRM}{_FAR}{_ADJUSTED}{_NEAR}{_TARGET}|{_AFFIRM}{_FAR}{_TARGET}{_NEAR}{_ADJUSTED}",
    "lower": f"(?i){_LOWER}{_FAR}{_TARGET}",
    "lower_gaap": f"(?i){_LOWER}{_FAR}{_GAAP}{_NEAR}{_TARGET}|{_GAAP}\\b{_NEAR}{_LOWER}{_FAR}{_TARGET}",
    "raise": f"(?i){_RAISE}{_FAR}{_TARGET}",
    "withdraw": f"(?i){_WITHDRAW}{_FAR}{_TARGET}",
}


# Every match of a pattern has one of these at most two characters after its start, and a target stem behind that.
_TARGET_STEMS = ("guidance", "outlook", "forecast", "target", "expectation")
_VERB_STEMS = {
    "affirm": ("affirm", "maintain", "reiterate", "reconfirm", "continue"),
    "lower": ("lower", "reduce", "cut", "trim", "decrease", "narrow"),
    "raise": ("raise", "increase", "boost", "lift", "expand", "narrow"),
    "withdraw": ("withdraw", "suspend", "pull", "remove"),
    "gaap": ("gaap",),
}
_STEMS_OF = {k: (k,) for k in ("affirm", "lower", "raise", "withdraw")} | {"affirm_adjusted": ("affirm",), "lower_gaap": ("lower", "gaap")}


def _once(value: Column, then) -> Column:
    """``then`` of a value that is worked out once and handed on as a one-element array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _any_of(low: Column, stems) -> Column:
    found = F.lit(False)
    for stem in stems:
        found = found | F.contains(low, F.lit(stem))
    return found


def _guidance_hits(plain: Column, low: Column, max_hits: int) -> Column:
    """First matches of every kind.  Patterns are slow to fail, so each is tried only from the first of its stems on."""
    spots = F.struct(*[F.least(F.lit(None), *[F.when(F.contains(low, F.lit(x)), F.instr(low, x)) for x in stems]).alias(k) for k, stems in _VERB_STEMS.items()])
    same_places = F.length(low) == F.length(plain)

    def taken(kind: str, at: Column) -> Column:
        start = F.least(F.lit(None), *[at[k] for k in _STEMS_OF[kind]])
        rest = F.substr(plain, F.when(same_places, F.greatest(start - 3, F.lit(1))).otherwise(1))
        found = F.slice(F.regexp_extract_all(rest, F.lit(ascii_words(GUIDANCE_PATTERNS[kind])), F.lit(0)), 1, max_hits)
        return F.when(start.isNotNull(), found).otherwise(F.array().cast("array<string>"))

    hits = _once(spots, lambda at: F.struct(*[taken(kind, at).alias(kind) for kind in GUIDANCE_PATTERNS]))
    return F.when(_any_of(low, _TARGET_STEMS), hits).otherwise(F.struct(*[F.array().cast("array<string>").alias(kind) for kind in GUIDANCE_PATTERNS]))


def guidance_status(text: Column, max_hits: int = 3) -> Column:
    """Struct of guidance flags; each kind counts its first ``max_hits`` matches, taken once per text."""
    hits = _once(F.coalesce(plain_spaces(text), F.lit("")), lambda plain: _once(F.lower(plain), lambda low: _guidance_hits(plain, low, max_hits)))

    def flags(h: Column) -> Column:
        n = {k: F.size(h[k]) for k in GUIDANCE_PATTERNS}

        def fragment(kind: str, label: str) -> Column:
            first = F.trim(F.substring(F.get(h[kind], F.lit(0)), 1, 200))
            return F.when(n[kind] > 0, F.concat(F.lit(label + ": "), first))

        fragments = F.array_compact(
            F.array(
                F.coalesce(fragment("affirm_adjusted", "AFFIRMS_ADJUSTED"), fragment("affirm", "AFFIRMS")),
                F.coalesce(fragment("lower_gaap", "LOWERS_GAAP"), fragment("lower", "LOWERS")),
                fragment("raise", "RAISES"),
                fragment("withdraw", "WITHDRAWS"),
            )
        )
        return F.struct(
            (n["affirm"] > 0).alias("has_affirmation"),
            (n["affirm_adjusted"] > 0).alias("affirms_adjusted"),
            (n["lower"] > n["lower_gaap"]).alias("has_lowering"),
            ((n["lower"] > 0) & (n["lower_gaap"] == n["lower"])).alias("lowers_gaap_only"),
            (n["raise"] > 0).alias("has_raising"),
            (n["withdraw"] > 0).alias("has_withdrawal"),
            fragments.alias("fragments"),
        )

    return _once(hits, flags)


def guidance_floor(status: Column) -> Column:
    """Affirmed and neither withdrawn nor lowered."""
    affirmed = status["has_affirmation"] | status["affirms_adjusted"]
    return affirmed & ~status["has_withdrawal"] & ~status["has_lowering"]


_AMOUNT = r"\$\s*([0-9]+(?:[,.][0-9]+)*)\s*"
_UNIT = r"(million|billion|M\b|B\b|mln|bln)"
_REVENUE_RES = (
    r"(?i)(?:total\s+|net\s+)?revenue[s]?\s+(?:of\s+)?" + _AMOUNT + _UNIT + "?",
    r"(?i)(?:total\s+|net\s+)?revenue[s]?\s*[:=]?\s*" + _AMOUNT + _UNIT,
)


def reported_revenue(text: Column, minimum: float = 1e6) -> Column:
    """Largest dollar amount stated after 'revenue', scaled by its unit."""
    text = plain_spaces(text)

    def amounts(pattern: str) -> Column:
        numbers = F.regexp_extract_all(text, F.lit(ascii_words(pattern)), F.lit(1))
        units = F.regexp_extract_all(text, F.lit(ascii_words(pattern)), F.lit(2))
        return F.zip_with(
            numbers,
            units,
            lambda n, u: F.regexp_extract(F.replace(n, F.lit(","), F.lit("")), r"^[0-9]+(\.[0-9]+)?", 0).cast("double")
            * F.when(F.lower(u).startswith("b"), 1e9).when(F.lower(u).startswith("m"), 1e6).otherwise(1.0),
        )

    found = F.concat(*[amounts(p) for p in _REVENUE_RES])
    return F.array_max(F.filter(found, lambda v: v >= minimum))


_EPS_NUMBER = r"\$?\s*\(?(-?[0-9]+\.[0-9]{1,3})"
_EPS_RES = (
    r"(?i)diluted\s+(?:eps|earnings\s+per\s+share)\s*(?:of|[:=])?\s*" + _EPS_NUMBER + r"\)?",
    r"(?i)\beps\s*\(?\s*diluted\s*\)?\s*[:=]?\s*" + _EPS_NUMBER + r"\)?",
    r"(?i)earnings\s+per\s+share[,\s]+diluted[,\s:=]+" + _EPS_NUMBER + r"\)?",
    r"(?i)net\s+(?:income|loss)\s+per\s+share[,\s]+diluted[,\s:=]+" + _EPS_NUMBER + r"\)?",
)


def reported_eps(text: Column, limit: float = 100.0) -> Column:
    """Diluted EPS: first pattern whose value is plausible."""
    text = plain_spaces(text)
    out = []
    for p in _EPS_RES:
        raw = F.regexp_extract(text, ascii_words(p), 1)
        value = F.when(raw != "", raw).cast("double")
        out.append(F.when(F.abs(value) <= limit, value))
    return F.coalesce(*out)


# Wording that marks a fact as missing data.
MISSING_DATA_RE = "(?iu)" + "|".join(
    f"(?:{p})"
    for p in (
        r"niedost[eę]pn",
        r"brak\s+(szczeg[oó][lł]owych|danych|liczbowych|konkretnych|informacji)",
        r"nie\s+(podano|ujawniono|wiadomo|sprecyzowano)",
        r"\bunknown\b",
        r"\binsufficient\b",
        r"not\s+(disclosed|available|specified|provided)",
        r"\bnie\s+wiemy\b",
    )
)


_MISSING_STEMS = ("nie", "brak", "unknown", "insufficient", "not")  # every match in an ASCII fact holds one of them


def missing_data_facts(facts: Column) -> Column:
    return F.filter(facts, lambda f: ((F.octet_length(f) != F.length(f)) | _any_of(F.lower(f), _MISSING_STEMS)) & plain_spaces(f).rlike(ascii_words(MISSING_DATA_RE)))


def message_conviction(message: Column) -> Column:
    """Conviction figure out of an escaped alert message."""
    plain = F.replace(F.replace(message, F.lit("\\."), F.lit(".")), F.lit("\\-"), F.lit("-"))
    raw = F.regexp_extract(plain, r"(?i)Conviction:\s*([+-]?\d+\.?\d*)", 1)
    return F.when(raw != "", raw).cast("double")


def fact_has_numbers(facts: Column) -> Column:
    return F.exists(facts, lambda f: plain_spaces(f).rlike(r"\$[\d.,]+\s*(mln|bln|mld|million|billion|%)"))


def fact_exhibit_missing(facts: Column) -> Column:
    return F.exists(
        facts,
        lambda f: f.rlike("(?iu)(niedostępn|not available|nie udostępniony|not provided)") & f.rlike("(?i)exhibit"),
    )


# Words that make a short post worth enriching.
ENRICH_RE = (
    "(?i)(earnings|EPS|revenue|quarter|Q[1-4]|guidance|beat|miss|results|reported|FDA|drug|approval|GLP|semaglutide|"
    "Wegovy|Ozempic|clinical|trial|pharma|analyst|price target|upgrade|downgrade|maintains|rating|lawsuit|legal|sue|"
    "DOJ|SEC|investigation|regulatory|Medicare|Medicaid|CMS|insurance|Advantage|managed care|insider|buyback|"
    "acquisition|merger|dividend|patent)"
)


def enrichment_candidate(source: Column, text: Column, news_min: int = 100, post_min: int = 80) -> Column:
    return ((source == "news") & (F.length(text) > news_min)) | (
        (source == "stocktwits") & (F.length(text) > post_min) & text.rlike(ENRICH_RE)
    )


PLAN_FLAG_RE = r"(?is)<aff10b5One>\s*(1|true|y)\s*</aff10b5One>"


def plan_flag_in_xml(xml: Column) -> Column:
    return F.coalesce(xml.rlike(PLAN_FLAG_RE), F.lit(False))


def exhibit_concat(section: Column, exhibit: Column, limit: int = SECTION_LIMIT, min_exhibit: int = 200) -> Column:
    """Section plus press release, cut at the section limit."""
    usable = F.length(exhibit) > min_exhibit
    joined = F.concat(section, F.lit("\n\n--- EXHIBIT 99.1 ---\n\n"), exhibit)
    return F.substring(F.when(usable, joined).otherwise(section), 1, limit)


def main_document(names: Column) -> Column:
    """First .htm(l) of a filing directory that is no exhibit, index or rendered report."""

    def ok(n: Column) -> Column:
        low = F.lower(n)
        return (
            low.rlike(r"\.html?$")
            & ~low.rlike("^r[12]")
            & ~low.rlike("exhibit|ex-|xbrl|index|-headers")
        )

    return F.get(F.filter(names, ok), F.lit(0))


def exhibit_document(names: Column) -> Column:
    return F.get(
        F.filter(
            names,
            lambda n: F.lower(n).rlike(r"\.html?$")
            & F.lower(n).rlike(r"ex(hibit)?[-_]?99[-_.]?1(?![A-Za-z0-9_])|ex(hibit)?991"),
        ),
        F.lit(0),
    )


def raw_xml_document(names: Column) -> Column:
    return F.get(F.filter(names, lambda n: F.lower(n).endswith(".xml")), F.lit(0))


def merge_owner_roles(roles: Column) -> Column:
    """Union of the comma-separated parts of several owners' roles, order kept."""
    parts = F.flatten(
        F.transform(F.filter(roles, lambda r: r.isNotNull()), lambda r: F.split(r, r"\s*,\s*"))
    )
    kept = F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))
    return F.when(F.size(kept) > 0, ellipsis(F.array_join(kept, ", "), 100))


def merge_owner_names(names: Column) -> Column:
    first, extra = F.get(names, F.lit(0)), F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(1)))
    joined = F.concat(first, F.lit(" (co-filing z "), F.array_join(extra, ", "), F.lit(")"))
    return ellipsis(F.when(F.size(names) > 1, joined).otherwise(F.coalesce(first, F.lit("Unknown"))), 255)


def ellipsis(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def owner_role(title: Column, officer: Column, director: Column, ten_pct: Column) -> Column:
    """Comma-separated role of one owner, null when nothing is set."""

    def yes(c: Column) -> Column:
        return F.lower(F.trim(c.cast("string"))).isin("1", "true")

    named = F.when(F.length(F.coalesce(title, F.lit(""))) > 0, title).when(yes(officer), F.lit("Officer"))
    role = F.concat_ws(", ", named, F.when(yes(director), "Director"), F.when(yes(ten_pct), "10% Owner"))
    return F.when(role != "", role)


ANALYSIS_SCHEMA = T.StructType(
    [
        T.StructField(
            "price_impact",
            T.StructType(
                [
                    T.StructField("direction", T.StringType()),
                    T.StructField("magnitude", T.StringType()),
                    T.StructField("confidence", T.DoubleType()),
                    T.StructField("time_horizon", T.StringType()),
                ]
            ),
        ),
        T.StructField("conviction", T.DoubleType()),
        T.StructField("summary", T.StringType()),
        T.StructField("conclusion", T.StringType()),
        T.StructField("key_facts", T.ArrayType(T.StringType())),
        T.StructField("catalyst_type", T.StringType()),
        T.StructField("requires_immediate_attention", T.BooleanType()),
    ]
)


def parse_analysis(raw: Column) -> Column:
    """Analysis struct of a model response, code fences removed; null unless exactly one object.

    Parsed as the only element of an array, so text after the object is an error.
    """
    opened = F.regexp_replace(raw, r"(?i)^```json?\s*", "")
    body = F.regexp_replace(opened, r"\s*```$", "")
    parsed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), T.ArrayType(ANALYSIS_SCHEMA))
    return F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0)))


def valid_analysis(a: Column) -> Column:
    """Enum, range and length rules of the analysis object."""
    impact = a["price_impact"]
    rules = (
        impact["direction"].isin("positive", "negative", "neutral")
        & impact["magnitude"].isin("high", "medium", "low")
        & impact["confidence"].between(0, 1)
        & impact["time_horizon"].isin("immediate", "short_term", "medium_term")
        & a["conviction"].between(-2, 2)
        & (F.length(a["summary"]) >= 1)
        & (F.length(a["conclusion"]) >= 1)
        & F.size(a["key_facts"]).between(1, 10)
        & F.forall(a["key_facts"], lambda f: f.isNotNull())
        & (F.length(a["catalyst_type"]) >= 1)
        & a["requires_immediate_attention"].isNotNull()
    )
    return F.coalesce(rules, F.lit(False))
