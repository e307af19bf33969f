"""Surrogates for personal data, in DataFrame functions only.

One pattern finds e-mail addresses, phone numbers, IPv4 addresses, payment cards (with a valid check digit), social security
numbers, IBANs (with valid check digits), secrets that are assigned to a name, and names after a form of address.  Mentions with
one canonical form (case, spacing and punctuation aside) are one entity everywhere.  An entity's surrogate comes from a keyed
hash of its kind and canonical form: digits stay digits, letters letters of their script and case, hexadecimal stays hexadecimal;
cards and IBANs get valid check digits, octets stay octets of the same length, country codes and top-level domains stay, addresses
at one domain share the new domain, and given names keep their gender.  Names are replaced word by word, so that "Mr Smith" and "Mr John
Smith" still share a word; words that a hyphen joins at the end of a name are all of the family name.  Names in Cyrillic or Greek letters
get names in these letters, all others Latin ones.

Names are found by a form of address.  After that, every other mention of their words in the same text (capitalised, the whole word) is
replaced by the same surrogate, a word that is both given and family name by that of the family name.  Given names that stand with
no form of address anywhere in the text stay, and so do names in texts without any form of address.

Surrogates are checked against each other and against the entities of the corpus; on a collision all but one of the entities get the
hash of the next attempt, until there is none.  Names gain two syllables with every attempt, so there are as many as needed.  Of other kinds,
after ``ATTEMPTS`` attempts (more entities of a form than the form has values) a surrogate is the kind with a hash in brackets, which is
distinct but gives up the form.

Null texts stay null and have no entity; texts without one are unchanged.  Repeated rows get equal results, also without an id;
empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.order_minhash import let
from tidewatch.session import cut_lineage

ATTEMPTS = 12
# Forms of address by gender, given names by gender, syllables of family names, alphabets
MALE = ("Mr", "Herr", "Sr", "Señor", "Signor", "Monsieur", "господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Signora", "Madame", "Mme", "госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
GIVEN = {
    "latin_m": ("Adam", "Bruno", "Carl", "Daniel", "Erik", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Marco", "Nils", "Oscar", "Paul"),
    "latin_f": ("Alma", "Bianca", "Clara", "Diana", "Elsa", "Frida", "Greta", "Helen", "Irene", "Julia", "Karin", "Lena", "Maria", "Nora", "Olga", "Paula"),
    "latin_n": ("Alex", "Charlie", "Dana", "Jamie", "Kim", "Lou", "Noa", "Robin", "Sam", "Sascha", "Toni", "Yuri"),
    "cyrillic_m": ("Алексей", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Кирилл", "Максим", "Олег", "Павел"),
    "cyrillic_f": ("Алла", "Вера", "Галина", "Дарья", "Елена", "Инна", "Ксения", "Мария", "Ольга", "Полина"),
    "cyrillic_n": ("Саша", "Женя", "Валя"),
    "greek_m": ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Λευτέρης", "Μάριος", "Νίκος", "Πέτρος", "Σταύρος", "Χρήστος"),
    "greek_f": ("Αγγελική", "Βασιλική", "Γεωργία", "Δέσποινα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"),
    "greek_n": ("Άλεξ", "Ντάνι", "Κιμ"),
}
SYLLABLES = {
    "latin": ("ba", "ber", "dor", "fen", "gal", "hol", "kar", "lin", "mar", "nor", "pel", "ros", "sten", "tal", "ver", "win"),
    "cyrillic": ("ба", "бер", "дор", "фен", "гал", "хол", "кар", "лин", "мар", "нор", "пел", "рос", "стен", "тал", "вер", "вин"),
    "greek": ("βα", "βερ", "δορ", "φεν", "γαλ", "χολ", "καρ", "λιν", "μαρ", "νορ", "πελ", "ρο", "στεν", "ταλ", "βιν", "ζακ"),
}
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"

# Characters of an IBAN by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}

# Capitalised words that end a name, as they start what follows it
AFTER_NAME = (
    "The A An And But Or He She They It We You I His Her Their Its This That These Those In On At Of To For From With By As Is Was If When Who What Will "
    "Der Die Das Und Aber Er Sie Es Ein Eine Le La Les Et Mais Il Elle Un Une El Los Las Y Pero Él Ella И Но Он Она Они Это В На"
).split()
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:['’]?\p{Lu}\p{Ll}+)*"
_MENTION = r"(?<![\p{L}\p{N}_])\p{Lu}\p{L}*(?:['’]\p{Lu}\p{L}+)*(?![\p{L}\p{N}_])"  # also in capitals

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Codes that are not listed are left to the general form, which comes last
_IBANS = "|".join(
    rf"(?:{codes.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{(n - 4) % 4}}}" if n % 4 else "") + r"\b" for n, codes in IBAN_LENGTHS.items()
)
PATTERNS = {
    "secret": r"(?i:\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_-]{12,}",
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,8}",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+.-])(?:1-)?\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d+.-])\d{3}\.\d{3}\.\d{4}(?!\.?\d)",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])",
    "iban": rf"\b(?=[A-Z]{{2}}\d{{2}})(?:{_IBANS}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?\b)",
    "name": rf"\b(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? {_WORD}(?:[ -](?!(?:{'|'.join(AFTER_NAME)})\b){_WORD}){{0,4}}",
}
PATTERN = "|".join(PATTERNS.values())
_ADDRESS = rf"^(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? "
_PREFIX = r"^.*?[=:]\s*[\"']?"


def _may_match(text: Column) -> Column:
    """Whether a text has a character or word that every match of some pattern has; much faster than the patterns."""
    maybe = text.rlike("[@0-9=:]")
    for word in MALE + FEMALE + NEUTRAL:
        maybe |= text.contains(word)
    return maybe


def _kind(m: Column) -> Column:
    """Kind of a match; the first pattern that it fits as a whole."""
    out = None
    for kind, pattern in PATTERNS.items():
        fits = m.rlike(rf"^(?:{pattern})$")
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Sum of a string of digits with every second one from the right doubled, modulo 10; the last digit counts once."""
    value = lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(F.reverse(_chars(digits)), value), F.lit(0), lambda a, v: a + v) % 10


def mod_97(iban: Column) -> Column:
    """Remainder of an IBAN without spaces, its first four characters moved to the end and letters as 10 .. 35."""
    turned = _chars(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step)


def _valid(kind: Column, m: Column) -> Column:
    bare = F.regexp_replace(m, "[ -]", "")
    return F.when(kind == "card", luhn(bare) == 0).when(kind == "iban", mod_97(bare) == 1).otherwise(kind.isNotNull())


def _plain(word: Column) -> Column:
    """A word of a name without its case and kind of apostrophe."""
    return F.lower(F.translate(word, "’", "'"))


def _parts(kind: Column, m: Column) -> Column:
    """Entities (kind, canonical) of a match: words of a name by themselves, everything else as a whole."""
    part = lambda k, c: F.struct(k.alias("kind"), c.alias("form"))
    words = F.split(F.regexp_replace(m, _ADDRESS, ""), "[ -]")
    gender = F.when(m.rlike(rf"^(?:{'|'.join(MALE)})\b"), "given_m").when(m.rlike(rf"^(?:{'|'.join(FEMALE)})\b"), "given_f").otherwise("given_n")
    last = F.size(F.split(F.substring_index(m, " ", -1), "-"))  # words of the family name
    names = let(words, lambda ws: F.transform(ws, lambda w, i: part(F.when(i >= F.size(ws) - last, "family").otherwise(gender), _plain(w))))
    form = (
        F.when(kind == "secret", F.regexp_replace(m, _PREFIX, ""))
        .when(kind.isin("phone", "card"), F.regexp_replace(m, "[^0-9]", ""))
        .when(kind == "email", F.lower(m))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .otherwise(m)
    )
    return F.when(kind == "name", names).otherwise(F.array(part(kind, form)))


def _stream(seed: Column, size: Column) -> Column:
    """Keyed hexadecimal digits, two for each of ``size`` characters."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(size / 32).cast("int")), lambda k: F.sha2(F.concat(seed, F.lit("|"), k.cast("string")), 256)), "")


def _draw(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")


def _pick(text: str, n: Column) -> Column:
    return F.substr(F.lit(text), n % len(text) + 1, F.lit(1))


def _like(form: Column, stream: Column, hexadecimal: Column) -> Column:
    """Characters of the same kind, one by one."""

    def one(c: Column, i: Column) -> Column:
        n, low = _draw(stream, i), F.lower(c)
        letter = (
            F.when(hexadecimal, _pick("abcdef", n))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(CYRILLIC, n))
            .when(c.rlike(r"\p{IsGreek}"), _pick(GREEK, n))
            .otherwise(_pick(LATIN, n))
        )
        return F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike(r"\p{L}"), F.when(c == low, letter).otherwise(F.upper(letter))).otherwise(c)

    return F.array_join(F.transform(_chars(form), one), "")


def surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """Surrogate of an entity's canonical form."""
    keyed = lambda *parts: F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)
    stream = _stream(keyed(kind, form, attempt.cast("string")), F.greatest(F.length(form), 8 + 2 * attempt))
    hexadecimal = form.rlike("^[0-9a-fA-F]+$") & (kind == "secret")
    like = lambda f, s: _like(f, s, hexadecimal)

    def card(s: Column) -> Column:
        body = let(like(form, s), lambda x: F.concat(F.substr(form, F.lit(1), F.lit(1)), F.substr(x, F.lit(2), F.length(x) - 2)))
        return let(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))

    def octets(s: Column) -> Column:
        def one(o: Column, i: Column) -> Column:
            n = _draw(s, i) * 256 + _draw(s, i + 4)
            return F.when(F.length(o) == 1, 1 + n % 9).when(F.length(o) == 2, 10 + n % 90).otherwise(100 + n % 155).cast("string")

        return F.array_join(F.transform(F.split(form, r"\."), one), ".")

    def email(s: Column) -> Column:
        local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
        head, top = F.regexp_replace(domain, r"\.[^.]*$", ""), F.substring_index(domain, ".", -1)
        return F.concat(like(local, s), F.lit("@"), like(head, _stream(keyed(F.lit("domain"), domain), F.length(domain))), F.lit("."), top)

    def phone(s: Column) -> Column:
        code = F.when(form.rlike("^[17]"), 1).otherwise(2)
        return let(like(form, s), lambda x: F.concat(F.substr(form, F.lit(1), code), F.substr(x, code + 1)))

    def iban(s: Column) -> Column:
        account = let(like(form, s), lambda x: F.substr(x, F.lit(5)))
        country = F.substr(form, F.lit(1), F.lit(2))
        return let(account, lambda a: F.concat(country, F.lpad((98 - mod_97(F.concat(country, F.lit("00"), a))).cast("string"), 2, "0"), a))

    script = F.when(form.rlike(r"\p{IsCyrillic}"), "cyrillic").when(form.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def syllables(s: Column, first: int, n: Column) -> Column:
        """A capitalised word of ``n`` syllables by the draws from ``first`` on."""
        of = F.create_map(*[x for k, v in SYLLABLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[script]
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(of, _draw(s, i + (first - 1)) % len(SYLLABLES["latin"]))), ""))

    def family(s: Column) -> Column:
        return syllables(s, 0, 4 + 2 * attempt)

    def given(s: Column) -> Column:
        gender = F.substring_index(kind, "_", -1)
        of = F.create_map(*[x for k, v in GIVEN.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.concat_ws("_", script, gender)]
        name = let(of, lambda names: F.get(names, _draw(s, F.lit(0)) % F.size(names)))
        return F.when(attempt == 0, name).otherwise(F.concat(name, F.lit("-"), syllables(s, 1, 2 * attempt)))

    def made(s: Column) -> Column:
        return (
            F.when(kind == "card", card(s))
            .when(kind == "ip", octets(s))
            .when(kind == "email", email(s))
            .when(kind == "phone", phone(s))
            .when(kind == "iban", iban(s))
            .when(kind == "family", family(s))
            .when(kind.startswith("given"), given(s))
            .otherwise(like(form, s))
        )

    given_up = F.concat(F.lit("["), kind, F.lit("-"), F.substr(keyed(kind, form), F.lit(1), F.lit(20)), F.lit("]"))
    grows = kind.startswith("given") | (kind == "family")
    return F.when((attempt >= ATTEMPTS) & ~grows, given_up).otherwise(let(stream, made))


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) for distinct entities (kind, form): distinct per kind, and no entity's own form."""
    table = entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key))
    for _ in range(2 * ATTEMPTS + 1):
        table = cut_lineage(table)
        real = table.select(F.col("kind").alias("k"), F.col("form").alias("r")).withColumn("real", F.lit(True))
        groups = table.groupBy("kind", "surrogate").agg(F.min("form").alias("first"), F.count(F.lit(1)).alias("n"))
        spelled = F.when(F.col("kind").startswith("given") | (F.col("kind") == "family"), F.lower("surrogate")).otherwise(F.col("surrogate"))
        bad = groups.withColumn("spelled", spelled).join(real, (F.col("kind") == F.col("k")) & (F.col("spelled") == F.col("r")), "left")
        bad = bad.filter("n > 1 OR real").select(F.col("kind").alias("bad_kind"), F.col("surrogate").alias("bad"), "first", "real")
        if bad.isEmpty():
            return table.select("kind", "form", "surrogate")
        joined = table.join(bad, (F.col("kind") == F.col("bad_kind")) & (F.col("surrogate") == F.col("bad")), "left")
        again = F.col("bad").isNotNull() & (F.coalesce("real", F.lit(False)) | (F.col("form") != F.col("first")))
        attempt = F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt"))
        table = joined.select("kind", "form", attempt.alias("attempt"), F.col("surrogate").alias("old"), again.alias("again"))
        table = table.select(
            "kind", "form", "attempt", F.when(F.col("again"), surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key)).otherwise(F.col("old")).alias("surrogate")
        )
    raise RuntimeError("surrogates still collide")  # names have had 50 syllables by then, other kinds 80 bits of a hash


def _dressed(m: Column, kind: Column, parts: Column) -> Column:
    """A mention with the surrogates of its entities in its own format."""
    whole = F.get(parts, F.lit(0))
    given_up = whole.startswith("[")
    digit = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), "[^0-9]", ""))
    numbers = F.array_join(F.transform(_chars(m), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(whole, digit(i), F.lit(1))).otherwise(c)), "")
    place = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), " ", ""))
    spaced = F.array_join(F.transform(_chars(m), lambda c, i: F.when(c == " ", c).otherwise(F.substr(whole, place(i), F.lit(1)))), "")
    cased = F.array_join(F.transform(_chars(m), lambda c, i: let(F.substr(whole, i + 1, F.lit(1)), lambda x: F.when(c == F.lower(c), x).otherwise(F.upper(x)))), "")
    between = F.regexp_extract_all(F.regexp_replace(m, _ADDRESS, ""), F.lit("[ -]"), F.lit(0))
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(between, i), F.lit("")))), "")
    name = F.concat(F.regexp_extract(m, _ADDRESS, 0), joined)
    return (
        F.when(kind == "name", name)
        .when(kind == "secret", F.concat(F.regexp_extract(m, _PREFIX, 0), whole))
        .when(given_up, whole)
        .when(kind.isin("phone", "card"), numbers)
        .when(kind == "iban", spaced)
        .when(kind == "email", cased)
        .otherwise(whole)
    )


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_entities, kinds array<string>, text) per row of ``docs``: replaced mentions, their kinds, and the new text."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("hash"))
    found = texts.filter(_may_match(F.col("text"))).select("hash", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found")).filter(F.size("found") > 0)
    mentions = found.select("hash", F.posexplode("found").alias("at", "mention")).distinct().withColumn("kind", _kind(F.col("mention")))
    mentions = cut_lineage(mentions.filter(_valid(F.col("kind"), F.col("mention"))).withColumn("parts", _parts(F.col("kind"), F.col("mention"))))
    words = mentions.select("hash", "at", "mention", F.col("kind").alias("of"), F.posexplode("parts").alias("nth", "part"))
    words = words.select("hash", "at", "mention", "of", "nth", F.col("part.kind").alias("kind"), F.col("part.form").alias("form"))
    table = surrogate_table(words.select("kind", "form").distinct(), key)
    dressed = (
        words.join(table, ["kind", "form"])
        .groupBy("hash", "at", "mention", "of")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "surrogate", "kind", "form"))).alias("parts"))
        .withColumn("new", _dressed(F.col("mention"), F.col("of"), F.col("parts.surrogate")))
    )
    # words of a text's names: (form, whether given, surrogate), one for each form
    own = F.when(F.col("of") == "name", F.transform("parts", lambda p: F.struct(p["form"].alias("form"), (p["kind"] != "family").alias("given"), p["surrogate"].alias("surrogate"))))
    by_text = dressed.groupBy("hash").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("new"),
        F.array_sort(F.collect_set("of")).alias("kinds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("own"),
    )
    first = lambda own: F.filter(own, lambda p, i: F.when(i == 0, True).otherwise(F.get(own, i - 1)["form"] != p["form"]))
    bare = let(F.col("own"), lambda own: F.map_from_entries(F.transform(first(own), lambda p: F.struct(p["form"], p["surrogate"]))))
    by_text = by_text.select("hash", "new", "kinds", F.when(F.size("own") > 0, bare).alias("bare"))
    # matches and what stands between them, in turns
    matches, between = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), F.split("text", PATTERN, -1)
    put = lambda m: F.transform(m, lambda x, i: F.coalesce(F.col("new")[i], x))

    def again(gap: Column) -> Column:
        """(text, number of replaced words) of what stands between matches."""

        def spelled(word: Column) -> Column:
            made = F.col("bare")[_plain(word)]
            return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(made)).otherwise(made)

        def written(words: Column) -> Column:
            rest, made = F.split(gap, _MENTION, -1), F.transform(words, spelled)
            return let(
                made,
                lambda n: F.struct(
                    F.array_join(F.transform(rest, lambda r, i: F.concat(r, F.coalesce(F.get(n, i), F.get(words, i), F.lit("")))), "").alias("text"),
                    F.size(F.filter(n, lambda x: x.isNotNull())).alias("n"),
                ),
            )

        return F.when(F.col("bare").isNull(), F.struct(gap.alias("text"), F.lit(0).alias("n"))).otherwise(let(F.regexp_extract_all(gap, F.lit(_MENTION), F.lit(0)), written))

    whole = lambda m, gaps: F.struct(
        F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap["text"], F.coalesce(F.get(m, i), F.lit("")))), "").alias("text"),
        F.aggregate(gaps, F.lit(0), lambda a, gap: a + gap["n"]).alias("n"),
    )
    written = let(put(matches), lambda m: let(F.transform(between, again), lambda gaps: whole(m, gaps)))
    unchanged = F.struct(F.col("text").alias("text"), F.lit(0).alias("n"))
    row = lambda w: F.struct(
        "doc_id",
        (F.coalesce(F.size("new"), F.lit(0)) + w["n"]).cast("long").alias("n_entities"),
        F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"),
        w["text"].alias("text"),
    )
    # the written text is computed once, in one generator
    return texts.join(by_text, "hash", "left").select(F.inline(F.array(let(F.when(F.col("new").isNotNull(), written).otherwise(unchanged), row))))
