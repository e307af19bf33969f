"""Every operator against brute force on a small table, and on the awkward one: nulls, empty and long texts, ties, repeated rows."""

import collections
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import WORD, ascii_lower, near_components, without_line_runs, without_repeats
from tidewatch.llm import bpe, components, exact_dedup, line_dedup, mixing, near_dedup, order_minhash, pii, quality, substring_dedup, toxicity, words
from tidewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, kept string, row string, src string, hash string, rep string, n string"
LONG = " ".join(f"word{k % 977}" for k in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    texts = [
        (1, "The same words here\nand a second line of it"), (2, "the SAME words here\nand a second line of it"), (3, None), (4, ""), (5, " \n\t "),
        (None, "no id at all"), (None, "no id at all"), (None, None), (6, "one"), (7, LONG), (8, LONG + " end"), (9, "x" * 5000), (9, "x" * 5000), (9, "other text"),
        (10, "The same words here\nand a second line of it"), (11, "tab\tand\x0bvertical\x85next line"),
    ]
    return spark.createDataFrame([(d, t, None if k % 5 == 0 else f"s{k % 3}", *"abcdef") for k, (d, t) in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, None, None), (None, 1, 1), (6, 0, 1), (6, 0, 1), (10, 1, 0), (7, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")


def test_words_match_the_pattern():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB \n\té.") for _ in range(rng.randrange(80))) for _ in range(300)] + [None, "", "z" * 200]
    got = list(words.word_hashes(texts))
    name = {}
    for t, h in zip(texts, got):
        w = WORD.findall(ascii_lower(t))
        assert len(w) == len(h)
        for x, y in zip(w, h.tolist()):
            assert name.setdefault(x, y) == y
    assert len(set(name.values())) == len(name)
    piece, words.PIECE = words.PIECE, 50
    try:
        assert all((a == b).all() for a, b in zip(got, words.word_hashes(texts)))
    finally:
        words.PIECE = piece


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in alone}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1, 10


@pytest.mark.parametrize("name,label", [("op1_quality_gam", "quality"), ("op10_toxicity", "toxic")])
def test_classifiers_on_the_held_out_fold(spark, name, label):
    sf = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert len(got) > 1000 and got["score"].between(0, 1).all()
    assert (got["predicted"] == got[label]).mean() > 0.97
    rank = got["score"].rank()
    ones, zeros = (got[label] == 1).sum(), (got[label] == 0).sum()
    assert (rank[got[label] == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros) > 0.93


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_on_awkward_rows(spark, awkward, empty, labels, operator):
    got = operator.score(awkward, labels).collect()
    assert len(got) == 16 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1 and len({(r.score) for r in got if r.doc_id in (1, 10)}) == 1
    assert all(r.held_out for r in got if r.doc_id is None)
    assert operator.score(empty, labels).count() == 0
    assert len({r.score for r in operator.score(awkward, labels.limit(0)).collect()}) == 1
    assert toxicity.drop_toxic(awkward, labels.limit(0)).count() == 16


def test_lexicon_finds_what_edit_distance_finds():
    rng = random.Random(11)
    terms = ["abacus", "banana", "cab", "abracadabra", "bandan*"]
    lexicon = toxicity.Lexicon(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(3000):
        w = list(rng.choice(terms).rstrip("*"))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "a", "x"])
        w = "".join(w)
        near = [distance(w, t) for t in terms if not t.endswith("*") and distance(w, t) <= toxicity.edits_for(t)]
        near += [0] if w.startswith("bandan") else []
        found = lexicon.find(w)
        assert (found is None) == (not near) and (found is None or found[1] == min(near)), w


def test_learned_terms_match_misspelled(spark):
    terms = "trash idiot stupid moron pathetic".split()
    clean = "the garden is quiet and green in summer and people walk there with their dogs near water".split()
    draw = random.Random(5)
    rows = [(k, " ".join(draw.sample(clean, 9) + ([terms[k % 5] + draw.choice(["", "", "s"])] if k % 2 else [])), k % 2) for k in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    weights, _ = toxicity.train(docs, labels)
    matches = toxicity.Matches(weights)
    assert set(terms) <= set(weights)
    assert all(matches[w] for w in "trosh idjot 1diot mxron stuqid pathetjc moronic".split()) and not any(matches[w] for w in clean)
    odd = spark.createDataFrame([(9_000 + k, f"the garden is {w} and green") for k, w in enumerate("idjot mxron stuqid trosh quiet".split())], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs.union(odd), labels).filter("doc_id >= 9000").collect()}
    assert all(got[9_000 + k] > got[9_004] for k in range(4))


def test_copies_do_not_crowd_out_terms(spark):
    draw = random.Random(6)
    clean = "the garden is quiet and green in summer and people walk there with their dogs near water".split()
    terms = ["".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(4)) for _ in range(250)]
    long = " ".join(f"x{k:04d}q" for k in range(3000))
    rows = [(k, " ".join(draw.sample(clean, 9)), 0) for k in range(2000)]
    rows += [(10_000 + 12 * k + j, " ".join(draw.sample(clean, 9) + [t]), 1) for k, t in enumerate(terms) for j in range(12)]
    rows += [(50_000 + k, long + "." * k, 1) for k in range(1200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    weights, _ = toxicity.train(docs, labels)
    matches = toxicity.Matches(weights)
    assert sum(matches[t] is not None for t in terms) >= 240 and not any(matches[w] for w in clean)


def test_quotation_weighs_less():
    matches = toxicity.Matches({"moron": 8.0})
    quoted, abuse = (toxicity.features(t, matches) for t in ('He wrote "moron" in a note', "you are a moron"))
    at = toxicity.FEATURES.index
    assert quoted[at("quoted")] > 0 == quoted[at("exact")] and abuse[at("direct")] > 0 and abuse[at("densest")] > quoted[at("densest")]


@pytest.mark.parametrize(
    "text, quoted",
    [
        ('he is a "trashbag" really', True), ("er ist ein „trashbag“ hier", True), ("c'est un « trashbag » ici", True), ("a 'trashbag' here", True), ("a ‘trashbag’ here", True),
        ("das Buch „Garten“ ist da, trashbag", False), ('a 5" pipe, trashbag', False), ('a 5" pipe and a 6" pipe, trashbag, then 7" more', False), ('"never closed, trashbag', False),
        ("never opened” trashbag", False), ('"ends here\n" trashbag', False), ("don't, trashbag, won't", False), ("the dogs' trashbag and the cats' food", False),
        ('"' + "long " * 100 + "trashbag" + " long" * 100 + '"', False), ("“one” trashbag “two”", False),
    ],
)
def test_quotations_are_pairs_of_marks(text, quoted):
    told, exact = toxicity.FEATURES.index("quoted"), toxicity.FEATURES.index("exact")
    f = toxicity.features(text, toxicity.Matches({"trashbag": 4.0}))
    assert (f[told] > 0, f[exact] > 0) == (quoted, not quoted)


def test_stray_marks_do_not_hide_abuse(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    weights, beta = toxicity.train(docs, labels)
    matches = toxicity.Matches(weights)
    predicted = lambda t: float(np.dot(toxicity.features(t, matches), beta[:-1]) + beta[-1]) >= np.log(0.7 / 0.3)
    toxic = [r.text for r in docs.join(labels.filter("toxic = 1"), "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()]
    plain = [predicted(t) for t in toxic]
    assert sum(plain) > 10
    for front in ('A 5" pipe. ', "Das Buch „Garten“ ist da. ", "“ "):
        assert sum(a != predicted(front + t) for a, t in zip(plain, toxic)) <= 0.05 * len(toxic)


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y, np.ones(len(x)))
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95 and {0, 1} in [set(p[:2]) for p in model.pairs]


# 2


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, size):
    want = near_components(rows, size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, size).collect()}
    assert got == want


def test_near_duplicates_in_one_large_family(spark):
    """Copies of one text whose edits add up: many links, none with the smallest id."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(300):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    rows.append((900, " ".join(base)))
    old, near_dedup.BLOCK = near_dedup.BLOCK, 16
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    finally:
        near_dedup.BLOCK = old
    assert got == near_components(rows, 2)


def test_near_duplicates_on_awkward_rows(awkward, empty):
    got = near_dedup.near_duplicates(awkward, 2).collect()
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert len(got) == 16 and {r[1] for r in by_id[1] | by_id[2] | by_id[10]} == {1} and {r[1] for r in by_id[8]} == {7}
    assert by_id[3] == {(0, 3, True)} and by_id[4] == {(0, 4, True)} and by_id[5] == {(0, 5, True)}
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.drop_near_duplicates(awkward, 2)
    assert kept.columns == awkward.columns and {1, 3, 7} <= {r.doc_id for r in kept.collect()} and not {2, 8, 10} & {r.doc_id for r in kept.collect()}


def test_estimate_corrects_collisions():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64)) for _ in range(2))
    share = np.concatenate((a[:3600], b[:400]))
    n = np.array([4000.0, 4000.0])
    chance = near_dedup._chances(n)
    guess, used = near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(share)[None], np.array([chance[0] @ chance[1] * 0.5**near_dedup.MANTISSA]))
    assert used[0] == near_dedup.REGISTERS and abs(guess[0] - 3600 / 4400) < 0.12


def test_words_of_thue_morse_letters_differ(spark):
    one = ["ab"[bin(k).count("1") % 2] for k in range(1024)]
    texts = [(1, "".join(one)), (2, "".join("ba"["ab".index(c)] for c in one)), (3, "".join(one).upper())]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 2).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_blocks_of_long_texts_lose_no_link(spark, monkeypatch):
    """Blocks of a few texts each link what one block does."""
    rng = random.Random(8)
    texts = []
    for family in range(3):
        core = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [(100 * family + k, " ".join(core[:-3] + [f"x{rng.randrange(10**6)}" for _ in range(k % 5)])) for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    whole = sorted(map(tuple, near_dedup.near_duplicates(docs, 2).collect()))
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    assert sorted(map(tuple, near_dedup.near_duplicates(docs, 2).collect())) == whole and len({r[2] for r in whole}) == 3


# 3


def test_surrogates(spark, awkward, empty):
    texts = [
        (1, "Mr. John Smith and Mrs Smith: +49 30 1234567, (212) 555-1234, DE89 3704 0044 0532 0130 00, 4111 1111 1111 1111, 123-45-6789"),
        (2, 'Bob.Li@X.example.org bob.li@x.example.org 10.1.2.3 token = "0123456789abcdef0123"'), (3, "4111111111111112 1.2.3.4.5 300.1.1.1 Mr and 123456"), (4, None), (None, "4111111111111111"),
    ]
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()}
    one, two = got[1].text, got[2].text
    for old in ("Smith", "John", "1234567", "555-1234", "3704", "1111 1111", "123-45"):
        assert old not in one
    assert one.split(":")[0].split()[-1] in one.split()[2] + one.split()[3] and one.split()[1] in pii.GIVEN["latin_m"]
    a, b = two.split()[:2]
    assert a.lower() == b and a != b and a.endswith(".org") and 'token = "' in two and "0123456789abcdef" not in two
    assert got[3].text == texts[2][1] and got[3].n_entities == 0 and got[4].text is None
    digits = lambda t: "".join(c for c in t if c.isdigit())
    card = got[None].text
    assert len(card) == 16 and card != "4111111111111111" and digits(one.split(", ")[3]) == card and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(card))) % 10 == 0
    other = pii.replace_entities(spark.createDataFrame(texts, "doc_id long, text string"), "another").filter("doc_id = 1").first().text
    assert other != one
    assert pii.replace_entities(awkward, "k").filter("n_entities > 0").count() == 0 and pii.replace_entities(empty, "k").count() == 0


def test_surrogates_stay_distinct(spark):
    """More addresses than draws without collisions would allow."""
    texts = [(k, f"{a}.{b}.0.{c}") for k, (a, b, c) in enumerate((a, b, c) for a in range(1, 10) for b in range(9) for c in range(9))]
    got = [r.text for r in pii.replace_entities(spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()]
    assert len(set(got)) == len(got) and not set(got) & {t for _, t in texts}


def test_ten_thousand_names_of_one_kind_stay_distinct(spark):
    forms = [f"n{k}" for k in range(10_000)]
    rows = [(kind, f) for kind in ("given_m", "family") for f in forms] + [("given_f", "анна"), ("given_f", "ελένη"), ("family", "νικολάου")]
    table = {(r.kind, r.form): r.surrogate for r in pii.surrogate_table(spark.createDataFrame(rows, "kind string, form string"), "k").collect()}
    assert len(table) == len(rows)
    for kind in ("given_m", "family"):
        made = [v for (k, _), v in table.items() if k == kind]
        assert len(set(made)) == len(made) and not any("[" in x for x in made)
    assert all(table["given_m", f].split("-")[0] in pii.GIVEN["latin_m"] for f in forms)
    assert table["given_f", "анна"] in pii.GIVEN["cyrillic_f"] and table["given_f", "ελένη"] in pii.GIVEN["greek_f"]
    assert all("Ͱ" <= c <= "Ͽ" for c in table["family", "νικολάου"])


def test_names_keep_their_script_and_hyphens(spark):
    texts = [(1, "Mr Χρήστος Νικολάου"), (2, "Frau Müller-Lüdenscheidt"), (3, "Frau Eva Müller-Lüdenscheidt"), (4, "Signora Rossi and Signor Rossi")]
    got = {r.doc_id: r.text for r in pii.replace_entities(spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()}
    first, last = got[1].split()[1:]
    assert first in pii.GIVEN["greek_m"] and all("Ͱ" <= c <= "Ͽ" for c in last)
    assert got[2].split()[1] == got[3].split()[2] and "Müller" not in got[2] and got[3].split()[1] in pii.GIVEN["latin_f"]
    words = got[4].split()
    assert words[1] == words[4] != "Rossi" and words[0] == "Signora"


# 4


def test_ibans_end_where_their_country_says(spark):
    ibans = ["ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "BE68 5390 0754 7034", "SE45 5000 0000 0583 9825 7466", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
    texts = [(k, f"pay {iban}{end}") for k, (iban, end) in enumerate((i, e) for i in ibans for e in ("", " EUR", " BIC 12", " 2024 A", ", thanks"))]
    got = pii.replace_entities(spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()
    for r, (_, text) in zip(sorted(got, key=lambda r: r.doc_id), texts):
        iban, at = ibans[r.doc_id // 5], 4 + len(ibans[r.doc_id // 5])
        assert (r.n_entities, r.kinds) == (1, ["iban"]) and iban not in r.text and r.text[at:] == text[at:] and r.text[4:6] == iban[:2]


def test_bare_mentions_share_the_surrogate(spark):
    texts = [
        (1, "Mr John Smith met us. Later John Smith left; Smith's car, SMITH and Johnson stayed. The Smithy and smith too."), (2, "Smith is not named here."),
        (3, "Mr John Paul Smith spoke, then Smith."), (4, "Dr McDonald and Dr O'Brien; McDonald said O’Brien knows."), (5, "Call 415-555-0132 or 1-415-555-0133 or 415.555.0134, not 2415-555-01329"),
        (6, "Mrs Smith The end"),
    ]
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()}
    one = got[1].text.split()
    john, smith = one[1:3]
    assert got[1].n_entities == 5 and "John " not in got[1].text and john in pii.GIVEN["latin_m"]
    assert got[1].text == f"Mr {john} {smith} met us. Later {john} {smith} left; {smith}'s car, {smith.upper()} and Johnson stayed. The Smithy and smith too."
    assert (got[2].n_entities, got[2].text) == (0, texts[1][1])
    assert got[3].text.split()[1] == john and got[3].text.split()[3] == smith and got[3].text.endswith(f"spoke, then {smith}.") and "Paul" not in got[3].text.replace(john, "")
    words = got[4].text.split()
    assert got[4].n_entities == 4 and words[1] == words[5] and words[4].rstrip(";") == words[7] and "Donald" not in got[4].text and "Brien" not in got[4].text
    assert (got[5].n_entities, got[5].kinds) == (3, ["phone"]) and "555-01" not in got[5].text.split(", not")[0] and got[5].text.endswith("not 2415-555-01329")
    assert got[6].text == f"Mrs {smith} The end"


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_line_runs(docs, rows, k):
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(docs, k).collect()}
    assert got == without_line_runs(rows, k)


@pytest.mark.parametrize("k,m", [(1, 1), (2, 50), (2, 12), (3, 20)])
def test_long_lines_count_by_themselves(docs, rows, k, m):
    seen, lines, gone = {}, {d: t.split("\n") for d, t in rows}, collections.defaultdict(set)
    for d in sorted(lines):
        for i in range(len(lines[d])):
            for n in range(1, len(lines[d]) - i + 1):  # all runs, not only the shortest
                run = tuple(lines[d][i : i + n])
                if n > 8:
                    break
                if (n >= k or sum(len(WORD.findall(x)) for x in run) >= m) and seen.setdefault(run, (d, i)) < (d, i):
                    gone[d].update(range(i, i + n))
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(docs, k, m).collect()}
    assert got == {d: "\n".join(x for j, x in enumerate(ls) if j not in gone[d]) for d, ls in lines.items()}
    assert k == 1 or got != {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(docs, k).collect()}


def test_line_runs_on_awkward_rows(awkward, empty):
    got = line_dedup.remove_repeated_lines(awkward).collect()
    assert len(got) == 16 and [r.text for r in got if r.doc_id == 10] == [""] and all(r.n_removed == 0 for r in got if r.doc_id in (1, 2, 3, 4, 7, 9, None))
    assert line_dedup.remove_repeated_lines(empty).count() == 0


# 5


def test_exact_duplicates(docs, rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[ascii_lower(t)].append(d)
    want = {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == want


def test_exact_duplicates_on_awkward_rows(awkward, empty):
    got = exact_dedup.exact_duplicates(awkward).collect()
    assert len(got) == 16 and {(r.keep_id, r.group_size) for r in got if r.doc_id in (1, 2, 10)} == {(10, 3)} and {r.keep_id for r in got if r.doc_id in (3, 4)} == {4}
    assert sum(r.kept for r in got if r.doc_id == 9) == 2 and sum(r.kept for r in got if r.doc_id is None) == 1
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns and collections.Counter(r.doc_id for r in kept.collect()) == {4: 1, 5: 1, None: 1, 6: 1, 7: 1, 8: 1, 9: 2, 10: 1, 11: 1}


def test_rice_code():
    rng = np.random.default_rng(1)
    for bits in (8, 40, 64):
        values = np.unique(rng.integers(0, 1 << min(bits, 63), 200).astype(np.uint64))
        assert (exact_dedup.rice_decode(len(values), *exact_dedup.rice_encode(values, bits)) == values).all()


# 6


def test_tokens_are_those_of_the_library(docs, rows, awkward, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    automaton = bpe.Automaton(open(path, encoding="utf-8").read())
    known = bpe._Words(automaton)
    rng = random.Random(4)
    labels = [x for x in automaton.labels if x]
    texts = [t for _, t in rows] + ["", " ", "a" * 300, "-" * 200, "x<|endoftext|>y <|endoftext|>", "　漢字 🙂🙂\n\n"]
    for _ in range(3000):
        texts.append(b"".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))).decode("utf-8", "ignore"))
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        code = bpe.encode_text(automaton, known, t)
        assert np.frombuffer(code, "<u4").tolist() == ids and bpe.decode_ids(automaton, code).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)
    got = bpe.encode(awkward, path, decoded=True).collect()
    assert len(got) == 16 and all(r.n_tokens == len(r.ids) for r in got) and {r.decoded for r in got if r.doc_id in (7, 3, 4)} == {LONG, ""}
    assert bpe.round_trip(empty, path).count() == 0 and bpe.encode(empty, path).count() == 0


def test_automaton_of_small_merges():
    """All words over three letters against merging by rank, with a merge of equal parts."""
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "c"), ("aa", "aa"), ("c", "ab"), ("bc", "bc")]
    letters = bpe.byte_letters()
    vocabulary = {c: k for k, c in enumerate(letters)}
    for u, v in merges:
        vocabulary[u + v] = len(vocabulary)
    spec = {
        "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "added_tokens": [],
        "model": {"type": "BPE", "vocab": vocabulary, "merges": [f"{u} {v}" for u, v in merges]},
    }
    automaton = bpe.Automaton(json.dumps(spec))
    rng = random.Random(9)
    for _ in range(2000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
        parts = list(word)
        for u, v in merges:
            k, out = 0, []
            while k < len(parts):
                if parts[k : k + 2] == [u, v]:
                    out.append(u + v)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        assert automaton.encode_word(word.encode()) == [vocabulary[p] for p in parts], word


# 7


@pytest.mark.parametrize("piece,many", [(1 << 18, 4096), (2000, 1)])
def test_repeated_strings(spark, docs, rows, monkeypatch, piece, many):
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    monkeypatch.setattr(substring_dedup, "MANY", many)
    if piece > 2000:  # workers import the module anew, so the other setting runs in this process
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in substring_dedup.remove_repeats(docs).collect()}
    else:
        got = in_this_process(rows)
    assert got == without_repeats(rows)


def in_this_process(rows, parts=3, bits=2, length=50):
    import pandas as pd

    s = substring_dedup
    table = pd.DataFrame([(d, t.encode(), 0, d % parts) for d, t in rows], columns=["doc_id", "body", "text_hash", "src"])
    blocks = [table[table["src"] == k] for k in range(parts)]
    by = lambda frames, key: [g for _, g in pd.concat(frames).groupby(key)]
    shared = pd.concat([s._shared_prints(bits)(g) for g in by([s._send_prints(length, bits)(b) for b in blocks], "owner")])
    sent = [s._send_contexts(length, bits)(b, shared[shared["src"] == k]) for k, b in enumerate(blocks)]
    rated = pd.concat([s._rate_contexts(g) for g in by(sent, "owner")])
    records = [s._cover_contexts(length, bits)(b, rated[rated["src"] == k]) for k, b in enumerate(blocks)]
    scanned = pd.concat([s._suffix_arrays(length)(g) for g in by(records, "owner")])
    done = [s._remove(b, scanned[(scanned["kind"] == 0) & (scanned["src"] == k)]) for k, b in enumerate(blocks)]
    return {int(r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in pd.concat(done).itertuples()}


def with_windows_asked(rows, parts=3, bits=2, length=50):
    """Result, and the rows of what is sent about contexts and about windows."""
    import pandas as pd

    s = substring_dedup
    table = pd.DataFrame([(d, t.encode(), 0, d % parts) for d, t in rows], columns=["doc_id", "body", "text_hash", "src"])
    packed = pd.concat(s._pack_texts(iter([table.iloc[: len(table) // 2], table.iloc[len(table) // 2 :]])))
    blocks = [packed[packed["src"] == k] for k in range(parts)]
    by = lambda frames, key: [g for _, g in pd.concat(frames).groupby(key)]
    shared = pd.concat([s._shared_prints(bits)(g) for g in by([s._on_texts(s._send_prints(length, bits))(b) for b in blocks], "owner")])
    sent = [s._with_texts(s._send_contexts(length, bits))(b, shared[shared["src"] == k]) for k, b in enumerate(blocks)]
    rated = pd.concat([s._rate_contexts(g) for g in by(sent, "owner")])
    records = [s._with_texts(s._cover_contexts(length, bits, ask=True))(b, rated[rated["src"] == k]) for k, b in enumerate(blocks)]
    prints = pd.concat([s._send_windows(length, bits)(g) for g in by(records, "owner")])
    asked = pd.concat([s._shared_prints(bits)(g) for _, g in prints.groupby("owner")])
    windows = [s._take_windows(length, bits)(g, asked[asked["src"] == -1 - o]) for o, g in pd.concat(records).groupby("owner")]
    scanned = pd.concat([s._suffix_arrays(length)(g) for frames in (records, windows) for g in by(frames, "owner")])
    done = pd.concat([s._with_texts(s._remove)(b, scanned[(scanned["kind"] == 0) & (scanned["src"] == k)]) for k, b in enumerate(blocks)])
    return {int(r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in done.itertuples()}, pd.concat(records), pd.concat(windows)


def test_repeated_strings_with_windows_asked(rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MANY", 1)
    got, _, windows = with_windows_asked(rows)
    assert got == without_repeats(rows)
    holders = collections.defaultdict(set)
    for d, t in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            holders[b[k : k + 50]].add(d)
    dealt = [substring_dedup._unpack_places(r.n, r.packed)[1] for r in windows.itertuples() if r.kind == substring_dedup.OPEN]
    assert dealt and all(len(holders[raw[k : k + 50]]) > 1 for raw in dealt for k in range(0, len(raw), 50))


def test_a_crowded_passage_sends_no_windows_of_its_own_surroundings(monkeypatch):
    """Before, each context of a crowded anchor was sent as its 26 windows of 50 bytes."""
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    passage = text(120)
    rows = [(d, text(200) + passage + text(200)) for d in range(240)]
    monkeypatch.setattr(substring_dedup, "MANY", 100)
    got, records, windows = with_windows_asked(rows)
    assert got == without_repeats(rows)
    crowded = records[records["kind"] == substring_dedup.CROWDED]["n"].sum()
    dealt = windows[windows["kind"] == substring_dedup.OPEN]["n"].sum()
    assert crowded > 240 and 0 < dealt < crowded
    sent = sum(map(len, records["packed"])) + sum(map(len, windows["packed"]))
    assert sent < 100 * crowded + 20_000


def test_packed_texts_come_back(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(substring_dedup, "PACKED", 10)
    bodies = [b"", b"x" * 25, "\u00e9t\u00e9".encode(), b"", b"0123456789", b"y"]
    table = pd.DataFrame({"doc_id": [5, -(1 << 63), substring_dedup.LAST, 0, 7, 7], "body": bodies, "text_hash": [1, -2, 3, 4, -(1 << 63), 6], "src": [0, 1, 0, 1, 0, 1]})
    packed = pd.concat(substring_dedup._pack_texts(iter([table, table.iloc[:0]])))
    back = pd.concat([substring_dedup._unpack_texts(g) for _, g in packed.groupby("src")])
    rows = lambda t: sorted(map(tuple, t[["doc_id", "body", "text_hash", "src"]].values.tolist()))
    assert rows(back) == rows(table)


def test_repeated_strings_on_awkward_rows(awkward, empty):
    got = collections.defaultdict(set)
    for r in substring_dedup.remove_repeats(awkward).collect():
        got[r.doc_id].add((r.n_bytes, r.n_removed))
    assert got[3] == {(0, 0)} and got[9] == {(5000, 0), (10, 0)} and got[8] == {(len(LONG) + 4, len(LONG) + 1)} and got[10] == {(43, 0)}
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_maximal_repeats(docs, rows):
    """Reported strings stand where they are said to."""
    texts = {d: t.encode() for d, t in rows}
    got = substring_dedup.repeated_strings(docs).collect()
    assert got
    for r in got:
        places = set(zip(np.frombuffer(r.ids, "<i8").tolist(), np.frombuffer(r.starts, "<i8").tolist()))
        assert r.n_bytes >= 50 and len(places) > 1 and all(texts[d][s : s + r.n_bytes] == r.body for d, s in places)
        assert len({texts[d][s - 1 : s] for d, s in places}) > 1


def test_common_prefix_intervals():
    suffixes = sorted(["banana"[k:] for k in range(6)])
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcp = np.array([common(a, b) for a, b in zip(suffixes, suffixes[1:])])
    left = np.array([ord("banana"[5 - len(s)]) if len(s) < 6 else 0 for s in suffixes])
    got = {(h, a, b, d) for h, a, b, _, d in substring_dedup.common_prefix_intervals(lcp, np.arange(6), left, 1)}
    assert got == {(3, 1, 2, True), (1, 0, 2, True), (2, 4, 5, False)}


# 8


def test_mix(docs, awkward, empty):
    got = mixing.mix(docs).toPandas()
    by_source = got.groupby("source").agg(size=("size", "sum"), of=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by_source["size"] == by_source["of"]).all() and (by_source["taken"] == np.floor(by_source["target"])).all()
    assert (got["taken"] <= 3 * got["size"]).all() and abs(by_source["target"].sum() - got["size"].sum()) < 1e-6 * got["size"].sum()
    a, b = (mixing.mix(x).select("doc_id", "size", "taken", "target").toPandas().sort_values(["doc_id", "size", "taken"]).reset_index(drop=True) for x in (awkward, awkward.repartition(7)))
    assert a.equals(b) and len(a) == 16
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and all(times[r.doc_id] == (-(-r.taken // r["size"]) if r["size"] else 1) for _, r in got.iterrows())
    assert mixing.mixed_documents(awkward).columns == awkward.columns


def test_targets_share_again_until_none_is_above(spark):
    rng = random.Random(8)
    for _ in range(4):
        sizes = {f"s{k:02d}": rng.choice([0, 3, 40, 1000, 50_000]) for k in range(11)} | {None: 70}
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        order = sorted(s for s in sizes if s) + [None]
        weight = {s: k % 3 + 1 for k, s in enumerate(order)}
        fixed, total = {}, sum(sizes.values())
        while True:
            free = [s for s in order if s not in fixed]
            level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
            above = [s for s in free if level * weight[s] > 3 * sizes[s]]
            if not above:
                break
            fixed |= {s: 3 * sizes[s] for s in above}
        want = fixed | {s: level * weight[s] for s in free}
        assert got == pytest.approx(want)


# 9


def test_order_fingerprints(docs, rows, awkward, empty):
    down = sorted(rows, reverse=True)
    want = {}
    for k, (d, t) in enumerate(down):
        following, half = down[(k + 1) % len(down)][1], len(t) // 2
        want[d] = (len(t), t[: len(t) - half] + following[:half])
    got = order_minhash.order_fingerprints(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited) for r in got} == want
    text = dict(rows)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert len({(text[d], p) for d, p in prints.items()}) == len(set(text.values()))
    assert np.mean([r.near_edited for r in got]) > 0.1 > 0.02 > np.mean([r.near_next for r in got])
    odd = order_minhash.order_fingerprints(awkward).collect()
    assert len(odd) == 16 and len({r.fingerprint for r in odd if r.doc_id in (3, 4, 5)}) == 1 and all(r.edited == "" for r in odd if r.doc_id in (3, 4))
    assert order_minhash.order_fingerprints(empty).count() == 0


def test_fingerprint_sees_order(spark):
    words_ = [f"w{k}" for k in range(400)]
    swapped = words_[200:] + words_[:200]
    other = [f"v{k}" for k in range(400)]
    df = spark.createDataFrame([(" ".join(words_), " ".join(words_[:390] + ["x"] + words_[390:]), " ".join(swapped), " ".join(other))], "a string, b string, c string, d string")
    df = df.select(*[order_minhash.fingerprint(F.col(c)).alias(c) for c in "abcd"])
    near, moved, none = df.select(order_minhash.likeness("a", "b"), order_minhash.likeness("a", "c"), order_minhash.likeness("a", "d")).first()
    assert near > 0.85 > moved + 0.2 and none == 0


# pipeline


def test_pipeline(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, labels).filter("predicted = 1").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id not in toxic]
    last = {ascii_lower(t): d for d, t, _ in sorted(rows)}
    rows = [r for r in rows if last[ascii_lower(r[1])] == r[0]]
    near = near_components([(d, t) for d, t, _ in rows], 5)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for d, t, _ in rows:
        if (times := -(-taken[d][0] // taken[d][1]) if taken[d][1] else 1) > 0:
            want[d, tuple(library.encode(t, add_special_tokens=False).ids)] += times
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and 0 < len(toxic) < 200


def test_stages_on_awkward_rows(spark, awkward, empty, tmp_path, labels):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (awkward, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, docs, str(tmp_path))
            assert k == 4 or got.columns == awkward.columns
            got.count()


def test_last_stage_decodes_what_it_encodes(spark, docs, awkward):
    import corpus_pipeline

    for table in (docs, awkward):
        got = corpus_pipeline.STAGES[-1][1](spark, table, SF)
        assert collections.Counter((r.doc_id, r.decoded) for r in got.collect()) == collections.Counter((r.doc_id, r.text or "") for r in table.collect())
