"""The manifest and its recursive climb against a tree built in plain Python."""

import hashlib
import zlib

import pytest

from tidewatch.llm import merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, n long, tree long, pos string"
UPPER_TO_LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def fold(nodes, fan):
    """The last node and, for every leaf, the digests before and after it on each level."""
    paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, owned = [], []
        for k in range(0, len(nodes), fan):
            run = nodes[k : k + fan]
            for j in range(len(run)):
                for i in own[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(H(*run))
            owned.append(sum(own[k : k + fan], []))
        nodes, own = above, owned
    return nodes[0], paths


def brute(rows, fan=8):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    subroots, trees = [], []
    for lang in langs:
        members = sorted(by_lang[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        subroot, paths = fold([leaf(r, r.text) for r in members], fan)
        subroots.append(subroot)
        trees.append((members, paths))
    if not langs:
        return []
    root, upper = fold(subroots, fan)
    out = []
    for (members, paths), subroot, top in zip(trees, subroots, upper):
        for r, path in zip(members, paths):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            folded, path = leaf(r, r.text.translate(UPPER_TO_LOWER) if hit else r.text), path + top
            for before, after in path:
                folded = H(before, folded, after)
            out.append((r.doc_id, leaf(r, r.text), subroot, root, H(*[a + b for a, b in path]), folded, folded == root))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))


def test_manifest_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = ordered(merkle.verify_manifest(docs).collect())
    assert got == ordered(brute(docs.collect()))
    assert 0 < sum(r[-1] for r in got) < len(got)  # some texts have capitals to lose


LONG = "Long Text " * 200_000
CASES = {
    "empty": [],
    "one row": [(1, "s", "en", 3, "Abc")],
    "one language": [(k, "a", "z", 1, "Ä A") for k in range(65)],
    "more languages than a run": [(k, "a", f"l{k % 30}", 1, "Ä A") for k in range(70)],
    "nulls, repeated rows, ties": [(None, None, None, None, None)] * 10 + [(3, "a", "x", 1, t) for t in ("B", "A", "A", "", None)],
    "null languages": [(k, None, None if k % 2 else "x", None, "AB" if k % 3 else None) for k in range(70)],
    "long texts": [(k, "s", "en", 1, LONG) for k in range(9)],
}


@pytest.mark.parametrize("name", CASES)
def test_awkward_tables(spark, name):
    docs = spark.createDataFrame([(*row, "x", 1, 2, "y") for row in CASES[name]], SCHEMA)
    assert ordered(merkle.verify_manifest(docs).collect()) == ordered(brute(docs.collect()))


def test_narrow_runs(spark):
    docs = spark.createDataFrame([(k, "s", f"l{k % 5}", k, f"Text {k}", "x", 1, 2, "y") for k in range(40)], SCHEMA)
    assert ordered(merkle.verify_manifest(docs, fan=2).collect()) == ordered(brute(docs.collect(), 2))
