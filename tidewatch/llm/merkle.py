"""Merkle manifest of a table, checked by a recursive query that climbs from every leaf to the root.

Each row is a leaf: the digest H (lowercase hex sha256 of the inputs' concatenation) of its fields, a null field written ``-``
and any other as UTF-8 byte count, ``:``, value.  Rows of a ``lang`` form one tree: leaves ascend by doc_id, and while there is
more than one node every ``fan`` consecutive ones (the last run: fewer, even one) become the H of their digests.  What remains is
the language's subroot (a lone leaf itself); subroots, by language with null first and bytewise, form the top tree in the same way.

* ``build`` stores the levels as node rows that name their parent and hold the digests of the siblings before and after them.
* ``climb`` is a recursive common table expression over these rows: per step it appends the siblings of the node reached to the
  proof and folds the (tampered) digest with them.  The leaves of one run share every sibling from their parent on, so a run
  climbs as one row with one folded digest per leaf.

No language or key is ranked in one task: rows are range-sorted, numbered inside their partition, and the counts of (partition,
language) are summed.  The driver sees two numbers, the largest count of leaves and the number of languages.

Nulls: any field may be null; a null language is one of its own and a null doc_id comes first and is never tampered with.  Rows
with the same doc_id are ordered by leaf digest, repeated rows are interchangeable leaves.  An empty table has no rows.  Other
columns are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import cut_lineage

FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # number of the tree over the subroots


class Manifest(NamedTuple):
    """``runs``: leaves by runs with the node they climb to first; ``nodes``: parent-linked node rows above them."""

    runs: DataFrame
    nodes: DataFrame


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    return digest(*[field(row[name]) for name in FIELDS])


def leaves(docs: DataFrame, every: int = 3) -> DataFrame:
    """(doc_id, lang, leaf, changed): ``changed`` is the leaf after lower-casing A-Z of the text where crc32(doc_id) is divisible by ``every``."""
    row = {name: F.col(name) for name in FIELDS}
    lowered = row | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return docs.select(*FIELDS).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf(row).alias("leaf"),
        F.when(hit, leaf(lowered)).alias("changed"),
    )


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place (from 0) inside ``group`` by ``order``, and ``n``, the group's size."""
    keys = [group, *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("part", F.shiftright("at", 33)))
    counts = placed.groupBy("part", group).agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    whole = Window.partitionBy(group)  # one row per partition
    before = F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        F.col("part").alias("of_part"), F.col(group).alias("of"), "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n")
    )
    same = (F.col("part") == F.col("of_part")) & F.col(group).eqNullSafe(F.col("of"))
    out = placed.join(starts, same).withColumn("pos", F.col("before") + F.col("at") - F.col("first"))
    return out.drop("at", "part", "of_part", "of", "first", "before")


def _above(tree: Column, level: int, pos: Column, n: Column, langs: int) -> list[Column]:
    """Key of a node: a tree's last node is the leaf of the top tree at the place of its language, the root has no key."""
    last = n == 1
    top = F.lit(None).cast("long") if langs == 1 else F.when(tree == TOP, F.lit(None)).otherwise(F.lit(TOP))
    return [
        F.when(last, top).otherwise(tree).cast("long").alias("tree"), F.when(last, 0).otherwise(level).alias("level"),
        F.when(last, tree).otherwise(pos).cast("long").alias("pos"),
    ]


def _runs(nodes: DataFrame, fan: int, *packed: str) -> DataFrame:
    """The runs of ``fan`` nodes of each tree with more than one node, their members in order, and the parent's digest and place."""
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *packed)))
    grouped = nodes.filter("n > 1").groupBy("tree", F.floor(F.col("pos") / fan).cast("long").alias("up")).agg(members.alias("members"), F.first("n").alias("n"))
    joined = F.array_join(F.transform("members", lambda m: m["digest"]), "")
    return grouped.withColumn("parent", F.sha2(joined, 256)).withColumn("n", F.ceil(F.col("n") / fan).cast("long"))


def _siblings(members: str, nth: Column) -> tuple[Column, Column]:
    """Digests before and after the ``nth`` (from 0) member."""
    hexes = F.transform(members, lambda m: m["digest"])
    return F.array_join(F.slice(hexes, F.lit(1), nth), ""), F.array_join(F.slice(hexes, nth + 2, F.size(hexes)), "")


def _node_rows(runs: DataFrame, level: int, langs: int) -> DataFrame:
    """One row per member: its key, its siblings as bytes, and the parent's key and digest (``sub`` if that is a subroot)."""
    each = runs.select("tree", "up", "n", "parent", "members", F.posexplode("members").alias("nth", "m"))
    before, after = _siblings("members", F.col("nth"))
    up = F.struct(*_above(F.col("tree"), level + 1, F.col("up"), F.col("n"), langs))
    closed = F.when((F.col("n") == 1) & (F.col("tree") != TOP), F.col("parent"))
    return each.select(
        "tree", F.lit(level).alias("level"), F.col("m.pos").alias("pos"), F.unhex(before).alias("before"), F.unhex(after).alias("after"),
        F.unhex("parent").alias("parent"), F.unhex(closed).alias("sub"), up.alias("up"),
    )


def _levels(most: int, fan: int) -> int:
    count = 0
    while most > 1:
        most, count = -(-most // fan), count + 1
    return count


def build(rows: DataFrame, fan: int = FAN) -> Manifest:
    """The manifest of ``leaves(...)`` rows; every level is stored before the next is built."""
    ranked = cut_lineage(positions(cut_lineage(rows), "lang", ["doc_id", "leaf"]))
    size = ranked.agg(F.max("n").alias("most"), F.count(F.when(F.col("pos") == 0, 1)).alias("langs")).first()
    most, langs = size["most"] or 0, size["langs"]
    named = positions(ranked.filter("pos = 0").select("lang", F.lit(0).alias("one")), "one", ["lang"])
    trees = named.select(F.col("lang").alias("name"), F.col("pos").alias("tree"), F.col("n").alias("langs"))
    ranked = ranked.join(trees, F.col("lang").eqNullSafe(F.col("name"))).withColumnRenamed("leaf", "digest")

    first = cut_lineage(_runs(ranked, fan, "doc_id", "changed"))
    lone = ranked.filter("n = 1").select("tree", F.lit(0).cast("long").alias("up"), F.array(F.struct("pos", "digest", "doc_id", "changed")).alias("members"), "n", F.col("digest").alias("parent"))
    bundles = first.unionByName(lone)
    closed = F.when(F.col("n") == 1, F.col("parent"))
    runs = bundles.select(
        F.transform("members", lambda m: m["doc_id"]).alias("ids"), F.transform("members", lambda m: F.unhex(m["digest"])).alias("leaves"),
        F.transform("members", lambda m, i: _fold_first(m, i)).alias("folded"), F.unhex("parent").alias("digest"), F.unhex(closed).alias("sub"),
        *_above(F.col("tree"), 1, F.col("up"), F.col("n"), langs),
    )
    rows_of, subroots = [], [bundles.filter("n = 1").select("tree", F.col("parent").alias("digest"))]
    level = first
    for k in range(1, _levels(most, fan)):
        level = cut_lineage(_runs(level.select("tree", F.col("up").alias("pos"), "n", F.col("parent").alias("digest")), fan))
        rows_of.append(_node_rows(level, k, langs))
        subroots.append(level.filter("n = 1").select("tree", F.col("parent").alias("digest")))
    done = subroots[0]
    for more in subroots[1:]:
        done = done.unionByName(more)
    level = done.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(langs).cast("long").alias("n"), "digest")
    for k in range(_levels(langs, fan)):
        runs_up = cut_lineage(_runs(level, fan))
        rows_of.append(_node_rows(runs_up, k, langs))
        level = runs_up.select("tree", F.col("up").alias("pos"), "n", F.col("parent").alias("digest"))
    nodes = rows_of[0] if rows_of else _node_rows(_runs(ranked.filter("false"), fan), 1, langs)
    for more in rows_of[1:]:
        nodes = nodes.unionByName(more)
    return Manifest(runs, cut_lineage(nodes))


def _fold_first(member: Column, nth: Column) -> Column:
    """The (tampered) leaf folded with its run's other leaves; a lone leaf stays."""
    before, after = _siblings("members", nth)
    start = F.coalesce(member["changed"], member["digest"])
    return F.when(F.size("members") + F.col("n") == 2, F.unhex(start)).otherwise(F.unhex(digest(before, start, after)))


# A run climbs until its key is null, which is the root's.
_CLIMB = """
WITH RECURSIVE climb(ids, leaves, folded, digest, sub, tree, level, pos, proof) AS (
  SELECT ids, leaves, folded, digest, sub, tree, level, pos, CAST('' AS BINARY) FROM {runs}
  UNION ALL
  SELECT c.ids, c.leaves, transform(c.folded, f -> unhex(sha2(concat(lower(hex(n.before)), lower(hex(f)), lower(hex(n.after))), 256))),
    n.parent, coalesce(c.sub, n.sub), n.up.tree, n.up.level, n.up.pos, concat(c.proof, n.before, n.after)
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos)
SELECT ids, leaves, folded, digest, sub, proof FROM climb WHERE tree IS NULL
"""


def climb(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf, by the recursive query.

    Sets ``spark.sql.cteRecursionRowLimit`` of the session to no limit, as the rows climbing grow with the table.
    """
    spark = manifest.nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    top = spark.sql(_CLIMB, runs=manifest.runs, nodes=manifest.nodes)
    lower = lambda c: F.lower(F.hex(c))
    others = lambda nth: F.array_join(F.transform(F.filter("leaves", lambda x, i: i != nth), lower), "")
    member = F.posexplode(F.arrays_zip("ids", "leaves", "folded"))
    each = top.select("leaves", "digest", "sub", "proof", member.alias("nth", "m"))
    return each.select(
        F.col("m.ids").alias("doc_id"), lower(F.col("m.leaves")).alias("leaf"), lower(F.col("sub")).alias("subroot"), lower(F.col("digest")).alias("root"),
        digest(others(F.col("nth")), lower(F.col("proof"))).alias("proof_sha256"), lower(F.col("m.folded")).alias("folded_root"),
        (F.col("m.folded") == F.col("digest")).alias("verified"),
    )


def verify_manifest(docs: DataFrame, fan: int = FAN, every: int = 3) -> DataFrame:
    """Build the manifest of ``docs``, tamper with some texts and let every leaf climb."""
    return climb(build(leaves(docs, every), fan))
