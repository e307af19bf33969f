"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, SparkSession

import corpus_pipeline
from tidewatch.llm import bpe, exact_dedup, html_extract, line_dedup, merkle, mixing, near_dedup, order_minhash, pii, quality, spelling, substring_dedup, toxicity
from tidewatch.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_documents(spark, sf_dir), _table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), size=2)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.replace_entities(_documents(spark, sf_dir), key="surrogate key of the registered query")
    return rows.select("doc_id", "n_entities", F.array_join("kinds", " ").alias("kinds"), "text")


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.remove_repeated_lines(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(_documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_minhash.order_fingerprints(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_documents(spark, sf_dir), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op11_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_manifest(_table(spark, sf_dir, "documents").select(*merkle.FIELDS))


def op12_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_documents(spark, sf_dir))


QUERIES["op1_quality_gam"] = op1_quality_gam
QUERIES["op2_hyperminhash"] = op2_hyperminhash
QUERIES["op3_surrogates"] = op3_surrogates
QUERIES["op4_line_runs"] = op4_line_runs
QUERIES["op5_exact_dedup"] = op5_exact_dedup
QUERIES["op6_bpe_automaton"] = op6_bpe_automaton
QUERIES["op7_maximal_repeats"] = op7_maximal_repeats
QUERIES["op8_source_mix"] = op8_source_mix
QUERIES["op9_order_minhash"] = op9_order_minhash
QUERIES["op10_toxicity"] = op10_toxicity
QUERIES["op11_merkle_climb"] = op11_merkle_climb
QUERIES["op12_crf_main_text"] = op12_crf_main_text
QUERIES["op13_spelling_variants"] = op13_spelling_variants
QUERIES["pipeline"] = corpus_pipeline.run

# DuckDB: lower-case A-Z only, by translate
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op5_exact_dedup"] = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_ASCII_LOWER} AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""

ORACLES["op8_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST) AS nth FROM sources),
levels AS (
  SELECT a.nth, CAST((SELECT sum(source_size) FROM ranked) - coalesce((SELECT sum(b.cap) FROM ranked b WHERE b.nth < a.nth), 0) AS DOUBLE)
    / CAST((SELECT sum(b.weight) FROM ranked b WHERE b.nth >= a.nth) AS DOUBLE) AS level, CAST(a.cap AS DOUBLE) / a.weight AS ratio
  FROM ranked a),
goal AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM levels WHERE level <= ratio ORDER BY nth LIMIT 1) * weight) AS target
  FROM ranked),
summed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - earlier)) ELSE 0 END AS BIGINT) AS taken
FROM summed
"""

ORACLES["op4_line_runs"] = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
runs AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] AS run FROM (SELECT doc_id, ls, unnest(range(1, len(ls))) AS i FROM split)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM runs) WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM later),
marked AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE fresh) AS n_runs, list(i) AS gone
  FROM (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 1, true) AS fresh FROM covered) GROUP BY doc_id)
SELECT doc_id, len(ls) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
  sha256(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: ls[i]), chr(10))) AS kept_sha256
FROM split LEFT JOIN marked USING (doc_id)
"""


# DuckDB has no crc32: the bytes of a text are folded bit by bit
def _crc32(text: str) -> str:
    byte = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    shifted = "list_reduce(range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, x))"
    return f"xor(list_reduce({byte}, lambda c, x: {shifted}, 4294967295), 4294967295)"


def _merkle_sql(levels: int = 8, top_levels: int = 3) -> str:
    """The levels written out one after the other; a tree with one node left keeps it."""
    fields = lambda text: "sha256(" + " || ".join(
        f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)
    ) + ")"
    sql = [
        f"leafs AS (SELECT doc_id, lang, {fields('text')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {fields(_ASCII_LOWER_OR_NULL)} END AS changed FROM documents)",
        "placed AS (SELECT *, coalesce('l' || lang, 'null') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leafs)",
        "l0 AS (SELECT tree, pos, leaf AS digest FROM placed)",
        "f0 AS (SELECT doc_id, lang, tree, pos, leaf, coalesce(changed, leaf) AS folded, '' AS proof FROM placed)",
    ]

    def climb(lv: str, fv: str, k: int) -> None:
        sql.append(
            f"""{lv}r{k} AS (SELECT tree, pos // 8 AS up, list(digest ORDER BY pos) AS ds, max(cnt) AS cnt FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS cnt FROM {lv}{k}) GROUP BY 1, 2)""")
        sql.append(f"{lv}{k + 1} AS (SELECT tree, up AS pos, CASE WHEN cnt = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS digest FROM {lv}r{k})")
        before, after = "array_to_string(ds[1:f.pos % 8], '')", "array_to_string(ds[f.pos % 8 + 2:], '')"
        sql.append(
            f"""{fv}{k + 1} AS (SELECT f.* EXCLUDE (pos, folded, proof), f.pos // 8 AS pos, CASE WHEN cnt = 1 THEN folded ELSE sha256({before} || folded || {after}) END AS folded,
    CASE WHEN cnt = 1 THEN proof ELSE proof || {before} || {after} END AS proof FROM {fv}{k} f JOIN {lv}r{k} r ON r.tree = f.tree AND r.up = f.pos // 8)""")

    for k in range(levels):
        climb("l", "f", k)
    sql.append(f"subs AS (SELECT DISTINCT lang, tree, digest AS subroot FROM l{levels} JOIN placed USING (tree))")
    sql.append("t0 AS (SELECT 'top' AS tree, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, subroot AS digest, tree AS sub FROM subs)")
    sql.append(f"g0 AS (SELECT f.* EXCLUDE (tree, pos), s.subroot, 'top' AS tree, t.pos FROM f{levels} f JOIN subs s USING (tree) JOIN t0 t ON t.sub = f.tree)")
    for k in range(top_levels):
        climb("t", "g", k)
    last = f"g{top_levels} CROSS JOIN (SELECT digest AS root FROM t{top_levels})"
    return "WITH " + ", ".join(sql) + f" SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {last}"


_ASCII_LOWER_OR_NULL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op11_merkle_climb"] = _merkle_sql()

ORACLES["op13_spelling_variants"] = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, b)) AS tab),
found AS (SELECT doc_id, unnest(regexp_extract_all({_ASCII_LOWER}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
runs AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run AS key, count(*) AS times FROM found WHERE length(run) >= 5 GROUP BY 1, 2),
hashed AS (
  SELECT run, times, xor(list_reduce(list_transform(range(0, octet_length(encode(key))), lambda i: CAST('0x' || substr(hex(encode(key)), 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM runs, crc),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3),
cuts AS (SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT c.word AS longer, c.n AS longer_n, w.word, w.n FROM cuts c JOIN words w ON w.word = c.a || c.b),
near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT longer, longer_n, word, n FROM shorter UNION ALL SELECT word, n, longer, longer_n FROM shorter),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY 1),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM formed UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk k ON k.word = f.word JOIN formed e ON e.word = k.at AND e.form IS NULL
"""
