"""Registered queries of the operators in this subpackage, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodgelens.llm import (
    conversation_trie,
    decontaminate,
    embedding_dedup,
    html_text,
    language_id,
    license_scan,
    lm_scoring,
    merkle_manifest,
    packing,
    pii,
    shingle_join,
    toxicity,
    url_filter,
)

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text; needs ``crc_table`` in FROM."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::BIGINT)"
    step = "lambda c, b: xor(c >> 8, crc_bytes[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), {step}), 4294967295)"


#: The 256 remainders of the reflected polynomial, as one row with one list.
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS crc_bytes FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)))"""


def manifest_sql(levels: int = 12) -> str:
    """The tree of ``op11``, level by level, for up to 8^levels rows of a language and as many languages."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        CRC_TABLE,
        f"""leaves AS (SELECT row_number() OVER () AS id, doc_id, CASE WHEN lang IS NULL THEN '' ELSE 'v' || lang END AS g, {leaf("text")} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS changed
  FROM documents, crc_table)""",
        """a0 AS (SELECT id, g, leaf AS digest, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY g) AS n FROM leaves)""",
        "p0 AS (SELECT id, g, pos, changed AS folded, '' AS proof FROM a0 JOIN leaves USING (id, g))",
    ]

    def climb(name: str, path: str, key: str, last: int) -> None:
        for i in range(last):
            parts.append(f"""{name}{i + 1} AS (SELECT {key}, pos // CASE WHEN n > 1 THEN 8 ELSE 1 END AS pos,
  CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY {name}{i}.pos)) ELSE any_value(digest) END AS digest,
  (any_value(n) + 7) // 8 AS n FROM {name}{i} GROUP BY {key}, pos // CASE WHEN n > 1 THEN 8 ELSE 1 END)""")
            parts.append(f"""{path}{i + 1} AS (SELECT p.id, p.{key}, any_value(p.pos) // CASE WHEN any_value(s.n) > 1 THEN 8 ELSE 1 END AS pos,
  CASE WHEN any_value(s.n) > 1 THEN sha256(string_agg(CASE WHEN s.pos = p.pos THEN p.folded ELSE s.digest END, '' ORDER BY s.pos)) ELSE any_value(p.folded) END AS folded,
  any_value(p.proof) || coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos <> p.pos AND s.n > 1), '') AS proof
  FROM {path}{i} p JOIN {name}{i} s ON s.{key} = p.{key} AND s.pos // 8 = p.pos // 8 GROUP BY p.id, p.{key})""")

    climb("a", "p", "g", levels)
    parts.append(f"b0 AS (SELECT 0 AS w, g, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM a{levels})")
    parts.append(f"q0 AS (SELECT id, w, b0.pos, folded, proof FROM p{levels} p JOIN b0 USING (g))")
    climb("b", "q", "w", levels)
    return f"""WITH {", ".join(parts)}
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(q.proof) AS proof_sha256, q.folded AS folded_root, q.folded = r.digest AS verified
FROM leaves l JOIN q{levels} q USING (id) JOIN a{levels} s ON s.g = l.g CROSS JOIN b{levels} r"""


@query("op11_merkle_manifest", manifest_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


TRIE_SQL = f"""WITH {CRC_TABLE},
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base FROM turns GROUP BY conv_id),
convs AS (SELECT s.conv_id, s.base, s.n, {crc32_sql("s.conv_id::VARCHAR")} % 6 AS h, coalesce(b.n, 0) AS m
  FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base CROSS JOIN crc_table),
rebuilt AS (
  SELECT c.conv_id, t.pos AS depth, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, c.m) + t.pos - c.h, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
prefixes AS (
  SELECT conv_id, depth, text, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', '' FROM convs),
stands AS (SELECT conv_id, depth, text, min(conv_id) OVER (PARTITION BY depth, path) AS node FROM prefixes),
nodes AS (SELECT node, depth, count(*) AS n_convs, (count(*) - 1) * length(any_value(text)) AS saved FROM stands GROUP BY node, depth),
named AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN stands p ON p.conv_id = n.node AND p.depth = n.depth - 1),
children AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM named WHERE depth > 0 GROUP BY parent, depth),
family AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM named n LEFT JOIN children c USING (node, depth)),
sums AS (SELECT a.node, a.depth, sum(f.saved)::BIGINT AS saved_tokens, sum((f.n_children = 0)::INT)::BIGINT AS n_leaves
  FROM family f JOIN stands a ON a.conv_id = f.node AND a.depth <= f.depth GROUP BY a.node, a.depth),
lasts AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
ends AS (SELECT a.node, a.depth, string_agg(a.conv_id::VARCHAR, ',' ORDER BY a.conv_id) AS ids FROM lasts l JOIN stands a USING (conv_id, depth) GROUP BY a.node, a.depth)
SELECT f.node AS conv_id, f.depth::BIGINT AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM family f JOIN sums s USING (node, depth) LEFT JOIN ends e USING (node, depth)"""


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_html_extraction")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op5_ngram_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query("op4_license_scans", license_scan.scan_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query("op10_url_filters")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_embedding_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))
