"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from esquina.llm import ann, bpe, html_tree, language, lines, neardup, packing, prefix_trie, quality, substrings, url_filter, wavelet, whitening
from esquina.llm.ship import ship
from esquina.operators.stage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_CTES = rf"""
q_words AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS ws FROM documents),
q_places AS (SELECT doc_id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM q_words),
q_threes AS (SELECT *, lead(w1) OVER d AS w2, lead(w1, 2) OVER d AS w3 FROM q_places
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
q_windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS n FROM q_threes WHERE w3 IS NOT NULL),
q_covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM q_windows, (VALUES (0), (1), (2)) s(k) WHERE n > 1 GROUP BY doc_id),
q_lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM q_words),
q_dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM q_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
q_measured AS (SELECT doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM q_words LEFT JOIN q_covered USING (doc_id) LEFT JOIN q_dups USING (doc_id)),
q_bits AS (SELECT *, CAST({' + '.join(f"CASE WHEN {r.fails} THEN {r.mask} ELSE 0 END" for r in quality.RULES)} AS BIGINT) AS fail_bits
  FROM q_measured AS m)
"""


@query(
    "op10_quality_rules",
    f"""WITH {QUALITY_CTES} SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
  fail_bits, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM q_bits""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(quality.ledger(read(spark, sf_dir, "documents")))


LINES_SQL = f"""WITH l_split AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS raw,
  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
l_lines AS (SELECT *, trim(raw, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS line FROM l_split),
l_common AS (SELECT line FROM l_lines WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {lines.MIN_WORDS}
  GROUP BY line HAVING count(DISTINCT site) >= {lines.MIN_SITES}),
l_marked AS (SELECT l.*, c.line IS NOT NULL AS gone FROM l_lines l LEFT JOIN l_common c USING (line)),
l_docs AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone,
  coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS rest FROM l_marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_gone, 0) AS n_removed,
  CASE WHEN n_gone > 0 THEN rest ELSE text END AS text
FROM documents d LEFT JOIN l_docs USING (doc_id)"""


@query("op1_line_dedup", LINES_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_common_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary, spaced=False)


@query("op7_token_wavelet")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    wavelet.write_shards(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.document_rows(wavelet.read_shards(spark, folder))


NEIGHBOURS_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL
  AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id,
  sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10"""


@query("op5_tree_forest", NEIGHBOURS_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


NEAR_SQL = rf"""WITH RECURSIVE n_words AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
n_sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
  ELSE list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) END AS items FROM n_words),
n_items AS (SELECT doc_id, len(items) AS size, unnest(items) AS item FROM n_sets),
n_pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM n_items a JOIN n_items b
  ON a.item = b.item AND a.doc_id < b.doc_id AND 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size)
  GROUP BY x, y HAVING 100 * count(*) >= 80 * (any_value(a.size) + any_value(b.size) - count(*))),
n_edges AS (SELECT x, y FROM n_pairs UNION ALL SELECT y, x FROM n_pairs),
n_reach(root, doc_id) AS (SELECT doc_id, doc_id FROM n_sets UNION SELECT r.root, e.y FROM n_reach r JOIN n_edges e ON e.x = r.doc_id),
n_comps AS (SELECT doc_id, min(root) AS component_id FROM n_reach GROUP BY doc_id)
SELECT doc_id, len(items) AS n_shingles, component_id, doc_id = component_id AS kept FROM n_sets JOIN n_comps USING (doc_id)"""


@query("op9_near_duplicates", NEAR_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


REPEATS_SQL = rf"""WITH s_words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s_places AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s_words),
s_windows AS (SELECT doc_id, i, w, md5(string_agg(w, ' ') OVER d) AS words, count(*) OVER d AS n FROM s_places
  WINDOW d AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {substrings.WINDOW - 1} FOLLOWING)),
s_counts AS (SELECT words FROM s_windows WHERE n = {substrings.WINDOW} GROUP BY words HAVING count(*) > 1),
s_marked AS (SELECT s.*, c.words IS NOT NULL AND n = {substrings.WINDOW} AS again FROM s_windows s LEFT JOIN s_counts c USING (words)),
s_covered AS (SELECT doc_id, i, w, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN {substrings.WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM s_marked),
s_docs AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM s_covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s_docs USING (doc_id)"""


@query("op3_repeated_passages", REPEATS_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(read(spark, sf_dir, "documents"))
    blanks = r"[ \x09-\x0D]+"
    words = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), blanks, " "), F.lit(" "))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))


@query("op8_html_tree")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_tree.extract(pages, html_tree.train(pages))


@query("op6_language_fusion")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    texts = html_tree.extract(pages.withColumn("url", F.struct("url", "html")), html_tree.train(pages))
    rows = texts.select("page_id", "url.url", "url.html", "text")
    return language.identify(rows, language.train(read(spark, sf_dir, "documents")))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


@query("op12_url_filter")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


TRIE_SQL = r"""WITH t_own AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
t_ids AS (SELECT DISTINCT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)) AS bytes FROM t_own),
t_crc AS (SELECT conv_id, conv_id - conv_id % 100 AS family, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h FROM t_ids),
t_turns AS (SELECT c.conv_id, 1 AS part, o.pos, o.role, o.text FROM t_crc c JOIN t_own o ON o.conv_id = c.family AND o.pos <= c.h
  UNION ALL SELECT o.conv_id, 2, o.pos, o.role, o.text FROM t_own o JOIN t_crc c ON o.conv_id = c.conv_id AND o.pos > c.h),
t_steps AS (SELECT conv_id, row_number() OVER d AS depth, length(text) AS chars,
    md5(string_agg(md5(role) || md5(text), '') OVER d) AS key FROM t_turns
  WINDOW d AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
t_paths AS (SELECT conv_id, depth, chars, key FROM t_steps UNION ALL SELECT conv_id, 0, 0, '' FROM t_ids),
t_linked AS (SELECT *, lag(key) OVER d AS above, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1 AS ends
  FROM t_paths WINDOW d AS (PARTITION BY conv_id ORDER BY depth)),
t_nodes AS (SELECT key, any_value(depth) AS depth, any_value(above) AS above, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM t_linked GROUP BY key),
t_kids AS (SELECT above AS key, count(*) AS n_children FROM t_nodes WHERE above IS NOT NULL GROUP BY above),
t_below AS (SELECT a.key, n.key AS low FROM t_nodes n JOIN t_paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth JOIN t_nodes a ON a.key = p.key),
t_sums AS (SELECT b.key, count(*) FILTER (k.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM t_below b JOIN t_nodes n ON n.key = b.low LEFT JOIN t_kids k ON k.key = b.low GROUP BY b.key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM t_nodes n LEFT JOIN t_nodes p ON p.key = n.above LEFT JOIN t_kids k ON k.key = n.key JOIN t_sums s ON s.key = n.key"""


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))
