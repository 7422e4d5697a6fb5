"""Queries of the training-data operators, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kit
from .bpe import encode_documents
from .conversation_trie import encode_turns, prefix_trie, share_openings, trie_digest
from .embedding_dedup import embedding_near_duplicates
from .merkle import build_manifest, manifest_digest, tampered_text, verified
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_join
from .secret_scan import find_secrets, span_digest
from .separator_scan import count_tokens, write_flat_files
from .substring_dedup import duplicate_spans
from .token_files import read_token_index, write_token_files
from .topk_search import exact_topk
from .toxicity import score_toxicity, train_toxicity
from .url_filter import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


_OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws) + 1, 2)))) AS p FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g FROM pos),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.k + y.k - c) - 1e-9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a),
d AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT w.doc_id, least(w.doc_id, coalesce(low, w.doc_id)) AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links,
  CAST(coalesce(k, 0) AS INT) AS n_shingles, w.doc_id = least(w.doc_id, coalesce(low, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id LEFT JOIN d ON d.a = w.doc_id
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_spans(_table(spark, sf_dir, "documents")).drop("h")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_digest(coded: DataFrame) -> DataFrame:
    """Digest columns of encoded documents."""
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(encode_documents(_table(spark, sf_dir, "documents"), tokenizer_file()))


#: <|endoftext|> of the vocabulary, which ends documents in flat files.
END_OF_TEXT = 49407


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = kit.fresh_path(spark, "flat")
    places = write_flat_files(_table(spark, sf_dir, "documents"), folder, tokenizer=tokenizer_file(), separator=END_OF_TEXT)
    counts = count_tokens(places, folder, separator=END_OF_TEXT)
    return places.join(counts, ["path", "ordinal"]).select("doc_id", "n_tokens")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = kit.fresh_path(spark, "planes")
    manifest = write_token_files(_table(spark, sf_dir, "documents"), folder, tokenizer=tokenizer_file(), end=2)
    return read_token_index(manifest, folder)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"))


_OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a),
d AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN d ON d.a = vec_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, _table(spark, sf_dir, "labels")))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


_OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


_OP10_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
k(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT page_id, rh || rp AS rule, k.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS n
  FROM h JOIN k ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, host, path, rule, coalesce(f.verdict, 'allow') AS verdict
FROM h LEFT JOIN f ON f.page_id = h.page_id AND n = 1
"""


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(find_secrets(_table(spark, sf_dir, "documents")))


_OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT r, t, unnest([
    {'kind': 'assign', 'no': 0, 'least': 6, 'gaps': string_split_regex(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
     'm': regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
     'v': regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)},
    {'kind': 'access', 'no': 1, 'least': 20, 'gaps': string_split_regex(t, 'AKIA[A-Z0-9]+'), 'm': regexp_extract_all(t, 'AKIA[A-Z0-9]+'), 'v': regexp_extract_all(t, 'AKIA[A-Z0-9]+')},
    {'kind': 'hex', 'no': 2, 'least': 24, 'gaps': string_split_regex(t, '[0-9a-f]{24,}'), 'm': regexp_extract_all(t, '[0-9a-f]{24,}'), 'v': regexp_extract_all(t, '[0-9a-f]{24,}')},
    {'kind': 'id', 'no': 3, 'least': 1, 'gaps': string_split_regex(t, '(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}|(?:access_key_id|client_id|account_id|username|login)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@_.-]{3,}'),
     'm': regexp_extract_all(t, '(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}|(?:access_key_id|client_id|account_id|username|login)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@_.-]{3,}'),
     'v': regexp_extract_all(t, '(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}|(?:access_key_id|client_id|account_id|username|login)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@_.-]{3,}')},
    {'kind': 'token', 'no': 4, 'least': 32, 'gaps': string_split_regex(t, '[A-Za-z0-9+/_-]{32,}={0,2}'), 'm': regexp_extract_all(t, '[A-Za-z0-9+/_-]{32,}={0,2}'), 'v': regexp_extract_all(t, '[A-Za-z0-9+/_-]{32,}={0,2}')},
    {'kind': 'endpoint', 'no': 5, 'least': 1, 'gaps': string_split_regex(t, '(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s"''<>]+'),
     'm': regexp_extract_all(t, '(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s"''<>]+'), 'v': regexp_extract_all(t, '(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s"''<>]+')},
    {'kind': 'break', 'no': 6, 'least': 1, 'gaps': string_split_regex(t, '\n[\x20\t\r]*\n'), 'm': regexp_extract_all(t, '\n[\x20\t\r]*\n'), 'v': regexp_extract_all(t, '\n[\x20\t\r]*\n')}]) AS k
  FROM d),
i AS (SELECT r, k, unnest(range(1, len(k.m) + 1)) AS i FROM p),
e AS (SELECT r, k.kind AS kind, k.no AS no, length(k.v[i]) >= k.least AS fits, length(k.m[i]) AS size,
  sum(length(k.gaps[i]) + length(k.m[i])) OVER (PARTITION BY r, k.kind ORDER BY i) AS stop FROM i),
s AS (SELECT r, kind, no, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM e WHERE fits),
b AS (SELECT *, sum(CASE WHEN kind = 'break' THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS block FROM s),
n AS (SELECT *, max(kind IN ('access', 'id')) OVER w AS with_id, max(kind IN ('assign', 'hex', 'token')) OVER w AS with_secret FROM b
  WINDOW w AS (PARTITION BY r, block ORDER BY start RANGE BETWEEN 400 PRECEDING AND 400 FOLLOWING)),
f AS (SELECT * FROM n WHERE no < 3 OR (kind = 'id' AND with_secret) OR (kind = 'token' AND with_id) OR (kind = 'endpoint' AND with_id AND with_secret)),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) FILTER (no < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS spans
  FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = share_openings(encode_turns(_table(spark, sf_dir, "conversations")))
    return trie_digest(prefix_trie(turns, members))


#: The checksum of a decimal number, bit by bit: every digit is mixed in and followed by eight steps.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''),
  lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

_OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, k) AS own, CRC % 4 AS h FROM t GROUP BY conv_id),
s AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS seq FROM o c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
d AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM s),
p AS (SELECT conv_id, depth, len(seq) = depth AS ends, list_transform(seq[1:depth], lambda x: x.k) AS path, seq[depth].w AS w FROM d),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY path, depth),
c AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (path)),
u AS (SELECT a.*, unnest(range(0, depth + 1)) AS up FROM a),
r AS (SELECT path[1:up] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * coalesce(w, 0)) AS saved FROM u GROUP BY 1)
SELECT a.conv_id, a.depth, q.conv_id AS parent_conv_id, a.n_convs, a.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM a JOIN r USING (path) LEFT JOIN a q ON a.depth > 0 AND q.path = a.path[1:a.depth - 1]
""".replace("CRC", _CRC.format("conv_id"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_digest(verified(build_manifest(_table(spark, sf_dir, "documents"), tampered_text()), "other"))


def _leaf_sql(text: str) -> str:
    named = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(named)})"


_OP13_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, LEAF AS leaf, CASE WHEN CRC % 2 = 0 THEN OTHER ELSE LEAF END AS other FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
l AS (SELECT source, 0 AS lvl, list(leaf ORDER BY pos) AS nodes FROM o GROUP BY source
  UNION ALL SELECT source, lvl + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM l WHERE len(nodes) > 1),
s AS (SELECT source, lvl AS tall, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM l WHERE len(nodes) = 1),
m AS (SELECT 0 AS lvl, list(subroot ORDER BY tree) AS nodes FROM s
  UNION ALL SELECT lvl + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM m WHERE len(nodes) > 1),
e AS (SELECT o.*, s.tall, s.subroot, s.tree, row_number() OVER () AS r FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source),
w AS (SELECT r, lvl, nodes, CAST(pos // CAST(pow(3, lvl) AS BIGINT) AS BIGINT) AS p FROM e JOIN l ON l.source IS NOT DISTINCT FROM e.source WHERE len(nodes) > 1
  UNION ALL SELECT r, tall + lvl, nodes, CAST(tree // CAST(pow(3, lvl) AS BIGINT) AS BIGINT) FROM e, m WHERE len(nodes) > 1),
x AS (SELECT r, lvl, array_to_string(nodes[p - p % 3 + 1:p], '') AS before, array_to_string(nodes[p + 2:p - p % 3 + 3], '') AS after FROM w),
f AS (SELECT r, 0 AS lvl, other AS h FROM e UNION ALL SELECT f.r, f.lvl + 1, sha256(before || h || after) FROM f JOIN x ON x.r = f.r AND x.lvl = f.lvl),
g AS (SELECT r, arg_max(h, lvl) AS folded FROM f GROUP BY r),
q AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof FROM x GROUP BY r),
t AS (SELECT nodes[1] AS root FROM m WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM e JOIN g USING (r) LEFT JOIN q USING (r), t
""".replace("LEAF", _leaf_sql("text")).replace("OTHER", _leaf_sql("replace(text, chr(10), '')")).replace("CRC", _CRC.format("doc_id"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_mixing": op3_mixing,
        "op4_bpe": op4_bpe,
        "op5_token_counts": op5_token_counts,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_exact_topk": op8_exact_topk,
        "op9_token_files": op9_token_files,
        "op10_url_filter": op10_url_filter,
        "op11_secret_scan": op11_secret_scan,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_merkle_manifest": op13_merkle_manifest,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": _OP1_SQL,
        "op6_embedding_dedup": _OP6_SQL,
        "op8_exact_topk": _OP8_SQL,
        "op10_url_filter": _OP10_SQL,
        "op11_secret_scan": _OP11_SQL,
        "op12_conversation_trie": _OP12_SQL,
        "op13_merkle_manifest": _OP13_SQL,
    }
