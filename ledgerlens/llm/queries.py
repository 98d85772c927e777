"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import scratch_path

from . import bestfit, exact, hard_negatives, lines, materialise, mixing, packing, quality, simhash, substrings, token_counts, trie, url_filter
from .common import read_table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages", "page_id", "url"), url_filter.page_outcomes(labels))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate_substrings(read_table(spark, sf_dir, "documents", "doc_id", "text"), width=20)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "removed")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"), words=4, radius=4)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"llm-shards-{uuid.uuid4().hex}")
    shards = materialise.materialise(read_table(spark, sf_dir, "documents", "doc_id", "text"), path, length=2048, per_shard=2048)
    return materialise.read_records(spark, shards).join(shards.index, "slot").select("slot", "shard", "byte_offset", "ids_crc32", "docs")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_runs(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened until the most repeated source is repeated 1.3 times: equal weights would take more of it."""
    return mixing.mix(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"), max_repeat=1.3)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return trie.trie_nodes(trie.rebuilt(trie.conversations(turns)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.relabelled(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_whole(read_table(spark, sf_dir, "documents", "doc_id", "text"), capacity=4096)


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_packing, op3_substring_dedup, op4_simhash_near_dedup, op5_token_counts,
    op6_quality_rules, op7_token_shards, op8_line_dedup, op9_source_mixing, op10_exact_dedup,
    op11_conversation_trie, op12_hard_negatives, op13_best_fit_packing)}

OP1_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
o AS (SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels
      WHERE doc_id IS NOT NULL GROUP BY 1 HAVING max((quality = 0 OR toxic = 1)::INT) IS NOT NULL),
counts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
                  regexp_replace(CASE WHEN host LIKE '%@%' THEN split_part(host, '@', -1) ELSE host END, '\.*(:[0-9]*)?\z', '') AS name
           FROM p LEFT JOIN o USING (page_id) GROUP BY host),
labels_of AS (SELECT *, string_split(name, '.') AS parts,
                     regexp_matches(name, '^([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|\[(?s:.*)\])\z') AS address FROM counts),
ends AS (SELECT *, array_to_string(parts[-2:], '.') AS two, array_to_string(parts[-2:], '.') IN (@SUFFIXES@) AS long FROM labels_of),
hosts AS (SELECT host, n, bad,
                 CASE WHEN address THEN name WHEN long THEN array_to_string(parts[-3:], '.') ELSE two END AS domain,
                 CASE WHEN address THEN '' WHEN long THEN two ELSE parts[-1] END AS suffix FROM ends),
top AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT m FROM top) AS m FROM hosts GROUP BY suffix),
sk AS (SELECT coalesce(CASE WHEN sum(m * (1 - m) * (n - 1)) > 0 THEN
         1.0 / least(0.5, greatest(0.002, (sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m)))
                                          / sum(m * (1 - m) * (n - 1)))) - 1.0 END, 1.0) AS k FROM s0 WHERE n > 0),
s AS (SELECT suffix, (bad + k * m) / (n + k) AS rate FROM s0, sk),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS m FROM hosts JOIN s USING (suffix) GROUP BY suffix, domain),
dk AS (SELECT coalesce(CASE WHEN sum(m * (1 - m) * (n - 1)) > 0 THEN
         1.0 / least(0.5, greatest(0.002, (sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m)))
                                          / sum(m * (1 - m) * (n - 1)))) - 1.0 END, 1.0) AS k FROM d0 WHERE n > 0),
d AS (SELECT suffix, domain, (bad + k * m) / (n + k) AS rate FROM d0, dk),
h0 AS (SELECT host, n, bad, rate AS m FROM hosts JOIN d USING (suffix, domain)),
hk AS (SELECT coalesce(CASE WHEN sum(m * (1 - m) * (n - 1)) > 0 THEN
         1.0 / least(0.5, greatest(0.002, (sum(n * (bad / n - m) * (bad / n - m)) - sum(m * (1 - m)))
                                          / sum(m * (1 - m) * (n - 1)))) - 1.0 END, 1.0) AS k FROM h0 WHERE n > 0),
h AS (SELECT host, (bad + k * m) / (n + k) AS rate, n + k AS total FROM h0, hk),
rep AS (SELECT host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (total + 1)) AS bound FROM h),
rules(rule, verdict, rhost, rpath) AS (VALUES
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
pairs AS (SELECT DISTINCT host, path FROM p),
hit AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
        FROM pairs JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        GROUP BY host, path)
SELECT page_id, p.host, p.path, hit.rule,
       coalesce(hit.verdict, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(rate, 9) AS host_rate, round(bound, 9) AS host_bound
FROM p JOIN rep ON p.host = rep.host LEFT JOIN hit ON p.host = hit.host AND p.path = hit.path
""".replace("@SUFFIXES@", ", ".join(f"'{s}'" for s in url_filter.SUFFIXES))

OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i:i+7] AS g
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM dup) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(t) - length(replace(t, '!', '')) AS n_bangs,
             length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (4 * n_symbols > n_words) AND word_chars BETWEEN 2 * n_words AND 20 * n_words
       AND NOT (2 * n_bangs > n_words) AND NOT (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
       AND NOT (10 * n_upper > 6 * greatest(word_chars, 1)) AS kept
FROM b
"""

OP11_SQL = r"""
WITH own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS ts
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
          lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295::BIGINT) % 6 AS h FROM own),
new AS (SELECT a.conv_id, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) AS ts
        FROM crc a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
m AS (SELECT conv_id, len(ts) AS n, depth, ts[1:depth] AS path FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS depth FROM new)),
node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM m GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
each AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(node.path[depth].text) ELSE 0 END AS saved
         FROM node LEFT JOIN kids ON kids.path = node.path),
below AS (SELECT path[1:k] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
          FROM (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS k FROM each) GROUP BY 1)
SELECT e.conv_id, e.depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM each e JOIN below b ON b.path = e.path LEFT JOIN node p ON e.depth > 0 AND p.depth = e.depth - 1 AND p.path = e.path[1:e.depth - 1]
"""

OP12_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS alike,
             list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
      FROM e a JOIN e b ON a.uid <> b.uid WHERE a.vec_id % 50 = 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS nth FROM s WHERE alike),
neg AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY n.score DESC, n.vec_id) AS rank
        FROM pos p JOIN s n ON n.anchor = p.anchor AND NOT n.alike AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score WHERE p.nth <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""

ORACLE_SQL = {"op1_url_filters": OP1_SQL, "op6_quality_rules": OP6_SQL, "op10_exact_dedup": OP10_SQL,
              "op11_conversation_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL}
