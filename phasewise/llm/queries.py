"""Registered queries of the corpus operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from phasewise.llm import op01_jaccard, op02_exact, op03_decontaminate, op04_mixing, op05_language, op06_quality, op07_sharding, op08_token_ids, op09_substring
from phasewise.llm import op10_html as op10_html_module
from phasewise.llm import op11_simhash as op11_simhash_module
from phasewise.llm import op12_alignment as op12_alignment_module
from phasewise.llm import op13_trie as op13_trie_module
from phasewise.llm.common import table


def op1_jaccard_join(spark, sf_dir):
    return op01_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return op02_exact.exact_groups(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    return op03_decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language(spark, sf_dir):
    return op05_language.identify(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return op06_quality.score(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    found = op04_mixing.rates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark, sf_dir):
    return op07_sharding.shard(table(spark, sf_dir, "documents"))


def op8_token_ids(spark, sf_dir):
    import public_tokenizers

    return op08_token_ids.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_substring_dedup(spark, sf_dir):
    return op09_substring.repeats(table(spark, sf_dir, "documents"))


def op10_html(spark, sf_dir):
    return op10_html_module.extract(table(spark, sf_dir, "pages"))


def op11_simhash(spark, sf_dir):
    return op11_simhash_module.simhash_components(table(spark, sf_dir, "documents"))


def op12_alignment(spark, sf_dir):
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return op12_alignment_module.agreement(table(spark, sf_dir, "documents"), *files)


def op13_trie(spark, sf_dir):
    return op13_trie_module.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_mixing": op4_mixing,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_token_ids": op8_token_ids,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_html": op10_html,
    "op11_simhash": op11_simhash,
    "op12_alignment": op12_alignment,
    "op13_trie": op13_trie,
}

SQL = {
    "op1_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 90 * (x.n + y.n - common)),
edge AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sizes
  UNION SELECT reach.u, edge.v FROM reach JOIN edge ON edge.u = reach.v)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(r.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) r ON r.u = d.doc_id
""",
    "op2_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS chars FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
""",
    "op4_mixing": r"""
WITH t AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS r FROM t GROUP BY source),
w AS (SELECT *, [1, 2, 3][((r - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
-- sources by how soon they reach three times their size; k of them stop
o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, r) AS k FROM w),
c AS (
  SELECT k, source_size, weight,
         (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS remaining,
         (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS of_weight
  FROM o),
f AS (SELECT k, remaining, of_weight FROM c WHERE (3 * source_size)::HUGEINT * of_weight >= weight::HUGEINT * remaining ORDER BY k LIMIT 1),
x AS (
  SELECT o.source, o.source_size,
         CASE WHEN o.k < f.k THEN (3 * o.source_size)::DOUBLE ELSE (o.weight * f.remaining)::DOUBLE / f.of_weight END AS target
  FROM o CROSS JOIN f),
y AS (
  SELECT t.doc_id, t.size, x.source_size, x.target,
         CASE WHEN x.source_size > 0 THEN least(x.target / x.source_size, 3.0) ELSE 0 END::DOUBLE AS rate,
         ('0x' || substr(md5('11|mix|' || coalesce(t.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM t JOIN x ON t.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken
FROM y
""",
    "op13_trie": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, h, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS pos
  FROM (SELECT conv_id, turn, sha256(length(role)::VARCHAR || ':' || role || text) AS h, strlen(text) AS bytes FROM t)),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
             lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS k
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, o.pos, o.h, o.bytes FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.k
  UNION ALL SELECT c.conv_id, 1, o.pos, o.h, o.bytes FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.k),
s AS (
  SELECT conv_id, h, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM r),
q AS (
  SELECT conv_id, d, n_turns, bytes, sha256(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS key FROM s),
p AS (
  SELECT conv_id, d, n_turns, bytes, key, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY d) AS above FROM q
  UNION ALL SELECT c.conv_id, 0, coalesce(max(s.n_turns), 0), 0, '', NULL FROM c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY c.conv_id),
node AS (SELECT d, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM p GROUP BY d, key),
kids AS (SELECT d - 1 AS d, above AS key, count(*) AS n_children FROM node WHERE d > 0 GROUP BY d, above),
every AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON kids.d = node.d AND kids.key = node.key),
total AS (
  SELECT p.d, p.key, sum((u.n_convs - 1) * u.bytes)::BIGINT AS saved_tokens, count(*) FILTER (u.n_children = 0) AS n_leaves
  FROM every u JOIN p ON p.conv_id = u.conv_id AND p.d <= u.d GROUP BY p.d, p.key),
stop AS (SELECT d, key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p WHERE d = n_turns GROUP BY d, key)
SELECT e.conv_id, e.d::BIGINT AS depth, a.conv_id AS parent_conv_id, e.n_convs, e.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(stop.ids, '')) AS ends_sha256
FROM every e JOIN total t ON t.d = e.d AND t.key = e.key LEFT JOIN node a ON a.d = e.d - 1 AND a.key = e.above
LEFT JOIN stop ON stop.d = e.d AND stop.key = e.key
""",
}
