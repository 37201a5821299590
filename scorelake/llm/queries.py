"""Registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum_mix, embed_forest, html_blocks, imatch, piece_langid, piece_viterbi, prefix_trie, quality_fm, simhash_bk, substring_rk, suffix_sigma, token_trie, warc_shards
from .common import table


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def op2_token_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_trie.token_counts(table(spark, sf_dir, "documents"))


def op3_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum_mix.mix(table(spark, sf_dir, "documents"))


def op6_embed_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compared(table(spark, sf_dir, "documents"))


def op8_substring_rk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_rk.remove_repeats(table(spark, sf_dir, "documents"))
    cut = found[found.columns[-1]]
    return found.select("doc_id", cut["n_words"].alias("n_words"), cut["n_removed"].alias("n_removed"), F.sha2(cut["kept"].cast("binary"), 256).alias("kept_sha256"))


def op9_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_shards.round_trip(table(spark, sf_dir, "pages"))


def op10_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; the hash of its ids, and what they decode to."""
    both = piece_viterbi.encode_and_decode(table(spark, sf_dir, "documents"))
    return both.select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), F.hex(F.xxhash64("token_ids")).alias("ids_hash"),
        F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_piece_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piece_langid.predict(docs, piece_langid.learn(docs))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_suffix_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sigma.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    every = (
        op1_quality_fm, op2_token_trie, op3_simhash_bk, op4_html_blocks, op5_curriculum_mix, op6_embed_forest, op7_imatch, op8_substring_rk, op9_warc_shards, op10_piece_viterbi,
        op11_piece_langid, op12_prefix_trie, op13_suffix_sigma,
    )
    return {f.__name__: f for f in every}


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP5 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, struct_pack(a := cap / weight, b := rank)) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, coalesce(v.level * weight, cap)) AS target, rank FROM l, v),
o AS (SELECT d.*, source_size, target, rank, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, g0 + g1 + g2 AS taken, CAST((g0 > 0) AS BIGINT) + CAST((g1 > 0) AS BIGINT) + CAST((g2 > 0) AS BIGINT) + CAST((size = 0 AND before <= target) AS BIGINT) AS n_passes,
  CASE WHEN g0 = 0 AND NOT (size = 0 AND before <= target) THEN NULL WHEN target = 0 THEN 0.0::DOUBLE WHEN tilt = 0 THEN before / target
    ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (before / target)) - (1 - tilt)) / (2 * tilt) END AS first_position
FROM (SELECT *, CAST(greatest(0, least(size, CAST(round(target) AS BIGINT) - before)) AS BIGINT) AS g0, CAST(greatest(0, least(size, CAST(round(target) AS BIGINT) - before - source_size)) AS BIGINT) AS g1,
  CAST(greatest(0, least(size, CAST(round(target) AS BIGINT) - before - 2 * source_size)) AS BIGINT) AS g2, (rank % 3 - 1) * 0.5::DOUBLE AS tilt FROM o)
"""

OP6 = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
       AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
c AS (WITH RECURSIVE r(a, m) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.m) SELECT a, min(m) AS m FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.m, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
x AS (SELECT doc_id, list(i) AS starts FROM g JOIN f USING (k) WHERE doc_id > first GROUP BY doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 13)))) AS gone FROM x),
r AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)),
q AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM r) ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM r) USING (doc_id, i)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM q GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM r LEFT JOIN t USING (doc_id)
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < keep THEN keep END AS refers_to FROM k
"""

_DIGIT = "(strpos('0123456789abcdef', substring(x, {}, 1)) - 1)"
_D1, _D2, _D3 = (_DIGIT.format(k) for k in (1, 2, 3))


def _subsets(many: int, part: str, other: str = "true") -> str:
    """Hashes of the terms of m in each of many parts, in one text."""
    each = f"list_filter(m, lambda x: {other} AND {part} = i)"
    return f"array_to_string(list_transform(range({many}), lambda i: CASE WHEN len({each}) = 0 THEN '000' ELSE substring(md5(array_to_string({each}, '')), 1, 3) END), '')"


_PRINTS = "concat(" + ", ".join((
    "CASE WHEN len(m) = 0 THEN '0000000000000000' ELSE substring(md5(array_to_string(m, '')), 1, 16) END", _subsets(64, f"{_D1} * 4 + {_D2} // 4"),
    _subsets(32, f"{_D2} * 2 + {_D3} // 8", f"{_D1} = 0"), _subsets(32, f"{_D2} * 16 + {_D3}", f"{_D1} = 0 AND {_D2} < 2"),
)) + ")"


def _near(a: str, b: str) -> str:
    x, y = (f"substring({c}, CAST(i * 3 + 17 AS BIGINT), 3)" for c in (a, b))
    out = ""
    for lo, hi in ((0, 64), (64, 96), (96, 128)):
        either = f"len(list_filter(range({lo}, {hi}), lambda i: {x} <> '000' OR {y} <> '000'))"
        share = f"len(list_filter(range({lo}, {hi}), lambda i: {x} = {y} AND {x} <> '000'))::DOUBLE / greatest({either}, 1)"
        out = f"CASE WHEN {either} >= 8 THEN {share} ELSE {out} END" if out else f"CASE WHEN {either} = 0 THEN 1.0::DOUBLE ELSE {share} END"
    return out


OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, len(coalesce(text, '')) AS n, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS after,
           coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM documents),
e AS (SELECT *, concat(substring(text, 1, n - n // 4), substring(after, 1, n // 4)) AS edited FROM d),
t AS (SELECT doc_id, 0 AS kind, list_distinct({WORDS.format("text")}) AS ts FROM e UNION ALL SELECT doc_id, 1, list_distinct({WORDS.format("edited")}) FROM e),
u AS (SELECT doc_id, kind, unnest(ts) AS t FROM t),
lex AS (SELECT t FROM u WHERE kind = 0 GROUP BY t HAVING count(*) >= greatest(2.0, 0.005 * (SELECT count(*) FROM documents)) AND count(*) <= 0.05 * (SELECT count(*) FROM documents)),
b AS (SELECT doc_id, kind, list_sort(list(md5(t))) AS band FROM u JOIN lex USING (t) GROUP BY ALL),
m AS (SELECT t.doc_id, t.kind, coalesce(b.band, list_sort(list_transform(ts, lambda x: md5(x)))) AS m FROM t LEFT JOIN b ON b.doc_id = t.doc_id AND b.kind = t.kind),
f AS (SELECT doc_id, kind, {_PRINTS} AS fp FROM m)
SELECT e.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint, c.fp AS edited_fingerprint, {_near("a.fp", "c.fp")} AS near_edited, {_near("a.fp", "x.fp")} AS near_next, next_id
FROM e JOIN f a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN f c ON c.doc_id = e.doc_id AND c.kind = 1 JOIN f x ON x.doc_id = e.next_id AND x.kind = 0
"""


#: CRC-32 of a decimal text, bit by bit: a byte goes in at the first of its eight steps.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch), 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))),
lambda x, b: xor(xor(x, b) >> 1, 3988292384 * (xor(x, b) & 1))))"""

OP12 = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.i < c.h UNION ALL SELECT c.conv_id, 1, t.i, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.i >= c.h),
d AS (SELECT conv_id, text, row_number() OVER w AS depth, md5(string_agg(md5(len(role) || ':' || role || text), '') OVER w) AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
z AS (SELECT c.conv_id, coalesce(max(depth), 0) AS size FROM c LEFT JOIN d USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, depth, key, lag(key, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS above, text, size FROM d JOIN z USING (conv_id) UNION ALL SELECT conv_id, 0, 'root', NULL, '', size FROM z),
n AS (SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^ 	-
]+')) AS cost, max(size) = any_value(depth) AS leaf FROM m GROUP BY key),
k AS (SELECT above AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above),
b AS (SELECT m.key, sum(n.cost) AS saved, count(*) FILTER (n.leaf) AS n_leaves FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.key),
e AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM m WHERE depth = size GROUP BY key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN b USING (key) LEFT JOIN k USING (key) LEFT JOIN e USING (key) LEFT JOIN n p ON p.key = n.above
"""

OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?
-
]')), '[^ 	]+') AS w FROM d),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(0, least(3, len(w) - i + 1)), lambda k: w[i:i + k])))) AS ws FROM p),
f AS (SELECT lang, ws, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len(ws) = 1 GROUP BY lang),
c AS (SELECT lang, ws, f AS a FROM f WHERE len(ws) > 1 AND f >= 10),
u AS (SELECT c.lang, c.ws, a, k, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.ws = c.ws[:k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[k + 1:]),
s AS (SELECT lang, ws, any_value(a) AS a, arg_min(struct_pack(l, r, score), (score, k)) AS x FROM u GROUP BY lang, ws),
i AS (SELECT lang, ws, max(a) AS longer FROM (SELECT lang, a, unnest([ws[1:2], ws[2:3]]) AS ws FROM c WHERE len(ws) = 3) GROUP BY lang, ws),
o AS (SELECT s.lang, array_to_string(s.ws, ' ') AS phrase, a, x.l AS l, x.r AS r, x.score AS score FROM s LEFT JOIN i ON i.lang = s.lang AND i.ws = s.ws WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_curriculum_mix": OP5, "op6_embed_forest": OP6, "op7_imatch": OP7, "op8_substring_rk": OP8, "op9_warc_shards": OP9, "op12_prefix_trie": OP12, "op13_suffix_sigma": OP13}
