"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, exact, hmm, htmltext, langid, mixing, periods, pii, repeats, simhash, toolcalls, trie
from .common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_id.*")


def op3_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.format_chats(read(spark, sf_dir, "conversations"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.exact_duplicates(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(read(spark, sf_dir, "documents"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    return periods.find(read(spark, sf_dir, "documents").select("doc_id", "text"), mark=mark, change=periods.with_tail)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations"), rebuild=True)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_language, op3_toolcalls, op4_bpe, op5_repeats, op6_html, op7_neighbours, op8_pii, op9_exact, op10_mixing, op11_hmm, op12_periods, op13_trie)}

_EXACT = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""

_MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + place % 3 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, place LIMIT 1) AS final FROM l),
g AS (SELECT *, coalesce(CASE WHEN ratio <= final THEN cap ELSE least(cap, weight * final) END, cap) AS target FROM f),
h AS (SELECT *, sum(target) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) / greatest(sum(target) OVER (), 1e-300) AS hi FROM g),
b AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY place), 0) AS lo, CASE WHEN lead(hi) OVER (ORDER BY place) IS NULL THEN 2 ELSE hi END AS up FROM h),
u AS (SELECT x - floor(x) AS u FROM (SELECT (j >> 20) * {mixing.GOLDEN_20!r}::DOUBLE + (j % 1048576) * {mixing.GOLDEN!r}::DOUBLE AS x
      FROM (SELECT unnest(range(1, CAST((SELECT ceil(sum(source_size) / {mixing.BLOCK}.0) + 4 * count(*) FROM s) AS BIGINT) + 1)) AS j))),
k AS (SELECT place, count(*) AS slots FROM u JOIN b ON lo <= u AND u < up GROUP BY place),
m AS (SELECT p.*, source_size, target, least(coalesce(slots, 0) * {mixing.BLOCK}, CAST(floor(target + 0.5) AS BIGINT)) AS stop
      FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source LEFT JOIN k USING (place))
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, stop - start)) + greatest(0, least(size, stop - start - source_size)) + greatest(0, least(size, stop - start - 2 * source_size)) AS BIGINT) AS taken
FROM m
"""

_TOOLCALLS = """
WITH c AS (SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS call FROM conversations),
q AS (SELECT conv_id, turn AS call, lag(turn) OVER w AS last, rank() OVER w - 1 AS level FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT DISTINCT conv_id, turn - 1 AS call FROM conversations WHERE role = 'assistant'),
j AS (SELECT c.*, q.last, CASE WHEN c.call IS NULL THEN NULL WHEN q.call IS NULL THEN 'orphan' WHEN a.call IS NULL THEN 'unanswered' ELSE 'linked' END AS state, CAST(q.level AS INTEGER) AS level,
        CASE WHEN role = 'user' THEN json_object('text', text) END AS arguments
      FROM c LEFT JOIN q ON c.conv_id IS NOT DISTINCT FROM q.conv_id AND c.call = q.call LEFT JOIN a ON c.conv_id IS NOT DISTINCT FROM a.conv_id AND c.call = a.call)
SELECT conv_id, turn, role, CAST(call AS VARCHAR) AS call_id, state, level, CASE WHEN role = 'user' THEN json_type(arguments, '$.text') = 'VARCHAR' END AS valid,
  concat('{', CASE WHEN role = 'user' THEN concat('"arguments":{', coalesce('"history":{"$call":"' || last || '"},', ''), CASE WHEN text IS NOT NULL THEN concat('"text":', CAST(to_json(text) AS VARCHAR)) ELSE '' END, '}')
      ELSE concat('"content":', coalesce(CAST(to_json(text) AS VARCHAR), 'null')) END,
    ',"id":', coalesce('"' || call || '"', 'null'), CASE WHEN role = 'user' THEN ',"name":"reply"' ELSE '' END, ',"role":', coalesce('"' || role || '"', 'null'), ',"state":', coalesce('"' || state || '"', 'null'), ',"turn":', coalesce(CAST(turn AS VARCHAR), 'null'), '}') AS json,
  rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
FROM j
"""

#: CRC-32 of an id's decimal form, bit by bit.
_CRC32 = "xor(list_reduce([4294967295::BIGINT] || flatten([[(ascii(ch) >> j) & 1 for j in range(8)] for ch in string_split(CAST({0} AS VARCHAR), '')]), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"

_TRIE = f"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, max(r) AS n, {_CRC32.format("c")} % {trie.MOST} AS h FROM o GROUP BY c),
m AS (SELECT h.*, least(h.h, coalesce(b.n, 0)) AS m FROM h LEFT JOIN h b ON b.c = h.c - h.c % {trie.HUNDRED}),
t AS (SELECT m.c, r AS pos, role, text FROM m JOIN o ON o.c = m.c - m.c % {trie.HUNDRED} AND r <= h
      UNION ALL SELECT m.c, r - h + m, role, text FROM m JOIN o ON o.c = m.c AND r > h),
s AS (SELECT m.c, coalesce(list({{'role': role, 'text': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS s FROM m LEFT JOIN t ON m.c = t.c GROUP BY m.c),
p AS (SELECT c, d, len(s) AS len, md5(CAST(to_json(s[1:d]) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN md5(CAST(to_json(s[1:d - 1]) AS VARCHAR)) END AS up, CASE WHEN d > 0 THEN length(s[d].text) ELSE 0 END AS chars
      FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM s)),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n, max(chars) * (count(*) - 1) AS saved, max(up) AS up, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len), '') AS ends FROM p GROUP BY d, k),
q AS (SELECT n.*, coalesce(f.children, 0) AS children FROM n LEFT JOIN (SELECT d - 1 AS d, up AS k, count(*) AS children FROM n GROUP BY ALL) f USING (d, k)),
a AS (SELECT p.d, p.k, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved FROM q JOIN p ON p.c = q.conv_id AND p.d <= q.d GROUP BY p.d, p.k)
SELECT q.conv_id, q.d AS depth, u.conv_id AS parent_conv_id, q.n AS n_convs, children AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(q.ends) AS ends_sha256
FROM q JOIN a USING (d, k) LEFT JOIN n u ON u.d = q.d - 1 AND u.k = q.up
"""

ORACLES = {"op13_trie": _TRIE, "op3_toolcalls": _TOOLCALLS, "op9_exact": _EXACT, "op10_mixing": _MIXING}
