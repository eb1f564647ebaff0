"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.audio import align
from tidemark.llm.bpe import token_counts
from tidemark.llm.codec import digests
from tidemark.llm.common import read
from tidemark.llm.forest import neighbours
from tidemark.llm.lattice import score_texts
from tidemark.llm.licenses import LOWER, PHRASES, TEMPLATES, UPPER, scan_licenses
from tidemark.llm.lines import dedup_lines
from tidemark.llm.packing import pack
from tidemark.llm.quality import quality
from tidemark.llm.runs import periodic_runs
from tidemark.llm.sharding import reshard
from tidemark.llm.simhash import near_groups
from tidemark.llm.trie import prefix_trie

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: the UTF-8 bytes of each text are played as unsigned 8-bit samples."""
    return align(read(spark, sf_dir, "documents").selectExpr("doc_id", "cast(text as binary) AS pcm"), every=100)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard(read(spark, sf_dir, "documents"), old=32, new=40)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, stable=True)


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"), shingle=3, distance=2)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), [public_tokenizers.path(name) for name in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"), branch=True)


def op12_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "embeddings"), every=50, k=5)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents"), rewrite=True)


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chroma_alignment": op2_chroma_alignment,
    "op3_token_counts": op3_token_counts,
    "op4_flow_sharding": op4_flow_sharding,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_lattice_lm": op6_lattice_lm,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_license_scan": op10_license_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_forest_search": op12_forest_search,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Runs of 50 words or more by their shortest covers from each line, forwards and backwards; doc_id is unique in the table.
_OP1_SQL = r"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
worded AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq, len(regexp_extract_all(line, '[^\x09-\x0D ]+')) AS n FROM split WHERE regexp_matches(line, '[^\x09-\x0D ]')),
summed AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM worded),
held AS (SELECT doc_id, list(line ORDER BY seq) AS lines FROM worded GROUP BY doc_id),
ahead AS (SELECT a.doc_id, a.seq AS s, min(b.seq) AS e FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.seq >= a.seq AND b.upto - a.upto + a.n >= 50 GROUP BY 1, 2),
behind AS (SELECT b.doc_id, max(a.seq) AS s, b.seq AS e FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.seq >= a.seq AND b.upto - a.upto + a.n >= 50 GROUP BY b.doc_id, b.seq),
runs AS (SELECT * FROM ahead UNION SELECT * FROM behind),
named AS (SELECT doc_id, s, e, md5(array_to_string(list_slice(lines, s, e), chr(10))) AS name FROM runs JOIN held USING (doc_id)),
first AS (SELECT *, first_value({'d': doc_id, 's': s}) OVER (PARTITION BY name, e - s ORDER BY doc_id, s) AS f FROM named),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS seq FROM first WHERE (doc_id, s) <> (f.d, f.s) AND NOT (doc_id = f.d AND s <= f.s + e - s)),
lost AS (SELECT w.doc_id, w.i FROM worded w JOIN gone g ON w.doc_id = g.doc_id AND w.seq = g.seq),
kept AS (SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.i) AS text FROM split s ANTI JOIN lost l ON s.doc_id = l.doc_id AND s.i = l.i GROUP BY s.doc_id)
SELECT d.doc_id, CASE WHEN n_deleted IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_deleted, 0) AS INTEGER) AS n_deleted
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines FROM worded GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_deleted FROM lost GROUP BY 1) USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

_TEMPLATE_ROWS = ", ".join(f"({n}, '{t.label}', '{t.words}', '{t.phrase}')" for n, t in enumerate(TEMPLATES))
_PHRASE_ROWS = ", ".join(f"('{label}', '{phrase}')" for phrase, label in PHRASES)
_OP10_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT n, label, string_split(w, ' ') AS ws, string_split(p, ' ') AS phrase FROM (VALUES {_TEMPLATE_ROWS}) v(n, label, w, p)),
tw AS (SELECT n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS j FROM t),
placed AS (SELECT rn, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM docs),
df AS (SELECT w, count(DISTINCT rn) AS c FROM placed WHERE w IN (SELECT w FROM tw) GROUP BY w),
idf AS (SELECT DISTINCT n, w, ln(((SELECT count(*) FROM docs) + 1.0) / (coalesce(c, 0) + 1.0)) AS idf FROM tw LEFT JOIN df USING (w)),
idx AS (SELECT n, w, count(*) OVER (PARTITION BY n) AS size FROM (SELECT n, w FROM idf QUALIFY row_number() OVER (PARTITION BY n ORDER BY idf DESC, w) <= 6)),
inside AS (SELECT n, min(j) AS j FROM tw JOIN t USING (n) WHERE list_slice(t.ws, j + 1, j + len(phrase)) = phrase GROUP BY n),
proof AS (SELECT rn, n, pos - inside.j AS start FROM placed JOIN t ON w = phrase[1] JOIN inside USING (n) JOIN docs USING (rn) WHERE list_slice(docs.ws, pos + 1, pos + len(phrase)) = phrase),
agreed AS (SELECT rn, n, start, any_value(size) AS size, count(DISTINCT idx.w) AS agree FROM proof JOIN idx USING (n) JOIN tw ON tw.n = proof.n AND tw.w = idx.w JOIN docs USING (rn) WHERE start + tw.j >= 0 AND docs.ws[start + tw.j + 1] = idx.w GROUP BY rn, n, start),
found AS (SELECT rn, label, agree / size AS score FROM agreed JOIN t USING (n) WHERE agree >= least(2, size)),
base AS (SELECT rn, label, pos FROM placed JOIN (SELECT label, string_split(p, ' ') AS phrase FROM (VALUES {_PHRASE_ROWS}) v(label, p)) ON w = phrase[1] JOIN docs USING (rn) WHERE list_slice(ws, pos + 1, pos + len(phrase)) = phrase)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.a AS first_word, b.z AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(m.labels, '') AS labels, coalesce(f.score, 0.0) AS score
FROM docs LEFT JOIN (SELECT rn, count(*) AS n, CAST(min(pos) AS BIGINT) AS a, CAST(max(pos) AS BIGINT) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rn) b USING (rn)
LEFT JOIN (SELECT rn, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rn, label FROM base UNION SELECT rn, label FROM found) GROUP BY rn) m USING (rn) LEFT JOIN (SELECT rn, max(score) AS score FROM found GROUP BY rn) f USING (rn)
"""

#: Every prefix of every rebuilt conversation as a list of turns. DuckDB has no CRC-32, so it is made byte by byte from its table.
_OP11_SQL = """
WITH bytes AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, bytes.t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h FROM own, bytes),
rebuilt AS (SELECT o.conv_id, list_concat(list_slice(coalesce(b.ts, []), 1, o.h), list_slice(o.ts, o.h + 1, len(o.ts))) AS ts FROM headed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
reached AS (SELECT conv_id, len(ts) AS n, d, list_slice(ts, 1, d) AS p FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT p, d, min(conv_id) AS c, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends FROM reached GROUP BY p, d),
named AS (SELECT *, row_number() OVER () AS id, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(p[d].t) END AS saved FROM nodes),
linked AS (SELECT a.*, b.id AS up, b.c AS above FROM named a LEFT JOIN named b ON b.d = a.d - 1 AND b.p = list_slice(a.p, 1, a.d - 1)),
kids AS (SELECT up AS id, count(*) AS k FROM linked WHERE up IS NOT NULL GROUP BY up),
counted AS (SELECT l.*, coalesce(k, 0) AS k FROM linked l LEFT JOIN kids USING (id)),
under AS (SELECT p, d, sum(saved) AS saved, sum(leaf) AS leaves FROM (SELECT saved, CAST(k = 0 AS INTEGER) AS leaf, x AS d, list_slice(p, 1, x) AS p FROM (SELECT *, unnest(range(d + 1)) AS x FROM counted)) GROUP BY p, d)
SELECT c.c AS conv_id, c.d AS depth, c.above AS parent_conv_id, c.n_convs, c.k AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, c.ends AS ends_sha256
FROM counted c JOIN under u ON u.d = c.d AND u.p = c.p
"""

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": _OP1_SQL, "op10_license_scan": _OP10_SQL, "op11_prefix_trie": _OP11_SQL}
