"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import table
from gridloom.llm.decontaminate import decontaminate
from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.html_extract import main_text
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.metric_join import similarity_components
from gridloom.llm.minhash import near_duplicates
from gridloom.llm.packing import pack_documents
from gridloom.llm.phrases import collocations
from gridloom.llm.prefix_trie import shared_opening_trie
from gridloom.llm.sharding import shard_documents
from gridloom.llm.tokens import token_counts
from gridloom.llm.toxicity import fit_toxicity, score_toxicity
from gridloom.llm.warc import archive_pages


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), limit=2048)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=4096, end_id=2)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language."""
    return collocations(table(spark, sf_dir, "documents"), max_n=3, least=10, contained_percent=50, top=2000)


def op12_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document under Jaccard similarity of five-word shingles of 0.8 or more."""
    return similarity_components(table(spark, sf_dir, "documents"), words=5, percent=80)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the conversations that begin like the first one of their hundred."""
    return shared_opening_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_warc": op5_warc,
    "op6_minhash": op6_minhash,
    "op7_toxicity": op7_toxicity,
    "op8_html_extraction": op8_html_extraction,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_packing": op10_packing,
    "op11_phrases": op11_phrases,
    "op12_metric_join": op12_metric_join,
    "op13_conversation_trie": op13_conversation_trie,
}



def components_sql(words: int, percent: int, more: str = "") -> str:
    """SQL for documents that Jaccard similarity of word shingles links: all pairs that share a shingle, then what is reachable."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
p AS (SELECT doc_id, ws, least({words}, len(ws)) AS k, unnest(range(1, greatest(len(ws) - {words - 1}, 1) + 1)) AS pos FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[pos:pos + k - 1], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
sym AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, sym.y FROM r JOIN sym ON sym.x = r.y),
least_one AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id{more}
FROM d JOIN least_one USING (doc_id) LEFT JOIN n USING (doc_id)
"""


ORACLE_SQL = {
    "op6_minhash": components_sql(3, 85, ", component_id = doc_id AS kept"),
    "op12_metric_join": components_sql(5, 80),
    "op1_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, pos, line, list_sort(list_distinct(list_filter(string_split_regex(
    lower(line), '[\\x09-\\x0D\\x20]+'), lambda x: x <> ''))) AS ws
  FROM l),
c AS (
  SELECT ws, min(doc_id) AS d, arg_min(pos, (doc_id, pos)) AS p, row_number() OVER (ORDER BY min(doc_id), arg_min(pos, (doc_id, pos))) AS k
  FROM w WHERE len(ws) > 0 GROUP BY ws),
u AS (SELECT k, len(ws) AS n, unnest(ws) AS word FROM c),
f AS (SELECT word, count(*) AS df FROM u GROUP BY word),
r AS (SELECT k, n, word, row_number() OVER (PARTITION BY k ORDER BY df, word) AS rk FROM u JOIN f USING (word)),
pre AS (SELECT * FROM r WHERE rk <= n - CAST(ceil(n * 4 / 5.0) AS BIGINT) + 1),
cand AS (
  SELECT DISTINCT a.k AS ka, b.k AS kb FROM pre a JOIN pre b ON a.word = b.word AND a.k < b.k
  WHERE a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
gone AS (
  SELECT DISTINCT kb AS k FROM cand JOIN c x ON x.k = ka JOIN c y ON y.k = kb
  WHERE 5 * len(list_intersect(x.ws, y.ws)) >= 4 * (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws)))),
m AS (
  SELECT w.doc_id, w.pos, w.line,
         len(w.ws) = 0 OR (c.d = w.doc_id AND c.p = w.pos AND c.k NOT IN (SELECT k FROM gone)) AS stays
  FROM w LEFT JOIN c ON len(w.ws) > 0 AND c.ws = w.ws),
t AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays) AS text, count(*) AS n_lines,
         count(*) FILTER (WHERE NOT stays) AS n_removed
  FROM m GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
       CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed
FROM documents LEFT JOIN t USING (doc_id)
""",
    "op3_decontamination": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark),
iw AS (
  SELECT item_id, least(13, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p, ws
  FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS gram FROM iw),
lens AS (SELECT DISTINCT n FROM w),
dp AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS p, ws FROM d, lens WHERE len(ws) >= n),
dg AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS gram FROM dp),
m AS (SELECT DISTINCT doc_id, n, p, item_id FROM dg JOIN w USING (n, gram)),
pos AS (SELECT doc_id, unnest(range(p, p + n)) AS spot FROM (SELECT DISTINCT doc_id, n, p FROM m)),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM pos GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op5_warc": """
WITH t AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM t)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR page_id = first THEN NULL ELSE first END AS refers_to
FROM f
""",
    "op9_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       coalesce(doc_id = max(doc_id) OVER g, false) AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
""",
    "op11_phrases": """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w),
s AS (SELECT lang, k, ws[pos:pos + k - 1] AS words FROM g, range(1, 4) t(k) WHERE pos + k - 1 <= len(ws)),
f AS (SELECT lang, k, array_to_string(words, ' ') AS phrase, any_value(words) AS words, count(*) AS f FROM s GROUP BY lang, k, phrase),
tot AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, words, f AS a FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, a, j, lang || chr(10) || array_to_string(words[1:j], ' ') AS one, lang || chr(10) || array_to_string(words[j + 1:], ' ') AS two
  FROM c, range(1, 3) t(j) WHERE j < k),
keyed AS (SELECT lang || chr(10) || phrase AS key, f FROM f WHERE f >= 10),
sc AS (
  SELECT lang, phrase, a, j, x.f AS l, y.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN keyed x ON x.key = one JOIN keyed y ON y.key = two),
worst AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS part FROM c WHERE k = 3)
  GROUP BY lang, part),
kept AS (
  SELECT worst.* FROM worst LEFT JOIN inside ON inside.lang = worst.lang AND part = phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN tot USING (lang) WHERE rank <= 2000
""",
    "op13_conversation_trie": """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
steps AS (
  SELECT DISTINCT c, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS steps
  FROM (SELECT DISTINCT c FROM t)),
h AS (
  SELECT c, xor(list_reduce([CAST(4294967295 AS BIGINT)] || steps,
                lambda crc, s: xor(xor(crc, s) >> 1, xor(crc, s) % 2 * 3988292384)), 4294967295) % 6 AS h
  FROM steps),
r AS (
  SELECT t.c, 1 AS part, pos, role, txt FROM t JOIN h USING (c) WHERE pos > h
  UNION ALL SELECT h.c, 0, pos, role, txt FROM h JOIN t ON t.c = h.c - h.c % 100 AND pos <= h),
l AS (
  SELECT h.c, CASE WHEN turns IS NULL THEN [] ELSE turns END AS turns
  FROM h LEFT JOIN (SELECT c, list(struct_pack(role := role, txt := txt) ORDER BY part, pos) AS turns FROM r GROUP BY c) g USING (c)),
m AS (SELECT c, len(turns) AS n, unnest(range(len(turns) + 1)) AS d, turns FROM l),
nodes AS (
  SELECT turns[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends
  FROM m GROUP BY ALL),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(k[d].txt) END AS own
  FROM nodes LEFT JOIN kids USING (k)),
up AS (SELECT k[1:e] AS k, n_children, own FROM (SELECT *, unnest(range(d + 1)) AS e FROM full_nodes)),
sums AS (SELECT k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM up GROUP BY k)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(x.ends) AS ends_sha256
FROM full_nodes x JOIN sums ON sums.k = x.k LEFT JOIN nodes p ON x.d > 0 AND p.k = x.k[1:x.d - 1]
""",
}
