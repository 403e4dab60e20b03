"""The registered query of each operator: production parameters, whole tables; and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.decontaminate import contamination
from tidewell.llm.exact import exact_groups
from tidewell.llm.lexical import ranked
from tidewell.llm.lm import lm_scores
from tidewell.llm.near import near_groups
from tidewell.llm.neighbours import nearest
from tidewell.llm.packing import pack_documents
from tidewell.llm.repeats import LENGTH, without_repeated_bytes
from tidewell.llm.sentences import MIN_SENTENCES, without_repeats
from tidewell.llm.sharding import shard_ids
from tidewell.llm.tokens import token_counts
from tidewell.llm.toxicity import held_out, model_of, scored
from tidewell.llm.trie import FAMILY, HEADS, prefix_trie
from tidewell.session import table

TOKENIZER = "byte_bpe_50k.json"
CONTEXT_TOKENS = 2048
COUNT_LIMIT = 1024
SHARD_BYTES = 16 << 20
WINDOW = 10
#: Words of a run in op2_every_run, which takes runs for equal wherever they are cut into sentences: any.
MIN_WORDS = 1
TOXIC_SCORE = 0.3
HITS = 10
QUERY_EVERY, NEIGHBOURS = 50, 5


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW)


def op2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_every_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"), MIN_WORDS)
    return found.select("doc_id", "n_sentences", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), CONTEXT_TOKENS)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > COUNT_LIMIT)


def op5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), size=4, percent=80)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_ids(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return exact_groups(table(spark, sf_dir, "documents")).select(columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(F.col("doc_id"), 4, 2)
    model = model_of(docs, table(spark, sf_dir, "labels").filter(~out))
    found, name = scored(docs, model)
    found = found.select("doc_id", out.alias("held_out"), F.col(name).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= TOXIC_SCORE).cast("int"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(F.col("doc_id"), 5, 1)
    return lm_scores(docs, ~out).withColumn("held_out", out)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), HITS)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), QUERY_EVERY, NEIGHBOURS)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_sentences, op2_every_run, op3_pack, op4_token_counts, op5_near, op6_shards, op7_exact, op8_toxicity, op9_lm, op10_repeats, op11_trie, op12_lexical, op13_neighbours)}

_CRC32 = """xor(list_reduce([ascii(c) FOR c IN string_split({}, '')],
    lambda a, x: list_reduce([0 FOR i IN range(8)], lambda b, y: xor(b >> 1, (b & 1) * 3988292384::BIGINT), xor(a, x::BIGINT)), 4294967295::BIGINT), 4294967295::BIGINT)"""
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, w[p:p + k - 1] AS win
       FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM i WHERE len(w) > 0) x, unnest(range(1, len(w) - k + 2)) t(p)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, p, w[p:p + k - 1] AS win FROM d, ks, unnest(range(1, len(w) - k + 2)) t(p)),
m AS (SELECT dw.doc_id, dw.p, dw.k, iw.item_id FROM dw JOIN iw USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM m, unnest(range(p, p + k)) t(x) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op2_sentences": rf"""
WITH p AS (SELECT doc_id, piece, k, {_WORDS.format("piece")} AS w
           FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+')) AS piece,
                 generate_subscripts(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+'), 1) AS k FROM documents)),
s AS (SELECT doc_id, k, w, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i,
      sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k) AS c FROM p WHERE len(w) > 0),
r AS (SELECT doc_id, first, first + {MIN_SENTENCES - 1} AS last, run FROM
      (SELECT doc_id, i AS first, string_agg(array_to_string(w, ' '), '|') OVER v AS run, count(*) OVER v AS n FROM s
       WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {MIN_SENTENCES - 1} FOLLOWING)) WHERE n = {MIN_SENTENCES}),
g AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS nth FROM r),
x AS (SELECT DISTINCT s.doc_id, s.k FROM g JOIN s ON s.doc_id = g.doc_id AND s.i BETWEEN g.first AND g.last WHERE nth > 1),
y AS (SELECT p.doc_id, count(*) FILTER (len(w) > 0) AS n_sentences, count(x.k) AS n_removed,
      coalesce(string_agg(piece, '' ORDER BY p.k) FILTER (x.k IS NULL), '') AS kept
      FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.k = p.k GROUP BY 1)
SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN y USING (doc_id)""",
    "op2_every_run": rf"""
WITH p AS (SELECT doc_id, piece, k, {_WORDS.format("piece")} AS w
           FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+')) AS piece,
                 generate_subscripts(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+'), 1) AS k FROM documents)),
s AS (SELECT doc_id, k, w, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i,
      sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k) AS c FROM p WHERE len(w) > 0),
e AS (SELECT a.doc_id, a.i AS first, min(b.i) AS last FROM s a JOIN s b
      ON a.doc_id = b.doc_id AND b.i >= a.i + {MIN_SENTENCES - 1} AND b.c - a.c + len(a.w) >= {MIN_WORDS} GROUP BY 1, 2
      UNION SELECT b.doc_id, max(a.i), b.i FROM s a JOIN s b
      ON a.doc_id = b.doc_id AND b.i >= a.i + {MIN_SENTENCES - 1} AND b.c - a.c + len(a.w) >= {MIN_WORDS} GROUP BY 1, 3),
r AS (SELECT e.doc_id, e.first, e.last, string_agg(array_to_string(s.w, ' '), ' ' ORDER BY s.i) AS run
      FROM e JOIN s ON s.doc_id = e.doc_id AND s.i BETWEEN e.first AND e.last GROUP BY 1, 2, 3),
g AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS nth FROM r),
x AS (SELECT DISTINCT s.doc_id, s.k FROM g JOIN s ON s.doc_id = g.doc_id AND s.i BETWEEN g.first AND g.last WHERE nth > 1),
y AS (SELECT p.doc_id, count(*) FILTER (len(w) > 0) AS n_sentences, count(x.k) AS n_removed,
      coalesce(string_agg(piece, '' ORDER BY p.k) FILTER (x.k IS NULL), '') AS kept
      FROM p LEFT JOIN x ON x.doc_id = p.doc_id AND x.k = p.k GROUP BY 1)
SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN y USING (doc_id)""",
    "op5_near": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[p:p + least(len(w), 4) - 1] AS sh FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n.n""",
    "op6_shards": f"""
WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
b AS (SELECT d::BIGINT AS depth, h >> (60 - d) AS prefix, sum(n_bytes) AS shard_bytes, count(*) AS rows
      FROM r, generate_series(0, 60) t(d) GROUP BY 1, 2),
f AS (SELECT r.doc_id, r.n_bytes, r.h, min(b.depth) AS depth
      FROM r JOIN b ON b.prefix = r.h >> (60 - b.depth)
      WHERE b.shard_bytes <= {SHARD_BYTES} OR b.rows = 1 OR b.depth = 60 GROUP BY ALL)
SELECT f.doc_id, f.n_bytes, f.depth || '-' || b.prefix AS shard, f.depth::INTEGER AS depth,
       b.shard_bytes::BIGINT AS shard_bytes, b.shard_bytes > {SHARD_BYTES} AS oversized
FROM f JOIN b ON b.depth = f.depth AND b.prefix = f.h >> (60 - f.depth)""",
    "op7_exact": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)""",
    "op10_repeats": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(x) // 2 - {LENGTH - 1})) AS p,
      unnest([md5_number(substr(x, 2 * i + 1, {2 * LENGTH})) FOR i IN range(0, length(x) // 2 - {LENGTH - 1})]) AS m FROM d),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
g AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} THEN 1 ELSE 0 END AS new FROM r),
s AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b
      FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g) GROUP BY doc_id, k),
k AS (SELECT s.*, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
t AS (SELECT k.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
      string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)""",
    "op11_trie": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC32.format("conv_id::VARCHAR")} % {HEADS} AS h, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS own FROM t GROUP BY 1),
r AS (SELECT c.conv_id, coalesce(f.own[1:c.h], []) || c.own[c.h + 1:] AS p FROM c LEFT JOIN c f ON f.conv_id = c.conv_id - c.conv_id % {FAMILY}),
x AS (SELECT conv_id, d, p[1:d] AS pre, len(p) = d AS ends FROM r, unnest(range(len(p) + 1)) u(d)),
n AS (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM x GROUP BY 1, 2),
k AS (SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
s AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(pre[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n LEFT JOIN k USING (d, pre)),
u AS (SELECT a AS d, pre[1:a] AS pre, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM s, unnest(range(d + 1)) v(a) GROUP BY 1, 2)
SELECT s.conv_id, s.d AS depth, q.conv_id AS parent_conv_id, s.n_convs, s.n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, s.ends_sha256
FROM s JOIN u ON u.d = s.d AND u.pre = s.pre LEFT JOIN s q ON q.d = s.d - 1 AND q.pre = s.pre[1:s.d - 1]""",
    "op12_lexical": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("text")} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
i AS (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT DISTINCT i, t FROM (SELECT i, {_WORDS.format("text")} AS w FROM i), unnest(w) u(t)),
p AS (SELECT r, t, count(*) AS tf FROM d, unnest(w) u(t) SEMI JOIN q USING (t) GROUP BY 1, 2),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS wt FROM p, s GROUP BY t, n_docs),
v AS (SELECT d.r, doc_id, 100 - 90 + (90 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT i, v.doc_id, v.r, sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN p USING (t) JOIN f USING (t) JOIN v ON v.r = p.r GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM i JOIN
(SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) y USING (i) WHERE rank <= {HITS}""",
    "op13_neighbours": f"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
x AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q, v WHERE q.vec_id % {QUERY_EVERY} = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM x) WHERE rank <= {NEIGHBOURS}""",
}
