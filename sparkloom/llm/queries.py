"""The contract queries of the corpus operators and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, collocations, exact_dedup, langid, line_dedup, mixing, near_dedup, prefix_trie, quality, repeats, topk, url_filter

#: The vocabulary that ``op3`` encodes with.
TOKENIZER = "byte_bpe_50k.json"
#: The vocabulary whose pieces ``op7`` segments words into.
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents")).drop("match_id")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP1_SQL = f"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i AS s, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM words)),
often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
spans AS (SELECT DISTINCT doc_id, s FROM windows SEMI JOIN often USING (h)),
marked AS (SELECT *, CASE WHEN s < lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM spans),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM marked)
SELECT doc_id, min(s)::INT AS start_word, (max(s) + 50)::INT AS end_word, (max(s) + 50 - min(s))::INT AS n_words FROM islands GROUP BY doc_id, island
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, table(spark, sf_dir, "labels")).drop("text")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokenizer_path()).drop("text")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"), keep="largest")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    clean = F.sha2(F.col("clean").cast("binary"), 256).alias("clean_sha256")
    return line_dedup.cleaned(docs).select("doc_id", "n_lines", "n_removed", F.length("clean").alias("clean_chars"), clean)


OP6_SQL = """
WITH parts AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS part,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), named AS (
  SELECT *, trim(part, ' ' || chr(9) || chr(13)) AS line FROM parts
), spread AS (
  SELECT line FROM named WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('s' || source, '-')) >= 8
), marked AS (
  SELECT n.*, s.line IS NOT NULL AS gone FROM named n LEFT JOIN spread s ON n.line = s.line
), joined AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(part, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS clean
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines::INT AS n_lines, n_removed::INT AS n_removed, length(clean)::INT AS clean_chars, sha256(clean) AS clean_sha256 FROM joined
"""


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
walk AS (SELECT *, coalesce(sum(s) OVER run, 0) AS s_before, coalesce(sum(w) OVER run, 0) AS w_before, sum(s) OVER () AS s_all, sum(w) OVER () AS w_all FROM totals
  WINDOW run AS (ORDER BY s / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fits AS (SELECT (s_all - 3 * s_before) AS num, (w_all - w_before) AS den FROM walk WHERE (s_all - 3 * s_before) * w <= 3 * s * (w_all - w_before) ORDER BY s_before, w_before LIMIT 1),
targets AS (SELECT source, s, least(w * num::DOUBLE / den::DOUBLE, (3 * s)::DOUBLE) AS target FROM totals, fits),
rates AS (SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate FROM targets),
met AS (SELECT d.*, r.s, r.target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
draws AS (SELECT *, ('0x' || substr(md5('mix-' || (t // 4) || '-' || coalesce(doc_id::VARCHAR, '')), 1 + 8 * (t % 4), 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM met, range(16) r(t)),
trials AS (SELECT source, t, abs(sum(CASE WHEN u < part THEN size ELSE 0 END) + any_value(whole * s) - any_value(target)) AS off FROM draws GROUP BY source, t),
best AS (SELECT source, arg_min(t, (off, t)) AS t FROM trials GROUP BY source)
SELECT d.doc_id, d.size, d.s AS source_size, d.target, CASE WHEN size > 0 THEN size * (whole + CASE WHEN u < part THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS taken
FROM draws d JOIN best b ON d.t = b.t AND d.source IS NOT DISTINCT FROM b.source
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.mark(docs, words=3, percent=85).drop("tkey")


OP10_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.x, reach.r FROM reach JOIN edges e ON e.y = reach.doc_id)
SELECT doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), shared_heads=True)


# CRC-32 of a decimal text, bit by bit: 8 + 1 steps a byte, as a fold over a list
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda b: [ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295::BIGINT)"""
OP11_SQL = f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64),
  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {_CRC} % 6 AS h, c - c % 100 AS base FROM (SELECT DISTINCT c FROM own)),
parts AS (SELECT i.c, 0 AS side, o.p, o.r, o.x FROM ids i JOIN own o ON o.c = i.base AND o.p < i.h UNION ALL SELECT o.c, 1, o.p, o.r, o.x FROM ids i JOIN own o USING (c) WHERE o.p >= i.h),
turns AS (SELECT c, sha256(length(r) || ':' || r || x) AS t, length(x) AS n, row_number() OVER (PARTITION BY c ORDER BY side, p) AS d FROM parts),
lists AS (SELECT c, coalesce(l, []) AS l, coalesce(len(l), 0) AS total FROM ids LEFT JOIN (SELECT c, list(t ORDER BY d) AS l FROM turns GROUP BY c) USING (c)),
paths AS (SELECT c, total, d, sha256(array_to_string(l[:d], ',')) AS k, sha256(array_to_string(l[:d - 1], ',')) AS pk FROM (SELECT *, unnest(range(total + 1)) AS d FROM lists)),
nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(pk) AS pk, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = total), '')) AS ends_sha256 FROM paths GROUP BY d, k),
sized AS (SELECT nodes.*, (n_convs - 1) * coalesce(n, 0) AS saved FROM nodes LEFT JOIN turns ON turns.c = conv_id AND turns.d = nodes.d),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT s.*, coalesce(n_children, 0) AS n_children FROM sized s LEFT JOIN kids USING (d, k)),
below AS (SELECT p.d, p.k, sum(f.saved) AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves FROM full_nodes f JOIN paths p ON p.c = f.conv_id AND p.d <= f.d GROUP BY p.d, p.k)
SELECT f.conv_id, f.d::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below USING (d, k) LEFT JOIN nodes u ON f.d > 0 AND u.d = f.d - 1 AND u.k = f.pk
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, m, list_slice(w, i, i + m - 1) AS p, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 6) t(m)) GROUP BY ALL HAVING count(*) >= 100),
inside AS (SELECT DISTINCT lang, p, f FROM (SELECT lang, f, k, list_slice(p, i, i + k - 1) AS p FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM grams WHERE m > 2)))),
cuts AS (SELECT g.lang, g.m, g.p, g.f AS a, k, x.f AS l, y.f AS r, n, (1000 * g.f::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM grams WHERE m > 1) g
  JOIN grams x ON x.lang = g.lang AND x.p = list_slice(g.p, 1, k) JOIN grams y ON y.lang = g.lang AND y.p = list_slice(g.p, k + 1, g.m) JOIN totals t ON t.lang = g.lang),
best AS (SELECT lang, p, array_to_string(p, ' ') AS phrase, any_value(a) AS a, any_value(n) AS n, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM cuts GROUP BY lang, p),
kept AS (SELECT b.* FROM best b ANTI JOIN (SELECT g.lang, g.p FROM grams g JOIN inside i ON i.lang = g.lang AND i.p = g.p AND 100 * i.f >= 100 * g.f) d ON d.lang = b.lang AND d.p = b.p)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH sound AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores) WHERE rank <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_ann": op5_ann,
    "op6_line_dedup": op6_line_dedup,
    "op7_langid": op7_langid,
    "op8_mixing": op8_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_minhash": op10_minhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_topk": op13_topk,
}

ORACLE: dict[str, str] = {"op1_repeats": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op6_line_dedup": OP6_SQL, "op8_mixing": OP8_SQL, "op10_minhash": OP10_SQL,
                          "op11_prefix_trie": OP11_SQL, "op12_collocations": OP12_SQL, "op13_topk": OP13_SQL}
