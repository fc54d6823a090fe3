"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .bpe import bpe_encode
from .clustering import centroid_clusters
from .common import scratch
from .exact_dedup import exact_dedup
from .labelled import held_out
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import cut_pieces, place_pieces
from .pii import KINDS, count_of, find_pii, fit_pii, pii_candidates, written
from .quality import fit_quality, score_quality
from .token_files import crc32_of, read_sequences, write_sequences
from .topk import top_k
from .toxicity import fit_toxicity, score_toxicity
from .warc import plan_records, read_warc, write_warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"), digest_all=True).drop("chars", "text_hash")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good; kept: likely of grade 1 or more."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") > 0, F.when(F.col("toxic") > 0, 1).otherwise(2))
    scored = score_quality(docs, fit_quality(docs, labels, grade, 3))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("kept"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    read = read_warc(write_warc(plan_records(pages)))
    number = pages.schema["page_id"].dataType
    return read.select(F.col("page").cast(number).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(number).alias("refers_to"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe_encode(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded_col="decoded")
    return decoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = scratch(pii_candidates(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "pii-candidates")
    found = find_pii(candidates, fit_pii(candidates))
    counts = [count_of("base_spans", kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base_spans"), 256).alias("base_sha256"), written("spans").alias("spans"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8_pii says of base spans alone, which SQL can say too."""
    return op8_pii(spark, sf_dir).drop("spans")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle_words=2, percent=80).drop("group")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    index = write_sequences(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return crc32_of(read_sequences(index))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = cut_pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, seq_len=4096)
    return place_pieces(crc32_of(pieces), 4096)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = align_tokenizers(_read(spark, sf_dir, "documents"), a, b, shown=lambda groups: F.sha2(groups, 256))
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_read(spark, sf_dir, "embeddings")).drop("centroid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_topk": op7_topk,
    "op8_pii": op8_pii,
    "op9_near_dedup": op9_near_dedup,
    "op10_token_files": op10_token_files,
    "op11_packing": op11_packing,
    "op12_alignment": op12_alignment,
    "op13_clustering": op13_clustering,
    "pii_base_spans": pii_base_spans,
}


def _pii_kind(kind: str, order: int, pattern: str, check: str) -> str:
    """Base spans of a kind: the text is cut at marks around its matches; t is a match, d its digits."""
    return f"""
SELECT doc_id, '{kind}' AS kind, {order} AS k, s, s + length(t) AS e FROM (
  SELECT doc_id, p[2 * i] AS t, list_sum(list_transform(p[1:2 * i - 1], lambda x: length(x)))::BIGINT AS s, regexp_replace(p[2 * i], '[^0-9]', '', 'g') AS d
  FROM (SELECT doc_id, p, unnest(range(1, len(p) // 2 + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL))
) WHERE {check}"""


_LUHN = "length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(d)), lambda j: CASE WHEN j % 2 = 0 THEN substr(d, (length(d) - j)::INT, 1)::INT ELSE (substr(d, (length(d) - j)::INT, 1)::INT * 2) // 10 + (substr(d, (length(d) - j)::INT, 1)::INT * 2) % 10 END)) % 10 = 0"
_PII = " UNION ALL ".join([
    _pii_kind("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    _pii_kind("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(t, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 256) > 255)) = 0"),
    _pii_kind("card", 2, r"[0-9]([\x20-]?[0-9])+", _LUHN),
    _pii_kind("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15"),
])

def _rounds(k: int, rounds: int, scale: int, width: int, seed: int) -> str:
    """Centroid clustering: tables a<n> assign, tables c<n> hold the centroids of each round."""
    assign = "a{n} AS MATERIALIZED (SELECT vec_id, row, v, arg_min(c, {{'d': d, 'c': c}}) AS cluster, min(d)::BIGINT AS distance FROM (SELECT q.*, c, vv - 2 * list_dot_product(v, x) + list_dot_product(x, x) AS d FROM q, c{n}) GROUP BY ALL)"
    mean = """c{m} AS MATERIALIZED (SELECT c, coalesce(y, x) AS x FROM c{n} LEFT JOIN (
  SELECT cluster AS c, list(floor_of ORDER BY dim) AS y FROM (
    SELECT cluster, dim, ((s - ((s % n) + n) % n) / n)::DOUBLE AS floor_of FROM (
      SELECT cluster, dim, sum(x::BIGINT)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({width})) AS dim FROM a{n}) GROUP BY ALL)) GROUP BY 1) USING (c))"""
    steps = [step.format(n=r, m=r + 1, width=width) for r in range(rounds) for step in (assign, mean)]
    steps.append(assign.format(n=rounds))
    return f"""
WITH u AS (
  SELECT vec_id, row_number() OVER () AS row, embedding FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS MATERIALIZED (SELECT vec_id, row, v, list_dot_product(v, v) AS vv FROM (SELECT vec_id, row, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM u)),
c0 AS MATERIALIZED (SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v AS x FROM q) WHERE c < {k}),
{", ".join(steps)}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(x, lambda y: y::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = cluster"""


ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), h AS (SELECT doc_id, chars, sha256(norm) AS text_sha256 FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
""",
    "op2_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (
  SELECT k, source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM d GROUP BY k, source
), s1 AS (
  SELECT *, (sum(source_size) OVER () * 150 / 100.0::DOUBLE - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s0
), s2 AS (
  SELECT *, arg_min(level, struct_pack(a := source_size::DOUBLE / weight, b := source IS NULL, c := source)) FILTER (WHERE level * weight <= 2 * source_size) OVER () AS final FROM s1
), s3 AS (
  SELECT k, source_size, least((2 * source_size)::DOUBLE, coalesce(final * weight, (2 * source_size)::DOUBLE)) AS target FROM s2
), s4 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216)::BIGINT ELSE 0 END AS rate, ('0x' || substr(md5('0:' || k), 1, 6))::BIGINT AS off FROM s3
), p AS (
  SELECT doc_id, size, source_size, target, rate, off + rate * row_number() OVER (PARTITION BY k ORDER BY size, doc_id) AS upto FROM d JOIN s4 USING (k)
)
SELECT doc_id, size, source_size, target, (((upto >> 24) - ((upto - rate) >> 24)) * size)::BIGINT AS taken FROM p
""",
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS best FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN best <> page_id THEN best END AS refers_to FROM m
""",
    "pii_base_spans": f"""
WITH f AS ({_PII}), g AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS w FROM f GROUP BY 1)
SELECT doc_id, (SELECT count(*) FROM f WHERE f.doc_id = d.doc_id AND k = 0) AS n_email, (SELECT count(*) FROM f WHERE f.doc_id = d.doc_id AND k = 1) AS n_ip,
       (SELECT count(*) FROM f WHERE f.doc_id = d.doc_id AND k = 2) AS n_card, (SELECT count(*) FROM f WHERE f.doc_id = d.doc_id AND k = 3) AS n_phone, sha256(coalesce(w, '')) AS base_sha256
FROM documents d LEFT JOIN g USING (doc_id)
""",
    "op9_near_dedup": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM t
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a
), c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
""",
    "op7_topk": """
WITH ok AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM ok
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op13_clustering": _rounds(8, 10, 1024, 64, 3),
}
