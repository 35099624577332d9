"""Registered queries of the retrieval engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import numbers as N
from citeloom.functions import text as T
from citeloom.operators import answers as A
from citeloom.operators import chunking as C
from citeloom.operators import gate as G
from citeloom.operators import index as I
from citeloom.operators import retrieval as R
from citeloom.operators import structure as S
from citeloom.plans import fixtures as X
from citeloom.session import Scratch
from citeloom.sources import documents as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- retrieval -----------------------------------------------------------------------------------------------------


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a vector table: the label stands for the document and its type."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("string")
    return rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), label.alias("document_id"), F.concat(F.lit("t"), label).alias("document_type"), F.lit(None).cast("string").alias("source_file"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20: its vector, and a question that names it."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.concat(F.lit("Article "), F.col("vec_id").cast("string"), F.lit(" of the law")).alias("query"))


def hits(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = R.dense_topk(questions(spark, sf_dir), collection(spark, sf_dir), **options)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_d"), F.concat(F.lit("Article "), F.col("doc_id").cast("string"), F.lit(". "), F.col("text")).alias("text"))
    return found.join(texts, found["chunk_id"] == F.col("_d"), "left").drop("_d").withColumn("text", F.coalesce("text", F.lit("")))


SCORED = """
q AS (SELECT vec_id AS query_id, vec_id AS v FROM embeddings WHERE vec_id % 20 = 0),
qv AS (SELECT q.query_id, q.v, CAST(e.embedding AS DOUBLE[]) AS qvec FROM q JOIN embeddings e ON e.vec_id = q.v),
scored AS (
  SELECT query_id, 'Article ' || v || ' of the law' AS query, vec_id AS chunk_id, CAST(label AS VARCHAR) AS document_id,
         list_inner_product(CAST(embedding AS DOUBLE[]), qvec)
           / (sqrt(list_inner_product(qvec, qvec)) * sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS score
  FROM embeddings CROSS JOIN qv
),
"""
RANKED = SCORED + "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS dense_rank_no FROM scored),\n"
HITS = RANKED + "hits AS (SELECT r.*, coalesce('Article ' || d.doc_id || '. ' || d.text, '') AS text FROM ranked r LEFT JOIN documents d ON d.doc_id = r.chunk_id WHERE dense_rank_no <= 20),\n"
CAPPED = HITS + "capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) AS n FROM hits) WHERE n <= 4),\n"
# a deterministic second score in whole numbers, so that both engines order alike
RERANK_NUMBER = "(chunk_id * 7919 + query_id * 104729) % 1000"
RERANKED = CAPPED + f"""reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, dense_rank_no) AS rerank_no
  FROM (SELECT *, {RERANK_NUMBER} / 1000.0 AS rerank_score FROM capped)) WHERE rerank_no <= 6),
"""


def second_score() -> F.Column:
    return (F.col("chunk_id") * 7919 + F.col("query_id") * 104729) % 1000 / 1000.0


def ranked_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "chunk_id", "document_id", F.round("score", 6).alias("score"), F.col("dense_rank_no").cast("long").alias("dense_rank_no"), *more)


RANKED_COLUMNS = "query_id, chunk_id, document_id, round(score, 6) AS score, dense_rank_no"


@query(f"WITH {RANKED} x AS (SELECT 1) SELECT {RANKED_COLUMNS} FROM ranked WHERE dense_rank_no <= 20")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_columns(R.dense_topk(questions(spark, sf_dir), collection(spark, sf_dir)))


@query(f"WITH {RANKED} x AS (SELECT 1) SELECT {RANKED_COLUMNS} FROM ranked WHERE dense_rank_no <= 20 AND score >= 0.3")
def dense_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_columns(R.dense_topk(questions(spark, sf_dir), collection(spark, sf_dir), threshold=0.3))


@query(
    f"WITH {SCORED} ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS dense_rank_no FROM scored WHERE document_id = '3') SELECT {RANKED_COLUMNS} FROM ranked WHERE dense_rank_no <= 20"
)
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_columns(R.dense_topk(questions(spark, sf_dir), collection(spark, sf_dir), filters={"document_type": "t3", "source": ""}))


@query(f"WITH {CAPPED} x AS (SELECT 1) SELECT {RANKED_COLUMNS} FROM capped")
def diversify_cap4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_columns(R.diversify(R.dense_topk(questions(spark, sf_dir), collection(spark, sf_dir))))


def reranked(found: DataFrame) -> DataFrame:
    return R.rerank(R.diversify(found), second_score())


@query(f"WITH {RERANKED} x AS (SELECT 1) SELECT {RANKED_COLUMNS}, rerank_score, rerank_no FROM reranked")
def rerank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reranked(R.dense_topk(questions(spark, sf_dir), collection(spark, sf_dir)))
    return ranked_columns(found.withColumn("rerank_no", F.col("rerank_no").cast("long")), "rerank_score", "rerank_no")


EVIDENCE = RERANKED + """tops AS (SELECT * FROM hits WHERE dense_rank_no = 1),
every AS (
  SELECT query_id, query, chunk_id, document_id, score, dense_rank_no, text, rerank_no FROM reranked
  UNION ALL SELECT t.query_id, t.query, t.chunk_id, t.document_id, t.score, t.dense_rank_no, t.text, NULL FROM tops t
    WHERE NOT EXISTS (SELECT 1 FROM reranked r WHERE r.query_id = t.query_id AND r.chunk_id = t.chunk_id)
),
evidence AS (SELECT * FROM (
  SELECT e.*, row_number() OVER (PARTITION BY e.query_id ORDER BY e.dense_rank_no <> 1, e.rerank_no) AS evidence_no
  FROM every e JOIN tops t ON t.query_id = e.query_id WHERE t.score - e.score <= {drop}) WHERE evidence_no <= 3),
"""


@query(f"WITH {EVIDENCE.replace('{drop}', '0.6')} x AS (SELECT 1) SELECT {RANKED_COLUMNS}, evidence_no FROM evidence")
def select_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.dense_topk(questions(spark, sf_dir), collection(spark, sf_dir))
    kept = R.select_evidence(found, reranked(found), n=3, max_drop=0.6)
    return ranked_columns(kept.withColumn("evidence_no", F.col("evidence_no").cast("long")), "evidence_no")


IDS = r"list_distinct(regexp_extract_all(lower({x}), '(?:المادة|قانون|قرار|مرسوم|article|law|decree|decision)\s*(?:رقم|no\.?|number)?\s*[\[(]?[\s:.-]*([0-9٠-٩]+)', 1))"
GATE = RERANKED + f"""signals AS (
  SELECT query_id, any_value(query) AS query, max(score) AS top, max(CASE WHEN dense_rank_no = 2 THEN score END) AS second, count(DISTINCT document_id) AS source_count,
         list_distinct(flatten(list({IDS.replace('{x}', 'text')}))) AS named
  FROM hits GROUP BY query_id
), best AS (SELECT query_id, max(rerank_score) AS rr FROM reranked GROUP BY query_id),
judged AS (SELECT s.*, b.rr, list_has_any({IDS.replace('{x}', 's.query')}, s.named) AS match FROM signals s JOIN best b ON b.query_id = s.query_id),
reasons AS (SELECT *, CASE WHEN top < 0.82 AND NOT (match AND top >= 0.75) THEN 'dense_score_below_experimental_threshold' WHEN rr < 0.97 THEN 'rerank_score_below_experimental_threshold'
  WHEN top < 0.82 THEN 'exact_identifier_override' ELSE 'sufficient' END AS reason FROM judged)
SELECT query_id, reason IN ('exact_identifier_override', 'sufficient') AS sufficient, reason, round(top, 6) AS top_dense_score, round(top - second, 6) AS dense_margin, rr AS top_rerank_score,
  source_count, match AS identifier_match FROM reasons
"""


@query(f"WITH {GATE}")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir).withColumn("section_title", F.lit(None).cast("string"))
    judged = G.assess(questions(spark, sf_dir).select("query_id", "query"), found, reranked(found), G.GateConfig(minimum_rerank=0.97))
    return judged.select("query_id", "sufficient", "reason", F.round("top_dense_score", 6).alias("top_dense_score"), F.round("dense_margin", 6).alias("dense_margin"), "top_rerank_score", "source_count", "identifier_match")


@query("SELECT d.doc_id AS chunk_id, CASE WHEN l.doc_id IS NOT NULL THEN d.text ELSE 'kept ' || d.doc_id END AS text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def chunk_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    stored = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("original_text"), F.lit(None).cast("string").alias("normalized_text"), F.lit(1).alias("seq"))
    marked = labels.withColumn("_l", F.lit(1)).withColumnRenamed("doc_id", "_i")
    empty = docs.join(marked, docs["doc_id"] == F.col("_i"), "left")
    asked = empty.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("_l").isNull(), F.concat(F.lit("kept "), F.col("doc_id").cast("string"))).otherwise("").alias("text"))
    return R.fallback_texts(asked, stored)


@query(f"""WITH {EVIDENCE.replace('{drop}', '2.0')}
s AS (SELECT query_id, chunk_id, evidence_no, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM evidence),
b AS (SELECT *, 3000 - coalesce(sum(length(t)) OVER (PARTITION BY query_id ORDER BY evidence_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM s WHERE t <> '')
SELECT query_id, chunk_id, 'E' || row_number() OVER (PARTITION BY query_id ORDER BY evidence_no) AS evidence_id, '[' || row_number() OVER (PARTITION BY query_id ORDER BY evidence_no) || ']' AS marker,
  substr(t, 1, CAST(room AS BIGINT)) AS quoted_text FROM b WHERE room > 0""")
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir)
    evidence = R.select_evidence(found, reranked(found), n=3, max_drop=2.0)
    return A.bounded_evidence(evidence, 3000).select("query_id", "chunk_id", "evidence_id", "marker", "quoted_text")


# --- identity, duplicates, upsert ------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return docs.groupBy("file_hash").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("""
WITH i AS (SELECT doc_id, sha256(text) AS document_id, CASE WHEN n_chars % 5 = 0 THEN 'b' ELSE 'a' END AS configuration, source AS metadata FROM documents),
m AS (SELECT sha256(text) AS artifact, any_value(CASE WHEN n_chars % 7 = 0 THEN 'b' ELSE 'a' END) AS configuration, min(source) AS metadata, bool_and(n_chars % 3 <> 0) AS complete,
  bool_and(n_chars % 11 <> 0) AS sound, any_value(CASE WHEN n_chars % 13 = 0 THEN 'other' ELSE sha256(text) END) AS document_id FROM documents GROUP BY 1 HAVING min(n_chars) % 2 = 0)
SELECT i.doc_id, CASE WHEN m.artifact IS NULL THEN 'new' WHEN i.configuration <> m.configuration OR NOT sound THEN 'reprocess' WHEN i.document_id <> m.document_id THEN 'reprocess' WHEN i.metadata <> m.metadata THEN 'conflict'
  WHEN NOT m.complete THEN 'reprocess' ELSE 'duplicate' END AS status
FROM i LEFT JOIN m ON m.artifact = i.document_id
""")
def idempotency_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", F.sha2("text", 256).alias("document_id"))
    inputs = docs.select("doc_id", F.col("document_id").alias("artifact"), "document_id", F.when(F.col("n_chars") % 5 == 0, "b").otherwise("a").alias("configuration"), F.col("source").alias("metadata"))
    manifest = docs.groupBy(F.col("document_id").alias("artifact")).agg(
        F.any_value(F.when(F.col("n_chars") % 7 == 0, "b").otherwise("a")).alias("configuration"), F.min("source").alias("metadata"), F.bool_and(F.col("n_chars") % 3 != 0).alias("complete"), F.bool_and(F.col("n_chars") % 11 != 0).alias("sound"),
        F.any_value(F.when(F.col("n_chars") % 13 == 0, "other").otherwise(F.col("document_id"))).alias("document_id"), F.min("n_chars").alias("_n"),
    )
    return D.idempotency(inputs, manifest.where("_n % 2 = 0")).select("doc_id", F.col("decision").alias("status"))


@query("""
WITH old AS (SELECT vec_id, label FROM embeddings WHERE label < 6), new AS (SELECT vec_id, -label AS label FROM embeddings WHERE label > 3)
SELECT * FROM old WHERE vec_id NOT IN (SELECT vec_id FROM new) UNION ALL SELECT * FROM new
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = rows.where("label > 3")
    # each new row comes twice; the later version is the one that stays
    versions = new.withColumn("v", F.lit(1)).union(new.withColumn("label", -F.col("label")).withColumn("v", F.lit(2)))
    return I.upsert(rows.where("label < 6").withColumn("v", F.lit(0)), versions, key="vec_id", order=F.col("v")).drop("v")


@query("""
WITH one AS (SELECT vec_id, label, 1 AS v FROM embeddings WHERE label < 6), two AS (SELECT vec_id, label + 100, 2 FROM embeddings WHERE label > 3), three AS (SELECT vec_id, label + 200, 3 FROM embeddings WHERE vec_id % 3 = 0),
every AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three), kept AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC) AS n FROM every)
SELECT k.vec_id, k.label, v, len(embedding) AS dimension, round(CAST(embedding[1] AS DOUBLE), 5) AS first_component FROM kept k JOIN embeddings e USING (vec_id) WHERE n = 1
""")
def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three upserts that overlap, into a vector table made for this, and what it holds afterwards."""
    rows = table(spark, sf_dir, "embeddings")
    dimension = rows.select(F.max(F.size("embedding"))).first()[0]
    held = I.VectorTable(spark, f"{Scratch(spark, 'vector_table').base}/table", dimension)
    held.create()
    for v, some, label in ((1, rows.where("label < 6"), F.col("label")), (2, rows.where("label > 3"), F.col("label") + 100), (3, rows.where("vec_id % 3 = 0"), F.col("label") + 200)):
        held.upsert(some.select(F.col("vec_id").cast("string").alias("chunk_id"), "vec_id", label.alias("label"), F.lit(v).alias("v"), F.col("embedding").alias("vector")))
    return held.read().select("vec_id", "label", "v", F.size("vector").alias("dimension"), F.round(F.element_at("vector", 1).cast("double"), 5).alias("first_component"))


@query(r"""
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || doc_id)) AS d FROM documents)
SELECT doc_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
  substr('89ab', CAST((instr('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 + 1 AS INTEGER), 1) || substr(d, 18, 1) || substr(d, 19, 2) || '-' || substr(d, 21, 12) AS point_id FROM h
""")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.uuid5(F.concat(F.lit(I.POINT_PREFIX), F.col("doc_id").cast("string"))).alias("point_id"))


@query(r"""
WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS word FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h FROM w),
c AS (SELECT doc_id, h % 64 AS place, sum(CASE WHEN h // 65536 % 2 = 0 THEN 1 ELSE -1 END) AS v FROM h GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM c GROUP BY doc_id)
SELECT d.doc_id, place, CAST(floor(coalesce(v / nullif(norm, 0), 0) * 10000 + 0.5) AS BIGINT) AS component FROM (SELECT doc_id, unnest(range(0, 64)) AS place FROM documents) d LEFT JOIN c USING (doc_id, place) LEFT JOIN n USING (doc_id)
""")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(I.hash_embedding(F.col("text"), double=True)).alias("place", "v"))
    return docs.select("doc_id", F.col("place").cast("long").alias("place"), F.floor(F.col("v") * 10000 + 0.5).alias("component"))


# --- text ------------------------------------------------------------------------------------------------------------

ARABIC_RE = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
QUALITY_SQL = f"""
seen AS (SELECT id, regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\x{{00A0}}]', '', 'g') AS s FROM src),
quality AS (SELECT id, length(s) AS character_count,
  length(regexp_replace(s, '[^{ARABIC_RE}]', '', 'g')) / greatest(length(s), 1) AS arabic_ratio,
  length(regexp_replace(s, '[^A-Za-zªºÀ-ÖØ-öø-ɏ]', '', 'g')) / greatest(length(s), 1) AS latin_ratio,
  length(regexp_replace(s, '[^\\x{{FFFD}}]', '', 'g')) / greatest(length(s), 1) AS replacement_ratio FROM seen)
"""
SOURCE_SQL = f"src AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -id, text FROM {X.values(X.TEXTS, 'id, text')})"
LANGUAGE_SQL = """CASE WHEN round_even(character_count * (arabic_ratio + latin_ratio), 0) < 3 OR arabic_ratio + latin_ratio = 0 THEN 'unknown'
  WHEN arabic_ratio / (arabic_ratio + latin_ratio) >= 0.8 THEN 'ar' WHEN arabic_ratio / (arabic_ratio + latin_ratio) <= 0.2 THEN 'en' ELSE 'mixed' END"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = X.frame(spark, X.TEXTS, "id long, text string").withColumn("id", -F.col("id"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").union(fixed)


@query(f"WITH {SOURCE_SQL}, {QUALITY_SQL} SELECT id, character_count, round(arabic_ratio, 6) AS arabic_ratio, round(latin_ratio, 6) AS latin_ratio, round(replacement_ratio, 6) AS replacement_ratio FROM quality")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = texts(spark, sf_dir).select("id", T.text_quality(F.col("text")).alias("q"))
    ratios = [F.round(f"q.{n}", 6).alias(n) for n in ("arabic_ratio", "latin_ratio", "replacement_ratio")]
    return q.select("id", F.col("q.character_count").cast("long").alias("character_count"), *ratios)


@query(f"WITH {SOURCE_SQL}, {QUALITY_SQL} SELECT id, {LANGUAGE_SQL} AS language FROM quality")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", T.detect_language(T.text_quality(F.col("text"))).alias("language"))


@query(f"WITH {SOURCE_SQL}, {QUALITY_SQL} SELECT id, character_count < 50 OR replacement_ratio > 0.01 OR arabic_ratio + latin_ratio < 0.2 AS needs_ocr FROM quality")
def needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", T.requires_ocr(T.text_quality(F.col("text")), "auto").alias("needs_ocr"))


NORMALIZE_SQL = r"""
array_to_string(list_filter(list_transform(string_split_regex(
  translate(regexp_replace(regexp_replace(regexp_replace(text, '[\x{0640}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]', '', 'g'),
    '[\x{E000}-\x{F8FF}]+', ' ', 'g'), '[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]', '', 'g'), 'آأإٱىیک', 'ااااييك'),
  '\r\n|[\n\r]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))
"""


@query(f"WITH {SOURCE_SQL} SELECT id, {NORMALIZE_SQL} AS normalized, md5({NORMALIZE_SQL}) AS composed FROM src")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search form, and that of the same text in wide digits and with ligatures, which compose to what they stand for."""
    wide = F.replace(F.replace(F.translate("text", "0123456789", "０１２３４５６７８９"), F.lit("fi"), F.lit("ﬁ")), F.lit("لا"), F.lit("ﻻ"))
    return texts(spark, sf_dir).select("id", T.normalize_text(F.col("text")).alias("normalized"), F.md5(T.normalize_text(wide)).alias("composed"))


@query(f"WITH {SOURCE_SQL} SELECT id, array_to_string(list_transform(regexp_extract_all(text, '[٠-٩۰-۹]+|[^٠-٩۰-۹]+'), lambda x: CASE WHEN regexp_matches(x, '^[٠-٩۰-۹]') THEN reverse(x) ELSE x END), '') AS reversed FROM src")
def reverse_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", T.reverse_digit_runs(F.col("text")).alias("reversed"))


def rtl_digit_storage(glyphs: DataFrame) -> DataFrame:
    """page, rtl: more neighbouring Arabic digit pairs of a line run leftwards than rightwards."""
    order = Window.partitionBy("page", "line").orderBy("pos")
    both = F.col("c").rlike(f"^[{T.ARABIC_DIGITS}]$") & F.lead("c").over(order).rlike(f"^[{T.ARABIC_DIGITS}]$")
    step = F.when(both, F.signum(F.lead("x").over(order) - F.col("x"))).otherwise(0)
    return glyphs.withColumn("_s", step).groupBy("page").agg((F.coalesce(F.sum("_s"), F.lit(0)) < 0).alias("rtl"))


@query(f"""
WITH g AS (SELECT doc_id AS page, pos % 2 AS line, pos, CASE WHEN (doc_id + pos) % 4 = 0 THEN 'a' ELSE substr('٠١٢٣٤٥٦٧٨٩۴۵', CAST((doc_id * 31 + pos) % 12 + 1 AS INTEGER), 1) END AS c, ((doc_id * 7919 + pos * 104729) % 997) / 10.0 AS x
  FROM documents CROSS JOIN (SELECT unnest(range(1, 13)) AS pos)),
n AS (SELECT *, lead(c) OVER w AS c2, lead(x) OVER w AS x2 FROM g WINDOW w AS (PARTITION BY page, line ORDER BY pos))
SELECT page, coalesce(sum(CASE WHEN regexp_matches(c, '^[٠-٩۰-۹]$') AND regexp_matches(c2, '^[٠-٩۰-۹]$') THEN sign(x2 - x) ELSE 0 END), 0) < 0 AS rtl FROM n GROUP BY page
""")
def rtl_digit_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve glyphs in two lines for each document, digits of both Arabic blocks and letters, at places made from its id."""
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("pos"))
    digit = F.substring(F.lit("٠١٢٣٤٥٦٧٨٩۴۵"), ((F.col("page") * 31 + F.col("pos")) % 12 + 1).cast("int"), F.lit(1))
    glyph = F.when((F.col("page") + F.col("pos")) % 4 == 0, "a").otherwise(digit)
    return rtl_digit_storage(held.select("page", (F.col("pos") % 2).alias("line"), "pos", glyph.alias("c"), ((F.col("page") * 7919 + F.col("pos") * 104729) % 997 / 10.0).alias("x")))


IDENTIFIERS_SQL = f"list_sort(list_distinct(list_transform({IDS.replace('{x}', 'text')}, lambda x: translate(x, '٠١٢٣٤٥٦٧٨٩', '0123456789'))))"


@query(f"WITH {SOURCE_SQL} SELECT id, array_to_string({IDENTIFIERS_SQL}, ',') AS identifiers FROM src")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", F.array_join(F.array_sort(T.identifiers(F.col("text"))), ",").alias("identifiers"))


@query(r"SELECT id, answer_language, citation FROM (SELECT id, regexp_matches(text, '\[[0-9]+\]|\b[eE][0-9]+\b') AS citation, " + f"""
  CASE WHEN n = 0 THEN false WHEN id % 2 = 0 THEN la / n >= 0.6 ELSE ar / n >= 0.6 END AS answer_language
  FROM (SELECT id, text, length(l) AS n, length(regexp_replace(l, '[^{ARABIC_RE}]', '', 'g')) AS ar, length(regexp_replace(l, '[^A-Za-zÀ-ɏ]', '', 'g')) AS la
    FROM (SELECT id, text, regexp_replace(text, '[^\\p{{L}}]', '', 'g') AS l FROM documents_and)))""".replace("documents_and", "(SELECT doc_id AS id, text FROM documents)"))
def answer_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    language = F.when(F.col("id") % 2 == 0, "en").otherwise("ar")
    return docs.select("id", T.answer_matches_language(F.col("text"), language).alias("answer_language"), T.holds_model_citation(F.col("text")).alias("citation"))


# --- sources and routing ---------------------------------------------------------------------------------------------


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a text file: some with a byte order mark, some not sound."""
    kind, raw = F.col("doc_id") % 12, F.encode("text", "UTF-8")
    content = (
        F.when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw))
        .when(kind == 2, F.concat(raw, F.unhex(F.lit("00"))))
        .when(kind == 3, F.concat(raw, F.unhex(F.lit("FF"))))
        .when(kind == 4, F.encode(F.lit(" \n\t"), "UTF-8"))
        .when(kind == 5, F.unhex(F.lit("")))
        .otherwise(raw)
    )
    held = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.when(kind == 6, "doc").otherwise("txt").alias("source_format"))
    return held.withColumn("path", F.concat(F.lit("d"), "doc_id")).withColumn("document_id", F.col("doc_id").cast("string")).withColumn("length", F.octet_length("content").cast("long"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 12 = 6 THEN 'unsupported format' WHEN doc_id % 12 = 5 OR (text = '' AND doc_id % 12 NOT IN (1, 2, 3, 4)) THEN 'file is empty'
  WHEN strlen(text) + CASE doc_id % 12 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END > 20000 AND doc_id % 12 <> 4 THEN 'file is too large'
  WHEN doc_id % 12 = 3 THEN 'text is not UTF-8' WHEN doc_id % 12 = 2 THEN 'text holds NUL' WHEN doc_id % 12 = 4 OR (doc_id % 12 <> 1 AND NOT regexp_matches(text, '\\S')) THEN 'text is blank' END AS error
FROM documents
""")
def validate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.validate(text_files(spark, sf_dir), limit=20_000).select("doc_id", "error")


@query(r"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+$') AS lines FROM documents)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS segments, CAST(greatest(len(lines), 1) AS BIGINT) AS locator_end, CAST(length(text) AS BIGINT) AS characters, CAST(coalesce(length(lines[len(lines)]), 0) AS BIGINT) AS last_segment,
  sha256(text) AS original_hash, 'txt' AS extraction_method, 'line' AS locator_type FROM t
""")
def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source records of all documents as text files, each twelfth with a byte order mark, which is not part of the text."""
    raw = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 12 == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).otherwise(raw)
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("d"), "doc_id").alias("path"), F.lit("txt").alias("source_format"), content.alias("content"))
    records = D.text_records(files)
    last = F.try_element_at("source_segments", F.lit(-1))
    return records.select(
        F.col("document_id").cast("long").alias("doc_id"), F.size("source_segments").cast("long").alias("segments"), F.col("locator_end").cast("long").alias("locator_end"), F.length("original_text").cast("long").alias("characters"),
        F.coalesce(last["end_char"] - last["start_char"], F.lit(0)).cast("long").alias("last_segment"), F.sha2("original_text", 256).alias("original_hash"), "extraction_method", "locator_type",
    )


READ = {"en": ("recognised words of a page ", 0.9), "ar": ("كلمات مقروءة من صفحة الكتاب ", 0.95)}


def stub_engine(document: str, page: int, language: str) -> tuple[str, float]:
    """An OCR engine without a model: it breaks on each fifth document's pages, reads nothing on third pages, and else what it is asked to read."""
    if int(document) % 5 == 0:
        raise RuntimeError("broken page")
    text, confidence = READ[language]
    return ("" if page == 3 else text * 4, confidence)


ROUTED_SQL = """
WITH p AS (SELECT page_id, page_id // 3 AS document_id, page_id % 3 + 1 AS page_number, CASE page_id % 8 WHEN 0 THEN url WHEN 4 THEN repeat('12345 ', 20) WHEN 6 THEN repeat('67 89 ', 20) ELSE html END AS src, page_id % 8 = 0 AS latin FROM pages),
src AS (SELECT page_id AS id, src AS text FROM p), """ + QUALITY_SQL + """,
r AS (SELECT p.*, character_count < 50 OR replacement_ratio > 0.01 OR arabic_ratio + latin_ratio < 0.2 AS ocr FROM p JOIN quality ON id = page_id),
-- a page of Latin letters is read as English; one without letters in the language that last was read, else in Arabic, of which the engine is surer
f AS (SELECT *, ocr AND document_id % 5 <> 0 AND page_number < 3 AS read FROM r),
w AS (SELECT *, CASE WHEN latin OR coalesce(bool_or(read AND latin) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'en' ELSE 'ar' END AS language FROM f)
"""


@query(ROUTED_SQL + f"""SELECT document_id, page_number, CASE WHEN NOT ocr THEN 'native' WHEN read THEN 'ocr' ELSE 'failed' END AS extraction_method,
  CASE WHEN NOT ocr THEN sha256(src) WHEN NOT read THEN sha256('') WHEN language = 'en' THEN sha256(repeat('{READ['en'][0]}', 4)) ELSE sha256(repeat('{READ['ar'][0]}', 4)) END AS text_hash,
  CASE WHEN read AND language = 'en' THEN 0.9::DOUBLE WHEN read THEN 0.95::DOUBLE END AS ocr_mean_confidence FROM w""")
def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as those of PDF files, three to a file: good native text stays, the others go to an OCR engine, whose failures mark single pages."""
    read = D.choose_ocr(page_frame(spark, sf_dir), stub_engine)
    return read.select(F.col("document_id").cast("long").alias("document_id"), F.col("page_number").cast("long").alias("page_number"), "extraction_method", F.sha2("original_text", 256).alias("text_hash"), "ocr_mean_confidence")


def page_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 8
    text = F.when(kind == 0, F.col("url")).when(kind == 4, F.repeat(F.lit("12345 "), F.lit(20))).when(kind == 6, F.repeat(F.lit("67 89 "), F.lit(20))).otherwise(F.col("html"))
    held = table(spark, sf_dir, "pages").select(F.expr("page_id div 3").cast("string").alias("document_id"), (F.col("page_id") % 3 + 1).cast("int").alias("page_number"), text.alias("native_text"))
    return held.withColumn("needs_ocr", T.requires_ocr(T.text_quality(F.col("native_text")), "auto"))


def in_turn(scratch: Scratch, rows: DataFrame, number: str, numbers: tuple[int, ...], made: Callable[[DataFrame], DataFrame], out: str) -> None:
    """What a stream makes of rows that arrive in turn by a number: one batch each, however many files it has; state and progress are kept between them."""
    folder = f"{scratch.base}/files"
    for n in numbers:
        rows.where(F.col(number) == n).write.mode("append").parquet(folder)
        stream = made(rows.sparkSession.readStream.schema(rows.schema).parquet(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{scratch.base}/state").trigger(availableNow=True).start().awaitTermination()


@query(ORACLES["page_routing"])
def page_routing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as a stream of three batches, one for each page number; the language that a document was last read in is kept as state."""
    from citeloom.streaming import carried

    carried.use_state_store(spark)
    scratch = Scratch(spark, "page_stream")
    pages = page_frame(spark, sf_dir)
    out = f"{scratch.base}/pages"
    in_turn(scratch, pages, "page_number", (1, 2, 3), lambda stream: carried.stream_ocr(stream, stub_engine), out)
    read = spark.read.schema(carried.PAGE_ROW).parquet(out)
    return read.select(F.col("document_id").cast("long").alias("document_id"), F.col("page_number").cast("long").alias("page_number"), "extraction_method", F.sha2("original_text", 256).alias("text_hash"), "ocr_mean_confidence")


@query(ROUTED_SQL + "SELECT document_id, count(*) AS processed_records, count_if(NOT ocr) AS direct_records, count_if(read) AS ocr_records, count_if(ocr AND NOT read) AS failed_records FROM w GROUP BY document_id")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report counts, per document."""
    from citeloom.plans.ingestion import record_counts

    counted = record_counts(page_routing(spark, sf_dir))
    return counted.select("document_id", *[F.col(c).cast("long").alias(c) for c in ("processed_records", "direct_records", "ocr_records", "failed_records")])


# --- numbers ---------------------------------------------------------------------------------------------------------

NUM = r"(?:[0-9]+(?:[.,][0-9]+)*|[٠-٩]+(?:[٫،.][٠-٩]+)*)"
NORM_NUM = "trim(replace(translate(translate({v}, '٠١٢٣٤٥٦٧٨٩', '0123456789'), '٫،', '.,'), ',', ''), '.')"
NUMBERS_SQL = "list_distinct(list_transform(regexp_extract_all({t}, '" + NUM + "'), lambda v: " + NORM_NUM.replace("{v}", "v") + "))"
# Fixed values, written out here as well, so that the operator's lists are checked and not quoted.
WORD_VALUES = {
    "صفر": 0, "واحد": 1, "واحدة": 1, "اثنان": 2, "اثنين": 2, "اثنتان": 2, "اثنتين": 2, "ثلاثة": 3, "ثلاث": 3, "أربعة": 4, "أربع": 4,
    "خمسة": 5, "خمس": 5, "ستة": 6, "ست": 6, "سبعة": 7, "سبع": 7, "ثمانية": 8, "ثمان": 8, "تسعة": 9, "تسع": 9, "عشرة": 10,
}
MILLION_UNITS = "مليون|ملايين|مليونًا|مليوناً|million|millions"
THRESHOLD_PHRASES = (
    r"(?:أقل|اقل|أقل من|اقل من)\s*(?:قيمة\s*)?(?:الدعوى|الدعاوى|المنازعة|المنازعات)?\s*{n}\s*(?:مليون|ملايين|million|millions)",
    r"(?:تقل|يقل)\s*(?:قيمتها|قيمته|القيمة)?\s*(?:عن|على)?\s*{n}\s*(?:مليون|ملايين|million|millions)",
    r"(?:لا تجاوز|لا يجاوز|لا تتجاوز|لا يتجاوز)\s*(?:قيمتها|قيمته|القيمة)?\s*{n}\s*(?:مليون|ملايين|million|millions)",
    r"(?:تزيد|يزيد)\s*(?:قيمتها|قيمته|القيمة)?\s*(?:على|عن)\s*{n}\s*(?:مليون|ملايين|million|millions)",
    r"(?:تجاوز|تجاوزت|يتجاوز|تتجاوز)\s*(?:قيمتها|قيمته|القيمة)?\s*{n}\s*(?:مليون|ملايين|million|millions)",
)
# End of fixed values.
WORD_CASE = "CASE v " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in WORD_VALUES.items()) + " END"
MILLIONS_SQL = (
    "list_distinct(list_concat(list_transform(regexp_extract_all({t}, '(?i)(" + NUM + r")\s*(?:" + MILLION_UNITS + ")', 1), lambda v: " + NORM_NUM.replace("{v}", "v") + " || ' million'), "
    "list_transform(regexp_extract_all({t}, '(" + "|".join(WORD_VALUES) + r")\s*(?:مليون|ملايين|مليونًا|مليوناً)', 1), lambda v: " + WORD_CASE + " || ' million')))"
)
THRESHOLD_SQL = "list_filter(" + MILLIONS_SQL + ", lambda m: " + " OR ".join(f"regexp_matches(lower({{t}}), replace('{p}', '{{n}}', replace(replace(m, ' million', ''), '.', '\\.')))" for p in THRESHOLD_PHRASES) + ")"


def sorted_list(sql: str, column: str = "text") -> str:
    return f"array_to_string(list_sort({sql.replace('{t}', column)}), ',')"


@query(f"WITH {SOURCE_SQL} SELECT id, {sorted_list(NUMBERS_SQL)} AS numbers FROM src")
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("id", F.array_join(F.array_sort(N.numbers(F.col("text"))), ",").alias("numbers"))


@query(f"WITH {SOURCE_SQL} SELECT id, {sorted_list(MILLIONS_SQL)} AS millions, {sorted_list(THRESHOLD_SQL)} AS thresholds FROM src")
def million_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return texts(spark, sf_dir).select("id", joined(N.million_values(F.col("text"))).alias("millions"), joined(N.threshold_values(F.col("text"))).alias("thresholds"))


def minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda z: NOT list_contains({b}, z))"


CLAIM_SQL = (
    "list_distinct(list_concat(list_concat("
    + minus(minus(NUMBERS_SQL.replace("{t}", "answer"), NUMBERS_SQL.replace("{t}", "question")), NUMBERS_SQL.replace("{t}", "evidence"))
    + ", "
    + minus(THRESHOLD_SQL.replace("{t}", "answer"), THRESHOLD_SQL.replace("{t}", "evidence"))
    + "), "
    + minus(minus(MILLIONS_SQL.replace("{t}", "answer"), MILLIONS_SQL.replace("{t}", "question")), MILLIONS_SQL.replace("{t}", "evidence"))
    + "))"
)


CLAIMED_SQL = f"""SELECT doc_id AS id, replace(question, '5', d) AS question, replace(replace(answer, '5', d), '12', e) AS answer, replace(evidence, '5', d) || ' ' || text AS evidence
  FROM (SELECT *, CAST(doc_id % 4 + 4 AS VARCHAR) AS d, CAST(doc_id % 3 + 11 AS VARCHAR) AS e FROM documents) JOIN {X.values(X.CLAIMS, 'k, question, answer, evidence')} ON k = doc_id % {len(X.CLAIMS)} + 1"""


@query(f"SELECT id, len(bad) = 0 AS ok, array_to_string(list_sort(bad), ',') AS unsupported FROM (SELECT id, {CLAIM_SQL} AS bad FROM ({CLAIMED_SQL}))")
def numeric_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question, answer and evidence for each document: one of eight forms with numbers made from its id, and the whole document as evidence."""
    forms = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("question", "answer", "evidence"), c[1:])]) for c in X.CLAIMS])
    d, e = (F.col("doc_id") % 4 + 4).cast("string"), (F.col("doc_id") % 3 + 11).cast("string")
    put = lambda c: F.replace(F.col(f"f.{c}"), F.lit("5"), d)
    rows = table(spark, sf_dir, "documents").withColumn("f", F.element_at(forms, (F.col("doc_id") % len(X.CLAIMS) + 1).cast("int")))
    rows = rows.select(F.col("doc_id").alias("id"), put("question").alias("q"), F.replace(put("answer"), F.lit("12"), e).alias("a"), F.concat(put("evidence"), F.lit(" "), F.col("text")).alias("t"))
    held = rows.select("id", N.validate_numeric_claims(F.col("q"), F.col("a"), F.col("t")).alias("v"))
    return held.select("id", "v.ok", F.array_join("v.unsupported", ",").alias("unsupported"))


# --- whole answers -----------------------------------------------------------------------------------------------------

# the share of the question's words that a text holds, as the deterministic reranker counts it
OVERLAP = r"(len(list_intersect(list_distinct(list_filter(string_split_regex(lower(query), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'), lambda x: x <> '')), string_split_regex(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'))) / 5.0::DOUBLE)"
ANSWERED_SQL = RANKED + f"""
hits AS (SELECT r.*, coalesce(d.text, '') AS text FROM ranked r LEFT JOIN documents d ON d.doc_id = r.chunk_id WHERE dense_rank_no <= 20),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) AS n FROM hits) WHERE n <= 4),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, dense_rank_no) AS rerank_no FROM (SELECT *, {OVERLAP} AS rerank_score FROM capped)) WHERE rerank_no <= 6),
{EVIDENCE[EVIDENCE.index('tops AS'):].replace('{drop}', '0.02').replace('evidence_no <= 3', 'evidence_no <= 2')}
stripped AS (SELECT query_id, query, chunk_id, document_id, evidence_no, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM evidence),
room AS (SELECT *, 12000 - coalesce(sum(length(t)) OVER (PARTITION BY query_id ORDER BY evidence_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM stripped WHERE t <> ''),
quoted AS (SELECT *, substr(t, 1, CAST(room AS BIGINT)) AS q, row_number() OVER (PARTITION BY query_id ORDER BY evidence_no) AS k FROM room WHERE room > 0),
signals AS (SELECT query_id, any_value(query) AS query, max(score) AS top, max(CASE WHEN dense_rank_no = 2 THEN score END) AS second, count(DISTINCT document_id) AS source_count, list_distinct(flatten(list({IDS.replace('{x}', 'text')}))) AS named FROM hits GROUP BY query_id),
best AS (SELECT query_id, max(rerank_score) AS rr FROM reranked GROUP BY query_id),
"""


@query(
    f"WITH {ANSWERED_SQL}"
    + r"""
first AS (SELECT query_id, q AS quoted, trim(regexp_extract(q, '(?s)^(.*?[.!؟\n]|.+$)', 1), ' ') AS answer FROM quoted WHERE k = 1),
counted AS (SELECT query_id, count(*) AS evidence_count FROM quoted GROUP BY query_id),
claimed AS (SELECT s.*, rr, coalesce(evidence_count, 0) AS evidence_count, f.quoted AS evidence, f.answer, s.query AS question, regexp_matches(f.answer, '\[\p{Nd}+\]|\b[eE]\p{Nd}+\b') AS cites FROM signals s LEFT JOIN best USING (query_id) LEFT JOIN first f USING (query_id) LEFT JOIN counted USING (query_id)),
"""
    + f"judged AS (SELECT *, CASE WHEN answer IS NOT NULL THEN list_sort({CLAIM_SQL}) END AS bad, list_has_any({IDS.replace('{x}', 'query')}, named) AS match FROM claimed)"
    + f"""
SELECT query_id, CASE WHEN answer IS NULL THEN '{A.MESSAGES['no_evidence']['en']}' WHEN cites THEN '{A.MESSAGES['generation']['en']}' WHEN len(bad) > 0 THEN 'The answer contained unsupported numeric values: ' || array_to_string(bad, ', ') || '.'
    ELSE answer || ' [1]' END AS answer,
  coalesce(NOT cites AND len(bad) = 0, false) AS answered, CASE WHEN answer IS NULL THEN 'model_reported_insufficient_evidence' WHEN cites THEN 'invalid_structured_generation' WHEN len(bad) > 0 THEN 'numeric_validation_failure' ELSE 'sufficient' END AS reason,
  CASE WHEN coalesce(NOT cites AND len(bad) = 0, false) THEN '[1]E1' ELSE '' END AS cited, CASE WHEN coalesce(NOT cites AND len(bad) = 0, false) THEN sha256(evidence) ELSE sha256('') END AS excerpts_hash,
  CASE WHEN answer IS NULL THEN 0 WHEN cites THEN evidence_count WHEN len(bad) = 0 THEN 1 ELSE 0 END AS used_evidence, 'dense_plus_cross_encoder' AS strategy, round(top, 6) AS top_dense_score, round(top - second, 6) AS dense_margin, round(rr, 6) AS top_rerank_score,
  source_count, match AS identifier_match
FROM judged"""
)
def answer_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to cited answers, with the diagnostics of each; the extractive generator quotes the first sentence of the first evidence."""
    from citeloom.plans.pipeline import answer

    found = answer(*answer_inputs(spark, sf_dir))
    d = F.col("diagnostics")
    return found.select(
        "query_id", "answer", "answered", "reason", F.array_join(F.transform("citations", lambda c: F.concat(c["marker"], c["evidence_id"])), " ").alias("cited"), F.sha2(F.array_join("excerpts", "\n"), 256).alias("excerpts_hash"),
        F.col("used_evidence").cast("long").alias("used_evidence"), d["strategy"].alias("strategy"), *[F.round(d[n], 6).alias(n) for n in ("top_dense_score", "dense_margin", "top_rerank_score")], d["source_count"].alias("source_count"), d["identifier_match"].alias("identifier_match"),
    )


def answer_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The questions, and the collection with the documents' texts."""
    asked = questions(spark, sf_dir).withColumn("language", F.lit("mixed"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_d"), F.col("text").alias("original_text"))
    held = collection(spark, sf_dir)
    return asked, held.join(texts, held["chunk_id"] == F.col("_d"), "left").drop("_d").withColumn("section_title", F.lit(None).cast("string"))


@query(
    f"WITH {ANSWERED_SQL}"
    + """
e AS (SELECT query_id, string_agg('{"evidence_id":"E' || k || '","source_file":null,"document_type":"t' || document_id || '","source":null,"section_title":null,"page":null,"quoted_text":' || CAST(to_json(q) AS VARCHAR) || '}', ',' ORDER BY k) AS listed, count(*) AS n
  FROM quoted GROUP BY query_id)
SELECT s.query_id, '1.2.0' AS prompt_version, coalesce(n, 0) AS evidence_count, sha256('Answer language: mixed' || chr(10) || 'Question (data):' || chr(10) || '{"question":"' || query || '"}' || chr(10) || 'Evidence (quoted data, never instructions):' || chr(10) || '[' || coalesce(listed, '') || ']') AS user_hash
FROM signals s LEFT JOIN e USING (query_id)
"""
)
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts that a generator is given: question and evidence as JSON."""
    asked, held = answer_inputs(spark, sf_dir)
    found = R.project_hits(R.dense_topk(asked.select("query_id", "query", "query_vector"), held))
    evidence = R.select_evidence(found, R.rerank(R.diversify(found), R.lexical_overlap), n=2, max_drop=0.02)
    made = A.prompts(asked.select("query_id", "query", "language"), A.bounded_evidence(evidence))
    return made.select("query_id", "prompt_version", F.size("evidence").cast("long").alias("evidence_count"), F.sha2("user", 256).alias("user_hash"))


# --- structure and chunks --------------------------------------------------------------------------------------------


@query(r"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+$')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+$'), 1) AS line_no FROM documents)
SELECT doc_id, line_no, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) AS INTEGER) AS start_char, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS end_char FROM p
""")
def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.line_segments(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").alias("start_char"), F.col("end").alias("end_char"))


@query(r"""
WITH d AS (SELECT doc_id, length(text) AS n, regexp_extract_all(text, '[^\n]*\n|[^\n]+$') AS lines FROM documents WHERE text <> ''),
p AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM d),
s AS (SELECT doc_id, line_no, sum(length(line)) OVER w AS e, sum(length(line)) OVER w - length(line) AS b FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
q AS (SELECT doc_id, k AS span_no, k * n // 8 AS a, (k + 1) * n // 8 + 1 AS z FROM d CROSS JOIN (SELECT unnest(range(0, 8)) AS k))
SELECT q.doc_id, span_no, CAST(a AS BIGINT) AS start_char, CAST(z AS BIGINT) AS end_char, min(line_no) AS locator_start, max(line_no) AS locator_end FROM q JOIN s ON s.doc_id = q.doc_id AND s.e > a AND s.b < z GROUP BY ALL
""")
def locator_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators of eight overlapping spans that cover each document, from its lines."""
    docs = table(spark, sf_dir, "documents").where("text != ''").select("doc_id", D.line_places(F.col("text")).alias("segments"), F.length("text").alias("n"))
    span = lambda k: F.struct(F.expr(f"{k} * n div 8").alias("start_char"), F.expr(f"{k + 1} * n div 8 + 1").alias("end_char"))
    found = C.locate_spans(docs.withColumn("spans", F.array(*[span(k) for k in range(8)])), ["doc_id"])
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in found.columns if c != "doc_id"])


KINDS_SQL = r"""
SELECT id, CASE WHEN t = '' THEN 'paragraph' WHEN regexp_matches(t, '^(الباب|الفصل|القسم|الكتاب|الجزء)( |$)') THEN 'heading' WHEN regexp_matches(t, '^(المادة|مادة)') THEN 'article'
  WHEN regexp_matches(t, '(?i)^(part|chapter|section)\b') THEN 'heading' WHEN regexp_matches(t, '(?i)^article') THEN 'article'
  WHEN regexp_matches(t, '^(?:\(?[0-9٠-٩]+\)?|[أ-يA-Za-z])\s*[-–—.):]\s+') THEN 'clause' ELSE 'paragraph' END AS kind,
 CASE WHEN regexp_matches(t, '^(الباب|الكتاب|الجزء)( |$)') OR regexp_matches(t, '(?i)^part\b') THEN 'part' WHEN regexp_matches(t, '^الفصل( |$)') OR regexp_matches(t, '(?i)^chapter\b') THEN 'chapter'
  WHEN regexp_matches(t, '^القسم( |$)') OR regexp_matches(t, '(?i)^section\b') THEN 'section' WHEN regexp_matches(t, '^(المادة|مادة)') OR regexp_matches(t, '(?i)^article') THEN 'article' END AS section_type,
 CASE WHEN regexp_matches(t, '^(المادة|مادة)') THEN trim(regexp_extract(t, '^(?:المادة|مادة)\s*(?:\([^)]{1,30}\)|\S{1,30})?')) WHEN regexp_matches(t, '(?i)^article') THEN trim(regexp_extract(t, '(?i)^article\s*(?:\([^)]{1,30}\)|[0-9A-Za-z.-]{1,30})?'))
  WHEN regexp_matches(t, '^(الباب|الفصل|القسم|الكتاب|الجزء)( |$)') OR regexp_matches(t, '(?i)^(part|chapter|section)\b') THEN substr(t, 1, 200) END AS title
FROM (SELECT id, trim(translate(regexp_replace(l, ' +', ' ', 'g'), 'آأإٱىیک', 'ااااييك')) AS t FROM (SELECT doc_id AS id, CASE WHEN line = '' THEN '' ELSE line || ' ' || regexp_replace(d.text, '[^A-Za-z .]', '', 'g') END AS l
  FROM documents d JOIN """ + X.values(X.LINES, "k, line") + f" ON k = doc_id % {len(X.LINES)} + 1))"


@query(KINDS_SQL)
def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each document: one of the forms of headings, articles, clauses and prose, and the document's letters."""
    form = F.element_at(F.array(*[F.lit(t) for _, t in X.LINES]), (F.col("doc_id") % len(X.LINES) + 1).cast("int"))
    line = F.when(form == "", "").otherwise(F.concat(form, F.lit(" "), F.regexp_replace("text", "[^A-Za-z .]+", "")))
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), line.alias("line"))
    held = lines.select("id", S.classify(F.col("line")).alias("c"))
    return held.select("id", "c.kind", "c.section_type", "c.title")


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as two records; the second line of the first opens a chapter, some second records open an article."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    one = F.concat(F.lit("Opening words.\nCHAPTER "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    two = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Article "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise(""), F.lit("1. First clause\n\n"), F.col("text"))
    return docs.select("doc_id", F.lit(1).alias("record_no"), one.alias("text")).union(docs.select("doc_id", F.lit(2).alias("record_no"), two.alias("text")))


SECTIONS_SQL = r"""
WITH r AS (SELECT doc_id, 1 AS record_no, 'Opening words.' || chr(10) || 'CHAPTER ' || doc_id || chr(10) || text AS text FROM documents
  UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 3 = 0 THEN 'Article ' || doc_id || chr(10) ELSE '' END || '1. First clause' || chr(10) || chr(10) || text FROM documents),
p AS (SELECT doc_id, record_no, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+$')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+$'), 1) AS line_no FROM r),
c AS (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t, sum(length(line)) OVER (PARTITION BY doc_id, record_no ORDER BY line_no) AS e FROM p),
k AS (SELECT *, regexp_matches(t, '(?i)^(part|chapter|section)\b') AS h, regexp_matches(t, '(?i)^article') AS a,
  regexp_matches(t, '^(?:\(?[0-9]+\)?|[A-Za-z])\s*[-–—.):]\s+') AS cl FROM c),
s AS (SELECT *, sum(CASE WHEN h OR a THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, record_no ORDER BY line_no) AS section_no,
  last_value(CASE WHEN h THEN lower(regexp_extract(t, '(?i)^(part|chapter|section)')) WHEN a THEN 'article' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY record_no, line_no) AS st,
  last_value(CASE WHEN h THEN substr(t, 1, 200) WHEN a THEN trim(regexp_extract(t, '(?i)^article\s*(?:\([^)]{1,30}\)|[0-9A-Za-z.-]{1,30})?')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY record_no, line_no) AS ti FROM k)
SELECT doc_id, record_no, CAST(section_no AS BIGINT) AS section_no, CAST(min(e - length(line)) AS INTEGER) AS start_char, CAST(max(e) AS INTEGER) AS end_char, coalesce(any_value(st), 'document') AS section_type, any_value(ti) AS section_title,
  coalesce(string_agg(CASE WHEN t = '' THEN e WHEN cl THEN e - length(line) END, ',' ORDER BY line_no), '') AS breaks
FROM s GROUP BY doc_id, record_no, section_no HAVING max(length(t)) > 0
"""


@query(SECTIONS_SQL)
def detect_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.detect_sections(headed(spark, sf_dir))
    return found.withColumn("breaks", F.array_join(F.transform("preferred_breaks", lambda b: b.cast("string")), ",")).drop("preferred_breaks")


@query(SECTIONS_SQL)
def sections_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sections from a stream: first records and second records are files that come in several batches, headings are kept as state between them."""
    from citeloom.streaming import carried

    carried.use_state_store(spark)
    scratch = Scratch(spark, "sections_stream")
    records = headed(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document"), "record_no", "text")
    out = f"{scratch.base}/sections"
    in_turn(scratch, records, "record_no", (1, 2), carried.stream_sections, out)
    found = spark.read.parquet(out)
    breaks = F.array_join(F.transform("preferred_breaks", lambda b: b.cast("string")), ",")
    return found.select(F.col("document").cast("long").alias("doc_id"), "record_no", "section_no", "start_char", "end_char", "section_type", "section_title", breaks.alias("breaks"))


@query(SECTIONS_SQL)
def sections_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sections by the table function, called from SQL."""
    from citeloom.plans import sql_functions

    sql_functions.register(spark)
    return spark.sql(
        "SELECT doc_id, record_no, section_no, start_char, end_char, section_type, section_title, array_join(transform(preferred_breaks, b -> string(b)), ',') AS breaks "
        "FROM citeloom_sections(TABLE({records}) PARTITION BY doc_id ORDER BY record_no)",
        records=headed(spark, sf_dir),
    )


CHUNKS_SQL = r"""
w AS (SELECT doc_id, source, regexp_extract_all(text, '\S+') AS words FROM documents),
k AS (SELECT doc_id, source, words, len(words) AS n, CASE WHEN len(words) + 3 <= 480 THEN 0 ELSE CAST(ceil((len(words) - 477) / 337.0) AS INTEGER) END AS last FROM w WHERE len(words) > 0),
c AS (SELECT doc_id, source, words, n, last, unnest(range(0, last + 1)) AS i FROM k),
chunks AS (SELECT doc_id, source, CAST(i AS INTEGER) AS chunk_index, CAST(i * 337 AS INTEGER) AS first_word, CAST(CASE WHEN i = last THEN n - i * 337 ELSE 397 END AS INTEGER) AS n_words,
  array_to_string(words[i * 337 + 1 : i * 337 + CASE WHEN i = last THEN n - i * 337 ELSE 397 END], ' ') AS chunk_text FROM c)
"""


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_words(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, first_word, n_words, n_words + 3 AS token_count, sha256(chunk_text) AS text_hash FROM chunks")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir).select("doc_id", "chunk_index", "first_word", "n_words", "token_count", F.sha2("chunk_text", 256).alias("text_hash"))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, n_words + 3 AS token_count, sha256(chunk_text) AS text_hash FROM chunks")
def chunk_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general walk, with its search for ends and starts, by the word counter: it must cut where the closed form cuts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.array().cast("array<int>").alias("preferred_breaks"))
    found = C.chunk_spans(docs, keep=["doc_id"])
    return found.select("doc_id", F.col("chunk_in_section").alias("chunk_index"), "token_count", F.sha2(F.regexp_replace("chunk_text", r"\s+", " "), 256).alias("text_hash"))


@query()
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents by the tokens of a word BPE file; tests hold them against a walk that tokenises each candidate anew."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.array().cast("array<int>").alias("preferred_breaks"))
    found = C.chunk_spans(docs, C.tokenizer_counter(public_tokenizers.path("word_bpe_49k.json")), keep=["doc_id"])
    return found.select("doc_id", F.col("chunk_in_section").alias("chunk_index"), "chunk_start", "chunk_end", "token_count", F.sha2("chunk_text", 256).alias("text_hash"))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, source, chunk_index, n_words + 3 AS token_count, sha256(chunk_text) AS text_hash FROM chunks")
def chunks_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the table function, called from SQL, with the other columns of its table."""
    from citeloom.plans import sql_functions

    sql_functions.register(spark)
    return spark.sql(
        "SELECT doc_id, source, chunk_index, token_count, sha2(regexp_replace(chunk_text, '\\\\s+', ' '), 256) AS text_hash FROM citeloom_chunks(TABLE({docs}))",
        docs=table(spark, sf_dir, "documents").select("doc_id", "source", "text"),
    )


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, sha256('d' || doc_id || ':1:1.2.0:txt:line:1:1:' || first_word || ':' || (first_word + n_words) || ':document:') AS chunk_id FROM chunks")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1)
    ident = C.stable_chunk_id(F.concat(F.lit("d"), F.col("doc_id").cast("string")), one, F.lit("txt"), F.lit("line"), one, one, F.col("first_word"), F.col("first_word") + F.col("n_words"), F.lit("document"), F.lit(None))
    return chunked(spark, sf_dir).select("doc_id", "chunk_index", ident.alias("chunk_id"))


@query(f"WITH {CHUNKS_SQL} SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS chunks, CAST(sum(n_words) AS BIGINT) AS words, count_if(n_words + 3 > 400) AS over_target FROM chunks GROUP BY source")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counts per document come from the chunk rows themselves: every document's first chunk has index 0
    rows = chunked(spark, sf_dir).groupBy("source")
    return rows.agg(F.count_if(F.col("chunk_index") == 0).alias("documents"), F.count(F.lit(1)).alias("chunks"), F.sum("n_words").cast("long").alias("words"), F.count_if(F.col("token_count") > 400).alias("over_target"))


# --- answers ---------------------------------------------------------------------------------------------------------

ANSWER_VARIANTS = [
    '{"answer":"@","evidence_ids":["E1"],"insufficient_evidence":false}', '{"answer":"@","evidence_ids":["E1","E1"],"insufficient_evidence":false}', '{"answer":"@","evidence_ids":["E9"]}', '{"answer":"@ [1]","evidence_ids":["E1"]}',
    '{"answer":"@","evidence_ids":[],"insufficient_evidence":true}', '{"answer":"@","evidence_ids":[],"insufficient_evidence":false}', '{"answer":"@","evidence_ids":["E2"],"more":1}', 'not json @', '{"answer":"","evidence_ids":["E1"]}',
    '{"answer":"@","evidence_ids":["E2"]}', '{"answer":5,"evidence_ids":["E1"]}', '{"answer":true,"evidence_ids":["E1"]}', '{"answer":{"a":"@"},"evidence_ids":["E1"]}', '{"answer":"@","evidence_ids":["E1"]} and more', '{"answer":"@","evidence_ids":["E1"],"insufficient_evidence":null}',
    '{"answer":"@","evidence_ids":[],"insufficient_evidence":"Yes"}', '{"answer":"@","evidence_ids":[],"insufficient_evidence":"no"}', '{"answer":"@","evidence_ids":[],"insufficient_evidence":1}', '{"answer":"@","evidence_ids":[],"insufficient_evidence":2}', '{"answer":"@","evidence_ids":["E1",null]}',
    '{"answer":"@","evidence_ids":"E1"}', '{"answer":"@"}', '[{"answer":"@","evidence_ids":["E1"]}]', '{"answer":null,"evidence_ids":["E1"]}', '{"answer":"@","evidence_ids":["E1"],"insufficient_evidence":"perhaps"}',
]
ANSWERS_SQL = f"""
WITH v AS (SELECT * FROM {X.values(list(enumerate(ANSWER_VARIANTS)), 'k, shape')}),
r AS (SELECT doc_id, replace(shape, '@', regexp_replace(text, '[^A-Za-z .,]', '', 'g')) AS raw, CASE WHEN doc_id % 3 = 0 THEN 'ar' WHEN doc_id % 3 = 1 THEN 'en' ELSE 'mixed' END AS language FROM documents JOIN v ON k = doc_id % {len(ANSWER_VARIANTS)}),
j AS (SELECT *, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS o FROM r),
f AS (SELECT *, json_type(o) AS kind, json_keys(o) AS keys, json_type(o, '$.answer') AS answer_kind, json_type(o, '$.evidence_ids') AS ids_kind, o ->> '$.answer' AS answer, json_type(o, '$.insufficient_evidence') AS lack_kind,
  lower(o ->> '$.insufficient_evidence') AS lack_word, CASE WHEN json_type(o, '$.evidence_ids') = 'ARRAY' THEN CAST(json_extract(o, '$.evidence_ids[*]') AS JSON[]) END AS ids FROM j),
g AS (SELECT *, CASE WHEN NOT list_contains(keys, 'insufficient_evidence') THEN false WHEN lack_kind = 'BOOLEAN' THEN lack_word = 'true' WHEN lack_kind = 'VARCHAR' AND lack_word IN ('1', 'on', 't', 'true', 'y', 'yes') THEN true
  WHEN lack_kind = 'VARCHAR' AND lack_word IN ('0', 'off', 'f', 'false', 'n', 'no') THEN false WHEN lack_kind IN ('UBIGINT', 'BIGINT') AND lack_word = '1' THEN true WHEN lack_kind IN ('UBIGINT', 'BIGINT') AND lack_word = '0' THEN false END AS lack,
  list_transform(ids, lambda x: x ->> '$') AS names, length(regexp_replace(answer, '[^A-Za-z]', '', 'g')) AS letters FROM f)
SELECT doc_id, coalesce(kind = 'OBJECT' AND len(list_filter(keys, lambda x: x NOT IN ('answer', 'evidence_ids', 'insufficient_evidence'))) = 0 AND answer_kind = 'VARCHAR' AND length(answer) > 0 AND ids_kind = 'ARRAY'
    AND len(list_filter(ids, lambda x: json_type(x) <> 'VARCHAR')) = 0 AND len(list_distinct(names)) = len(names) AND lack IS NOT NULL AND len(list_filter(names, lambda x: x NOT IN ('E1', 'E2'))) = 0
    AND (lack OR len(names) > 0) AND NOT regexp_matches(answer, '\\[[0-9]+\\]|\\b[eE][0-9]+\\b') AND (language = 'mixed' OR (language = 'en' AND letters > 0)), false) AS valid
FROM g
"""


@query(ANSWERS_SQL)
def structured_answer_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw answer per document: its letters in one of the shapes that a model may give; a shape in three languages."""
    shapes = F.array(*[F.lit(v) for v in ANSWER_VARIANTS])
    words = F.regexp_replace("text", "[^A-Za-z .,]", "")
    raw = F.replace(F.element_at(shapes, (F.col("doc_id") % len(ANSWER_VARIANTS) + 1).cast("int")), F.lit("@"), words)
    language = F.when(F.col("doc_id") % 3 == 0, "ar").when(F.col("doc_id") % 3 == 1, "en").otherwise("mixed")
    return table(spark, sf_dir, "documents").select("doc_id", A.acceptable(raw, F.array(F.lit("E1"), F.lit("E2")), language).isNotNull().alias("valid"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
