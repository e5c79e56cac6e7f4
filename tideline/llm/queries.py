"""The registered queries of this package: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table_of


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    docs = table_of(spark, sf_dir, "documents")
    return pack_documents(docs, _vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import link_documents

    return link_documents(table_of(spark, sf_dir, "documents"), words=3, percent=90)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import find_secrets

    base = F.filter("spans", lambda s: s["kind"] != "model")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return find_secrets(table_of(spark, sf_dir, "documents")).select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    return score_documents(table_of(spark, sf_dir, "documents"), table_of(spark, sf_dir, "labels"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; the digests of both, and whether the text came back."""
    from .piece_codec import encode_documents

    return encode_documents(table_of(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), decode=True).select(
        "doc_id",
        "n_pieces",
        F.crc32("ids").cast("long").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("same").alias("round_trip"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import duplicate_groups

    return duplicate_groups(table_of(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_duplicates

    return near_duplicates(table_of(spark, sf_dir, "embeddings"), cosine=0.93)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KEY_CONF, surrogate_documents

    return surrogate_documents(table_of(spark, sf_dir, "documents"), spark.conf.get(KEY_CONF, "no secret"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_documents

    found = identify_documents(table_of(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import digest_documents, round_trip

    docs = table_of(spark, sf_dir, "documents")
    return digest_documents(round_trip(docs, _vocabulary("word_bpe_49k.json"), end_id=2))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), pairs AS (
  SELECT a, b FROM common JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * shared >= 90 * (m.n + n.n - shared)
), links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
classes AS (SELECT sha256(array_to_string(list_sort(s), chr(10))) AS c, min(doc_id) AS class_id FROM sets WHERE len(s) > 0 GROUP BY 1)
SELECT s.doc_id, n.n AS n_shingles, coalesce(c.class_id, s.doc_id) AS class_id, l.component_id
FROM sets s JOIN sizes n USING (doc_id) JOIN least l USING (doc_id)
LEFT JOIN classes c ON len(s.s) > 0 AND c.c = sha256(array_to_string(list_sort(s.s), chr(10)))
"""

OP7_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counted USING (vec_id)
"""

OP6_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def queries() -> dict:
    every = (
        op1_best_fit_packing,
        op2_ngram_jaccard_join,
        op3_secret_scan,
        op4_quality_classifier,
        op5_piece_codec,
        op6_exact_dedup,
        op7_embedding_near_dedup,
        op8_pii_surrogates,
        op9_language_id,
        op10_token_store,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op7_embedding_near_dedup": OP7_SQL}
