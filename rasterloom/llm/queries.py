"""The corpus operators' queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, langid, neardup, packing, quality, repeats, topk, toxicity, urls
from .common import fold, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.tag(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), spans=None)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.rank(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), k=3, percent=85)


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) sh FROM w),
e AS (SELECT doc_id, unnest(sh) k, len(sh) n FROM s),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) i, min(a.n) an, min(b.n) bn FROM e a JOIN e b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (an + bn - i)),
r AS (SELECT doc_id id, doc_id comp FROM documents UNION SELECT l.b, r.comp FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(comp) comp FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) n_shingles, m.comp component_id, s.doc_id = m.comp kept FROM s JOIN m ON m.id = s.doc_id
"""


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h, CAST(strlen(coalesce(text, '')) AS BIGINT) n FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) i FROM d)),
c AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY 1 HAVING count(*) > 1)),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END fresh FROM c),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) s FROM b),
r AS (SELECT doc_id, s, min(i) a, max(i) + 200 z FROM g GROUP BY 1, 2),
q AS (SELECT doc_id, count(*) spans, sum(z - a) removed, list(a ORDER BY a) xs, list(z ORDER BY a) zs FROM r GROUP BY 1)
SELECT d.doc_id, n n_bytes, CAST(coalesce(removed, 0) AS BIGINT) n_removed, coalesce(spans, 0) n_spans,
sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, spans + 2), lambda j: substr(h, 2 * coalesce(zs[j - 1], 0) + 1, 2 * (coalesce(xs[j], n) - coalesce(zs[j - 1], 0)))), '') END)) kept_sha256
FROM d LEFT JOIN q USING (doc_id)
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = langid.identify(docs.drop("lang"), langid.fit(docs))
    return told.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return fingerprint.edited_likeness(docs)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_toxicity, op3_url_filter, op4_topk, op5_quality, op6_neardup, op7_repeats, op8_packing, op9_langid, op10_fingerprint, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": OP4_SQL, "op6_neardup": OP6_SQL, "op7_repeats": OP7_SQL}
