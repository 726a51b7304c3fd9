"""The queries of the training-data operators, with production parameters, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townloom.session import scratch_path

PSEUDONYM_KEY = "townloom"  # a deployment passes its own secret key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_best_fit_packing(spark, sf_dir):
    from townloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_token_counts(spark, sf_dir):
    from townloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_token_files(spark, sf_dir):
    from townloom.llm.token_files import read_token_files, write_token_files

    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path).drop("ids")


SHINGLES_SQL = """(SELECT DISTINCT {key}, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5
    THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM (SELECT {key}, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws
    FROM {table} WHERE text IS NOT NULL))"""


@query
def op1_benchmark_decontamination(spark, sf_dir):
    from townloom.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op1_benchmark_decontamination"] = f"""
WITH d AS {SHINGLES_SQL.format(key="doc_id", table="documents")},
     b AS {SHINGLES_SQL.format(key="item_id", table="benchmark")},
     n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d JOIN b USING (g) JOIN n USING (item_id) GROUP BY 1, 2, 3 HAVING 5 * count(*) >= 4 * n_item"""


@query
def op9_pii_pseudonyms(spark, sf_dir):
    from townloom.llm.pii import pseudonymize

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, PSEUDONYM_KEY, count_col="n_values")


@query
def op10_quality_classifier(spark, sf_dir):
    from townloom.llm.quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_toxicity(spark, sf_dir):
    from townloom.llm.toxicity import classify_toxicity

    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_lattice_lm(spark, sf_dir):
    from townloom.llm.lattice_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_exact_top_k(spark, sf_dir):
    from townloom.llm.topk import top_products

    vectors = table(spark, sf_dir, "embeddings")
    return top_products(vectors.where("vec_id % 20 = 0"), vectors)


ORACLES["op4_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(
      CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


@query
def op2_ngram_jaccard_join(spark, sf_dir):
    from townloom.llm.jaccard_join import similarity_components

    return similarity_components(table(spark, sf_dir, "documents"))


@query
def op11_ranked_search(spark, sf_dir):
    from townloom.llm.ranked_search import ranked_documents

    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERMS_SQL = """(SELECT {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {table} WHERE text IS NOT NULL)"""

ORACLES["op11_ranked_search"] = f"""
WITH d AS (SELECT doc_id, term, count(*) AS tf FROM {TERMS_SQL.format(key="doc_id", table="documents")} GROUP BY 1, 2),
  i AS (SELECT item_id, term, count(*) AS times FROM {TERMS_SQL.format(key="item_id", table="benchmark")} GROUP BY 1, 2),
  n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY 1),
  c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM n),
  w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM d, c WHERE term IN (SELECT term FROM i) GROUP BY term, docs),
  s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len)))) AS BIGINT) AS score
    FROM i JOIN d USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""


@query
def op12_hard_negatives(spark, sf_dir):
    from townloom.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


ORACLES["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
      CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
    FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  r AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (
        PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
      vec_id AS negative_id, positive_score, score AS negative_score
    FROM s JOIN p USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM r WHERE rank <= 5"""


@query
def op13_minhash_dedup(spark, sf_dir):
    from townloom.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


# Components by the links themselves: shared shingles counted, links followed to the end.
LINKED_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
  g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n} - 1], ' ')) END) AS g FROM w),
  k AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
  s AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM s JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
  m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(k.n, 0) AS n_shingles, component_id{more} FROM m LEFT JOIN k USING (doc_id)"""
ORACLES["op2_ngram_jaccard_join"] = LINKED_SQL.format(n=4, more="")
ORACLES["op13_minhash_dedup"] = LINKED_SQL.format(n=5, more=", doc_id = component_id AS kept")
