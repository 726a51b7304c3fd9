"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townloom.session import cut

BROADCAST_ROWS = 1_000_000  # at most so many narrow rows (16 to 32 bytes each) are broadcast


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_texts(w: Column, n: int) -> Column:
    """Distinct runs of n words; with fewer words the whole sequence as one; none without words."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))),
                       lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(n))))
    return F.when(F.size(w) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def shingle_hashes(h: Column, n: int) -> Column:
    """The shingles as hashes of word hashes; equal to those of any text with the same words."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))),
                       lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))
    return F.when(F.size(h) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def with_hashes(df: DataFrame, n: int) -> DataFrame:
    """Replaces `text` by `grams`.

    Each step is a projection of its own, so no array is computed once per element of the next. For the
    same reason no filter may ask for sizes of these arrays before they are exploded (explode_outer: a plain
    explode adds such a filter, and it would be pushed below the projections).
    """
    df = df.withColumn("word_hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    return df.withColumn("grams", shingle_hashes(F.col("word_hashes"), n)).drop("word_hashes", "text")


def share(n: Column, threshold: float) -> Column:
    """The fewest of n shingles that reach the threshold."""
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")


def item_sketches(items: DataFrame, n: int, threshold: float) -> DataFrame:
    """(item_id, n_item, need, hits_needed, gram): the MinHash sketch of every item.

    Items are partitioned by size (powers of two). A partition's sketch length comes from its upper bound u:
    twice as many values as such an item may miss, and one more. A document that holds `need` of an item's
    shingles misses at most n_item - need sketch values whatever the order, hence holds at least
    `hits_needed` of them: no document is lost.
    """
    items = with_hashes(items, n).withColumn("n_item", F.size("grams"))
    upper = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    kept = F.least(F.col("n_item"), 2 * (upper - share(upper, threshold)) + 1).cast("int")
    items = items.withColumn("kept", kept).withColumn("need", share(F.col("n_item"), threshold))
    sketch = F.slice(F.array_sort("grams"), F.lit(1), F.col("kept"))
    return items.select("item_id", "n_item", "need",
                        (F.col("kept") - (F.col("n_item") - F.col("need"))).alias("hits_needed"),
                        F.explode_outer(sketch).alias("gram")).where("gram IS NOT NULL")


def small(df: DataFrame) -> DataFrame:
    """Broadcast if its counted rows are few; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contaminated(df: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id",
                 text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every (document, item) where the document holds at least `threshold` of the item's word shingles.

    Returns doc_id, item_id, n_item, n_shared and containment, one row per pair of ids (the highest
    containment if ids repeat). Candidates come from the items' sketches, one row per hit, combined before
    the shuffle; each is then verified on the shingles' texts. A document's shingles meet only sketch values, so
    a passage that many documents share costs one row each. Null or wordless texts match nothing; an item
    shorter than n words only matches a document of exactly these words. Rows with null ids are kept.
    """
    found = contaminated_texts(df, benchmark, n, threshold, id_col, text_col, item_id_col, item_text_col)
    best = F.max(F.struct("containment", "n_shared", "n_item")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("m.n_item").cast("long").alias("n_item"),
        F.col("m.n_shared").cast("long").alias("n_shared"), F.col("m.containment").alias("containment"))


def contaminated_texts(df: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id",
                       text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """As contaminated, by the hash of the text too: doc_id, text_hash, item_id and the measures."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                     F.xxhash64(F.col(text_col)).alias("text_hash")).where(F.col("text").isNotNull())
    items = benchmark.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text")).where(
        F.col("text").isNotNull()).dropDuplicates()
    items = items.withColumn("item_row", F.xxhash64("text"))
    sketches = cut(item_sketches(items.drop("item_id").withColumnRenamed("item_row", "item_id").dropDuplicates(["item_id"]),
                                 n, threshold)).withColumnRenamed("item_id", "item_row")
    rows = with_hashes(docs, n).withColumn("n_doc", F.size("grams")).select(
        "doc_id", "text_hash", "n_doc", F.explode_outer("grams").alias("gram"))
    hits = rows.join(small(sketches), "gram").where("n_doc >= need")
    found = hits.groupBy("doc_id", "text_hash", "item_row").agg(
        F.count(F.lit(1)).alias("hits"), F.first("hits_needed").alias("hits_needed"), F.first("n_item").alias("n_item"))
    # repeated rows of a document hit as often as they occur; the bound only asks for more
    candidates = cut(found.where("hits >= hits_needed").select("doc_id", "text_hash", "item_row"))
    item_words = items.dropDuplicates(["item_row"]).select("item_row", words(F.col("text")).alias("w")).select(
        "item_row", shingle_texts(F.col("w"), n).alias("item_grams"))
    candidates = candidates.withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    pairs = docs.join(small(candidates), F.col("doc_id").eqNullSafe(F.col("found_id"))
                      & (F.col("text_hash") == F.col("found_hash"))).select("doc_id", "text", "text_hash", "item_row")
    exact = pairs.withColumn("w", words(F.col("text"))).withColumn("doc_grams", shingle_texts(F.col("w"), n)).join(
        small(cut(item_words)), "item_row")
    counted = exact.select("doc_id", "text_hash", "item_row", F.size("item_grams").alias("n_item"),
                           F.size(F.array_intersect("doc_grams", "item_grams")).alias("n_shared"))
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("m")
    ids = small(items.select("item_row", "item_id"))
    # grouping keeps the filter from being evaluated together with the arrays a second time
    return counted.join(ids, "item_row").groupBy("doc_id", "text_hash", "item_id").agg(best).where(
        F.col("m.n_shared") >= share(F.col("m.n_item"), threshold)).select("doc_id", "text_hash", "item_id", "m.*")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of `df` whose text holds no benchmark item. Null texts stay; other columns are kept."""
    bad = cut(contaminated_texts(df, benchmark, n, threshold).select(
        F.col("doc_id").alias("townloom_id"), F.col("text_hash").alias("townloom_hash")).distinct())
    return df.join(small(bad), F.col("doc_id").eqNullSafe(F.col("townloom_id"))
                   & (F.xxhash64("text") == F.col("townloom_hash")), "left_anti")
