"""Ranked retrieval: BM25, cosine, fusion and reranking, for many queries at once.

A search takes a table of queries (query_id and terms or a vector) against all rows. Ranks are row_number by rounded
score and key, so that equal scores have one order; `rank <= k` after a window is pushed down by Spark to a partial
top-k in every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60
DIGITS = 6
#: Query sides up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 10_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def top_k(scored: DataFrame, k: int, query: str, key: str, score: str = "score") -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, key: str, idf: str = "constant", stats: DataFrame | None = None) -> DataFrame:
    """query_id, key, score. docs: key and tokens; queries: query_id and terms (repeated terms add).

    The postings of the queries' own terms only are built: tokens are joined to the distinct query terms before
    counting. idf 'constant' is ln((N + 1) / 2) for every term; 'robertson' uses document frequencies. stats: n_docs and avg_len, where docs are a part of all.
    """
    if stats is None:
        stats = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avg_len"))
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    terms = asked.select("term").distinct()
    postings = docs.select(key, F.size("tokens").alias("len"), F.explode("tokens").alias("term")).join(small(terms), "term").groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    if idf == "robertson":
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
        asked = asked.join(df, "term")
        weight = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    else:
        weight = F.log((F.col("n_docs") + 1) / 2)
    part = F.col("times") * weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = postings.join(small(asked), "term").crossJoin(F.broadcast(stats)).groupBy("query_id", key).agg(F.round(F.sum(part), DIGITS).alias("score"))
    return scored.where("score > 0")


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def vector_scores(items: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """query_id, key, score of a stated query set against all rows (not a join within a table)."""
    return items.crossJoin(small(queries)).select("query_id", key, F.round(cosine(F.col("embedding"), F.col("query_vector")), DIGITS).alias("score"), *[c for c in items.columns if c not in (key, "embedding")])


def rrf(lists: DataFrame, query: str, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists (query, key, rank): one aggregation instead of an outer join."""
    return lists.groupBy(query, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.count("*").alias("n_lists"))


def weighted_fusion(lists: DataFrame, query: str, key: str, weights: dict[str, float]) -> DataFrame:
    """Min-max scores within a query's list, summed by weight; a list without range keeps its raw scores."""
    w = Window.partitionBy(query, "list")
    low, high = F.min("score").over(w), F.max("score").over(w)
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    scaled = lists.withColumn("low", low).withColumn("high", high).withColumn("scaled", F.when(F.col("high") == F.col("low"), F.col("score")).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))))
    return scaled.groupBy(query, key).agg(F.round(F.sum(F.col("scaled") * F.element_at(weight, F.col("list"))), DIGITS).alias("score"))


def lexical_score(query: Column, text: Column) -> Column:
    """Distinct query terms contained, by their number; twice that if the whole query is contained."""
    terms = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != ""))
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t)))
    return F.round(F.try_divide(hits * F.when(F.contains(F.lower(text), F.lower(F.trim(query))), 2).otherwise(1), F.size(terms)), 4)


def combine(original: Column, rerank: Column, method: str = "weighted") -> Column:
    """weighted (0.3 and 0.7), multiply, rrf, or else the rerank score alone."""
    if method == "weighted":
        return 0.3 * original + 0.7 * rerank
    if method == "multiply":
        return original * rerank
    if method == "rrf":
        return F.try_divide(F.lit(1.0), RRF_K + F.try_divide(F.lit(1.0), original)) + F.try_divide(F.lit(1.0), RRF_K + F.try_divide(F.lit(1.0), rerank))
    return rerank
