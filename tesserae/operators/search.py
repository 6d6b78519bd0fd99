"""Text search over objects: mean embeddings, ranking, and labels with a fallback to similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.vec import dot, norm, vector_sum
from tesserae.functions.plan import small_side


def object_embeddings(masks: DataFrame, by: str = "id", vector: str = "embedding") -> DataFrame:
    """Unit mean embedding of the masks of each object with id >= 0."""
    total = vector_sum(masks.where(F.col(by) >= 0), [by], vector)
    length = F.greatest(norm(F.col("total")), F.lit(1e-6))
    return total.select(by, F.transform("total", lambda x: x / length).alias("embedding"))


#: Queries that are sent to every task, and queries in a block beyond that.
FEW, BLOCK = 10_000, 4096


def met(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """Every query beside every object: a stated query set against all rows.

    Few queries are broadcast. More are dealt to blocks by hash; objects are copied once for each block, not for each
    query, and both sides meet by the block's number.
    """
    n = queries.count()
    if n <= FEW:
        return small_side(queries, FEW).join(objects)
    blocks = -(-n // BLOCK)
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    copies = objects.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.join(copies, "_block").drop("_block")


def rank(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """query, id, score, rank: every object for every query by cosine, ties to the smaller id.

    queries: query, q. objects: id, embedding.
    """
    score = met(queries, objects).select("query", "id", dot(F.col("q"), F.col("embedding")).alias("score"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return score.withColumn("rank", F.row_number().over(order))


def of_type(ranked: DataFrame, labels: DataFrame, text: DataFrame, top: int) -> DataFrame:
    """query, id, rank: the objects whose label is the query's text exactly, or else the best ``top``."""
    named = ranked.join(labels, "id").join(small_side(text, 10_000), "query")
    hit = F.col("label") == F.lower(F.trim(F.col("text")))
    known = named.withColumn("_known", F.max(hit).over(Window.partitionBy("query")))
    return known.where(F.when(F.col("_known"), hit).otherwise(F.col("rank") <= top)).select("query", "id", "rank")
