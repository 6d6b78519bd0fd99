"""Exact top-k search by inner product with no-random-access aggregation over sorted lists.

Candidates lie in blocks of bounded size; in a block every dimension has its values in sorted order, read
from the top for queries whose component is positive and from the bottom where it is negative. Reading goes on in
steps, each over half of what is left of the lists. What has been read gives each candidate a lower bound (unread
components at their worst) and an upper bound (unread components at the value the reading stands at). A candidate whose
upper bound is under the k-th best lower bound of a query, or under the k-th best score that earlier blocks gave it, is
an outsider of that query and leaves. Each query stops by itself, as soon as no outsider can qualify: no more than k
candidates are left, or none. Only then the final scores of those that are left are resolved. A query that never gets
there reads the lists to their end, where both bounds are the score.

While most candidates of a block of queries are left, bounds are matrix products over values clamped at the reading's
thresholds; later each query goes on alone over the candidates it has left. The k best of each block meet in a top-k
by query.

Every query block meets every candidate block once: a stated query set against all rows, in blocks. Query blocks
are copied to the candidate blocks by number; no row pair is ever a Spark row. Blocks hold a number of components, not
of rows, so a candidate block is as large as a task's memory allows whatever the dimension, and copies are few.

Components become floor(scale * x), held in the range of long. Bounds are exact where all products stay below 2^53 in
sum; beyond, they are widened by more than their rounding error, and final scores are sums of whole numbers of any
size. A score outside the range of long is given as the nearest long, and order still goes by the exact score. Ties go
to the smaller id.

Defined cases: null vectors and vectors with null or non-finite components take no part; vectors with another
number of components than a query's are no candidates of it; repeated rows are candidates each; a query whose own
id appears on several rows is asked once, with the smallest vector, and leaves out all rows of that id; rows with a
null id take no part; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import checkpointed, map_batches, only

#: Components in a candidate block and in a query block at most.
BLOCK_VALUES, QUERY_VALUES = 1 << 21, 1 << 17
#: Rows of a block at least, where the table has as many.
LEAST_ROWS = 2048
#: Queries whose bounds are held at once.
AT_ONCE = 256
#: Share of the block's candidates under which a query goes on alone.
ALONE = 0.25
#: Best scores so far that a task remembers, over all its query blocks.
REMEMBERED = 1 << 22
EXACT, LONG = 2**53, 2**63


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """id, dim and the vector of floor(scale * x), without vectors that take no part."""
    v = F.col("v")
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LONG - 1024))), F.lit(-float(LONG)))).cast("bigint")
    return (
        vectors.select(vectors[vec_id].alias("id"), vectors[embedding].cast("array<double>").alias("v"))
        .where(ok & (F.size(v) > 0) & F.col("id").isNotNull())
        .select("id", F.size(v).alias("dim"), F.transform(v, held).alias("v"))
    )


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in four bytes each if all fit, else in eight."""
    small = not values.size or max(int(values.max()), -int(values.min())) < 2**31
    return values.astype("<i4" if small else "<i8").tobytes()


def in_blocks(rows: DataFrame, values: int, name: str) -> DataFrame:
    """Rows packed within their partition: name (partition and number in it), dim, ids, matrix."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[int, list] = {}
        n = 0

        def out(dim):
            nonlocal n
            ids, m = zip(*held.pop(dim), strict=True)
            n += 1
            return {
                name: [(part << 32) + n],
                "dim": [dim],
                "ids": [np.asarray(ids, dtype="<i8").tobytes()],
                "matrix": [packed(np.asarray(m, dtype="<i8"))],
            }

        for b in batches:
            for key, dim, v in zip(b["id"], b["dim"], b["v"], strict=True):
                held.setdefault(dim, []).append((key, v))
                if (len(held[dim]) + 1) * dim > values:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return map_batches(rows, run, f"{name} bigint, dim int, ids binary, matrix binary", batch_rows=500)


class SortedLists:
    """A candidate block with its dimensions in sorted order. ``read``: of each query asked, the share of lists read."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[order], x[order]
        self.x = self.whole.astype(np.float64)
        self.lists = np.sort(self.x, axis=0)
        self.largest = float(np.abs(self.x).max(initial=0.0))
        self.read: list[float] = []

    def depths(self) -> Iterator[int]:
        """How far the lists are read after each step: half of what is left, and to the end at last."""
        n, left = len(self.ids), len(self.ids)
        while left > 1:
            left //= 2
            yield n - left
        yield n

    def bounds(self, queries: np.ndarray, rows: np.ndarray | slice, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of ``rows`` for every query after ``depth`` entries of each list."""
        n = len(self.ids)
        x = self.x[rows]
        if depth >= n:
            score = queries @ x.T
            return score, score
        high, low = self.lists[n - depth], self.lists[depth - 1]
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        upper = up @ np.maximum(x, high).T + down @ np.minimum(x, low).T
        lower = up @ np.where(x >= high, x, self.lists[0]).T + down @ np.where(x <= low, x, self.lists[-1]).T
        return lower, upper

    def final(self, query: np.ndarray, rows: np.ndarray, exact: bool) -> list[int]:
        """Scores of rows as whole numbers. ``exact``: doubles hold them."""
        if exact:
            return (self.x[rows] @ query.astype(np.float64)).astype(np.int64).tolist()
        q = query.tolist()
        return [sum(map(int.__mul__, q, r)) for r in self.whole[rows].tolist()]

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None
    ) -> list[tuple[np.ndarray, list[int]]]:
        """Per query: positions of its k best in the block, best first, and their scores.

        ``floors``: what a score must reach to matter. Rows with a query's own id are left out.
        """
        n, m = len(self.ids), len(queries)
        q = queries.astype(np.float64)
        weight = np.abs(q).sum(axis=1) * self.largest  # no partial sum of a query is larger
        exact = weight < EXACT
        slack = np.where(exact, 0.0, weight * 2.0**-40)
        floors = np.full(m, -np.inf) if floors is None else floors
        alive = query_ids[:, None] != self.ids[None, :]
        left = alive.sum(axis=1)
        depth_of = np.zeros(m, dtype=np.int64)
        together = np.arange(m)
        for depth in self.depths():
            together = together[(left[together] > k) & (left[together] > ALONE * n)]
            if not len(together):
                break
            lower, upper = self.bounds(q[together], slice(None), depth)
            lower = np.where(alive[together], lower, -np.inf) - slack[together, None]
            upper += slack[together, None]
            least = np.maximum(np.partition(lower, n - k, axis=1)[:, n - k] if n > k else -np.inf, floors[together])
            alive[together] &= upper >= least[:, None]
            left[together] = alive[together].sum(axis=1)
            depth_of[together] = depth
        out = []
        for i in range(m):
            rows = np.flatnonzero(alive[i])
            for depth in self.depths():
                if len(rows) <= k:
                    break
                if depth <= depth_of[i]:
                    continue
                lower, upper = (b[0] for b in self.bounds(q[i : i + 1], rows, depth))
                least = max(np.partition(lower, len(rows) - k)[len(rows) - k] - slack[i], floors[i])
                rows = rows[upper + slack[i] >= least]
                depth_of[i] = depth
            score = self.final(queries[i], rows, bool(exact[i]))
            best = sorted(range(len(rows)), key=lambda j: (-score[j], j))[:k]  # ids ascend
            out.append((rows[best], [score[j] for j in best]))
        self.read.extend((depth_of / max(1, n)).tolist())
        return out


class Floors:
    """The k-th best score so far of the queries of each block that a task has met."""

    def __init__(self, k: int):
        self.k, self.held, self.best = k, 0, {}

    def of(self, block: int, m: int) -> np.ndarray:
        return np.asarray([float(s[0]) if len(s) == self.k else -np.inf for s in self.best.get(block, [[]] * m)])

    def add(self, block: int, found: list[tuple[np.ndarray, list[int]]]) -> None:
        if block not in self.best:
            if self.held >= REMEMBERED:
                self.best.clear()
                self.held = 0
            self.best[block] = [[] for _ in found]
            self.held += self.k * len(found)
        for i, (_, score) in enumerate(found):
            self.best[block][i] = sorted(self.best[block][i] + score)[-self.k :]


def beyond(score: int) -> bytes | None:
    """Order among scores outside the range of long: larger scores have larger bytes."""
    return None if -LONG < score < LONG - 1 else (score + (1 << 191)).to_bytes(24, "big")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row with ``is_query``.

    ``is_query`` is a condition on the column ``id``.
    """
    rows = quantised(only(vectors, vec_id, embedding), vec_id, embedding, scale)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("dim").cast("bigint")), F.lit(0)).alias("values")).first()
    threads = vectors.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, math.ceil(total["values"] / BLOCK_VALUES), min(threads, math.ceil(total["n"] / LEAST_ROWS)))
    candidates = checkpointed(in_blocks(rows.repartition(n_blocks), BLOCK_VALUES, "block"))
    asked = rows.where(is_query).groupBy("id", "dim").agg(F.min("v").alias("v"))
    values = asked.agg(F.coalesce(F.sum(F.col("dim").cast("bigint")), F.lit(0)).alias("values")).first()["values"]
    queries = checkpointed(
        in_blocks(asked.repartition(max(1, math.ceil(values / QUERY_VALUES))), QUERY_VALUES, "query_block")
    ).withColumnsRenamed({"ids": "query_ids", "matrix": "query_matrix"})
    numbered = candidates.withColumn("number", F.pmod(F.shiftright("block", 32), F.lit(n_blocks)).cast("int"))
    copies = queries.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    met = numbered.join(copies, ["number", "dim"])

    def matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
        return np.frombuffer(raw, f"<i{len(raw) // (n * dim)}").reshape(n, dim).astype(np.int64)

    def run(batches):
        last, lists, floors = None, None, Floors(k)
        for b in batches:
            for at in range(len(b["block"])):
                dim = b["dim"][at]
                if b["block"][at] != last:
                    last = b["block"][at]
                    ids = np.frombuffer(b["ids"][at], dtype="<i8")
                    lists = SortedLists(ids, matrix(b["matrix"][at], len(ids), dim))
                asked_ids = np.frombuffer(b["query_ids"][at], dtype="<i8")
                q = matrix(b["query_matrix"][at], len(asked_ids), dim)
                name = b["query_block"][at]
                least = floors.of(name, len(asked_ids))
                found = []
                for i in range(0, len(q), AT_ONCE):
                    found += lists.search(asked_ids[i : i + AT_ONCE], q[i : i + AT_ONCE], k, least[i : i + AT_ONCE])
                lists.read.clear()
                floors.add(name, found)
                scores = [s for _, score in found for s in score]
                yield {
                    "query_id": np.repeat(asked_ids, [len(score) for _, score in found]),
                    "vec_id": lists.ids[np.concatenate([rows for rows, _ in found])],
                    "score": [min(max(s, -LONG), LONG - 1) for s in scores],
                    "beyond": [beyond(s) for s in scores],
                }

    found = map_batches(
        met.select("block", "dim", "ids", "matrix", "query_block", "query_ids", "query_matrix"),
        run,
        "query_id bigint, vec_id bigint, score bigint, beyond binary",
        batch_rows=4,
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def oracle(k: int = 20, scale: int = 64, every: int = 20) -> str:
    """DuckDB SQL over ``embeddings``: queries are the rows whose id is divisible by ``every``."""
    return f"""
WITH e AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.id AS query_id, c.id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.id % {every} = 0 AND c.id <> q.id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY rank <= {k}"""
