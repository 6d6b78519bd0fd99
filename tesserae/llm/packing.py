"""Packing documents into fixed-size training sequences by cutting-stock column generation.

1. Every document becomes tokens with an end id. Full sequences are cut off its front, so one piece shorter than
   the capacity remains; pieces, their checksums and lengths come from a single pass over the texts.
2. The lengths of the short pieces form a histogram over size classes (capacity / granularity of them at most),
   the only thing that reaches the driver.
3. A linear program over packing patterns covers the histogram with as few sequences as possible. Its columns
   are generated: an unbounded knapsack, solved by dynamic programming over the dual prices, finds the pattern
   with the best reduced cost until none improves. Pattern counts are rounded down and the small rest is packed
   best-fit decreasing over the classes.
4. Pieces are ranked within their class: by partition, and in a partition by their order. Rank intervals of a class
   belong to patterns, so a piece finds its sequence by its rank alone, and offsets are running sums within a
   sequence.

The pass over the texts numbers the pieces of each class within its partition and writes the numbers to the
checkpoint with them. What is summed up afterwards is one count for each class and partition; no class, however
common its length, is ordered anywhere, and no task's work grows with the number of documents.

Defined cases: a null or empty text is the end id alone; a null id is kept; repeated rows are packed each; pieces of
equal length rank by their place in the input, and in a sequence the longer piece stands first, then the smaller id,
start and checksum; extra columns are ignored; an empty table gives an empty result; texts of any length are tokenised
whole. A pre-tokenised piece for which the model gives no id is an error, never silently dropped.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import checkpointed, map_batches, only
from tesserae.llm.token_count import Cutter

#: Words whose ids a worker remembers at most.
REMEMBERED = 500_000
ODD_SPACE = re.compile("[\x1c-\x1f]")


class PieceIds(dict):
    """Pre-tokenised piece -> its ids as little-endian unsigned 32-bit integers, by the library's model."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()
        if not ids:
            raise ValueError(f"the model gives no id for {piece!r}")
        self[piece] = ids
        return ids


class WordIds(dict):
    """Word without white space -> its ids, by the tokenizers library."""

    def __init__(self, path: str):
        self.cutter = Cutter(path)
        self.tokenizer = self.cutter.tokenizer
        self.of_piece = PieceIds(self.tokenizer.model)
        self.hints = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids = b"".join(map(self.of_piece.__getitem__, self.cutter.pieces(word)))
        return ids

    def ids(self, text: str) -> bytes:
        """Words are encoded alone where white space parts them for certain: no added token's text, no odd space."""
        if ODD_SPACE.search(text) or any(h in text for h in self.hints):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut_pieces(
    docs: DataFrame, path: str, end_id: int, capacity: int, granularity: int, doc_id: str, text: str
) -> DataFrame:
    """Pieces of every document, whole sequences first, then what remains; class (0: a whole sequence), partition and
    number among the partition's pieces of that class."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "at")

    def run(batches):
        from pyspark import TaskContext

        words, end, part = word_ids(path), array("I", [end_id]).tobytes(), TaskContext.get().partitionId()
        counts = [0] * (capacity // granularity + 1)
        for b in batches:
            rows = []
            for key, t in zip(b[doc_id], b[text], strict=True):
                ids = words.ids(t or "") + end
                for begin in range(0, len(ids), 4 * capacity):
                    held = ids[begin : begin + 4 * capacity]
                    n = len(held) // 4
                    c = -(-n // granularity) if n < capacity else 0
                    rows.append((key, begin // 4, n, zlib.crc32(held), len(ids) // 4, c, part, counts[c]))
                    counts[c] += 1
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int, part int, at bigint"
    return map_batches(only(docs, doc_id, text), run, schema)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of sizes 1..len(prices) within capacity, each as often as wanted, and how often each is taken."""
    m = len(prices)
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        n = min(c, m)
        value = best[c - 1 :: -1][:n] + prices[:n]
        k = int(value.argmax())
        if value[k] > best[c - 1] + 1e-12:
            best[c], last[c] = value[k], k + 1
        else:
            best[c] = best[c - 1]
    taken, c = np.zeros(m, dtype=np.int64), capacity
    while c > 0:
        if last[c]:
            taken[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), taken


def solve_patterns(demand: np.ndarray, max_rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: patterns (columns) and fractional counts that cover ``demand[i]`` pieces of size i + 1.

    The capacity is len(demand). Revised simplex over the classes in use; the first basis holds one pattern of a
    single size for each of them.
    """
    capacity = len(demand)
    used = np.flatnonzero(demand)
    m = len(used)
    basis = np.zeros((m, m))
    np.fill_diagonal(basis, capacity // (used + 1))
    inverse = np.diag(1 / np.diag(basis)) if m else np.zeros((0, 0))
    x = inverse @ demand[used]
    for _ in range(max_rounds if m else 0):
        duals = inverse.sum(axis=0)
        prices = np.zeros(capacity)
        prices[used] = np.maximum(duals, 0)
        value, taken = knapsack(prices, capacity)
        if value <= 1 + 1e-9:
            break
        column = taken[used].astype(float)
        direction = inverse @ column
        ratios = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        if not np.isfinite(step):
            break
        x = np.maximum(x - step * direction, 0)
        x[out] = step
        basis[:, out] = column
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
    patterns = np.zeros((m, capacity), dtype=np.int64)
    patterns[:, used] = np.rint(basis.T).astype(np.int64)
    return patterns, x


def integer_patterns(demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and whole counts that hold exactly ``demand``: rounded down, the rest best-fit decreasing."""
    capacity = len(demand)
    patterns, x = solve_patterns(demand)
    counts = np.floor(x + 1e-9).astype(np.int64)
    over = counts @ patterns - demand if len(counts) else np.zeros(capacity, dtype=np.int64)
    while (over > 0).any():  # rounding noise only: take back a pattern of a class that is covered twice
        k = int(np.flatnonzero((patterns[:, int(over.argmax())] > 0) & (counts > 0))[0])
        counts[k] -= 1
        over = counts @ patterns - demand
    rest = -over
    bins: list[dict[int, int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for size in range(capacity, 0, -1):
        for _ in range(int(rest[size - 1])):
            k = next((r for r in range(size, capacity + 1) if room[r]), None)
            if k is None:
                bins.append({})
                at, k = len(bins) - 1, capacity
            else:
                at = room[k].pop()
            bins[at][size] = bins[at].get(size, 0) + 1
            room[k - size].append(at)
    extra = np.zeros((len(bins), capacity), dtype=np.int64)
    for i, b in enumerate(bins):
        for size, n in b.items():
            extra[i, size - 1] = n
    both = np.concatenate([patterns, extra])
    n = np.concatenate([counts, np.ones(len(bins), dtype=np.int64)])
    return both[n > 0], n[n > 0]


def slots(patterns: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Class -> (first rank of each pattern, pieces of the class in it, first sequence of the pattern)."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, dtype=np.int64)
    found = {}
    for c in np.flatnonzero(patterns.any(axis=0)) if len(counts) else []:
        k = np.flatnonzero(patterns[:, c])
        each = patterns[k, c]
        begins = np.concatenate([[0], np.cumsum(each * counts[k])[:-1]])
        found[int(c) + 1] = (begins, each, first[k])
    return found


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    capacity: int = 4096,
    granularity: int = 8,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold ``capacity`` tokens at most. Short pieces count as the next multiple of ``granularity`` in the
    linear program; full pieces have a sequence of their own after those.
    """
    if capacity % granularity:
        raise ValueError("granularity must divide capacity")
    pieces = checkpointed(cut_pieces(docs, path, end_id, capacity, granularity, doc_id, text))
    tally = checkpointed(pieces.groupBy("class", "part").agg(F.count("*").alias("n")))
    histogram = {r["class"]: r["n"] for r in tally.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    demand = np.asarray([histogram.get(c + 1, 0) for c in range(capacity // granularity)], dtype=np.int64)
    patterns, counts = integer_patterns(demand)
    plan, short = slots(patterns, counts), int(counts.sum())

    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = tally.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    ranked = pieces.join(begin, ["class", "part"]).withColumn("rank", F.col("begin") + F.col("at"))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    kind = docs.schema[doc_id].dataType.simpleString()

    def place(batches):
        for b in batches:
            kinds, ranks = np.asarray(b["class"], dtype=np.int64), np.asarray(b["rank"], dtype=np.int64)
            where = short + ranks
            for c in np.unique(kinds[kinds > 0]):
                mine = np.flatnonzero(kinds == c)
                begins, each, first = plan[int(c)]
                k = np.searchsorted(begins, ranks[mine], side="right") - 1
                where[mine] = first[k] + (ranks[mine] - begins[k]) // each[k]
            yield {n: b[n] for n in names} | {"sequence_id": where}

    placed = map_batches(
        ranked.select(*names, "class", "rank"),
        place,
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint",
        batch_rows=10_000,
    )
    in_order = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "ids_crc32")
    return placed.withColumn(
        "offset", F.sum("length").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    )
