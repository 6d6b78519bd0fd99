"""Near-duplicate groups by MinHash bands and sequential Bayesian verification.

1. One pass over the texts hashes every document's set of word shingles and keeps its size, a digest of the set, a
   MinHash signature of a byte for each hash function, and the keys of the signature's bands. Copies (equal digests)
   become one node, so a group of copies costs one row from here on.
2. Nodes that share a band key are candidates. A bucket is first read as a star around its smallest node, which is
   linear in its size. Signatures of a candidate pair are compared in batches; after each, a pair is dropped if the
   posterior probability of a similarity at or above the threshold, given the matches so far, is under the chosen
   miss probability. Each node's best survivor is verified on the full sets of both texts.
3. Verified links give components. In buckets that hold more than one component, every pair of nodes from different
   components is compared in the same way, so no candidate is left out; nodes of a bucket's largest component are
   never compared with each other, and a pair is looked at in the first band it shares. Large buckets are dealt out as
   blocks of bounded size. Survivors are verified on the full sets, best matches first; pairs whose components a block
   has joined by then need no test, and only links that join components leave the block, not pairs.
4. Components come from repeated hooking to the smallest neighbour and pointer jumping, on checkpointed tables.

A pair at the threshold shares no band with probability (1 - t^rows)^bands, 5e-6 by default, and is dropped by the
Bayesian test with about the miss probability; no other link is lost, and none is made without the exact check.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; a text with
fewer words than a shingle is one shingle; repeated rows are linked as copies; rows that share an id are one node of
the graph; a null id is in no component (null, not kept); extra columns are ignored; an empty table gives an empty
result; texts are read whole. Ids must be whole numbers (they cast to bigint). Of partners with equally many matching bytes
the smaller id is verified first. Sets are of 64-bit hashes of shingles: two different shingles of a pair of documents
have equal hashes with a probability of about 1e-13 for sets of a thousand.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import checkpointed, map_batches, only

#: Bands and hash functions in each.
BANDS, ROWS = 32, 4
#: Signature positions compared before each posterior test.
BATCH = 32
#: Posterior probability under which a pair is dropped.
MISS = 1e-5
#: Nodes of a bucket that meet as one block.
BLOCK = 256
REMEMBERED = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``width`` words, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(words) < width:
        total = np.uint64(len(words))
        with np.errstate(over="ignore"):
            for x in h:
                total = total * MIX + x
        return mixed(np.asarray([total], dtype=np.uint64))
    total = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for k in range(width):
        total = total * MIX + h[k : len(h) - width + 1 + k]
    return np.unique(mixed(total))


@lru_cache(maxsize=2)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n hash functions."""
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhash(h: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    a, b = permutations(n)
    best = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 1024):
        best = np.minimum(best, (h[at : at + 1024, None] * a + b).min(axis=0))
    return best


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, the band's number mixed in."""
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        total = mixed(total * MIX + signature[k::ROWS])
    return total.view(np.int64)


def hashed(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, n_shingles, digest, signature and band keys of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        words = WordHashes()
        for b in batches:
            out = {"doc_id": b[doc_id], "n_shingles": [], "digest": [], "signature": [], "bands": []}
            for t in b[text]:
                h = shingles(t, words, width)
                s = minhash(h) if len(h) else None
                out["n_shingles"].append(len(h))
                out["digest"].append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                out["signature"].append(mixed(s).astype(np.uint8).tobytes() if len(h) else None)
                out["bands"].append(band_keys(s) if len(h) else None)
            yield out

    schema = f"doc_id {kind}, n_shingles bigint, digest binary, signature binary, bands array<bigint>"
    return map_batches(only(docs, doc_id, text), run, schema)


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float, n: int = BANDS * ROWS, batch: int = BATCH) -> tuple[int, ...]:
    """After each batch, the fewest matches with which a pair stays: posterior of s >= threshold at least ``miss``.

    Uniform prior on s; bytes of unequal minima match by chance once in 256.
    """
    s = (np.arange(4000) + 0.5) / 4000
    q = np.log(s + (1 - s) / 256), np.log((1 - s) * 255 / 256)
    least = []
    for seen in range(batch, n + 1, batch):
        for m in range(seen + 1):
            logs = m * q[0] + (seen - m) * q[1]
            p = np.exp(logs - logs.max())
            if p[s >= threshold].sum() / p.sum() >= miss:
                break
        least.append(m)
    return tuple(least)


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that no batch drops, and their matches. a, b: pairs, bytes."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int64)
    for k, least in enumerate(least_matches(threshold, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive, matches


def sizes_fit(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be as similar as asked."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def stars(buckets: DataFrame, nodes: DataFrame, percent: int, miss: float) -> DataFrame:
    """a, b: of each node the pair with a bucket's smallest node that matches best, of those that survive."""
    pairs = buckets.where(F.col("id") != F.col("hub")).select("id", "hub").distinct()
    mine = nodes.select("id", F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
    other = nodes.select(F.col("id").alias("hub"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))

    def run(batches):
        for b in batches:
            fit = np.flatnonzero(sizes_fit(np.asarray(b["n_a"]), np.asarray(b["n_b"]), percent))
            if not len(fit):
                continue
            s_a, s_b = (np.frombuffer(b"".join(b[k][i] for i in fit), np.uint8).reshape(len(fit), -1) for k in ("s_a", "s_b"))
            alive, matches = surviving(s_a, s_b, percent / 100, miss)
            yield {"a": [b["id"][i] for i in fit[alive]], "b": [b["hub"][i] for i in fit[alive]], "matches": matches}

    found = map_batches(
        pairs.join(mine, "id").join(other, "hub").select("id", "hub", "n_a", "n_b", "s_a", "s_b"),
        run,
        "a bigint, b bigint, matches bigint",
        batch_rows=5000,
    )
    best = found.groupBy("a").agg(F.max(F.struct("matches", (-F.col("b")).alias("less"))).alias("best"))
    return best.select("a", (-F.col("best.less")).alias("b"))


def candidates(group: list[tuple], percent: int, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surviving pairs of a block (positions, and matches): minor nodes against all others of another component.

    A row: band, id, component, n, signature, minor, keys of all bands. A pair is looked at in the first band that it
    shares only; bands are shared by key, as equal signature bytes need not mean equal minima.
    """
    part = np.asarray([g[2] for g in group], dtype=np.int64)
    n = np.asarray([g[3] for g in group], dtype=np.int64)
    minor = np.asarray([g[5] for g in group], dtype=bool)
    a, b = np.flatnonzero(minor), np.flatnonzero(~minor)
    x, y = np.repeat(a, len(b)), np.tile(b, len(a))
    ok = (part[x] != part[y]) & sizes_fit(n[x], n[y], percent)
    x, y = x[ok], y[ok]
    if not len(x):
        return x, y, x
    s = np.frombuffer(b"".join(g[4] for g in group), np.uint8).reshape(len(group), -1)
    band = np.asarray([g[0] for g in group], dtype=np.int64)
    keys = np.asarray([g[6] for g in group], dtype=np.int64)
    out = []
    for at in range(0, len(x), 50_000):
        u, v = x[at : at + 50_000], y[at : at + 50_000]
        same = keys[u] == keys[v]
        mine = same.any(axis=1) & (same.argmax(axis=1) == band[u]) & (band[u] == band[v])
        u, v = u[mine], v[mine]
        alive, matches = surviving(s[u], s[v], percent / 100, miss)
        out.append((u[alive], v[alive], matches))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def linked_once(group: list[tuple], percent: int, miss: float, sets: Callable[[str], np.ndarray]) -> list[tuple[int, int]]:
    """Exact links between components of a block, best matches first; what a link has joined is not tested again.

    A row is one of ``candidates`` and the text.
    """
    x, y, matches = candidates(group, percent, miss)
    root = {g[2]: g[2] for g in group}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    known: dict[int, np.ndarray] = {}
    links = []
    for k in np.argsort(-matches, kind="stable"):
        i, j = int(x[k]), int(y[k])
        c, d = find(group[i][2]), find(group[j][2])
        if c == d:
            continue
        for e in (i, j):
            if e not in known:
                known[e] = sets(group[e][7])
        if similar(known[i], known[j], percent):
            root[max(c, d)] = min(c, d)
            links.append((group[i][1], group[j][1]))
    return links


def across(buckets: DataFrame, nodes: DataFrame, component: DataFrame, texts: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """a, b: exact links between nodes that share a bucket and lie in different components, enough to join them.

    ``component``: id, component of the nodes that have a link; others are their own component. ``texts``: id, text.
    Signatures meet first; the texts of the nodes that have a surviving partner are then sent to the same blocks.
    """
    members = (
        buckets.select("key", "band", "id")
        .join(component, "id", "left")
        .select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    )
    by_part = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    open_ = (
        by_part.groupBy("key")
        .agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"))
        .where(F.col("parts") > 1)
        .select(
            "key",
            F.col("top.component").alias("major"),
            F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("minor_blocks"),
        )
    )
    rows = members.join(open_, "key").join(nodes.select("id", "n", "signature", "bands"), "id")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.col(n)).cast("int")
    kept = ["key", "band", "id", "component", "n", "signature", "bands"]
    right = rows.select(*kept, F.lit(False).alias("minor"), F.explode(numbers("minor_blocks")).alias("i"), block("blocks").alias("j"))
    left = rows.where(F.col("component") != F.col("major")).select(
        *kept, F.lit(True).alias("minor"), block("minor_blocks").alias("i"), F.explode(numbers("blocks")).alias("j")
    )
    place = ["key", "i", "j"]
    held = ["band", "id", "component", "n", "signature", "minor", "bands"]
    dealt = left.unionByName(right).repartition(*place).sortWithinPartitions(*place, "minor", "id")

    def groups(batches, names):
        """(place, rows) of each block, in order."""
        now, group = None, []
        for b in batches:
            for where, row in zip(zip(*(b[k] for k in place), strict=True), zip(*(b[k] for k in names), strict=True), strict=True):
                if where != now:
                    if len(group) > 1:
                        yield now, group
                    now, group = where, []
                if not group or row != group[-1]:  # a repeated row of one id comes right after the first
                    group.append(row)
        if len(group) > 1:
            yield now, group

    def meet(batches):
        out: dict[str, list] = {k: [] for k in (*place, *held)}
        for where, group in groups(batches, held):
            x, y, _ = candidates(group, percent, miss)
            for at in np.unique(np.concatenate([x, y])):
                for k, v in zip(out, (*where, *group[at]), strict=True):
                    out[k].append(v)
            if len(out["key"]) > 2000:
                yield out
                out = {k: [] for k in out}
        yield out

    kinds = "key bigint, i int, j int, band int, id bigint, component bigint, n bigint, signature binary, minor boolean, bands array<bigint>"
    involved = map_batches(dealt.select(*place, *held), meet, kinds, batch_rows=5000)
    whole = involved.join(texts, "id").repartition(*place).sortWithinPartitions(*place, "minor", "id")

    def confirm(batches):
        words = WordHashes()
        for _, group in groups(batches, (*held, "text")):
            if links := linked_once(group, percent, miss, lambda t: shingles(t, words, width)):
                yield {"a": [a for a, _ in links], "b": [b for _, b in links]}

    return map_batches(whole.select(*place, *held, "text"), confirm, "a bigint, b bigint", batch_rows=200)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The exact condition on two sets of shingle hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b, linked: the exact test on the full sets of both texts (id, text)."""
    met = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("t_a")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("t_b")), "b")
        .select("a", "b", "t_a", "t_b")
    )

    def run(batches):
        words = WordHashes()
        known: dict[str, np.ndarray] = {}
        for b in batches:
            linked = []
            for t_a, t_b in zip(b["t_a"], b["t_b"], strict=True):
                if t_b not in known:  # pairs of one smallest node come one after another
                    known = {t_b: shingles(t_b, words, width)}
                y = known[t_b]
                linked.append(similar(shingles(t_a, words, width), y, percent))
            yield {"a": b["a"], "b": b["b"], "linked": linked}

    return map_batches(met, run, "a bigint, b bigint, linked boolean", batch_rows=200)


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every node in ``links`` (a, b)."""
    ends = links.select("a", "b").where(F.col("a") != F.col("b"))
    edges = checkpointed(ends.union(ends.select("b", "a")).distinct())
    found = None  # id, component over the rounds so far
    while True:
        parent = checkpointed(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")))
        while True:  # pointers go to smaller ids only, so they form trees
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("g"))
            parent = checkpointed(parent.join(up, "p", "left").select("a", F.coalesce("g", "p").alias("p"), (F.coalesce("g", "p") != F.col("p")).alias("moved")))
            if parent.where("moved").isEmpty():
                break
            parent = parent.select("a", "p")
        step = parent.select(F.col("a").alias("component"), F.col("p").alias("next"))
        if found is None:
            found = step.select(F.col("component").alias("id"), F.col("next").alias("component"))
        else:
            found = checkpointed(
                found.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
            )
        root = parent.select("a", "p")
        edges = checkpointed(
            edges.join(root, "a")
            .select(F.col("p").alias("u"), "b")
            .join(root.select(F.col("a").alias("b"), F.col("p").alias("v")), "b")
            .where(F.col("u") != F.col("v"))
            .select(F.col("u").alias("a"), F.col("v").alias("b"))
            .distinct()
        )
        if edges.isEmpty():
            return found


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, miss: float = MISS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the component's smallest id) for every row."""
    rows = checkpointed(hashed(docs, doc_id, text, width))
    ids = F.col("doc_id").cast("bigint")
    nodes = checkpointed(
        rows.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("digest")
        .agg(F.min(F.struct(ids.alias("id"), F.col("n_shingles").alias("n"), "signature", "bands")).alias("x"))
        .select("digest", "x.*")
    )
    texts = docs.select(docs[doc_id].cast("bigint").alias("id"), docs[text].alias("text"))
    keys = nodes.select("id", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where(F.col("n") > 1)
    buckets = checkpointed(keys.join(shared.select("key", "hub"), "key"))
    first = verified(stars(buckets, nodes, percent, miss), texts, width, percent)
    links = checkpointed(first.where("linked").select("a", "b"))
    component = components(links)
    more = checkpointed(across(buckets, nodes, component, texts, width, percent, miss))
    if not more.isEmpty():
        component = components(links.union(more))
    of_set = (
        nodes.select("digest", "id")
        .join(component, "id", "left")
        .select("digest", F.coalesce("component", "id").alias("component_id"))
    )
    return (
        rows.select("doc_id", "n_shingles", "digest")
        .join(of_set, "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", ids).alias("component_id"))
        .withColumn("kept", F.coalesce(ids == F.col("component_id"), F.lit(False)))
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **named) -> DataFrame:
    """The rows of the documents that stay, with all their columns: of each component one, the smallest id first.

    Rows are judged, not ids. Rows whose id is null or repeated are known by a 64-bit hash of their text, so each text
    is a document of its own; of rows with equal id and text one stays. Rows without shingles have no copies: all with
    a null id stay, and one of each id and text.
    """
    of_text = F.xxhash64(F.coalesce(F.col("_text"), F.lit("")))
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs[doc_id].alias("_id"), docs[text].alias("_text"))
    counts = docs.groupBy(docs[doc_id].alias("_id")).agg(F.count("*").alias("rows"))
    odd = checkpointed(counts.where(F.col("_id").isNull() | (F.col("rows") > 1)).select("_id"))
    if odd.isEmpty():  # every row has an id of its own
        kept = near_duplicates(docs, doc_id, text, **named).where("kept").select(F.col("doc_id").alias(doc_id))
        return docs.join(kept, doc_id, "left_semi").select(*docs.columns)
    repeated = odd.where(F.col("_id").isNotNull())
    own = whole.where(F.col("_id").isNotNull()).join(repeated, "_id", "left_anti").withColumn("_key", F.col("_id").cast("bigint"))
    shared = whole.where(F.col("_id").isNull()).unionByName(whole.join(repeated, "_id", "left_semi")).withColumn("_key", of_text)
    texts = own.select("_key", "_text").unionByName(shared.select("_key", "_text").dropDuplicates(["_key"]))
    judged = checkpointed(near_duplicates(texts, "_key", "_text", **named).select(F.col("doc_id").alias("_key"), "n_shingles", "component_id"))
    ids = own.select("_id", "_key").unionByName(shared.select("_id", "_key").distinct()).join(judged, "_key")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key")).alias("first")
    linked = ids.where("n_shingles > 0").groupBy("component_id").agg(first).select("first._id", "first._key", F.lit(False).alias("bare"))
    stay = checkpointed(linked.unionByName(ids.where("n_shingles = 0").select("_id", "_key", F.lit(True).alias("bare"))))

    def staying(rows: DataFrame) -> DataFrame:
        at = stay.select(F.col("_id").alias("id"), F.col("_key").alias("key"), "bare")
        return rows.join(at, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("id")))

    several = staying(shared)
    bare = F.col("bare") & F.col("_id").isNull()
    one = several.where(~bare).groupBy("_id", "_key").agg(F.min("_row").alias("_row"))
    return staying(own).select("_row.*").unionByName(several.where(bare).select("_row.*")).unionByName(one.select("_row.*"))


def oracle(width: int = 5, percent: int = 75) -> str:
    """DuckDB SQL over ``documents``: exact similarity of all pairs that share a shingle, and what is reachable."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {width - 2}), lambda i: array_to_string(words[i:i + {width - 1}], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.both >= {percent} * (x.n + y.n - p.both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
