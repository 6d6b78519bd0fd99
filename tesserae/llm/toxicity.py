"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another. The model of a category is logistic regression over the mean of a
document's word features, and over the probabilities of all earlier categories; for training those come out of
fold, so that a later model sees earlier probabilities as unsure as it will meet them.

A word's features are the hashed word, in lower case without marks around it, and its first characters. As they
are averaged over words, a linear model gives each word a score for each category, which workers remember; a
document's text is read once, whole, and never leaves the executors.

The labels say toxic or not, so the categories are what they and the documents' languages can tell apart: toxic in each
language, commonest first, and toxic at all at the end of the chain.

The models are fitted on the driver on a bounded sample: the ``sample`` labelled documents whose ids hash lowest.
Each sends its features, of which the ``MAX_FEATURES`` that say most about toxicity are kept: with some thousand
documents, more features than that are words that occur once or twice, and the model would learn them by heart.

Defined cases: a null or empty text has no words and gets the chain's probabilities for no evidence, never a toxic
verdict; a document that is labelled twice counts as toxic if either label says so; repeated rows give repeated
results; extra columns are ignored (or kept, by the filter); without labels, or with labels of one kind, nothing is
toxic; a probability at the threshold is toxic; a null id is kept; texts of any length are read whole; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import BATCH_ROWS, map_batches, only

#: Labelled documents that the models are fitted on at most, and features that are kept of them.
SAMPLE, MAX_FEATURES = 5000, 1500
#: Labelled documents that must hold a feature.
MIN_DOCUMENTS = 2
#: Hashed feature space, and words whose scores a worker remembers.
DIMS, REMEMBERED = 1 << 20, 300_000
#: Lengths of a word's first characters that are features.
PREFIXES = (3, 4, 5, 6)
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
FOLDS = 3


def word_features(word: str) -> list[int]:
    w = word.strip(MARKS).lower()
    keys = [w, *("^" + w[:k] for k in PREFIXES if len(w) >= k)] if w else []
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) % DIMS for k in keys]


@dataclass
class Sparse:
    """Rows of feature shares: row pointers, columns, values."""

    begin: np.ndarray
    column: np.ndarray
    value: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))

    def take(self, rows: np.ndarray) -> Sparse:
        length = np.diff(self.begin)[rows]
        begin = np.concatenate([[0], np.cumsum(length)])
        at = np.arange(begin[-1]) + np.repeat(self.begin[rows] - begin[:-1], length)
        return Sparse(begin, self.column[at], self.value[at])


@dataclass
class Linear:
    """Logistic regression over shares (scaled by feature) and dense extra inputs."""

    weight: np.ndarray
    extra: np.ndarray
    bias: float

    def score(self, x: Sparse, extra: np.ndarray) -> np.ndarray:
        n = len(x.begin) - 1
        return np.bincount(x.row, weights=x.value * self.weight[x.column], minlength=n) + extra @ self.extra + self.bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: Sparse, extra: np.ndarray, y: np.ndarray, dims: int, rounds: int = 60, rate: float = 0.05, decay: float = 1e-3) -> Linear:
    """Full-batch Adam from zero, rare classes weighted up by the square root of their odds."""
    n, row = len(y), x.row
    up = np.sqrt(max(1.0, (n - y.sum()) / max(1.0, y.sum())))
    each = np.where(y > 0, up, 1.0)
    each /= each.sum()
    w = np.zeros(dims + extra.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        model = Linear(w[:dims], w[dims:-1], w[-1])
        z = np.bincount(row, weights=x.value * w[x.column], minlength=n) + extra @ model.extra + model.bias
        g = each * (sigmoid(z) - y)
        grad = np.concatenate([np.bincount(x.column, weights=x.value * g[row], minlength=dims), g @ extra, [g.sum()]])
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Linear(w[:dims], w[dims:-1], float(w[-1]))


@dataclass
class Chain:
    """Fitted models in order, over the kept features; ``threshold`` is for the last category."""

    categories: tuple[str, ...]
    features: np.ndarray  # hashed, ascending
    models: list[Linear]
    threshold: float

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        """Of every category from mean word scores, each category's with those before it."""
        out = np.zeros_like(means)
        for j, m in enumerate(self.models):
            out[:, j] = sigmoid(means[:, j] + out[:, :j] @ m.extra + m.bias)
        return out


def fit_chain(x: Sparse, y: np.ndarray, categories: tuple[str, ...], features: np.ndarray, seed: int = 7) -> Chain:
    n, k = y.shape
    fold = np.random.default_rng(seed).permutation(n) % FOLDS
    held, models = np.zeros((n, k)), []
    parts = [(np.flatnonzero(fold != f), np.flatnonzero(fold == f)) for f in range(FOLDS)]
    cut = [(x.take(a), x.take(b), a, b) for a, b in parts]
    for j in range(k):
        for fit_x, own_x, a, b in cut:
            model = fit_linear(fit_x, held[a, :j], y[a, j], len(features))
            held[b, j] = sigmoid(model.score(own_x, held[b, :j]))
        models.append(fit_linear(x, held[:, :j], y[:, j], len(features)))
    return Chain(categories, features, models, best_threshold(held[:, -1], y[:, -1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap with the best out-of-fold F score, in which precision counts double; one half at least."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f = 1.25 * hits / np.maximum(1e-9, np.arange(1, len(p) + 1) + 0.25 * y.sum())
    best = int(f.argmax())
    after = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return float(max((p[order[best]] + after) / 2, 0.5))


def sampled_features(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, toxic: str, sample: int):
    """doc_id, lang, toxic, hashed features and their shares (packed) of the sampled labelled documents."""
    known = labels.where(labels[doc_id].isNotNull() & labels[toxic].isNotNull())
    one_each = known.groupBy(labels[doc_id].alias("_id")).agg(F.max(labels[toxic]).cast("int").alias("toxic"))
    share = min(1.0, 4.0 * sample / max(1, one_each.count()))  # a bound on the hash leaves a few times the sample to sort
    chosen = (
        one_each.where(F.xxhash64("_id") <= int(-(2**63) + share * (2**64 - 2**11)))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    texts = docs.select(docs[doc_id].alias("_id"), docs[text].alias("_text"), docs[lang].cast("string").alias("_lang"))
    joined = texts.join(F.broadcast(chosen), "_id")  # ``sample`` rows of two numbers at most
    joined = (  # a document for each id, however often it is repeated
        joined.groupBy("_id")
        .agg(F.min(F.struct("_text", "_lang")).alias("d"), F.max("toxic").alias("toxic"))
        .select("_id", "d.*", "toxic")
    )

    def run(batches):
        for b in batches:
            out = {"id": b["_id"], "lang": b["_lang"], "toxic": b["toxic"], "features": [], "shares": []}
            for t in b["_text"]:
                words = (t or "").split()
                f = np.asarray([h for w in words for h in word_features(w)], dtype=np.int64)
                keys, n = np.unique(f, return_counts=True)
                out["features"].append(keys.astype("<i4").tobytes())
                out["shares"].append((n / max(1, len(words))).astype("<f4").tobytes())
            yield out

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(joined, run, f"id {kind}, lang string, toxic int, features binary, shares binary")


def train(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", lang="lang", toxic="toxic", sample: int = SAMPLE) -> Chain | None:
    """The chain: toxic in each language that has toxic labels, commonest first, then toxic at all."""
    rows = sampled_features(docs, labels, doc_id, text, lang, toxic, sample).toArrow().to_pandas()
    return fit_rows(rows.sort_values("id", kind="stable", ignore_index=True)) if len(rows) else None


def associated(column: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The features whose presence says most about toxicity (chi-square), ascending."""
    n1, n0 = y.sum(), (1 - y).sum()
    df1, df = np.bincount(column, weights=y[row], minlength=DIMS), np.bincount(column, minlength=DIMS)
    p = np.clip(df / len(y), 1e-9, 1 - 1e-9)
    chi = (df1 / n1 - (df - df1) / n0) ** 2 / (p * (1 - p))
    chi[df < MIN_DOCUMENTS] = 0
    best = np.argsort(-chi, kind="stable")[:MAX_FEATURES]
    return np.sort(best[chi[best] > 0])


def log_ratios(column: np.ndarray, row: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Naive-Bayes log ratio of each feature's share of toxic to its share of other documents, half a document added.

    Features are scaled by it, so that few rounds on a few hundred labels already rest on those that tell.
    """
    df1, df = np.bincount(column, weights=y[row], minlength=n), np.bincount(column, minlength=n)
    return np.log((df1 + 0.5) / (y.sum() + 1)) - np.log((df - df1 + 0.5) / (len(y) - y.sum() + 1))


def fit_rows(rows) -> Chain | None:
    """The chain from a pandas frame of id, lang, toxic, and packed features and shares."""
    toxic = rows["toxic"].to_numpy().astype(float)
    if toxic.min() == toxic.max():
        return None
    langs = rows["lang"][toxic > 0].dropna().value_counts()
    order = sorted(langs.index, key=lambda k: (-langs[k], k))
    y = np.stack([*[(toxic > 0) & (rows["lang"] == k).to_numpy() for k in order], toxic > 0], axis=1).astype(float)
    column = np.frombuffer(b"".join(rows["features"]), dtype="<i4")
    value = np.frombuffer(b"".join(rows["shares"]), dtype="<f4")
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) // 4 for f in rows["features"]])
    features = associated(column, row, toxic)
    place = np.full(DIMS, -1, dtype=np.int64)
    place[features] = np.arange(len(features))
    keep = place[column] >= 0
    row, column, value = row[keep], place[column[keep]], value[keep].astype(np.float64)
    n = np.maximum(1, np.bincount(column, minlength=len(features)))
    scale = np.sqrt(np.bincount(column, weights=value**2, minlength=len(features)) / n)
    scale = 2 * scale / np.maximum(np.abs(log_ratios(column, row, toxic, len(features))), 1e-3)
    x = Sparse(np.searchsorted(row, np.arange(len(rows) + 1)), column, value / scale[column])
    chain = fit_chain(x, y, (*(f"toxic_{k}" for k in order), "toxic"), features)
    for m in chain.models:
        m.weight = m.weight / scale
    return chain


class WordScores(dict):
    """Word -> row of its scores in ``scores``."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.place = {h: i for i, h in enumerate(chain.features.tolist())}
        self.weights = np.stack([m.weight for m in chain.models], axis=1)
        self.scores = np.zeros((1024, len(chain.models)))

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        at = [self.place[h] for h in word_features(word) if h in self.place]
        self.scores[n] = self.weights[at].sum(axis=0) if at else 0.0
        self[word] = n
        return n

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        if len(self) >= REMEMBERED:
            self.clear()
        means = np.zeros((len(texts), len(self.chain.models)))
        for i, t in enumerate(texts):
            if words := (t or "").split():
                at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
                means[i] = self.scores[at].mean(axis=0)
        return self.chain.probabilities(means)

    def toxic(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        p = self.probabilities(texts)
        some = np.asarray([bool(t and not t.isspace()) for t in texts], dtype=bool)
        return p, some & (p[:, -1] > self.chain.threshold)


def judge_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **named) -> DataFrame:
    """doc_id, probability of every category (array in the chain's order and map), toxic and kept for every row."""
    chain = train(docs, labels, doc_id=doc_id, text=text, **named)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, probability double, categories map<string,double>, toxic boolean, kept boolean"
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        known = None if held.value is None else WordScores(held.value)
        for b in batches:
            n = len(b[text])
            p, bad = (np.zeros((n, 1)), np.zeros(n, dtype=bool)) if known is None else known.toxic(b[text])
            names = ("toxic",) if known is None else known.chain.categories
            yield {
                "doc_id": b[doc_id],
                "probability": p[:, -1],
                "categories": [list(zip(names, map(float, x), strict=True)) for x in p],
                "toxic": bad,
                "kept": ~bad,
            }

    return map_batches(only(docs, doc_id, text), run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", **named) -> DataFrame:
    """The rows that are not toxic, with all their columns."""
    chain = train(docs, labels, text=text, **named)
    if chain is None:
        return docs
    held, at_text = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index(text)

    def run(batches):
        known = WordScores(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                part = whole.slice(at, BATCH_ROWS)
                _, bad = known.toxic(part.column(at_text).to_pylist())
                yield part.filter(pa.array(~bad))

    return docs.mapInArrow(run, docs.schema)
