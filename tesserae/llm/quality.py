"""Document quality by weak supervision: rules vote or abstain, and EM weighs the votes.

Every rule looks at one property of a text and votes good or bad, or abstains. Several rules see each kind of junk
(symbols, repetition, shouting, text that is no prose), and each also votes good where its property is as in plain
text, so that their accuracies can be told from how they agree. Expectation-maximisation over the counts of vote
patterns estimates how often a rule that votes is wrong on good documents and right on bad ones, and how common good
documents are; the posterior probability of good quality replaces the rule that all checks must pass. A document with a
bad vote stays if the other votes outweigh it. No bound is set on an accuracy; weak pseudo-counts say that rules
are mostly right, and a rule is never read backwards. Only the counts of patterns (3 to the number of rules at most,
whatever the size of the corpus) reach the driver.

Counts are exact: words are runs of anything but the six ASCII white-space characters.

Defined cases: a null or empty text has no words, no votes, and fails the base checks; a text under ``FEW`` words has no
votes; without votes the posterior is the share of good documents; a posterior at the threshold is kept; a null id is
kept; repeated rows give repeated results; extra columns are ignored (or kept, by the filter); an empty table gives an
empty result; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import BATCH_ROWS, checkpointed, map_batches, only

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SYMBOL_BYTES = frozenset(SYMBOLS.encode())
#: Outcomes of a rule as letters of a vote pattern: bad, no vote, good.
OUTCOMES = "b-g"
#: Words under which a text is too short for a rule to say anything.
FEW = 10
#: Pseudo-counts of (bad, good) votes on good and on bad documents: rules are mostly right.
TRUST = np.asarray([[1.0, 20.0], [4.0, 4.0]])
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: ASCII characters that are neither letters nor digits nor white space.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(text: str | None) -> dict[str, float]:
    """The exact counts, and those that only the rules use."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    found: dict[str, float] = {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": 0,
        "n_lines": len(lines),
        "n_same": 0,
        "n_distinct": 0,
        "n_stops": text.count(". ") + text.count(", ") + text.count(".\n"),
        "n_upper": 0,
        "n_calls": text.count("!") + text.count("?"),
        "n_marked": 0,
        "n_capitals": len(raw) - len(raw.translate(None, CAPITALS)),
        "n_marks": len(raw) - len(raw.translate(None, MARKS)),
    }
    if not n:
        return found
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    m = len(seen)
    found["n_same"] = int((ids[1:] == ids[:-1]).sum())
    times = np.bincount(ids, minlength=m)
    found["n_distinct"] = m
    found["n_upper"] = int(times[[w.isupper() and len(w) > 1 for w in seen]].sum())
    found["n_marked"] = int(times[[w[-1] in SYMBOL_BYTES for w in seen]].sum()) if found["n_symbols"] else 0
    if n > 2:
        pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
        _, at, n_at = np.unique(pair[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
        twice = n_at[at] > 1
        held = np.zeros(n, dtype=bool)
        for k in range(3):
            held[k : n - 2 + k] |= twice
        found["n_repeat_words"] = int(held.sum())
    return found


@dataclass(frozen=True)
class Rule:
    """Good up to ``good``, bad from ``bad`` on, else no vote."""

    name: str
    value: Callable[[dict[str, float]], float]
    good: float
    bad: float

    def vote(self, m: dict[str, float]) -> int:
        if m["n_words"] < FEW:
            return 0
        v = self.value(m)
        return 1 if v <= self.good else -1 if v >= self.bad else 0


def share(a: str, b: str) -> Callable[[dict[str, float]], float]:
    return lambda m: m[a] / max(1, m[b])


def _distance(low: float, high: float) -> Callable[[dict[str, float]], float]:
    """How far the mean word length lies outside a range."""

    def value(m: dict[str, float]) -> float:
        mean = m["word_chars"] / max(1, m["n_words"])
        return max(low - mean, mean - high, 0)

    return value


RULES = (
    # symbols
    Rule("symbols", share("n_symbols", "n_words"), 0.02, 0.12),
    Rule("marked_words", share("n_marked", "n_words"), 0.02, 0.1),
    Rule("punctuation", share("n_marks", "word_chars"), 0.04, 0.055),
    # repetition
    Rule("repeats", share("n_repeat_words", "n_words"), 0.05, 0.25),
    Rule("same_word", share("n_same", "n_words"), 0.01, 0.025),
    Rule("duplicate_lines", share("n_dup_lines", "n_lines"), 0.05, 0.25),
    Rule("few_words", lambda m: m["n_words"] ** 0.5 / max(1, m["n_distinct"]), 0.25, 0.4),
    # shouting
    Rule("upper_words", share("n_upper", "n_words"), 0.05, 0.2),
    Rule("capitals", share("n_capitals", "word_chars"), 0.1, 0.3),
    Rule("calls", share("n_calls", "n_words"), 0.05, 0.2),
    # prose
    Rule("word_length", _distance(3, 9), 0, 3),
    Rule("no_stops", lambda m: 1 - m["n_stops"] / max(1, m["n_words"]), 0.93, 0.96),
)


def votes(m: dict[str, float], rules: tuple[Rule, ...]) -> str:
    """A letter for each rule: g, b or -."""
    return "".join(OUTCOMES[r.vote(m) + 1] for r in rules)


def base_failed(m: dict[str, float]) -> bool:
    return m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and of each rule's votes the share that is bad on good and on bad documents."""

    prior: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def weights(self) -> np.ndarray:
        """rules, (bad, none, good): what a vote adds to the log odds of bad quality."""
        bad, good = np.log(self.on_bad) - np.log(self.on_good), np.log1p(-self.on_bad) - np.log1p(-self.on_good)
        return np.stack([bad, np.zeros_like(bad), good], axis=1)

    def posterior(self, pattern: str) -> float:
        """Of good quality. A rule that abstains says nothing, so without votes it is the prior."""
        odds = np.log1p(-self.prior) - np.log(self.prior)
        odds += sum(w[OUTCOMES.index(c)] for w, c in zip(self.weights(), pattern, strict=True))
        return float(1 / (1 + np.exp(np.clip(odds, -700, 700))))


#: Where EM starts: share of good documents, bad votes on good documents, bad votes on bad documents.
STARTS = tuple((prior, wrong, right) for prior in (0.85, 0.5, 0.7, 0.95) for wrong in (0.01, 0.05) for right in (0.25, 0.5, 0.8))


def fit_votes(patterns: dict[str, int], n_rules: int, rounds: int = 500, starts=STARTS) -> VoteModel:
    """EM over counted vote patterns, with the pseudo-counts ``TRUST``; of all starts the likeliest end.

    A rule is never read backwards: a bad vote stays at least as likely on bad documents as on good ones.
    """
    keys = sorted(patterns)
    n = np.asarray([patterns[k] for k in keys], dtype=float)
    seen = np.asarray([[[c == OUTCOMES[0], c == OUTCOMES[2]] for c in k] for k in keys], dtype=float).reshape(len(keys), n_rules, 2)
    ends = [expectation_maximisation(n, seen, *start, rounds=rounds) for start in starts]
    return max(ends, key=lambda end: end[0])[1]


def expectation_maximisation(
    n: np.ndarray, seen: np.ndarray, prior: float, wrong: float, right: float, rounds: int
) -> tuple[float, VoteModel]:
    """Log likelihood, with that of the pseudo-counts, and model. n: counts of patterns; seen: patterns, rules, (bad, good)."""
    n_rules = seen.shape[1]
    share_, on_good, on_bad = prior, np.full(n_rules, wrong), np.full(n_rules, right)
    both = lambda on: np.log(np.stack([on, 1 - on], axis=1))
    known = lambda: TRUST[0] @ both(on_good).T + TRUST[1] @ both(on_bad).T
    for _ in range(rounds if len(n) else 0):
        good = np.log(share_) + (seen * both(on_good)).sum(axis=(1, 2))
        bad = np.log1p(-share_) + (seen * both(on_bad)).sum(axis=(1, 2))
        p = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        before, share_ = share_, float((n @ p + 1) / (n.sum() + 2))
        of_good, of_bad = np.tensordot(n * p, seen, 1) + TRUST[0], np.tensordot(n * (1 - p), seen, 1) + TRUST[1]
        on_good, on_bad = of_good[:, 0] / of_good.sum(axis=1), of_bad[:, 0] / of_bad.sum(axis=1)
        on_bad = np.maximum(on_bad, on_good)
        if abs(share_ - before) < 1e-10:
            break
    good = np.log(share_) + (seen * both(on_good)).sum(axis=(1, 2))
    bad = np.log1p(-share_) + (seen * both(on_bad)).sum(axis=(1, 2))
    return float(n @ np.logaddexp(good, bad) + known().sum()), VoteModel(share_, on_good, on_bad)


def rejected_patterns(counted: DataFrame, rules: tuple[Rule, ...], threshold: float) -> list[str]:
    """The vote patterns whose posterior is under the threshold. ``counted``: votes, n."""
    patterns = {r["votes"]: r["n"] for r in counted.collect()}
    model = fit_votes(patterns, len(rules))
    return sorted(k for k in patterns if model.posterior(k) < threshold)


def measured(docs: DataFrame, doc_id: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [measures(t) for t in b[text]]
            yield {
                "doc_id": b[doc_id],
                **{c: [m[c] for m in found] for c in COUNTS},
                "votes": [votes(m, rules) for m in found],
                "base_failed": [base_failed(m) for m in found],
            }

    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return map_batches(only(docs, doc_id, text), run, f"doc_id {kind}, {counts}, votes string, base_failed boolean")


def judge_quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5
) -> DataFrame:
    """doc_id, the exact counts, the votes, base_failed and kept for every row."""
    rows = checkpointed(measured(docs, doc_id, text, rules))
    rejected = rejected_patterns(rows.groupBy("votes").agg(F.count("*").alias("n")), rules, threshold)
    kept = ~F.col("base_failed") & ~F.col("votes").isin(rejected or ["none"])
    return rows.withColumn("kept", kept)


def keep_good(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5
) -> DataFrame:
    """The rows of good quality with all their columns.

    Texts are measured in one pass, which writes the rows that pass the base checks, with their votes, to the
    checkpoint; the filter reads them from there. Votes of rows that fail the base checks count in the model too.
    """
    name = docs.columns.index(text)
    mark = "_votes"
    while mark in docs.columns:
        mark += "_"
    failed = F.substring(F.col(mark), 1, 1) == "!"

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                part = whole.slice(at, BATCH_ROWS)
                found = [measures(t) for t in part.column(name).to_pylist()]
                marks = [("!" if base_failed(m) else "") + votes(m, rules) for m in found]
                # A row that failed is needed for its votes alone.
                texts = pa.array([None if k[:1] == "!" else t for k, t in zip(marks, part.column(name).to_pylist(), strict=True)], type=part.schema.field(name).type)
                columns = [texts if i == name else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(marks)], schema=part.schema.append(pa.field(mark, pa.string())))

    judged = checkpointed(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(mark, T.StringType())])))
    counted = judged.groupBy(F.when(failed, F.expr(f"substring({mark}, 2)")).otherwise(F.col(mark)).alias("votes")).agg(F.count("*").alias("n"))
    rejected = rejected_patterns(counted, rules, threshold)
    return judged.where(~failed & ~F.col(mark).isin(rejected or ["none"])).select(*docs.columns)
