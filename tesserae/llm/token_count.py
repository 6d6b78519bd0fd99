"""Token counts by heap-and-linked-list byte-pair merging, for the word-level BPE vocabulary files.

A word's symbols lie in a doubly linked list; adjacent pairs that can merge lie in a heap by (rank, position).
The lowest is popped, stale entries are skipped, the pair is joined and its two new neighbours are pushed. The
count is the number of initial symbols minus the number of merges: no identifier is ever looked up.

A merge never crosses white space, so a worker remembers the counts of words (bounded, cleared when full) and a
text's count is a sum over its words. The text is normalised and cut as the vocabulary file states, by the
library's own normaliser and pre-tokeniser; strings of added tokens inside a text are one token each, which is
the library's default.

Defined cases: a null or empty text has 0 tokens and 0 bytes; repeated rows give repeated results; a null id is kept;
equal ranks cannot occur, and of equal pairs the leftmost is merged first; extra columns are ignored; an empty table
gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserae.llm.common import map_batches, only

#: Words whose counts a worker remembers at most.
REMEMBERED = 500_000
#: White space to Python's ``split`` but not to the vocabulary's pattern.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges."""
    n = len(symbols)
    after, before = list(range(1, n)) + [-1], [-1, *range(n - 1)]
    part: list[str | None] = list(symbols)
    heap = [(ranks[p], i, *p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in ranks]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if part[i] != a or j < 0 or part[j] != b:
            continue
        part[i], part[j] = a + b, None
        merges += 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (p := (part[i], part[k])) in ranks:
                heapq.heappush(heap, (ranks[p], i, *p))
        if (h := before[i]) >= 0 and (p := (part[h], part[i])) in ranks:
            heapq.heappush(heap, (ranks[p], h, *p))
    return n - merges


def byte_symbols() -> str:
    """The byte-level alphabet: symbol i stands for byte i; printable bytes stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(i if i in own else next(rest)) for i in range(256))


class PieceCounter(dict):
    """Pre-tokenised piece -> its number of tokens."""

    def __init__(self, ranks: dict[tuple[str, str], int], ending: str):
        self.ranks, self.ending = ranks, ending

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = n = merge_count([*piece[:-1], piece[-1] + self.ending], self.ranks)
        return n


class Cutter:
    """Normalises and cuts texts into byte-level pieces, as a vocabulary file states."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.find = self._finder(self.spec)
        self.alphabet = byte_symbols()

    @staticmethod
    def _finder(spec: dict):
        """The pattern that cuts words, where the file asks for NFC, lower case, that pattern and the byte alphabet."""
        made = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if made != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
            return None
        if cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["add_prefix_space"]:
            return None
        return regex.compile(cuts[0]["pattern"]["Regex"]).findall

    def pieces(self, text: str) -> list[str]:
        """By the library; words of Latin letters, whose tables never differ, by its pattern alone.

        Printable ASCII characters but the space stand for themselves in the byte alphabet; control characters do not.
        """
        if self.find and text.isascii():
            if text.isalpha():
                return [text.lower()]
            found = self.find(text.lower())
            return found if text.isprintable() and " " not in text else [p.translate(self.alphabet) for p in found]
        if self.find and max(text) < "\u0250" and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
            return [p.encode().decode("latin-1").translate(self.alphabet) for p in self.find(text.lower())]
        made = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(made)]


class WordCounter(dict):
    """Word without white space -> its number of tokens."""

    def __init__(self, path: str):
        self.cutter = Cutter(path)
        model = self.cutter.spec["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ranks = {tuple(p): i for i, p in enumerate(pairs)}
        self.symbols = PieceCounter(ranks, model.get("end_of_word_suffix") or "")
        added = sorted((t["content"] for t in self.cutter.spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.hints = sorted({t[:2] for t in added})

    def plain(self, text: str) -> int:
        return sum(map(self.symbols.__getitem__, self.cutter.pieces(text))) if text else 0

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = self.plain(word)
        return n

    def count(self, text: str) -> int:
        if self.added and any(h in text for h in self.hints) and (found := self.added.findall(text)):
            return len(found) + sum(map(self.count_plain, self.added.split(text)))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        if ODD_SPACE.search(text):
            return self.plain(text)
        return sum(map(self.__getitem__, text.split()))


@lru_cache(maxsize=4)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row; ``path``: a vocabulary file on every worker."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        words = counter(path)
        for b in batches:
            texts = [t or "" for t in b[text]]
            n = [words.count(t) for t in texts]
            yield {
                doc_id: b[doc_id],
                "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                "n_tokens": n,
                "over_limit": [x > limit for x in n],
            }

    schema = T._parse_datatype_string(f"`{doc_id}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return map_batches(only(docs, doc_id, text), run, schema)
