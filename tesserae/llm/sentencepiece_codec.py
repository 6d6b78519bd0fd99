"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice has a node for each character boundary and an edge for each piece. For a unigram model a node keeps its
best-scoring edge. For a byte-pair model the merges fix one encoding of every prefix, and a sequence of pieces is that
encoding exactly if each neighbouring pair is: no merge across the pair's border comes before the merges that build
the two pieces. So a node keeps the one edge whose piece fits the piece kept at its start, and the same search with
backpointers finds the library's segmentation without a heap of merges over the text.

The search reads a stream. It holds backpointers of a window only: later edges can start at the last ``longest``
boundaries, so once all paths back from those meet in one boundary, the ids before it are committed and forgotten. A
meeting is looked for as soon as the window is longer than the longest piece, and again a quarter of it later.
Where no piece can cross a boundary (between two characters that stand side by side in no piece) paths meet at once and
are committed there; stretches between such boundaries are independent, and a worker remembers their ids (bounded).
Every id comes from this one search, whatever the length of a stretch.

Characters without a piece become their UTF-8 bytes' pieces. Decoding joins the pieces' bytes.

Defined cases: a null or empty text has no ids and decodes to the empty text; a null id is kept; repeated rows give
repeated results; of equal scores in a unigram model the longer piece is kept; extra columns are ignored; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame

from tesserae.llm.common import map_batches, only

SPACE = "▁"
#: Stretches and pairs of pieces that a worker remembers.
REMEMBERED, PAIRS = 600_000, 1_000_000
INF = float("inf")


class Pieces:
    """The vocabulary of a model: scores, ids, and for byte-pair models how merges build each piece."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int], unknown: int, unigram: bool):
        self.scores, self.ids, self.byte_ids, self.unknown, self.unigram = scores, ids, byte_ids, unknown, unigram
        self.longest = max(map(len, scores), default=1)
        self.floor = min(scores.values(), default=0.0) - 10
        by_end: dict[str, set[int]] = {}  # lengths of the pieces that end in three characters
        for p in scores:
            if len(p) > 2:
                by_end.setdefault(p[-3:], set()).add(len(p))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in by_end.items()}
        self.inside = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.crossed = any(SPACE in p.lstrip(SPACE) for p in scores)
        self.edges: dict[str, tuple | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merges(self, text: str) -> list[tuple[str, list[tuple[str, float]], list[tuple[str, float]]]]:
        """Byte-pair encoding of a short text: each piece with its left and right edge parts over time.

        An edge part comes with the cost (negative score) of the merge that ended it; the last part's is infinite.
        """
        parts = [(c, [[c, INF]], [[c, INF]]) for c in text]
        while len(parts) > 1:
            cost, at = min(
                ((-self.scores[x], i) for i in range(len(parts) - 1) if (x := parts[i][0] + parts[i + 1][0]) in self.scores),
                default=(INF, -1),
            )
            if at < 0:
                break
            (a, left, _), (b, _, right) = parts[at], parts[at + 1]
            left[-1][1] = right[-1][1] = cost
            parts[at : at + 2] = [(a + b, [*left, [a + b, INF]], [*right, [a + b, INF]])]
        return [(p, [tuple(x) for x in l], [tuple(x) for x in r]) for p, l, r in parts]

    def edge(self, piece: str) -> tuple | None:
        """Edge parts of a piece as (part, first cost, last cost); None if merges never build it."""
        if piece not in self.edges:
            made = self.merges(piece)
            self.edges[piece] = None
            if len(made) == 1:
                both = []
                for spine in made[0][1:]:
                    begin, parts = -INF, []
                    for part, end in spine:
                        parts.append((part, begin, end))
                        begin = max(begin, end)
                    both.append(parts)
                self.edges[piece] = tuple(both)
        return self.edges[piece]

    def cut(self, text: str) -> list[str]:
        """The text cut wherever two characters stand side by side in no piece: every path passes there."""
        at = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.inside), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:], strict=False) if a < b]

    def fits(self, a: str, b: str) -> bool:
        """Whether byte-pair encoding of a + b is [a, b]."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._fits(a, b)
        return known

    def to_ids(self, found) -> list[int]:
        """Ids of pieces; characters without a piece by their bytes, or unknown."""
        out: list[int] = []
        for piece in found:
            k = self.ids.get(piece)
            if k is not None:
                out.append(k)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def _fits(self, a: str, b: str) -> bool:
        if SPACE * 2 in a + b:  # equal scores: by the merges themselves
            return [p for p, _, _ in self.merges(a + b)] == [a, b]
        for x, x_begin, x_end in self.edge(a)[1]:
            for y, y_begin, y_end in self.edge(b)[0]:
                score = self.scores.get(x + y)
                if score is not None and max(x_begin, y_begin) < -score < x_end and -score <= y_end:
                    return False
        return True


class StreamingEncoder:
    """Encodes one stretch of characters as they come; ``out`` grows as ids are committed."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.out: list[int] = []
        self.text = ""  # characters since the committed boundary
        self.start = [0]  # backpointers, by boundary
        self.best = [0.0]
        self.last: list[str | None] = [None]  # kept piece, by boundary
        self.before: str | None = None  # piece in front of the window
        self.widest = 0  # boundaries held at most, so far
        self.commits = 0  # times that paths met before the end
        self.look = pieces.longest + 1  # boundaries with which a meeting is looked for

    def feed(self, more: str) -> None:
        step = self._best_edge if self.pieces.unigram else self._fitting_edge
        for c in more:
            self.text += c
            step(len(self.text))
            if len(self.last) > self.look:
                self.widest = max(self.widest, len(self.last))
                at = self._meeting()
                self.commits += at > 0
                self._commit(at)
                self.look = max(self.pieces.longest, len(self.last)) + 1 + self.pieces.longest // 4

    def _best_edge(self, i: int) -> None:
        """Unigram model: the edge with the best sum of scores. A character that is no piece has a low score."""
        p, text = self.pieces, self.text
        best, start = -INF, i - 1
        for n in range(min(p.longest, i), 0, -1):
            score = p.scores.get(text[i - n : i])
            if score is not None and self.best[i - n] + score > best:
                best, start = self.best[i - n] + score, i - n
        if text[i - 1] not in p.scores and self.best[i - 1] + p.floor > best:
            best, start = self.best[i - 1] + p.floor, i - 1
        self.start.append(start)
        self.best.append(best)
        self.last.append(text[start:i])

    def _fitting_edge(self, i: int) -> None:
        """Byte-pair model: the one edge whose piece fits the piece kept at its start."""
        p, text, last = self.pieces, self.text, self.last
        scores, edges, pairs = p.scores, p.edges, p.pairs
        for n in (*p.ends.get(text[i - 3 : i] if i > 2 else "", ()), 2, 1):
            if n > i:
                continue
            s = text[i - n : i]
            if s in scores and (edges[s] if s in edges else p.edge(s)) is not None:
                left = last[i - n] if i > n else self.before
                if left is None or left not in scores or (pairs[left, s] if (left, s) in pairs else p.fits(left, s)):
                    break
        else:
            n, s = 1, text[i - 1]
        self.start.append(i - n)
        self.best.append(0.0)
        last.append(s)

    def _meeting(self) -> int:
        """The boundary that all paths back from the last boundaries share."""
        ends = set(range(max(0, len(self.last) - self.pieces.longest), len(self.last)))
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(self.start[top])
        return ends.pop()

    def _commit(self, at: int) -> None:
        if at <= 0:
            return
        found, i = [], at
        while i > 0:
            found.append(self.last[i])
            i = self.start[i]
        self.out.extend(self.pieces.to_ids(reversed(found)))
        self.before = self.last[at]
        self.text = self.text[at:]
        self.start = [0, *(max(0, x - at) for x in self.start[at + 1 :])]
        base = self.best[at]
        self.best = [x - base for x in self.best[at:]]
        self.last = [None, *self.last[at + 1 :]]

    def finish(self) -> list[int]:
        self._commit(len(self.text))
        return self.out


class Codec:
    """Encoder and decoder of a model file; ``unigram`` says which of the two kinds the model is."""

    def __init__(self, path: str, unigram: bool = False):
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, ids, byte_ids = {}, {}, {}
        self.surface: list[bytes] = []
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                self.surface.append(bytes([int(piece[3:-1], 16)]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                self.surface.append(" ⁇ ".encode() if p.is_unknown(i) else b"")
            else:
                scores[piece], ids[piece] = p.get_score(i), i
                self.surface.append(piece.replace(SPACE, " ").encode())
        full = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else []
        self.pieces = Pieces(scores, ids, full, p.unk_id(), unigram)
        probe = "  A ﬁ é\t\n b  "
        self.plain = p.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.marked, self.bare = Stretches(self.pieces, SPACE), Stretches(self.pieces, "")
        self.parts = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        #: Lines can be cut where the line feed has no piece and no piece holds it.
        self.by_words = self.plain and not self.pieces.crossed and not any("\n" in x for x in scores)
        self.line = self.bare["\n"]

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_words:
            whole = self.library.normalize(text) if not self.plain else SPACE + text.replace(" ", SPACE)
            e = StreamingEncoder(self.pieces)
            e.feed(whole)
            return array("I", e.finish()).tobytes()
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.line)
            if not line and k:
                continue
            words = line.split(" ")
            if "" in words or SPACE in line:
                marked = (SPACE if k == 0 else "") + line.replace(" ", SPACE)
                out.extend(map(self.bare.__getitem__, self.parts.findall(marked)))
                continue
            out.append((self.bare if k else self.marked)[words[0]])
            out.extend(map(self.marked.__getitem__, words[1:]))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()

    def decode(self, ids) -> str:
        """The text of ids; the space in front that encoding added is dropped, bad UTF-8 becomes U+FFFD."""
        whole = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole


class Stretches(dict):
    """Text between sure boundaries -> its ids in bytes; the mark is set in front, and further sure boundaries cut it."""

    def __init__(self, pieces: Pieces, mark: str):
        self.pieces, self.mark = pieces, mark
        self.parts: dict[str, bytes] = {}
        self.searches = self.commits = 0

    def search(self, part: str) -> bytes:
        e = StreamingEncoder(self.pieces)
        e.feed(part)
        found = e.finish()
        self.searches += 1
        self.commits += e.commits
        return array("I", found).tobytes()

    def __missing__(self, stretch: str) -> bytes:
        whole, out = self.mark + stretch, []
        for part in self.pieces.cut(whole):
            ids = self.parts.get(part)
            if ids is None:
                ids = self.search(part)
                if len(part) <= 64:
                    if len(self.parts) >= REMEMBERED:
                        self.parts.clear()
                    self.parts[part] = ids
            out.append(ids)
        ids = b"".join(out)
        if len(stretch) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = ids
        return ids


@lru_cache(maxsize=4)
def codec(path: str, unigram: bool = False) -> Codec:
    return Codec(path, unigram)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", unigram: bool = False) -> DataFrame:
    """doc_id and ids (array) for every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        c = codec(path, unigram)
        for b in batches:
            yield {"doc_id": b[doc_id], "ids": [c.encode(t or "") for t in b[text]]}

    return map_batches(only(docs, doc_id, text), run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text for every row of ids; null ids are the empty text."""
    kind = encoded.schema[doc_id].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for b in batches:
            yield {"doc_id": b[doc_id], "text": [c.decode(x or []) for x in b[ids]]}

    return map_batches(only(encoded, doc_id, ids), run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_chars, restored (decoding gives the text)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [t or "" for t in b[text]]
            ids = [c.encode_bytes(t) for t in texts]
            back = [c.decode(array("I", x)) for x in ids]
            yield {
                "doc_id": b[doc_id],
                "n_ids": [len(x) // 4 for x in ids],
                "ids_crc32": [zlib.crc32(x) for x in ids],
                "decoded_chars": [len(t) for t in back],
                "restored": [x == y for x, y in zip(texts, back, strict=True)],
            }

    schema = f"doc_id {kind}, n_ids bigint, ids_crc32 bigint, decoded_chars bigint, restored boolean"
    return map_batches(only(docs, doc_id, text), run, schema)
