"""Personal data: exact patterns, and spans that a character BiLSTM-CRF adds to them.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of fixed patterns that pass their
check. The model is a character-level bidirectional LSTM with a linear-chain CRF over begin/inside tags, written
and trained in numpy from labelled spans: carrier texts of the corpus (a bounded, documented sample) into which
identifiers in many written forms, and look-alikes that are none, are set at known places. It knows forms that the
patterns do not hold (``name at host dot com``, phone numbers without a plus, cards with dots, addresses with spaces)
and one kind more: secrets, such as keys, tokens and passwords with the word that names them.

The model reads every character of every text, in overlapping windows on a grid of ``STEP`` characters. Emissions of
the windows that cover a character are weighed by the distance to each window's edge, and one CRF decoding of the whole
text reconciles them. That decoding is exact and touches little of the text: from the emissions follows, for each
character, a bound on what any path could gain by not being outside there; where it is negative the best path is
outside for certain, and the stretches between are decoded one by one.

A decoded span is added if it has the look of its kind and touches no base span (a secret may hold one).

Offsets are code points, ends exclusive.

Defined cases: a null or empty text has no spans; a null id is kept; repeated rows give repeated results; equal starts
of one kind are in the order of their ends; extra columns are ignored (or kept, by the masking form), whatever their
names; texts of any length are read whole, in slabs of bounded memory; an empty table gives an empty result, and a
corpus without text is trained on plain words of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import BATCH_ROWS, map_batches, only

#: Kinds that patterns hold, and all.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Window and step of the model, in characters; length of a training window.
WINDOW, STEP, LESSON = 256, 216, 96
#: Characters whose emissions are held at once, windows that run together (their states fit in a core's cache), and steps
#: whose emissions are laid out together.
SLAB, AT_ONCE, BLOCK = 1 << 20, 640, 16
#: Texts that serve as carriers in training, and characters taken of each. They are material to write labelled
#: spans into, not labelled rows: the labels come from the generator, so more of them teach nothing new.
CARRIERS, CARRIER_CHARS = 400, 600

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits is entered at its start only; a later start could not match where the first does not.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, found: str) -> bool:
    """The kind's check on a span's text."""
    d = digits_of(found)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in parts)
    return True


def emails(text: str) -> list[tuple[int, int]]:
    """By the at signs, so that long runs of letters cost nothing."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed and then by start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return found


# The model.

N_CHARS = 99  # 0 pads


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point: printable ASCII each, white space, letters, other characters."""
    out = np.full(1 << 16, 98, dtype=np.uint8)
    for o in range(1 << 16):
        if 32 < o < 127:
            out[o] = o - 31
        elif chr(o).isspace():
            out[o] = 96
        elif chr(o).isalpha():
            out[o] = 97
    return out


def char_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return classes()[np.minimum(points, (1 << 16) - 1)]


def softsign(x: np.ndarray, room: np.ndarray, out: np.ndarray) -> np.ndarray:
    """It stands for tanh, and half of one more than it for the logistic function: three passes, no power series."""
    np.abs(x, out=room)
    room += 1
    return np.divide(x, room, out=out)


@dataclass
class Tagger:
    """Character table and recurrence of an LSTM in each direction (gates i, f, o, g), emission layer and CRF."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator, hidden: int = 16) -> Tagger:
        k = len(TAGS)
        p = {"X": rng.normal(0, 0.2, (2, N_CHARS, 4 * hidden)), "R": rng.normal(0, 0.2, (2, hidden, 4 * hidden))}
        p["X"][:, :, hidden : 2 * hidden] += 1.0  # forget little at first
        p |= {"V": rng.normal(0, 0.2, (2 * hidden, k)), "v": np.zeros(k), "T": np.zeros((k, k)), "S": np.zeros(k)}
        return Tagger({n: x.astype(np.float32) for n, x in p.items()})

    def states(self, ids: np.ndarray, keep: bool = False):
        """ids: batch, time. Hidden states (direction, time, batch, hidden), each direction in its own time.

        ``keep``: also cells and gates, for the backward pass.
        """
        x, r = self.p["X"], self.p["R"]
        n, steps = ids.shape
        h = r.shape[1]
        both = np.stack([ids.T, ids.T[::-1]]).astype(np.intp)
        hs = np.zeros((2, steps + 1, n, h), np.float32)
        cs = np.zeros((2, steps + 1, n, h), np.float32) if keep else None
        gates = np.empty((2, steps, n, 4 * h), np.float32) if keep else None
        c, bent = np.zeros((2, n, h), np.float32), np.empty((2, n, h), np.float32)
        z, signs, own = (np.empty((2, n, 4 * h), np.float32) for _ in range(3))
        i, f, o, g = (signs[..., q * h : (q + 1) * h] for q in range(4))  # gates are (1 + sign) / 2
        x = np.ascontiguousarray(x, dtype=np.float32)
        for t in range(steps):
            np.matmul(hs[:, t], r, out=z)
            for d in (0, 1):
                np.take(x[d], both[d, t], axis=0, out=own[d], mode="clip")
            z += own
            softsign(z, signs, signs)
            c += np.multiply(f, c, out=bent)
            c += np.multiply(i, g, out=bent)
            c += g
            c *= 0.5
            softsign(c, bent, bent)
            after = hs[:, t + 1]
            np.multiply(o, bent, out=after)
            after += bent
            after *= 0.5
            if keep:
                cs[:, t + 1], gates[:, t] = c, signs
        if keep:
            gates[..., : 3 * h] = 0.5 + 0.5 * gates[..., : 3 * h]
        return (hs, cs, gates, both) if keep else hs

    def read(self, windows: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Emissions (time, tags) of every window, without ``v``. The windows are codes, in falling order of length.

        What ``states`` and ``emissions`` compute of windows padded to ``WINDOW``, without reading the padding: a window that
        has come to its end leaves the batch, and the other direction begins in the state that the padding leaves behind.
        Hidden states are not kept; emissions go to the windows ``BLOCK`` steps at a time.
        """
        n, steps, k = len(windows), len(windows[0]), self.p["V"].shape[1]
        h = len(self.p["V"]) // 2
        # By gate and direction, so that each gate's values lie together; rows of the character table one below another.
        r = np.ascontiguousarray(self.p["R"].reshape(2, h, 4, h).transpose(2, 0, 1, 3)) / 2
        x = np.ascontiguousarray(self.p["X"].reshape(2, N_CHARS, 4, h).transpose(2, 0, 1, 3), dtype=np.float32).reshape(-1, h)
        base = np.arange(0, len(x), N_CHARS).reshape(4, 2, 1)
        v = self.p["V"].reshape(2, h, k) / 2  # as R: states are held doubled
        ids = np.zeros((2, n, steps), np.uint8)
        for j, w in enumerate(windows):
            ids[0, j, : len(w)], ids[1, j, : len(w)] = w, w[::-1]
        ids = np.ascontiguousarray(ids.transpose(2, 0, 1))
        live = np.searchsorted([-len(w) for w in windows], -np.arange(steps)).tolist()
        row = np.dtype((np.void, 4 * k))
        out, block = np.empty((2, n, steps, k), np.float32), np.empty((2, BLOCK, n, k), np.float32)
        out_rows, block_rows = out.view(row)[..., 0], block.view(row)[..., 0].transpose(0, 2, 1)
        m = n
        z = np.zeros((5, 2, n, h), np.float32)  # gates i, f, o, g, and the cell
        own, at = np.empty((4, 2, n, h), np.float32), np.empty((4, 2, n), np.intp)
        bent, after = np.empty((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        behind = [WINDOW - len(w) for w in windows]
        after[1], z[4, 1] = 2 * self.padding[0][behind], self.padding[1][behind]
        for t in range(steps):
            if t % BLOCK == 0:
                codes = ids[t : t + BLOCK].astype(np.intp)
            if live[t] != m:
                m = live[t]
                z, bent, after = z[:, :, :m], bent[:, :m], after[:, :m]
                own, at = np.empty((4, 2, m, h), np.float32), np.empty((4, 2, m), np.intp)
            np.matmul(after, r, out=z[:4])
            np.add(base, codes[t % BLOCK, :, :m], out=at)
            np.take(x, at, axis=0, out=own, mode="clip")
            z[:4] += own
            softsign(z[:4], own, z[:4])
            z[:3] += 1  # twice the logistic function's stand-in
            z[:2] *= z[3:]
            c = np.add(z[0], z[1], out=z[4])
            c *= 0.5
            softsign(c, bent, bent)
            np.multiply(z[2], bent, out=after)
            np.matmul(after, v, out=block[:, t % BLOCK, :m])
            if t % BLOCK == BLOCK - 1 or t == steps - 1:
                a = t - t % BLOCK
                most, done = live[a], block_rows[..., : t + 1 - a]
                out_rows[0, :most, a : t + 1] = done[0, :most]
                out_rows[1, :most, steps - 1 - t : steps - a] = done[1, :most, ::-1]
        for j, w in enumerate(windows):
            em = out[0, j, : len(w)]
            em += out[1, j, steps - len(w) :]
            yield em

    @cached_property
    def padding(self) -> tuple[np.ndarray, np.ndarray]:
        """Hidden state and cell of the direction from the end, after each number of padding characters."""
        hs, cs, *_ = self.states(np.zeros((1, WINDOW), np.uint8), keep=True)
        return hs[1, :, 0], cs[1, :, 0]

    def emissions(self, hs: np.ndarray) -> np.ndarray:
        """time, batch, tags."""
        h = hs.shape[3]
        flat = hs[:, 1:].reshape(2, -1, h)
        out = (flat[0] @ self.p["V"][:h] + self.p["v"]).reshape(*hs[0, 1:].shape[:2], -1)
        out += (flat[1] @ self.p["V"][h:]).reshape(out.shape)[::-1]
        return out

    def loss(self, ids: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood per window, and gradients."""
        hs, cs, gates, chars = self.states(ids, keep=True)
        em = self.emissions(hs)
        steps, n, k = em.shape
        h = hs.shape[3]
        tr, st, y = self.p["T"].astype(np.float64), self.p["S"].astype(np.float64), tags.T
        top = em.max(axis=2, keepdims=True)
        e, way = np.exp((em - top).astype(np.float64)), np.exp(tr)
        a, b, c = np.empty((steps, n, k)), np.ones((steps, n, k)), np.empty((steps, n, 1))
        for t in range(steps):  # forward, each step scaled to a sum of one
            a[t] = (a[t - 1] @ way if t else np.exp(st)) * e[t]
            c[t] = a[t].sum(axis=1, keepdims=True)
            a[t] /= c[t]
        for t in range(steps - 2, -1, -1):
            b[t] = (e[t + 1] * b[t + 1] / c[t + 1]) @ way.T
        z = np.log(c).sum(axis=(0, 2)) + top.sum(axis=(0, 2))
        r = np.arange(n)
        gold = st[y[0]] + em[np.arange(steps)[:, None], r, y].sum(axis=0) + tr[y[:-1], y[1:]].sum(axis=0)
        d_em = a * b
        dt = way * (a[:-1].reshape(-1, k).T @ (e[1:] * b[1:] / c[1:]).reshape(-1, k))
        np.add.at(dt, (y[:-1].ravel(), y[1:].ravel()), -1)
        ds = d_em[0].sum(axis=0)
        np.add.at(ds, y[0], -1)
        d_em[np.arange(steps)[:, None], r, y] -= 1
        d_em = (d_em / n).astype(np.float32)
        out = np.concatenate([hs[0, 1:], hs[1, 1:][::-1]], axis=2)
        d_out = d_em @ self.p["V"].T
        g = {"V": np.einsum("tnh,tnk->hk", out, d_em), "v": d_em.sum(axis=(0, 1)), "T": dt / n, "S": ds / n}
        d_hs = np.stack([d_out[:, :, :h], d_out[::-1, :, h:]])
        dz = np.empty_like(gates)
        dh, dc, th = (np.zeros((2, n, h), np.float32) for _ in range(3))
        slope = lambda gate: 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
        back = self.p["R"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            i, f, o, c = (gates[:, t, :, q * h : (q + 1) * h] for q in range(4))
            th = softsign(cs[:, t + 1], th, th)
            dh = dh + d_hs[:, t]
            dc = dc + dh * o * (1 - np.abs(th)) ** 2
            dz[:, t, :, :h] = dc * c * slope(i)
            dz[:, t, :, h : 2 * h] = dc * cs[:, t] * slope(f)
            dz[:, t, :, 2 * h : 3 * h] = dh * th * slope(o)
            dz[:, t, :, 3 * h :] = dc * i * (1 - np.abs(c)) ** 2
            dh = np.matmul(dz[:, t], back)
            dc = dc * f
        flat = dz.reshape(2, steps * n, 4 * h)
        g["R"] = np.matmul(hs[:, :-1].reshape(2, steps * n, h).transpose(0, 2, 1), flat)
        hot = (chars.reshape(2, steps * n, 1) == np.arange(N_CHARS)).astype(np.float32)
        g["X"] = np.matmul(hot.transpose(0, 2, 1), flat)
        return float((z - gold).mean()), g

    def ways(self) -> dict[str, np.ndarray]:
        """What transitions add to a tag's emission over being O, for a position that is the first of a span, inside, last or alone.

        At the first character of a text, a span is begun or alone by ``S``. A first position has a begin tag, every second one.
        """
        tr = self.p["T"].astype(np.float64) + LEGAL
        stay, out, start = tr[0, 0], tr[1:, 0] - tr[0, 0], self.p["S"][1:] - self.p["S"][0] + LEGAL[0, 1:]
        enter, inside = tr[0, 1:] - stay, tr[1:, 1:].max(axis=0) - stay
        found = {"enter": enter[::2], "inside": inside, "leave": inside + out, "alone": (enter + out)[::2]}
        found |= {"start": start, "start alone": start + out, "end alone": enter}
        return {n: x.astype(np.float32)[:, None] for n, x in found.items()}

    def gain(self, em: np.ndarray, first: bool, last: bool, ways: dict[str, np.ndarray]) -> np.ndarray:
        """The most that each position (rows of emissions) can add to a path that is not O there: rows of ``open_stretches``.

        ``first`` and ``last``: the text begins and ends here. ``ways`` are the model's.
        """
        by_tag = np.ascontiguousarray(em.T, dtype=np.float32)
        more = by_tag[1:] - by_tag[0]
        begin, room = more[::2], np.empty_like(more)
        found = np.empty((4, len(em)), np.float32)
        for x, tags, row in zip(("enter", "inside", "leave", "alone"), (begin, more, more, begin), found, strict=True):
            np.add(tags, ways[x], out=room[: len(tags)]).max(axis=0, out=row)
        most = lambda at, way: (more[:, [at]] + ways[way]).max()
        if first:
            found[0, 0], found[3, 0] = most(0, "start"), most(0, "start alone")
        if last:
            found[2, -1], found[3, -1] = most(-1, "inside"), most(-1, "end alone")
        if first and last and len(em) == 1:
            found[3, 0] = most(0, "start")
        return found

    def decode(self, em: np.ndarray, first: bool = True, last: bool = True) -> list[int]:
        """Best tag path for emissions (time, tags). Not ``first`` or not ``last``: the text goes on there, outside."""
        return self.decode_all([(em, first, last)])[0]

    def decode_all(self, parts: list[tuple[np.ndarray, bool, bool]]) -> list[list[int]]:
        """``decode`` of many, in step: in falling order of length, those that have come to their end leave."""
        order = sorted(range(len(parts)), key=lambda j: -len(parts[j][0]))
        ems, firsts, lasts = zip(*(parts[j] for j in order), strict=True)
        lengths = np.asarray([len(em) for em in ems])
        live = np.searchsorted(-lengths, -np.arange(lengths[0])).tolist()
        starts = np.concatenate([[0], np.cumsum(live)])
        flat = np.empty((starts[-1], len(TAGS)), ems[0].dtype)  # by time, then by stretch
        for j, em in enumerate(ems):
            flat[starts[: len(em)] + j] = em
        at, live = starts.tolist(), [*live, 0]
        tr = self.p["T"] + LEGAL
        leave = np.where(np.asarray(lasts)[:, None], 0, tr[:, 0])
        score = flat[: live[0]] + np.where(np.asarray(firsts)[:, None], self.p["S"] + LEGAL[0], tr[0])
        back = np.empty(flat.shape, np.uint8)
        path = np.empty(len(flat), np.uint8)
        for t in range(lengths[0]):
            if t:
                s = score[: live[t], :, None] + tr
                back[at[t] : at[t + 1]] = s.argmax(axis=1)
                score = s.max(axis=1)
                score += flat[at[t] : at[t + 1]]
            m = live[t + 1]
            if m < live[t]:
                path[at[t] + m : at[t + 1]] = (score[m:] + leave[m : live[t]]).argmax(axis=1)
        rows = np.arange(len(ems))
        for t in range(lengths[0] - 1, 0, -1):
            tag = path[at[t] : at[t + 1]]
            path[at[t - 1] : at[t - 1] + live[t]] = back[at[t] : at[t + 1]][rows[: live[t]], tag]
        found: list[list[int]] = [[] for _ in parts]
        for j, k in enumerate(order):
            found[k] = path[starts[: lengths[j]] + j].tolist()
        return found


#: An inside tag only follows a begin or inside tag of its kind.
LEGAL = np.asarray([[-1e9 if b[0] == "I" and (a == "O" or a[2:] != b[2:]) else 0.0 for b in TAGS] for a in TAGS])


def train(windows: np.ndarray, tags: np.ndarray, seed: int = 5, steps: int = 600, batch: int = 48, rate: float = 0.04) -> Tagger:
    """Adam with a falling rate and clipped gradients."""
    rng = np.random.default_rng(seed)
    model = Tagger.fresh(rng)
    m = {k: np.zeros_like(x) for k, x in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for t in range(1, steps + 1):
        pick = rng.choice(len(windows), min(batch, len(windows)), replace=False)
        _, g = model.loss(windows[pick], tags[pick])
        size = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        for k, x in model.p.items():
            d = g[k].astype(np.float32) * min(1.0, 5.0 / max(size, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d**2
            x -= rate * (1 - 0.95 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return model


# Labelled spans.

LOWER, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
ALNUM = LOWER + LOWER.upper() + "0123456789"
#: Words that name a secret, and words before strings that look like one.
SECRET_NAMES = ("token", "secret", "api_key", "apikey", "key", "password", "passwd", "access_key", "auth", "client_secret", "private_key", "access_token")
HASH_NAMES = ("commit", "sha1", "sha256", "md5", "checksum", "hash", "digest", "etag", "rev", "id", "build", "blob")


def drawn(rng: np.random.Generator, letters: str, n: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


def _card(rng: np.random.Generator, good: bool) -> str:
    body = drawn(rng, "0123456789", 15)
    return body + next(str(d) for d in range(10) if luhn(body + str(d)) == good)


def identifier(rng: np.random.Generator, kind: str) -> tuple[str, str, str]:
    """What stands before, one identifier in one of its written forms, what stands after."""
    pick = lambda *forms: forms[int(rng.integers(len(forms)))]
    name = lambda: drawn(rng, LOWER, int(rng.integers(3, 10)))
    number = lambda n: drawn(rng, "0123456789", n)
    if kind == "email":
        user = name() + pick("", "", f".{name()}", f"_{number(2)}", f".{number(2)}", number(2))
        host, top = pick(name(), f"{name()}.{name()}", f"mail{number(1)}.{name()}"), pick("com", "org", "net", "de", "fr")
        a, b = pick(("(at)", "(dot)"), ("[at]", "[dot]"), ("at", "dot"), ("at", "dot"))
        gap = " " if a == "at" else pick("", " ")
        spelled = user + gap + a + gap + f"{host}.{top}".replace(".", gap + b + gap)
        return "", pick(f"{user}@{host}.{top}", f"{user} @ {host}.{top}", f"{user}@ {host}.{top}", spelled, spelled), ""
    if kind == "ip":
        return "", pick(".", ".", " . ").join(str(x) for x in rng.integers(0, 256, 4)), ""
    if kind == "card":
        d = _card(rng, True)
        four = [d[i : i + 4] for i in range(0, 16, 4)]
        return "", pick(d, *(x.join(four) for x in (" ", "-", ".", "  ", "/"))), ""
    if kind == "phone":
        a, b, c = number(3), number(3), number(4)
        return "", pick(f"+1 ({a}) {b}-{c}", f"+{a[:2]} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"{a}.{b}.{c}"), ""
    n = int(rng.integers(20, 45))
    value = pick(drawn(rng, HEX, pick(32, 40, 40, 64)), drawn(rng, ALNUM, n), drawn(rng, HEX, n), drawn(rng, ALNUM + "+/", n) + "=")
    if rng.random() < 0.15:
        return "", pick("sk_live_", "ghp_", "AKIA", "xoxb-", "glpat-") + drawn(rng, ALNUM, n), ""
    word = pick(*SECRET_NAMES)
    word = pick(word, word, word.upper(), f"my_{word}")
    quote = pick('"', '"', "'", "")
    return word + pick(" = ", " = ", "=", ": ", " is ", '": ') + quote, value, quote


def look_alike(rng: np.random.Generator) -> str:
    """Digits, at signs, words and strings that are no personal data."""
    pick = lambda *forms: forms[int(rng.integers(len(forms)))]
    name = lambda: drawn(rng, LOWER, int(rng.integers(2, 9)))
    number = lambda n: drawn(rng, "0123456789", n)
    k = int(rng.integers(14))
    if k == 0:
        return drawn(rng, HEX, int(rng.integers(16, 65)))
    if k == 1:
        return _card(rng, False)
    if k == 2:
        return f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    if k == 3:
        return f"{rng.integers(0, 30)}.{rng.integers(0, 30)}" + f".{rng.integers(0, 30)}" * int(rng.integers(2))
    if k == 4:
        return number(int(rng.integers(1, 9)))
    if k == 5:
        return f"{rng.integers(300, 999)}.{rng.integers(300, 999)}.{rng.integers(0, 99)}"
    if k == 6:
        return f"@{name()}"
    if k == 7:
        return f"{rng.integers(1, 200)},{number(3)}.{number(2)}"
    if k in (8, 9):
        quote = pick('"', "'", "")
        return pick(*HASH_NAMES) + pick(" ", " = ", ": ", "=") + quote + drawn(rng, HEX, pick(32, 40, 64, 24)) + quote
    if k == 10:
        return f"{name()} at {name()} " + pick(f"{name()}.", f"{name()}.com", "dot", f"on {name()}", f"the {name()}")
    if k == 11:
        word = pick(*SECRET_NAMES)
        return word + pick(f" = {name()}", f" of the {name()}", f": {name()} {name()}", f' = "{name()}"', f" {number(2)}")
    if k == 12:
        return "-".join(drawn(rng, HEX, n) for n in (8, 4, 4, 4, 12))
    return f"{name()} dot {name()}"


def labelled_windows(carriers: list[str], n: int = 3000, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of carrier text with identifiers and look-alikes set into them, and their tags."""
    rng = np.random.default_rng(seed)
    bare = (re.sub(r"(?:\S+\s*[=:]\s*)?\S*[0-9@]\S*", "", t).strip() for t in carriers)
    carriers = [c for c in bare if c] or ["plain words of a text without data"]
    ids, tags = np.zeros((n, LESSON), np.uint8), np.zeros((n, LESSON), np.int64)
    for i in range(n):
        c = carriers[int(rng.integers(len(carriers)))]
        text, label, at = "", [], int(rng.integers(max(1, len(c) - LESSON)))
        take = int(rng.integers(0, 50)) * (rng.random() < 0.8)
        while len(text) < LESSON:
            words = c[at : at + take] or " "
            at, take = at + take, int(rng.integers(5, LESSON))
            if text and not text[-1].isspace() and not words[0].isspace():
                words = " " + words
            text, label = text + words, label + [0] * len(words)
            if rng.random() < 0.25:
                continue
            if not words[-1].isspace() and rng.random() < 0.9:
                text, label = text + " ", [*label, 0]
            if rng.random() < 0.6:
                kind = KINDS[int(rng.choice(len(KINDS), p=[0.25, 0.14, 0.14, 0.17, 0.3]))]
                before, found, after = identifier(rng, kind)
                tag = TAGS.index(f"B-{kind}")
                own = [0] * len(before) + [tag] + [tag + 1] * (len(found) - 1) + [0] * len(after)
                part = before + found + after
            else:
                part = look_alike(rng)
                own = [0] * len(part)
            mark = str(rng.choice(["", "", "", ".", ",", "!!", "%%%", ";", ")", "###"])) + (" " if rng.random() < 0.95 else "\n")
            text, label = text + part + mark, label + own + [0] * len(mark)
        if rng.random() < 0.12:
            text = "".join(u if len(u := x.upper()) == 1 else x for x in text)
        ids[i], tags[i] = char_ids(text[:LESSON]), label[:LESSON]
    return ids, tags


# Finding.

#: Characters that two windows share, and the weight of the later one there; the earlier one has the rest.
OVERLAP = WINDOW - STEP
RISING = ((np.arange(OVERLAP) + 1) / (OVERLAP + 1)).astype(np.float32)[:, None]


def merged_emissions(model: Tagger, jobs: list[tuple[np.ndarray, int, int]]) -> list[np.ndarray]:
    """Emissions of each job's characters (all codes of its text, from, to), from all windows that cover them.

    Windows begin at multiples of STEP of the whole text and count as padded to their full length, so a character's emissions
    depend neither on the job nor on other texts. Windows of like lengths run together.
    """
    out = [np.tile(model.p["v"], (b - a, 1)) for _, a, b in jobs]
    windows: list[tuple[int, int, int, bool]] = []
    for k, (codes, a, b) in enumerate(jobs):
        last = max(0, -(-(len(codes) - WINDOW) // STEP)) * STEP
        first = max(0, -(-(a - WINDOW + 1) // STEP)) * STEP
        windows += [(k, s, min(WINDOW, len(codes) - s), s < last) for s in range(first, min(last, b - 1) + 1, STEP)]
    windows.sort(key=lambda w: -w[2])
    for lo in range(0, len(windows), AT_ONCE):
        part = windows[lo : lo + AT_ONCE]
        read = model.read([jobs[k][0][s : s + n] for k, s, n, _ in part])
        for (k, s, n, goes_on), own in zip(part, read, strict=True):
            _, a, b = jobs[k]
            if s:
                own[:OVERLAP] *= RISING
            if goes_on:
                own[STEP:] *= 1 - RISING
            x, y = max(s, a), min(s + n, b)
            if x < y:
                out[k][x - a : y - a] += own[x - s : y - s]
    return out


def open_stretches(gain: np.ndarray) -> list[tuple[int, int]]:
    """Stretches outside of which the best path is O for certain.

    ``gain``: of each character the most that it adds to a path as the first of a span, inside, as the last, and alone.
    Put together they bound what a span from any a to any b adds to the path that is O there, transitions included. A
    character around which no such sum is positive lies in no span of the best path.
    """
    enter, inside, leave, alone = gain.astype(np.float64)
    total = np.cumsum(inside)
    begun = np.maximum.accumulate(enter - total)
    ended = np.maximum.accumulate((leave + total - inside)[::-1])[::-1]
    free = alone >= -1e-3
    free[1:] |= begun[:-1] + ended[1:] >= -1e-3
    free[:-1] |= begun[:-1] + ended[1:] >= -1e-3
    edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tag_spans(path: list[int], at: int) -> list[tuple[str, int, int]]:
    found, start = [], 0
    while start < len(path):
        tag = TAGS[path[start]]
        end = start + 1
        while tag != "O" and end < len(path) and TAGS[path[end]] == f"I-{tag[2:]}":
            end += 1
        if tag != "O":
            found.append((tag[2:], at + start, at + end))
        start = end
    return found


def grouped(jobs: list, chars: int) -> Iterator[list]:
    """Jobs (text number, codes, from, to) in groups of about ``chars`` characters."""
    held, n = [], 0
    for job in jobs:
        held.append(job)
        n += job[3] - job[2]
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def added_spans(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The model's spans of every text, before they are held against the base spans."""
    codes = [char_ids(t) for t in texts]
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    jobs = [(i, c, a, min(a + SLAB, len(c))) for i, c in enumerate(codes) for a in range(0, len(c), SLAB)]
    gains: dict[int, list[np.ndarray]] = {}  # of texts longer than a slab
    ways = model.ways()

    def decoded(stretches: list[tuple[int, int, np.ndarray]]) -> None:
        parts = [(em, a == 0, a + len(em) == len(codes[i])) for i, a, em in stretches]
        for (i, a, _), path in zip(stretches, model.decode_all(parts) if parts else (), strict=True):
            found[i] += tag_spans(path, a)

    for group in grouped(jobs, SLAB):
        stretches = []
        for (i, c, x, y), em in zip(group, merged_emissions(model, [j[1:] for j in group]), strict=True):
            gain = model.gain(em, x == 0, y == len(c), ways)
            if len(c) > SLAB:
                gains.setdefault(i, []).append(gain)
            else:
                stretches += [(i, a, em[a:b]) for a, b in open_stretches(gain)]
        decoded(stretches)
    for i, parts in gains.items():
        again = [(i, codes[i], a, b) for a, b in open_stretches(np.concatenate(parts, axis=1))]
        for group in grouped(again, SLAB):
            ems = merged_emissions(model, [j[1:] for j in group])
            decoded([(i, a, em) for (_, _, a, _), em in zip(group, ems, strict=True)])
    return found


EMAIL_FORM = re.compile(
    r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(]at[\])]|(?<= )at(?= )) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(]dot[\])]|(?<= )dot(?= )) ?[A-Za-z0-9-]+)+",
    re.IGNORECASE,
)
SECRET_FORM = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/.=-]{16,}")
RUN = frozenset(ALNUM + "_+/-")
NUMBER_FORM = re.compile(r"[+(]?[0-9][0-9\s()./-]*[0-9]")


def plausible(kind: str, found: str) -> bool:
    """The check on an added span: the kind's own, on a span with clean ends and no foreign characters."""
    if kind == "email":
        return bool(EMAIL_FORM.fullmatch(found))
    if kind == "secret":
        return bool(SECRET_FORM.fullmatch(found))
    if not NUMBER_FORM.fullmatch(found):
        return False
    if kind == "phone" and len(re.findall(r"[0-9]+", found)) < 3:
        return False
    return valid(kind, found) and (kind != "ip" or "." in found)


def find_all(model: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """Of every text the base spans, and all spans: base and added, by kind as listed and then by start."""
    out = []
    for text, more in zip(texts, added_spans(model, texts), strict=True):
        base = base_spans(text)
        fresh = []
        for kind, a, b in more:
            if kind == "secret":  # to the ends of its run of characters
                while a > 0 and text[a - 1] in RUN:
                    a -= 1
                while b < len(text) and text[b] in RUN:
                    b += 1
            outside = (text[a - 1 : a] if a else "") + text[b : b + 1]
            alone = not any(c.isalnum() or c in "@+" for c in outside)
            met = [(x, y) for _, x, y in base if x < b and a < y]
            free = all(a <= x and y <= b for x, y in met) if kind == "secret" else not met
            if alone and free and plausible(kind, text[a:b]):
                fresh.append((kind, a, b))
        out.append((base, sorted(base + list(dict.fromkeys(fresh)), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


@lru_cache(maxsize=4)
def trained(carriers: tuple[str, ...]) -> Tagger:
    """One training for the same carriers in a session."""
    return train(*labelled_windows(list(carriers)))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carriers: int = CARRIERS) -> Tagger:
    """Train on ``carriers`` texts, those that hash lowest; ``CARRIER_CHARS`` of each, from a place by hash.

    A bound on the hash, from the number of rows, leaves some times ``carriers`` rows before anything is sent, and
    equal texts meet as one, so what reaches the driver depends neither on the partitions nor on copies.
    """
    rows = docs.select(docs[doc_id].alias("k"), docs[text].alias("t")).where(F.col("t").isNotNull())
    share = min(1.0, 4.0 * carriers / max(1, rows.count()))
    h = F.xxhash64("k", "t")
    room = F.greatest(F.length("t") - CARRIER_CHARS, F.lit(1))
    sample = (
        rows.select(h.alias("h"), F.substring("t", F.pmod(h, room).cast("int") + 1, F.lit(CARRIER_CHARS)).alias("t"))
        .where(F.col("h") <= int(-(2**63) + share * (2**64 - 2**11)))
        .groupBy("h")
        .agg(F.min("t").alias("t"))
        .orderBy("h")
        .limit(carriers)
    )
    return trained(tuple(r["t"] for r in sample.collect()))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Tagger | None = None) -> DataFrame:
    """doc_id, base and all spans as arrays of (kind, start, end) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs, doc_id, text))
    kind = docs.schema[doc_id].dataType.simpleString()
    span = "array<struct<kind:string,start:bigint,end:bigint>>"

    def run(batches):
        for b in batches:
            found = find_all(held.value, [t or "" for t in b[text]])
            as_rows = lambda s: [{"kind": k, "start": x, "end": y} for k, x, y in s]
            yield {"doc_id": b[doc_id], "base": [as_rows(x) for x, _ in found], "spans": [as_rows(y) for _, y in found]}

    return map_batches(only(docs, doc_id, text), run, f"doc_id {kind}, base {span}, spans {span}")


def span_digests(found: DataFrame) -> DataFrame:
    """The fixed digest columns, from what ``find_personal_data`` returns; counts are of base spans."""
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda c, kind: F.size(F.filter(c, lambda s: s["kind"] == kind)).cast("long")
    counts = [of("base", k).alias(f"n_{k}") for k in BASE]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), added)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans become [KIND]; overlapping ones become one, of the first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Tagger | None = None) -> DataFrame:
    """The same rows and columns with personal data masked in the text; a column n_chars follows the new text."""
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs, doc_id, text))
    names = docs.columns
    at_text, at_chars = names.index(text), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                part = whole.slice(at, BATCH_ROWS)
                texts = part.column(at_text).to_pylist()
                found = find_all(held.value, [t or "" for t in texts])
                made = [None if t is None else masked(t, s) for t, (_, s) in zip(texts, found, strict=True)]
                columns = list(part.columns)
                columns[at_text] = pa.array(made, type=part.schema.field(at_text).type)
                if at_chars is not None:
                    n = [o if t is None or t == m else len(m) for t, m, o in zip(texts, made, columns[at_chars].to_pylist(), strict=True)]
                    columns[at_chars] = pa.array(n, type=part.schema.field(at_chars).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)

