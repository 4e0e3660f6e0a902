"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained in numpy on labelled spans: those the patterns find in a bounded sample of windows, and written
variants placed into such windows. When texts are scored it reads every character of every line: a line is one window, or
windows of WINDOW characters that overlap by OVERLAP, more than the longest span that it is trained on. Each window is
decoded by Viterbi; windows that are equal are decoded once, and its backward half is left out where the forward half shows
that no span wins. A decoded span is widened to the ends of the words that it cuts, and weighs its log odds against no span
there. Of all windows' spans the set without overlaps that has the largest total weight over the whole text is taken. Spans that
touch a pattern's span, or that `plausible` vetoes, are left out.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textscan
from quarry.llm.common import others

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; for each kind begin, inside
#: Characters of a window of training; of a window of scoring, and of the overlap of two.
TRAINED, WINDOW, OVERLAP = 128, 1024, 128
HIDDEN = 10
#: Bounds of training: documents, those with the smallest hash of their id; windows of each, and written windows.
DOCUMENTS, WINDOWS_EACH, WRITTEN = 400, 3, 4500
EPOCHS, BATCH = 12, 40
#: Added to the log odds that a span begins, as what can't be of its kind is left out afterwards.
LEAN = 2.5
#: The score of a step that can't be.
BARRED = -1e4
#: Characters, padding too, and windows that are decoded at once (what a step works on stays in a processor's own cache); the fewest characters that a span has (a@b.c).
AT_ONCE, ROWS, LEAST = 1 << 19, 1024, 5
#: How far a decoded span is widened to the ends of its words.
REACH = 80

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _parts_ok(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, kind by kind, each in ascending order; linear in the text, whatever it holds."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        done = host.end() if host else at + 1
        if host:
            out.append((0, start, done))
        at = text.find("@", done)
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if _parts_ok(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


_LABELS, _MARKED = r"[A-Za-z0-9-]{1,63}", r"\s?[\[(]\s?{}\s?[\])]\s?"
_MAIL = re.compile(
    rf"[A-Za-z0-9._%+-]{{1,64}}(?:\s?@\s?|{_MARKED.format('at')}){_LABELS}(?:(?:\s?\.\s?|{_MARKED.format('(?:dot|[.])')}){_LABELS}){{1,8}}|[A-Za-z0-9._%+-]{{1,64}}\sat\s{_LABELS}(?:\sdot\s{_LABELS}){{1,8}}"
)
_DOTTED = re.compile(rf"[0-9]{{1,3}}(?:(?:\s?\.\s?|{_MARKED.format('(?:dot|[.])')})[0-9]{{1,3}}){{3}}")
_NUMBER = re.compile(r"[0-9](?:(?:  |[ ./\u00a0-])?[0-9]){12,18}")
_CALL = re.compile(r"(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])(?:[0-9]{2,4}[ .-]){1,3}[0-9]{3,5}")


def plausible(kind: int, text: str) -> bool:
    """A veto on decoded spans: an address has an @ (or at) between names, with a domain; four parts are up to 255; 13 to 19 digits
    pass Luhn; a number to call has 9 to 15 digits in groups."""
    if kind == 0:
        return bool(_MAIL.fullmatch(text))
    if kind == 1:
        return bool(_DOTTED.fullmatch(text)) and all(int(p) <= 255 for p in re.findall("[0-9]+", text))
    digits = _digits(text)
    if kind == 2:
        return bool(_NUMBER.fullmatch(text)) and luhn(digits)
    return bool(_CALL.fullmatch(text)) and 9 <= len(digits) <= 15


def _code_table() -> np.ndarray:
    """Characters as small numbers: 0 beyond the text, printable ASCII its own, white space and what is not ASCII one each."""
    table = np.full(128, 1, np.int64)
    table[32:127] = np.arange(32, 127) - 32 + 3
    table[[9, 10, 11, 12, 13]] = 2
    return table


CODES = 3 + 95 + 1
_ascii = _code_table()


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _ascii[np.minimum(points, 127)], CODES - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """Parameters of the network. Gates stand in the order in, forget, out, candidate."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 5) -> Tagger:
        rng = np.random.Generator(np.random.PCG64(seed))
        h, draw = HIDDEN, lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        p = {}
        for d in "fb":
            p["x" + d], p["u" + d] = draw(CODES, 4 * h), draw(h, 4 * h)
            p["x" + d][:, h : 2 * h] += 1.0  # remember at first
        p |= {"o": draw(2 * h, TAGS), "c": np.zeros(TAGS, np.float32), "t": draw(TAGS, TAGS) * 0.1, "s": np.zeros(TAGS, np.float32)}
        return Tagger(p)

    def _run(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, rows, HIDDEN) of one direction over codes (rows, time)."""
        n, length = x.shape
        h = HIDDEN
        table, u = self.p["x" + way], self.p["u" + way]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out = np.empty((length, n, h), np.float32)
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            z = table[x[:, t]] + state @ u
            gates, new = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            before, old = state, cell
            cell = gates[:, h : 2 * h] * old + gates[:, :h] * new
            wide = np.tanh(cell)
            state = gates[:, 2 * h : 3 * h] * wide
            out[t] = state
            if keep is not None:
                keep.append((t, before, old, gates, new, wide))
        return out

    def emissions(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([self._run(x, "f", keep and keep[0]), self._run(x, "b", keep and keep[1])], axis=2)
        return both @ self.p["o"] + self.p["c"], both

    def fast_emissions(self, x: np.ndarray) -> np.ndarray:
        """The emissions of codes x (rows, time), as (TAGS, time, rows).

        Each gate is an array of its own. All are sigmoids, 1 / (1 + exp(-z)), as exp takes half the time of tanh, and tanh(z) is twice the
        sigmoid of 2 z, less 1: the factors are put into the weights, and half the cell and half the state are what is kept here.
        """
        n, length = x.shape
        h, kind, at = HIDDEN, self.p["o"].dtype, np.ascontiguousarray(x.T, np.int64)
        out = np.empty((length * n, h), kind)
        e = np.repeat(self.p["c"][:, None], length * n, axis=1)
        factors, one = np.array([-1, -1, -1, -2], kind)[:, None, None], kind.type(1)
        for k, way in enumerate("fb"):
            table = np.ascontiguousarray(self.p["x" + way].reshape(-1, 4, h).transpose(1, 0, 2)) * factors
            u = np.ascontiguousarray(self.p["u" + way].reshape(h, 4, h).transpose(1, 0, 2)) * factors * kind.type(2)
            state, cell, wide = np.zeros((n, h), kind), np.zeros((n, h), kind), np.empty((n, h), kind)
            z, looked = np.empty((4, n, h), kind), np.empty((4, n, h), kind)
            into, keep, show, new = z
            with np.errstate(over="ignore"):  # of exp; the sigmoid is 0 then
                for t in range(length) if way == "f" else range(length - 1, -1, -1):
                    np.matmul(state, u, out=z)
                    np.take(table, at[t], axis=1, out=looked, mode="clip")
                    z += looked
                    np.exp(z, out=z)
                    z += one
                    np.divide(one, z, out=z)
                    new -= 0.5
                    new *= into
                    cell *= keep
                    cell += new
                    np.multiply(cell, -4, out=wide)
                    np.exp(wide, out=wide)
                    wide += one
                    np.divide(one, wide, out=wide)
                    wide -= 0.5
                    np.multiply(wide, show, out=state)
                    out[t * n : (t + 1) * n] = state
            e += (self.p["o"][k * h : (k + 1) * h].T * kind.type(2)) @ out.T
        return e.reshape(TAGS, length, n)

    def leaning(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the steps between tags and of the first tag, with LEAN. A span begins with its kind's first tag, after
        outside or at the start, goes on with its kind's second one, and ends before outside; other steps are barred."""
        trans, start = np.full_like(self.p["t"], BARRED), np.full_like(self.p["s"], BARRED)
        start[0], start[1::2] = self.p["s"][0], self.p["s"][1::2] + LEAN
        trans[:, 0], trans[0, 1::2] = self.p["t"][:, 0], self.p["t"][0, 1::2] + LEAN
        begin = np.arange(1, TAGS, 2)
        trans[begin, begin + 1], trans[begin + 1, begin + 1] = self.p["t"][begin, begin + 1], self.p["t"][begin + 1, begin + 1]
        return trans, start

    def beats_outside(self, e: np.ndarray) -> np.ndarray:
        """Which rows of emissions (TAGS, time, rows) have a path that scores above outside all along: the forward half of
        Viterbi, in scores less those of outside."""
        trans, start = self.leaning()
        begin = np.arange(1, TAGS, 2)
        enter, on, more = (x[:, None] - trans[0, 0] for x in (trans[0, begin], trans[begin, begin + 1], trans[begin + 1, begin + 1]))
        short, leave = (x[:, None] - trans[0, 0] for x in (trans[begin, 0], trans[begin + 1, 0]))
        first, rest = e[1::2] - e[0], e[2::2] - e[0]
        out = np.zeros(e.shape[2], e.dtype)
        one, two = first[:, 0] + (start[begin] - start[0])[:, None], np.full_like(first[:, 0], BARRED)
        for t in range(1, e.shape[1]):
            best = np.maximum((one + short).max(axis=0), (two + leave).max(axis=0))
            two += more
            np.maximum(two, one + on, out=two)
            two += rest[:, t]
            one = out + enter
            one += first[:, t]
            out = np.maximum(out, best)
        return np.maximum(out, np.maximum(one, two).max(axis=0)) > 0

    def viterbi(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (rows, time) for emissions (time, rows, TAGS), and how much each place adds to the log odds of its tag against
        outside all along: the scores of its tag and of the step to it, less those of outside."""
        length, n, _ = e.shape
        trans, start = self.leaning()
        score, back = e[0] + start, np.empty((length, n, TAGS), np.int8)
        for t in range(1, length):
            step = score[:, :, None] + trans
            back[t] = step.argmax(axis=1)
            score = np.take_along_axis(step, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + e[t]
        tags, rows = np.empty((n, length), np.int8), np.arange(n)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t][rows, tags[:, t]]
        e, at = e.transpose(1, 0, 2), tags.astype(np.int64)
        margin = np.take_along_axis(e, at[:, :, None], axis=2)[:, :, 0] - e[:, :, 0]
        margin[:, 1:] += trans[at[:, :-1], at[:, 1:]] - trans[0, 0]
        margin[:, 0] += start[at[:, 0]] - start[0]
        return tags, margin

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, tags, margins) of `viterbi` for the rows of codes x (rows, time) whose best path is not outside all along."""
        e = self.fast_emissions(x)
        rows = np.flatnonzero(self.beats_outside(e))
        tags, margin = self.viterbi(e[:, :, rows].transpose(1, 2, 0))
        some = tags.any(axis=1)
        return rows[some], tags[some], margin[some]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags y (rows, time) for codes x, and its gradients."""
        keep: tuple[list, list] = ([], [])
        e, both = self.emissions(x, keep)
        length, n, _ = e.shape
        trans, rows = self.p["t"], np.arange(n)

        steps = np.exp(trans)

        def summed(v: np.ndarray, table: np.ndarray) -> np.ndarray:
            """log(exp(v) @ table) of rows of scores."""
            top = v.max(axis=1, keepdims=True)
            return np.log(np.exp(v - top) @ table) + top

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.p["s"]
        for t in range(1, length):
            alpha[t] = summed(alpha[t - 1], steps) + e[t]
        for t in range(length - 2, -1, -1):
            beta[t] = summed(e[t + 1] + beta[t + 1], steps.T)
        z = summed(alpha[-1], np.ones((TAGS, 1), e.dtype))[:, 0]
        d_e = np.exp(alpha + beta - z[None, :, None])
        top = alpha[:-1].max(axis=2, keepdims=True)
        left, right = np.exp(alpha[:-1] - top), np.exp(e[1:] + beta[1:] - z[None, :, None] + top)
        g = {"s": d_e[0].sum(axis=0), "t": steps * (left.reshape(-1, TAGS).T @ right.reshape(-1, TAGS))}
        g["t"] -= np.bincount((y[:, :-1] * TAGS + y[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        gold = self.p["s"][y[:, 0]] + sum(e[t][rows, y[:, t]] for t in range(length)) + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
        for t in range(length):
            d_e[t][rows, y[:, t]] -= 1
        np.add.at(g["s"], y[:, 0], -1)
        flat = d_e.reshape(-1, TAGS)
        g["o"], g["c"] = both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
        d_both = d_e @ self.p["o"].T
        h = HIDDEN
        places = np.argsort(x.T, axis=None, kind="stable")  # of `every`, code by code
        used, starts = np.unique(x.T.ravel()[places], return_index=True)
        for k, way in enumerate("fb"):
            u = self.p["u" + way]
            every, gu = np.empty((length, n, 4 * h), e.dtype), np.zeros_like(u)
            d_state, d_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, before, old, gates, new, wide in reversed(keep[k]):
                ds = d_state + d_both[t][:, k * h : (k + 1) * h]
                i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                dc = d_cell + ds * o * (1 - wide * wide)
                dz = np.concatenate([dc * new * i * (1 - i), dc * old * f * (1 - f), ds * wide * o * (1 - o), dc * i * (1 - new * new)], axis=1)
                every[t] = dz
                gu += before.T @ dz
                d_state, d_cell = dz @ u.T, dc * f
            gx = np.zeros_like(self.p["x" + way])
            gx[used] = np.add.reduceat(every.reshape(-1, 4 * h)[places], starts)
            g["x" + way], g["u" + way] = gx, gu
        return float((z - gold).mean()), {k: v / n for k, v in g.items()}


def train(examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS) -> Tagger:
    """A tagger from windows of text with their labelled spans, by Adam; the same for the same examples."""
    tagger = Tagger.new()
    if not examples:
        return tagger
    x, y = np.zeros((len(examples), TRAINED), np.int64), np.zeros((len(examples), TRAINED), np.int64)
    for r, (text, spans) in enumerate(examples):
        c = codes(text[:TRAINED])
        x[r, : len(c)] = c
        for kind, a, b in spans:
            y[r, a:b] = 2 + 2 * kind
            if a < TRAINED:
                y[r, a] = 1 + 2 * kind
    mean = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    square = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    step, total = 0, epochs * -(-len(x) // BATCH)
    for epoch in range(epochs):
        order = np.random.Generator(np.random.PCG64(epoch)).permutation(len(x))
        for i in range(0, len(x), BATCH):
            at = order[i : i + BATCH]
            _, g = tagger.gradients(x[at], y[at])
            step += 1
            rate = 0.03 * (1 - step / (total + 1))
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                tagger.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


def _card_number(rng: random.Random, n: int) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _written(rng: random.Random, kind: int) -> str:
    """A made-up item of a kind, in a form drawn from the kind's list, or for kind -1 something that is none."""

    def d(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def w(least: int = 2, most: int = 9) -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most)))

    if kind == 0:
        name = rng.choice([w(1, 3), w(1, 4), w(), w(6, 16), f"{w()}.{w()}", f"{w()}{d(2)}", f"{w()}_{w()}", f"{w()}.{w()}_{d(2)}", f"{w(4)}.{w(4, 14)}_{d(2)}", f"{w(4)}.{w(8, 20)}-{w()}", f"{w(1, 1)}.{w()}+{w()}"])
        top = rng.choice(["com", "org", "net", "example", "co.uk", "info", w(2, 3), w(2, 3), w(2, 5)])
        host = rng.choice([w(2, 4), w(), w(3, 14), f"{w()}.{w()}", f"mail.{w()}-{w()}", f"{w()}-{w()}", f"{w()}{d(1)}", f"{w()}.{w(5, 14)}-{w(4)}"])
        if rng.random() < 0.3:
            name, host, top = w(1, 4), w(2, 6), w(2, 3)
        at, dot = rng.choice([(" @ ", "."), (" @", "."), (" @ ", "."), (" @ ", "."), ("@ ", "."), ("@ ", "."), (" @", "."), (" @", "."), ("@", "."), (" @ ", " . "), (" [at] ", "."), ("[at]", "."), (" (at) ", "."), (" at ", " dot "), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)")])
        return name + at + (host if dot == "." else host.replace(".", dot)) + dot + (top if dot == "." else top.replace(".", dot))
    if kind == 1:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice([".", "[.]", "[.]", " . ", " [.] ", "[dot]", "(dot)", " [dot] "]).join(parts)
    if kind == 2:
        n = rng.choice([13, 14, 15, 15, 16, 16, 16, 17, 18, 19])
        c, sep = _card_number(rng, n), rng.choice(["", "", " ", "-", "-", ".", ".", ".", "/", "  ", "\u00a0"])
        return sep.join(c[i : i + 4] for i in range(0, n, 4))
    if kind == 3:
        s = rng.choice(" -.")
        return rng.choice([
            f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}{s}{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"{d(3)}.{d(3)}.{d(4)}",
            f"0{d(3)}{s}{d(3)}{s}{d(4)}", f"00{d(2)}{s}{d(3)}{s}{d(4)}", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"{d(2)}{s}{d(4)}{s}{d(4)}",
        ])
    return rng.choice([
        d(rng.randint(1, 9)), d(16), d(20), d(40), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(1)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"v{d(1)}.{d(1)}.{d(2)}",
        f"{d(1)}.{d(1)}.{d(2)}", f"{d(3)}-{d(2)}", f"{rng.randint(256, 999)}.{d(3)}.{d(2)}.{d(3)}", f"{w()}@", f"@{w()}", f"#{d(5)}", f"{d(4)} {d(4)}", f"{d(2)}/{d(2)}/{d(4)}", f"[{d(2)}]", "".join(rng.choice("0123456789abcdef") for _ in range(24)),
        f"{d(2)} {d(3)} {d(3)} {d(2)}", f"{d(1)} {d(3)} {d(3)}", f"{d(3)} {d(3)} {d(3)} {d(3)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}", f"{w()} at {w()}.{w(2, 3)}", f"{w()} at {w()} dot", f"{w()} at {w()} {w()}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(8)}", f"{d(10)}",
        f"{w()} @ {w()} {w()}", f"{w()} @ {w()}. {w().capitalize()} {w()}", f"@ {w()}.", f"{w()} @ {d(2)}.{d(2)}", f"{d(4)}-{d(4)}", f"{d(3)} {d(3)}",
    ])


def written_examples(contexts: list[str], count: int = WRITTEN, seed: int = 9) -> list[tuple[str, list[Span]]]:
    """Windows of context with made-up items put in, labelled."""
    rng = random.Random(seed)
    out = []
    for k in range(count):
        context = contexts[rng.randrange(len(contexts))] if contexts else "the of and it was " * 6
        text = context[: rng.randint(0, 60)]
        spans = base_spans(text)
        for _ in range(rng.randint(1, 2)):
            kind = (-1, 0, 0, 0, 1, 2, 3, 3)[k % 8] if rng.random() < 0.8 else rng.randrange(-1, 4)
            item = _written(rng, kind)
            text += rng.choice([" ", " ", " ", " (", "\n", ", ", ": ", " | ", "="])
            if kind >= 0:
                spans.append((kind, len(text), len(text) + len(item)))
            text += item + rng.choice([" ", " ", " ", ". ", ") ", ", ", "\n", " | "])
        text += context[60 : 60 + max(0, TRAINED - len(text))]
        known = set(spans)
        clear = [s for s in base_spans(text) if not any(s[1] < b and a < s[2] for _, a, b in known)]
        out.append((text[:TRAINED], [(q, a, min(b, TRAINED)) for q, a, b in [*spans, *clear] if a < TRAINED]))
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (doc_id, text) some windows: around the first pattern spans and at places drawn by the id."""
    for batch in batches:
        out = []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text, rng = value or "", random.Random(key or 0)
            near = [max(0, s - rng.randint(0, 60)) for _, s, _ in base_spans(text)[: WINDOWS_EACH - 1]]
            starts = near + [rng.randrange(max(1, len(text) - TRAINED)) for _ in range(WINDOWS_EACH - len(near))]
            out += [text[s : s + TRAINED] for s in starts]
        yield pa.RecordBatch.from_pydict({"window": pa.array(out, pa.string())})


def fit(docs: DataFrame) -> Tagger:
    """A tagger from docs (doc_id, text). Training reads at most DOCUMENTS documents and WINDOWS_EACH windows of each."""
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = keyed.select(F.col("doc_id").alias("i")).orderBy(F.xxhash64("i", F.lit(4)), "i").limit(DOCUMENTS)
    rows = keyed.join(F.broadcast(chosen), F.col("doc_id") == F.col("i")).select("doc_id", "text")  # DOCUMENTS numbers
    windows = sorted(rows.mapInArrow(_sampled, "window string").toArrow()["window"].to_pylist())
    found = [(w, base_spans(w)) for w in windows]
    return train(found + written_examples([w for w, s in found if not s]))


def _choose(found: list[tuple[float, int, int, int]]) -> list[Span]:
    """Of (score, kind, start, end) the spans without overlaps whose scores have the largest sum."""
    found = sorted(set(found), key=lambda s: (s[3], s[2], s[1]))
    best: list[tuple[float, int]] = [(0.0, -1)]  # of the first i spans: the sum, and the last one taken
    ends = [s[3] for s in found]
    for i, (score, _, start, _) in enumerate(found):
        before = int(np.searchsorted(ends[:i], start, "right"))
        take = best[before][0] + score
        best.append((take, i) if take > best[i][0] else (best[i][0], -1))
    out, i = [], len(found)
    while i > 0:
        if best[i][1] >= 0:
            _, kind, start, end = found[i - 1]
            out.append((kind, start, end))
            i = int(np.searchsorted(ends[: i - 1], start, "right"))
        else:
            i -= 1
    return out


def windows_of(text: str) -> Iterator[tuple[int, int, bool, bool]]:
    """(first, end, cut before, cut after) of all windows: each line, or equal parts of it that overlap by OVERLAP, WINDOW characters
    at most. Only lines too short for any span have none."""
    first = 0
    while first <= len(text):
        end = text.find("\n", first)
        end = len(text) if end < 0 else end
        size = end - first
        if size > WINDOW:
            k = -(-(size - OVERLAP) // (WINDOW - OVERLAP))
            length = -(-(size + OVERLAP * (k - 1)) // k)
            for i in range(k):
                a = min(first + i * (length - OVERLAP), end - length)
                yield a, a + length, i > 0, i < k - 1
        elif size >= LEAST:
            yield first, end, False, False
        first = end + 1


def _spans_of(tags: np.ndarray, margin: np.ndarray, first: int, size: int) -> list[tuple[float, int, int, int]]:
    """Spans of one window of `size` characters that starts at `first`, with their log odds against no span there."""
    out, t = [], 0
    while t < size:
        tag = int(tags[t])
        if tag:
            kind, end = (tag - 1) // 2, t + 1
            while end < size and tags[end] == 2 + 2 * kind:
                end += 1
            leave = float(margin[end]) if end < size and tags[end] == 0 else 0.0
            out.append((float(margin[t:end].sum()) + leave, kind, first + t, first + end))
            t = end
        else:
            t += 1
    return out


def settled(kind: int, text: str, start: int, end: int) -> tuple[int, int]:
    """The ends of a decoded span, widened to those of the words that it cuts (of an address: of its name and host) and
    without white space and marks around it. One that would be widened by more than REACH is left as it is."""
    low, high = start, end
    while low < high and text[low] not in (_LOCAL if kind == 0 else "0123456789(+"):
        low += 1
    while high > low and not (text[high - 1].isalnum() if kind == 0 else text[high - 1] in "0123456789"):
        high -= 1
    if low == high:
        return start, end
    inside = _LOCAL if kind == 0 else "0123456789"
    if text[low] in inside:
        while low > 0 and start - low < REACH and text[low - 1] in inside:
            low -= 1
    while high < len(text) and high - end < REACH:
        if not (text[high] in inside and text[high] not in "._%+") and not (kind == 0 and text[high] == "." and text[high + 1 : high + 2].isalnum()):
            break
        high += 1
    if kind == 3 and low > 0 and text[low - 1] == "(" and ")" in text[low:high]:
        low -= 1
    return (low, high) if start - low < REACH and high - end < REACH else (start, end)


class Finder:
    """Spans of texts: patterns and tagger."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        self.vetoed = 0

    def decoded(self, texts: list[str]) -> list[list[tuple[float, int, int, int]]]:
        """For each text (log odds, kind, start, end) of the spans decoded in its windows. Equal windows are decoded once, and
        windows of about the same length together."""
        places: dict[str, list[tuple[int, int, bool, bool]]] = {}
        for k, text in enumerate(texts):
            for first, end, before, after in windows_of(text):
                places.setdefault(text[first:end], []).append((k, first, before, after))
        found: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
        windows = sorted(places, key=len)
        i = 0
        while i < len(windows):
            # all that fit, by the longest of them
            j = i + 1
            while j < min(len(windows), i + ROWS) and (j + 1 - i) * len(windows[j]) <= AT_ONCE and len(windows[j]) <= len(windows[i]) + 64:
                j += 1
            some, length = windows[i:j], len(windows[j - 1])
            x = np.zeros((len(some), length), np.int16)
            at = np.cumsum([0, *map(len, some)])
            flat = codes("".join(some))
            for r, w in enumerate(some):
                x[r, : len(w)] = flat[at[r] : at[r + 1]]
            rows, tags, margin = self.tagger.decode(x)
            for r, t, m in zip(rows.tolist(), tags, margin, strict=True):
                size = len(some[r])
                spans = _spans_of(t, m, 0, size)
                for k, first, before, after in places[some[r]]:
                    # one that touches an inner edge is whole in the neighbour
                    found[k] += [(odds, kind, first + a, first + b) for odds, kind, a, b in spans if not (before and a == 0) and not (after and b == size)]
            i = j
        return found

    def added(self, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """For each text the spans that the tagger adds to the base spans."""
        out = []
        for text, spans, found in zip(texts, base, self.decoded(texts), strict=True):
            if not found:
                out.append([])
                continue
            taken = sorted((a, b) for _, a, b in spans)
            starts, tops = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
            fit = []
            for odds, kind, a, b in found:
                a, b = settled(kind, text, a, b)
                before = bisect_left(starts, b)
                if odds <= 0 or (before and tops[before - 1] > a):
                    continue
                if plausible(kind, text[a:b]):
                    fit.append((odds, kind, a, b))
                else:
                    self.vetoed += 1
            out.append(_choose(fit) if fit else [])
        return out

    def spans(self, texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
        base = [base_spans(t) for t in texts]
        return base, self.added(texts, base)


def rendered(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its (first) kind in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


FOUND = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def _pass(batches: Iterator[pa.RecordBatch], finder, at: int, redact: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textscan.pieces(whole, at):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            base, added = finder().spans(texts)
            if redact:
                value = pa.array([None if t is None else redacted(t, b + a) for t, b, a in zip(batch.column(at).to_pylist(), base, added, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([value if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
                continue
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([sha256(rendered(b).encode()).hexdigest() for b in base])
            every = pa.array([rendered(b + a) for b, a in zip(base, added, strict=True)], pa.string())
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, *counts, digest, every], names=[*(n for i, n in enumerate(batch.schema.names) if i != at), *FOUND])


def _apply(docs: DataFrame, tagger: Tagger, redact: bool) -> DataFrame:
    rows = docs if redact else docs.select(*others(docs, FOUND))
    at = rows.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(tagger.p)  # some thousands of numbers
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if redact or f.name != "text"]
    more = [] if redact else ["n_email bigint", "n_ip bigint", "n_card bigint", "n_phone bigint", "base_sha256 string", "spans string"]
    return rows.mapInArrow(lambda batches: _pass(batches, lambda: Finder(Tagger(shared.value)), at, redact), ", ".join(names + more))


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs without text, with counts of base spans by kind, the SHA-256 of the base spans, and all spans (kind:start:end,
    by kind and start, code points). Null texts count as empty: counts of 0 and no spans. Rows stay where they are; equal
    texts have equal spans, very long texts are read whole, an empty table gives no rows, and other columns pass through,
    but for those named like the results (in any case)."""
    return _apply(docs, tagger, redact=False)


def redact(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; a null text stays null. Of overlapping spans the first
    names the kind. Repeated rows stay repeated, an empty table stays empty, and all other columns are as they were."""
    return _apply(docs, tagger, redact=True)
