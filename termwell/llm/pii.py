"""Personal data: patterns, and a character tagger that learns from them to find other notations.

Four kinds of spans are found by their patterns: e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone
numbers. A bidirectional LSTM over characters with a conditional random field over its tags, both
written in numpy, is trained on a sample of these labelled spans, also rewritten into notations that the patterns
miss (spaced or bracketed signs, phone numbers without plus, cards in dotted groups), and on windows that hold
other numbers. It then reads every text in overlapping windows. A window is decoded by Viterbi; the
spans of all windows of a text are reconciled together: a span that a window's border cuts gives way to a whole one or joins
its other half, and of spans that still overlap the set of highest total confidence stays. Spans that
overlap a pattern's are dropped, so the tagger only adds.

A tagger's span must be sound: an address holds an ``@``, an IP four numbers up to 255, a card 14 to 19 digits of a right
check sum, a phone number 7 to 15 digits. Windows that hold neither an ``@`` nor ``LEAST_DIGITS`` digits cannot have one and are
passed over; every other place of every text, however long, is read, ``BATCH`` windows at a time.

The sample has at most ``PER_KIND`` windows of each kind and as many without any, drawn by a hash of their content. With
fewer than ``LEAST_SPANS`` labelled spans there is no tagger, and the patterns' spans are the result.

``with_pii`` adds ``pii``, an array of (kind, start, end, base, confidence) in code points, end exclusive, ordered
by start and kind. ``without_pii`` replaces the spans by their kinds.

Defined cases: null and empty texts have no spans; repeated rows and equal texts get equal spans; spans of different
patterns may overlap and all stay; an empty table gives an empty result; a column ``pii`` is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termwell.llm.common import read_table, stored
from termwell.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 96, 48
HIDDEN = 24
BATCH = 512
PER_KIND = 400
LEAST_SPANS = 8
LEAST_DIGITS = 4
STEPS = 300
STEP_WINDOWS = 64
RATE = 0.012
CONFIDENT = 0.9
SEED = 13

# ---- patterns -----------------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """The check sum of payment cards."""
    values = [int(d) for d in reversed(digits)]
    return sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(values)) % 10 == 0


def _emails(text: str):
    """Signs are looked up and addresses grown to both sides, so long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        match = _DOMAIN.match(text, at)
        low = at
        if match:
            while low > done and text[low - 1] in _LOCAL:
                low -= 1
        if low < at:
            done = match.end()
            yield low, done
        at = text.find("@", max(at + 1, done))


def _addresses(text: str):
    for chain in _NUMBERS.finditer(text):
        places = [m.span() for m in re.finditer("[0-9]+", chain[0])]
        for k in range(0, len(places) - 3, 4):
            four = places[k:k + 4]
            if all(len(part := chain[0][a:b].lstrip("0")) < 4 and int(part or 0) < 256 for a, b in four):
                yield chain.start() + four[0][0], chain.start() + four[3][1]


def _cards(text: str, failing: bool = False):
    """Card numbers; with ``failing`` those of a right length whose check sum is wrong."""
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits) is not failing:
            yield match.span()


def _phones(text: str):
    for match in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(match[0])) <= 15:
            yield match.span()


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of all patterns, in order; kinds are numbers of ``KINDS``."""
    return sorted((start, kind, end) for kind, find in enumerate((_emails, _addresses, _cards, _phones)) for start, end in find(text))


# ---- tagger -------------------------------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
PAD, SYMBOLS = 97, 98
_SYMBOL = np.full(128, 95, np.int64)  # control characters
_SYMBOL[32:127] = np.arange(95)
_FORBIDDEN = np.zeros((TAGS, TAGS))
for _tag in range(2, TAGS, 2):  # inside follows begin or inside of its kind; a window may begin inside
    _FORBIDDEN[:, _tag] = -1e4
    _FORBIDDEN[_tag - 1, _tag] = _FORBIDDEN[_tag, _tag] = 0


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _symbols(points: np.ndarray) -> np.ndarray:
    return np.where(points < 128, _SYMBOL[np.minimum(points, 127)], 96)


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


@dataclass
class Tagger:
    """Weights: per direction input, recurrent and bias; output; transitions, first and last tag."""

    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    step: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @staticmethod
    def fresh(rng: np.random.Generator, hidden: int = HIDDEN) -> Tagger:
        def normal(scale, *shape):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        bias = np.zeros((2, 1, 4 * hidden), np.float32)
        bias[:, :, hidden:2 * hidden] = 1  # remember at first
        return Tagger(normal(0.3, 2, SYMBOLS, 4 * hidden), normal(hidden ** -0.5, 2, hidden, 4 * hidden), bias,
                      normal((2 * hidden) ** -0.5, 2 * hidden, TAGS), np.zeros(TAGS, np.float32),
                      np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32), np.zeros(TAGS, np.float32))

    def emissions(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Scores (window, place, tag); ``keep`` receives what the gradient needs."""
        n, width = x.shape
        size = self.wh.shape[1]
        h, c = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32)
        states = np.empty((width, 2, n, size), np.float32)
        for t in range(width):
            z = np.stack((self.wx[0][x[:, t]], self.wx[1][x[:, width - 1 - t]])) + h @ self.wh + self.b
            gates = 1 / (1 + np.exp(-np.clip(z[..., :3 * size], -30, 30)))  # in, forget, out
            cell = np.tanh(z[..., 3 * size:])
            before = c
            c = gates[..., size:2 * size] * c + gates[..., :size] * cell
            bent = np.tanh(c)
            if keep is not None:
                keep.append((gates, cell, before, bent, h))
            h = gates[..., 2 * size:] * bent
            states[t] = h
        both = np.concatenate((states[:, 0], states[::-1, 1]), axis=-1).transpose(1, 0, 2)
        if keep is not None:
            keep.append(both)
        return both @ self.wo + self.bo

    def _alphas(self, e: np.ndarray, step: np.ndarray) -> np.ndarray:
        alpha = np.empty_like(e)
        alpha[:, 0] = e[:, 0] + self.first
        for t in range(1, e.shape[1]):
            alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + step, 1) + e[:, t]
        return alpha

    def _betas(self, e: np.ndarray, step: np.ndarray) -> np.ndarray:
        beta = np.empty_like(e)
        beta[:, -1] = self.last
        for t in range(e.shape[1] - 2, -1, -1):
            beta[:, t] = _log_sum(step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        return beta

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """The probability of each tag at each place."""
        e, step = e.astype(np.float64), self.step + _FORBIDDEN
        alpha, beta = self._alphas(e, step), self._betas(e, step)
        return np.exp(alpha + beta - _log_sum(alpha[:, -1] + self.last, 1)[:, None, None])

    def best(self, e: np.ndarray) -> np.ndarray:
        """The likeliest tags of each window."""
        n, width, _ = e.shape
        step = (self.step + _FORBIDDEN).astype(np.float32)
        score, back = e[:, 0] + self.first, np.empty((width, n, TAGS), np.int8)
        for t in range(1, width):
            ways = score[:, :, None] + step
            back[t] = ways.argmax(axis=1)
            score = ways.max(axis=1) + e[:, t]
        tags = np.empty((n, width), np.int64)
        tags[:, -1] = (score + self.last).argmax(axis=1)
        for t in range(width - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags

    def gradient(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradient by all weights."""
        keep: list = []
        e = self.emissions(x, keep).astype(np.float64)
        both = keep.pop()
        n, width = x.shape
        step = self.step + _FORBIDDEN
        alpha, beta = self._alphas(e, step), self._betas(e, step)
        whole = _log_sum(alpha[:, -1] + self.last, 1)
        rows, places = np.arange(n)[:, None], np.arange(width)[None]
        path = e[rows, places, tags].sum() + step[tags[:, :-1], tags[:, 1:]].sum() + self.first[tags[:, 0]].sum() + self.last[tags[:, -1]].sum()
        de = np.exp(alpha + beta - whole[:, None, None])
        pairs = np.exp(alpha[:, :-1, :, None] + step + (e + beta)[:, 1:, None, :] - whole[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(pairs, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        first, last = de[:, 0].sum(axis=0), de[:, -1].sum(axis=0)
        np.subtract.at(first, tags[:, 0], 1)
        np.subtract.at(last, tags[:, -1], 1)
        de[rows, places, tags] -= 1
        de = de.astype(np.float32)
        dboth = de @ self.wo.T
        size = self.wh.shape[1]
        dwx, dwh, db = np.zeros_like(self.wx), np.zeros_like(self.wh), np.zeros_like(self.b)
        dh, dc = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32)
        for t in range(width - 1, -1, -1):
            gates, cell, before, bent, h = keep[t]
            dh = dh + np.stack((dboth[:, t, :size], dboth[:, width - 1 - t, size:]))
            dc = dc + dh * gates[..., 2 * size:] * (1 - bent * bent)
            dgates = np.concatenate((dc * cell, dc * before, dh * bent), axis=-1) * gates * (1 - gates)
            dz = np.concatenate((dgates, dc * gates[..., :size] * (1 - cell * cell)), axis=-1)
            np.add.at(dwx[0], x[:, t], dz[0])
            np.add.at(dwx[1], x[:, width - 1 - t], dz[1])
            dwh += h.transpose(0, 2, 1) @ dz
            db += dz.sum(axis=1, keepdims=True)
            dh, dc = dz @ self.wh.transpose(0, 2, 1), dc * gates[..., size:2 * size]
        flat = both.reshape(-1, 2 * size)
        grads = [dwx, dwh, db, flat.T @ de.reshape(-1, TAGS), de.sum(axis=(0, 1)), pairs, first, last]
        return float(whole.sum() - path) / n, [np.asarray(g, np.float32) / n for g in grads]

    def weights(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.b, self.wo, self.bo, self.step, self.first, self.last]


def trained(x: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Tagger:
    """A tagger fitted by Adam on batches drawn from the windows; the same for the same windows in order."""
    rng = np.random.default_rng(seed)
    tagger = Tagger.fresh(rng)
    weights = tagger.weights()
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(STEP_WINDOWS, len(x)):
            order = np.r_[order, rng.permutation(len(x))]
        drawn, order = order[:STEP_WINDOWS], order[STEP_WINDOWS:]
        _, grads = tagger.gradient(x[drawn], tags[drawn])
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, s in zip(weights, grads, mean, square, strict=True):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return tagger


# ---- labelled windows ---------------------------------------------------------------------------------------------------


def _hash(text: str) -> int:
    value = 2166136261
    for char in text:
        value = (value ^ ord(char)) * 16777619 % (1 << 32)
    return value


def _around(text: str, start: int, end: int) -> int:
    """Where a window begins that shows the span at a place given by its content."""
    room = max(1, WIDTH - (end - start))
    return max(0, min(start - _hash(text[start:end] + text[max(0, start - 8):start]) % room, max(0, len(text) - WIDTH)))


def labelled_windows(texts) -> list[tuple[str, str, list[tuple[int, int, int]]]]:
    """Windows (kind, text, spans) around every pattern's span, and such as hold digits outside of all spans."""
    out = []
    for text in texts:
        spans = pattern_spans(text)
        failing = sorted(_cards(text, failing=True))
        taken = sorted([(a, b) for a, _, b in spans] + failing)
        begins = [(KINDS[kind], _around(text, start, end)) for start, kind, end in spans if end - start <= WIDTH]
        last = -WIDTH
        for match in _DIGITS.finditer(text):
            if match.start() >= last + WIDTH:
                last = _around(text, match.start(), match.end())
                begins.append(("none", last))
        for kind, low in begins:
            high = low + WIDTH
            near = [s for s in taken[bisect_left(taken, (low - 4 * WIDTH,)):bisect_left(taken, (high,))] if s[1] > low]
            if any(s in near for s in failing) or (kind == "none" and near):
                continue  # a number that only its check sum tells from a card teaches nothing
            some = spans[bisect_left(spans, (low - 4 * WIDTH,)):bisect_left(spans, (high,))]
            inside = [(max(a, low) - low, number, min(b, high) - low) for a, number, b in some if b > low]
            out.append((kind, text[low:high], inside))
    return out


def _tags(spans: list[tuple[int, int, int]], size: int) -> np.ndarray:
    """Tags of a window; where patterns overlap the first span counts. A span from place 0 may be cut there and begins all the same."""
    tags, end = np.zeros(size, np.int64), 0
    for a, kind, b in sorted(spans):
        if a >= end:
            tags[a] = 1 + 2 * kind
            tags[a + 1:b] = 2 + 2 * kind
            end = b
    return tags


def rewritten(kind: int, span: str, pick: int) -> str:
    """The same datum in a notation that the patterns miss."""
    if kind == 0:
        return [span.replace("@", " @ "), span.replace("@", "[@]").replace(".", "[.]"), span.replace("@", "@ "),
                span.replace("@", "(@)")][pick % 4]
    if kind == 1:
        return [span.replace(".", "[.]"), span.replace(".", " . "), span.replace(".", "(.)")][pick % 3]
    digits = "".join(_DIGITS.findall(span))
    if kind == 2:
        fours = [digits[k:k + 4] for k in range(0, len(digits), 4)]
        return [".".join(fours), "  ".join(fours), " - ".join(fours), "/".join(fours)][pick % 4]
    return [span[1:], "00" + span[1:], span.split(" ", 1)[-1], "(+" + span[1:].replace(" ", ") ", 1), span[1:].replace("-", " ")][pick % 5]


def _other_number(rng: np.random.Generator) -> str:
    """Numbers of everyday texts that are no personal data."""
    a, b, c, d = rng.integers(1, 9999, 4).tolist()
    return [f"{1900 + a % 130}-{b % 12 + 1:02}-{c % 28 + 1:02}", f"{a % 24:02}:{b % 60:02}:{c % 60:02}", f"${a},{b % 1000:03}.{c % 100:02}",
            f"v{a % 20}.{b % 30}.{c % 99}", f"{a}", f"{a % 100}.{b % 10} %", f"ISBN 978-{a % 10}-{b:04}-{c:04}-{d % 10}", f"{a % 31 + 1}/{b % 12 + 1}/{1900 + c % 130}",
            f"{a:x}{b:x}{c:x}{d:x}{a * b:x}", f"#{a}{b}", f"{a}-{b}", f"{a % 400} {b % 90} {c % 90}", f"{a % 90}.{b % 90} km", f"pp. {a}-{a + b % 40}"][int(rng.integers(14))]


def training_set(windows: list[tuple[str, str, list[tuple[int, int, int]]]], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of the windows, of copies with spans rewritten, and of windows with other numbers put in."""
    rng = np.random.default_rng(seed)
    made = []
    for kind, text, spans in windows:
        made.append((text, _tags(spans, len(text))))
        if spans:
            text2, tags2, at = "", [], 0
            for a, number, b in sorted(spans):
                if a < at:
                    continue
                whole = (number, text[a:b], 0 < a and b < len(text))
                new = rewritten(whole[0], whole[1], int(rng.integers(60))) if whole[2] else whole[1]
                text2 += text[at:a] + new
                tags2 += [0] * (a - at) + [1 + 2 * number] + [2 + 2 * number] * (len(new) - 1)
                at = b
            text2, tags2 = text2 + text[at:], np.array(tags2 + [0] * (len(text) - at))
            shift = max(0, min(len(text2) - WIDTH, int(rng.integers(WIDTH))))
            made.append((text2[shift:shift + WIDTH], tags2[shift:shift + WIDTH]))
        words = [m.start() for m in re.finditer(" ", text)]
        if kind == "none" or not words or rng.random() < 0.5:
            other = " " + _other_number(rng)
            tags = _tags(spans, len(text))
            free = [w for w in words if tags[w] == 0 and (w + 1 >= len(text) or tags[w + 1] % 2 == 1 or tags[w + 1] == 0)]
            at = free[int(rng.integers(len(free)))] if free else 0 if not len(text) or tags[0] == 0 else None
            if at is not None:
                made.append((text[:at] + other + text[at:], np.r_[tags[:at], np.zeros(len(other), np.int64), tags[at:]]))
    x, y = np.full((len(made), WIDTH), PAD, np.int64), np.zeros((len(made), WIDTH), np.int64)
    for k, (text, tags) in enumerate(made):
        size = min(WIDTH, len(text))
        x[k, :size], y[k, :size] = _symbols(_points(text))[:size], tags[:size]
    for start in range(0, WIDTH):  # a window cut inside a span begins with it
        cut = (y[:, start] % 2 == 0) & (y[:, start] > 0) & (y[:, start - 1] == 0 if start else True)
        y[cut, start] -= 1
    return x, y


def fit_tagger(docs: DataFrame, text: str = "text", per_kind: int = PER_KIND, steps: int = STEPS) -> Tagger | None:
    """Train on a bounded sample of windows around the patterns' spans in all texts."""

    def windows(batches):
        for batch in batches:
            texts = batch.column(0)
            texts = texts.filter(pc.match_substring_regex(texts, "[0-9@]"))
            for value in texts:
                found = labelled_windows([value.as_py()])
                if found:
                    yield pa.record_batch({"kind": [f[0] for f in found], "window": [f[1] for f in found], "spans": [
                        ",".join(f"{a}:{kind}:{b}" for a, kind, b in f[2]) for f in found]})

    rows = docs.select(F.coalesce(F.col(text), F.lit(""))).mapInArrow(windows, "kind string, window string, spans string")
    order = W.partitionBy("kind").orderBy(F.xxhash64("window", "spans"), "window", "spans")
    drawn = stored(rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_kind).drop("place"), "pii-windows")
    sample = sorted(tuple(r) for r in drawn.collect())
    if sum(kind != "none" for kind, _, _ in sample) < LEAST_SPANS:
        return None
    parsed = [(kind, window, [tuple(map(int, s.split(":"))) for s in spans.split(",") if s]) for kind, window, spans in sample]
    return trained(*training_set(parsed), steps)


# ---- reading whole texts ------------------------------------------------------------------------------------------------


def _window_starts(points: np.ndarray) -> np.ndarray:
    """Windows of the grid that hold a sign or digits enough."""
    digit = (points >= 48) & (points <= 57)
    if not (digit.sum() >= LEAST_DIGITS or (points == 64).any()):
        return np.zeros(0, np.int64)
    starts = np.arange(0, max(1, len(points) - STRIDE), STRIDE)
    ends = np.minimum(starts + WIDTH, len(points))
    digits, signs = np.r_[0, np.cumsum(digit)], np.r_[0, np.cumsum(points == 64)]
    return starts[(digits[ends] - digits[starts] >= LEAST_DIGITS) | (signs[ends] > signs[starts])]


def decoded(tagger: Tagger, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """Spans (start, kind, end, confidence) of each window."""
    e = tagger.emissions(x)
    tags = tagger.best(e)
    out: list[list] = [[] for _ in range(len(x))]
    some = np.flatnonzero(tags.any(axis=1))
    if not len(some):
        return out
    chance = tagger.marginals(e[some])
    for row, k in enumerate(some.tolist()):
        line = tags[k]
        opens = np.flatnonzero((line % 2 == 1) | ((line > 0) & (np.r_[0, line[:-1]] == 0)))
        for a in opens.tolist():
            kind, b = (int(line[a]) - 1) // 2, a + 1
            while b < len(line) and line[b] == 2 + 2 * kind:
                b += 1
            sure = chance[row, a:b, 1 + 2 * kind:3 + 2 * kind].sum(axis=1).mean()
            out[k].append((a, kind, b, float(sure)))
    return out


def reconciled(found: list[tuple[int, int, int, float, bool]], fixed: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """One set of spans of all windows' spans (start, kind, end, confidence, cut by a border), beside the fixed ones."""
    whole = sorted({s[:4] for s in found if not s[4]})
    starts, reach = [s[0] for s in whole], np.maximum.accumulate([s[2] for s in whole]).tolist() if whole else []

    def meets(a: int, b: int) -> bool:
        k = bisect_right(starts, b - 1)
        return k > 0 and reach[k - 1] > a

    joined: list[list] = []
    for a, kind, b, sure, _ in sorted(s for s in found if s[4] and not meets(s[0], s[2])):
        if joined and joined[-1][1] == kind and a <= joined[-1][2]:
            joined[-1][2], joined[-1][3] = max(b, joined[-1][2]), max(sure, joined[-1][3])
        else:
            joined.append([a, kind, b, sure])
    fixed = sorted((a, b) for a, _, b in fixed)
    tops = np.maximum.accumulate([b for _, b in fixed]).tolist() if fixed else []

    def free(a: int, b: int) -> bool:
        k = bisect_right(fixed, (b - 1, 1 << 62))
        return k == 0 or tops[k - 1] <= a

    spans = sorted((s for s in {*whole, *map(tuple, joined)} if s[3] >= CONFIDENT and free(s[0], s[2])), key=lambda s: (s[2], s[0], s[1]))
    ends, best = [s[2] for s in spans], [(0.0, -1, False)]  # best total of the first k spans
    for k, (a, _, _, sure) in enumerate(spans):
        before = bisect_right(ends, a, 0, k)
        total = best[before][0] + sure
        best.append((total, before, True) if total > best[k][0] else (best[k][0], k, False))
    kept, k = [], len(spans)
    while k > 0:
        if best[k][2]:
            kept.append(spans[k - 1])
        k = best[k][1]
    return kept[::-1]


def _sound(text: str, kind: int, a: int, b: int) -> bool:
    """What holds for a kind in any notation."""
    numbers = re.findall("[0-9]+", text[a:b])
    digits = "".join(numbers)
    if kind == 0:
        return "@" in text[a:b]
    if kind == 1:
        return len(numbers) == 4 and all(len(n) < 4 and int(n) < 256 for n in numbers)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def scanned(tagger: Tagger | None, texts: list[str]) -> list[list[tuple[int, int, int, bool, float]]]:
    """All spans (start, kind, end, by a pattern, confidence) of each text."""
    base = [pattern_spans(text) for text in texts]
    found: list[list] = [[] for _ in texts]
    waiting: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        x = np.full((len(waiting), WIDTH), PAD, np.int64)
        for k, (_, _, symbols) in enumerate(waiting):
            x[k, :len(symbols)] = symbols
        for (number, low, _), spans in zip(waiting, decoded(tagger, x), strict=True):
            size = len(texts[number])
            for a, kind, b, sure in spans:
                a, b = low + a, min(low + b, size)
                cut = (a == low > 0) or (b == low + WIDTH < size)
                if a < b and _sound(texts[number], kind, a, b):
                    found[number].append((a, kind, b, sure, cut))
        waiting.clear()

    if tagger is not None:
        for number, text in enumerate(texts):
            points = _points(text)
            for low in _window_starts(points).tolist():
                waiting.append((number, low, _symbols(points[low:low + WIDTH])))
                if len(waiting) == BATCH:
                    flush()
        if waiting:
            flush()
    return [sorted([(a, k, b, True, 1.0) for a, k, b in fixed] + [(a, k, b, False, sure) for a, k, b, sure in reconciled(more, fixed)])
            for fixed, more in zip(base, found, strict=True)]


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("base", T.BooleanType()), T.StructField("confidence", T.DoubleType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("confidence", pa.float64())]))


def with_pii(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """The rows with ``pii``."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def scan(texts: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in range(len(texts))]
        some = np.flatnonzero(pc.match_substring_regex(texts.fill_null(""), "[0-9@]").to_numpy(zero_copy_only=False))
        for number, spans in zip(some.tolist(), scanned(shared.value, texts.take(pa.array(some)).to_pylist()), strict=True):
            out[number] = [{"kind": KINDS[k], "start": a, "end": b, "base": base, "confidence": sure} for a, k, b, base, sure in spans]
        return pa.array(out, _ARROW_SPANS)

    return docs.withColumn("pii", F.arrow_udf(scan, SPANS)(F.col(text)))


def without_pii(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; what overlaps goes with the first."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("upto"))

    def put(state, span):
        gap = F.substring(text, (state["upto"] + 1).cast("int"), F.greatest(span["start"] - state["upto"], F.lit(0)).cast("int"))
        sign = F.when(span["start"] >= state["upto"], F.concat(gap, F.lit("<"), span["kind"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.concat(state["done"], sign).alias("done"), F.greatest(state["upto"], span["end"]).alias("upto"))

    return F.aggregate(spans, start, put, lambda state: F.concat(
        state["done"], F.substring(text, (state["upto"] + 1).cast("int"), F.length(text))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op13_pii")
def op13_pii(spark, sf_dir):
    """Personal data in every document: counts and digest of the patterns' spans, and all spans."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_pii(docs, fit_tagger(docs))
    base = F.filter("pii", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in KINDS],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))
