"""Personal data: patterns with exact checks, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The tagger adds what they miss: the four kinds written otherwise (spelled-out and bracketed
addresses, numbers with blanks, dots or brackets between their parts, phone numbers without a prefix), numbers that run into
one match and fail its check together, and a fifth kind, ``secret``: keys and tokens of mixed characters. It is trained in
numpy on snippets of texts whose spans the patterns have labelled, with many of those spans rewritten, with drawn secrets,
and with numbers, dates, prices and versions that are none of these.

The tagger reads windows of characters that overlap by half. Every window is decoded by itself; a character takes its tag,
and the marginal probability that the CRF gives it, from the window in whose middle it is nearest, and spans are read off
the tags of the whole text. A span is added if the mean marginal of its characters reaches ``CERTAIN``, it ends at no letter
or digit and touches no span that stands already. What has the very form of a base kind is judged by that kind's check.

Windows lie wherever a character is within ``REACH`` of a digit, an ``@`` or a spelled-out one, in any text of any length;
elsewhere no span of these kinds can be. A null text is an empty one without spans. A table without labelled spans trains no
tagger, and base spans alone are returned. Rows that repeat an id are read each. An empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from taleweave.llm.common import Adam, slices, whole_text

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds that the patterns find.
BASE = 4
#: Characters of a window, and how far from what may belong to a span characters are read.
WINDOW, REACH = 64, 32
#: Mean marginal from which a span is added.
CERTAIN = 0.65
#: Bounds of the learning sample: texts looked at, snippets taken from them, characters of a text.
SAMPLE_ROWS, SNIPPETS, SAMPLE_CHARS = 20_000, 400, 20_000
#: Texts made of the snippets' words: with spans close together, and with rewritten spans, secrets and other numbers.
CLOSE, REWRITTEN = 800, 2_800

_EMAIL_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# digits are never matched from within a run of them, so long runs are read once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TRIGGER = re.compile(r"[0-9@]|(?i:[(\[{]\x20?at\x20?[)\]}]|[(\[{]\x20?dot\x20?[)\]}]|\x20dot\x20)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def holds(kind: str, match: str) -> bool:
    """The check that a match of the kind's pattern has to pass."""
    digits = _NOT_DIGIT.sub("", match)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: a local part cannot hold one."""
    last = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > last and text[first - 1] in _LOCAL:
            first -= 1
        end = _EMAIL_END.match(text, at) if first < at else None
        if end:
            yield first, end.end()
            last = end.end()
        at = text.find("@", max(at + 1, last))


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """Matches of all patterns: start, kind, end, and whether the kind's check holds."""
    found = [(a, 0, b, True) for a, b in _emails(text)]
    for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [(m.start(), k, m.end(), holds(KINDS[k], m.group())) for m in pattern.finditer(text)]
    return sorted(found)


# ---------------------------------------------------------------- tagger

#: Tags: 0 outside, then for each kind the first character of a span and the others.
TAGS = 1 + 2 * len(KINDS)
_EMBED, _HIDDEN, _SYMBOLS = 12, 16, 131


def symbols(text: str) -> np.ndarray:
    """ASCII as it is, other letters and other characters as one symbol each; 130 pads."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(code < 128, code, np.where(code >= 0xC0, 128, 129)).astype(np.int16)


def _allowed() -> np.ndarray:
    """Transitions that a sequence of spans can make; the rest are closed."""
    open_ = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        open_[:, inside] = False
        open_[[inside - 1, inside], inside] = True
    return open_


_OPEN = _allowed()
_CLOSED = np.where(_OPEN, 0.0, -1e4).astype(np.float32)
_START = np.array([0 if t % 2 or t == 0 else -1e4 for t in range(TAGS)], np.float32)


def _cell(x: np.ndarray, w: np.ndarray, u: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states [n, t, h] of an LSTM over ``x`` [n, t, d] in one direction; gates are kept for learning."""
    n, steps, _ = x.shape
    h = np.zeros((n, _HIDDEN), np.float32)
    c = np.zeros_like(h)
    out = np.zeros((n, steps, _HIDDEN), np.float32)
    z_all = x @ w[:-1] + w[-1]
    trace = []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        z = z_all[:, t] + h @ u
        gate = 0.5 * (1 + np.tanh(0.5 * z[:, : 3 * _HIDDEN]))
        i, f, o = np.split(gate, 3, axis=1)
        g = np.tanh(z[:, 3 * _HIDDEN :])
        before, prior = c, h
        c = f * c + i * g
        s = np.tanh(c)
        h = o * s
        out[:, t] = h
        if keep:
            trace.append((t, i, f, o, g, before, prior, s))
    return out, trace


def _uncell(x, u, trace, d_out, w):
    """Gradients of ``_cell`` with respect to its input and weights."""
    d_x, d_w, d_u = np.zeros_like(x), np.zeros_like(w), np.zeros_like(u)
    d_h = np.zeros((len(x), _HIDDEN), np.float32)
    d_c = np.zeros_like(d_h)
    for t, i, f, o, g, before, prior, s in reversed(trace):
        d_h = d_h + d_out[:, t]
        d_c = d_c + d_h * o * (1 - s * s)
        d_z = np.concatenate(
            [d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * s * o * (1 - o), d_c * i * (1 - g * g)], 1
        )
        d_w[:-1] += x[:, t].T @ d_z
        d_w[-1] += d_z.sum(0)
        d_u += prior.T @ d_z
        d_x[:, t] = d_z @ w[:-1].T
        d_h, d_c = d_z @ u.T, d_c * f
    return d_x, d_w, d_u


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Tagger:
    embed: np.ndarray
    forward: list[np.ndarray]
    backward: list[np.ndarray]
    out: np.ndarray
    moves: np.ndarray

    def emissions(self, windows: np.ndarray) -> np.ndarray:
        x = self.embed[windows]
        a, _ = _cell(x, *self.forward, back=False, keep=False)
        b, _ = _cell(x, *self.backward, back=True, keep=False)
        return np.concatenate([a, b], 2) @ self.out[:-1] + self.out[-1]

    def marginals(self, windows: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Probability of each given tag among all sequences of its window."""
        e = self.emissions(windows)
        moves = self.moves + _CLOSED
        ahead, after = [e[:, 0] + _START], [np.zeros((len(e), TAGS), np.float32)]
        for t in range(1, e.shape[1]):
            ahead.append(_lse(ahead[-1][:, :, None] + moves, 1) + e[:, t])
            back = e.shape[1] - t
            after.append(_lse(moves[None] + (e[:, back] + after[-1])[:, None, :], 2))
        whole = _lse(ahead[-1], 1)
        both = np.stack([f + g - whole[:, None] for f, g in zip(ahead, reversed(after), strict=True)], 1)
        return np.exp(np.take_along_axis(both, tags[:, :, None], 2)[:, :, 0])

    def decode(self, windows: np.ndarray) -> np.ndarray:
        """Best tags of each window."""
        e = self.emissions(windows)
        moves = self.moves + _CLOSED
        score, back = e[:, 0] + _START, []
        for t in range(1, e.shape[1]):
            paths = score[:, :, None] + moves
            back.append(paths.argmax(1))
            score = paths.max(1) + e[:, t]
        tags = np.zeros(windows.shape, np.int64)
        tags[:, -1] = score.argmax(1)
        for t in range(e.shape[1] - 2, -1, -1):
            tags[:, t] = back[t][np.arange(len(tags)), tags[:, t + 1]]
        return tags


def fit(windows: np.ndarray, tags: np.ndarray, epochs: int = 7, batch: int = 128, seed: int = 3) -> Tagger:
    """Maximum conditional likelihood; gradients of the transitions and emissions are exact marginals."""
    rng = np.random.default_rng(seed)
    weight = lambda *shape: (rng.normal(0, 1, shape) * (1 / shape[0]) ** 0.5).astype(np.float32)

    def lstm() -> list[np.ndarray]:
        w = weight(_EMBED + 1, 4 * _HIDDEN)
        w[-1] = 0
        w[-1, _HIDDEN : 2 * _HIDDEN] = 1
        return [w, weight(_HIDDEN, 4 * _HIDDEN)]

    embed = rng.normal(0, 0.5, (_SYMBOLS, _EMBED)).astype(np.float32)
    net = Tagger(embed, lstm(), lstm(), weight(2 * _HIDDEN + 1, TAGS), np.zeros((TAGS, TAGS), np.float32))
    params = [net.embed, *net.forward, *net.backward, net.out, net.moves]
    adam = Adam(params, 0.01)
    steps = windows.shape[1]
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - epoch / epochs)
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            w, y = windows[at], tags[at]
            n = len(at)
            x = net.embed[w]
            a, trace_a = _cell(x, *net.forward, back=False, keep=True)
            b, trace_b = _cell(x, *net.backward, back=True, keep=True)
            h = np.concatenate([a, b], 2)
            e = h @ net.out[:-1] + net.out[-1]
            moves = net.moves + _CLOSED
            ahead = [e[:, 0] + _START]
            for t in range(1, steps):
                ahead.append(_lse(ahead[-1][:, :, None] + moves, 1) + e[:, t])
            after = [np.zeros((n, TAGS), np.float32)]
            for t in range(steps - 1, 0, -1):
                after.append(_lse(moves[None] + (e[:, t] + after[-1])[:, None, :], 2))
            after.reverse()
            total = _lse(ahead[-1], 1)
            d_e = np.stack([np.exp(f + g - total[:, None]) for f, g in zip(ahead, after, strict=True)], 1)
            d_moves = np.zeros_like(net.moves)
            for t in range(1, steps):
                pair = ahead[t - 1][:, :, None] + moves + (e[:, t] + after[t])[:, None, :] - total[:, None, None]
                d_moves += np.exp(pair).sum(0)
                np.subtract.at(d_moves, (y[:, t - 1], y[:, t]), 1)
            np.put_along_axis(d_e, y[:, :, None], np.take_along_axis(d_e, y[:, :, None], 2) - 1, 2)
            d_e, d_moves = (d_e / n).astype(np.float32), (d_moves / n).astype(np.float32)
            d_out = np.concatenate([np.tensordot(h, d_e, ((0, 1), (0, 1))), d_e.sum((0, 1))[None]])
            d_h = d_e @ net.out[:-1].T
            xa, wa, ua = _uncell(x, net.forward[1], trace_a, d_h[:, :, :_HIDDEN], net.forward[0])
            xb, wb, ub = _uncell(x, net.backward[1], trace_b, d_h[:, :, _HIDDEN:], net.backward[0])
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, w, xa + xb)
            grads = [d_embed, wa, ua, wb, ub, d_out, d_moves]
            size = float(np.sqrt(sum((g * g).sum() for g in grads)))
            adam.step([g * min(1.0, 5 / (size + 1e-9)) for g in grads])
    return net


# ---------------------------------------------------------------- learning texts


def _zones(text: str, reach: int = REACH) -> list[tuple[int, int]]:
    """Stretches of text within reach of a digit or ``@``."""
    zones: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if zones and a <= zones[-1][1]:
            zones[-1] = (zones[-1][0], b)
        else:
            zones.append((a, b))
    return zones


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short labelled stretches without matches that failed their check; ``spans`` as start, kind, end."""
    for batch in batches:
        texts, spans = [], []
        for text in batch.column("text").to_pylist():
            found = candidates(text)
            for a, b in _zones(text):
                own = [c for c in found if c[0] < b and c[2] > a]
                if b - a <= 4 * WINDOW and all(c[3] and c[0] >= a and c[2] <= b for c in own):
                    texts.append(text[a:b])
                    spans.append([x for c in own for x in (c[0] - a, c[1], c[2] - a)])
        yield pa.record_batch([pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int32()))], ["snippet", "spans"])


def _tagged(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    tags = np.zeros(len(text), np.int64)
    for a, k, b in spans:
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return symbols(text), tags


def _windowed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of one stretch, overlapping by half, with each window's beginning."""
    begins = np.arange(0, max(1, len(codes) - WINDOW // 2), WINDOW // 2)
    padded = np.full(begins[-1] + WINDOW, 130, np.int16)
    padded[: len(codes)] = codes[: len(padded)]
    return padded[begins[:, None] + np.arange(WINDOW)], begins


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def drawn(rng: np.random.Generator, kind: int) -> str:
    """A span of a base kind."""
    if kind == 0:
        word = lambda: "".join(_LETTERS[26:][i] for i in rng.integers(0, 26, rng.integers(3, 9)))
        return f"{word()}.{word()}@{word()}.{('com', 'org', 'net', 'de', 'fr')[rng.integers(5)]}"
    if kind == 1:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        while True:
            digits = str(rng.integers(3, 7)) + _digits(rng, 15)
            if luhn(digits):
                return digits if rng.random() < 0.5 else " ".join(digits[i : i + 4] for i in range(0, 16, 4))
    return f"+{rng.integers(1, 99)} ({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}"


def rewritten(rng: np.random.Generator, span: str, kind: int) -> str:
    """A base span as people write it to be read by people only, or by habit."""
    pick = lambda x: x[rng.integers(len(x))]
    if kind == 0:
        at = pick([" (at) ", "(at)", " [at] ", "[at]", " {at} ", " @ ", " (AT) ", " at ", "@ "])
        spelled = "at" in at.lower()
        dot = pick([" (dot) ", "(dot)", " [dot] ", "[dot]", " dot ", " DOT "]) if spelled else pick([" . ", ". ", " dot ", "."])
        name, _, host = span.partition("@")
        return name + at + host.replace(".", dot)
    digits = _NOT_DIGIT.sub("", span)
    if kind == 1:
        return pick([" . ", "[.]", "(.)", " dot ", "[dot]"]).join(span.split("."))
    if kind == 2:
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return pick([".", "  ", "/", "_", " - ", " . ", "--"]).join(groups)
    area, mid, last = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return pick([
        f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"{area}/{mid}/{last}", f"00{rng.integers(1, 99)} {area} {mid} {last}",
        f"tel {area} {mid} {last}", f"0{area[:2]} {mid} {last[:2]} {last[2:]}", f"({area}){mid}-{last}",
    ])


_HEX, _LETTERS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def secret(rng: np.random.Generator) -> str:
    """A key or token: hexadecimal, of letters and digits, or with a prefix of its own."""

    def of(alphabet: str, n: int) -> str:
        out = "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
        # a key without a digit or a letter is a word or a number
        return out if any(c.isdigit() for c in out) and any(c.isalpha() for c in out) else of(alphabet, n)

    kind = rng.integers(6)
    if kind < 2:
        value = of(_HEX, int(rng.choice([24, 32, 40, 48, 64])))
        return value.upper() if rng.random() < 0.3 else value
    if kind == 2:
        return of(_LETTERS + "0123456789", rng.integers(20, 45))
    if kind == 3:
        return of(_LETTERS + "0123456789-_", rng.integers(24, 45)).strip("-_")
    if kind == 4:
        return ("AK", "AS", "SK", "PK")[rng.integers(4)] + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18)
    prefix = "".join(_LETTERS[26:][i] for i in rng.integers(0, 26, rng.integers(2, 5)))
    return prefix + "-_"[rng.integers(2)] + of(_LETTERS + "0123456789", rng.integers(20, 40))


_BEFORE_SECRET = ("token = \"", "TOKEN = \"", "api_key: ", "key='", "secret=", "password: ", "Bearer ", "", "", "access key ", "(")
_AFTER_SECRET = ("\"", "\"", "", "'", "", "", "", "", "", ".", ")")


def unrelated(rng: np.random.Generator) -> str:
    """Numbers and words that are no span of any kind."""
    n = rng.integers
    kinds = [
        f"{n(1900, 2100)}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 29)}", f"{n(1, 24)}:{n(10, 60)}",
        f"${n(1, 999)}.{n(10, 99)}", f"{n(1, 999)},{n(100, 999)},{n(100, 999)}", f"{n(0, 20)}.{n(0, 20)}", f"v{n(0, 9)}.{n(0, 20)}.{n(0, 20)}", f"{n(1, 10**6)}",
        f"{n(1, 100)}%", f"{n(1, 300)}-{n(301, 700)}", f"No. {n(1, 9999)}", f"{n(300, 999)}.{n(300, 999)}.{n(300, 999)}.{n(300, 999)}", _digits(rng, n(20, 40)), _digits(rng, n(4, 9)),
        f"look at the dot {n(10)} and", "a dot com of", "meet me at noon (at) the", f"x{n(100)}y{n(100)}", "co" * n(10, 20) + "operation", f"chapter{n(10)}section{n(10)}",
    ]
    return kinds[rng.integers(len(kinds))]


def learning_windows(snippets: list[str], spans: list[list[int]], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The snippets, and new ones between whose words spans stand: with other digits and close together, rewritten, drawn
    secrets, and numbers and words that are none."""
    rng = np.random.default_rng(seed)
    pool, plain, rows = [], [], []
    for text, flat in zip(snippets, spans, strict=True):
        own = [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]
        rows.append((text, own))
        pool += [(text[a:b], k) for a, k, b in own]
        last = 0
        for a, _, b in [*own, (len(text), 0, len(text))]:
            plain.append(text[last:a])
            last = b
    if pool:
        pool += [(drawn(rng, k), k) for k in range(BASE) for _ in range(40)]  # a kind may have no labelled span
        kinds = [[p for p in pool if p[1] == k] for k in sorted({k for _, k in pool})]
        for _ in range(CLOSE):
            text, own = plain[rng.integers(len(plain))][-24:], []
            for _ in range(rng.integers(1, 4)):
                group = kinds[rng.integers(len(kinds))]
                span, k = group[rng.integers(len(group))]
                span = "".join(str(rng.integers(10)) if c in "0123456789" else c for c in span) if k != 0 else span
                own.append((len(text), k, len(text) + len(span)))
                text += span + (" ", " ", ", ", "; ", "\n", "! ")[rng.integers(6)]
            rows.append((text + plain[rng.integers(len(plain))][:24], own))
        for _ in range(REWRITTEN):
            text, own = plain[rng.integers(len(plain))][-40:], []
            text += (" ", " ", "", "\n")[rng.integers(4)] if text[-1:].isalnum() else ""
            for _ in range(rng.integers(1, 3)):
                if text[-1:].isalnum():
                    text += " "
                draw = rng.random()
                if draw < 0.25:
                    form = rng.integers(len(_BEFORE_SECRET))
                    value, close, k = secret(rng), _AFTER_SECRET[form], BASE
                    text += _BEFORE_SECRET[form]
                elif draw < 0.65:
                    group = kinds[rng.choice(BASE, p=(0.2, 0.15, 0.3, 0.35))]  # numbers are the harder ones to tell
                    span, k = group[rng.integers(len(group))]
                    value, close = rewritten(rng, span, k), ""
                else:
                    value, close, k = unrelated(rng), "", -1
                    if rng.random() < 0.2:  # words in capitals, as in headings
                        value = plain[rng.integers(len(plain))][-30:].upper()
                if k >= 0:
                    own.append((len(text), k, len(text) + len(value)))
                text += value + close + (" ", " ", ", ", ". ", "\n", "! ")[rng.integers(6)]
            rows.append((text + plain[rng.integers(len(plain))][:40], own))
    windows, tags = [], []
    for text, own in rows:
        codes, y = _tagged(text, own)
        w, begins = _windowed(codes)
        padded = np.zeros(begins[-1] + WINDOW, np.int64)
        padded[: len(y)] = y[: len(padded)]
        t = padded[begins[:, None] + np.arange(WINDOW)]
        cut = (t[:, 0] > 0) & (t[:, 0] % 2 == 0)  # a window that begins inside a span sees that span begin there
        t[cut, 0] -= 1
        windows.append(w)
        tags.append(t)
    if not windows:
        return np.zeros((0, WINDOW), np.int16), np.zeros((0, WINDOW), np.int64)
    return np.concatenate(windows), np.concatenate(tags)


def train_pii(docs: DataFrame, rows: int = SAMPLE_ROWS, snippets: int = SNIPPETS, chars: int = SAMPLE_CHARS) -> Broadcast:
    """The fitted tagger (None where no span is labelled). Ids are ranked by a hash before any text is read."""
    chosen = docs.select("doc_id").filter("doc_id is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(rows)
    text = docs.select("doc_id", whole_text().alias("text")).filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= chars))
    found = text.join(F.broadcast(chosen), "doc_id").select("text")
    found = found.mapInArrow(_snippets, "snippet string, spans array<int>")
    found = found.orderBy(F.xxhash64("snippet"), "snippet").limit(snippets).toArrow()
    x, y = learning_windows(found.column("snippet").to_pylist(), found.column("spans").to_pylist())
    return docs.sparkSession.sparkContext.broadcast(fit(x, y) if (y > 0).any() else None)


# ---------------------------------------------------------------- reading texts


def tagged_spans(net: Tagger, texts: list[str], most: int = 2048) -> list[list[tuple[int, int, int, float]]]:
    """Spans (start, kind, end, mean marginal) that the tagger sees in each text, windows of all texts decoded together."""
    stretches = [(n, a, b) for n, text in enumerate(texts) for a, b in _zones(text)]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    middle = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    group, count = [], 0
    for k, (n, a, b) in enumerate(stretches):
        w, begins = _windowed(symbols(texts[n][a:b]))
        group.append((n, a, b, w, begins))
        count += len(w)
        if count < most and k + 1 < len(stretches):
            continue
        every = np.concatenate([g[3] for g in group])
        tags = np.concatenate([net.decode(every[i : i + most]) for i in range(0, len(every), most)])
        sure = np.zeros(tags.shape, np.float32)
        spoken = np.flatnonzero(tags.any(1))
        for i in range(0, len(spoken), most):
            at = spoken[i : i + most]
            sure[at] = net.marginals(every[at], tags[at])
        first = 0
        for n, a, b, w, begins in group:
            best, line = np.full(begins[-1] + WINDOW, -1), np.zeros(begins[-1] + WINDOW, np.int64)
            certain = np.zeros(begins[-1] + WINDOW, np.float32)
            for j, begin in enumerate(begins):
                better = middle > best[begin : begin + WINDOW]
                best[begin : begin + WINDOW][better] = middle[better]
                line[begin : begin + WINDOW][better] = tags[first + j][better]
                certain[begin : begin + WINDOW][better] = sure[first + j][better]
            first += len(begins)
            line = line[: b - a]
            for s in np.flatnonzero(line % 2 == 1):
                k = int(line[s] - 1) // 2
                e = s + 1
                while e < len(line) and line[e] == 2 + 2 * k:
                    e += 1
                out[n].append((a + int(s), k, a + e, float(certain[s:e].mean())))
        group, count = [], 0
    return out


_FORMS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def admitted(text: str, a: int, k: int, b: int, sure: float) -> bool:
    """Whether a tagged span is added. Its shape is the tagger's to judge; what it holds must suit its kind: parts of an
    address of at most 255, a card's digits with their check digit, as many digits as a phone number has, digits and
    letters in a secret. A span of its kind's base form needs no more than that."""
    if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
        return False
    span = text[a:b]
    if k < BASE and _FORMS[k].fullmatch(span):
        return holds(KINDS[k], span)
    if sure < CERTAIN or b - a < 7:
        return False
    if k == 0:
        return any(c.isalpha() for c in span)
    if k == BASE:
        return any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
    if k == 1:
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return holds(KINDS[k], span)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_OUT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)


def _read(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        names = [c.split()[0] for c in _OUT.split(", ")]
        for batch in batches:
            column = batch.column("text")
            for part in slices(column):
                ids = batch.column("doc_id").slice(part.offset - column.offset, len(part)).to_pylist()
                texts = part.to_pylist()
                base = [[c[:3] for c in candidates(t) if c[3]] for t in texts]
                seen = tagged_spans(net, texts) if net is not None else [[] for _ in texts]
                rows = []
                for doc_id, text, own, tagged in zip(ids, texts, base, seen, strict=True):
                    spans = list(own)
                    for a, k, b, sure in tagged:
                        if admitted(text, a, k, b, sure) and all(b <= s[0] or s[2] <= a for s in spans):
                            spans.append((a, k, b))
                    counts = [sum(s[1] == k for s in own) for k in range(BASE)]
                    digest = hashlib.sha256(_listed(own).encode()).hexdigest()
                    rows.append((doc_id, *counts, digest, _listed(spans), len(spans) - len(own)))
                kinds = [pa.string() if n in ("base_sha256", "spans") else pa.int64() for n in names]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch(columns, names)

    return run


def find_pii(docs: DataFrame, model: Broadcast) -> DataFrame:
    """A row for each document: base spans counted and digested, all spans listed as kind:start:end."""
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(_read(model), _OUT)
