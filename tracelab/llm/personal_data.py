"""Personal data in text by a character BiLSTM with CRF transitions (operator 3).

Base patterns find e-mail addresses, IP addresses, card numbers and phone
numbers. A bidirectional LSTM over characters, with a CRF over its tags, finds
more: addresses written with (at) and (dot), phone numbers without a plus,
IP addresses with brackets around their dots, and the like. It is trained in
numpy from labelled spans; ``examples`` makes a set of them with as many
look-alikes (dates, versions, tokens, prices, article numbers).

A text is cut into overlapping windows at fixed places, all windows of a batch
are decoded together, and each character takes its tag from the window in which
it is furthest from an edge. A span found this way is kept if it fits its
kind's rules and touches no base span. What fits some kind's rules is part of a
match of ``_CANDIDATE``, so windows without any of these can't give a span and
aren't run; the spans are those of all windows, however long the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import appended, small_batches, table

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
WINDOW, STEP = 96, 24  #: characters of a window, and from one to the next
CHARACTERS, EMBEDDING, HIDDEN = 130, 10, 20
EXAMPLES, EPOCHS, BATCH, RATE, SEED = 2500, 7, 48, 0.02, 17

_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What stands for @ and for a dot: bracketed, or words between spaces.
_AT = r"(?:\s?[\[({<]\s?(?:[aA][tT]|@)\s?[\])}>]\s?|\s?@\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\s?[\[({<]\s?(?:[dD][oO][tT]|\.)\s?[\])}>]\s?|\.|\s(?:dot|DOT)\s)"
_NAME, _LABEL = r"[A-Za-z0-9_%+-]+", r"[A-Za-z0-9-]+"
_ADDRESS = re.compile(rf"{_NAME}(?:{_DOT}{_NAME})*{_AT}{_LABEL}(?:{_DOT}{_LABEL})+")
_BARE = re.compile(r"[A-Za-z0-9]\s(?:at|AT)\s[A-Za-z0-9]")
_WORDED = re.compile(r"\s(?:dot|DOT)\s|[\[({<]\s?[dD][oO][tT]")
_QUAD = re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}")
_NUMBER = re.compile(r"\+?\(?[0-9][\x20()./0-9_-]+[0-9]")
_HOST = re.compile(rf"{_AT}{_LABEL}(?:{_DOT}{_LABEL})+")
_DOT_BEFORE = re.compile(rf"{_DOT}$")
_DIGITS = re.compile(rf"[0-9](?:{_DOT}|[\x20()./_-]*+[0-9])*")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _card(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _ip(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and non-overlapping for each kind, in time linear in the text.

    An address can only begin where the run of its characters before an at sign
    does, so each at sign is looked at once.
    """
    found: list[Span] = []
    end = after = 0
    for m in _RIGHT.finditer(text) if "@" in text else ():
        after = max(end, text.rfind("@", after, m.start()) + 1)
        start = after + len(text[after : m.start()].rstrip(_LOCAL))
        if start < m.start():
            found.append(("email", start, m.end()))
            end = m.end()
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip(m[0])]
        found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if _card(m[0])]
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def plausible(kind: str, s: str) -> bool:
    """The rules that a span found by the model has to fit."""
    if kind == "email":
        return bool(_ADDRESS.fullmatch(s)) and not (_BARE.search(s) and not _WORDED.search(s))
    if kind == "ip":
        return bool(_QUAD.fullmatch(s)) and all(int(x) <= 255 for x in re.findall(r"[0-9]+", s))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[\x20._-]?[0-9])+", s)) and _card(s)
    groups = re.findall(r"[0-9]+", s)
    return bool(_NUMBER.fullmatch(s)) and 9 <= len(_digits(s)) <= 15 and len(groups) >= 3 and max(map(len, groups)) <= 5


def candidates(text: str) -> list[tuple[int, int]]:
    """Stretches of a text outside which no span fits the rules, in order and apart from each other.

    A number has nine digits or four groups of them; an address goes on from
    its at sign over names and dots to both sides.
    """
    found = []
    for m in _DIGITS.finditer(text):
        if len(_digits(m[0])) >= 9 or len(re.findall(r"[0-9]+", m[0])) >= 4:
            found.append((max(0, m.start() - 2), m.end()))
    for m in _HOST.finditer(text):
        at = m.start()
        while True:
            end = at
            while at and text[at - 1].isascii() and (text[at - 1].isalnum() or text[at - 1] in "_%+-"):
                at -= 1
            dot = _DOT_BEFORE.search(text, max(0, at - 9), at) if at < end else None
            if dot is None:
                break
            at = dot.start()
        found.append((at, m.end()))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 2:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Made-up texts with their labelled spans, and as many look-alikes without a label."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda a, b: "".join(pick(*"aeiounrtslhdcm") for _ in range(rng.integers(a, b)))

    def word() -> str:
        w = letters(1, 11)
        known = pick("at", "the", "and", "dot", "call", "mail", "to", "der", "und", "que", "de", "le", "to:", "me")
        return pick(w, w, w, known, w.capitalize(), w + pick(",", ".", ";", "!", "é"), w.upper(), pick("ß", "ó", "ê") + w)

    def card() -> str:
        d = number(pick(15, 15, 14, 12))
        d += next(c for c in "0123456789" if luhn(d + c))
        cut = pick("", " ", "-", ".", "_")
        return cut.join(d[i : i + 4] for i in range(0, len(d), 4))

    def email() -> str:
        name = pick(letters(3, 9), letters(3, 7) + "." + letters(3, 8), letters(3, 7) + number(2), letters(2, 6) + "_" + letters(2, 6), letters(1, 2) + "." + letters(4, 14), ".".join(letters(1, 7) for _ in range(4)))
        host = pick(letters(3, 9), letters(5, 16), letters(3, 8) + "-" + letters(3, 12), "-".join(letters(2, 8) for _ in range(4)), "mail" + number(1) + "." + letters(3, 8), letters(3, 7) + "." + letters(3, 7))
        end = pick("com", "org", "net", "de", "fr", "es", "co.uk", "edu")
        at, dot = pick(("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" at ", " dot "), ("{at}", "{dot}"), (" AT ", " DOT "), (" @ ", "."), ("(@)", "."), ("[at]", " [dot] "), (" (at) ", "."))
        spread = dot if pick(True, False) else "."
        return f"{name.replace('.', spread)}{at}{host.replace('.', spread)}{dot}{end.replace('.', dot)}"

    def phone() -> str:
        a, b, c, d = number(3), number(3), number(4), number(2)
        return pick(f"+{number(1)} ({a}) {b}-{c}", f"+{d} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{number(1)}-{a}-{b}-{c}", f"{a}/{b}-{c}", f"0{number(2)} {number(4)} {number(4)}", f"00{d} {number(2)} {number(4)} {number(2)}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", f"1-{a}-{b}-{c}")

    def ip() -> str:
        dot = pick(".", "[.]", "(.)", " dot ", "[dot]", " (dot) ", "(dot)")
        return dot.join(str(rng.integers(256)) for _ in range(4))

    def other() -> str:
        a, b = number(2), number(3)
        return pick(
            f"{2000 + rng.integers(30)}-{a}-{number(2)}", f"{a}:{number(2)}", f"{number(1)}.{a}.{number(1)}", f"${b}.{a}", number(rng.integers(1, 12)), f'token = "{"".join(pick(*"0123456789abcdef") for _ in range(40))}"',
            f"{letters(2, 5)}{b}", f"({number(4)})", f"{a}/{number(2)}", f"@{letters(3, 8)}", f"{number(1)}, {a}, {number(2)}", f"{b}-{a}", f"at {number(1)}.{a} dot", f"look at {letters(3, 8)}.{letters(2, 5)}", f"{letters(3, 8)} at {letters(3, 8)}.",
            f"ISBN 978-{number(1)}-{b}-{number(5)}-{number(1)}", f"2{number(3)}-{a}-{number(2)} {number(2)}:{number(2)}:{number(2)}", f"{number(1)} {b} {number(3)} {number(3)}", f"{a}.{number(3)}.{number(3)},{number(2)}", f"{number(2)}.{number(2)}.{2000 + rng.integers(30)}", f"{a}-{number(2)}-{number(2)}",
            f"1{number(3)}-1{number(3)}, 2{number(3)}-2{number(3)}", f"§ {a}.{number(1)}.{number(2)}.{number(1)}.{number(1)}", f"No. {number(4)}-{number(6)}-{number(2)}", f"{number(8)}-{number(4)}-4{number(3)}-{number(4)}-{number(12)}",
        )

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(1, 4)):
            text += " ".join(word() for _ in range(rng.integers(1, 6))) + pick(" ", " ", "\n", " | ", ": ", " (")
            if rng.random() < 0.55:
                kind = pick(*KINDS)
                s = makers[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            else:
                text += other()
            text += pick(" ", " ", ". ", ", ", "! ", "\n", ") ")
        out.append((text.rstrip(" .,!\n") if rng.random() < 0.3 else text, spans))
    return out


_CODE = np.array([c if 32 <= c < 127 else 1 for c in range(128)], np.int64)


def characters(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(code < 128, _CODE[np.minimum(code, 127)], np.where(code >= 192, 128, 129))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large negative number: inside follows its own kind alone."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        out[[t for t in range(TAGS) if t not in (2 * k + 1, 2 * k + 2)], 2 * k + 2] = -1e4
    return out


@dataclass
class Tagger:
    """The network; parameters are named arrays, time is the first axis of all activations."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = SEED) -> Tagger:
        rng = np.random.default_rng(seed)
        some = lambda *shape: rng.standard_normal(shape).astype(np.float32) / np.float32(np.sqrt(shape[0]))
        p = {"embedding": some(CHARACTERS, EMBEDDING) * 3, "out": some(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "next": np.zeros((TAGS, TAGS), np.float32)}
        for way in ("f", "b"):
            p |= {f"x{way}": some(EMBEDDING, 4 * HIDDEN), f"h{way}": some(HIDDEN, 4 * HIDDEN), f"b{way}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}
        return cls(p)

    def _run(self, e: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Hidden states of one direction and, for training, gates and cells. Gates: in, forget, cell, out."""
        steps, n = e.shape[:2]
        h, c, kept = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), [None] * steps
        out, given, back = np.empty((steps, n, HIDDEN), np.float32), e @ self.p[f"x{way}"] + self.p[f"b{way}"], self.p[f"h{way}"]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ back
            s = _sigmoid(z)
            g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 3 * HIDDEN :]
            before, prior = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            kept[t], out[t] = (i, f, g, o, prior, tc, before), h
        return out, kept

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.p["embedding"][x]
        hf, kf = self._run(e, "f")
        hb, kb = self._run(e, "b")
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["out"] + self.p["out_b"], (e, h, kf, kb)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags under the CRF, and its gradients."""
        s, (e, h, kf, kb) = self.scores(x)
        steps, n, _ = s.shape
        move = self.p["next"] + _allowed()
        a, b = np.empty((steps, n, TAGS)), np.zeros((steps, n, TAGS))
        a[0] = s[0]
        for t in range(1, steps):
            a[t] = s[t] + _lse(a[t - 1][:, :, None] + move, 1)
        for t in range(steps - 2, -1, -1):
            b[t] = _lse(move + (s[t + 1] + b[t + 1])[:, None, :], 2)
        z = _lse(a[-1], 1)
        rows = np.arange(n)
        gold = sum(s[t, rows, y[t]] for t in range(steps)) + sum(move[y[t - 1], y[t]] for t in range(1, steps))
        ds = np.exp(a + b - z[None, :, None])
        dmove = np.zeros((TAGS, TAGS))
        for t in range(1, steps):
            dmove += np.exp(a[t - 1][:, :, None] + move + (s[t] + b[t])[:, None, :] - z[:, None, None]).sum(axis=0)
            np.add.at(dmove, (y[t - 1], y[t]), -1)
            ds[t, rows, y[t]] -= 1
        ds[0, rows, y[0]] -= 1
        ds, g = (ds / n).astype(np.float32), {"next": (dmove / n).astype(np.float32)}
        g["out"], g["out_b"] = np.einsum("tnh,tnk->hk", h, ds), ds.sum(axis=(0, 1))
        dh, de = ds @ self.p["out"].T, np.zeros_like(e)
        for way, kept, own in (("f", kf, dh[..., :HIDDEN]), ("b", kb, dh[..., HIDDEN:])):
            de += self._back(e, own, kept, way, g)
        g["embedding"] = np.zeros_like(self.p["embedding"])
        np.add.at(g["embedding"], x, de)
        return float((z - gold).mean()), g

    def _back(self, e: np.ndarray, dh: np.ndarray, kept: list, way: str, g: dict[str, np.ndarray]) -> np.ndarray:
        steps, n = e.shape[:2]
        dz, later_h, later_c = np.empty((steps, n, 4 * HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        gh, back = np.zeros_like(self.p[f"h{way}"]), self.p[f"h{way}"].T
        for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
            i, f, c, o, prior, tc, before = kept[t]
            d = dh[t] + later_h
            dc = d * o * (1 - tc**2) + later_c
            z = dz[t]
            z[:, :HIDDEN], z[:, HIDDEN : 2 * HIDDEN] = dc * c * i * (1 - i), dc * prior * f * (1 - f)
            z[:, 2 * HIDDEN : 3 * HIDDEN], z[:, 3 * HIDDEN :] = dc * i * (1 - c**2), d * tc * o * (1 - o)
            gh += before.T @ z
            later_h, later_c = z @ back, dc * f
        g[f"h{way}"], g[f"x{way}"], g[f"b{way}"] = gh, np.einsum("tne,tnk->ek", e, dz), dz.sum(axis=(0, 1))
        return dz @ self.p[f"x{way}"].T

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of windows (time, window) by Viterbi."""
        s, _ = self.scores(x)
        move, steps = self.p["next"] + _allowed(), len(s)
        best, come = s[0], np.empty((steps, *s.shape[1:]), np.int64)
        for t in range(1, steps):
            ways = best[:, :, None] + move
            come[t] = ways.argmax(axis=1)
            best = s[t] + ways.max(axis=1)
        tags = np.empty(s.shape[:2], np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = come[t][np.arange(s.shape[1]), tags[t]]
        return tags


def windows_of(text: str, starts: list[int]) -> np.ndarray:
    """Character codes of the windows that begin at ``starts``, filled up with 0; time first."""
    out = np.zeros((WINDOW, len(starts)), np.int64)
    for k, a in enumerate(starts):
        code = characters(text[a : a + WINDOW])
        out[: len(code), k] = code
    return out


def train(labelled: list[tuple[str, list[Span]]], epochs: int = EPOCHS, seed: int = SEED) -> Tagger:
    """A network for the labelled spans, by Adam; the same for the same spans."""
    xs, ys = [], []
    for text, spans in labelled:
        tags = np.zeros(len(text) + WINDOW, np.int64)
        for kind, a, b in spans:
            tags[a:b] = 2 * KINDS.index(kind) + 2
            tags[a] -= 1
        starts = list(range(0, max(1, len(text) - STEP), WINDOW // 2))
        xs.append(windows_of(text, starts))
        ys.append(np.stack([tags[a : a + WINDOW] for a in starts], axis=1))
    x, y = np.concatenate(xs, axis=1), np.concatenate(ys, axis=1)
    net, rng = Tagger.new(seed), np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    total = epochs * -(-x.shape[1] // BATCH)
    for _ in range(epochs):
        order = rng.permutation(x.shape[1])
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            _, g = net.loss(x[:, own], y[:, own])
            step += 1
            norm = float(np.sqrt(sum((v**2).sum() for v in g.values())))
            rate = RATE * (1 - step / (total + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for name, v in g.items():
                v = v * min(1.0, 5 / max(norm, 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.99 * second[name] + 0.01 * v**2
                net.p[name] = (net.p[name] - rate * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
    return net


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    return train(examples())


def n_windows(length: int) -> int:
    return max(1, -(-(length - WINDOW) // STEP) + 1)


def deciding(at: int, length: int) -> int:
    """The number of the window in which a character is furthest from an edge."""
    return min(max((at - (WINDOW - STEP) // 2) // STEP, 0), n_windows(length) - 1)


def stretches_of(text: str, gated: bool = True) -> list[tuple[int, int]]:
    """Parts of a text whose tags are asked for: the candidates, a character more on both sides, or all of it."""
    found = candidates(text) if gated else [(0, len(text))] if text else []
    return [(max(0, a - 1), min(len(text), b + 1)) for a, b in found]


def reconciled(a: int, b: int, length: int, tags: dict[int, np.ndarray]) -> np.ndarray:
    """The tags of characters ``a`` to ``b``, each from its deciding window."""
    return np.array([tags[k := deciding(i, length)][i - k * STEP] for i in range(a, b)], np.int64)


def added_spans(text: str, stretches: list[tuple[int, int]], tags: dict[int, np.ndarray], base: list[Span]) -> list[Span]:
    """Spans of decoded stretches that fit their kind and touch neither base spans nor other letters and digits."""
    out: list[Span] = []
    for a, b in stretches:
        seq = reconciled(a, b, len(text), tags)
        edge = np.flatnonzero((seq != 0) & ((seq % 2 == 1) | (np.append(0, seq[:-1]) == 0)))
        for s in edge.tolist():
            kind, e = (seq[s] - 1) // 2, s + 1
            while e < len(seq) and seq[e] == 2 * kind + 2:
                e += 1
            x, y = a + s, a + e
            if text[x:y].count(")") > text[x:y].count("(") and text[x - 1 : x] == "(":
                x -= 1
            elif text[x] == "(" and ")" not in text[x:y]:
                x += 1
            free = not any(p < y and x < q for _, p, q in (*base, *out))
            if free and not (x and text[x - 1].isalnum()) and not (y < len(text) and text[y].isalnum()) and plausible(KINDS[kind], text[x:y]):
                out.append((KINDS[kind], x, y))
    return out


def find_all(texts: list[str | None], net: Tagger, together: int = 256, gated: bool = True) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text; windows of many texts are decoded at once.

    ``gated`` leaves out the windows in which no span is possible; the spans are the same.
    """
    texts = [t or "" for t in texts]
    base, asked = [base_spans(t) for t in texts], [stretches_of(t, gated) for t in texts]
    jobs = sorted({(i, k) for i, own in enumerate(asked) for a, b in own for k in range(deciding(a, len(texts[i])), deciding(b - 1, len(texts[i])) + 1)})
    tags: list[dict[int, np.ndarray]] = [{} for _ in texts]
    for n in range(0, len(jobs), together):
        part = jobs[n : n + together]
        got = net.decode(np.concatenate([windows_of(texts[i], [k * STEP]) for i, k in part], axis=1)).astype(np.int8)
        for j, (i, k) in enumerate(part):
            tags[i][k] = got[:, j]
    return [(own, added_spans(t, s, g, own)) for t, own, s, g in zip(texts, base, asked, tags, strict=True)]


def personal_data(docs: DataFrame, text: str = "text", net: Tagger | None = None) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (base spans), n_added, base_spans and spans.

    Spans are listed as kind:start:end in code points, end exclusive, by start
    and then kind, joined by commas. Null and empty texts have none, long ones
    are read whole, repeated rows have equal spans. Columns with the added
    names are replaced; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    net = net or default_tagger()
    made = ", ".join([*(f"n_{k} long" for k in (*KINDS, "added")), "base_spans string", "spans string"])

    def find(texts: pa.Array) -> list[list]:
        found = find_all(texts.to_pylist(), net)
        return [*([sum(s[0] == k for s in b) for b, _ in found] for k in KINDS), [len(m) for _, m in found], [listed(b) for b, _ in found], [listed(ordered(b + m)) for b, m in found]]

    return appended(docs, made, find, [text])


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in ordered(spans):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")
