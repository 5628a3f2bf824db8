"""Words of texts as 64-bit hashes, taken from the bytes of many texts at once.

A word is a run of letters and digits, lower-cased; ASCII signs, the signs of
the Latin-1 block, general and CJK punctuation come between words. Other bytes
above ASCII count as letters.
"""

from __future__ import annotations

import re

import numpy as np

P = 0x9E3779B97F4A7C15
_SIGNS = re.compile("[\u0080-©«-´¶-¹»-¿×÷ -⁯　-〿]")
_IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grow(n: int) -> None:
    if n >= len(_powers["up"]):
        n = max(2 * n, 1 << 18)
        for name, p in (("up", P), ("down", pow(P, -1, 1 << 64))):
            _powers[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, p, np.uint64))])


def _plain(text: str | None) -> bytes:
    text = (text or "").lower()
    if not text.isascii() and _SIGNS.search(text):
        text = _SIGNS.sub(" ", text)
    return text.encode("utf-8", "replace")


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and where each text's begin (one more entry than texts)."""
    raw = [_plain(t) for t in texts]
    b = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    begin = np.cumsum([0, *(len(x) + 1 for x in raw)])
    word = _IS_WORD[b]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    _grow(len(b))
    total = np.concatenate([[np.uint64(0)], np.cumsum(b * _powers["up"][: len(b)])])
    h = mixed((total[e] - total[s]) * _powers["down"][s] + (e - s).astype(np.uint64) * np.uint64(P))
    return h, np.searchsorted(s, begin)


def grouped(texts: list, chars: int = 1 << 18):
    """Slices of a list of texts with about ``chars`` characters each, a longer text by itself."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def window_hashes(words: np.ndarray, begin: np.ndarray, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at ``offsets`` from each place whose window stays in its text, and those places."""
    span = offsets[-1] + 1
    if len(words) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    at = np.flatnonzero(text[: len(words) - span + 1] == text[span - 1 :])
    h = np.full(len(at), len(offsets), np.uint64)
    for k in offsets:
        h = (h + words[at + k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h, at
