"""Vectorised hashing of words and shingles: a polynomial over the bytes of a text, cut at white space."""

from __future__ import annotations

import numpy as np

from .common import slices

ODD, ROLL = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes hashed at once: the powers of ODD take 16 bytes each.
PIECE = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: [\\x20\\x09-\\x0D] by byte.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE + 4096, n)
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            both = []
            for base in (ODD, pow(ODD, -1, 1 << 64)):
                p = np.full(size, np.uint64(base), np.uint64)
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def hash_words(text: str | None) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased; null has none."""
    data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    if len(data) <= PIECE:
        return hash_piece(data)[0]
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not IS_SPACE[data[end]]:  # a word stays whole
            nxt = np.flatnonzero(IS_SPACE[data[end : end + 4096]])
            end = end + int(nxt[0]) if len(nxt) else min(end + 4096, len(data))
        out.append(hash_piece(data[at:end])[0])
        at = end
    return np.concatenate(out)


def hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where the words begin."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * up[: len(data)], dtype=np.uint64, out=run[1:])
        return mixed((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(ROLL)), start


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word shingles; with fewer words, of the whole sequence; without words, none."""
    out: list[np.ndarray] = []
    for i, j in slices(texts, PIECE // 2):
        part = [(t or "").encode("utf-8", "replace") for t in texts[i:j]]
        data = b"\n".join(part).lower()
        if len(data) > PIECE:  # a long text by itself or in company
            h = [hash_words(t) for t in texts[i:j]]
            w, first = np.concatenate(h), np.cumsum([0, *map(len, h)])
        else:
            w, start = hash_piece(np.frombuffer(data, np.uint8))
            first = np.searchsorted(start, np.cumsum([0, *(len(p) + 1 for p in part)]))
        n = len(w)
        with np.errstate(over="ignore"):
            full = np.full(max(n - words + 1, 0), np.uint64(words), np.uint64)
            for k in range(words):
                full = full * np.uint64(ROLL) + w[k : n - words + 1 + k]
            full = mixed(full)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                s = np.sort(full[a : b - words + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    x = np.full(1, np.uint64(b - a), np.uint64)
                    for k in range(a, b):
                        x = x * np.uint64(ROLL) + w[k]
                    s = mixed(x)
            else:
                s = w[:0]
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
    return out


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    return shingle_sets([text], words)[0]
