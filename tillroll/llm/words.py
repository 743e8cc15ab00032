"""Words and word shingles of whole texts as 64-bit hashes, vectorised with numpy.

A word is a run of characters other than the ASCII white space
``[\\x20\\x09-\\x0D]``; A-Z count as a-z, every other character as itself.
A text is handled as its UTF-8 bytes: no byte of a multi-byte character is
below 0x80, so white space and case never touch one.

A word's hash is a sum over its bytes of ``code[byte] * BASE ** position``
(mod 2**64, position counted from the word's start), finished by a bit mixer;
a shingle's hash mixes the hashes of its words in order.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)


def _codes() -> np.ndarray:
    codes = np.random.RandomState(20240229).randint(1, 1 << 62, size=256, dtype=np.int64).astype(U)
    codes[65:91] = codes[97:123]
    return codes


_CODE = _codes()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII character but letters and digits parts words.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes whose terms are summed together, whatever the length of the text.
BLOCK = 1 << 17


def _power(base: int) -> np.ndarray:
    """``base ** 0 .. base ** (BLOCK - 1)`` mod 2**64."""
    out = np.full(BLOCK, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _BACK = _power(BASE), _power(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_spans(data: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every word in a byte array."""
    space = np.empty(len(data) + 2, dtype=bool)
    space[0] = space[-1] = True
    space[1:-1] = apart[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), dtype=U)
    for low in range(0, len(data), BLOCK):
        block = data[low : low + BLOCK]
        total = np.zeros(len(block) + 1, dtype=U)
        np.cumsum(_CODE[block] * _POWER[: len(block)], out=total[1:])
        i, j = np.searchsorted(end, low, side="right"), np.searchsorted(start, low + len(block))
        here = np.maximum(start[i:j] - low, 0)
        part = (total[np.minimum(end[i:j] - low, len(block))] - total[here]) * _BACK[here]
        if i < j and start[i] < low:  # a word that began in an earlier block
            part[:1] *= U(pow(BASE, int(low - start[i]), 1 << 64))
        out[i:j] += part
    return mix(out + (end - start).astype(U))


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word of the text, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    start, end = word_spans(data)
    return _hash_words(data, start, end) if len(start) else np.empty(0, dtype=U)


def word_hash_lists(texts: list[str | None], apart: np.ndarray = _SPACE, chunk: int = 1 << 17):
    """``word_hashes`` of each text in turn; short texts are hashed together,
    about ``chunk`` bytes at a time.  ``apart``: the bytes that part words."""
    i = 0
    while i < len(texts):
        parts, size = [], 0
        while i < len(texts) and size < chunk:
            parts.append((texts[i] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            i += 1
        data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
        start, end = word_spans(data, apart)
        hashes = _hash_words(data, start, end) if len(start) else np.empty(0, dtype=U)
        ends = np.cumsum([len(p) + 1 for p in parts])
        yield from np.split(hashes, np.searchsorted(start, ends)[:-1])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash per run of ``k`` words, in order; the whole sequence as one
    shingle when there are fewer (none for no words)."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, dtype=U)
    for i in range(k):
        out = mix(out * U(0xD6E8FEB86659FD93) + words[i : i + n])
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    x = np.sort(x)
    first = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return distinct(shingle_hashes(word_hashes(text or ""), k))


def shingle_sets(texts: list[str | None], k: int):
    """``shingle_set`` of each text in turn."""
    for words in word_hash_lists(texts):
        yield distinct(shingle_hashes(words, k))
