"""Hashed words and character n-grams of texts, by sentence, in numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Buckets of feature hashes (a power of two) and characters of the buffers that are worked on at once.
BITS, PIECE = 22, 1 << 17
GRAMS = (4, 5)
ENDS = ".!?\n"
U32, U64 = np.uint32, np.uint64
#: Odd multipliers of the characters of an n-gram, and of a word's polynomial with its inverse.
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], U32)
BASE = 0x2545F4914F6CDD1D

_word_table: list[np.ndarray] = []
_powers: list[np.ndarray] = []


def _is_word() -> np.ndarray:
    """Whether each character is one of a word, as in the regular expression class of word characters."""
    if not _word_table:
        _word_table.append(np.fromiter((chr(i).isalnum() or chr(i) == "_" for i in range(0x110000)), bool, 0x110000))
    return _word_table[0]


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + 1024)
        inverse = pow(BASE, -1, 1 << 64)
        factors = [np.full(n, b, U64) for b in (BASE, inverse)]
        for f in factors:
            f[0] = 1
        _powers[:] = map(np.cumprod, factors)
    return _powers


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U32(16))) * U32(0x7FEB352D)
    h = (h ^ (h >> U32(15))) * U32(0x846CA68B)
    return (h ^ (h >> U32(16))) >> U32(32 - BITS)


def _features(lowered: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """([(buckets, sentence of each)], number of sentences) of a buffer; the last entry is of whole words.

    Features are words and the n-grams of words between border marks, so that stems count inside compounds.
    """
    codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), U32)
    n = len(codes)
    is_word = _is_word()[codes]
    ends = np.isin(codes, np.array([ord(c) for c in ENDS], U32))
    sentence = np.cumsum(ends, dtype=np.int32)
    # Word characters, and one mark (code 1) for each stretch of others and at both ends.
    w = np.concatenate([[False], is_word, [False]])
    keep = w.copy()
    keep[1:] |= w[:-1]
    keep[0] = True
    c = np.where(w, np.concatenate([[1], codes, [1]]).astype(U32), U32(1))[keep]
    of = np.concatenate([[0], sentence, sentence[-1:]])[keep] if n else np.zeros(len(c), np.int32)
    w = w[keep]
    out = []
    for size in GRAMS:
        m = len(c) - size + 1
        if m <= 0:
            out.append((np.empty(0, U32), np.empty(0, np.int32)))
            continue
        inside = w[1 : m + 1].copy()
        for j in range(2, size - 1):
            inside &= w[j : m + j]
        at = np.flatnonzero(inside)
        h = np.full(len(at), size, U32)
        for j in range(size):
            h += c[at + j] * FACTORS[j]
        out.append((_bucket(h), of[at + 1]))
    first = np.flatnonzero(w[1:] & ~w[:-1]) + 1
    last = np.flatnonzero(w[:-1] & ~w[1:]) + 1
    power, inverse = _power_tables(len(c))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(c.astype(U64) * power[: len(c)])])
    h = (sums[last] - sums[first]) * inverse[first]
    out.append((_bucket(((h ^ (h >> U64(32))) & U64(0xFFFFFFFF)).astype(U32)), of[first]))
    return out, int(sentence[-1]) + 1 if n else 1


def _cuts(text: str) -> Iterator[str]:
    """Parts of a long text. They end between words, so a word of up to PIECE characters is never cut; a longer one is cut
    into parts of PIECE characters from its own start, wherever in the text it stands."""
    at = 0
    while len(text) - at > PIECE:
        stop = back = at + PIECE
        while back > at and (text[back - 1].isalnum() or text[back - 1] == "_"):
            back -= 1
        if back > at:
            stop = back
        yield text[at:stop]
        at = stop
    yield text[at:]


def buffers(texts: list[str]) -> Iterator[tuple[list[int], list[str], bool]]:
    """(places in `texts`, strings, whether they are parts of one text): short texts together, long ones in parts."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > PIECE:
            yield held, [texts[j] for j in held], False
            held, size = [], 0
        if len(t) > PIECE:
            yield [i], list(_cuts(t)), True
            continue
        held.append(i)
        size += len(t) + 1
    if held:
        yield held, [texts[j] for j in held], False


def by_sentence(texts: list[str]) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(place in `texts`, number of its sentences, [(buckets, sentence of each)]) for each text, in order.

    Sentences run to one of `.!?` or a line's end and are numbered from 0 in each text; those without words count too.
    """
    for places, strings, parts in buffers(texts):
        if parts:
            got, base = [], 0
            for s in strings:
                some, n = _features(s.lower())
                got.append([(b, of + base) for b, of in some])
                base += n - 1
            yield places[0], base + 1, [(np.concatenate([g[k][0] for g in got if len(g) > k]), np.concatenate([g[k][1] for g in got if len(g) > k])) for k in range(max(map(len, got)))]
            continue
        some, n = _features("\n".join(s.lower() for s in strings))
        starts = np.cumsum([0] + [1 + sum(map(s.count, ENDS)) for s in strings])
        edges = [np.searchsorted(of, starts) for _, of in some]
        for k, i in enumerate(places):
            yield i, int(starts[k + 1] - starts[k]), [(b[e[k] : e[k + 1]], of[e[k] : e[k + 1]] - starts[k]) for (b, of), e in zip(some, edges)]


def sums(texts: list[str], weights: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in `texts`, sum of the weights of each sentence's features, whether it has words), in order."""
    for places, strings, parts in buffers(texts):
        total, words, held = [], [], []
        for s in strings if parts else ["\n".join(s.lower() for s in strings)]:
            some, n = _features(s.lower() if parts else s)
            total.append(sum((np.bincount(of, weights[b], n) for b, of in some), np.zeros(n)))
            words.append(np.bincount(some[-1][1], minlength=n) > 0)
        if parts:
            z, has = total[0], words[0]
            for t, h in zip(total[1:], words[1:]):
                held.append((z[:-1], has[:-1]))
                t[0] += z[-1]
                h[0] |= has[-1]
                z, has = t, h
            held.append((z, has))
            yield places[0], np.concatenate([z for z, _ in held]), np.concatenate([h for _, h in held])
            continue
        starts = np.cumsum([0] + [1 + sum(map(s.count, ENDS)) for s in strings])
        for k, i in enumerate(places):
            yield i, total[0][starts[k] : starts[k + 1]], words[0][starts[k] : starts[k + 1]]
