"""Words of many texts at once: byte-level splitting and 64-bit word hashes in numpy, for use inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in blocks of about so many bytes.
BLOCK_BYTES = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C17 & ~0b100 | 0b11)  # 3 mod 4, so that swapped letters keep 63 bits apart
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 (Steele, Lea, Flood 2014): a bijection on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, BLOCK_BYTES + BLOCK_BYTES // 2)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(m, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_STEP, _INVERSE)]
    return _powers[0], _powers[1]


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets within the bytes) of consecutive texts; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words [^\\x20\\x09-\\x0D]+ in order, A-Z lower-cased, and the offsets of each text's words among them."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    up, down = _powers_to(len(raw) + 1)
    gap = np.empty(len(raw) + 1, bool)
    gap[0] = True
    gap[1:] = _SPACE[raw]
    first = gap[:-1].copy()
    inner = at[at < len(raw)]
    first[inner] = True
    first &= ~gap[1:]
    last = np.empty(len(raw), bool)
    last[:-1] = gap[2:]
    last[-1] = True
    last[inner[inner > 0] - 1] = True
    last &= ~gap[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LETTER[raw] * up[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ (ends - starts).astype(np.uint64)), np.searchsorted(starts, at)


def shingles(h: np.ndarray, at: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of k words; fewer words: of the whole text as one run; none: empty."""
    step = np.uint64(0xD6E8FEB86659FD93)
    run = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        run = run * step + h[j : j + len(run)]
    run = mix(run)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(run[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            x = np.zeros(1, np.uint64)
            for v in h[a:b]:
                x = x * step + v
            out.append(mix(x ^ np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out
