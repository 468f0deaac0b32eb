"""Vectorised words, shingles and byte-window hashes of whole batches of texts.

All helpers work on one Arrow batch at a time inside a task. A word's hash is the 64-bit XXH3 digest of its bytes.
Hashes of byte ranges are polynomial prefix sums modulo 2**64 over a table of mixed byte values, finished by a 64-bit
avalanche. Made-up strings of 1,024 bytes and more can defeat these, so they serve where ranges are shorter or where
bytes are compared afterwards. Equal byte strings get equal hashes in every task.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes that are hashed at once, which bounds the memory of the tables of powers.
HASH_BYTES = 1 << 20
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _byte_values() -> np.ndarray:
    if "bytes" not in _tables:
        _tables["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return _tables["bytes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if "pow" not in _tables or len(_tables["pow"]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("pow", _BASE), ("inv", inverse)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _tables[key] = np.cumprod(p, dtype=np.uint64)
    return _tables["pow"][:n], _tables["inv"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any byte range follows; one longer than data."""
    power, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[data] * power, dtype=np.uint64, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for arrays of bounds."""
    _, inverse = _powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of A-Z-lower-cased texts, in order, and the number of words of each text."""
    out, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else None
        if words:
            counts[i] = len(words)
            out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)))
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), counts


def shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as hashes, sorted within each text, and the number of each text.

    A text of fewer than k words, but not none, has one shingle: the whole sequence of its words."""
    words, counts = word_hashes(texts)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(max(len(words) - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        full += words[j : j + len(full)] * factors[j]
    full = mix(full)
    out, sizes, at = [], np.zeros(len(texts), dtype=np.int64), 0
    for i, n in enumerate(counts.tolist()):
        if n >= k:
            h = np.sort(full[at : at + n - k + 1])
            if len(h) > 1 and not (h[1:] != h[:-1]).all():
                h = h[np.concatenate([[True], h[1:] != h[:-1]])]
        elif n:
            h = mix(np.array([(words[at : at + n] * factors[:n]).sum() + np.uint64(n)], dtype=np.uint64))
        else:
            continue
        out.append(h)
        sizes[i] = len(h)
        at += n
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), sizes
