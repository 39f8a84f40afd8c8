"""Vectorised hashing of words and shingles inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random odd multipliers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_PLACES = odd_numbers(64, 1)


def spaced_words(text: str | None) -> list[bytes]:
    """Words between white space (space, tab to carriage return), A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; fewer words are one run; none without words."""
    found = spaced_words(text)
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(k, len(found))
    runs = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        runs += mix64(hashes[i:len(hashes) - k + 1 + i] * _PLACES[i] + _PLACES[k + i])
    return np.unique(mix64(runs))


def set_digest(values: np.ndarray) -> bytes:
    return blake2b(values.tobytes(), digest_size=16).digest()


def rows_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most_bytes`, so that what a task holds does not follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
