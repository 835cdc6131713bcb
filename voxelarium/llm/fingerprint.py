"""64-bit SimHash fingerprints of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle and the seed of its XXH64.
SHINGLE = 3
SEED = 42

_LOWER = bytes(range(256)).lower()
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: Shingles whose bits are unpacked at once.
_ROWS = 1 << 16


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of UTF-8 ``text`` as an unsigned number; without words it is zero.

    ``bytes.split`` cuts at exactly ``[\\x20\\x09-\\x0D]`` and ``bytes.lower`` touches A-Z only.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(size))))
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8", count=len(words) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), _ROWS):
        part = hashes[start : start + _ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[2 * ones > len(hashes)].sum(dtype=np.uint64))
