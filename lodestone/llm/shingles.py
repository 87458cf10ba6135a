"""Word shingles of whole Arrow columns of text, as 64-bit hashes, without a Python object for any word.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased. A shingle is `width` words in a
row; a text of fewer words has one shingle, of all of them; a text without words has one that stands for the whole text, so
that equal texts always have equal sets.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time (one longer text is hashed alone).
AT_ONCE = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of 0 to n, and the inverses (modulo 2 to the 64)."""
    up, down = np.empty(n + 1, dtype=np.uint64), np.empty(n + 1, dtype=np.uint64)
    for out, base in ((up, int(BASE)), (down, pow(int(BASE), -1, 1 << 64))):
        out[0], have = 1, 1
        while have <= n:
            step = min(have, n + 1 - have)
            out[have : have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
            have += step
    return up, down


def _hashed(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts that lie one behind another in data, and how many each text has."""
    n = len(data)
    inside = IN_WORD[data]
    first = np.zeros(n, dtype=bool)  # where a text begins, words are cut
    begins = np.append(0, ends[:-1])
    first[begins[begins < n]] = True
    before = np.append(False, inside[:-1])
    starts = np.flatnonzero(inside & (~before | first))
    stops = np.flatnonzero(inside & np.append(~inside[1:] | first[1:], True)) + 1
    up, down = powers(max(AT_ONCE, 1 << int(n).bit_length()))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    words = mix((total[stops] - total[starts]) * down[starts])
    of = np.searchsorted(ends, starts, side="right")
    counts = np.bincount(of, minlength=len(ends))
    bounds = np.append(0, np.cumsum(counts))
    seeds = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    most = max(0, len(words) - width + 1)
    joined = np.zeros(most, dtype=np.uint64)
    for k in range(width):
        joined += words[k : k + most] * seeds[k]
    whole = of[:most] == of[width - 1 : width - 1 + most] if most else np.zeros(0, dtype=bool)
    joined = mix(joined[whole])
    have = np.maximum(counts - width + 1, 0)
    short = np.flatnonzero(have == 0)
    if len(short):
        single = np.empty(len(short), dtype=np.uint64)
        for i, t in enumerate(short.tolist()):
            own = words[bounds[t] : bounds[t + 1]]
            if len(own):
                single[i] = mix(np.array([(own * seeds[: len(own)]).sum() + np.uint64(len(own))], dtype=np.uint64))[0]
            else:
                single[i] = int.from_bytes(hashlib.blake2b(data[begins[t] : ends[t]].tobytes(), digest_size=8).digest(), "little")
        joined = np.insert(joined, np.append(0, np.cumsum(have))[short], single)
        have[short] = 1
    return joined, have


def shingle_batches(column: pa.Array | pa.ChunkedArray, width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first text, hashes, bounds) of stretches of the column; text i of a stretch has hashes[bounds[i]:bounds[i + 1]], with repeats."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string()))
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, side="right")) - 1)
        hashes, have = _hashed(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], width)
        yield at, hashes, np.append(0, np.cumsum(have))
        at = to


def set_digest(members: np.ndarray) -> bytes:
    """Of a sorted array of distinct hashes."""
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()
