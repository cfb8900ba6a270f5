"""Reproducible draws: uniform numbers from a seed, a row's key and a place, the same on any partitioning.

Python, Spark and DuckDB give the same number: the first 32 bits of md5("seed:key:place") over 2^32. Where a row
needs many draws in a row, draw i is the (i mod 4)-th 32 bits of md5("seed:key:i / 4"), so a digest gives four.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, key: Column, place: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), place.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def draw(seed: int, key: str, place: object) -> float:
    return int(hashlib.md5(f"{seed}:{key}:{place}".encode()).hexdigest()[:8], 16) / 4294967296.0


def duck_uniform(seed: int, key: str, place: str) -> str:
    """The same as DuckDB SQL, of two SQL expressions."""
    return f"(('0x' || substr(md5('{seed}:' || ({key})::VARCHAR || ':' || ({place})::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def draws(seed: int, key: str, n: int) -> np.ndarray:
    """n draws in a row, four a digest."""
    head = f"{seed}:{key}:"
    digests = b"".join([hashlib.md5(f"{head}{k}".encode()).digest() for k in range(-(-n // 4))])
    return np.frombuffer(digests, ">u4")[:n] / 4294967296.0


def duck_draws(seed: int, key: str, i: str) -> str:
    """Draw i of draws() as DuckDB SQL."""
    return f"(('0x' || substr(md5('{seed}:' || ({key})::VARCHAR || ':' || (({i}) // 4)::VARCHAR), 8 * (({i}) % 4)::INT + 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(np.sin(i + 1)) * 4294967296) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Digests that are worked out at once.
_AT_ONCE = 1 << 14


def _md5(words: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Digests (n rows of four numbers, the first byte highest) of messages of one block: its words that aren't zero."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, np.uint32(_SINES[i]), out=f)
        if (found := words.get((i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16)) is not None:
            np.add(f, found, out=f)
        shift = _SHIFTS[turn][i % 4]
        np.right_shift(f, np.uint32(32 - shift), out=g)
        np.left_shift(f, np.uint32(shift), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    out = np.empty((n, 4), np.uint32)
    for k, x in enumerate((a, b, c, d)):
        np.add(x, np.uint32(_START[k]), out=out[:, k])
    return out.byteswap(inplace=True)


@lru_cache(64)
def _ends(size: int, n: int) -> np.ndarray:
    """What comes after `size` bytes in the messages of numbers below n: digits, the end, the length in bits."""
    rows = [(b"\0" * size + (t := str(k).encode()) + b"\x80").ljust(56, b"\0") + (8 * (size + len(t))).to_bytes(8, "little") for k in range(n)]
    return np.frombuffer(b"".join(rows), "<u4").reshape(n, 16)


def many_draws(seed: int, keys: list[str], n: np.ndarray) -> np.ndarray:
    """draws() of many keys, n[i] of key i one after another, before their division: whole numbers below 2^32."""
    n = np.asarray(n, np.int64)
    blocks = -(-n // 4)
    heads = [f"{seed}:{k}:".encode() for k in keys]
    sizes, first = np.array([len(h) for h in heads], np.int64), np.cumsum(blocks) - blocks
    out = np.empty((int(blocks.sum()), 4), np.uint32)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero((sizes == size) & (blocks > 0))
        if not len(rows):
            continue
        most = int(blocks[rows].max())
        if size + len(str(most)) > 55:  # more than a block
            for r in rows.tolist():
                digests = b"".join([hashlib.md5(heads[r] + str(k).encode()).digest() for k in range(blocks[r])])
                out[first[r] : first[r] + blocks[r]] = np.frombuffer(digests, ">u4").reshape(-1, 4)
            continue
        starts, ends = np.frombuffer(b"".join([heads[r].ljust(64, b"\0") for r in rows.tolist()]), "<u4").reshape(-1, 16), _ends(size, -(-most // 256) * 256) if most < 4096 else _ends.__wrapped__(size, most)
        heads_in, ends_in = (list(map(np.ascontiguousarray, x.T)) for x in (starts, ends[:most]))
        used = [(w, heads_in[w].any(), ends_in[w].any()) for w in range(16)]
        stops = np.cumsum(blocks[rows])
        for low in range(0, int(stops[-1]), _AT_ONCE):
            at = np.arange(low, min(low + _AT_ONCE, int(stops[-1])))
            line = np.searchsorted(stops, at, "right")
            k = at - (stops - blocks[rows])[line]
            words = {w: heads_in[w][line] | ends_in[w][k] if a and b else heads_in[w][line] if a else ends_in[w][k] for w, a, b in used if a or b}
            out[first[rows[line]] + k] = _md5(words, len(at))
    flat = out.ravel()
    kept = np.arange(len(flat)) - np.repeat(4 * first, 4 * blocks) < np.repeat(n, 4 * blocks)
    return flat if kept.all() else flat[kept]
