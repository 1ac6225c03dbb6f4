"""MD5 of many short texts of one length at a time, in arrays; one digest at a time costs several times as much."""

from __future__ import annotations

import math

import numpy as np

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_ORDER = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


#: Steps after which the first word of the state is known: three less than all.
_FIRST = 61
#: Arrays without axes: numbers would be made into such at every step.
_LEFT, _RIGHT = [np.array(s, np.uint32) for s in _SHIFTS], [np.array(32 - s, np.uint32) for s in _SHIFTS]


def _block(state: list[np.ndarray], words: list[tuple[int, np.ndarray | None, np.ndarray | None]], steps: int = 64) -> list[np.ndarray]:
    """The state after a block of 16 words; a word is the sum of a number, a column and a row. After _FIRST steps, its first word alone.

    Arrays are as large as what was read by then: a step whose words are the same in a row is made once for it.
    """
    a, b, c, d = (x.copy() for x in state)
    f = t = u = np.empty((0, 0, 0), np.uint32)
    shape, whole = f.shape, np.broadcast_shapes(a.shape, *(x.shape for w in words for x in w[1:] if x is not None))
    for i, (k, (same, column, row)) in enumerate(zip(_SINES[:steps], (words[g] for g in _ORDER), strict=False)):
        if shape != whole or f.shape != whole:
            shape = np.broadcast_shapes(*(x.shape for x in (a, b, c, d, column, row) if x is not None))
            f, t, u = (x if x.shape == shape else np.empty(shape, np.uint32) for x in (f, t, u))
        if i < 16:
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, f), b, f), d, f)
        elif i < 32:
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, f), d, f), c, f)
        elif i < 48:
            if i % 2:
                np.bitwise_xor(b, u, f)  # of c and d: b and c of the step before
            else:
                np.bitwise_xor(np.bitwise_xor(b, c, u), d, f)
        else:
            np.bitwise_xor(np.bitwise_or(np.invert(d, f), b, f), c, f)
        np.add(f, a, f)
        k = np.array(k + same & 0xFFFFFFFF, np.uint32)
        if column is not None:
            np.add(f, column + k, f)
            if row is not None:
                np.add(f, row, f)
        else:
            np.add(f, k if row is None else row + k, f)
        np.left_shift(f, _LEFT[i], t)
        np.right_shift(f, _RIGHT[i], f)
        np.add(np.bitwise_or(f, t, f), b, f)
        a, b, c, d, f = d, f, b, c, a
    if steps == _FIRST:
        return [state[0] + b]
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def pair_heads(prefix: bytes, left: np.ndarray, between: bytes, right: np.ndarray) -> np.ndarray:
    """The first 32 bits of md5(prefix + l + between + r) for every row l of left and r of right, matrices of bytes; row by row of left."""
    size = len(prefix) + left.shape[1] + len(between) + right.shape[1]
    blocks = (size + 8) // 64 + 1
    at, given = 0, []
    for part, of in ((np.frombuffer(prefix, np.uint8)[None], 0), (left, 1), (np.frombuffer(between, np.uint8)[None], 0), (right, 2), (np.array([[0x80]], np.uint8), 0)):
        text = np.zeros((len(part), 64 * blocks), np.uint8)
        text[:, at : at + part.shape[1]] = part
        given.append((of, range(at // 4, -(-(at + part.shape[1]) // 4)) if part.shape[1] else (), text.view("<u4")))
        at += part.shape[1]
    words: list[list] = [[0, None, None] for _ in range(16 * blocks)]
    for of, where, text in given:
        for w in where:
            words[w][of] = (words[w][0] + int(text[0, w]), np.ascontiguousarray(text[:, w])[:, None], np.ascontiguousarray(text[:, w])[None])[of] if len(text) else np.zeros((0, 1) if of == 1 else (1, 0), np.uint32)
    words[-2][0], words[-1][0] = size * 8 & 0xFFFFFFFF, size * 8 >> 32
    state = [np.full((1, 1), x, np.uint32) for x in _START]
    for i in range(blocks):
        state = _block(state, [tuple(w) for w in words[16 * i : 16 * i + 16]], 64 if i + 1 < blocks else _FIRST)
    return np.broadcast_to(state[0], (len(left), len(right))).reshape(-1).byteswap()
