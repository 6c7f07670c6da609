"""Places in byte strings that any two equal windows have in common.

Of the CORE-byte strings in every WINDOW bytes the one with the least hash is marked. Equal windows mark the same
place, so two documents that share a window share a marked core, at the same distance from the window's start.
"""

from __future__ import annotations

import numpy as np

WINDOW, CORE = 50, 24
#: Cores in a window, less one: how far a window can begin before its marked core.
REACH = WINDOW - CORE
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one number, for all places with 8 bytes left; data is uint8."""
    padded = np.ascontiguousarray(data)
    n = len(padded) - 7
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), "<u8", padded, 0, (1,)).astype(np.uint64)


def core_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from every place on, from the places' eights."""
    n = len(words) - 16
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mixed(words[:n] * _ODD[0] + (words[8 : n + 8] * _ODD[1] ^ (words[16 : n + 16] * _ODD[2] >> np.uint64(7))) + words[16 : n + 16] * _ODD[2])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every `width` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = pick(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def marked(hashes: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose hash is the least of the cores of some window, all of them where several are equally small, each
    with the first and the last of the windows that mark it (those between do so too).
    skip: windows, by their first place, that do not count."""
    width = REACH + 1
    if len(hashes) < width:
        return (np.zeros(0, np.int64),) * 3
    least = _sliding(hashes, width, np.minimum)
    if skip is not None:
        least = np.where(skip, np.uint64(0), least)
    # The greatest of the minima of the windows that hold a place: the place is marked if that is its own hash.
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), width, np.maximum) == hashes)
    first, last = np.maximum(at - REACH, 0), np.minimum(at, len(least) - 1)
    for place, step in ((first, 1), (last, -1)):
        rows = np.arange(len(at))
        while len(rows):
            rows = rows[least[place[rows]] != hashes[at[rows]]]
            place[rows] += step
    return at, first, last
