"""Deep-shallow sorting of suffixes that are compared up to WINDOW bytes.

Shallow: multikey quicksort by 8-byte letters down to SHALLOW bytes; all groups of equal prefixes are split in the
same numpy sort, and only groups that are still tied go on. Deep: the groups that remain have a long common prefix;
a blind trie, which stores only where strings part and which byte decides, orders each of them.
"""

from __future__ import annotations

import numpy as np

from tablekit.llm.minimizers import WINDOW, eights

SHALLOW = 32


class BlindTrie:
    """A trie of equally long strings with branch positions alone; strings are looked at once, at a single leaf."""

    def __init__(self, text: memoryview, length: int):
        self.text, self.length = text, length
        self.root: list | None = None  # [branch position, {byte: child}] or a leaf [-1, first suffix, all suffixes]

    def add(self, at: int) -> None:
        if self.root is None:
            self.root = [-1, at, [at]]
            return
        own = self.text[at : at + self.length]
        path, node = [], self.root
        while node[0] >= 0:
            path.append(node)
            node = node[1].get(own[node[0]]) or next(iter(node[1].values()))
        other = self.text[node[1] : node[1] + self.length]
        if own == other:
            node[2].append(at)
            return
        k = next(i for i in range(self.length) if own[i] != other[i])
        # The first node that branches at or below the place of difference.
        parent, node = None, self.root
        while node[0] >= 0 and node[0] < k:
            parent, node = node, node[1][own[node[0]]]
        if node[0] == k:
            node[1][own[k]] = [-1, at, [at]]
            return
        branch = [k, {other[k]: node, own[k]: [-1, at, [at]]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][own[parent[0]]] = branch

    def groups(self):
        """Suffixes of equal strings together, strings in order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[2]
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))


def equal_groups(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the suffixes (indices into starts) in order of their first WINDOW bytes, and a number for each
    that suffixes with equal bytes share. Every suffix has WINDOW bytes in data."""
    words = eights(data).byteswap() if len(data) >= 8 else np.zeros(0, np.uint64)
    order = np.arange(len(starts))
    rank = np.zeros(len(starts), np.int64)  # place of the first of its group in the order so far
    tied = order
    depth = 0
    while len(tied) and depth < SHALLOW:
        letter = words[starts[tied] + depth]
        by = np.lexsort((letter, rank[tied]))
        moved, letter = tied[by], letter[by]
        base = rank[moved]
        new = np.concatenate(([True], (base[1:] != base[:-1]) | (letter[1:] != letter[:-1])))
        first = np.concatenate(([True], base[1:] != base[:-1]))
        place = base + np.arange(len(moved)) - np.maximum.accumulate(np.where(first, np.arange(len(moved)), 0))
        order[place] = moved
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(moved)))
        rank[moved] = np.repeat(place[head], size)
        tied = moved[np.repeat(size > 1, size)]
        depth += 8
    if len(tied):
        # Groups whose rest is one string are settled; the others get a trie each.
        rest = [words[starts[tied] + d] for d in (*range(SHALLOW, WINDOW - 7, 8), WINDOW - 8)]
        base = rank[tied]
        head = np.flatnonzero(np.concatenate(([True], base[1:] != base[:-1])))
        same = np.logical_and.reduce([np.minimum.reduceat(w, head) == np.maximum.reduceat(w, head) for w in rest])
        text = memoryview(np.ascontiguousarray(data))
        stop = np.append(head[1:], len(tied))
        for a, b in zip(head[~same].tolist(), stop[~same].tolist()):
            of = {}
            trie = BlindTrie(text, WINDOW)
            for i in tied[a:b].tolist():
                at = int(starts[i])
                of.setdefault(at, []).append(i)
                if len(of[at]) == 1:
                    trie.add(at)
            place = int(base[a])
            for group in trie.groups():
                members = [i for at in group for i in of[at]]
                order[place : place + len(members)] = members
                rank[members] = place
                place += len(members)
    return order, rank[order]
