"""Deep-shallow sorting of byte strings: multikey quicksort first, blind tries for what stays together."""

from __future__ import annotations

import numpy as np


def byte_rows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of one matrix, padded with zeros to whole words of 8 bytes, and their lengths."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    width = max(8, -(-int(lengths.max(initial=0)) // 8) * 8)
    rows = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    return rows, lengths


def common_prefixes(rows: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each string in ``order`` the length of the prefix it shares with the one before it (the first: 0)."""
    same = rows[order[1:]] == rows[order[:-1]]
    shared = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return np.concatenate(([0], np.minimum(shared, np.minimum(lengths[order[1:]], lengths[order[:-1]]))))


class BlindTrie:
    """Orders strings that share a long prefix; inner nodes keep only where their strings part, and by which byte.

    A search follows branch bytes without looking at what lies between, and so may end in a wrong
    leaf; one comparison with that leaf tells how far the new string agrees, and at that depth it is
    put in.
    """

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list = [None, [first]]  # leaf: [None, members]; node: [depth, {byte: child}]

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def add(self, i: int) -> None:
        node = self.root
        while node[0] is not None:
            node = node[1].get(self._byte(i, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        own = self.strings[i]
        if own == other:
            node[1].append(i)
            return
        n = min(len(own), len(other))
        unlike = int.from_bytes(own[:n], "big") ^ int.from_bytes(other[:n], "big")
        agree = n - (unlike.bit_length() + 7) // 8
        node, parent, branch = self.root, None, 0
        while node[0] is not None and node[0] <= agree:
            branch = self._byte(i, node[0])
            parent, node = node, node[1].get(branch)
            if node is None:
                parent[1][branch] = [None, [i]]
                return
        leaf = node
        while leaf[0] is not None:
            leaf = next(iter(leaf[1].values()))
        split = [agree, {self._byte(leaf[1][0], agree): node, self._byte(i, agree): [None, [i]]}]
        if parent is None:
            self.root = split
        else:
            parent[1][branch] = split

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            depth, below = stack.pop()
            if depth is None:
                out += below
            else:
                stack += [below[b] for b in sorted(below, reverse=True)]
        return out


def deep_shallow_order(strings: list[bytes], rows: np.ndarray, shallow: int = 32) -> np.ndarray:
    """Positions of the strings in byte order, a shorter string before those it starts; equal ones in any order."""
    words = rows.view(">u8").astype(np.uint64)
    deep = min(shallow // 8, words.shape[1])
    out: list[int] = []
    stack = [(np.arange(len(strings)), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) == 1:
            out.append(int(part[0]))
        elif depth == deep:
            first, *rest = part.tolist()
            trie = BlindTrie(strings, first)
            for i in rest:
                trie.add(i)
            out += trie.ordered()
        elif len(part):
            key = words[part, depth]
            pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
            below, above = key < pivot, key > pivot
            stack += [(part[above], depth), (part[~(below | above)], depth + 1), (part[below], depth)]
    return np.array(out, np.int64)
