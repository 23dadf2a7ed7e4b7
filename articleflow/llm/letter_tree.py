"""K-d trees over letter counts of words, and the exact check that two words are one edit apart.

A replaced letter moves a word by one down in a letter and by one up in another, so by an L1 distance of two; an inserted
one moves it by one. Boxes farther than that from a word hold none of its near words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Letters of words in Latin-1, which is also their code point.
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)])
#: Points of a leaf of a tree inside a task, about.
LEAF = 128
#: Compared letters at a time.
CHUNK_LETTERS = 1 << 22


def spelled(words: list[bytes], length: int) -> np.ndarray:
    """(words, length) letters of words of one length."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """(words, letters of the alphabet)."""
    made = np.zeros((len(letters), len(LETTERS)), np.int32)
    for i in range(0, len(letters), 4096):
        piece = letters[i : i + 4096]
        flat = (np.arange(len(piece))[:, None] << 8 | piece).ravel()
        made[i : i + 4096] = np.bincount(flat, minlength=len(piece) << 8).reshape(-1, 256)[:, LETTERS]
    return made


def ladders(counts: np.ndarray) -> np.ndarray:
    """(words, 3) numbers of 64 bits whose differing bits are never more than the L1 distance of the counts.

    Unary counts: up to four of each plain letter, one of each accented letter.
    """
    plain, rare = counts[:, :26], counts[:, 26:]
    bits = [plain >= k for k in (1, 2, 3, 4)]
    wide = np.hstack([*bits[:2], np.zeros((len(counts), 12), bool), *bits[2:], np.zeros((len(counts), 12), bool), rare >= 1])
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


@dataclass(frozen=True)
class Node:
    """A split: counts of ``letter`` up to ``at`` go low. A leaf has a number and no parts."""

    letter: int = -1
    at: int = 0
    low: Node | None = None
    high: Node | None = None
    leaf: int = 0


def grow(counts: np.ndarray, most: int, least: int = 1, first: int = 0) -> tuple[Node, int]:
    """A tree whose leaves hold up to ``most`` points where their counts differ, and the number of the next leaf.

    The letter of the largest variance is cut at its median. Leaves get no smaller than ``least``.
    """
    if len(counts) > most and len(counts) >= 2 * least:
        letter = int(counts.var(0).argmax())
        values = np.sort(counts[:, letter])
        if values[0] < values[-1]:
            at = int(min(values[(len(values) - 1) // 2], values[-1] - 1))
            low = counts[:, letter] <= at
            left, first = grow(counts[low], most, least, first)
            right, first = grow(counts[~low], most, least, first)
            return Node(letter, at, left, right), first
    return Node(leaf=first), first + 1


def leaves_near(tree: Node, counts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf whose box is within ``radius`` of a row's counts; radius 0 gives the own leaf only."""
    rows, leaves = [], []
    open_nodes = [(tree, np.arange(len(counts)), np.zeros(len(counts), np.int32), {})]
    while open_nodes:
        node, at, off, box = open_nodes.pop()
        if node.low is None:
            rows.append(at)
            leaves.append(np.full(len(at), node.leaf))
            continue
        value = counts[at, node.letter]
        least, greatest = box.get(node.letter, (-(1 << 30), 1 << 30))
        before = np.maximum(least - value, 0) + np.maximum(value - greatest, 0)
        for part, span in ((node.low, (least, min(greatest, node.at))), (node.high, (max(least, node.at + 1), greatest))):
            now = off - before + np.maximum(span[0] - value, 0) + np.maximum(value - span[1], 0)
            near = now <= radius
            if near.any():
                open_nodes.append((part, at[near], now[near], {**box, node.letter: span}))
    return np.concatenate(rows), np.concatenate(leaves)


def one_edit(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For rows of letters: one replaced (equal lengths), or one inserted in ``longer``."""
    if shorter.shape[1] == longer.shape[1]:
        return (shorter != longer).sum(1) == 1
    same = shorter == longer[:, :-1]
    ahead = np.where(same.all(1), same.shape[1], same.argmin(1))
    same = (shorter == longer[:, 1:])[:, ::-1]
    behind = np.where(same.all(1), same.shape[1], same.argmin(1))
    return ahead + behind >= shorter.shape[1]


class Points:
    """Words of one length with a tree of their own."""

    def __init__(self, words: list[bytes], length: int):
        self.letters = spelled(words, length)
        counts = letter_counts(self.letters)
        self.tree, leaves = grow(counts, LEAF)
        of = np.zeros(len(words), np.int64)
        row, leaf = leaves_near(self.tree, counts, 0)
        of[row] = leaf
        self.order = np.argsort(of, kind="stable")
        self.starts = np.searchsorted(of[self.order], np.arange(leaves + 1))
        self.counts, self.marks = counts, ladders(counts)

    def near(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``letters``, point) of all pairs one edit apart; ``letters`` are as long as the points or one shorter."""
        radius = 2 if letters.shape[1] == self.letters.shape[1] else 1
        counts = letter_counts(letters)
        marks = ladders(counts)
        row, leaf = leaves_near(self.tree, counts, radius)
        by_leaf = np.argsort(leaf, kind="stable")
        row, leaf = row[by_leaf], leaf[by_leaf]
        cuts = np.searchsorted(leaf, np.arange(len(self.starts)))
        rows, points = [], []
        for k in range(len(self.starts) - 1):
            mine = row[cuts[k] : cuts[k + 1]]
            here = self.order[self.starts[k] : self.starts[k + 1]]
            for h in range(0, len(here), 4 * LEAF):  # equal counts can fill a leaf beyond its size
                piece = here[h : h + 4 * LEAF]
                for i in range(0, len(mine), 4096):
                    asked = mine[i : i + 4096]
                    apart = np.bitwise_count(marks[asked, None] ^ self.marks[None, piece]).sum(2, dtype=np.uint8)
                    x, y = np.nonzero(apart <= radius)
                    x, y = asked[x], piece[y]
                    width = max(1, CHUNK_LETTERS // self.letters.shape[1])
                    for j in range(0, len(x), width):
                        good = one_edit(letters[x[j : j + width]], self.letters[y[j : j + width]])
                        rows.append(x[j : j + width][good])
                        points.append(y[j : j + width][good])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(points)
