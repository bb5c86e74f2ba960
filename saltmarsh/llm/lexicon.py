"""Minimal acyclic transducers: words to numbers through an automaton with shared suffixes, in one memory-mapped file.

Words are added in byte order and suffixes are shared as they are added (a state equal to an earlier one is
replaced by it). An arc's output is the number of accepted words that come before its branch, so the outputs along a word's
path sum to the word's place in the list: minimal perfect numbering. Each word's token ids are a slice of one array.

File: magic, counts, then int64 arc keys (state * 256 + byte, sorted), int32 targets, int32 outputs, uint8 finals,
int64 id offsets, int32 ids. Arrays are mapped, not read, so workers of a machine share its pages.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

MAGIC = b"SMLX0001"


def build(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file for (word, ids) pairs; of equal words the first counts. The empty word is left out."""
    pairs: dict[bytes, list[int]] = {}
    for word, ids in entries:
        if word:
            pairs.setdefault(word, ids)
    words = sorted(pairs)
    register: dict[tuple, int] = {}
    finals, arcs = [], []  # by state

    def frozen(node: list) -> int:
        """The state equal to this node, whose children are frozen."""
        key = (node[0], tuple(node[1]))
        if (state := register.get(key)) is None:
            state = register[key] = len(finals)
            finals.append(node[0])
            arcs.append(key[1])
        return state

    # A node is [final, [(byte, state)...]]; path holds the open nodes of the last word.
    path, last = [[False, []]], b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for k in range(len(last), common, -1):
            path[k - 1][1].append((last[k - 1], frozen(path.pop())))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1][1].append((last[k - 1], frozen(path.pop())))
    root = frozen(path[0])
    below = [0] * len(finals)  # children are frozen before their parents
    keys, targets, outputs = [], [], []
    for state, own in enumerate(arcs):
        n = int(finals[state])
        for byte, to in own:
            keys.append(state << 8 | byte)
            targets.append(to)
            outputs.append(n)
            n += below[to]
        below[state] = n
    lists = [pairs[w] for w in words]
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.array([i for x in lists for i in x], np.int32)
    head = struct.pack("<8s4q", MAGIC, len(keys), len(finals), len(words), root)
    return b"".join([head, np.array(keys, np.int64).tobytes(), offsets.tobytes(), np.array(targets, np.int32).tobytes(), np.array(outputs, np.int32).tobytes(), flat.tobytes(), np.array(finals, np.uint8).tobytes()])


class Lexicon:
    """A built file, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, n_arcs, n_states, self.n_words, self.root = struct.unpack_from("<8s4q", self.map)
        if magic != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        at = 40

        def take(dtype, n):
            nonlocal at
            found = np.frombuffer(self.map, dtype, n, at)
            at += found.nbytes
            return found

        self.keys, self.offsets = take(np.int64, n_arcs), take(np.int64, self.n_words + 1)
        self.targets, self.outputs = take(np.int32, n_arcs), take(np.int32, n_arcs)
        self.ids, self.finals = take(np.int32, int(self.offsets[-1])), take(np.uint8, n_states)

    def numbers(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """Each word's number, -1 if it has none; all words walk the automaton together, a byte at a time."""
        found = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return found
        words = pa.array(words, pa.binary()) if isinstance(words, list) else words.cast(pa.binary())
        ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
        start, size = ends[:-1], np.diff(ends)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        live = np.flatnonzero(size)
        state, number = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state << 8 | data[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            live, arc, number = live[on], arc[on], number[on]
            state = self.targets[arc].astype(np.int64)
            number += self.outputs[arc]
            step += 1
            over = size[live] == step
            ended = over & (self.finals[state] > 0)
            found[live[ended]] = number[ended]
            live, state, number = live[~over], state[~over], number[~over]
        return found

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist()

    def ids_of_all(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words one after another, and how many each has."""
        begin, sizes = self.offsets[numbers], self.offsets[numbers + 1] - self.offsets[numbers]
        before = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(begin - before, sizes) + np.arange(sizes.sum())].astype(np.int64), sizes
