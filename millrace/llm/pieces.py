"""Ids of recurring pieces of text: each distinct piece is coded once, documents are joined from a table by array gathers."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Distinct pieces and characters that a worker's table holds before it starts anew.
TABLE_PIECES, TABLE_CHARS = 800_000, 16_000_000


class PieceTable:
    """Pieces by number, with their ids end to end.

    `code` gives the ids of new pieces: all ids in one array, and how many each piece has. A full table forgets what
    the pieces at hand do not need.
    """

    def __init__(self, code: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], pieces: int = TABLE_PIECES, chars: int = TABLE_CHARS):
        self.code, self.most, self.most_chars = code, pieces, chars
        self.numbers: dict[str, int] = {}
        self.chars = 0
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self, found: np.ndarray) -> np.ndarray:
        """Keeps the pieces whose numbers are in `found` (-1: unknown), and returns their new numbers."""
        kept, new = np.unique(found[found >= 0], return_inverse=True)
        names = list(self.numbers)
        pieces = [names[i] for i in kept.tolist()]
        self.numbers = dict(zip(pieces, range(len(pieces)), strict=True))
        self.chars = sum(map(len, pieces))
        lengths = self.lengths[kept]
        starts = np.cumsum(lengths) - lengths
        self.flat = self.flat[np.arange(lengths.sum()) + np.repeat(self.starts[kept] - starts, lengths)]
        self.starts, self.lengths = starts, lengths
        found[found >= 0] = new
        return found

    def numbered(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece, good until the next call."""
        found = np.fromiter(map(self.numbers.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(self.numbers) > self.most or self.chars > self.most_chars:
            found = self.forget(found)
        unknown = np.flatnonzero(found < 0).tolist()
        if unknown:
            missing = list(dict.fromkeys([pieces[i] for i in unknown]))
            ids, lengths = self.code(missing)
            first = len(self.numbers)
            self.numbers.update(zip(missing, range(first, first + len(missing)), strict=True))
            self.chars += sum(map(len, missing))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.flat = np.concatenate((self.flat, ids.astype(np.int32)))
            found[unknown] = [self.numbers[pieces[i]] for i in unknown]
        return found

    def joined(self, pieces: np.ndarray, ends: np.ndarray) -> pa.ListArray:
        """The ids of documents; `pieces` are numbers, `ends` (from 0 on) where each document's pieces end."""
        lengths = self.lengths[pieces]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        source = np.arange(upto[-1]) + np.repeat(self.starts[pieces] - upto[:-1], lengths)
        return pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), pa.array(self.flat[source], pa.int32()))


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as PieceTable's coder returns them."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((x for part in ids for x in part), np.int32, int(lengths.sum())), lengths
