"""Texts as words with single spaces between them, and a table of the words met so far: what the two encoders share.

Arrow cuts the texts, numbers their words and joins each text's byte strings, so Python only sees words that are new to a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any kind but single spaces and line feeds between words, for RE2.
ODD_SPACE = r"[\t\x0B-\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"


def in_blocks(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Slices of about that many bytes, of one text at least; texts above a gigabyte get wide offsets."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        block = texts.slice(at, stop - at)
        yield block.cast(pa.large_string()) if ends[stop - 1] - before > 1 << 30 else block
        at = stop


def oddly_spaced(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)


class WordTable:
    """Words and the byte strings that belong to each, as Arrow arrays; forgets all when it has more than `limit`."""

    def __init__(self, columns: int, limit: int):
        self.columns, self.limit = columns, limit
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.values = [pa.array([], pa.binary()) for _ in range(self.columns)]

    def _places(self, words: pa.Array, learn: Callable[[list[str]], list[list[bytes]]]) -> np.ndarray:
        """Places of different words; learn(new words) gives the byte strings, a list for each column."""
        if len(self.words) > self.limit:
            self._forget()
        place = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().copy()
        lacking = np.flatnonzero(place < 0)
        if len(lacking):
            new = words.take(pa.array(lacking))
            place[lacking] = len(self.words) + np.arange(len(new))
            got = learn(new.to_pylist())
            self.values = [pa.concat_arrays([old, pa.array(more, pa.binary())]) for old, more in zip(self.values, got, strict=True)]
            self.words = pa.concat_arrays([self.words, new])
        return place

    def joined(self, texts: pa.Array, learn: Callable[[list[str]], list[list[bytes]]]) -> list[list[bytes]]:
        """For each column, each text's byte strings joined. Texts are words with single spaces between them, one word at least."""
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        place = pa.array(self._places(coded.dictionary.cast(pa.string()), learn)).take(coded.indices)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
        out = []
        for column in self.values:
            taken = column.cast(pa.large_binary()).take(place)
            offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
            raw, cut = taken.buffers()[2].to_pybytes() if taken.buffers()[2] else b"", offsets[ends].tolist()
            out.append([raw[lo:hi] for lo, hi in zip([0, *cut[:-1]], cut, strict=True)])
            del taken, raw
        pa.default_memory_pool().release_unused()
        return out
