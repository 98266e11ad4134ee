"""Ids of whole texts from those of their units: words without a closing mark, and the marks.

A tokenizer whose pre-tokenizer cuts between two units encodes each of them alike wherever it stands. So a unit that has
been seen is looked up, by its bytes, and the library sees only new ones.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Units that a Python worker remembers at most, and their bytes; it then starts anew.
KNOWN = 500_000
KNOWN_BYTES = 32 << 20
SPECIAL = "<|endoftext|>"
_MARK = np.zeros(256, bool)
_MARK[[*b".,!?;:"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LATIN = np.zeros(256, bool)  # second bytes of the letters U+00C0 to U+00FF
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, read once in each Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def split_marks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of units, and for each word the index of its first unit (one more at the end).

    A mark is cut off if an ASCII letter or digit or a Latin-1 letter precedes it: letters, digits and other characters
    are always different pieces.
    """
    if not len(starts):
        return starts, ends, np.zeros(1, np.int64)
    before = raw[np.maximum(ends - 2, 0)]
    cut = (ends - starts > 1) & _MARK[raw[ends - 1]]
    cut &= _ALNUM[before] | (ends - starts > 2) & (raw[np.maximum(ends - 3, 0)] == 0xC3) & _LATIN[before]
    at = np.concatenate(([0], np.cumsum(1 + cut)))
    s, e = np.repeat(starts, 1 + cut), np.repeat(ends, 1 + cut)
    last = at[1:][cut] - 1
    s[last] = ends[cut] - 1
    e[last - 1] = ends[cut] - 1
    return s, e, at


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each unit the index of its bytes in a list of distinct ones."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    edges = np.empty(2 * len(starts), np.int64)  # units and what lies between them, by turns
    edges[::2], edges[1::2] = starts, ends
    all_parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = all_parts.dictionary_encode()
    return coded.indices.to_numpy()[::2], coded.dictionary.to_pylist()


def _letters(unit: str) -> bool:
    return unit.isalpha() and max(unit) < "ɐ" and "İ" not in unit


class UnitIds:
    """Remembers the ids of units.

    ``lead`` goes before each unit when it is encoded. ``letters`` encodes many units of Latin letters in one call: it gets
    their text and says which of the ids begin or end a unit. Other units are joined by a special token, which splits the
    library's input before anything else happens; those that may hold one go alone.
    """

    def __init__(self, path: str, lead: str, joint: str, opens: Callable[[str], bool] | None, closes: Callable[[str], bool] | None):
        self.tokenizer, self.lead, self.joint = tokenizer(path), lead, joint
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens = opens is not None
        self.together = bool(opens or closes)
        for token, k in vocabulary.items() if self.together else ():
            self.edge[k] = (opens or closes)(token)
        self.special = self.tokenizer.token_to_id(SPECIAL)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.at = np.zeros(KNOWN // 8, np.int64)
        self.flat = np.zeros(KNOWN // 4, np.uint32)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _new(self, units: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """``(places, ids, lengths)``"""
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for k, x in enumerate(units):
            kinds[0 if self.together and _letters(x) else 2 if "<|" in x else 1].append(k)
        for n in range(0, len(kinds[0]), 4096):
            some = kinds[0][n : n + 4096]
            ids = self._encode(self.lead + self.joint.join([units[k] for k in some]))
            edges = np.flatnonzero(self.edge[ids])
            if self.opens:
                lengths = np.diff(np.append(edges, len(ids)))
            else:
                lengths = np.diff(np.concatenate(([-1], edges)))
            if len(lengths) != len(some) or lengths.sum() != len(ids):
                raise ValueError("the tokenizer does not keep units apart")
            yield some, ids, lengths
        for n in range(0, len(kinds[1]), 4096):
            some = kinds[1][n : n + 4096]
            ids = self._encode(SPECIAL.join([self.lead + units[k] for k in some]))
            cuts = ids == self.special
            yield some, ids[~cuts], np.diff(np.concatenate(([-1], np.flatnonzero(cuts), [len(ids)]))) - 1
        for k in kinds[2]:
            ids = self._encode(self.lead + units[k])
            yield [k], ids, np.array([len(ids)])

    def slots(self, codes: np.ndarray, units: list[bytes]) -> np.ndarray:
        """For each code, an index into ``units``, the place of its ids: ``flat[at[slot] : at[slot + 1]]``."""
        if not len(codes):
            return np.zeros(0, np.int64)
        wanted = np.zeros(len(units), bool)
        wanted[codes] = True
        places = np.flatnonzero(wanted).tolist()
        found = [self.known.get(units[k]) for k in places]
        new = [n for n, x in enumerate(found) if x is None]
        if new and (len(self.known) + len(new) > KNOWN or self.held > KNOWN_BYTES):
            self.clear()
            new = list(range(len(places)))
        if new:
            for some, ids, lengths in self._new([units[places[n]].decode() for n in new]):
                base = len(self.known)
                stop = self.at[base] + np.cumsum(lengths)
                while base + len(some) + 1 > len(self.at):
                    self.at = np.append(self.at, np.zeros_like(self.at))
                while stop[-1] > len(self.flat):
                    self.flat = np.append(self.flat, np.zeros_like(self.flat))
                self.flat[self.at[base] : stop[-1]] = ids
                self.at[base + 1 : base + len(some) + 1] = stop
                for slot, k in enumerate(some, base):
                    unit = units[places[new[k]]]
                    self.known[unit] = found[new[k]] = slot
                    self.held += len(unit)
        table = np.zeros(len(units), np.int64)
        table[places] = found
        return table[codes]

    def sizes(self, slots: np.ndarray) -> np.ndarray:
        return self.at[slots + 1] - self.at[slots]

    def gather(self, slots: np.ndarray) -> np.ndarray:
        size = self.sizes(slots)
        shift = np.repeat(self.at[slots] - np.cumsum(size) + size, size)
        return self.flat[np.arange(len(shift)) + shift]
