"""Hierarchical packing of documents into training windows of several lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm import textkernel as tk
from sitefold.llm.wordunits import UnitIds, distinct, split_marks
from sitefold.llm.workspace import bound_arrow_batches

TOKENIZER = "word_bpe_49k.json"
END = 2
#: Context sizes, longest first; powers of two.
TIERS = (4096, 2048, 1024, 512)
#: Tokens of the documents that are packed together, and of a step group; bytes of text that are cut into words at once.
GROUP = 1 << 21
STEP = 1 << 16
#: Bytes of a text that are split into words at once.
SEGMENT = 1 << 21


class WordIds:
    """Ids of texts whose tokenizer lowers case, drops white space and never joins across it."""

    def __init__(self, path: str):
        self.units = UnitIds(path, lead="", joint=" ", opens=None, closes=lambda token: token.endswith("</w>"))

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for a, b in tk.row_slices(offsets):
            part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if b > a + 1 or len(part) <= SEGMENT:
                yield from self._few(part, at)
            else:
                yield np.concatenate([next(self._few(x, np.array([0, len(x)]))) for x in _segments(part)])

    def _few(self, raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        starts, ends, first = tk.word_spans(raw, at)
        starts, ends, word = split_marks(raw, starts, ends)
        slots = self.units.slots(*distinct(tk.lowered(raw), starts, ends))
        flat = self.units.gather(slots)
        cuts = np.concatenate(([0], np.cumsum(self.units.sizes(slots))))[word[first]].tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield flat[i:j]


def _segments(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts, cut at white space."""
    begin, text = 0, raw.tobytes()
    while begin < len(raw):
        found = [x for x in (text.find(c, begin + SEGMENT) for c in (b" ", b"\n")) if x >= 0]
        end = min(found, default=len(raw))
        yield raw[begin:end]
        begin = end


_encoders: dict[str, WordIds] = {}

Piece = tuple[int, int, int]  # document, start, length


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, rest: list[Piece] | None = None) -> list[list[Piece]]:
    """Sequences of pieces; each sequence is as long as a tier, or a smaller power of two for the very last tokens.

    A document gives as many whole longest windows as it has; its rest goes to the smallest tier that holds it. Rests open
    windows of their tier, longest first. What a window lacks comes from the shorter rests: the longest that fits, and in
    the end the head of one that is cut. When nothing is left to fill it, the window is cut into powers of two, or its pieces
    go to the list ``rest`` for a later call.
    """
    top, out = tiers[0], []
    rests: list[tuple[int, int, int]] = []  # length, document, start
    for d, n in enumerate(lengths):
        whole = n // top * top
        out += [[(d, s, top)] for s in range(0, whole, top)]
        if n > whole:
            rests.append((n - whole, d, whole))
    rests.sort()
    while rests:
        n, d, s = rests.pop()
        size = min(t for t in tiers if t >= n)
        window, gap = [(d, s, n)], size - n
        while gap and rests:
            k = bisect_right(rests, (gap, 1 << 62, 0)) - 1
            if k >= 0:
                n, d, s = rests.pop(k)
                window.append((d, s, n))
                gap -= n
            else:
                n, d, s = rests.pop(0)
                window.append((d, s, gap))
                insort(rests, (n - gap, d, s + gap))
                gap = 0
        if not gap:
            out.append(window)
            continue
        if rest is not None:
            rest += window
            break
        left = size - gap
        while left:  # the last window only
            part, room = [], 1 << (left.bit_length() - 1)
            left -= room
            while room:
                d, s, n = window[0]
                part.append((d, s, min(n, room)))
                window[:1] = [(d, s + room, n - room)] if n > room else []
                room -= part[-1][2]
            out.append(part)
    return out


def step_groups(sequences: list[list[Piece]], step: int = STEP) -> list[int]:
    """A step for each sequence: one length each, about ``step`` tokens each, attention costs dealt out evenly."""
    by_size: dict[int, list[int]] = {}
    for k, pieces in enumerate(sequences):
        by_size.setdefault(sum(n for _, _, n in pieces), []).append(k)
    out, base = [0] * len(sequences), 0
    for size in sorted(by_size, reverse=True):
        ranked = sorted(by_size[size], key=lambda k: -sum(n * n for _, _, n in sequences[k]))
        steps = max(1, round(len(ranked) * size / step))
        for i, k in enumerate(ranked):
            lap, place = divmod(i, steps)
            out[k] = base + (place if lap % 2 == 0 else steps - 1 - place)
        base += steps
    return out


def _packed(path: str, end: int, tiers: tuple[int, ...], group: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids

    def run(batches) -> Iterator[pa.RecordBatch]:
        words = _encoders.setdefault(path, WordIds(path))
        high = TaskContext.get().partitionId() << 32
        held: list[tuple[object, np.ndarray, int, int]] = []  # document, ids, how many precede them, how many it has
        tokens = sequences = steps = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, tokens, sequences, steps
            rest: list[Piece] = []
            packed = pack([len(x[1]) for x in held], tiers, None if last else rest)
            groups = step_groups(packed)
            rows = []
            for k, pieces in enumerate(packed):
                offset, size = 0, sum(n for _, _, n in pieces)
                for d, s, n in pieces:
                    doc, all_ids, before, total = held[d]
                    ids = all_ids[s : s + n]
                    rows.append((doc, before + s, n, zlib.crc32(ids.astype("<u4").tobytes()), total, high + sequences + k, offset, size, high + steps + groups[k]) + ((ids,) if with_ids else ()))
                    offset += n
            sequences, steps = sequences + len(packed), steps + max(groups, default=0) + 1
            held = [(held[d][0], held[d][1][s : s + n], held[d][2] + s, held[d][3]) for d, s, n in rest]
            tokens = sum(len(x[1]) for x in held)
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            arrays = [pa.array(x, pa.int64()) for x in columns[:9]]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[9]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids(*tk.text_bytes(batch.column(1))), strict=True):
                ids = np.append(ids, np.uint32(end))
                held.append((doc, ids, 0, len(ids)))
                tokens += len(ids)
                if tokens >= group:
                    yield flush(False)
        if held:
            yield flush(True)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end: int = END,
    tiers: tuple[int, ...] = TIERS,
    group: int = GROUP,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group`` and
    ``ids`` where asked for.

    Documents are encoded and packed where they are read, in groups of about ``group`` tokens, so nothing is shuffled and a
    lost task is simply run again. Every id of a document, with ``end`` after its last, lies in exactly one piece. All
    sequences are full: as long as a tier, or for the last tokens of a partition a smaller power of two. ``sequence_id``
    and ``step_group`` hold the partition in their upper bits; a step has one length and about STEP tokens.

    Null texts count as empty: one piece with just ``end``. Repeated rows are packed each; a null doc_id is passed
    through. An empty table gives no rows; other columns are ignored. The tokenizer must drop white space.
    """
    bound_arrow_batches(docs.sparkSession)
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        _packed(path, end, tuple(sorted(tiers, reverse=True)), group, with_ids), schema + ", ids array<int>" * with_ids
    )
