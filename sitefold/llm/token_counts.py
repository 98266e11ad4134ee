"""Token counts of whole texts; long ones in overlapping chunks, spliced where both encodings are certain."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm import textkernel as tk
from sitefold.llm.wordunits import UnitIds, distinct, split_marks, tokenizer
from sitefold.llm.workspace import bound_arrow_batches

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Bytes of a chunk, of which longer texts have several, and of the first overlap tried.
CHUNK = 1 << 13
OVERLAP = 256
#: White space at which a text may be cut, and characters after which it may.
_SPACE = np.zeros(256, bool)
_SPACE[[*b" \n\t\r"]] = True
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_GRAPHIC[[*b">"]] = False
#: Two first bytes of white space, joiners and marks of order in UTF-8: U+0085, U+00A0, U+1680, U+180E, U+2000 to U+206F,
#: U+3000 to U+303F, U+FEFF. Fixed values.
_ODD = ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)), (0xEF, (0xBB,)))
#: Full-width marks (U+3001, U+3002, U+FF01, U+FF0C, U+FF1A, U+FF1B, U+FF1F) in UTF-8. Fixed values.
_WIDE_MARKS = (0xE38081, 0xE38082, 0xEFBC81, 0xEFBC8C, 0xEFBC9A, 0xEFBC9B, 0xEFBC9F)
#: Classes of ASCII: 1 letters, 2 digits, 3 marks other than the apostrophe.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x27] = 0
_ODD_FIRST = np.zeros(256, bool)
_ODD_FIRST[[*range(0x1C, 0x20), *(x for x, _ in _ODD)]] = True


class PieceCounts:
    """Counts of texts from those of their words, each with the space before it, and of the marks that close words.

    Where words are one space or line break apart and there is no white space of other kinds, these are pieces of the
    pre-tokenizer or whole runs of them (see ``certain``).
    """

    def __init__(self, path: str):
        self.spaced = UnitIds(path, lead=" ", joint=" ", opens=lambda token: token.startswith("Ġ"), closes=None)
        self.bare = UnitIds(path, lead="", joint="", opens=None, closes=None)
        self.line = len(tokenizer(path).encode("\n", add_special_tokens=False).ids)

    def pieces(self, raw: np.ndarray, lead: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Starts of the words of one text, each with what is before it, and their tokens; nothing if it can't be made so.
        With ``lead`` the text starts with a space or line break, as it stands within a longer one."""
        starts, ends, _ = tk.word_spans(raw, np.array([0, len(raw)]))
        if not len(starts) or starts[0] != lead or ends[-1] != len(raw) or len(odd_spaces(raw)):
            return None
        before = raw[np.maximum(starts - 1, 0)]
        if (starts[1:] - ends[:-1] != 1).any() or not ((before == 0x20) | (before == 0x0A))[1 - lead :].all():
            return None
        line, spaced = before == 0x0A, before == 0x20
        line[: 1 - lead], spaced[: 1 - lead] = False, False
        s, e, word = split_marks(raw, starts, ends)
        codes, units = distinct(raw, s, e)
        first = np.zeros(len(s), bool)
        first[word[:-1]] = spaced
        sizes = np.empty(len(s), np.int64)
        for known, some in ((self.spaced, first), (self.bare, ~first)):
            sizes[some] = known.sizes(known.slots(codes[some], units))
        total = np.concatenate(([0], np.cumsum(sizes)))
        tokens = total[word[1:]] - total[word[:-1]] + self.line * line
        starts = starts - 1
        starts[0] = 0
        return starts, tokens

    def count(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each text, and whether it could be made so."""
        starts, ends, first = tk.word_spans(raw, at)
        n = len(at) - 1
        if not len(starts):
            return np.zeros(n, np.int64), np.diff(at) == 0
        row = np.repeat(np.arange(n), np.diff(first))
        lead = raw[np.maximum(starts - 1, 0)]
        heads = first[:-1][np.diff(first) > 0]
        gap = np.ones(len(starts), bool)
        gap[1:] = (starts[1:] - ends[:-1] == 1) & ((lead[1:] == 0x20) | (lead[1:] == 0x0A))
        gap[heads] = starts[heads] == at[row[heads]]
        fine = np.ones(n, bool)
        fine[row[~gap]] = False
        tails = first[1:][np.diff(first) > 0] - 1
        fine[row[tails][ends[tails] != at[row[tails] + 1]]] = False
        fine[(np.diff(first) == 0) & (np.diff(at) > 0)] = False
        fine[np.searchsorted(at, odd_spaces(raw), "right") - 1] = False
        spaced = lead == 0x20
        spaced[heads] = False
        use = fine[row]
        lines = np.bincount(row[use & (lead == 0x0A)], minlength=n) - np.bincount(row[heads][use[heads] & (lead[heads] == 0x0A)], minlength=n)
        out = lines * self.line
        s, e, word = split_marks(raw, starts[use], ends[use])
        spaced_unit = np.zeros(len(s), bool)
        spaced_unit[word[:-1]] = spaced[use]
        unit_row = np.repeat(row[use], np.diff(word))
        codes, distinct_units = distinct(raw, s, e)
        for units, some in ((self.spaced, spaced_unit), (self.bare, ~spaced_unit)):
            slots = units.slots(codes[some], distinct_units)
            out = out + np.bincount(unit_row[some], weights=units.sizes(slots), minlength=n).astype(np.int64)
        return out, fine


def odd_spaces(raw: np.ndarray) -> np.ndarray:
    """Positions of characters, other than ASCII space to carriage return, that are or may be taken for white space."""
    first = np.flatnonzero(_ODD_FIRST[raw])
    if not len(first):
        return first
    first = first[(raw[first] < 0x80) | (first + 1 < len(raw))]
    second = raw[np.minimum(first + 1, len(raw) - 1)]
    odd = raw[first] < 0x80
    for lead, follow in _ODD:
        odd |= (raw[first] == lead) & np.isin(second, follow)
    return first[odd]


def certain(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Those of these bytes before and after which the tokens don't depend on each other: white space right after a character
    that is none. No piece of the pre-tokenizer holds white space behind another character, and special tokens hold none.

    An end bracket doesn't count, as special tokens may take white space after them; nor do characters other than ASCII, letters
    and digits, of which some might be taken for white space.
    """
    places = places[_SPACE[raw[places]] & (places > 0)]
    before = raw[places - 1]
    sure = _GRAPHIC[before]
    for k in np.flatnonzero(before >= 0x80).tolist():
        sure[k] = raw[_edge(raw, places[k] - 1) : places[k]].tobytes().decode().isalnum()
    return places[sure]


def _edge(raw: np.ndarray, at: int) -> int:
    """The start of the character that this byte belongs to."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


Encode = Callable[[int, int], tuple[np.ndarray, np.ndarray]]


def class_edges(raw: np.ndarray, places: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Those of these bytes at which letters, digits and marks meet such that every pre-tokenizer of bytes cuts there: a letter
    and a digit, or a letter or digit and the mark after it (an apostrophe may belong to what follows). ASCII, and Chinese
    ideographs before full-width marks. ``free`` says which bytes no special token holds, so that none lies across the edge.
    """
    places = places[(places > 0) & (places < len(raw))]
    before, after = raw[places - 1], raw[places]
    b, a = _CLASS[before], _CLASS[after]
    sure = (((b == 1) & (a == 2)) | ((b == 1) | (b == 2)) & (a == 3)) & free[after] | (b == 2) & (a == 1) & free[before]
    wide = np.flatnonzero(((after == 0xE3) | (after == 0xEF)) & (before >= 0x80) & (places >= 3) & (places + 2 < len(raw)))
    if len(wide):
        at = places[wide]
        mark = (raw[at].astype(np.int64) << 16) | (raw[at + 1].astype(np.int64) << 8) | raw[at + 2]
        lead, second = raw[at - 3], raw[at - 2]
        ideograph = ((lead >= 0xE5) & (lead <= 0xE8)) | ((lead == 0xE4) & (second >= 0xB8)) | ((lead == 0xE9) & (second < 0xBE))
        sure[wide] |= ideograph & np.isin(mark, _WIDE_MARKS)
    return places[sure]


_free: dict[str, np.ndarray] = {}


def free_bytes(path: str) -> np.ndarray:
    """Which bytes occur in none of the tokenizer's special tokens."""
    if path not in _free:
        _free[path] = np.ones(256, bool)
        for token in tokenizer(path).get_added_tokens_decoder().values():
            _free[path][[*token.content.encode()]] = False
    return _free[path]


def encode_long(raw: np.ndarray, encode: Encode, chunk: int = CHUNK, overlap: int = OVERLAP, free: np.ndarray | None = None) -> np.ndarray:
    """What ``encode`` gives for the pieces of a text, as if it were encoded whole.

    ``encode`` takes the bounds of a chunk in bytes, and gives the starts of pieces in it and a value of each. Each chunk begins
    ``overlap`` bytes before the last one's end. Two encodings are joined at the last common start that is certain, by white
    space, or with ``free`` also by the classes of the characters there. Where the overlap has none it is widened, to a quarter of
    what has been read since the last joint; then all of this is read again with as much again behind it, so that however
    long a stretch without a certain place is, no more than a few times its bytes are encoded.
    """
    out = []
    begin, end = 0, _edge(raw, min(chunk, len(raw)))
    starts, values = encode(begin, end)
    while end < len(raw):
        width, joint = overlap, None
        while joint is None and (width == overlap or width <= (end - begin) // 4):
            start, stop = _edge(raw, max(begin, end - width)), _edge(raw, min(end + chunk, len(raw)))
            others, theirs = encode(start, stop)
            both = np.intersect1d(starts[np.searchsorted(starts, start, "right") :], others[others < end])
            common = certain(raw, both)
            if free is not None:
                common = np.union1d(common, class_edges(raw, both, free))
            joint = int(common[-1]) if len(common) else None
            width *= 4
        if joint is None:
            stop = _edge(raw, min(end + max(chunk, end - begin), len(raw)))
            (starts, values), end = encode(begin, stop), stop
            continue
        out.append(values[starts < joint])
        keep = others >= joint
        starts, values, begin, end = others[keep], theirs[keep], joint, stop
    return np.concatenate([*out, values])


def by_library(raw: np.ndarray, path: str) -> Encode:
    """Every token a piece, its id the value. Offsets follow from the bytes of the tokens, as the library's leave spaces out."""
    t, widths = tokenizer(path), token_widths(path)

    def encode(a, b):
        ids = np.array(t.encode(raw[a:b].tobytes().decode(), add_special_tokens=False).ids, np.int64)
        ends = np.cumsum(widths[ids])
        if len(ids) and ends[-1] != b - a:
            raise ValueError("not a tokenizer of bytes")
        return a + ends - widths[ids], ids

    return encode


def by_words(raw: np.ndarray, pieces: PieceCounts, path: str) -> Encode:
    """Every word a piece, the number of its tokens the value; the library's tokens where white space is unusual.

    What lies before the first or after the last certain place of a chunk is left to its neighbours.
    """
    library = by_library(raw, path)

    def encode(a, b):
        sure = certain(raw, np.flatnonzero(_SPACE[raw[a:b]]) + a) if a or b < len(raw) else np.zeros(0, np.int64)
        found = None
        if len(sure) or a == 0 and b == len(raw):
            p, q = 0 if a == 0 else int(sure[0]), b if b == len(raw) else int(sure[-1])
            found = pieces.pieces(raw[p:q], p > 0)
        if found is not None:
            return p + found[0], found[1]
        starts, ids = library(a, b)
        return starts, np.ones(len(ids), np.int64)

    return encode


_counters: dict[str, PieceCounts] = {}
_widths: dict[str, np.ndarray] = {}


def token_widths(path: str) -> np.ndarray:
    """The bytes of each token; the vocabulary writes each byte as one character."""
    if path not in _widths:
        vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
        _widths[path] = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            _widths[path][k] = len(token)
    return _widths[path]


def counts(raw: np.ndarray, offsets: np.ndarray, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and the chunks in which it was encoded. Only its own length decides how a text is encoded."""
    t, pieces = tokenizer(path), _counters.setdefault(path, PieceCounts(path))
    n_tokens, n_chunks = np.zeros(len(offsets) - 1, np.int64), np.ones(len(offsets) - 1, np.int64)

    long = np.diff(offsets) > chunk
    for k in np.flatnonzero(long):
        text = raw[offsets[k] : offsets[k + 1]]
        encode, bounds = by_words(text, pieces, path), []
        n_tokens[k] = encode_long(text, lambda a, b: (bounds.append(a), encode(a, b))[1], chunk, overlap, free_bytes(path)).sum()  # noqa: B023
        n_chunks[k] = len(bounds)
    rest = np.flatnonzero(~long)
    sizes = np.diff(offsets)[rest]
    at = np.concatenate(([0], np.cumsum(sizes)))
    short = raw[np.repeat(~long, np.diff(offsets))] if long.any() else raw
    for a, b in tk.row_slices(at):
        part, edges = short[at[a] : at[b]], at[a : b + 1] - at[a]
        n_tokens[rest[a:b]], made = pieces.count(part, edges)
        for i in np.flatnonzero(~made).tolist():
            n_tokens[rest[a + i]] = len(t.encode(part[edges[i] : edges[i + 1]].tobytes().decode(), add_special_tokens=False).ids)
    return n_tokens, n_chunks


def _counted(path: str, chunk: int, overlap: int):
    def run(batches):
        for batch in batches:
            n_tokens, n_chunks = counts(*tk.text_bytes(batch.column(1)), path, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_tokens), pa.array(n_chunks)], ["doc_id", "n_bytes", "n_tokens", "n_chunks"])

    return run


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, n_chunks, over_limit)``, one row per input row, in one pass without a shuffle.

    Every text of more than ``chunk`` bytes is encoded in overlapping chunks, which are spliced; ``n_chunks`` says in how many
    (an overlap that had to be widened counts again), and shorter ones are one chunk. Within a chunk the library encodes each
    distinct word once, and all of it where white space is unusual. The tokenizer must be a BPE of bytes.

    Counts are those of the tokenizer's library for the whole text, without added special tokens; strings of special
    tokens inside texts are handled as the library does by default. Null texts count as empty: 0 bytes and tokens. Null or
    repeated doc_ids are passed through. Other columns are ignored. ``tokenizer_path`` must exist on every executor.
    """
    bound_arrow_batches(docs.sparkSession)
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(
        _counted(path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long, n_chunks long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
