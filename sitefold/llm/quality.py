"""Quality scores by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm import textkernel as tk
from sitefold.llm.workspace import Workspace, bound_arrow_batches

FOLDS = 5
THRESHOLD = 0.3
#: Share of the pooled variances in each class covariance, and the least variance.
SHRINKAGE = 0.1
FLOOR = 1e-4
#: Log densities are divided by this before they become a score: statistics of one document repeat each other's evidence.
TEMPERATURE = 4.0
FEATURES = (
    "words", "word_bytes", "word_spread", "capitals", "digits", "marks", "symbols", "bars", "exclaims", "ends",
    "no_ascii", "short_words", "variety", "top_word", "echoes", "lines", "line_words", "repeated_lines", "symbol_tails",
)

_KINDS = np.zeros((7, 256), bool)
_KINDS[0, [*range(0x41, 0x5B)]] = True
_KINDS[1, [*range(0x30, 0x3A)]] = True
_KINDS[2, [*b",;:'\"()-"]] = True
_KINDS[3, [*b"#$%&*+/<=>@[\\]^_`{}~"]] = True
_KINDS[4, [*b"|"]] = True
_KINDS[5, [*b"!"]] = True
_KINDS[6, [*b".?"]] = True
_HIGH = np.arange(256) >= 0x80
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_ODD_TAIL = ~(_LETTER | _HIGH | _KINDS[1] | _KINDS[2] | _KINDS[6])


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text: logarithms of sizes, and of shares with a small constant added."""
    rows = []
    for a, b in tk.row_slices(offsets):
        part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = tk.word_spans(part, at)
        hashed, sizes = tk.word_hashes(part, starts, ends, lower=True), (ends - starts).astype(float)
        n_bytes, n_words = np.diff(at).astype(float), np.diff(first).astype(float)
        letters = _sums(_LETTER[part], at)
        kinds = [_sums(k[part], at) for k in _KINDS]
        mean = (_sums(sizes, first) + 5) / (n_words + 1)
        spread = np.sqrt((_sums(sizes**2, first) + 34) / (n_words + 1) - np.minimum(mean**2, (_sums(sizes**2, first) + 34) / (n_words + 1) - 0.1))
        echo = np.zeros(len(hashed))
        if len(hashed):
            echo[1:] = hashed[1:] == hashed[:-1]
            echo[first[:-1][first[:-1] < len(hashed)]] = 0
        tails = _sums(_ODD_TAIL[part[ends - 1]] if len(ends) else np.zeros(0), first)
        distinct, top = np.zeros(b - a), np.zeros(b - a)
        for k, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if j > i:
                counts = np.unique(hashed[i:j], return_counts=True)[1]
                distinct[k], top[k] = len(counts), counts.max()
        breaks = part == 0x0A
        line_first = breaks.copy()
        line_last = breaks.copy()
        line_first[1:], line_last[:-1] = breaks[:-1], breaks[1:]
        if len(part):
            line_first[at[:-1][at[:-1] < len(part)]] = True
            line_last[at[1:][at[1:] > 0] - 1] = True
        begins, finishes = np.flatnonzero(line_first & ~breaks), np.flatnonzero(line_last & ~breaks) + 1
        line_at = np.searchsorted(begins, at)
        line_hash = tk.word_hashes(part, begins, finishes, lower=False)
        n_lines, repeated = np.diff(line_at).astype(float), np.zeros(b - a)
        for k, (i, j) in enumerate(zip(line_at[:-1].tolist(), line_at[1:].tolist(), strict=True)):
            if j > i + 1:
                repeated[k] = j - i - len(np.unique(line_hash[i:j]))
        share = lambda x, n: np.log(x / (n + 1e-9) * (n / (n + 8)) + 0.005)  # noqa: E731  few words say little
        rows.append(np.column_stack([
            np.log1p(n_words), mean, spread, share(kinds[0], letters), share(kinds[1], n_bytes), share(kinds[2], n_words), share(kinds[3], n_words),
            share(kinds[4], n_words), share(kinds[5], n_words), share(kinds[6], n_words), share(_sums(_HIGH[part], at), n_bytes),
            _sums(sizes <= 3, first) / (n_words + 4), np.log((distinct + 4) / (n_words + 4)), np.log((top + 1) / (n_words + 8)), share(_sums(echo, first), n_words),
            np.log1p(n_lines), np.log1p(n_words / np.maximum(n_lines, 1)), share(repeated, n_lines), share(tails, n_words),
        ]))
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _measured(batches):
    for batch in batches:
        x = statistics(*tk.text_bytes(batch.column(2)))
        at = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))], ["doc_id", "held_out", "statistics"]
        )


def _moments(batches):
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = batch.column(1).values.to_numpy().reshape(-1, d)
        y = batch.column(0).to_numpy()
        for c in (0, 1):
            z = x[y == c]
            total[c] += np.concatenate(([len(z)], z.sum(0), (z.T @ z).ravel()))
    classes, places = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(classes.ravel()), pa.array(places.ravel()), pa.array(total.ravel())], ["class", "place", "total"])


class Discriminant:
    """Two Gaussians with their inverse Cholesky factors, computed once and sent with the scoring tasks."""

    def __init__(self, moments: np.ndarray, shrinkage: float = SHRINKAGE, temperature: float = TEMPERATURE):
        d, n = len(FEATURES), moments[:, 0]
        self.temperature, self.classes = temperature, None
        self.share = n[1] / n.sum() if n.sum() else 0.5
        if min(n) < 2:
            return
        means = moments[:, 1 : d + 1] / n[:, None]
        spread = [m[d + 1 :].reshape(d, d) / k - np.outer(mu, mu) for m, k, mu in zip(moments, n, means, strict=True)]
        pooled = np.diag(sum(k * s for k, s in zip(n, spread, strict=True)) / n.sum())
        self.classes = []
        for k, mu, s in zip(n, means, spread, strict=True):
            own = shrinkage + (1 - shrinkage) * d / (d + k)  # few rows: nearly all from the pool
            root = np.linalg.cholesky((1 - own) * s + own * np.diag(pooled) + FLOOR * np.eye(d))
            self.classes.append((mu, np.linalg.inv(root), np.log(np.diag(root)).sum(), np.log(k / n.sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        zero, one = (prior - root - 0.5 * (((x - mu) @ inverse.T) ** 2).sum(1) for mu, inverse, root, prior in self.classes)
        return 1 / (1 + np.exp(np.clip((zero - one) / self.temperature, -700, 700)))


def _scored(model: Discriminant):
    def run(batches):
        for batch in batches:
            x = batch.column(2).values.to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], ["doc_id", "held_out", "score"])

    return run


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """The discriminant of all labelled rows of ``measured`` that are not held out. Documents whose labels contradict each
    other, and labels other than 0 and 1, are left out."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("label")).where("label IN (0, 1)")
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", "label")
    )
    rows = measured.where("NOT held_out").join(known, "doc_id").select("label", "statistics").mapInArrow(_moments, "class long, place long, total double")
    moments = np.zeros((2, 1 + len(FEATURES) + len(FEATURES) ** 2))
    for c, place, total in rows.groupBy("class", "place").agg(F.sum("total")).collect():  # at most 762 rows
        moments[c, place] = total
    return Discriminant(moments)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, threshold: float = THRESHOLD
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row.

    Statistics of the whole text are all that a score depends on. Rows whose crc32(doc_id as text) is divisible by
    ``folds`` are held out of the fit. Means and covariances come from sums over all other labelled rows, added up by
    Spark; the model has fewer than 1000 numbers. Null and empty texts are scored as texts without words. A null doc_id is
    not held out and has no label. Without labels of both classes the score is the share of label 1, or 0.5. Repeated rows
    are scored each; other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "quality")
    bound_arrow_batches(docs.sparkSession)
    key = F.col(id_col).cast("long")
    held_out = F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))
    texts = docs.select(key.alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    measured = space.write(texts.mapInArrow(_measured, "doc_id long, held_out boolean, statistics array<double>"), "measured")
    model = fit(measured, labels, id_col, label_col)
    scored = measured.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
