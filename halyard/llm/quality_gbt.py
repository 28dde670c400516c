"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once. Trees are grown on a bounded sample of labelled rows: split points
come from quantile bins, gradients and hessians of the log loss are summed by bin, and leaves take Newton steps. The
grown trees are flattened into arrays - feature, threshold, children, value - which numpy walks for a whole batch of
documents, one level at a time.

Nulls: a null text is empty, and empty texts get a score. Labels that are null are ignored; a doc_id labelled more than
once counts as 1 if any label is 1. Without labels of both classes every score is the share of label 1, or 0.5 with
none. Rows with a null or repeated doc_id are scored as others; a repeated one teaches once, by the least of its figures.
The sample is cut by a hash of doc_id below a rate, so there are no ties at its edge. Texts of any length are measured
whole, a bounded number of characters at a time. Other columns are ignored, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.chunks import slices
from halyard.llm.common import checkpointed, uniform
from halyard.llm.shingles import mixed, word_hashes

#: Labelled rows that are fitted at most; held-out rows' labels are never read.
SAMPLE_ROWS, FOLDS, HELD_OUT, ACCEPT = 12_000, 4, 2, 0.7
NAMES = (
    "log_words", "log_bytes", "mean_word", "symbols", "digits", "upper", "marks", "exclaims", "pipes", "distinct_words", "repeated_windows",
    "repeated_lines", "top_word", "line_words", "one_letter", "beyond_ascii",
)
_SYMBOL, _MARK = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&|<>", b".,;:!?"))


def statistics(text: str) -> list[float]:
    """The text's figures, in the order of ``NAMES``. Windows, words and lines are compared by 64-bit numbers."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = word_hashes(raw)
    n, size = max(1, len(words)), len(raw)
    white = int(counts[[9, 10, 11, 12, 13, 32]].sum())
    _, seen = np.unique(words, return_counts=True) if len(words) else (None, np.zeros(0))
    repeated = 0
    if len(words) > 3:
        windows = mixed(mixed(mixed(words[:-2]) + words[1:-1]) + words[2:])
        _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
        covered = np.zeros(len(words) + 3, bool)
        for k in range(3):
            covered[k : k + len(windows)] |= times[back] > 1
        repeated = int(covered.sum())
    lines = [x for x in text.split("\n") if x.strip()]
    upper = int(counts[65:91].sum())
    lower = int(counts[97:123].sum())
    return [
        float(np.log1p(len(words))), float(np.log1p(size)), (size - white) / n, float(counts[_SYMBOL].sum() / size), float(counts[48:58].sum() / size),
        upper / max(1, upper + lower), float(counts[_MARK].sum() / size), float(counts[33] / n), float(counts[124] / n), len(seen) / n, repeated / n,
        1 - len(set(lines)) / max(1, len(lines)), float(seen.max(initial=0) / n), n / max(1, len(lines)), text.count(" | ") / n, float(counts[128:].sum() / size),
    ]


def figures(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row. One pass over the texts."""

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, texts in slices(batch.column(1)):
                x = [statistics(t) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, x array<double>")


class Trees:
    """Boosted trees as flat arrays: node k of tree t splits ``feature[t, k]`` at ``threshold[t, k]``; its children are
    ``2k + 1`` and ``2k + 2``; ``value[t]`` has the leaves'. A node that does not split sends all rows to the left."""

    def __init__(self, depth: int = 4, trees: int = 80, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 8.0):
        self.depth, self.trees, self.rate, self.bins, self.ridge, self.least = depth, trees, rate, bins, ridge, least
        self.bias, inner = 0.0, 2**depth - 1
        self.feature, self.threshold = np.zeros((0, inner), np.int32), np.zeros((0, inner))
        self.value = np.zeros((0, 2**depth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.bias = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2:
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        raw = np.full(len(y), self.bias)
        grown = [self._grow(binned, cuts, y, raw) for _ in range(self.trees)]
        self.feature, self.threshold, self.value = (np.stack([g[k] for g in grown]) for k in range(3))
        return self

    def _grow(self, binned, cuts, y, raw):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        inner = 2**self.depth - 1
        feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf)
        node, width = np.zeros(len(y), np.int64), max(map(len, cuts)) + 1
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            own = node - first
            g_all, h_all = (np.bincount(own, w, n) for w in (grad, hess))
            for f, (bins, cut) in enumerate(zip(binned, cuts, strict=True)):
                if not len(cut):
                    continue
                g, h = (np.cumsum(np.bincount(own * width + bins, w, n * width).reshape(n, width), axis=1)[:, : len(cut)] for w in (grad, hess))
                gr, hr = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + self.ridge) + gr**2 / (hr + self.ridge) - (g_all**2 / (h_all + self.ridge))[:, None]
                gain[(h * 4 < self.least) | (hr * 4 < self.least)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(n), at]
                for k in np.flatnonzero(top > best):
                    best[k], feature[first + k], threshold[first + k] = top[k], f, cut[at[k]]
            right = np.zeros(len(y), np.int64)
            for k in range(n):
                rows = np.flatnonzero(own == k)
                if np.isfinite(threshold[first + k]):
                    f = feature[first + k]
                    right[rows] = binned[f, rows] > np.searchsorted(cuts[f], threshold[first + k], side="left")
            node = 2 * node + 1 + right
        leaf = node - inner
        value = self.rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + self.ridge)
        raw += value[leaf]
        return feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += value[node - len(feature)]
        return 1 / (1 + np.exp(-raw))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fitted(x: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Trees:
    """Trees for ``sample`` labelled documents at most, outside the held-out fold.

    Of more, those are taken whose doc_id's hash is below a rate that follows from their count, some deviations short of
    ``sample``, so that nothing is sorted and no task or driver meets more than the sample.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy(F.col("doc_id").alias("d")).agg(F.max("quality").alias("y"))
    n = known.count()
    if n > sample:
        known = known.where(uniform(F.col("d"), 17) < max(0.0, sample - 6 * sample**0.5) / n)
    met = x.join(known, F.col("doc_id") == F.col("d")).groupBy("d").agg(F.min("x").alias("x"), F.max("y").alias("y"))
    rows = met.select("d", "x", "y").toArrow().sort_by("d")
    features = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(NAMES))
    return Trees().fit(features, rows.column("y").to_numpy().astype(np.float64))


def scored(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, sample: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted. Labels teach, and enter no score."""
    x = checkpointed(figures(docs))
    trees = fitted(x, labels, sample)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(own))], ["doc_id", "score"])

    out = x.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
