"""Document quality from statistics of the text, by histogram gradient-boosted trees.

Statistics are computed for every whole text in one pass. The trees are fitted on labelled rows only, on a sample of at
most ``SAMPLE`` of them (chosen by a hash of doc_id, all rows if there are fewer), and kept as flat arrays, so that
scoring walks all rows of a batch down all trees with numpy.

Defined results: NULL text counts as empty; an empty text has all statistics 0 and a score like any other. Rows without
label, or with another label than 0 and 1, are not learned from. Without labels of both classes every score is the
share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercantile.llm.tables import scratch
from mercantile.llm.textkit import BLANK_SEPARATED, find_words, hash_spans, slices

#: Labelled rows that a fit may use at most.
SAMPLE = 20_000
THRESHOLD = 0.5


def _bytes_of(text: str) -> np.ndarray:
    table = np.zeros(256)
    table[list(text.encode())] = 1
    return table


_SHARES = {
    "upper": _bytes_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": _bytes_of("abcdefghijklmnopqrstuvwxyz"),
    "digit": _bytes_of("0123456789"),
    "blank": _bytes_of(" \t"),
    "line_end": _bytes_of("\n"),
    "stop": _bytes_of(".,;:?"),
    "cry": _bytes_of("!"),
    "bar": _bytes_of("|"),
    "symbol": _bytes_of("#$%&*+<=>@^_~`\\"),
    "bracket": _bytes_of("()[]{}\"'-/"),
    "beyond_ascii": np.r_[np.zeros(128), np.ones(128)],
}
FEATURES = ["log_bytes", "log_words", "word_length", "word_spread", "long_words", "short_words", "distinct_words", "repeated_lines", "line_words", "entropy", *_SHARES]


def _repeats(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each text."""
    order = np.lexsort((hashes, text))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    return np.bincount(text[order][new], minlength=n)


_LINE_BYTES = np.ones(256, dtype=bool)
_LINE_BYTES[10] = False


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    n = len(at) - 1
    size = np.diff(at)
    counts = np.zeros((n, 256))
    for row in range(n):
        counts[row] = np.bincount(data[at[row] : at[row + 1]], minlength=256)
    words = find_words(data, at, BLANK_SEPARATED)
    length = words.end - words.start
    n_words = words.counts
    some, any_bytes = np.maximum(n_words, 1), np.maximum(size, 1)
    total = lambda x: np.bincount(words.text, weights=x, minlength=n)
    mean = total(length) / some
    lines = find_words(data, at, _LINE_BYTES)
    p = counts / any_bytes[:, None]
    columns = [
        np.log1p(size),
        np.log1p(n_words),
        mean,
        np.sqrt(np.maximum(total(length.astype(float) ** 2) / some - mean**2, 0)),
        total(length > 14) / some,
        total(length < 3) / some,
        _repeats(hash_spans(data, words.start, words.end), words.text, n) / some,
        1 - _repeats(hash_spans(data, lines.start, lines.end), lines.text, n) / np.maximum(lines.counts, 1),
        np.log1p(n_words / np.maximum(lines.counts, 1)),
        -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1),
        *(p @ table for table in _SHARES.values()),
    ]
    columns[7][lines.counts == 0] = 0
    return np.column_stack(columns).astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees as arrays: node i of a tree has the children 2i + 1 and 2i + 2."""

    prior: float
    depth: int = 0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        margin, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss. Cuts are quantiles, so a histogram per node is all that a split needs."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return Trees(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")).astype(np.float32) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    f_count, share = x.shape[1], float(y.mean())
    model = Trees(float(np.log(share / (1 - share))), depth)
    margin = np.full(len(y), model.prior)
    inner, features, limits, leaves = 2**depth - 1, [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), dtype=np.int64)
        feature, limit = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slots = ((node - first)[:, None] * f_count + np.arange(f_count)) * bins + binned
            shape = (width, f_count, bins)
            hist = [np.bincount(slots.ravel(), np.repeat(v, f_count), width * f_count * bins).reshape(shape) for v in (slope, curve, np.ones(len(y)))]
            left = [np.cumsum(h, axis=2) for h in hist]
            whole = [c[:, :1, -1:] for c in left]
            gain = sum(s**2 / (c + ridge) for s, c in ((left[0], left[1]), (whole[0] - left[0], whole[1] - left[1]))) - whole[0] ** 2 / (whole[1] + ridge)
            gain[(left[2] < least) | (whole[2] - left[2] < least)] = 0
            for f, c in enumerate(cuts):
                gain[:, f, len(c) :] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, at in enumerate(best):
                f, b = divmod(int(at), bins)
                if gain[k, f, b] > 1e-9:
                    feature[first + k], limit[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        slot = node - inner
        leaf = rate * np.bincount(slot, slope, inner + 1) / (np.bincount(slot, curve, inner + 1) + ridge)
        margin += leaf[slot]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    model.feature, model.cut, model.leaf = np.array(features), np.array(limits), np.array(leaves)
    return model


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch.column(1)):
                x = statistics(data, at)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).cast(pa.int64()), lists], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most ``sample`` labelled rows of ``text_statistics``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y IN (0, 1)").distinct()
    rows = stats.join(known, "doc_id").withColumn("at", F.xxhash64("doc_id", F.lit(1)))
    count = rows.count()
    if count > sample:  # a share by hash first, so that the exact limit sorts little more than it keeps
        low = -(2**63) + int(2**64 * min(1.0, 1.2 * sample / count + 1000 / count)) - 1
        rows = rows.where(F.col("at") <= min(low, 2**63 - 1))
    found = rows.orderBy("at", "y", "x").limit(sample).select("x", "y").toPandas()
    if not len(found):
        return fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    return fit(np.stack(found["x"].to_numpy()).astype(np.float32), found["y"].to_numpy().astype(float))


def train_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on the texts of at most ``sample`` labels, chosen by a hash; only their texts are looked at."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(1)), "quality").limit(sample)
    chosen = scratch(docs.sparkSession).store(chosen, "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    return train(scratch(docs.sparkSession).store(text_statistics(texts), "statistics"), chosen, sample)


def score_statistics(stats: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) from stored statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def keep_scored(docs: DataFrame, model: Trees, least: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            scores = [model.score(statistics(data, at)) for _, _, data, at in slices(text)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= least))

    return docs.mapInArrow(run, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32 of the doc_id as text, modulo 3, is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 != 1)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    stats = scratch(docs.sparkSession).store(text_statistics(docs), "statistics")
    scored = score_statistics(stats, train(stats, learnable(labels)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
