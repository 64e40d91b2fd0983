"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature's values are cut into bins. Training goes round the features in cycles; in each step a shallow tree is fitted to the
bins' summed gradients and added, damped, to the feature's lookup table. Pairs of features whose interaction explains most of what is
left get two-dimensional tables, trained the same way. A score is the logistic of a sum of table entries, added up for whole arrays.

Features are counts and ratios of the whole text, computed for blocks of rows on bytes. The model is fitted on the driver from a
bounded sample of labelled rows (`SAMPLE`, smallest hashes of the id first); everything else covers all rows.

Defined results: a null text scores as the empty one; labels without a partner, null labels and labels other than 0 and 1 are not
used; with no usable labels, or one class only, every score is the smoothed share of class 1 (0.5 with no labels); equal texts score equal;
input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaforge.llm.common import BLANK_WORDS, add_columns, arrow_schema, byte_table, crc_of_id, runs, span_hashes, text_blocks, without, word_spans, written

SAMPLE = 40_000  # labelled rows that a fit may use
BINS, PAIR_BINS, PAIRS = 32, 8, 8
CYCLES, PAIR_CYCLES, RATE, LEAVES = 200, 60, 0.1, 4
ACCEPT = 0.3
FOLDS = 5

FEATURES = [
    "bytes", "upper", "digits", "spaces", "symbols", "bangs", "stops", "bars", "non_ascii", "word_length", "distinct_words", "same_words",
    "top_word", "distinct_pairs", "lines", "distinct_lines", "words_per_line", "short_words",
]


def _classes() -> np.ndarray:
    table = np.zeros(256, dtype="uint8")
    table[65:91], table[97:123], table[48:58], table[32] = 1, 2, 3, 4
    for kind, chars in ((5, b"*#%&$@^~_=+<>\\/{}[]`"), (6, b"!"), (7, b",.;:"), (8, b"|")):
        table[list(chars)] = kind
    table[128:] = 9
    return table


CLASSES = _classes()
LINES = byte_table([(10, 10)])


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype="int64")])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row and how often its most frequent one occurs."""
    if not len(hashes):
        return np.zeros(rows), np.zeros(rows)
    keys = np.sort((row.astype("uint64") << np.uint64(40)) | (hashes >> np.uint64(24)))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    owner = (keys[new] >> np.uint64(40)).astype("int64")
    often = np.diff(np.append(new, len(keys)))
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    top = np.zeros(rows)
    top[owner[first]] = np.maximum.reduceat(often, first)
    return np.bincount(owner, minlength=rows).astype("float64"), top


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of features per text."""
    out = [np.zeros((0, len(FEATURES)), dtype="float32")]
    for low, high, data, offsets in text_blocks(texts):
        rows, size = high - low, np.diff(offsets).astype("float64")
        kind = CLASSES[data]
        n = [_per_row(kind == k, offsets) for k in range(10)]
        starts, ends, row = word_spans(data, offsets, BLANK_WORDS)
        h = span_hashes(data, starts, ends)
        count = lambda mask, of=row: np.bincount(of[mask], minlength=rows).astype("float64")
        words = np.bincount(row, minlength=rows).astype("float64")
        distinct, top = _repeats(h, row, rows)
        together = row[1:] == row[:-1]
        pairs = count(together, row[1:])
        distinct_pairs, _ = _repeats(runs(h, 2)[together], row[1:][together], rows)
        l_start, l_end, l_row = word_spans(data, offsets, LINES)
        lines = np.bincount(l_row, minlength=rows).astype("float64")
        distinct_lines, _ = _repeats(span_hashes(data, l_start, l_end), l_row, rows)
        per = lambda a, b: a / np.maximum(b, 1)
        length = np.bincount(row, weights=ends - starts, minlength=rows)
        out.append(np.stack([
            np.log1p(size), per(n[1], n[1] + n[2]), per(n[3], size), per(n[4], size), per(n[5], size), per(n[6], words), per(n[7], words), per(n[8], words),
            per(n[9], size), per(length, words), per(distinct, words), per(count(together & (h[1:] == h[:-1]), row[1:]), words), per(top, words),
            per(distinct_pairs, pairs), np.log1p(lines), per(distinct_lines, lines), np.log1p(per(words, lines)), per(count(ends - starts <= 2), words),
        ], axis=1).astype("float32"))
    return np.concatenate(out)


@dataclass
class Gam:
    """Bin edges per feature, tables per feature and per pair, and the constant."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        if self.pairs:
            coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for p in self.pairs for j in p}
            for (a, b), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)).astype(values.dtype)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of a greedy tree over ordered bins."""
    step, segments = np.zeros(len(g)), [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(segments) < leaves:
        best = (1e-9, None, 0)
        for i, (a, b) in enumerate(segments):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gain = _gain(cg[at] - cg[a], ch[at] - ch[a]) + _gain(cg[b] - cg[at], ch[b] - ch[at]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], i, int(at[k]))
        if best[1] is None:
            break
        a, b = segments.pop(best[1])
        segments += [(a, best[2]), (best[2], b)]
    for a, b in segments:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return step


def _corner(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree with one cut on each axis over a grid of bins: (gain, Newton steps)."""
    total = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = total(g), total(h)
    a, b = cg.shape[0] - 1, cg.shape[1] - 1
    quarters = lambda c: (c[1:a, 1:b], c[1:a, b:] - c[1:a, 1:b], c[a:, 1:b] - c[1:a, 1:b], c[a:, b:] - c[1:a, b:] - c[a:, 1:b] + c[1:a, 1:b])
    if a < 2 or b < 2:
        return 0.0, np.zeros_like(g)
    qg, qh = quarters(cg), quarters(ch)
    gain = sum(_gain(x, y) for x, y in zip(qg, qh))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.zeros_like(g)
    areas = [(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, b)), (slice(i + 1, a), slice(0, j + 1)), (slice(i + 1, a), slice(j + 1, b))]
    for area, x, y in zip(areas, qg, qh):
        step[area] = x[i, j] / (y[i, j] + 1.0)
    return float(gain[i, j]), step


def fit_gam(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fit to features and 0/1 labels."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    width = x.shape[1]
    model.edges = [_cuts(x[:, j], BINS) for j in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(width)]
    total = np.full(len(y), model.bias)
    for _ in range(CYCLES):
        for j in range(width):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(bins[j], weights=y - p, minlength=len(model.tables[j]))
            h = np.bincount(bins[j], weights=p * (1 - p), minlength=len(model.tables[j]))
            step = RATE * _tree(g, h, LEAVES)
            model.tables[j] += step
            total += step[bins[j]]
    model.pair_edges = [_cuts(x[:, j], PAIR_BINS) for j in range(width)]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], side="right") for j in range(width)]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], weights=values, minlength=shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-total))
    gains = sorted(((-_corner(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0], a, b) for a in range(width) for b in range(a)))
    model.pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain < 0]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_CYCLES):
        for k, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _corner(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1]
            model.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return model


# ---------------------------------------------------------------- tables


def feature_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, features array) of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("features", T.ArrayType(T.FloatType()))])
    arrow = arrow_schema(schema)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column("text"))
            ends = pa.array(np.arange(len(x) + 1, dtype="int32") * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()), type=arrow.field("features").type)], schema=arrow)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(measure, schema)


def held_out(doc_id: str = "doc_id", folds: int = FOLDS):
    """Rows that no fit may learn from."""
    return crc_of_id(F.col(doc_id)) % folds == 0


def fit(features: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = FOLDS) -> Gam:
    """Fit on at most `sample` labelled rows outside the held-out fold."""
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out("doc_id", folds)).select("doc_id", F.col(label).cast("double").alias("label"))
    rows = features.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample).select("features", "label").toPandas()
    if not len(rows):
        return Gam(0.0)
    return fit_gam(np.stack(rows["features"].to_numpy()).astype("float32"), rows["label"].to_numpy())


def _add_score(rows: DataFrame, model: Gam, features_of, drop: str | None = None, out: str = "score") -> DataFrame:
    kept = [f for f in rows.schema.fields if f.name != drop]
    schema = T.StructType(kept + [T.StructField(out, T.DoubleType())])
    arrow = arrow_schema(schema)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.score(features_of(batch))
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], schema=arrow)

    return rows.mapInArrow(add, schema)


def score_features(features: DataFrame, model: Gam) -> DataFrame:
    """(doc_id, score) of rows measured before."""

    def stacked(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("features").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))

    return _add_score(features, model, stacked, "features")


def score_texts(docs: DataFrame, model: Gam, text: str = "text", out: str = "score") -> DataFrame:
    """Documents with their score."""
    return _add_score(without(docs, [out]), model, lambda batch: text_features(batch.column(text)), out=out)


def judge(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the model learns from the labels outside the held-out fold."""
    features = written(feature_table(docs), "features")
    scored = score_features(features, fit(features, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents that the classifier does not reject."""
    model = fit(written(feature_table(docs), "features"), labels)
    return score_texts(docs, model, out="__score").filter(F.col("__score") >= accept).drop("__score")
