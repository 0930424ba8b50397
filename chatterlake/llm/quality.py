"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are words, word shapes (letters, digits and marks with runs folded), pairs of shapes and
words equal to the one before, all hashed. A bounded sample of labelled rows gives term
weights, a truncated singular value decomposition and the labelled vectors; both are
broadcast (their size is fixed by the parameters). Every document is compared with every
labelled vector in blocks of exact cosine products, and the labels of its nearest ones are
weighted by similarity. Scoring is one pass without a shuffle.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import LOWER, Hasher, arrow_schema, chunks, column_of, mix, record, row_bounds, rows_of, small_batches, text_bytes, word_spans

LABELLED_ROWS = 4000
WORD_TERMS, SHAPE_TERMS = 2048, 2048
TERMS = WORD_TERMS + SHAPE_TERMS
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 4.0
BLOCK_ROWS = 256

# Byte classes of word shapes; marks stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 48
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97


def term_counts(data, offsets):
    """Dense counts of hashed terms, a row per text."""
    n_rows = len(offsets) - 1
    starts, ends = word_spans(data, offsets)
    rows = rows_of(row_bounds(starts, offsets))
    words = Hasher(LOWER[data])(starts, ends)
    kinds = _CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change[starts] = True
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(change, out=place[1:])
    shapes = Hasher(kinds[change])(place[starts], place[ends])
    same_row = rows[1:] == rows[:-1]
    pairs = mix(shapes[:-1] * np.uint64(3) + shapes[1:])[same_row]
    again = (same_row & (words[1:] == words[:-1]))
    place = np.concatenate([
        rows * TERMS + (words % np.uint64(WORD_TERMS)).astype(np.int64),
        rows * TERMS + WORD_TERMS + (shapes % np.uint64(SHAPE_TERMS - 1)).astype(np.int64),
        rows[1:][same_row] * TERMS + WORD_TERMS + (pairs % np.uint64(SHAPE_TERMS - 1)).astype(np.int64),
        rows[1:][again] * TERMS + TERMS - 1,
    ])
    return np.bincount(place, minlength=n_rows * TERMS).reshape(n_rows, TERMS)


def _blocks(data, offsets):
    """Unit rows of dampened counts, in blocks of bounded height: (first row, counts)."""
    for a in range(0, len(offsets) - 1, BLOCK_ROWS):
        part = offsets[a : a + BLOCK_ROWS + 1]
        yield a, np.log1p(term_counts(data[part[0] : part[-1]], part - part[0])).astype(np.float32)


def _unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    weights: np.ndarray     # term weights
    axes: np.ndarray        # terms × dimensions
    vectors: np.ndarray     # labelled unit vectors
    labels: np.ndarray
    prior: float

    def project(self, counts):
        return _unit(_unit(counts * self.weights) @ self.axes)

    def score(self, counts):
        """Similarity-weighted share of label 1 among the nearest labelled vectors; ties at the rim all vote."""
        empty = ~counts.any(1)
        close = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, close.shape[1])
        rim = np.partition(close, close.shape[1] - k, axis=1)[:, close.shape[1] - k, None]
        votes = np.where(close >= rim, np.maximum(close, 1e-6) ** SHARPNESS, 0.0).astype(np.float64)
        scores = (votes @ self.labels) / votes.sum(1)
        return np.where(empty, self.prior, np.clip(scores, 0.0, 1.0))


def choose(labels, label_col="label", id_col="doc_id", rows=LABELLED_ROWS):
    """About `rows` labelled rows, chosen by a hash of the id over all of them."""
    good = labels.filter(F.col(label_col).isNotNull())
    return good.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < min(1.0, rows / max(good.count(), 1)) * (1 << 20))


def fit(sample, label_col="label", id_col="doc_id", text_col="text"):
    """Fit on the labelled texts of a bounded sample, see `choose`.

    Rows without label or text are left out. Returns None when nothing is left. Only
    the sample's term counts come to the driver: its rows × `TERMS` small numbers.
    """
    sample = sample.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sample = sample.select(F.xxhash64(id_col).alias("h"), F.col(label_col).cast("double").alias("label"), F.col(text_col).alias("text"))
    schema = arrow_schema("h long, label double, counts binary")

    def count(batches):
        for batch in chunks(batches, "text"):
            data, offsets = text_bytes(column_of(batch, "text"))
            for a, counts in _blocks(data, offsets):
                part = batch.slice(a, len(counts))
                yield record(schema, h=column_of(part, "h"), label=column_of(part, "label"), counts=[row.astype(np.float16).tobytes() for row in counts])

    # The order is fixed, so that the same rows give the same model on every run.
    found = sample.mapInArrow(count, "h long, label double, counts binary").toArrow().sort_by([("h", "ascending"), ("label", "ascending")])
    if not found.num_rows:
        return None
    counts = np.frombuffer(b"".join(found["counts"].to_pylist()), np.float16).reshape(found.num_rows, TERMS).astype(np.float32)
    labels = found["label"].to_numpy()
    weights = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = _unit(counts * weights)
    # Truncated decomposition by subspace iteration from fixed start vectors.
    basis = np.random.default_rng(7).standard_normal((TERMS, DIMENSIONS + 16)).astype(np.float32)
    for _ in range(5):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ turn.T)[:, :DIMENSIONS].astype(np.float32)
    return Model(weights, axes, _unit(x @ axes), labels, float(labels.mean()))


def score_quality(docs, model, id_col="doc_id", text_col="text", threshold=0.3):
    """`score` (share of label 1 among neighbours) and `predicted` for every row.

    A missing or empty text has no terms and gets the labels' mean. Without a model (no
    labels) every score is 0. Repeated rows are scored each; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    columns = "score double, predicted int"
    schema = arrow_schema(columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in chunks(batches, text_col):
            score = np.zeros(batch.num_rows)
            if model is not None:
                for a, counts in _blocks(*text_bytes(column_of(batch, text_col))):
                    score[a : a + len(counts)] = model.score(counts)
            rows = record(schema, score=score, predicted=(score >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([column_of(batch, id_col), *rows.columns], names=[id_col, *schema.names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {columns}")
