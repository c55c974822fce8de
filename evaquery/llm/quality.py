"""Quality classifier: a factorisation machine over words, structure and metadata.

Features are hashed words (square-root frequencies), binned structure statistics of the
text and binned metadata. The score is linear plus low-rank pairwise interactions,
computed in linear time: the sum over pairs <v_i, v_j> x_i x_j is half of
(sum v_i x_i)^2 - sum (v_i x_i)^2, for each factor. Trained by AdaGrad in numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import arrow_map, col, sliced, texts
from .sample import sampled

WORD_BUCKETS = 1 << 14
BINS = 8
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_STOPS = b".!?"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-")
STATS = ("log_words", "word_length", "upper", "digits", "symbols", "stops", "letters", "distinct_words", "top_word", "repeated_lines", "line_length", "loud_words")


def statistics(data: bytes, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Structure of a text, from its bytes and its words and their bucket counts."""
    n, k = max(1, len(data)), max(1, len(words))
    without = lambda chars: len(data) - len(data.translate(None, chars))
    letters, space = max(1, without(_LETTERS)), without(_SPACE)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return np.array([
        np.log1p(len(words)), (n - space) / k, without(_UPPER) / letters, without(_DIGITS) / n, without(_SYMBOLS) / n, without(_STOPS) / k,
        letters / n, np.count_nonzero(counts) / k, counts.max(initial=0) / k, 1 - len(set(lines)) / max(1, len(lines)), k / max(1, len(lines)), data.count(b"!!") / k,
    ])


@dataclass
class Features:
    """Where features sit: word buckets, then BINS per statistic, then BINS per metadata column."""

    edges: np.ndarray = field(default_factory=lambda: np.zeros((len(STATS), BINS - 1)))
    n_meta: int = 0

    @property
    def size(self) -> int:
        return WORD_BUCKETS + BINS * len(STATS) + 2 * 64 * self.n_meta

    @staticmethod
    def raw(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = text.encode("utf-8", "surrogatepass")
        words = data.lower().split()
        counts = np.bincount(np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) % WORD_BUCKETS, minlength=WORD_BUCKETS)
        at = np.flatnonzero(counts)
        weight = np.sqrt(counts[at] / max(1, len(words)))
        return at, weight, statistics(data, words, counts)

    def vector(self, text: str, meta: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values) of a text's features; a metadata value counts by its power of two, null as its own."""
        at, weight, stats = self.raw(text)
        bins = [WORD_BUCKETS + i * BINS + int(np.searchsorted(e, s)) for i, (e, s) in enumerate(zip(self.edges, stats))]
        base = WORD_BUCKETS + BINS * len(STATS)
        for i, v in enumerate(meta):
            bins.append(base + 128 * i + (127 if v is None else min(63, int(abs(v)).bit_length())))
        return np.concatenate([at, bins]).astype(np.int64), np.concatenate([weight, np.ones(len(bins))])


@dataclass
class Model:
    features: Features
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        total = v.sum(axis=0)
        return float(self.bias + self.linear[at] @ x + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str, meta: tuple = ()) -> float:
        """Probability of label 1."""
        return float(1 / (1 + np.exp(-np.clip(self.margin(*self.features.vector(text, meta)), -35, 35))))


def train(rows: list[tuple[str, tuple, int]], rank: int = 8, epochs: int = 8, rate: float = 0.05, decay: float = 1e-4, seed: int = 0, n_meta: int | None = None) -> Model:
    """Fits on (text, metadata, label 0 or 1) rows; no rows give a model that answers 0.5."""
    if n_meta is None:
        n_meta = len(rows[0][1]) if rows else 0
    features = Features(n_meta=n_meta)
    if rows:
        stats = np.array([features.raw(t)[2] for t, _, _ in rows])
        features.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
        # the tails matter most for junk: the outer edges move outwards
        features.edges[:, 0], features.edges[:, -1] = np.quantile(stats, 0.03, axis=0), np.quantile(stats, 0.97, axis=0)
        features.edges.sort(axis=1)
    rng = np.random.default_rng(seed)
    model = Model(features, 0.0, np.zeros(features.size), rng.normal(0, 0.02, (features.size, rank)))
    seen_w, seen_v, seen_b = np.full(features.size, 1e-3), np.full((features.size, rank), 1e-3), 1e-3
    data = [(*features.vector(t, m), y) for t, m, y in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at, x, y = data[i]
            own = model.factors[at]
            scaled = own * x[:, None]
            total = scaled.sum(axis=0)
            z = model.bias + model.linear[at] @ x + 0.5 * (total @ total - (scaled * scaled).sum())
            slope = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y
            grad_w = slope * x + decay * model.linear[at]
            grad_v = slope * x[:, None] * (total - scaled) + decay * own
            seen_b += slope * slope
            seen_w[at] += grad_w * grad_w
            seen_v[at] += grad_v * grad_v
            model.bias -= rate * slope / np.sqrt(seen_b)
            model.linear[at] -= rate * grad_w / np.sqrt(seen_w[at])
            model.factors[at] -= rate * grad_v / np.sqrt(seen_v[at])
    model.linear, model.factors = model.linear.astype(np.float32), model.factors.astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = ("n_chars",), per_label: int = 2000) -> Model:
    """Trains on rows of ``docs`` that have a 0/1 label and for which ``train_on`` (over doc_id) holds.

    About ``per_label`` ids of each label are drawn, by the hash of doc_id, from the
    labels alone; their texts come to the driver, one for each id (the least of rows that
    share an id), and no other text moves.
    Labels of a doc_id that disagree, and null ones, are left out.
    """
    known = labels.select(col(id_col).cast("bigint").alias("doc_id"), col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(train_on).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    picked = sampled(known, "label", per_label, 2 * per_label)
    if not picked:
        return train([], n_meta=len(meta_cols))
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in picked], "doc_id bigint, label int")
    own = texts(docs, id_col, text_col, *meta_cols).join(F.broadcast(chosen), "doc_id")
    once = own.groupBy("doc_id", "label").agg(F.min(F.struct("text", *map(col, meta_cols))).alias("x"))
    rows = sorted(once.collect(), key=lambda r: r["doc_id"])
    return train([(r["x"]["text"], tuple(r["x"][m] for m in meta_cols), r["label"]) for r in rows], n_meta=len(meta_cols))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """(doc_id, score, predicted): one row for each row of ``docs``, from its whole text.

    A null text scores as an empty one; null metadata is a value of its own; equal rows
    score equally and repeat; a null doc_id stays null; an empty table gives no rows.
    predicted is 1 if score >= 0.5, a tie of both labels included.
    """

    def rows(x: dict[str, list]) -> dict[str, list]:
        got = [model.score(t, m) for t, *m in zip(x["text"], *(x[c] for c in meta_cols))]
        return {"doc_id": x["doc_id"], "score": got, "predicted": [int(s >= 0.5) for s in got]}

    return arrow_map(texts(docs, id_col, text_col, *meta_cols), rows, "doc_id bigint, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", meta_cols: tuple[str, ...] = ("n_chars",), least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                columns = [part.column(part.schema.names.index(c)).to_pylist() for c in (text_col, *meta_cols)]
                yield part.filter(pa.array([model.score(t or "", tuple(m)) >= least for t, *m in zip(*columns)], pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
