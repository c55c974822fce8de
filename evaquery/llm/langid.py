"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean embedding of its hashed byte 2- to 4-grams (letters only, case
folded); a linear softmax turns it into language probabilities. Embeddings and weights
are trained together by stochastic gradient descent in numpy on a bounded sample, a
temperature and a rejection threshold are fitted on rows held back from it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, col, texts
from .sample import sampled

UNDETERMINED = "und"
BUCKET_BITS = 14
ORDERS = (2, 3, 4)
_LETTERS = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint32)
_BLOCK = 1 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def subwords(text: str) -> np.ndarray:
    """How often each bucket's subwords occur in the whole text (int64, one per bucket)."""
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    data = np.frombuffer(f" {text} ".lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    most = max(ORDERS)
    for i in range(0, len(data), _BLOCK):
        letters = _LETTERS[data[i : i + _BLOCK + most - 1]]
        own = min(_BLOCK, len(data) - i)
        h = np.zeros(len(letters), dtype=np.uint32)
        for n in range(1, most + 1):
            h = h[: len(letters) - n + 1] * np.uint32(0x01000193) + letters[n - 1 :] + np.uint32(n)
            if n in ORDERS and len(h):
                mixed = (h[:own] ^ (h[:own] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                counts += np.bincount(mixed >> np.uint32(32 - BUCKET_BITS), minlength=1 << BUCKET_BITS)
    return counts


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # bucket x label: embedding times weights, so a text costs one product
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        counts = subwords(text)
        return counts @ self.table / max(1, counts.sum()) + self.bias

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected): the probability is under the threshold."""
        if not self.labels or not has_letter(text):
            return UNDETERMINED, 0.0, True
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best]), bool(p[best] < self.reject_below)


def snippet(text: str, rng: np.random.Generator) -> str:
    """A few words from anywhere in the text, so that short texts are learned too."""
    words = text.split()
    at = int(rng.integers(0, max(1, len(words) - 3)))
    return " ".join(words[at : at + int(rng.integers(2, 12))])


def train(rows: list[tuple[str, str]], width: int = 16, epochs: int = 6, rate: float = 20.0, rejected: float = 0.01, seed: int = 0) -> Model:
    """Fits on (text, language) rows; every fifth is held back for calibration.

    No rows, or none with a letter, give a model that answers ``und``.
    """
    rng = np.random.default_rng(seed)
    rows = [r for r in rows if has_letter(r[0])]
    labels = sorted({lang for _, lang in rows})
    size = 1 << BUCKET_BITS
    if not labels:
        return Model([], np.zeros((size, 0)), np.zeros(0))

    def encoded(part: list[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        out = []
        for text, lang in part:
            for own in (text, snippet(text, rng)):
                counts = subwords(own)
                at = np.flatnonzero(counts)
                out.append((at, counts[at] / max(1, counts.sum()), labels.index(lang)))
        return out

    held, fit = encoded(rows[::5]), encoded([r for i, r in enumerate(rows) if i % 5])
    vectors, weights, bias = rng.normal(0, 0.1, (size, width)), rng.normal(0, 0.1, (width, len(labels))), np.zeros(len(labels))
    steps, step = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            at, share, y = fit[i]
            now = rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[at]
            error = _softmax(mean @ weights + bias)
            error[y] -= 1
            back = weights @ error
            weights -= 0.02 * now * np.outer(mean, error)
            bias -= 0.002 * now * error
            vectors[at] -= now * share[:, None] * back
    model = Model(labels, (vectors @ weights).astype(np.float32), bias)
    held = held or fit
    z = np.array([share @ model.table[at] + bias for at, share, _ in held])
    y = np.array([y for _, _, y in held])
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    model.temperature = float(min(loss, key=loss.get))
    model.reject_below = float(np.quantile(_softmax(z / model.temperature).max(axis=1), rejected))
    return model


def fit(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 1000, most_rows: int = 50_000) -> Model:
    """Trains on rows of ``docs`` where ``train_on`` holds and the language is known: about
    ``per_label`` of every language, fewer of each if they would exceed ``most_rows`` in all."""
    own = docs.where(train_on).select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"), col(lang_col).alias("lang"))
    return train([(r["text"], r["lang"]) for r in sampled(own, "lang", per_label, most_rows)])


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected): one row for each row of ``docs``, from its whole text.

    A null text, an empty one, one without a letter, or an untrained model give ``und``,
    score 0 and rejected. ``rejected`` otherwise marks a calibrated probability under
    the model's threshold. Of languages that tie, the first by name is given; equal texts
    get equal answers, repeated rows repeat, a null doc_id stays null. An empty table gives no rows.
    """

    def rows(x: dict[str, list]) -> dict[str, list]:
        lang, score, rejected = zip(*map(model.predict, x["text"]))
        return {"doc_id": x["doc_id"], "lang_pred": lang, "score": score, "rejected": rejected}

    return arrow_map(texts(docs, id_col, text_col), rows, "doc_id bigint, lang_pred string, score double, rejected boolean")
