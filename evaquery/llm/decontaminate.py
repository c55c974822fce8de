"""Benchmark decontamination: edit-distance search for benchmark items inside documents.

CGK random walks embed word sequences so that few edits become few Hamming mismatches;
repeated bit-sampling over item-sized windows proposes (window, item) pairs, and a
semi-global edit distance decides. Item and document are compared as word sequences,
case and punctuation aside.

The symbols that a walk writes are runs of up to three words. A repetition samples one
step of a walk, and the bucket table holds, for every item, the symbol its own walk
writes at that step. A window of a document is in an item's bucket if its walk writes the
same symbol at the same step, so such windows are looked for around the places where the
document has the symbol, and their walks are followed up to the step. An item above
PIECE_WORDS is embedded piece by piece: one piece has no more than its share of the edits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import col, sliced, texts

WORD = re.compile(r"\w+")
NOTHING, UNKNOWN = -2, -1
SYMBOL_WORDS = 3
PIECE_WORDS = 48
#: Share of a piece's steps at which the walks of item and window agree at the threshold; measured in tests, sets the repetitions.
AGREEMENT = 0.15
#: Characters of benchmark text that are searched for in one pass over the documents.
BLOCK_CHARS = 4_000_000
#: (window, sampled step) pairs whose walks are followed at a time.
WALKS_AT_ONCE = 1 << 20


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def repetitions(recall: float) -> int:
    """Repetitions of one sampled step each that miss a piece at the threshold with probability 1 - recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREEMENT))


def symbols(flat: np.ndarray, q: int) -> np.ndarray:
    """A number for each run of ``q`` words of ``flat``."""
    out = np.zeros(max(0, len(flat) - q + 1), dtype=np.int64)
    for i in range(q):
        out = out * np.int64(0x9E3779B97F4A7C1) + flat[i : len(flat) - q + 1 + i] + 3
    return out


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, str | None]], similarity: float = 0.8, recall: float = 0.99, seed: int = 7) -> None:
        listed = [(i, words(t)) for i, t in items]
        listed = [(i, w) for i, w in listed if w]
        self.ids = [i for i, _ in listed]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for _, own in listed for w in own))}
        self.tokens = [np.array([self.vocabulary[w] for w in own], dtype=np.int64) for _, own in listed]
        self.size = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.edits = np.floor((1 - similarity) * self.size + 1e-9).astype(np.int64)
        rng, reps = np.random.default_rng(seed), repetitions(recall)
        self.walks = rng.integers(0, 2**63, (reps, 2 * PIECE_WORDS), dtype=np.int64) * 2 + 1
        self.samples = rng.random(reps)
        self.buckets = self._buckets(similarity)

    def _buckets(self, similarity: float) -> dict[int, tuple[np.ndarray, ...]]:
        """For each symbol length: distinct symbols, ascending, where the entries of each begin,
        and the entries' (item, repetition, step, place in the piece, place in the item, shift)."""
        found: dict[int, list[tuple[int, ...]]] = {}
        for item, tokens in enumerate(self.tokens):
            n = -(-len(tokens) // PIECE_WORDS)
            for i in range(n):
                start, end = len(tokens) * i // n, len(tokens) * (i + 1) // n
                k = int((1 - similarity) * (end - start) + 1e-9)
                q = min(SYMBOL_WORDS, (end - start) // (k + 1))
                own = symbols(tokens[start:end], q)
                steps = (self.samples * 2 * len(own)).astype(np.int64)
                for rep, (step, at) in enumerate(zip(steps, self._walked(own, np.zeros(len(steps), dtype=np.int64), np.arange(len(steps)), steps))):
                    if at < len(own):
                        found.setdefault(q, []).append((int(own[at]), item, rep, int(step), int(at), start + int(at), k))
        out = {}
        for q, entries in found.items():
            table = np.array(sorted(entries), dtype=np.int64)
            keys, first = np.unique(table[:, 0], return_index=True)
            out[q] = (keys, np.append(first, len(table)), *table[:, 1:].T.copy())
        return out

    def _walked(self, own: np.ndarray, at: np.ndarray, rep: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Where walks that begin ``at`` places of the symbols ``own`` stand after ``steps`` steps.

        A walk writes the symbol it stands on at every step and moves on if the hash of
        the step and the symbol says so; past the last symbol it stays.
        """
        order = np.argsort(-steps, kind="stable")
        at, rep, left = at[order], rep[order], np.searchsorted(-steps[order], -np.arange(int(steps.max(initial=0))), side="left")
        for j, n in enumerate(left.tolist()):
            here = at[:n]
            inside = here < len(own)
            here += inside & ((own[np.minimum(here, len(own) - 1)] * self.walks[rep[:n], j]) < 0)
        out = np.empty_like(at)
        out[order] = at
        return out

    def candidates(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, place where the item would begin), distinct, of windows in an item's bucket.

        ``flat`` holds the documents' word numbers end to end, ``starts`` where each begins and, last, ends.
        """
        kept = [np.zeros((3, 0), dtype=np.int64)]
        for q, (keys, first, item, rep, step, at_piece, at_item, shift) in self.buckets.items():
            own = symbols(flat, q)
            near = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            place = np.flatnonzero(keys[near] == own)
            doc = np.searchsorted(starts, place, side="right") - 1
            whole = place + q <= starts[doc + 1]
            place, near = place[whole], near[place[whole]]
            count = first[near + 1] - first[near]
            most = 2 * int(shift.max()) + 1
            for part in np.array_split(np.arange(len(place)), 1 + int(count.sum()) * most // WALKS_AT_ONCE):
                n = count[part]
                entry = np.repeat(first[near[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                stands = np.repeat(place[part], n)
                # windows that begin up to the piece's edits away from where the item's would
                entry, moved = (x.ravel() for x in np.broadcast_arrays(entry[:, None], np.arange(-(most // 2), most // 2 + 1)[None, :]))
                stands = np.repeat(stands, most)
                begins = stands - at_piece[entry] + moved
                doc = np.searchsorted(starts, stands, side="right") - 1
                some = (np.abs(moved) <= shift[entry]) & (begins >= starts[doc]) & (begins <= stands)
                entry, stands, begins, doc = entry[some], stands[some], begins[some], doc[some]
                some = self._walked(own, begins, rep[entry], step[entry]) == stands
                kept.append(np.stack([doc[some], item[entry[some]], stands[some] - at_item[entry[some]]]))
        doc, item, place = np.unique(np.concatenate(kept, axis=1), axis=1)
        # places of a pair that one stretch of the document covers are compared once
        stretch = np.stack([doc, item, place // (self.edits[item] + 1)])
        once = np.unique(stretch, axis=1, return_index=True)[1]
        return doc[once], item[once], place[once]

    def distances(self, flat: np.ndarray, starts: np.ndarray, doc: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Least edit distance of each item to any stretch of its document that begins within
        its edits before ``place``, or twice its edits after it."""
        out = np.full(len(doc), np.iinfo(np.int64).max, dtype=np.int64)
        for one in np.unique(item):
            mine = np.flatnonzero(item == one)
            tokens, k = self.tokens[one], int(self.edits[one])
            for part in np.array_split(mine, 1 + len(mine) * (len(tokens) + 5 * k) // 2_000_000):
                at = place[part][:, None] + np.arange(-k, len(tokens) + 3 * k)
                inside = (at >= starts[doc[part]][:, None]) & (at < starts[doc[part] + 1][:, None])
                region = np.where(inside, flat[np.clip(at, 0, max(0, len(flat) - 1))], NOTHING)
                steps = np.arange(region.shape[1] + 1)
                row = np.zeros((len(part), region.shape[1] + 1), dtype=np.int64)
                for i, word in enumerate(tokens):
                    new = np.empty_like(row)
                    new[:, 0] = i + 1
                    new[:, 1:] = np.minimum(row[:, :-1] + (region != word), row[:, 1:] + 1)
                    row = np.minimum.accumulate(new - steps, axis=1) + steps
                out[part] = row.min(axis=1)
        return out

    def find(self, documents: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(document's place in the list, item's place, edits, first word of the window): the best of each pair."""
        get, lists = self.vocabulary.get, [words(t) for t in documents]
        starts = np.cumsum([0, *map(len, lists)])
        flat = np.fromiter((get(w, UNKNOWN) for own in lists for w in own), dtype=np.int64, count=int(starts[-1]))
        if not len(flat) or not self.ids:
            return []
        doc, item, place = self.candidates(flat, starts)
        edits = self.distances(flat, starts, doc, item, place)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for i in np.flatnonzero(edits <= self.edits[item]):
            pair, own = (int(doc[i]), int(item[i])), (int(edits[i]), max(0, int(place[i] - starts[doc[i]])))
            best[pair] = min(best.get(pair, own), own)
        return [(d, i, *own) for (d, i), own in sorted(best.items())]


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", similarity: float = 0.8, recall: float = 0.99) -> Iterator[Items]:
    """The benchmark in blocks of about BLOCK_CHARS, so what a task is sent stays bounded however
    large the benchmark is; every block is searched for in every document."""
    own = items.select(col(id_col).cast("bigint").alias("item_id"), col(text_col).alias("text"))
    n = max(1, -(-(own.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    for b in range(n):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else own
        yield Items(sorted(((r["item_id"], r["text"]) for r in rows.collect()), key=str), similarity, recall)


HITS = "doc_id bigint, item_id bigint, edits bigint, at_word bigint"


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """(doc_id, item_id, edits, at_word): a row for each row of ``docs`` and item it contains.

    An item of n words is contained if some stretch of the document is within
    (1 - similarity) * n word edits of it. Items and documents without words match
    nothing; repeated rows and repeated items repeat; a null id stays null; empty
    tables give no rows. Documents are searched where they are read: nothing is shuffled.
    """
    own, found = texts(docs, id_col, text_col), None
    for block in blocks(items, item_id_col, item_text_col, similarity, recall):

        def run(batches: Iterable[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in sliced(batch):
                    ids = part.column(0).to_pylist()
                    hits = [(ids[d], block.ids[i], e, at) for d, i, e, at in block.find(part.column(1).to_pylist())]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits)], names=["doc_id", "item_id", "edits", "at_word"])

        made = own.mapInArrow(run, HITS)
        found = made if found is None else found.unionByName(made)
    return found


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns as they are."""
    ship(docs.sparkSession)
    for block in blocks(items, item_id_col, item_text_col, similarity, recall):

        def run(batches: Iterable[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in sliced(batch):
                    bad = {d for d, *_ in block.find(part.column(part.schema.names.index(text_col)).to_pylist())}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
