"""Evaluation passages inside a training corpus.

One pass over the corpus turns markup into the words a reader sees, codes them
by the vocabulary of the passages and finds every passage n-gram. These seeds
join documents to passages. A shared n-gram alone says little; what counts is how
many hits of a passage lie on neighbouring diagonals (place in the document less
place in the passage): ``needed`` hits within a quarter of the passage's length,
that is one for eight words of the passage, and at most as many as a run of ``RUN``
equal words has. So what is found in a document doesn't depend on the rest of the
corpus, and common phrases start nothing. Where enough hits meet, the words around
them, bounded by the passage's length, are aligned word by word (Smith-Waterman,
linear gaps), which scores edited and partial copies.

A run of ``RUN`` equal words is never missed. An edited copy is found while it keeps
``needed`` of its n-grams in place: with n-grams of three words even an edit in each
fourth word leaves enough; denser edits are missed.

The passages are a stated query set. They are worked off in blocks of at most
``block_words`` words, so what is sent to all tasks is bounded whatever the size
of the set; a set beyond one block costs one corpus pass a block. Documents of any
length are read whole, in overlapping pieces of ``PIECE`` words.

Defined results: null or empty texts and passages have no words and match
nothing; rows with a null id are left out; passages of at most ``gram`` words are
seeded as a whole; equal passages of different items are all reported; rows that
repeat a doc_id are one document, shown by its best text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix64
from .wikitext import plain_words, words

GRAM, RUN, BLOCK_WORDS = 8, 12, 500_000
#: words of a passage for each hit that starts an alignment
WORDS_A_HIT = 8
#: words of a document looked at together; seeds expanded at a time
PIECE, EXPAND = 50_000, 1 << 21
MATCH, MISMATCH, GAP = 2, -1, -1
_U = np.uint64


def _gram_hashes(ids: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n word codes from each position on, or from the positions ``at``."""
    at = np.arange(max(0, len(ids) - n + 1)) if at is None else at
    h = np.full(len(at), n, _U)
    for i in range(n):
        h = mix64(h * _U(1000003) + ids[at + i].astype(np.int64).view(_U))
    return h


def needed(size: int, gram: int) -> int:
    """Hits on neighbouring diagonals that start an alignment with a passage of ``size`` words."""
    return max(1, min(RUN - gram + 1, size // WORDS_A_HIT))


def item_blocks(items: DataFrame, block_words: int):
    """Lists of (item_id, words), each list of at most ``block_words`` words, read by the tasks."""

    def read(batches):
        for batch in batches:
            said = [plain_words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.list_(pa.string()))], names=["item_id", "words"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "passage").where("item_id is not null and passage is not null")
    block, size = [], 0
    for row in rows.mapInArrow(read, "item_id long, words array<string>").orderBy("item_id", "words").toLocalIterator():
        if block and size + len(row["words"]) > block_words:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["words"]))
        size += len(row["words"])
    if block:
        yield block


class Passages:
    """A block of passages as word codes, and the places of each of their n-grams."""

    def __init__(self, block: list[tuple[int, list[str]]], gram: int):
        self.gram = gram
        self.vocab: dict[str, int] = {}
        self.ids = [i for i, w in block if w]
        self.words = [np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int32) for _, w in block if w]
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.sizes, self.needed = sizes, np.array([needed(n, gram) for n in sizes], np.int64)
        # a passage of fewer words is one n-gram of its own length
        self.lengths = sorted({min(gram, int(n)) for n in sizes})
        hashes = [_gram_hashes(w, min(gram, len(w))) for w in self.words]
        flat = np.concatenate([np.zeros(0, _U), *hashes])
        order = np.argsort(flat, kind="stable")
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)])[order]

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers) of all n-grams of passages in a row of word codes."""
        unknown = np.concatenate([[0], np.cumsum(code < 0)])
        places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.lengths:
            if len(code) < n or not len(self.grams):
                continue
            place = np.flatnonzero(unknown[n:] == unknown[:-n])
            h = _gram_hashes(code, n, place)
            g = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
            ok = self.grams[g] == h
            places.append(place[ok])
            numbers.append(g[ok])
        return np.concatenate(places), np.concatenate(numbers)

    def windows(self, owner: np.ndarray, place: np.ndarray, number: np.ndarray):
        """(owner, item, lowest, highest diagonal, straight) wherever enough hits of an item meet.

        ``owner`` numbers the piece of text that a hit lies in; ``straight`` tells
        whether one diagonal has as many hits as a run of ``RUN`` words.
        """
        count = self.count[number]
        of = np.repeat(np.arange(len(number)), count)
        spot = np.repeat(self.first[number] - np.cumsum(count) + count, count) + np.arange(len(of))
        item, n = self.item[spot], len(self.words)
        pair = owner[of] * n + item
        if len(pair) and pair[-1] < 1 << 24:  # most pairs have too few hits anywhere: they needn't be sorted
            enough = np.bincount(pair)[pair] >= self.needed[item]
            of, spot, pair = of[enough], spot[enough], pair[enough]
        key = pair << 32 | (place[of] - self.at[spot] + (1 << 30))
        key.sort()
        item = (key >> 32) % n
        last = np.searchsorted(key, key + np.maximum(1, self.sizes[item] // 4), "right") - 1
        start = np.flatnonzero(last - np.arange(len(key)) + 1 >= self.needed[item])
        alike = np.searchsorted(key, key, "right") - np.arange(len(key))
        straight = np.concatenate([[0], np.cumsum(alike >= RUN - self.gram + 1)])
        pair, low, high = key[start] >> 32, key[start], key[last[start]]
        new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]])) if len(start) else start
        end = np.append(new[1:], len(start)) - 1 if len(start) else start
        diagonal = lambda k: (k & 0xFFFFFFFF) - (1 << 30)
        runs = straight[last[start[end]] + 1] > straight[start[new]] if len(start) else start.astype(bool)
        return pair[new] // n, pair[new] % n, diagonal(low[new]), diagonal(high[end]), runs

    def overlap(self, item: int, code: np.ndarray) -> int:
        """Words that a stretch of text has in common with a passage, with repeats."""
        known, often = self.bags[item]
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        return int(np.minimum(np.bincount(at[known[at] == code], minlength=len(known)), often).sum())


def _stretches(low: int, high: int, size: int):
    """A range of diagonals in parts of at most two passages' length, which overlap by one."""
    while high - low > 2 * size:
        yield low, low + 2 * size
        low += size
    yield low, high


def windows(docs: DataFrame, block: Passages, least: float = 0.0) -> DataFrame:
    """(doc_id, item, words): a row wherever enough seeds of a passage meet.

    ``words`` are the codes of the words around (-1: in no passage). Left out is what
    has too few words of the passage, in any order, for a score of ``least`` and no
    straight run of ``RUN`` words.
    """
    longest = int(block.sizes.max(initial=1))

    def pieces(code):
        """(offset, codes): overlapping parts, so that each window lies whole in one."""
        step = max(PIECE, 8 * longest)
        return [(a, code[a : a + step + 6 * longest]) for a in range(0, max(1, len(code)), step)]

    def found(batch):
        """Pieces of the batch's documents with their hits, a bounded number of expanded seeds at a time."""
        held, size = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            code = np.array([block.vocab.get(w, -1) for w in words(text)] if text else [], np.int32)
            for _, part in pieces(code):
                place, number = block.hits(part)
                if len(place):
                    held.append((doc, part, place, number))
                    size += int(block.count[number].sum())
            if size > EXPAND:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches):
        for batch in batches:
            for held in found(batch):
                owner = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
                out: tuple[list, list, list] = ([], [], [])
                spans = block.windows(owner, *(np.concatenate([h[i] for h in held]) for i in (2, 3)))
                for own, item, low, high, straight in zip(*(x.tolist() for x in spans)):
                    n = int(block.sizes[item])
                    for a, b in _stretches(low, high, n):
                        near = held[own][1][max(0, a - n // 2) : b + n + n // 2]
                        if straight or least <= 0 or block.overlap(item, near) >= least * n:
                            for column, v in zip(out, (held[own][0], item, near)):
                                column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int32()))], names=["doc_id", "item", "words"])

    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return clean.mapInArrow(run, "doc_id long, item int, words array<int>")


def align(docs: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(Smith-Waterman score, longest run of equal words) of each pair, pairs side by side."""
    p, wide, long = len(docs), max(map(len, docs)), max(map(len, items))
    x, y = np.full((wide, p), -1, np.int32), np.full((long, p), -2, np.int32)
    for i, (d, t) in enumerate(zip(docs, items)):
        x[: len(d), i] = d
        y[: len(t), i] = t
    kind = np.int16 if MATCH * (wide + long) < 1 << 15 else np.int32
    ramp = (-GAP * np.arange(wide + 1)).astype(kind)[:, None]
    h, run, best, most, up = (np.zeros((wide + 1, p), kind) for _ in range(5))
    same, step = np.empty((wide, p), bool), np.empty((wide, p), kind)
    for j in range(long):
        # padding equals nothing, so it only lowers scores
        np.equal(x, y[j], out=same)
        np.multiply(same, kind(MATCH - MISMATCH), out=step)
        step += h[:-1]
        step += kind(MISMATCH)
        np.maximum(h + kind(GAP), 0, out=up)
        np.maximum(up[1:], step, out=up[1:])
        up += ramp
        np.maximum.accumulate(up, axis=0, out=h)
        h -= ramp
        np.maximum(best, h, out=best)
        np.multiply(run[:-1] + kind(1), same, out=step)
        run[1:] = step
        np.maximum(most, run, out=most)
    return best.max(axis=0).astype(np.int32), most.max(axis=0).astype(np.int32)


def leaks_of_block(docs: DataFrame, block: Passages, least: float = 0.0) -> DataFrame:
    """(doc_id, item_id, score, longest_run) for documents and passages joined by seeds."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            items = batch.column(1).to_pylist()
            # revisions of a page show the same words again: each stretch is aligned once
            known: dict[tuple[int, bytes], int] = {}
            own, which = [], np.empty(len(items), np.int64)
            for k, (item, w) in enumerate(zip(items, batch.column(2))):
                code = np.asarray(w.values, np.int32)
                which[k] = known.setdefault((item, code.tobytes()), len(known))
                if which[k] == len(own):
                    own.append((item, code))
            order = np.argsort([len(w) for _, w in own], kind="stable")
            score, longest = np.zeros(len(own)), np.zeros(len(own), np.int32)
            for a in range(0, len(order), 128):
                at = order[a : a + 128]
                s, r = align([own[i][1] for i in at], [block.words[own[i][0]] for i in at])
                score[at] = s / (MATCH * block.sizes[[own[i][0] for i in at]])
                longest[at] = r
            ids = pa.array([block.ids[i] for i in items], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(score[which]), pa.array(longest[which])], names=["doc_id", "item_id", "score", "longest_run"])

    return windows(docs, block, least).mapInArrow(run, "doc_id long, item_id long, score double, longest_run int")


def leaks(docs: DataFrame, items: DataFrame, *, gram: int = GRAM, least: float = 0.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, longest_run) of all blocks of passages.

    ``score`` is the alignment score over that of a whole, unedited copy; rows with
    less than ``least`` and without ``RUN`` equal words may be left out. Reads the
    passages at once (a job); an item whose id repeats is reported once, by its best.
    """
    out = None
    for block in item_blocks(items, block_words):
        part = leaks_of_block(docs, Passages(block, gram), least)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, longest_run int")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("longest_run").alias("longest_run"))
