"""Benchmark decontamination: rare word triples of test items seed Smith-Waterman alignments with the training texts.

1. Words are runs of letters and digits, Latin capitals lowered. All documents are counted once for the words of the test items, which gives
   each triple of an item a chance of occurring by accident: the product of its words' shares of the corpus.
2. Triples rarer than a limit are seeds, and in any case the rarest few of each item. Every document is searched for all of them.
3. Where a document has a seed of an item, the item is aligned with the document's words around the seed's diagonal
   (match 2, other word -1, gap -1). The score over that of a perfect copy is the similarity; edited and paraphrased copies keep
   most of it.
4. A short passage of a long item has a small similarity, but is no accident either. Where the similarity is too small, a second alignment
   scores each matched word by the digits of its share of the corpus (and other words and gaps by a loss); enough digits make a leak too.

Test items are taken in blocks of a bounded number of words, so that what each task holds has a fixed size; documents are searched once
per block. A document's partners are not capped.

Defined results: null or empty texts and items without a word match nothing. An item with fewer than three words is sought as
a whole. Every input row that holds an item gives a row of its own, also where its ``doc_id`` is null or repeats; texts that share an ``item_id`` count as one
item, the best. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import textvec
from logspark.llm.common import keep_rows, map_batches, map_partitions

#: Words of test items searched for in one pass over the documents.
BLOCK_WORDS = 2_000_000
#: A triple counts as rare if it is expected less often than this per corpus word.
RARE = 1e-7
#: The rarest triples of an item are seeds even if they are not that rare.
LEAST_SEEDS = 8
#: Least similarity of a contaminated document without other evidence.
SIMILARITY = 0.32
#: Decimal digits by which the matched words of a passage must be rarer than accident; what one word adds at most, and another word or gap takes off.
EVIDENCE, WORD_DIGITS, OTHER_DIGITS = 24.0, 4.0, 3.0
MATCH, OTHER, GAP = 2, -1, -1

_gap = np.ones(256, bool)
_gap[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + list(range(128, 256))] = False


def tokens(column: pa.Array):
    for piece in textvec.pieces(column):
        piece.words(space=_gap, latin=True)
        yield piece


@dataclass
class Index:
    """Test items of one block: their words, and the seeds with the places (item, word) where each occurs."""

    ids: list[int | None]
    words: list[np.ndarray]
    sizes: tuple[int, ...] = ()
    seeds: np.ndarray | None = None
    first: np.ndarray | None = None
    item: np.ndarray | None = None
    place: np.ndarray | None = None
    digits: list[np.ndarray] | None = None

    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))

    def choose(self, share: dict[int, float], rare: float, least: int) -> None:
        found = []
        self.digits = [np.minimum(-np.log10([share[int(w)] for w in own]), WORD_DIGITS) for own in self.words]
        for k, own in enumerate(self.words):
            size = min(3, len(own))
            if not size:
                continue
            grams = textvec.combine(own, size)
            logs = np.log([share[int(w)] for w in own])
            chance = np.convolve(logs, np.ones(size), "valid")
            keep = (chance <= np.log(rare)) | (np.argsort(np.argsort(chance, kind="stable")) < least)
            found += [(int(g), k, int(at)) for g, at in zip(grams[keep], np.flatnonzero(keep), strict=True)]
        found.sort()
        seeds = np.array([f[0] for f in found], np.uint64)
        self.item, self.place = (np.array([f[i] for f in found], np.int64) for i in (1, 2))
        self.seeds, self.first = np.unique(seeds, return_index=True)
        self.first = np.append(self.first, len(found))
        self.sizes = tuple(sorted({min(3, len(w)) for w in self.words if len(w)}))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the grams that are seeds, and of the seeds."""
        at = np.searchsorted(self.seeds, grams)
        at[at == len(self.seeds)] = 0
        good = np.flatnonzero(self.seeds[at] == grams)
        return good, at[good]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman score of two word sequences, and the end of the best local alignment in ``text``."""
    steps = np.arange(len(text) + 1) * -GAP
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        move = np.maximum(row + GAP, 0)
        np.maximum(move[1:], row[:-1] + np.where(text == word, MATCH, OTHER), out=move[1:])
        row = np.maximum.accumulate(move + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def evidence(item: np.ndarray, digits: np.ndarray, text: np.ndarray) -> float:
    """Best local alignment of two word sequences if a match scores the digits of its word and another word or a gap loses a fixed number."""
    steps = np.arange(len(text) + 1) * OTHER_DIGITS
    row, best = np.zeros(len(text) + 1), 0.0
    for word, gain in zip(item, digits, strict=True):
        move = np.maximum(row - OTHER_DIGITS, 0)
        np.maximum(move[1:], row[:-1] + np.where(text == word, gain, -OTHER_DIGITS), out=move[1:])
        row = np.maximum.accumulate(move + steps) - steps
        best = max(best, float(row.max()))
    return best


def matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, rare: float = RARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, similarity, score, begin_word, end_word``: the best alignment of each contaminated document and test item.

    ``docs`` holds ``doc_id, text`` and ``items`` ``item_id, text``; word positions count runs of letters and digits, the end exclusive.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    found = None
    for index in _indexes(texts, items, rare, block_words):
        part = _search(texts, index, similarity)
        found = part if found is None else found.unionByName(part)
    return found


def _indexes(texts: DataFrame, items: DataFrame, rare: float, block_words: int) -> Iterator[Index]:
    """The test items in blocks of a bounded number of words; an ``item_id`` lies in one block."""
    sized = items.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()
    words = sized.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    blocks = -(-words // block_words) or 1
    for block in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        index = _index(rows)
        vocabulary = index.vocabulary()
        index.choose(_shares(texts, vocabulary) if len(vocabulary) else {}, rare, LEAST_SEEDS)
        yield index


def _index(rows: pa.Table) -> Index:
    words: list[np.ndarray] = []
    for piece in tokens(rows.column(1)):
        words += [piece.hashes[piece.at[r] : piece.at[r + 1]] for r in range(piece.rows)]
    return Index(rows.column(0).to_pylist(), words)


def _shares(texts: DataFrame, vocabulary: np.ndarray) -> dict[int, float]:
    """Share of the corpus of each word of a sorted vocabulary; a word that never occurs counts half."""
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = sent.value
        counts = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for piece in tokens(batch.column(0)):
                at = np.searchsorted(known, piece.hashes)
                at[at == len(known)] = 0
                counts[:-1] += np.bincount(at[known[at] == piece.hashes], minlength=len(known)) if len(known) else 0
                counts[-1] += len(piece.hashes)
        some = np.flatnonzero(counts)
        yield {"i": some, "n": counts[some]}

    total = map_partitions(texts.select("text"), "i long, n long", count).groupBy("i").agg(F.sum("n").alias("n")).collect()  # one block's words
    counts = {r["i"]: r["n"] for r in total}
    every = max(counts.get(len(vocabulary), 0), 1)
    return {int(w): max(counts.get(i, 0), 0.5) / every for i, w in enumerate(vocabulary)}


def _found(index: Index, column: pa.Array, similarity: float) -> list[tuple]:
    """Row, item, score and span of the best alignment of each text and ``item_id``; of equal scores the first in the text."""
    best: dict[tuple, tuple] = {}
    for piece in tokens(column):
        for row, item, score, begin, end in _piece(index, piece, similarity):
            key = (row, index.ids[item])
            if key not in best or (score, -begin) > (best[key][2], -best[key][3]):
                best[key] = (row, item, score, begin, end)
    return list(best.values())


def _search(texts: DataFrame, index: Index, similarity: float) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(index)

    def search(batch: pa.RecordBatch):
        own, ids = sent.value, batch.column(0)
        if out := _found(own, batch.column(1), similarity):
            row, item, score, begin, end = map(list, zip(*out, strict=True))
            full = np.array([MATCH * len(own.words[k]) for k in item])
            yield {
                "doc_id": ids.take(pa.array(row, pa.int64())), "item_id": [own.ids[k] for k in item], "similarity": np.array(score) / full, "score": score,
                "begin_word": begin, "end_word": end,
            }

    schema = "doc_id long, item_id long, similarity double, score long, begin_word long, end_word long"
    return map_batches(texts, schema, search)


def _piece(index: Index, piece: textvec.Piece, similarity: float) -> list[tuple]:
    """Row, item, score and span of the alignments in a piece that are similar enough."""
    rows, items, diagonals = [], [], []
    for size in index.sizes:
        grams, first = piece.grams(size)
        good, seed = index.hits(grams)
        for at, s in zip(first[good].tolist(), seed.tolist(), strict=True):
            for k in range(index.first[s], index.first[s + 1]):
                rows.append(int(piece.row[at]))
                items.append(int(index.item[k]))
                diagonals.append(at - int(index.place[k]))
    found, group = [], {}
    for key in zip(rows, items, diagonals, strict=True):
        group.setdefault(key[:2], set()).add(key[2])
    for (row, item), starts in group.items():
        words = index.words[item]
        slack = len(words) // 2 + 4
        begin, end = int(piece.at[row]), int(piece.at[row + 1])
        ordered, spans = sorted(starts), []
        for d in ordered:
            low, high = max(d - slack, begin), min(d + len(words) + slack, end)
            if spans and low <= spans[-1][1]:
                spans[-1][1] = high
            else:
                spans.append([low, high])
        for low, high in spans:
            text = piece.hashes[low:high]
            score, stop = align(words, text)
            if score >= similarity * MATCH * len(words) or evidence(words, index.digits[item], text) >= EVIDENCE:
                back, length = align(words[::-1], text[:stop][::-1])
                found.append((piece.first + row, item, score, low + stop - length - begin, low + stop - begin))
    return found


def keep_clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, rare: float = RARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without a test item, with all their columns: each is searched where its text is read, once for each block of items."""
    texts, out = docs.select(F.col("doc_id").cast("long"), "text"), docs
    for index in _indexes(texts, items, rare, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batch: pa.RecordBatch, sent=sent):
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, *_ in _found(sent.value, batch.column("text"), similarity)]] = False
            return keep

        out = keep_rows(out, clean)
    return out
