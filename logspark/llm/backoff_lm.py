"""Language-model scores with stupid backoff, from n-gram counts of the whole corpus.

The relations, with n-grams as 64-bit hashes of words (A-Z lowered), and rows that hold many of them as sorted arrays:

1. ``chunks``: documents in groups of about ``CHUNK_WORDS`` words, as numbers of the chunk's distinct words; stored in buckets, so they are not moved again.
2. ``marks``: per chunk and order ``MARK_BITS`` bits of each distinct n-gram, cut by ranges of the hash.
3. ``shared``: marks grouped by hash range, and for each n-gram of a chunk whether another chunk has its mark. An n-gram without such a mark is the
   chunk's own, and the chunk knows its count.
4. ``grams``: the distinct n-grams with shared marks, with their counts, cut alike (a count before any shuffle).
5. ``counts``: grams grouped by hash range, summed over all chunks, and joined back to each chunk's n-grams. Two n-grams of one mark stay apart here.
6. ``scores``: counts regrouped by chunk, joined to the chunk's exploded n-grams and summed per document.

A document's own n-grams are taken off the counts before it is scored, so a document does not vouch for itself. A word's score is the relative
count of the longest n-gram ending in it that other documents have, times ``ALPHA`` for each word of context given up; a word that no other
document has counts ``UNSEEN``.

Hash ranges grow in number with the corpus, so a group holds about ``RANGE_GRAMS`` n-grams whatever the input; a frequent n-gram has one entry
per chunk.

Defined results: null and empty texts have no words, a log score of 0 and a null mean. Repeated rows are scored one by one, and are each other's
companions. Rows without ``doc_id`` are scored like others. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import textvec
from logspark.llm.common import map_batches, map_partitions, save_and_read, save_in_buckets
from logspark.session import ship

ORDER = 3
ALPHA = 0.4
UNSEEN = 0.5
CHUNK_WORDS = 1_000_000
RANGE_GRAMS = 1_000_000
#: Bits by which n-grams of a range are told apart at first; a million n-grams leave one in 64 with the mark of another.
MARK_BITS = 26


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers as bytes: a width and, coded by how often each byte occurs, all lowest bytes, all next ones and so on."""
    if not len(values):
        return bytes([1])
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(len(values), 8)[:, :width]
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes.T.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    width, size = blob[0], int.from_bytes(blob[1:9], "little")
    out = np.zeros((size, 8), np.uint8)
    if size:
        planes = pa.decompress(blob[9:], decompressed_size=width * size, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, size).T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob), dtype=np.uint64)


def chunks(docs: DataFrame, words: int = CHUNK_WORDS) -> DataFrame:
    """``doc_id, size`` (arrays), ``tokens`` (numbers of words, packed) and ``vocabulary`` (sorted word hashes, packed)."""

    def run(batches):
        ids, sizes, hashes, total = [], [], [], 0
        for batch in batches:
            column = batch.column(0)
            for piece in textvec.pieces(batch.column(1)):
                piece.words()
                ids += column[piece.first : piece.first + piece.rows].to_pylist()
                sizes.append(np.diff(piece.at))
                hashes.append(piece.hashes)
                total += len(piece.hashes)
                if total >= words:
                    yield chunk(ids, sizes, hashes)
                    ids, sizes, hashes, total = [], [], [], 0
        if ids:
            yield chunk(ids, sizes, hashes)

    def chunk(ids, sizes, hashes) -> dict:
        vocabulary, number, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return {
            "doc_id": [ids], "size": [np.concatenate(sizes)], "tokens": [packed(rank[number])], "vocabulary": [pack_sorted(vocabulary)],
            "rank": [packed(order)],
        }

    schema = "doc_id array<long>, size array<int>, tokens binary, vocabulary binary, rank binary"
    return map_partitions(docs.select(F.col("doc_id").cast("long"), "text"), schema, run)


class Chunk:
    """The words of a chunk, and for each order its n-grams: ``first`` word of each, ``number`` among the distinct, ``distinct`` hashes, counts ``n``."""

    def __init__(self, size, tokens: bytes, vocabulary: bytes, rank: bytes):
        self.size = np.asarray(size, np.int64)
        self.hashes = unpack_sorted(vocabulary)[unpacked(rank).astype(np.int64)][unpacked(tokens).astype(np.int64)] if len(tokens) > 1 else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)

    def grams(self, k: int):
        count = max(len(self.hashes) - k + 1, 0)
        first = np.flatnonzero(self.doc[:count] == self.doc[k - 1 : k - 1 + count])
        all_ = textvec.combine(self.hashes, k)[first] if count else np.zeros(0, np.uint64)
        distinct, number, n = np.unique(all_, return_inverse=True, return_counts=True)
        return first, number, distinct, n


def cut(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the slices of sorted hashes that share their first ``bits`` bits."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]])


def shared_among(distinct: np.ndarray, bits: int, found: list[tuple[int, bytes]]) -> np.ndarray:
    """Whether another chunk has the mark of each of the ``distinct`` n-grams, from the ``shared`` bits of their slices."""
    at, out = cut(distinct, bits), np.zeros(len(distinct), bool)
    for s, flags in found:
        out[at[s] : at[s + 1]] = np.unpackbits(np.frombuffer(flags, np.uint8), count=at[s + 1] - at[s])
    return out


def flags_by_order(table: pa.Table, order: int) -> list[list[tuple[int, bytes]]]:
    """``shared`` of the rows of a chunk that have it, with the number of the slice, by order."""
    out: list[list[tuple[int, bytes]]] = [[] for _ in range(order)]
    for place, flags in zip(table.column("range").to_pylist(), table.column("shared").to_pylist(), strict=True):
        if flags is not None:
            out[place % order].append((place // order, flags))
    return out


def mark_tables(rows: DataFrame, order: int, bits: int, mark_bits: int) -> DataFrame:
    """``range, chunk, marks``: the marks of a chunk's sorted n-grams within a range of hashes. Orders share the ranges."""

    def run(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            own = Chunk(r["size"], r["tokens"], r["vocabulary"], r["rank"])
            for k in range(1, order + 1):
                distinct = own.grams(k)[2]
                at = cut(distinct, bits)
                some = np.flatnonzero(np.diff(at))
                marks = (distinct << np.uint64(bits)) >> np.uint64(64 - mark_bits)
                yield {
                    "range": [int(s) * order + k - 1 for s in some], "chunk": [r["chunk"]] * len(some),
                    "marks": [pack_sorted(marks[at[s] : at[s + 1]]) for s in some],
                }

    return map_batches(rows, "range long, chunk long, marks binary", run)


def shared_marks(tables: DataFrame) -> DataFrame:
    """``range, chunk, shared``: a bit for each of the marks, in the same order, set if another chunk has it too."""

    def compare(table: pa.Table) -> pa.Table:
        marks = [unpack_sorted(x) for x in table.column("marks").to_pylist()]
        distinct, holders = np.unique(np.concatenate([np.unique(m) for m in marks]), return_counts=True)
        flags = [np.packbits(holders[np.searchsorted(distinct, m)] > 1).tobytes() for m in marks]
        return pa.table({"range": table.column("range"), "chunk": table.column("chunk"), "shared": pa.array(flags, pa.binary())})

    ship(tables.sparkSession)
    return tables.groupBy("range").applyInArrow(compare, "range long, chunk long, shared binary")


def gram_tables(rows: DataFrame, shared: DataFrame, order: int, bits: int) -> DataFrame:
    """``range, chunk, grams, n``: sorted n-grams of a chunk within a range whose marks are ``shared``, with their counts."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {"range": [], "chunk": [], "grams": [], "n": []}
        found = flags_by_order(right, order)
        for r in left.to_pylist():
            own = Chunk(r["size"], r["tokens"], r["vocabulary"], r["rank"])
            for k in range(1, order + 1):
                _, _, distinct, n = own.grams(k)
                kept = shared_among(distinct, bits, found[k - 1])
                distinct, n = distinct[kept], n[kept]
                at = cut(distinct, bits)
                for s in np.flatnonzero(np.diff(at)):
                    out["range"].append(int(s) * order + k - 1)
                    out["chunk"].append(r["chunk"])
                    out["grams"].append(pack_sorted(distinct[at[s] : at[s + 1]]))
                    out["n"].append(packed(n[at[s] : at[s + 1]]))
        return pa.table(out, schema=pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("grams", pa.binary()), ("n", pa.binary())]))

    ship(rows.sparkSession)
    return rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(run, "range long, chunk long, grams binary, n binary")


def corpus_counts(tables: DataFrame) -> DataFrame:
    """``range, chunk, n``: for the same n-grams, in the same order, how often the corpus has them."""

    def total(table: pa.Table) -> pa.Table:
        grams = [unpack_sorted(x) for x in table.column("grams").to_pylist()]
        n = np.concatenate([unpacked(x) for x in table.column("n").to_pylist()]).astype(np.int64)
        distinct, number = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.bincount(number, weights=n, minlength=len(distinct)).astype(np.int64)[number]
        parts = np.split(sums, np.cumsum([len(g) for g in grams])[:-1])
        return pa.table({"range": table.column("range"), "chunk": table.column("chunk"), "n": pa.array([packed(p) for p in parts], pa.binary())})

    ship(tables.sparkSession)
    return tables.groupBy("range").applyInArrow(total, "range long, chunk long, n binary")


def score_chunk(own: Chunk, counts: list[np.ndarray], order: int, corpus_words: int, alpha: float) -> np.ndarray:
    """Log score of each document of a chunk. ``counts[k - 1]`` are the corpus counts of the chunk's distinct n-grams of order ``k``."""
    size = own.size
    others = []  # per order and word: how often other documents have the n-gram that ends there, and -1 where there is none
    for k in range(1, order + 1):
        first, number, distinct, _ = own.grams(k)
        key, inverse, mine = np.unique(own.doc[first] * max(len(distinct), 1) + number, return_inverse=True, return_counts=True)
        values = np.full(len(own.hashes), -1, np.int64)
        values[first + k - 1] = counts[k - 1][number] - mine[inverse]
        others.append(values)
    logs = np.zeros(len(own.hashes))
    open_ = np.ones(len(own.hashes), bool)
    given_up = np.zeros(len(own.hashes))
    for k in range(order, 1, -1):
        n = others[k - 1]
        context = np.concatenate([[-1], others[k - 2][:-1]]) if len(n) else n
        hit = open_ & (n > 0)
        logs[hit] = np.log(n[hit] / context[hit]) + given_up[hit] * math.log(alpha)
        open_ &= ~hit
        given_up[open_ & (n >= 0)] += 1
    rest = np.maximum(corpus_words - size, 1)[own.doc]
    one = np.maximum(others[0], UNSEEN)
    logs[open_] = np.log(one[open_] / rest[open_]) + given_up[open_] * math.log(alpha)
    return np.bincount(own.doc, weights=logs, minlength=len(size))


def scores(
    docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, chunk_words: int = CHUNK_WORDS, range_grams: int = RANGE_GRAMS, mark_bits: int = MARK_BITS
) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` for every row of ``docs`` (``doc_id``, ``text``)."""
    rows = save_in_buckets(chunks(docs, chunk_words).withColumn("chunk", F.monotonically_increasing_id()), "chunk", "lm-chunks")
    words = rows.select(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(words / range_grams, 1))))
    shared = save_and_read(shared_marks(mark_tables(rows, order, bits, mark_bits)), "lm-shared")
    counts = corpus_counts(gram_tables(rows, shared, order, bits))
    known = shared.withColumn("n", F.lit(None).cast("binary")).unionByName(counts.withColumn("shared", F.lit(None).cast("binary")))

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {"doc_id": [], "n_words": [], "log_score": []}
        flags = flags_by_order(right, order)
        found = sorted((at, n) for at, n in zip(right.column("range").to_pylist(), right.column("n").to_pylist(), strict=True) if n is not None)
        for r in left.to_pylist():
            own, per_order = Chunk(r["size"], r["tokens"], r["vocabulary"], r["rank"]), []
            for k in range(order):
                _, _, distinct, n = own.grams(k + 1)
                n[shared_among(distinct, bits, flags[k])] = np.concatenate([np.zeros(0, np.int64)] + [unpacked(x).astype(np.int64) for at, x in found if at % order == k])
                per_order.append(n)
            out["doc_id"] += r["doc_id"]
            out["n_words"] += r["size"]
            out["log_score"] += score_chunk(own, per_order, order, words, alpha).tolist()
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())]))

    found = rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, "doc_id long, n_words long, log_score double")
    return found.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
