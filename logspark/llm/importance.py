r"""Target-distribution importance resampling: hashed n-gram weights, seeded noise, and exact ranks by parallel sorting by regular sampling.

1. ``counts``: features (runs of one and two consecutive words) of all documents and of all target texts, per bucket of their crc32. Every partition
   adds up its buckets before it sends them.
2. ``gains``: one whole number a bucket, an array of fixed size that scores every document: its weight is the floored mean gain of its features.
3. ``score``: the weight plus Gumbel noise from a hash of the id, so that the highest scores are a draw without replacement.
4. ``ranks``: every partition of the scores is sorted by itself (a run) and gives regular samples; the sorted samples give regular splitters; every
   run is cut at the splitters, segment ``k`` of all runs is merged in one task, and the sizes of the earlier segments make local places global.

Splitters are whole sort keys (score, id, row), so any number of equal scores is split like others, and a segment holds at most twice its even share
of rows up to the spacing of the samples. The driver sees ``SAMPLES`` keys a partition, and one size a segment; no row of text is shuffled.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lowered. Defined results: null and empty texts have no features, weight 0 and are never drawn.
Null ids hash as an empty id and come last among equal scores. Repeated rows are drawn one by one. Target texts without words leave
all gains to the corpus counts. An empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import textvec
from logspark.llm.common import map_batches, map_partitions, save_and_read
from logspark.session import ship

BUCKETS = 10_000
SEED = 7
LEAST_WORDS, PERCENT = 20, 25
#: Regular samples of a run, and rows of a segment, about.
SAMPLES = 64
SEGMENT_ROWS = 1 << 17
#: Words up to this length are hashed together; longer ones one by one.
SHORT = 48

_gap = np.ones(256, bool)
_gap[list(b"0123456789abcdefghijklmnopqrstuvwxyz") + list(range(128, 256))] = False


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table of crc32, and for each length up to ``SHORT`` what as many zero bytes make of each byte of a register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (table >> np.uint32(1))
    zeros = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(SHORT):
        zeros.append(table[zeros[-1] & 255] ^ (zeros[-1] >> np.uint32(8)))
    return table, np.stack(zeros)


TABLE, ZEROS = _crc_tables()
FULL = np.uint32(0xFFFFFFFF)


def word_bounds(piece: textvec.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes of a piece, starts and ends of its words, and per text the bounds of its words."""
    data = textvec._lower[piece.data]
    gap = _gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[piece.offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = gap[:-1] | edge[1:-1]
    after[:-1] = gap[1:] | edge[1:-1]
    starts = np.flatnonzero(~gap & before)
    return data, starts, np.flatnonzero(~gap & after) + 1, np.searchsorted(starts, piece.offsets)


def crc_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of every word: byte by byte over all words that are that long."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    ordered, at = size[order], starts[order]
    long = int(np.count_nonzero(ordered > SHORT))
    crc = np.full(len(order), FULL)
    rest = slice(long, None)
    lengths = -ordered[rest]
    for k in range(int(ordered[long]) if long < len(ordered) else 0):
        own = slice(long, long + int(np.searchsorted(lengths, -k, "left")))
        crc[own] = TABLE[(crc[own] ^ data[at[own] + k]) & np.uint32(255)] ^ (crc[own] >> np.uint32(8))
    crc ^= FULL
    for k in range(long):
        crc[k] = zlib.crc32(data[at[k] : at[k] + ordered[k]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(piece: textvec.Piece, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature, the text of each, and the words of each text."""
    data, starts, ends, at = word_bounds(piece)
    one = crc_words(data, starts, ends)
    row = np.repeat(np.arange(piece.rows), np.diff(at))
    left = np.flatnonzero(row[:-1] == row[1:])
    spaced = one[left] ^ FULL
    spaced = TABLE[(spaced ^ np.uint32(32)) & np.uint32(255)] ^ (spaced >> np.uint32(8)) ^ FULL
    size = (ends - starts)[left + 1]
    short = np.minimum(size, SHORT)
    two = one[left + 1]
    for k in range(4):
        two = two ^ ZEROS[short, k, (spaced >> np.uint32(8 * k)) & np.uint32(255)]
    for k in np.flatnonzero(size > SHORT):
        word = left[k] + 1
        two[k] = zlib.crc32(data[starts[word] : ends[word]], int(spaced[k]))
    return np.concatenate([one, two]) % np.uint32(buckets), np.concatenate([row, row[left]]), np.diff(at)


def counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``text`` values lie in each bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in textvec.pieces(batch.column(0)):
                total += np.bincount(features(piece, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield {"bucket": some.astype(np.int32), "n": total[some]}

    out = np.zeros(buckets, np.int64)
    for r in map_partitions(texts.select("text"), "bucket int, n long", count).groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the smoothed log ratio of each bucket's shares of target and corpus, floored."""
    every, wanted, n = float(corpus.sum()), float(target.sum()), float(len(corpus))
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (every + n) / ((s + 1.0) * (wanted + n)))) for s, t in pairs], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``docs``."""

    def score(batch: pa.RecordBatch):
        ids, words, sizes, weights = batch.column(0), [], [], []
        for piece in textvec.pieces(batch.column(1)):
            bucket, row, n_words = features(piece, len(gain))
            n = np.bincount(row, minlength=piece.rows)
            total = np.zeros(piece.rows, np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[bucket])])
            singles = np.concatenate([[0], np.cumsum(n_words)])
            pairs = singles[-1] + np.concatenate([[0], np.cumsum(n - n_words)])
            for edges in (singles, pairs):
                total += np.diff(sums[edges])
            words.append(n_words)
            sizes.append(n)
            weights.append(total // np.maximum(n, 1))
        weight = np.concatenate(weights)
        drawn = np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
        yield {"doc_id": ids, "n_words": np.concatenate(words), "n_features": np.concatenate(sizes), "weight": weight, "score": weight + drawn}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), SCORED, score)


#: Values that travel with a sort key (falling score, rising id with null last, row).
CARRIED = ("doc_id", "n_features", "weight", "score", "row")
LAST = np.iinfo(np.int64).max


def sort_keys(table) -> np.ndarray:
    """The columns of the sort key, as rows that rise."""
    ids = table.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
    missing = table.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.stack([-table.column("score").to_numpy(), ids, missing, table.column("row").to_numpy()])


def order_of(keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def places(keys: np.ndarray, splitters: list[tuple]) -> list[int]:
    """Where the sorted ``keys`` are cut: before the first key that is not below the splitter."""
    cuts, low = [], 0
    n = keys.shape[1]
    for splitter in splitters:
        left, right = low, n
        while left < right:
            middle = (left + right) // 2
            if tuple(keys[:, middle].tolist()) < splitter:
                left = middle + 1
            else:
                right = middle
        cuts.append(left)
        low = left
    return cuts


def regular_splitters(runs: list[tuple[int, list[int]]], parts: int) -> list[tuple]:
    """At most ``parts - 1`` keys that cut all runs into even parts, from each run's size and regular samples; a sample stands for an even share of its run."""
    keyed = sorted((tuple(sample[k : k + 4]), size * 4 / len(sample)) for size, sample in runs for k in range(0, len(sample), 4))
    total, splitters, passed = sum(size for size, _ in runs), [], 0.0
    for key, share in keyed:
        if len(splitters) < parts - 1 and passed >= (len(splitters) + 1) * total / parts:
            splitters.append(key)
        passed += share
    return splitters


def ranks(rows: DataFrame, samples: int = SAMPLES, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: ``rows`` (``CARRIED``, ``row`` unique) ranked from 1 by falling score, then rising id."""
    lists = ", ".join(f"{c} array<long>" for c in CARRIED)

    def run(batches):
        """One sorted run a partition, with its regular samples (rows of the run at even distances)."""
        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches)
            keys = sort_keys(table)
            order = order_of(keys)
            keys = keys[:, order]
            at = np.unique(np.linspace(0, len(order) - 1, min(samples, len(order))).astype(np.int64))
            lists = {c: [table.column(c).combine_chunks().take(pa.array(order))] for c in CARRIED}
            yield {"size": [len(order)], **lists, "sample": [keys[:, at].T.ravel()]}

    stored = save_and_read(map_partitions(rows.select(*CARRIED), f"size long, {lists}, sample array<long>", run), "ranks-runs")
    own = stored.select("size", "sample").collect()  # `samples` keys a run
    total = sum(r["size"] for r in own)
    parts = -(-total // segment_rows) or 1
    splitters = regular_splitters([(r["size"], r["sample"]) for r in own], parts)
    sent = rows.sparkSession.sparkContext.broadcast(splitters)

    def exchange(batch: pa.RecordBatch):
        for k in range(batch.num_rows):
            parts = {c: batch.column(c)[k].values for c in CARRIED}
            keys = sort_keys(pa.table(parts))
            cuts = [0, *places(keys, sent.value), keys.shape[1]]
            some = [s for s in range(len(cuts) - 1) if cuts[s] < cuts[s + 1]]
            yield {"segment": some, "size": [cuts[s + 1] - cuts[s] for s in some]} | {c: [parts[c][cuts[s] : cuts[s + 1]] for s in some] for c in CARRIED}

    cut = map_batches(stored.drop("sample"), f"segment int, size long, {lists}", exchange)
    sizes = {r["segment"]: r["n"] for r in cut.groupBy("segment").agg(F.sum("size").alias("n")).collect()}  # one number a segment
    before, offsets = 0, {}
    for segment in sorted(sizes):
        offsets[segment] = before
        before += sizes[segment]

    def merge(table: pa.Table) -> pa.Table:
        own = pa.table({c: table.column(c).combine_chunks().flatten() for c in CARRIED})
        order = order_of(sort_keys(own))
        first = offsets[table.column("segment")[0].as_py()] + 1
        out = own.drop_columns("row").take(pa.array(order))
        return out.append_column("rank", pa.array(np.arange(first, first + len(order)), pa.int64()))

    ship(rows.sparkSession)
    return cut.groupBy("segment").applyInArrow(merge, "doc_id long, n_features long, weight long, score long, rank long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED,
    samples: int = SAMPLES, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``; ``rank`` is null for rows that are not drawn.

    ``docs`` holds ``doc_id, text`` and ``target`` ``text``. Of the N rows with ``least_words`` words the best ``percent * N // 100`` are drawn.
    """
    gain = gains(counts(docs, buckets), counts(target, buckets))
    rows = save_and_read(scored(docs, gain, seed).withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    able = rows.where(F.col("n_words") >= least_words)
    draw = able.count() * percent // 100
    ranked = ranks(able, samples, segment_rows).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = rows.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def duckdb_sql() -> str:
    """The same rows from the definitions: features, crc32, gains and ranks of the tables ``documents`` and ``benchmark``."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
f AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
g AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
kinds AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM (SELECT f FROM f UNION ALL SELECT f FROM g)),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT),
    lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]), 4294967295)) % {BUCKETS} AS k FROM kinds, crc
), s AS (SELECT k, count(*) AS n FROM f JOIN hashed USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM g JOIN hashed USING (f) GROUP BY k),
gain AS (
  SELECT s.k, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + {BUCKETS})
    / ((s.n + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t ON s.k = t.k
), w AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN hashed USING (f) JOIN gain USING (k) GROUP BY r),
x AS (
  SELECT r, doc_id, len(w) AS words, ('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d
), y AS (
  SELECT doc_id, words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x LEFT JOIN w USING (r)
), z AS (
  SELECT *, row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY words >= {LEAST_WORDS}) AS n FROM y
) SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN words >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END::BIGINT AS rank FROM z
"""
