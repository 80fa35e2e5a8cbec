"""Importance resampling: brute force, ranks under ties, crc32 of words, odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logspark.llm import importance, textvec

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def grams(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, target, percent=25):
    corpus = Counter(bucket(f) for _, t in docs for f in grams(t))
    wanted = Counter(bucket(f) for t in target for f in grams(t))
    every, goal = sum(corpus.values()), sum(wanted.values())
    gain = lambda k: math.floor(1000 * math.log((wanted[k] + 1) * (every + 10_000) / ((corpus[k] + 1) * (goal + 10_000))))
    rows = []
    for i, text in docs:
        own = grams(text)
        weight = sum(gain(bucket(f)) for f in own) // max(len(own), 1)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in rows), key=repr)


def test_brute_force(spark, odd, nothing):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    target = [r["text"] for r in items.collect()]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    for df in (docs.repartition(5), odd):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        for sizes in ({}, {"samples": 3, "segment_rows": 7}):
            got = importance.resample(df, items.withColumn("doc_id", F.lit("clash")), **sizes).collect()
            assert sorted((tuple(r) for r in got), key=repr) == brute(rows, target)
    nobody = importance.resample(odd, items.where("false")).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in nobody), key=repr) == brute(rows, [])
    assert importance.resample(nothing, items).count() == 0


def test_ranks_with_ties(spark):
    """Most rows have one score and id; runs of any length, also empty ones, give the ranks of a plain sort."""
    rng = np.random.default_rng(4)
    rows = [(int(rng.choice([1, 1, 1, 2])) if k % 9 else None, 5, -3, int(rng.choice([7, 7, 7, 7, 8, -4])), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, row long")
    want = sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[4]))
    for parts, samples, size in ((1, 64, 100), (7, 5, 100), (7, 64, 10_000), (40, 2, 64)):
        got = sorted(importance.ranks(df.repartition(parts), samples, size).collect(), key=lambda r: r["rank"])
        assert [tuple(r) for r in got] == [(*w[:4], k + 1) for k, w in enumerate(want)]


def test_segments_are_even():
    """No segment holds more than twice its share, though a third of the rows are equal but for their row."""
    rng = np.random.default_rng(1)
    score, doc_id = rng.integers(0, 1000, 20_000), rng.integers(0, 1 << 40, 20_000)
    score[::3], doc_id[::3] = 500, 5
    table = pa.table({"doc_id": doc_id, "score": score, "row": np.arange(20_000)})
    keys = importance.sort_keys(table)
    runs = [keys[:, own][:, importance.order_of(keys[:, own])] for own in np.array_split(rng.permutation(20_000), 8)]
    samples = [(r.shape[1], r[:, np.linspace(0, r.shape[1] - 1, 64).astype(int)].T.ravel().tolist()) for r in runs]
    splitters = importance.regular_splitters(samples, 20)
    sizes = sum(np.diff([0, *importance.places(r, splitters), r.shape[1]]) for r in runs)
    assert len(sizes) == 20 and sizes.sum() == 20_000 and sizes.max() <= 2000
    few = importance.sort_keys(pa.table({"doc_id": pa.array([1, 1, None], pa.int64()), "score": [0, 0, 0], "row": [0, 0, 0]}))
    assert importance.places(few, [(0, 1, 0, 0), (0, importance.LAST, 1, 0)]) == [0, 2]


def test_crc_of_words_and_pairs():
    long = "z" * 500
    texts = ["Alpha beta, ß42 über", None, "", "x", f"one {long} two {long} {long}", "!!!", "字 é\x00a b-c " + "y" * 48 + " " + "y" * 49]
    for limit in (1, 40, 1 << 20):
        got = []
        for piece in textvec.pieces(pa.array(texts), limit):
            b, row, n = importance.features(piece)
            got += [(sorted(b[row == k].tolist()), int(n[k])) for k in range(piece.rows)]
        assert got == [(sorted(map(bucket, grams(t))), len(words(t))) for t in texts]
