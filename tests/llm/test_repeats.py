"""Long repeats: brute force over all strings, the two-stage sort against a plain one, hot keys, odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from logspark.llm import repeated_text as rt

SMALL = {"length": 24, "gram": 8, "chunk_bytes": 400, "range_keys": 64, "bucket_bytes": 700}


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()


def check(df, length=rt.LENGTH, **how):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = [tuple(r)[:5] for r in rt.repeated_text(df, length=length, **how).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, length), key=repr)


def made_up(seed):
    """Texts with shared passages, periodic parts, copies, and letters of several bytes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé字") for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(n)) for n in (8, 12, 30)] + ["ab" * 40, "x" * 90, "long line again\n" * 5]
    texts = [" ".join(rng.choice([word(), word(), word(), word(), rng.choice(passages)]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    return [(k, t) for k, t in enumerate(texts + texts[:5] + ["", None, "x" * 24, "y" * 24, "y" * 23])]


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rt, "SORTED_BYTES", 300)
    for seed in range(2):
        df = spark.createDataFrame(made_up(seed), "doc_id long, text string").repartition(3)
        check(df, **SMALL)
        check(df, **SMALL, hot=2)  # nearly every shared key counts as hot
    spans = {r["doc_id"]: r["spans"] for r in rt.repeated_text(df, **SMALL).collect()}
    assert spans[67] == [[0, 24]] and spans[68] == spans[69] == [] and all(b < e for s in spans.values() for b, e in s)


def test_query_size(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(250)
    check(docs)
    check(odd.filter("doc_id is null or doc_id not in (5, 11)"), hot=1)
    big = {r["doc_id"]: r for r in rt.repeated_text(odd).collect()}
    assert big[11]["n_removed"] == 300_000 and big[11]["n_spans"] == 1 and big[11]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rt.repeated_text(nothing).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_sort(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(97, 97 + (1, 2, 3, 20)[seed % 4], n).astype(np.uint8).tobytes() for n in rng.integers(1, 60, 40)]
    text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    for depth in (8, 20, 24):
        order, eight = rt.suffix_order(text, depth)
        assert sorted(order.tolist()) == list(range(len(text)))
        raw = text.tobytes()
        inside = [p for p in order.tolist() if 0 not in raw[p : p + depth] and p + depth < len(raw)]
        assert [raw[p : p + depth] for p in inside] == sorted(raw[p : p + depth] for p in inside)
        pairs = np.array(list(zip(inside, inside[1:], strict=False)), np.int64).reshape(-1, 2)
        assert rt.common(eight, pairs[:, 0], pairs[:, 1], depth).tolist() == [raw[a : a + depth] == raw[b : b + depth] for a, b in pairs]


def test_runs_share_keys():
    """Equal strings get equal keys, whatever surrounds them, and every start is in one run."""
    rows = [(t or "").encode() for _, t in made_up(9)]
    data = np.frombuffer(b"".join(rows), np.uint8)
    offsets = np.cumsum([0] + [len(r) for r in rows])
    first, n, key, twin = rt.runs(data, offsets, 24, 8)
    keys, raw = {}, data.tobytes()
    starts = []
    for f, size, k, own in zip(first.tolist(), n.tolist(), key.tolist(), twin.tolist(), strict=True):
        strings = [raw[p : p + 24] for p in range(f, f + size)]
        assert own or len(set(strings)) == size
        starts += range(f, f + size)
        for s in strings:
            assert keys.setdefault(s, k) == k
    assert starts == [p for a, b in zip(offsets, offsets[1:], strict=False) for p in range(a, b - 23)]
