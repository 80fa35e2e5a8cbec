"""Plain numpy versions of whole results: the discriminant, alignments of every document with every item, rows with the same id."""

import numpy as np
import pyarrow as pa
import pytest

from logspark.llm import decontaminate, quality_qda, queries

SF = "/root/testdata/sf0.01"


def test_discriminant_plain_numpy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op2_quality_discriminant(spark, SF).collect()}
    x = quality_qda.statistics(pa.array([r["text"] for r in docs]))
    y = np.array([labels.get(r["doc_id"], -1) if not got[r["doc_id"]]["held_out"] else -1 for r in docs])
    known = y >= 0
    z = (x - x[known].mean(0)) / np.maximum(x[known].std(0), 1e-3)
    logs = []
    for k in (0, 1):
        own = z[y == k]
        cov = np.cov(own.T, bias=True)
        cov = (1 - quality_qda.SHRINKAGE) * cov + quality_qda.SHRINKAGE * np.trace(cov) / len(cov) * np.eye(len(cov))
        d = z - own.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = np.clip(logs[1] - logs[0], -quality_qda.LIMIT, quality_qda.LIMIT)
    mine = np.array([got[r["doc_id"]]["evidence"] for r in docs])
    assert np.allclose(mine, want, atol=1e-6)
    order = np.argsort(want)
    scores = np.array([got[r["doc_id"]]["score"] for r in docs])[order]
    assert (np.diff(scores) >= -1e-9).all()  # the curve keeps the order
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_kept_rows_are_those_scored_high(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality_qda.keep_good(docs, labels, queries.quality_held_out)
    assert kept.schema == docs.schema
    good = {r["doc_id"] for r in queries.op2_quality_discriminant(spark, SF).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good


def test_every_document_against_every_item(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(docs, items).collect()}
    cut = lambda text: next(iter(decontaminate.tokens(pa.array([text or ""])))).hashes
    item = {r["item_id"]: cut(r["text"]) for r in items.collect()}
    for r in docs.select("doc_id", "text").collect():
        words = cut(r["text"])
        for i, own in item.items():
            full = decontaminate.align(own, words)[0] / (decontaminate.MATCH * len(own))
            if full >= decontaminate.SIMILARITY:
                assert got[(r["doc_id"], i)] == pytest.approx(full)
            elif (r["doc_id"], i) in got:
                assert got[(r["doc_id"], i)] <= full + 1e-9  # by evidence of rare words


def test_a_row_for_each_leaking_row(spark):
    text = " ".join(f"rare{k}" for k in range(40))
    items = spark.createDataFrame([(1, text, "clash"), (1, "other words of the same item", "clash"), (None, text + " more", "clash")], "item_id long, text string, score string")
    docs = spark.createDataFrame([(None, text), (None, text), (7, text), (7, text), (7, "clean words"), (8, None), (9, text + " gap " * 50 + text)], "doc_id long, text string")
    got = decontaminate.matches(docs, items).where("item_id = 1").collect()
    assert sorted((r["doc_id"] or 0 for r in got)) == [0, 0, 7, 7, 9] and all(r["similarity"] == 1.0 and r["begin_word"] == 0 for r in got)
    assert sorted(r["text"] or "" for r in decontaminate.keep_clean(docs, items).collect()) == ["", "clean words"]
    blocks = decontaminate.matches(docs, items, block_words=20).collect()
    assert len(blocks) == 10 and decontaminate.keep_clean(docs, items, block_words=20).count() == 2
