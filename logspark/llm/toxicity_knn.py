"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

1. Examples are a bounded sample of the labelled rows: up to ``EXAMPLES`` of each class, the least by a hash of the id.
2. Terms are five-byte pieces of words (lower case, with the word's border) and longer beginnings of words, hashed. The index keeps the ``TERMS`` terms that examples labelled
   toxic have significantly more often (likelihood-ratio statistic).
3. Every whole text gives its counts of these terms; document frequencies are counted over all documents.
4. Examples are indexed by term. Postings come in blocks of neighbouring examples with the largest weight of each term; blocks are
   searched by falling upper bound until none can hold a nearer example, so the nearest examples are exact, ties by id.
5. The examples' votes, weighted by closeness, are mapped to scores by the monotone curve that fits the examples' own votes (each
   without itself), and come with the nearest examples as evidence.

Defined results: null, empty and all other texts without any of the terms have no neighbours and get the examples' share of toxic
rows among those without neighbours. Repeated rows are scored one by one; a label given twice counts once, the greatest. Without
examples of both classes every score is 0 (no toxic example) or 1 (no other). An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import textvec
from logspark.llm.common import map_batches, map_partitions, save_and_read
from logspark.llm.near_dedup import shingle_sets

#: Bound of the sample: labelled rows used of each class (0, 1).
EXAMPLES = (8000, 4000)
TERMS = 2048
#: Least likelihood-ratio statistic of a term.
SIGNIFICANCE = 20.0
#: Least ratio of a term's smoothed shares among toxic and other examples.
RATIO = 10
NEIGHBOURS = 16
#: Closeness that counts against toxic in every vote, so that far neighbours decide little.
DOUBT = 5.0
BLOCK = 64
HASH_BITS = 20
#: Bytes of the beginnings of words that are terms.
BEGINNINGS = (5, 6, 7, 8)
THRESHOLD = 0.7

_fold = np.arange(256, dtype=np.uint8)
_fold[[b for b in range(128) if not chr(b).isalnum()]] = 32
_fold[65:91] += 32


def terms(piece: textvec.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of all texts of a piece, and the row of each."""
    data = _fold[piece.data]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    second = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    data[1:][second] += 0x20
    row = np.repeat(np.arange(piece.rows), np.diff(piece.offsets))
    word = data != 32
    inside = word[:-2] & word[1:-1] & word[2:] & (row[:-2] == row[2:])
    at = np.flatnonzero(inside)
    before = np.where((at > 0) & (row[at] == row[at - 1]), data[at - 1], 32).astype(np.uint64)
    last = np.minimum(at + 3, len(data) - 1)
    after = np.where((at + 3 < len(data)) & (row[at] == row[last]), data[last], 32).astype(np.uint64)
    gram = before
    for part in (data[at], data[at + 1], data[at + 2], after):
        gram = gram << np.uint64(8) | part.astype(np.uint64)
    found, rows = [gram], [row[at]]
    start = np.flatnonzero(word & np.concatenate([[True], ~word[:-1] | (row[1:] != row[:-1])]))
    for size in BEGINNINGS:
        start = start[start + size <= len(data)]
        whole = np.all([word[start + k] & (row[start + k] == row[start]) for k in range(size)], axis=0) if len(start) else np.zeros(0, bool)
        start = start[whole]
        gram = np.full(len(start), np.uint64(size))
        for k in range(size):
            gram = gram * textvec.BASE + data[start + k].astype(np.uint64)
        found.append(textvec.mix(gram))
        rows.append(row[start])
    return (textvec.mix(np.concatenate(found)) >> np.uint64(64 - HASH_BITS)).astype(np.int64), np.concatenate(rows)


def counted(column: pa.Array, number: np.ndarray | None = None, size: int = 1 << HASH_BITS):
    """Per text the distinct terms and how often each occurs; ``number`` gives the number of a kept term, -1 for others."""
    for piece in textvec.pieces(column):
        term, row = terms(piece)
        if number is not None:
            term = number[term]
            row, term = row[term >= 0], term[term >= 0]
        key, n = np.unique(row * size + term, return_counts=True)
        at = np.searchsorted(key, np.arange(piece.rows + 1) * size)
        for r in range(piece.rows):
            own = slice(at[r], at[r + 1])
            yield key[own] - r * size, n[own]


@dataclass
class Index:
    """Unit vectors of the examples by term, in blocks of :data:`BLOCK` neighbouring examples."""

    ids: np.ndarray
    label: np.ndarray
    idf: np.ndarray
    #: postings of term ``t`` are ``begin[t]`` to ``begin[t + 1]``, ordered by example
    begin: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    #: per term and block of examples the largest weight
    top: np.ndarray
    edges: np.ndarray | None = None
    levels: np.ndarray | None = None
    alone: float = 0.0

    def vector(self, term: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1 + np.log(n)) * self.idf[term]
        return v / max(np.sqrt((v * v).sum()), 1e-12)

    def nearest(self, term: np.ndarray, n: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of greatest cosine above 0, nearest first, ties by place; ``without`` leaves one out."""
        if not len(term):
            return np.zeros(0, np.int64), np.zeros(0)
        q = self.vector(term, n)
        bound = (q[:, None] * self.top[term]).sum(0)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, score, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        step, at = 4, 0
        while at < len(order):
            chosen = order[at : at + step]
            chosen = chosen[bound[chosen] >= least - 1e-9]
            if not len(chosen):
                break
            wanted = np.zeros(self.top.shape[1], bool)
            wanted[chosen] = True
            total = np.zeros(len(self.ids))
            for t, w in zip(term, q, strict=True):
                own = slice(self.begin[t], self.begin[t + 1])
                example = self.example[own]
                keep = wanted[example // BLOCK]
                total[example[keep]] += w * self.weight[own][keep]
            found = np.flatnonzero(total > 0)
            found = found[found != without]
            best, score = np.concatenate([best, found]), np.concatenate([score, total[found]])
            first = np.lexsort((best, -np.round(score, 9)))[:k]
            best, score = best[first], score[first]
            least = score[-1] if len(best) == k else 0.0
            at, step = at + step, step * 4
        return best, score

    def vote(self, best: np.ndarray, score: np.ndarray) -> float:
        """Share of toxic among the neighbours, the nearer the weightier, against a fixed doubt; -1 without neighbours."""
        return float((score * self.label[best]).sum() / (score.sum() + DOUBT)) if len(best) else -1.0

    def calibrated(self, vote: np.ndarray) -> np.ndarray:
        level = self.levels[np.clip(np.searchsorted(self.edges, vote, "right") - 1, 0, len(self.levels) - 1)]
        return np.where(vote < 0, self.alone, level)


def examples(labels: DataFrame, held_out, sizes: tuple[int, int] = EXAMPLES) -> DataFrame:
    """``doc_id, label`` of at most ``sizes`` rows of each class."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out(F.col("doc_id")))
    first = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sizes[k]) for k in (0, 1)]
    return first[0].unionByName(first[1])


def select_terms(vectors: DataFrame) -> np.ndarray:
    """The chosen term hashes, from ``label, term`` (distinct terms of each example)."""

    def count(batches):
        n = np.zeros((2, 1 << HASH_BITS), np.int64)
        for batch in batches:
            label = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
            term = batch.column(1).flatten().to_numpy()
            for k in (0, 1):
                n[k] += np.bincount(term[label == k], minlength=1 << HASH_BITS)
        some = np.flatnonzero(n.sum(0))
        yield {"term": some, "n0": n[0][some], "n1": n[1][some]}

    size = {r["label"]: r["n"] for r in vectors.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = (float(size.get(k, 0)) for k in (0, 1))
    both = map_partitions(vectors.select("label", "term"), "term long, n0 long, n1 long", count).groupBy("term").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    part = lambda x, of: F.when(x > 0, x * F.log(x / of)).otherwise(0.0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / (n0 + n1)
    gain = 2 * (part(a, share * n0) + part(b, share * n1) + part(n0 - a, (1 - share) * n0) + part(n1 - b, (1 - share) * n1))
    chosen = both.withColumn("gain", gain).where(((b + 0.5) / n1 >= RATIO * (a + 0.5) / n0) & (F.col("gain") >= SIGNIFICANCE))
    return np.array(sorted(r["term"] for r in chosen.orderBy(F.desc("gain"), "term").limit(TERMS).collect()), np.int64)


def build(rows: list, frequency: np.ndarray, documents: int) -> Index:
    """An index of example ``rows`` (``doc_id, label, term, n``)."""
    idf = np.log((documents + 1) / (frequency + 1)) + 1
    rows = sorted(rows, key=lambda r: (r["label"], r["term"][int(np.argmax(idf[r["term"]]))] if r["term"] else -1, r["doc_id"]))
    index = Index(np.array([r["doc_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], float), idf, *[np.zeros(0)] * 4)
    term, example, weight = [], [], []
    for i, r in enumerate(rows):
        if r["term"]:
            t = np.array(r["term"])
            term.append(t)
            example.append(np.full(len(t), i))
            weight.append(index.vector(t, np.array(r["n"])))
    term, example, weight = (np.concatenate(x) if x else np.zeros(0, int) for x in (term, example, weight))
    order = np.lexsort((example, term))
    index.example, index.weight = example[order].astype(np.int32), weight[order].astype(float)
    index.begin = np.searchsorted(term[order], np.arange(len(idf) + 1))
    index.top = np.zeros((len(idf), -(-max(len(rows), 1) // BLOCK)))
    np.maximum.at(index.top, (term, example // BLOCK), weight)
    return index


def monotone(vote: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges and levels of the rising step curve of least squares (pool adjacent violators), each level drawn a little to 1/2."""
    at, inverse = np.unique(np.round(vote, 2), return_inverse=True)
    blocks: list[list[float]] = []
    for k, x in enumerate(at):
        own = label[inverse == k]
        blocks.append([x, own.sum(), len(own)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, s, n = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += n
    return np.array([b[0] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """``doc_id, held_out, score, predicted, neighbours, closeness`` for every row of ``docs`` (``doc_id``, ``text``).

    ``labels`` holds ``doc_id, toxic``; rows for which ``held_out`` (a function of the id column) is true are not learned from.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    chosen = save_and_read(examples(labels, held_out), "toxic-examples")

    def vectors(batch: pa.RecordBatch):
        term = [t for t, _ in counted(batch.column("text"))]
        kin = [int(own[:1].view(np.int64)[0]) if len(own) else 0 for own in shingle_sets(batch.column("text"))]
        yield {"label": batch.column("label"), "kin": kin, "term": term}

    # the sample is bounded by EXAMPLES, so its ids may be sent to all tasks
    sampled = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    seen = save_and_read(map_batches(sampled, "label int, kin long, term array<int>", vectors), "toxic-sample")
    classes = [r["label"] for r in chosen.select("label").distinct().collect()]
    # copies share their least shingle as a rule; one of them counts when terms are chosen
    kept = select_terms(seen.dropDuplicates(["label", "kin"])) if len(classes) == 2 else np.zeros(0, np.int64)
    number = np.full(1 << HASH_BITS, -1, np.int64)
    number[kept] = np.arange(len(kept))
    sent = spark.sparkContext.broadcast(number.astype(np.int16))

    def measure(batch: pa.RecordBatch):
        both = list(counted(batch.column(1), sent.value.astype(np.int64), TERMS))
        yield {"doc_id": batch.column(0), "term": [t for t, _ in both], "n": [n for _, n in both]}

    rows = save_and_read(map_batches(texts, "doc_id long, term array<int>, n array<int>", measure), "toxic-terms")
    counts = rows.select(F.explode("term").alias("term")).groupBy("term").count().collect()  # at most TERMS rows
    frequency = np.zeros(len(kept))
    for r in counts:
        frequency[r["term"]] = r["count"]
    own = rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).collect()  # bounded by EXAMPLES
    index = build(own, frequency, rows.count())
    index.edges, index.levels, index.alone = np.array([0.0]), np.array([0.5]), 1.0 if classes == [1] else 0.0
    model = spark.sparkContext.broadcast(index)
    if len(own):
        place = {int(i): p for p, i in enumerate(index.ids)}

        def own_votes(batch: pa.RecordBatch):
            x, votes = model.value, []
            for i, term, n in zip(*(batch.column(c).to_pylist() for c in ("place", "term", "n")), strict=True):
                votes.append(x.vote(*x.nearest(np.array(term, int), np.array(n, int), k, i)))
            yield {"label": batch.column("label"), "vote": votes}

        table = spark.createDataFrame(
            [(place[r["doc_id"]], r["label"], r["term"], r["n"]) for r in own], "place long, label int, term array<int>, n array<int>"
        ).repartition(spark.sparkContext.defaultParallelism)
        votes = map_batches(table, "label int, vote double", own_votes).toPandas()
        near = votes[votes.vote >= 0]
        if len(near):
            index.edges, index.levels = monotone(near.vote.to_numpy(), near.label.to_numpy())
        rest = votes[votes.vote < 0]
        if len(classes) == 2:
            index.alone = float((rest.label.sum() + 0.5) / (len(rest) + 10))
        model = spark.sparkContext.broadcast(index)

    def score(batch: pa.RecordBatch):
        x, votes, ids, near = model.value, [], [], []
        term, n = (batch.column(c) for c in ("term", "n"))
        for t, c in zip(term, n, strict=True):
            best, closeness = x.nearest(t.values.to_numpy().astype(int), c.values.to_numpy().astype(int), k) if len(t) else (np.zeros(0, int), np.zeros(0))
            votes.append(x.vote(best, closeness))
            ids.append(x.ids[best][:3])
            near.append(closeness[:3])
        yield {"doc_id": batch.column("doc_id"), "score": x.calibrated(np.array(votes)), "neighbours": ids, "closeness": near}

    out = map_batches(rows, "doc_id long, score double, neighbours array<long>, closeness array<double>", score)
    return out.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours", "closeness",
    )
