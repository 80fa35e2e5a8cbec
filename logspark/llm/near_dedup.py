"""Near duplicates by circulant MinHash, banding, exact Jaccard verification and components.

Two permutations make the whole signature: the first scatters shingle hashes over a fixed universe, the second
ranks its cells, and coordinate ``k`` is the least rank after shifting the second permutation ``k`` cells round.

Steps, all of them joins and aggregations over band keys:

1. Rows with equal shingle sets form a class, known by its least ``doc_id``; only classes are compared further.
2. Every class with a bucket mate is paired with the least class of each of its buckets and verified on full sets:
   a row per membership, however large the bucket.
3. Verified links give components. Inside a bucket whose members are of one component nothing is left to find. In the
   other buckets, classes of different components are paired and verified, in passes: where more than ``FEW`` pairs a
   member are possible, a pass takes a forest of the most similar ones, and components grow before the next pass counts
   what is left. In the first pass a bucket of many blocks meets inside blocks only. No pair is left out: the last pass has all that remain.

Pairs are verified only if a link is possible at all. Each set also has a map of bits, one for each cell that a shingle
falls in: a bit of one set that the other lacks is a shingle that they do not share, so the intersection is bounded
exactly from above, inside the join and without the texts.

Defined results: null and empty texts have no shingles, are linked with nothing and kept. A text with fewer words than a
shingle is one shingle as a whole. Rows repeating a ``doc_id`` get their own result from their own text. Rows without
``doc_id`` take the component of equal texts (null if none has an id) and are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import textvec
from logspark.llm.common import flag_among, map_batches, save_and_read

SHINGLE = 5
#: Links need intersection / union >= PERCENT / 100.
PERCENT = 85
#: A pair at similarity 0.85 misses all bands with probability (1 - 0.85**6)**32, below 3e-7.
BANDS, ROWS = 32, 6
#: Cells of the universe that the two permutations act on.
UNIVERSE = 1 << 20
#: 64-bit words of the map of cells.
MAP_WORDS = 32
#: Members of a bucket that meet at once; a larger bucket is cut into blocks, and blocks meet in pairs.
BLOCK = 256
#: Possible pairs a member up to which a meeting of blocks hands out all of them.
FEW = 4
#: Blocks up to which those of a bucket meet in the first pass.
NEAR_BLOCKS = 2


@cache
def ranks(seed: int, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second one as rows of ``coordinates`` neighbouring cells round the circle."""
    rng = np.random.default_rng(seed)
    first = rng.permutation(UNIVERSE).astype(np.int32)
    second = rng.permutation(UNIVERSE).astype(np.int32)
    circle = np.concatenate([second, second[: coordinates - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(circle, coordinates)


def signature(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = 17) -> np.ndarray:
    """Circulant MinHash of a non-empty set of 64-bit hashes: ``bands * rows`` coordinates."""
    first, second = ranks(seed, bands * rows)
    cells = np.unique(first[(shingles >> np.uint64(44)).astype(np.int64)])
    out = np.full(bands * rows, UNIVERSE, np.int32)
    for at in range(0, len(cells), 4096):
        np.minimum(out, second[cells[at : at + 4096]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.arange(bands, dtype=np.uint64) * np.uint64(0x51ED2701A9B4D3F1)
    for column in sig.reshape(bands, rows).T:
        key = textvec.mix(key * textvec.BASE ^ column.astype(np.uint64))
    return key.view(np.int64)


def cell_map(shingles: np.ndarray) -> np.ndarray:
    """One bit for each of ``64 * MAP_WORDS`` cells that holds a shingle."""
    bits = np.zeros(64 * MAP_WORDS, np.uint8)
    bits[(shingles % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """The distinct shingles of each text, as sorted hashes."""
    for piece in textvec.pieces(column):
        piece.words()
        grams, first = piece.grams(size)
        at = np.searchsorted(first, piece.at)
        for row in range(piece.rows):
            own = grams[at[row] : at[row + 1]]
            words = piece.hashes[piece.at[row] : piece.at[row + 1]]
            if not len(own) and len(words):
                own = textvec.combine(words, len(words))
            yield np.unique(own)


def overlap(left: np.ndarray, right: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(left) > len(right):
        left, right = right, left
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    return int((right[at] == left).sum()) if len(right) else 0


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, band, cells`` of every row; two sums tell sets apart; without shingles the rest is null."""

    def sketch(batch: pa.RecordBatch):
        sizes, a, b, keys, cells = [], [], [], [], []
        for own in shingle_sets(batch.column(1)):
            sizes.append(len(own))
            a.append(int(own.sum(dtype=np.uint64).view(np.int64)) if len(own) else None)
            b.append(int(textvec.mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if len(own) else None)
            keys.append(band_keys(signature(own, bands, rows), bands, rows) if len(own) else None)
            cells.append(cell_map(own) if len(own) else None)
        yield {"doc_id": batch.column(0), "n_shingles": sizes, "set_a": a, "set_b": b, "band": keys, "cells": cells}

    schema = "doc_id long, n_shingles long, set_a long, set_b long, band array<long>, cells array<long>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), schema, sketch)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (``a``, ``b``) with ``n_a``, ``n_b``, ``shared``: set sizes and intersection on full sets. Only texts of pairs are moved."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = flag_among(texts, "doc_id", ids, "paired").where("paired").drop("paired")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def count(batch: pa.RecordBatch):
        b, text = batch.column(1).to_numpy(), batch.column(3)
        new = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        pivots = shingle_sets(text.take(pa.array(new)))
        begins, pivot, out = set(new.tolist()), None, ([], [], [])
        for i, own in enumerate(shingle_sets(batch.column(2))):
            if i in begins:
                pivot = next(pivots)
            for values, x in zip(out, (len(own), len(pivot), overlap(own, pivot)), strict=True):
                values.append(x)
        yield {"a": batch.column(0), "b": batch.column(1), "n_a": out[0], "n_b": out[1], "shared": out[2]}

    return map_batches(both, "a long, b long, n_a long, n_b long, shared long", count)


def linked(percent: int) -> F.Column:
    return 100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` (the least reachable node) of every node of ``links`` (``a``, ``b``), by alternating stars.

    Each round replaces links by links to the least neighbour, first of the larger neighbours, then of the smaller
    ones; nothing but a minimum is kept per node, so a node may have any number of links.
    """
    current = save_and_read(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-links"
    )
    before = None
    while True:
        sides = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        current = save_and_read(small, f"{name}-round")
        state = current.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.count_distinct("a")).first()
        if state == before or state[0] == 0:
            break
        before = state
    tops = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id``, ``text``); see the module's text."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    found = save_and_read(sketches(docs, bands, rows), "near-sketches")
    first_of = F.first(F.struct("band", "cells")).alias("x")
    classes = found.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), first_of)
    classes = save_and_read(classes.select("set_a", "set_b", "n_shingles", "rep", "x.*"), "near-classes")
    members = classes.where("rep is not null").select("rep", F.col("n_shingles").alias("n"), "cells", F.explode("band").alias("key"))
    shared = members.drop("cells").groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    buckets = save_and_read(members.drop("cells").join(shared, "key").select("key", "rep", "pivot"), "near-buckets")
    sketch = classes.select("rep", F.col("n_shingles").alias("n"), "cells")
    tested = save_and_read(star(buckets, sketch, percent), "near-star")
    links = verify(tested, texts).where(linked(percent)).select("a", "b").distinct()
    links = save_and_read(links, "near-links")
    first = components(links, "near-first")

    final, across, whole, before = first, False, False, None
    while True:
        more = save_and_read(rest(buckets, sketch, final, percent, across, whole), "near-rest")
        extra = save_and_read(verify(more.where("a is not null"), texts).where(linked(percent)).select("a", "b").distinct(), "near-extra")
        if grown := not extra.isEmpty():
            links = links.unionByName(extra)
            final = components(links, "near-final")
        left, given = more.agg(F.sum("omitted"), F.count("a")).first()
        if not left:
            break
        # All pairs follow where few were put off, or a forest has joined little.
        whole = left <= given or across and (not grown or before is not None and 2 * left > before)
        before = left if across else None
        across = True

    named = classes.join(final, F.col("rep") == F.col("node"), "left").select(
        "set_a", "set_b", F.coalesce("component", "rep").alias("component")
    )
    out = found.drop("band", "cells").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def common(n: np.ndarray, cells: np.ndarray, n_r: np.ndarray, cells_r: np.ndarray) -> np.ndarray:
    """Upper bound of the intersection, by size and by the cells that only one of the two sets has; arrays broadcast."""
    alone = np.bitwise_count(cells & ~cells_r).sum(-1, dtype=np.int64)
    alone_r = np.bitwise_count(cells_r & ~cells).sum(-1, dtype=np.int64)
    return np.minimum(n - alone, n_r - alone_r)


def possible(n: np.ndarray, cells: np.ndarray, n_r: np.ndarray, cells_r: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets can be linked."""
    most = common(n, cells, n_r, cells_r)
    return 100 * most >= percent * (n + n_r - most)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of cell maps as an array with a row for each."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), MAP_WORDS)


def star(buckets: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of the members of buckets and the least class of each, where a link is possible."""
    pivots = sketch.select(F.col("rep").alias("pivot"), F.col("n").alias("n_r"), F.col("cells").alias("cells_r"))
    pairs = buckets.where("rep <> pivot").select("rep", "pivot").distinct().join(sketch, "rep").join(pivots, "pivot")

    def keep(batch: pa.RecordBatch):
        n, n_r = (batch.column(c).to_numpy() for c in ("n", "n_r"))
        good = pa.array(possible(n, matrix(batch.column("cells")), n_r, matrix(batch.column("cells_r")), percent))
        yield {"a": batch.column("rep").filter(good), "b": batch.column("pivot").filter(good)}

    return map_batches(pairs, "a long, b long", keep)


def forest(u: np.ndarray, v: np.ndarray, order: np.ndarray) -> list[int]:
    """Edges ``u, v`` of a spanning forest, taken in ``order``."""
    top = {x: x for x in np.union1d(u, v).tolist()}
    u, v, out = u.tolist(), v.tolist(), []

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for k in order.tolist():
        x, y = find(u[k]), find(v[k])
        if x != y:
            top[x] = y
            out.append(k)
    return out


def rest(buckets: DataFrame, sketch: DataFrame, found: DataFrame, percent: int, across: bool = True, whole: bool = False) -> DataFrame:
    """Pairs ``a, b`` of bucket mates in different components where a link is possible; the star's pairs are left out.

    Without ``whole``, meetings with many such pairs give a forest over components, and without ``across`` only members of
    one block meet in buckets of over ``NEAR_BLOCKS`` blocks; ``omitted`` of the row without ``a`` is then more than 0 if anything was put off.
    """
    placed = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    size = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    mixed = size.where("low < high").select("key", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    members = placed.where("rep <> pivot").drop("pivot").join(mixed, "key").join(sketch, "rep")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block")
    blocks = members.groupBy("key", "blocks", block).agg(F.collect_list(F.struct("rep", "n", "component", "cells")).alias("of"))
    blocks = save_and_read(blocks, "near-blocks")
    right = blocks.select("key", F.col("block").alias("block_r"), F.col("of").alias("of_r"))
    alone = F.lit(not across) & (F.col("blocks") > NEAR_BLOCKS)
    meetings = blocks.join(right, "key").where((F.col("block") == F.col("block_r")) | (F.col("block") < F.col("block_r")) & ~alone)
    meetings = meetings.select("of", "of_r", (alone & (F.col("block") > 0)).cast("int").alias("skipped"))

    def fields(column: pa.Array, row: int):
        part = column[row].values
        return [part.field(k).to_numpy(zero_copy_only=False) for k in range(3)] + [matrix(part.field(3))]

    def meet(batch: pa.RecordBatch):
        for row in range(batch.num_rows):
            rep, n, own, cells = fields(batch.column(0), row)
            rep_r, n_r, own_r, cells_r = fields(batch.column(1), row)
            same, pairs = np.array_equal(rep, rep_r), []
            for at in range(0, len(rep), 32):
                cut = slice(at, at + 32)
                sized = percent * np.maximum.outer(n[cut], n_r) <= 100 * np.minimum.outer(n[cut], n_r)
                apart = rep[cut, None] > rep_r if same else rep[cut, None] != rep_r
                i, j = np.nonzero((own[cut, None] != own_r) & apart & sized)
                most = common(n[cut][i], cells[cut][i], n_r[j], cells_r[j])
                good = 100 * most >= percent * (n[cut][i] + n_r[j] - most)
                pairs.append((i[good] + at, j[good], most[good]))
            i, j, most = (np.concatenate(x) for x in zip(*pairs, strict=True))
            omitted = batch.column(2)[row].as_py()
            if not whole and len(i) > FEW * (len(rep) if same else len(rep) + len(rep_r)):
                few = forest(own[i], own_r[j], np.lexsort((rep_r[j], rep[i], -most / (n[i] + n_r[j] - most))))
                omitted += len(i) - len(few)
                i, j = i[few], j[few]
            yield {"a": np.maximum(rep[i], rep_r[j]), "b": np.minimum(rep[i], rep_r[j]), "omitted": np.zeros(len(i), np.int64)}
            if omitted:
                yield {"a": [None], "b": [None], "omitted": [omitted]}

    return map_batches(meetings, "a long, b long, omitted long", meet).groupBy("a", "b").agg(F.sum("omitted").alias("omitted"))
