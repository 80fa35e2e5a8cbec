"""Long repeats across all documents, by suffix arrays built in two stages.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else. Sorting every suffix of the corpus would shuffle it many times over, so
only text that can repeat is sorted:

1. ``chunks``: documents in chunks of a few megabytes, compressed. Each start of a ``LENGTH``-byte string gets a key, the least hash of the shorter strings
   (``GRAM`` bytes) inside it, which equal strings share. Neighbouring starts with one key form a run: about one for 50 bytes.
2. ``shared``: the distinct keys of every chunk, cut by ranges of the key, meet and come back as a code: held by one run, by more, or by very many.
3. ``contexts``: runs with a shared key send their text (the starts and ``LENGTH`` bytes on) to a bucket of the key, each different text once a chunk. Equal strings
   therefore meet in one bucket.
4. ``repeats``: copies of a text count once. A bucket's different texts are joined and their suffixes sorted in two stages: suffixes smaller than their successors are
   sorted directly, the others are induced by scanning the buckets of first bytes; common prefixes of adjacent suffixes then tell which strings occur twice.
   Texts are left out only if each text under their key is known to occur twice as a whole, as then all their strings do.
5. ``removed``: a chunk's starts that repeat cover the bytes that go; the rest is hashed.

Hot keys: a key of over ``HOT`` runs (a passage that very many documents share, in different surroundings) would make one bucket large. Starts of such runs
send a hash of 128 bits of their own string instead, to ranges of the hash, and those whose hash another start has repeat: chance equality is out of
question at any size of corpus. No run, bucket or document is capped.

Step 2 sends a few bytes a run and step 3 repeated text only. Chunks meet their codes by a join on the chunk, which Spark turns into a broadcast only
while its own size check allows. What a task holds is a chunk, a range of keys or a bucket, all of bounded size but for a single text longer than a chunk.

Defined results: null and empty texts have no bytes and nothing is removed. Repeated rows and rows without ``doc_id`` are documents of their own, so equal ones remove
each other from the length on. Texts shorter than the length lose nothing. An empty table gives an empty result; columns but ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import textvec
from logspark.llm.backoff_lm import cut, pack_sorted, packed, unpack_sorted, unpacked
from logspark.llm.common import map_batches, save_and_read
from logspark.session import ship

LENGTH, GRAM = 200, 100
#: Most starts of a run; a longer one (repetitive text) is cut.
RUN = 128
CHUNK_BYTES = 2 << 20
RANGE_KEYS = 1 << 22
BUCKET_BYTES = 3 << 20
HOT = 1 << 12
#: Bytes of texts, about, whose suffixes are sorted together; texts of one key stay together.
SORTED_BYTES = 1 << 20
KEY_BITS = 48
#: Other values for the bytes of a text, for the second half of a hash.
SCRAMBLED = (textvec.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(1)) | np.uint64(1)


def squeezed(data: bytes) -> bytes:
    """``data`` compressed, with its length before it."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def released(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of every string of ``n`` bytes."""
    up, down = textvec.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    out = (total[n:] - total[:-n]) * down[: len(data) - n + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def fold(values: np.ndarray, width: int, best) -> np.ndarray:
    """The ``best`` (``np.minimum`` or ``np.maximum``) of each ``width`` consecutive values."""
    span, out = 1, values
    while 2 * span <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts and key of every run of a chunk, and whether it may repeat itself; runs stay inside a text."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    h, width = rolling(data, gram), length - gram + 1
    m = fold(h, width, np.minimum)
    edge = np.ones(len(m), bool)
    edge[1:] = m[1:] != m[:-1]
    edge[offsets[:-1][offsets[:-1] < len(m)]] = True
    first = np.flatnonzero(edge)
    row = np.searchsorted(offsets, first, "right") - 1
    stop = np.minimum(np.append(first[1:], len(m)), offsets[row + 1] - length + 1)
    good = stop > first
    first, stop = first[good], stop[good]
    # A run holds a string twice only if its least gram occurs twice in it. Those are neighbours among the places of least grams: a gram
    # between them is not least in any window, as each window that it lies in reaches one of the two.
    bound = np.zeros(len(m) + 2 * (width - 1), np.uint64)
    bound[width - 1 : width - 1 + len(m)] = m
    place = np.flatnonzero(h == fold(bound, width, np.maximum))
    pairs = np.append(0, np.cumsum(h[place[1:]] == h[place[:-1]]))
    low, high = np.searchsorted(place, first), np.searchsorted(place, stop + width - 1) - 1
    twin = (high > low) & (pairs[high] > pairs[np.minimum(low, len(pairs) - 1)])
    size = stop - first
    parts = -(-size // RUN)
    before = np.repeat(np.cumsum(parts) - parts, parts)
    step = (np.arange(len(before)) - before) * RUN
    first, size = np.repeat(first, parts) + step, np.minimum(np.repeat(size, parts) - step, RUN)
    return first, size, textvec.mix(m[first]) >> np.uint64(64 - KEY_BITS), np.repeat(twin, parts)


def chunks(docs: DataFrame, length: int, gram: int, chunk_bytes: int) -> DataFrame:
    """``doc_id, size`` (arrays), ``text`` (all bytes) and the runs: ``first``, ``n``, ``key``, ``twin``."""

    def cut_up(batch: pa.RecordBatch):
        ids = batch.column(0)
        for piece in textvec.pieces(batch.column(1), chunk_bytes):
            first, n, key, twin = runs(piece.data, piece.offsets, length, gram)
            yield {
                "doc_id": [ids[piece.first : piece.first + piece.rows].to_pylist()], "size": [np.diff(piece.offsets)], "text": [squeezed(piece.data.tobytes())],
                "first": [squeezed(pack_sorted(first.astype(np.uint64)))], "n": [squeezed(packed(n))], "key": [packed(key)], "twin": [squeezed(np.packbits(twin).tobytes())],
            }

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id array<long>, size array<long>, text binary, first binary, n binary, key binary, twin binary", cut_up)


def shared(keys: DataFrame, bits: int, hot: int) -> DataFrame:
    """``chunk, code, more, hottest`` from ``chunk, key, twin`` (packed): for a chunk's sorted distinct keys in turn 0 (one holder in the corpus), 1 (more) or 2 (over ``hot``).

    The first ``bits`` of the keys make the ranges that meet. ``more`` counts keys of code 1, ``hottest`` runs of code 2.
    """

    def send(batch: pa.RecordBatch):
        for chunk, blob, twin in zip(*(batch.column(c).to_pylist() for c in ("chunk", "key", "twin")), strict=True):
            own = unpacked(blob)
            distinct, number = np.unique(own, return_inverse=True)
            n = np.bincount(number, weights=1 + np.unpackbits(np.frombuffer(released(twin), np.uint8))[: len(own)], minlength=len(distinct)).astype(np.int64)
            at = cut(distinct << np.uint64(64 - KEY_BITS), bits)
            some = np.flatnonzero(np.diff(at)).tolist()
            yield {
                "range": some, "chunk": [chunk] * len(some), "keys": [pack_sorted(distinct[at[s] : at[s + 1]]) for s in some],
                "n": [packed(n[at[s] : at[s + 1]]) for s in some],
            }

    def meet(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        n = np.concatenate([unpacked(x) for x in table.column("n").to_pylist()]).astype(np.int64)
        _, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, weights=n)[number]
        codes = np.split((total > 1).astype(np.uint8) + (total > hot), np.cumsum([len(k) for k in keys])[:-1])
        columns = {"chunk": table.column("chunk"), "range": table.column("range"), "code": pa.array([squeezed(c.astype(np.uint8).tobytes()) for c in codes], pa.binary())}
        runs_ = np.split(n, np.cumsum([len(k) for k in keys])[:-1])
        columns |= {"more": pa.array([int((c == 1).sum()) for c in codes], pa.int64())}
        return pa.table(columns | {"hottest": pa.array([int(r[c == 2].sum()) for c, r in zip(codes, runs_, strict=True)], pa.int64())})

    ship(keys.sparkSession)
    met = map_batches(keys.select("chunk", "key", "twin"), "range long, chunk long, keys binary, n binary", send)
    met = met.groupBy("range").applyInArrow(meet, "chunk long, range long, code binary, more long, hottest long")
    # a chunk's own ranges: as many bytes as it has keys
    found = met.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("range", "code"))).alias("c"), F.sum("more").alias("more"), F.sum("hottest").alias("hottest"))
    return save_and_read(found.select("chunk", F.col("c.code").alias("code"), "more", "hottest"), "repeats-codes")


def records(batch: pa.RecordBatch):
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def range_bits(keys: int, per_range: int) -> int:
    return max(0, math.ceil(math.log2(max(keys / per_range, 1))))


class Chunk:
    """A chunk with the codes of its keys: which of its texts go to which bucket, and which starts each stands for."""

    def __init__(self, record: dict, length: int):
        self.length = length
        self.data = released(record["text"])
        self.first = unpack_sorted(released(record["first"])).astype(np.int64)
        self.n = unpacked(released(record["n"])).astype(np.int64)
        self.key = unpacked(record["key"])
        self.code = self._codes(self.key, record["code"])

    @staticmethod
    def _codes(keys: np.ndarray, codes: list[bytes] | None) -> np.ndarray:
        if not codes:
            return np.zeros(len(keys), np.uint8)
        return np.frombuffer(b"".join(map(released, codes)), np.uint8)[np.unique(keys, return_inverse=True)[1]]

    def hot(self, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The starts of hot runs by range of their hash, with the range and both halves of the hash of each."""
        own = self.code == 2
        n = self.n[own]
        starts = np.repeat(self.first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        halves = np.zeros((2, 0), np.uint64)
        if len(starts):
            data = np.frombuffer(self.data, np.uint8)
            halves = np.stack([textvec.mix(rolling(d, self.length)[starts]) for d in (data, SCRAMBLED[data])])
        part = (halves[0] % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return starts[order], part[order], halves[:, order]

    def contexts(self, buckets: int) -> tuple[dict[int, dict[bytes, list[int]]], dict[int, list[int]]]:
        """Different texts by bucket, each with its runs; and their keys."""
        own = self.code == 1
        first, n, key = self.first[own], self.n[own], self.key[own]
        bucket = textvec.mix(key + np.uint64(1)) % np.uint64(buckets)
        order = np.lexsort((first, key, bucket))
        found: dict[int, dict[bytes, list[int]]] = {}
        keys: dict[int, list[int]] = {}
        for b, k, at, size in zip(bucket[order].tolist(), key[order].tolist(), first[order].tolist(), n[order].tolist(), strict=True):
            texts = found.setdefault(b, {})
            places = texts.setdefault(self.data[at : at + size + self.length - 1], [])
            if not places:
                keys.setdefault(b, []).append(k)
            places.append(at)
        return found, keys


def contexts(joined: DataFrame, buckets: int, ranges: int, length: int) -> DataFrame:
    """``bucket, chunk, n, key, twice, text``: starts, key, whether a chunk holds it twice, and bytes of the texts that a chunk sends to a bucket.

    Buckets from ``buckets`` on are the ranges of hot starts: ``key`` and ``text`` are the halves of their hashes.
    """

    def send(batch: pa.RecordBatch):
        for record in records(batch):
            chunk = Chunk(record, length)
            _, part, halves = chunk.hot(ranges)
            for p in np.unique(part).tolist():
                a, b = (half[part == p].tobytes() for half in halves)
                yield {"bucket": [buckets + p], "chunk": [record["chunk"]], "n": [b""], "key": [a], "twice": [b""], "text": [b]}
            found, keys = chunk.contexts(buckets)
            yield {
                "bucket": list(found), "chunk": [record["chunk"]] * len(found),
                "n": [packed(np.array([len(t) - length + 1 for t in own], np.int64)) for own in found.values()],
                "key": [pack_sorted(np.array(keys[b], np.uint64)) for b in found], "twice": [np.packbits([len(at) > 1 for at in own.values()]).tobytes() for own in found.values()],
                "text": [squeezed(b"".join(own)) for own in found.values()],
            }

    return map_batches(joined.drop("doc_id", "size"), "bucket long, chunk long, n binary, key binary, twice binary, text binary", send)


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order of their first ``depth`` bytes, at least, and the eight bytes at each place as numbers. Text ends with its least byte."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64)
    last = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # ends of runs of one byte
    rises = np.append(text[last[:-1] + 1] > text[last[:-1]], True)
    smaller = np.repeat(rises, np.diff(last, prepend=-1))  # smaller than the successor
    first = _direct(np.flatnonzero(smaller), eight, padded, depth)

    heads = text[first]
    bounds = np.searchsorted(heads, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(places: np.ndarray, byte: int) -> np.ndarray:
        """Hand the predecessors that are not smaller to the buckets of their first bytes; those of this bucket come back."""
        before = places[places > 0] - 1
        before = before[~smaller[before]]
        bytes_ = text[before]
        own = before[:0]
        if not len(before):
            return own
        order = np.argsort(bytes_, kind="stable")
        before, bytes_ = before[order], bytes_[order]
        edges = [0, *(np.flatnonzero(bytes_[1:] != bytes_[:-1]) + 1).tolist(), len(bytes_)]
        for low, high in zip(edges, edges[1:], strict=False):
            if bytes_[low] == byte:
                own = before[low:high]
            else:
                waiting[bytes_[low]].append(before[low:high])
        return own

    for byte in range(256):
        queue = np.concatenate(waiting[byte]) if waiting[byte] else first[:0]
        while len(queue):
            out.append(queue)
            queue = induce(queue, byte)
        rest = first[bounds[byte] : bounds[byte + 1]]
        if len(rest):
            out.append(rest)
            induce(rest, byte)
    return np.concatenate(out), eight


def _direct(places: np.ndarray, eight: np.ndarray, padded: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in order of their first ``depth`` bytes, eight at a time among those that are still equal; strings equal all through stay as they are."""
    out = places[np.argsort(eight[places], kind="stable")]
    key = eight[out]
    fresh = np.append(True, key[1:] != key[:-1])
    whole = rolling(padded, depth)
    at = np.arange(len(out))  # where the open suffixes lie
    group = np.cumsum(fresh)
    d = 8
    while d < depth:
        # open: in a group of two or more, not all equal to the end
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(begin, len(group)))
        same = whole[out[at]]
        differs = np.append(False, (same[1:] != same[:-1]) & (group[1:] == group[:-1]))
        open_ = (np.add.reduceat(differs, begin) > 0) & (size > 1) if len(begin) else np.zeros(0, bool)
        size, every = size[open_], np.repeat(open_, size)
        at = at[every]
        if not len(at):
            break
        number = np.repeat(np.arange(len(size), dtype=np.uint64), size)
        # one number: the group, then as many of the next bytes as there is room for
        wide = (64 - len(size).bit_length()) // 8
        own = out[at]
        key = (number << np.uint64(8 * wide)) | (eight[own + d] >> np.uint64(64 - 8 * wide))
        order = np.argsort(key)
        out[at], key = own[order], key[order]
        group = np.cumsum(np.append(True, key[1:] != key[:-1]))
        d += wide
    return out


def common(eight: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of ``length`` bytes at ``a`` and ``b`` are equal, byte for byte."""
    alive = np.arange(len(a))
    for d in range(0, length, 8):
        left, right = eight[a[alive] + d], eight[b[alive] + d]
        if length - d < 8:
            shift = np.uint64(8 * (8 - (length - d)))
            left, right = left >> shift, right >> shift
        alive = alive[left == right]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def repeated_starts(texts: list[bytes], twice: np.ndarray, length: int) -> np.ndarray:
    """For all starts of different ``texts`` in turn, whether their string occurs at another start; all of a text that is held ``twice`` do."""
    size = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255: 0 ends each text
    begin = np.cumsum(size + 1) - size - 1
    n = size - length + 1
    start = np.zeros(len(joined), bool)
    places = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start[places] = True
    order, eight = suffix_order(joined, length)
    order = order[start[order]]
    equal = common(eight, order[:-1], order[1:], length)
    again = np.zeros(len(joined), bool)
    again[order[:-1][equal]] = True
    again[order[1:][equal]] = True
    return again[places] | np.repeat(twice, n)


def repeated_hashes(table: pa.Table) -> list[np.ndarray]:
    """For each record of a range of hot starts, whether each start's hash occurs twice or more in the range."""
    a, b = ([np.frombuffer(x, np.uint64) for x in table.column(c).to_pylist()] for c in ("key", "text"))
    pairs = np.stack([np.concatenate(a), np.concatenate(b)])
    order = np.lexsort(pairs)
    fresh = np.append(True, (pairs[:, order][:, 1:] != pairs[:, order][:, :-1]).any(0))
    number = np.cumsum(fresh) - 1
    again = np.empty(len(order), bool)
    again[order] = (np.bincount(number) > 1)[number]
    return np.split(again, np.cumsum([len(x) for x in a])[:-1])


def repeats(sent: DataFrame, buckets: int, length: int) -> DataFrame:
    """``chunk, starts``: for each chunk, one bit for every start that it sent (buckets in order)."""

    def find(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:
            bits = [squeezed(np.packbits(x).tobytes()) for x in repeated_hashes(table)]
            return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})
        number: dict[bytes, int] = {}
        twice, keys, parts = [], [], []
        for n, key, flags, blob in zip(*(table.column(c).to_pylist() for c in ("n", "key", "twice", "text")), strict=True):
            data, at, own = released(blob), 0, []
            sizes, again = unpacked(n).tolist(), np.unpackbits(np.frombuffer(flags, np.uint8)).tolist()
            for k, size, more in zip(unpack_sorted(key).tolist(), sizes, again, strict=False):
                text = data[at : at + size + length - 1]
                at += len(text)
                i = number.setdefault(text, len(number))
                if i == len(twice):
                    twice.append(bool(more))
                    keys.append(k)
                else:
                    twice[i] = True
                own.append(i)
            parts.append(own)
        texts, whole = list(number), np.array(twice)
        _, kind = np.unique(np.array(keys, np.uint64), return_inverse=True)
        unsure = (np.bincount(kind, weights=~whole) > 0)[kind]  # under a key with a text that is seen once
        size = np.array([len(t) - length + 1 for t in texts])
        found = np.ones(size.sum(), bool)
        edges = np.append(0, np.cumsum(size))
        order = np.argsort(kind, kind="stable")
        order = order[unsure[order]]
        begin = np.flatnonzero(np.append(True, kind[order][1:] != kind[order][:-1])) if len(order) else order
        passed = np.cumsum(size[order] + length)[begin] // SORTED_BYTES if len(order) else order
        cuts = begin[np.flatnonzero(np.append(True, passed[1:] != passed[:-1]))] if len(order) else order
        for part in np.split(order, cuts[1:]):
            if len(part):
                marks = repeated_starts([texts[i] for i in part], whole[part], length)
                for i, own in zip(part.tolist(), np.split(marks, np.cumsum(size[part])[:-1]), strict=True):
                    found[edges[i] : edges[i + 1]] = own
        bits = [squeezed(np.packbits(np.concatenate([found[edges[i] : edges[i + 1]] for i in own])).tobytes()) for own in parts]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    ship(sent.sparkSession)
    found = sent.groupBy("bucket").applyInArrow(find, "chunk long, bucket long, bits binary")
    bits = F.sort_array(F.collect_list(F.struct("bucket", "bits")))  # a chunk's own: one bit a start
    return save_and_read(found.groupBy("chunk").agg(bits.alias("b")).select("chunk", F.col("b.bits").alias("starts")), "repeats-starts")


def removed(joined: DataFrame, buckets: int, ranges: int, length: int) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every document; ``spans`` are begin and end of each removed run."""

    def drop(batch: pa.RecordBatch):
        for record in records(batch):
            chunk = Chunk(record, length)
            found, _ = chunk.contexts(buckets)
            single, part, _ = chunk.hot(ranges)
            step = np.zeros(len(chunk.data) + 1, np.int64)
            marks = [np.zeros(0, np.int64)]
            blobs = record["starts"] or []
            for p, blob in zip(np.unique(part).tolist(), blobs[len(found) :], strict=True):
                own = single[part == p]
                marks.append(own[np.unpackbits(np.frombuffer(released(blob), np.uint8))[: len(own)] > 0])
            for b, blob in zip(sorted(found), blobs[: len(found)], strict=True):
                bits, at = np.unpackbits(np.frombuffer(released(blob), np.uint8)), 0
                for text, places in found[b].items():
                    n = len(text) - length + 1
                    hits = np.flatnonzero(bits[at : at + n])
                    at += n
                    marks += [hits + p for p in places]
            starts = np.concatenate(marks)
            step[starts] += 1  # every start is listed once
            step[starts + length] -= 1
            gone = np.cumsum(step[:-1]) > 0
            data, offsets = np.frombuffer(chunk.data, np.uint8), np.concatenate([[0], np.cumsum(record["size"])]).astype(np.int64)
            inner = np.zeros(len(data) + 1, bool)
            inner[offsets] = True
            begin = np.flatnonzero(gone & (inner[:-1] | ~np.append(False, gone[:-1]))) if len(gone) else np.zeros(0, np.int64)
            end = np.flatnonzero(gone & (inner[1:] | ~np.append(gone[1:], False))) + 1 if len(gone) else begin
            at = np.searchsorted(begin, offsets)
            out: dict = {"doc_id": record["doc_id"], "n_bytes": record["size"], "n_removed": [], "n_spans": np.diff(at), "kept_sha256": [], "spans": []}
            for k in range(len(record["size"])):
                spans = np.stack([begin[at[k] : at[k + 1]], end[at[k] : at[k + 1]]], 1)
                own = slice(offsets[k], offsets[k + 1])
                kept = data[own][~gone[own]] if len(spans) else data[own]
                out["n_removed"].append(int((spans[:, 1] - spans[:, 0]).sum()))
                out["kept_sha256"].append(hashlib.sha256(kept.tobytes()).hexdigest())
                out["spans"].append((spans - offsets[k]).tolist())
            yield out

    return map_batches(joined, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>", drop)


def repeated_text(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, range_keys: int = RANGE_KEYS, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every row of ``docs`` (``doc_id``, ``text``)."""
    stored = save_and_read(chunks(docs, length, gram, chunk_bytes).withColumn("chunk", F.monotonically_increasing_id()), "repeats-chunks")
    every = stored.select(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    codes = shared(stored, range_bits(2 * every // (length - gram + 2), range_keys), hot)
    more, hottest = codes.agg(F.coalesce(F.sum("more"), F.lit(0)), F.coalesce(F.sum("hottest"), F.lit(0))).first()
    rows = stored.join(codes.select("chunk", "code"), "chunk", "left")
    spread = (length - gram) // 2  # starts of a run, about
    buckets, ranges = -(-more * (length + spread) // bucket_bytes) or 1, -(-hottest * spread * 16 // bucket_bytes) or 1
    found = repeats(contexts(rows, buckets, ranges, length), buckets, length)
    return removed(rows.join(found, "chunk", "left"), buckets, ranges, length)


def duckdb_sql(length: int = LENGTH) -> str:
    """The same rows (without ``spans``) from the definition: every start's string is hashed and counted."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, p, md5(array_slice(b, p, p + {length - 1})) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - {length - 2})) AS p FROM d)),
again AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, p, CASE WHEN p - lag(p) OVER w <= {length} THEN 0 ELSE 1 END AS fresh FROM starts JOIN again USING (h) WINDOW w AS (PARTITION BY r ORDER BY p)),
spans AS (
  SELECT r, min(p) AS a, max(p) + {length} AS e FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS k FROM hit) GROUP BY r, k
), lists AS (SELECT r, count(*) AS n, sum(e - a) AS gone, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e FROM spans GROUP BY r),
kept AS (
  SELECT doc_id, octet_length(b) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans,
    CASE WHEN n IS NULL THEN hex(b) ELSE array_to_string(list_transform(range(0, n + 1), lambda k:
      hex(array_slice(b, CASE WHEN k = 0 THEN 1 ELSE e[k] END, CASE WHEN k = n THEN octet_length(b) ELSE a[k + 1] - 1 END))), '') END AS h
  FROM d LEFT JOIN lists USING (r)
) SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256 FROM kept
"""
