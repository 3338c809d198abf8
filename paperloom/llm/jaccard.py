"""Near copies by an exact Jaccard join on word shingles, with partitions of the token universe.

Sets of shingles in one size band differ from a partner above the threshold in at most H shingles. A hash cuts the universe into
segments; a set's part of a segment is a segment subset and its hash a signature. A set with H + 1 signatures that
can be used shares one of them, unchanged, with every partner. Segments are allocated by cost:

* 0 for an empty subset, and for a signature that more than ``FREQUENT`` unconnected sets share: it would pair strangers;
* 1 otherwise: the signature must be equal;
* 2, only for sets that are left with fewer than H + 1: the subset may also differ by one shingle, so its hash and the
  hashes of all its one-deletion neighbours are indexed.

A set whose allocation adds up to H + 1 misses no partner. What remains even then (sets that consist of very common
parts) is joined by its rarest shingles, so nothing is lost.

Copies of a set are one class, found by a 64-bit hash of the set; only classes are joined. Each class is first compared with one
center, the one it shares most signatures with, so a cluster of n near copies costs about n comparisons. Where a signature still has
unconnected classes, they meet in a task with their parity sketches (one bit per shingle hash, bits that are hit twice cancel), which bound the number of differing
shingles from below, without error: rows travel there once, and only pairs that the sketches leave come out of it. These
are compared exactly, on the sets of 64-bit shingle hashes, which are recomputed for just those texts.

Signatures travel as packed arrays, by hash bucket; the number of buckets grows with the input, so that a bucket has bounded size. A signature
that a sample shows to be very frequent is spread over several buckets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.graph import components
from paperloom.llm.store import forget, written

SHINGLE = 5
#: Unconnected classes that may share a signature before it is allocated 0.
FREQUENT = 1_000
#: Signatures per bucket, and classes compared with one center in one task.
BUCKET_ROWS = 400_000
CENTER_ROWS = 5_000
#: Rounds of comparing each class with a center, at most, and the share of links among the compared that makes another one worth it.
ROUNDS = 6
FEW = 0.05
#: Classes of one key that a task holds; those that may be unconnected with them pass by.
HELD_ROWS = 20_000
#: Texts and signatures that a task turns into rows at a time.
SLICE = 256
PACKED = 250_000
#: Comparisons up to which a key's sketches are compared one by one instead of in blocks.
FEW_PAIRS = 64
#: One of so many ids is sampled to find signatures that need several buckets.
SAMPLE = 64
GROWTH = 1.6  # of size bands
#: Size of the filter on texts whose sets are asked for: 4 MB are broadcast, always.
FILTER_BITS = 1 << 25
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _tops() -> np.ndarray:
    tops = [4]
    while tops[-1] < 1 << 40:
        tops.append(int(tops[-1] * GROWTH) + 1)
    return np.array(tops)


TOPS = _tops()  # upper ends of the size bands


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and just the six blanks
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    acc = np.full(n, k, np.uint64)
    for i in range(k):
        acc = _mix(acc + h[i : i + n])
    acc.sort()
    return acc[np.r_[True, acc[1:] != acc[:-1]]]


def set_hash(tokens: np.ndarray) -> int:
    """The class of a set: 64 bits, signed."""
    return int(np.add.reduce(_mix(tokens + np.uint64(len(tokens)))).astype(np.int64)) if len(tokens) else 0


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, of two sorted sets."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 80 * (len(a) + len(b) - common)


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the number of shingles per bit, over the next power of two above twice their number."""
    bits = 64 << max(0, int(2 * len(tokens) - 1).bit_length() - 6)
    odd = np.bincount((_mix(tokens + np.uint64(7)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> bool:
    """False only if sizes or sketches (as ``(size, uint64 array)``) prove that two sets are not linked."""
    (n, x), (m, y) = a, b
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= n + m


def _bands(tokens: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``(band, H, number of segments, segment of each token)`` of the bands that ``subsets`` names."""
    n = len(tokens)
    own = int(np.searchsorted(TOPS, n))
    for band in (own, own - 1):
        if band < 0 or band < own and 5 * int(TOPS[band]) < 4 * n:
            continue
        top = int(TOPS[band])
        most = top // 4  # at 0.8, |r| <= 1.25 |s|: H <= (|r| + |s|) / 9 <= |s| / 4
        segments = most + 3 + most // 8  # some more than H + 1, for the empty and the frequent
        h = min(n // 4, most) if band == own else min((n + top) // 9, most)
        yield band, h, segments, (_mix(tokens + np.uint64(band + 1)) % np.uint64(segments)).astype(np.int64)


def subsets(tokens: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per band a set takes part in: ``(band, H, segments, starts, mixed)``.

    ``mixed`` holds token hashes by segment, ``starts`` where each non-empty segment begins. A set is in its own band,
    where the smaller set of a pair is, and in the one below if that may hold a partner.
    """
    for band, h, segments, where in _bands(tokens):
        order = np.argsort(where.astype(np.uint16) if segments < 1 << 16 else where, kind="stable")  # 16 bits: by digits
        where = where[order]
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        yield band, h, where[starts], starts, _mix(tokens[order])


def _key(sums: np.ndarray, segments: np.ndarray, band: int) -> np.ndarray:
    return _mix(sums ^ _mix((segments * 64 + band).astype(np.uint64)))


def signatures(tokens: np.ndarray) -> np.ndarray:
    """Signatures of all non-empty segment subsets, in all bands of the set."""
    out = [_key(np.add.reduceat(mixed, starts), segs, band) for band, _, segs, starts, mixed in subsets(tokens)]
    return np.concatenate(out)


def margin(tokens: np.ndarray, unused: set[int] = frozenset()) -> int:
    """Signatures that a partner shares at least, in the worst band: what is neither empty nor ``unused``, less H."""
    if not unused:
        return min(int(np.count_nonzero(np.bincount(where, minlength=segments))) - h for _, h, segments, where in _bands(tokens))
    found = []
    for band, h, segs, starts, mixed in subsets(tokens):
        keys = _key(np.add.reduceat(mixed, starts), segs, band)
        found.append(len(keys) - h - sum(k in unused for k in keys.astype(np.int64).tolist()))
    return min(found)


def short(tokens: np.ndarray, unused: set[int] = frozenset()) -> bool:
    """Whether some band leaves fewer than H + 1 signatures after the empty and the ``unused`` ones."""
    return margin(tokens, unused) < 1


def neighbourhoods(tokens: np.ndarray) -> tuple[list[int], list[int], list[int], list[bool]]:
    """``need, segment, key, exact`` rows: hashes of every subset and of its one-deletion neighbours.

    ``need`` is the band's H + 1, with the band in the upper digits of ``segment``.
    """
    need, at, keys, exact = [], [], [], []
    for band, h, segs, starts, mixed in subsets(tokens):
        ends = np.r_[starts[1:], len(mixed)]
        for seg, s, e in zip(segs.tolist(), starts.tolist(), ends.tolist()):
            total = np.add.reduce(mixed[s:e])
            sums = np.concatenate([[total], total - mixed[s:e]]) if e - s > 1 else np.array([total])
            got = _key(sums, np.full(len(sums), seg), band).astype(np.int64).tolist()
            keys += got
            exact += [True] + [False] * (len(got) - 1)
            need += [h + 1] * len(got)
            at += [(band << 48) + seg] * len(got)
    return need, at, keys, exact


def _arrow(rows: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(rows.values()), list(rows))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``SLICE`` rows, so that what is made of whole texts stays small."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def _classes(rows: DataFrame) -> DataFrame:
    """``id, h, n, cls, margin, sketch`` from ``id, h, text``."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n, cls, few, bits = [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py())
                n.append(len(s))
                cls.append(set_hash(s))
                few.append(margin(s) if len(s) else 0)
                bits.append(sketch(s))
            yield _arrow({"id": batch.column(0), "h": batch.column(1), "n": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.int64()),
                          "margin": pa.array(few, pa.int32()), "sketch": pa.array(bits, pa.binary())})

    return rows.mapInArrow(run, f"id {kind}, h string, n long, cls long, margin int, sketch binary")


def _hot_signatures(rows: DataFrame, limit: int) -> set[int]:
    """Signatures that a sample of ids expects to exceed ``limit`` rows; at most ``10 * rows / limit`` of them."""
    def run(batches):
        for batch in batches:
            sets = {set_hash(s): s for t in batch.column(0).to_pylist() if len(s := shingles(t))}
            sigs = [signatures(s).astype(np.int64) for s in sets.values()]
            yield _arrow({"sig": pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64))})

    sample = rows.where(F.pmod(F.xxhash64("h"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(run, "sig long").groupBy("sig").count()
    return {r["sig"] for r in counts.where(F.col("count") * SAMPLE > limit).select("sig").collect()}


def _groups(rows: DataFrame, buckets: int, hot: set[int]) -> DataFrame:
    """``sig, cls`` of all signatures that two or more classes have."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # copies within a task are sent once
        held: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            sig = np.concatenate(held)
            cls = np.repeat(np.array([c for c, _ in owners], np.int64), [k for _, k in owners])
            spread = np.isin(sig.astype(np.int64), np.array(sorted(hot), np.int64)) if hot else np.zeros(len(sig), bool)
            bucket = np.where(spread, _mix(sig ^ _mix(cls.astype(np.uint64))), sig) >> np.uint64(16)
            bucket = (bucket % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
            ends = np.r_[cuts[1:], len(order)]
            blobs = [sig[order[a:b]].tobytes() + cls[order[a:b]].tobytes() for a, b in zip(cuts, ends)]
            held.clear()
            owners.clear()
            return _arrow({"bucket": pa.array(bucket[order][cuts]), "blob": pa.array(blobs, pa.binary())})

        total = 0
        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py())
                if not len(s) or (c := set_hash(s)) in sent:
                    continue
                sent.add(c)
                held.append(signatures(s))
                owners.append((c, len(held[-1])))
                total += len(held[-1])
                if total >= PACKED:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(blobs: list[bytes]) -> pa.RecordBatch:
            parts = [np.frombuffer(b, np.int64).reshape(2, -1) for b in blobs]
            sig, cls = np.concatenate(parts, 1)
            order = np.lexsort((cls, sig))
            sig, cls = sig[order], cls[order]
            first = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])]
            sig, cls = sig[first], cls[first]
            same = sig[1:] == sig[:-1]
            keep = np.r_[same, False] | np.r_[False, same]
            if hot:
                keep |= np.isin(sig, np.array(sorted(hot), np.int64))
            return _arrow({"sig": pa.array(sig[keep]), "cls": pa.array(cls[keep])})

        at, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at and blobs:
                    yield group(blobs)
                    blobs = []
                at = bucket
                blobs.append(blob)
        if blobs:
            yield group(blobs)

    packed = rows.select("text").mapInArrow(pack, "bucket long, blob binary")
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "sig long, cls long")


def _bit(h: str) -> Column:
    """Place of a text's hash in the filter, from 1."""
    return F.pmod(F.xxhash64(h), F.lit(FILTER_BITS)) + 1


def _bitmap(needed: DataFrame) -> np.ndarray:
    """Bits of the text hashes in ``needed``: ``FILTER_BITS``, whatever their number."""
    parts = needed.select(_bit("h").alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in parts.collect():
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _sets(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """Written ``cls, tokens`` (8 bytes each) for the classes of ``needed`` (``id, h, cls``), recomputed from their texts.

    A filter of fixed size spares most other texts the join; the join alone decides.
    """
    needed = written(needed, "near-needed")
    bits = rows.sparkSession.sparkContext.broadcast(_bitmap(needed))

    def narrow(batches):
        for batch in batches:
            at = batch.column(3).to_numpy() - 1
            mask = (bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(mask.astype(bool))).select([0, 1, 2])

    def run(batches):
        for batch in _slices(batches):
            sets = [shingles(text.as_py()).tobytes() for text in batch.column(1)]
            yield _arrow({"cls": batch.column(0), "tokens": pa.array(sets, pa.binary())})

    kind = rows.schema["id"].dataType.simpleString()
    some = rows.select("id", "h", "text", _bit("h").alias("at")).mapInArrow(narrow, f"__id {kind}, __h string, text string")
    found = some.join(needed, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__h") == F.col("h"))).dropDuplicates(["__id", "__h"])
    out = written(found.select("cls", "text").mapInArrow(run, "cls long, tokens binary"), "near-sets")
    forget(needed)
    return out


def _compare(pairs: DataFrame, table: DataFrame, exact: bool) -> DataFrame:
    """The ``pairs`` (``a, b``) that are linked, or that sketches do not rule out; written.

    What ``table`` (``cls, n, body``: tokens or a sketch) has of b travels to a, whose own comes first.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CENTER_ROWS).alias("parts"))
    members = pairs.join(counts, "a").select(
        F.col("b").alias("cls"), F.col("a").alias("at"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(1).alias("member"))
    centers = counts.select(
        F.col("a").alias("cls"), F.col("a").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    sent = members.unionByName(centers).join(table, "cls")
    test = linked if exact else may_link

    def run(batches):
        center, at = None, None
        for batch in batches:
            a, b = [], []
            for cls, where, part, member, n, body in zip(*(batch.column(i).to_pylist() for i in range(6))):
                s = np.frombuffer(body, np.uint64)
                s = s if exact else (n, s)
                if not member:
                    center, at = s, (where, part)
                elif at == (where, part) and test(center, s):
                    a.append(where)
                    b.append(cls)
            yield _arrow({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    moved = sent.select("cls", "at", "part", "member", "n", "body").repartition("at", "part").sortWithinPartitions("at", "part", "member")
    return written(moved.mapInArrow(run, "a long, b long"), "near-pairs")


def _half(body: bytes) -> np.ndarray:
    """A sketch folded once: half the bits, the same bound."""
    x = np.frombuffer(body, np.uint64)
    return x[: len(x) // 2] ^ x[len(x) // 2 :] if len(x) > 1 else x


def _near(n: int, x: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which rows of ``held``, sketches of one length, ``may_link`` with ``(n, x)``."""
    fits = np.flatnonzero((5 * np.minimum(n, sizes) >= 4 * np.maximum(n, sizes)))
    rows = held[fits]
    while len(x) > rows.shape[1]:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(x) < rows.shape[1]:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return fits[9 * np.bitwise_count(rows ^ x).sum(1, dtype=np.int64) <= n + sizes[fits]]


def _by_blocks(own: list, guests: list) -> Iterator[tuple[int, int]]:
    """Pairs of a guest and an own class, of other labels, that sketches do not rule out: folded ones first, then whole ones."""
    by: dict[int, list] = {}
    for r in own:
        by.setdefault(len(r[4]), []).append(r)
    for block in by.values():
        ids, labels, sizes = (np.array([r[i] for r in block]) for i in (1, 2, 3))
        held = np.frombuffer(b"".join(r[4] for r in block), np.uint64).reshape(len(block), -1)
        half = held[:, : held.shape[1] // 2] ^ held[:, held.shape[1] // 2 :] if held.shape[1] > 1 else held
        for _, cls, label, n, body in guests:
            near = _near(n, _half(body), sizes, half)
            near = near[labels[near] != label]
            if len(near):
                for other in ids[near[_near(n, np.frombuffer(body, np.uint64), sizes[near], held[near])]].tolist():
                    yield cls, other


def _one_by_one(own: list, guests: list) -> Iterator[tuple[int, int]]:
    """The same for a few rows, with sketches as whole numbers."""
    bits = {r[1]: int.from_bytes(r[4], "little") for r in own + guests}
    for _, cls, label, n, body in guests:
        for _, other, theirs, m, their_body in own:
            if theirs == label or 5 * min(n, m) < 4 * max(n, m):
                continue
            x, y, wide, narrow = bits[cls], bits[other], 8 * len(body), 8 * len(their_body)
            if wide < narrow:
                x, y, wide, narrow = y, x, narrow, wide
            while wide > narrow:
                wide //= 2
                x = (x >> wide) ^ (x & ((1 << wide) - 1))
            if 9 * (x ^ y).bit_count() <= n + m:
                yield cls, other


def _met():
    """Per key, or part of a large key: pairs of classes with different labels that sketches do not rule out, as ``a, b``.

    Rows ``key, part, guest, cls, label, n, body`` come with a part's own classes before its guests, which are compared with
    them. Where a key has one part, guests are told here: all classes that have not the most frequent label.
    """
    def pairs(rows: list, sent: set, a: list, b: list) -> None:
        own, guests = [r for r in rows if not r[0]], [r for r in rows if r[0]]
        if not guests:
            labels = Counter(r[2] for r in own)
            if len(labels) == 1:
                return
            most = labels.most_common(1)[0][0]
            guests = [r for r in own if r[2] != most]
        found = _one_by_one if len(own) * len(guests) <= FEW_PAIRS else _by_blocks
        for cls, other in found(own, guests):
            pair = (min(cls, other), max(cls, other))
            if pair not in sent:
                sent.add(pair)
                a.append(pair[0])
                b.append(pair[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, sent = None, [], set()
        a, b = [], []

        def close() -> None:
            if len(rows) > 1:
                pairs(rows, sent, a, b)
            rows.clear()

        def out() -> pa.RecordBatch:
            found = _arrow({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a.clear()
            b.clear()
            if len(sent) > 200_000:
                sent.clear()
            return found

        for batch in batches:
            for small in (batch.slice(i, 1024) for i in range(0, len(batch), 1024)):
                for key, part, *row in zip(*(small.column(i).to_pylist() for i in range(7))):
                    if (key, part) != at:
                        if rows:
                            close()
                        at = (key, part)
                    rows.append(row)
                    if row[0] and len(rows) > 2 * HELD_ROWS:  # guests pass by in turn
                        pairs(rows, sent, a, b)
                        rows[:] = [r for r in rows if not r[0]]
                if a:
                    yield out()
        if rows:
            close()
            yield out()

    return run


def _meet(keyed: DataFrame, key: str, limit: int | None, classes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes with different labels that share a key and may be linked by their sketches, and the
    keys with more than ``limit`` labels, left out; ``keyed`` has ``cls`` and the key.

    Only rows of keys with several labels travel to their key, once, with their sketches. A key of more than ``HELD_ROWS`` classes is
    dealt to parts of that size; its classes that have not its most frequent label also visit every part, so that each pair with
    two labels meets.
    """
    named = _labelled(keyed.select(F.col(key).alias("key"), "cls"), labels)
    shares = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    per = shares.groupBy("key").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("m", "label")).alias("most"))
    per = written(per.where("labels > 1"), "near-apart")
    often = per.where("false" if limit is None else F.col("labels") > limit).select(F.col("key").alias(key))
    used = per if limit is None else per.where(F.col("labels") <= limit)
    row = ["cls", "label", "n", "body"]
    sent = named.join(used, "key").join(classes.select("cls", "n", "body"), "cls")
    if used.where(F.col("m") <= HELD_ROWS).count() == used.count():
        sent = sent.select("key", F.lit(0).cast("long").alias("part"), F.lit(0).alias("guest"), *row)
    else:
        parts = F.ceil(F.col("m") / HELD_ROWS)
        dealt = sent.withColumn("home", F.pmod(F.xxhash64("cls"), parts))
        own = F.array(F.struct(F.col("home").alias("part"), F.lit(0).alias("guest")))
        visits = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda p: F.struct(p.alias("part"), F.lit(1).alias("guest")))
        every = F.when((F.col("label") == F.col("most")) | (parts == 1), own).otherwise(F.concat(own, visits))
        sent = dealt.select("key", F.explode(every).alias("p"), *row).select("key", "p.part", "p.guest", *row)
    met = sent.repartition("key", "part").sortWithinPartitions("key", "part", "guest").mapInArrow(_met(), "a long, b long")
    return written(met, "near-met").distinct(), often


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (with ``cls``) and the label of the class, its own if it has no links."""
    return rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def _open(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``groups`` whose signature still has classes of several labels; written."""
    marked = _labelled(groups, labels).groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return written(groups.join(marked.where("low < high").select("sig"), "sig").select("sig", "cls"), "near-open")


def _stars(groups: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """``a, b``: each class b that shares a signature with a center of another label, and the center it shares most with.

    The center of a signature is a class of its largest component, another one in every ``turn``. In the first it is the class
    that meets most others over all its signatures: what the rest of a cluster was copied from.
    """
    if labels is None:
        sizes = groups.groupBy("sig").agg(F.count(F.lit(1)).alias("m"))
        popular = groups.join(sizes, "sig").groupBy("cls").agg(F.sum("m").alias("size"))
        marked = groups.join(popular, "cls").withColumn("label", F.col("cls"))
    else:
        sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        own = labels.join(sizes, "label").select(F.col("node").alias("cls"), "label", "size")
        marked = groups.join(own, "cls", "left").withColumns({"label": F.coalesce("label", "cls"), "size": F.coalesce("size", F.lit(1).cast("long"))})
    rank = F.struct("size", F.xxhash64("cls", F.lit(turn)).alias("h"), F.col("cls").alias("a"), F.col("label").alias("la"))
    centers = marked.groupBy("sig").agg(F.max(rank).alias("c")).select("sig", "c.a", "c.la")
    met = marked.join(centers, "sig").where("label <> la").groupBy("a", F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")


class _Join:
    """One run of the join: the tables it has written, and the links so far."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.rows = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("h"), text.alias("text"))
        self.table = written(_classes(self.rows), "near-classes")
        own = F.struct("id", "h")
        classes = self.table.where("n > 0").groupBy("cls").agg(F.min(own).alias("r"), F.first("n").alias("n"), F.first("sketch").alias("body"), F.first("margin").alias("margin"))
        self.classes = written(classes, "near-sketches")
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.n_links = 0

    def sets(self, wanted: DataFrame) -> DataFrame:
        needed = self.classes.join(wanted.select("cls").distinct(), "cls").select("r.id", "r.h", "cls")
        return _sets(self.rows, needed).select("cls", F.lit(0).alias("n"), F.col("tokens").alias("body"))

    def verify(self, pairs: DataFrame, sketched: bool = True) -> None:
        """Add the links among ``pairs`` and, if there are any, label the components anew.

        ``sketched``: the pairs have passed a folded sketch; otherwise sketches are compared first.
        """
        near = written(pairs, "near-pairs")
        if not sketched:
            pairs, near = near, _compare(near, self.classes.select("cls", "n", "body"), exact=False)
            forget(pairs)
        found = near
        if not near.isEmpty():
            sets = self.sets(near.select(F.col("a").alias("cls")).union(near.select("b")))
            found = _compare(near, sets, exact=True)
            forget(sets)
        new = found.count()
        some, self.n_links = new > 0, self.n_links + new
        if some:
            self.links = found if self.links is None else self.links.unionByName(found)
        if some or self.labels is None:
            self.labels = written(components(found if self.links is None else self.links), "near-labels")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written tables ``(id, h, n, cls, ...)`` per row and ``(node, label)`` per class that is linked to another.

    ``h`` is the MD5 of the text.
    """
    join = _Join(docs, id_col, text_col)
    total = join.table.agg(F.sum("n")).first()[0] or 0
    buckets = int(0.5 * total / BUCKET_ROWS) + 1
    hot = _hot_signatures(join.rows, BUCKET_ROWS // 4)
    groups = written(_groups(join.rows, buckets, hot), "near-groups")

    # each class with one center, the one it shares most signatures with, in rounds; then whatever is still apart
    for turn in range(ROUNDS):
        pairs = written(_stars(groups, join.labels, turn), "near-stars")
        before = join.n_links
        join.verify(pairs, sketched=False)
        if join.n_links - before <= FEW * pairs.count():
            break
        forget(pairs)
        if not turn:  # what the first round has connected needs no more comparisons
            done, groups = groups, _open(groups, join.labels)
            forget(done)
    pairs, frequent = _meet(groups, "sig", FREQUENT, join.classes, join.labels)
    unused = written(frequent, "near-frequent")
    join.verify(pairs)

    rest, sets = _uncovered(join, groups, unused)
    if not rest.isEmpty():
        rest, pairs = _by_neighbourhoods(join, rest, sets)
        join.verify(pairs)
        if not rest.isEmpty():
            join.verify(_by_rarest(join, rest, sets))
    forget(groups, sets, unused)
    return join.table, join.labels


def _uncovered(join: _Join, groups: DataFrame, unused: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cls`` of the classes that have too few usable signatures, and the sets of all that might; both written."""
    lost = groups.join(unused, "sig").groupBy("cls").agg(F.collect_set("sig").alias("lost"))  # at most a class's own segments
    few = join.classes.where("margin < 1").select("cls")
    sets = join.sets(lost.select("cls").union(few)).select("cls", F.col("body").alias("tokens"))

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
            found = [cls for cls, tokens, gone in rows if short(np.frombuffer(tokens, np.uint64), set(gone))]
            yield _arrow({"cls": pa.array(found, pa.int64())})

    fewer = sets.join(lost, "cls").select("cls", "tokens", "lost").mapInArrow(run, "cls long")
    return written(fewer.union(few).distinct(), "near-rest"), sets


def _by_neighbourhoods(join: _Join, rest: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes that even one-deletion neighbourhoods do not cover, and the pairs those give."""
    def run(batches):
        for batch in batches:
            for cls, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                need, at, keys, exact = neighbourhoods(np.frombuffer(tokens, np.uint64))
                yield _arrow({"cls": pa.array([cls] * len(keys), pa.int64()), "need": pa.array(need, pa.int64()), "at": pa.array(at, pa.int64()),
                              "key": pa.array(keys, pa.int64()), "exact": pa.array(exact, pa.bool_())})

    keyed = written(sets.join(rest, "cls").select("cls", "tokens").mapInArrow(run, "cls long, need long, at long, key long, exact boolean"), "near-deletions")
    pairs, frequent = _meet(keyed.select("cls", "key").distinct(), "key", FREQUENT, join.classes, join.labels)
    lost = keyed.join(frequent.withColumn("off", F.lit(1)), "key", "left")
    share = lost.groupBy("cls", "need", "at").agg(
        F.max(F.when(F.col("exact"), F.col("off"))).alias("exact_off"), F.max("off").alias("any_off"), F.count(F.lit(1)).alias("size"))
    # 2 where the subset and all its neighbours can be used, 1 where the subset can
    cost = F.when(F.col("exact_off").isNotNull(), 0).when(F.col("any_off").isNotNull() | (F.col("size") == 1), 1).otherwise(2)
    got = share.groupBy("cls", F.shiftright("at", 48).alias("band"), "need").agg(F.sum(cost).alias("got"))
    return written(got.where("got < need").select("cls").distinct(), "near-rest"), pairs


def _by_rarest(join: _Join, rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs among the rest by their rarest shingles: two linked sets share one among the first n - ceil(0.8 n) + 1."""
    def run(batches):
        for batch in batches:
            for cls, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.frombuffer(tokens, np.int64)
                yield _arrow({"cls": pa.array([cls] * len(s), pa.int64()), "token": pa.array(s)})

    tokens = written(sets.join(rest, "cls").select("cls", "tokens").mapInArrow(run, "cls long, token long"), "near-tokens")
    counts = tokens.groupBy("token").count()
    ranked = tokens.join(counts, "token").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("all"))  # one set
    first = F.expr("slice(all, 1, cast(size(all) - ceil(size(all) * 4 / 5.0) + 1 as int))")
    keyed = ranked.select("cls", F.explode(first).alias("t")).select("cls", F.col("t.token").alias("key"))
    return _meet(keyed, "key", None, join.classes, join.labels)[0]


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` per row: the smallest id reachable by links.

    Null and wordless texts have no shingles and are alone. Equal texts, and texts with equal sets, are linked. Null ids
    count as above all others; a component of null ids has a null id. Repeated rows are one class. An empty
    table gives an empty result. Other columns are not read.
    """
    table, labels = near_classes(docs, id_col, text_col)
    return _with_components(table, labels).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"))


def _with_components(table: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, h, n, first`` (the struct ``no_id, id, h`` of the component's first row)."""
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "h")
    alone = table.where("n = 0").withColumn("first", own)
    rows = table.where("n > 0").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    first = rows.groupBy("label").agg(F.min(own).alias("first"))
    return rows.join(first, "label").select("id", "h", "n", "first").unionByName(alone.select("id", "h", "n", "first"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without near copies: of each component the row with the smallest id stays, once.

    Rows without words all stay, but repeated ones (same id, same text) once. Only rows that a filter of fixed size marks as
    dropped or repeated meet the table of these; the join alone decides.
    """
    table, labels = near_classes(docs, id_col, text_col)
    seen = _with_components(table, labels).groupBy("id", "h").agg(F.count(F.lit(1)).alias("times"), F.first("first").alias("first"))
    stays = (F.col("first.h") == F.col("h")) & F.col("first.id").eqNullSafe(F.col("id"))
    marks = written(seen.select("id", "h", stays.alias("stays"), "times").where("NOT stays OR times > 1").select("id", "h", "stays"), "near-marks")
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(marks))
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("__doc"), F.col(id_col).alias("__id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("__h"))

    @F.pandas_udf("boolean")
    def marked(at: pd.Series) -> pd.Series:
        at = at.to_numpy() - 1
        return pd.Series(((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))

    packed = packed.withColumn("__marked", marked(_bit("__h")))
    some = packed.where("__marked")
    met = some.join(marks, (F.col("__h") == F.col("h")) & F.col("__id").eqNullSafe(F.col("id")), "left").where("coalesce(stays, true)")
    kept = packed.where("NOT __marked").select("__doc").unionByName(met.dropDuplicates(["__h", "__id"]).select("__doc"))
    return kept.select(*[F.col("__doc").getField(c).alias(c) for c in names])
