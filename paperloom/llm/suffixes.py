"""Repeated byte strings across documents, by column-wise construction of a collection's BWT and common prefixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Equal strings are adjacent in the sorted list
of all suffixes, with a common prefix of at least ``length``. That list is built column by column: the collection starts with every
piece's empty suffix; each round inserts one more symbol per piece, finds the place of the longer suffix by its
rank in the Burrows-Wheeler transform so far, and sets its common prefixes with its two neighbours from the range minima between
the last and the next suffix that the same symbol precedes. A round reads its columns once, front to back, and writes them anew.

Whole texts would need as many rounds as the longest text has bytes, over one collection that no machine holds. So:

* Each window of ``length`` bytes has an anchor, its substring of ``ANCHOR`` bytes with the smallest hash. Equal windows have equal anchors,
  so windows are compared per anchor. Neighbouring windows with one anchor form a piece, of less than twice the
  window's length, which bounds the rounds. Anchors that occur once are dropped before any text moves.
* Collections are groups of anchors of bounded size; their columns are the sequential files, kept in task memory, since tasks have no
  shared disk. The files between the steps are Spark's shuffles and tables in the shared folder.
* Copies are combined first, by text, by piece within a task, and by piece within a group: a later copy of a piece is a repeat as a
  whole. An anchor that very many pieces share (the edge of a passage that everybody cites) is cut to single
  windows, which are spread by their own hash.

Texts travel compressed, in partitions whose number grows with the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.store import written

LENGTH = 100
ANCHOR = 40
#: Bytes of text per document partition and per anchor bucket, bytes of pieces per collection.
PART_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
COLLECTION_BYTES = 1 << 20
#: Documents that share an anchor before it is cut to single windows.
HOT = 6_000
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(base: int) -> np.ndarray:
    size = CHUNK + 4096
    out = np.ones(size, np.uint64)
    n = 1
    while n < size:
        m = min(n, size - n)
        out[n : n + m] = out[:m] * np.uint64(pow(base, n, 1 << 64))
        n += m
    return out


def pieces(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of a text: ``(offset, first, last, anchors)``: pieces hold the windows that start from first to
    last; ``anchors`` are hashes of their anchors."""
    up, down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    span = length - anchor + 1
    for offset in range(0, len(text) - length + 1, CHUNK):
        b = np.frombuffer(text, np.uint8)[offset : offset + CHUNK + length - 1].astype(np.uint64)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * down[: len(b)], out=sums[1:])
        hashes = _mix((sums[anchor:] - sums[:-anchor]) * up[: len(b) - anchor + 1])
        # smallest hash, leftmost among equals, in every span: from minima to the left and right in blocks of that span
        key = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        blocks = np.concatenate([key, np.full(-len(key) % span, ~np.uint64(0))]).reshape(-1, span)
        right = np.minimum.accumulate(blocks, 1).ravel()
        left = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        at = (np.minimum(left[: len(key) - span + 1], right[span - 1 : len(key)]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        yield offset, first, last, hashes[at[first]] >> np.uint64(16)


def repeated_windows(texts: list[bytes], order: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each piece the offsets of windows that are equal to one which starts earlier.

    ``order[i]`` is the rank of piece i's first byte: windows are compared by ``order[i] + offset``.
    """
    _, suffix, common = build(texts, length)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    group = np.cumsum(common < length, dtype=np.int32)
    alike = np.r_[group[1:] == group[:-1], False]
    alike[1:] |= alike[:-1]  # groups of one have nothing to compare
    group, suffix = group[alike], suffix[alike]
    piece = np.searchsorted(ends, suffix, "right").astype(np.int32)
    rank = order[piece] + (suffix - (ends - sizes)[piece])
    o = np.lexsort((rank, group))
    again = np.zeros(len(o), bool)
    again[1:] = group[o][1:] == group[o][:-1]
    piece, offset = piece[o][again], (suffix - (ends - sizes)[piece])[o][again]
    out = np.lexsort((offset, piece))
    piece, offset = piece[out], offset[out]
    return np.split(offset, np.searchsorted(piece, np.arange(1, len(texts))))


def build(texts: list[bytes], cap: int = 255) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BWT (symbols + 1, 0 at a text's start), suffix starts in the joined texts, and common prefixes (up to ``cap``) with the suffix before.

    Texts have end marks of their own, in order. Every round works on columns sorted as the suffixes so far.
    """
    n = len(texts)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    kind = np.uint8 if joined.max(initial=0) < 255 else np.uint16  # UTF-8 has no byte 255
    joined = joined.astype(kind) + kind(1)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    alive = np.arange(n)
    place = np.arange(n)  # of each text's longest suffix so far
    suffix = (begin + sizes).astype(np.int32)
    bwt = np.where(sizes > 0, joined[np.maximum(begin + sizes, 1) - 1] if len(joined) else 0, 0).astype(kind)
    common = np.zeros(n, np.uint8)
    for done in range(1, int(sizes.max(initial=0)) + 1):
        going = sizes[alive] >= done
        alive, place = alive[going], place[going]
        by_symbol = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int32)
        rank[by_symbol] = np.arange(len(bwt), dtype=np.int32)
        symbol, k = bwt[place], rank[place]
        before, after = by_symbol[np.maximum(k - 1, 0)], by_symbol[np.minimum(k + 1, len(bwt) - 1)]
        low, high = np.split(_range_minima(
            common, np.concatenate([before, place]) + 1, np.concatenate([place, after]) + 1,
            np.concatenate([(k > 0) & (bwt[before] == symbol), (k + 1 < len(bwt)) & (bwt[after] == symbol)])), 2)
        ended = n - len(alive)  # texts without a symbol left: marks that precede nothing
        at = k.astype(np.int64) + n - ended
        old = np.ones(len(bwt) + len(alive), bool)
        old[at] = False
        start = begin[alive] + sizes[alive] - done
        more = np.where(start > begin[alive], joined[np.maximum(start, 1) - 1], 0)
        columns = []
        for column, added in ((bwt, more), (suffix, start), (common, np.minimum(low + 1, cap) * (low >= 0))):
            wider = np.empty(len(old), column.dtype)
            wider[old] = column
            wider[at] = added
            columns.append(wider)
        bwt, suffix, common = columns
        follows = high >= 0
        common[at[follows] + 1] = np.minimum(high[follows] + 1, cap)
        place = at
    return bwt, suffix, common


def _range_minima(values: np.ndarray, start: np.ndarray, stop: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Minimum of ``values[start:stop]`` where ``use``, else -1: two overlapping powers of two cover each range."""
    out = np.full(len(start), -1, np.int64)
    at = np.flatnonzero(use)
    level = np.frexp((stop[at] - start[at]).astype(np.float64))[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        own = at[level == k]
        out[own] = np.minimum(values[start[own]], values[stop[own] - (1 << k)])
        values = np.minimum(values[: -(1 << k)], values[1 << k :]) if len(values) > 1 << k else values
    return out


def _arrow(rows: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(rows.values()), list(rows))


def _split(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else []
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)]) if len(key) else ():
        yield int(key[order[a]]), [c[order[a:b]] for c in columns]


def _anchors(texts: DataFrame, buckets: int, parts: int) -> DataFrame:
    """``part, kind = 1, blob``: anchors, and flags of the hot ones, that two texts or two pieces of one text share."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent, total = [], set(), 0

        def flush() -> pa.RecordBatch:
            anchor, cls = (np.concatenate(x) for x in zip(*held))
            rows = [(b, a.tobytes(), c.tobytes()) for b, (a, c) in _split((anchor % np.uint64(buckets)).astype(np.int64), anchor, cls)]
            held.clear()
            six = [np.frombuffer(a, np.uint8).reshape(-1, 8)[:, :6].tobytes() + c for _, a, c in rows]
            return _arrow({"bucket": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array(six, pa.binary())})

        for batch in batches:
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text.encode()
                if cls in sent or len(text) < LENGTH:
                    continue
                sent.add(cls)
                found = np.concatenate([p[3] for p in pieces(text)] or [np.zeros(0, np.uint64)])
                anchor, counts = np.unique(found, return_counts=True)
                if not len(anchor):
                    continue
                twice = anchor[counts > 1]  # as if another text had them too
                held.append((np.concatenate([anchor, twice]), np.r_[np.full(len(anchor), cls), np.full(len(twice), cls ^ 1)].astype(np.int64)))
                total += len(anchor) + len(twice)
                if total > 1_000_000:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            anchors, classes = [], []
            for b in blobs:
                k = len(b) // 14
                wide = np.zeros((k, 8), np.uint8)
                wide[:, :6] = np.frombuffer(b, np.uint8, 6 * k).reshape(-1, 6)
                anchors.append(wide.ravel().view(np.uint64))
                classes.append(np.frombuffer(b, np.int64, k, 6 * k))
            anchor, cls = np.concatenate(anchors), np.concatenate(classes)
            order = np.lexsort((cls, anchor))
            anchor, cls = anchor[order], cls[order]
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (cls[1:] != cls[:-1])]
            anchor, cls = anchor[new], cls[new]
            _, inverse, counts = np.unique(anchor, return_inverse=True, return_counts=True)
            n = counts[inverse]
            keep = n > 1
            flagged = anchor[keep] * np.uint64(2) + (n[keep] > HOT)
            rows = [(p, np.unique(a).tobytes()) for p, (a,) in _split((cls[keep] >> 1) % parts, flagged)]
            yield _arrow({"part": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

        at, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at and blobs:
                    yield from group(blobs)
                    blobs = []
                at = bucket
                blobs.append(blob)
        if blobs:
            yield from group(blobs)

    packed = texts.mapInArrow(pack, "bucket long, blob binary")
    met = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "part long, blob binary")
    return met.select("part", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("cls"), F.lit(None).cast("long").alias("ref"), "blob")


def _packed_texts(texts: DataFrame, parts: int, kind: int) -> DataFrame:
    """Texts compressed, once per class and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, sent = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            part, cls, blob = [], [], []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c not in sent and len(text.encode()) >= LENGTH:
                    sent.add(c)
                    part.append((c >> 1) % parts)
                    cls.append(c)
                    blob.append(press.compress(text.encode()))
            yield _arrow({"part": pa.array(part, pa.int64()), "cls": pa.array(cls, pa.int64()), "blob": pa.array(blob, pa.binary())})

    packed = texts.mapInArrow(run, "part long, cls long, blob binary")
    return packed.select("part", F.lit(kind).alias("kind"), "cls", F.lit(None).cast("long").alias("ref"), "blob")


def _by_part(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "part").sortWithinPartitions("part", "kind", "cls").select("part", "kind", "cls", "ref", "blob")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, int], list[bytes], Iterator[tuple[int, bytes]]]]:
    """``(part, refs by class, blobs of kind 1, texts by class)`` per partition of documents; texts are a stream."""
    rows = ((row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5)))))
    row = next(rows, None)
    while row is not None:
        part, refs, blobs = row[0], {}, []
        while row is not None and row[0] == part and row[1] < 2:
            if row[1] == 0:
                refs[row[2]] = row[3]
            else:
                blobs.append(row[4])
            row = next(rows, None)

        def texts() -> Iterator[tuple[int, bytes]]:
            nonlocal row
            unpress, last = zstandard.ZstdDecompressor(), None
            while row is not None and row[0] == part:
                if row[2] != last:
                    last = row[2]
                    yield last, unpress.decompress(row[4])
                row = next(rows, None)

        stream = texts()
        yield part, refs, blobs, stream
        for _ in stream:
            pass


_RUN = np.dtype([("ref", "<i8"), ("cls", "<i8"), ("pos", "<i8"), ("last", "<i8")])


def _runs_by_part(runs: np.ndarray, parts: int) -> pa.RecordBatch:
    rows = [(p, r.tobytes()) for p, (r,) in _split((runs["cls"] >> 1) % parts, runs)]
    return _arrow({"bucket": pa.array([None] * len(rows), pa.int64()), "part": pa.array([r[0] for r in rows], pa.int64()),
                   "blob": pa.array([r[1] for r in rows], pa.binary())})


def _shared_pieces(rows: DataFrame, buckets: int, parts: int) -> DataFrame:
    """``bucket, part, blob``: pieces with shared anchors for a bucket, and runs of windows already known as repeats for a part."""
    head = np.dtype([("anchor", "<u8"), ("ref", "<i8"), ("cls", "<i8"), ("pos", "<i8"), ("size", "<i4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for _, refs, blobs, texts in _parts(batches):
            flagged = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in blobs])) if blobs else np.zeros(0, np.uint64)
            known, hot = flagged >> np.uint64(1), set((flagged[flagged & np.uint64(1) == 1] >> np.uint64(1)).tolist())
            first: dict[bytes, tuple[int, int, int, int]] = {}
            again: list[tuple[int, int, int, int]] = []

            def meet(piece: bytes, place: tuple[int, int, int, int]) -> None:
                other = first.get(piece)
                if other is None or (place[0], place[2]) < (other[0], other[2]):
                    first[piece] = place
                    place, other = other, place
                if place is not None:
                    again.append((place[0], place[1], place[2], place[2] + len(piece) - LENGTH))

            for cls, text in texts if len(known) else ():
                ref = refs[cls]
                for offset, start, last, anchor in pieces(text):
                    at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
                    for i in np.flatnonzero(known[at] == anchor).tolist():
                        a, z, key = int(start[i]) + offset, int(last[i]) + offset, int(anchor[i])
                        if key in hot:
                            for p in range(a, z + 1):
                                meet(text[p : p + LENGTH], (ref, cls, p, key))
                        else:
                            meet(text[a : z + LENGTH], (ref, cls, a, key))
                if len(again) > 100_000:
                    yield _runs_by_part(np.array(again, _RUN), parts)
                    again.clear()
            if again:
                yield _runs_by_part(np.array(again, _RUN), parts)
            if first:
                rows = [(p[3], p[0], p[1], p[2], len(t)) for t, p in first.items()]
                table, bodies = np.array(rows, head), list(first)
                hashed = np.array([int.from_bytes(hashlib.blake2b(t, digest_size=6).digest(), "little") if p[3] in hot else p[3] for t, p in first.items()], np.int64)
                bucket, blob = [], []
                for b, (index,) in _split(hashed % buckets, np.arange(len(table))):
                    part = table[index].tobytes()
                    bucket.append(b)
                    blob.append(len(index).to_bytes(4, "little") + press.compress(part + b"".join(bodies[i] for i in index)))
                yield _arrow({"bucket": pa.array(bucket, pa.int64()), "part": pa.array([None] * len(bucket), pa.int64()), "blob": pa.array(blob, pa.binary())})

    return _by_part(rows, parts).mapInArrow(run, "bucket long, part long, blob binary")


def _repeats(shared: DataFrame, buckets: int, parts: int) -> DataFrame:
    """``part, kind = 1, blob``: runs of windows that start earlier elsewhere, by the part of their text."""
    head = np.dtype([("anchor", "<u8"), ("ref", "<i8"), ("cls", "<i8"), ("pos", "<i8"), ("size", "<i4")])

    def group(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        first: dict[bytes, tuple] = {}
        runs: list[tuple[int, int, int, int]] = []
        for b in blobs:
            k, body = int.from_bytes(b[:4], "little"), unpress.decompress(b[4:])
            rows = np.frombuffer(body, head, k)
            at = k * head.itemsize
            for row in rows.tolist():
                text = body[at : at + row[4]]
                at += row[4]
                other = first.get(text)
                if other is None or (row[1], row[3]) < (other[1], other[3]):
                    first[text] = row
                    row, other = other, row
                if row is not None:
                    runs.append((row[1], row[2], row[3], row[3] + row[4] - LENGTH))
        groups: dict[int, list[bytes]] = {}
        for text, row in first.items():
            groups.setdefault(row[0], []).append(text)
        batch: list[bytes] = []
        size = 0
        for same in groups.values():
            if len(same) > 1 and any(len(t) > LENGTH for t in same):  # different windows of one length are different strings
                batch += same
                size += sum(map(len, same))
            if size >= COLLECTION_BYTES:
                runs += _collection(batch, first)
                batch, size = [], 0
        if batch:
            runs += _collection(batch, first)
        if runs:
            out = _runs_by_part(np.array(runs, _RUN), parts)
            yield _arrow({"part": out.column(1), "blob": out.column(2)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for batch in batches:
            for bucket, part, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket is None:
                    yield _arrow({"part": pa.array([part], pa.int64()), "blob": pa.array([blob], pa.binary())})
                    continue
                if bucket != at and blobs:
                    yield from group(blobs)
                    blobs = []
                at = bucket
                blobs.append(blob)
        if blobs:
            yield from group(blobs)

    spread = F.coalesce("bucket", F.col("part"))  # runs that are known pass through
    met = shared.repartition(buckets, spread).sortWithinPartitions("bucket").mapInArrow(run, "part long, blob binary")
    return met.select("part", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("cls"), F.lit(None).cast("long").alias("ref"), "blob")


def _collection(texts: list[bytes], first: dict[bytes, tuple]) -> Iterator[tuple[int, int, int, int]]:
    """Runs of repeated windows of the pieces of one collection."""
    places = [first[t] for t in texts]
    # ranks of first bytes: by text, then position, with room for a piece between texts
    order = sorted(range(len(texts)), key=lambda i: (places[i][1], places[i][3]))
    rank = np.zeros(len(texts), np.int64)
    base, last = 0, None
    for i in order:
        _, ref, _, pos, size = places[i]
        if last is None or last[0] != ref:
            base = base + 4096
        else:
            base += min(pos - last[1], 4096)
        rank[i] = base
        last = (ref, pos)
    for (_, ref, cls, pos, _), offsets in zip(places, repeated_windows(texts, rank)):
        if len(offsets):
            cuts = np.flatnonzero(np.r_[True, np.diff(offsets) != 1])
            for a, b in zip(offsets[cuts].tolist(), offsets[np.r_[cuts[1:], len(offsets)] - 1].tolist()):
                yield ref, cls, pos + a, pos + b


def _removed(rows: DataFrame, parts: int) -> DataFrame:
    """``cls, n_removed, n_spans, kept_sha256, spans`` of each class's first text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, refs, blobs, texts in _parts(batches):
            runs = np.concatenate([np.frombuffer(b, _RUN) for b in blobs]) if blobs else np.zeros(0, _RUN)
            runs = runs[np.lexsort((runs["pos"], runs["cls"]))]
            out: list[tuple] = []
            for cls, text in texts:
                a, b = np.searchsorted(runs["cls"], [cls, cls + 1])
                begin, end = runs["pos"][a:b], np.maximum.accumulate(runs["last"][a:b] + LENGTH) if b > a else runs["last"][a:b]
                cut = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]]) if b > a else np.zeros(0, np.int64)
                spans = [(int(begin[i]), int(end[j])) for i, j in zip(cut, np.r_[cut[1:], b - a] - 1)]
                kept, at = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(text[at:s])
                    at = e
                kept.update(text[at:])
                out.append((cls, sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [{"start": s, "stop": e} for s, e in spans]))
                if len(out) >= 2000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        names = ["cls", "n_removed", "n_spans", "kept_sha256", "spans"]
        return _arrow({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return _by_part(rows, parts).mapInArrow(run, "cls long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256, spans`` per row: bytes that repeat earlier text, as
    ``[start, stop)`` spans, and what is left.

    Earlier means a smaller id, or an earlier start in the same text. Null texts are empty; texts under ``LENGTH`` bytes keep all. Ids
    that are null, repeated or no integers are taken in sorted order, nulls last, repeated ones by text, so of
    repeated rows the first keeps its bytes. An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # 60 bits of the MD5, even: the odd number beside it stands for a second piece of the text
    cls = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long") * 2
    slim = written(rows.select("id", F.octet_length("text").cast("long").alias("n"), cls.alias("cls")), "repeats-texts")
    facts = slim.agg(F.count(F.lit(1)).alias("rows"), F.count("id").alias("ids"), F.countDistinct("id").alias("distinct"), F.sum("n").alias("bytes")).first()
    plain = facts["rows"] == facts["ids"] == facts["distinct"] and slim.schema["id"].dataType.simpleString() in ("bigint", "int")
    slim = slim.withColumn("ref", F.col("id").cast("long")) if plain else _numbered(slim)
    firsts = written(slim.groupBy("cls").agg(F.min("ref").alias("ref"), F.max("n").alias("n")), "repeats-firsts")
    parts = int((facts["bytes"] or 0) / PART_BYTES) + 1
    buckets = int((facts["bytes"] or 0) / BUCKET_BYTES) + 1
    texts = rows.select(cls.alias("cls"), "text")
    refs = firsts.where(F.col("n") >= LENGTH).select(
        F.pmod(F.shiftright("cls", 1), F.lit(parts)).alias("part"), F.lit(0).alias("kind"), "cls", "ref", F.lit(None).cast("binary").alias("blob"))
    anchors = _anchors(texts, buckets, parts)
    shared = _shared_pieces(refs.unionByName(anchors).unionByName(_packed_texts(texts, parts, 2)), buckets, parts)
    repeats = written(_repeats(shared, buckets, parts), "repeats-runs")
    removed = _removed(refs.unionByName(repeats).unionByName(_packed_texts(texts, parts, 2)), parts)
    joined = slim.join(firsts.select("cls", F.col("ref").alias("first")), "cls").join(removed, "cls", "left")
    none = F.array().cast("array<struct<start:long,stop:long>>")
    copy = (F.col("n") >= LENGTH) & (F.col("ref") != F.col("first"))
    empty = hashlib.sha256(b"").hexdigest()
    out = joined.withColumn("short", F.col("n") < LENGTH)
    result = out.where("NOT short").select(
        F.col("id").alias(id_col), F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")))).otherwise(F.col("spans")).alias("spans"),
    )
    # short texts keep everything; they never left the scan
    whole = rows.where(F.octet_length("text") < LENGTH).select(
        F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), none.alias("spans"))
    return result.unionByName(whole)


def _numbered(slim: DataFrame) -> DataFrame:
    """Number the rows by id and class; nulls last. Rows are sorted over all partitions, none is gathered."""
    fields = slim.schema.add("ref", "long")
    ordered = slim.orderBy(F.col("id").asc_nulls_last(), "cls", "n")
    return written(slim.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), fields), "repeats-numbered")
