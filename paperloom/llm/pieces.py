"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model file: the normaliser (replacements, escaped blanks, dummy prefix), the
pieces (a trie whose paths emit an id), and byte fallback (a character that no piece spells emits its UTF-8 bytes). A text is
composed with them to a lattice over character positions, and the shortest path in the tropical semiring (costs add, the
smaller wins) is its encoding.

For a unigram model an arc costs minus its piece's score. For a BPE model arcs cost nothing but are composed with an acceptor over
neighbouring pieces: a pair is accepted if merging its text in the model's order yields just that pair, and costs
infinity otherwise. A path that the acceptor lets through is the sequence of merges of that text, and there is exactly one for every
prefix, so one state per position is enough. The acceptor's arcs are compiled when first met and kept.

Merges never cross a blank that follows another character, nor a character without a piece. The text is cut there, equal
cuts are solved once per worker, and only a bounded number of them is kept.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Solved cuts and acceptor arcs that a worker keeps.
KEPT = 200_000
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_INF = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 2: -1, 5: 4}[tag & 7]
        size = varint() if size < 0 else size
        yield tag >> 3, data[i : i + size]
        i += size


class Transducer:
    """Compiled model; ``encode`` and ``decode`` are inverse but for U+2581 in the text and what the rules replace."""

    def __init__(self, model: bytes, rules: dict[str, str] | None = None):
        self.texts: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.bpe, self.prefix = True, True
        for number, value in _fields(model):
            got = dict(_fields(value)) if isinstance(value, bytes) else {}
            if number == 1:
                self.texts.append(got[1].decode())
                self.scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                kinds.append(got.get(3, _NORMAL))
            elif number == 2:
                self.bpe = {1: False, 2: True}[got.get(3, 1)]
            elif number == 3:
                if got.get(2) or got.get(4, 1):
                    raise ValueError("the model's own character map or blank removal is not compiled; give it as rules")
                self.prefix = bool(got.get(3, 1))
        self.rules = {k: v for k, v in (rules or {}).items()}
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, kinds)) if k == _NORMAL}
        self.unknown = kinds.index(_UNKNOWN)
        bytes_at = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, kinds)) if k == _BYTE}
        self.bytes_at = [bytes_at.get(b, self.unknown) for b in range(256)]
        self.out = [
            bytes([int(t[3:5], 16)]) if k == _BYTE else t.replace(BLANK, " ").encode() if k == _NORMAL else b" \xe2\x81\x87 " if k == _UNKNOWN else b""
            for t, k in zip(self.texts, kinds)
        ]
        self.trie = {t[:k]: -1 for t in self.ids for k in range(1, len(t))} | self.ids  # -1: inside a path
        self.inside = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        self.byte_cost = 10.0 - min(self.scores)
        chars = {c for t in self.ids for c in t}
        lone = "".join(re.escape(c) for c in "\n\r\t" if c not in chars)
        inner = f"[^{BLANK}{lone}]"
        # a blank starts a cut unless blanks precede it, if no piece has a blank behind another character
        apart = not any(BLANK in t.lstrip(BLANK) for t in self.ids)
        self.cut = re.compile(f"{BLANK}+{inner}*|{inner}+" + (f"|[{lone}]" if lone else "") if apart else "(?s).+").findall
        self.replace = re.compile("|".join(map(re.escape, sorted(self.rules, key=len, reverse=True)))).sub if self.rules else None
        self.accepted: dict[int, bool] = {}
        self.accepted_older: dict[int, bool] = {}
        self.solved: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        if self.replace:
            text = self.replace(lambda m: self.rules[m[0]], text)
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def _accepts(self, left: int, right: int) -> bool:
        """Compile the acceptor's arc from one piece to the next; left is -1 after bytes and at the start.

        There is one if merging both texts gives these two pieces.
        """
        if len(self.accepted) >= KEPT:  # what was not met since the last turn goes
            self.accepted_older, self.accepted = self.accepted, {}
        arc = (left << 32) + right
        ok = self.accepted_older.get(arc)
        if ok is None:
            want = [right] if left < 0 else [left, right]
            ok = self._merged("".join(self.texts[i] for i in want)) == want
        self.accepted[arc] = ok
        return ok

    def _merged(self, text: str) -> list[int]:
        """Merge rule of the model on the text of two pieces: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            options = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not options:
                break
            k = min(options)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids.get(p, -1) for p in parts]

    def shortest_path(self, cut: str) -> list[int]:
        """Ids on the cheapest path through the lattice of a normalised cut."""
        begun, piece_at = self._merge_path(cut) if self.bpe else self._scored_path(cut)
        ids: list[int] = []
        n = len(cut)
        while n:
            start, piece = begun[n], piece_at[n]
            ids += [piece] if piece >= 0 else [self.bytes_at[b] for b in reversed(cut[start:n].encode("utf-8", "replace"))]
            n = start
        return ids[::-1]

    def _merge_path(self, cut: str) -> tuple[list[int], list[int]]:
        """Last arc into each position: start and piece (-1: bytes). Weights are zero or infinite, so the first accepted
        arc into a position is its cheapest."""
        n, step, accepted = len(cut), self.trie.get, self.accepted.get
        begun, piece_at = [0] * (n + 1), [-1] + [-2] * n
        for start in range(n):
            left, end = piece_at[start] << 32, start + 1
            piece = step(cut[start])
            if piece is None:
                begun[end], piece_at[end] = start, -1
            while piece is not None:
                if piece >= 0 and piece_at[end] == -2:
                    ok = accepted(left + piece)
                    if ok is None:
                        ok = self._accepts(piece_at[start], piece)
                    if ok:
                        begun[end], piece_at[end] = start, piece
                end += 1
                if end > n:
                    break
                piece = step(cut[start:end])
        return begun, piece_at

    def _scored_path(self, cut: str) -> tuple[list[int], list[int]]:
        """The same where an arc costs minus its piece's score; a character without a piece costs more than any."""
        n = len(cut)
        cost, begun, piece_at = [0.0] + [_INF] * n, [0] * (n + 1), [-1] * (n + 1)
        for start in range(n):
            arcs = [(start + 1, self.byte_cost, -1)] if cut[start] not in self.ids else []
            for end in range(start + 1, n + 1):
                piece = self.trie.get(cut[start:end])
                if piece is None:
                    break
                if piece >= 0:
                    arcs.append((end, -self.scores[piece], piece))
            for end, weight, piece in arcs:
                if cost[start] + weight < cost[end]:
                    cost[end], begun[end], piece_at[end] = cost[start] + weight, start, piece
        return begun, piece_at

    def _solve(self, cut: str) -> bytes:
        """Packed ids of a cut; parts between characters that no piece has side by side are solved, and kept, alone."""
        inside, at = self.inside, 0
        parts: list[str] = []
        for i in range(1, len(cut)):
            if cut[i - 1 : i + 1] not in inside:
                parts.append(cut[at:i])
                at = i
        if not parts:
            path = self.shortest_path(cut)
            return struct.pack(f"<{len(path)}i", *path)
        return b"".join(self._kept(p) or self._keep(p, self._solve(p)) for p in [*parts, cut[at:]])

    def _kept(self, cut: str) -> bytes | None:
        return self.solved.get(cut) or self.older.get(cut)

    def _keep(self, cut: str, ids: bytes) -> bytes:
        if len(cut) <= 64:
            if len(self.solved) >= KEPT:  # what was not met since the last turn goes
                self.older, self.solved = self.solved, {}
            self.solved[cut] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        kept, parts = self.solved.get, []
        for cut in self.cut(self.normalise(text)):
            ids = kept(cut)
            if ids is None:
                ids = self._keep(cut, self.older.get(cut) or self._solve(cut))
                kept = self.solved.get
            parts.append(ids)
        return np.frombuffer(b"".join(parts), "<i4")

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(2)
def _compiled(model: bytes, rules: tuple[tuple[str, str], ...]) -> Transducer:
    return Transducer(model, dict(rules))


def encode_texts(
    docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, model_file: str = MODEL,
    rules: dict[str, str] | None = None, ids: bool = True,
) -> DataFrame:
    """The columns in ``carry`` (all by default), then ``n_ids`` (long), ``n_bytes_ids`` (ids of byte fallback), ``ids`` (array,
    unless switched off), ``ids_sha256`` of the ids as little-endian 32-bit integers, and ``round_trip``: decoding gives the text.

    A carried column named like one of these is returned as ``<name>_carried``; other names may be any. Null and empty texts
    have no ids and come back as empty. Repeated rows are returned as often as they come, an empty table gives an empty result. U+2581 in a text decodes as a blank, so those rows do
    not come back. No shuffle; the model (bounded by its vocabulary) travels with the task.
    """
    carry = docs.columns if carry is None else carry
    with open(model_file, "rb") as f:
        model = f.read()
    fixed = tuple(sorted((rules or {}).items()))
    inside = [f"c{i}" for i in range(len(carry))]  # names of our own between here and the result
    rows = docs.select(*[docs[f"`{c}`"].alias(i) for c, i in zip(carry, inside)], docs[f"`{text_col}`"].alias("text"))
    own = {"n_ids": "long", "n_bytes_ids": "long", **({"ids": "array<int>"} if ids else {}), "ids_sha256": "string", "round_trip": "boolean"}
    fields = [f"{i} {rows.schema[i].dataType.simpleString()}" for i in inside] + [f"{name} {kind}" for name, kind in own.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(model, fixed)
        is_byte = np.zeros(len(fst.texts), bool)
        is_byte[fst.bytes_at] = True
        for batch in batches:
            # long texts: few rows at a time
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = []
                for text in part.column(part.num_columns - 1).to_pylist():
                    got = fst.encode(text or "")
                    coded.append((got, int(is_byte[got].sum()), hashlib.sha256(got.tobytes()).hexdigest(), fst.decode(got.tolist()) == (text or "")))
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                columns += [pa.array([len(c[0]) for c in coded], pa.int64()), pa.array([c[1] for c in coded], pa.int64())]
                if ids:
                    ends = np.cumsum([0] + [len(c[0]) for c in coded]).astype("int32")
                    flat = np.concatenate([c[0] for c in coded]) if coded else np.array([], "<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
                columns += [pa.array([c[2] for c in coded]), pa.array([c[3] for c in coded])]
                yield pa.RecordBatch.from_arrays(columns, [*inside, *own])

    taken = {n.lower() for n in own}
    named = [F.col(i).alias(f"{c}_carried" if c.lower() in taken else c) for c, i in zip(carry, inside)]
    return rows.mapInArrow(run, ", ".join(fields)).select(*named, *own)
