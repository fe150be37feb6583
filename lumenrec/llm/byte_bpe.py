"""Byte-level BPE over length-bucketed padded numpy matrices.

The distinct pieces of a batch are laid into matrices by length, one piece a row. Each round every row merges its
leftmost pair of least rank; the ranks of pairs are looked up in an open-addressing hash table of numpy arrays, the row
is closed up, only the two pairs beside the merge are looked up again, and finished rows leave the matrix. A row of more
than WIDEST bytes is a matrix of its own, and merges its pairs of least rank in one round, from the left up to the first that
makes a pair which would be next: these are the merges that it would make in as many rounds.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NONE = np.int32(2**31 - 1)  # rank of a pair that never merges
WIDEST = 256  # bytes of a row that shares a matrix
KEPT = 120_000  # pieces that a worker remembers before it starts anew

#: Letters and numbers that Unicode 16 added to those of 15.1. The tiktoken library knows those of 16.
ADDED_IN_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D49), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF),
    (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0), (0x1E5F1, 0x1E5FA),
)


def later_characters() -> dict[int, str]:
    """Letters and numbers newer than Unicode 16, each with a private-use character: to tiktoken they are neither."""
    known = {c for a, b in ADDED_IN_16 for c in range(a, b + 1)}
    fresh = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")))
    return {ord(c): "\ue000" for c in regex.findall(r"[\p{L}\p{N}]", fresh) if ord(c) not in known}


class PairTable:
    """Hash table from pairs of ids to the id of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 2.5))))
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == np.uint64(2**64 - 1)]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != np.uint64(2**64 - 1)))
        while len(todo):
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != np.uint64(2**64 - 1))]
        return out


class Encoder:
    """Ranks from a file of lines "base64 rank", and the pattern that splits a text before the merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.later = later_characters()
        self.later_table = np.zeros(0x110000, bool)
        self.later_table[list(self.later)] = True
        self.token = {r: t for t, r in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs))
        self.pairs = PairTable(left, right, merged.astype(np.int32))
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.later_table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any():
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.later))]

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """ids of pieces of up to width bytes, as little-endian unsigned 32-bit integers."""
        rows = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, rows)
        flat = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.full((rows, width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = flat
        ranks = np.full((rows, width), NONE, np.int32)  # ranks[:, k]: of the pair (k, k + 1); the last column has none
        pair = np.arange(width - 1) < sizes[:, None] - 1
        ranks[:, :-1][pair] = self.pairs.find(ids[:, :-1][pair], ids[:, 1:][pair])
        out: list = [None] * rows
        own, cols = np.arange(rows), np.arange(width)
        while len(own):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(own)), at]
            done = best == NONE
            if done.any():
                for n, row, size in zip(own[done].tolist(), ids[done], sizes[done].tolist()):
                    out[n] = row[:size].astype("<u4").tobytes()
                go = ~done
                own, ids, ranks, sizes, at, best = own[go], ids[go], ranks[go], sizes[go], at[go], best[go]
                if not len(own):
                    break
                most = int(sizes.max())
                if most < len(cols):
                    ids, ranks, cols = ids[:, :most], ranks[:, :most], cols[:most]
            r = np.arange(len(own))
            ids[r, at] = best
            take = np.minimum(cols + (cols > at[:, None]), len(cols) - 1)  # closes the gap at at + 1
            ids = np.take_along_axis(ids, take, 1)
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= at[:, None]), len(cols) - 1), 1)
            sizes = sizes - 1
            ids[r, sizes], ranks[r, sizes] = -1, NONE
            ranks[r, sizes - 1] = NONE
            for k, there in ((at - 1, at > 0), (at, at + 1 < sizes)):
                x, y = r[there], k[there]
                ranks[x, y] = self.pairs.find(ids[x, y], ids[x, y + 1])
        return out

    def _wide(self, piece: bytes) -> bytes:
        """The same merges for one long piece: in each round all its pairs of least rank, of overlapping ones from the left every other."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            n = np.arange(len(at))
            at = at[(n - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, n, 0))) % 2 == 0]
            # What stands beside a merge when it is made: on the left what earlier merges left there, on the right what no merge has touched.
            made = np.full(len(at), best)
            before = np.where(np.diff(at, prepend=-3) == 2, best, ids[at - 1])
            sooner = (at > 0) & (self.pairs.find(before, made) <= best)
            more = np.flatnonzero(at + 2 < len(ids))
            sooner[more] |= self.pairs.find(made[more], ids[at[more] + 2]) <= best
            if sooner.any():
                at = at[: sooner.argmax() + 1]
            ids[at] = best
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, ranks = ids[stay], ranks[stay[1:]]  # a place after a merged one goes, and with it the rank of the pair that ended there
            at -= np.arange(len(at))
            for k in (at[at > 0] - 1, at[at < len(ids) - 1]):
                ranks[k] = self.pairs.find(ids[k], ids[k + 1])
        return ids.astype("<u4").tobytes()

    def learn(self, pieces) -> None:
        """Encode pieces that are not yet known."""
        groups: dict[int, list] = {}
        for p in pieces:
            data = p.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(data)) is not None:
                self.known[p] = whole.to_bytes(4, "little")
            elif len(data) > WIDEST:
                self.known[p] = self._wide(data)
            else:
                groups.setdefault(max(4, 1 << (len(data) - 1).bit_length()), []).append((p, data))
        for width, group in groups.items():
            rows = max(1, (1 << 19) // width)
            for k in range(0, len(group), rows):
                part = group[k : k + rows]
                self.known.update(zip([p for p, _ in part], self._matrix([d for _, d in part], width)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out, group, room = [], [], 1_000_000  # characters that are split at a time
        for n, text in enumerate(texts):
            group.append(self.split(text))
            room -= len(text)
            if room <= 0 or n == len(texts) - 1:
                if len(self.known) > KEPT:
                    self.known.clear()
                self.learn({p for pieces in group for p in pieces} - self.known.keys())
                out += [b"".join(map(self.known.__getitem__, pieces)) for pieces in group]
                group, room = [], 1_000_000
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker for each vocabulary."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) of every row of docs.

    A null text counts as empty and has no ids; repeated rows each get theirs; an empty table gives none; other columns
    are left aside. path is read by the executors and has to be there on each of them.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        own = encoder(path, pattern)
        for b in batches:
            ids = own.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, data: the bytes that ids stand for."""

    def run(batches):
        own = encoder(path, pattern)
        for b in batches:
            data = [own.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    encoded = encoded.select("doc_id", "ids")
    return encoded.mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, ids binary, data binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs, as encode() and decode() give them.

    Both ways run in one worker, so a core holds one vocabulary and one set of known pieces, and ids stay where they are.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        own = encoder(path, pattern)
        for b in batches:
            ids = own.encode([t or "" for t in b.column(1).to_pylist()])
            digest = [hashlib.sha256(x).hexdigest() for x in ids]
            decoded = [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), counts, pa.array(digest, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


