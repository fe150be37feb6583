"""SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprints of 8 bytes that differ in at most 4 bits agree in at least 4 of their bytes. Postings are kept under the bytes
at three positions, for so many choices of three that any four positions hold one of them: 20, where choices of four would
take 70 and single positions, 2,048 postings in all, would grow with the square of the corpus. In a posting the shared
positional bytes of each pair are tallied: pairs below the guaranteed minimum are let go, of the others each is looked at in
the first posting that it shares, and is verified bit by bit. A posting of very many fingerprints is dealt out once more by
a position more, as its pairs have to share one, and what is still too many is compared in pairs of blocks.

near_documents() reaches a similarity of 0.8, where a pair differs in ten bits of 64 and need not share any byte. There
fingerprints only join what is very near; all other pairs are found by the rarest shingles of each document, of which two
similar ones share one for sure, and every link is verified on the shingles themselves.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop, dropped_after, store, table
from .packs import trim

BYTES, BLOCK = 8, 2048  # bytes of a fingerprint; fingerprints of a posting that are compared at once
TABLES, LEAST = 12, 3  # fingerprints of a document in near_documents(), and the positional bytes that a pair shares in the first of them
COUNTERS, SLICES = 1 << 18, 16  # counts of shingles by the first bits of their hash, and the rows that they travel in
PARITIES = 512  # bits that tell how far apart two sets of shingles are at least
_MIX = np.random.Generator(np.random.PCG64(23)).integers(0, 2**63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]  # each bit of a byte in a byte of its own


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of the word shingles of text, A-Z lower-cased; of fewer words, of all of them; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # at the six ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    data = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(data, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    one = xxhash.xxh64_intdigest
    return np.array([one(data[a:b], seed) for a, b in zip((ends - sizes).tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def majority(h: np.ndarray) -> np.ndarray:
    """Of each row of hashes the bits that over half of them have, as signed 64-bit numbers."""
    ones = np.zeros((len(h), 64), np.int64)
    for k in range(0, h.shape[1], 255):  # as many as a byte can count
        part = np.ascontiguousarray(h[:, k : k + 255]).view(np.uint8).reshape(len(h), -1, 8)
        ones += _SPREAD[part].sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(len(h), 64)
    return np.packbits(ones * 2 > h.shape[1], axis=1, bitorder="little").view(np.int64)[:, 0]


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles of text; 0 without words."""
    return int(majority(shingle_hashes(text, shingle, seed)[None])[0])


def sketch(text: str | None, shingle: int, tables: int, seed: int = 42) -> list[int]:
    """As many fingerprints of the distinct shingles of text, each from its own mix of their hashes."""
    return sketch_of(np.unique(shingle_hashes(text, shingle, seed)), tables)


def sketch_of(h: np.ndarray, tables: int) -> list[int]:
    """As many fingerprints of distinct hashes."""
    x = h[None] * _MIX[:tables, None]
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return majority(x ^ x >> np.uint64(32)).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint")


def choices(same: int) -> list[tuple[int, ...]]:
    """Positions of the postings: any same positions hold one of these choices.

    Of four positions dealt to three groups in a ring, three are in one group, or two in one and another in the next, or
    else two groups hold two each and the one before gives a choice with either. Of three dealt to two groups, two meet.
    """
    if same < 1:
        raise ValueError("fingerprints that differ in 8 bits or more need not share a byte")
    if same <= 2:
        return [(p,) for p in range(BYTES)]
    if same == 3:
        return [c for c in combinations(range(BYTES), 2) if c[0] % 2 == c[1] % 2]
    ring = {tuple(sorted(x)) for g in range(3) for x in ((g, g, g), (g, g, (g + 1) % 3))}
    return [c for c in combinations(range(BYTES), 3) if tuple(sorted(p % 3 for p in c)) in ring]


def finer(chosen: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Each choice with one position more, which stands last."""
    return [(*c, p) for c in chosen for p in range(BYTES) if p not in c]


def _mask(positions) -> int:
    return sum(1 << p for p in positions)


def handled(chosen: list[tuple[int, ...]], more: bool = False) -> np.ndarray:
    """For each posting and each set of equal bytes (as bits) whether a pair is looked at there: in the first choice that the set holds.

    With more, for finer(chosen): there with the first position besides.
    """
    sets = np.arange(1 << BYTES)
    first = np.full(len(sets), -1)
    for n, c in reversed(list(enumerate(chosen))):
        first[sets & _mask(c) == _mask(c)] = n
    if not more:
        return first == np.arange(len(chosen))[:, None]
    out = []
    for n, c in enumerate(chosen):
        rest = sets & ~_mask(c)
        out += [(first == n) & (rest & -rest == 1 << p) for p in range(BYTES) if p not in c]
    return np.array(out)


class Rule:
    """When a pair of a posting is a link, and which posting looks at it.

    least: shared positional bytes; bits: differing bits, at most; sure: differing bits up to which a link needs no other
    beside it; here: by posting, the sets of equal bytes that are looked at; shift: bits of a key below the posting's number.
    """

    def __init__(self, least: int, bits: int, sure: int, here: np.ndarray, shift: int):
        self.least, self.bits, self.sure, self.here, self.shift = least, bits, sure, here, shift

    def linked(self, fp: np.ndarray, i: np.ndarray, j: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs (i, j), with their postings' keys, are links: those that reach the tally, are looked at here and are verified; and their differing bits."""
        x = fp[i] ^ fp[j]
        equal = x.view(np.uint8).reshape(-1, BYTES) == 0
        left = np.flatnonzero(equal.sum(axis=1) >= self.least)
        sets = np.packbits(equal[left], axis=1, bitorder="little")[:, 0]
        left = left[self.here[(keys[left] >> self.shift) % len(self.here), sets]]
        apart = np.bitwise_count(x[left])
        return left[apart <= self.bits], apart[apart <= self.bits]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label after all labels a and b are joined: each component's least."""
    root = np.arange(len(label))
    while True:
        low, was = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (was == root).all():
            return root[label]


def first_of_each(labels: np.ndarray) -> np.ndarray:
    """For each row the first one of its label."""
    _, first, which = np.unique(labels, return_index=True, return_inverse=True)
    return first[which]


class Forest:
    """Links that join all that the added ones join, near ones before far ones; no more than a few for each of n rows are held. Rows of one label are joined from the start."""

    def __init__(self, n: int, sure: int, labels: np.ndarray | None = None):
        self.n, self.sure, self.held, self.base = n, sure, 0, np.arange(n) if labels is None else first_of_each(labels)
        self.label = self.base
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> None:
        self.parts.append((i, j, apart))
        self.held += len(i)
        if self.held > 1 << 20:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """The links to keep. label then tells which rows sure links join."""
        i, j, apart = (np.concatenate(x).astype(np.int64) for x in zip(*self.parts, (np.empty(0, np.int64),) * 3))
        order = np.argsort(apart, kind="stable")
        i, j, apart = i[order], j[order], apart[order]
        label, kept, left = self.base, [], np.arange(len(i))
        while len(left := left[label[i[left]] != label[j[left]]]):
            first = np.full(self.n, len(i))  # of each component the link that comes first
            np.minimum.at(first, label[i[left]], left)
            np.minimum.at(first, label[j[left]], left)
            new = np.unique(first[first < len(i)])
            kept.append(new)
            label = _joined(label, label[i[new]], label[j[new]])
        kept = np.concatenate([*kept, np.empty(0, np.int64)]).astype(np.int64)
        i, j, apart = i[kept], j[kept], apart[kept]
        near = apart <= self.sure
        self.label = _joined(self.base, self.base[i[near]], self.base[j[near]])
        self.parts, self.held = [(i, j, apart)], len(i)
        return i, j


def within(fp: np.ndarray, keys: np.ndarray, rule: Rule, labels: np.ndarray | None = None, whole: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys (sorted), as many as join what all of its links join; of a run of at most whole rows all that are not sure."""
    n, found, every = len(fp), Forest(len(fp), rule.sure, labels), []
    small = np.repeat(runs <= whole, runs) if len(runs := np.diff(np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), n])) and n else np.zeros(n, bool)
    at, step = np.arange(n), 1
    while len(at := at[at + step < n]) and len(at := at[keys[at] == keys[at + step]]):
        i = at[found.label[at] != found.label[at + step]]  # what sure links join needs no other
        ok, apart = rule.linked(fp, i, i + step, keys[i])
        found.add(i[ok], i[ok] + step, apart)
        far = i[ok][small[i[ok]] & (apart > rule.sure)]
        every.append((far, far + step))
        step += 1
        if step >= 8 and not step & (step - 1):
            found.settle()
    i, j = found.settle()
    far, to = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (zip(*every) if every else ([], [])))
    apart = found.label[far] != found.label[to]
    return np.concatenate([i, far[apart]]), np.concatenate([j, to[apart]])


def across(fp: np.ndarray, n: int, keys: np.ndarray, rule: Rule, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of pairs of one of the first n rows and one of the rest, all of one posting, as many as join what all join.

    First one row of each side meets the other side. What is then joined by sure links needs comparing with the rest only.
    """
    found = Forest(len(fp), rule.sure, labels)

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        each = max(1, (1 << 18) // max(1, len(j)))
        for k in range(0, len(i), each):
            x, y = np.repeat(i[k : k + each], len(j)), np.tile(j, len(i[k : k + each]))
            apart = found.label[x] != found.label[y]
            x, y = x[apart], y[apart]
            ok, apart = rule.linked(fp, x, y, keys[x])
            found.add(x[ok], y[ok], apart)

    left, right = np.arange(n), np.arange(n, len(fp))
    meet(left[:1], right)
    meet(left, right[:1])
    found.settle()
    joined = found.label == np.bincount(found.label).argmax()
    out = ~joined
    meet(left[out[:n]], right)
    meet(left[joined[:n]], right[out[n:]])
    return found.settle()


OUT, LABEL = "key bigint, block bigint, a bigint, b bigint", ", label bigint"


def _row(*columns) -> pa.RecordBatch:
    """key, block, a, b and, if rows have one, label."""
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "block", "a", "b", "label"][: len(columns)])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of rows that end with fp, node and, if they have one, label; without, each node is its own."""
    out = [c.to_numpy() for c in batch.columns]
    return out if batch.schema.names[-1] == "label" else [*out, out[-1]]


def _search(rule: Rule, limit: int, small: int = 0):
    """Over rows (key, fp, node, label if there is one) sorted by key: links of nodes (block -1), and in blocks the rows of postings of over limit, which are left for later."""

    def run(batches):
        keys, fps, nodes, labels = (np.empty(0, np.int64) for _ in range(4))
        own, given, last = True, 0, None  # whether rows have a label; the rows of the last key so far; its blocks given away

        def finish(keys, fps, nodes, labels):
            i, j = within(fps.view(np.uint64), keys, rule, labels, small)
            return _row(np.full(len(i), -1), np.full(len(i), -1), nodes[i], nodes[j], *[np.zeros(len(i), np.int64)] * own)

        for batch in batches:
            own = batch.schema.names[-1] == "label"
            keys, fps, nodes, labels = (np.concatenate(x) for x in zip((keys, fps, nodes, labels), _columns(batch)))
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            rest = starts[-1]  # from here on rows are kept for the next batch
            whole = np.ones(len(keys), bool)
            whole[starts[-1] :] = False  # the last key may go on
            for s, m in zip(starts[sizes > limit].tolist(), sizes[sizes > limit].tolist()):
                whole[s : s + m] = False
            if given and keys[0] == last and len(starts) > 1:
                whole[: sizes[0]] = False
            for s, m in zip(starts.tolist(), sizes.tolist()):
                key, tail = int(keys[s]), s == starts[-1]
                on = given if key == last else 0
                if m <= limit and not on:
                    if tail:
                        given, last = 0, key
                    continue
                full = m // limit * limit if tail else m
                if full:
                    blocks = on + np.arange(full) // limit
                    yield _row(np.full(full, key), blocks, fps[s : s + full], nodes[s : s + full], *[labels[s : s + full]] * own)
                    on = int(blocks[-1]) + 1
                if tail:
                    given, last = on, key
                    rest = s + full
            out = finish(keys[whole], fps[whole], nodes[whole], labels[whole])
            if out.num_rows:
                yield out
            keys, fps, nodes, labels = keys[rest:], fps[rest:], nodes[rest:], labels[rest:]
        if len(keys):
            yield _row(keys, np.full(len(keys), given), fps, nodes, *[labels] * own) if given else finish(keys, fps, nodes, labels)

    return run


def _search_blocks(rule: Rule):
    """Over rows (unit, side, key, fp, node, label if there is one) sorted by unit and side: links within the one block of a unit, or across its two."""

    def compare(side, keys, fps, nodes, labels):
        n, fp = int((side == 0).sum()), fps.view(np.uint64)
        i, j = within(fp, keys, rule, labels) if n == len(fp) else across(fp, n, keys, rule, labels)
        return pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], ["a", "b"])

    def run(batches):
        held = [np.empty(0, np.int64) for _ in range(6)]
        for batch in batches:
            held = [np.concatenate(x) for x in zip(held, _columns(batch))]
            cuts = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                yield compare(*(x[lo:hi] for x in held[1:]))
            if len(cuts):
                held = [x[cuts[-1] :] for x in held]
        if len(held[0]):
            yield compare(*held[1:])

    return run


def _index(rows: DataFrame, chosen: list[tuple[int, ...]], refined: int = 0) -> DataFrame:
    """(key, fp, node and label if rows have one) of the postings of each choice, sorted by key.

    rows: fp, node and posting, the number of the fingerprint's table; or where postings are refined, the posting that a row
    was in, one of refined in each table, of which only the choices that refine it are made.
    """
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(BYTES)]
    size, keys = len(chosen[0]), []
    for n, c in enumerate(chosen):
        key = F.lit(n).cast("bigint")
        for p in c:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)
    keys, at = F.array(*keys), F.col("posting")
    if refined:
        own = len(chosen) // refined
        keys = F.slice(keys, (at % refined * own + 1).cast("int"), own)
        at = F.floor(at / refined)
    shift = F.shiftleft((at * len(chosen)).cast("bigint"), 8 * size)
    own = [c for c in ("fp", "node", "label") if c in rows.columns]
    out = rows.select(F.explode(keys).alias("k"), shift.alias("s"), *own)
    return out.select((F.col("k") + F.col("s")).alias("key"), *own).repartition("key").sortWithinPartitions("key")


def links(rows: DataFrame, least: int, bits: int, sure: int, block: int = BLOCK, small: int = 0) -> DataFrame:
    """a, b: links between nodes of rows (posting: the table's number; fp, distinct in its table; node; label, if some nodes are joined already).

    Nodes link whose fingerprints of a table share least bytes by position and differ in no more than bits. Of the links of
    a posting those are given that join what all join, near ones first, and of a posting of at most small rows all; none is
    given where sure bits or a label join the ends already.
    """
    chosen, own = choices(least), ["label"] * ("label" in rows.columns)
    rule = Rule(least, bits, sure, handled(chosen), 8 * len(chosen[0]))
    found, _ = store(_index(rows, chosen).mapInArrow(_search(rule, block, small), OUT + LABEL * len(own)), "postings")
    edges, later = found.where("block < 0").select("a", "b"), found.where("block >= 0")
    if len(chosen[0]) < least:  # pairs share one byte more
        hot = later.select(F.shiftright("key", rule.shift).alias("posting"), F.col("a").alias("fp"), F.col("b").alias("node"), *own)
        rule = Rule(least, bits, sure, handled(chosen, True), rule.shift + 8)
        found, _ = store(_index(hot, finer(chosen), len(chosen)).mapInArrow(_search(rule, block, small), OUT + LABEL * len(own)), "finer-postings")
        edges, later = edges.unionByName(found.where("block < 0").select("a", "b")), found.where("block >= 0")
    later = later.select("key", "block", F.col("a").alias("fp"), F.col("b").alias("node"), *own)
    blocks, _ = store(later.groupBy("key").agg((F.max("block") + 1).alias("n")), "hot-postings")
    units = later.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    units = units.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).cast("bigint").alias("side"), "key", "fp", "node", *own)
    more = units.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(_search_blocks(rule), "a bigint, b bigint")
    return edges.unionByName(more).distinct()


def link_fingerprints(fps: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join all that pairs within bits differing bits join.

    bits is at most 7, so that fingerprints within them share a byte.
    """
    return links(fps.select(F.lit(0).alias("posting"), "fp", F.col("fp").alias("node")), BYTES - bits, bits, bits, block)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs.

    component_id is the smallest doc_id that links of at most bits differing bits reach, the row's own included. Null,
    empty and blank texts have fingerprint zero and link like any other; fewer words than a shingle are one shingle.
    Equal fingerprints are one node, so copies cost one row each. A null doc_id gets the smallest id of its component,
    null if there is none. Repeated rows each get their own; an empty table gives none; other columns are left aside.
    """
    spark = docs.sparkSession
    each, each_path = store(fingerprints(docs, id_col, text, shingle), "fingerprints")
    with dropped_after(spark, keep := [each_path]):
        fps, _ = store(each.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
        nodes, _ = store(components(link_fingerprints(fps.select("fp"), bits, block)), "fingerprint-components")
        # Each step is a table, so that a join's two sides have shuffles of its own and Spark can split a hot key's partition.
        grouped, _ = store(fps.join(nodes.withColumnRenamed("node", "fp"), "fp"), "grouped-fingerprints")
        least, _ = store(grouped.groupBy("component").agg(F.min("rep").alias("least")), "least-ids")
        moved = grouped.join(least, "component").select("fp", "least")
        ids, path = store(fps.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "component-ids")
        keep.append(path)
    return each.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def expected_bits(similarity: float, n: int, spread: float) -> int:
    """Of n bits those that differ between sets of shingles of that similarity: the mean, and spread standard deviations more."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return max(0, math.floor(n * p + spread * math.sqrt(n * p * (1 - p))))


def _sets(rows: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """node, shingles (sorted distinct hashes, as bytes) of rows (node, text)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingle_hashes(t, shingle, seed)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "shingles"])
            trim()

    return rows.mapInArrow(run, "node bigint, shingles binary")


def parities(h: np.ndarray, groups: int = PARITIES) -> bytes:
    """For each of so many groups of hashes, a power of 2, whether h (distinct) holds an odd number of it: sets differ in as many hashes at least as these bits do."""
    group = h * _MIX[-1] >> np.uint64(64 - groups.bit_length() + 1)
    return np.packbits(np.bincount(group.astype(np.int64), minlength=groups) & 1 == 1).tobytes()


def fine_parities(h: np.ndarray) -> bytes:
    """parities() of as many groups as h has hashes at least: PARITIES of a large set are odd about as often as not, whatever it holds."""
    return parities(h, max(PARITIES, 1 << max(0, len(h) - 1).bit_length()))


def bits_apart(x: bytes, y: bytes) -> int:
    """How many parities of two sets differ; of groups in different numbers, those of the larger number are put together."""
    bits = [np.unpackbits(np.frombuffer(b, np.uint8)) for b in (x, y)]
    n = min(map(len, bits))
    return int(np.logical_xor(*(np.bitwise_xor.reduce(b.reshape(n, -1), axis=1) for b in bits)).sum())


def rarest(h: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Of the distinct hashes of a set so many, by counts and then by themselves, that sets of that similarity share one of theirs."""
    least = math.ceil(similarity * len(h) - 1e-9)  # hashes that are shared at least
    return h[np.lexsort((h, counts[_counter(h)]))[: len(h) - least + 1]]


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


_SKETCH = "text_hash bigint, own binary, fps array<bigint>, size bigint, bits binary, fine binary, slice int, counts binary"


def _sketches(rows: DataFrame, shingle: int, tables: int) -> DataFrame:
    """Of rows (doc_id, text_hash, text): 128 bits that tell sets of shingles apart, fingerprints, the set's size, parities and fine parities; and of each task its counts of shingles, in rows with a slice."""

    def row(of: list, like: pa.RecordBatch | None, schema: pa.Schema) -> pa.RecordBatch:
        n = len(of[2])
        first = [like.column(0), like.column(1)] if like is not None else [pa.nulls(n, schema.field(0).type), pa.nulls(n, pa.int64())]
        return pa.RecordBatch.from_arrays([*first, *(pa.array(x, f.type) if x else pa.nulls(n, f.type) for x, f in zip(of, list(schema)[2:]))], schema=schema)

    def run(batches):
        counts, schema = np.zeros(COUNTERS, np.uint32), None
        for b in batches:
            schema = pa.schema([("doc_id", b.schema.field(0).type), ("text_hash", pa.int64()), ("own", pa.binary()), ("fps", pa.list_(pa.int64())), ("size", pa.int64()), ("bits", pa.binary()), ("fine", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])
            own, fps, size, bits, fine = [], [], [], [], []
            for t in b.column(2).to_pylist():
                h = np.unique(shingle_hashes(t, shingle, 42))
                np.add.at(counts, _counter(h), 1)
                own.append(xxhash.xxh3_128_digest(h.tobytes()))
                fps.append(sketch_of(h, tables))
                size.append(len(h))
                bits.append(parities(h))
                fine.append(fine_parities(h))
            yield row([own, fps, size, bits, fine, [None] * len(own), None], b, schema)
            trim()
        if schema is not None:
            yield row([None, None, [0] * SLICES, None, None, list(range(SLICES)), [x.tobytes() for x in np.split(counts, SLICES)]], None, schema)

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {_SKETCH}")


def _counts(sketches: DataFrame) -> np.ndarray:
    """Counts of all tasks together, COUNTERS numbers whatever the corpus."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in rows.column("counts").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    got = sketches.where("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInArrow(run, "slice int, counts binary").collect()
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in sorted(got, key=lambda r: r["slice"]))])


def _shared(rows: DataFrame, shingle: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """h, o: those of the rarest shingles of rows (text) that sets of different o have, the first 64 bits of what tells sets apart."""
    sent = rows.sparkSession.sparkContext.broadcast(counts)

    def posted(batches):
        for b in batches:
            hs, os = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for t in b.column(0).to_pylist():
                h = np.unique(shingle_hashes(t, shingle, 42))
                if len(h):
                    hs.append(rarest(h, sent.value, similarity))
                    os.append(np.full(len(hs[-1]), np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), ">i8", 1)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(os).astype(np.int64))], ["h", "o"])
            trim()

    def several(batches):
        h, o, out = np.empty(0, np.int64), np.empty(0, np.int64), False  # the last row so far, and whether it has left
        for b in batches:
            if not b.num_rows:
                continue
            n = len(h)
            h, o = np.concatenate([h, b.column(0).to_numpy()]), np.concatenate([o, b.column(1).to_numpy()])
            new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]
            h, o = h[new], o[new]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            sizes = np.diff(np.r_[starts, len(h)])
            go = np.repeat(sizes > 1, sizes)
            if n and out:
                go[: sizes[0]] = True
            last = bool(go[-1])
            if n and out:
                go[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(h[go]), pa.array(o[go])], ["h", "o"])
            h, o, out = h[-1:], o[-1:], last

    return rows.mapInArrow(posted, "h bigint, o bigint").repartition("h").sortWithinPartitions("h", "o").mapInArrow(several, "h bigint, o bigint")


def _met(similarity: float, every: bool):
    """Over rows (unit, side, node, label, size, bits) sorted by unit: pairs of different labels that can be so similar by their sizes and
    parities. With every all of them, else those that join all that they join, near ones first. Rows of sides 0 and 1 meet the other side only."""

    def pairs(unit, side, node, label, size, bits):
        bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(unit), -1)
        found, all_pairs = Forest(len(unit), -1, label), []
        at, step = np.arange(len(unit)), 1
        while len(at := at[at + step < len(unit)]) and len(at := at[unit[at] == unit[at + step]]):
            i = at[(label[at] != label[at + step]) & ((side[at] == 2) | (side[at] != side[at + step]))]
            x, y = size[i], size[i + step]
            i = i[np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9]
            apart = np.bitwise_count(bits[i] ^ bits[i + step]).sum(axis=1, dtype=np.int64)
            near = apart <= (size[i] + size[i + step]) * (1 - similarity) / (1 + similarity) + 1e-9
            i, apart = i[near], apart[near]
            all_pairs.append((node[i], node[i + step])) if every else found.add(i, i + step, apart)
            step += 1
        if every:
            a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*all_pairs) if all_pairs else ([], [])))
        else:
            i, j = found.settle()
            a, b = node[i], node[j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def columns(b):
        return [*(c.to_numpy() for c in b.columns[:5]), np.array(b.column(5).to_pylist(), object)]

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = columns(b) if held is None else [np.concatenate(x) for x in zip(held, columns(b))]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last unit may go on
            if cut:
                yield pairs(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None:
            yield pairs(*held)

    return run


def _meetings(posted: DataFrame, labels: DataFrame, similarity: float, every: bool, block: int) -> DataFrame:
    """a, b: pairs of nodes of different labels that meet in a posting of posted (h, node, size, bits), as _met() has them. Postings of over block rows are compared in pairs of blocks."""
    rows = posted.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy("h").agg(F.ceil(F.count("*") / block).alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("h", "n")
    mixed, _ = store(mixed, "mixed-postings")
    rows = rows.join(mixed, "h").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise(F.when(F.col("own") < F.col("other"), 0).otherwise(1)).cast("bigint")
    units = rows.select(F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), side.alias("side"), "node", "label", "size", "bits")
    return store(units.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(_met(similarity, every), "a bigint, b bigint").distinct(), "candidates")[0]


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sets as _sets() has them; two empty ones are alike."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sizes and fine parities allow similarity; of large sets few others are left."""
    both = pairs
    for x in ("a", "b"):
        both = both.join(nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("fine").alias(f"fine_{x}")), x)

    def run(batches):
        for batch in batches:
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (1 - similarity) / (1 + similarity) + 1e-9
            apart = np.array([bits_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(apart <= most))

    return both.select("a", "b", "size_a", "size_b", "fine_a", "fine_b").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sets reach similarity. Sets are larger than their texts, so only those of pairs that can reach it are made, and they go with the step."""

    def run(batches):
        for batch in batches:
            near = [jaccard(x, y) >= similarity for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    with dropped_after(pairs.sparkSession, keep := []):
        pairs, _ = store(_possible(pairs, nodes, similarity), "possible-pairs")
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        asked, _ = store(nodes.join(ends, "node").select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "asked-documents")
        texts = rows.join(asked, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["text_hash"] == F.col("_hash"))).select("node", "text")
        sets, _ = store(_sets(texts, shingle).dropDuplicates(["node"]), "shingle-sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        links, path = store(both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "links")
        keep.append(path)
    return links


def _alike(own: DataFrame, one: DataFrame) -> DataFrame:
    """a, b: few edges that join all nodes that share a fingerprint in some table. own: posting, fp, node; one: the least node and the number of nodes of each.

    Each node is joined with the least of the largest group that it is in; other groups then join the least nodes of these.
    So a group of very many nodes has an edge a node, and not one for each table.
    """
    groups = one.withColumnRenamed("node", "least")
    labels = own.join(groups, ["posting", "fp"]).groupBy("node").agg(F.max(F.struct("n", (-F.col("least")).alias("m"))).alias("g")).select("node", (-F.col("g.m")).alias("label"))
    labels, _ = store(labels, "labels")
    rows, _ = store(own.join(labels, "node").select("posting", "fp", "label").distinct(), "labelled-fingerprints")
    least, _ = store(rows.groupBy("posting", "fp").agg(F.min("label").alias("b")), "least-labels")
    across = rows.join(least, ["posting", "fp"]).where("label <> b").select(F.col("label").alias("a"), "b").distinct()
    edges, _ = store(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(across), "alike")
    return edges


def near_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash (Spark's xxhash64 of the text), component_id, kept of every row of docs.

    Documents link at a Jaccard similarity of their word shingles (A-Z lower-cased) of similarity or more: all that do, and no
    others. Equal sets of shingles are one node. Nodes that share a fingerprint of tables, or whose first ones are near, are
    verified first, so that large groups of near copies are joined by few pairs. All other pairs are found by postings of
    each node's rarest shingles (by counts of hashes' first bits, any order that all share would do): sets of that
    similarity share one of them. Of a posting those pairs are left that are not joined yet and whose sizes and parities
    allow the similarity; first as many as join all of these, nearest first, and when they are verified all that remain.

    component_id is the smallest doc_id that links reach, and the row that has it is kept; of several rows with that id,
    those of the text of least hash. Blank texts are alike; a text of fewer words than a shingle is one shingle. A null
    doc_id gets the smallest id of its component, null if there is none. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sketches, each_path = store(_sketches(rows, shingle, tables), "sketches")
    each = sketches.where("slice IS NULL")
    first = lambda: F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("rep")
    with dropped_after(spark, keep := [each_path]):
        nodes = each.groupBy("own").agg(first(), *[F.any_value(c).alias(c) for c in ("fps", "size", "bits", "fine")])
        nodes, _ = store(nodes.select(F.monotonically_increasing_id().alias("node"), "own", "fps", "size", "bits", "fine", "rep.doc_id", "rep.text_hash"), "nodes")
        own = nodes.select("node", F.posexplode("fps").alias("posting", "fp"))
        one, _ = store(own.groupBy("posting", "fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "table-fingerprints")
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("fps").alias(f"fps_{x}"))
        apart = F.aggregate(F.zip_with("fps_a", "fps_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        pairs = links(one.where("posting = 0").select("posting", "fp", "node"), LEAST, expected_bits(similarity, 64 - 8 * LEAST, 2.0), expected_bits(similarity, 64, -3.0), block)
        pairs, _ = store(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "fingerprint-links")
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= expected_bits(similarity, 64 * tables, -4.0)).select("a", "b")
        begun, _ = store(pairs.unionByName(_alike(own, one)).distinct(), "first-candidates")
        verified = _verified(begun, nodes, rows, shingle, similarity)
        found, _ = store(components(verified), "document-components")

        shared, shared_path = store(_shared(rows.select("text"), shingle, similarity, _counts(sketches)), "shared-shingles")
        facts = nodes.select(F.conv(F.hex(F.substring("own", 1, 8)), 16, -10).cast("bigint").alias("o"), "node", "size", "bits")
        posted, _ = store(shared.join(facts, "o").select("h", "node", "size", "bits"), "postings")
        drop(spark, shared_path)
        for every in (False, True):
            more = _verified(_meetings(posted, found, similarity, every, block), nodes, rows, shingle, similarity)
            if not more.isEmpty():
                verified = verified.unionByName(more)
                found, _ = store(components(verified), "document-components")
        named, _ = store(nodes.join(found, "node"), "grouped-documents")
        least, _ = store(named.groupBy("component").agg(first()), "least-documents")
        moved = named.join(least, "component").select("node", "rep")
        alone = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
        out, path = store(nodes.join(moved, "node", "left").select("own", F.coalesce("rep", alone).alias("rep")), "document-ids")
        keep.append(path)
    stays = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_hash") == F.col("rep.text_hash"))
    return each.join(out, "own").select("doc_id", "text_hash", F.col("rep.doc_id").alias("component_id"), stays.alias("kept"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
