"""Conflict-constrained best-fit packing of documents into training sequences.

Pieces go, longest first, into the tightest bin that has room and no conflict. Bins are ordered by residual room and
carry a bitmap of their sources and one of their duplicate clusters; the search for a bin starts at the first with
enough room and goes on to its successors until the bitmaps allow one. Clusters are documents that links of SimHash
fingerprints join. Documents are dealt to shards by hash, so that a source with a third of all rows has a third of each
shard, and shards are packed apart.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dropped_after, store, table
from .simhash import fingerprint, link_fingerprints

CAPACITY = 2_048  # words of a bin
SHINGLE, BITS = 5, 4  # of the fingerprints that make clusters
SHARD_ROWS, SHARD_CHARS = 4_096, 32_000_000  # documents and characters that are packed together, about
_SPANS = re.compile(r"[^\x20\x09-\x0D]+").finditer


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int = 1) -> tuple[list[int], int]:
    """The bin of each piece, all of 1 to capacity, and how many bins there are. Pieces are placed in the order given.

    A bin holds one document of a cluster, and per_source of a source at most: its k-th source bitmap has the sources of
    which it holds k or more, so a source is full in the last.
    """
    source_bit: dict = {}
    many: dict = {}
    for c in clusters:
        many[c] = many.get(c, 0) + 1
    cluster_bit: dict = {}
    open_bins: list[tuple[int, int]] = []  # residual room, bin
    maps: list[list[int]] = [[] for _ in range(per_source)]
    full, cluster_map, out = maps[-1], [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        s = 1 << source_bit.setdefault(source, len(source_bit))
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit)) if many[cluster] > 1 else 0  # a cluster of one conflicts with nothing
        k = bisect_left(open_bins, (size, -1))
        while k < len(open_bins) and (full[open_bins[k][1]] & s or cluster_map[open_bins[k][1]] & c):
            k += 1
        if k < len(open_bins):
            room, b = open_bins.pop(k)
        else:
            room, b = capacity, len(cluster_map)
            cluster_map.append(0)
            for m in maps:
                m.append(0)
        cluster_map[b] |= c
        next(m for m in maps if not m[b] & s)[b] |= s
        if room > size:
            insort(open_bins, (room - size, b))
        out.append(b)
    return out, len(cluster_map)


def measured(docs: DataFrame, id_col: str, text: str, source: str, cluster: str | None, keep_text: bool) -> DataFrame:
    """doc_id, source, cluster, n_words, salt of every row, and its text if it is kept. The salt is of a row's place in docs: rows alike in all else differ in it. Without a column cluster it is the component of the row's fingerprint."""
    columns = [F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster") if cluster else F.lit(None).cast("string").alias("cluster"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("salt")]
    docs = docs.select(columns)
    names = ["doc_id", "source", "cluster", "n_words", "salt", "fp", "text"]

    def run(batches):
        for b in batches:
            texts = b.column(3).to_pylist()
            words = pa.array([len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts], pa.int64())
            fps = pa.array([None if cluster else fingerprint(t, SHINGLE) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], words, b.column(4), fps, *[b.column(3)] * keep_text], names[: 6 + keep_text])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.mapInArrow(run, f"doc_id {kind}, source string, cluster string, n_words bigint, salt bigint, fp bigint" + ", text string" * keep_text)
    if cluster:
        return out.drop("fp")
    out, path = store(out, "measured")
    with dropped_after(docs.sparkSession, keep := [path]):
        fps, _ = store(out.select("fp").distinct(), "distinct-fingerprints")
        nodes, path = store(components(link_fingerprints(fps, BITS)), "fingerprint-components")
        keep.append(path)
    out = out.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("cluster", F.coalesce("component", "fp").cast("string"))
    return out.select([n for n in names if n != "fp"][: 5 + keep_text])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, capacity: int = CAPACITY, keep_text: bool = False, shard_rows: int = SHARD_ROWS, per_source: int = 1) -> DataFrame:
    """Pieces of all rows of docs: doc_id, part, start, n_words, bin_id, position, bin_words, and the piece's text if kept.

    No bin holds more than capacity words, two documents of a duplicate cluster, or more than per_source of a source.
    cluster names a column of cluster ids; without it, documents are a cluster whose fingerprints, of shingles of five words,
    links of at most four differing bits join, copies with them. A null source or cluster conflicts with nothing. A
    document of more than capacity words is cut into whole bins and a last piece. start and position count words from the
    document's and the bin's beginning. Rows without words (null, empty or blank texts) are one piece without a bin.
    Repeated rows are pieces of a cluster of their own; an empty table gives none; other columns of docs are left aside.
    """
    rows, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length(F.col(text))), F.lit(0))).first()
    shards = max(1, -(-rows // shard_rows), -(-chars // SHARD_CHARS))
    each = measured(docs, id_col, text, source, cluster, keep_text)
    each = each.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_words", "cluster", "salt"), F.lit(shards)).cast("int"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        t = t.combine_chunks()
        n = np.asarray(t.column("n_words").combine_chunks()) if t.num_rows else np.empty(0, np.int64)
        ids, source_of, cluster_of = (t.column(c).to_pylist() for c in ("doc_id", "source", "cluster"))
        whole = n // capacity
        rest = n - whole * capacity
        last = np.flatnonzero(rest > 0)
        tie = [xxhash.xxh3_64_intdigest(f"{ids[k]} {cluster_of[k]}") for k in last.tolist()]
        last = last[np.lexsort((tie, -rest[last]))].tolist()
        alone = lambda v, k: v if v is not None else ("", k)
        bins, used = best_fit([int(rest[k]) for k in last], [alone(source_of[k], k) for k in last], [alone(cluster_of[k], k) for k in last], capacity, per_source)
        row, part, bin_id = [*last], [int(whole[k]) for k in last], [*bins]
        for k in np.flatnonzero(whole).tolist():
            for p in range(int(whole[k])):
                row.append(k)
                part.append(p)
                bin_id.append(used)
                used += 1
        size = [int(min(capacity, n[k] - p * capacity)) for k, p in zip(row, part)]
        filled = np.bincount(bin_id, size, used).astype(np.int64) if row else np.empty(0, np.int64)
        at, position = [0] * used, []
        for b, s in zip(bin_id, size):
            position.append(at[b])
            at[b] += s
        empty = np.flatnonzero(n == 0).tolist()
        none = [None] * len(empty)
        columns = {
            "doc_id": t.column("doc_id").take(pa.array(row + empty, pa.int64())),
            "part": pa.array(part + [0] * len(empty), pa.int64()),
            "start": pa.array([p * capacity for p in part] + [0] * len(empty), pa.int64()),
            "n_words": pa.array(size + [0] * len(empty), pa.int64()),
            "bin_id": pa.array([(shard << 32) + b for b in bin_id] + none, pa.int64()),
            "position": pa.array(position + none, pa.int64()),
            "bin_words": pa.array([int(filled[b]) for b in bin_id] + none, pa.int64()),
        }
        if keep_text:
            texts = t.column("text").to_pylist()
            spans = {k: [m.span() for m in _SPANS(texts[k])] for k in np.flatnonzero(whole).tolist()}
            pieces = [texts[k][spans[k][p * capacity][0] : spans[k][p * capacity + s - 1][1]] if k in spans else texts[k] for k, p, s in zip(row, part, size)]
            columns["text"] = pa.array(pieces + [texts[k] for k in empty], pa.string())
        return pa.table(columns)

    kind = dict(each.dtypes)["doc_id"]
    schema = f"doc_id {kind}, part bigint, start bigint, n_words bigint, bin_id bigint, position bigint, bin_words bigint"
    return each.groupBy("shard").applyInArrow(run, schema + ", text string" * keep_text)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
