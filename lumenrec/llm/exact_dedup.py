"""Exact dedup by content-defined chunk recipes.

A text is cut where its own bytes say so, so equal stretches give equal chunks wherever they stand. Each distinct chunk
travels once, to be verified byte for byte under its hash; after that a document is the ordered list of its chunks'
identifiers, and documents are compared by those lists. Long texts themselves are never moved.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table
from .packs import trim

WINDOW = 16  # bytes that decide whether a chunk ends
LEAST, MOST = 256, 8192  # bytes of a chunk
MASK = np.uint32(0x3FF << 20)  # one place in 1024
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)
_MULTIPLIER = np.uint32(0x2C1B3C6D)


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of data end. The end of a chunk depends on the WINDOW bytes before it and on the chunk's start."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    ends, start = [], 0
    block = 1 << 20  # bytes hashed at a time, so long texts need no more memory
    marks = []
    for lo in range(0, n, block):
        part = _GEAR[np.frombuffer(data[max(0, lo - WINDOW + 1) : lo + block], np.uint8)]
        h = part.copy()
        for k in range(1, WINDOW):
            h[k:] += part[:-k] << np.uint32(k)
        at = np.flatnonzero((h * _MULTIPLIER & MASK) == 0) + 1 + max(0, lo - WINDOW + 1)
        marks += at[at > lo].tolist()
    for end in [*marks, n]:
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST or end == n and end > start:
            ends.append(end)
            start = end
    return ends


def _chunks(text: str | None) -> tuple[bytes, list[bytes]]:
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only
    ends = chunk_ends(data)
    return data, [data[a:b] for a, b in zip([0, *ends], ends)]


def _hash(chunk: bytes, bits: int) -> int:
    return (xxhash.xxh3_64_intdigest(chunk) >> (64 - bits)) - (1 << 63 if bits == 64 else 0)


def _recipes(bits: int):
    def run(batches):
        for b in batches:
            digests, recipes = [], []
            for text in b.column(1).to_pylist():
                data, chunks = _chunks(text)
                digests.append(hashlib.sha256(data).hexdigest())
                recipes.append([_hash(c, bits) for c in chunks])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(recipes, pa.list_(pa.int64())), pa.array(digests, pa.string())], ["doc_id", "text_hash", "recipe", "text_sha256"])
            trim()

    return run


def _distinct_chunks(bits: int):
    def run(batches):
        for b in batches:
            seen = {c for text in b.column(1).to_pylist() for c in _chunks(text)[1]}
            yield pa.RecordBatch.from_arrays([pa.array([_hash(c, bits) for c in seen], pa.int64()), pa.array(list(seen), pa.binary())], ["h", "chunk"])
            del seen
            trim()

    return run


def recipes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hash_bits: int = 64) -> DataFrame:
    """doc_id, text_hash, recipe, text_sha256 of every row. recipe: verified chunk identifiers, in order; text_hash: Spark's xxhash64 of the text.

    An identifier is the chunk's hash, and where different chunks share a hash, also the chunk's rank among them. Such
    hashes are found by grouping the distinct chunks themselves; only then are recipes taken apart to be given ranks.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    hashed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = hashed.mapInArrow(_recipes(hash_bits), f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash bigint, recipe array<bigint>, text_sha256 string")
    chunks = docs.mapInArrow(_distinct_chunks(hash_bits), "h bigint, chunk binary").distinct()
    clash = chunks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    if clash.isEmpty():
        return out
    ranked = chunks.join(clash, "h", "left_semi").select("h", "chunk", F.sha2("chunk", 256).alias("s"))
    ranked = ranked.join(ranked.groupBy("h").agg(F.sort_array(F.collect_set("chunk")).alias("all")), "h")
    ranked = ranked.select("h", "s", F.array_position("all", F.col("chunk")).cast("bigint").alias("r"))

    def placed(batches):
        for b in batches:
            rows = []
            for n, text in enumerate(b.column(1).to_pylist()):
                rows += [(n, k, _hash(c, hash_bits), hashlib.sha256(c).hexdigest()) for k, c in enumerate(_chunks(text)[1])]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            keys = [b.column(0)[i].as_py() for i in cols[0]]
            digests = [hashlib.sha256(_chunks(t)[0]).hexdigest() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array([digests[i] for i in cols[0]], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["doc_id", "text_sha256", "k", "h", "s"])

    # Rows that share doc_id and digest have one text, so a set of (place, identifier) is their recipe.
    parts = docs.mapInArrow(placed, f"doc_id {dict(docs.dtypes)['doc_id']}, text_sha256 string, k bigint, h bigint, s string")
    parts = parts.join(ranked, ["h", "s"], "left").groupBy("doc_id", "text_sha256")
    fixed = parts.agg(F.sort_array(F.collect_set(F.struct("k", "h", F.coalesce("r", F.lit(0)).alias("r")))).alias("p"))
    fixed = fixed.select("doc_id", "text_sha256", F.flatten(F.transform("p", lambda x: F.array(x["h"], x["r"]))).alias("fixed"))
    both = out.alias("o").join(fixed.alias("f"), F.col("o.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("o.text_sha256") == F.col("f.text_sha256")), "left")
    return both.select("o.doc_id", "o.text_hash", F.coalesce("f.fixed", "o.recipe").alias("recipe"), "o.text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_hash (Spark's xxhash64 of the text as it is) of every row of docs.

    Texts are equal when identical after lower-casing A-Z. The row with the largest doc_id of a group stays. A null text
    counts as empty, and empty texts are one group. A null doc_id is smaller than any other; in a group without any id
    keep_id is null and every row stays. Rows that repeat the largest doc_id stay together, as nothing tells them apart.
    An empty table gives no rows; other columns of docs are left aside.
    """
    each, _ = store(recipes(docs, id_col, text, hash_bits), "recipes")  # both sides below read it
    groups, _ = store(each.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "recipe-groups")
    # Groups are read from a table, not joined as they come from their aggregation: so both sides of the join have
    # shuffles of its own, and Spark can split the partition of a recipe that very many rows have.
    return each.join(groups, "recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "text_hash")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


OP7_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
