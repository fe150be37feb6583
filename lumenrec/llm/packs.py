"""Packs of documents, and questions that packs put to all of the corpus.

A pack holds some megabytes of whole documents in one compressed cell. Where a count over the corpus is needed, each
pack sends the keys that it holds to shards of the key space, as one sorted array a shard and each key once. A shard
counts over the packs and answers each with an array in the order of its keys, often a bit a key. So a frequent key
costs one entry a pack and every shard gets its even part of the hashed keys, however the keys are distributed.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

PACK = 3_000_000  # characters a pack, but for a document that is longer by itself
SHARD = 16_000_000  # characters of the corpus for each shard
ASKED = "shard int, pack bigint, data binary"
ANSWER = "pack bigint, shard int, data binary"


def trim() -> None:
    """Give freed memory back, as a worker lives on through stages that need less."""
    pa.default_memory_pool().release_unused()
    if (give_back := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        give_back(0)


def _pack_bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> tuple[list[bytes], pa.Table]:
    """UTF-8 texts of a pack, empty for a null text, and all its rows."""
    rows = pa.ipc.open_stream(data).read_all().combine_chunks()
    return [t or b"" for t in rows.column("text").cast(pa.large_binary()).to_pylist()], rows


def _cut(docs: DataFrame, size: int, row, schema: str) -> DataFrame:
    """row(table, chars) of each size characters of docs, whole rows of all its columns; docs has a column text."""
    at_text = docs.columns.index("text")

    def run(batches):
        held, room = [], size
        for b in batches:
            sizes = np.fromiter((len(t or "") for t in b.column(at_text).to_pylist()), np.int64, b.num_rows)
            at = 0
            while at < b.num_rows:
                n = min(int(np.searchsorted(np.cumsum(sizes[at:]), room, "left")) + 1, b.num_rows - at)
                held.append(pa.Table.from_batches([b.slice(at, n)]))
                room -= int(sizes[at : at + n].sum())
                at += n
                if room <= 0:
                    yield row(pa.concat_tables(held).combine_chunks(), size - room)
                    held, room = [], size
                    trim()
        if held:
            yield row(pa.concat_tables(held).combine_chunks(), size - room)

    return docs.mapInArrow(run, schema)


def _number() -> int:
    """Of a pack; the stored row keeps it."""
    return uuid.uuid4().int >> 65


def pack(docs: DataFrame, size: int = PACK) -> tuple[DataFrame, int]:
    """(pack, chars, data) of all rows and columns of docs, stored; and how many shards the corpus needs. docs has a column text."""
    names = ["pack", "chars", "data"]
    row = lambda rows, chars: pa.RecordBatch.from_arrays([pa.array([_number()], pa.int64()), pa.array([chars], pa.int64()), pa.array([_pack_bytes(rows)], pa.binary())], names)
    packs, _ = store(_cut(docs, size, row, "pack bigint, chars bigint, data binary"), "packs")
    return packs, shards_for(packs)


def pack_rows(docs: DataFrame, body, keep: list[str], size: int = PACK) -> tuple[DataFrame, str]:
    """(pack, chars, rows, body) of all rows of docs, stored, and where: the columns in keep, and what body(table) makes of a pack."""
    names = ["pack", "chars", "rows", "body"]

    def row(rows: pa.Table, chars: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_number()], pa.int64()), pa.array([chars], pa.int64()), pa.array([_pack_bytes(rows.select(keep))], pa.binary()), pa.array([body(rows)], pa.binary())], names)

    return store(_cut(docs, size, row, "pack bigint, chars bigint, rows binary, body binary"), "token-packs")


def shards_for(packs: DataFrame) -> int:
    return max(1, -(-(packs.agg(F.sum("chars")).first()[0] or 0) // SHARD))


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted unsigned 64-bit keys: the shards that have any, and where each one's keys begin, with the end of all."""
    own = np.minimum(keys // np.uint64(min((1 << 64) // shards, (1 << 64) - 1)), np.uint64(shards - 1)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    return own[starts], np.r_[starts, len(keys)].astype(np.int64)


def batch(schema: str, *columns) -> pa.RecordBatch:
    """A batch of (shard, pack, data) or (pack, shard, data) columns, by the names in schema."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for (_, k), c in zip(fields, columns)], [n for n, _ in fields])


def ask_rows(asked: DataFrame, handle) -> DataFrame:
    """handle(shard, packs, list of data) for each shard, which gives (pack, data) of any number; gives (pack, shard, data)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        out = handle(shard, rows.column("pack").to_pylist(), rows.column("data").to_pylist())
        trim()
        return pa.table({"pack": pa.array([p for p, _ in out], pa.int64()), "shard": pa.array([shard] * len(out), pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})

    return asked.groupBy("shard").applyInArrow(run, ANSWER)


def ask(asked: DataFrame, handle) -> DataFrame:
    """handle(shard, list of data) for each shard, which gives the answers in the order of data; gives (pack, shard, data)."""
    return ask_rows(asked, lambda shard, packs, data: [*zip(packs, handle(shard, data))])


def told(packs: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """packs with the answers to each as an array of (shard, data).

    Always by a merge join: answers grow with the corpus, so they are not for broadcasting at any size.
    """
    return packs.join(answers.groupBy("pack").agg(F.collect_list(F.struct("shard", "data")).alias(name)).hint("merge"), "pack", "left")


def in_order(answers: list | None) -> dict[int, bytes]:
    return {a["shard"]: a["data"] for a in answers or []}
