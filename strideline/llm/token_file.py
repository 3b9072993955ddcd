"""Token ids in fixed-width bit packing.

A token file is a Parquet folder of blocks. A block holds whole documents, in ascending doc_id order, of about
`block_ids` ids, each id in the fewest bits that hold the vocabulary, least significant bit first. Beside the packed
bytes it has its place (`shard`, `block`, `first` = ids of the shard before it) and its documents' ids and counts, so
that one document is read by its block and bit offset, without unpacking what stands before it.

Documents are range partitioned on doc_id; a partition is a shard. Files are committed by Spark's writer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.llm.common import shared_path
from strideline.llm.tokens import batches_of, word_encoder

BLOCKS = "shard int, block int, first long, n_ids long, bits int, payload binary, doc_ids array<long>, counts array<long>"
BLOCK_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)
READ = "doc_id long, shard int, first long, n_tokens long, ids_crc32 long"
READ_SCHEMA = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, `bits` bits each, least significant first. Widths of whole machine words need no shifting."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1, bitorder="little").tobytes()


def unpack_bits(payload, bits: int, start: int, n: int) -> np.ndarray:
    """`n` ids from the `start`-th on, reading only the bytes that hold them."""
    lo = start * bits
    raw = np.frombuffer(payload, np.uint8)[lo // 8 : (lo + n * bits + 7) // 8]
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}").astype(np.uint32)
    flat = np.unpackbits(raw, bitorder="little")[lo % 8 : lo % 8 + n * bits].reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = 1 << 16) -> None:
    """Encode `text` of every row of `docs`, close it with `end_id`, and write the blocks below `path`.

    NULL and empty texts are the end id alone; a NULL doc_id comes first; rows with equal doc_id stay separate, by
    text; other columns are ignored; an empty table writes no block. One text is never split over blocks.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        bits, shard = width(encoder.vocabulary), TaskContext.get().partitionId()
        held, held_ids, n, first, block = [], [], 0, 0, 0

        def close():
            ids = np.concatenate(held)
            row = [[shard], [block], [first], [n], [bits], [pack_bits(ids, bits)], [held_ids], [[len(x) for x in held]]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, BLOCK_SCHEMA)], schema=BLOCK_SCHEMA)

        for big in batches:
            for b in batches_of(big):
                for doc, ids in zip(b.column(0).to_pylist(), encoder.ids(b.column(1).to_pylist(), end_id)):
                    held.append(ids)
                    held_ids.append(doc)
                    n += len(ids)
                    if n >= block_ids:
                        yield close()
                        first, block, held, held_ids, n = first + n, block + 1, [], [], 0
        if held:
            yield close()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    d.mapInArrow(blocks, BLOCKS).write.parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the file: `doc_id, start, n_tokens, ids_crc32`, read from the packed ids."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, bits, payload, docs, counts in zip(*[b.column(k) for k in range(6)]):
                starts = np.concatenate([[0], np.cumsum(counts.as_py())])
                data, wide = payload.as_buffer(), bits.as_py()
                crcs = [zlib.crc32(unpack_bits(data, wide, int(a), int(z - a)).astype("<u4").tobytes()) for a, z in zip(starts, starts[1:])]
                rows = [docs.as_py(), [shard.as_py()] * len(crcs), (first.as_py() + starts[:-1]).tolist(), counts.as_py(), crcs]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, READ_SCHEMA)], schema=READ_SCHEMA)

    blocks = spark.read.schema(BLOCKS).parquet(path)
    before = W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    # one row per shard, that is per written partition
    offsets = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n")).select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = blocks.select("shard", "first", "bits", "payload", "doc_ids", "counts").mapInArrow(documents, READ)
    return found.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("_before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """The ids of one document, by random access: one block is fetched, and only its bits are unpacked."""
    blocks = spark.read.schema(BLOCKS).parquet(path).filter(F.array_contains("doc_ids", doc_id)).select("bits", "payload", "doc_ids", "counts")
    row = blocks.first()
    if row is None:
        return []
    at = row.doc_ids.index(doc_id)
    return unpack_bits(bytes(row.payload), row.bits, sum(row.counts[:at]), row.counts[at]).tolist()


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    path = shared_path(docs.sparkSession, "tokens")
    write_token_file(docs, path, tokenizer, end_id)
    return read_token_file(docs.sparkSession, path)
