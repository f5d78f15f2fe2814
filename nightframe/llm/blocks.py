"""Shared pieces of the text operators: buckets of documents, word splitting, packed arrays.

Documents are dealt into buckets by a hash of their id. A bucket is the unit that one
Python call sees, so its size bounds that call's memory, and every message between two
steps is first made unique inside the bucket: a text, line or word that fills a third of
the corpus sends one message a bucket, not one a document.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, ensure_checkpoint_dir, ship

#: Bytes of text that one bucket holds on average, at most.
BUCKET_BYTES = 32 << 20
#: Bytes of a table of ids or words that may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Ids that are null sort after every other id.
NULL_ID = np.iinfo(np.int64).max


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, for rows that are read more than once and
    only in part; like checkpoints, the table stays until that folder is cleared."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if it has been counted to be small; else Spark joins it by a shuffle.
    It is written first, so that counting does not work it out twice."""
    df = checkpointed(df)
    width = sum(_WIDTH.get(kind, 40) for _, kind in df.dtypes) + 16
    return F.broadcast(df) if df.count() * width <= most else df


#: Bytes of a value in a broadcast table; those of other kinds count as 40.
_WIDTH = {"int": 8, "bigint": 8, "double": 8, "boolean": 8}


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(docs: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for all of docs: two a shuffle partition, or more if they would be too large."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(2 * shuffle_partitions(docs.sparkSession), -(-int(total) // bucket_bytes))


def part_count(buckets: int) -> int:
    """Parts that own the hashes which buckets send: fewer than buckets, as each pair of a
    bucket and a part is a message."""
    return -(-buckets // 2)


def bucketed(docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, doc_id, text. The same frame for every step, so that Spark reuses its exchange.
    The text counts as well, so rows that share an id, or have none, spread over all buckets."""
    ids, t = F.col(doc_id).cast("long"), F.col(text).cast("string")
    return docs.select(F.pmod(F.xxhash64(ids, t), F.lit(n)).cast("int").alias("bucket"), ids.alias("doc_id"), t.alias("text"))


#: Messages of fewer bytes are not compressed.
PLAIN = 200


def pack(**arrays) -> bytes:
    """Arrays and bytes by name. A message has some ten bytes besides its values, as with many
    buckets a message may hold a single hash."""
    out = [b""]
    for name, x in arrays.items():
        if not isinstance(x, bytes):
            x = np.atleast_1d(x)
        kind, data = ("b", x) if isinstance(x, bytes) else (x.dtype.str[1:], x.tobytes())
        out.append(struct.pack("<BBI", len(name), len(kind), len(data)) + name.encode() + kind.encode())
        out.append(data)
    flat = b"".join(out)
    return b"\0" + flat if len(flat) < PLAIN else b"\1" + zstandard.ZstdCompressor(level=1).compress(flat)


def unpack(data: bytes) -> dict:
    flat = memoryview(data[1:] if data[0] == 0 else zstandard.ZstdDecompressor().decompress(data[1:]))
    out, at = {}, 0
    while at < len(flat):
        n, k, size = struct.unpack_from("<BBI", flat, at)
        at += 6
        name, kind = bytes(flat[at : at + n]).decode(), bytes(flat[at + n : at + n + k]).decode()
        at += n + k
        raw = flat[at : at + size]
        out[name] = bytes(raw) if kind == "b" else np.frombuffer(raw, kind)
        at += size
    return out


class Bucket:
    """The rows of one bucket in a fixed order: by id, then by text. Row numbers are the
    same in every step, whatever order the shuffle delivered, as rows that tie are equal."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        ids = table["doc_id"]
        self.ids = pc.fill_null(ids, NULL_ID).to_numpy().astype(np.int64)
        texts = pc.fill_null(table["text"], "").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks == 1 else texts
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        order = np.argsort(self.ids, kind="stable")
        if len(self.ids) and (np.diff(self.ids[order]) == 0).any():
            tie = np.array([xxhash.xxh3_64_intdigest(x.as_buffer()) if x.is_valid else 0 for x in texts], np.uint64)
            order = np.lexsort((tie, self.ids))
        if not np.array_equal(order, np.arange(len(order))):
            self.ids, texts, ids = self.ids[order], texts.take(pa.array(order)), ids.take(pa.array(order))
        self.texts, self.doc_id = texts, ids

    def __len__(self) -> int:
        return len(self.ids)

    def bytes_and_offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """All texts as one array of UTF-8 bytes, and where each begins."""
        if not len(self.texts):
            return np.zeros(0, np.uint8), np.zeros(1, np.int64)
        wide = self.texts.type == pa.large_string()
        _, offsets, data = self.texts.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[self.texts.offset : self.texts.offset + len(self.texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return raw[at[0] : at[-1]], at - at[0]


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash; forgets all when it grows beyond a bound."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = WordHashes()


def space_words(text: bytes) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+: what bytes.split() does."""
    return text.split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array: where each run of equal values begins, and the run number of each element."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def ranges(keys: np.ndarray) -> list[tuple[int, int]]:
    """Of a sorted array: where each run of equal values begins and ends."""
    begin, _ = grouped(keys)
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(keys)][: len(begin)], strict=True))
