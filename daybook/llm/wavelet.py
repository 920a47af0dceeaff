"""Token files as wavelet matrices: one bit-plane per id bit, with rank and select, in one compressed blob per shard.

Documents are range-partitioned and sorted by id; every task cuts its run of documents into shards of bounded size, and
Spark's writer commits them, so a lost task leaves nothing behind. A shard answers access, count, rank and the places of
an id without being decoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm import tokens
from daybook.llm.common import partitions_for, work_dir

MAGIC = b"DWM1"
BLOCK = 512  # bits for one entry of the rank directory


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max(initial=0))
        a, planes, zeros, ranks = ids.astype(np.uint16 if top < 1 << 16 else np.uint32), [], [], []
        for k in reversed(range(max(1, top.bit_length()))):
            one = (a & a.dtype.type(1 << k)).astype(bool)
            bits = np.packbits(one)
            blocks = np.zeros(-(-len(a) // BLOCK) * (BLOCK >> 3), np.uint8)
            blocks[: len(bits)] = bits
            ones = np.bitwise_count(blocks.view("<u8")).reshape(-1, BLOCK >> 6).sum(axis=1, dtype=np.uint32)
            planes.append(bits)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4"))
            zeros.append(len(a) - int(ranks[-1][-1]))
            b = np.empty_like(a)
            np.compress(~one, a, out=b[: zeros[-1]])
            np.compress(one, a, out=b[zeros[-1] :])
            a = b
        return cls(len(ids), planes, zeros, ranks)

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        body = [pack(x.tobytes()) for pair in zip(self.planes, self.ranks, strict=True) for x in pair]
        head = MAGIC + struct.pack("<QI", self.n, len(self.planes)) + struct.pack(f"<{len(self.zeros)}Q", *self.zeros)
        return head + struct.pack(f"<{len(body)}Q", *map(len, body)) + b"".join(body)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, levels = struct.unpack_from("<QI", raw, 4)
        zeros = list(struct.unpack_from(f"<{levels}Q", raw, 16))
        sizes = struct.unpack_from(f"<{2 * levels}Q", raw, 16 + 8 * levels)
        at, parts, unpack = 16 + 24 * levels, [], zstandard.ZstdDecompressor().decompress
        for s in sizes:
            parts.append(unpack(raw[at : at + s]))
            at += s
        return cls(n, [np.frombuffer(x, np.uint8) for x in parts[::2]], zeros, [np.frombuffer(x, "<u4") for x in parts[1::2]])

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (7 - (i & 7))) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block = i // BLOCK
        bits = np.unpackbits(self.planes[level][block * BLOCK >> 3 : (i + 7) >> 3])[: i - block * BLOCK]
        return int(self.ranks[level][block]) + int(bits.sum())

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            b, r = self.bit(level, i), self.rank1(level, i)
            value, i = value << 1 | b, self.zeros[level] + r if b else i - r
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            one = token >> (len(self.planes) - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the id before place i."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, nth: int) -> int:
        """Place of the nth occurrence (from 0)."""
        lo, hi = self._range(token, self.n)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        i = lo + nth
        for level in reversed(range(len(self.planes))):
            one = i >= self.zeros[level]
            want, low, high = i - self.zeros[level] if one else i, 0, self.n
            while low < high:  # first place with want + 1 bits of the kind up to and with it
                mid = (low + high) // 2
                ones = self.rank1(level, mid + 1)
                low, high = (low, mid) if (ones if one else mid + 1 - ones) > want else (mid + 1, high)
            i = low
        return i

    def decode(self) -> np.ndarray:
        a = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in reversed(range(len(self.planes))):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            low, high = a[: self.zeros[level]], a[self.zeros[level] :]
            up = np.empty_like(a)
            up[np.flatnonzero(one)] = high | a.dtype.type(1 << (len(self.planes) - 1 - level))
            up[np.flatnonzero(~one)] = low
            a = up
        return a.astype(np.uint32)


SHARDS = "part int, seq int, doc_ids array<long>, lengths array<long>, n_tokens long, payload binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_tokens: int = 1 << 20, partition_bytes: int = 48 << 20) -> None:
    """Shards of at most ``shard_tokens`` ids (a longer document has one of its own) in ascending doc_id order."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = docs.select("doc_id", "text").repartitionByRange(partitions_for(spark, size, partition_bytes), "doc_id").sortWithinPartitions("doc_id", F.crc32("text"))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, parts, held = [], [], 0

        def shard() -> pd.DataFrame:
            flat = np.frombuffer(b"".join(parts), "<u4")
            return pd.DataFrame([[part, seq, ids, [len(p) // 4 for p in parts], len(flat), WaveletMatrix.of(flat).to_bytes()]], columns=["part", "seq", "doc_ids", "lengths", "n_tokens", "payload"])

        for frame in frames:
            for i in range(0, len(frame), 1000):
                rows = frame.iloc[i : i + 1000]
                for doc_id, raw in zip(rows.doc_id.astype("Int64"), tokens.encode(rows.text, tokenizer, end_id), strict=True):
                    if parts and held + len(raw) // 4 > shard_tokens:
                        yield shard()
                        seq, ids, parts, held = seq + 1, [], [], 0
                    ids.append(None if doc_id is pd.NA else int(doc_id))
                    parts.append(raw)
                    held += len(raw) // 4
        if parts:
            yield shard()

    dealt.mapInPandas(build, SHARDS).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards."""
    files = spark.read.schema(SHARDS).parquet(path)
    of_part = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per task of the writer, then one per shard of a task: no window sees documents.
    parts = of_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq")
    starts = files.select("part", "seq", "n_tokens").select("part", "seq", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("seq_start"))
    placed = starts.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("base"))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                flat = WaveletMatrix.from_bytes(r.payload).decode().astype("<u4")
                lengths = np.asarray(r.lengths, dtype=np.int64)
                ends = np.cumsum(lengths)
                yield pd.DataFrame({"part": r.part, "seq": r.seq, "doc_id": pd.array(list(r.doc_ids), dtype="Int64"), "inner": ends - lengths, "n_tokens": lengths,
                                    "ids_crc32": [zlib.crc32(flat[b - n : b].tobytes()) for b, n in zip(ends, lengths, strict=True)]})

    one_by_one = files.select("part", "seq", "doc_ids", "lengths", "payload")
    rows = one_by_one.mapInPandas(decode, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(placed, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write shards of ``docs`` (doc_id, text; other columns are ignored) to the shared folder and report each document from them.

    Null is the empty text: one end id. Rows that share a doc_id follow one another; a null doc_id comes first. No rows
    give no rows.
    """
    import uuid

    path = f"{work_dir(docs.sparkSession)}/llm-wavelet-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer, end_id)
    return read_shards(docs.sparkSession, path)
