"""Length-delimited binary records of token ids, with masked checksums and a separate offset index.

File format. A data file is a run of frames; a frame is

    payload length      unsigned 64-bit, little-endian
    masked CRC-32C of the eight length bytes, unsigned 32-bit
    payload
    masked CRC-32C of the payload, unsigned 32-bit
    one line feed, which ends the frame and isn't counted in the length

and a payload is one document: doc_id as signed 64-bit (null: the smallest), the bytes of an id (2 or 4) as
unsigned 32-bit, then its ids. Frames lie in ascending doc_id order across the files in shard order. The index
is a Parquet table with one row for each frame (shard, file, offset, length), so a reader can fetch frames in any
order without a scan.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keyed_texts, map_arrow, materialise, new_path, slices
from .token_ids import default_tokenizer, encoder

NULL_ID = -(1 << 63)
#: Fixed values of the checksum's mask: rotate right by 15 bits, then add this.
MASK_DELTA = 0xA282EAD8
#: Fixed value: the reflected Castagnoli polynomial.
CASTAGNOLI = 0x82F63B78
_LANE = 256
#: Bytes of text whose ids a file holds, about.
FILE_BYTES = 128 << 20


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(CASTAGNOLI), t >> np.uint32(1)).astype(np.uint32)
    return t


_T = _byte_table()


def _after_zeros(n: int) -> np.ndarray:
    """Four tables of 256: a state's four bytes, each moved on by n zero bytes."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(n):
        state = _T[state & 255] ^ (state >> np.uint32(8))
    return state.reshape(4, 256)


_shift: dict[int, np.ndarray] = {}


def _moved(state: np.ndarray, n: int) -> np.ndarray:
    if n not in _shift:
        _shift[n] = _after_zeros(n) if n <= _LANE else np.stack([_moved(_moved(t, n // 2), n // 2) for t in _after_zeros(0)])
    t = _shift[n]
    return t[0][state & 255] ^ t[1][state >> 8 & 255] ^ t[2][state >> 16 & 255] ^ t[3][state >> 24]


def crc32c(parts: list[bytes]) -> list[int]:
    """CRC-32C of each part: all parts are read in lanes of 256 bytes side by side, then lanes are folded in pairs.

    A lead of zero bytes leaves a zero state as it is, so each part is padded in front to a power of two lanes;
    the usual start value is brought in as the state that the part's length moves on.
    """
    out = [0] * len(parts)
    by_lanes: dict[int, list[int]] = {}
    for k, p in enumerate(parts):
        lanes = 1 << max(0, (len(p) + _LANE - 1) // _LANE - 1).bit_length()
        by_lanes.setdefault(lanes, []).append(k)
    for lanes, ks in by_lanes.items():
        step = max(1, (4 << 20) // (lanes * _LANE))
        for lo in range(0, len(ks), step):
            some = ks[lo : lo + step]
            whole = lanes * _LANE
            # the start value is the same as flipping the first four bytes
            padded = [_flipped(parts[k]).rjust(whole, b"\0") for k in some]
            cols = np.ascontiguousarray(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, _LANE).T)
            state = np.zeros(cols.shape[1], np.uint32)
            for row in cols:
                state = _T[(state ^ row) & 255] ^ (state >> np.uint32(8))
            state, n = state.reshape(len(some), lanes), _LANE
            while state.shape[1] > 1:
                state, n = _moved(state[:, ::2], n) ^ state[:, 1::2], n * 2
            for k, s in zip(some, (state[:, 0] ^ np.uint32(0xFFFFFFFF)).tolist(), strict=True):
                out[k] = s
    for k, p in enumerate(parts):
        if len(p) < 4:
            s = 0xFFFFFFFF
            for x in p:
                s = int(_T[(s ^ x) & 255]) ^ (s >> 8)
            out[k] = s ^ 0xFFFFFFFF
    return out


def _flipped(p: bytes) -> bytes:
    return bytes(x ^ 255 for x in p[:4]) + p[4:]


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frames(payloads: list[bytes]) -> list[bytes]:
    """Frames without their closing line feed."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    return [h + struct.pack("<I", masked(a)) + p + struct.pack("<I", masked(b)) for h, a, p, b in zip(heads, crc32c(heads), payloads, crc32c(payloads), strict=True)]


def read_frames(data: bytes, at: list[tuple[int, int]] | None = None) -> tuple[list[tuple[int, int]], list[bytes]]:
    """(offset, payload length) and payloads of the frames in data, or of those at the given places, checksums verified."""
    if at is None:
        at, k = [], 0
        while k < len(data):
            n = struct.unpack_from("<Q", data, k)[0]
            at.append((k, n))
            k += n + 17
        if k != len(data):
            raise ValueError("the file ends within a frame")
    heads, payloads = [data[k : k + 8] for k, _ in at], [data[k + 12 : k + 12 + n] for k, n in at]
    for (k, n), h, a, b in zip(at, heads, crc32c(heads), crc32c(payloads), strict=True):
        if h != struct.pack("<Q", n) or struct.unpack_from("<I", data, k + 8)[0] != masked(a) or struct.unpack_from("<I", data, k + 12 + n)[0] != masked(b) or data[k + 16 + n : k + 17 + n] != b"\n":
            raise ValueError(f"damaged frame at byte {k}")
    return at, payloads


def _pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<qI", NULL_ID if doc_id is None else doc_id, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = struct.unpack_from("<qI", payload)
    return None if doc_id == NULL_ID else doc_id, np.frombuffer(payload, f"<u{width}", offset=12).astype("<u4")


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Encode every text whole and write it as frames below path, in ascending doc_id order over the files.

    Null or empty texts give the end id alone; null ids come first; rows with equal ids follow each other in
    the order of their texts. An empty input gives no frame. Only the id and text columns are read.
    The files are written by Spark's own committed writer, so a task that is run again leaves no second copy.
    Unless their number is given there are as many files as shuffle partitions, and so many more that a file holds the
    ids of about FILE_BYTES of text, which a task can read at once.
    """
    spark = docs.sparkSession
    n = files
    if not n:
        held = keyed_texts(docs, id_col, text_col).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // FILE_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 2 if len(enc.opens) <= 1 << 16 and end_id < 1 << 16 else 4
        for batch in slices(batches, "text"):
            d = batch.to_pydict()
            payloads = [_pack(i, np.append(x, np.uint32(end_id)), width) for i, x in zip(d["doc_id"], enc.encode(d["text"]), strict=True)]
            yield pa.record_batch([pa.array(frames(payloads), pa.binary())], ["frame"])

    rows = keyed_texts(docs, id_col, text_col).repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    map_arrow(rows, encode, "frame binary").select(F.col("frame").cast("string").alias("value")).write.text(path, lineSep="\n")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each data file: its place among the files, its name and its bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard"), F.col("path").alias("file"), "content")


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Read all files back and index their frames.

    Columns: shard, file, record (its place in the file), offset, length (of the payload), doc_id, n_tokens,
    before (ids in this file ahead of it), ids_crc32 (unsigned, ids as little-endian unsigned 32-bit).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file, content in zip(batch["shard"].to_pylist(), batch["file"].to_pylist(), batch["content"], strict=True):
                data, record, before = content.as_buffer().to_pybytes(), 0, 0
                places, k = [], 0
                while k < len(data):
                    places.append((k, struct.unpack_from("<Q", data, k)[0]))
                    k += places[-1][1] + 17
                for lo in range(0, len(places), 512):
                    got = read_frames(data, places[lo : lo + 512])
                    rows = []
                    for (offset, length), p in zip(*got, strict=True):
                        doc_id, ids = unpack(p)
                        rows.append((shard, file, record, offset, length, doc_id, len(ids), before, zlib.crc32(ids.tobytes())))
                        record, before = record + 1, before + len(ids)
                    yield pa.RecordBatch.from_pylist([dict(zip(INDEX.names, r, strict=True)) for r in rows], INDEX)

    return map_arrow(_files(spark, path), scan, "shard long, file string, record long, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long")


INDEX = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("record", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("ids_crc32", pa.int64())])


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int) -> DataFrame:
    """doc_id and ids of the indexed frames in a random order that seed fixes: each file's frames are fetched by offset."""

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, ids = [], []
        if left.num_rows and right.num_rows:
            data = right["content"][0].as_buffer().to_pybytes()
            _, payloads = read_frames(data, list(zip(left["offset"].to_pylist(), left["length"].to_pylist(), strict=True)))
            for p in payloads:
                d, x = unpack(p)
                docs.append(d)
                ids.append(x.astype(np.int64))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    some = index.select("shard", "offset", "length").groupBy("shard").cogroup(_files(spark, path).groupBy("shard")).applyInArrow(fetch, "doc_id long, ids array<long>")
    return some.orderBy(F.xxhash64("doc_id", F.lit(seed)))


def with_starts(index: DataFrame) -> DataFrame:
    """Add start: ids of all documents in files and frames before. Only one row a file meets in the window."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    bases = totals.select("shard", (F.sum("_n").over(W.orderBy("shard")) - F.col("_n")).alias("_base"))
    return index.join(bases, "shard").withColumn("start", F.col("_base") + F.col("before")).drop("_base")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    path = new_path(spark, "records")
    write_records(table(spark, sf_dir, "documents"), path, default_tokenizer(), end_id=0)
    index = materialise(build_index(spark, path), "record-index")
    return with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset")
