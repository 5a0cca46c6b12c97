"""Operator 7, media columns: content-addressed payloads in tar shards.

Each text's bytes, padded to a multiple of 64, are the pixels of an 8-bit grey PNG 64 wide. A task
appends the images to tar shards in the shared folder, one member a digest, and rows carry digest,
shard, offset and length. Of copies written by several tasks the first place (smallest shard, then
offset) stands for all. Readers fill the metadata columns from a range read of the header alone,
and features from the whole member; places are read in order, so reads of a shard are sequential.

Defined results: a null text is an empty one (64 zero bytes); equal texts share a payload and have
equal values; rows with a null or repeated id keep a row each; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, join_groups, materialize, new_folder, small
from .files import Ranges, Roller

WIDTH, SHARD, LEVEL = 64, 64 << 20, 6
#: Signature, IHDR chunk with its length and CRC: all that a header read takes.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """The payload as rows of 64 grey pixels, without a row filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """width, height and bits of the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("no image header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data[:HEADER])
    at, packed = HEADER, []
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A ustar header of a plain file."""
    head = bytearray(512)
    for at, field in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(field)] = field
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def feature_of(payload: bytes) -> str:
    """Mean, spread and entropy of the samples, and how many values occur."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    values = np.arange(256)
    mean = float(counts @ values) / len(payload)
    spread = float(counts @ (values - mean) ** 2) / len(payload)
    return f"mean={mean:.4f};var={spread:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};values={len(share)}"


def store(df: DataFrame, folder: str, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, digest and, on the rows that wrote a member, shard, offset and length."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def write(batches):
        files, known = Roller(folder, TaskContext.get().partitionId(), ".tar", shard), set()
        for b in small(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payload = payload_of(text)
                name = hashlib.sha256(payload).digest()
                n = len((text or "").encode())
                if name in known:
                    rows.append((doc, n, name, None, None, None))
                    continue
                known.add(name)
                image = to_png(payload)
                path, at = files.append(tar_header(name.hex() + ".png", len(image)) + image + bytes(-len(image) % 512))
                rows.append((doc, n, name, path, at + 512, len(image)))
            yield batch({f.name: [r[k] for r in rows] for k, f in enumerate(schema)}, schema)
        files.close(bytes(1024))

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(write, "doc_id long, n_bytes long, digest binary, shard string, offset long, length long")


def places(rows: DataFrame) -> DataFrame:
    """digest, shard, offset, length, copies: the one place that stands for a digest, and how many rows have it."""
    place = F.min(F.when(F.col("shard").isNotNull(), F.struct("shard", "offset", "length")))
    return rows.groupBy("digest").agg(place.alias("p"), F.count("*").alias("copies")).select("digest", "p.*", "copies")


def read_metadata(at: DataFrame) -> DataFrame:
    """digest, width, height, bits: by range reads of the headers only."""
    schema = pa.schema([("digest", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32())])

    def read(batches):
        files = Ranges()
        for b in batches:
            rows = [(d, *png_header(files.read(s, o, HEADER))) for d, s, o in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
            yield batch({f.name: [r[k] for r in rows] for k, f in enumerate(schema)}, schema)

    return at.select("digest", "shard", "offset").mapInArrow(read, "digest binary, width int, height int, bits int")


def read_features(at: DataFrame) -> DataFrame:
    """What is known of each member: metadata by its header, then features of the whole payload read back."""
    schema = pa.schema([("digest", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.binary()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.binary()), ("feature", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32()), ("shard", pa.string()), ("offset", pa.int64()), ("copies", pa.int64())])

    def read(batches):
        files = Ranges()
        for b in small(batches):
            rows = []
            for name, shard, offset, length, copies in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                header = png_header(files.read(shard, offset, HEADER))
                image = files.read(shard, offset, length)
                payload = from_png(image)
                rows.append((name, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).digest(), feature_of(payload), *header, shard, offset, copies))
            yield batch({f.name: [r[k] for r in rows] for k, f in enumerate(schema)}, schema)

    return at.select("digest", "shard", "offset", "length", "copies").mapInArrow(read, "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string, width int, height int, bits int, shard string, offset long, copies long")


def media_columns(df: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all texts and returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height, bits, shard, offset."""
    spark = df.sparkSession
    rows = materialize(store(df, folder or new_folder(spark, "media"), id_col=id_col, text_col=text_col), "media-rows")
    at = materialize(places(rows), "places")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = read_features(at.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset"))
    shown = lambda x: F.lower(F.hex(x)).alias(x)
    return join_groups(rows.select("doc_id", "n_bytes", "digest"), known, ["digest"], "copies", rows.count(), "inner", sizes=at).select("doc_id", "n_bytes", "payload_bytes", shown("payload_sha256"), "tail_crc32", "media_bytes", shown("media_sha256"), "feature", "width", "height", "bits", "shard", "offset")
