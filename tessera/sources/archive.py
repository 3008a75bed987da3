"""One zip archive of tables as CSV: tasks deflate their parts, and the parts are joined as they are.

A part's stream ends on a byte boundary and refers to nothing before it, so a member of the
archive is its parts' streams one after another, and an empty last block. The checksum of
the whole follows from those of the parts. Only the joined file passes through the
driver's JVM, in pieces of a megabyte.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Scratch

_LAST_BLOCK = b"\x03\x00"  # an empty final deflate block
PART_BYTES = 4 << 20
_WIDE = 0xFFFFFFFF


def crc_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings in a row, from theirs and the second one's length, by squaring the shift by one bit."""
    odd = [0xEDB88320] + [1 << n for n in range(31)]

    def times(matrix: list[int], vector: int) -> int:
        total, i = 0, 0
        while vector:
            if vector & 1:
                total ^= matrix[i]
            vector, i = vector >> 1, i + 1
        return total

    square = lambda m: [times(m, row) for row in m]
    shift = square(square(square(odd)))  # by eight zero bits
    while length:
        if length & 1:
            first = times(shift, first)
        shift, length = square(shift), length >> 1
    return first ^ second


def _csv_lines(df: DataFrame) -> DataFrame:
    """Rows as CSV lines: a value with a comma, quote or line break is quoted, a null is empty."""
    def field(c: str):
        value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.when(value.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)

    return df.select(F.concat_ws(",", *[field(c) for c in df.columns]).alias("line"))


def _deflated(df: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, piece, data, crc, size): the table's CSV text in deflated pieces of about PART_BYTES."""

    def press(batches):
        part, piece, held, size = TaskContext.get().partitionId(), 0, [], 0

        def emit():
            nonlocal piece, held, size
            raw = "".join(held).encode()
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH)
            row = pd.DataFrame({"part": [part], "piece": [piece], "data": [data], "crc": [zlib.crc32(raw)], "size": [len(raw)]})
            piece, held, size = piece + 1, [], 0
            return row

        for pdf in batches:
            for line in pdf["line"]:
                held.append(line + "\r\n")
                size += len(line) + 2
                if size >= PART_BYTES:
                    yield emit()
        if held:
            yield emit()

    return scratch.table(_csv_lines(df).mapInPandas(press, "part int, piece int, data binary, crc long, size long"), "parts")


def write_zip(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> None:
    """Write an archive with one CSV member, header first, for each table; rows keep their order if they have one.

    Members and archive may pass 4 GB. An existing file is replaced when the new one is complete.
    """
    scratch = Scratch(spark, "archive")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    final, temp = hadoop(path), hadoop(f"{path}.part")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out, at, directory = fs.create(temp, True), 0, b""

    def write(data: bytes) -> None:
        nonlocal at
        out.write(bytearray(data))
        at += len(data)

    try:
        for name, df in tables.items():
            head = (",".join(df.columns) + "\r\n").encode()
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            first = packer.compress(head) + packer.flush(zlib.Z_FULL_FLUSH)
            parts = _deflated(df, scratch)
            crc, size, packed = zlib.crc32(head), len(head), len(first)
            rows = parts.select("part", "piece", "crc", "size", F.length("data").alias("packed")).orderBy("part", "piece")
            for r in rows.toLocalIterator():  # checksums and lengths, a row for each piece of 4 MB
                crc, size, packed = crc_joined(crc, r["crc"], r["size"]), size + r["size"], packed + r["packed"]
            packed += len(_LAST_BLOCK)
            member, start, extra = name.encode(), at, struct.pack("<HHQQ", 1, 16, size, packed)
            write(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0x800, 8, 0, 33, crc, _WIDE, _WIDE, len(member), len(extra)) + member + extra)
            write(first)
            for r in parts.orderBy("part", "piece").select("data").toLocalIterator(prefetchPartitions=False):
                write(bytes(r["data"]))
            write(_LAST_BLOCK)
            extra = struct.pack("<HHQQQ", 1, 24, size, packed, start)
            directory += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0x800, 8, 0, 33, crc, _WIDE, _WIDE, len(member), len(extra), 0, 0, 0, 0, _WIDE) + member + extra
        start, n = at, len(tables)
        write(directory)
        end = at
        write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, end - start, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, _WIDE, _WIDE, 0))
    finally:
        out.close()
    fs.delete(final, False)
    if not fs.rename(temp, final):
        raise OSError(f"{path} could not be written")
