"""Token-ID files: independent zstandard frames, a trailing seek table, checksums per frame.

A file holds data frames (16-bit little-endian ids of one whole document each, or of
several up to ``frame_ids`` ids), one directory frame (ids, lengths and places of the documents) and a
skippable frame with the seek table of the zstandard seekable format: compressed
size, decompressed size and the low 32 bits of the XXH64 of each frame. A reader
that wants some documents reads the table, the directory and their frames only, adjacent
frames in one read.

Files are written by tasks under names of their own and count once the manifest,
written last, names them; a task that is run again leaves a file nobody reads.
"""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._text import tidy
from tessera.llm._tokens import crc_of, encode_column, vocabulary_path
from tessera.session import Scratch

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_IDS = 1  # a frame ends before it would hold more ids, so each document has its own
READ_BYTES = 4 << 20


def open_store(uri: str):
    """(file system, path) of a shared folder; file:, hdfs:, s3: and gs: are understood."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Collects documents into frames and ends the file with directory and seek table."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3):
        import zstandard

        self.out, self.frame_ids = out, frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.entries: list[tuple[int, int, int]] = []
        self.pending: list[np.ndarray] = []
        self.n_pending = 0
        self.doc_ids: list[int | None] = []
        self.lens: list[int] = []
        self.frame_of: list[int] = []

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.pack(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.pending:
            self._frame(np.concatenate(self.pending).astype("<u2").tobytes())
            self.pending, self.n_pending = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.n_pending and self.n_pending + len(ids) > self.frame_ids:
            self._flush()
        self.doc_ids.append(doc_id)
        self.lens.append(len(ids))
        self.frame_of.append(len(self.entries))
        self.pending.append(ids)
        self.n_pending += len(ids)

    def close(self) -> None:
        self._flush()
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        self._frame(struct.pack("<Q", len(ids)) + ids.tobytes() + null.tobytes() + np.array(self.lens, "<u8").tobytes() + np.array(self.frame_of, "<u4").tobytes())
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        table += struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        file.seek(self.size - 9)
        n, flag, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        file.seek(self.size - 9 - 12 * n)
        self.entries = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.entries[:, 0].astype(np.int64))])
        raw = self.frame(n - 1)
        (docs,) = struct.unpack_from("<Q", raw)
        take = lambda kind, at: np.frombuffer(raw, kind, docs, at)
        self.doc_ids, self.null = take("<i8", 8), take("u1", 8 + 8 * docs).astype(bool)
        self.lens, self.frame_of = take("<u8", 8 + 9 * docs).astype(np.int64), take("<u4", 8 + 17 * docs)
        before = np.cumsum(self.lens) - self.lens
        first = np.searchsorted(self.frame_of, np.arange(n - 1))
        self.starts = before
        self.inside = before - before[first[self.frame_of]] if docs else before

    def frame(self, i: int) -> bytes:
        return next(self._frames([i]))[1]

    def _frames(self, wanted):
        """Yield (frame, raw bytes) of frames in rising order; adjacent ones are read at once, up to READ_BYTES."""
        import xxhash
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        wanted = np.asarray(wanted, np.int64)
        lo = 0
        while lo < len(wanted):
            hi = lo + 1
            while hi < len(wanted) and wanted[hi] == wanted[hi - 1] + 1 and self.at[wanted[hi] + 1] - self.at[wanted[lo]] <= READ_BYTES:
                hi += 1
            start = int(self.at[wanted[lo]])
            self.file.seek(start)
            held = memoryview(self.file.read(int(self.at[wanted[hi - 1] + 1]) - start))
            for i in wanted[lo:hi].tolist():
                packed, size, check = (int(x) for x in self.entries[i])
                at = int(self.at[i]) - start
                raw = unpack(held[at : at + packed], max_output_size=size)
                if len(raw) != size or xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF != check:
                    raise ValueError(f"checksum of frame {i} does not match")
                yield i, raw
            lo = hi

    def documents(self, which=None):
        """Yield (place, ids) of the documents at these places, all by default; each frame is read once."""
        places = np.arange(len(self.lens)) if which is None else np.unique(np.asarray(which, np.int64))
        frames, first = np.unique(self.frame_of[places], return_index=True)
        ends = np.append(first[1:], len(places))
        for (_, raw), a, b in zip(self._frames(frames), first, ends):
            ids = np.frombuffer(raw, "<u2")
            for p in places[a:b].tolist():
                yield p, ids[self.inside[p] : self.inside[p] + self.lens[p]]


def write_token_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Encode ``docs`` and write one file for each range of ids; return the manifest.

    Documents stand in ascending id order over the files (null ids first; equal ids by
    hash of the text, then by the text). Null text is empty; every document ends with
    id 1. An empty input gives an empty manifest. Other columns are ignored.
    """
    path = tokenizer or vocabulary_path()
    run = uuid.uuid4().hex[:8]

    def write(batches):
        where, writer, out = None, None, None
        tokens = docs_in = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, one in encode_column(batch.column(1), path):
                if writer is None:
                    fs, root = open_store(folder)
                    fs.create_dir(root, recursive=True)
                    part = TaskContext.get().partitionId()
                    name = f"shard-{part:06d}-{run}-{uuid.uuid4().hex[:8]}.tok"
                    where = f"{folder}/{name}"
                    out = fs.open_output_stream(f"{root}/{name}")
                    writer = FrameWriter(out)
                writer.add(ids[row], one)
                tokens += len(one)
                docs_in += 1
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [where], "n_docs": pa.array([docs_in], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    tie = F.xxhash64(text_col)
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = dealt.repartitionByRange("doc_id", tie.alias("tie")).sortWithinPartitions("doc_id", tie, "text")
    rows = dealt.mapInArrow(tidy(write, tokens=True), "part long, path string, n_docs long, n_tokens long").collect()  # one row a file
    files, start = [], 0
    for r in sorted(rows, key=lambda r: r["part"]):
        files.append({"path": r["path"], "n_docs": r["n_docs"], "n_tokens": r["n_tokens"], "start": start})
        start += r["n_tokens"]
    spark = docs.sparkSession
    fs, root = open_store(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json.tmp") as f:
        f.write(json.dumps({"version": 1, "dtype": "<u2", "end_id": 1, "files": files}).encode())
    fs.move(f"{root}/manifest.json.tmp", f"{root}/manifest.json")
    return _manifest_frame(spark, files)


def _manifest_frame(spark: SparkSession, files: list[dict]) -> DataFrame:
    rows = [(f["path"], f["start"], f["n_docs"], f["n_tokens"]) for f in files]
    return spark.createDataFrame(rows, "path string, start long, n_docs long, n_tokens long")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    fs, root = open_store(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return _manifest_frame(spark, json.loads(f.read())["files"])


def read_token_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read the files of a manifest back: one row a document, from the files alone."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, where = open_store(path)
                with fs.open_input_file(where) as f:
                    reader = FrameReader(f)
                    step = 4096
                    for lo in range(0, len(reader.lens), step):
                        which = np.arange(lo, min(lo + step, len(reader.lens)))
                        got = [ids for _, ids in reader.documents(which)]
                        out = {
                            "doc_id": pa.array(reader.doc_ids[which], mask=reader.null[which]),
                            "start": pa.array(start + reader.starts[which]),
                            "n_tokens": pa.array(reader.lens[which]),
                            "ids_crc32": pa.array([crc_of(g) for g in got], pa.int64()),
                        }
                        if with_ids:
                            out["ids"] = pa.array([g.astype(np.int32) for g in got], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return manifest.select("path", "start").mapInArrow(tidy(read), schema)


def fetch_documents(path: str, doc_ids: list[int]) -> pd.DataFrame:
    """Ids of some documents of one file; only their frames are decompressed."""
    fs, where = open_store(path)
    with fs.open_input_file(where) as f:
        reader = FrameReader(f)
        places = np.flatnonzero(np.isin(reader.doc_ids, doc_ids) & ~reader.null)
        return pd.DataFrame([(int(reader.doc_ids[p]), ids) for p, ids in reader.documents(places)], columns=["doc_id", "ids"])


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``documents`` as token files and report what the files hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_shards(write_token_shards(docs, Scratch(spark, "tokens").path))
