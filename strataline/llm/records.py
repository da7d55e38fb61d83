"""Length-delimited binary records of token ids, with a separate offset index.

Layout of a record file, integers little-endian:

    u64 n | u32 masked checksum of those 8 bytes | n payload bytes | u32 masked checksum of the payload

The payload is one flag byte (1: the document's id is null, 2: ids take two
bytes, which they do if the largest fits), the i64 id and the token ids.  A masked checksum is the CRC-32 of the bytes, rotated
right by 15 bits, plus a constant, so that checksums of data that itself holds
checksums stay sound.  Beside each file `x.rec` lies `x.idx`: for each record
its u64 offset and u64 whole length, so that a reader can take records in any
order.

Files are written by the tasks of one Spark job through pyarrow's file systems
into a folder that all executors share.  Every attempt of a task writes names
of its own, and only the manifest (a table) says which files count, so a lost
executor or a repeated task leaves at most an unused file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import need
from strataline.llm.minhash import text_slices
from strataline.llm.tokens import default_tokenizer, encoder
from strataline.session import Scratch

#: Added to a rotated checksum.
MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_FIXED = struct.Struct("<Bq")
_U32 = struct.Struct("<I")

MANIFEST = "part int, file string, n_docs long, n_tokens long, n_bytes long"
RECORDS = "part int, ordinal long, doc_id long, n_tokens long, start long, ids binary"


class BrokenRecord(ValueError):
    """A length or checksum that does not hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + _U32.pack(masked(head)) + payload + _U32.pack(masked(payload))


def unframe(f) -> bytes | None:
    """The next payload of an open file, None at its end."""
    head = f.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size or masked(head[:8]) != _HEAD.unpack(head)[1]:
        raise BrokenRecord("length")
    n = _HEAD.unpack(head)[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != _U32.unpack(body[n:])[0]:
        raise BrokenRecord("payload")
    return body[:n]


def to_payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    short = not len(ids) or int(ids.max()) < 1 << 16
    return _FIXED.pack((doc_id is None) + 2 * short, doc_id or 0) + ids.astype("<u2" if short else "<u4").tobytes()


def of_payload(payload: bytes) -> tuple[int | None, bytes]:
    """The id, and the token ids as little-endian u32."""
    flags, doc_id = _FIXED.unpack_from(payload)
    ids = payload[_FIXED.size :]
    return (None if flags & 1 else doc_id), np.frombuffer(ids, "<u2").astype("<u4").tobytes() if flags & 2 else ids


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Encodes `text`, appends end_id and writes files under `folder`; the lazy result has a MANIFEST row for each file.

    Documents go in ascending doc_id order over the files (by `part`) and
    within each; null ids come first, equal ids are ordered by a hash of the
    text.  A null text counts as empty and gives a record with the end id
    alone.  Long texts are whole.  An empty table gives no files.  Only doc_id
    and text are read, so other columns may have any name.
    """
    tokenizer = tokenizer or default_tokenizer()

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        name, out, idx, at, docs, tokens = f"part-{part:06d}-{uuid.uuid4().hex[:8]}.rec", None, None, 0, 0, 0
        for batch in chain.from_iterable(text_slices(b, 4 << 20) for b in batches):
            if not batch.num_rows:
                continue
            if out is None:
                store, top = _store(folder)
                store.create_dir(top, recursive=True)
                out, idx = (store.open_output_stream(f"{top}/{x}") for x in (name, name[:-4] + ".idx"))
            ids, lens = enc.encode(batch.column("text"))
            ends = np.cumsum(lens)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), ends - lens, ends, strict=True):
                record = frame(to_payload(doc_id, np.append(ids[a:b].astype(np.uint32), np.uint32(end_id))))
                out.write(record)
                idx.write(struct.pack("<QQ", at, len(record)))
                at += len(record)
            docs += len(lens)
            tokens += len(ids) + len(lens)
        if out is not None:
            out.close()
            idx.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": [docs], "n_tokens": [tokens], "n_bytes": [at]})

    tie = F.xxhash64("text")
    ordered = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", tie.alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(write_part, MANIFEST)


def read(manifest: DataFrame, digest_only: bool = False) -> DataFrame:
    """Every record of the files that the manifest names, checked: RECORDS; start counts the ids before the record over all files.

    With digest_only the ids stay in the task and ids_crc32, their unsigned
    CRC-32 as little-endian u32, is returned instead.
    """
    last = "ids_crc32 long" if digest_only else "ids binary"
    schema = RECORDS.replace("ids binary", last)

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["file"])
                rows, start, held = [], row["base"], 0
                with store.open_input_stream(path, buffer_size=1 << 20) as f:
                    k = 0
                    while (payload := unframe(f)) is not None:
                        doc_id, ids = of_payload(payload)
                        n = len(ids) // 4
                        rows.append((row["part"], k, doc_id, n, start, zlib.crc32(ids) if digest_only else ids))
                        k, start, held = k + 1, start + n, held + (0 if digest_only else len(ids))
                        if len(rows) >= 20_000 or held > 1 << 24:
                            yield _batch(rows, digest_only)
                            rows, held = [], 0
                if k != row["n_docs"] or start - row["base"] != row["n_tokens"]:
                    raise BrokenRecord(f"{path} is not whole")
                if rows:
                    yield _batch(rows, digest_only)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return _dealt(placed).mapInArrow(read_files, schema)


def _dealt(manifest: DataFrame) -> DataFrame:
    """The manifest with about a task for each file: its rows are few and small, so adaptive execution would put them into one."""
    return manifest.repartition(max(1, manifest.count()), "file")


def _batch(rows: list[tuple], digest_only: bool) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest_only else pa.binary()]
    names = ["part", "ordinal", "doc_id", "n_tokens", "start", "ids_crc32" if digest_only else "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def index(manifest: DataFrame) -> DataFrame:
    """The offset index: file, part, ordinal, at, n_bytes for each record."""

    def read_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["file"][:-4] + ".idx")
                with store.open_input_stream(path) as f:
                    at = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                n = len(at)
                yield pa.RecordBatch.from_pydict({"file": [row["file"]] * n, "part": pa.array([row["part"]] * n, pa.int32()), "ordinal": np.arange(n), "at": at[:, 0], "n_bytes": at[:, 1]})

    return _dealt(manifest).mapInArrow(read_index, "file string, part int, ordinal long, at long, n_bytes long")


def read_shuffled(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """All records in a random order set by `seed`: place, doc_id, ids.

    The index is shuffled, not the records: rows of the index are dealt out by
    a hash, sorted by it, and each task seeks to its records.
    """

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened: dict = {}
            out = []
            for row in batch.to_pylist():
                if row["file"] not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    store, path = _store(row["file"])
                    opened[row["file"]] = store.open_input_file(path)
                f = opened[row["file"]]
                f.seek(row["at"])
                doc_id, ids = of_payload(unframe(f))
                out.append((row["place"], doc_id, ids))
            for f in opened.values():
                f.close()
            for i in range(0, len(out), 1000):
                some = list(zip(*out[i : i + 1000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int64()), pa.array(some[1], pa.int64()), pa.array(some[2], pa.binary())], names=["place", "doc_id", "ids"])

    dealt = index(manifest).withColumn("place", F.xxhash64(F.lit(seed), "part", "ordinal"))
    return dealt.repartitionByRange("place", "part", "ordinal").sortWithinPartitions("place", "part", "ordinal").mapInArrow(seek, "place long, doc_id long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes the files, reads them back: doc_id, start, n_tokens, ids_crc32."""
    scratch = Scratch(docs.sparkSession, "records")
    manifest = scratch.save(write(docs, scratch.folder("files"), tokenizer, end_id), "manifest")
    return read(manifest, digest_only=True).select("doc_id", "start", "n_tokens", "ids_crc32")
