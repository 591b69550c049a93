"""Token ids in Arrow files of equal-length sequences and masks.

A shard is an Arrow IPC file whose batches hold fixed-size lists: ``ids`` (``length`` unsigned
integers, 16 bits where the vocabulary allows) and ``mask`` (``length`` bytes, 0 on the padding
after a shard's last id, else 1).  A shard has at most two different masks, so that column is a
dictionary of fixed-size lists with a number for each sequence.  Buffers are written as they
are: a memory map of a file gives any sequence and its mask without a copy (``sequence``).
Beside each shard lies a file of its documents: id, first id's place in the shard, number of ids.

Documents come in ascending ``doc_id`` (null first; rows that share an id by their texts),
range-partitioned by both, in a bounded number of tasks that write one shard after another; a
shard's ids do not depend on others, so a lost task writes its own files again.  Files are written under a name of their own attempt
and renamed, and the manifest lists what the committed attempt of each task wrote.

A null text is empty and gives the end id alone.  An empty table gives no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoders import encoder
from .scratch import scratch_path, small_batches, written
from .words import slices

_MANIFEST = "shard long, path string, n_docs long, n_ids long"
_BATCH = 256
#: Bits of a shard's number that count the shards of one task.
_TASK_BITS = 24


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _sequences(ids: np.ndarray, real: int, length: int) -> pa.RecordBatch:
    """A batch of sequences of which the first ``real`` ids are no padding."""
    masks, kind = [np.ones(length, np.uint8)], np.zeros(len(ids) // length, np.int8)
    if real < len(ids):
        masks.append((np.arange(length) < real % length).astype(np.uint8))
        kind[-1] = 1
    masks = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(masks)), length)
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.DictionaryArray.from_arrays(pa.array(kind), masks)], names=["ids", "mask"])


def _masks(batch: pa.RecordBatch) -> np.ndarray:
    """One mask per sequence of a batch."""
    mask = batch.column("mask")
    return mask.dictionary.flatten().to_numpy().reshape(len(mask.dictionary), -1)[mask.indices.to_numpy()]


class _Shard:
    """The files of one shard, written under names of their own and renamed when they are whole."""

    def __init__(self, fs: pafs.FileSystem, root: str, number: int, kind: type, length: int):
        self.fs, self.number, self.length, self.size = fs, number, length, 0
        self.name, self.own = f"{root}/{number:013d}", uuid.uuid4().hex
        self.left, self.doc_ids, self.counts, self.n_ids = np.empty(0, kind), [], [], 0
        schema = _sequences(np.empty(0, kind), 0, length).schema
        options = pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)  # the padded mask of a shard's end is added when it comes
        self.out = fs.open_output_stream(f"{self.name}.{self.own}.part")
        self.sink = pa.ipc.new_file(self.out, schema, options=options)

    def add(self, doc_ids: list, ids: np.ndarray, starts: np.ndarray, size: int) -> None:
        wide = self.length * _BATCH
        self.doc_ids += doc_ids
        self.counts += np.diff(starts).tolist()
        self.n_ids += len(ids)
        self.size += size
        left = np.concatenate([self.left, ids])
        while len(left) >= wide:
            self.sink.write_batch(_sequences(left[:wide], wide, self.length))
            left = left[wide:]
        self.left = left.copy()

    def closed(self, folder: str) -> pa.RecordBatch:
        """The shard's row of the manifest."""
        if len(self.left):
            padded = np.zeros(-(-len(self.left) // self.length) * self.length, self.left.dtype)
            padded[: len(self.left)] = self.left
            self.sink.write_batch(_sequences(padded, len(self.left), self.length))
        self.sink.close()
        self.out.close()
        table = pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "start": pa.array(np.cumsum([0, *self.counts[:-1]]), pa.int64()), "n_tokens": pa.array(self.counts, pa.int64())})
        with self.fs.open_output_stream(f"{self.name}.{self.own}.docs") as out, pa.ipc.new_file(out, table.schema) as sink:
            sink.write_table(table)
        self.fs.move(f"{self.name}.{self.own}.docs", f"{self.name}.docs.arrow")
        self.fs.move(f"{self.name}.{self.own}.part", f"{self.name}.arrow")
        return pa.RecordBatch.from_pydict({"shard": [self.number], "path": [f"{folder}/{self.number:013d}"], "n_docs": [len(self.doc_ids)], "n_ids": [self.n_ids]})


def write_sequences(
    docs: DataFrame, folder: str, *, tokenizer: str, keeps_space: bool = True, end: int = 0, length: int = 2048,
    doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 24 << 20, tasks: int = 8192,
) -> DataFrame:
    """Writes the shards into ``folder``, in at most ``tasks`` tasks; returns the manifest (shard, path, n_docs, n_ids), a written table."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    small_batches(docs.sparkSession)
    total = rows.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task = encoder(tokenizer, keeps_space), TaskContext.get().partitionId()
        fs, root = _files(folder)
        fs.create_dir(root, recursive=True)
        shard, made = None, 0
        for batch in batches:
            for part in slices(batch, "body", min(8 << 20, shard_bytes)):
                if shard is None:
                    shard = _Shard(fs, root, (task << _TASK_BITS) + made, code.kind, length)
                bodies = part.column("body").to_pylist()
                shard.add(part.column("doc_id").to_pylist(), *code.encode(bodies, end), sum(map(len, bodies)))
                if shard.size >= shard_bytes:
                    yield shard.closed(folder)
                    shard, made = None, made + 1
        if shard is not None:
            yield shard.closed(folder)

    # the second key parts rows that share an id, or have none; it orders them as their texts do
    place = [F.col("doc_id").asc_nulls_first(), F.substring("body", 1, 64).asc()]
    ordered = rows.repartitionByRange(min(shards, tasks), *place).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "body")
    return written(ordered.mapInArrow(write, _MANIFEST), "manifest")


def read_documents(manifest: DataFrame, tasks: int = 8192) -> DataFrame:
    """Per document, from the files: shard, doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("base", before).repartition(max(1, min(manifest.count(), tasks)), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _files(row["path"])
                with fs.open_input_file(f"{path}.docs.arrow") as file:
                    table = pa.ipc.open_file(file).read_all()
                with fs.open_input_file(f"{path}.arrow") as file:
                    reader, at, batch_ids, crcs = pa.ipc.open_file(file), 0, np.empty(0, "<u4"), []
                    for n in table.column("n_tokens").to_pylist():
                        crc = 0
                        while n:
                            if not len(batch_ids):
                                got = reader.get_batch(at)
                                batch_ids = got.column("ids").values.to_numpy()[_masks(got).ravel() != 0].astype("<u4")
                                at += 1
                            crc = zlib.crc32(batch_ids[:n].tobytes(), crc)
                            n, batch_ids = n - len(batch_ids[:n]), batch_ids[n:]
                        crcs.append(crc)
                start = table.column("start").to_numpy() + row["base"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(crcs), pa.int64()), table.column("doc_id").combine_chunks(), pa.array(start, pa.int64()), table.column("n_tokens").combine_chunks(), pa.array(crcs, pa.int64())],
                    names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(read, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")


def sequence(path: str, k: int, length: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``k`` of a local shard and its mask: views of the memory-mapped file."""
    reader = pa.ipc.open_file(pa.memory_map(path))
    batch = reader.get_batch(k // _BATCH)
    row, mask = k % _BATCH, batch.column("mask")
    ids = batch.column("ids").values.slice(row * length, length)
    own = mask.dictionary.values.slice(mask.indices[row].as_py() * length, length)
    return ids.to_numpy(zero_copy_only=True), own.to_numpy(zero_copy_only=True)


def tokenized(docs: DataFrame, *, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """``write_sequences`` into ``folder`` (else a scratch folder), then ``read_documents`` of what lies there."""
    folder = folder or scratch_path(docs.sparkSession, "sequences")
    return read_documents(write_sequences(docs, folder, tokenizer=tokenizer, **options))
