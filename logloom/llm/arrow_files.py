"""Token ids as Arrow files of equal-length sequences, written in id order and read without copies."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import as_text, id_and_text, steps, task_number
from logloom.llm.tokens import ENCODED_BYTES, encoder
from logloom.operators.numbering import shared_folder

# Sequences per record batch of a file.
BATCH_ROWS = 128
MANIFEST = "part int, path string, n_documents bigint, n_tokens bigint"


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        if folder.startswith("file:") and not folder.startswith("file://"):
            folder = "file://" + folder.removeprefix("file:")
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def sequence_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", kind, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])


class _Writer:
    """One Arrow file of full sequences; what does not fill a record batch waits, the last sequence is padded."""

    def __init__(self, sink: pa.NativeFile, length: int, kind: np.dtype) -> None:
        self.length, self.kind, self.total = length, kind, 0
        self.schema = sequence_schema(length, pa.from_numpy_dtype(kind))
        self.out = ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        full = self.length * BATCH_ROWS
        if self.held >= full:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // full * full
            for at in range(0, whole, full):
                self._batch(flat[at : at + full], full)
            self.waiting, self.held = [flat[whole:].copy()], len(flat) - whole

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(v, type=f.type) for v, f in zip((pa.array(ids), mask), self.schema, strict=True)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.kind)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self.out.close()


def write_sequence_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 2
) -> list[dict]:
    """Encode every whole text, append ``end_id``, and write the ids in ascending id order.

    Documents are range-partitioned by id (equal ids by a hash of their text; a null id
    comes first) and sorted inside each partition, so the files in the order of ``part``
    hold the ids of all documents in order. Each task writes ``part-N.arrow`` (fixed-size
    lists of ``length`` ids and a mask that marks real ids) and ``docs-N.arrow`` (id, start
    and count of each document of the file) under a name of its attempt and renames both
    when they are whole, so a retried task replaces them. Null text counts as empty and
    gives the end id alone; an empty table gives no file. Returns one entry per file.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/logloom/sequences-{uuid.uuid4().hex}"
    places, path = _open_folder(folder)
    places.create_dir(path, recursive=True)
    rows = id_and_text(docs, id_col, text_col)
    order = [F.col("_id"), F.xxhash64("_text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (part, attempt) = encoder(tokenizer), task_number()
        store, root = _open_folder(folder)
        names = [posixpath.join(root, f"{kind}-{part:06d}.arrow") for kind in ("part", "docs")]
        drafts = [f"{n}.{attempt}.tmp" for n in names]
        writer = sink = index_sink = index = None
        documents = 0
        index_schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for batch in steps(batches, limit=ENCODED_BYTES):
            ids, ends = encode.encode(as_text(batch.column("_text")))
            if writer is None:
                sink, index_sink = (store.open_output_stream(d) for d in drafts)
                writer, index = _Writer(sink, length, encode.type), ipc.new_file(index_sink, index_schema)
            sizes = np.diff(ends)
            first = writer.total + ends[:-1] - ends[0] + np.arange(len(sizes))
            writer.add(np.insert(ids, ends[1:] - ends[0], np.array(end_id, encode.type)))
            index.write_batch(pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(first), pa.array(sizes + 1)], schema=index_schema))
            documents += len(sizes)
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            index_sink.close()
            for draft, name in zip(drafts, names, strict=True):
                store.move(draft, name)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "path": [names[0]], "n_documents": [documents], "n_tokens": [writer.total]}
            )

    done = ordered.mapInArrow(write, MANIFEST).collect()  # a row per file
    return [{**r.asDict(), "folder": folder} for r in sorted(done, key=lambda r: r["part"])]


class SequenceFile:
    """Random access to one file: views into the mapped file where the store is a local one."""

    def __init__(self, folder: str, path: str) -> None:
        store, _ = _open_folder(folder)
        local = isinstance(store, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else store.open_input_file(path)
        self.reader = ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def batch(self, i: int) -> np.ndarray:
        """All ids of record batch ``i``, padding included, as one flat view."""
        return np.asarray(self.reader.get_batch(i).column("ids").flatten())

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        batch = self.reader.get_batch(i // BATCH_ROWS)
        at = i % BATCH_ROWS
        return np.asarray(batch.column("ids")[at].values), batch.column("mask")[at].values.to_numpy(zero_copy_only=False)

    def read(self, start: int, size: int) -> np.ndarray:
        """``size`` ids from position ``start`` of the file."""
        per, out = self.length * BATCH_ROWS, []
        while size > 0:
            at = start % per
            out.append(self.batch(start // per)[at : at + size])
            start, size = start + len(out[-1]), size - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)

    def close(self) -> None:
        self.source.close()


def read_documents(spark, files: list[dict]) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of ``files``, read from the files themselves.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned
    32-bit integers. One task reads a file, a bounded number of documents at a time.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    before, listed = 0, []
    for f in files:
        listed.append((f["folder"], f["path"], before))
        before += f["n_tokens"]
    if not listed:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame(listed, "folder string, path string, base bigint").repartition(len(listed))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = _open_folder(row["folder"])
                head, name = posixpath.split(row["path"])
                file = SequenceFile(row["folder"], row["path"])
                with store.open_input_file(posixpath.join(head, "docs" + name.removeprefix("part"))) as source:
                    index = ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        part = index.get_batch(i)
                        starts, sizes = (np.asarray(part.column(c)) for c in ("start", "n_tokens"))
                        values = [file.read(int(s), int(n)).astype("<u4").tobytes() for s, n in zip(starts, sizes, strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [part.column("id"), pa.array(starts + row["base"]), part.column("n_tokens"), pa.array(values, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                file.close()

    return todo.mapInArrow(read, schema)
