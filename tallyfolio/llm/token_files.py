"""Token ids in Arrow files of equal-length sequences.

Documents in ascending id order become one stream of ids (each document ends with the end id),
cut into sequences of equal length. A file is an Arrow IPC file of record batches; a row is one
sequence:

* ``ids``: fixed-size list of unsigned integers, the narrowest type that holds the vocabulary;
* ``mask``: fixed-size list of booleans, false where the last sequence of a file is padded;
* ``doc_ids``, ``doc_ends``: the documents that end in the sequence, and where (exclusive).

All batches but a file's last hold ``BATCH_ROWS`` rows and nothing is compressed, so row i of a
memory-mapped file is found by division and read without a copy (``TokenFile``). Files follow
each other by their number. A task writes under a name of its own and renames the file at the
end, so a repeated task replaces equal content; one row per file tells what was written.

Defined results: a null text is empty and holds the end id alone; null ids come first; rows
with equal ids are ordered by their text; an empty table writes no ids.
"""
from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyfolio.llm.common import documents, written
from tallyfolio.llm.units import UnitValues
from tallyfolio.session import scratch_path

SEQUENCE = 1024
BATCH_ROWS = 1024
END_ID = 2
# Units in one call of the library.
RUN = 200


class Encoder:
    """The tokenizers library over distinct units of text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special_bytes = {t: np.array([i], self.kind).tobytes() for t, i in self.specials.items()}
        # Bytes of each token: its characters stand for one byte each.
        self.width = np.zeros(self.size, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token)
        self.texts = UnitValues(self.encode_units, b"".join, self.specials)

    def _library(self, texts: list[str]) -> Iterator[list[int]]:
        for i in range(0, len(texts), 5_000):
            for found in self.library.encode_batch_fast(texts[i:i + 5_000], add_special_tokens=False):
                yield found.ids

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit. Units that start with a space go to the library in runs.

        No token spans the place between two of them, so the widths of the tokens tell which
        ids belong to which unit.
        """
        apart = [u for u in units if u[0] != " " or u[-1].isspace()]
        value = {u: np.array(ids, self.kind).tobytes() for u, ids in zip(apart, self._library(apart))}
        runs = [u for u in units if u not in value]
        cut = [runs[i:i + RUN] for i in range(0, len(runs), RUN)]
        for run, found in zip(cut, self._library(["".join(r) for r in cut])):
            ids = np.array(found, self.kind)
            ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) for u in run])
            stop = ((np.searchsorted(np.cumsum(self.width[ids]), ends) + 1) * self.kind.itemsize).tolist()
            data = ids.tobytes()
            value.update(zip(run, [data[i:j] for i, j in zip([0, *stop], stop)]))
        return [value[u] for u in units]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for segments in self.texts.of(texts):
            yield b"".join([self.special_bytes[s] if i % 2 else s for i, s in enumerate(segments)])


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def file_schema(kind: np.dtype, length: int, doc_id: pa.DataType) -> pa.Schema:
    item = pa.uint16() if kind.itemsize == 2 else pa.uint32()
    return pa.schema([
        pa.field("ids", pa.list_(pa.field("item", item, nullable=False), length), nullable=False),
        pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length), nullable=False),
        pa.field("doc_ids", pa.list_(doc_id), nullable=False),
        pa.field("doc_ends", pa.list_(pa.field("item", pa.int32(), nullable=False)), nullable=False)])


class _Writer:
    """Packs documents into sequences and writes full batches."""

    def __init__(self, sink, kind: np.dtype, length: int, doc_id: pa.DataType):
        self.kind, self.length = kind, length
        self.schema = file_schema(kind, length, doc_id)
        self.out = ipc.new_file(sink, self.schema)
        self.chunks: list[bytes] = []
        self.held = self.n_ids = self.n_docs = 0
        self.doc_ids: list = []
        self.ends: list[int] = []
        self.doc_type = doc_id

    def add(self, doc_id, ids: bytes) -> None:
        self.chunks.append(ids)
        n = len(ids) // self.kind.itemsize
        self.held += n
        self.n_ids += n
        self.n_docs += 1
        self.doc_ids.append(doc_id)
        self.ends.append(self.held)
        if self.held >= BATCH_ROWS * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.chunks), self.kind)
        full = BATCH_ROWS * self.length
        ends = np.array(self.ends, np.int64)
        at = done = 0
        while len(flat) - at >= full or last and at < len(flat):
            part = flat[at:at + full]
            # A document belongs to the sequence that holds its last id.
            until = done + int(np.searchsorted(ends[done:], at + len(part), "right"))
            self._batch(part, self.doc_ids[done:until], ends[done:until] - at)
            at, done = at + len(part), until
        self.chunks, self.held = [flat[at:].tobytes()], len(flat) - at
        self.doc_ids, self.ends = self.doc_ids[done:], (ends[done:] - at).tolist()

    def _batch(self, part: np.ndarray, doc_ids: list, ends: np.ndarray) -> None:
        rows = -(-len(part) // self.length)
        mask = np.zeros(rows * self.length, bool)
        mask[:len(part)] = True
        if len(part) < len(mask):
            part = np.concatenate((part, np.zeros(len(mask) - len(part), self.kind)))
        row = (ends - 1) // self.length
        offsets = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
        types = [f.type for f in self.schema]
        self.out.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(part), type=types[0]),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), type=types[1]),
            pa.ListArray.from_arrays(offsets, pa.array(doc_ids, self.doc_type)),
            pa.ListArray.from_arrays(offsets, pa.array(ends - row * self.length, pa.int32())).cast(types[3])],
            schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._flush(True)
        self.out.close()


class TokenFile:
    """Random access to a file's sequences; ids and mask are views where the file is mapped."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        source = pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name)
        self.file = ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size

    def batches(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.file.num_record_batches):
            yield self.file.get_batch(i)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch = self.file.get_batch(i // BATCH_ROWS)
        at = (i % BATCH_ROWS) * self.length
        ids = batch.column(0).values.slice(at, self.length).to_numpy()
        return ids, batch.column(1).values.slice(at, self.length).to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[object, int, int, int]]:
        """(doc id, start, number of ids, crc32 of the ids as 32-bit integers), in order."""
        start, crc = 0, 0
        here = 0                                    # ids of the file before this batch
        for batch in self.batches():
            n = batch.column(1).values.true_count
            data = memoryview(batch.column(0).values.to_numpy()[:n].astype("<u4")).cast("B")
            lists = batch.column(3)
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            ends = row * self.length + lists.flatten().to_numpy()
            at = 0
            for doc_id, end in zip(batch.column(2).flatten().to_pylist(), ends.tolist()):
                crc = zlib.crc32(data[4 * at:4 * end], crc)
                yield doc_id, start, here + end - start, crc
                start, crc, at = here + end, 0, end
            crc = zlib.crc32(data[4 * at:4 * n], crc)
            here += n


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def write_files(docs: DataFrame, folder: str | None = None, text: str = "text", doc_id: str = "doc_id",
                path: str | None = None, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as token files; one row per file: number, path, documents, ids.

    Documents are range-partitioned by id (and by text, so that one id cannot fill a task); a
    task encodes and writes as it reads, holding one batch of sequences.
    """
    path = path or vocabulary_path()
    folder = folder or scratch_path(docs.sparkSession, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        code = encoder(path)
        end = np.array([end_id], code.kind).tobytes()
        writer = None
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                store, root = _store(folder)
                store.create_dir(root, recursive=True)
                own, name = f"{root}/_{uuid.uuid4().hex}", f"part-{number:06d}.arrow"
                sink = store.open_output_stream(own)
                writer = _Writer(sink, code.kind, length, batch.column(0).type)
            texts = (t.as_py() or "" for t in batch.column(1))
            for i, ids in zip(batch.column(0).to_pylist(), code.encode(texts)):
                writer.add(i, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            store.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([f"{folder}/{name}"]),
                 pa.array([writer.n_docs], pa.int64()), pa.array([writer.n_ids], pa.int64())],
                ["number", "file", "n_docs", "n_ids"])

    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    order = [F.col("id"), F.xxhash64("text"), F.col("place")]
    ranged = (given.withColumn("place", F.monotonically_increasing_id())
              .repartitionByRange(*order).sortWithinPartitions("id", F.xxhash64("text"), "text").select("id", "text"))
    return written(ranged.mapInArrow(run, "number bigint, file string, n_docs bigint, n_ids bigint"), "token-manifest")


def read_documents(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest.

    Where a file starts is a running sum over one row per file.
    """
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("number", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, start, n, crc = [], [], [], []
                tokens = TokenFile(row["file"])
                for doc in tokens.documents():
                    ids.append(doc[0])
                    start.append(row["first"] + doc[1])
                    n.append(doc[2])
                    crc.append(doc[3])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, tokens.file.schema.field("doc_ids").type.value_type), *[pa.array(c, pa.int64()) for c in (start, n, crc)]],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One file per task: the rows are few, and dealt out in turn.
    spread = placed.repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_files(documents(spark, sf_dir)))


QUERIES = {"op10_token_files": op10_token_files}
