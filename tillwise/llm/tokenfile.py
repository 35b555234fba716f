"""Token files: ids of whole documents as Arrow files of equal-length sequences.

Documents are dealt by ranges of doc_id and sorted, each becomes its ids and an
end id, and each task writes one Arrow file (the random-access form) whose batches
have two fixed-size-list columns: `ids` of ``ROW`` ids and `mask`, false where the
last sequence is filled up. The buffers are not compressed, so a sequence is a
slice of the mapped file. Beside it lies a small Arrow file of doc_id, start in
the file and length. Ids are 16 bits wide if the vocabulary allows it.

A task that runs again writes a file of another name; only the files that finished
tasks report are listed. Files go through Arrow's file systems, so the folder may
be any address that these and Spark both understand.

Defined results
* null or empty text: the end id alone; an empty table: no file, no rows;
* order: doc_id, null last, then text; rows that share an id stay apart;
* extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import Scratch, partitions
from tillwise.llm.tokens import encoder

ROW = 1024
ROWS_IN_BATCH = 256
END_ID = 1
MANIFEST = "part int, path string, n_docs long, n_tokens long"


def place(address: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(address)


class Writer:
    """One token file, written as ids come."""

    def __init__(self, address: str, width: int, row: int) -> None:
        self.row, self.kind = row, pa.uint16() if width <= 1 << 16 else pa.uint32()
        self.schema = pa.schema({"ids": pa.list_(self.kind, row), "mask": pa.list_(pa.bool_(), row)})
        self.files, path = place(address)
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = self.files.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.index_path = path + ".docs"
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0
        self.docs: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n_tokens, len(ids)))
        self.n_tokens += len(ids)
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.n_held += len(ids)
        if self.n_held >= self.row * ROWS_IN_BATCH:
            self.flush(self.n_held // self.row)

    def flush(self, rows: int, last: bool = False) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.kind.to_pandas_dtype())
        now, self.held = ids[: rows * self.row], [ids[rows * self.row :]]
        self.n_held = len(self.held[0])
        mask = np.ones(len(now), dtype=bool)
        if last and len(now) % self.row:
            fill = self.row - len(now) % self.row
            now, mask = np.append(now, np.zeros(fill, now.dtype)), np.append(mask, np.zeros(fill, bool))
        for at in range(0, len(now), self.row * ROWS_IN_BATCH):
            end = at + self.row * ROWS_IN_BATCH
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[at:end]), self.row) for x in (now, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self, id_type: pa.DataType) -> None:
        self.flush(-(-self.n_held // self.row), last=True)
        self.file.close()
        self.sink.close()
        columns = [pa.array([d[0] for d in self.docs], id_type), pa.array([d[1] for d in self.docs], pa.int64()), pa.array([d[2] for d in self.docs], pa.int64())]
        table = pa.table(columns, ["doc_id", "start", "length"])
        with self.files.open_output_stream(self.index_path) as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)


class Reader:
    """Random access to a token file: sequences by number, documents by place."""

    def __init__(self, address: str) -> None:
        files, path = place(address)
        local = isinstance(files, pafs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else files.open_input_file(path))
        with files.open_input_file(path + ".docs") as f:
            self.docs = pa.ipc.open_file(f).read_all()
        self.row = self.file.schema.field("ids").type.list_size

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence; the ids are a view of the file."""
        batch, at = divmod(number, ROWS_IN_BATCH)
        rows = self.file.get_batch(batch)
        ids, mask = (rows.column(c).slice(at, 1).flatten() for c in ("ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def streams(self) -> Iterator[np.ndarray]:
        for i in range(self.file.num_record_batches):
            rows = self.file.get_batch(i)
            ids, mask = (rows.column(c).flatten() for c in ("ids", "mask"))
            yield ids.to_numpy()[mask.to_numpy(zero_copy_only=False)]

    def checksums(self) -> np.ndarray:
        """crc32 of each document's ids as little-endian 32-bit numbers, batch by batch."""
        lengths = self.docs.column("length").to_numpy()
        ends, out = np.cumsum(lengths), np.zeros(len(lengths), dtype=np.int64)
        doc, at = 0, 0
        for ids in self.streams():
            data, used = ids.astype("<u4"), 0
            while used < len(data):
                take = min(len(data) - used, int(ends[doc]) - at)
                out[doc] = zlib.crc32(data[used : used + take].tobytes(), int(out[doc]))
                used, at = used + take, at + take
                doc += at == ends[doc]
        return out


def write_token_files(
    documents: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, row: int = ROW
) -> DataFrame:
    """Write the files into ``folder``; the list of them (part, path, n_docs, n_tokens), in order of part."""
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    spark = documents.sparkSession

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, tool = TaskContext.get().partitionId(), None, None
        address = f"{folder.rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                tool = encoder(vocabulary)
                out = Writer(address, max(tool.whole.get_vocab_size(), end_id + 1), row)
            ids = batch.column(0).to_pylist()
            for doc_id, tokens in zip(ids, tool.encode(batch.column(1).to_pylist())):
                out.add(doc_id, np.append(tokens, np.uint32(end_id)))
            id_type = batch.schema.field(0).type
        if out is not None:
            out.close(id_type)
            columns = [pa.array([part], pa.int32()), pa.array([address]), pa.array([len(out.docs)], pa.int64()), pa.array([out.n_tokens], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "path", "n_docs", "n_tokens"])

    order = F.asc_nulls_last("doc_id")
    dealt = docs.repartitionByRange(partitions(spark), order).sortWithinPartitions(order, "text")
    return Scratch(spark, "token-manifest").keep(dealt.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32, all from the files."""
    # one row per file: the running sum over them is small
    begin = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    listed = manifest.select("part", "path", F.coalesce(begin, F.lit(0)).cast("long").alias("begin"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                file = Reader(path)
                start = pa.array(file.docs.column("start").to_numpy() + before, pa.int64())
                columns = [file.docs.column("doc_id").combine_chunks(), start, file.docs.column("length").combine_chunks(), pa.array(file.checksums(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = listed.repartition(partitions(manifest.sparkSession), "part")
    return dealt.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
