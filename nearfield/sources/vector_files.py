"""fvecs and ivecs files as Spark data sources.

A record is a little-endian int32 count followed by that many little-endian float32 (fvecs) or
int32 (ivecs) values. Files whose records all have one length are cut into byte ranges; files
with records of varying length are read one task per file. Paths may be files, folders or
comma-separated lists on any file system pyarrow can open.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from nearfield.session import file_count, staged

SPLIT_BYTES = 64 << 20
_BATCH_BYTES = 8 << 20


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and plain path of a path or URI."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{rest}")


def _list_files(paths: str) -> list[tuple[str, int]]:
    """``(path, size)`` of the data files behind a path list, sorted by path."""
    found: list[tuple[str, int]] = []
    for path in paths.split(","):
        system, plain = _open_fs(path.strip())
        info = system.get_file_info(plain)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        prefix = path.strip()[: len(path.strip()) - len(plain)] if path.strip().endswith(plain) else "file://"
        infos = system.get_file_info(fs.FileSelector(plain, recursive=True)) if info.type == fs.FileType.Directory else [info]
        found += [
            (prefix + i.path, i.size)
            for i in infos
            if i.type == fs.FileType.File and not re.search(r"(^|/)[_.]", i.path[len(plain.rstrip("/")) :] or i.base_name)
        ]
    # Numbers in names count as numbers, so part-100000 follows part-99999.
    natural = lambda f: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", f[0])]
    return sorted(found, key=natural)


@dataclass
class _Range(InputPartition):
    path: str
    start: int  # byte where the range begins
    records: int  # records to read, -1 for the rest of the file
    dim: int  # fixed record length, 0 when records vary
    ordinal: int  # ordinal of the first record

    def __init__(self, path: str, start: int, records: int, dim: int, ordinal: int):
        super().__init__(path)
        self.path, self.start, self.records, self.dim, self.ordinal = path, start, records, dim, ordinal


class _VecsReader(DataSourceReader):
    def __init__(self, options: dict, dtype: str):
        self.paths = options["path"]
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.layout = options.get("layout", "fixed")
        if self.layout not in ("fixed", "variable"):
            raise ValueError("layout must be 'fixed' or 'variable'")
        self.first, self.last = int(options.get("from", 0)), int(options.get("to", -1))
        self.dtype = dtype

    def partitions(self) -> list[InputPartition]:
        files = _list_files(self.paths)
        if self.layout == "variable":
            return [_Range(path, 0, -1, 0, 0) for path, size in files if size]
        parts: list[InputPartition] = []
        seen = 0
        for path, size in files:
            if not size:
                continue
            system, plain = _open_fs(path)
            with system.open_input_file(plain) as f:
                dim = int.from_bytes(f.read(4), "little", signed=True)
            if dim <= 0:
                raise ValueError(f"{path}: record length {dim} is not positive")
            width = 4 + 4 * dim
            if size % width:
                raise ValueError(f"{path}: truncated, or records vary in length (then set layout=variable)")
            total, step = size // width, max(1, self.split_bytes // width)
            low = max(0, self.first - seen)
            high = total if self.last < 0 else min(total, self.last - seen)
            for at in range(low, max(low, high), step):
                parts.append(_Range(path, at * width, min(step, high - at), dim, seen + at))
            seen += total
        return parts

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        system, plain = _open_fs(part.path)
        with system.open_input_file(plain) as f:
            f.seek(part.start)
            yield from (self._fixed(f, part) if part.dim else self._varying(f, part))

    def _batch(self, path: str, ordinals: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        kind = pa.float32() if self.dtype == "<f4" else pa.int32()
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
        names = pa.array([path] * len(ordinals), pa.string())
        column = "vector" if self.dtype == "<f4" else "neighbors"
        return pa.RecordBatch.from_arrays([names, pa.array(ordinals, pa.int64()), lists], names=["file", "ordinal", column])

    def _fixed(self, f, part: _Range) -> Iterator[pa.RecordBatch]:
        width = 4 + 4 * part.dim
        step = max(1, _BATCH_BYTES // width)
        for at in range(0, part.records, step):
            n = min(step, part.records - at)
            raw = np.frombuffer(f.read(n * width), "<i4").reshape(n, part.dim + 1)
            if (raw[:, 0] != part.dim).any():
                raise ValueError(f"{part.path}: records vary in length; set layout=variable")
            values = np.ascontiguousarray(raw[:, 1:]).view(self.dtype).ravel()
            offsets = np.arange(0, (n + 1) * part.dim, part.dim)
            yield self._batch(part.path, np.arange(n) + part.ordinal + at, offsets, values)

    def _varying(self, f, part: _Range) -> Iterator[pa.RecordBatch]:
        stream = io.BufferedReader(f, _BATCH_BYTES)
        ordinal, lengths, chunks, held = part.ordinal, [], [], 0
        last = part.ordinal + part.records if part.records >= 0 else -1

        def batch() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            values = np.concatenate(chunks) if chunks else np.zeros(0, self.dtype)
            return self._batch(part.path, np.arange(ordinal - len(lengths), ordinal), offsets, values)

        while ordinal != last and (head := stream.read(4)):
            n = int.from_bytes(head, "little", signed=True)
            if len(head) < 4 or n < 0 or (n == 0 and self.dtype == "<f4"):
                raise ValueError(f"{part.path}: bad record header at record {ordinal}")
            body = stream.read(4 * n)
            if len(body) < 4 * n:
                raise ValueError(f"{part.path}: truncated record {ordinal}")
            lengths.append(n)
            chunks.append(np.frombuffer(body, self.dtype))
            ordinal, held = ordinal + 1, held + 4 + 4 * n
            if held >= _BATCH_BYTES:
                yield batch()
                lengths, chunks, held = [], [], 0
        if lengths:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _VecsWriter(DataSourceArrowWriter):
    """One file per task, written aside and renamed when the job commits."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool, dtype: str):
        self.root, self.overwrite, self.dtype, self.column = options["path"], overwrite, dtype, schema.names[-1]
        self.extension = "fvecs" if dtype == "<f4" else "ivecs"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, root = _open_fs(self.root)
        system.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        held = f"{root}/_attempt-{part:05d}-{uuid.uuid4().hex}"
        rows = 0
        with system.open_output_stream(held) as out:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(self.column))
                if column.null_count or column.flatten().null_count or (len(column) and pc.min(pc.list_value_length(column)).as_py() == 0):
                    raise ValueError(f"{self.column}: null or empty vectors, or null elements, have no form in this format")
                offsets = column.offsets.to_numpy()
                values = column.values.cast(pa.float32() if self.dtype == "<f4" else pa.int32())
                values = values.to_numpy(zero_copy_only=False).astype(self.dtype, copy=False).view("<i4")
                lengths = np.diff(offsets).astype("<i4")
                # Each record's header goes in front of its first value.
                body = values[offsets[0] : offsets[-1]]
                out.write(np.insert(body, offsets[:-1] - offsets[0], lengths).tobytes())
                rows += len(column)
        if not rows:
            system.delete_file(held)
            return _Written([])
        return _Written([(held, f"{root}/part-{part:010d}.{self.extension}")])

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        system, root = _open_fs(self.root)
        moves = [pair for m in messages if m is not None for pair in m.files]
        existing = [i for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith("part-")]
        if existing and not self.overwrite:
            raise FileExistsError(f"{self.root} holds data; use mode overwrite")
        for info in existing:
            system.delete_file(info.path)
        for held, final in moves:
            system.move(held, final)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        system, _ = _open_fs(self.root)
        for held, _ in [pair for m in messages if m is not None for pair in m.files]:
            system.delete_file(held)


class FvecsSource(DataSource):
    """``spark.read.format("fvecs")``; options ``path``, ``from``, ``to``, ``splitBytes``, ``layout``."""

    dtype, value_type = "<f4", "vector array<float>"

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        return f"file string, ordinal long, {self.value_type}"

    def _lowered(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> DataSourceReader:
        return _VecsReader(self._lowered(), self.dtype)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _VecsWriter(self._lowered(), schema, overwrite, self.dtype)


class IvecsSource(FvecsSource):
    dtype, value_type = "<i4", "neighbors array<int>"

    @classmethod
    def name(cls) -> str:
        return "ivecs"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)


_SPLIT = "number bigint, path string, start bigint, records bigint"


def record_splits(spark: SparkSession, path: str, dtype: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(path, start, records, ordinal)``: where files of records of any length can be cut.

    Tasks walk the record headers, one file each, and note a place about every ``split_bytes``; only
    these places are added up and come back, so reading is not bound to one task per file.
    """
    files = spark.createDataFrame([(i, f, size) for i, (f, size) in enumerate(_list_files(path)) if size], "number long, path string, size long")
    least = 1 if dtype == "<f4" else 0

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for number, name, size in zip(*(c.to_pylist() for c in batch.columns)):
                system, plain = _open_fs(name)
                with system.open_input_file(plain) as f:
                    at = start = records = seen = 0
                    while at < size:
                        head = f.read_at(4, at)
                        n = int.from_bytes(head, "little", signed=True)
                        if len(head) < 4 or n < least:
                            raise ValueError(f"{name}: bad record header at record {seen}")
                        at, records, seen = at + 4 + 4 * n, records + 1, seen + 1
                        if at > size:
                            raise ValueError(f"{name}: truncated record {seen - 1}")
                        if at - start >= split_bytes or at == size:
                            rows.append((number, name, start, records))
                            start, records = at, 0
            columns = list(zip(*rows)) or [()] * 4
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["number", "path", "start", "records"])

    splits = staged(files.repartition(max(1, files.count())).mapInArrow(walk, _SPLIT), "splits")
    before = F.sum("records").over(Window.orderBy("number", "start").rowsBetween(Window.unboundedPreceding, -1))
    return splits.select("path", "start", "records", F.coalesce(before, F.lit(0)).alias("ordinal"))


def _read_splits(splits: DataFrame, source: type[FvecsSource]) -> DataFrame:
    """The records of splits, each split in a task of its own."""
    options, dtype = {"path": "", "layout": "variable"}, source.dtype

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _VecsReader(options, dtype)
        for batch in batches:
            for name, start, records, ordinal in zip(*(c.to_pylist() for c in batch.columns)):
                yield from reader.read(_Range(name, start, records, 0, ordinal))

    return splits.repartition(max(1, splits.count())).mapInArrow(read, f"file string, ordinal long, {source.value_type}")


def qualified(spark: SparkSession, paths: str) -> str:
    """A path list with the file system of each path spelled out: the session's own, unless it says."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def one(path: str) -> str:
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(conf).makeQualified(place).toString()

    return ",".join(one(p.strip()) for p in paths.split(","))


def _read(spark: SparkSession, source: str, path: str, layout: str, start: int, stop: int | None) -> DataFrame:
    register(spark)
    path = qualified(spark, path)
    reader = spark.read.format(source).option("layout", layout)
    if layout == "fixed":
        return reader.option("from", start).option("to", -1 if stop is None else stop).load(path)
    kind = FvecsSource if source == "fvecs" else IvecsSource
    splits = record_splits(spark, path, kind.dtype).filter(F.col("ordinal") + F.col("records") > start)
    df = _read_splits(splits if stop is None else splits.filter(F.col("ordinal") < stop), kind)
    if stop is not None:
        df = df.filter(F.col("ordinal") < stop)
    return df.filter(F.col("ordinal") >= start) if start else df


def read_fvecs(
    spark: SparkSession, path: str, layout: str = "fixed", start: int = 0, stop: int | None = None
) -> DataFrame:
    """``(ordinal, vector)`` of fvecs files, ordinals counted from 0 in file order.

    ``start`` and ``stop`` select a record range; with fixed-length records only those bytes are
    read. ``layout="variable"`` accepts records of different lengths; see ``record_splits``.
    """
    return _read(spark, "fvecs", path, layout, start, stop).select("ordinal", "vector")


def read_ivecs(
    spark: SparkSession, path: str, layout: str = "fixed", start: int = 0, stop: int | None = None
) -> DataFrame:
    """``(query_ordinal, neighbors)`` of ivecs files, repeated neighbours dropped."""
    df = _read(spark, "ivecs", path, layout, start, stop)
    return df.select(F.col("ordinal").alias("query_ordinal"), F.array_distinct("neighbors").alias("neighbors"))


def truth_pairs(ground_truth: DataFrame) -> DataFrame:
    """Ground truth lists as ``(query_id, doc_id)`` pairs, the form the recall operators take."""
    return ground_truth.select(
        F.col("query_ordinal").alias("query_id"), F.explode(F.col("neighbors").cast("array<long>")).alias("doc_id")
    )


def write_vecs(df: DataFrame, path: str, order_col: str, value_col: str, source: str, files: int | None = None) -> None:
    """Write an array column as fvecs or ivecs files; record order follows ``order_col``.

    Without ``files`` their number follows from the number of elements.
    """
    register(df.sparkSession)
    if files is None:
        n = df.agg(F.coalesce(F.sum(F.size(value_col)), F.lit(0))).first()[0]
        files = file_count(df.sparkSession, 4 * n)
    ranged = df.repartitionByRange(files, order_col).sortWithinPartitions(order_col)
    ranged.select(value_col).write.format(source).mode("overwrite").save(qualified(df.sparkSession, path))
