"""Cells of Parquet files by pointer: (file, row group, row in it, column), with errors as values.

Pointers are dealt in ranges of their own order, so those into one file stand together and a file that most point into is still spread over
tasks. A task opens a file once, reads only the row groups that are asked for, of one column, a few rows at a time, and hands each
payload to a function or out as a row. Payloads are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quern.session import ensure_importable
from quern.sources.row_groups import failure, open_store

POINTER = ["parquet_path", "row_group", "row_in_group", "audio_column"]
#: Rows of a column that are held at a time, and bytes of results after which a batch is handed on.
STEP, MOST = 128, 16 << 20


class _File:
    """One open file at a time, and a place in the column that is read from it."""

    def __init__(self) -> None:
        self.path = self.file = self.stream = self.error = None

    def open(self, path: str) -> None:
        if path == self.path:
            return
        self.close()
        self.path, self.error, self.file = path, None, None
        try:
            store, inner = open_store(path)
            self.stream = store.open_input_file(inner)
            self.file = pq.ParquetFile(self.stream, pre_buffer=False)
        except (FileNotFoundError, pa.ArrowInvalid) as error:
            self.error = error

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None

    def cells(self, row_group: int, column: str, picks: list[int], texts: bool = False) -> Iterator[bytes | Exception]:
        """The payload or error of each pick, which are in ascending order; reads no further than the last."""
        if self.error:
            yield from [self.error] * len(picks)
            return
        field = self.file.schema_arrow.get_field_index(column)
        if field < 0:
            yield from [KeyError(f"no column {column}")] * len(picks)
            return
        if row_group is None or not 0 <= row_group < self.file.metadata.num_row_groups:
            yield from [IndexError("row_group is outside the file")] * len(picks)
            return
        rows = self.file.metadata.row_group(row_group).num_rows
        valid = [p for p in picks if p is not None and 0 <= p < rows]
        yield from [IndexError("row_in_group is outside row group")] * sum(p is None or p < 0 for p in picks)
        if valid:
            kind = self.file.schema_arrow.field(field).type
            nested = pa.types.is_struct(kind) and kind.get_field_index("bytes") >= 0
            at, i = 0, 0
            for batch in self.file.iter_batches(STEP, [row_group], [f"{column}.bytes" if nested else column], use_threads=False):
                while i < len(valid) and valid[i] < at + batch.num_rows:
                    cell = batch.column(0)[valid[i] - at].as_py()
                    yield _payload(cell["bytes"] if nested and cell is not None else cell, nested, texts)
                    i += 1
                if i == len(valid):
                    break
                at += batch.num_rows
        yield from [IndexError("row_in_group is outside row group")] * sum(p is not None and p >= rows for p in picks)


def _payload(cell, nested: bool, texts: bool) -> bytes | Exception:
    if isinstance(cell, (bytes, bytearray)) and (cell or not nested):
        return bytes(cell)
    if nested:
        return ValueError("Audio struct has no embedded bytes; refusing an unverified or stale path")
    if isinstance(cell, str):
        if texts:
            return cell.encode()
        return ValueError("Path-only audio is disabled")
    return TypeError(f"Unsupported audio cell type: {type(cell).__name__}")


def _fetch(batches: Iterator[pa.RecordBatch], function: Callable, names: list[str], kinds: list[pa.DataType], texts: bool) -> Iterator[pa.RecordBatch]:
    file, made, held = _File(), [], 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*made)) if made else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def runs() -> Iterator[list[tuple[tuple, dict]]]:
        """Pointers into one row group and column, as many as stand together in a batch."""
        for batch in batches:
            run: list[tuple[tuple, dict]] = []
            for row in batch.to_pylist():
                key = row.pop("__0"), row.pop("__1"), row.pop("__3")
                if run and run[-1][0][:3] != key:
                    yield run
                    run = []
                run.append(((*key, row.pop("__2")), row))
            if run:
                yield run

    for run in runs():
        path, row_group, column, _ = run[0][0]
        file.open(path or "")
        for (_, row), got in zip(run, file.cells(row_group, column or "", [k[3] for k, _ in run], texts), strict=True):
            error, values = None, None
            if isinstance(got, Exception):
                error = failure(got)
            else:
                try:
                    values = function(row, got)
                except Exception as e:  # what a payload does wrong is a value, counted by its kind
                    error = failure(e)
                held += len(got)
            made.append((*row.values(), *(values if values is not None else [None] * (len(kinds) - len(row) - 1)), error))
        if held >= MOST or len(made) >= 4096:
            yield out()
            made.clear()
            held = 0
    file.close()
    if made:
        yield out()


def map_cells(
    rows: DataFrame, function: Callable[[dict, bytes], tuple], fields: str, keep: list[str] | None = None, partitions: int | None = None, texts: bool = False,
) -> DataFrame:
    """(``keep``, ``fields``, error): ``function(row, payload)`` of the cell that each pointer names, in the task that reads it.

    ``rows`` have the columns of POINTER; ``row`` holds the columns of ``keep`` (all by default). A pointer out of bounds, a missing file or
    column, a cell without bytes and what ``function`` raises give nulls and ``error``, "kind:message". Every row gives one. A store that fails
    otherwise fails the task. Files are opened through Arrow's file systems, which every executor must reach. A column of strings holds paths, which are refused,
    unless ``texts`` says that they are payloads themselves, as UTF-8.
    """
    spark = rows.sparkSession
    ensure_importable(spark)
    keep = list(rows.columns) if keep is None else keep
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*[F.col(c) for c in keep], *[F.col(c).alias(f"__{i}") for i, c in enumerate(POINTER)])
    order = ["__0", "__1", "__3", F.col("__2").asc_nulls_first()]
    dealt = dealt.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([*[dealt.schema[c] for c in keep], *made, T.StructField("error", T.StringType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    return dealt.mapInArrow(partial(_fetch, function=function, names=schema.fieldNames(), kinds=kinds, texts=texts), schema)


def _same(row: dict, payload: bytes) -> tuple:
    return (payload,)


def fetch_cells(rows: DataFrame, keep: list[str] | None = None, partitions: int | None = None, texts: bool = False) -> DataFrame:
    """(``keep``, payload, error): the bytes that each pointer names."""
    return map_cells(rows, _same, "payload binary", keep, partitions, texts)


def fetch_audio(rows: DataFrame, sample_rate: int = 16_000, verify_duration: bool = True, partitions: int | None = None) -> DataFrame:
    """(the rows, audio, rate, error): decoded mono samples at one rate, after the checks of duration and of an audited hash.

    The duration of the row must be within the tolerance of the decoded one, and ``audio_sha1`` that of the payload where the row has one.
    """
    return map_cells(rows, partial(_decoded, sample_rate=sample_rate, verify=verify_duration), "audio array<float>, rate int", None, partitions)


def _decoded(row: dict, payload: bytes, sample_rate: int, verify: bool) -> tuple:
    import hashlib

    from quern.functions.audio import check_duration, decode, mono

    got = decode(payload)
    if not len(got.waveform):
        raise ValueError("Decoded audio contains zero frames")
    if verify:
        check_duration(row["duration"], len(got.waveform) / got.rate)
    if row.get("audio_sha1") and hashlib.sha1(payload).hexdigest() != row["audio_sha1"]:
        raise ValueError("embedded audio hash differs from audited manifest")
    return mono(got, sample_rate), sample_rate
