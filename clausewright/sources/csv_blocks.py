"""SC8: quoted CSV files in parallel. A quoted field may hold line ends, so a line end alone says nothing about where a
record begins; the number of quotes before it does: it ends a record if that is even. Blocks of bytes are counted first,
their sums tell each block how many quotes stand before it, and then every block reads the records that begin in it."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.sources.shared import store_of

BLOCK_BYTES = 32_000_000
#: Bytes that are read at once behind a block, for its last record, and for a header.
MORE = 1 << 16


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    store, root = store_of(path)
    base = store.get_file_info(root)
    found = [base] if base.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.size and not i.base_name.startswith(("_", ".")))


def record_ends(data: bytes, quotes_before: int) -> np.ndarray:
    """Places behind the line ends of `data` that end a record."""
    own = np.frombuffer(data, dtype=np.uint8)
    inside = np.cumsum(own == 34) + quotes_before
    return np.flatnonzero((own == 10) & (inside % 2 == 0)) + 1


def _header(store, path: str) -> list[str]:
    with store.open_input_file(path) as file:
        data = b""
        while part := file.read(MORE):
            data += part
            if len(ends := record_ends(data, 0)):
                data = data[: ends[0]]
                break
    return next(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")), [])


def records_of(file, start: int, end: int, quotes_before: int) -> bytes:
    """The records that begin within [start, end) of a file, whole. The byte before the block tells whether one begins
    with it."""
    first = max(start - 1, 0)
    file.seek(first)
    data = file.read(end - first)
    quotes = quotes_before - (start > 0 and data[:1] == b'"')
    ends = record_ends(data, quotes)
    begin = 0 if start == 0 else int(ends[0]) if len(ends) else len(data)
    if begin >= len(data):
        return b""  # a record of an earlier block goes through all of this one
    # The last record may go on behind the block.
    if not len(ends) or ends[-1] < len(data):
        quotes += data.count(b'"')
        parts = [data]
        while more := file.read(MORE):
            later = record_ends(more, quotes)
            if len(later):
                parts.append(more[: later[0]])
                break
            parts.append(more)
            quotes += more.count(b'"')
        data = b"".join(parts)
    return data[begin:]


def read_quoted_csv(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The records of the CSV files at `path` as text columns named by their headers, which must agree. Files follow RFC
    4180: fields with quotes, separators or line ends are quoted, quotes within are doubled. Fields that a record lacks
    are null, further ones are left out; blank lines are no records; files without a byte are none. The driver sees names
    and lengths of files, their headers, and plans a row a block; a record longer than a block is read by the block that
    it begins in."""
    files = _files(path)
    store, _ = store_of(path)
    names = _header(store, files[0][0]) if files else []
    if any(_header(store, other) != names for other, _ in files[1:]):
        raise ValueError("the headers of the files differ")
    if not names:
        return spark.createDataFrame([], "value string")
    rows = [(file, k, at, min(at + block_bytes, size)) for file, size in files for k, at in enumerate(range(0, size, block_bytes))]
    plan = "path string, k long, start long, end long"
    blocks = spark.createDataFrame(rows, plan).repartition(max(1, min(len(rows), 10_000)), "path", "k")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _ = store_of(path)
        for batch in batches:
            found = []
            for file, start, end in zip(batch["path"], batch["start"], batch["end"]):
                with own.open_input_file(file) as opened:
                    opened.seek(start)
                    found.append(opened.read(end - start).count(b'"'))
            yield batch.assign(quotes=found)

    # One number a block: their sums are small, whatever the files are.
    before = F.sum("quotes").over(Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    counted = blocks.mapInPandas(count, f"{plan}, quotes long").withColumn("before", F.coalesce(before, F.lit(0))).repartition(max(1, min(len(rows), 10_000)), "path", "k")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _ = store_of(path)
        for batch in batches:
            for file, start, end, quotes in zip(batch["path"], batch["start"], batch["end"], batch["before"]):
                with own.open_input_file(file) as opened:
                    data = records_of(opened, start, end, int(quotes))
                csv.field_size_limit(max(len(data), 131_072))
                records = csv.reader(io.StringIO(data.decode("utf-8-sig" if start == 0 else "utf-8"), newline=""))
                if start == 0:
                    next(records, None)
                kept = [(r + [None] * len(names))[: len(names)] for r in records if r]
                for i in range(0, len(kept), 10_000):
                    yield pd.DataFrame(kept[i : i + 10_000], columns=names, dtype=object)

    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return counted.mapInPandas(read, schema)
