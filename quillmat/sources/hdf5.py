"""HDF5 files as a Python data source, read by ranges in many tasks; needs the optional library h5py where tasks run.

Every reader opens the file by its path, so that has to lie in a folder which all executors see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STEP = 1 << 20


def plain(a: np.ndarray) -> np.ndarray:
    """Texts as str, anything else as it is."""
    if a.dtype.kind in "OS":
        return np.array([x.decode() if isinstance(x, bytes) else str(x) for x in a], object)
    return a


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class RangeReader(DataSourceReader):
    """Rows ``first`` to ``last`` of what the options name, some at a time."""

    def __init__(self, options: dict, kind: str):
        self.path, self.group, self.kind = options["path"], options["group"], kind
        self.tasks = int(options.get("tasks", 64))

    def open(self):
        import h5py

        return h5py.File(self.path, "r")

    def length(self, g) -> int:
        return {"compressed": lambda: len(g["indptr"]) - 1, "dense": lambda: g.shape[0], "column": lambda: len(g["codes"]) if hasattr(g, "keys") else len(g)}[self.kind]()

    def partitions(self) -> list[Range]:
        with self.open() as f:
            n = self.length(f[self.group])
        size = max(1, -(-n // self.tasks))
        return [Range(a, min(a + size, n)) for a in range(0, n, size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        first, last = partition.value
        with self.open() as f:
            yield from getattr(self, f"_{self.kind}")(f[self.group], first, last)

    def _compressed(self, g, first: int, last: int) -> Iterator[pa.RecordBatch]:
        ends = np.asarray(g["indptr"][first : last + 1], np.int64)
        for at in range(int(ends[0]), int(ends[-1]), STEP):
            to = min(at + STEP, int(ends[-1]))
            outer = first + np.searchsorted(ends, np.arange(at, to), "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(outer, pa.int64()), pa.array(g["indices"][at:to].astype(np.int64)), pa.array(g["data"][at:to].astype(float))], ["outer", "inner", "value"])

    def _dense(self, g, first: int, last: int) -> Iterator[pa.RecordBatch]:
        step = max(1, STEP // max(1, g.shape[1]))
        for at in range(first, last, step):
            part = np.asarray(g[at : min(at + step, last)], float)
            r, c = np.nonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array(at + r), pa.array(c), pa.array(part[r, c])], ["outer", "inner", "value"])

    def _column(self, g, first: int, last: int) -> Iterator[pa.RecordBatch]:
        for at in range(first, last, STEP):
            to = min(at + STEP, last)
            if hasattr(g, "keys"):  # categories by code
                codes, categories = np.asarray(g["codes"][at:to]), plain(np.asarray(g["categories"][:]))
                values = [None if k < 0 else str(categories[k]) for k in codes]
            else:
                values = [str(x) for x in plain(np.asarray(g[at:to]))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, to)), pa.array(values, pa.string())], ["n", "value"])


class Cells(DataSource):
    """(outer, inner, value) of a compressed sparse group or, with ``dense``, of an array."""

    @classmethod
    def name(cls) -> str:
        return "quillmat_hdf5_cells"

    def schema(self) -> str:
        return "outer long, inner long, value double"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options, "dense" if self.options.get("dense") == "true" else "compressed")


class Column(DataSource):
    """(n, value) of one list, as text."""

    @classmethod
    def name(cls) -> str:
        return "quillmat_hdf5_column"

    def schema(self) -> str:
        return "n long, value string"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options, "column")


def read_cells(spark: SparkSession, path: str, group: str, dense: bool = False) -> DataFrame:
    spark.dataSource.register(Cells)
    return spark.read.format(Cells.name()).options(path=path, group=group, dense=str(dense).lower()).load()


def read_columns(spark: SparkSession, path: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """(n, one column for each name): ``columns`` gives a dataset and a Spark type for each."""
    spark.dataSource.register(Column)
    out = None
    for name, (group, kind) in columns.items():
        own = spark.read.format(Column.name()).options(path=path, group=group).load()
        own = own.selectExpr("n", f"cast(value as {kind}) as `{name}`")
        out = own if out is None else out.join(own, "n")
    return out
