"""Cells or rows of a table on the host, in a file: what a list of them would give, without holding them."""

from __future__ import annotations

import pickle
import tempfile
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Items that are pickled together, and that are in memory at a time.
BATCH = 5000


class Values(Sequence):
    """Read once, by partition, in the table's order; batches of items come back from a file of the driver's
    disk, which goes with the object. Equal to a list of the same items."""

    def __init__(self, df: DataFrame, cells: bool = False):
        """cells: items are the cells of the one column, else dictionaries of rows."""
        self._file = tempfile.TemporaryFile()
        self._offsets: list[int] = []  # of batches in the file
        self._ends: list[int] = []  # items up to each batch's end
        self._at, self._held = -1, []
        n = 0
        for size, data in spooled(_pickled(df, cells)):
            self._offsets.append(self._file.tell())
            self._file.write(data)
            n += size
            self._ends.append(n)

    def __len__(self) -> int:
        return self._ends[-1] if self._ends else 0

    def _batch(self, k: int) -> list:
        if k != self._at:
            self._file.seek(self._offsets[k])
            self._held = pickle.load(self._file)
            self._at = k
        return self._held

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        place = i + len(self) if i < 0 else i
        if not 0 <= place < len(self):
            raise IndexError(f"there is no item {i}")
        k = bisect_right(self._ends, place)
        return self._batch(k)[place - (self._ends[k - 1] if k else 0)]

    def __iter__(self) -> Iterator:
        for k in range(len(self._ends)):
            yield from self._batch(k)

    def __eq__(self, other) -> bool:
        return isinstance(other, (list, Values)) and len(self) == len(other) and all(a is b or a == b for a, b in zip(self, other))

    __hash__ = None

    def __add__(self, other) -> list:
        return [*self, *other]

    def __radd__(self, other) -> list:
        return [*other, *self]

    def __repr__(self) -> str:
        shown = ", ".join(map(repr, islice(self, 20)))
        return f"[{shown}{', ...' if len(self) > 20 else ''}]"


def spooled(table: DataFrame | RDD) -> Iterator:
    """The rows in order: all partitions are computed at once, to the executors' disks, and come to the
    driver one by one."""
    table.persist(StorageLevel.DISK_ONLY)
    try:
        table.count()
        yield from table.toLocalIterator()
    finally:
        table.unpersist()


#: Types whose cells Arrow gives just as Spark's rows do.
PLAIN = (T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType, T.StringType)


def _pickled(df: DataFrame, cells: bool) -> DataFrame | RDD:
    """(number, pickled list) of each batch of items."""

    def from_arrow(batches):
        import pyarrow as pa

        for b in batches:
            for s in range(0, b.num_rows, BATCH):
                part = b.slice(s, BATCH)
                items = part.column(0).to_pylist() if cells else part.to_pylist()
                yield pa.RecordBatch.from_pydict({"n": [len(items)], "data": pa.array([pickle.dumps(items, pickle.HIGHEST_PROTOCOL)], pa.binary())})

    def from_rows(rows):
        rows = iter(rows)
        while items := [r[0] if cells else r.asDict() for r in islice(rows, BATCH)]:
            yield len(items), pickle.dumps(items, pickle.HIGHEST_PROTOCOL)

    if df.columns and all(isinstance(f.dataType, PLAIN) for f in df.schema.fields):
        return df.mapInArrow(from_arrow, "n long, data binary")
    return df.rdd.mapPartitions(from_rows)
