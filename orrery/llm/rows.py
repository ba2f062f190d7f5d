"""Row identity shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.staging import Stages

ROW = "__orrery_row"


def with_row_key(docs: DataFrame, doc_id: str, stages: Stages) -> tuple[DataFrame, bool]:
    """``docs`` with a long column ``ROW`` that is unique and the same in every scan.

    That is the id itself where ids are unique and not null (second value: True). Otherwise the
    rows are numbered once, in the order (id, row), and written to a stage table, since a number
    made while scanning need not come out alike in another scan.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("id"))
    if ids.groupBy("id").count().where("id IS NULL OR count > 1").isEmpty():
        return docs.withColumn(ROW, F.col(doc_id).cast("long")), True
    ordered = docs.repartitionByRange(F.col(doc_id).cast("long").asc_nulls_last()).sortWithinPartitions(F.col(doc_id).cast("long").asc_nulls_last())
    return stages.save(ordered.withColumn(ROW, F.monotonically_increasing_id()), "numbered"), False


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``, giving back at a task's end what the allocators keep: workers live on, and
    several of them share an executor's memory."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # a C library without it
            pass

    return run
