"""A step over files or clips that may fail for single rows without ending the job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from glossloom.session import checkpoint


def guarded(df: DataFrame, step: Callable[[dict], dict], schema: str, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(done, failed): the step's rows, and (path, error) of the rows for which it raised or gave values of a wrong type.

    The step gets a row as a dict and returns the columns of `schema`; missing ones
    are null. Every row of df is in exactly one of the two tables. The step runs
    once; both tables read its checkpointed result, so a rerun after a lost
    executor repeats single partitions. A null path is kept in both tables.
    """
    fields = StructType.fromDDL(schema)
    names = fields.fieldNames()
    if path not in names:
        fields = StructType([df.schema[path], *fields])
    fields = fields.add("error", StringType())
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    done = {**{n: None for n in names}, path: row[path], **step(row), "error": None}
                    pa.RecordBatch.from_pylist([done], schema=target)
                except Exception as e:  # any failure of one row is logged and the others go on
                    done = {path: row[path], "error": f"{type(e).__name__}: {e}"}
                out.append(done)
            yield pa.RecordBatch.from_pylist(out, schema=target)

    rows = checkpoint(df.mapInArrow(run, fields))
    return rows.filter("error IS NULL").select(*[f for f in fields.fieldNames() if f != "error"]), rows.filter("error IS NOT NULL").select(path, "error")
