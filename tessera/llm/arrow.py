"""Arrow batches between Spark and numpy code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

#: rows of text that one batch may hold, so that a worker's memory follows the longest texts
TEXT_ROWS = 512


def small_batches(df: DataFrame, rows: int = TEXT_ROWS) -> DataFrame:
    """Bounds what Spark hands to a Python worker at once: rows, and bytes where it can."""
    for name, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 32 << 20)):
        df.sparkSession.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
    return df


def arrow_schema(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))


def record_batch(kind: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in kind], schema=kind)


def slices(batch: pa.RecordBatch, rows: int, most_bytes: int | None = None,
           column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of ``rows`` rows at most, and of ``most_bytes`` of text if that is given; a longer
    text is a part by itself."""
    if most_bytes is None:
        cuts = range(0, batch.num_rows, rows)
    else:
        cuts, have = [], most_bytes + 1
        for at, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            have += size or 0
            if have > most_bytes or at - cuts[-1] >= rows:
                cuts.append(at)
                have = size or 0
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def map_rows(df: DataFrame, fn: Callable[..., dict], uses: list[str], schema: str | StructType,
             rows: int = TEXT_ROWS, most_bytes: int | None = None) -> DataFrame:
    """``fn(*lists of the columns uses)`` gives the columns of the output batch, of any one
    length; columns of ``schema`` that it leaves out pass through."""
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows, most_bytes):
                out = fn(*[part.column(n).to_pylist() for n in uses])
                kept = {f.name: part.column(f.name) for f in kind if f.name not in out}
                yield record_batch(kind, kept | out)

    return small_batches(df).mapInArrow(run, schema)
