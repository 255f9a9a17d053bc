"""What several operators share: row identity, ASCII folding, compact checkpoints and batch slicing."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tapeworks.runtime import checkpoint_dir, materialize

# Fixed values of the contracts: the six ASCII blanks, and what stands for a document without an id.
BLANKS = "\t\n\x0b\x0c\r "
NO_ID = -(2**63)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def keep(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder; for compact rows only, never for texts."""
    return materialize(df)


def id_or_none(name: str = "doc_id") -> Column:
    """The id as a long, with a value below all others for a null one, so that joins and minima see it."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def as_id(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else; a text of ASCII alone may take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(column) == F.char_length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, upper, upper.lower()))


def binary_text(column: Column) -> Column:
    return F.encode(column, "UTF-8")


def blocks(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of about ``limit`` bytes of one binary column, a longer value alone."""
    for batch in batches:
        lengths = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0))
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def where(docs: DataFrame, text: Column, judge: Callable[[list[bytes | None]], np.ndarray], limit: int = 1 << 20) -> DataFrame:
    """The rows whose text is kept by ``judge``, which sees about ``limit`` bytes at a time: only the text goes to Python, a flag comes back."""

    @F.arrow_udf("boolean")
    def stay(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            batch = pa.RecordBatch.from_arrays([array], names=["t"])
            flags = [np.zeros(0, dtype=bool), *(judge(part.column(0).to_pylist()) for part in blocks(iter([batch]), 0, limit))]
            yield pa.array(np.concatenate(flags))

    return docs.filter(stay(text))


def word_runs(data: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists that cover about ``limit`` bytes each; one empty list for a blank text."""
    if len(data) <= limit:
        yield data.split()
        return
    start = 0
    while start < len(data):
        cut = _BLANK.search(data, min(start + limit, len(data)))
        stop = cut.start() if cut else len(data)
        yield data[start:stop].split()
        start = stop if stop > start else len(data)


def table(df: DataFrame) -> DataFrame:
    """A written copy in the shared folder, as Parquet: what ``keep`` does, for rows that would be bulky there."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of_id(name: str = "doc_id") -> Column:
    """The unsigned crc32 of the id as text; of nothing for a null id."""
    return F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8"))
