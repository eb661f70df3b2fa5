"""Shared helpers: written intermediate tables, Arrow batches, words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import materialize, new_path, remove, shared_dir  # noqa: F401

#: The six ASCII white-space characters that separate words, as a Java/RE2 class body.
SPACE_CLASS = r"\x20\x09-\x0D"


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes: bytes.split() knows just these six separators."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same after lower-casing A-Z only (bytes.lower() leaves other letters alone)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000, weigh: str | None = None, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no slice has over ``rows`` rows or, beyond one row, ``most`` bytes in column ``weigh``."""
    for batch in batches:
        start = 0
        if weigh is None:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)
            continue
        size, total = pa.compute.fill_null(pa.compute.binary_length(batch.column(weigh)), 0).to_pylist(), 0
        for i, n in enumerate(size):
            if i > start and (total + n > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def unsigned(column) -> Column:
    """crc32 of a string's UTF-8 bytes as an unsigned long."""
    return F.crc32(column.cast("binary"))
