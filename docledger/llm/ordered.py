"""Rows dealt to ranges of their ids, so that work on neighbours needs no global sort in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Rows of one range, and most ranges; beyond that ranges grow.
ROWS = 512
MOST = 8192


def range_of(docs: DataFrame, key: str = "doc_id", rows: int = ROWS) -> Column:
    """The number of the range of ids that a row falls in: ascending with ``key``, about ``rows`` rows each; null ids first.

    The borders are quantiles of the id column alone, at most ``MOST`` numbers.
    """
    n = docs.select(key).count()
    parts = min(MOST, max(1, -(-n // rows)))
    at = [i / parts for i in range(1, parts)]
    borders = np.unique(docs.select(F.col(key).cast("double").alias(key)).approxQuantile(key, at, 1 / (8 * parts)) if at else [])

    @arrow_udf("int")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ids = batch.cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            yield pa.array(np.searchsorted(borders, ids, side="right").astype(np.int32))

    return place(F.col(key))
