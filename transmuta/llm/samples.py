"""Samples chosen by a hash, of any share of the rows and without a global sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def below_share(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash is in the lowest `share` of its range; all are at share 1."""
    return F.lit(True) if share >= 1 else hashed < F.lit(int(share * 2**64) - 2**63)


def smallest(sized: DataFrame, most: int) -> int | None:
    """The largest hash of a sample, none without rows: the smallest distinct hashes up to the one whose size brings their sum to `most`.

    sized: hash long, size long. Copies share a hash and count once. A task keeps no more than such a sample of its rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            hashes, first = np.unique(np.concatenate((hashes, batch["hash"].to_numpy())), return_index=True)
            sizes = np.concatenate((sizes, batch["size"].to_numpy()))[first]
            n = int(np.searchsorted(np.cumsum(sizes), most)) + 1
            hashes, sizes = hashes[:n], sizes[:n]
        yield pa.RecordBatch.from_pydict({"hash": pa.array(hashes), "size": pa.array(sizes)})

    kind = "hash long, size long"
    rows = sized.select("hash", F.col("size").cast("long")).mapInArrow(run, kind).repartition("hash").mapInArrow(run, kind).collect()
    total, last = 0, None
    for r in sorted(rows):
        if total >= most:
            break
        last = r["hash"]
        total += r["size"]
    return last
