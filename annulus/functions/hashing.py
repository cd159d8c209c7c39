"""SplitMix64, the public 64-bit mixer, over Arrow batches. Long arithmetic would overflow in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published generator.
_GAMMA, _FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def splitmix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + _GAMMA
        z = (z ^ (z >> np.uint64(30))) * _FIRST
        z = (z ^ (z >> np.uint64(27))) * _SECOND
    return z ^ (z >> np.uint64(31))


def splitmix_shard(ids: Column, shards: int) -> Column:
    """The hash, unsigned, modulo ``shards``."""

    def run(batch):
        return pd.Series((splitmix64(batch.to_numpy(np.int64).view(np.uint64)) % np.uint64(shards)).astype(np.int32))

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "int")(ids)
