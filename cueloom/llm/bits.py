"""Bitmaps of a fixed size over hashed keys, to leave out rows before a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shuffles_freed

#: Two to this power bits: 16 MB, whatever the number of keys. A full bitmap lets everything through.
POWER = 27


def bitmap(keys: DataFrame, power: int = POWER):
    """Broadcast bitmap of ``keys(key long)``, which sets the bit of key modulo 2^power.

    Bits are merged before they reach the driver, in 2^(power - 6) words at most.
    """
    import numpy as np

    at = F.pmod("key", F.lit(1 << power))
    words = keys.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("bit"))
    with shuffles_freed(keys.sparkSession):
        got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out)


def is_set(words, keys):
    """Which of an array of int64 keys have their bit set."""
    import numpy as np

    at = keys & np.int64(64 * len(words) - 1)
    return (words[at >> np.int64(6)] >> (at & np.int64(63)) & np.int64(1)).astype(bool)
