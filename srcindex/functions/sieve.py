"""A Bloom filter of fixed size that keeps rows from being shuffled to a join that they would leave."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter, at most (8 MB), and bits for a key while there are few keys.
BITS, PER_KEY = 1 << 26, 16


def sieve(frame: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``frame`` without most of the rows whose ``column`` is not in ``keys`` (null is a key like others).

    A join has to follow: some other rows pass. The filter never grows beyond BITS bits;
    with very many keys it lets everything pass and the join does all the work. Its bits
    are a broadcast row that the JVM looks into: a Python worker for this would stand
    beside the one that works on the rows.
    """
    n = keys.count()
    size = 1 << min(BITS, max(1 << 10, n * PER_KEY)).bit_length() - 1
    places = [F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.lit(size)) for salt in (1, 2)]
    # at most BITS / 64 rows come to the driver
    words = (keys.select(F.explode(F.array(*places)).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("at"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("word")).toArrow())
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("at").to_numpy()] = words.column("word").to_numpy()
    row = pa.table({"sieve_bits": pa.ListArray.from_arrays(pa.array([0, len(bits)], pa.int32()), pa.array(bits))})

    def holds(place):
        word = F.get("sieve_bits", F.shiftright(place, 6).cast("int"))
        return F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    return (frame.crossJoin(F.broadcast(frame.sparkSession.createDataFrame(row)))
            .where(holds(places[0]) & holds(places[1])).drop("sieve_bits"))
