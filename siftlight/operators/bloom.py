"""A Bloom filter over the values of one column, for proving that a key is absent."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY = 12
#: With fewer bits a key hardly any absent key is proved, and the filter is left out.
LEAST_BITS_PER_KEY = 3
#: A filter takes at most this part of an executor's memory, as each of its Python workers has a copy, and at
#: least LEAST_LIMIT bits are allowed (16 MB).
MEMORY_SHARE = 64
LEAST_LIMIT, MOST_BITS = 1 << 27, 1 << 32


def limit_of(spark: SparkSession) -> int:
    """Bits that a filter may have in this session, by the memory of an executor; a power of two."""
    text = spark.sparkContext.getConf().get("spark.executor.memory", "1g")
    memory = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)
    bits = memory * 8 // MEMORY_SHARE
    return max(LEAST_LIMIT, min(MOST_BITS, 1 << (bits.bit_length() - 1)))


class BloomFilter:
    """Built by the executors, combined into words of 64 bits, broadcast as one bitmap.

    Its size follows from the number of keys, up to ``max_bits`` (by default what ``limit_of`` allows); the
    driver gets a 64th of that many words. Where that leaves a key fewer than LEAST_BITS_PER_KEY bits nothing
    is built and nothing is proved: every key but null may then be there. Null keys are found absent.
    """

    def __init__(self, df: DataFrame, column: str, max_bits: int | None = None, bits_per_key: int = BITS_PER_KEY):
        max_bits = max_bits or limit_of(df.sparkSession)
        keys = df.select(F.col(column).alias("key")).where("key is not null")
        n = keys.agg(F.approx_count_distinct("key", 0.02)).first()[0]
        bits = 1 << max(10, math.ceil(math.log2(max(1, n) * bits_per_key)))
        self.bits = min(bits, max_bits)
        self.useful = self.bits >= LEAST_BITS_PER_KEY * n
        if not self.useful:
            return
        self.hashes = max(1, min(8, round(self.bits / max(1, n) * math.log(2))))
        pairs = keys.select(*self._hashes(F.col("key"))).select(
            F.explode(F.array(*(self._position(i) for i in range(self.hashes)))).alias("at")
        )
        words = pairs.groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")
        )
        got = words.toPandas()  # bounded: bits / 64 rows
        bitmap = np.zeros(self.bits // 64, np.uint64)
        bitmap[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
        self._bitmap = df.sparkSession.sparkContext.broadcast(bitmap)

    @staticmethod
    def _hashes(key: Column) -> tuple[Column, Column]:
        return F.xxhash64(key).alias("h"), F.xxhash64(key, F.lit(1)).alias("g")

    def _position(self, i: int) -> Column:
        # wraps silently only outside ANSI mode, so both parts are cut to the size of the filter first
        mask = F.lit(self.bits - 1)
        return (F.col("h").bitwiseAND(mask) + i * F.col("g").bitwiseAND(mask)).bitwiseAND(mask)

    def may_contain(self, key: Column) -> Column:
        """False only where the key is certainly not in the filter."""
        if not self.useful:
            return key.isNotNull()
        bitmap, mask, hashes = self._bitmap, np.int64(self.bits - 1), self.hashes

        @F.pandas_udf("boolean")
        def test(h: pd.Series, g: pd.Series) -> pd.Series:
            a, b = h.to_numpy(np.int64) & mask, g.to_numpy(np.int64) & mask
            found = np.ones(len(a), bool)
            for i in range(hashes):
                at = (a + i * b) & mask
                word = bitmap.value[at >> 6]
                found &= ((word >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            return pd.Series(found)

        h, g = self._hashes(key)
        return key.isNotNull() & test(h, g)
