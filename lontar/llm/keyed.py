"""Large tables against sets of 64-bit keys, without shuffling the rows whose key is in no set.

A bit array of bounded size (two bits for each key) is broadcast instead of the keys. Rows that miss it are surely
not in the set; the others, few more than there are keys, are joined exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 28
SEEN_KEYS = 500_000


def key_bits(keys: DataFrame, column: str, most_bits: int = MOST_BITS) -> np.ndarray:
    """The bit array of a long column; its size follows the number of rows, up to 2**most_bits bits."""
    bits = min(max(20, (32 * max(1, keys.count())).bit_length()), most_bits)
    key = F.col(column)
    places = F.array(F.shiftrightunsigned(key, 64 - bits), key.bitwiseAND((1 << bits) - 1))
    words = keys.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint64)


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a key (uint64) is surely not in the set."""
    bits = len(words).bit_length() - 1 + 6
    ok = np.ones(len(keys), bool)
    for p in (keys >> np.uint64(64 - bits), keys & np.uint64((1 << bits) - 1)):
        ok &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def _split(df: DataFrame, column: str, shared, wanted: bool, once: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(column)
            held = may_hold(shared.value, keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & keys.is_valid().to_numpy(zero_copy_only=False)
            keep = held == wanted
            if once:
                if len(seen) > SEEN_KEYS:
                    seen = set()
                for i in np.flatnonzero(keep).tolist():
                    key = keys[i].as_py()
                    keep[i] = key not in seen
                    seen.add(key)
            yield batch.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def among(df: DataFrame, column: str, keys: DataFrame, once: bool = False) -> DataFrame:
    """Rows of df whose long column may be among the keys' (all that are, and a few more); once: a task leaves out most repeats of a key."""
    return _split(df, column, df.sparkSession.sparkContext.broadcast(key_bits(keys, column)), True, once)


def without(df: DataFrame, column: str, bad: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df that match no row of bad in all columns of ``on`` (null matches null); ``column`` is a long one of them."""
    shared = df.sparkSession.sparkContext.broadcast(key_bits(bad.filter(F.col(column).isNotNull()).select(column), column))
    maybe, held = _split(df, column, shared, True), bad.alias("bad")
    match = None
    for name in on:
        same = maybe[name].eqNullSafe(held[name])
        match = same if match is None else match & same
    return _split(df, column, shared, False).unionByName(maybe.join(held, match, "left_anti"))
