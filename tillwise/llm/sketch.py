"""A fixed-size sketch of a key set, to thin out rows before a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.textscan import mix

#: At most so many positions are broadcast, however many keys there are.
POSITIONS = 1 << 20
#: Bits of the sketch for numpy, and bits that one row of it holds.
BITS, _ROW_BITS = 1 << 26, 1 << 16


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it differ, in any case,
    from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def position(*key: Column) -> Column:
    """The position of a key. Equal keys have equal positions; others rarely."""
    return F.pmod(F.xxhash64(*key), F.lit(POSITIONS))


def positions(keys: DataFrame) -> DataFrame:
    """The distinct positions of the rows of ``keys``: (position), bounded by
    ``POSITIONS`` and so safe to broadcast. A semi-join with it keeps every row
    whose key is among ``keys`` and few others; it never decides alone."""
    return keys.select(position(*[F.col(c) for c in keys.columns]).alias("position")).distinct()


def split_by_id(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts by the one column of ``ids``, of the same name: rows whose id
    is certainly not among them, which need no shuffle, and the others, few of which are
    not. Together they are all rows. Null is an id."""
    [name] = unused(docs, "position")
    at = positions(ids).withColumnRenamed("position", name)
    key = position(F.col(ids.columns[0])) == F.col(name)
    return docs.join(F.broadcast(at), key, "left_anti"), docs.join(F.broadcast(at), key, "left_semi")


def _places(ids: pa.Array, hashes: np.ndarray) -> list[np.ndarray]:
    """Three bits of each pair of an id, which may be null, and a hash."""
    number = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64)
    key = mix(hashes.view(np.uint64) ^ mix(number + np.uint64(1)) ^ np.asarray(ids.is_null()).astype(np.uint64))
    return [((key >> np.uint64(shift)) % np.uint64(BITS)).astype(np.int64) for shift in (0, 19, 38)]


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(np.concatenate(_places(batch.column(0), np.asarray(batch.column(1)))))
        yield pa.RecordBatch.from_arrays([pa.array(at // _ROW_BITS), pa.array(at % _ROW_BITS)], ["row", "bit"])


def _packed(table: pa.Table) -> pa.Table:
    held = np.zeros(_ROW_BITS, np.uint8)
    held[np.asarray(table["bit"].combine_chunks())] = 1
    return pa.table({"row": table["row"][:1], "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})


def bits(keys: DataFrame) -> np.ndarray:
    """A sketch of ``keys`` (id long, hash long) for ``among``: 8 MB, however many keys there
    are. A job runs when called."""
    rows = keys.mapInArrow(_set_bits, "row long, bit long").distinct().groupBy("row").applyInArrow(
        _packed, "row long, bits binary")
    held = np.zeros((BITS // _ROW_BITS, _ROW_BITS // 8), np.uint8)
    for row, packed in rows.collect():
        held[row] = np.frombuffer(packed, np.uint8)
    return held.reshape(-1)


def among(sketch: np.ndarray, ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
    """Which pairs of an id and a hash may be in ``sketch``: all that are and few others."""
    found = np.ones(len(hashes), bool)
    for at in _places(ids, hashes):
        found &= (sketch[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return found
