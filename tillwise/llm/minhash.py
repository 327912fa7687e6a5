"""Near duplicates by MinHash: banded minima, verified signatures, verified sets.

* Every text's shingle set is reduced to minima under many universal hash functions
  ``a x + b``. Minima are banded; sets with equal minima in a band share a bucket.
* Buckets of one set are dropped, and of buckets with the same sets one is kept.
  Inside a bucket, in pairs of bounded blocks, signatures are compared. What is
  returned is a forest of the pairs that agree in enough minima, never all pairs.
* The trees of those forests, joined by alternating large-star and small-star, are
  clusters. Their texts are read again, and the links in a cluster confirmed on full
  sets, again in pairs of blocks that return a forest.
* Large-star and small-star over the confirmed forests give the groups.

With 32 bands of 4 minima a pair of similarity 0.85 shares no bucket with probability
(1 - 0.85^4)^32 < 10^-10, and agrees in too few of 128 minima about as rarely.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.jaccard_join import shingle_sets
from tillwise.llm.sketch import position, positions
from tillwise.llm.textscan import mix
from tillwise.plans.components import components
from tillwise.plans.durable import written_once

#: Bands of minima, and minima in a band.
BANDS, MINIMA = 32, 4
#: Sets in a block, and bytes of sets, about.
BLOCK_SETS, BLOCK_BYTES = 1024, 16 << 20
#: A signature agrees where at most so many standard deviations fewer minima are equal
#: than a pair at the threshold has on average.
DEVIATIONS = 6.5

#: Shingles that are hashed together: the scratch arrays stay in a core's cache.
_STEP = 1 << 16
_FACTORS = mix(np.arange(1, BANDS * MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(1 << 20, (1 << 20) + BANDS * MINIMA, dtype=np.uint64))
_MEMBERS = "doc_id long, n long, fp long, fp2 long, signature binary, bands binary"


def least_agreement(percent: int) -> int:
    """Equal minima below which a pair is not looked at."""
    n, p = BANDS * MINIMA, percent / 100
    return max(1, int(n * p - DEVIATIONS * (n * p * (1 - p)) ** 0.5))


# -- signatures ---------------------------------------------------------------------

def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of every set (rows), none of which is empty, under each function."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.full((BANDS * MINIMA, len(sets)), np.iinfo(np.uint64).max, np.uint64)
    if not len(sets):
        return out.T
    tokens, at = np.concatenate(sets), np.concatenate(([0], np.cumsum(size)))
    for low in range(0, len(tokens), _STEP):
        some = tokens[low:low + _STEP]
        first = np.searchsorted(at, low, "right") - 1
        last = np.searchsorted(at, low + len(some), "left")
        begins = np.maximum(at[first:last] - low, 0)
        hashed = np.empty_like(some)
        for row, a, b in zip(out, _FACTORS, _SHIFTS):
            np.multiply(some, a, out=hashed)
            np.add(hashed, b, out=hashed)
            np.minimum(row[first:last], np.minimum.reduceat(hashed, begins), out=row[first:last])
    return out.T


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits for each set that tell it from others."""
    sums = np.array([(s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(-1, 2)
    size = np.array([len(s) for s in sets], np.uint64)
    return mix(sums + size[:, None]).view(np.int64)


def _runs(sets: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Sets in runs of a bounded number of shingles (or one set)."""
    run, held = [], 0
    for s in sets:
        run.append(s)
        held += len(s)
        if held >= 4 * _STEP or len(run) >= 4096:
            yield run
            run, held = [], 0
    if run:
        yield run


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Each document's set size and fingerprint, the last byte of every minimum, and a
    hash of every band. Without shingles there are none of the last two."""
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        low = 0
        for run in _runs(shingle_sets(batch.column(1), words)):
            ids = batch.column(0).slice(low, len(run))
            low += len(run)
            full = [s for s in run if len(s)]
            least = mix(minima(full))
            bands = salt[None, :].repeat(len(full), 0)
            for k in range(MINIMA):
                bands = mix(bands + least[:, k::MINIMA])
            place = np.cumsum([len(s) > 0 for s in run]) - 1
            blob = lambda rows: pa.array([rows[j].tobytes() if len(s) else None for s, j in zip(run, place)], pa.binary())
            prints = _prints(run)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in run], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]),
                 blob(least.astype(np.uint8)), blob(bands)],
                ["doc_id", "n", "fp", "fp2", "signature", "bands"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every band of a set."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(np.repeat(np.asarray(batch.column(0)), BANDS))], ["bucket", "node"])


# -- pairs of blocks ----------------------------------------------------------------

class _Forest:
    """Which of a few sets hang together."""

    def __init__(self, n: int):
        self.tree = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> list[tuple[int, int]]:
        """Those of the pairs (i, other) that join two trees."""
        apart = others[self.tree[others] != self.tree[i]]
        trees, first = np.unique(self.tree[apart], return_index=True)
        for tree in trees:
            self.tree[self.tree == tree] = self.tree[i]
        return [(i, int(apart[k])) for k in first]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, from rows that come sorted by them; one group is held."""
    held, last = [], None
    for batch in batches:
        values = np.stack([np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys], 1)
        if not len(values):
            continue
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(values)]):
            now = tuple(values[low].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the one and the other block; the same ones inside a block."""
    high, low = table["high"][0].as_py(), table["low"][0].as_py()
    block = np.asarray(table["block"].combine_chunks())
    if high == low:
        every = np.arange(len(block))
        return every, every, True
    return np.flatnonzero(block == high), np.flatnonzero(block == low), False


def _forests(batches: Iterator[pa.RecordBatch], keys: list[str], linked: Callable) -> Iterator[pa.RecordBatch]:
    """Of every pair of blocks, a forest of the pairs that ``linked`` finds row by row."""
    for table in _groups(batches, keys):
        left, right, inside = _sides(table)
        node = np.asarray(table["node"].combine_chunks())
        forest, made = _Forest(len(node)), []
        for i, found in linked(table, left, right, inside):
            made += forest.join(int(i), found)
        if made:
            pairs = np.array(made)
            yield pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], ["a", "b"])


def _agreeing(table: pa.Table, left: np.ndarray, right: np.ndarray, inside: bool, least: int
              ) -> Iterator[tuple[int, np.ndarray]]:
    signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(table), -1)
    other = signature[right]
    for place, i in enumerate(left):
        some = right[place + 1:] if inside else right
        rows = other[place + 1:] if inside else other
        yield i, some[(rows == signature[i]).sum(1) >= least]


def _confirmed(table: pa.Table, left: np.ndarray, right: np.ndarray, inside: bool, percent: int
               ) -> Iterator[tuple[int, np.ndarray]]:
    """Links on full sets, by counting in an inverted list of the right block's shingles."""
    sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
    n = np.array([len(s) for s in sets], np.int64)
    token = np.concatenate([sets[j] for j in right]) if len(right) else np.zeros(0, np.uint64)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], np.repeat(np.arange(len(right)), n[right])[order]
    for place, i in enumerate(left):
        low, high = np.searchsorted(token, sets[i], "left"), np.searchsorted(token, sets[i], "right")
        size = high - low
        at = np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        both = np.bincount(owner[at], minlength=len(right))
        found = 100 * both >= percent * (n[i] + n[right] - both)
        if inside:
            found[:place + 1] = False
        yield i, right[found]


def _in_blocks(rows: DataFrame, key: str, sizes: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with their block, once for each pair of blocks of their ``key`` they are in,
    dealt and sorted by pair. ``sizes`` (key, k) says how many blocks a key has."""
    block = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    dealt = (rows.join(sizes, key).withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select(key, F.greatest("block", "other").alias("high"), F.least("block", "other").alias("low"), "block", "node", *columns))
    keys = [key, "high", "low"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


# -- on Spark -----------------------------------------------------------------------

def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): forests of the sets that share a bucket and agree in enough minima."""
    bands = classes.select("node", "bands").mapInArrow(_bands, "bucket long, node long")
    buckets = bands.groupBy("bucket").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("n > 1")
    # Buckets with the same sets would find the same pairs.
    sizes = written_once(buckets.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select(
        "bucket", F.ceil(F.col("n") / BLOCK_SETS).cast("int").alias("k")), "buckets")
    kept = bands.join(sizes.select("bucket"), "bucket", "left_semi")
    met = written_once(kept, "buckets")
    rows = met.join(classes.select("node", "signature"), "node")
    least = least_agreement(percent)
    return _in_blocks(rows, "bucket", sizes, ["signature"]).mapInArrow(
        lambda batches: _forests(batches, ["bucket", "high", "low"], partial(_agreeing, least=least)), "a long, b long")


def _sets_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in _runs(shingle_sets(batch.column(0), words)):
            prints = _prints(run)
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([s.tobytes() for s in run], pa.binary())],
                ["fp", "fp2", "tokens"])


def minhash_groups(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per document: doc_id, n_shingles, component_id
    (the smallest doc_id that links reach), kept (whether that is its own).

    The text is lower-cased in A-Z and split at ASCII white space. A text of fewer words
    than a shingle is one shingle. Every link returned is confirmed on full sets; two
    documents of similarity ``percent`` or more are missed with a probability below 10^-7,
    if no third one joins them.

    A null or empty text has no shingle, no link and its own doc_id as component. Rows that
    repeat stay, and are kept together. A null doc_id belongs to a group without naming it,
    unless the group has no other; it is kept in that case. Columns beside doc_id and text
    are not read. Runs jobs when called.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = written_once(docs.mapInArrow(partial(_signed, words=words), _MEMBERS), "signatures")
    total = members.count()

    # Equal sets are one from here on.
    print_of = ["fp", "fp2", "n"]
    classes = members.filter("n > 0").groupBy(*print_of).agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("docs"), F.first("signature").alias("signature"),
        F.first("bands").alias("bands"))
    classes = written_once(classes.withColumn("node", F.xxhash64("fp", "fp2")), "classes")
    clusters = written_once(components(_candidates(classes, percent)).withColumnRenamed("component", "cluster"), "clusters")

    inside = classes.select("node", "n", "fp", "fp2", "first_id").join(clusters, "node")
    inside = written_once(inside, "inside")
    near = positions(inside.select("first_id"))
    texts = docs.join(F.broadcast(near), near["position"] == position(F.col("doc_id")), "left_semi").select("text")
    found = texts.mapInArrow(partial(_sets_of, words=words), "fp long, fp2 long, tokens binary")
    sets = written_once(
        found.groupBy("fp", "fp2").agg(F.first("tokens").alias("tokens"))
        .join(inside.select("fp", "fp2", "node", "cluster"), ["fp", "fp2"]).select("cluster", "node", "tokens"), "sets")
    sizes = inside.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("k"))
    links = _in_blocks(sets, "cluster", sizes, ["tokens"]).mapInArrow(
        lambda batches: _forests(batches, ["cluster", "high", "low"], partial(_confirmed, percent=percent)), "a long, b long")
    groups = written_once(components(links), "groups")

    named = classes.select(*print_of, "node", "first_id", "docs").join(groups, "node")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = named.join(least, "component").select(*print_of, "docs", "component_id")
    alone = classes.join(groups.select("node"), "node", "left_anti").filter("docs > 1").select(
        *print_of, "docs", F.col("first_id").alias("component_id"))
    of_set = written_once(linked.unionByName(alone), "named")
    # Sets of very many documents are at most a thousand; their documents need no shuffle.
    heavy = F.broadcast(of_set.filter(F.col("docs") * 1000 > total).drop("docs"))
    light = of_set.filter(F.col("docs") * 1000 <= total).drop("docs")
    members = members.select("doc_id", *print_of)
    rows = members.join(heavy, print_of).unionByName(
        members.join(heavy.select(*print_of), print_of, "left_anti").join(light, print_of, "left"))
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       component.eqNullSafe(F.col("doc_id")).alias("kept"))
