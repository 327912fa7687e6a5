"""Hard negatives of anchor vectors, by spanning trees over the anchors.

Scores are integer inner products. The anchors of a block are joined by a minimum
spanning tree. What a candidate ``c`` scores at an anchor differs from its score at
the anchor's parent by at most ``|anchor - parent| |c|``, so intervals for all
candidates go down the tree, from exact scores at the root. Only candidates whose
interval meets the window of scores an anchor still needs are scored at it; the
others keep their interval for the anchor's children.

Two searches use this. The first finds an anchor's best rows of its own label, its
positives; only blocks and rows of one label meet. The second finds, below each
positive, the best rows of other labels in the positive's window. Blocks of anchors
meet parts of the rows; both are bounded, and a pair of them is one task's unit of
work. Nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.plans.durable import written_once

#: Anchors in a block and rows in a part, about.
BLOCK_ANCHORS, PART_ROWS = 4096, 1 << 14
#: Rows of a part that go down the tree together.
CHUNK_ROWS = 2048
#: Scaled components beyond this are taken as this, so that scores fit 64 bits.
_MOST = 1 << 27
#: Sums of products below this are exact in doubles.
_EXACT = 2.0 ** 52
_LAST = np.iinfo(np.int64).max


# -- vectors ------------------------------------------------------------------------

def _scaled(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Rows whose vector is whole and finite, with floor(scale * x) in 32 bits."""
    for batch in batches:
        vectors = batch.column(2)
        values = vectors.flatten()
        valid = np.asarray(values.is_valid())
        values = np.asarray(values.cast(pa.float64()).fill_null(0.0))
        bad = ~valid | ~np.isfinite(values)
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(scale * np.where(bad, 0.0, values)), -_MOST, _MOST).astype("<i4")
        size = np.asarray(vectors.value_lengths().fill_null(0))
        at = np.concatenate(([0], np.cumsum(size)))
        faults = np.concatenate(([0], np.cumsum(bad)))
        keep = np.asarray(vectors.is_valid()) & (faults[at[1:]] == faults[at[:-1]])
        some = np.flatnonzero(keep)
        rows = pa.array(some)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows),
             pa.array([whole[at[i]:at[i + 1]].tobytes() for i in some], pa.binary())], ["id", "label", "vector"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    vectors = [np.frombuffer(x, "<i4") for x in column.to_pylist()]
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for row, vector in zip(out, vectors):
        row[:len(vector)] = vector
    return out


def _products(rows: np.ndarray, norms: np.ndarray, vector: np.ndarray, norm: float) -> np.ndarray:
    """Exact inner products; doubles hold them up to 2^52."""
    if norm * norms.max(initial=0.0) < _EXACT:
        return (rows @ vector).astype(np.int64)
    return rows.astype(np.int64) @ vector.astype(np.int64)


# -- the tree -----------------------------------------------------------------------

def spanning_tree(vectors: np.ndarray) -> list[tuple[int, int, float, bool]]:
    """(anchor, parent, distance, last) in the order they are visited: a minimum
    spanning tree from the first vector, whose parent is -1. A parent comes before its
    children, and its smaller branches before the largest, so that only the logarithm of
    the number of anchors are open at a time. ``last`` is set on a parent's last child."""
    n = len(vectors)
    squares = np.einsum("ij,ij->i", vectors, vectors)
    parent, order = np.full(n, -1), [0]
    length = np.zeros(n)
    least = np.full(n, np.inf)
    near = np.zeros(n, np.int64)
    least[0] = -np.inf
    for _ in range(n - 1):
        new = order[-1]
        away = squares + squares[new] - 2 * (vectors @ vectors[new])
        closer = away < least
        near[closer], least[closer] = new, away[closer]
        least[new] = -np.inf  # in the tree
        nearest = int(np.argmin(np.where(least == -np.inf, np.inf, least)))
        parent[nearest] = near[nearest]
        length[nearest] = np.linalg.norm(vectors[nearest] - vectors[near[nearest]])
        order.append(nearest)
    size = np.ones(n, np.int64)
    for i in reversed(order[1:]):
        size[parent[i]] += size[i]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in order[1:]:
        children[parent[i]].append(i)
    visits, open_ = [], [(0, False)]
    while open_:
        i, last = open_.pop()
        visits.append((i, int(parent[i]), float(length[i]), last))
        branches = sorted(children[i], key=lambda c: (-size[c], c))  # the largest is popped last
        open_ += [(c, k == 0) for k, c in enumerate(branches)]
    return visits


def _descend(tree, anchors, anchor_norms, rows, norms, needed) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of every anchor: the rows that ``needed(anchor, low, high)`` marks by the bounds of
    their scores, and their exact scores."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for anchor, parent, length, last in tree:
        reach = anchor_norms[anchor] * norms * (1 + 1e-9) + 1
        low, high = -reach, reach
        if parent >= 0:
            above = held.pop(parent) if last else held[parent]
            slack = length * norms * (1 + 1e-9) + 1
            low, high = np.maximum(low, above[0] - slack), np.minimum(high, above[1] + slack)
        some = np.flatnonzero(needed(anchor, low, high))
        if parent < 0:
            scores = _products(rows, norms, anchors[anchor], anchor_norms[anchor])
            low, high = scores.astype(float), scores.astype(float)
            scores = scores[some]
        elif 2 * len(some) > len(rows):
            scores = _products(rows, norms, anchors[anchor], anchor_norms[anchor])[some]
        else:
            scores = _products(rows[some], norms[some], anchors[anchor], anchor_norms[anchor])
        low[some] = high[some] = scores
        held[anchor] = low, high
        yield anchor, some, scores


def _first(score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """The positions of the first ``k``: higher scores, then smaller ids."""
    if len(score) > 8 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= cut)
        return some[np.lexsort((ident[some], -score[some]))[:k]]
    return np.lexsort((ident, -score))[:k]


class _Block:
    """Anchors of a block with their tree, and the rows that meet them in chunks."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        self.vectors = _matrix(anchors["vector"])
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.key = np.asarray(anchors["anchor"].combine_chunks())
        self.id = np.asarray(anchors["id"].combine_chunks())
        self.label = np.asarray(anchors["label"].combine_chunks())
        self.tree = spanning_tree(self.vectors) if len(self.id) else []
        self.rows = rows

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, labels, vectors, norms); no id comes after all others."""
        for low in range(0, len(self.rows) if self.tree else 0, CHUNK_ROWS):
            some = self.rows.slice(low, CHUNK_ROWS)
            vectors = _matrix(some["vector"])
            wide = max(vectors.shape[1], self.vectors.shape[1])
            vectors = np.pad(vectors, ((0, 0), (0, wide - vectors.shape[1])))
            norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            yield (np.asarray(some["id"].combine_chunks().fill_null(_LAST)), np.asarray(some["label"].combine_chunks()),
                   vectors, norms)

    def descend(self, vectors, norms, needed):
        wide = np.pad(self.vectors, ((0, 0), (0, vectors.shape[1] - self.vectors.shape[1])))
        return _descend(self.tree, wide, self.norms, vectors, norms, needed)


_FOUND = "anchor long, slot int, id long, score long"


def _rows_found(parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    size = [len(p[2]) for p in parts]
    ids = np.concatenate([p[2] for p in parts] or [np.zeros(0, np.int64)])
    return pa.table({
        "anchor": np.repeat(np.array([p[0] for p in parts], np.int64), size),
        "slot": np.repeat(np.array([p[1] for p in parts], np.int32), size),
        "id": pa.array(ids, mask=ids == _LAST),
        "score": np.concatenate([p[3] for p in parts] or [np.zeros(0, np.int64)])})


def _positives(_key, anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The best ``k`` rows of a part for each anchor of a block; all have one label."""
    block = _Block(anchors, rows)
    none = np.zeros(0, np.int64)
    best = {i: (none, none) for i in range(len(block.id))}
    least = np.full(len(block.id), -np.inf)
    for ids, _, vectors, norms in block.chunks():
        for i, some, scores in block.descend(
                vectors, norms, lambda i, low, high: (high >= least[i]) & (ids != block.id[i])):
            ident, score = np.append(best[i][0], ids[some]), np.append(best[i][1], scores)
            first = _first(score, ident, k)
            best[i] = ident[first], score[first]
            if len(first) == k:
                least[i] = best[i][1][-1]
    return _rows_found([(block.key[i], 0, ident, score) for i, (ident, score) in best.items()])


def _negatives(_key, anchors: pa.Table, rows: pa.Table, k: int, above: int, below: int) -> pa.Table:
    """The best ``k`` rows of other labels in the window under each positive."""
    block = _Block(anchors, rows)
    # Slots with equal positives have equal windows: one of them is searched.
    slots = [np.unique(np.array(x, np.int64), return_index=True) for x in anchors["positives"].to_pylist()]
    floor = [-(-above * s[0] // 100) for s in slots]
    top = [below * s[0] // 100 for s in slots]
    none = np.zeros(0, np.int64)
    best = {(i, j): (none, none) for i, s in enumerate(slots) for j in range(len(s[0]))}

    for ids, labels, vectors, norms in block.chunks():
        def needed(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            meets = np.zeros(len(low), bool)
            for a, b in zip(floor[i], top[i]):
                if a <= b:
                    meets |= (high >= a) & (low <= b)
            return meets & (labels != block.label[i]) & (ids != block.id[i])

        for i, some, scores in block.descend(vectors, norms, needed):
            for j, (a, b) in enumerate(zip(floor[i], top[i])):
                mine = (scores >= a) & (scores <= b)
                if not mine.any():
                    continue
                ident, score = np.append(best[i, j][0], ids[some][mine]), np.append(best[i, j][1], scores[mine])
                first = _first(score, ident, k)
                best[i, j] = ident[first], score[first]
                if len(first) == k:
                    floor[i][j] = score[first[-1]]
    return _rows_found([(block.key[i], int(slots[i][1][j]) + 1, ident, score) for (i, j), (ident, score) in best.items()])


# -- on Spark -----------------------------------------------------------------------

def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _met(anchors: DataFrame, rows: DataFrame, keys: list[str], search, **limits: int) -> DataFrame:
    """``search`` over all blocks of anchors and all parts of the rows, of one key each where
    there are keys. A block is copied to all parts and a part to all blocks."""
    def number(of: str, size: int):
        return F.ceil(F.col(of) / size).cast("int")

    counted = (rows.withColumn("mine", F.lit(0)).select(*keys, "mine")
               .unionByName(anchors.withColumn("mine", F.lit(1)).select(*keys, "mine"))
               .groupBy(*keys).agg(F.sum("mine").alias("n"), F.sum(1 - F.col("mine")).alias("m"))
               .select(*keys, number("n", BLOCK_ANCHORS).alias("blocks"), number("m", PART_ROWS).alias("parts")))
    if keys:
        # Keys of more than one block or part: at most one row per PART_ROWS rows.
        large = F.broadcast(counted.filter("blocks > 1 or parts > 1"))
        sized = lambda df: df.join(large, keys, "left").fillna(1, ["blocks", "parts"])
    else:
        blocks, parts = counted.select(F.coalesce("blocks", F.lit(1)), F.coalesce("parts", F.lit(1))).first()
        sized = lambda df: df.withColumns({"blocks": F.lit(blocks), "parts": F.lit(parts)})

    def dealt(df: DataFrame, own: str, total: str, key: tuple[str, ...], other: str, others: str) -> DataFrame:
        return (sized(df).withColumn(own, F.pmod(F.xxhash64(*key), F.col(total)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("blocks", "parts"))

    left = dealt(anchors, "block", "blocks", ("anchor",), "part", "parts")
    right = dealt(rows, "part", "parts", ("id", "vector"), "block", "blocks")
    units = [*keys, "block", "part"]
    return left.groupBy(*units).cogroup(right.groupBy(*units)).applyInArrow(
        lambda key, a, b: search(key, a, b, **limits), _FOUND)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 10, above: int = 30, below: int = 90,
                   scale: int = 256, every: int = 100) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score: for every anchor (vec_id divisible by ``every``) and
    each of its first ``positives`` rows of its label, the first ``negatives`` rows of other
    labels with a score from ``above`` to ``below`` percent of the positive's. Higher scores
    come first, then smaller vec_ids.

    A component counts as floor(``scale`` * x), at most 2^27 either way; a score is the
    integer inner product. Rows with a null label, a null vector or a component that is null
    or not finite take no part. A vector that is shorter than another counts as ending in
    zeros, an empty one scores 0. A null vec_id is no anchor and comes after all others.
    Rows with the anchor's vec_id are neither its positives nor its negatives; other rows that
    repeat count each; an anchor that repeats wholly is answered once. Columns beside these
    three are not read. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                          "embedding").filter("label is not null")
    rows = written_once(rows.mapInArrow(partial(_scaled, scale=scale), "id long, label long, vector binary"), "vectors")
    anchors = written_once(rows.filter(F.col("id") % every == 0).distinct().withColumn(
        "anchor", F.xxhash64("id", "label", "vector")), "anchors")

    found = _ranked(_met(anchors, rows, ["label"], _positives, k=positives), positives)
    found = written_once(found.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"),
                                      F.col("score").alias("positive_score")), "positives")
    scores = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))
    asked = anchors.join(scores.select("anchor", F.col("p.positive_score").alias("positives")), "anchor")
    # Of positives with equal scores, the first slot's window stands for all.
    first = found.groupBy("anchor", "positive_score").agg(F.min("slot").alias("searched"))
    windows = _ranked(_met(asked, rows, [], _negatives, k=negatives, above=above, below=below), negatives).select(
        "anchor", F.col("slot").alias("searched"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (found.join(first, ["anchor", "positive_score"]).join(windows, ["anchor", "searched"])
            .join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
