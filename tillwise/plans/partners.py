"""The best partners of every item: the others it meets in most groups, or most alike.

Pairs that meet are far more than the best ``k`` of each item, so no pair is a row here.
Items are dealt into blocks. A group's members go once to every block that has one of
them, and there an item's partners are counted and ranked in one go. Bounds spare the
large groups: an item's small groups are counted first, and give a score that its best
``k`` partners reach. Groups that cannot lift a partner met nowhere else to that score are
not gone through; the partners at hand are looked up in them.

Two kinds are taken out beforehand, because a task could not hold them:

* *Large groups* (an anonymous customer, say) become a signature of each item: the list
  of large groups it is in. Items with equal signatures have the same best partners by
  them, so the ``k + 1`` smallest of every signature are enough. (Under a cosine, where
  that does not hold, a table with a large group takes rows for pairs.)
* *Heavy items*, in groups of very many members together, are few. Their partners are
  counted by an aggregate, which combines them before the shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import written_once
from .pairs import item_pairs, mirrored
from .ranking import top_per_key

#: Members of a group beyond which it is large.
LARGE_GROUP = 1 << 16
#: Members, over all its groups, beyond which an item is heavy.
HEAVY_ITEM = 1 << 20
#: Members that a block holds, about.
BLOCK_MEMBERS = 1 << 20
#: Members of an item from which bounds are worth their while.
BOUND_FROM = 1 << 13

#: An item's block is its id modulo the prime, times the factor, modulo both: no product
#: passes 64 bits, and the tasks can tell their own items by it.
_PRIME, _FACTOR = 2_147_483_647, 1_103_515_245
#: Ids are sent in pieces of so many bits: one for a small step, more for others, or all of it.
_BITS, _MORE, _ALL = 15, 2, 5


class _Lists:
    """The member lists of a block, end to end, each in order of ids."""

    def __init__(self, members: pa.ListArray):
        flat = members.flatten()
        names = [field.name for field in flat.type]
        self.at = np.concatenate(([0], np.cumsum(np.asarray(members.value_lengths()))))
        self.id = np.asarray(flat.field("i"))
        self.weight, self.square = (np.asarray(flat.field(name)) if name in names else np.ones(len(flat)) for name in ("w", "square"))
        self.large, self.large_at = np.zeros(0, np.int64), np.zeros(len(flat) + 1, np.int64)
        if "large" in names:
            self.large = np.asarray(flat.field("large").flatten())
            self.large_at[1:] = np.cumsum(np.asarray(flat.field("large").value_lengths()))

    @staticmethod
    def ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())

    def met(self, groups: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in some groups, a place of each, and the sum of both weights' products."""
        size = self.at[groups + 1] - self.at[groups]
        place = self.ranges(self.at[groups], size)
        ids, first, same = np.unique(self.id[place], return_index=True, return_inverse=True)
        return ids, place[first], np.bincount(same, self.weight[place] * np.repeat(weights, size), minlength=len(ids))

    def looked_up(self, ids: np.ndarray, group: int, weight: float) -> np.ndarray:
        """What one more group adds to some ids."""
        low, high = self.at[group], self.at[group + 1]
        place = np.minimum(low + np.searchsorted(self.id[low:high], ids), high - 1)
        return np.where(self.id[place] == ids, self.weight[place] * weight, 0.0)

    def large_shared(self, places: np.ndarray, signature: np.ndarray) -> np.ndarray:
        """Large groups that some members have in common with a signature."""
        size = self.large_at[places + 1] - self.large_at[places]
        inside = np.isin(self.large[self.ranges(self.large_at[places], size)], signature)
        return np.bincount(np.repeat(np.arange(len(places)), size)[inside], minlength=len(places))


def _best(lists: _Lists, item: int, groups: np.ndarray, weights: np.ndarray, square: float, signature: np.ndarray,
          k: int, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` partners of one item and their scores, by the groups that are not large."""
    size = lists.at[groups + 1] - lists.at[groups]
    order = np.argsort(size, kind="stable")
    groups, weights, cost = groups[order], weights[order], np.cumsum(size[order])
    n = len(groups)

    def scored(ids: np.ndarray, places: np.ndarray, sums: np.ndarray) -> np.ndarray:
        if cosine:
            score = sums / np.sqrt(square * lists.square[places])
        else:
            score = sums + (lists.large_shared(places, signature) if len(signature) else 0)
        score[ids == item] = -1.0
        return score

    # The cheap groups first, for a score that the best k reach.
    done = int(np.searchsorted(cost, cost[-1] // 4, "right"))
    ids, places, sums = lists.met(groups[:done], weights[:done])
    score = scored(ids, places, sums)
    least = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -1.0
    # What a partner can reach that is met in groups[j:] only.
    if cosine:
        rest = np.sqrt(np.append(np.cumsum(weights[::-1] ** 2)[::-1], 0.0) / square) * (1 + 1e-9)
    else:
        rest = np.arange(n, -1, -1) + len(signature)
    need = done + int(np.argmax(np.append(rest[done:n] < least, True)))
    # All who are met in the last group only score 1: the smallest ids stand for them.
    ties = need == n and not cosine and not len(signature)
    need -= ties
    if need > done:
        ids, places, sums = lists.met(groups[:need], weights[:need])
    if ties:
        low = lists.at[groups[-1]]
        more = np.arange(low, min(low + k + 1, lists.at[groups[-1] + 1]))
        more = more[~np.isin(lists.id[more], ids)]
        ids, places, sums = np.append(ids, lists.id[more]), np.append(places, more), np.append(sums, np.zeros(len(more)))
    for group, weight in zip(groups[need:], weights[need:]):
        sums = sums + lists.looked_up(ids, group, weight)
    score = scored(ids, places, sums)
    first = np.lexsort((ids, -score))[:k + 1]
    first = first[ids[first] != item][:k]
    return ids[first], score[first]


def _best_of_many(lists: _Lists, items: np.ndarray, groups: np.ndarray, places: np.ndarray, k: int, cosine: bool
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many items at once: (item, group, the item's place in it) in order of
    items, each whose partners are few."""
    edges = np.flatnonzero(np.diff(items, prepend=items[:1] - 1))
    number = np.cumsum(np.diff(items, prepend=items[:1]) != 0)
    size = lists.at[groups + 1] - lists.at[groups]
    place, row = lists.ranges(lists.at[groups], size), np.repeat(np.arange(len(items)), size)
    place, row = place[lists.id[place] != items[row]], row[lists.id[place] != items[row]]
    # Ids in order, so that pairs sort by (item, partner).
    known, code = np.unique(lists.id[place], return_inverse=True)
    pair = number[row] * len(known) + code
    order = np.argsort(pair, kind="stable")
    first = np.flatnonzero(np.diff(pair[order], prepend=-1))
    if not len(first):
        return (np.zeros(0, np.int64),) * 3
    sums = np.add.reduceat(lists.weight[place[order]] * lists.weight[places[row[order]]], first)
    own, partner = pair[order[first]] // len(known), known[pair[order[first]] % len(known)]
    if cosine:
        sums = sums / np.sqrt(lists.square[places[edges[own]]] * lists.square[place[order[first]]])
    best = np.lexsort((-sums, own))
    rank = np.arange(len(best)) - np.searchsorted(own, own)
    best = best[rank < k]
    return items[edges[own[best]]], partner[best], sums[best]


def _unpacked(table: pa.Table) -> pa.ListArray:
    """The lists that ``_packed`` made small."""
    columns = {name: table[name].combine_chunks() for name in table.column_names}
    pieces, width = np.asarray(columns["pieces"].flatten()).astype(np.int64), np.asarray(columns["width"]).astype(np.int64)
    sent = np.asarray(columns["pieces"].value_lengths()).astype(np.int64)
    size = sent // width
    at = np.concatenate(([0], np.cumsum(size)))
    ids = np.zeros(at[-1], np.int64)
    for n in np.unique(width):
        of = pieces[np.repeat(width == n, sent)].reshape(-1, n)
        ids[np.repeat(width == n, size)] = reduce(lambda high, low: (high << _BITS) + low, of.T)
    near = np.repeat(width < _ALL, size)
    sums = np.cumsum(np.where(near, ids, 0))
    ids = np.where(near, sums + np.repeat(np.asarray(columns["first"]) - sums[at[:-1]], size), ids)
    fields = {"i": pa.array(ids)} | {name: columns[name].flatten() for name in ("w", "square", "large") if name in columns}
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([*fields.values()], [*fields]))


def _best_of_block(table: pa.Table, blocks: int, k: int, cosine: bool) -> pa.Table:
    lists = _Lists(_unpacked(table))
    group = np.repeat(np.arange(len(table)), np.diff(lists.at))
    dealt = np.mod(np.mod(np.mod(lists.id, _PRIME) * _FACTOR, _PRIME), blocks) == table["block"][0].as_py()
    if "heavy" in table.column_names:
        dealt &= ~np.isin(lists.id, np.asarray(table["heavy"].combine_chunks().flatten()))
    place = np.flatnonzero(dealt)
    place = place[np.argsort(lists.id[place], kind="stable")]
    group, item = group[place], lists.id[place]
    edges = np.flatnonzero(np.diff(item, prepend=item[:1] - 1))
    cost = np.add.reduceat(np.diff(lists.at)[group], edges)
    signed = np.add.reduceat(np.diff(lists.large_at)[place], edges) > 0
    single = signed | (cost > BOUND_FROM)
    found = []
    for low, high in zip(edges[single], np.append(edges[1:], len(item))[single]):
        first = place[low]
        ids, score = _best(lists, item[low], group[low:high], lists.weight[place[low:high]], lists.square[first],
                           lists.large[lists.large_at[first]:lists.large_at[first + 1]], k, cosine)
        found.append((np.full(len(ids), item[low]), ids, score))
    few = np.repeat(~single, np.diff(np.append(edges, len(item))))
    group, item, place = group[few], item[few], place[few]
    # About as many members at a time as one of the others may have.
    work = np.cumsum(np.diff(lists.at)[group]) // (16 * BOUND_FROM)
    starts = np.flatnonzero(np.diff(item, prepend=item[:1] - 1))
    starts = starts[np.diff(work[starts], prepend=-1) > 0]
    for low, high in zip(starts, np.append(starts[1:], len(item))):
        found.append(_best_of_many(lists, item[low:high], group[low:high], place[low:high], k, cosine))
    a, b, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return pa.table({"a": a, "b": b, "score": score.astype(float)})


def _block(item: Column, blocks: int) -> Column:
    return F.pmod(F.pmod(F.pmod(item, F.lit(_PRIME)) * F.lit(_FACTOR), F.lit(_PRIME)), F.lit(blocks)).cast("int")


def _packed(lists: DataFrame, *columns: str) -> DataFrame:
    """The lists ``all`` in few bytes, because each goes to as many blocks as it has: ids as
    the steps from one to the next, in as many pieces of 15 bits as they need, and the
    members' other ``columns`` apart. Lists whose ids lie far apart keep them whole."""
    last = F.size("ids") - 1
    steps = F.zip_with(F.slice("ids", F.lit(2), last), F.slice("ids", F.lit(1), last), lambda b, a: F.try_subtract(b, a))
    lists = lists.select("blocks", *columns, "ids", F.concat(F.array(F.lit(0).cast("long")), steps).alias("steps"))
    most, far = F.array_max("steps"), F.try_subtract(F.element_at("ids", -1), F.element_at("ids", 1)).isNull()

    def pieces(numbers: str, n: int) -> Column:
        return F.expr(f"flatten(transform({numbers}, x -> array(" + ", ".join(
            f"cast(shiftright(x, {_BITS * p}){f' & {(1 << _BITS) - 1}' if p < n - 1 else ''} as smallint)"
            for p in reversed(range(n))) + ")))")

    width = F.when(far | (most >= 1 << _BITS * _MORE), _ALL).when(most >= 1 << _BITS, _MORE).otherwise(1)
    return lists.select("blocks", *columns, "ids", "steps", width.cast("tinyint").alias("width")).select(
        "blocks", *columns, F.element_at("ids", 1).alias("first"), "width",
        F.when(F.col("width") == _ALL, pieces("ids", _ALL)).when(F.col("width") == _MORE, pieces("steps", _MORE))
        .otherwise(F.col("steps").cast("array<smallint>")).alias("pieces"))


def _by_signature(signatures: DataFrame, k: int) -> DataFrame:
    """(a, b, score) of the best ``k`` by large groups alone: what they have in common.

    Whoever is not among the ``k + 1`` smallest of its signature is beaten by ``k`` others
    with the same one."""
    members = top_per_key(signatures, "large", k + 1, F.col("i"))
    kinds = written_once(members.groupBy("large").agg(F.collect_list("i").alias("first")), "signatures")
    side = lambda name: kinds.select(F.col("large").alias(name), F.explode("large").alias("g"))
    alike = side("x").join(side("y"), "g").groupBy("x", "y").agg(F.count("*").cast("double").alias("score"))
    offered = alike.join(kinds.withColumnRenamed("large", "y"), "y").select("x", "score", F.explode("first").alias("b"))
    best = top_per_key(offered, "x", k + 1, F.col("score").desc(), F.col("b"))
    return (signatures.select(F.col("i").alias("a"), F.col("large").alias("x")).join(best, "x")
            .where("a != b").select("a", "b", "score"))


def best_partners(df: DataFrame, group: str, item: str, k: int, weight: str | None = None) -> DataFrame:
    """``(a, b, score)``: for every item the ``k`` others with the highest scores, smaller
    ids first among equals; those without a group in common never.

    The score is the number of groups in common, or with a ``weight`` the cosine of the
    items' weights by group. ``df`` holds a (group, item) at most once; items are whole
    numbers, weights positive. Rows with a null group or item are left out. Runs jobs when called.
    """
    cosine = weight is not None
    rank = lambda scored: top_per_key(scored, "a", k, F.col("score").desc(), F.col("b"))
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        F.col(group).alias("g"), F.col(item).cast("long").alias("i"),
        (F.col(weight) if cosine else F.lit(1)).cast("double").alias("w"))
    if cosine:
        squares = rows.groupBy("i").agg(F.sum(F.col("w") * F.col("w")).alias("square"))
        rows = rows.join(squares, "i")
    else:
        rows = rows.withColumn("square", F.lit(1.0))
    rows = written_once(rows.select("g", "i", "w", "square"), "met")

    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    small = F.col("n") <= LARGE_GROUP
    work, most, large = sizes.agg(F.coalesce(F.sum(F.when(small, F.col("n") * F.col("n"))), F.lit(0)),
                                  F.max(F.when(small, F.col("n"))), F.count(F.when(~small, 1))).first()
    if large and cosine:
        # Signatures say nothing about weights: pairs, spread over blocks of each group.
        square = lambda name: rows.groupBy(F.col("i").alias(name)).agg(F.first("square").alias(f"square_{name}"))
        pairs = mirrored(item_pairs(rows, "g", "i", "w").select("a", "b", "dot")).join(square("a"), "a").join(square("b"), "b")
        return rank(pairs.select("a", "b", (F.col("dot") / F.sqrt(F.col("square_a") * F.col("square_b"))).alias("score")))
    none = F.array().cast(f"array<{rows.schema['g'].dataType.simpleString()}>")
    parts, own = [], ["i"]
    if cosine:
        own += ["w", "square"]
    if large:
        signatures = written_once(rows.join(sizes.where(~small), "g", "left_semi").groupBy("i").agg(
            F.array_sort(F.collect_list("g")).alias("large")), "signatures")
        parts.append(_by_signature(signatures, k))
        rows = rows.join(signatures, "i", "left").withColumn("large", F.coalesce("large", none))
        own.append("large")
    met = rows.join(sizes.where(small), "g")

    blocks = max(1, -(-work // BLOCK_MEMBERS))
    heavy = None
    if work > HEAVY_ITEM and most * rows.groupBy("i").count().agg(F.max("count")).first()[0] > HEAVY_ITEM:
        heavy = written_once(met.groupBy("i").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY_ITEM).select("i"), "heavy")
        heavy = None if heavy.isEmpty() else heavy.withColumn("heavy", F.lit(True))
    if heavy is not None:
        met = met.join(heavy, "i", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
        own.append("heavy")
    lists = met.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("all"))
    if heavy is not None:
        lists = written_once(lists, "members")
        of_heavy = met.where("heavy").select("g", F.struct(*own).alias("x")).join(lists, "g")
        partners = of_heavy.select("x", F.explode("all").alias("y")).where("x.i != y.i")
        if cosine:
            score = F.sum(F.col("x.w") * F.col("y.w")) / F.sqrt(F.first("x.square") * F.first("y.square"))
        elif large:
            score = F.count("*") + F.first(F.size(F.array_intersect("x.large", "y.large")))
        else:
            score = F.count("*")
        parts.append(rank(partners.groupBy(F.col("x.i").alias("a"), F.col("y.i").alias("b")).agg(
            score.cast("double").alias("score"))))

    light, apart = F.col("all"), [F.col(f"all.{name}").alias(name) for name in own if name not in ("i", "heavy")]
    if heavy is not None:
        light = F.filter("all", lambda x: ~x["heavy"])
        apart.append(F.filter("all", lambda x: x["heavy"])["i"].alias("heavy"))
    lists = lists.select(F.col("all.i").alias("ids"), *apart, F.array_distinct(
        F.transform(light["i"], lambda i: _block(i, blocks))).alias("blocks"))
    packed = _packed(lists, *(name for name in own if name != "i"))
    dealt = packed.withColumn("block", F.explode("blocks")).drop("blocks")
    parts.append(dealt.groupBy("block").applyInArrow(
        lambda table: _best_of_block(table, blocks, k, cosine), "a long, b long, score double"))
    found = reduce(DataFrame.unionByName, parts)
    # A partner may come from its signature and, with all that is shared, from its block.
    return rank(found.groupBy("a", "b").agg(F.max("score").alias("score"))) if large else found
