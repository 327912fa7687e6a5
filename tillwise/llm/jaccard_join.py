"""Near duplicates: an exact Jaccard self-join on word shingles with prefix filters
under several token orders, and the groups its links form.

Sets x, y with J(x, y) >= t share a token in the first ``|x| - ceil(t |x|) + 1``
tokens of each, whatever global order sorts them. So a pair has to pass the test
under every order one cares to try:

* *rare first, exactly*: a set with that many tokens found in no other set cannot
  link at all. One shuffle of all tokens finds such sets; most of a corpus ends here.
* *rare first, by how many of the sets that are left have a token*: tokens are counted
  where they are dealt to, each set learns how far its prefix goes, and the sets that have
  a token in their prefixes meet where it was counted. Of a few that meet, pairs whose
  sizes or parities rule out a link are dropped. Sets that still meet, directly or through
  others, form a cluster; links stay inside.
* *rare first by a count sketch, by hash up and down*: tested pair by pair within a
  cluster, together with the sizes. Only pairs that pass all of them are verified.

Clusters are compared in pairs of blocks with a bounded number of sets and bytes.
Pairs are never rows: a block pair returns each of its sets once, with the set it
hangs on and the number of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.sketch import among, bits, position, positions, split_by_id, unused
from tillwise.llm.textscan import give_back, mix, scan_words, slices
from tillwise.plans.components import components
from tillwise.plans.durable import drop_shuffles, written_once

#: Characters and tokens for which there is one more part of all tokens.
CHARS_PER_PART, TOKENS_PER_PART = 6_000_000, 1_000_000
#: Sets and bytes of sets that a block of a cluster holds, about.
BLOCK_SETS, BLOCK_BYTES = 1024, 24 << 20
#: Counters of the frequency sketch; it orders tokens and never decides a link.
SKETCH_BITS = 18
#: Sets with one prefix token whose pairs are looked at; more of them hang on the first.
FEW = 4
#: Bits of a set's parities, at most.
PARITY_BITS = 1 << 16

#: Documents whose tokens are dealt out together; 16 bits number them.
_RUN = 8192
#: Bytes of texts, or of sets, dealt out together, about: a task holds several times that.
_RUN_BYTES = 8 << 20
_SCANNED = "part int, run long, doc_id long, n long, fp long, fp2 long, place int, tokens binary, owners binary"
_COUNTED = "run long, doc_id long, n long, fp long, fp2 long, place int, shared long"
#: Sets that are numbered in a row, and of which one row says how far their prefixes go.
_PLACES = 1024
#: Levels of rarity. Those of one count are told apart by two bits of the token.
_LEVELS = 256
_TOKENS_OF_PART = "part int, run long, tokens binary, owners binary, cuts binary"


def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text, in order.

    A text with fewer words than a shingle has one: all its words. A text
    without words has none.
    """
    factor = _factors(words)
    for found in scan_words(column):
        h, at = found.hashes, found.offsets
        whole = mix(sum((h[k:len(h) - words + 1 + k] * factor[k] for k in range(words)), np.uint64(0))) \
            if len(h) >= words else h[:0]
        for j, n in enumerate(found.counts):
            start = at[j]
            if n >= words:
                yield np.unique(whole[start:start + n - words + 1])
            elif n:
                salted = (h[start:start + n] * factor[:n]).sum(dtype=np.uint64) + np.uint64(n)
                yield mix(np.array([salted], np.uint64))
            else:
                yield h[:0]


def _fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others."""
    pair = np.array([tokens.sum(dtype=np.uint64), mix(tokens).sum(dtype=np.uint64)], np.uint64)
    return tuple(mix(pair + np.uint64(len(tokens))).view(np.int64).tolist())


def _dealt(ids: pa.Array, sets: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Each set's id, size and fingerprint, and all tokens dealt out by their hash. A
    token says which set it is from by the run of sets and a place in it; equal sets
    in a run share a place."""
    schema = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()),
                        ("fp", pa.int64()), ("fp2", pa.int64()), ("place", pa.int32()), ("tokens", pa.binary()),
                        ("owners", pa.binary())])
    sizes = np.array([len(s) for s in sets], np.int64)
    prints = np.array([_fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
    first, place = np.unique(prints[:, 0], return_index=True, return_inverse=True)[1:]
    run = int(np.bitwise_xor.reduce(mix(prints[:, 0].view(np.uint64) + np.arange(len(sets), dtype=np.uint64))
                                    ).view(np.int64)) if len(sets) else 0
    yield pa.RecordBatch.from_arrays(
        [pa.array((place % parts).astype(np.int32)), pa.array(np.full(len(sets), run)), ids, pa.array(sizes),
         pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(place.astype(np.int32)),
         *[pa.nulls(len(sets), pa.binary())] * 2], schema=schema)
    tokens = np.concatenate([sets[i] for i in first]) if sets else np.zeros(0, np.uint64)
    if not len(tokens):
        return
    owner = np.repeat(np.arange(len(first), dtype=np.uint16), sizes[first])
    part = ((tokens >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, low_bits, owner = part[order], tokens.astype(np.uint32)[order], owner[order]
    del tokens, order
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    none, pairs = pa.nulls(len(edges) - 1, pa.int64()), list(zip(edges, edges[1:]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(part[edges[:-1]]), pa.array(np.full(len(pairs), run)), none, none, none, none, none.cast(pa.int32()),
         pa.array([low_bits[a:b].tobytes() for a, b in pairs], pa.binary()),
         pa.array([owner[a:b].tobytes() for a, b in pairs], pa.binary())], schema=schema)


def _scan_texts(batches: Iterator[pa.RecordBatch], words: int, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch, 1, _RUN, _RUN_BYTES):
            yield from _dealt(some.column(0), list(shingle_sets(some.column(1), words)), parts)
        give_back()


def _deal_sets(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """All tokens of numbered sets dealt out by their hash, with the places of their owners in
    the run of sets that a number belongs to."""
    for batch in batches:
        for some in slices(batch, 1, _RUN, _RUN_BYTES):
            sets = [np.frombuffer(x, np.uint64) for x in some.column(1).to_pylist()]
            size = [len(x) for x in sets]
            node, tokens = np.repeat(np.asarray(some.column(0)), size), np.concatenate(sets)
            part, run = ((tokens >> np.uint64(32)) % np.uint64(parts)).astype(np.int32), node // _PLACES
            order = np.lexsort((part, run))
            part, run = part[order], run[order]
            low_bits, owner = tokens.astype(np.uint32)[order], (node % _PLACES).astype(np.uint16)[order]
            del node, tokens, order
            edges = np.concatenate(([0], np.flatnonzero((part[1:] != part[:-1]) | (run[1:] != run[:-1])) + 1, [len(part)]))
            pairs = [(x, y) for x, y in zip(edges, edges[1:]) if y > x]
            at = [x for x, _ in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[at]), pa.array(run[at]), pa.array([low_bits[x:y].tobytes() for x, y in pairs], pa.binary()),
                 pa.array([owner[x:y].tobytes() for x, y in pairs], pa.binary()), pa.nulls(len(pairs), pa.binary())],
                ["part", "run", "tokens", "owners", "cuts"])
        give_back()


class _Part(NamedTuple):
    """The tokens of one part, in order; those of a set stand as the sets are numbered."""

    runs: np.ndarray
    token: np.ndarray
    owner: np.ndarray  # places, from the first of the first run on
    level: np.ndarray  # rarity; 0 if no other set has the token


def _part(table: pa.Table) -> _Part:
    dealt = table.filter(pc.is_valid(table["tokens"]))
    tokens = [np.frombuffer(x, np.uint32) for x in dealt["tokens"].to_pylist()]
    runs, at = np.unique(np.asarray(dealt["run"].combine_chunks()), return_inverse=True)
    owner = np.concatenate([np.zeros(0, np.uint16), *[np.frombuffer(x, np.uint16) for x in dealt["owners"].to_pylist()]]).astype(np.int64)
    owner += np.repeat(at * _PLACES, [len(x) for x in tokens])
    token = np.concatenate([np.zeros(0, np.uint32), *tokens])
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    edges = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True]))) if len(token) else np.zeros(1, np.int64)
    times = np.diff(edges)
    rarity = np.where(times > 1, 4 * np.floor(2 * np.log2(times)).astype(np.int64) - 7 + token[edges[:-1]] % 4, 0)
    return _Part(runs, token, owner, np.repeat(rarity, times).astype(np.uint8))


def _count_levels(table: pa.Table) -> pa.Table:
    """Of one part: how many tokens of each level its sets have there; a row for each run."""
    part = _part(table)
    key, times = np.unique(part.owner * _LEVELS + part.level, return_counts=True)
    ends = np.searchsorted(key, np.arange(len(part.runs) + 1) * (_PLACES * _LEVELS))
    blobs = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())
    return pa.table({"run": pa.array(part.runs), "keys": blobs((key % (_PLACES * _LEVELS)).astype(np.uint32)),
                     "times": blobs(times.astype(np.uint32))})


def _cuts(table: pa.Table, percent: int) -> pa.Table:
    """Of one run: for every place the last level of its set's prefix, which holds the first
    tokens of any order of these levels; 0 for a set without the shared tokens of a link."""
    held = np.zeros(_PLACES * _LEVELS, np.int64)
    for keys, times in zip(table["keys"], table["times"]):
        held[np.frombuffer(keys.as_buffer(), np.uint32)] += np.frombuffer(times.as_buffer(), np.uint32)
    upto = held.reshape(_PLACES, _LEVELS).cumsum(1)
    n = upto[:, -1]
    cut = (upto < _prefix_length(n, percent)[:, None]).sum(1)
    cut[100 * (n - upto[:, 0]) < percent * n] = 0
    last = np.flatnonzero(n)[-1] + 1
    return pa.table({"run": table["run"][:1], "cuts": pa.array([cut[:last].astype(np.uint8).tobytes()], pa.binary())})


def _meeting(table: pa.Table) -> pa.Table:
    """Of one part: the pairs (a, b) of sets that have a token in both prefixes, if few sets
    have it; if more do, ``many`` of them are paired with the first only."""
    part = _part(table)
    cut = np.full(len(part.runs) * _PLACES, _LEVELS - 1, np.int64)
    for run, blob in zip(table["run"].to_pylist(), table["cuts"].to_pylist()):
        if blob is not None and (at := np.searchsorted(part.runs, run)) < len(part.runs) and part.runs[at] == run:
            cut[at * _PLACES:at * _PLACES + len(blob)] = np.frombuffer(blob, np.uint8)
    inside = (part.level > 0) & (part.level <= cut[part.owner])
    token, owner = part.token[inside], part.owner[inside]
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(token)))
    first, size = np.repeat(first, size), np.repeat(size, size)
    left, right = [owner[first[size > FEW]]], [owner[size > FEW]]
    hung = len(left[0])
    for step in range(1, FEW):
        some = np.flatnonzero((size[:-step] <= FEW) & (first[:-step] == first[step:]))
        left.append(owner[some])
        right.append(owner[some + step])
    a, b = np.concatenate(right), np.concatenate(left)
    pair = np.unique(((a * len(cut) + b) * 2 + (np.arange(len(a)) < hung))[a != b])
    named = lambda x: pa.array((part.runs[x // _PLACES] * _PLACES + x % _PLACES).astype(np.int64))
    give_back()
    return pa.table({"a": named(pair // 2 // max(1, len(cut))), "b": named(pair // 2 % max(1, len(cut))), "many": pa.array(pair % 2 > 0)})


# -- pairs that no link can join ----------------------------------------------------

def _parity(tokens: np.ndarray) -> bytes:
    """For each of some 2 len(tokens) positions, whether an odd number of tokens is there.
    Sets whose parities differ at d positions differ in d tokens at least."""
    width = min(PARITY_BITS, max(64, 1 << int(2 * len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        odd = [_parity(np.frombuffer(x, np.uint64)) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odd, pa.binary())], ["node", "n", "odd"])


def _differing(x: bytes, y: bytes) -> int:
    """Positions at which parities differ, at the smaller number of positions."""
    short, long = sorted((x, y), key=len)
    folded, bits = int.from_bytes(long, "little"), 8 * len(long)
    while bits > 8 * len(short):
        bits //= 2
        folded = (folded >> bits) ^ (folded & ((1 << bits) - 1))
    return (folded ^ int.from_bytes(short, "little")).bit_count()


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, n and odd of either) that sizes and parities allow to be linked."""
    for batch in batches:
        n, m = (np.asarray(batch.column(k)) for k in (2, 4))
        allowed = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        for i in np.flatnonzero(allowed):
            apart = _differing(batch.column(3)[i].as_py(), batch.column(5)[i].as_py())
            allowed[i] = (100 + percent) * apart <= (100 - percent) * (n[i] + m[i])
        yield batch.select([0, 1]).filter(pa.array(allowed))


def _clusters(sets: DataFrame, total: int, percent: int) -> DataFrame:
    """(node, component): sets (node, n, tokens) that may be linked, directly or through
    others. A set of which no link is possible is in none."""
    parts = 64 + total // TOKENS_PER_PART
    dealt = sets.select("node", "tokens").mapInArrow(partial(_deal_sets, parts=parts), _TOKENS_OF_PART)
    levels = dealt.groupBy("part").applyInArrow(_count_levels, "run long, keys binary, times binary")
    cuts = written_once(levels.groupBy("run").applyInArrow(lambda run: _cuts(run, percent), "run long, cuts binary"), "cuts")
    none = F.lit(None).cast("binary")
    told = cuts.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "run", none.alias("tokens"),
                       none.alias("owners"), "cuts")
    met = dealt.unionByName(told).groupBy("part").applyInArrow(_meeting, "a long, b long, many boolean")
    met = written_once(met.groupBy("a", "b").agg(F.max("many").alias("many")), "met")
    odd = sets.select("node", "n", "tokens").mapInArrow(_parities, "node long, n long, odd binary")
    few = met.filter("not many").select("a", "b")
    for end in ("a", "b"):
        few = few.join(odd.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("odd").alias(f"odd_{end}")), end)
    few = few.select("a", "b", "n_a", "odd_a", "n_b", "odd_b").mapInArrow(partial(_possible, percent=percent), "a long, b long")
    return components(written_once(few.unionByName(met.filter("many").select("a", "b")), "met"))


def _with_counts(scanned: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """All sets that were dealt, and those of them with enough tokens dealt by others
    that a link is possible."""
    counted = written_once(scanned.groupBy("part").applyInArrow(_count_shared, _COUNTED), "shingles")
    drop_shuffles(scanned.sparkSession)
    members = counted.filter("n is not null").select("run", "place", "doc_id", "n", "fp", "fp2")
    shared = counted.filter("shared is not null").groupBy("run", "place").agg(F.sum("shared").alias("shared"))
    return members, members.join(shared, ["run", "place"]).filter(
        F.col("shared") >= F.ceil(F.lit(percent) * F.col("n") / 100))


def _count_shared(table: pa.Table) -> pa.Table:
    """Of one part: its documents as they came, and for each set how many of its
    tokens in this part were dealt by another set too."""
    docs = table.filter(pc.is_valid(table["n"])).select(["run", "doc_id", "n", "fp", "fp2", "place"])
    docs = docs.append_column("shared", pa.nulls(len(docs), pa.int64()))
    dealt = table.filter(pc.is_valid(table["tokens"]))
    if not len(dealt):
        return docs
    tokens = [np.frombuffer(x, np.uint32) for x in dealt["tokens"].to_pylist()]
    runs, at = np.unique(np.asarray(dealt["run"].combine_chunks()), return_inverse=True)
    owner = np.concatenate([np.frombuffer(x, np.uint16) for x in dealt["owners"].to_pylist()]).astype(np.int64)
    owner += np.repeat(at * _RUN, [len(x) for x in tokens])
    token = np.concatenate(tokens)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    del tokens, order
    same = np.zeros(len(token), bool)
    same[1:] = token[1:] == token[:-1]
    same[:-1] |= same[1:]
    shared = np.bincount(owner[same], minlength=1)
    some = np.flatnonzero(shared)
    none = pa.nulls(len(some), pa.int64())
    del token, owner, same
    give_back()
    counted = pa.table([pa.array(runs[some // _RUN]), none, none, none, none, pa.array((some % _RUN).astype(np.int32)),
                        pa.array(shared[some])], schema=docs.schema)
    return pa.concat_tables([docs, counted])


def _sets_of(batches: Iterator[pa.RecordBatch], words: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sets of the texts (doc_id, text), of those that are not wanted next to none."""
    for batch in batches:
        for some in slices(batch, 1, _RUN, _RUN_BYTES):
            sets = list(shingle_sets(some.column(1), words))
            prints = np.array([_fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            kept = np.flatnonzero(among(wanted, some.column(0), prints[:, 0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints[kept, 0]), pa.array(prints[kept, 1]), pa.array([sets[i].tobytes() for i in kept], pa.binary())],
                ["fp", "fp2", "tokens"])
        give_back()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            counts += np.bincount(_cell(np.frombuffer(blob, np.uint64)), minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["cell", "n"])


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _prefix_length(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    return n - -(-percent * n // 100) + 1


def _rare_first(tokens: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    order = np.lexsort((tokens, counts[_cell(tokens)]))
    return tokens[order[:_prefix_length(len(tokens), percent)]]


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left has in common with each on the right."""
    m, n = len(left), len(right)
    out = np.zeros((m, n), np.int32)
    if not m or not n:
        return out
    token = np.concatenate(right)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], np.repeat(np.arange(n), [len(x) for x in right])[order]
    for i, x in enumerate(left):
        low, high = np.searchsorted(token, x, "left"), np.searchsorted(token, x, "right")
        size = high - low
        if total := int(size.sum()):
            at = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)
            out[i] = np.bincount(owner[at], minlength=n)
    return out


def _verified(table: pa.Table, counts: np.ndarray, percent: int) -> pa.Table:
    """The links between two blocks of a cluster, or inside one."""
    node = np.asarray(table["node"].combine_chunks())
    side = np.asarray(table["block"].combine_chunks()) != table["high"][0].as_py()
    sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
    inside = table["high"][0].as_py() == table["low"][0].as_py()
    a = np.arange(len(node)) if inside else np.flatnonzero(side)
    b = a if inside else np.flatnonzero(~side)
    n = np.array([len(s) for s in sets], np.int64)
    small, large = np.minimum(n[a][:, None], n[b]), np.maximum(n[a][:, None], n[b])
    passed = 100 * small >= percent * large
    if inside:
        passed &= np.tri(len(a), k=-1, dtype=bool)
    head = [_prefix_length(len(s), percent) for s in sets]
    for order in (lambda s, k: _rare_first(s, counts, percent), lambda s, k: s[:k], lambda s, k: s[len(s) - k:]):
        if passed.any():
            passed &= _common([order(sets[i], head[i]) for i in a], [order(sets[i], head[i]) for i in b]) > 0
    links = np.zeros(len(node), np.int64)
    root = np.arange(len(node))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    rows, columns = np.flatnonzero(passed.any(1)), np.flatnonzero(passed.any(0))
    if len(rows):
        both = _common([sets[a[i]] for i in rows], [sets[b[j]] for j in columns])
        total = n[a[rows]][:, None] + n[b[columns]] - both
        linked = (100 * both.astype(np.int64) >= percent * total) & passed[np.ix_(rows, columns)]
        docs = np.asarray(table["docs"].combine_chunks())
        links[a[rows]] += linked @ docs[b[columns]]
        links[b[columns]] += docs[a[rows]] @ linked
        for i, j in np.argwhere(linked):
            root[find(a[rows[i]])] = find(b[columns[j]])
    some = np.flatnonzero(links)
    hangs = np.array([find(i) for i in some], np.int64)
    return pa.table({"a": node[some], "b": node[hangs], "links": links[some]})


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per document: doc_id, n_shingles,
    component_id, n_links.

    ``component_id`` is the smallest doc_id that links reach; ``n_links`` counts the
    other documents a document is linked with, those with an equal set too; rows that
    repeat count each. The text is lower-cased in A-Z and split at
    ASCII white space.

    A null or empty text has no shingle, no link and its own doc_id as component.
    Rows that repeat stay; a null doc_id belongs to a group without naming it, unless
    the group has no other. Columns beside doc_id and text are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 64 + chars // CHARS_PER_PART
    members, enough = _with_counts(docs.mapInArrow(partial(_scan_texts, words=words, parts=parts), _SCANNED), percent)

    # Equal sets are one from here on; node is the set's number. Copies in other runs
    # counted as sets that share tokens and so are counted again, once each.
    classes = members.filter("n > 0").groupBy("fp", "fp2", "n").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("docs"))
    left = written_once(classes.join(enough, ["fp", "fp2", "n"], "left_semi"), "candidates")
    at = positions(left.select("first_id"))
    texts = docs.join(F.broadcast(at), at["position"] == position(F.col("doc_id")), "left_semi").select("doc_id", "text")
    wanted = spark.sparkContext.broadcast(bits(left.select("first_id", "fp")))
    found = texts.mapInArrow(lambda batches: _sets_of(batches, words, wanted.value), "fp long, fp2 long, tokens binary")
    sets = left.join(found, ["fp", "fp2"]).groupBy("fp", "fp2", "n").agg(
        *[F.first(c).alias(c) for c in ("tokens", "docs", "first_id")])
    sets = written_once(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    drop_shuffles(spark)
    tokens = sets.agg(F.sum("n")).first()[0] or 0
    clusters = written_once(_clusters(sets, tokens, percent), "clusters")
    drop_shuffles(spark)

    cells = sets.select("tokens").mapInArrow(_sketched, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << SKETCH_BITS, np.int64)  # a fixed number of counters, whatever the input
    for cell, n in cells.collect():
        counts[cell] = n
    held = spark.sparkContext.broadcast(counts)

    inside = sets.select("node", "n").join(clusters, "node").select("node", "n", F.col("component").alias("cluster"))
    blocks = inside.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.col("n") * 8) / BLOCK_BYTES)).cast("int").alias("k"))
    block = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    pairs = (sets.select("node", "docs", "tokens").join(inside.join(blocks, "cluster").drop("n"), "node").withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select("node", "docs", "tokens", "cluster", "block", F.greatest("block", "other").alias("high"),
                     F.least("block", "other").alias("low")))
    many = 64 + (blocks.agg(F.sum(F.col("k") * (F.col("k") + 1) / 2)).first()[0] or 0) // 64
    pairs = pairs.repartition(int(many), "cluster", "high", "low")
    links = written_once(pairs.groupBy("cluster", "high", "low").applyInArrow(
        lambda table: _verified(table, held.value, percent), "a long, b long, links long"), "links")
    groups = components(links.select("a", "b"))

    degree = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    named = written_once(sets.select("node", "fp", "fp2", "n", "first_id").join(groups.join(degree, "node"), "node"), "linked")
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_set = named.join(first, "component").select("fp", "fp2", "n", "component_id", "n_links")
    # Documents with an equal set, then those of the sets linked with it.
    equal = F.coalesce(F.col("docs") - 1, F.lit(0))
    return (members.join(classes, ["fp", "fp2", "n"], "left").join(by_set, ["fp", "fp2", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "first_id", "doc_id").alias("component_id"),
                    (equal + F.coalesce("n_links", F.lit(0))).alias("n_links")))


def one_per_group(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their group, with all their columns: one
    document of each group, and all that are in none. Rows that share a doc_id stay or go
    together, and stay if any of them would. Other columns may have any names."""
    groups = jaccard_groups(docs, words, percent)
    lost = groups.groupBy("doc_id").agg(F.bool_and(~F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("lost"))
    lost = written_once(lost.filter("lost").select("doc_id"), "near")
    apart, maybe = split_by_id(docs, lost)
    [name] = unused(docs, "gone")
    gone = lost.select(F.col("doc_id").alias(name))
    return apart.unionByName(maybe.join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti"))
