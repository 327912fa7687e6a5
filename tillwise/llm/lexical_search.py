"""Ranked lexical search without an index of the documents.

All terms of all items make one Aho-Corasick automaton. A term stands in it between
two guards, as it does in a text whose other characters are guards, so the automaton
finds whole terms only. Its outputs are term numbers, and a table of postings maps
those to the items.

The texts are scanned twice. The first scan counts documents, terms and the documents
of each item term; a task returns one row per term. The second scores every document
for every item; a task returns its best rows for each item. No text is shuffled.

Items are the stated queries' side. They are held in passes of bounded size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.textscan import SPACE_OR_SIGN, string_buffers
from tillwise.plans.durable import written_once

#: Postings (an item's distinct terms) that one pass over the documents holds, about.
POSTINGS_PER_PASS = 1 << 20
#: Texts go through the automaton in pieces of about so many bytes, cut between terms.
PIECE_BYTES = 1 << 20
#: Scores that are held at once, and the most documents they are from.
_CELLS, _ROWS = 1 << 20, 1024

_GUARD = 0x20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[SPACE_OR_SIGN] = _GUARD
_LAST = np.iinfo(np.int64).max


def _folded(data: np.ndarray) -> np.ndarray:
    """A text's bytes, A-Z in lower case and a guard for whatever is in no term."""
    return _FOLD[data]


def _pieces(folded: np.ndarray) -> Iterator[str]:
    """The text between guards, in pieces of whole terms."""
    raw = folded.tobytes()
    low = 0
    while low < len(raw):
        high = len(raw)
        if high - low > PIECE_BYTES:
            cut = raw.find(b" ", low + PIECE_BYTES)
            high = high if cut < 0 else cut + 1
        yield f" {raw[low:high].decode(errors='replace')} "
        low = high


@dataclass(frozen=True)
class Queries:
    """Items and their terms; ``at`` holds where a term's postings begin."""

    items: list[int | None]
    terms: list[str]
    at: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Built once in every Python worker."""
        found = ahocorasick.Automaton()
        for number, term in enumerate(self.terms):
            found.add_word(f" {term} ", number)
        found.make_automaton()
        return found

    def postings_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the postings of some terms, and how many each term has."""
        low, size = self.at[terms], self.at[terms + 1] - self.at[terms]
        return np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()), size


def build_queries(rows: list[tuple[int | None, str, int]]) -> Queries:
    """Queries from (item, term, times)."""
    items = sorted({r[0] for r in rows}, key=lambda x: (x is None, x))
    terms = sorted({r[1] for r in rows})
    place = {x: i for i, x in enumerate(items)}
    number = {x: i for i, x in enumerate(terms)}
    term = np.array([number[r[1]] for r in rows], np.int64)
    order = np.argsort(term, kind="stable")
    at = np.searchsorted(term[order], np.arange(len(terms) + 1))
    return Queries(items, terms, at, np.array([place[r[0]] for r in rows], np.int64)[order],
                   np.array([r[2] for r in rows], np.int64)[order])


def _scanned(queries: Queries, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of every text: the number of its terms, the item terms among them and how often
    each occurs."""
    at, data = string_buffers(column)
    term_of = itemgetter(1)
    for low, high in zip(at, at[1:]):
        folded = _folded(data[low:high])
        inside = folded != _GUARD
        n = int(inside[:1].sum()) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))
        found = Counter()
        if queries.terms:
            for piece in _pieces(folded):
                found.update(map(term_of, queries.automaton.iter(piece)))
        yield (n, np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found)))


_DOCUMENTS, _TERMS = -1, -2


def _counted(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Documents with each item term; documents and terms in all under two numbers of
    their own."""
    queries = held.value
    df, documents, terms = np.zeros(len(queries.terms), np.int64), 0, 0
    for batch in batches:
        for n, found, _ in _scanned(queries, batch.column(0)):
            documents += n > 0
            terms += n
            df[found] += 1
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(some, [_DOCUMENTS, _TERMS])), pa.array(np.append(df[some], [documents, terms]))], ["term", "n"])


class _Best:
    """The first ``k`` documents of every item so far: higher scores, then smaller ids."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        item, score, doc = (np.concatenate(pair) for pair in (
            (self.item, item), (self.score, scores[row, item]), (self.doc, docs[row])))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        self.item, self.score, self.doc = item[rank < self.k], score[order], doc[order]
        last = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.least[self.item[last]] = self.score[last]


def _ranked(batches: Iterator[pa.RecordBatch], held, weight, documents: int, terms: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best documents of this task for every item."""
    queries = held.value
    gain = queries.times * np.repeat(weight.value, np.diff(queries.at))
    best = _Best(len(queries.items), k)
    rows = max(1, min(_ROWS, _CELLS // max(1, len(queries.items))))
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            some = batch.slice(low, rows)
            scores = np.zeros((some.num_rows, len(queries.items)), np.int64)
            for row, (n, found, tf) in enumerate(_scanned(queries, some.column(1))):
                if len(found):
                    m = 100 - 75 + 75 * n * documents // terms
                    share = 1_000_000_000 * tf // (1000 * tf + 8 * m)
                    posting, size = queries.postings_of(found)
                    np.add.at(scores[row], queries.item[posting], gain[posting] * np.repeat(share, size))
            # No id comes after all others.
            best.add(np.asarray(some.column(0).fill_null(_LAST)), scores)
    no_id = pa.array(best.doc == _LAST)
    yield pa.RecordBatch.from_arrays(
        [pa.array(queries.items, pa.int64()).take(pa.array(best.item)),
         pa.array(best.doc, mask=np.asarray(no_id)), pa.array(best.score)], ["item_id", "doc_id", "score"])


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An item's terms and how often each occurs in this row of it."""
    for batch in batches:
        at, data = string_buffers(batch.column(1))
        for row, (low, high) in enumerate(zip(at, at[1:])):
            found = Counter(re.findall("[^ ]+", _folded(data[low:high]).tobytes().decode(errors="replace")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[row].as_py()] * len(found), pa.int64()), pa.array(list(found.keys()), pa.string()),
                 pa.array(list(found.values()), pa.int64())], ["item_id", "term", "times"])


def _passes(items: DataFrame) -> Iterator[Queries]:
    """The items, in runs of bounded size: whole items, by a hash of their id."""
    found = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        _terms_of, "item_id long, term string, times long")
    found = written_once(found.groupBy("item_id", "term").agg(F.sum("times").alias("times")), "queries")
    passes = -(-found.count() // POSTINGS_PER_PASS)
    for number in range(passes):
        mine = found.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number)
        if rows := [tuple(r) for r in mine.collect()]:
            yield build_queries(rows)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``docs`` (doc_id, text), ``items`` (item_id, text) -> item_id, rank, doc_id, score:
    the ``k`` documents with the highest scores above 0 for every item, smaller doc_ids
    first among equals.

    Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z is
    lower-cased. The score is a BM25 in integers: ``w * (10^9 tf div (1000 tf + 8 m))``
    summed over the item's terms with repeats, ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``,
    ``m = 25 + 75 n N div L``.

    Null and empty texts have no terms: such documents are not counted in ``N`` and never
    found, such items find nothing. Rows with one item_id are one item with the terms of
    all; a null item_id is an item. Rows with one doc_id are ranked each, a null doc_id
    after all others of its score. Other columns are not read. Counts the corpus when called.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    best = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for queries in _passes(items):
        held = spark.sparkContext.broadcast(queries)
        counts = dict(docs.select("text").mapInArrow(partial(_counted, held=held), "term long, n long")
                      .groupBy("term").agg(F.sum("n")).collect())  # a row per term of the pass
        documents, terms = counts.get(_DOCUMENTS, 0), counts.get(_TERMS, 0)
        if not terms:
            continue
        weight = spark.sparkContext.broadcast(np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * counts.get(i, 0) + 1))) for i in range(len(queries.terms))], np.int64))
        best = best.unionByName(docs.mapInArrow(
            partial(_ranked, held=held, weight=weight, documents=documents, terms=terms, k=k), best.schema))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
