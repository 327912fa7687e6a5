"""Benchmark decontamination: every passage of every document is a query against a
BM25 index of the test items.

The index is inverted, cut into blocks of items, and keeps the largest score of each
term per block. Scores are divided by the item's score for its own text, so that one
threshold holds for all items and the score reads as the share of the item's weight
that a passage covers. A passage is dropped as soon as bounds allow it, as in
block-max WAND: if the largest scores of its terms do not add up to the threshold; then
for each block, if the block's largest scores do not. Only items of blocks that are
left are scored. The bounds are never below the score, so nothing is missed. A passage's
terms are bounded together, block by block; there is no pivot that moves along postings.

Every item above the threshold is then verified: word trigrams of its question and of
its answer have to occur in the passage. Items of few words share most of them with clean
texts; they count only as one run of words, question and answer whole and in order. To be
bounded like the others, their scores are scaled so that all their words make the threshold.
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

from tillwise.llm.textscan import SPACE_OR_SIGN, give_back, mix, scan_words

#: Items that one broadcast index holds; more are taken in turn.
ITEMS_PER_INDEX = 20_000
#: Items in a block of the index.
BLOCK = 16
#: Runs of items that are screened for together, and the share of items (one in so many)
#: from which a term is common.
SCREENS, COMMON = 16, 20
_LOOKUP_BITS = 20
_GRAM = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _words(texts: list[str]) -> list[np.ndarray]:
    found = [w for w in scan_words(pc.utf8_lower(pa.array(texts, pa.large_string())), SPACE_OR_SIGN)]
    return [x for w in found for x in np.split(w.hashes, w.offsets[1:-1])]


def _grams(words: np.ndarray) -> np.ndarray:
    """Distinct trigrams; none of fewer words."""
    return np.unique(mix(words[:-2] * _GRAM[0] + words[1:-1] * _GRAM[1] + words[2:] * _GRAM[2]))


def _evidence(words: np.ndarray) -> np.ndarray:
    """What a passage has to have of a question or answer: trigrams, or words if they are few."""
    return _grams(words) if len(words) >= 3 else np.unique(words)


class Index(NamedTuple):
    """Postings by term and, for bounds, by (term, block). Terms are word hashes, sorted."""

    items: np.ndarray
    terms: np.ndarray
    lookup: np.ndarray  # whether any term has these upper bits
    highest: np.ndarray  # of each term
    at: np.ndarray  # postings of term t: at[t] to at[t + 1]
    item: np.ndarray
    score: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_score: np.ndarray
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    runs: list[np.ndarray | None]  # words in order, of the items that must stand as one run
    longest: int  # words of the longest item
    rare: np.ndarray  # terms in few items
    screen: np.ndarray  # highest score of each rare term in each of SCREENS runs of items
    slack: np.ndarray  # most that the other terms can add for an item of the run


def build_index(rows: list[tuple[int, str, str, dict[int, float]]], k1: float, b: float, mean: float,
                threshold: float = 1.0, run_words: int = 0) -> Index:
    """``rows``: item_id, question, answer, and the inverse document frequency of its words.
    Items of fewer than ``run_words`` words reach ``threshold`` with all their words."""
    rows = sorted(rows, key=lambda r: (len(r[1]) + len(r[2]), r[0]))  # blocks of like lengths bound better
    questions, answers = _words([r[1] for r in rows]), _words([r[2] for r in rows])
    words_in_order = [np.concatenate(x) for x in zip(questions, answers)]
    whole = [w if len(w) < run_words else None for w in words_in_order]
    parts = []
    for i, row in enumerate(rows):
        words, tf = np.unique(words_in_order[i], return_counts=True)
        idf = np.array([row[3].get(w, 0.0) for w in words.view(np.int64).tolist()])
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * tf.sum() / mean))
        parts.append((words, np.full(len(words), i), part / part.sum() * (1.0 if whole[i] is None else threshold)))
    word, item, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((item, word))
    word, item, score = word[order], item[order], score[order]
    terms, at = np.unique(word, return_index=True)
    at = np.append(at, len(word))
    term = np.repeat(np.arange(len(terms)), np.diff(at))
    key, block_at = np.unique(term * (len(rows) // BLOCK + 1) + item // BLOCK, return_index=True)
    block_score = np.maximum.reduceat(score, block_at)
    of = key // (len(rows) // BLOCK + 1)
    # Terms of many items are in every passage. What they can add to an item is known
    # beforehand, so passages are screened by the others.
    common = np.diff(at) >= max(3, len(rows) // COMMON)
    runs = np.arange(len(rows)) * SCREENS // len(rows)
    rare = np.flatnonzero(~common)
    shared = np.bincount(item, np.where(common[term], score, 0), len(rows))
    slack = np.array([shared[runs == r].max(initial=0) for r in range(SCREENS)])
    screen = np.zeros((SCREENS, len(terms)))
    np.maximum.at(screen, (runs[item], term), score)
    lookup = np.zeros(1 << _LOOKUP_BITS, bool)
    lookup[terms[rare] >> np.uint64(64 - _LOOKUP_BITS)] = True
    return Index(np.array([r[0] for r in rows]), terms, lookup, np.maximum.reduceat(score, at[:-1]), at, item, score,
                 np.searchsorted(of, np.arange(len(terms) + 1)), key % (len(rows) // BLOCK + 1), block_score,
                 [_evidence(x) for x in questions], [_evidence(x) for x in answers],
                 whole, max(map(len, words_in_order)), ~common, screen, slack)


def _gathered(at: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Positions of the postings of some terms."""
    low, size = at[terms], at[terms + 1] - at[terms]
    return np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())


def retrieve(index: Index, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All items that score at least ``threshold`` for a passage's distinct terms."""
    if index.highest[terms].sum() < threshold:
        return np.zeros(0, np.int64), np.zeros(0)
    some = _gathered(index.block_at, terms)
    bound = np.bincount(index.block[some], index.block_score[some])
    alive = bound >= threshold
    if not alive.any():
        return np.zeros(0, np.int64), np.zeros(0)
    some = _gathered(index.at, terms)
    some = some[alive[index.item[some] // BLOCK]]
    score = np.bincount(index.item[some], index.score[some])
    found = np.flatnonzero(score >= threshold)
    return found, score[found]


def _overlap(wanted: np.ndarray, passage: np.ndarray) -> float:
    return float(np.isin(wanted, passage, assume_unique=True).mean()) if len(wanted) else 1.0


def _has_run(run: np.ndarray, words: np.ndarray) -> bool:
    """Whether ``words`` has the words of ``run`` one after the other."""
    n = len(words) - len(run) + 1
    same = np.ones(max(n, 0), bool)
    for k, word in enumerate(run):
        same &= words[k:k + len(same)] == word
    return bool(same.any())


def _hits(index: Index, column: pa.Array, threshold: float, question: float, answer: float
          ) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(row, item, score, question overlap, answer overlap, first word) of each row and item."""
    step = max(8, index.longest // 2)
    size = index.longest + step  # every run of words as long as an item lies in a passage
    margin = threshold - 1e-9
    for found in scan_words(pc.utf8_lower(column), SPACE_OR_SIGN):
        at = found.offsets
        some = np.flatnonzero(index.lookup[found.hashes >> np.uint64(64 - _LOOKUP_BITS)])
        term = np.minimum(np.searchsorted(index.terms, found.hashes[some]), len(index.terms) - 1)
        real = (index.terms[term] == found.hashes[some]) & index.rare[term]
        some, term = some[real], term[real]
        passages = np.maximum(1, -(-(found.counts - step) // step))
        passages[found.counts == 0] = 0
        row = np.repeat(np.arange(len(found.counts)), passages)
        first = at[row] + step * (np.arange(len(row)) - np.repeat(np.cumsum(passages) - passages, passages))
        last = np.minimum(first + size, at[row + 1])
        low, high = np.searchsorted(some, first), np.searchsorted(some, last)
        maybe = np.zeros(len(row), bool)
        for bound, slack in zip(index.screen, index.slack):
            sums = np.append(0.0, np.cumsum(bound[term]))
            maybe |= sums[high] - sums[low] + slack >= margin
        best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        for p in np.flatnonzero(maybe):
            words = np.unique(found.hashes[first[p]:last[p]])
            mine = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
            items, scores = retrieve(index, mine[index.terms[mine] == words], margin)
            if not len(items):
                continue
            grams = np.union1d(words, _grams(found.hashes[first[p]:last[p]]))
            for i, score in zip(items.tolist(), scores.tolist()):
                if index.runs[i] is not None:
                    if not _has_run(index.runs[i], found.hashes[first[p]:last[p]]):
                        continue
                    score /= threshold
                q, a = _overlap(index.questions[i], grams), _overlap(index.answers[i], grams)
                key = (found.first + int(row[p]), i)
                if q >= question and a >= answer and (key not in best or (score, q + a) > (best[key][0], sum(best[key][1:3]))):
                    best[key] = (score, q, a, int(first[p] - at[row[p]]))
        for (r, i), values in sorted(best.items()):
            yield r, int(index.items[i]), *values


def _matched(batches: Iterator[pa.RecordBatch], held, **limits: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = list(_hits(held.value, batch.column(1), **limits))
        rows = pa.array([h[0] for h in hits], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), *(pa.array([h[k] for h in hits], kind) for k, kind in (
                (1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()), (5, pa.int64())))],
            ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])


def _clean(batches: Iterator[pa.RecordBatch], held, **limits: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        keep = np.ones(batch.num_rows, bool)
        keep[[h[0] for h in _hits(held.value, text, **limits)]] = False
        yield batch.filter(pa.array(keep))
        give_back()


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = _words([text])[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(words)]), pa.array([np.unique(words).view(np.int64)], pa.list_(pa.int64()))], ["size", "words"])


def split_items(items: DataFrame) -> DataFrame:
    """(item_id, text) -> item_id, question, answer: the last line is the answer, or
    in one line the last sentence. A single sentence is a question alone."""
    text = F.rtrim(F.coalesce("text", F.lit("")))
    answer = F.regexp_extract(text, r"(?s)\S.*(?:\n|[.!?]\s)\s*([^\n]*?[^\s.!?][^\n.!?]*[.!?]*)$", 1)
    return items.select("item_id", text.alias("_t"), answer.alias("answer")).select(
        "item_id", F.expr("left(_t, length(_t) - length(answer))").alias("question"), "answer")


def _indexes(items: DataFrame, threshold: float, run_words: int, k1: float, b: float) -> Iterator[Index]:
    """One index after the other, each of a bounded number of items; the statistics are
    those of all items that have a word."""
    if "question" not in items.columns:
        items = split_items(items)
    items = items.filter("item_id is not null").select(
        "item_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
    sized = items.withColumn("text", F.concat_ws(" ", "question", "answer"))
    counted = sized.select("text").mapInArrow(_item_words, "size long, words array<long>").filter(F.col("size") > 0)
    n, mean = counted.agg(F.count("*"), F.avg("size")).first()
    if not n:
        return
    idf = counted.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")).select(
        "word", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    turns = -(-sized.count() // ITEMS_PER_INDEX)
    for turn in range(turns):
        mine = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn)
        words = {r[0]: r[1] for r in mine.select("text").mapInArrow(_item_words, "size long, words array<long>")
                 .select(F.explode("words").alias("word")).distinct().join(idf, "word").collect()}
        rows = [(r["item_id"], r["question"], r["answer"], words) for r in mine.select("item_id", "question", "answer").collect()]
        sizes = [len(w) for w in _words([f"{r[1]} {r[2]}" for r in rows])]
        rows = [r for r, size in zip(rows, sizes) if size]
        if rows:
            yield build_index(rows, k1, b, mean, threshold, run_words)


def contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.6, question: float = 0.6,
                  answer: float = 0.5, run_words: int = 8, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``docs`` (doc_id, text), ``items`` (item_id, text or question and answer) -> one
    row per document and item found in it: doc_id, item_id, score, question_overlap,
    answer_overlap, first_word (of the best passage, from 0).

    Words are runs of letters, digits and characters beyond ASCII, lower-cased.
    An item of fewer than ``run_words`` words is found where its question and answer stand
    word for word, one after the other; an item of one word, in every text with that word.
    ``threshold`` is above 0. Null and empty texts contain nothing; an item without a word or
    with a null item_id is left out. Rows with the same doc_id are searched each, and items
    of the same text are each found. Of a text's passages with equal scores the first of
    those with most overlap is given. Texts of any length are searched whole, in overlapping
    passages. Other columns are not read.

    The items are the stated queries' side and broadcast in indexes of bounded size.
    """
    only = docs.select("doc_id", "text")
    kind = only.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double, "
              "first_word long")
    limits = {"threshold": threshold, "question": question, "answer": answer}
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _indexes(items, threshold, run_words, k1, b):
        held = docs.sparkSession.sparkContext.broadcast(index)
        found = found.unionByName(only.mapInArrow(partial(_matched, held=held, **limits), schema))
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, question: float = 0.6,
                         answer: float = 0.5, run_words: int = 8, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The rows of ``docs`` in which no item is found (see ``contamination``), with all their
    columns, whatever they are called. Null and empty texts stay, repeated rows stay each."""
    limits = {"threshold": threshold, "question": question, "answer": answer}
    for index in _indexes(items, threshold, run_words, k1, b):
        held = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.mapInArrow(partial(_clean, held=held, **limits), docs.schema)
    return docs
