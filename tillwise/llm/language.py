"""Language identification in two steps: the language family first, then one-versus-one
linear support vector machines between the languages of that family.

Features are the relative frequencies of hashed byte bigrams and trigrams of the whole
text, lower-cased in A-Z, with everything in ASCII but letters as space. A linear decision
is then the mean over the text of one number per n-gram, so texts are scored without
building their feature vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.textscan import CHUNK_BYTES, string_buffers
from tillwise.plans.durable import written_once

# Families of languages. A language that is not listed is its own family.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
}
UNKNOWN = "und"
SIZE = 1 << 12

_MAP = np.full(256, 0x20, np.uint32)
_MAP[128:] = np.arange(128, 256)
_MAP[97:123] = _MAP[65:91] = np.arange(97, 123)


def _cells(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the bigram and of the trigram at each byte; the last two bytes
    have none of one kind or both."""
    b = _MAP[data]
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - 12)
    return (two * np.uint32(0x165667B1)) >> shift, (three * np.uint32(0x165667B1)) >> shift


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, data = string_buffers(batch.column(1))
        rows = []
        for a, b in zip(at, at[1:]):
            counts = np.zeros(SIZE, np.float32)
            if b - a >= 2:
                for cells in _cells(data[a:b]):
                    counts += np.bincount(cells, minlength=SIZE)
            rows.append(counts / max(1.0, counts.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["lang", "features"])


@dataclass
class Separators:
    """Linear decisions between pairs; the first of a pair is on the positive side."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # SIZE x pair
    bias: np.ndarray


def learn_languages(docs: DataFrame, rows: int = 800, families: dict[str, str] | None = None,
                    rounds: int = 25, penalty: float = 1e-3) -> Separators:
    """Separators learned from ``docs`` (doc_id, text, lang).

    About ``rows`` documents of each language are taken, those with the lowest hashes of
    doc_id. Rows with a null lang or without text teach nothing.
    """
    named = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(
        "lang is not null and length(text) >= 2")
    many = named.groupBy("lang").count().withColumnRenamed("lang", "of")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    taken = named.join(F.broadcast(many), F.col("lang") == F.col("of")).filter(share * F.col("count") < rows)
    sample = written_once(taken.select("lang", "text").mapInArrow(_vectors, "lang string, features array<float>"), "languages")
    members: dict[str, list[str]] = {}
    for lang in sorted(r["lang"] for r in sample.select("lang").distinct().collect()):
        members.setdefault({**FAMILIES, **(families or {})}.get(lang, lang), []).append(lang)
    pairs = list(combinations(sorted(members), 2)) + [p for f in sorted(members) for p in combinations(members[f], 2)]
    weights, bias = np.zeros((SIZE, len(pairs))), np.zeros(len(pairs))
    fit = LinearSVC(maxIter=rounds, regParam=penalty, standardization=True)
    for k, (left, right) in enumerate(pairs):
        sides = [members.get(x, [x]) if left in members and right in members else [x] for x in (left, right)]
        mine = sample.filter(F.col("lang").isin(sides[0] + sides[1])).select(
            F.col("lang").isin(sides[0]).cast("double").alias("label"), array_to_vector("features").alias("features"))
        model = fit.fit(mine.coalesce(6))
        weights[:, k], bias[k] = model.coefficients.toArray(), model.intercept
    return Separators(members, pairs, weights, bias)


def _decisions(column: pa.Array, learned: Separators) -> np.ndarray:
    """Text x pair. Texts without an n-gram have the bias alone."""
    at, data = string_buffers(column)
    table = np.ascontiguousarray(learned.weights, np.float32)
    n, first = len(at) - 1, 0
    out = np.tile(learned.bias, (n, 1))
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
        part, starts = data[at[first]:at[last]], at[first:last + 1] - at[first]
        if len(part) >= 3:
            two, three = _cells(part)
            size = np.diff(starts)
            for cells, width in ((two, 2), (three, 3)):
                valid = np.flatnonzero(size >= width)
                ends = starts[1:][valid] - width + 1
                edges = np.stack([starts[:-1][valid], ends], 1).ravel()
                count = np.maximum(size[valid] - 1, 0) + np.maximum(size[valid] - 2, 0)
                for k in range(table.shape[1]):
                    # Even sums are of texts, odd ones of what spans two texts.
                    sums = np.add.reduceat(np.append(table[cells, k], np.float32(0)), edges, dtype=np.float64)[::2]
                    out[first + valid, k] += sums / count
        first = last
    return out


def _voted(names: list[str], decisions: np.ndarray, pairs: list[tuple[str, str]], within: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The member with most pairs won, then the largest sum of decisions; and its margin."""
    votes, total = np.zeros((len(decisions), len(names))), np.zeros((len(decisions), len(names)))
    for k in within:
        d = decisions[:, k]
        for name, side in zip(pairs[k], (1, -1)):
            i = names.index(name)
            votes[:, i] += side * d > 0
            total[:, i] += np.tanh(side * d)
    best = np.lexsort((total, votes), axis=1)[:, -1] if len(names) > 1 else np.zeros(len(decisions), np.int64)
    margin = np.full(len(decisions), np.inf)
    for k in within:
        for name, side in zip(pairs[k], (1, -1)):
            mine = best == names.index(name)
            margin[mine] = np.minimum(margin[mine], side * decisions[mine, k])
    return best, margin


def _identified(batches: Iterator[pa.RecordBatch], learned: Separators) -> Iterator[pa.RecordBatch]:
    names, pairs = sorted(learned.families), learned.pairs
    for batch in batches:
        ids, text = batch.columns
        letter = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
        lang, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
        if names:
            d = _decisions(text, learned)
            family, sure = _voted(names, d, pairs, [k for k, p in enumerate(pairs) if p[0] in names and p[1] in names
                                                    and k < len(names) * (len(names) - 1) // 2])
            for i, name in enumerate(names):
                mine = np.flatnonzero((family == i) & letter)
                members = learned.families[name]
                offset = len(names) * (len(names) - 1) // 2
                best, margin = _voted(members, d[mine], pairs, [k for k, p in enumerate(pairs) if k >= offset and p[0] in members])
                lang[mine] = np.array(members, object)[best]
                score[mine] = 1 / (1 + np.exp(-2 * np.clip(np.minimum(sure[mine], margin), -20, 20)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, learned: Separators) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, lang_pred and score, from 0 to 1, for every row.

    Null texts, texts without a letter and all texts where nothing was learned are ``und``
    with score 0. If one language was learned, it is the answer for all others. Columns
    beside the two are not read.
    """
    only = docs.select("doc_id", "text")
    kind = only.schema["doc_id"].dataType.simpleString()
    return only.mapInArrow(partial(_identified, learned=learned), f"doc_id {kind}, lang_pred string, score double")
