"""Toxicity scores from a weighted lexicon.

Texts are folded first: A-Z to lower case, look-alike letters of other scripts and
digits or signs inside a word to the Latin letters they stand for. One Aho-Corasick
pass then finds all terms at the start of words. Terms inside an exception phrase do
not count. The sum of weights is divided by the length of the text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.textscan import CHUNK_BYTES, give_back, slices
from tillwise.plans.durable import written_once

# Look-alikes of Latin letters in Cyrillic, Greek and other alphabets.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ё": "e", "ї": "i",
    "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "У": "y",
    "Х": "x", "Ѕ": "s", "І": "i", "Ј": "j", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m",
    "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x", "ı": "i", "ℓ": "l",
}
# Digits and signs for letters; signs count only before a letter.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}

_WIDE = {chr(0xFF21 + i + case): chr(97 + i) for i in range(26) for case in (0, 32)}
_LOOKALIKES = str.maketrans(LOOKALIKES | _WIDE)
#: First UTF-8 bytes of the characters above.
_LEADS = sorted({c.encode()[0] for c in LOOKALIKES | _WIDE})


def _byte_map() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    table[128:] = np.arange(128, 256)
    for low in range(97, 123):
        table[low] = table[low - 32] = low
    for a, b in (DIGITS | SIGNS).items():
        table[ord(a)] = ord(b)
    table[[ord(c) for c in "269"]] = [ord(c) for c in "269"]
    return table


_FOLD = _byte_map()
_IS_LEAD = np.zeros(256, bool)
_IS_LEAD[_LEADS] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in SIGNS]] = True


def folded_bytes(raw: bytes) -> np.ndarray:
    """UTF-8 bytes folded to words between single-byte spaces, one byte more at the end."""
    data = np.frombuffer(raw, np.uint8)
    if _IS_LEAD[data].any():
        data = np.frombuffer(raw.decode().translate(_LOOKALIKES).encode(), np.uint8)
    out = np.append(_FOLD[data], np.uint8(0x20))
    loose = _SIGN[data] & ~np.append(_LETTER[data[1:]], False)
    out[:-1][loose] = 0x20
    return out


def folded(text: str | None) -> str:
    """The text as the lexicon sees it: lower-case words with a space before each."""
    return " ".join(["", *folded_bytes((text or "").encode()).tobytes().decode().split()])


@dataclass
class Lexicon:
    """Terms with weights. " idiot " is a word, " idio" whatever begins so."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    #: Weight per word at which a text scores 0.3.
    level: float = 0.05
    #: Added to the number of words, so that one term in a short text is no proof.
    extra_words: int = 20


# -- learning ---------------------------------------------------------------------

def _patterns(word: str, least: int, most: int) -> Iterator[str]:
    yield f" {word} "
    for k in range(least, min(most, len(word)) + 1):
        yield f" {word[:k]}"


def _counted(batches: Iterator[pa.RecordBatch], wanted: frozenset[str] | None, least: int, most: int
             ) -> Iterator[pa.RecordBatch]:
    """Occurrences of patterns, and documents that have them, by label."""
    for batch in batches:
        times, docs = Counter(), Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = Counter()
            for word, n in Counter(folded(text).split()).items():
                for p in _patterns(word, least, most):
                    if wanted is None or p in wanted:
                        found[p] += n
            times.update({(p, toxic): n for p, n in found.items()})
            docs.update((p, toxic) for p in found)
        keys = list(times)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([times[k] for k in keys], pa.int64()), pa.array([docs[k] for k in keys], pa.int64())],
            ["pattern", "toxic", "times", "docs"])


def _phrases(batches: Iterator[pa.RecordBatch], weights: dict[str, float], longest: int) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours of which one is a term, by label."""
    def known(word: str) -> bool:
        return any(p in weights for p in _patterns(word, 1, longest))

    for batch in batches:
        times = Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = folded(text).split()
            hit = [known(w) for w in words]
            times.update((f" {words[i]} {words[i + 1]} ", toxic) for i in range(len(words) - 1) if hit[i] or hit[i + 1])
        keys = list(times)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([times[k] for k in keys], pa.int64())], ["phrase", "toxic", "times"])


def learn_lexicon(docs: DataFrame, labels: DataFrame, rows: int = 12_000, terms: int = 4_000,
                  least: int = 4, most: int = 9) -> Lexicon:
    """A lexicon from at most ``rows`` labelled documents, chosen by a hash of doc_id.

    A pattern is a folded word or the first ``least`` to ``most`` characters of words.
    Its weight is the logarithm of how much more often it occurs per word under label 1.
    Patterns need several documents and a clear excess; of patterns that say the same the
    most specific stays. Pairs of words with a term in them that are as common under
    label 0 become exception phrases. At most ``terms`` of each are kept.

    Labels that are null are left out; of several labels of a document the largest holds.
    Without documents of both kinds the lexicon is empty.
    """
    chosen = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
              .agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    sample = written_once(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                          .join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    words = {r["toxic"]: (r["rows"], r["words"]) for r in sample.groupBy("toxic").agg(
        F.count("*").alias("rows"), F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("words")).collect()}
    if set(words) != {0, 1} or not words[0][1] or not words[1][1]:
        return Lexicon({})
    count = partial(_counted, least=least, most=most)
    kinds = "pattern string, toxic int, times long, docs long"
    floor = max(3, words[1][0] // 300)
    usual = (sample.filter("toxic = 1").mapInArrow(partial(count, wanted=None), kinds).groupBy("pattern")
             .agg(F.sum("times").alias("times"), F.sum("docs").alias("docs")).filter(F.col("docs") >= floor)
             .orderBy(F.desc("docs"), "pattern").limit(20 * terms).collect())
    toxic = {r["pattern"]: r["times"] for r in usual}
    clean = {r["pattern"]: r["times"] for r in sample.filter("toxic = 0").mapInArrow(
        partial(count, wanted=frozenset(toxic)), kinds).groupBy("pattern").agg(F.sum("times").alias("times")).collect()}

    weights = {}
    for p, n in toxic.items():
        expected = (clean.get(p, 0) + 0.5) * words[1][1] / words[0][1]
        if n > 4 * expected and n - expected > 4 * math.sqrt(expected):
            weights[p] = math.log((n + 0.5) / expected)
    kept: dict[str, float] = {}
    for p in sorted(weights, key=lambda p: (-len(p), p)):
        longer = [q for q in kept if q.startswith(p)]
        if any(toxic[q] >= 0.9 * toxic[p] for q in longer):
            continue  # one longer term accounts for it
        kept[p] = weights[p]
    for p in list(kept):
        shorter = [kept[p[:k]] for k in range(least, len(p)) if p[:k] in kept]
        if shorter and kept[p] < max(shorter) + 0.3:
            del kept[p]
    weights = dict(sorted(kept.items(), key=lambda x: (-x[1] * toxic[x[0]], x[0]))[:terms])

    pairs = (sample.mapInArrow(partial(_phrases, weights=weights, longest=most), "phrase string, toxic int, times long")
             .groupBy("phrase").agg(F.sum(F.expr("if(toxic = 1, times, 0)")).alias("bad"),
                                    F.sum(F.expr("if(toxic = 0, times, 0)")).alias("good"))
             .filter((F.col("good") >= 3) & (F.col("good") * float(words[1][1]) >= F.col("bad") * float(words[0][1])))
             .orderBy(F.desc("good"), "phrase").limit(terms).collect())
    lexicon = Lexicon(weights, [r["phrase"] for r in pairs])
    scored = sample.mapInArrow(partial(_densities, lexicon=lexicon), "density double, toxic int").collect()
    lexicon.level = _best_level(np.array([r["density"] for r in scored]), np.array([r["toxic"] for r in scored]))
    return lexicon


def _best_level(density: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap at which most labels of either kind come out right."""
    order = np.argsort(density, kind="stable")
    density, toxic = density[order], toxic[order] == 1
    right = np.cumsum(~toxic) / max(1, (~toxic).sum()) - np.cumsum(toxic) / max(1, toxic.sum())
    right[:-1][density[1:] == density[:-1]] = -1
    at = int(np.argmax(right))
    return float(max(1e-6, density[at:at + 2].mean()))


# -- scoring ----------------------------------------------------------------------

class _Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        # Keys as one character per UTF-8 byte, so that positions are bytes.
        for term, weight in lexicon.weights.items():
            self.automaton.add_word(key := term.encode().decode("latin-1"), (len(key), weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(key := phrase.encode().decode("latin-1"), (len(key), 0.0))
        self.automaton.make_automaton()

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Weight and words of every text."""
        pieces = [np.array([0x20], np.uint8)]
        pieces += [folded_bytes((t or "").encode()) for t in texts]
        ends = np.cumsum([len(p) for p in pieces])[1:]
        data = np.concatenate(pieces)
        # Runs of spaces would hide a phrase.
        space = data == 0x20
        keep = ~(space & np.append(False, space[:-1]))
        keep[ends - 1] = True
        data, ends = data[keep], np.cumsum(keep)[ends - 1]
        space = data == 0x20
        begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        words = np.diff(np.searchsorted(begins, np.append(0, ends)))
        total = np.zeros(len(texts))
        if len(self.lexicon.weights):
            found = [(end - n + 1, n, w) for end, (n, w) in self.automaton.iter(data.tobytes().decode("latin-1"))]
            if found:
                start, size, weight = (np.array(x) for x in zip(*found))
                start, size = start.astype(np.int64), size.astype(np.int64)
                shut = weight == 0.0
                order = np.lexsort((-size, start))
                order = order[~shut[order]]
                first = np.append(True, start[order][1:] != start[order][:-1])
                hits = order[first]  # the longest term at a word
                # A phrase over the end of a text is none.
                shut &= np.searchsorted(ends, start + 1, "right") == np.searchsorted(ends, start + size - 1, "right")
                if shut.any():
                    low, high = np.sort(start[shut]), np.sort((start + size)[shut])
                    inside = np.searchsorted(low, start[hits], "right") > np.searchsorted(high, start[hits] + 1, "right")
                    hits = hits[~inside]
                total = np.bincount(np.searchsorted(ends, start[hits] + 1, "right"), weight[hits], len(texts))[:len(texts)]
        return total, words


def _density(matcher: _Matcher, batch: pa.RecordBatch, column: int) -> np.ndarray:
    """Of every text of a column, of which a few are held as strings at a time."""
    sums = (matcher.sums(some.column(column).to_pylist()) for some in slices(batch, column, batch.num_rows, CHUNK_BYTES))
    parts = [(0.0 + s) / (n + matcher.lexicon.extra_words) for s, n in sums]
    return np.concatenate(parts) if parts else np.zeros(0)


def _densities(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    matcher = _Matcher(lexicon)
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array(_density(matcher, batch, 0)), batch.column(1)], ["density", "toxic"])


def _scored(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    matcher = _Matcher(lexicon)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        d = _density(matcher, batch, at)
        score = d / (d + lexicon.level * 7 / 3)
        yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(score)],
                                         [*(n for n in batch.schema.names if n != "text"), "score"])


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id and score, from 0 to 1; 0.3 at the lexicon's level.

    Null, empty and wordless texts score 0. One row per row of ``docs``, repeated ones
    too; doc_id may be null. Columns beside the two are not read.
    """
    only = docs.select("doc_id", "text")
    kind = only.schema["doc_id"].dataType.simpleString()
    return only.mapInArrow(partial(_scored, lexicon=lexicon), f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(lexicon)
        for batch in batches:
            d = _density(matcher, batch, batch.schema.get_field_index("text"))
            yield batch.filter(pa.array(d / (d + lexicon.level * 7 / 3) < threshold))
            give_back()

    return docs.mapInArrow(keep, docs.schema)
