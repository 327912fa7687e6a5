"""Secrets in texts: known forms, and tokens that no test can tell from random ones.

Every long token is tested for randomness in the alphabet of its likely encoding: a
chi-squared test of uniform characters, a runs test around the middle of the alphabet
and the serial correlation of neighbours. Fisher's method combines the three. A token is a
run of the characters of all encodings; as keys stand in paths and names too, its parts
between slashes and pluses, and between hyphens and underscores, are tested as well. They
count where the whole does not. Tokens and parts of fewer than 20 characters are not tested.

Words and names fail these tests, the more clearly the longer they are. So thresholds
are set for each encoding and length class over the whole corpus: p-values of random
tokens are uniform, which tells how many there are from the upper half, and the
threshold is the lowest at which the others are at most a share ``fdr`` of the tokens
that are kept. A class of few tokens does not show that; there the threshold is fixed
unless a binomial test speaks against it.

All of it is built-in functions; a text is read once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.spans import block_columns, match_columns, prefix_columns, step_columns
from tillwise.plans.durable import written_once

# The forms asked for, in order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Characters and least length of a token that is tested.
TOKEN = "[A-Za-z0-9+/_-]{20,}"
#: Parts of longer runs: between slashes and pluses, and between hyphens and underscores.
PARTS = {"segment": ("A-Za-z0-9_-", "+/"), "plain": ("A-Za-z0-9+/", "_-")}
PARTS = {name: f"(?<=[{out}])[{of}]{{20,}}+|(?<![{of}])[{of}]{{20,}}+(?=[{out}])" for name, (of, out) in PARTS.items()}
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "upper_hex": _DIGITS + "ABCDEF", "base32": _LOWER.upper() + "234567",
    "alphanumeric": _DIGITS + _LOWER.upper() + _LOWER, "base64": _DIGITS + _LOWER.upper() + _LOWER + "+/",
    "base64url": _DIGITS + _LOWER.upper() + _LOWER + "-_", "mixed": _DIGITS + _LOWER.upper() + _LOWER + "+/-_",
}
_FORMS = {"hex": "^[0-9a-f]+$", "upper_hex": "^[0-9A-F]+$", "base32": "^[A-Z2-7]+$", "alphanumeric": "^[A-Za-z0-9]+$",
          "base64": "^[A-Za-z0-9+/]+$", "base64url": "^[A-Za-z0-9_-]+$", "mixed": "^[A-Za-z0-9+/_-]+$"}
_BINS = 200
#: The fixed threshold of classes with too few tokens to estimate one, which loses one
#: random token in twenty; and how unlikely an excess has to be by chance to count as one.
LEAST, DOUBT = 0.05, 0.05


def _tail(z: Column) -> Column:
    """The probability that a standard normal number exceeds |z| in size.

    Fixed values: the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def _randomness(token: Column, alphabet: str) -> Column:
    """Fisher's combined p-value of the three tests, small for tokens that are not random."""
    k, n = len(alphabet), F.length(token).cast("double")
    letters = F.array(*[F.lit(c) for c in alphabet])
    squares = F.aggregate(F.transform(letters, lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double")),
                          F.lit(0.0), lambda a, b: a + b * b)
    chi = squares * k / n - n
    # Wilson and Hilferty: the cube root of chi-squared is close to normal.
    h = 2 / (9 * (k - 1))
    # Far too even is as suspicious as far too uneven, but not for a token shorter than its alphabet.
    uniform = (F.cbrt(F.greatest(chi, F.lit(0.0)) / (k - 1)) - (1 - h)) / math.sqrt(h)
    p_uniform = F.when(uniform > 0, _tail(uniform) / 2).otherwise(1 - _tail(uniform) / 2)

    sides = F.translate(token, alphabet, "0" * (k // 2) + "1" * (k - k // 2))
    ones = (F.length(sides) - F.length(F.replace(sides, F.lit("1"), F.lit("")))).cast("double")
    zeros = n - ones
    runs = F.regexp_count(sides, F.lit("01")) + F.regexp_count(sides, F.lit("10")) + 1
    mean = 2 * ones * zeros / n + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    p_runs = F.when((ones == 0) | (zeros == 0), F.pow(F.lit(2.0), 1 - n)).otherwise(_tail((runs - mean) / spread))

    values = F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(alphabet), c).cast("double"))
    middle = (k + 1) / 2

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    square = total(F.transform(values, lambda v: (v - middle) * (v - middle)))
    neighbours = total(F.zip_with(F.slice(values, 1, F.length(token) - 1), F.slice(values, 2, F.length(token) - 1),
                                  lambda a, b: (a - middle) * (b - middle)))
    p_serial = _tail(neighbours / F.greatest(square, F.lit(1e-9)) * F.sqrt(n))
    half = -(F.log(p_uniform) + F.log(p_runs) + F.log(p_serial))
    return F.exp(-half) * (1 + half + half * half / 2)


def _tested(tokens: Column) -> Column:
    """encoding, length class (twice the logarithm) and p-value of every token."""
    def test(token: Column) -> Column:
        chosen = F.lit(None).cast("struct<encoding:string,size:int,p:double>")
        size = F.floor(2 * F.log2(F.length(token))).cast("int")
        for name in reversed(ALPHABETS):
            p = _randomness(token, ALPHABETS[name])
            chosen = F.when(token.rlike(_FORMS[name]), F.struct(F.lit(name).alias("encoding"), size.alias("size"), p.alias("p"))
                            ).otherwise(chosen)
        return chosen

    return F.transform(tokens, test)


def _chance(most: int, n: int, share: float) -> float:
    """The probability of at most ``most`` hits in ``n`` draws."""
    if share >= 1:
        return float(most >= n)
    if n > 500:  # the normal approximation, with the usual half
        return math.erfc((n * share - most - 0.5) / math.sqrt(2 * n * share * (1 - share))) / 2
    term = total = (1 - share) ** n
    for i in range(1, most + 1):
        term *= (n - i + 1) / i * share / (1 - share)
        total += term
    return total


def thresholds(tested: DataFrame, fdr: float) -> list[tuple[str, int, float]]:
    """(encoding, size, p) -> encoding, length class and the least p-value, in steps of
    1/200 up to a half, from which tokens count as random: the least at which the excess
    over uniform p-values is at most ``fdr``, or, from ``LEAST`` on, at which a binomial
    test sees no excess at all. Few tokens show none, so for them it is ``LEAST``."""
    step = F.least(F.floor(F.col("p") * _BINS), F.lit(_BINS - 1)).cast("int")
    # A few hundred rows for each of a few dozen encodings and length classes.
    counts = defaultdict(lambda: [0] * _BINS)
    for row in tested.groupBy("encoding", "size", step.alias("step")).agg(F.count("*").alias("n")).collect():
        counts[row["encoding"], row["size"]][row["step"]] = row["n"]
    found = []
    for (encoding, size), n in counts.items():
        upper = sum(n[_BINS // 2:])
        for at in range(1, _BINS // 2 + 1):
            level, kept = at / _BINS, sum(n[at:])
            excess = kept - 2 * upper * (1 - level)
            if excess <= fdr * kept or level >= LEAST and _chance(upper, kept, 0.5 / (1 - level)) >= DOUBT:
                found.append((encoding, size, level))
                break
    return found


def _labelled(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank).alias("rank")))


def _without_touching(spans: Column, rank: int, touches: Callable[[Column, Column], Column]) -> Column:
    """Those of the rank stay only if they touch none of an earlier one."""
    earlier = F.filter(spans, lambda y: y["rank"] < rank)
    return F.filter(spans, lambda x: (x["rank"] != rank) | ~touches(x, earlier))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per document: doc_id, n_assign, n_access, n_hex,
    n_random, base (spans of the known forms), all_spans (and the random tokens that touch
    none of those); spans are (start, kind, end), kind the place in ``KINDS``.

    Null and empty texts have no spans. Repeated rows are searched each. Where no
    token of a class has a p-value in the upper half, up to four of the others may be kept.
    Columns beside doc_id and text are not read.
    """
    text = F.col("text")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tokens = {"token": TOKEN, **PARTS}
    names = ("assign", "access", "hex", *tokens)
    steps = docs.select(
        "doc_id", *[c.alias(n) for n, c in {
            **match_columns("assign", text, ASSIGN, (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN), 2),
            **match_columns("access", text, ACCESS, F.contains(text, F.lit("AKIA"))),
            **match_columns("hex", text, HEX, text.rlike(HEX)),
            **{k: v for n, p in tokens.items() for k, v in match_columns(n, text, p, text.rlike(p)).items()},
        }.items()],
        *[F.when(text.rlike(p), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"{n}_text")
          for n, p in tokens.items()])
    for make in (step_columns, block_columns, prefix_columns):
        steps = steps.withColumns({k: v for n in names for k, v in make(n).items()})
    long_enough = F.filter(F.zip_with(F.col("assign_at"), F.col("assign_g"), lambda a, g: F.struct(
        a["start"].alias("start"), a["end"].alias("end"), g.alias("size"))), lambda x: x["size"] >= 6)
    full = F.filter(F.col("access_at"), lambda x: x["end"] - x["start"] >= 20)
    base = F.concat(_labelled(long_enough, 0), _labelled(full, 1), _labelled(F.col("hex_at"), 2))
    found = written_once(steps.select(
        "doc_id", base.alias("base"),
        F.zip_with(F.concat(*[_ranked(F.col(f"{n}_at"), i) for i, n in enumerate(tokens)]),
                   _tested(F.concat(*[F.col(f"{n}_text") for n in tokens])), lambda a, t: F.struct(
            a["start"].alias("start"), a["end"].alias("end"), a["rank"].alias("rank"), t["encoding"].alias("encoding"),
            t["size"].alias("size"), t["p"].alias("p"))).alias("tested")), "secrets")

    levels = thresholds(found.select(F.explode("tested").alias("x")).select("x.*"), fdr)
    needed = F.create_map(*[F.lit(x) for encoding, size, level in levels for x in (f"{encoding}:{size}", level)]) if levels else \
        F.create_map().cast("map<string,double>")
    touches = lambda x, spans: F.exists(spans, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    random = F.filter(F.col("tested"), lambda x: (
        x["p"] >= F.try_element_at(needed, F.concat_ws(":", x["encoding"], x["size"].cast("string")))) & ~touches(x, F.col("base")))
    found = found.select("doc_id", "base", random.alias("random"))
    for i in range(1, len(tokens)):  # wholes first, then parts of the others
        found = found.withColumn("random", _without_touching(F.col("random"), i, touches))
    count = lambda kind: F.size(F.filter(F.col("all_spans"), lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return found.select("doc_id", "base", F.concat("base", _labelled(F.col("random"), 3)).alias("all_spans")).select(
        "doc_id", *[count(k) for k in range(4)], "base", "all_spans")
