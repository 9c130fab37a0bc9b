"""Secrets in texts: three plain patterns, and strings that look random.

Native Spark expressions alone: a map over the texts, no shuffle, no Python.

* Base spans come from the patterns of ``BASE`` (leftmost, not overlapping per
  kind; matches that fail the length rule are dropped without another try).
* Candidates are the runs of at least ``WINDOW`` characters of ``ALPHABET``. A
  window of that many characters slides over each one: its character counts
  change by one that enters and one that leaves, and with them the Shannon entropy
  and the numbers of characters of each class. A window counts when it holds
  letters and digits and its entropy reaches the bound of its class (``LEAST_BITS``):
  hexadecimal, letters of one case, or anything else.
* The allow-list suppresses candidates: ``ALLOWED`` patterns (placeholders, keyboard
  and alphabet rows, UUIDs, published digests), words and numbers that are only
  joined by signs, and the strings that the caller names. So do base spans that
  a candidate overlaps; these stay as they are.

Results: offsets are code points, ends exclusive. Null and empty texts have
no spans. Every row of the table gives one row, repeated rows too; an empty table
gives none. Other columns of the table take no part, whatever their names.
A running value over the spans of a text is computed in blocks, so a very
long text with n spans costs some n * 256 steps, not n * n.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import texts

KINDS = ("assign", "access", "hex", "entropy")  # fixed order; the last is added by the method
# Fixed values of the base rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same as runs of one character or more that have 20 in all
HEX = r"[0-9a-f]{24,}"  # the same as all runs, less those below 24

WINDOW = 20
_DIGITS, _HEX_LOW, _LOW, _HEX_UP, _UP, _SIGNS = "0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_=-"
ALPHABET = _DIGITS + _HEX_LOW + _LOW + _HEX_UP + _UP + _SIGNS
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
LEAST_BITS = {"hex": 3.0, "one_case": 3.5, "mixed": 3.75}
LEAST_EACH = 2  # digits, and letters, of a window
# What looks random and is no secret.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]?(?:api[_-]?)?(?:key|token|secret|password)|xxxx",
    r"(?i)0123456789|1234567890|abcdefghij|qwertyuiop|zyxwvutsrq",
    r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"^[A-Z]{2}[0-9]{13,32}$",  # account numbers: a country's letters and digits
    r"(?i)^(?:sha(?:1|256|384|512)|md5)[-_=]",
)
MIXED = r"[A-Za-z][0-9]|[0-9][A-Za-z]"  # words and numbers joined by signs never have this

_BLOCK = 256
_CLOG = [c * math.log2(c) if c else 0.0 for c in range(WINDOW + 2)]


def running(values: Column, zero: int, merge: Callable[[Column, Column], Column]) -> Column:
    """The running sum (or maximum) of an array of longs, by blocks: running
    values inside each block, and of the blocks' totals."""
    first = F.lit(zero).cast("long")
    nothing = F.array().cast("array<long>")

    def within(a: Column) -> Column:
        start = F.struct(first.alias("at"), nothing.alias("out"))
        step = lambda s, v: F.struct(merge(s["at"], v).alias("at"), F.concat(s["out"], F.array(merge(s["at"], v))).alias("out"))
        return F.aggregate(a, start, step, lambda s: s["out"])

    last = F.greatest(F.ceil(F.size(values) / _BLOCK).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
    before = within(F.transform(blocks, lambda b: F.aggregate(b, first, merge)))
    shifted = F.slice(F.concat(F.array(first), before), 1, F.size(before))
    return F.flatten(F.zip_with(F.transform(blocks, within), shifted, lambda b, c: F.transform(b, lambda v: merge(v, c))))


_add = lambda a, b: a + b
_most = lambda a, b: F.greatest(a, b)


def _located(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """``df`` with ``name``: an array of (start, end, value) of the matches of a
    pattern in ``text``. The text is cut at the matches, and lengths added up."""
    found, ends = f"__{name}_found", f"__{name}_ends"
    df = df.withColumn(found, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    parts = F.split("text", pattern, -1)
    steps = F.zip_with(F.slice(parts, 1, F.size(found)), F.col(found), lambda p, v: (F.char_length(p) + F.char_length(v)).cast("long"))
    df = df.withColumn(ends, F.when(F.size(found) > 0, steps))
    df = df.withColumn(ends, F.when(F.col(ends).isNotNull(), running(F.col(ends), 0, _add)))
    spans = F.zip_with(ends, found, lambda e, v: F.struct((e - F.char_length(v)).alias("start"), e.alias("end"), v.alias("value")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return df.withColumn(name, F.coalesce(spans, empty)).drop(found, ends)


def looks_random(value: Column) -> Column:
    """Whether a window of ``WINDOW`` characters of a string over ``ALPHABET``
    reaches the entropy of its class."""
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    # (the codes of the characters), kept as an element so that they are computed once
    codes = F.array(F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c)))
    n_digit, n_hex, n_low = len(_DIGITS), len(_DIGITS + _HEX_LOW), len(_DIGITS + _HEX_LOW + _LOW)
    n_uphex, n_up = n_low + len(_HEX_UP), n_low + len(_HEX_UP + _UP)
    clog = F.array(*[F.lit(x) for x in _CLOG])
    log = lambda c: F.element_at(clog, c + 1)
    one = lambda c: F.when(c, 1).otherwise(0)
    classes = {  # numbers of characters of the window; code 0 is no character
        "digits": lambda x: x.between(1, n_digit),
        "low_hex": lambda x: x.between(n_digit + 1, n_hex),
        "low": lambda x: x.between(n_hex + 1, n_low),
        "up_hex": lambda x: x.between(n_low + 1, n_uphex),
        "up": lambda x: x.between(n_uphex + 1, n_up),
    }

    def slide(code: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            new = F.element_at(code, i)
            old = F.when(i > WINDOW, F.element_at(code, F.greatest(i - WINDOW, F.lit(1)))).otherwise(0)
            had = F.element_at(s["counts"], new)
            left = F.element_at(s["counts"], F.greatest(old, F.lit(1))) + one(old == new)
            change = log(had + 1) - log(had) + F.when(old > 0, log(left - 1) - log(left)).otherwise(0.0)
            numbers = {k: s[k] + one(is_(new)) - one(is_(old)) for k, is_ in classes.items()}
            counts = F.transform(s["counts"], lambda c, j: c + one(j + 1 == new) - one(j + 1 == old))
            digits, low, up = numbers["digits"], numbers["low_hex"] + numbers["low"], numbers["up_hex"] + numbers["up"]
            bound = (F.when((digits + numbers["low_hex"] == WINDOW) | (digits + numbers["up_hex"] == WINDOW), LEAST_BITS["hex"])
                     .when((digits + low == WINDOW) | (digits + up == WINDOW), LEAST_BITS["one_case"]).otherwise(LEAST_BITS["mixed"]))
            clogs = s["clogs"] + change
            hit = (i >= WINDOW) & (digits >= LEAST_EACH) & (low + up >= LEAST_EACH) & (math.log2(WINDOW) - clogs / WINDOW >= bound - 1e-9)
            return F.struct(counts.alias("counts"), clogs.alias("clogs"), *[v.alias(k) for k, v in numbers.items()], (s["hit"] | hit).alias("hit"))

        start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("clogs"),
                         *[F.lit(0).alias(k) for k in classes], F.lit(False).alias("hit"))
        return F.aggregate(F.sequence(F.lit(1), F.size(code)), start, step, lambda s: s["hit"])

    return F.element_at(F.transform(codes, slide), 1)


def find_secrets(docs: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, and ``base`` and ``spans``: arrays of (start, kind, end),
    sorted, kind being the place in ``KINDS``. ``allowed``: strings that are no
    secrets when they make up a whole candidate."""
    d = texts(docs)
    for name, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True):
        d = _located(d, name, pattern)
    span = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"))
    d = d.withColumn("assign", F.filter("assign", lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST))

    def suspicious(s: Column) -> Column:
        v = s["value"]
        harmless = [v.rlike(p) for p in (*ALLOWED, ACCESS, HEX)]  # runs of the last two lie in one candidate
        keep = v.rlike(MIXED)
        for h in harmless:
            keep = keep & ~h
        if allowed:
            keep = keep & ~v.isin(*allowed)
        return keep

    d = d.withColumn("entropy", F.filter("entropy", suspicious))
    d = d.withColumn("entropy", F.filter("entropy", lambda s: looks_random(s["value"])))
    # candidates and assignments by start; which candidates begin before an assignment's end, or end behind the start of one
    both = F.sort_array(F.concat(F.transform("assign", span(0)), F.transform("entropy", span(3))))
    d = d.withColumn("__both", F.when(F.size("entropy") > 0, both).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    far = F.lit(-(1 << 62)).cast("long")
    ends = F.transform("__both", lambda s: F.when(s["kind"] == 0, s["end"]).otherwise(far))
    starts = F.transform(F.reverse("__both"), lambda s: F.when(s["kind"] == 0, -s["start"]).otherwise(far))
    d = d.withColumn("__reach", running(ends, -(1 << 62), _most)).withColumn("__next", F.reverse(running(starts, -(1 << 62), _most)))
    d = d.withColumn("__both", F.arrays_zip(F.col("__both").alias("s"), F.col("__reach").alias("reach"), F.col("__next").alias("next")))
    free = F.filter("__both", lambda x: (x["s"]["kind"] == 3) & (x["reach"] <= x["s"]["start"]) & (-x["next"] >= x["s"]["end"]))
    base = F.sort_array(F.concat(*[F.transform(n, span(k)) for k, n in enumerate(KINDS[:3])]))
    d = d.withColumn("base", base).withColumn("added", F.transform(free, lambda x: x["s"]))
    return d.select("doc_id", "text", "base", F.sort_array(F.concat("base", "added")).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
