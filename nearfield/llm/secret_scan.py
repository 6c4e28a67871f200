"""Secret scans: known forms, and sliding-window Shannon entropy for what has no form.

All of it is one narrow projection of native functions. A first pattern tells whether a text holds
anything to look at, so most texts are read once.

* Base kinds are patterns (``assign``, ``access``, ``hex``); matches that are too short are dropped
  after matching, since they use up their characters.
* Candidate strings are the maximal runs of a character class. A window slides over each; the counts
  of its characters and the sum of c log2 c over them change by the one character that enters and the
  one that leaves. Windows at or above the class's threshold are merged into a span. Sums are kept in
  millionths as longs, so the order of additions does not matter.
* The allow list suppresses candidates that are known to be harmless. It never touches base spans.

Places are code points, ends exclusive. Patterns give matches and the pieces between them; running
sums of their lengths give the places.

Defined results: a null text is empty. Rows are scanned one by one, repeated or not. A text of any
length is scanned whole. ``scan`` carries the row as a struct, so no column name can clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the base kinds, the group whose length counts and its least length; fixed values.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))
#: Finds out, in one pass, whether a text can hold a base match at all.
BASE_GATE = r"""AKIA[A-Z0-9]{14}|[0-9a-f]{16}|(?i:word|passwd|secret|token|key)["']?\x20*[:=]"""


class Class(NamedTuple):
    """Characters of a candidate string, the window, and the bits at which a window is a secret."""

    kind: str
    characters: str
    window: int
    bits: float


CLASSES = (
    Class("entropy_hex", "0-9A-Fa-f", 24, 3.2),
    Class("entropy_alnum", "0-9A-Za-z", 24, 3.95),
    Class("entropy_base64", "0-9A-Za-z+/=_-", 32, 4.25),
)
#: Finds out, in one pass, whether a text holds a candidate of any class.
DENSE_GATE = "[0-9A-Za-z+/=_-]{24}"
#: Candidates that are harmless: identifiers with a fixed form, digests that are meant to be public,
#: alphabets, placeholders.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$|^sha(1|256|384|512)-|"
    r"[Aa][Bb][Cc][Dd][Ee][Ff][Gg][Hh]|01234567|[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Xx]{8}|[Pp]laceholder"
)
SPAN = "array<struct<kind:string,start:int,end:int>>"
_STEP = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(numbers: Column) -> Column:
    """Sums up to each element, in steps so that a long array takes no quadratic time."""
    part = lambda i: F.floor(i / _STEP).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def of(a: Column) -> Column:
        parts = F.sequence(F.lit(0), part(F.size(a) - 1))
        sums = F.transform(parts, lambda b: total(F.slice(a, b * _STEP + 1, F.lit(_STEP))))
        before = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, F.lit(-1)) + x)))
        return let(before, lambda base: F.transform(a, lambda _, i: F.get(base, part(i)) + total(F.slice(a, part(i) * _STEP + 1, i % _STEP + 1))))

    return F.when(F.size(numbers) > 0, let(numbers, of)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<(start, end, part)> of the leftmost matches; ``part`` is the match or a group of it."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    lengths = F.zip_with(whole, F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda m, p: F.length(m) + F.length(p))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.arrays_zip(running(lengths).alias("end"), whole.alias("whole"), part.alias("part"))
    return F.transform(
        found,
        lambda m: F.struct((m["end"] - F.length(m["whole"])).alias("start"), m["end"].alias("end"), m["part"].alias("part")),
    )


def base_spans(text: Column) -> list[Column]:
    """The spans of each base kind, in the order of ``BASE``."""
    found = []
    for kind, pattern, group, least in BASE:
        long = F.filter(matches(text, pattern, group), lambda m: F.length(m["part"]) >= least)  # noqa: B023
        found.append(F.transform(long, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))))  # noqa: B023
    return found


def weights(window: int) -> list[int]:
    """c log2 c in millionths, for c up to the window's length."""
    return [0, *(round(c * math.log2(c) * 1e6) for c in range(1, window + 1))]


def limit(c: Class) -> int:
    """The largest sum of c log2 c at which a window's entropy reaches the class's bits."""
    return math.floor((math.log2(c.window) - c.bits) * c.window * 1e6)


def dense_runs(candidate: Column, c: Class) -> Column:
    """array<(start, end)> of the merged windows of a candidate that reach the class's bits.

    A fold over the characters. Its state: the counts by character, their sum of c log2 c, the span
    that is open and those that are closed.
    """
    table = F.array(*[F.lit(w).cast("long") for w in weights(c.window)])
    none = F.lit(-1)
    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"),
        F.lit(0).cast("long").alias("sum"),
        none.alias("low"),
        none.alias("high"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
    )
    with_count = lambda a, code, n: F.concat(F.slice(a, F.lit(1), code), F.array(n), F.slice(a, code + 2, 127 - code))

    def enter(state: Column, code: Column) -> Column:
        n = F.get(state["counts"], code)
        return F.struct(
            with_count(state["counts"], code, n + 1).alias("counts"),
            (state["sum"] + F.get(table, n + 1) - F.get(table, n)).alias("sum"),
        )

    def leave(state: Column, code: Column) -> Column:
        n = F.get(state["counts"], code)
        return F.struct(
            with_count(state["counts"], code, n - 1).alias("counts"),
            (state["sum"] - F.get(table, n) + F.get(table, n - 1)).alias("sum"),
        )

    def follow(state: Column, now: Column, end: Column) -> Column:
        """Opens, extends or closes a span by the window that ends before place ``end``."""
        begin = end - c.window
        dense = (begin >= 0) & (now["sum"] <= limit(c))
        joins = state["high"] >= begin
        closes = dense & ~joins & (state["high"] >= 0)
        closed = F.array(F.struct(state["low"].alias("start"), state["high"].alias("end")))
        return F.struct(
            now["counts"].alias("counts"),
            now["sum"].alias("sum"),
            F.when(dense & ~joins, begin).otherwise(state["low"]).alias("low"),
            F.when(dense, end).otherwise(state["high"]).alias("high"),
            F.when(closes, F.concat(state["spans"], closed)).otherwise(state["spans"]).alias("spans"),
        )

    def fold(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            kept = F.when(i >= c.window, leave(state, F.get(codes, i - c.window))).otherwise(
                F.struct(state["counts"].alias("counts"), state["sum"].alias("sum"))
            )
            return let(let(kept, lambda s: enter(s, F.get(codes, i))), lambda now: follow(state, now, i + 1))

        places = F.sequence(F.lit(0), F.size(codes) - 1)
        last = lambda s: F.when(
            s["high"] >= 0, F.concat(s["spans"], F.array(F.struct(s["low"].alias("start"), s["high"].alias("end"))))
        ).otherwise(s["spans"])
        return F.aggregate(places, start, step, last)

    return let(F.transform(F.split(candidate, ""), lambda x: F.ascii(x)), fold)


def added_spans(text: Column, c: Class, allow: str = ALLOW) -> Column:
    """The spans that entropy finds in the runs of a class's characters."""
    run = f"(?<![{c.characters}])[{c.characters}]{{{c.window},}}"
    candidates = F.filter(matches(text, run), lambda m: ~F.rlike(m["part"], F.lit(allow)))
    spans = F.transform(
        candidates,
        lambda m: F.transform(
            dense_runs(m["part"], c),
            lambda s: F.struct(F.lit(c.kind).alias("kind"), (m["start"] + s["start"]).alias("start"), (m["start"] + s["end"]).alias("end")),
        ),
    )
    return F.when(F.rlike(text, F.lit(run)), F.flatten(spans)).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, text: str = "text", allow: str = ALLOW) -> DataFrame:
    """(row, assign, access, hex, added): every row with the spans of the base kinds and the added ones."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    texts = docs.select(row, F.coalesce(F.col(text), F.lit("")).alias("t"))
    gated = texts.select("row", "t", F.rlike("t", F.lit(BASE_GATE)).alias("based"), F.rlike("t", F.lit(DENSE_GATE)).alias("dense"))
    none = F.array().cast(SPAN)
    base = [F.when(F.col("based"), s.cast(SPAN)).otherwise(none).alias(kind) for (kind, *_), s in zip(BASE, base_spans(F.col("t")))]
    added = F.concat(*[added_spans(F.col("t"), c, allow).cast(SPAN) for c in CLASSES])
    return gated.select("row", *base, F.when(F.col("dense"), added).otherwise(none).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, by start and then kind as listed, joined by commas."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate([*[b[0] for b in BASE], *[c.kind for c in CLASSES]]) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"], F.element_at(order, s["kind"]), s["end"], s["kind"].alias("kind")))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(keyed), text), ",")


def report(docs: DataFrame, allow: str = ALLOW) -> DataFrame:
    """(row, n_assign, n_access, n_hex, base_sha256, spans, n_added) of every row."""
    found = scan(docs, allow=allow)
    base = F.concat("assign", "access", "hex")
    return found.select(
        "row",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.concat(base, F.col("added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
