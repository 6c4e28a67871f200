"""Windows of fixed length that occur more than once in a corpus, without sorting every window.

What the two exact deduplication operators share. A text is a sequence of units (bytes, words) and
a window is ``length`` successive units. Every window is filed under its anchor: of the runs of
``gram`` units inside the window, the one whose hash is least. Equal windows have equal anchors at
the same place, and neighbouring windows mostly share theirs, so a text has one anchor per about
(length - gram) / 2 windows.

1. Anchors: per anchor the gram's hash, a hash of all units under its windows (the class) and the
   block of the text, summed per block.
2. Classes: a class that occurs again settles all its windows (``answers``). Where a gram has
   several classes, their windows may be equal in part; one text of each is asked for its units
   (``asks``).
3. The units asked for meet by gram, and the operator's own method tells which windows they share
   (``verdicts``). A gram with more than ``GROUP`` classes is not gathered: its windows are
   counted one by one, each by its own hash.
4. Every block of texts meets what concerns it and the windows are taken out.

Texts move once, by block; everything else that moves follows the number of anchors. A block is a
hash of the row, so neither sources nor copies pile up in one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import text_bytes
from nearfield.llm.hashing import BASE, INVERSE, joined, mixed, powers
from nearfield.session import staged

#: Bytes of text worked on at once; about a dozen arrays of eight times this size are held by a task.
SEGMENT = 1 << 18
BLOCK_BYTES = 4 << 20
GROUP = 2_000
PLACE = np.uint64((1 << 24) - 1)
NO_ID = 2**63 - 1  # sorts after every id that is there


class Anchors(NamedTuple):
    """Per anchor: windows ``low`` to ``high`` (inclusive), the gram's place, its hash, the class."""

    low: np.ndarray
    high: np.ndarray
    at: np.ndarray
    gram: np.ndarray
    kind: np.ndarray


class Method(NamedTuple):
    """What an operator brings: its units and how it compares the units of one gram."""

    length: int
    gram: int
    #: Bytes of a unit in a context.
    width: int
    #: (joined texts, their starts, their lengths) -> (unit values, first and last unit of each text)
    units: Callable[[bytes, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: Groups of members of one gram -> for each member the shared windows, as a boolean array.
    resolve: Callable[[list[list[Member]]], Iterator[tuple[Member, np.ndarray]]]
    #: Whether a window counts as repeated only in texts after the one with the smallest id.
    keep_first: bool


class Member(NamedTuple):
    block: int
    gram: int
    kind: int
    first: int  # smallest id of the class
    total: int  # occurrences of the class
    before: int  # units of the context before the anchor
    windows: int
    context: bytes


def anchors(x: np.ndarray, lows: np.ndarray, highs: np.ndarray, length: int, gram: int) -> Anchors:
    """Anchors of the windows inside the pieces [low, high) of ``x``."""
    count = len(x) - length + 1
    if count <= 0:
        return Anchors(*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint64)] * 2)
    change = np.zeros(count + 1, np.int32)
    long = highs - lows >= length
    np.add.at(change, lows[long], 1)
    np.add.at(change, highs[long] - length + 1, -1)
    valid = np.cumsum(change[:-1]) > 0
    parts = [_segment(x[k : k + SEGMENT + length - 1], valid[k : k + SEGMENT], length, gram, k) for k in range(0, count, SEGMENT)]
    return Anchors(*[np.concatenate(c) for c in zip(*parts)])


def _segment(x: np.ndarray, valid: np.ndarray, length: int, gram: int, base: int) -> Anchors:
    weighted, back = x * powers(BASE, len(x)), powers(INVERSE, len(x))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
    hashes = mixed((total[gram:] - total[:-gram]) * back[: len(x) - gram + 1])
    # Hash and place in one number: the least is the leftmost of the least.
    least = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    starts = np.flatnonzero(valid)
    found = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (found[1:] != found[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    low = starts[first]
    high = starts[np.append(first[1:], len(starts))[: len(first)] - 1] if len(first) else low
    at = (found[first] & PLACE).astype(np.int64)
    content = (total[high + length] - total[low]) * back[low]
    place = (at - low).astype(np.uint64) << np.uint64(32) | (high - low).astype(np.uint64)
    return Anchors(low + base, high + base, at + base, hashes[at], mixed(content ^ mixed(place)))


class Batch(NamedTuple):
    """Joined texts: their units, the range of units of each text, and their anchors by text."""

    first: int
    data: bytes
    starts: np.ndarray
    lengths: np.ndarray
    x: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    found: Anchors
    owner: np.ndarray


def batches_of(texts: list[bytes], method: Method) -> Iterator[Batch]:
    for first, data, starts in joined(texts, SEGMENT):
        lengths = np.append(starts[1:] - 1, len(data)) - starts
        x, lows, highs = method.units(data, starts, lengths)
        found = anchors(x, lows, highs, method.length, method.gram)
        if method.width == 1:
            # Long windows get a hash without any algebra that texts could be made to meet.
            view, ends = memoryview(data), found.high + method.length
            ranges = zip(found.low.tolist(), ends.tolist(), found.at.tolist())
            kinds = [xxhash.xxh3_64_intdigest(view[low:end], at - low) for low, end, at in ranges]
            found = found._replace(kind=np.array(kinds, np.uint64))
        owner = np.searchsorted(lows, found.low, side="right") - 1
        # Texts without units share their low with the next one; the last of them owns the windows.
        yield Batch(first, data, starts, lengths, x, lows, highs, found, owner)


def _encoded(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _rows(batches: Iterator[pa.RecordBatch], method: Method) -> Iterator[pa.RecordBatch]:
    """Classes of the anchors, summed over the texts of a batch that are in the same block."""
    for record in batches:
        block, ids = record["block"].to_numpy(), record["id"].to_numpy()
        for b in batches_of(_encoded(record["text"]), method):
            row = b.first + b.owner
            order = np.lexsort((block[row], b.found.kind, b.found.gram))
            columns = [a[order] for a in (b.found.gram, b.found.kind, block[row], ids[row])]
            new = np.ones(len(order), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
            at = np.flatnonzero(new)
            if len(at):
                n = np.diff(np.append(at, len(order)))
                values = [columns[0][at].view(np.int64), columns[1][at].view(np.int64), columns[2][at].astype(np.int32), n.astype(np.int32)]
                values.append(np.minimum.reduceat(columns[3], at))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["gram", "kind", "block", "n", "first"])


def blocked(docs: DataFrame, n: int) -> DataFrame:
    """Every row as the struct ``row`` with its id for comparison and its block."""
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    own = F.col("doc_id").cast("long")
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.coalesce(own, F.lit(NO_ID)).alias("id"),
        F.pmod(F.xxhash64(own, mark), F.lit(n)).cast("int").alias("block"),
    )


def classes(rows: DataFrame, method: Method) -> DataFrame:
    """The rows of repeated classes (``answer``) and of grams with several classes (``ask``)."""
    # One order serves both windows, so the rows are sorted once.
    ordered = Window.partitionBy("gram", "kind").orderBy("first", "block")
    by_class, by_gram = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.partitionBy("gram")
    counted = rows.repartition("gram").select(
        "gram", "kind", "block", "n",
        F.col("first").alias("own"),
        F.sum("n").over(by_class).alias("total"),
        F.min("first").over(by_class).alias("first"),
        F.row_number().over(ordered).alias("place"),
    )
    counted = counted.select(
        "*",
        (F.min("kind").over(by_gram) != F.max("kind").over(by_gram)).alias("several"),
        F.min("total").over(by_gram).alias("least"),
        F.sum((F.col("place") == 1).cast("int")).over(by_gram).alias("kinds"),
    )
    if method.keep_first:
        # Occurrences after the first text go; what is left open is the first text itself.
        answer = (F.col("total") > 1) & ((F.col("n") > 1) | (F.col("own") > F.col("first")))
        ask = F.col("several") & (F.col("own") == F.col("first"))
    else:
        answer = F.col("total") > 1
        ask = F.col("several") & (F.col("least") == 1) & (F.col("place") == 1)
    kept = counted.withColumn("answer", answer).withColumn("ask", ask).where("answer or ask")
    return kept.select("gram", "kind", "block", "first", "total", "kinds", "answer", "ask")


def _matching(kinds: np.ndarray, grams: np.ndarray, table: pa.Table) -> np.ndarray:
    """Row of ``table`` with each (gram, kind), or -1."""
    own = table["kind"].to_numpy()
    if not len(own) or not len(kinds):
        return np.full(len(kinds), -1, np.int64)
    order = np.argsort(own, kind="stable")
    place = np.minimum(np.searchsorted(own[order], kinds), len(own) - 1)
    row = order[place]
    same = (own[row] == kinds) & (table["gram"].to_numpy()[row] == grams)
    return np.where(same, row, -1)


MEMBER = "block int, gram bigint, kind bigint, first bigint, total bigint, kinds bigint, before int, windows int, context binary"


def _contexts(docs: pa.Table, asks: pa.Table, method: Method) -> pa.Table:
    """The units under the anchors asked for, one anchor of each class."""
    rows: list[dict] = []
    wanted = set(range(asks.num_rows))
    first, total, kinds = (asks[c].to_numpy() for c in ("first", "total", "kinds"))
    for b in batches_of(_encoded(_texts(docs)), method) if wanted else ():
        grams, kind = b.found.gram.view(np.int64), b.found.kind.view(np.int64)
        row = _matching(kind, grams, asks)
        for i in np.flatnonzero(row >= 0):
            r = int(row[i])
            if r not in wanted:
                continue
            wanted.discard(r)
            low, end = int(b.found.low[i]), int(b.found.high[i]) + method.length
            rows.append(
                {
                    "block": int(asks["block"][r].as_py()),
                    "gram": int(grams[i]),
                    "kind": int(kind[i]),
                    "first": int(first[r]),
                    "total": int(total[r]),
                    "kinds": int(kinds[r]),
                    "before": int(b.found.at[i]) - low,
                    "windows": int(b.found.high[i]) - low + 1,
                    "context": b.data[low:end] if method.width == 1 else b.x[low:end].tobytes(),
                }
            )
    types = [pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary()]
    names = MEMBER.replace(",", "").split()[::2]
    return pa.Table.from_pylist(rows, pa.schema(list(zip(names, types))))


def _texts(docs: pa.Table) -> pa.ChunkedArray:
    return pa.chunked_array([c.field("text") for c in docs["row"].chunks], pa.string()) if docs.num_rows else pa.chunked_array([[]], pa.string())


def _verdicts(batches: Iterator[pa.RecordBatch], method: Method) -> Iterator[pa.RecordBatch]:
    """Shared windows of the members, which come ordered by gram; groups go to the method in lots."""

    def decided(groups: list[list[Member]]) -> pa.RecordBatch:
        found = [(m, shared) for m, shared in method.resolve(groups) if shared.any()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([m.block for m, _ in found], pa.int32()),
                pa.array([m.gram for m, _ in found], pa.int64()),
                pa.array([m.kind for m, _ in found], pa.int64()),
                pa.array([np.flatnonzero(s).tolist() for _, s in found], pa.list_(pa.int32())),
            ],
            ["block", "gram", "kind", "shared"],
        )

    lot: list[list[Member]] = []
    group: list[Member] = []
    size = 0
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("block", "gram", "kind", "first", "total", "before", "windows", "context")]
        for values in zip(*columns):
            member = Member(*values)
            if group and group[0].gram != member.gram:
                lot.append(group)
                size += len(group)
                group = []
                if size >= GROUP:
                    yield decided(lot)
                    lot, size = [], 0
            group.append(member)
    yield decided([*lot, group] if group else lot)


def _windows(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Every window of the members, by a hash of its units."""
    for batch in batches:
        rows: list[tuple] = []
        for block, gram, kind, first, total, windows, context in zip(
            *[batch[c].to_pylist() for c in ("block", "gram", "kind", "first", "total", "windows", "context")]
        ):
            for k in range(windows):
                rows.append((xxhash.xxh3_128_digest(context[k * width : (k + length) * width]), block, gram, kind, first, total, k))
        columns = list(zip(*rows)) or [()] * 7
        types = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        names = ["w", "block", "gram", "kind", "first", "total", "k"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def verdicts(members: DataFrame, method: Method) -> DataFrame:
    """(block, gram, kind, shared): windows of a class that others share, by gathering each gram."""
    result = "block int, gram bigint, kind bigint, shared array<int>"
    by_gram = members.repartition("gram").sortWithinPartitions("gram")
    return by_gram.mapInArrow(functools.partial(_verdicts, method=method), result)


def counted_verdicts(members: DataFrame, method: Method) -> DataFrame:
    """The same by counting every window by itself, for grams of any number of classes."""
    single = members.mapInArrow(
        functools.partial(_windows, length=method.length, width=method.width),
        "w binary, block int, gram bigint, kind bigint, first bigint, total bigint, k int",
    )
    counts = single.groupBy("w").agg(F.sum("total").alias("all"), F.min("first").alias("least"))
    shared = F.col("first") > F.col("least") if method.keep_first else F.col("all") > 1
    hit = single.join(counts, "w").where(shared)
    return hit.groupBy("block", "gram", "kind").agg(F.sort_array(F.collect_set("k")).alias("shared"))


def covered(b: Batch, ids: np.ndarray, settled: pa.Table, partly: pa.Table, method: Method) -> np.ndarray:
    """Which units of a batch lie in a window that goes."""
    grams, kinds = b.found.gram.view(np.int64), b.found.kind.view(np.int64)
    change = np.zeros(len(b.x) + 1, np.int32)
    row = _matching(kinds, grams, settled)
    goes = row >= 0
    if method.keep_first and len(row) and settled.num_rows:
        goes &= ids[b.first + b.owner] > settled["first"].to_numpy()[np.maximum(row, 0)]
    np.add.at(change, b.found.low[goes], 1)
    np.add.at(change, b.found.high[goes] + method.length, -1)
    row = _matching(kinds, grams, partly)
    for i in np.flatnonzero((row >= 0) & ~goes):
        starts = b.found.low[i] + np.array(partly["shared"][int(row[i])].as_py())
        np.add.at(change, starts, 1)
        np.add.at(change, starts + method.length, -1)
    return np.cumsum(change[:-1]) > 0


def without_repeats(
    docs: DataFrame, method: Method, finish: Callable[[Batch, np.ndarray, int], list], fields: str, types: list[pa.DataType]
) -> DataFrame:
    """Rows of ``docs`` as the struct ``row`` with the columns that ``finish`` makes of each text.

    ``finish`` gets a batch, its covered units and the number of a text in it.
    """
    n = -(-text_bytes(docs) // BLOCK_BYTES) or 1
    rows = blocked(docs, n)
    texts = rows.select("block", "id", F.col("row.text").alias("text"))
    counted = texts.mapInArrow(functools.partial(_rows, method=method), "gram bigint, kind bigint, block int, n int, first bigint")
    found = staged(classes(counted, method), "classes")
    asks = found.where("ask").select("gram", "kind", "block", "first", "total", "kinds")
    by_block = rows.groupBy("block")
    members = lambda asked: by_block.cogroup(asked.groupBy("block")).applyInArrow(
        functools.partial(_contexts, method=method), MEMBER
    )
    crowded = asks.where(F.col("kinds") > GROUP)
    partly = verdicts(members(asks.where(F.col("kinds") <= GROUP)), method)
    if not crowded.isEmpty():
        partly = partly.unionByName(counted_verdicts(members(crowded), method))
    none = F.lit(None)
    told = found.where("answer").select("gram", "kind", "block", "first", none.cast("array<int>").alias("shared"))
    told = told.unionByName(partly.select("gram", "kind", "block", none.cast("bigint").alias("first"), "shared"))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        is_part = pc.is_valid(right["shared"])
        settled, some = right.filter(pc.invert(is_part)), right.filter(is_part)
        ids = left["id"].to_numpy()
        values: list[list] = [[] for _ in types]
        for b in batches_of(_encoded(_texts(left)), method):
            gone = covered(b, ids, settled, some, method)
            for k in range(len(b.lows)):
                for column, value in zip(values, finish(b, gone, k)):
                    column.append(value)
        names = [f.split()[0] for f in fields.split(", ")]
        return pa.table([left["row"], *[pa.array(v, t) for v, t in zip(values, types)]], names=["row", *names])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, {fields}"
    return by_block.cogroup(told.groupBy("block")).applyInArrow(apply, schema)
