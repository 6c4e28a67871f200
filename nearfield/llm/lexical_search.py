"""Ranked lexical search: item bundles travel through the owners of their terms.

1. One pass over the documents lays them into slices of at most ``SLICE`` rows, inside each task, and
   inverts every slice: a row per (slice, term) with the places, frequencies and lengths. Only terms
   of the items are kept, as long as their vocabulary is small enough to hand to the tasks.
2. Document frequencies give each term a weight and an owner: owners hold the terms of one band of
   document frequency, rarest first.
3. Items are numbered and bundled. A bundle visits the owners in turn: its sparse accumulators for a
   slice (item, document, score so far) meet the owner's postings of that slice by a cogroup on
   (bundle, slice), which adds integers and hands the accumulators on. So no term is ever gathered
   in one place, however many documents hold it.
4. After the last owner each slice gives its best per item, and the best of all slices are ranked.

Between owners the scores so far give each item a floor: at least ``k`` documents have reached it. An
accumulator that can't reach the floor with everything the later owners may add is left behind; the
bound is exact (the term's weight times the largest share that any of its postings can give), so
results are those of adding everything up.

Items are worked on in lots of about ``LOT``; what the driver holds is two numbers per item of a lot.

Defined results: a null text has no terms. Documents are rows: repeated rows are ranked each for
itself, a null id after the others of its score. Rows of one item id and text are one item; an id with
several texts is ranked once per text. Items without a matching document give no rows, as do empty
tables. Extra columns are not read.
"""

from __future__ import annotations

import functools
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import arrow_rows, guarded_join
from nearfield.session import staged

TOP = 50
#: Documents of a slice, and postings after which a slice is closed early.
SLICE, SLICE_POSTINGS = 4_096, 1 << 20
BUNDLE, LOT = 64, 4_096
#: Largest vocabulary that is handed to the tasks; beyond it, postings of other terms go in the join.
VOCABULARY, VOCABULARY_BYTES = 200_000, 4 << 20
#: Owners take terms up to these shares of the documents, rarest first.
OWNERS = (1 / 512, 1 / 64, 1 / 12, 1.0)
#: Bytes of a text that are split at once.
STEP = 1 << 20
#: Items times documents of a slice scored at once.
ROWS = 500

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time: runs of letters, digits and all beyond ASCII."""
    at = 0
    while at < len(text):
        end = at + STEP
        if end < len(text):
            # Never inside a term: up to the next byte that folds to a space.
            while end < len(text) and _FOLD[text[end]] != 32:
                end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


POSTINGS = "slice bigint, term binary, pos array<int>, tf array<int>, n array<bigint>, ids array<bigint>"
_TYPES = {
    "slice": pa.int64(),
    "term": pa.binary(),
    "pos": pa.list_(pa.int32()),
    "tf": pa.list_(pa.int32()),
    "n": pa.list_(pa.int64()),
    "ids": pa.list_(pa.int64()),
}


class _Slice:
    """Documents gathered by a task, inverted."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.n: list[int] = []
        self.found: dict[bytes, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        self.postings = 0

    def add(self, doc_id: int | None, text: bytes, vocabulary: frozenset | None) -> None:
        place, n, counts = len(self.ids), 0, Counter()
        for part in terms(text):
            n += len(part)
            counts.update(part)
        for term in counts.keys() if vocabulary is None else counts.keys() & vocabulary:
            pos, tf = self.found[term]
            pos.append(place)
            tf.append(counts[term])
            self.postings += 1
        self.ids.append(doc_id)
        self.n.append(n)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """The slice's own row (ids and lengths, in the order of the ids), then a row per term."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        n = np.array(self.n, np.int64)
        made = [(number, None, [], [], n[order], [self.ids[i] for i in order])]
        for term, (pos, tf) in self.found.items():
            made.append((number, term, place[pos], tf, n[pos], []))
            if len(made) >= ROWS:
                yield _batch(made)
                made = []
        yield _batch(made)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES.values())], list(_TYPES))


def _invert(batches: Iterator[pa.RecordBatch], vocabulary: frozenset | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, held = TaskContext.get().partitionId() << 32, _Slice()
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
            held.add(doc_id, text or b"", vocabulary)
            if len(held.ids) >= SLICE or held.postings >= SLICE_POSTINGS:
                yield from held.rows(number)
                number, held = number + 1, _Slice()
    if held.ids:
        yield from held.rows(number)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lot, item, text in zip(*(batch[c].to_pylist() for c in ("lot", "item", "text"))):
            own = {t for part in terms((text or "").encode()) for t in part}
            for some in _cut(sorted(own), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lot] * len(some), pa.int32()), pa.array([item] * len(some), pa.int32()), pa.array(some, pa.binary())],
                    ["lot", "item", "term"],
                )


def _cut(values: list, n: int) -> Iterator[list]:
    for i in range(0, len(values), n):
        yield values[i : i + n]


def numbered(items: DataFrame, lot: int = LOT) -> tuple[DataFrame, int]:
    """(lot, item, item_id, text): distinct items, numbered from 0 inside lots of about ``lot``; the number of lots."""
    distinct = staged(items.select("item_id", "text").where(F.col("text").isNotNull()).distinct(), "items")
    lots = -(-distinct.count() // lot) or 1
    dealt = distinct.withColumn("lot", F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)).cast("int"))
    order = Window.partitionBy("lot").orderBy("item_id", "text")
    return staged(dealt.withColumn("item", (F.row_number().over(order) - 1).cast("int")), "numbered"), lots


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Slices and their postings; ``vocabulary`` (term) is handed to the tasks if it is small."""
    size = vocabulary.agg(F.count("term").alias("rows"), F.sum(F.length("term")).alias("bytes")).first()
    small = size["rows"] <= VOCABULARY and (size["bytes"] or 0) <= VOCABULARY_BYTES
    known = frozenset(bytes(r["term"]) for r in vocabulary.collect()) if small else None
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return columns.mapInArrow(functools.partial(_invert, vocabulary=known), POSTINGS)


def weighted(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(term, w, most, owner): weight, the most that a posting can add, and the owner of each term."""
    per = found.groupBy("term").agg(
        F.sum(F.size("pos")).alias("df"), F.max(F.array_max("tf")).cast("long").alias("tf"), F.min(F.array_min("n")).alias("n")
    )
    w = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    m = 50 + F.floor(50 * F.col("n").cast("decimal(38,0)") * n_docs / n_terms).cast("long")
    # The share rises with tf and falls with m; one more covers the rounding of m's division.
    share = F.floor(1e9 * F.col("tf") / (1000.0 * F.col("tf") + 20.0 * (m - 1))).cast("long") + 1
    owner = functools.reduce(lambda o, s: o.when(F.col("df") <= s[1] * n_docs, s[0]), enumerate(OWNERS[:-1]), F)
    return per.select("term", w.alias("w"), (w * share).alias("most"), owner.otherwise(len(OWNERS) - 1).alias("owner"))


def shares(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 20 m) of postings, in longs."""
    if 50 * int(n.max(initial=0)) * n_docs >= 2**63:
        m = np.array([50 + 50 * int(x) * n_docs // n_terms for x in n.tolist()], np.int64)
    else:
        m = 50 + 50 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1_000 * tf + 20 * m)


ACCUMULATORS = "bundle int, slice bigint, item array<int>, doc array<int>, score array<bigint>, top_item array<int>, top_score array<bigint>"


def visit(
    key: tuple, left: pa.Table, right: pa.Table, floors: np.ndarray, rests: np.ndarray, n_docs: int, n_terms: int, k: int, sent: int, last: bool
) -> pa.Table:
    """One bundle at one owner, for one slice: accumulators in, accumulators out.

    ``floors`` and ``rests`` hold, per item, the score that ``k`` documents are known to reach and
    the most that the later owners can add. After the last owner only the ``k`` best stay.
    """
    bundle, number = (x.as_py() if isinstance(x, pa.Scalar) else x for x in key)
    base = bundle * BUNDLE
    height = min(BUNDLE, len(floors) - base)
    of = lambda table, name: table[name].combine_chunks().flatten().to_numpy()
    known = of(left, "doc") if left.num_rows else np.zeros(0, np.int32)
    pos = right["pos"].combine_chunks() if right.num_rows else None
    seen = pos.flatten().to_numpy() if right.num_rows else np.zeros(0, np.int32)
    width = int(max(known.max(initial=-1), seen.max(initial=-1))) + 1
    score = np.zeros((height, width), np.int64)
    if left.num_rows:
        score[of(left, "item") - base, known] = of(left, "score")
    if right.num_rows:
        ends = np.concatenate([[0], np.cumsum(np.diff(pos.offsets.to_numpy()))])
        part = shares(of(right, "tf").astype(np.int64), of(right, "n"), n_docs, n_terms)
        for i, (w, items) in enumerate(zip(right["w"].to_pylist(), right["items"].to_pylist())):
            places = seen[ends[i] : ends[i + 1]]
            score[np.array(items)[:, None] - base, places] += w * part[ends[i] : ends[i + 1]]
    out: tuple[list, ...] = ([], [], [])
    tops: tuple[list, ...] = ([], [])
    for i in range(height):
        row = score[i]
        docs = np.flatnonzero(row)
        floor = int(floors[base + i])
        if len(docs) > k:
            floor = max(floor, int(np.partition(row[docs], -k)[-k]))
        docs = docs[row[docs] + rests[base + i] >= floor]
        if last and len(docs) > k:
            docs = docs[np.argsort(-row[docs], kind="stable")[:k]]
        best = np.sort(row[docs])[::-1][:sent]
        for column, values in zip((*out, *tops), (np.full(len(docs), base + i), docs, row[docs], np.full(len(best), base + i), best)):
            column.append(values)
    lists = [pa.array([np.concatenate(c)], pa.list_(t)) for c, t in zip((*out, *tops), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
    head = [pa.array([bundle], pa.int32()), pa.array([number], pa.int64())]
    return pa.table([*head, *lists], names=["bundle", "slice", "item", "doc", "score", "top_item", "top_score"])


def floors_of(accumulators: DataFrame, n_items: int, k: int) -> np.ndarray:
    """Per item the k-th best of the scores that slices have sent (0 with fewer), one number each."""
    sent = accumulators.select(F.explode(F.arrays_zip("top_item", "top_score")).alias("t")).select("t.top_item", "t.top_score")
    order = Window.partitionBy("top_item").orderBy(F.desc("top_score"))
    best = sent.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    floors = np.zeros(n_items, np.int64)
    for r in best.groupBy("top_item").agg(F.count("place").alias("n"), F.min("top_score").alias("least")).where(F.col("n") == k).collect():
        floors[r["top_item"]] = r["least"]
    return floors


def search(docs: DataFrame, items: DataFrame, k: int = TOP, lot: int = LOT) -> DataFrame:
    """(item_id, item_text, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    known, lots = numbered(items, lot)
    wanted = staged(known.mapInArrow(_item_terms, "lot int, item int, term binary"), "item-terms")
    with arrow_rows(spark, ROWS):
        laid = staged(postings(docs, wanted.select("term").distinct()), "postings")
    slices, found = laid.where(F.col("term").isNull()), laid.where(F.col("term").isNotNull())
    n = F.explode("n").alias("n")
    total = slices.select(n).where(F.col("n") > 0).agg(F.count("n").alias("docs"), F.sum("n").alias("terms")).first()
    head = "lot int, item int, slice bigint, doc int, score bigint"
    if not total["docs"]:
        best = spark.createDataFrame([], head)
    else:
        counts = (total["docs"], total["terms"])
        rated = staged(wanted.join(weighted(found, *counts), "term"), "rated")
        best = functools.reduce(DataFrame.unionByName, [_lot(rated, found, slices, i, known, counts, k) for i in range(lots)])
    order = Window.partitionBy("lot", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    # Ids of a slice are in order, so equal scores of a slice keep theirs.
    named = best.join(slices.select("slice", "ids"), "slice").select("lot", "item", "score", F.get("ids", F.col("doc")).alias("doc_id"))
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    of = known.select("lot", "item", "item_id", F.col("text").alias("item_text"))
    return guarded_join(ranked, of, ["lot", "item"], "inner", salt=F.col("rank")).select("item_id", "item_text", "rank", "doc_id", "score")


def _keyed(step: Callable) -> Callable:
    def of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return step(key, left, right)

    return of


def _lot(rated: DataFrame, found: DataFrame, slices: DataFrame, number: int, known: DataFrame, counts: tuple[int, int], k: int) -> DataFrame:
    """(lot, item, slice, doc, score): the best of every slice for the items of a lot."""
    own = rated.where(F.col("lot") == number)
    n_items = known.where(F.col("lot") == number).count()
    most = np.zeros((len(OWNERS), n_items), np.int64)
    for r in own.groupBy("owner", "item").agg(F.sum("most").alias("most")).collect():  # at most owners x lot rows
        most[r["owner"], r["item"]] = r["most"]
    # Enough scores from every slice to fill k places when there are few slices.
    sent = max(1, min(k, -(-4 * k // slices.count())))
    bundle = F.floor(F.col("item") / BUNDLE).cast("int").alias("bundle")
    asked = own.groupBy("owner", "term", "w", bundle).agg(F.collect_list("item").alias("items"))
    floors = np.zeros(n_items, np.int64)
    carried = found.sparkSession.createDataFrame([], ACCUMULATORS)
    for owner in range(len(OWNERS)):
        terms_here = asked.where(F.col("owner") == owner).select("term", "w", "bundle", "items")
        here = guarded_join(found.select("slice", "term", "pos", "tf", "n"), terms_here, ["term"], "inner", F.col("slice"), 20_000)
        step = functools.partial(
            visit, floors=floors, rests=most[owner + 1 :].sum(axis=0), n_docs=counts[0], n_terms=counts[1], k=k, sent=sent, last=owner == len(OWNERS) - 1
        )
        visited = carried.groupBy("bundle", "slice").cogroup(here.groupBy("bundle", "slice"))
        carried = staged(visited.applyInArrow(_keyed(step), ACCUMULATORS), f"owner{owner}")
        if owner < len(OWNERS) - 1:
            floors = np.maximum(floors, floors_of(carried, n_items, k))
    each = carried.select("slice", F.explode(F.arrays_zip("item", "doc", "score")).alias("a"))
    return each.select(F.lit(number).alias("lot"), "a.item", "slice", "a.doc", "a.score")
