"""N-gram Jaccard join: MinHash LSH forest with exact verification.

Texts with the same words are one text with a copy count. Each text has ``TREES`` signatures of
``DEPTH`` minima over its five-word shingles; a tree is the sorted table of its signatures, whose
groups of equal prefixes are the nodes of a prefix trie. The join starts at full depth and shortens
the prefix until a pair at the threshold is in a common group with the target probability:

* At full depth a text becomes a candidate of its group's least text. At the shortest prefix, groups
  of which all texts are connected by now drop out; in the others a text becomes a candidate of the
  unconnected ones among the ``NEAR`` before it, by signature and by key: in groups of up to
  ``NEAR`` + 1 these are all. Larger groups that still hold unconnected texts are dealt over blocks,
  and every two blocks are compared whole in one task, which hands on links only.
* Candidates are verified by the Jaccard similarity of their whole shingle sets; what passes is a
  link, and the links' components are the classes. Links are then counted over all pairs of a class.

Defined results: a text of one to four words has one shingle, all its words; a text without words
(null, empty) is linked to nothing. Rows with equal words are one class whatever their ids, null
ids included; a class is named by its smallest id (null if it has none). Extra columns are carried
by ``one_of_each``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import arrow_rows, guarded_join
from nearfield.llm.components import components
from nearfield.llm.hashing import joined, runs_of, words_of
from nearfield.session import staged

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 6
NEAR = 8
RECALL = 0.999
#: Texts and bytes of shingle sets in a block of a group that is compared whole.
BLOCK, BLOCK_BYTES = 1_024, 8 << 20
#: Shingles of a block taken at once, and the share of its sets from which a shingle is a matrix column.
WIDTH, RARE = 2_048, 32
#: Rows per Arrow batch and bytes of text hashed at once.
BATCH_ROWS, STEP = 500, 1 << 18


def depths(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> list[int]:
    """Prefix lengths from full depth down to the first one that reaches the target recall."""
    found = []
    for d in range(depth, 0, -1):
        found.append(d)
        if 1 - (1 - threshold**d) ** trees >= recall:
            break
    return found


_RNG = np.random.default_rng(104_729)
FACTORS = _RNG.integers(0, 2**63, (TREES * DEPTH, 1), np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 2**63, (TREES * DEPTH, 1), np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each permutation, as 32-bit integers."""
    least = np.full(TREES * DEPTH, 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 4_096):
        least = np.minimum(least, ((FACTORS * shingles[at : at + 4_096] + OFFSETS) >> np.uint64(32)).min(axis=1))
    return least.astype(np.uint32).view(np.int32)


def shingled(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """(key of the word sequence, shingle hashes) of each text; the key of a text without words is empty."""
    for _, data, starts in joined(texts, STEP):
        hashes, begins, _ = words_of(data)
        runs = runs_of(hashes, SHINGLE)
        bounds = np.append(np.searchsorted(begins, starts), len(hashes))
        for low, high in zip(bounds, bounds[1:]):
            if low == high:
                yield b"", runs[:0]
            else:
                own = runs[low : high - SHINGLE + 1] if high - low >= SHINGLE else runs_of(hashes[low:high], high - low)
                yield xxhash.xxh3_128_digest(hashes[low:high].tobytes()), own


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, signatures, known = [], [], {}
        for key, shingles in shingled([(t or "").encode() for t in batch["text"].to_pylist()]):
            if key and key not in known:
                known[key] = minima(shingles)
            keys.append(key or None)
            signatures.append(known.get(key))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["mark"], pa.array(keys, pa.binary()), pa.array(signatures, pa.list_(pa.int32()))],
            ["doc_id", "mark", "t", "signature"],
        )


def mark_of(text):
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, t, signature) of every document; t is the key of its words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of(F.col("text")).alias("mark"), "text")
    return rows.mapInArrow(_signatures, "doc_id bigint, mark bigint, t binary, signature array<int>")


def _nodes(texts: DataFrame, depth: int) -> DataFrame:
    """(t, root, node, leaf): the node of every text in every trie, and its group at full depth."""
    prefix = lambda d: F.slice("signature", F.col("tree") * DEPTH + 1, d)
    trees = texts.select("t", "root", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    return trees.select(
        "t", "root", F.xxhash64("tree", prefix(depth)).alias("node"), F.xxhash64("tree", prefix(DEPTH)).alias("leaf")
    )


def candidates(texts: DataFrame, depth: int) -> DataFrame:
    """(a, b): texts of different classes so far (``root``) that meet in a node of the tries.

    In a node whose texts are of several classes, each text meets the ``NEAR`` ones before it, by
    signature (``leaf``) and by key (``t``): as many pairs as texts, times a constant. At full depth,
    where nodes are mostly copies with a few edits, the least text of the node stands for all. What
    this leaves open in nodes of more than ``NEAR`` + 1 texts is compared by ``crowded``.
    """
    nodes = _nodes(texts, depth)
    if depth == DEPTH:
        least = nodes.groupBy("node").agg(F.min("t").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("node", "b")
        met = nodes.join(least, "node").select(F.col("t").alias("a"), "b").where("a != b")
    else:
        node = Window.partitionBy("node")
        several = nodes.withColumn("several", F.min("root").over(node) != F.max("root").over(node)).where("several")
        orders = (node.orderBy("leaf", "t"), node.orderBy("t"))
        before = F.array(*[F.lag(F.struct("t", "root"), k).over(order) for order in orders for k in range(1, NEAR + 1)])
        other = several.select("t", "root", before.alias("before")).select("t", "root", F.explode("before").alias("o"))
        met = other.where(F.col("o.root") != F.col("root")).select(F.col("t").alias("a"), F.col("o.t").alias("b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(k, np.unique(s).tobytes()) for k, s in shingled([(t or "").encode() for t in batch["text"].to_pylist()])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in found], pa.binary()), pa.array([s for _, s in found], pa.binary())], ["t", "shingles"]
        )


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for x, y in zip(batch["x"], batch["y"]):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            if len(small) < threshold * len(large):
                kept.append(False)
                continue
            place = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[place] == small).sum())
            kept.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(kept, pa.bool_()))


def shingle_sets(wanted: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(t, s): the shingle sets of the texts ``wanted`` (t); one document of each is read again, by id and mark."""
    wanted = texts.join(wanted, "t", "left_semi").select("doc_id", "mark")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of(F.col("text")).alias("mark"), "text")
    rows = guarded_join(rows, wanted, ["doc_id", "mark"], "inner", salt=F.col("mark"))
    # Several rows may share id and mark; one set per text is enough.
    return staged(rows.select("text").mapInArrow(_sets, "t binary, shingles binary"), "sets").groupBy("t").agg(F.first("shingles").alias("s"))


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose whole shingle sets reach the threshold; only texts that occur in a pair are read again."""
    ends = pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))).distinct()
    sets = shingle_sets(ends, texts, docs)
    left = pairs.join(sets.select(F.col("t").alias("a"), F.col("s").alias("x")), "a")
    both = left.join(sets.select(F.col("t").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(functools.partial(_verify, threshold=threshold), "a binary, b binary")


def shared(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the sets before ``split`` with those from it on; of all with all if it is 0.

    Shingles of many sets are columns of a matrix product, each of the others counts its few pairs.
    """
    n = len(sets)
    rows, base = (split, split) if split else (n, 0)
    both = np.zeros((rows, n - base), np.float32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(times), np.int64)
    place[np.argsort(-times, kind="stable")] = np.arange(len(times))
    column, times = place[column], -np.sort(-times)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    starts = np.append(0, np.cumsum(times))
    often = int(np.searchsorted(-times, -max(n // RARE, 1), "left"))
    for at in range(0, often, WIDTH):
        end = min(at + WIDTH, often)
        part = slice(starts[at], starts[end])
        marks = np.zeros((n, end - at), np.float32)
        marks[owner[part], column[part] - at] = 1
        both += marks[:rows] @ marks[base:].T
    for d in range(2, max(n // RARE, 1) + 1):
        low, high = np.searchsorted(-times, [-d, 1 - d], "left")
        low = max(low, often)
        for at in range(low, high, max(1, (1 << 20) // (d * d))):
            own = owner[starts[at] : starts[min(at + max(1, (1 << 20) // (d * d)), high)]].reshape(-1, d)
            x, y = np.broadcast_arrays(own[:, :, None], own[:, None, :])
            met = (x < rows) & (y >= base)
            both += np.bincount(x[met] * (n - base) + y[met] - base, minlength=both.size).reshape(both.shape)
    if not split:
        # A shingle of one set only is in no pair, but in that set.
        np.fill_diagonal(both, [len(s) for s in sets])
    return both.astype(np.int64)


def linked(sets: list[np.ndarray], split: int, threshold: float) -> np.ndarray:
    """Which sets before ``split`` reach the threshold with which from it on; all with all others if it is 0."""
    both = shared(sets, split)
    sizes = np.array([len(s) for s in sets])
    left, right = (sizes[:split], sizes[split:]) if split else (sizes, sizes)
    found = both >= threshold * (left[:, None] + right[None, :] - both) - 1e-9
    if not split:
        np.fill_diagonal(found, False)
    return found


def cells(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Every two blocks of each group of ``members`` (g, t, ...), with their sets, one after the other.

    A text is in the block its hash says, and goes to as many cells as its group has blocks; all
    rows of a cell are in one task, those of its second block (``second``) last.
    """
    sizes = members.join(sets.select("t", F.octet_length("s").alias("size")), "t").groupBy("g").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    dealt = guarded_join(members, sizes, ["g"], "inner", salt=F.col("t"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("t"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = dealt.withColumn("second", F.col("block") > F.col("low")).drop("blocks", "block", "other")
    return dealt.join(sets, "t").repartition("g", "low", "high").sortWithinPartitions("g", "low", "high", "second", "t")


def _by_cell(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(split, sets, the columns' values) of each cell; cells of one text, or of one side only, hold no pair."""
    cell, held = None, []

    def whole():
        split = sum(not row[0] for row in held)
        if len(held) > 1 and split and (split < len(held) or cell[1] == cell[2]):
            yield split % len(held), [np.frombuffer(row[1], np.uint64) for row in held], *zip(*[row[2:] for row in held])

    for batch in batches:
        keys = zip(*[batch[c].to_pylist() for c in ("g", "low", "high")])
        for key, *row in zip(keys, *[batch[c].to_pylist() for c in ("second", "s", *columns)]):
            if key != cell:
                yield from whole()
                cell, held = key, []
            held.append(row)
    yield from whole()


def _crowded(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between texts of different classes, of each cell as many as connect what is connected."""
    for split, sets, keys, roots in _by_cell(batches, "t", "root"):
        n, names = len(sets), np.unique(np.array(roots, object), return_inverse=True)[1]
        near = np.zeros((n, n), bool)
        near[: split or n, split:] = linked(sets, split, threshold)
        near = (near | near.T) & (names[:, None] != names[None, :])
        fresh, a, b = np.ones(n, bool), [], []
        for first in range(n):
            waiting = [first] if fresh[first] else []
            fresh[first] = False
            while waiting:
                at = waiting.pop()
                found = np.flatnonzero(near[at] & fresh)
                fresh[found] = False
                waiting += found.tolist()
                a += [keys[at]] * len(found)
                b += [keys[k] for k in found]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def crowded(texts: DataFrame, depth: int) -> DataFrame:
    """(g, t, root): the nodes of more than ``NEAR`` + 1 texts that hold texts of several classes."""
    nodes = _nodes(texts, depth).select(F.col("node").alias("g"), "t", "root")
    several = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
    several = several.where((F.col("n") > NEAR + 1) & (F.col("least") != F.col("most"))).select("g")
    return guarded_join(nodes, several, ["g"], "inner", salt=F.col("t"))


def _counted(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(t, linked): the documents that each text is linked to within a cell."""
    for split, sets, keys, copies in _by_cell(batches, "t", "copies"):
        near, copies = linked(sets, split, threshold), np.array(copies, np.int64)
        counts = np.zeros(len(sets), np.int64)
        counts[: split or len(sets)] = near @ copies[split:]
        if split:
            counts[split:] = copies[:split] @ near
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts)], ["t", "linked"])


def _grouped(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The (doc_id, mark, t) of every document, the texts, and (t, root) of those with a link."""
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS):
        rows = staged(signatures(docs), "signatures")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "doc_id", "mark", "signature")).alias("first")
    texts = rows.where("t is not null").groupBy("t").agg(first, F.count(F.lit(1)).alias("copies"))
    texts = staged(texts.select("t", "copies", "first.doc_id", "first.mark", "first.signature"), "texts")
    links, roots = None, None
    steps = depths(threshold, recall)

    def rooted() -> DataFrame:
        root = F.col("t") if roots is None else F.coalesce("root", "t")
        known = texts if roots is None else texts.join(roots.withColumnRenamed("node", "t"), "t", "left")
        return known.select("t", "signature", root.alias("root"))

    # Full depth finds the bulk; a pair in a node of any depth is in a node of the shortest prefix, too.
    for depth in dict.fromkeys((steps[0], steps[-1])):
        pairs = staged(candidates(rooted(), depth), "pairs")
        with arrow_rows(spark, BATCH_ROWS):
            found = staged(verified(pairs, texts, docs, threshold), "verified")
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    members = staged(crowded(rooted(), steps[-1]), "crowded")
    if not members.isEmpty():
        with arrow_rows(spark, BATCH_ROWS):
            sets = staged(shingle_sets(members.select("t").distinct(), texts, docs), "crowded-sets")
            found = cells(members, sets).mapInArrow(functools.partial(_crowded, threshold=threshold), "a binary, b binary")
            links = links.unionByName(staged(found, "crowded-links"))
        roots = components(links)
    return rows, texts, roots.withColumnRenamed("node", "t")


def _named(rows: DataFrame, texts: DataFrame, roots: DataFrame, joins: DataFrame | None = None) -> DataFrame:
    """``rows`` with the class of each and, given ``joins`` (t, linked), its number of links."""
    named = texts.join(roots, "t", "left").select("t", "doc_id", "copies", F.coalesce("root", "t").alias("root"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    by_text = named.join(names, "root")
    # Without words there is no class to share: the document is alone.
    columns = ["doc_id", "mark", "t", F.when(F.col("t").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")]
    if joins is None:
        return rows.select("doc_id", "mark", "t").join(by_text.select("t", "class_id"), "t", "left").select(*columns)
    n_links = F.col("copies") - 1 + F.coalesce("linked", F.lit(0))
    by_text = by_text.join(joins, "t", "left").select("t", "class_id", n_links.alias("n_links"))
    rows = rows.select("doc_id", "mark", "t").join(by_text, "t", "left")
    return rows.select(*columns, F.coalesce("n_links", F.lit(0)).alias("n_links"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, mark, t, class_id, n_links): the class of every document, with t null without words.

    n_links counts the other documents that are linked to it: copies of its own text and of the
    texts whose shingle sets reach the threshold. All of them are in its class, so every two texts
    of a class are compared, block by block, and a task hands on one count per text and cell.
    """
    rows, texts, roots = _grouped(docs, threshold, recall)
    members = roots.join(texts.select("t", "copies"), "t").select(F.col("root").alias("g"), "t", "copies")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        sets = staged(shingle_sets(members.select("t"), texts, docs), "class-sets")
        counts = cells(members, sets).mapInArrow(functools.partial(_counted, threshold=threshold), "t binary, linked bigint")
        joins = staged(counts, "linked").groupBy("t").agg(F.sum("linked").alias("linked"))
    return _named(rows, texts, roots, joins)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The document with the smallest id of every class (of its texts the one with the least mark),
    and every document without words; columns unchanged."""
    rows = staged(_named(*_grouped(docs, threshold, recall)), "classes")
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "doc_id", "mark")
    # A class without any id is named by its text.
    name = [F.col("class_id"), F.when(F.col("class_id").isNull(), F.col("t"))]
    best = rows.where("t is not null").groupBy(*name).agg(F.min(order).alias("best")).select("best.doc_id", "best.mark")
    empty = rows.where("t is null").select("doc_id", "mark").withColumn("all", F.lit(True)).distinct()
    counts = rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    best = best.withColumn("all", F.lit(False)).unionByName(empty).alias("k").join(
        counts.alias("c"), F.col("k.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("k.mark") == F.col("c.mark"))
    )
    best = staged(best.select("k.doc_id", "k.mark", ((F.col("n") == 1) | F.col("all")).alias("single")), "best")
    marked = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), mark_of(F.col("text")).alias("mark")
    )
    join = lambda side: guarded_join(marked, side, ["doc_id", "mark"], "inner", salt=F.col("mark"))
    once = join(best.where("single").select("doc_id", "mark")).select("row.*")
    # Rows repeated with id and text: one of them stays.
    again = join(best.where("not single").select("doc_id", "mark")).dropDuplicates(["doc_id", "mark"]).select("row.*")
    return once.unionByName(again)


def target_recall(threshold: float, depth: int, trees: int = TREES) -> float:
    """Probability that a pair of this similarity meets in a tree at this depth."""
    return 1 - math.pow(1 - threshold**depth, trees)
