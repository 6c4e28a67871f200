"""Best-fit packing of tokenized documents: partitions first, then a tree of residual bins.

1. Documents are tokenized where they are; only piece descriptions (no ids) travel.
2. Each partition packs its pieces best-fit, longest first. Bins with at most ``SLACK`` tokens free
   are closed. The others go on as items of their fill.
3. Rounds merge the open bins of several partitions and pack them again, bins as items, until one
   task holds them all or a round closes hardly any. Tasks take ``ROUND_BINS`` open bins, so a
   round's tasks follow the data.

Every round is written before the next one reads it: a lost executor repeats a task of one round
and can't change what others have already read.

Defined results: null text is empty, one piece holding the end id. Documents longer than a
sequence are cut into whole sequences, the first piece taking what is over. Repeated rows are
packed each for itself. Extra columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import staged

LENGTH = 2048
SLACK = 8
END_ID = 0
ROUND_BINS = 50_000
FAN_IN = 8

ITEM = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>"
BIN = f"bin_id bigint, fill int, items array<{ITEM}>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """Token ids as little-endian 32-bit bytes, from a byte-level vocabulary file.

    The file's ranks are run by tiktoken, whose ids are those of ``tokenizers`` on the same file
    at several times its speed (the tests compare both). As there, the strings of added tokens are
    cut out of a text first and become their own ids.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        # Byte-level vocabularies write printable bytes as themselves and the others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in model.get("added_tokens", [])}
        strings = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, strings))) if strings else None
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.added}
        self.encode = tiktoken.Encoding(
            "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def _bytes(self, text: str) -> bytes:
        ids = array("I", self.encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def of(self, text: str) -> bytes:
        out, at = [], 0
        for found in self.cut.finditer(text) if self.cut else ():
            out += [self._bytes(text[at : found.start()]), self.added[found[0]]]
            at = found.end()
        return b"".join([*out, self._bytes(text[at:])])


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    if n <= length:
        return [(0, n)]
    head = n % length or length
    return [(0, head), *((s, length) for s in range(head, n, length))]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int) -> Iterator[pa.RecordBatch]:
    ids, end = Ids(path), np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            data = ids.of(text or "") + end
            for k, (start, size) in enumerate(cuts(len(data) // 4, length)):
                rows.append((doc_id, k, start, size, zlib.crc32(data[4 * start : 4 * (start + size)])))
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
        )


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    cut = functools.partial(_pieces, path=path or default_vocabulary(), length=length)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return columns.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Indices of ``sizes`` by bin: longest first, each to the open bin that it fills best."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(length + 1)]
    mask = 0  # bit f: there is a bin with f tokens free
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = length, len(bins)
            bins.append([i])
        rest = room - size
        if rest:
            free[rest].append(k)
            mask |= 1 << rest
    return bins


def _pack(batches: Iterator[pa.RecordBatch], length: int, level: int) -> Iterator[pa.RecordBatch]:
    """Bins out of bins, a bounded number of input bins at a time."""
    from pyspark import TaskContext

    base = (level << 56) | (TaskContext.get().partitionId() << 32)
    schema = pa.schema(
        [
            ("bin_id", pa.int64()),
            ("fill", pa.int32()),
            (
                "items",
                pa.list_(
                    pa.struct(
                        [
                            ("doc_id", pa.int64()),
                            ("piece", pa.int32()),
                            ("start", pa.int64()),
                            ("length", pa.int64()),
                            ("ids_crc32", pa.int64()),
                            ("offset", pa.int64()),
                        ]
                    )
                ),
            ),
        ]
    )
    done = 0

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal done
        fills = [f for b in held for f in b["fill"].to_pylist()]
        items = [x for b in held for x in b["items"].to_pylist()]
        bins = best_fit(fills, length)
        for at in range(0, len(bins), 5_000):
            rows = []
            for members in bins[at : at + 5_000]:
                place, inside = 0, []
                for i in members:
                    inside += [x | {"offset": x["offset"] + place} for x in items[i]]
                    place += fills[i]
                rows.append({"bin_id": base | done, "fill": place, "items": inside})
                done += 1
            yield pa.RecordBatch.from_pylist(rows, schema)

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 2 * ROUND_BINS:
            yield from packed(held)
            held, rows = [], 0
    if rows:
        yield from packed(held)


def pack(cut: DataFrame, length: int = LENGTH, slack: int = SLACK, round_bins: int = ROUND_BINS) -> DataFrame:
    """Sequences for the rows of ``pieces``: adds sequence_id and offset.

    The pieces are written first: a lost packing task does not tokenize again, and no task needs
    two Python workers at once, one to tokenize and one to pack.
    """
    cut = staged(cut, "pieces")
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    bins = cut.select(F.lit(0).cast("long").alias("bin_id"), F.col("length").cast("int").alias("fill"), F.array(item).alias("items"))
    level, done = 0, []
    current = staged(bins.mapInArrow(functools.partial(_pack, length=length, level=level), BIN), "bins-0")
    parts = max(1, current.rdd.getNumPartitions())
    while True:
        is_open = F.col("fill") < length - slack
        done.append(current.where(~is_open))
        rest = current.where(is_open)
        count = rest.count()
        parts = max(-(-count // round_bins), parts // FAN_IN, 1)
        level += 1
        # Rows are dealt round-robin after a sort, so a repeated task sees the same rows.
        merged = staged(
            rest.repartition(parts).mapInArrow(functools.partial(_pack, length=length, level=level), BIN), f"bins-{level}"
        )
        left = merged.where(is_open).count()
        if parts == 1 or left > 0.98 * count:
            done.append(merged)
            break
        current = merged
    whole = functools.reduce(DataFrame.unionByName, done)
    flat = whole.select(F.col("bin_id").alias("sequence_id"), F.explode("items").alias("i"))
    return flat.select("i.doc_id", "i.piece", "i.start", "i.length", "i.ids_crc32", "sequence_id", "i.offset")
