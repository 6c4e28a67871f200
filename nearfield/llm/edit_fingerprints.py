"""Document fingerprints: a randomised edit embedding, bit-sampled, with banding and verification.

A walk reads a text from the left. At step j it writes the character it stands on and moves on if
the shared random bit r(j, character) is 1, else it stays. Two walks that an edit has parted come
together again after a few steps, so a small edit distance becomes a small Hamming distance of
what the walks write. The fingerprint samples what is written: ``SAMPLES`` random steps of each
octave of steps, one hex digit (a hash of the character) per sample, so it grows with the
logarithm of the length, every part of a text counts by its length, and nothing is cut off.

The likeness of two fingerprints is the mean over octaves, weighted by their lengths, of the share
of equal digits, corrected for digits that agree by chance. Near texts are found by bands: digits
drawn at random from the two longest full octaves form the band keys, and every two members of a
band are compared.

Defined results: null text is empty, its fingerprint is "" and two empty texts are alike (1.0).
Rows are ordered by descending id, null last, ties by the text; a single document is its own next
one. Equal texts have equal fingerprints. A row without an id has no near document and is none.
Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import guarded_join
from nearfield.session import staged

SEED = 20_240
PERIOD = 4_096  # steps after which the random bits repeat
CLASSES = 256
SAMPLES = 32
FIRST = 4  # the first octave starts at step 2^FIRST; the steps before it are one octave
BLOCK_BYTES = 16 << 20
RANGES = 256
LANES = 4 << 20  # characters walked together
BANDS, BAND_DIGITS = 18, 10
LIKE = 0.8
#: Members of a part of a band; a task compares two parts at a time. Octaves of pairs compared at once.
PART, SLAB = 4_096, 1 << 18
#: A walk that wrote this many samples or fewer of its last octave may have near ones that end an octave before.
BARELY = 10


#: Tables made once per process; tasks get this module by value, so plain dictionaries keep them.
_TABLES: dict = {}


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Steps spent on a character by (class, step mod PERIOD), and a hex digit by class."""
    if "stay" in _TABLES:
        return _TABLES["stay"], _TABLES["digit"]
    rng = np.random.default_rng(SEED)
    bits = rng.integers(0, 2, (CLASSES, PERIOD), np.int8)
    bits[:, ::64] = 1  # every stay ends
    doubled = np.concatenate([bits, bits], axis=1)
    places = np.where(doubled == 1, np.arange(2 * PERIOD), 4 * PERIOD)
    following = np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    stay = (following - np.arange(PERIOD) + 1).astype(np.int32)
    _TABLES["stay"], _TABLES["digit"] = stay.reshape(-1), rng.integers(0, 16, CLASSES).astype(np.uint8)
    return _TABLES["stay"], _TABLES["digit"]


def sampled_steps(octaves: int) -> np.ndarray:
    """The sampled steps of the first ``octaves`` octaves, ascending within each."""
    if octaves in _TABLES:
        return _TABLES[octaves]
    found = []
    for o in range(octaves):
        low, high = (0, 1 << FIRST) if o == 0 else (1 << (FIRST + o - 1), 1 << (FIRST + o))
        rng = np.random.default_rng([SEED, o])
        found.append(np.sort(rng.choice(high - low, SAMPLES, replace=high - low < SAMPLES)) + low)
    _TABLES[octaves] = np.concatenate(found)
    return _TABLES[octaves]


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, points, 128 + points % 128).astype(np.uint8)


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each text; texts walk side by side, the long ones first."""
    found = [""] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        size, end = 0, at
        while end < len(order) and (end == at or size + len(texts[order[at]]) <= LANES):
            size += len(texts[order[at]])
            end += 1
        for i, fingerprint in zip(order[at:end], _walk([classes(texts[i]) for i in order[at:end]])):
            found[i] = fingerprint
        at = end
    return found


def _walk(coded: list[np.ndarray]) -> list[str]:
    """``coded`` comes longest first, so the lanes still walking are always the first ones."""
    stay, digit = tables()
    lengths = np.array([len(c) for c in coded])
    grid = np.zeros((lengths[0], len(coded)), np.uint8)
    for lane, c in enumerate(coded):
        grid[: len(c), lane] = c
    step = np.zeros(len(coded), np.int32)
    left = np.empty((lengths[0], len(coded)), np.int32)  # the step at which each character was left
    # A lane is in the grid for as many rows as its text has characters.
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    for i in range(lengths[0]):
        n = active[i]
        now = step[:n]
        now += stay.take((grid[i, :n].astype(np.int32) << 12) | (now & (PERIOD - 1)))
        left[i, :n] = now
    found = []
    for lane, c in enumerate(coded):
        ends = left[: len(c), lane]
        octaves = max(1, int(ends[-1]).bit_length() - FIRST + 1)
        steps = sampled_steps(octaves)
        place = np.searchsorted(ends, steps, side="right")
        written = np.where(place < len(c), digit[c[np.minimum(place, len(c) - 1)]], 16)
        found.append("".join(map("0123456789abcdef-".__getitem__, written.tolist())))
    return found


def likeness(a: str, b: str) -> float:
    """0 to 1; steps after a text's end (``-``) differ from any character."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(longest, "-").encode(), np.uint8).reshape(-1, SAMPLES) for s in (a, b))
    written = (x != 45) | (y != 45)
    equal = ((x == y) & written).sum(1)
    weight = written.sum(1) / SAMPLES * 2.0 ** np.arange(len(x))
    share = equal / np.maximum(written.sum(1), 1)
    # Characters of unrelated texts agree in about one digit of eight.
    return float(np.clip(((share - 0.125) / 0.875 * weight).sum() / weight.sum(), 0, 1))


def edit(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def pack(fingerprint: str) -> bytes:
    """Two digits a byte after the number of octaves and of closing ``-``, which only a text's end writes."""
    digits = fingerprint.rstrip("-")
    head = bytes([len(fingerprint) // SAMPLES, len(fingerprint) - len(digits)])
    return head + bytes.fromhex(digits + "0" * (len(digits) % 2))


def unpack(code: bytes) -> str:
    octaves, ended = code[0], code[1]
    return code[2:].hex()[: octaves * SAMPLES - ended] + "-" * ended


def key_of(code: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(code, digest_size=8).digest(), "little", signed=True)


def _blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, Column, int]:
    """The rows, and the block of an id: ranges of ids of about ``block_bytes`` of text each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = -(-size // block_bytes) or 1
    # Quantiles level out uneven ids; within the range of two quantiles ids are cut evenly.
    ranges = min(n, RANGES)
    parts = -(-n // ranges)
    bounds = rows.approxQuantile("doc_id", [k / ranges for k in range(ranges + 1)], 1 / (4 * ranges))
    bounds = sorted({int(b) for b in bounds})[::-1] or [0]
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    # Descending ids: block 0 holds the largest, null ids go last.
    at = F.greatest(F.size(F.filter(edges, lambda b: b >= F.col("doc_id"))), F.lit(1)) - 1
    top = F.get(edges, at)
    width = F.greatest(top - F.coalesce(F.get(edges, at + 1), top), F.lit(1).cast("long"))
    inside = F.least(F.greatest(F.floor((top - F.col("doc_id")) * parts / width), F.lit(0)), F.lit(parts - 1))
    block = F.when(F.col("doc_id").isNull(), len(bounds) * parts).otherwise(at * parts + inside)
    return rows, block.cast("long"), n


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        zipped = [press.compress(t.encode("utf-8", "surrogatepass")) for t in batch["text"].to_pylist()]
        columns = [batch["block"], batch["doc_id"], pa.array(zipped, pa.binary()), batch["tie"]]
        yield pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "zipped", "tie"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block in order; its last row, ``head``, is the first one of the next block.

    The rows that name an id's near documents come right before the id's texts.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string())]
        + [(c, pa.string()) for c in ("fingerprint", "edited_fingerprint")]
        + [(c, pa.float64()) for c in ("near_edited", "near_next")]
        + [("near_id", pa.int64()), ("near_likeness", pa.float64())]
    )
    ids: list[int | None] = []
    texts: list[str] = []
    near: dict[tuple[int, int], tuple[int, float]] = {}
    size = 0

    def written(final: bool) -> pa.RecordBatch:
        """Rows for all texts held, save the last one, which is the first of what follows."""
        prints = fingerprints(texts + [edit(a, b) for a, b in zip(texts, texts[1:])])
        own, other = prints[: len(texts)], prints[len(texts) :]
        rows = []
        for i in range(len(texts) - 1):
            near_id, alike = near.get((ids[i], key_of(pack(own[i]))), (None, None)) if near else (None, None)
            rows.append(
                {
                    "doc_id": ids[i],
                    "n_chars": len(texts[i]),
                    "edited_sha256": hashlib.sha256(edit(texts[i], texts[i + 1]).encode()).hexdigest(),
                    "fingerprint": own[i],
                    "edited_fingerprint": other[i],
                    "near_edited": likeness(own[i], other[i]),
                    "near_next": likeness(own[i], own[i + 1]),
                    "near_id": near_id,
                    "near_likeness": alike,
                }
            )
        keep = 0 if final else 1
        del ids[: len(ids) - keep], texts[: len(texts) - keep]
        for key in [k for k in near if not ids or k[0] != ids[0]]:
            del near[key]
        return pa.RecordBatch.from_pylist(rows, schema)

    press = zstandard.ZstdDecompressor()
    columns = ("doc_id", "zipped", "head", "key", "near_id", "near_likeness")
    for batch in batches:
        for doc_id, zipped, head, key, near_id, alike in zip(*[batch[c].to_pylist() for c in columns]):
            if zipped is None:
                near[doc_id, key] = (near_id, alike)
                continue
            text = press.decompress(zipped).decode("utf-8", "surrogatepass")
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if head or size > LANES:
                yield written(head)
                size = 0


def fingerprint_with_edits(docs: DataFrame, block_bytes: int = BLOCK_BYTES, like: float = LIKE) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likenesses, and the nearest earlier document.

    Blocks are ranges of descending ids. Each gets a copy of the first row of the next block that
    isn't empty (of the first block, after the last), so a block needs nothing but its own rows.
    Texts move to their blocks compressed, those of repeated ids also as they are, to be sorted by.
    ``near_id`` is the document of ``near_documents``, found
    before the texts move and carried by rows of its own to the block of its document.
    """
    rows, block, n = _blocks(docs, block_bytes)
    codes = staged(rows.mapInArrow(_codes, "doc_id bigint, key bigint, code binary"), "codes")
    near = near_of_codes(codes, like)
    rows = rows.withColumn("block", block)
    repeated = codes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("repeated"))
    tied = guarded_join(rows, repeated, ["doc_id"], "left", salt=F.col("text")).withColumn("tie", F.when(F.col("repeated"), F.col("text")))
    # The first row of a block has its largest id, and of that id's texts the smallest.
    tops = rows.groupBy("block").agg(F.max("doc_id").alias("top"))
    heads = guarded_join(rows, tops, ["block"], "inner", salt=F.col("doc_id")).where(F.col("doc_id").eqNullSafe(F.col("top")))
    heads = staged(heads.groupBy("block").agg(F.max("doc_id").alias("doc_id"), F.min("text").alias("text")), "heads")
    # The window sees one row per block, without texts.
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("block").over(Window.orderBy("block")), F.max("block").over(whole))
    places = heads.select("block", before.alias("before"))
    heads = heads.join(places, "block").select(F.col("before").alias("block"), "doc_id", "text")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("key", "long"), ("near_id", "long"), ("near_likeness", "double"))]
    schema = "block bigint, doc_id bigint, zipped binary, tie string"
    texts = tied.select("block", "doc_id", "text", "tie").mapInArrow(_zipped, schema).withColumn("head", F.lit(False))
    heads = heads.withColumn("tie", F.lit(None).cast("string")).mapInArrow(_zipped, schema).withColumn("head", F.lit(True))
    signs = near.select(block.alias("block"), "doc_id", F.lit(False).alias("head"), "key", "near_id", "near_likeness")
    dealt = texts.unionByName(heads).select("*", *none).unionByName(signs, allowMissingColumns=True)
    # The rows of near documents come first, then the texts of an id.
    order = [F.col("doc_id").desc_nulls_last(), F.col("zipped").isNotNull(), F.col("tie")]
    dealt = dealt.repartition(n, "block").sortWithinPartitions("block", "head", *order)
    return dealt.select("doc_id", "zipped", "head", "key", "near_id", "near_likeness").mapInArrow(
        _edited,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, near_id bigint, near_likeness double",
    )


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [pack(f) for f in fingerprints([t or "" for t in batch["text"].to_pylist()])]
        keys = pa.array([key_of(c) for c in codes], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], keys, pa.array(codes, pa.binary())], ["doc_id", "key", "code"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [pack(f or "") for f in batch["fingerprint"].to_pylist()]
        keys = pa.array([key_of(c) for c in codes], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], keys, pa.array(codes, pa.binary())], ["doc_id", "key", "code"])


def band_places() -> list[list[tuple[int, int]]]:
    """The digits of each band, as (octaves before the band's, sample)."""
    rng = np.random.default_rng([SEED, 1_000])
    return [list(zip(rng.integers(0, 2, BAND_DIGITS).tolist(), rng.integers(0, SAMPLES, BAND_DIGITS).tolist())) for _ in range(BANDS)]


def bands_of(fingerprint: str, places: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """(band key, its last octave); octaves are counted from the start of the walk.

    Those of the last full octave; and where the last octave has barely begun, so that a near text
    may end before it, those of the full octave before. The shortest texts use the octaves they have.
    """
    octaves = len(fingerprint) // SAMPLES
    if not octaves:
        return []
    written = SAMPLES - (len(fingerprint) - len(fingerprint.rstrip("-")))
    ends = {max(octaves - 2, 0)} | ({max(octaves - 3, 0)} if written <= BARELY else set())
    found = []
    for end in sorted(ends):
        for b, digits in enumerate(places):
            drawn = "".join(fingerprint[max(end - back, 0) * SAMPLES + k] for back, k in digits)
            found.append((key_of(f"{b}:{end}:{drawn}".encode()), end))
    return found


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = band_places()
    for batch in batches:
        found = [bands_of(unpack(c), places) for c in batch["code"].to_pylist()]
        keys = np.repeat(batch["key"].to_numpy(zero_copy_only=False), [len(f) for f in found]).astype(np.int64)
        bases = pa.array([band for f in found for band, _ in f], pa.int64())
        yield pa.RecordBatch.from_arrays([bases, pa.array(keys)], ["base", "key"])


def _planes(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The four bits of each digit and whether it is written, as 32 bits an octave, and the weight of what is written."""
    octaves = np.array([c[0] for c in codes])
    written = octaves * SAMPLES - np.array([c[1] for c in codes])
    most = int(octaves.max())
    digits = np.frombuffer(b"".join(c[2:].ljust(most * SAMPLES // 2, b"\0") for c in codes), np.uint8)
    bits = np.packbits(np.unpackbits(digits).reshape(len(codes), most, SAMPLES, 4), axis=2)
    inside = (np.arange(most * SAMPLES) < written[:, None]).reshape(len(codes), most, SAMPLES)
    planes = np.ascontiguousarray(np.moveaxis(bits, 3, 0)).view(np.uint32)[..., 0]
    inside_planes = np.packbits(inside, axis=2).view(np.uint32)[..., 0]
    # Octaves before texts, so that what is compared at once is long.
    turned = np.ascontiguousarray(planes.transpose(0, 2, 1)), np.ascontiguousarray(inside_planes.T)
    return *turned, inside.sum(2) @ 2.0 ** np.arange(most)


def _earlier(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For slices of ``x``, the place in ``y`` of the most alike of a lower id, the lowest if several, and the likeness.

    Both are (ids, planes, written, weights), ascending by ids. The likeness is that of ``likeness``,
    with the sums over octaves as whole numbers; it is negative if there is no lower id.
    """
    ids, planes, written, weights = x
    limits = np.searchsorted(y[0], ids, "left")
    factors = 2.0 ** np.arange(len(written))
    rows = max(1, SLAB // (len(y[0]) * len(factors)))
    for at in range(int(np.searchsorted(limits, 0, "right")), len(ids), rows):
        part = slice(at, at + rows)
        # The limits ascend.
        stop = int(limits[part][-1])
        differ = ~(written[:, part, None] & y[2][:, None, :stop])
        for own, other in zip(planes, y[1]):
            differ |= own[:, part, None] ^ other[:, None, :stop]
        equal = SAMPLES - np.bitwise_count(differ).reshape(len(factors), -1).astype(np.float64)
        equal = (factors @ equal).reshape(-1, stop)
        weight = np.maximum(weights[part, None], y[3][None, :stop])
        alike = np.clip((8 * equal - weight) / (7 * weight), 0, 1)
        alike[np.arange(stop) >= limits[part, None]] = -1
        best = alike.argmax(1)
        yield part, best, alike[np.arange(len(best)), best]


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole cells, and where each cell starts and the last one ends; a cell's rows come one after the other."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        starts = _starts(held)
        if len(starts) > 1:
            yield held.slice(0, starts[-1]), starts
            held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held, np.append(_starts(held), held.num_rows)


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    cells = np.stack([batch[c].to_numpy() for c in ("base", "low", "high")])
    return np.flatnonzero(np.append(True, (cells[:, 1:] != cells[:, :-1]).any(0))[: batch.num_rows])


def _nearest(batches: Iterator[pa.RecordBatch], like: float) -> Iterator[pa.RecordBatch]:
    """(key, met): for each member of a cell the nearest earlier one that it is compared with there."""
    for batch, starts in _whole_cells(batches):
        ids, keys = batch["doc_id"].to_numpy(), batch["key"].to_numpy()
        second = batch["second"].to_numpy(zero_copy_only=False)
        crossed = batch["low"].to_numpy() != batch["high"].to_numpy()
        codes = batch["code"].to_pylist()
        found, met = [], []
        for start, end in zip(starts[:-1], starts[1:]):
            whole = (ids[start:end], *_planes(codes[start:end]))
            split = end - start - int(second[start:end].sum())

            def part(a: int, b: int) -> tuple[np.ndarray, ...]:
                return whole[0][a:b], whole[1][..., a:b], whole[2][:, a:b], whole[3][a:b]

            # Two parts of a band are compared with each other only, each part within itself in a cell of its own.
            sides = [(0, split), (split, end - start)] if crossed[start] else [(0, end - start)]
            for own, other in zip(sides, sides[::-1]):
                for rows, best, alike in _earlier(part(*own), part(*other)):
                    near = np.flatnonzero(alike >= like - 1e-9)
                    found.append(keys[start + own[0] + rows.start + near])
                    met.append(keys[start + other[0] + best[near]])
        columns = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (found, met)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "met"])


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = zip(batch["code"].to_pylist(), batch["other"].to_pylist())
        like = pa.array([likeness(unpack(a), unpack(b)) for a, b in codes], pa.float64())
        names = ["key", "met", "doc_id", "near_id"]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], like], [*names, "likeness"])


def _verified(pairs: DataFrame, texts: DataFrame, like: float) -> DataFrame:
    """(key, met, doc_id, near_id, likeness) of the pairs (key, met) that are alike; ids are those of ``texts``."""
    other = texts.select(F.col("key").alias("met"), F.col("doc_id").alias("near_id"), F.col("code").alias("other"))
    both = pairs.join(texts, "key").join(other, "met").select("key", "met", "doc_id", "near_id", "code", "other")
    return both.mapInArrow(_likeness, "key bigint, met bigint, doc_id bigint, near_id bigint, likeness double").where(F.col("likeness") >= like)


def near_texts(texts: DataFrame, like: float) -> DataFrame:
    """(doc_id, near_id, likeness) of different texts (doc_id, key, code), larger id first.

    Every two members of a band are compared, in cells of two of its parts; of each member and cell
    the nearest earlier one that reaches ``like`` remains. So the work grows with the square of a
    band's different texts and what is kept with their number. Of bands with the same members one is compared.
    """
    band = Window.partitionBy("base")
    found = texts.mapInArrow(_bands, "base bigint, key bigint")
    marks = [F.bit_xor("key").over(band).alias("mark"), F.bit_xor(F.xxhash64("key")).over(band).alias("other_mark")]
    crowded = found.select("base", "key", F.count(F.lit(1)).over(band).alias("n"), *marks).where("n > 1")
    crowded = staged(crowded, "crowded")
    bands = crowded.groupBy("n", "mark", "other_mark").agg(F.min("base").alias("base"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    members = crowded.join(bands.select("base"), "base").select("base", "key", parts.alias("parts"))
    members = members.join(texts, "key").withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.withColumn("low", F.least("part", "with")).withColumn("high", F.greatest("part", "with"))
    members = members.select("base", "low", "high", (F.col("part") > F.col("low")).alias("second"), "doc_id", "key", "code")
    cells = members.repartition("base", "low", "high").sortWithinPartitions("base", "low", "high", "second", "doc_id", "key")
    # Texts that meet in several bands are compared in each and verified once.
    pairs = cells.mapInArrow(functools.partial(_nearest, like=like), "key bigint, met bigint").distinct()
    alike = _verified(pairs, texts, like)
    alike = alike.select(F.greatest("doc_id", "near_id").alias("doc_id"), F.least("doc_id", "near_id").alias("near_id"), "likeness")
    return alike.where("doc_id != near_id").distinct()


def near_of_codes(codes: DataFrame, like: float) -> DataFrame:
    """(doc_id, key, near_id, near_likeness): the nearest earlier document of the rows (doc_id, key, code).

    Rows with one code are one text, met by its least id; its other rows are nearest to that one.
    """
    named = codes.where("doc_id is not null")
    texts = staged(named.groupBy("key", "code").agg(F.min("doc_id").alias("doc_id")), "texts")
    met = near_texts(texts, like)
    best = met.groupBy("doc_id").agg(F.max(F.struct("likeness", (-F.col("near_id")).alias("order"))).alias("best"))
    best = best.select(F.col("doc_id").alias("least"), (-F.col("best.order")).alias("near_id"), F.col("best.likeness").alias("near_likeness"))
    leasts = texts.select("key", F.col("doc_id").alias("least")).join(best, "least", "left")
    rows = named.select("doc_id", "key").join(leasts, "key")
    copy = F.col("doc_id") > F.col("least")
    rows = rows.select(
        "doc_id",
        "key",
        F.when(copy, F.col("least")).otherwise(F.col("near_id")).alias("near_id"),
        F.when(copy, F.lit(1.0)).otherwise(F.col("near_likeness")).alias("near_likeness"),
    )
    return rows.where("near_id is not null").distinct()


def near_documents(prints: DataFrame, like: float = LIKE) -> DataFrame:
    """(doc_id, near_id, likeness): the nearest earlier document of (doc_id, fingerprint) rows.

    Nearest of those whose bands meet and whose likeness is at least ``like``: the most alike, then
    the smallest id. Documents without an earlier one have no row. Copies meet as one text.
    """
    rows = prints.select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint")
    codes = staged(rows.mapInArrow(_packed, "doc_id bigint, key bigint, code binary"), "codes")
    return near_of_codes(codes, like).select("doc_id", "near_id", F.col("near_likeness").alias("likeness"))
