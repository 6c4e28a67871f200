"""Suffix-array dedup: bytes in a string of ``LENGTH`` bytes that starts anywhere else go.

Suffixes are sorted where they can matter: at the anchors that ``repeats`` leaves open, grouped by
the gram they start with. Sorting is deep-shallow: multikey quicksort down to a shallow depth, then
a blind trie for each group whose members still agree. Sorted both ways from the anchor (suffixes
to the right, reversed prefixes to the left), longest common prefixes of neighbours tell which
windows over the anchor are equal.

Defined results: a null text is empty. Matches don't cross texts; repeated rows match each other.
The bytes kept are those of the UTF-8 text; ``clean`` drops the rest of a character that a removal
cuts, and documents of which no word is left. Extra columns are carried.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.hashing import BYTE
from nearfield.llm.repeats import Batch, Member, Method, without_repeats

LENGTH = 400
GRAM = 64
SHALLOW = 32


def common(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the common prefix, known to be at least ``low``."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class _Node:
    __slots__ = ("depth", "children", "leaf")

    def __init__(self, depth: int, leaf: int = -1):
        self.depth, self.leaf = depth, leaf
        self.children: dict[int, _Node] = {}


def blind_trie(strings: list[bytes], members: list[int], depth: int) -> list[int]:
    """``members`` in the order of their strings, which agree up to ``depth``.

    Inner nodes hold only the depth at which strings part and a child per byte there (-1: ended).
    An insertion goes down blindly, compares once with the leaf it reaches, and hangs its string
    in where the two really part. Equal strings share a leaf.
    """
    at = lambda s, d: s[d] if d < len(s) else -1
    root = _Node(0, members[0])
    same: dict[int, list[int]] = {members[0]: [members[0]]}
    for m in members[1:]:
        s, node = strings[m], root
        while node.leaf < 0:
            node = node.children.get(at(s, node.depth)) or next(iter(node.children.values()))
        other = strings[node.leaf]
        part = common(s, other, depth)
        if part == len(s) == len(other):
            same[node.leaf].append(m)
            continue
        same[m] = [m]
        parent, node = None, root
        while node.leaf < 0 and node.depth < part:
            parent, node = node, node.children[at(s, node.depth)]
        leaf = _Node(0, m)
        if node.leaf < 0 and node.depth == part:
            node.children[at(s, part)] = leaf
            continue
        branch = _Node(part)
        branch.children = {at(other, part): node, at(s, part): leaf}
        if parent is None:
            root = branch
        else:
            parent.children[at(s, parent.depth)] = branch
    ordered: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.leaf >= 0:
            ordered += same[node.leaf]
        else:
            stack += [node.children[c] for c in sorted(node.children, reverse=True)]
    return ordered


def deep_shallow(strings: list[bytes], members: list[int], depth: int, shallow: int) -> list[int]:
    """``members`` in the order of their strings, which agree up to ``depth``.

    Multikey quicksort by eight bytes at a time down to ``shallow``, blind tries below.
    """
    if len(members) < 2:
        return members
    if depth >= shallow:
        return blind_trie(strings, members, depth)
    keys = {m: strings[m][depth : depth + 8] for m in members}
    pivot = sorted(keys.values())[len(members) // 2]
    less = [m for m in members if keys[m] < pivot]
    same = [m for m in members if keys[m] == pivot]
    more = [m for m in members if keys[m] > pivot]
    if len(pivot) == 8:
        same = deep_shallow(strings, same, depth + 8, shallow)
    return deep_shallow(strings, less, depth, shallow) + same + deep_shallow(strings, more, depth, shallow)


def suffix_order(strings: list[bytes], depth: int) -> tuple[list[int], np.ndarray]:
    """Order of the strings, and the longest common prefix of each with the one before it."""
    order = deep_shallow(strings, list(range(len(strings))), depth, depth + SHALLOW)
    return order, np.array([0, *(common(strings[a], strings[b], depth) for a, b in zip(order, order[1:]))])


def shared_windows(group: list[Member], length: int, gram: int) -> Iterator[tuple[Member, np.ndarray]]:
    """Windows of the classes of one gram that another class has too.

    A window that starts d bytes before the anchor equals another's if both agree on d bytes to
    the left and length - d to the right. Both orders fall into runs that agree that far; the runs
    change only where d passes a common prefix, so each stretch of d is looked at once.
    """
    right = [m.context[m.before :] for m in group]
    left = [m.context[: m.before][::-1] for m in group]
    right_order, right_common = suffix_order(right, gram)
    left_order, left_common = suffix_order(left, 0)
    last = np.array([m.before for m in group])
    first = last - np.array([m.windows for m in group]) + 1
    stops = np.unique(np.concatenate([first, last + 1, length - right_common[1:], left_common[1:] + 1]))
    stops = stops[(stops >= first.min()) & (stops <= last.max() + 1)]
    shared = [np.zeros(m.windows, bool) for m in group]
    right_run, left_run = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    for d, end in zip(stops.tolist(), stops[1:].tolist()):
        right_run[right_order] = np.cumsum(right_common < length - d)
        left_run[left_order] = np.cumsum(left_common < d)
        inside = np.flatnonzero((first <= d) & (d <= last))
        runs, count = np.unique(right_run[inside] * len(group) * 2 + left_run[inside], return_inverse=True, return_counts=True)[1:]
        for i in inside[count[runs] > 1].tolist():
            # Window k of a class starts last - k bytes before its anchor.
            shared[i][last[i] - end + 1 : last[i] - d + 1] = True
    for member, windows in zip(group, shared):
        if member.total == 1:
            yield member, windows


def _resolve(groups: list[list[Member]], length: int, gram: int) -> Iterator[tuple[Member, np.ndarray]]:
    for group in groups:
        if len(group) > 1:
            yield from shared_windows(group, length, gram)


def _units(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return BYTE[np.frombuffer(data, np.uint8)], starts, starts + lengths


def method(length: int = LENGTH, gram: int = GRAM) -> Method:
    return Method(length, gram, 1, _units, functools.partial(_resolve, length=length, gram=gram), False)


def _digest(b: Batch, gone: np.ndarray, k: int) -> list:
    raw, out = b.data[b.lows[k] : b.highs[k]], gone[b.lows[k] : b.highs[k]]
    removed = int(out.sum())
    spans = int((out[1:] & ~out[:-1]).sum() + out[0]) if removed else 0
    kept = np.frombuffer(raw, np.uint8)[~out].tobytes() if removed else raw
    return [len(raw), removed, spans, hashlib.sha256(kept).hexdigest()]


def _kept(b: Batch, gone: np.ndarray, k: int) -> list:
    raw, out = b.data[b.lows[k] : b.highs[k]], gone[b.lows[k] : b.highs[k]]
    return [np.frombuffer(raw, np.uint8)[~out].tobytes().decode("utf-8", "ignore") if out.any() else raw.decode()]


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    fields = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return without_repeats(docs, method(length, gram), _digest, fields, types)


def clean(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents without their repeated strings; ``n_chars`` follows the text."""
    kept = without_repeats(docs, method(length, gram), _kept, "kept string", [pa.string()])
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return kept.where(F.col("kept").rlike(r"[^\x20\x09-\x0D]")).select(row.alias("row")).select("row.*")
