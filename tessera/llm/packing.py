"""Packing of token ids into windows by minimum bin slack.

A document's whole windows become sequences of their own; its remainder is an item. The items
of a group of documents are a multiset of lengths. Each window takes the longest item left and
the multiset whose sum comes closest to what is free: a bitset holds the sums that can be
reached, length after length, and the counts are traced back through the bitsets. If no
multiset fills the window, the next longest item is cut and its head fills it. The group's last
ids, fewer than a window, become sequences whose lengths are powers of two: no id of padding.

Null texts are empty and give the end id alone. Rows that share a doc_id are packed each by
itself. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens, util


def closest(counts: list[int], lengths: list[int], free: int) -> list[tuple[int, int]]:
    """(length, how many) whose sum comes closest to free; lengths descend."""
    full, goal = (1 << (free + 1)) - 1, 1 << free
    reach, trail = 1, []
    for length in lengths:
        if length > free or not counts[length]:
            continue
        before, left, size = reach, min(counts[length], free // length), 1
        while left:
            take = min(size, left)
            reach = (reach | reach << (take * length)) & full
            left, size = left - take, size * 2
        trail.append((length, before))
        if reach & goal:
            break
    at, picked = reach.bit_length() - 1, []
    for length, before in reversed(trail):
        n = 0
        while not before >> at & 1:
            at, n = at - length, n + 1
        if n:
            picked.append((length, n))
    return picked


def pack(lengths: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the item, length, sequence, offset): every id of every item once."""
    out: list[tuple[int, int, int, int, int]] = []
    items: dict[int, list[tuple[int, int]]] = {}
    counts = [0] * (window + 1)
    n = 0
    for i, length in enumerate(lengths):
        for start in range(0, length - window + 1, window):
            out.append((i, start, window, n, 0))
            n += 1
        if rest := length % window:
            items.setdefault(rest, []).append((i, length - rest))
            counts[rest] += 1
    total = sum(a * b for a, b in enumerate(counts))
    order = sorted(items, reverse=True)

    def take(length: int, part: int, at: int) -> int:
        """Puts the first part ids of an item so long at the place at; what is left is an item."""
        nonlocal order
        i, start = items[length].pop()
        counts[length] -= 1
        out.append((i, start, part, n, at))
        if rest := length - part:
            items.setdefault(rest, []).append((i, start + part))
            counts[rest] += 1
            if rest not in order:
                order = sorted({*order, rest}, reverse=True)
        return at + part

    while total >= window:
        order = [x for x in order if counts[x]]
        at = take(order[0], order[0], 0)
        for length, k in closest(counts, order, window - at):
            for _ in range(k):
                at = take(length, length, at)
        while at < window:
            longest = next(x for x in order if counts[x])
            at = take(longest, min(longest, window - at), at)
        total -= window
        n += 1
    while total:
        size = 1 << (total.bit_length() - 1)
        at = 0
        while at < size:
            longest = next(x for x in sorted(items, reverse=True) if counts[x])
            at = take(longest, min(longest, size - at), at)
        total -= size
        n += 1
    return out


def packed(docs: DataFrame, *, tokenizer: str | None = None, end: int = 0, window: int = 1024, group_tokens: int = 1 << 22, with_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text). A task packs its own documents in groups of about so many ids: nothing is shuffled."""
    import pyarrow as pa

    tokenizer = tokenizer or tokens.default_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pieces(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        coder, last = tokens.encoder(tokenizer), np.array([end], "<u4").tobytes()
        held: list[tuple[int, bytes]] = []
        size = 0

        def out():
            nonlocal base, held, size
            rows = pack([len(x) // 4 for _, x in held], window)
            cut = [held[i][1][4 * a : 4 * (a + k)] for i, a, k, _, _ in rows]
            columns = [pa.array([held[r[0]][0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array([len(held[r[0]][1]) // 4 for r in rows], pa.int64()), pa.array([base + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())]
            if with_ids:
                columns.append(pa.array(cut, pa.binary()))
            base += max((r[3] for r in rows), default=-1) + 1
            held, size = [], 0
            whole = pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)
            return [whole.slice(a, 20_000) for a in range(0, whole.num_rows, 20_000)]

        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), coder.ids(batch.column(1).to_pylist())):
                held.append((d, ids + last))
                size += len(ids) // 4 + 1
                if size >= group_tokens:
                    yield from out()
        if held:
            yield from out()

    util.settle(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(pieces, ", ".join(f"{x} long" for x in names) + ", ids binary" * with_ids)


def op5(spark, sf_dir: str) -> DataFrame:
    return packed(util.documents(spark, sf_dir))
