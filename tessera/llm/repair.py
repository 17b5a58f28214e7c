"""Token-id files compressed by a Re-Pair grammar.

A block holds whole documents in ascending doc_id order. Frequent adjacent id pairs are replaced
by nonterminals, round after round, until no pair occurs twice in the block; a
document's end id is part of its last symbol only, so no rule spans two documents. A block
stores the symbols, the rules, the length to which each rule expands and, for each document,
the place of its first symbol: one document, or any range of its ids, is decoded without the rest.

Empty or null texts are documents with the end id alone. Rows that share a doc_id are kept, each
as a document of its own, in order of their text's hash. An empty table gives no block. Other
columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens, util

_SLOTS = 1 << 16
#: blocks are large: a row group, and so what a reader holds at once, ends after a few of them
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}
BLOCK = "block_of int, block int, doc_ids array<bigint>, firsts array<int>, symbols binary, rules binary, lengths binary, n_tokens long"


def compress(ids: np.ndarray, firsts: np.ndarray, terminals: int, rounds: int | None, least: int):
    """(symbols, firsts, rules, lengths): rules[i] is what symbol terminals + i stands for.

    Each round counts adjacent pairs, takes the most frequent ones (a pair whose slot in the
    round's hash table is taken waits for the next round) and replaces their occurrences from
    left to right without overlap. A pair can only be new, or have waited, where it holds a symbol
    of the round before or has a waiting pair's slot: after the first round only such pairs are
    counted. Without a number of rounds it goes on until no pair occurs least times.
    """
    s, firsts = ids.astype(np.uint32), firsts.astype(np.int64)
    rules: list[np.ndarray] = []
    n_rules, base, waiting = 0, 0, np.zeros(_SLOTS, bool)
    mult, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(48)
    for _ in range(len(s) if rounds is None else rounds):  # each round shortens s
        if len(s) < 2:
            break
        keys = (s[:-1].astype(np.uint64) << np.uint64(32)) | s[1:]
        keys[firsts[1:] - 1] = 0  # a pair across documents; the pair (0, 0) is never replaced either
        slot = ((keys * mult) >> shift).astype(np.int64)
        new = s >= base
        place = np.flatnonzero((new[:-1] | new[1:] | waiting[slot]) & (keys != 0))
        keys, slot = keys[place], slot[place]
        order = np.sort(keys)
        head = np.flatnonzero(np.append(True, order[1:] != order[:-1])) if len(order) else np.zeros(0, np.int64)
        found, counts = order[head], np.diff(np.append(head, len(order)))
        found, counts = found[counts >= least], counts[counts >= least]
        if not len(found):
            break
        found = found[np.argsort(-counts, kind="stable")]
        home = ((found * mult) >> shift).astype(np.int64)
        _, pick = np.unique(home[: _SLOTS // 8], return_index=True)
        pick.sort()
        waiting[:] = False
        waiting[np.delete(home, pick)] = True
        chosen, home = found[pick], home[pick]
        table, symbol = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint32)
        table[home] = chosen
        base = terminals + n_rules
        symbol[home] = np.arange(base, base + len(chosen), dtype=np.uint32)
        hit = np.flatnonzero(table[slot] == keys)
        where, slot = place[hit], slot[hit]
        run = np.flatnonzero(np.diff(where, prepend=-2) != 1)
        within = np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))
        even = np.flatnonzero(within & 1 == 0)
        where, slot = where[even], slot[even]
        s[where] = symbol[slot]
        left = np.ones(len(s), bool)
        left[where + 1] = False
        firsts = firsts - np.searchsorted(where + 1, firsts)
        s = s[np.flatnonzero(left)]
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype("<u4"))
        n_rules += len(chosen)
    return s.astype("<u4"), firsts, np.concatenate([np.zeros((0, 2), "<u4"), *rules]), _lengths(rules, terminals)


def _lengths(rounds: list[np.ndarray], terminals: int) -> np.ndarray:
    """How many ids each rule stands for; the rules of a round hold symbols of earlier ones only."""
    known = np.zeros(sum(map(len, rounds)), "<u4")
    n = 0
    for pair in rounds:
        inner = pair.astype(np.int64) - terminals
        known[n : n + len(pair)] = np.where(inner < 0, 1, known[np.maximum(inner, 0)]).sum(axis=1)
        n += len(pair)
    return known


def widths(symbols: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    inner = symbols.astype(np.int64) - terminals
    return np.where(inner < 0, 1, lengths[np.maximum(inner, 0)].astype(np.int64)) if len(lengths) else np.ones(len(symbols), np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """The ids for which any slice of symbols stands: each nonterminal's place is known, so a step touches those that are left only."""
    wide = widths(symbols, lengths, terminals)
    at = np.cumsum(wide) - wide
    out = np.empty(int(wide.sum()), "<u4")
    s = symbols
    while len(s):
        big = s >= terminals
        out[at[~big]] = s[~big]
        at, inner = at[big], s[big].astype(np.int64) - terminals
        left, right = rules[inner, 0], rules[inner, 1]
        s, at = np.concatenate([left, right]), np.concatenate([at, at + widths(left, lengths, terminals)])
    return out


def decode(block: dict, k: int, start: int = 0, stop: int | None = None, terminals: int = 1 << 17) -> np.ndarray:
    """The ids start to stop of the k-th document of a block, without the others: symbols outside are never expanded."""
    symbols, lengths = np.frombuffer(block["symbols"], "<u4"), np.frombuffer(block["lengths"], "<u4")
    firsts = [*block["firsts"], len(symbols)]
    symbols = symbols[firsts[k] : firsts[k + 1]]
    ends = np.cumsum(widths(symbols, lengths, terminals))
    total = int(ends[-1]) if len(ends) else 0
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.zeros(0, "<u4")
    a, z = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    ahead = int(ends[a - 1]) if a else 0
    return expand(symbols[a:z], np.frombuffer(block["rules"], "<u4").reshape(-1, 2), lengths, terminals)[start - ahead : stop - ahead]


def write(docs: DataFrame, path: str, *, tokenizer: str | None = None, end: int = 0, block_tokens: int = 1 << 20, rounds: int | None = None, least: int = 2, terminals: int = 1 << 17) -> None:
    """Writes the id files of docs(doc_id, text), ascending by doc_id, in the folder path."""
    import pyarrow as pa

    tokenizer = tokenizer or tokens.default_path()

    def blocks(batches):
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        coder = tokens.encoder(tokenizer)
        last = np.array([end], "<u4").tobytes()

        def out():
            nonlocal n, held, size
            counts = np.array([len(x) // 4 for _, x in held], np.int64)
            s, firsts, rules, lengths = compress(np.frombuffer(b"".join(x for _, x in held), "<u4"), np.cumsum(counts) - counts, terminals, rounds, least)
            row = {"block_of": part, "block": n, "doc_ids": [d for d, _ in held], "firsts": firsts.tolist(), "symbols": s.tobytes(), "rules": rules.tobytes(), "lengths": lengths.tobytes(), "n_tokens": int(counts.sum())}
            n, held, size = n + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("block_of", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32())), ("symbols", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("n_tokens", pa.int64())])
        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), coder.ids(batch.column(1))):
                held.append((d, ids + last))
                size += len(ids) // 4 + 1
                if size >= block_tokens:
                    yield out()
        if held:
            yield out()

    util.settle(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    own.repartitionByRange(util.parts(docs), *order).sortWithinPartitions(*order).mapInArrow(blocks, BLOCK).write.options(**SMALL_GROUPS).parquet(path)


def read(spark, path: str, *, terminals: int = 1 << 17) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids (its end id included)."""
    return _documents(spark, path, terminals, True)


def digests(spark, path: str, *, terminals: int = 1 << 17) -> DataFrame:
    """As read(), with the crc32 of the ids in place of the ids."""
    return _documents(spark, path, terminals, False)


def _documents(spark, path: str, terminals: int, whole: bool) -> DataFrame:
    import pyarrow as pa

    kind = ("ids", pa.list_(pa.int64())) if whole else ("ids_crc32", pa.int64())

    def docs(batches):
        for batch in batches:
            for b in batch.to_pylist():
                symbols, rules = np.frombuffer(b["symbols"], "<u4"), np.frombuffer(b["rules"], "<u4").reshape(-1, 2)
                lengths = np.frombuffer(b["lengths"], "<u4")
                width = widths(symbols, lengths, terminals)
                begins = (np.cumsum(width) - width)[np.array(b["firsts"], np.int64)]
                ids = expand(symbols, rules, lengths, terminals)
                ends = [*begins[1:].tolist(), len(ids)]
                raw = ids.tobytes()
                rows = [ids[a:z] if whole else zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([pa.array([b["block_of"]] * len(rows), pa.int32()), pa.array([b["block"]] * len(rows), pa.int32()), pa.array(b["doc_ids"], pa.int64()), pa.array(begins, pa.int64()), pa.array(np.array(ends) - begins, pa.int64()), pa.array(rows, kind[1])], names=["block_of", "block", "doc_id", "within", "n_tokens", kind[0]])

    files = spark.read.schema(BLOCK).parquet(path)
    # ids before each file of a range, then before each block of it: the files are as many as the partitions
    sizes = files.groupBy("block_of", "block").agg(F.sum("n_tokens").alias("n"))
    ranges = sizes.groupBy("block_of").agg(F.sum("n").alias("n"))
    ahead = ranges.select("block_of", (F.sum("n").over(Window.orderBy("block_of")) - F.col("n")).alias("ahead"))
    inside = Window.partitionBy("block_of").orderBy("block")
    starts = sizes.withColumn("inside", F.sum("n").over(inside) - F.col("n")).join(ahead, "block_of").select("block_of", "block", (F.col("inside") + F.col("ahead")).alias("before"))
    made = files.mapInArrow(docs, f"block_of int, block int, doc_id long, within long, n_tokens long, {kind[0]} {'array<bigint>' if whole else 'bigint'}")
    return made.join(starts, ["block_of", "block"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", kind[0])


def op2(spark, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{util.shared_dir(spark).rstrip('/')}/tessera-ids-{uuid.uuid4().hex}"
    write(util.documents(spark, sf_dir), path)
    return util.result(digests(spark, path), path)
