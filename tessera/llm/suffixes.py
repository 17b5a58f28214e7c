"""Repeated byte strings by column-wise construction of a collection's suffix order.

Which bytes repeat. A byte of a document is removed if a string of ``length`` bytes that covers
it also starts in a document with a smaller doc_id. Exact copies need no search: every byte of
the later ones goes if they are that long. For the distinct texts:

1. Each window of ``length`` bytes is named by the least hash among its k-grams. Equal windows
   have equal names, so only windows whose name occurs in two texts can repeat.
2. Runs of windows with one such name are cut out as strings and dealt by name, equal strings of
   a chunk of texts once with their least doc_id. All equal windows meet in one group. A name
   in more than ``hot`` texts is dealt further, window by window: each gets a name from all of
   its bytes, as first bytes inside a common passage would all be the same.
3. In a group, runs of windows whose hash occurs twice are what may repeat; equal runs are one
   string. The strings of names that still have several are inserted column by column, from
   their ends: in each round every string gives one symbol. The rows of the transform and their
   common prefixes are read in blocks, from the first to the last, to count the ranks of the new
   suffixes, and once more to write them between the others. Beyond ``in_memory`` rows they
   lie in files in the shared folder; a round holds a block and some numbers for each string.
4. Suffixes with a common prefix of ``length`` or more are one class; its least doc_id goes back
   to the texts, where the windows' bytes are removed.

Null texts are empty; rows without a doc_id neither remove nor lose bytes; rows that share text
and doc_id are judged alike. Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import util
from tessera.llm.minhash import mix

K = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SHIFT = np.uint32(15)
_RANDOM = mix(np.arange(1, 321, dtype=np.uint64) * np.uint64(_BASE))
_BYTES = (_RANDOM[:256] >> np.uint64(32)).astype(np.uint32)
_DOUBLE, _TAIL = ((_RANDOM[a : a + 32] >> np.uint64(32)).astype(np.uint32) | np.uint32(1) for a in (256, 288))


class Names:
    """The least k-gram hash of every window of a byte array."""

    def __init__(self, length: int, block: int = 1 << 19):
        self.length, self.block = length, block
        self.k = min(K, length)
        self.width = length - self.k + 1
        powers = np.full(block + length + 1, _BASE, np.uint64)
        powers[0] = 1
        self.up = np.multiply.accumulate(powers)
        inverse = np.full(block + length + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.down = np.multiply.accumulate(inverse)

    def windows(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - self.length + 1
        if n <= 0:
            return np.zeros(0, np.uint32)
        return np.concatenate([self._some(data[a : a + self.block + self.length - 1]) for a in range(0, n, self.block)])

    def prints(self, data: np.ndarray) -> np.ndarray:
        """A hash of all bytes of every window."""
        n = max(0, len(data) - self.length + 1)
        return np.concatenate([np.zeros(0, np.uint64), *(mix(self._grams(data[a : a + self.block + self.length - 1], self.length)) for a in range(0, n, self.block))])

    def _grams(self, data: np.ndarray, k: int) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        return (total[k:] - total[:-k]) * self.down[: len(data) - k + 1]

    def _some(self, data: np.ndarray) -> np.ndarray:
        # hashes of 1, 2, 4 ... bytes: two neighbours of one width make one of twice the width
        h, have, rest, n = _BYTES[data], 1, None, 0
        for bit in range(self.k.bit_length()):
            if self.k >> bit & 1:
                rest, n = (h, have) if rest is None else (rest[: len(h) - n] * _TAIL[bit] + h[n:] if n else h, n + have)
                rest ^= rest >> _SHIFT
            if have * 2 <= self.k:
                h = h[:-have] * _DOUBLE[bit] + h[have:]
                h ^= h >> _SHIFT
                have *= 2
        low = rest[: len(data) - self.k + 1] * _TAIL[31]
        low ^= low >> _SHIFT
        low *= _DOUBLE[31]
        done = 1
        while done * 2 <= self.width:
            low = np.minimum(low[:-done], low[done:])
            done *= 2
        if more := self.width - done:
            low = np.minimum(low[: len(low) - more], low[more:])
        return low


def joined(texts: list[bytes], length: int):
    """The texts in a row, where each begins, and which windows lie inside one text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    inside = np.zeros(max(0, len(data) - length + 1) + 1, np.int32)
    long = sizes >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long] + sizes[long] - length + 1, -1)
    return data, starts, sizes, np.cumsum(inside[:-1]) > 0


def names_of(coder: Names, texts: list[bytes]):
    """For each text its distinct names."""
    data, starts, sizes, inside = joined(texts, coder.length)
    low = coder.windows(data)
    step = np.ones(len(low), bool)
    step[1:] = low[1:] != low[:-1]
    step[starts[(starts < len(low)) & (sizes > 0)]] = True
    at = np.flatnonzero(step & inside)
    owner = np.searchsorted(starts, at, "right") - 1
    both = np.unique((owner.astype(np.uint64) << np.uint64(32)) | low[at].astype(np.uint64))
    cut = np.searchsorted(both >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))
    values = (both & np.uint64(0xFFFFFFFF)).astype("<u4")
    return [values[cut[i] : cut[i + 1]] for i in range(len(texts))]


def strings_of(coder: Names, texts: list[bytes], known: np.ndarray, hot: np.ndarray):
    """Runs of windows with a name in known: (data, starts, begin, windows, name). known holds text << 32 | name, in order.

    Names in hot give single windows, named by the checksum of all their bytes.
    """
    data, starts, _, inside = joined(texts, coder.length)
    low = coder.windows(data)
    if not len(low):
        none = np.zeros(0, np.int64)
        return data, starts, none, none, none.astype(np.uint32)
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
    new[starts[starts < len(low)]] = True
    at = np.flatnonzero(new)
    windows = np.diff(np.append(at, len(low)))
    owner = np.searchsorted(starts, at, "right") - 1
    key = (owner.astype(np.uint64) << np.uint64(32)) | low[at].astype(np.uint64)
    found = np.searchsorted(known, key)
    good = inside[at] & (found < len(known))
    good[good] = known[found[good]] == key[good]
    # a name that recurs in periodic text gives long runs: strings stay short, so the rounds stay few
    at, windows, name = at[good], windows[good], low[at[good]]
    single = np.isin(name, hot)
    wide = np.where(single, 1, coder.width)
    cuts = -(-windows // wide)
    nth = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    wide = np.repeat(wide, cuts)
    begin = np.repeat(at, cuts) + nth * wide
    windows = np.minimum(np.repeat(windows, cuts) - nth * wide, wide)
    name = np.repeat(name, cuts)
    if single.any():
        some = np.flatnonzero(np.repeat(single, cuts))
        name[some] = [zlib.crc32(data[a : a + coder.length]) for a in begin[some].tolist()]
    return data, starts, begin, windows, name


class Store:
    """Rows of the transform, read in blocks from the first to the last while the next state is written.

    A row is a symbol, the common prefix with the row before and a window's number (or -1). Up
    to ``limit`` rows lie in memory, more in files of ``folder``, a path that pyarrow opens.
    """

    KINDS = [("symbol", "u1"), ("prefix", "<u2"), ("window", "<i4")]

    def __init__(self, limit: int, block: int, folder: str | None):
        self.limit, self.block, self.folder = limit, block, folder
        self.files = self.base = None
        self.n, self.turns, self.held, self.at = 0, 0, [], None

    def _path(self, turn: int, name: str) -> str:
        return f"{self.base}-{turn % 2}-{name}"

    def write(self, rows: int, blocks) -> None:
        """The next state has so many rows, which blocks yields as triples of arrays."""
        if rows <= self.limit or self.folder is None:
            self.held, self.at = [x for x in blocks], None
        else:
            if self.files is None:
                import uuid

                from pyarrow import fs

                self.files, root = fs.FileSystem.from_uri(self.folder)
                self.base = f"{root.rstrip('/')}/tessera-rows-{uuid.uuid4().hex}"
            turn = self.turns + 1
            outs = [self.files.open_output_stream(self._path(turn, name)) for name, _ in self.KINDS]
            try:
                for x in blocks:
                    for out, part, (_, kind) in zip(outs, x, self.KINDS):
                        out.write(part.astype(kind, copy=False).data)
            finally:
                for out in outs:
                    out.close()
            self.held, self.at, self.turns = [], turn, turn
        self.n = rows

    def read(self):
        if self.at is None:
            yield from self.held
            return
        ins = [self.files.open_input_stream(self._path(self.at, name)) for name, _ in self.KINDS]
        try:
            for a in range(0, self.n, self.block):
                n = min(self.block, self.n - a)
                yield tuple(np.frombuffer(x.read(n * np.dtype(kind).itemsize), kind) for x, (_, kind) in zip(ins, self.KINDS))
        finally:
            for x in ins:
                x.close()

    def drop(self) -> None:
        for turn in range(2 if self.files is not None else 0):
            for name, _ in self.KINDS:
                path = self._path(turn, name)
                if self.files.get_file_info(path).is_file:
                    self.files.delete_file(path)


def column_wise(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int, in_memory: int = 1 << 24, folder: str | None = None, block: int = 1 << 18) -> Store:
    """The transform of the strings' suffixes: ends first, in the strings' order, symbol 0 before a whole string.

    flat holds symbols of at least 1. After round j all suffixes of up to j symbols are in
    their places. A round reads the rows twice, from the first to the last: for the ranks and
    common prefixes of the suffixes that are new, and to write them between the others. What it
    holds besides a block is a few numbers for each string and each symbol.
    """
    m = len(begin)
    end = begin + size
    windows = np.maximum(size - length + 1, 0)
    first = np.cumsum(windows) - windows
    store = Store(in_memory, block, folder)
    last = np.where(size > 0, flat[np.maximum(end - 1, 0)], 0).astype(np.uint8)
    store.write(m, ((last[a : a + block], np.zeros(len(last[a : a + block]), np.uint16), np.full(len(last[a : a + block]), -1, np.int32)) for a in range(0, m, block)))
    total = np.bincount(last, minlength=256)
    who = np.flatnonzero(size > 0)
    place = who.copy()
    for j in range(1, int(size.max(initial=0)) + 1):
        total[0] = 0
        at, common, string = _ranks(store, place, who, m + np.cumsum(total) - total)
        order = np.argsort(at)
        at, common, string = at[order], common[order], string[order]
        fresh = string >= 0
        place, who, low = at[fresh], string[fresh], common[fresh]
        symbol = np.where(size[who] > j, flat[np.maximum(end[who] - j - 1, 0)], 0).astype(np.uint8)
        window = np.where(j >= length, first[who] + size[who] - j, -1).astype(np.int32)
        old = Store(0, block, None)
        old.__dict__.update(store.__dict__)
        store.write(old.n + len(place), _merged(old, place, symbol, low, window, at[~fresh], common[~fresh]))
        total += np.bincount(symbol, minlength=256)
        live = size[who] > j
        place, who = place[live], who[live]
    return store


def _ranks(store: Store, place: np.ndarray, who: np.ndarray, start: np.ndarray):
    """(place, common prefix, string or -1) of the new suffixes and of those that follow one, from the rows so far.

    place (ascending) holds the rows whose symbols are inserted, start each symbol's first place.
    The suffix that a row's symbol begins ranks after those of the symbol's earlier rows; its
    common prefix with the one before is one more than the least prefix since that row.
    """
    met, least, new = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, bool)
    out, base = [], 0
    for symbols, prefix, _ in store.read():
        n = len(symbols)
        lo, hi = np.searchsorted(place, [base, base + n])
        string = np.full(n, -1, np.int64)
        string[place[lo:hi] - base] = who[lo:hi]
        order = np.argsort(symbols, kind="stable")
        counts = np.bincount(symbols, minlength=256)
        order = order[counts[0] :]
        counts[0] = 0
        present = np.flatnonzero(counts)
        heads = (np.cumsum(counts) - counts)[present]
        tails = heads + counts[present] - 1
        fresh = string[order] >= 0
        asked = fresh.copy()
        asked[1:] |= fresh[:-1]
        asked[heads] = fresh[heads] | new[present]
        ask = np.flatnonzero(asked)
        s = symbols[order[ask]]
        rank = start[s] + met[s] + ask - (np.cumsum(counts) - counts)[s]
        common = np.zeros(len(ask), np.int64)
        opens = np.zeros(len(order) + 1, bool)
        opens[heads] = True
        inner = ~opens[ask]
        common[inner] = 1 + _range_min(prefix, order[ask[inner] - 1] + 1, order[ask[inner]] + 1)
        if not inner.all():
            reach = np.minimum.accumulate(prefix)[order[ask[~inner]]]
            c = s[~inner]
            common[~inner] = np.where(met[c] > 0, 1 + np.minimum(least[c], reach), 0)
        out.append((rank, common, string[order[ask]]))
        least = np.minimum(least, int(prefix.min(initial=65535)))
        since = np.append(np.minimum.accumulate(prefix[::-1])[::-1].astype(np.int64), 1 << 16)
        least[present] = since[order[tails] + 1]
        new[present] = fresh[tails]
        met += counts
        base += n
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _merged(old: Store, place, symbol, low, window, changed, common):
    """The rows with new ones at their places, and with changed common prefixes."""
    before = place - np.arange(len(place))  # rows ahead of each
    base = 0
    for symbols, prefix, windows in old.read():
        n = len(symbols)
        lo = np.searchsorted(before, base)
        hi = len(place) if base + n == old.n else np.searchsorted(before, base + n)
        a = base + lo
        rows = n + int(hi - lo)
        put = place[lo:hi] - a
        stay = np.ones(rows, bool)
        stay[put] = False
        made = []
        for x, y in ((symbols, symbol), (prefix, low), (windows, window)):
            z = np.empty(rows, x.dtype)
            z[stay], z[put] = x, y[lo:hi]
            made.append(z)
        c, d = np.searchsorted(changed, [a, a + rows])
        made[1][changed[c:d] - a] = common[c:d]
        for x in range(0, rows, old.block):
            yield tuple(y[x : x + old.block] for y in made)
        base += n


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) for each pair, from minima over doubled spans."""
    out = np.empty(len(lo), values.dtype)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    by = np.argsort(level.astype(np.uint8), kind="stable")
    bounds = np.searchsorted(level[by], np.arange(int(level.max(initial=-1)) + 2))
    span = values
    for k in range(len(bounds) - 1):
        if k:
            half = 1 << (k - 1)
            span = np.minimum(span[:-half], span[half:])
        some = by[bounds[k] : bounds[k + 1]]
        if len(some):
            out[some] = np.minimum(span[lo[some]], span[hi[some] - (1 << k)])
    return out


def least_owner(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int, in_memory: int = 1 << 24, folder: str | None = None, block: int = 1 << 18) -> np.ndarray:
    """For every window of every string, in order, the least owner of a string that holds it."""
    windows = np.maximum(size - length + 1, 0)
    of = np.repeat(owner, windows)
    kind = np.zeros(len(of), np.int64)
    store = column_wise(flat, begin, size, length, in_memory, folder, block)
    try:
        least, n = [np.full(1, np.iinfo(np.int64).max)], 0
        for _, prefix, window in store.read():
            head = prefix < length  # a class goes on over the end of a block
            some = window >= 0
            mine = n + np.cumsum(head)[some]
            kind[window[some]] = mine
            made = np.full(int(head.sum()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(made, mine - n, of[window[some]])
            least[-1][-1] = min(least[-1][-1], made[0])
            least.append(made[1:]) if len(made) > 1 else None
            n += len(made) - 1
    finally:
        store.drop()
    return np.concatenate(least)[kind]


def repeated_parts(strings: list[bytes], coder: Names):
    """(parts, string, start in it, windows) for the runs of windows whose bytes may be in two places: a candidate search by 64-bit hashes."""
    data, starts, _, inside = joined(strings, coder.length)
    prints = coder.prints(data)
    at = np.flatnonzero(inside)
    order = np.argsort(prints[at], kind="stable")
    s = prints[at][order]
    twin = np.zeros(len(s) + 1, bool)
    twin[1:-1] = s[1:] == s[:-1]
    good = np.zeros(len(inside) + 1, bool)
    good[at[order]] = twin[:-1] | twin[1:]
    edge = np.diff(good[: len(inside)].astype(np.int8), prepend=0, append=0)
    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    string = np.searchsorted(starts, a, "right") - 1
    raw = data.tobytes()
    parts = [raw[x : y + coder.length - 1] for x, y in zip(a.tolist(), z.tolist())]
    return parts, string, a - starts[string], z - a


def _pack(**arrays) -> bytes:
    import pickle

    return pickle.dumps({k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in arrays.items()}, 5)


def _unpack(raw: bytes) -> dict:
    import pickle

    return pickle.loads(raw)


def _group(names: np.ndarray, groups: int) -> np.ndarray:
    """Names are least hashes, so most are small: they are mixed again before they are dealt."""
    x = names.astype(np.uint32) * _DOUBLE[0]
    x ^= x >> _SHIFT
    return (((x * _TAIL[0]).astype(np.uint64) * np.uint64(groups)) >> np.uint64(32)).astype(np.int32)


def _spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] of them, and so on."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _shared(names: np.ndarray) -> np.ndarray:
    """Where names occur that occur twice."""
    _, of, often = np.unique(names, return_inverse=True, return_counts=True)
    return np.flatnonzero(often[of] > 1)


def _groups(batches, of: int):
    """Runs of rows with one value in a column, from batches in that column's order."""
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[of] != key and held:
                yield key, held
                held = []
            key = row[of]
            held.append(row)
    if held:
        yield key, held


def removals(docs: DataFrame, *, length: int = 50, chunk_mb: int = 3, in_memory: int = 1 << 24, hot: int = 1 << 14) -> tuple[DataFrame, DataFrame, list[str]]:
    """(sha, rep) of distinct texts; (rep, s, n_removed, n_spans, kept_sha256, kept) of those that lose bytes; the paths of both."""
    import pyarrow as pa

    if not 1 <= length <= 1 << 14:
        raise ValueError("strings have 1 to 16384 bytes")
    spark = util.settle(docs.sparkSession)
    own = _own(docs)
    folder = util.shared_dir(spark)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts, first_path = util.staged(own.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("rep")), "first")

    # rows that share both doc_id and text are one text; only if there are any are texts compared for it
    repeated_rows = own.where("doc_id IS NOT NULL").groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    once = lambda df: df.dropDuplicates(["sha"]) if repeated_rows else df

    # 1: names of each distinct text, in chunks of texts
    def named(batches):
        util.lean()
        coder = Names(length)
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            found = names_of(coder, texts)
            keep = [i for i, x in enumerate(found) if len(x)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array([found[i].tobytes() for i in keep], pa.binary())], names=["doc_id", "sha", "names"])

    names = own.where(F.octet_length("text") >= length).where("doc_id IS NOT NULL").select("doc_id", "sha", F.col("text").cast("binary")).mapInArrow(named, "doc_id long, sha binary, names binary")
    firsts_k = firsts.select(F.col("sha").alias("s"), "rep")
    names = names.join(firsts_k, (F.col("sha") == F.col("s")) & (F.col("doc_id") == F.col("rep"))).select("rep", "sha", "names")
    parts = max(shuffles, util.parts(docs, 8))
    # groups follow the data and not the partitions: each chunk sends a row to each group at most
    groups = max(parts, util.blocks(docs, 8) * 12)

    def chunked(batches):
        util.lean()
        from pyspark import TaskContext

        base, n, size, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def out():
            nonlocal n, size, held
            raw = _pack(shas=[s for _, s, _ in held], reps=[r for r, _, _ in held], counts=[len(x) // 4 for _, _, x in held])
            row = pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([raw], pa.binary()), pa.array([b"".join(x for _, _, x in held)], pa.binary())], names=["chunk", "who", "names"])
            n, size, held = n + 1, 0, []
            return row

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[2])
                if size >= chunk_mb << 18:  # a name stands for about sixteen bytes
                    yield out()
        if held:
            yield out()

    chunks, chunk_path = util.staged(once(names).mapInArrow(chunked, "chunk long, who binary, names binary"), "names")

    def dealt(batches):
        util.lean()
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(raw, "<u4")
                group = _group(values, groups)
                order = np.argsort(group, kind="stable")
                cut = np.flatnonzero(np.diff(group[order], prepend=-1))
                ends = [*cut[1:].tolist(), len(order)]
                yield pa.RecordBatch.from_arrays([pa.array(group[order][cut], pa.int32()), pa.array([chunk] * len(cut), pa.int64()), pa.array([values[order[a:z]].tobytes() for a, z in zip(cut.tolist(), ends)], pa.binary())], names=["grp", "chunk", "names"])

    def repeated(batches):
        util.lean()
        for group, rows in _groups(batches, 0):
            values = np.concatenate([np.frombuffer(x, "<u4") for _, _, x in rows])
            s = np.sort(values)
            twice = s[1:][s[1:] == s[:-1]]
            heads = np.flatnonzero(np.append(True, twice[1:] != twice[:-1])) if len(twice) else np.zeros(0, np.int64)
            often = np.diff(np.append(heads, len(twice))) + 1 > hot
            twice = twice[heads]
            at, marks = 0, []
            for _, _, x in rows:
                some = values[at : at + len(x) // 4]
                at += len(some)
                k = np.searchsorted(twice, some)
                hit = np.zeros(len(some), bool)
                ok = k < len(twice)
                hit[ok] = twice[k[ok]] == some[ok]
                many = np.zeros(len(some), bool)
                many[hit] = often[k[hit]]
                marks.append(np.packbits(hit).tobytes() + np.packbits(many).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([group] * len(rows), pa.int32()), pa.array(marks, pa.binary())], names=["chunk", "grp", "marks"])

    sent = chunks.select("chunk", "names").mapInArrow(dealt, "grp int, chunk long, names binary")
    marks = sent.repartition(parts, "grp").sortWithinPartitions("grp", "chunk").mapInArrow(repeated, "chunk long, grp int, marks binary")

    # 2: the texts with repeated names, and those names
    both = chunks.select("chunk", F.lit(-1).alias("grp"), "who", F.col("names").alias("raw")).unionByName(marks.select("chunk", "grp", F.lit(None).cast("binary").alias("who"), F.col("marks").alias("raw")))

    def resolved(batches):
        util.lean()
        for _, rows in _groups(batches, 0):
            who, values = _unpack(rows[0][2]), np.frombuffer(rows[0][3], "<u4")
            group = _group(values, groups)
            order = np.argsort(group, kind="stable")
            ranked = group[order]
            hit, many, at = np.zeros(len(values), bool), np.zeros(len(values), bool), 0
            for _, g, _, raw in rows[1:]:
                n = int(np.searchsorted(ranked, g, "right")) - at
                bits = np.frombuffer(raw, np.uint8).reshape(2, -1)
                hit[order[at : at + n]] = np.unpackbits(bits[0], count=n).astype(bool)
                many[order[at : at + n]] = np.unpackbits(bits[1], count=n).astype(bool)
                at += n
            ends = np.cumsum(who["counts"])
            shas, reps, some, often = [], [], [], []
            for i, (a, z) in enumerate(zip((ends - who["counts"]).tolist(), ends.tolist())):
                x = values[a:z][hit[a:z]]
                if len(x):
                    shas.append(who["shas"][i])
                    reps.append(who["reps"][i])
                    some.append(x.tobytes())
                    often.append(values[a:z][many[a:z]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(shas, pa.binary()), pa.array(some, pa.binary()), pa.array(often, pa.binary())], names=["rep", "s", "names", "hot"])

    wanted = both.repartition(parts, "chunk").sortWithinPartitions("chunk", "grp").mapInArrow(resolved, "rep long, s binary, names binary, hot binary")
    wanted, wanted_path = util.staged(wanted, "wanted")
    util.drop(spark, chunk_path)

    def gathered(batches):
        util.lean()
        from pyspark import TaskContext

        base, n, size, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def out():
            nonlocal n, size, held
            raw = _pack(reps=[r[0] for r in held], shas=[r[1] for r in held], names=[r[2] for r in held], hot=b"".join(r[3] for r in held), sizes=[len(r[4]) for r in held])
            row = pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([raw], pa.binary()), pa.array([b"".join(r[4] for r in held)], pa.binary())], names=["chunk", "who", "texts"])
            n, size, held = n + 1, 0, []
            return row

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[4])
                if size >= chunk_mb << 20:
                    yield out()
        if held:
            yield out()

    texts = own.join(wanted, (F.col("sha") == F.col("s")) & (F.col("doc_id") == F.col("rep"))).select("rep", "sha", "names", "hot", F.col("text").cast("binary").alias("text"))
    texts, text_path = util.staged(once(texts).mapInArrow(gathered, "chunk long, who binary, texts binary"), "texts")
    util.drop(spark, wanted_path)

    def opened(who: bytes, raw: bytes):
        """A chunk's strings: equal ones once, in the order of their groups."""
        who = _unpack(who)
        ends = np.cumsum(who["sizes"]).tolist()
        each = [raw[z - n : z] for z, n in zip(ends, who["sizes"])]
        known = np.concatenate([(np.uint64(i) << np.uint64(32)) | np.frombuffer(x, "<u4").astype(np.uint64) for i, x in enumerate(who["names"])])
        data, starts, begin, windows, name = strings_of(Names(length), each, known, np.unique(np.frombuffer(who["hot"], "<u4")))
        owner = np.searchsorted(starts, begin, "right") - 1
        reps = np.array(who["reps"], np.int64)[owner]
        index: dict = {}
        which = [index.setdefault(raw[a:z], len(index)) for a, z in zip(begin.tolist(), (begin + windows + length - 1).tolist())]
        which = np.array(which, np.int64)
        one = np.zeros(len(index), np.int64)
        one[which[::-1]] = np.arange(len(which))[::-1]
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, which, reps)
        group = _group(name[one], groups) if len(index) else np.zeros(0, np.int32)
        order = np.argsort(group, kind="stable")
        return who, each, data, starts, begin, windows, reps, which, list(index), least, name[one] if len(index) else name, group, order

    def cut_out(batches):
        util.lean()
        for batch in batches:
            for chunk, who, raw in zip(*(c.to_pylist() for c in batch.columns)):
                *_, strings, least, name, group, order = opened(who, raw)
                cut = np.flatnonzero(np.diff(group[order], prepend=-1))
                strings = [strings[i] for i in order.tolist()]
                sizes = np.fromiter(map(len, strings), np.uint16, len(strings))
                least, name, ends = least[order], name[order], [*cut[1:].tolist(), len(order)]
                blobs = [_pack(sizes=sizes[a:z], least=least[a:z], names=name[a:z], flat=b"".join(strings[a:z])) for a, z in zip(cut.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([pa.array(group[order][cut], pa.int32()), pa.array(np.full(len(cut), chunk)), pa.array(blobs, pa.binary())], names=["grp", "chunk", "blob"])

    # 3: suffixes of each group
    def ordered(batches):
        util.lean()
        coder = Names(length)
        for group, rows in _groups(batches, 0):
            index: dict = {}
            least: list[int] = []
            named: list[int] = []
            back = []
            for _, _, blob in rows:
                x = _unpack(blob)
                sizes, flat, at, mine = np.frombuffer(x["sizes"], np.uint16).tolist(), x["flat"], 0, []
                for n, low, name in zip(sizes, np.frombuffer(x["least"], np.int64).tolist(), np.frombuffer(x["names"], np.uint32).tolist()):
                    i = index.setdefault(flat[at : at + n], len(index))
                    if i == len(least):
                        least.append(low)
                        named.append(name)
                    elif low < least[i]:
                        least[i] = low
                    at += n
                    mine.append(i)
                back.append(mine)
            strings = list(index)
            sizes = np.array([len(s) for s in strings], np.int64)
            windows = sizes - length + 1
            first = np.cumsum(windows) - windows
            owner = np.array(least, np.int64)
            low = np.repeat(owner, windows)
            # equal windows have equal names: where only one string has a name, its owner stands
            many = _shared(np.array(named, np.uint32))
            if len(many):
                parts_of, string, start, wide = repeated_parts([strings[i] for i in many.tolist()], coder)
                string = many[string]
                uniq: dict = {}
                which = np.array([uniq.setdefault(x, len(uniq)) for x in parts_of], np.int64)
                own = np.full(len(uniq), np.iinfo(np.int64).max)
                np.minimum.at(own, which, owner[string])
                size = np.array([len(x) for x in uniq], np.int64)
                of_name = np.zeros(len(uniq), np.uint32)
                of_name[which] = np.array(named, np.uint32)[string]
                span = size - length + 1
                before = np.cumsum(span) - span
                found = np.repeat(own, span)
                again = _shared(of_name)
                if len(again):
                    # symbols are at least 1; no UTF-8 text holds byte 255
                    texts_of = list(uniq)
                    flat = np.frombuffer(b"".join([texts_of[i] for i in again.tolist()]), np.uint8) + np.uint8(1)
                    got = least_owner(flat, np.cumsum(size[again]) - size[again], size[again], own[again], length, in_memory, folder)
                    found[_spans(before[again], span[again])] = got
                low[_spans(first[string] + start, wide)] = found[_spans(before[which], wide)]
            # runs of equal owners, string by string
            head = np.ones(len(low), bool)
            head[1:] = low[1:] != low[:-1]
            head[first] = True
            runs = np.flatnonzero(head)
            lengths = np.diff(np.append(runs, len(low))).astype(np.uint16)
            run_of = np.searchsorted(runs, np.append(first, len(low)))
            values = low[runs]
            out = []
            for mine in back:
                mine = np.array(mine, np.int64)
                a, n = run_of[mine], run_of[mine + 1] - run_of[mine]
                take = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                out.append(_pack(n=n.astype(np.uint16), lengths=lengths[take], values=values[take]))
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([group] * len(rows), pa.int32()), pa.array(out, pa.binary())], names=["chunk", "grp", "raw"])

    strings = texts.mapInArrow(cut_out, "grp int, chunk long, blob binary").repartition(parts, "grp").sortWithinPartitions("grp", "chunk")
    # written, so that the strings' shuffle files go before the texts are dealt
    answers, answer_path = util.staged(strings.mapInArrow(ordered, "chunk long, grp int, raw binary"), "answers")

    # 4: back to the texts
    def applied(batches):
        util.lean()
        for _, rows in _groups(batches, 0):
            who, each, data, starts, begin, windows, reps, which, uniq, _, _, _, order = opened(rows[0][2], rows[0][3])
            got = [_unpack(r[3]) for r in rows[1:]]
            n = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x["n"], np.uint16).astype(np.int64) for x in got)])
            lengths = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x["lengths"], np.uint16).astype(np.int64) for x in got)])
            values = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x["values"], np.int64) for x in got)])
            a = np.empty(len(uniq), np.int64)
            k = np.empty(len(uniq), np.int64)
            a[order], k[order] = np.cumsum(n) - n, n
            n = k[which]
            take = np.repeat(a[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            size, least = lengths[take], values[take]
            # the runs of a string's windows follow one another
            begins = np.repeat(begin, n) + _within(size, n)
            hit = least < np.repeat(reps, n)
            diff = np.zeros(len(data) + 1, np.int32)
            np.add.at(diff, begins[hit], 1)
            np.add.at(diff, begins[hit] + size[hit] + length - 1, -1)
            gone = np.cumsum(diff[:-1]) > 0
            out = []
            for i, (start, text) in enumerate(zip(starts.tolist(), each)):
                mask = gone[start : start + len(text)]
                n_gone = int(mask.sum())
                if n_gone:
                    spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    left = np.frombuffer(text, np.uint8)[~mask].tobytes()
                    out.append((who["reps"][i], who["shas"][i], n_gone, spans, left, left.decode("utf-8", "ignore")))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in cols[4]], pa.string()), pa.array(cols[5], pa.string())], names=["rep", "s", "n_removed", "n_spans", "kept_sha256", "kept"])

    def _within(size, n):
        total = np.cumsum(size) - size
        return total - np.repeat(total[np.minimum(np.cumsum(n) - n, max(len(total) - 1, 0))], n) if len(size) else size

    both = texts.select("chunk", F.lit(-1).alias("grp"), "who", F.col("texts").alias("raw")).unionByName(answers.select("chunk", "grp", F.lit(None).cast("binary").alias("who"), "raw"))
    done = both.repartition(parts, "chunk").sortWithinPartitions("chunk", "grp").mapInArrow(applied, "rep long, s binary, n_removed long, n_spans long, kept_sha256 string, kept string")
    done, done_path = util.staged(done, "removed")
    util.drop(spark, text_path, answer_path)
    return firsts, done, [first_path, done_path]


def _own(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def deduplicated(docs: DataFrame, *, length: int = 50, keep: list[str] | None = None, **more) -> tuple[DataFrame, list[str]]:
    """The columns keep of docs and _n_bytes, _n_removed, _n_spans, _kept_sha256, _kept: the text that is
    left, without characters that lost some of their bytes (null: as the text was)."""
    firsts, done, paths = removals(docs, length=length, **more)
    keep = keep or []
    own = docs.select(*[F.col(c) for c in keep], F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    own = own.withColumn("_sha", F.sha2(F.col("_text").cast("binary"), 256)).withColumn("_key", F.unhex("_sha")).withColumn("_n_bytes", F.octet_length("_text").cast("long"))
    own = own.drop("_text")
    rep = firsts.select(F.col("sha").alias("_s"), F.col("rep").alias("_rep"))
    gone = done.select(F.col("s").alias("_g"), *[F.col(c).alias(f"_d_{c}") for c in ("n_removed", "n_spans", "kept_sha256", "kept")])
    # what a distinct text loses goes with its least doc_id only, later copies lose all
    facts = rep.join(gone, F.col("_s") == F.col("_g"), "left").drop("_g")
    out = own.join(facts, F.col("_key") == F.col("_s"), "left")
    copy = (F.col("_id") > F.col("_rep")) & (F.col("_n_bytes") >= length)
    first = F.col("_id") == F.col("_rep")
    pick = lambda whole, mine, none: F.when(copy, whole).when(first & F.col("_d_n_removed").isNotNull(), mine).otherwise(none)
    out = out.select(
        *[F.col(c) for c in keep],
        F.col("_id"),
        F.col("_n_bytes"),
        pick(F.col("_n_bytes"), F.col("_d_n_removed"), F.lit(0).cast("long")).alias("_n_removed"),
        pick(F.lit(1).cast("long"), F.col("_d_n_spans"), F.lit(0).cast("long")).alias("_n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("_d_kept_sha256"), F.col("_sha")).alias("_kept_sha256"),
        pick(F.lit(""), F.col("_d_kept"), F.lit(None).cast("string")).alias("_kept"),
    )
    return out, paths


def op10(spark, sf_dir: str) -> DataFrame:
    out, paths = deduplicated(util.documents(spark, sf_dir))
    out = out.select(F.col("_id").alias("doc_id"), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))
    return util.result(out, *paths)
