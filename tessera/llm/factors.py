"""Repeated word sequences by relative Lempel-Ziv parsing.

A word of a document is removed if a window of ``length`` consecutive words that covers it also
starts in a document with a smaller doc_id; windows are judged on the input. Words are what
ASCII white space separates.

1. A window's name is the least hash of its ``K``-word grams. Equal windows have equal names, so
   only names that occur in two documents lead to blocks that can hold a window's words.
2. Runs of windows with such a name are cut out as strings. The strings of some names, each once
   with its least doc_id, make a reference block, indexed by its suffix order with common
   prefixes. A string is factored against each block that holds its name (a block without it has
   no window in common): greedily, a factor is the longest match with a string of a smaller
   doc_id, which stands among the nearest suffixes of such strings in the order.
3. Factors of ``length`` words or more are duplicate spans. A repeated window lies in one factor
   or in two that follow one another, since what is left of it after a factor's end is a match
   for the next. So at each end the windows across it are looked up where both factors together
   are long enough; nothing else is.
4. Spans go back to the documents. A later document with an equal string loses the whole of it.

A name in more than ``hot`` runs is dealt further, so that no block grows with it: its windows
whose full hash occurs in two documents are strings of their own, named by that hash. Exact
copies of a text need no parse: the later ones lose all words if there is a window.

Null texts are empty; rows without a doc_id neither remove nor lose words; rows that share a
doc_id remove nothing from one another and are told apart by their text. Texts with fewer words
than a window stay whole. Extra columns pass through (names that begin with ``_rl_`` are the
operator's own). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import util
from tessera.llm.minhash import mix

#: words of a gram that names windows, and symbols from which a reference block is full
K, BLOCK = 16, 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


class Words:
    """64-bit hashes of the words of texts, from sums over their bytes. They say where strings are sent; words decide."""

    def __init__(self, block: int = 1 << 20):
        self.block, self.up, self.down = block, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int):
        if len(self.up) < n:
            up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if n > 2 * self.block:  # of one very long text
                return up, down
            self.up, self.down = up, down
        return self.up, self.down

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and how many each text has."""
        parts, held, size = [], [], 0
        for t in texts:
            if held and size + len(t) > self.block:
                parts.append(self._some(held))
                held, size = [], 0
            held.append(t)
            size += len(t) + 1
        if held:
            parts.append(self._some(held))
        parts.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _some(self, texts):
        data = np.frombuffer(b"".join([b" ", *[x for t in texts for x in (t, b" ")]]), np.uint8)
        up, down = self._powers(len(data))
        blank = _BLANK[data]
        first, end = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        total = np.cumsum((data + np.uint64(1)) * up[: len(data)])
        h = mix((total[end - 1] - total[first - 1]) * down[first] + (end - first).astype(np.uint64))
        edge = np.cumsum([1, *[len(t) + 1 for t in texts]])
        return h, np.diff(np.searchsorted(first, edge))


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_WORDS = Words()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words that follow one another."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * np.multiply.accumulate(up), out=total[1:])
    return mix((total[k:] - total[:-k]) * np.multiply.accumulate(down)[: n - k + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n, out, at, level = len(values) - width + 1, None, 0, values
    for bit in range(width.bit_length()):
        if width >> bit & 1:
            out = level[at : at + n] if out is None else np.minimum(out, level[at : at + n])
            at += 1 << bit
        if width >> (bit + 1):
            level = np.minimum(level[: -(1 << bit)], level[1 << bit :])
    return out


def named(hashes: np.ndarray, sizes: np.ndarray, length: int):
    """(document, name, first window, windows) of the runs of windows with one name; sizes: words of each document."""
    ends = np.cumsum(sizes)
    k = min(K, length)
    if len(hashes) < length:
        return (np.zeros(0, np.int64),) * 4
    name = sliding_min(grams(hashes, k), length - k + 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(name)]
    inside = np.arange(len(name)) + length <= ends[doc]
    head = inside.copy()
    head[1:] &= ~(inside[:-1] & (name[1:] == name[:-1]) & (doc[1:] == doc[:-1]))
    first = np.flatnonzero(head)
    count = np.bincount(np.searchsorted(first, np.flatnonzero(inside), "right") - 1, minlength=len(first))
    return doc[first], name[first].view(np.int64), first - (ends - sizes)[doc[first]], count


class Block:
    """The suffix order of a reference block: strings of symbols (1 and more), each with an owner."""

    def __init__(self, strings: list[np.ndarray], owners: np.ndarray):
        owners = np.unique(owners, return_inverse=True)[1].astype(np.int32)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(self.size + 1) - self.size - 1
        n = int(self.begin[-1] + self.size[-1] + 1)
        flat, rest, self.owner = np.zeros(n, np.int64), np.zeros(n, np.int32), owners
        own = np.full(n, np.iinfo(np.int32).max, np.int32)  # the symbol 0 after a string belongs to nobody
        for s, a, o in zip(strings, self.begin.tolist(), owners.tolist()):
            flat[a : a + len(s)] = s
            rest[a : a + len(s)] = np.arange(len(s), 0, -1)
            own[a : a + len(s)] = o
        # ranks by the first 1, 2, 4 ... symbols, until they tell all strings apart
        ranks = [_ranks(flat)]
        while 1 << (len(ranks) - 1) <= self.size.max():
            w, r = 1 << (len(ranks) - 1), ranks[-1]
            key = r * np.int64(n + 2)
            key[:-w] += r[w:] + np.int64(1)
            ranks.append(_ranks(key))
        order = np.argsort(ranks[-1], kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        common = np.zeros(n - 1, np.int64)
        for j in range(len(ranks) - 1, -1, -1):
            a, b = order[:-1] + common, order[1:] + common
            ok = np.maximum(a, b) < n
            ok[ok] = ranks[j][a[ok]] == ranks[j][b[ok]]
            common += ok.astype(np.int64) << j
        common = np.minimum(common, np.minimum(rest[order[:-1]], rest[order[1:]]))
        self.n, self.least, self.common = n, _minima(own[order]), _minima(np.append(common, 0).astype(np.int32))

    def longest(self, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The longest match at each place with a string of a smaller owner than given."""
        n, place = self.n, self.place[at]
        far = np.iinfo(np.int32).max
        left, right = place.copy(), place + 1
        before, after = np.full(len(at), far, np.int32), np.full(len(at), far, np.int32)
        for j in range(len(self.least) - 1, -1, -1):
            w = 1 << j
            ok = left >= w  # none of the w suffixes before has a smaller owner: go past them
            ok[ok] = self.least[j][left[ok] - w] >= owner[ok]
            left[ok] -= w
            before[ok] = np.minimum(before[ok], self.common[j][left[ok]])
            ok = right + w <= n
            ok[ok] = self.least[j][right[ok]] >= owner[ok]
            after[ok] = np.minimum(after[ok], self.common[j][right[ok] - 1])
            right[ok] += w
        ok = left > 0
        before = np.where(ok, np.minimum(before, self.common[0][np.maximum(left - 1, 0)]), 0)
        ok = right < n
        after = np.where(ok, np.minimum(after, self.common[0][np.minimum(right, n - 1) - 1]), 0)
        return np.maximum(before, after)

    def spans(self, length: int, search: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """Of each string, runs (first window, windows) of windows that a string of a smaller owner has too;
        search: strings that are to be factored (else all)."""
        own, end = self.owner, self.begin + self.size
        at, last = self.begin.copy(), np.zeros(len(own), np.int64)
        hits: list[tuple] = []
        live = np.flatnonzero(self.size >= length) if search is None else search
        while len(live):
            p, o = at[live], own[live]
            got = np.minimum(self.longest(p, o), end[live] - p)
            long = got >= length
            hits.append((live[long], p[long], got[long] - length + 1))
            # windows across the end of the factor before
            both = np.flatnonzero((last[live] > 0) & (got > 0) & (last[live] + got >= length))
            a = np.maximum(p[both] - last[live][both], p[both] - length + 1)
            z = np.minimum(p[both] - 1, p[both] + got[both] - length)
            count = np.maximum(z - a + 1, 0)
            who = np.repeat(both, count)
            s = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            ok = self.longest(s, o[who]) >= length
            hits.append((live[who[ok]], s[ok], np.ones(int(ok.sum()), np.int64)))
            last[live], at[live] = got, p + np.maximum(got, 1)
            live = live[end[live] - (at[live] - last[live]) >= length]
        out: list[list[tuple[int, int]]] = [[] for _ in own]
        string, s, n = (np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 3
        s = s - self.begin[string]
        for i in np.lexsort((s, string)).tolist():
            mine, a, c = out[string[i]], int(s[i]), int(n[i])
            if mine and mine[-1][0] + mine[-1][1] >= a:
                mine[-1] = (mine[-1][0], max(mine[-1][1], a + c - mine[-1][0]))
            else:
                mine.append((a, c))
        return out


def _ranks(values: np.ndarray) -> np.ndarray:
    """0, 1 ... for the distinct values in their order."""
    order = np.argsort(values)
    head = np.ones(len(values), np.int32)
    head[1:] = np.diff(values[order]) != 0
    out = np.empty(len(values), np.int32)
    out[order] = np.cumsum(head, dtype=np.int32) - 1
    return out


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Least values of all ranges of 1, 2, 4 ... values."""
    out = [values]
    while len(out[-1]) > 1 << (len(out) - 1):
        w = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-w], out[-1][w:]))
    return out


def mark(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def parsed(strings: list[tuple[int, bytes, int]], length: int):
    """(name, mark, owner, spans) of distinct (name, text, owner), those of a name together; they make one reference block."""
    named_ = np.array([name for name, *_ in strings], np.int64)
    owners = np.array([o for *_, o in strings], np.int64)
    head = np.append(True, named_[1:] != named_[:-1])
    least = np.minimum.reduceat(owners, np.flatnonzero(head))[np.cumsum(head) - 1]
    # windows of a name are nowhere but in its strings: the first owner's have no factor, nor has a name of one owner
    search = owners > least
    some = np.flatnonzero(np.logical_or.reduceat(search, np.flatnonzero(head))[np.cumsum(head) - 1])
    spans: list = [[] for _ in strings]
    if len(some):
        ids: dict = {}
        block = Block([np.array([ids.setdefault(w, len(ids) + 1) for w in strings[i][1].split(b" ")], np.int64) for i in some.tolist()], owners[some])
        for i, x in zip(some.tolist(), block.spans(length, np.flatnonzero(search[some]))):
            spans[i] = x
    return [(name, mark(text), owner, x) for (name, text, owner), x in zip(strings, spans)]


_RUNS = "array<struct<name:bigint,a:int,n:int>>"


def _own(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))


def removals(docs: DataFrame, *, length: int = 50, hot: int = 256) -> tuple[DataFrame, DataFrame, list[str]]:
    """(sha, n_words, whole, rep) of distinct texts; (sha, n_removed, spans, kept) of those that lose words; the paths of both."""
    import pyarrow as pa

    if length < 1:
        raise ValueError("a window has a word or more")
    spark = util.settle(docs.sparkSession)
    parts = util.parts(docs, 8)
    own = _own(docs)

    # 1: names
    def read(batches):
        util.lean()
        for batch in batches:
            texts = batch.column(3).to_pylist()
            hashes, sizes = _WORDS.hashes(texts)
            doc, name, first, count = named(hashes, sizes, length)
            offsets = np.searchsorted(doc, np.arange(len(texts) + 1))
            runs = pa.StructArray.from_arrays([pa.array(name, pa.int64()), pa.array(first, pa.int32()), pa.array(count, pa.int32())], names=["name", "a", "n"])
            whole = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(whole, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)], names=["u", "doc_id", "sha", "n_words", "whole", "runs"])

    texts = own.select(F.monotonically_increasing_id().alias("u"), "doc_id", "sha", "text")
    seen, seen_path = util.staged(texts.mapInArrow(read, f"u long, doc_id long, sha binary, n_words long, whole string, runs {_RUNS}"), "words")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "u"))).alias("f")
    facts = seen.groupBy("sha", "n_words", "whole").agg(least).select("sha", "n_words", "whole", F.col("f.doc_id").alias("rep"), F.col("f.u").alias("u"))
    facts, fact_path = util.staged(facts, "texts")
    # a distinct text is read in the row with its least doc_id
    once = facts.where("rep IS NOT NULL").select(F.col("u").alias("v"))
    runs = seen.where(F.size("runs") > 0).join(once, F.col("u") == F.col("v"), "left_semi").select("u", "doc_id", F.inline("runs"))
    runs, run_path = util.staged(runs, "runs")
    often = runs.groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi")
    often = often.select(F.col("name").alias("of"), (F.col("c") > hot).alias("hot"))
    wanted = runs.join(often, F.col("name") == F.col("of")).groupBy("u").agg(F.collect_list(F.struct("name", "a", "n", "hot")).alias("runs"))
    known = facts.select(F.col("u").alias("v"), F.col("sha").alias("s"), "rep")
    wanted = wanted.join(known, F.col("u") == F.col("v")).select("v", "s", "rep", "runs")
    texts = own.join(wanted, (F.col("sha") == F.col("s")) & (F.col("doc_id") == F.col("rep"))).select("v", "rep", "sha", "text", "runs")
    if seen.where("doc_id IS NOT NULL").groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        texts = texts.dropDuplicates(["v"])  # rows that share doc_id and text
    texts, text_path = util.staged(texts.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), 7)), "candidates")
    util.drop(spark, seen_path, run_path)

    # names in very many runs: windows by their full hash, each once for a chunk of texts
    def windows(batches):
        util.lean()
        for batch in batches:
            met: dict = {}
            for chunk, rep, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                full = grams(_WORDS.hashes([text])[0], length).view(np.int64)
                mine = met.setdefault(chunk, {})
                for w in set(np.concatenate([full[r["a"] : r["a"] + r["n"]] for r in runs if r["hot"]]).tolist()):
                    lo, hi = mine.get(w, (rep, rep))
                    mine[w] = (min(lo, rep), max(hi, rep))
            for chunk, mine in met.items():
                lo, hi = zip(*mine.values())
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(mine), pa.int64()), pa.array(list(mine), pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["chunk", "w", "lo", "hi"])

    def after(lists: DataFrame, *columns: str) -> DataFrame:
        """A chunk's list and then its texts."""
        rows = texts.select("chunk", "v", *columns).unionByName(lists, allowMissingColumns=True)
        return rows.repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("v").asc_nulls_first())

    paths, hottest = [text_path], texts.where(F.exists("runs", lambda r: r["hot"]))
    if hottest.limit(1).count():
        full, full_path = util.staged(hottest.select("chunk", "rep", "text", "runs").mapInArrow(windows, "chunk long, w long, lo long, hi long"), "windows")
        twice = full.groupBy("w").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select(F.col("w").alias("x"))
        again = full.join(twice, F.col("w") == F.col("x"), "left_semi").groupBy("chunk").agg(F.collect_set("w").alias("again"))
        again, again_path = util.staged(again, "again")
        paths += [full_path, again_path]
        pieces = after(again, "rep", "text", "runs")
    else:
        pieces = texts.select("chunk", "v", "rep", "text", "runs", F.lit(None).cast("array<bigint>").alias("again"))

    def strings_of(text, runs, again):
        """(name, first window, windows, string): runs of windows; single windows of names in very many runs."""
        words = text.split()
        spots = [(r["name"], r["a"], r["n"]) for r in runs if not r["hot"]]
        at = [np.arange(r["a"], r["a"] + r["n"]) for r in runs if r["hot"]]
        if at and len(again):
            at = np.concatenate(at)
            full = grams(_WORDS.hashes([text])[0], length).view(np.int64)[at]
            ok = np.isin(full, again)
            spots += zip(full[ok].tolist(), at[ok].tolist(), [1] * int(ok.sum()))
        return words, [(name, a, n, b" ".join(words[a : a + n + length - 1])) for name, a, n in spots]

    # 2: strings, in a chunk of texts each once with its least and greatest doc_id
    def cut_out(batches):
        util.lean()
        of, again, met = None, (), {}

        def out():
            for a in range(0, len(met), 1 << 13):
                rows = [(of, name, mark(x), x, lo, hi) for (name, x), (lo, hi) in list(met.items())[a : a + (1 << 13)]]
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["chunk", "name", "mark", "string", "lo", "hi"])

        for batch in batches:
            lists = batch.column(5)
            for i, (chunk, v, rep, text, runs) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]))):
                if chunk != of:
                    yield from out()
                    of, again, met = chunk, (), {}
                if v is None:
                    again = lists[i].values.to_numpy()
                    continue
                for name, _, _, x in strings_of(text, runs, again)[1]:
                    lo, hi = met.get((name, x), (rep, rep))
                    met[name, x] = (min(lo, rep), max(hi, rep))
        yield from out()

    cut, cut_path = util.staged(pieces.mapInArrow(cut_out, "chunk long, name long, mark binary, string binary, lo long, hi long"), "strings")

    def factored(batches):
        util.lean()
        held, size, last = [], 0, None
        for batch in batches:
            for name, text, owner in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK and name != last:  # all strings of a name are in one block
                    yield _answers(held)
                    held, size = [], 0
                held.append((name, text, owner))
                size += text.count(b" ") + 2
                last = name
        if held:
            yield _answers(held)

    def _answers(held):
        got = parsed(held, length)
        spans = pa.array([[{"a": a, "n": n} for a, n in x[3]] for x in got], pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.binary()), pa.array([x[2] for x in got], pa.int64()), spans], names=["of", "id", "owner", "spans"])

    strings = cut.groupBy("name", "string").agg(F.min("lo").alias("owner"))
    strings = strings.repartition(parts, "name").sortWithinPartitions("name", "owner").select("name", "string", "owner")
    answers, answer_path = util.staged(strings.mapInArrow(factored, "of long, id binary, owner long, spans array<struct<a:int,n:int>>"), "factors")

    # 3: back to the chunks, and their texts
    known = cut.select("chunk", "name", "mark", "hi").join(answers, (F.col("name") == F.col("of")) & (F.col("mark") == F.col("id"))).where((F.col("hi") > F.col("owner")) | (F.size("spans") > 0))
    known = known.groupBy("chunk").agg(F.collect_list(F.struct("name", "mark", "owner", "spans")).alias("known"))

    def applied(batches):
        util.lean()
        of, facts, names = None, {}, ()
        for batch in batches:
            out = []
            for chunk, v, rep, sha, text, runs, known in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != of:
                    of, facts, names = chunk, {}, ()
                if v is None:
                    facts = {(x["name"], x["mark"]): (x["owner"], x["spans"]) for x in known}
                    names = np.array([x["name"] for x in known], np.int64)
                    continue
                words, strings = strings_of(text, runs, names) if facts else ([], [])
                diff = np.zeros(len(words) + 1, np.int64)
                for name, a, n, x in strings:
                    owner, spans = facts.get((name, mark(x)), (rep, ()))
                    for at, m in [(0, n)] if rep > owner else [(y["a"], y["n"]) for y in spans]:
                        diff[a + at] += 1
                        diff[a + at + m + length - 1] -= 1
                gone = np.cumsum(diff[:-1]) > 0
                if gone.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                    out.append((sha, int(gone.sum()), [{"a": x, "n": z - x} for x, z in zip(edge[::2], edge[1::2])], hashlib.sha256(kept).hexdigest(), kept.decode()))
            if out:
                types = (pa.binary(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int32())])), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["s", "n_removed", "spans", "kept_sha256", "kept"])

    done, done_path = util.staged(after(known, "rep", "sha", "text", "runs").mapInArrow(applied, "s binary, n_removed long, spans array<struct<a:int,n:int>>, kept_sha256 string, kept string"), "removed")
    util.drop(spark, *paths, cut_path, answer_path)
    return facts, done, [fact_path, done_path]


def deduplicated(docs: DataFrame, *, length: int = 50, keep: list[str] | None = None, **more) -> tuple[DataFrame, list[str]]:
    """The columns keep of docs, and _rl_id, _rl_n_words, _rl_n_removed, _rl_spans (runs of removed words),
    _rl_kept (null: no word goes; else the others, joined by one space) and _rl_kept_sha256; the staged tables behind it."""
    facts, done, paths = removals(docs, length=length, **more)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(F.lit(0).alias("_rl_"), *(keep or [])).alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"))
    known = facts.join(done, F.col("sha") == F.col("s"), "left").drop("s", "u").withColumnRenamed("sha", "k")
    out = rows.join(known, F.col("sha") == F.col("k"))
    copy = (F.col("id") > F.col("rep")) & (F.col("n_words") >= length)
    first = (F.col("id") == F.col("rep")) & F.col("n_removed").isNotNull()
    every = F.array(F.struct(F.lit(0).alias("a"), F.col("n_words").cast("int").alias("n")))
    pick = lambda all_, mine, none: F.when(copy, all_).when(first, mine).otherwise(none)
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in keep or []],
        F.col("id").alias("_rl_id"),
        F.col("n_words").alias("_rl_n_words"),
        pick(F.col("n_words"), F.col("n_removed"), F.lit(0).cast("long")).alias("_rl_n_removed"),
        pick(every, F.col("spans"), F.expr("CAST(array() AS array<struct<a:int,n:int>>)")).alias("_rl_spans"),
        pick(F.lit(""), F.col("kept"), F.lit(None).cast("string")).alias("_rl_kept"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("whole")).alias("_rl_kept_sha256"),
    ), paths


def op13(spark, sf_dir: str) -> DataFrame:
    out, paths = deduplicated(util.documents(spark, sf_dir))
    return util.result(out.select(*[F.col(f"_rl_{c}").alias("doc_id" if c == "id" else c) for c in ("id", "n_words", "n_removed", "kept_sha256")]), *paths)
