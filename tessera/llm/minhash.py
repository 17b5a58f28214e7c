"""Near duplicates by fast similarity sketches, banding and exact verification.

A sketch has t bins. In round i < t every shingle falls into a bin drawn for that round; in
round t + j every shingle falls into bin j, so each bin is filled after 2 t rounds at most. A
bin keeps the least value of the first round that reaches it. Bands of the bins are the buckets.

Texts of equal shingle sets are one class, and one text stands for it. In each bucket all texts
are compared with the bucket's first and last ones. Then, only where a bucket still holds more
than one component, the texts outside its first one's component meet those of other components
there, and are compared unless two exact bounds say that they can't be a link. The Jaccard
distance is a metric: two texts whose distances to the first (or the last) one differ by more
than the threshold allows are none. And odd sketches (the parity of how many shingles a text has
in each of ``ODD`` parts of the hash space) differ in no more bits than the sets do in shingles.
So no bucket of a large group of copies is paired out: the bounds are part of the join, and what
leaves it are links and few others. No link between different texts that share a bucket is left
out unless its ends are connected already. The
number of bands follows from the threshold: a pair at the threshold shares no bucket with a
probability of at most ``miss``. Links are confirmed on the full sets of the texts themselves.

A text of fewer words than a shingle is one shingle; without words or with null it has none and
links with nothing, as rows without a doc_id do (component_id null, kept). Rows that share a
doc_id are one node of the components, with the links of each of their texts: texts are paired
and verified by keys of their own. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import components, util

_M1, _M2, _S = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(31)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


#: bits of an odd sketch
ODD = 1024


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> _S)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII blanks only


def shingle_set(text: str | None, width: int) -> set:
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


class Sketcher:
    def __init__(self, width: int, bins: int, rows: int):
        import xxhash

        self.width, self.bins, self.rows, self.known, self.hash = width, bins, rows, {}, xxhash.xxh3_64_intdigest
        self.digest = xxhash.xxh3_128_digest
        self.seeds = mix(np.arange(1, 2 * bins + 1, dtype=np.uint64) * _A)
        self.mult = mix(np.arange(1, rows + 1, dtype=np.uint64) * _B) | np.uint64(1)
        self.step = mix(np.arange(1, width + 1, dtype=np.uint64) * _C) | np.uint64(1)

    def shingles(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        n = len(h) - k + 1
        total = np.full(n, k, np.uint64)
        for i in range(k):
            total = mix(total + h[i : i + n] * self.step[i])
        return np.unique(total)

    def sketch(self, x: np.ndarray) -> np.ndarray:
        t = self.bins
        out, empty = np.full(t, np.uint64(0xFFFFFFFFFFFFFFFF)), t
        for i in range(2 * t):
            h = mix(x ^ self.seeds[i])
            if i < t:
                at = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
                free = out[at] >= np.uint64(i << 52)  # filled in this round or not at all
                np.minimum.at(out, at[free], (h[free] >> np.uint64(12)) | np.uint64(i << 52))
                if i % 4 == 3 or len(x) > 8 * t:
                    empty = int((out == np.uint64(0xFFFFFFFFFFFFFFFF)).sum())
            else:
                if out[i - t] == np.uint64(0xFFFFFFFFFFFFFFFF):
                    out[i - t] = (h.min() >> np.uint64(12)) | np.uint64((i % 4096) << 52)
                empty = int(i < 2 * t - 1)
            if not empty:
                break
        return out

    def odd(self, x: np.ndarray) -> np.ndarray:
        """For each of ODD parts of the hashes, whether the set has an odd number there: where two texts differ, there is a shingle that only one of them has."""
        return np.packbits(np.bincount((x & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD).astype(np.uint8) & 1).view(np.int64)

    def bands(self, x: np.ndarray) -> np.ndarray:
        s = mix(self.sketch(x)).reshape(-1, self.rows)
        return mix((s * self.mult).sum(axis=1, dtype=np.uint64) + np.arange(len(s), dtype=np.uint64) * _A).view(np.int64)


def bands_for(threshold: float, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def sketched(docs: DataFrame, width: int, bins: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, sig (null: links with nothing), bands, odd."""
    import pyarrow as pa

    def run(batches):
        util.lean()
        coder = Sketcher(width, bins, rows)
        for batch in batches:
            ids, n, sig, bands, odd = batch.column(0), [], [], [], []
            for d, text in zip(ids.to_pylist(), batch.column(1).to_pylist()):
                x = coder.shingles(text)
                n.append(len(x))
                ok = d is not None and len(x)
                sig.append(coder.digest(x.tobytes()) if ok else None)
                bands.append(coder.bands(x) if ok else None)
                odd.append(coder.odd(x) if ok else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "sig", "bands", "odd"])

    util.settle(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, sig binary, bands array<bigint>, odd array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs(a, b) with the Jaccard distance of their full sets, and ok: alike enough. texts(rep, text) has one row for each rep."""
    import pyarrow as pa

    def check(batches):
        util.lean()
        for batch in batches:
            a_ids = batch.column(0).to_pylist()
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            own: dict = {}
            away, ok = [], []
            for a, x, y in zip(a_ids, left, right):
                p = own.get(a)
                if p is None:
                    if len(own) > 64:
                        own.clear()
                    p = own[a] = shingle_set(x, width)
                q = shingle_set(y, width)
                both = len(p & q)
                every = len(p) + len(q) - both
                ok.append(100 * both >= percent * every)
                away.append(1 - both / every)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away, pa.float64()), pa.array(ok, pa.bool_())], names=["a", "b", "away", "ok"])

    near = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("right")), "b")
    near = near.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("left")), "a")
    return near.select("a", "b", "left", "right").mapInArrow(check, "a long, b long, away double, ok boolean")


def keyed(docs: DataFrame, sk: DataFrame, first: DataFrame, width: int):
    """Keys of texts where rows share a doc_id and differ: (first with node, extra(sig, rep, node), several(id), texts(node, text), paths).

    A text's key is its rep; of several texts with one rep all but one get keys that are no doc_id.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    rows = sk.where("sig IS NOT NULL").select("doc_id", "sig").distinct()
    several, several_path = util.staged(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id")), "several")
    if not several.limit(1).count():
        return first.withColumn("node", F.col("rep")), None, None, None, [several_path]
    mine = first.join(several, F.col("rep") == F.col("id"), "left_semi")
    kept = mine.groupBy("rep").agg(F.min("sig").alias("own")).withColumnRenamed("rep", "of")
    extra, extra_path = util.staged(mine.join(kept, F.col("rep") == F.col("of")).where("sig != own").select("sig", "rep", F.monotonically_increasing_id().alias("nth")), "extra")
    least, most = sk.agg(F.min("doc_id"), F.max("doc_id")).first()
    room = (extra.agg(F.max("nth")).first()[0] or 0) + 1
    if most + room < 1 << 63:
        node = F.col("nth") + F.lit(most + 1)
    elif least - room >= -(1 << 63):
        node = F.lit(least - 1) - F.col("nth")
    else:
        raise ValueError("doc_ids leave no room for the keys of texts that share one")
    extra = extra.select(F.col("sig").alias("e"), F.col("rep").alias("of"), node.alias("key"))
    nodes = first.join(extra, F.col("sig") == F.col("e"), "left").select("sig", "rep", F.coalesce("key", "rep").alias("node"))

    def run(batches):
        util.lean()
        coder = Sketcher(width, 1, 1)
        for batch in batches:
            sig = [coder.digest(x.tobytes()) if len(x := coder.shingles(t)) else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.binary()), batch.column(1)], names=["doc_id", "s", "text"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(several, F.col("doc_id") == F.col("id"), "left_semi")
    texts = whole.mapInArrow(run, "doc_id long, s binary, text string").join(nodes, (F.col("s") == F.col("sig")) & (F.col("doc_id") == F.col("rep"))).select(F.col("node").alias("rep"), "text")
    return nodes, extra, several, texts, [several_path, extra_path]


def _in_cells(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows(cell, rep, lead ...) with comp and lead_comp: the components of the text and of its bucket's lead."""
    mine = comps.select(F.col("node").alias("_c"), F.col("component").alias("_m"))
    found = rows.join(mine, F.col("rep") == F.col("_c"), "left").withColumn("comp", F.coalesce("_m", "rep")).drop("_c", "_m")
    return found.join(mine, F.col("lead") == F.col("_c"), "left").withColumn("lead_comp", F.coalesce("_m", "lead")).drop("_c", "_m")


def _away(rows: DataFrame, links: DataFrame, to: str, name: str) -> DataFrame:
    """rows with the distance of rep to the text in the column to, where it is known."""
    found = links.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("away").alias("_d"))
    near = (F.least("rep", to) == F.col("_a")) & (F.greatest("rep", to) == F.col("_b"))
    return rows.join(found, near, "left").withColumn(name, F.when(F.col("rep") == F.col(to), 0.0).otherwise(F.col("_d"))).drop("_a", "_b", "_d")


def _possible(percent: int, known: list[str]):
    """Whether the odd sketches and the distances to third texts allow a link of a row and a row x_."""
    differ = sum((F.bit_count(F.get("odd", F.lit(i)).bitwiseXOR(F.get("x_odd", F.lit(i)))) for i in range(1, ODD // 64)), F.bit_count(F.get("odd", F.lit(0)).bitwiseXOR(F.get("x_odd", F.lit(0)))))
    fits = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("x_n"))
    for d in known:
        fits = fits & F.coalesce(F.abs(F.col(d) - F.col(f"x_{d}")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    return fits


def near_duplicates(docs: DataFrame, *, width: int = 5, threshold: float = 0.8, rows: int = 6, miss: float = 1e-8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    percent = round(100 * threshold)
    bins = rows * bands_for(threshold, rows, miss)
    sk, sk_path = util.staged(sketched(docs, width, bins, rows), "sketches")
    first = sk.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    nodes, extra, several, shared_texts, key_paths = keyed(docs, sk, first, width)
    # from here to the components rep is a text's key
    reps = sk.where("sig IS NOT NULL").join(nodes.withColumnRenamed("sig", "s"), (F.col("sig") == F.col("s")) & (F.col("doc_id") == F.col("rep")))
    cells = reps.select(F.col("node").alias("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last")
    met, met_path = util.staged(cells.join(shared, "cell").distinct(), "buckets")
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    known = met.select(F.col("rep").alias("_k")).distinct()
    facts = reps.select(F.col("node").alias("rep"), F.col("n_shingles").alias("n"), "odd").join(known, F.col("rep") == F.col("_k"), "left_semi").dropDuplicates(["rep"])
    facts, fact_path = util.staged(facts, "facts")
    pairs = met.where("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).unionByName(met.where("rep != last").select(F.col("rep").alias("a"), F.col("last").alias("b"))).distinct()
    other = facts.select(F.col("rep").alias("b"), F.col("n").alias("x_n"), F.col("odd").alias("x_odd"))
    # a text's distances to the first and last are windows for the others too, so only sizes keep these apart
    pairs = pairs.join(facts.withColumnRenamed("rep", "a"), "a").join(other, "b").where(alike(F.col("n"), F.col("x_n"))).select("a", "b")
    pairs, pair_path = util.staged(pairs, "pairs")
    known = known.withColumnRenamed("_k", "rep")
    whole = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    if several is not None:
        whole = whole.join(several, F.col("rep") == F.col("id"), "left_anti").unionByName(shared_texts)
    texts, text_path = util.staged(whole.join(known, "rep", "left_semi").groupBy("rep").agg(F.first("text").alias("text")), "texts")
    links, link_path = util.staged(verified(pairs, texts, width, percent), "links")
    comps, comp_path = components.components(links.where("ok").select("a", "b"))

    # buckets that still hold two components or more, with each text's distances to the first and last
    aside = _in_cells(met.select("cell", "rep", "n", "lead", "last"), comps).where("comp != lead_comp").select("cell").distinct()
    rest = _away(_away(met.join(aside, "cell", "left_semi"), links, "lead", "d1"), links, "last", "d2")
    rest = _in_cells(rest.join(facts.select(F.col("rep").alias("_r"), "odd"), F.col("rep") == F.col("_r")).select("cell", "rep", "n", "odd", "lead", "d1", "d2"), comps)
    now, placed_path = util.staged(rest, "placed")
    aside = now.where("comp != lead_comp").select(F.col("cell").alias("at"), F.col("rep").alias("x"), F.col("comp").alias("x_comp"), *[F.col(c).alias(f"x_{c}") for c in ("n", "odd", "d1", "d2")])
    second = now.join(aside, (F.col("cell") == F.col("at")) & (F.col("comp") != F.col("x_comp")) & ((F.col("comp") == F.col("lead_comp")) | (F.col("rep") < F.col("x"))) & _possible(percent, ["d1", "d2"]))
    second = second.select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b")).distinct().join(links.select("a", "b"), ["a", "b"], "left_anti")
    second, second_path = util.staged(second, "pairs")
    more, more_path = util.staged(verified(second, texts, width, percent), "links")
    edges = links.unionByName(more).where("ok").select("a", "b")
    if several is not None:
        # keys are doc_ids again, and a doc_id joins the classes of all its texts
        for end in ("a", "b"):
            edges = edges.join(extra.select("key", "of"), F.col(end) == F.col("key"), "left").withColumn(end, F.coalesce("of", end)).select("a", "b")
        held = sk.where("sig IS NOT NULL").join(several, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", F.col("sig").alias("s")).distinct()
        edges = edges.unionByName(held.join(first, F.col("s") == F.col("sig")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final, final_path = components.components(edges)

    class_of = first.join(final, F.col("rep") == F.col("node"), "left").select(F.col("sig").alias("s"), F.coalesce("component", "rep").alias("found"))
    out = sk.join(class_of, F.col("sig") == F.col("s"), "left").select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return util.result(out, sk_path, met_path, pair_path, text_path, link_path, comp_path, placed_path, second_path, more_path, final_path, fact_path, *key_paths)


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(util.documents(spark, sf_dir), width=3, threshold=0.85, rows=7)
