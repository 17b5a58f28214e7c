"""The Merkle manifest against a tree built by hand."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")

from tessera.llm import manifest, util  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, idx int, node string, m int, who string, block int, path string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves, fan):
    """root, and for each leaf the (before, after) of each level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            a = i - i % fan
            run = level[a : a + fan]
            paths[k].append(("".join(run[: i - a]), "".join(run[i - a + 1 :])))
        at = [i // fan for i in at]
        level = [H(*level[i : i + fan]) for i in range(0, len(level), fan)]
    return level[0], paths


def brute(rows, fan=2):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fan) for g in order}
    if not order:
        return []
    root, tops = tree([trees[g][0] for g in order], fan)
    out = []
    for g, top in zip(order, tops):
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            path = path + top
            acc = own
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                acc = leaf(*r[:3], r[3] + 1, r[4])
            for a, b in path:
                acc = H(a, acc, b)
            out.append((str(r[0]), own, trees[g][0], root, H(*[a + b for a, b in path]), acc, acc == root))
    return sorted(out)


def answered(spark, rows, tmp, **more):
    frame = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], *["x", 1, "y", 2, "z", 3, "p"]) for r in rows], SCHEMA)
    if more:
        altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, manifest.digest(*[manifest.encoded(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in manifest.COLUMNS]))
        out, paths = manifest.manifest(frame, forged=altered, **more)
        path = F.col("path")
        out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(path).cast("binary"), 256), manifest.folded(F.coalesce("forged", "leaf"), path).alias("f")).withColumn("v", F.col("f") == F.col("root"))
        got = out.collect()
        util.drop(spark, *paths)
    else:
        frame.write.mode("overwrite").parquet(f"{tmp}/documents.parquet")
        got = manifest.op11(spark, str(tmp)).collect()
    return sorted((str(r[0]), *r[1:]) for r in got)


def made(n, langs, seed):
    random.seed(seed)
    return [(i * 3 - 5, random.choice(["s", None, ""]), random.choice(langs), random.choice([None, 0, 7, 2**63 - 1]), random.choice([None, "", "é\U0001f600", "x" * random.randint(0, 40)])) for i in range(n)]


EDGES = [(1, None, None, None, None), (2, "a", "en", 3, "same"), (2, "a", "en", 3, "same"), (2, "a", "en", 3, "other"), (None, "a", "en", 1, "no id"), (14, "", "", 5, ""), (7, "s", "é", 1, "z"), (8, "s", "z", 1, "lorem " * 50_000), (9, "s", "\U0001f600", 1, "z")]


def test_manifest_equals_a_tree_built_by_hand(spark, tmp_path):
    rows = EDGES + made(300, ["en", "en", "en", "fr", None], 3)
    assert answered(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("n, fan, levels", [(1, 2, 1), (2, 2, 2), (13, 3, 1), (64, 2, 3), (65, 2, 3)])
def test_manifest_of_any_width(spark, tmp_path, n, fan, levels):
    rows = made(n, ["en", "fr"], n)
    rows = [(a, b, c, d if d != 2**63 - 1 else 1, e) for a, b, c, d, e in rows]
    assert answered(spark, rows, tmp_path, fan=fan, levels=levels) == brute(rows, fan)


def test_manifest_of_an_empty_table(spark, tmp_path):
    assert answered(spark, [], tmp_path) == []


def test_manifest_equals_its_sql(spark, sf):
    got = sorted(map(repr, (tuple(r) for r in manifest.op11(spark, sf).collect())))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(map(repr, c.execute(manifest.ORACLE).fetchall()))


def test_manifest_refuses_bad_widths(spark, sf):
    with pytest.raises(ValueError):
        manifest.manifest(spark.read.parquet(f"{sf}/documents.parquet"), fan=1)
