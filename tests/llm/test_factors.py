"""Repeated word sequences against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("tessera.llm")

from tessera.llm import factors, util  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, rep string, u int, v string, row int, runs string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs, length):
    least = {}
    cut = [(i, words(t)) for i, t in docs]
    for i, w in cut:
        for a in range(len(w) - length + 1) if i is not None else ():
            key = tuple(w[a : a + length])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in cut:
        gone = set()
        for a in range(len(w) - length + 1) if i is not None else ():
            if least[tuple(w[a : a + length])] < i:
                gone.update(range(a, a + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def answered(spark, docs, length, **more):
    frame = spark.createDataFrame([(i, t, *["x"] * 2, 1, "y", "z", 3, "w", 4, "r") for i, t in docs], SCHEMA)
    out, paths = factors.deduplicated(frame, length=length, keep=frame.columns, **more)
    got = out.collect()
    util.drop(spark, *paths)
    for r in got:
        left = words(r["text"])
        for s in reversed(r["_rl_spans"]):
            del left[s["a"] : s["a"] + s["n"]]
        assert (r["rep"], r["v"], r["row"]) == ("z", "w", 4)
        assert r["_rl_kept"] == (" ".join(left) if r["_rl_n_removed"] else None)
    return sorted((str(r["_rl_id"]), r["_rl_n_words"], r["_rl_n_removed"], r["_rl_kept_sha256"]) for r in got)


def mixed(seed, n, length):
    """Passages that many documents share, whole or in part, near and exact copies, contexts of their own."""
    random.seed(seed)
    word = lambda: random.choice(["the", "of", "a", "b", "é\U0001f600", f"w{random.randint(0, 400)}"])
    shared = [[word() for _ in range(random.randint(length, 3 * length))] for _ in range(4)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(random.randint(0, 4)):
            if random.random() < 0.6:
                p = list(random.choice(shared))
                a = random.randint(0, length // 2)
                p = p[a : len(p) - random.randint(0, length // 3)]
                if random.random() < 0.4:
                    p[random.randrange(len(p))] = word()
                w += p
            else:
                w += [word() for _ in range(random.randint(0, length))]
        docs.append((random.randint(1, 3 * n), random.choice([" ", "\n", "\t "]).join(w)))
    docs += [(random.randint(1, 3 * n), docs[k][1]) for k in range(0, n, 9)]
    return docs


LONG = "lorem ipsum dolor sit amet " * 4000
EDGES = [(1, None), (2, ""), (3, "a"), (4, LONG), (5, LONG), (5, LONG), (6, "ünï ©ode 中文 \U0001f600 " * 30), (6, "same id"), (7, "ünï ©ode 中文 \U0001f600 " * 20), (None, LONG), (8, " \n\t "), (9, "x" * 100_000 + " y" * 60), (10, "x" * 100_000 + " y" * 70), (0, " ".join(f"w{i}" for i in range(200))), (11, " ".join(f"w{i}" for i in range(49))), (12, " ".join(f"w{i}" for i in range(150, 200)))]


def test_edges(spark):
    assert answered(spark, EDGES, 50) == brute(EDGES, 50)
    assert answered(spark, [], 50) == []


@pytest.mark.parametrize("length, hot, seed", [(50, 256, 1), (50, 5, 2), (20, 0, 3), (7, 256, 4), (1, 3, 5)])
def test_equals_brute_force(spark, length, hot, seed):
    docs = mixed(seed, 120, length)
    assert answered(spark, docs, length, hot=hot) == brute(docs, length)


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in factors.op13(spark, sf).collect())
    assert got == brute(docs, 50)
    assert sum(r[2] for r in got) > 0


def longest(strings, owners, i, a):
    best = 0
    for s, o in zip(strings, owners):
        for b in range(len(s)) if o < owners[i] else ():
            n = 0
            while a + n < len(strings[i]) and b + n < len(s) and strings[i][a + n] == s[b + n]:
                n += 1
            best = max(best, n)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_block_by_brute_force(seed):
    random.seed(seed)
    strings = [np.array([random.randint(1, 2 + seed) for _ in range(random.randint(1, 25))]) for _ in range(14)]
    strings += [strings[3].copy(), strings[5][2:].copy()]
    owners = np.array([random.randint(0, 9) for _ in strings])
    block = factors.Block(strings, owners)
    for i, s in enumerate(strings):
        at = np.arange(len(s))
        got = np.minimum(block.longest(block.begin[i] + at, np.full(len(s), block.owner[i])), len(s) - at)
        assert got.tolist() == [longest(strings, owners, i, a) for a in at]
    for length in (1, 2, 4, 9):
        for i, spans in enumerate(block.spans(length)):
            want = {a for a in range(len(strings[i]) - length + 1) if longest(strings, owners, i, a) >= length}
            assert {a + k for a, n in spans for k in range(n)} == want


def test_a_block_has_few_places_looked_up():
    """Factors decide: a copy of one string is one look-up, and unlike strings are not searched window by window."""
    s = np.arange(1, 94)
    block = factors.Block([s, s.copy()], np.array([1, 2]))
    asked = []
    real = block.longest
    block.longest = lambda at, owner: (asked.append(len(at)), real(at, owner))[1]
    assert block.spans(50) == [[], [(0, 44)]]
    assert sum(asked) <= 2 + 44  # the first string has no match anywhere: a look-up for each word until no window fits
