"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("tessera.llm")

from tessera.llm import collocations, util  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, f long, phrase string, a int, k int, l string, r string, n string, rank int, score int"


def brute(docs, least, top, longest=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        inside = {}
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(a, inside.get(p[i : i + k], 0))
        rows = []
        for p, a in often.items():
            if len(p) > 1 and 100 * inside.get(p, -1) < 80 * a:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def answered(spark, docs, **more):
    frame = spark.createDataFrame([(None if i % 5 == 0 else i // 2, t, g, 1, "x", 2, 3, "y", "z", "q", 4, 5) for i, (g, t) in enumerate(docs)], SCHEMA)
    out, paths = collocations.collocations(frame, **more)
    got = sorted(tuple(r) for r in out.collect())
    util.drop(spark, *paths)
    return got


def made(seed, n):
    random.seed(seed)
    words = ["the", "The", "of", "a", "B", "é", "É", " x", "中文", "\U0001f600", "'s", "x" * 600, *[f"w{i}" for i in range(30)]]
    common = [[random.choice(words) for _ in range(random.randint(2, 5))] for _ in range(6)]
    docs = [(None, None), ("en", ""), ("en", " \t\n.,"), ("", "of a of a of a of a"), ("und", "the of")]
    for _ in range(n):
        w = []
        for _ in range(random.randint(1, 30)):
            w += random.choice(common) if random.random() < 0.4 else [random.choice(words)]
            w.append(random.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "!?", "\x0b", "\r"]))
        docs.append((random.choice(["en", "en", "en", "fr", None]), " ".join(w)))
    docs.append(("fr", "lorem ipsum dolor sit " * 3000))
    return docs


@pytest.mark.parametrize("exact, bits", [(2_000_000, 1 << 28), (0, 1 << 20), (0, 8)])
def test_equals_brute_force(spark, exact, bits):
    """With exact lists, with a bitmap, and with one so small that all phrases pass."""
    docs = made(1, 300)
    want = brute(docs, 10, 40)
    assert answered(spark, docs, least=10, top=40, exact=exact, bits=bits) == want and len(want) > 20


def test_shares_of_the_best(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 100)
    docs = made(2, 200)
    monkeypatch.setattr(collocations.best, "__defaults__", (40,))
    assert answered(spark, docs, least=2, top=7) == brute(docs, 2, 7)


def test_no_rows(spark):
    assert answered(spark, []) == []
    assert answered(spark, [("en", "a b c d"), (None, None)]) == []


def test_equals_its_sql(spark, sf):
    got = sorted(tuple(r) for r in collocations.op12(spark, sf).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(c.execute(collocations.ORACLE).fetchall()) and got


def test_only_phrases_with_frequent_parts_are_emitted():
    texts = [b"a b c d. a b x. B c y", b"c d e"]
    of = {w: collocations.word_hashes([w])[0] for w in (b"a", b"b", b"c", b"d", b"e", b"x", b"y")}
    two = [(b"a", b"b"), (b"b", b"c"), (b"c", b"d")]
    frequent = collocations.Frequent(np.sort(np.array([collocations.hashes([np.array([of[a]]), np.array([of[b]])])[0] for a, b in two])).tobytes())
    found, counts = collocations.phrases(texts, 3, frequent)
    assert sorted(zip(found, counts)) == [(b"a b c", 1), (b"b c d", 1)]
    one = collocations.Frequent(np.sort(np.array([of[b"a"], of[b"b"]])).tobytes())
    assert collocations.phrases(texts, 2, one) == ([b"a b"], [2])
    assert collocations.phrases([b"", b" . "], 2, one) == ([], [])
