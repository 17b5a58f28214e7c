"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")

from tessera.llm import components, linededup, minhash, packing, pieces, quality_rules, repair, rotation, rule_ensemble, srs, suffixes, tokens, util  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, _extra int"
LONG = "lorem ipsum dolor sit amet " * 4000


def frame(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, None if i is not None and i % 3 == 0 else "en", None, 0, "x", "y", 1) for i, t in texts], schema)


EDGES = [(1, None), (2, ""), (3, "a"), (4, LONG), (5, LONG), (6, "ünï ©ode 中文 \U0001f600"), (6, "same id"), (7, "a b"), (7, "a b"), (None, "no id here"), (8, " \n\t ")]


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def libs():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_unit_encoder_is_exact():
    t, e = libs(), tokens.encoder(tokens.default_path())
    random.seed(1)
    texts = ["".join(random.choice("ab the.,!'’s\n\t  é中1<|> \u0085") for _ in range(random.randint(0, 60))) for _ in range(3000)] + ["x<|endoftext|> y", "a\u0000b", " .,", "the.,the", "'s 's", None]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.ids(texts)] == want


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    e, t = tokens.encoder(path), Tokenizer.from_file(path)
    texts = ["Some  Words, here.", "", None, "x\n\ny 12.5", "é" * 40]
    assert not e.cuts and [np.frombuffer(b, "<u4").tolist() for b in e.ids(texts)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_long_units_are_exact_and_not_kept():
    random.seed(25)
    texts = ["".join(random.choice("abcdeé中😀,.") for _ in range(n)) for n in (500, 513, 3000, 20_000)] + ["ab" * 5000, "中" * 3000]
    t, e = libs(), tokens.encoder(tokens.default_path())
    assert [np.frombuffer(b, "<u4").tolist() for b in e.ids(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    p = pieces.encoder(pieces.default_path())
    assert [np.frombuffer(b"".join(b for b, _ in u), "<i4").tolist() for u in p.encode(texts)] == p.library.encode(texts, num_threads=1)
    assert max(map(len, [*e.cache.young, *p.cache.young, *p.segments.young])) <= util.LONG


def test_grammar_round_trip():
    random.seed(2)
    for least in (1, 2, 5):
        ids = np.array([random.randint(1, 6) for _ in range(3000)], "<u4")
        firsts = np.array([0, 10, 11, 2000])
        s, f, rules, lengths = repair.compress(ids, firsts, 1 << 17, 8, least)
        assert (repair.expand(s, rules, lengths, 1 << 17) == ids).all() and len(s) < len(ids)
        block = {"symbols": s.tobytes(), "rules": rules.tobytes(), "lengths": lengths.tobytes(), "firsts": f.tolist()}
        for k, (a, z) in enumerate(zip([0, 10, 11, 2000], [10, 11, 2000, 3000])):
            assert (repair.decode(block, k) == ids[a:z]).all()
            for _ in range(30):
                x, y = sorted((random.randint(0, z - a + 3), random.randint(0, z - a + 3)))
                assert (repair.decode(block, k, x, y) == ids[a:z][x:y]).all()
        for i, n in enumerate(lengths.tolist()):
            assert len(repair.expand(np.array([(1 << 17) + i]), rules, lengths, 1 << 17)) == n


def test_a_unit_is_looked_up_once_for_all_texts_of_a_column():
    import pyarrow as pa

    class Counted(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

    t, e = libs(), tokens.UnitEncoder(tokens.default_path())
    e.cache.young = Counted()
    odd = ["", " ", "\n", " lead", "tail ", "a  b", "a\n\nb c", "x \n y", "tab\tin text", "nul\0 in\0it", "no\xa0break a\u3000b", "\x1c a \x85b", "it's we'll.", "big&&& big.%%% big,### Bég*** 9!! ñ:; 中文, ...", "<|endoftext|>. a<|endoftext|>&& b", "a" * 2000 + " b"]
    texts = [None, *odd, *["one two three, two. one&&&\nthree"] * 500]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.ids(pa.array(texts))] == want
    assert e.cache.young.n < 200
    e.cache.turn()
    assert np.frombuffer(e.ids([" two three,"])[0], "<u4").tolist() == t.encode(" two three,", add_special_tokens=False).ids


def test_more_rounds_never_lengthen_a_block():
    random.seed(22)
    words = [[random.randint(1, 400) for _ in range(random.randint(1, 6))] for _ in range(300)]
    ids = np.array([x for _ in range(4000) for x in random.choice(words)], "<u4")
    sizes = [len(repair.compress(ids, np.array([0]), 1 << 17, n, 2)[0]) for n in (0, 1, 2, 3, 5, 8, None)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < 0.6 * sizes[0]


def test_id_files(spark, edges, empty, tmp_path):
    t = libs()
    repair.write(edges, str(tmp_path / "a"))
    got = [tuple(r) for r in repair.digests(spark, str(tmp_path / "a")).orderBy("start").collect()]
    assert len(got) == len(EDGES) and [r[0] for r in got] == sorted((i for i, _ in EDGES), key=lambda x: (x is not None, x))
    at = 0
    by = {}
    for i, x in EDGES:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        by.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for i, start, n, crc in got:
        assert start == at and (n, crc) in by[i]
        at += n
    whole = {r.doc_id: r.ids for r in repair.read(spark, str(tmp_path / "a")).collect()}
    assert whole[3] == t.encode("a", add_special_tokens=False).ids + [0]
    repair.write(empty, str(tmp_path / "b"))
    assert repair.digests(spark, str(tmp_path / "b")).count() == 0


def test_grammar_goes_on_until_no_pair_occurs_twice(spark, tmp_path):
    random.seed(14)
    copy = " ".join(str(random.randrange(10**6)) for _ in range(400))
    texts = [(i, copy) for i in range(3)] + [(9, " ".join(random.choice(["one", "two", "three"]) for _ in range(300)))]
    repair.write(frame(spark, texts).coalesce(1), str(tmp_path / "a"))
    for b in spark.read.parquet(str(tmp_path / "a")).collect():
        symbols, firsts = np.frombuffer(b.symbols, "<u4").tolist(), [*b.firsts, len(b.symbols) // 4]
        pairs = [p for a, z in zip(firsts, firsts[1:]) for p in zip(symbols[a : z - 1], symbols[a + 1 : z])]
        assert len(pairs) == len(set(pairs))
    got = {r.doc_id: r.ids for r in repair.read(spark, str(tmp_path / "a")).collect()}
    assert all(got[i] == libs().encode(x, add_special_tokens=False).ids + [0] for i, x in texts)


def test_packing(spark, edges, empty):
    assert packing.packed(empty).count() == 0
    rows = packing.packed(edges, window=64, with_ids=True).collect()
    seqs, docs = {}, {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert sum(n for p in docs[4] for n in [p[1]]) == docs[4][0][2]


def test_packing_covers_each_id_once(spark):
    random.seed(19)
    texts = [(i, " ".join(f"w{random.randrange(3000)}" for _ in range(random.choice([0, 1, 5, 40, 90, 700])))) for i in range(300)]
    rows = packing.packed(frame(spark, texts), window=128, with_ids=True).collect()
    t, docs, seqs = libs(), {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.start, r.ids))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in texts:
        at, whole = 0, b""
        for start, ids in sorted(docs[i]):
            assert start == at
            at, whole = at + len(ids) // 4, whole + bytes(ids)
        assert np.frombuffer(whole, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids + [0]
    full = [sum(n for _, n in s) for s in seqs.values()]
    # all but a few sequences of each task are full
    assert sum(full) / (128 * len(full)) > 0.97 and max(full) <= 128


def test_slack_is_least():
    random.seed(3)
    for _ in range(300):
        lengths = [random.randint(1, 30) for _ in range(random.randint(1, 8))]
        free = random.randint(0, 60)
        counts = [0] * 61
        for n in lengths:
            counts[n] += 1
        got = sum(a * b for a, b in packing.closest(counts, sorted(set(lengths), reverse=True), free))
        best = {0}
        for n in lengths:
            best |= {b + n for b in best if b + n <= free}
        assert got == max(best)


def test_piece_encoder_is_exact():
    e = pieces.encoder(pieces.default_path())
    random.seed(4)
    names = list(e.id)
    texts = ["".join(random.choice("ab the  ▁\n\té中\U0001f600.,ing") for _ in range(random.randint(0, 30))) for _ in range(3000)] + ["".join(random.choice(names) for _ in range(random.randint(1, 4))) for _ in range(3000)] + [" " * 500 + "a", "a" * 800, ""]
    got = [np.frombuffer(b"".join(b for b, _ in u), "<i4").tolist() for u in e.encode(texts)]
    assert got == e.library.encode(texts, num_threads=1)
    assert e.backtracked("▁the") == e.merged("▁the")


def test_piece_codec(spark, edges, empty):
    assert pieces.encoded(empty).count() == 0
    lib = pieces.encoder(pieces.default_path()).library
    got = {r.doc_id: r for r in pieces.encoded(edges, with_ids=True).collect()}
    for i, x in ((1, ""), (2, ""), (4, LONG), (3, "a")):
        ids = lib.encode(x)
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((lib.decode(ids) if ids else "").encode()).hexdigest()


def components_of(texts, width, percent):
    sets = {i: minhash.shingle_set(x, width) for i, x in texts}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates(spark, edges, empty):
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(6):
        base = [random.choice(words) for _ in range(120)]
        for _ in range(12):
            copy = list(base)
            for _ in range(random.randint(0, 9)):
                copy[random.randrange(120)] = random.choice(words)
            texts.append((len(texts), " ".join(copy).title() if len(texts) % 2 else " ".join(copy)))
    texts += [(500, None), (501, ""), (502, "one two"), (503, "One  Two"), (504, "one")]
    want, sizes = components_of(texts, 3, 85)
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts), width=3, threshold=0.85, rows=7).collect()}
    assert {i: r.component_id for i, r in got.items()} == want and {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert minhash.near_duplicates(empty).count() == 0
    rows = minhash.near_duplicates(edges).collect()
    assert len(rows) == len(EDGES) and {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}


def test_groups_that_the_first_text_does_not_reach(spark):
    random.seed(20)
    base, texts = [f"w{random.randrange(900)}" for _ in range(150)], []
    for _ in range(110):  # copies with few and with many changes of their own
        copy = list(base)
        for k in random.sample(range(150), random.choice([0, 1, 2, 4, 6, 8, 12])):
            copy[k] = f"x{random.randrange(10**6)}"
        texts.append((len(texts), " ".join(copy)))
    drift = [f"d{random.randrange(900)}" for _ in range(150)]
    for i in range(60):  # each text a small step from the one before
        for k in random.sample(range(150), 2):
            drift[k] = f"y{random.randrange(10**6)}"
        texts.append((1000 + i, " ".join(drift)))
    random.shuffle(texts)
    want, _ = components_of(texts, 3, 85)
    rows = minhash.near_duplicates(frame(spark, texts), width=3, threshold=0.85, rows=7).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


@pytest.mark.parametrize("top", [900, (1 << 63) - 1])
def test_texts_that_share_an_id_keep_their_links(spark, top):
    random.seed(13)
    text = lambda: [f"v{random.randrange(5000)}" for _ in range(150)]
    near = lambda x: " ".join(x[:70] + ["changed"] + x[71:])
    base = [text() for _ in range(6)]
    whole = [" ".join(x) for x in base]
    # 5 has three texts, each near another id; 9 has the text of 3 and one near 10; 20 ties 17 to 18
    texts = [(5, whole[0]), (5, whole[1]), (5, whole[2]), (6, near(base[0])), (7, near(base[1])), (8, near(base[2]))]
    texts += [(3, whole[3]), (9, whole[3]), (9, whole[4]), (10, near(base[4])), (17, whole[5]), (18, "a few other words here"), (20, whole[5]), (20, "a few other words here"), (top, "nothing like the others at all")]
    for _ in range(2):
        random.shuffle(texts)
        rows = minhash.near_duplicates(frame(spark, texts), width=3, threshold=0.85, rows=7).collect()
        assert len(rows) == len(texts)
        assert {(r.doc_id, r.component_id) for r in rows} == {(5, 5), (6, 5), (7, 5), (8, 5), (3, 3), (9, 3), (10, 3), (17, 17), (18, 17), (20, 17), (top, top)}


def test_odd_sketches_bound_the_difference():
    random.seed(21)
    s = minhash.Sketcher(3, 7, 7)
    for _ in range(200):
        x, y = (np.unique(minhash.mix(np.array(random.sample(range(400), random.randrange(1, 300)), np.uint64))) for _ in range(2))
        differ = sum(bin(int(a) & (1 << 64) - 1).count("1") for a in (s.odd(x) ^ s.odd(y)))
        assert differ <= len(set(x.tolist()) ^ set(y.tolist()))


def test_sketch_fills_and_estimates():
    s = minhash.Sketcher(3, 336, 7)
    a = minhash.mix(np.arange(400, dtype=np.uint64))
    b = minhash.mix(np.arange(60, 460, dtype=np.uint64))
    x, y = s.sketch(a), s.sketch(b)
    assert (x != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and abs((x == y).mean() - 340 / 460) < 0.12
    assert (s.sketch(a[:1]) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (7, 7)]
    got, path = components.components(spark.createDataFrame(chain, "a long, b long"))
    found = {r.node: r.component for r in got.collect()}
    assert all(found[i] == 0 for i in range(1, 21)) and found[101] == 100


def removed(texts, length):
    first, out = {}, {}
    raw = sorted((i, (x or "").encode()) for i, x in texts)
    for i, b in raw:
        for a in range(len(b) - length + 1):
            first.setdefault(b[a : a + length], i)
    for i, b in raw:
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < i:
                gone[a : a + length] = b"\1" * length
        left = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def test_repeated_strings(spark, edges, empty):
    random.seed(6)
    base = "".join(random.choice("abcdé ") for _ in range(2000))
    texts = []
    for i in range(60):
        a, n = random.randrange(1800), random.randrange(200)
        texts.append((i, "".join(random.choice("xyzü") for _ in range(random.randrange(80))) + base[a : a + n] + ("ab" * random.randrange(60))))
    texts += [(100, texts[3][1]), (101, texts[3][1]), (102, None), (103, "and " * 200), (104, "and " * 150)]
    out, _ = suffixes.deduplicated(frame(spark, texts))
    got = {r._id: (r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in out.collect()}
    assert got == removed(texts, 50)
    out, _ = suffixes.deduplicated(empty)
    assert out.count() == 0
    out, _ = suffixes.deduplicated(edges)
    rows = out.collect()
    assert len(rows) == len(EDGES) and {r._id: r._n_removed for r in rows}[5] == len(LONG) and {r._id: r._n_removed for r in rows}[None] == 0


def test_hot_names_are_dealt_by_windows(spark):
    random.seed(12)
    passage = "".join(random.choice("abcdefgh ") for _ in range(90))
    own = lambda n: "".join(random.choice("stuvwxyz") for _ in range(n))
    texts = [(i, own(30) + passage + own(30)) for i in range(40)] + [(90, passage[20:] + passage[20:]), (91, "q" * 90 + passage)]
    coder, raw = suffixes.Names(50), [t.encode() for _, t in texts]
    names = suffixes.names_of(coder, raw)
    known = np.concatenate([(np.uint64(i) << np.uint64(32)) | x.astype(np.uint64) for i, x in enumerate(names)])
    values, counts = np.unique(np.concatenate(names), return_counts=True)
    often = values[counts > 8]
    _, _, _, _, name = suffixes.strings_of(coder, raw, known, often[:0])
    data, _, begin, windows, dealt = suffixes.strings_of(coder, raw, known, often)
    assert len(often) and not np.isin(dealt, often).any() and len(np.unique(dealt)) > 10 * len(np.unique(name[np.isin(name, often)]))
    by = {}
    for a, w, n in zip(begin.tolist(), windows.tolist(), dealt.tolist()):
        for k in range(a, a + w):
            by.setdefault(data[k : k + 50].tobytes(), set()).add(n)
    assert all(len(n) == 1 for n in by.values())  # equal windows meet
    out, _ = suffixes.deduplicated(frame(spark, texts), hot=8)
    assert {r._id: (r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in out.collect()} == removed(texts, 50)


def test_column_wise_order(tmp_path):
    random.seed(7)
    for _ in range(60):
        strings = list({"".join(random.choice("ab") for _ in range(random.randint(1, 9))).encode() for _ in range(random.randint(1, 12))})
        sizes = np.array([len(s) for s in strings])
        flat, begin = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1), np.cumsum(sizes) - sizes
        for limit, block in ((1 << 20, 1 << 18), (1 << 20, 3), (4, 5)):  # in memory, and through files
            store = suffixes.column_wise(flat, begin, sizes, 4, limit, f"file://{tmp_path}", block)
            text, common, windows = (np.concatenate(x).tolist() for x in zip(*store.read()))
            store.drop()
            assert not list(tmp_path.iterdir())
            order = sorted((s[i:] + b"\0", k, len(s) - i) for k, s in enumerate(strings) for i in range(len(s) + 1))
            order.sort(key=lambda x: (x[0], x[1]))
            assert text == [strings[k][len(strings[k]) - n - 1] + 1 if n < len(strings[k]) else 0 for _, k, n in order]
            numbers = {x: i for i, x in enumerate((k, a) for k, s in enumerate(strings) for a in range(len(s) - 3))}
            assert windows == [numbers.get((k, len(strings[k]) - n), -1) for _, k, n in order]
            for i in range(1, len(order)):
                a, b = order[i - 1][0][:-1], order[i][0][:-1]
                n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
                assert common[i] == n
            owner = np.array([random.randrange(20) for _ in strings])
            got = suffixes.least_owner(flat, begin, sizes, owner, 4, limit, f"file://{tmp_path}", block).tolist()
            assert got == [min(o for o, t in zip(owner.tolist(), strings) if s[a : a + 4] in t) for s in strings for a in range(len(s) - 3)]


@pytest.mark.parametrize("length", [7, 300])
def test_other_lengths(spark, length):
    random.seed(15)
    base = "".join(random.choice("abcdefg ") for _ in range(900))
    texts = [(1, base[:350] + "one"), (2, "two " + base[:350] + " and more"), (3, "q" + base[300:800]), (4, base[350:790] + "x"), (5, "ab" * 400), (6, "ab" * 200 + "é" * 200), (7, "é" * 160)]
    out, _ = suffixes.deduplicated(frame(spark, texts), length=length)
    assert {r._id: (r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in out.collect()} == removed(texts, length)
    with pytest.raises(ValueError):
        suffixes.deduplicated(frame(spark, texts), length=0)


def test_names_are_dealt_evenly():
    random.seed(24)
    text = "".join(random.choice("abcdefghij ") for _ in range(400_000)).encode()
    names = suffixes.names_of(suffixes.Names(50), [text])[0]
    per = np.bincount(suffixes._group(names, 40), minlength=40)
    assert per.max() < 1.3 * per.mean() and per.min() > 0.7 * per.mean()


def test_one_name_with_thousands_of_strings(spark):
    random.seed(16)
    seed = "the very common twenty letters and some"  # a hot 20-gram, different windows around it
    texts = [(i, "".join(random.choice("stuvwxyz") for _ in range(30)) + seed + "".join(random.choice("stuvwxyz") for _ in range(30))) for i in range(2500)]
    texts += [(5000 + i, texts[i][1][random.randrange(9) :] + "end") for i in range(0, 2500, 7)]
    want = removed(texts, 50)
    for more in ({}, {"in_memory": 100}, {"hot": 64}):
        out, _ = suffixes.deduplicated(frame(spark, texts), **more)
        assert {r._id: (r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in out.collect()} == want


def test_lines(spark, edges, empty):
    body = "\n".join(f"line number {i} of the text" for i in range(30))
    texts = [(1, body), (2, "new line here\n" + body), (3, "alone"), (4, "x\ny"), (5, None), (6, body)]
    out, _ = linededup.deduplicated(frame(spark, texts))
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == body and got[3].text == "alone" and got[5].text is None
    assert got[6].text == "" or len(got[6].text) < len(body) // 3
    assert len(got[2].text) < len(body) // 2 and got[2]._ld_gone_chunks > 0  # the inserted line shifts no later boundary
    assert got[1]["n_words"] == "x"
    assert linededup.deduplicated(empty)[0].count() == 0
    rows = linededup.deduplicated(edges)[0].collect()
    assert len(rows) == len(EDGES)


def test_rotation(spark):
    schema = "conv_id long, turn long, role string, text string, name string"
    rows = [(1, 0, "system", "s", "z"), (1, 1, "anna", "hi", "z"), (1, 2, "bob", None, "z"), (1, 3, "cem", "yo", "z"), (2, 0, "system", "alone", "z"), (None, 0, None, "x", "z"), (1, 3, "cem", "yo", "z")]
    out, _ = rotation.rotated(spark.createDataFrame(rows, schema))
    got = {}
    for r in out.orderBy("position").collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(got) == {(1, "anna"), (1, "bob"), (1, "cem"), (None, "unknown")}
    for (conv, who), segments in got.items():
        whole = "".join(s.segment for s in segments)
        for s in segments:
            assert whole[s.start : s.start + s.length] == s.segment
            if s.role == "assistant":
                assert whole[s.mask_start : s.mask_end].endswith(rotation.END)
    bob = "".join(s.segment for s in got[1, "bob"])
    assert bob.startswith("<|system|>\ns<|end|>\n<|user|> name=anna\nhi<|end|>\n<|assistant|>\n<|end|>\n")
    assert rotation.rotated(spark.createDataFrame([], schema))[0].count() == 0


def test_neighbours(spark):
    schema = "vec_id long, embedding array<float>, label string"
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(16)], "a") for i in range(600)]
    rows += [(1000, None, "a"), (1001, [0.0] * 16, "a"), (1002, [float("nan")] * 16, "a"), (1003, [None] * 16, "a"), (1004, [1.0] * 3, "a"), (None, [1.0] * 16, "a"), (1005, rows[0][1], "a")]
    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in srs.nearest(df, df.where("vec_id % 100 = 0"), block=100, chunk=2, sure=0.7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    v = {i: np.array(x, np.float32).astype(float) for i, x, _ in rows[:600]} | {1005: np.array(rows[0][1], np.float32).astype(float)}
    assert set(got) == {0, 100, 200, 300, 400, 500}
    hits = 0
    for q, found in got.items():
        want = sorted((float(np.sqrt(((v[i] - v[q]) ** 2).sum())), i) for i in v if i != q)[:10]
        hits += len({i for _, i in want} & {i for _, i in found})
        assert found == sorted(found) and all(abs(s - np.sqrt(((v[i] - v[q]) ** 2).sum())) < 1e-9 for s, i in found)
    assert hits >= 54 and got[0][0] == (0.0, 1005)
    assert srs.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_stop_early(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = df.select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    queries = df.where("vec_id % 20 = 0")
    for more in ({}, {"block": 200}, {"block": 200, "leaves": 4}):  # one leaf, many, and leaves in parts
        got = {}
        for r in srs.nearest(df, queries, **more).collect():
            got.setdefault(r.query_id, ([], r.n_verified))[0].append(r.vec_id)
        hits = 0
        for q, (found, n) in got.items():
            d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
            hits += len(set(found) & set(ids[np.lexsort((ids, np.where(ids == q, np.inf, d)))][:10].tolist()))
            assert n <= len(ids) - 1
        share = sum(n for _, n in got.values()) / len(got) / (len(ids) - 1)
        assert len(got) == len([i for i in ids if i % 20 == 0]) and hits >= 0.95 * 10 * len(got) and share < 0.99


def test_leaves_deal_all_points():
    rng = np.random.default_rng(23)
    points = np.round(rng.standard_normal((3000, 4)), 1)
    tree = srs.splits(points, 16)
    leaf = srs.leaf_of(tree, points)
    assert 8 <= len(set(leaf.tolist())) <= 16 and np.bincount(leaf).max() < 600
    assert srs.leaf_of(srs.splits(points[:0], 8), points).max() == 0 and srs.leaf_of(srs.splits(points * 0, 8), points).max() == 0


def test_chi_square():
    rng = np.random.default_rng(9)
    x = (rng.standard_normal((40000, 8)) ** 2).sum(axis=1)
    for t in (4.0, 8.0, 15.5):
        assert abs(srs.chi_square(t, 8) - (x < t).mean()) < 0.01


def test_counts_by_brute_force():
    import re

    random.seed(10)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for _ in range(400):
        x = "".join(random.choice("ab \n\t#é!A\x0b ") for _ in range(random.randint(0, 60)))
        w = word.findall(x)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        lines = [y for y in x.split("\n") if word.search(y)]
        dup = sum(1 for i, y in enumerate(lines) if y in lines[:i])
        assert quality_rules.text_counts(x)[:5] == ((len(w), sum(map(len, w)), sum(x.count(c) for c in "#*$%&|<>") if w else 0, dup, len(hit)) if w else (0, 0, 0, 0, 0))


def test_tail_is_exact():
    from math import comb

    for n, k, p in ((10, 0, 0.1), (50, 3, 0.05), (200, 1, 0.02), (30, 12, 0.2)):
        assert abs(quality_rules.tail(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12
    p = 0.04 / 6
    for n in (10**4, 10**6, 10**9, 10**10):
        for away in (0, -4, 4):
            k = int(n * p + away * (n * p * (1 - p)) ** 0.5)
            # the whole distribution sums to 1, whichever end the sum begins at
            assert abs(quality_rules.tail(k, n, p) + quality_rules.tail(n - k - 1, n, 1 - p) - 1) < 1e-9
    # 4 standard deviations below, by integers
    from fractions import Fraction

    n, q = 3000, Fraction(1, 50)
    exact = sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(31))
    assert abs(quality_rules.tail(30, n, 0.02) / float(exact) - 1) < 1e-11
    # sums of more than 2000 terms: at most 20000 terms of 10**10, one by one
    n, k = 10**10, int(10**10 * p - 4 * (10**10 * p * (1 - p)) ** 0.5)
    terms = [quality_rules.point(i, n, p) for i in range(k - 40000, k + 1)]
    assert abs(quality_rules.tail(k, n, p) / sum(terms) - 1) < 1e-6 and sum(terms[-2000:]) < 0.7 * sum(terms)


def test_kept_is_what_the_bounds_allow(spark):
    from math import comb

    random.seed(17)
    texts, quality = [], {}
    for i in range(900):
        n_odd = random.choice([0, 0, 0, 1, 2, 12, 30]) if i % 4 else random.randint(0, 60)
        texts.append((i, " ".join([f"w{i}x{j}" for j in range(60)] + ["$$$$$$"] * (n_odd and 1) + [f"a{j}$%&" for j in range(n_odd)])))
        quality[i] = int(i % 4 > 0)
    docs = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a"))
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r._kept for r in quality_rules.judged(docs, labels, risk=0.6, error=0.2)[0].collect()}
    rules, share = quality_rules.RULES, 0.6 / len(quality_rules.RULES)
    counts = {i: dict(zip(quality_rules.COUNTS + quality_rules.MORE, quality_rules.text_counts(x))) for i, x in texts}
    ratio = lambda i, r: counts[i][rules[r][0]] / max(counts[i][rules[r][1]], 1)
    failed = lambda i: counts[i]["n_words"] < 50 or 100 * counts[i]["n_repeat_words"] > 50 * counts[i]["n_words"]
    cuts = {}
    for stratum in (0, 1):
        good = [i for i, _ in texts if i % 2 == stratum and quality[i] == 1 and zlib.crc32(str(i).encode()) % 4 != 2 and not failed(i)]
        for r in rules:
            for c in sorted(quality_rules.GRID, reverse=True):
                k, n = sum(ratio(i, r) > c for i in good), len(good)
                if sum(comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(k + 1)) <= 0.2 / (len(rules) * len(quality_rules.GRID) * 2):
                    cuts[stratum, r] = c
    assert cuts and got == {i: not failed(i) and not any(ratio(i, r) > cuts.get((i % 2, r), 1e9) for r in rules) for i, _ in texts}
    assert len(set(got.values())) == 2


def test_rules(spark, edges, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_rules.judged(edges, labels)[0].collect()
    assert len(rows) == len(EDGES) and all(r._kept == (not r._base_failed) for r in rows)
    assert quality_rules.judged(empty, labels)[0].count() == 0
    good = "plain words in a row of some length that differ each time " + " ".join(f"w{i}" for i in range(60))
    bad = " ".join(f"x{i}$$$" for i in range(80))
    texts = [(i, (good + f" n{i}") if i % 5 else (bad + f" n{i}")) for i in range(6000)]
    labels = spark.createDataFrame([(i, 1 if i % 5 else 0, 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r._kept for r in quality_rules.judged(frame(spark, texts), labels)[0].collect()}
    assert not any(out[i] for i in range(0, 6000, 5)) and sum(out[i] for i in range(6000) if i % 5) > 0.95 * 4800


def test_rule_ensemble():
    rng = np.random.default_rng(11)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)
    bias, rules = rule_ensemble.fit(x, y)
    score = 1 / (1 + np.exp(-(bias + sum(w * rule_ensemble.holds(r, x) for r, w in rules))))
    assert ((score >= 0.5) == (y == 1)).mean() > 0.98 and len(rules) < 60
    assert rule_ensemble.fit(x[:0], y[:0]) == (0.0, []) and rule_ensemble.fit(x, y * 0)[1] == []


def test_compiled_rules_are_the_rules(spark):
    rng = np.random.default_rng(18)
    x = np.round(rng.random((400, 3)), 2)  # values at the cuts too
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] < 0.3)).astype(float)
    bias, rules = rule_ensemble.fit(x, y)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    got = np.array([r.s for r in df.select("i", rule_ensemble.compiled(bias, rules, ["a", "b", "c"]).alias("s")).orderBy("i").collect()])
    want = 1 / (1 + np.exp(-(bias + sum(w * rule_ensemble.holds(r, x) for r, w in rules))))
    assert len(rules) > 1 and np.abs(got - want).max() < 1e-12


def test_sample_is_bounded(spark, monkeypatch):
    seen, fit = [], rule_ensemble.fit
    monkeypatch.setattr(rule_ensemble, "fit", lambda x, y, **m: (seen.append(len(x)), fit(x, y, **m))[1])
    texts = [(i, f"words {i} " * (5 + i % 50)) for i in range(1200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    assert rule_ensemble.scored(frame(spark, texts), labels, sample=400)[0].count() == 1200
    assert 150 < seen[0] <= 400


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out, _ = rule_ensemble.scored(util.documents(spark, sf), labels)
    both = out.join(labels, "doc_id").where("held_out").toPandas()
    assert (both.predicted == both.quality).mean() > 0.95 and out.where("score NOT BETWEEN 0 AND 1").count() == 0


def test_scored_edges(spark, edges, empty):
    labels = spark.createDataFrame([(3, None, 0)], "doc_id long, quality int, toxic int")
    out, _ = rule_ensemble.scored(edges, labels)
    assert [r.score for r in out.collect()] == [0.5] * len(EDGES)
    assert rule_ensemble.scored(empty, labels)[0].count() == 0


@pytest.mark.parametrize("name", ["op6_line_chunk_dedup", "op7_perspective_rotation"])
def test_llm_oracle(spark, sf, name):
    import duckdb
    import pandas as pd

    from tessera.llm import queries

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda f: sorted(repr(tuple(None if pd.isna(x) else (x if isinstance(x, str) else int(x)) for x in r)) for r in f[names].itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = util.documents(spark, sf)
    base = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = util.staged(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == base and docs.count() > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.agg({"length": "sum"}).first()[0] == sum(len(libs().encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.select("text").collect())


def test_pipeline_edges(spark, edges, empty, sf):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        stage(spark, empty, sf).count()
        stage(spark, edges, sf).count()


def test_pipeline_with_any_extra_columns(spark, sf):
    """Columns under the operators' own names pass through, with the values of their rows; two threads keep apart."""
    import threading

    import corpus_pipeline

    docs = util.documents(spark, sf)
    more = ["_id", "_text", "_s", "_gone", "_ld_id", "_kept", "_row", "_sha", "_key", "rep", "sha", "kept", "Text", "extra_0"]
    wide = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) if c != "Text" else F.lit("t").alias("extra_t") for c in more])
    wide = wide.toDF(*["Text" if c == "extra_t" else c for c in wide.columns])
    plain, got = docs, wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, _ = util.staged(stage(spark, plain, sf), "plain")
        got = stage(spark, got, sf).toDF(*docs.columns, *[f"m{i}" for i in range(len(more))])
        got, _ = util.staged(got, "wide")
        assert got.where("m0 <> concat('_id', doc_id) OR m12 <> 't'").count() == 0
        assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in plain.select("doc_id").collect())
        got = got.toDF(*docs.columns, *more)
    left: list = []
    one = threading.Thread(target=lambda: (corpus_pipeline._begin(spark), left.append(getattr(corpus_pipeline._LEFT, "paths", None))))
    corpus_pipeline._begin(spark, "/tmp/no-such-table")
    one.start()
    one.join()
    assert left == [()] and corpus_pipeline._LEFT.paths == ("/tmp/no-such-table",)
    corpus_pipeline._begin(spark)
