"""The language model against plain counting, and the trie against dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from kindred.llm import lm_scoring as L
from kindred.llm.elias_fano import EliasFano, Trie

U = np.uint64


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    one, two = Counter(), Counter()
    for (_, t), h in zip(rows, held):
        if not h:
            w = words(t)
            one.update(w)
            two.update(zip(["<begin>", *w], w))
    n, v, texts = sum(one.values()), len(one), one[None]
    p1 = lambda w: math.log10((one[w] + 1) / (n + v + 1))
    out = []
    for (i, t), h in zip(rows, held):
        w, score, unseen = words(t), 0.0, 0
        for u, x in zip(["<begin>", *w], w):
            c = texts if u == "<begin>" else one[u]
            if two[u, x]:
                score += math.log10(L.SEEN * two[u, x] / c)
            else:
                unseen += 1
                score += p1(x) + (math.log10(1 - L.SEEN) if c else 0)
        out.append((i, h, len(w), sum(one[x] > 0 for x in w), n, sum(map(p1, w)), score, unseen))
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, slice int")
    return [tuple(r) for r in L.lm_scores(docs).collect()]


def close(got, want):
    key = lambda r: (repr(r[0]), r[2], r[3], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] + g[7:] for g in got] == [w[:5] + w[7:] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-8 and abs(g[6] - w[6]) <= 2 * w[2] / L.STEP + 1e-6


def test_equals_plain_counting(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["the", "The", "of", f"w{rng.randrange(30)}", f"x{rng.randrange(4000)}"]) for _ in range(rng.choice([0, 1, 5, 60])))) for k in range(150)]
    rows += [(None, None), (None, "the of"), (3, rows[3][1]), (200, None), (201, " \t\n"), (202, "é\x0bÉ É é"), (203, "long " * 70_000 + "tail")]
    close(run(spark, rows), brute(rows))
    close(run(spark, rows[:1]), brute(rows[:1]))
    assert run(spark, []) == []


def test_all_held_out(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "a b a") for i in ids]
    close(run(spark, rows), brute(rows))


def test_elias_fano_equals_sorted_arrays():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (5, 100), (1000, 1 << 48), (1000, 1500), (20_000, 1 << 60)):
        v = np.unique(rng.integers(0, universe, n).astype(U))
        e = EliasFano(len(v), *EliasFano.parts(v, universe))
        q = np.concatenate([v, rng.integers(0, universe, 500).astype(U), np.array([0, universe - 1], U)])
        assert (e.get(np.arange(len(v))) == v).all() and (e.successor(q) == np.searchsorted(v, q)).all()


def test_trie_equals_a_dictionary(tmp_path):
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(0, 1 << 48, 500).astype(U))
    one, back = rng.integers(0, 65536, (2, len(words)))
    for bits in (32, 40):
        key = np.unique((rng.integers(0, len(words), 9000).astype(U) << U(bits)) | rng.integers(0, 1 << 12, 9000).astype(U))
        context, follower, two = (key >> U(bits)).astype(np.int64), key & U((1 << bits) - 1), rng.integers(1, 65536, len(key))
        image = Trie.image(words, one, back, context, follower, two, 48, bits)
        (tmp_path / "trie").write_bytes(image)
        known = dict(zip(key.tolist(), two.tolist()))
        asked = np.concatenate([words, rng.integers(0, 1 << 48, 100).astype(U)])
        which, wanted = rng.integers(0, len(asked), 5000), rng.integers(0, 1 << 12, 5000).astype(U)
        for trie in (Trie.mapped(image), Trie.open(str(tmp_path / "trie"))):
            node = trie.find(asked)
            assert node[: len(words)].tolist() == list(range(len(words))) and (node[len(words) :] < 0).all()
            assert (trie.probabilities(node, 7) == np.append(one, [7] * 100)).all() and (trie.back_offs(node) == np.append(back, [0] * 100)).all()
            start, stop = trie.children(node)
            assert (stop - start)[: len(words)].tolist() == [int((context == k).sum()) for k in range(len(words))] and (stop == start)[len(words) :].all()
            assert trie.below(node, which, wanted).tolist() == [known.get((int(node[a]) << bits) | b, 0) if node[a] >= 0 else 0 for a, b in zip(which.tolist(), wanted.tolist())]
            assert (trie.below(node, context, follower) == two).all()
    none = np.zeros(0, np.int64)
    empty = Trie.mapped(Trie.image(none, none, none, none, none, none, 48, 32))
    assert (empty.find(words) == -1).all() and not empty.below(empty.find(words), which % 500, wanted).any()


def test_rows_may_come_in_another_order_each_time(spark):
    """Each evaluation of the input gives its rows in a new order."""

    def shuffled(batches):
        for batch in batches:
            yield batch.take(np.random.default_rng().permutation(batch.num_rows))

    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["the", "of", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(40)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInArrow(shuffled, "doc_id long, text string")
    assert [r.doc_id for r in docs.collect()] != [r.doc_id for r in docs.collect()]
    close([tuple(r) for r in L.lm_scores(docs).collect()], brute(rows))


def test_contexts_are_dealt_over_buckets(monkeypatch):
    """A frequent context goes to several buckets, each follower to one, and every bucket learns the context's count."""
    import pyarrow as pa

    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", f"w{rng.randrange(900)}"]) for _ in range(30)) for _ in range(200)]
    s = L.tokens(pa.RecordBatch.from_pydict({"text": texts, "held_out": [k % 7 == 2 for k in range(200)]}))
    again, ids, nulls = L.unpacked(L.packed(s, pa.array([*range(199), None])))
    assert all((a == b).all() for a, b in zip(s, again)) and ids[:199].tolist() == list(range(199)) and nulls.tolist() == [False] * 199 + [True]
    the = s.words[np.bincount(s.tokens).argmax()]
    d = L.Deal(8, np.array([the], U), np.array([5]))
    x = L.layout(s, d)
    pairs = set(zip(L.before(s).tolist(), s.tokens.tolist()))
    assert set(zip(x.context.tolist(), x.follower.tolist())) == pairs and len(pairs) == len(x.context)
    assert (x.context[x.token] == L.before(s)).all() and (x.follower[x.token] == s.tokens).all()
    with_the = [b for b in x.bounds if (s.words[x.context[b[3] : b[4]]] == the).any() or b[8] > b[7]]
    assert len(with_the) == 5 and len(x.guest) == 4 and (s.words[x.guest] == the).all()
    spans = sorted((a, b) for bound in x.bounds for a, b in ((bound[3], bound[4]), (bound[7], bound[8])) if b > a)
    assert spans[0][0] == 0 and spans[-1][1] == len(pairs) and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
    assert x.of_word.sum() + x.of_guest.sum() == len(pairs)
