"""The Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from kindred.llm import jaccard_join as J
from kindred.llm import wordhash
from kindred.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, label string")
    return sorted(map(tuple, J.jaccard_components(df).collect()), key=repr), df


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passage, texts = words(40), []
    for _ in range(25):
        base = words(rng.choice([3, 5, 8, 20, 60, 120]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            new = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                new[rng.randrange(len(new))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(new))
    texts += [" ".join(passage + words(rng.choice([2, 6, 12, 40]))) for _ in range(25)]
    long = words(3000)
    texts += [" ".join(long), " ".join(long[:2400]), " ".join(long[:2100]).upper(), " ".join(long) + "\n"]
    chain = words(400)
    texts += [" ".join(chain[k : k + 200]) for k in range(0, 200, 15)]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        rows += [rows[0], rows[0], (None, rows[1][1]), (1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A\tB"), (6, "b a"), (None, "lone words of one row only"), (7, "é " * 9)]
        got, df = run(spark, rows)
        assert got == brute(rows)
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    want = {i for i, _, c in brute(rows) if i == c}
    assert {r.doc_id for r in kept.collect()} - {None} == want - {None}


def linked_rows(rows):
    """For each row, the rows that it is linked with."""
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: (common := len(sets[a] & sets[b])) and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common)
    return [{b for b in range(len(rows)) if b != a and near(a, b)} for a in range(len(rows))]


def test_links_within_and_between_families(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 8)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    family = [" ".join(w if rng.random() > 0.02 else f"y{rng.randrange(99)}" for w in base) for _ in range(40)]
    rows = [*corpus(3), *enumerate([*family, family[0], family[0].upper(), "lone words", ""], 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = linked_rows(rows)
    got = {r.doc_id: r for r in J.jaccard_counts(df).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(w) for (i, _), w in zip(rows, want)}
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.values()) == sorted(brute(rows))
    links, members = J.jaccard_links(df)
    of = {}
    for r in members.collect():
        of.setdefault(bytes(r.set_id), []).append(r.doc_id)
    pairs = [(bytes(r.a), bytes(r.b)) for r in links.collect()]
    assert len(set(pairs)) == len(pairs) and all(a < b for a, b in pairs)
    found = {(x, y) for a, b in pairs for x in of[a] for y in of[b]} | {(x, y) for ids in of.values() for x in ids for y in ids if x != y}
    assert found | {(y, x) for x, y in found} == {(rows[k][0], rows[m][0]) for k, w in enumerate(want) for m in w}


def test_empty_table(spark):
    assert run(spark, [])[0] == []


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 1 << 48, 300).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in "ab")
        for bits in (64, 256):
            assert J.overlap_bound(len(a), J.bitmap(a, bits), len(b), J.bitmap(b, bits)) >= len(np.intersect1d(a, b))
        assert (np.bitwise_or.reduce(J.bitmap(a, 256).reshape(-1, 8)) == J.bitmap(a, 64)).all()
        assert (J.unpack(J.pack(a)) == a).all()


def test_word_hashes_tell_words_apart():
    rng = random.Random(5)
    texts = ["".join(rng.choices("aAbB \t\n\x0b\x1cé,", k=rng.randrange(30))) for _ in range(400)] + ["", " ", "a"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    hashes, many = wordhash.words(np.frombuffer(b"".join(data), np.uint8), offsets)
    expected = [d.lower().split() for d in data]
    assert many.tolist() == [len(e) for e in expected]
    flat = [w for e in expected for w in e]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 201), (201, 200), (202, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(31)} | {100 + k: 100 for k in range(40)} | {200: 200, 201: 200, 202: 200}


def test_tables_of_a_few_words(spark):
    for text in ("one", "two words", "a b c", "a b c d", "a b c d e"):
        assert run(spark, [(1, text)])[0] == brute([(1, text)])
    rows = [(k, " ".join("abcdef"[: k % 5])) for k in range(12)]
    assert run(spark, rows)[0] == brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in J.one_of_each(df.repartition(12)).collect()} == {0, 1, 2, 3, 4, 5, 10}


def test_words_of_one_form_are_told_apart(spark):
    """Complementary Thue-Morse words agree under any polynomial hash modulo 2 ** 64."""
    rows = []
    for size in (8, 64, 1024, 2048):
        word = "".join("ab"[k.bit_count() % 2] for k in range(size))
        rows += [(len(rows), word), (len(rows) + 1, word.translate(str.maketrans("ab", "ba")))]
    rows += [(90, "x" * 8), (91, "x" * 16), (92, "x" * 256), (93, "x" * 257), (94, "X" * 257), (95, "y" * 257)]
    assert run(spark, rows)[0] == brute(rows)
    data = "".join(t + " " for _, t in rows).encode()
    hashes, many = wordhash.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert many.tolist() == [len(rows)] and len(set(hashes.tolist())) == len(rows) - 1


def test_linked_sizes_are_at_most_a_band_apart(spark):
    sizes = spark.range(1, 3000).select("id", J.size_band(F.col("id")).alias("band"))
    band = {r.id: r.band for r in sizes.collect()}
    assert all(band[min(2999, 4 * n // 3)] - band[n] <= 1 for n in band)
