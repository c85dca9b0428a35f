"""The toxicity network: gradients, held-out accuracy, and scores that depend on the text alone."""

import math
import random
import re
import zlib
from pathlib import Path

import numpy as np

from kindred.llm import toxicity as T
from kindred.llm.common import release


def labelled(n, seed):
    rng = random.Random(seed)
    texts, toxic = [], []
    for k in range(n):
        words = [f"{rng.choice('bcdfgmnprt')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.randrange(40)}" for _ in range(rng.choice([5, 40, 300]))]
        bad = k % 5 == 0
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["vileone", "wretch", f"scorn{rng.randrange(90)}"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, np.array(toxic)


def scores(model, texts):
    data = [t.encode() for t in texts]
    return model.score(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))[0]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = T.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(6, 5, T.INPUTS))
    mask = np.arange(6)[:, None] < np.array([6, 3, 1, 5, 0])
    x, y = np.where(mask[..., None], x, 0), np.array([1, 0, 1, 1, 0])

    def loss():
        p = T.sigmoid(wide(x, mask))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    wide = net.logits
    grads = net.gradients(x, mask, y)
    for name, g in grads.items():
        for _ in range(3):
            at = tuple(rng.integers(s) for s in net.p[name].shape)
            was, step = net.p[name][at], 1e-2
            net.p[name][at] = was + step
            up = loss()
            net.p[name][at] = was - step
            down = loss()
            net.p[name][at] = was
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3, name


def test_held_out_accuracy_and_windows():
    model = T.fit(*labelled(600, 1))
    texts, toxic = labelled(200, 2)
    p = scores(model, texts)
    assert ((p >= T.THRESHOLD) == toxic).mean() > 0.95
    alone = np.concatenate([scores(model, [t]) for t in texts[:20]])
    assert np.allclose(alone, p[:20], atol=1e-5)  # neighbours don't matter
    clean = " ".join(t for t, y in zip(texts, toxic) if not y)
    assert scores(model, [clean + " vileone wretch scorn5 wretch"])[0] > 0.3  # the end of a long text counts


def plain_score(model, text):
    """The score by loops over windows, directions, words and units."""
    net, p, n = model.network, model.network.p, T.HIDDEN
    data = np.frombuffer(text.encode(), np.uint8)
    words = T.read(data, np.array([0, len(data)]))
    sig = lambda v: 1 / (1 + math.exp(-v))
    x = []
    for k in range(words.counts[0]):
        row = [float(model.tables[0][words.bucket[k]])]
        for (bucket, low, high), table in zip(words.grams, model.tables[1:]):
            runs = [float(table[b]) for b in bucket[low[k] : high[k]]]
            row += [max(runs), sum(runs) / len(runs)] if runs else [0.0, 0.0]
        for table, place in zip(net.vectors, words.vectors[k]):
            row += [float(v) for v in table[place]]
        x.append(row)
    best, begin = -math.inf, 0
    while True:
        part = x[begin : begin + T.WINDOW]
        states = {}
        for d in "fb":
            h = [0.0] * n
            for t in range(len(part)) if d == "f" else reversed(range(len(part))):
                gx = [sum(v * p["W" + d][i, j] for i, v in enumerate(part[t])) + p["b" + d][j] for j in range(3 * n)]
                gh = [sum(v * p["U" + d][i, j] for i, v in enumerate(h)) for j in range(3 * n)]
                z, r = [sig(gx[j] + gh[j]) for j in range(n)], [sig(gx[n + j] + gh[n + j]) for j in range(n)]
                c = [math.tanh(gx[2 * n + j] + r[j] * gh[2 * n + j]) for j in range(n)]
                h = [c[j] + z[j] * (h[j] - c[j]) for j in range(n)]
                states[d, t] = h
        both = [states["f", t] + states["b", t] for t in range(len(part))]
        e = [sum(math.tanh(sum(v * p["A"][i, j] for i, v in enumerate(s))) * p["v"][j] for j in range(n)) for s in both]
        a = [math.exp(v) for v in e]
        context = [sum(w * s[i] for w, s in zip(a, both)) / sum(a) for i in range(2 * n)] if both else [0.0] * (2 * n)
        best = max(best, sum(v * p["w"][i] for i, v in enumerate(context)) + p["c"][0])
        if begin + T.WINDOW >= len(x):
            return sig(best)
        begin += T.WINDOW // 2


def test_scores_equal_plain_loops():
    model = T.fit(*labelled(300, 5))
    assert any(v.any() for v in model.network.vectors)
    texts = [*labelled(6, 8)[0], "", " \n", "vileone", "a bc d\u00e9f wretch " * 9]
    assert np.allclose(scores(model, texts), [plain_score(model, t) for t in texts], atol=1e-4)


def test_training_rows_are_bounded(spark, monkeypatch):
    texts, toxic = labelled(60, 9)
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0])] * 50 + [(1, "other text")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(y)) for k, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(T, "fit", lambda texts, toxic: seen.append((texts, toxic)))
    T.train(docs, labels, text_bytes=5000)
    T.train(docs, labels, rows=7)
    T.train(docs, labels)
    (few, _), (seven, _), (every, marks) = seen
    assert 1000 < sum(map(len, few)) <= 5000 and len(seven) == 7
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert every == ["other text" if k == 1 else texts[k] for k in ids] and marks.tolist() == [toxic[k] for k in ids]


def test_training_gives_memory_back(spark):
    """What stays with the driver is the model, some 6 MB, and not what training has used."""
    texts, toxic = labelled(2000, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").localCheckpoint()
    labels = spark.createDataFrame([(k, 1, int(y)) for k, y in enumerate(toxic)], "doc_id long, quality int, toxic int").localCheckpoint()
    used = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    release()
    before = used()
    model = T.train(docs, labels)
    assert model.network and used() - before < 30


def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 1000])
    first, size, text = T.windows(counts)
    begin = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        seen = np.zeros(n, int)
        for f, s in zip(first[text == k], size[text == k]):
            seen[f - begin[k] : f - begin[k] + s] += 1
        assert (seen >= 1).all() and (size[text == k] >= 0).all()
        assert n <= T.WINDOW or (size[text == k] > T.WINDOW // 2).all()


def test_query_rows(spark):
    texts, toxic = labelled(300, 3)
    rows = [(k, t, "en", 0.5) for k, t in enumerate(texts)] + [(None, None, None, None), (900, "", "en", 1.0), (901, " \n", "en", 1.0), (1, texts[1], "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(k, 1, int(y)) for k, y in enumerate(toxic)] + [(5, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.train(docs, labels)
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    kept = T.clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r.doc_id for r in got if r.doc_id is not None and not r.predicted)
    nothing = T.train(docs, labels.limit(0))
    assert {r.score for r in T.score(docs, nothing).collect()} == {0.1} and T.score(docs.limit(0), model).count() == 0
