"""Exact deduplication and mixing against plain computations."""

import hashlib
import math
import re
from collections import Counter

from kindred.llm import exact_dedup, mixing

ROWS = [
    (5, "a  b"), (2, "a\tb"), (9, "a\x0b\r\nb"), (2, "a b"), (1, None), (3, ""), (4, " "), (7, "\n"), (None, "a b"), (None, "only"), (None, "only"),
    (8, "x" * 200_000), (6, "x" * 200_000), (10, "a b\xa0"),
]


def test_annotate_and_deduplicate(spark):
    docs = spark.createDataFrame([(i, t, k, {"m": 1}, "z") for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, body int, h map<string,int>, kept string")
    groups = {}
    for i, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    assert sorted(map(tuple, exact_dedup.annotate(docs).collect()), key=repr) == sorted(want, key=repr)
    kept = exact_dedup.deduplicate(docs)
    got = kept.collect()
    assert kept.schema == docs.schema and len(got) == len(groups)
    rows = {(r.doc_id, r.text) for r in got}
    assert rows <= set(ROWS) and {i for i, _ in rows} == {w[1] for w in want}
    assert exact_dedup.annotate(docs.limit(0)).count() == 0 and exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_weights_meet_the_targets(spark):
    rows = [(k, "w " * 40, "big" if k % 3 else f"s{k % 4}") for k in range(400)] + [(900, None, "void"), (901, "one two", None), (902, "", "big")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, tokens int")
    for entropy, most in ((0.9, 50.0), (0.99, 2.0), (0.1, 4.0)):
        plan = {r.key: r for r in mixing.plan(docs, "source", "text", 1.0, entropy, most, 500).collect()}
        tokens = Counter()
        for _, t, s in rows:
            tokens[":" + s if s is not None else ""] += len((t or "").split())
        tokens = {s: n for s, n in tokens.items() if n}
        total = sum(tokens.values())
        assert {k: r.tokens for k, r in plan.items()} == tokens and abs(sum(r.weight for r in plan.values()) - 1) < 1e-9
        h = -sum(r.weight * math.log(r.weight) for r in plan.values())
        natural = all(abs(r.weight - tokens[k] / total) < 1e-9 for k, r in plan.items())
        assert natural or h <= entropy * math.log(len(plan)) + 1e-9 and all(r.weight * total / r.tokens <= most + 1e-6 for r in plan.values())
        drawn = mixing.mix(docs, target_entropy=entropy, most_epochs=most, block_tokens=500).collect()
        got = Counter()
        for r in drawn:
            got[":" + r.source if r.source is not None else ""] += r.n_tokens
        for k, r in plan.items():
            goal = r.epochs * r.tokens + r.rest
            assert goal - 41 < got[k] <= goal  # within one document below the budget
        per_epoch = Counter((r.doc_id, r.epoch) for r in drawn)
        assert set(per_epoch.values()) <= {1}
    kept = mixing.remix(docs)
    lone = spark.createDataFrame([(None, f"w {k}", "big") for k in range(300)], "doc_id long, text string, source string")
    spread = mixing.mix(lone, block_tokens=10).groupBy("block").count().collect()
    assert len(spread) > 30 and max(r["count"] for r in spread) < 40  # rows without an id don't share a block
    assert kept.schema == docs.schema and mixing.remix(docs.limit(0)).count() == 0
