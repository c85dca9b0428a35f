"""Chat formatting: exact round trips, and the loss mask against the texts themselves."""

import hashlib
import random

import numpy as np

from kindred.llm import chat


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(conv, turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_escapes_are_reversible():
    random.seed(3)
    for _ in range(3000):
        text = "".join(random.choices(["<", "[", "\\", "|", "/", "s>", "INST]", "/s>", "im_end|>\n", "<|im_start|>", "a\n"], k=8))
        body = chat.escaped(text)
        assert chat.unescaped(body) == text and "<|" not in body and "</s>" not in body and "[INST]" not in body
        turns = [(text, text), ("assistant", text)]
        formatted, spans = chat.render(turns)
        assert chat.read_back(formatted) == turns and chat.unescaped(formatted[slice(*spans[-1])]) == text


def test_query_rows(spark):
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", None), (1, 2, "assistant", " \n\nwhite  space\n"), (1, 3, "assistant", ""),
        (2, 1, "assistant", "é中🙂</s>"), (2, 0, "user", "x <|endoftext|>"), (3, None, "assistant", "a"), (3, 0, None, "b"),
        (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "assistant", "long " * 40_000),
        (None, 0, "assistant", "lone"), (None, 0, "user", "lone"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {(r.conv_id, r.turns_sha256): tuple(r) for r in chat.digests(chat.format_conversations(chat.with_probe(df))).collect()}
    groups = {}
    for conv, turn, role, text in [*rows, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]:
        groups.setdefault(conv if conv is not None else (role, text), []).append((turn is not None, turn or 0, role or "", text or ""))
    want = [expected(c if not isinstance(c, tuple) else None, [(r, t) for _, _, r, t in sorted(g)]) for c, g in groups.items()]
    assert len(got) == len(want)
    for w in want:
        assert got[w[0], w[2]][:5] == w
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_mask_equals_a_plain_intersection():
    rng = random.Random(4)
    for _ in range(300):
        cuts = sorted({0, 40, *(rng.randrange(40) for _ in range(12))})
        offsets = np.array(list(zip(cuts, cuts[1:])))
        a = sorted(rng.sample(range(41), 4))
        spans = [(a[0], a[1]), (a[2], a[3])]
        mask, chars = chat.masked(offsets, spans)
        assert mask.tolist() == [any(s < e2 and s2 < e for s2, e2 in spans) for s, e in offsets.tolist()]
        assert chars == spans
