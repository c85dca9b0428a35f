"""Byte-level BPE as finite-state transducers.

Two machines in cascade. `Splitter` is a small deterministic automaton over classes of code points that marks
where pieces begin; a text is cut into chunks, each chunk's map from every entry state to its exit state is
computed for all chunks in lockstep, and the maps compose by a parallel prefix scan, which gives each chunk's true
entry state. `Merges` compiles a merge table into a transducer over the bytes of a piece. It is determinised
lazily: a state holds, for each place where a token could still be open, the vocabulary-trie node reached and the
tokens before it that are not settled yet. On a byte the state emits the tokens that all open alternatives agree
on; the lookahead is bounded by the longest token. A transition so carries both its tokens and their number.

The last token of each prefix is unique: it is the vocabulary token that ends there and whose left neighbour
would stay apart from it under the merges (`apart`).
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np

#: States that a worker compiles (later ones are simulated, as a lazy automaton does when its cache is full),
#: neighbour pairs that it remembers, and pieces.
MOST_STATES, MOST_PAIRS, MOST_PIECES = 40_000, 100_000, 400_000
CHUNK = 512


class Merges:
    """tokens: the bytes of each id (None: unused). rank: an order of the merged tokens, as {id: rank}."""

    def __init__(self, tokens: list[bytes | None], rank: dict[int, int]):
        self.tokens, self.rank = tokens, rank
        ids = {b: i for i, b in enumerate(tokens) if b is not None}
        self.made: dict[tuple[int, int], int] = {}  # the merge that makes each longer token
        self.left: dict[int, tuple[tuple[int, int], ...]] = {}  # first parts, the token itself first: (id, when made)
        self.right: dict[int, tuple[tuple[int, int], ...]] = {}
        usable = []
        for i in sorted((i for i, b in enumerate(tokens) if b), key=lambda i: (len(tokens[i]) > 1, rank.get(i, -1))):
            b = tokens[i]
            if len(b) == 1:
                self.left[i] = self.right[i] = ((i, -1),)
                usable.append(i)
                continue
            for k in range(1, len(b)):
                x, y = ids.get(b[:k]), ids.get(b[k:])
                if x in self.left and y in self.left and self.apart(x, y, rank[i]):
                    self.made[x, y] = i
                    self.left[i], self.right[i] = ((i, rank[i]), *self.left[x]), ((i, rank[i]), *self.right[y])
                    usable.append(i)
                    break
        self.next: list[dict[int, int]] = [{}]  # trie of the usable tokens
        self.ends: list[int] = [-1]
        for i in usable:
            node = 0
            for c in tokens[i]:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                node = self.next[node][c]
            self.ends[node] = i
        self.known: dict[tuple[int, int], bool] = {}
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self._begin()

    def apart(self, x: int, y: int, before: float = float("inf")) -> bool:
        """Whether no merge made before that time joins anything across the border of the neighbours x and y.

        Going back in time along the right edge of x and the left edge of y, each pair that ever met at the border
        must not have a merge that was due while both stood there. The leftmost of equal merges comes first.
        """
        a, b, i, j = self.right[x], self.left[y], 0, 0
        x_goes = y_goes = before
        while True:
            (p, p_at), (q, q_at) = a[i], b[j]
            m = self.made.get((p, q))
            if m is not None and (r := self.rank[m]) < x_goes and (r <= y_goes if y_goes != before else r < before):
                return False
            if q_at >= p_at and q_at >= 0:
                y_goes, j = q_at, j + 1
            elif p_at >= 0:
                x_goes, i = p_at, i + 1
            else:
                return True

    def _begin(self) -> None:
        self.keys = {((0, (-1,)),): 0}
        self.states: list[tuple] = [((0, (-1,)),)]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.rest: list[tuple[int, ...]] = [()]  # what the end of a piece emits

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        open_, ended = [], None
        for node, before in self.states[state]:
            child = self.next[node].get(byte)
            if child is None:
                continue
            if ended is None and (token := self.ends[child]) >= 0:
                pair = (before[-1], token)
                fits = self.known.get(pair)
                if fits is None:
                    fits = self.known[pair] = pair[0] < 0 or self.apart(*pair)
                if fits:
                    ended = (*before, token)
            if self.next[child]:
                open_.append((child, before))
        open_.append((0, ended))
        common = 0
        first = open_[0][1]
        shortest = min(len(p) for _, p in open_)
        while common < shortest and all(p[common] == first[common] for _, p in open_):
            common += 1
        key = tuple((node, p[common - 1 :]) for node, p in open_)
        to = self.keys.get(key)
        if to is None:
            to = self.keys[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.rest.append(key[-1][1][1:])
        self.moves[state][byte] = move = (to, first[1:common])
        return move

    def _simulate(self, state: int, rest: bytes) -> list[int]:
        """What the machine emits from a state over the rest of a piece, without compiling more states."""
        open_ = []
        for node, before in self.states[state]:
            chain = None
            for token in before:
                chain = (token, chain)
            open_.append((node, chain))
        following, ends, known = self.next, self.ends, self.known
        for byte in rest:
            after, ended = [], None
            for node, before in open_:
                child = following[node].get(byte)
                if child is None:
                    continue
                if ended is None and (token := ends[child]) >= 0:
                    pair = (before[0], token)
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = pair[0] < 0 or self.apart(*pair)
                    if fits:
                        ended = (token, before)
                if following[child]:
                    after.append((child, before))
            after.append((0, ended))
            open_ = after
        out, chain = [], open_[-1][1]
        while chain[1] is not None:
            out.append(chain[0])
            chain = chain[1]
        if len(known) > MOST_PAIRS:
            known.clear()
        return out[::-1]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece, emitted as the bytes come in."""
        moves, state, out = self.moves, 0, []
        for at, byte in enumerate(piece):
            move = moves[state].get(byte)
            if move is None:
                if len(moves) >= MOST_STATES:
                    return (*out, *self._simulate(state, piece[at:]))
                move = self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        return (*out, *self.rest[state])

    def count(self, piece: bytes) -> int:
        """The number of ids of one piece: the sum of the counts on its transitions."""
        moves, state, n = self.moves, 0, 0
        for at, byte in enumerate(piece):
            move = moves[state].get(byte)
            if move is None:
                if len(moves) >= MOST_STATES:
                    return n + len(self._simulate(state, piece[at:]))
                move = self._move(state, byte)
            state = move[0]
            n += len(move[1])
        return n + len(self.rest[state])


def letters_of_bytes() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(2)
def from_json(path: str) -> tuple[Merges, dict[str, int]]:
    """The machine of a byte-level BPE file of the tokenizers library, and its special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letter, special = letters_of_bytes(), {x["content"]: x["id"] for x in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    tokens: list[bytes | None] = [None] * (1 + max(vocab.values()))
    for word, i in vocab.items():
        if word not in special:
            tokens[i] = bytes(letter[c] for c in word)
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return Merges(tokens, {vocab[a + b]: k for k, (a, b) in enumerate(merges)}), special


@lru_cache(2)
def from_ranks(path: str) -> Merges:
    """The machine of a file of base64 tokens and ranks."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            word, rank = line.split()
            tokens[int(rank)] = base64.b64decode(word)
    listed = [tokens.get(i) for i in range(1 + max(tokens))]
    return Merges(listed, {i: i for i in tokens if len(tokens[i]) > 1})


# Classes of code points. APOSTROPHE and the letters of 's 't 're 've 'm 'll 'd steer the contractions.
END, LETTER, NUMBER, OTHER, APOSTROPHE, SPACE, BLANK, ONE, R, V, L, E = range(12)
# States: in a run of letters, numbers, others; after one space, one other blank, more ending so; after an apostrophe
# that begins a piece, and with r, v or l after it; at a border.
(IN_L, IN_N, IN_O, W_SPACE, W_BLANK, WW_SPACE, WW_BLANK, AP, AP_R, AP_V, AP_L, FRESH) = range(12)
#: Which borders a transition emits: before the code point it reads, and before the one that it has read last.
HERE, BACK = 1, 2


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    to, emit = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    letters = (LETTER, ONE, R, V, L, E)
    for c in range(12):
        kind = IN_L if c in letters else {NUMBER: IN_N, OTHER: IN_O, APOSTROPHE: IN_O}.get(c)
        starts = AP if c == APOSTROPHE else {SPACE: W_SPACE, BLANK: W_BLANK, END: FRESH}.get(c, kind)
        for s in range(12):
            to[s, c], emit[s, c] = starts, HERE
            if s in (IN_L, IN_N, IN_O) and kind == s:
                to[s, c], emit[s, c] = s, 0
            elif s in (W_SPACE, W_BLANK, WW_SPACE, WW_BLANK):
                if c in (SPACE, BLANK):
                    to[s, c], emit[s, c] = WW_SPACE if c == SPACE else WW_BLANK, 0
                elif c != END:
                    many = BACK if s in (WW_SPACE, WW_BLANK) else 0
                    to[s, c], emit[s, c] = (kind, many) if s in (W_SPACE, WW_SPACE) else (starts, many | HERE)
            elif s == AP:
                if c in (ONE, R, V, L):
                    to[s, c], emit[s, c] = {ONE: FRESH, R: AP_R, V: AP_V, L: AP_L}[c], 0
                elif kind == IN_O:
                    to[s, c], emit[s, c] = IN_O, 0
            elif s in (AP_R, AP_V, AP_L):
                if c == (L if s == AP_L else E):
                    to[s, c], emit[s, c] = FRESH, 0
                else:  # the apostrophe was a piece of its own, and its letter began a run
                    to[s, c], emit[s, c] = to[IN_L, c], emit[IN_L, c] | BACK
    return to, emit


TO, EMIT = _automaton()


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, from the Unicode categories that the split pattern names."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", BLANK)):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    out[0x20], out[0x27] = SPACE, APOSTROPHE
    for letters, kind in (("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(c) for c in letters]] = kind
    return out


def compose(maps: np.ndarray) -> np.ndarray:
    """maps[k, s]: the state after chunk k from entry s. Their inclusive prefix compositions, by doubling."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def borders(kinds: np.ndarray) -> np.ndarray:
    """Whether a piece begins before each symbol. Texts are separated by END."""
    n = len(kinds)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    flat = TO.reshape(-1).astype(np.intp)
    if rows > 1:
        maps = np.tile(np.arange(12, dtype=np.intp), (rows, 1))
        for column in grid:
            maps = flat[maps * 12 + column[:, None]]
        entry = np.concatenate([[FRESH], compose(maps)[:-1, FRESH]])
    else:
        entry = np.array([FRESH], np.intp)
    emits = np.empty(grid.shape, np.uint8)
    state, said = entry, EMIT.reshape(-1)
    for k, column in enumerate(grid):
        at = state * 12 + column
        emits[k] = said[at]
        state = flat[at]
    emits = emits.T.reshape(-1)[:n]
    out = (emits & HERE).astype(bool)
    out[:-1] |= (emits[1:] & BACK).astype(bool)
    return out


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pieces of all texts in order, and how many each text has."""
    joined = "\x00".join(texts) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes()[codes]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    kinds[ends] = END
    marks = borders(kinds)
    marks[ends] = True
    at = np.flatnonzero(marks)
    ending = np.searchsorted(at, ends)
    cuts = at.tolist()
    found = [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    stops = ending.tolist()
    keep = np.ones(len(found), bool)  # a separator is no piece
    keep[[s for s in stops if s < len(found)]] = False
    out = [p for p, k in zip(found, keep.tolist(), strict=True) if k]
    return out, np.diff(np.concatenate([[-1], ending])) - 1


class Memo(dict):
    """Remembers f of each piece, in two generations: when the younger is full, the elder is dropped."""

    def __init__(self, f):
        self.f, self.elder = f, {}

    def __missing__(self, piece: str):
        out = self.elder.get(piece)
        if out is None:
            out = self.f(piece.encode("utf-8", "surrogatepass"))
        if len(self) >= MOST_PIECES // 2:
            self.elder = dict(self)
            self.clear()
        self[piece] = out
        return out
