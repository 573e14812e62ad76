"""Byte-level BPE as a transducer: encoding with bounded lookahead, decoding through a UTF-8 state machine.

A sequence of tokens is what the merges make of its bytes exactly if the merges leave each pair of
neighbours as it is: as long as no merge crosses a token's border, the parts between borders are merged
as if they stood alone.  So an automaton that guesses where tokens end, and lets a token follow another
only where the two are such a pair, accepts each text in one way, with the merges' tokens as its output.
It is determinised while texts are read: a state holds all guesses that are still open, and puts out
tokens as soon as all of them agree.  A guess is no longer than a token, which bounds the lookahead.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylane.llm.shared import hold, release, text_of

#: States and pieces that a worker keeps, beyond which they are made anew with equal results; characters of text that it takes together.
STATES, PIECES, TOGETHER = 200_000, 400_000, 1 << 22
#: Ids that the decoder takes at once.
BLOCK = 1 << 16
_NEVER = sys.maxsize
_START = -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """Which two tokens may stand beside each other.  Ranks follow the order of merges, all single bytes among them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {rank: token for token, rank in ranks.items()}
        self.spines: dict[int, list[tuple[bytes, int]]] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"single bytes without a rank: {missing}")

    def split(self, token: int) -> tuple[int, int] | None:
        """The last two parts that merge into a token; None for a single byte and for a token that merges do not reach."""
        if token not in self.halves:
            self.halves[token] = self._split(token)
        return self.halves[token]

    def _split(self, token: int) -> tuple[int, int] | None:
        body = self.bytes_of[token]
        parts, last = [body[i : i + 1] for i in range(len(body))], None
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _NEVER:
                return None
            last = self.ranks[parts[at]], self.ranks[parts[at + 1]]
            if max(last) >= rank:
                raise ValueError(f"token {rank} comes before its parts {last}")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return last

    def reached(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.split(token) is not None

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at a token's left (0) or right (1) border while it is merged, from a byte to the token, with the rank that replaces it."""
        key = token << 1 | side
        if key not in self.spines:
            chain = [token]
            while (halves := self.split(chain[-1])) is not None:
                chain.append(halves[side])
            chain.reverse()
            self.spines[key] = [(self.bytes_of[x], after) for x, after in zip(chain, [*chain[1:], _NEVER], strict=True)]
        return self.spines[key]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's bytes end as a and b: never is a merge across the border the next one.

        Of merges with equal rank the leftmost is first: one inside `a` before one across, one across before one inside `b`.
        """
        left, right, rank_of = self.spine(a, 1), self.spine(b, 0), self.ranks.get
        i = j = 0
        (left_bytes, next_left), (right_bytes, next_right) = left[0], right[0]
        while True:
            across = rank_of(left_bytes + right_bytes)
            if across is not None and across < next_left and across <= next_right:
                return False
            if next_left <= next_right:
                if next_left == _NEVER:
                    return True
                i += 1
                left_bytes, next_left = left[i]
            else:
                j += 1
                right_bytes, next_right = right[j]


class Transducer:
    """Ids of a piece of bytes, read byte by byte.

    A guess is a place in the trie of all tokens, where the next token stands so far, and the tokens before
    it since the last certain one, that one first.  The places of a state are the longest of them and its
    suffixes in the trie, found beforehand by failure links; the last guess is the trie's root: the tokens if the piece ended here.
    """

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.merges, self.limit = Merges(ranks), states
        self.trie: list[dict[int, int]] = [{}]
        token: list[int] = [_START]
        self.depth: list[int] = [0]
        for body, rank in ranks.items():
            at = 0
            for b in body:
                if (to := self.trie[at].get(b)) is None:
                    to = self.trie[at][b] = len(self.trie)
                    self.trie.append({})
                    token.append(_START)
                    self.depth.append(self.depth[at] + 1)
                at = to
            token[at] = rank
        self.token = token
        self._link()
        self.ways: dict[int, tuple] = {}
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _link(self) -> None:
        """For each place: its longest suffix, and the nearest suffixes, itself included, that are a token and that go on."""
        n = len(self.trie)
        self.suffix, self.ends, self.open = [0] * n, [0] * n, [0] * n
        layer = [0]
        while layer:
            behind = []
            for at in layer:
                for byte, to in self.trie[at].items():
                    if at:
                        back = self.suffix[at]
                        while back and byte not in self.trie[back]:
                            back = self.suffix[back]
                        self.suffix[to] = self.trie[back].get(byte, 0)
                    self.ends[to] = to if self.token[to] != _START else self.ends[self.suffix[to]]
                    self.open[to] = to if self.trie[to] else self.open[self.suffix[to]]
                    behind.append(to)
            layer = behind

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.guesses: list[tuple] = []
        #: (state << 8 | byte) to (next state, tokens put out)
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self._number((0, (_START,)))

    def _number(self, guesses: tuple) -> int:
        number = self.numbers.get(guesses)
        if number is None:
            number = self.numbers[guesses] = len(self.guesses)
            self.guesses.append(guesses)
        return number

    def _way(self, at: int, byte: int) -> tuple[int, tuple[int, ...], tuple[tuple[int, int], ...]]:
        """What one more byte does to the longest place of a state, whatever the tokens before are: the longest place that
        is open then, which guesses go on, and which guesses may end in which token, the longest token first.
        """
        index, x, n = {}, at, 1
        while True:
            index[self.depth[x]] = n
            if not x:
                break
            x, n = self.open[self.suffix[x]], n + 1
        while byte not in self.trie[at]:
            at = self.suffix[at]
        to = self.trie[at][byte]
        ends, x = [], self.ends[to]
        while x:
            if self.merges.reached(self.token[x]):
                ends.append((index[self.depth[x] - 1], self.token[x]))
            x = self.ends[self.suffix[x]]
        goes_on, x = [], self.open[to]
        while x:
            goes_on.append(index[self.depth[x] - 1])
            x = self.open[self.suffix[x]]
        return self.open[to], tuple(goes_on), tuple(ends)

    def _move(self, guesses: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """Guesses behind one more byte, and the tokens that all of them begin with.

        Guesses are the longest place and, for it and its suffixes that are open, down to the root, the tokens before.
        """
        key = guesses[0] << 8 | byte
        way = self.ways.get(key)
        if way is None:
            way = self.ways[key] = self._way(guesses[0], byte)
        first, goes_on, ends = way
        for i, token in ends:
            past = guesses[i]
            last = past[-1]
            if last == _START:
                break
            pair = last << 20 | token
            apart = self.pairs.get(pair)
            if apart is None:
                if len(self.pairs) >= 2 * self.limit:
                    self.pairs.clear()
                apart = self.pairs[pair] = self.merges.stay_apart(last, token)
            if apart:
                break
        whole = (*past, token)
        if not goes_on:
            return (first, whole[-1:]), whole[1:]
        found = [guesses[i] for i in goes_on]
        found.append(whole)
        one = found[0]
        sure = 1
        while sure < len(one):
            token = one[sure]
            for past in found:
                if len(past) == sure or past[sure] != token:
                    break
            else:
                sure += 1
                continue
            break
        if sure == 1:
            return (first, *found), ()
        return (first, *[past[sure - 1 :] for past in found]), one[1:sure]

    def encode_all(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of each piece.  What a piece shares with the one before is not read again, so sorted pieces cost least.

        A piece that is a token itself is that token, whether merges reach it or not.
        """
        states, outs, before, ranks = [self.start], [()], b"", self.merges.ranks
        for piece in pieces:
            n = 0
            for x, y in zip(before, piece, strict=False):
                if x != y:
                    break
                n += 1
            del states[n + 1 :], outs[n + 1 :]
            state = states[n]
            for byte in piece[n:] if n else piece:
                move = self.moves.get(state << 8 | byte)
                if move is None:
                    guesses, sure = self._move(self.guesses[state], byte)
                    if len(self.guesses) >= self.limit:
                        open_ = [self.guesses[x] for x in states]
                        self._forget()
                        states[:] = map(self._number, open_)
                        state = states[-1]
                    move = self.moves[state << 8 | byte] = self._number(guesses), sure
                state = move[0]
                states.append(state)
                outs.append(move[1])
            before = piece
            ids = [*chain.from_iterable(outs), *self.guesses[state][-1][1:]]
            if len(ids) > 1 and (whole := ranks.get(piece)) is not None:
                ids = [whole]
            yield ids

    def encode(self, piece: bytes) -> list[int]:
        return next(self.encode_all([piece]))


class Encoder:
    """Packed little-endian 32-bit ids of whole texts: each match of the pattern is encoded on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern, self.transducer = regex.compile(pattern), Transducer(ranks)
        self.known: dict[str, bytes] = {}

    def _learn(self, found: set[str]) -> None:
        new = found.difference(self.known)
        if len(self.known) + len(new) > PIECES:
            self.known.clear()
            new = found
        order = sorted(x.encode() for x in new)
        for piece, ids in zip(order, self.transducer.encode_all(order), strict=True):
            self.known[piece.decode()] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Texts are taken together up to a size, so that pieces that are new share what they begin with."""
        part, size = [], 0
        for text in texts:
            if len(text) > TOGETHER:
                yield from self._together(part)
                part, size = [], 0
                yield self._long(text)
                continue
            part.append(text)
            size += len(text)
            if size > TOGETHER:
                yield from self._together(part)
                part, size = [], 0
        yield from self._together(part)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        pieces = list(map(self.pattern.findall, texts))
        self._learn(set(chain.from_iterable(pieces)))
        for own in pieces:
            yield b"".join(map(self.known.__getitem__, own))

    def _long(self, text: str) -> bytes:
        pieces, parts = (m.group() for m in self.pattern.finditer(text)), []
        while own := list(islice(pieces, TOGETHER // 4)):
            self._learn(set(own))
            parts.append(b"".join(map(self.known.__getitem__, own)))
        return b"".join(parts)


# --- decoding ---------------------------------------------------------------

#: States of the UTF-8 machine: between characters, and by what is still missing.  The bytes that may follow
#: some first bytes are fewer (E0, ED, F0, F4), so that no character has two forms.  `HELD` is how many bytes of an open character were read.
BETWEEN, BAD, LAST1, E0, MIDDLE, ED, LAST2, F0, FAR, F4, MIDDLE2, LAST3 = range(12)
HELD = (0, 0, 1, 1, 1, 1, 2, 1, 1, 1, 2, 3)


def utf8_machine() -> np.ndarray:
    """Next state by state and byte."""
    table = np.full((12, 256), BAD, np.uint8)

    def allow(state: int, low: int, high: int, to: int) -> None:
        table[state, low : high + 1] = to

    allow(BETWEEN, 0x00, 0x7F, BETWEEN)
    for low, high, to in ((0xC2, 0xDF, LAST1), (0xE0, 0xE0, E0), (0xE1, 0xEF, MIDDLE), (0xED, 0xED, ED), (0xF0, 0xF0, F0), (0xF1, 0xF3, FAR), (0xF4, 0xF4, F4)):
        allow(BETWEEN, low, high, to)
    for state, low, high, to in ((E0, 0xA0, 0xBF, LAST2), (MIDDLE, 0x80, 0xBF, LAST2), (ED, 0x80, 0x9F, LAST2), (F0, 0x90, 0xBF, MIDDLE2), (FAR, 0x80, 0xBF, MIDDLE2), (F4, 0x80, 0x8F, MIDDLE2), (MIDDLE2, 0x80, 0xBF, LAST3)):
        allow(state, low, high, to)
    for state in (LAST1, LAST2, LAST3):
        allow(state, 0x80, 0xBF, BETWEEN)
    return table


class Decoder:
    """Text of ids, handed over in blocks; a character whose bytes lie in several tokens or blocks comes when it is whole.

    The machine takes a token at a time: what a token's bytes do to each state is worked out beforehand.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        machine = utf8_machine()
        sizes = np.array([len(t) for t in self.bytes_of])
        flat, begin = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(sizes) - sizes
        after = np.repeat(np.arange(12, dtype=np.uint8)[:, None], len(sizes), axis=1)
        for i in range(int(sizes.max())):
            own = np.flatnonzero(sizes > i)
            after[:, own] = machine[after[:, own], flat[begin[own] + i]]
        after[:, sizes == 0] = BAD
        self.after = after.tolist()

    def stream(self, blocks: Iterable[np.ndarray]) -> Iterator[bytes]:
        """UTF-8 of whole characters for each block of ids; ValueError where the bytes are no UTF-8."""
        state, held = BETWEEN, b""
        for ids in blocks:
            ids = ids.tolist()
            for i in ids:
                state = self.after[state][i]
            if state == BAD:
                raise ValueError("the ids' bytes are not UTF-8")
            body = held + b"".join(map(self.bytes_of.__getitem__, ids))
            whole = len(body) - HELD[state]
            held = body[whole:]
            yield body[:whole]
        if state != BETWEEN:
            raise ValueError("the ids end inside a character")

    def decode(self, packed: bytes, block: int = BLOCK) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        return b"".join(self.stream(ids[at : at + block] for at in range(0, len(ids), block)))


# --- on Spark ---------------------------------------------------------------

_KEPT: dict[tuple, object] = hold({})


def _kept(kind, *args):
    """One encoder or decoder for each Python worker and rank file, kept from task to task."""
    if (kind, *args) not in _KEPT:
        _KEPT[(kind, *args)] = kind(read_ranks(args[0]), *args[1:])
    return _KEPT[(kind, *args)]


def _other_operators_let_go() -> None:
    kept = dict(_KEPT)
    release()
    _KEPT.update(kept)


def _kind(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)


def encoded(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows and columns, the text replaced by its ids: little-endian unsigned 32-bit, packed in a binary column.

    `ranks` is a rank file as tiktoken reads it, `pattern` what splits a text before the merges.  Null texts count as empty, and an
    empty text has no ids.  Keys do not matter: rows are encoded each, in place, nothing is shuffled.
    """
    rest = [c for c in docs.columns if c != text]
    if ids in rest:
        raise ValueError(f"there is a column {ids} already")

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _other_operators_let_go()
        encode = _kept(Encoder, ranks, pattern).encode
        for batch in it:
            for part in _parts(batch):
                packed = pa.array(list(encode(part.column(len(rest)).to_pylist())), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], packed], names=[*rest, ids])

    return docs.select(*[F.col(f"`{c}`") for c in rest], text_of(F.col(f"`{text}`")).alias(text)).mapInArrow(step, f"{_kind(docs, rest)}`{ids}` binary")


def decoded(tokens: DataFrame, ranks: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All rows and columns, with the text of each row's packed ids added.  Null ids give a null text, no ids the empty text.

    Ids that are not a text (unknown ids, bytes that are no UTF-8) stop the job.
    """
    if text in tokens.columns:
        raise ValueError(f"there is a column {text} already")
    names, at = tokens.columns, tokens.columns.index(ids)

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _other_operators_let_go()
        decode = _kept(Decoder, ranks).decode
        for batch in it:
            for part in _parts(batch):
                found = pa.array([decode(x.as_buffer().to_pybytes()) if x.is_valid else None for x in part.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, found.cast(pa.string())], names=[*names, text])

    return tokens.mapInArrow(step, f"{_kind(tokens, names)}`{text}` string")


def _parts(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that its texts, ids and results are not all held at once."""
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def round_trip(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 and, of the text decoded from the ids, decoded_sha256; encoder and decoder in one worker.

    Rows are those of `encoded` and `decoded`, with the same rules for nulls; keys may be null or repeat.
    """

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _other_operators_let_go()
        encode, decode = _kept(Encoder, ranks, pattern).encode, _kept(Decoder, ranks).decode
        for batch in it:
            for part in _parts(batch):
                rows = [(len(ids) // 4, sha256(ids).hexdigest(), sha256(decode(ids)).hexdigest()) for ids in encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*rows, strict=True))], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text_of(text).alias("__text")).mapInArrow(step, f"{_kind(docs, [key])}n_tokens long, ids_sha256 string, decoded_sha256 string")


def digest(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    return round_trip(docs, ranks, pattern)
