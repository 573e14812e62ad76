"""Packing documents into sequences of bounded length: best fit, then best two for one."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylane.llm.shared import hold, materialise, text_of

LIMIT = 4096
#: Pieces that one packing task takes; each task wastes less than one sequence.
GROUP = 20_000
#: Words whose ids a Python worker remembers.
REMEMBER = 700_000


class WordIds:
    """Ids of whole texts through a memory of ids of words.

    Only for tokenizers that drop white space and never merge across it.  A word is what stands between
    ASCII white space, in ASCII lower case; a full stop or comma at the end of a word of letters is a
    token of its own for such tokenizers, so that it is taken off first.  Ids are the tokenizer's own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()
        self.marks = {ord(m): self._one_by_one([m])[0][0] for m in ".,"}

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.counts = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _one_by_one(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many for each word, of words of letters: one call for many, cut behind the ids that close a word."""
        all_ids, all_counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for low in range(0, len(words), 2000):
            part = words[low : low + 2000]
            ids = np.array(self._one_by_one([" ".join(part)])[0], np.uint32)
            ends = np.flatnonzero(self.closes_word[ids]) + 1
            if len(ends) != len(part):
                apart = self._one_by_one(part)
                ids, ends = np.array([i for x in apart for i in x], np.uint32), np.cumsum([len(x) for x in apart])
            all_ids.append(ids)
            all_counts.append(np.diff(ends, prepend=0))
        return np.concatenate(all_ids), np.concatenate(all_counts)

    def _learn(self, new: list[bytes]) -> None:
        letters: dict[str, int] = {}
        other: dict[str, int] = {}
        of_stem, mark, apart = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), np.zeros(len(new), bool)
        for i, word in enumerate(new):
            text = word.decode("utf-8", "replace")
            if word[-1] in self.marks and text[:-1].isalpha():
                mark[i] = self.marks[word[-1]]
                text = text[:-1]
            if text.isalpha():
                of_stem[i] = letters.setdefault(text, len(letters))
            else:
                apart[i] = True
                of_stem[i] = other.setdefault(text, len(other))
        ids, sizes = self._together(list(letters))
        rest = self._one_by_one(list(other))
        ids = np.concatenate([ids, np.array([i for x in rest for i in x], np.uint32)])
        sizes = np.concatenate([sizes, np.array([len(x) for x in rest], np.int64)])
        stem = of_stem + apart * len(letters)
        first, total = len(self.numbers) - len(new), int((sizes[stem] + (mark > 0)).sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.numbers) > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        counts = sizes[stem] + (mark > 0)
        ends = np.cumsum(counts)
        own = self.pool[self.used : self.used + total]
        # a place of its own for each id of a stem, and the mark behind them
        body = np.ones(total, bool)
        body[ends[mark > 0] - 1] = False
        own[body] = ids[_runs((np.cumsum(sizes) - sizes)[stem], sizes[stem])]
        own[~body] = mark[mark > 0]
        self.starts[first : len(self.numbers)] = self.used + ends - counts
        self.counts[first : len(self.numbers)] = counts
        self.used += total

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        if len(self.numbers) > REMEMBER:
            self._forget()
        words = [t.lower().split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        own = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int32, int(sizes.sum()))
        if self.numbers.new:
            self._learn(self.numbers.new)
            self.numbers.new = []
        counts = self.counts[own]
        before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[np.concatenate([[0], np.cumsum(sizes)])]
        return self.pool[_runs(self.starts[own], counts)], np.diff(before)


class _Numbers(dict):
    """Numbers words in the order in which they are first seen, and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `counts` of them."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


_WORDS: dict[str, WordIds] = hold({})


def word_ids(path: str) -> WordIds:
    """One memory for each Python worker, kept from task to task."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = 1) -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32.  Tokens stay in the task that made them."""

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in it:
            keys, rows = batch.column(0), []
            for low in range(0, batch.num_rows, 512):
                texts = [x.as_buffer().to_pybytes() for x in batch.column(1).slice(low, 512)]
                flat, sizes = word_ids(tokenizer).encode(texts)
                ends = np.cumsum(sizes)
                for row, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True), low):
                    ids = np.append(flat[end - size : end], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), limit)):
                        part = ids[start : start + limit]
                        rows.append((row, piece, start, len(part), crc32(part.tobytes())))
            if rows:
                row, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=[key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_of(text).cast("binary").alias("__text")).mapInArrow(step, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


class _Lengths:
    """Pieces not packed yet, by length: how many, and the largest length present up to a bound."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self.present = np.flatnonzero(counts).tolist()

    def largest(self, bound: int) -> int:
        at = bisect_right(self.present, bound)
        return self.present[at - 1] if at else 0

    def take(self, length: int) -> None:
        self.left[length] -= 1
        if not self.left[length]:
            del self.present[bisect_right(self.present, length) - 1]

    def give(self, length: int) -> None:
        if not self.left[length]:
            self.present.insert(bisect_right(self.present, length), length)
        self.left[length] += 1

    def best_two(self, room: int) -> tuple[int, int]:
        """Two lengths with the largest sum up to `room`; (0, 0) where no two fit."""
        best = (0, 0)
        low, high = 0, bisect_right(self.present, room) - 1
        while low <= high:
            a, b = self.present[low], self.present[high]
            if a + b > room or low == high and self.left[a] < 2:
                high -= 1
                continue
            if a + b > sum(best):
                best = (a, b)
                if a + b == room:
                    break
            low += 1
        return best


def best_two_fit(counts: np.ndarray, limit: int) -> list[list[int]]:
    """Bins as lists of lengths.  `counts[l]` pieces have length l.

    A bin is opened with the largest piece and filled greedily with the largest piece that still fits.
    Then, while a gap is left, its smallest piece is exchanged for two unpacked pieces that fill the
    piece's place and the gap more tightly.
    """
    rest, bins = _Lengths(counts), []
    while rest.present:
        own, gap = [], limit
        while length := rest.largest(gap):
            rest.take(length)
            own.append(length)
            gap -= length
        while gap and len(own) > 1:
            smallest = own[-1]
            two = rest.best_two(smallest + gap)
            if sum(two) <= smallest:
                break
            own.pop()
            rest.give(smallest)
            for length in two:
                rest.take(length)
            own += sorted(two, reverse=True)
            gap += smallest - sum(two)
            own.sort(reverse=True)
        bins.append(own)
    return bins


def pack(cut: DataFrame, key: str = "doc_id", limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """`cut` (from `pieces`) with sequence_id and offset (place in the sequence, gapless from 0).

    Pieces are dealt at random to groups of about `group`; each group is packed on its own, so that a
    group costs less than one sequence more than the best, and no task grows with the input.
    Sequence ids are the group's number and the bin's, unique but not consecutive.
    """
    n_groups = max(1, round(cut.count() / group))
    names = cut.columns

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "ascending"), (key, "ascending"), ("piece", "ascending")])
        bins = best_two_fit(np.bincount(table["length"].to_numpy(), minlength=limit + 1), limit)
        # the bins' places in order of length meet the pieces in order of length
        placed = np.array([(length, b, offset) for b, own in enumerate(bins) for length, offset in zip(own, np.cumsum([0, *own[:-1]]), strict=True)], np.int64)
        placed = placed[np.argsort(placed[:, 0], kind="stable")]
        number = table["__group"][0].as_py()
        return table.select(names).append_column("sequence_id", pa.array(number * (1 << 32) + placed[:, 1])).append_column("offset", pa.array(placed[:, 2]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    dealt = cut.withColumn("__group", F.pmod(F.xxhash64(key, "piece", "length"), F.lit(n_groups)))
    return dealt.groupBy("__group").applyInArrow(one, f"{fields}, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with the sequence and offset they are packed at.

    A document's ids are followed by `end_id`; only documents of more than `limit` ids are cut, into full
    pieces and a last shorter one.  Null and empty texts are the end id alone.  Keys may be null or repeat (rows are packed
    each); other columns do not matter; an empty table gives no row.  Only lengths are shuffled.
    """
    return pack(materialise(pieces(docs, tokenizer, key, text, limit, end_id)), key, limit, group)


def digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packed_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))
