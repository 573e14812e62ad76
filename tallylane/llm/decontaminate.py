"""Benchmark decontamination: q-gram lemma filter over diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylane.llm.shared import buffers, release

Q = 8
#: Length and spacing of the windows of an item that are searched for; a shorter item is one window.
WIDTH, STRIDE = 80, 40
#: Edits allowed, as a share of a window's length.
EDITS = 0.075
#: Items of fewer normalised bytes are too short to prove anything and are not searched for.
LEAST = 32
#: Benchmark bytes that one pass over the documents searches for.
BLOCK = 1 << 24
#: Bytes of text that are looked at together.
CHUNK = 1 << 21

_SPACE = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _SPACE[_b] = _b
_SPACE[65:91] = np.arange(97, 123)


def normalise(data: np.ndarray, offsets: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in ASCII lower case with one space for every run of other ASCII characters, `gap` zeros behind each row;
    starts and ends of the rows in it."""
    low, high = int(offsets[0]), int(offsets[-1])
    own = _SPACE[data[low:high]]
    keep = own != 32
    keep[1:] |= keep[:-1]  # the first space of a run stays
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets - low]
    sizes = np.diff(kept)
    out = np.zeros(int(sizes.sum()) + gap * len(sizes), np.uint8)
    starts = kept[:-1] + gap * np.arange(len(sizes))
    place = np.ones(len(out), bool)
    if gap:
        edge = np.zeros(len(out) + 1, np.int8)
        np.add.at(edge, starts + sizes, -1)
        np.add.at(edge, starts + sizes + gap, 1)
        place = np.cumsum(edge[:-1], dtype=np.int8) == 0
    out[place] = own[keep]
    return out, starts, starts + sizes


def qgrams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for shift in range(Q):
        own = out[shift::Q]
        own[:] = data[shift : shift + Q * len(own)].view(np.uint64)
    return out


@dataclass(frozen=True)
class Probes:
    """Windows of the benchmark items, and their q-grams in order with the places where they occur."""

    text: np.ndarray
    length: np.ndarray
    item: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    probe: np.ndarray
    place: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(texts: list[bytes], share: float = EDITS, width: int = WIDTH, stride: int = STRIDE) -> Probes:
        windows, item = [], []
        for i, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8)
            line = normalise(data, np.array([0, len(data)]))[0].tobytes().strip()
            if len(line) >= LEAST:
                last = max(0, len(line) - width)
                starts = sorted({*range(0, last, stride), last})
                windows += [line[s : s + width] for s in starts]
                item += [i] * len(starts)
        length = np.array([len(w) for w in windows], np.int64)
        edits = np.floor(length * share).astype(np.int64)
        need = length - Q + 1 - Q * edits
        if (need < 1).any():
            raise ValueError("the edit budget leaves no q-gram to count")
        text = np.zeros((len(windows), width), np.uint8)
        for i, w in enumerate(windows):
            text[i, : len(w)] = np.frombuffer(w, np.uint8)
        grams = [qgrams(np.frombuffer(w, np.uint8)) for w in windows]
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
        probe = np.repeat(np.arange(len(windows)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] + [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        known, first = np.unique(flat[order], return_index=True)
        table = np.zeros(1 << 21, bool)
        table[_slot(known)] = True
        return Probes(text, length, np.array(item, np.int64), edits, need, known, np.append(first, len(flat)), probe[order], place[order], table)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)


def _hits(data: np.ndarray, probes: Probes) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose q-gram occurs in a probe, and the number of that q-gram."""
    at, number = [], []
    for low in range(0, max(0, len(data) - Q + 1), CHUNK):
        grams = qgrams(data[low : low + CHUNK + Q - 1])
        maybe = np.flatnonzero(probes.table[_slot(grams)])
        index = np.searchsorted(probes.grams, grams[maybe])
        index[index == len(probes.grams)] = 0
        sure = probes.grams[index] == grams[maybe]
        at.append(maybe[sure] + low)
        number.append(index[sure])
    return (np.concatenate(at), np.concatenate(number)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _crowded(at: np.ndarray, need: int, span: int) -> np.ndarray:
    """Hits that are among `need` hits within `span`: only those can be enough for any probe."""
    edge = np.zeros(len(at) + 1, np.int64)
    if len(at) >= need:
        begin = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= span)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + need, -1)
    return np.cumsum(edge[:-1]) > 0


def _banded(probe: np.ndarray, region: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each probe (rows of equal length) and any part of its region, and where that part ends.

    Column c of row r stands for r + c consumed characters of the region, so that only diagonals inside the
    band are computed; start and end in the region are free.
    """
    n, length = probe.shape
    steps = np.arange(band)
    cost = np.zeros((n, band), np.int16)
    for r in range(1, length + 1):
        change = cost + (probe[:, r - 1 : r] != region[:, r - 1 : r - 1 + band])
        change[:, :-1] = np.minimum(change[:, :-1], cost[:, 1:] + 1)
        cost = (np.minimum.accumulate(change - steps, axis=1) + steps).astype(np.int16)
    end = cost.argmin(axis=1)
    return cost[np.arange(n), end], end + length


def find(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, probes: Probes) -> list[tuple[int, int, int, int, int]]:
    """(row, item, windows found, least edits, normalised byte where the first one ends) for rows that hold a window of an item."""
    if not len(probes.item):
        return []
    at, number = _hits(data, probes)
    near = _crowded(at, int(probes.need.min()), int((probes.length + probes.edits).max()))
    at, number = at[near], number[near]
    low, high = probes.first[number], probes.first[number + 1]
    counts = high - low
    occurrence = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    at = np.repeat(at, counts)
    probe = probes.probe[occurrence]
    # bands of 2 * step diagonals, one every `step`: any step = edits + 1 diagonals lie in one band
    step = int(probes.edits.max()) + 1
    diagonal = at - probes.place[occurrence] + probes.text.shape[1]
    key = probe << 40 | diagonal // step
    key, first, count = np.unique(np.concatenate([key, key - 1]), return_index=True, return_counts=True)
    good = count >= probes.need[key >> 40]
    key, at = key[good], at[first[good] % max(1, len(at))]
    probe, begin = key >> 40, (key & (1 << 40) - 1) * step - probes.text.shape[1]
    row = np.searchsorted(starts, at, side="right") - 1
    found: dict[tuple[int, int], list] = {}
    for length in np.unique(probes.length[probe]):
        own = np.flatnonzero(probes.length[probe] == length)
        for part in np.array_split(own, len(own) // 4096 + 1):
            edits = int(probes.edits[probe[part[0]]])
            band = 2 * step + 2 * edits + 1
            place = begin[part, None] - edits + np.arange(length + band)[None, :]
            inside = (place >= starts[row[part], None]) & (place < ends[row[part], None])
            region = np.where(inside, data[np.clip(place, 0, len(data) - 1)], 0)
            cost, end = _banded(probes.text[probe[part], :length], region, band)
            for i in np.flatnonzero(cost <= edits):
                r, p = int(row[part[i]]), int(probe[part[i]])
                was = found.setdefault((r, int(probes.item[p])), [set(), edits, 1 << 60])
                was[0].add(p)
                was[1] = min(was[1], int(cost[i]))
                was[2] = min(was[2], int(place[i, 0] + end[i] - starts[r]))
    return [(r, i, len(w), e, a) for (r, i), (w, e, a) in found.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = EDITS) -> DataFrame:
    """Pairs of documents and benchmark items: key, item, windows, edits, ends_at.

    An item is cut into windows of 80 normalised bytes, one every 40 (normalised: lower case, one space for
    each run of ASCII punctuation and space).  A document matches if a part of its whole text is within the edit budget
    (7.5 % of the window) of a window: by the q-gram lemma such a part shares at least length - 7 - 8 * edits
    q-grams with the window inside a band of edits + 1 diagonals.  Overlapping bands with so many are aligned, inside the band.
    Narrow over documents; the benchmark goes to every task, in blocks of at most 16 MB, one pass for each.
    Null, empty and too short texts match nothing; repeated documents and items are reported each.
    """
    items = benchmark.select(F.col(item).alias("item"), F.lower(F.col(item_text)).cast("binary").alias("body")).where("body is not null")
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = size // BLOCK + 1
    passes = [_one_pass(docs, items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b).collect(), key, text, item, items.schema["item"].dataType.simpleString(), share) for b in range(blocks)]
    return reduce(DataFrame.unionByName, passes)


def _one_pass(docs: DataFrame, items: list, key: str, text: str, item: str, item_type: str, share: float) -> DataFrame:
    probes = Probes.of([bytes(r.body) for r in items], share)
    names = [r.item for r in items]
    gap = WIDTH + 4 * (int(probes.edits.max()) + 1 if len(probes.edits) else 1)
    columns = [key, item, "windows", "edits", "ends_at"]

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in it:
            data, offsets = buffers(batch.column(1))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, side="right")) - 1)
                found = find(*normalise(data, offsets[low : high + 1], gap), probes)
                if found:
                    row, number, windows, edits, at = zip(*sorted(found), strict=True)
                    ids = pa.array([names[i] for i in number], pa.int64() if item_type == "bigint" else None)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(row) + low)), ids, pa.array(windows, pa.int32()), pa.array(edits, pa.int32()), pa.array(at, pa.int64())], names=columns)
                low = high

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__text")).mapInArrow(step, f"`{key}` {kind}, `{item}` {item_type}, windows int, edits int, ends_at long")
