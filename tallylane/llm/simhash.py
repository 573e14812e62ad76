"""SimHash near-duplicates: fingerprints, and all close pairs by distributed vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylane.llm.components import connected_components
from tallylane.llm.shared import in_arrow, materialise, text_of

BITS = 64
#: Fingerprints that one shard of a tree should hold; it sets the depth, and never cuts a shard.
SHARD = 512
#: Keys of documents to compare are broadcast up to this number, and joined by shuffling beyond it.
BROADCAST = 1_000_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle; of the whole word sequence where it is shorter; none without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    begin = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    end = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], 42) for i, j in zip(begin, end, strict=True)), np.uint64, n)


def vote(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    # ones per bit, from the counts of each byte value at each byte place
    places = hashes.view(np.uint8).reshape(n, 8) + _PLACE
    ones = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF
    return int.from_bytes(np.packbits((2 * ones > n).ravel(), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority vote over the XXH64 (seed 42) of the word shingles; zero where there is no word."""
    return vote(shingle_hashes(text, width))


def _remixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Other hashes of the same shingles: another fingerprint, independent of the first (number 0)."""
    if not number:
        return hashes
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * number)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def set_digest(hashes: np.ndarray) -> int:
    """XXH64 of the distinct shingle hashes in order: equal for equal sets of shingles."""
    import xxhash

    return xxhash.xxh64_intdigest(np.unique(hashes).tobytes())


_PLACE = (np.arange(8, dtype=np.int16) * 256)[None, :]
_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def with_fingerprints(docs: DataFrame, key: str, text: str, prints: dict[str, tuple[int, int | None]]) -> DataFrame:
    """The key and, for each name, the signed 64-bit fingerprint of (shingle width, number), or without a number the
    digest of the shingle set; a null text has no words."""
    widths = sorted({w for w, _ in prints.values()})

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.zeros((batch.num_rows, len(prints)), np.uint64)
        for row, text in enumerate(batch.column(1)):
            hashes = {w: shingle_hashes(text.as_buffer().to_pybytes(), w) for w in widths}
            values[row] = [set_digest(hashes[w]) if number is None else vote(_remixed(hashes[w], number)) for w, number in prints.values()]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, values.view(np.int64).T.copy())], names=[key, *prints])

    fields = "".join(f", `{name}` long" for name in prints)
    return in_arrow(docs.select(key, text_of(text).cast("binary").alias("__text")), step, f"`{key}` {docs.schema[key].dataType.simpleString()}{fields}")


def _vantage(levels: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << bits, size=levels, dtype=np.uint64)


def _routes(d: np.ndarray, radii: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and leaf numbers.  At each level a point goes to its own side of the radius and, if it lies
    inside and a point at `radius` from it could lie outside, also to the outer side: two points within
    `radius` of each other then meet in at least one leaf."""
    rows, leaf = np.arange(len(d)), np.zeros(len(d), np.int64)
    for level, mu in enumerate(radii):
        own = d[rows, level]
        outer = own > mu
        border = np.flatnonzero(~outer & (own + radius > mu))
        leaf = np.concatenate([leaf * 2 + outer, leaf[border] * 2 + 1])
        rows = np.concatenate([rows, rows[border]])
    return rows, leaf


def _ball_links(points: np.ndarray, checks: np.ndarray, reach: int, slack: int) -> Iterator[tuple[int, int]]:
    """Links (position, position) that join all points of a shard that are connected within `reach`.

    Points already reached are not compared again, so a ball of very many near copies costs one scan
    for each of its few outer members, not all its pairs.
    """
    left = np.arange(len(points))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(points[left] ^ points[at]) <= reach
            if near.any():
                near[near] = np.bitwise_count(checks[left[near]] ^ checks[at]) <= slack
                found = left[near]
                left = left[~near]
                frontier.extend(found.tolist())
                yield from ((int(at), int(f)) for f in found)


def _blocks(reach: int) -> int:
    """Blocks of bits such that two words within `reach` differ in one bit at most in one of them."""
    return (reach + 1) // 2 or 1


def _routed(points: DataFrame, reach: int, shard: int, seed: int, first: int = 0, trees: int = 0) -> DataFrame:
    """The columns of `points` behind the number of each shard that a point reaches, in a tree for each block of its
    first column, fp; `first` is the number of the first of these trees among all `trees`."""
    n = points.count()
    blocks = _blocks(reach)
    trees = trees or blocks
    bits = BITS // blocks
    levels = min(bits, max(0, int(np.ceil(np.log2(max(1, n / shard))))))
    vantage = [_vantage(levels, bits, seed + b) for b in range(blocks)]
    radii = np.zeros((blocks, levels), np.int16)
    if levels:
        part = [F.shiftrightunsigned("fp", bits * b).bitwiseAND(F.lit((1 << bits) - 1)) if blocks > 1 else F.col("fp") for b in range(blocks)]
        far = [F.bit_count(part[b].bitwiseXOR(F.lit(int(vantage[b][k].astype(np.int64))))) for b in range(blocks) for k in range(levels)]
        radii = np.array(points.agg(*[F.percentile_approx(d, 0.5, 1000).alias(f"r{i}") for i, d in enumerate(far)]).first(), np.int16).reshape(blocks, levels)

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            for b in range(blocks):
                own = (columns[0].view(np.uint64) >> np.uint64(bits * b)) & np.uint64((1 << bits) - 1)
                rows, leaf = _routes(np.bitwise_count(own[:, None] ^ vantage[b][None, :]).astype(np.int16), radii[b], 1)
                yield pa.RecordBatch.from_arrays([pa.array(leaf * trees + first + b), *(pa.array(x[rows]) for x in columns)], names=["leaf", *(f"c{i}" for i in range(len(columns)))])

    out = points.mapInArrow(route, "leaf long, " + ", ".join(f"c{i} long" for i in range(len(points.columns))))
    return out.toDF("leaf", *points.columns)


def close_links(points: DataFrame, reach: int = 3, slack: int = BITS, shard: int = SHARD, seed: int = 7) -> DataFrame:
    """Pairs (a, b) of nodes joined by chains of steps of at most `reach` bits between fingerprints.

    `points` has columns node, fp and check; a step's check words must differ in at most `slack` bits too.
    Two fingerprints within `reach` differ in one bit at most in one of (reach + 1) // 2 equal blocks of
    bits, so there is a vantage-point tree for each block, searched with radius 1.  A level's vantage
    point is a fixed pseudo-random word, its radius the median distance over all fingerprints (one
    aggregation; any radius gives the same links), and the depth follows the number of fingerprints.  The
    triangle inequality decides on which sides of a radius a point's neighbours can lie; points at a
    border go to both sides.  Every close pair so meets in a shard and is compared there at full width.
    """

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        node, fp, check = (pdf[c].to_numpy() for c in ("node", "fp", "check"))
        pairs = np.array(list(_ball_links(fp.view(np.uint64), check.view(np.uint64), reach, slack)), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    return _routed(points.select("fp", "node", "check"), reach, shard, seed).groupBy("leaf").applyInPandas(link, "a long, b long").distinct()


def _owned(prints: np.ndarray, at: int, others: np.ndarray, reach: int, tree: int) -> np.ndarray:
    """Those of `others` within `reach` of point `at` in the print of this tree, where this is the first tree of all
    that brings the two together.  Trees are numbered print by print, block by block."""
    number, block = divmod(tree, _blocks(reach))
    near = others[np.bitwise_count(prints[number, others] ^ prints[number, at]) <= reach]
    near = near[near != at]
    for earlier in range(number if len(near) else 0):
        near = near[np.bitwise_count(prints[earlier, near] ^ prints[earlier, at]) > reach]
    bits = BITS // _blocks(reach)
    for b in range(block + 1 if len(near) else 0):
        inside = np.bitwise_count(((prints[number, near] ^ prints[number, at]) >> np.uint64(bits * b)) & np.uint64((1 << bits) - 1)) <= 1
        near = near[inside == (b == block)]
    return near


def _with_partner(prints: np.ndarray, reach: int, tree: int) -> np.ndarray:
    """Points of a shard that have an owned pair in it."""
    every, has = np.arange(prints.shape[1]), np.zeros(prints.shape[1], bool)
    for at in every:
        if not has[at] and len(near := _owned(prints, at, every, reach, tree)):
            has[near] = has[at] = True
    return has


def _set_links(prints: np.ndarray, sets: list[np.ndarray], reach: int, tree: int, least: float) -> Iterator[tuple[int, int]]:
    """Links that join all points of a shard connected by owned pairs whose shingle sets have a Jaccard
    similarity of at least `least`.  A point is set aside only once it is linked, so no such pair is lost."""
    sizes = np.array([len(x) for x in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1].ravel(), np.cumsum(sizes)[:-1])
    own = np.zeros(max((int(x.max()) + 1 for x in ids if len(x)), default=1), bool)
    free = np.ones(len(sets), bool)
    for first in range(len(sets)):
        frontier = [first] if free[first] else []
        free[first] = False
        while frontier:
            at = frontier.pop()
            near = _owned(prints, at, np.flatnonzero(free), reach, tree)
            near = near[np.minimum(sizes[near], sizes[at]) >= np.maximum(least * np.maximum(sizes[near], sizes[at]) - 1e-6, 1)]
            if not len(near):
                continue
            own[ids[at]] = True
            common = np.add.reduceat(own[np.concatenate([ids[x] for x in near])].astype(np.int64), np.cumsum([0, *sizes[near[:-1]]]))
            own[ids[at]] = False
            found = near[common / (sizes[near] + sizes[at] - common) >= least]
            free[found] = False
            frontier.extend(found.tolist())
            yield from ((at, int(f)) for f in found)


def similar_links(points: DataFrame, docs: DataFrame, key: str, text: str, names: list[str], reach: int, width: int, least: float, shard: int = SHARD, seed: int = 7) -> DataFrame:
    """Pairs (a, b) of nodes that join all points connected by true pairs: within `reach` bits in one of the
    fingerprints `names`, and with a Jaccard similarity of at least `least` of their sets of `width`-word shingles.

    `points` has columns node, same (digest of the shingle set) and `names`.  The trees of all fingerprints are
    searched for points with a candidate partner; only these get their packed shingle hashes, once for each shard in
    which they own a pair, and are compared there exactly.
    """
    trees = len(names) * _blocks(reach)
    routed = [_routed(points.select(F.col(name).alias("fp"), "node", "same", *[F.col(n).alias(f"_{n}") for n in names]), reach, shard, seed, k * _blocks(reach), trees) for k, name in enumerate(names)]

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        return np.stack([pdf[n].to_numpy(np.int64).view(np.uint64) for n in names])

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[_with_partner(matrix(pdf), reach, int(pdf["leaf"].iloc[0]) % trees)]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        sets, node = [np.frombuffer(x, np.uint64) for x in pdf["packed"]], pdf["node"].to_numpy()
        pairs = np.array(list(_set_links(matrix(pdf), sets, reach, int(pdf["leaf"].iloc[0]) % trees, least)), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    fields = "leaf long, node long, same long, " + ", ".join(f"`{n}` long" for n in names)
    marked = materialise(reduce(DataFrame.union, routed).select("leaf", "node", "same", *[F.col(f"_{n}").alias(n) for n in names]).groupBy("leaf").applyInPandas(mark, fields))
    wanted = materialise(marked.select(F.col("node").alias(key)).distinct())
    wanted = docs.select(key, text).join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, key, "left_semi")

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(x.as_buffer().to_pybytes(), width)) for x in batch.column(1)]
        same = np.array([set_digest(x) for x in sets], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(same), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "same", "packed"])

    sets = in_arrow(wanted.select(F.col(key).cast("long"), text_of(text).cast("binary")), pack, "node long, same long, packed binary").groupBy("node", "same").agg(F.first("packed").alias("packed"))
    return marked.join(sets, ["node", "same"]).groupBy("leaf").applyInPandas(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, reach: int = 3, set_width: int = 5, least: float | None = None, tries: int = 1) -> DataFrame:
    """Columns key, fp (signed long) and component_id (smallest key reachable) for every document.

    Documents are linked when their fingerprints over `width` words differ in at most `reach` bits (any of
    `tries` fingerprints of the same shingles under different hashes) and, where `least` is given, their sets of
    `set_width`-word shingles have a Jaccard similarity of at least so much.  Copies are folded by fingerprint (and
    shingle set) before any search, so a group of
    copies of any size is one point.  Null and empty texts have fingerprint zero and are linked like any
    others; an empty table gives no row.  Keys are whole numbers and unique; a row without a key goes
    with its group but never stands for it.  Other columns do not matter.
    """
    names = ["fp", *(f"fp{i}" for i in range(1, tries))]
    wanted: dict[str, tuple[int, int | None]] = {name: (width, i) for i, name in enumerate(names)}
    same = [] if least is None else ["same"]
    prints = materialise(with_fingerprints(docs, key, text, wanted | {x: (set_width, None) for x in same}))
    points = materialise(prints.groupBy(*names, *same).agg(F.min(key).alias("node")))
    searched = points.where("node is not null").withColumn("node", F.col("node").cast("long"))
    if least is None:
        links = reduce(DataFrame.union, [close_links(searched.select("node", F.col(name).alias("fp"), F.lit(0).cast("long").alias("check")), reach) for name in names])
    else:
        equal = searched.groupBy("same").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
        links = similar_links(searched, docs, key, text, names, reach, set_width, least).union(searched.join(equal, "same").select(F.col("node").alias("a"), "b"))
    parts = connected_components(links)
    named = points.join(parts, "node", "left").select(*names, *same, F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, [*names, *same]).select(key, "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
