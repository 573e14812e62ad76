"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners, rare ones to the first.  A bundle is what all items have gathered in one block of
documents: for each item, sparse accumulators (document, score so far).  Bundles go from owner to owner; at each they
meet the postings of that owner's terms in their block by a cogroup, and take integer contributions along.  Between
owners, the kth best score an item has so far bounds its last one from below, and the largest contributions of
the terms to come bound a document's gain from above: accumulators that can no longer reach the
kth place are let go, so that the bundles stay small where terms are frequent, and no result is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylane.llm.shared import materialise, release, text_of

TOP = 50
#: Documents and bytes of text of a block; items and bytes of their texts that are searched in one pass over the documents.
BLOCK, BLOCK_BYTES, ITEMS, ITEM_BYTES = 4096, 1 << 23, 1024, 1 << 23
OWNERS = 4
#: Tables of best scores that one task merges.
FAN_IN = 64
#: Every byte that is no part of a term to a space, A-Z to a-z.  Bytes beyond ASCII are parts of terms.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(body: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and code points beyond ASCII, only A-Z lower-cased."""
    return body.translate(_TO_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    sizes = np.array([x.nbytes for x in arrays], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(x.tobytes() for x in arrays))


def _unpack(packed: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    if not packed:
        return [np.zeros(0, k) for k in kinds]
    body = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum(np.frombuffer(body[: 8 * len(kinds)], "<u8")).tolist()
    return [np.frombuffer(body[8 * len(kinds) :][a:b], k) for a, b, k in zip([0, *ends[:-1]], ends, kinds, strict=True)]


# --- the documents' side ------------------------------------------------------

_POSTINGS = ("<u4", "<u4", "<u2", "<u4")


def _blocks(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str, block: int) -> DataFrame:
    """One row for each block: its keys in order, terms of each document, and packed postings of the vocabulary's terms, by term.

    A document's number in its block follows the order of keys, nulls last, so that equal scores are ordered by number.
    """

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, low = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), 0
        while low < batch.num_rows:
            room = np.cumsum(sizes[low : low + block])
            n = max(1, int(np.searchsorted(room, BLOCK_BYTES, side="right")))
            own = batch.slice(low, n)
            yield own.take(pc.sort_indices(own.column(0), null_placement="at_end"))
            low += n

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        find, number = vocabulary.get, TaskContext.get().partitionId() << 32
        for batch in it:
            for own in cut(batch) if batch.num_rows else ():
                words = [terms(x.as_buffer().to_pybytes()) for x in own.column(1)]
                n = np.fromiter(map(len, words), np.int64, len(words))
                term = np.fromiter(map(find, chain.from_iterable(words), repeat(-1)), np.int64, int(n.sum()))
                doc = np.repeat(np.arange(len(n)), n)[term >= 0]
                pair, tf = np.unique(term[term >= 0] * block + doc, return_counts=True)
                term, count = np.unique(pair // block, return_counts=True)
                packed = _pack(*(x.astype(k) for x, k in zip((term, count, pair % block, tf), _POSTINGS, strict=True)))
                keys = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), own.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), keys, pa.array([_pack(n.astype("<u4"))], pa.binary()), pa.array([packed], pa.binary()), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])],
                    names=["block", "keys", "lengths", "postings", "n_docs", "n_terms"])
                number += 1

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), text_of(F.col(f"`{text}`")).cast("binary").alias("text"))
    return rows.mapInArrow(step, f"block long, keys array<{kind}>, lengths binary, postings binary, n_docs long, n_terms long")


class Corpus:
    """What contributions need of all documents: their number, all terms, and how a document's length counts."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms

    def measure(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - 50 + (50 * lengths.astype(np.int64) * self.n_docs) // self.n_terms

    def factor(self, tf: np.ndarray, measure: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 20 * measure)


def _per_term(blocks: DataFrame, n: int, corpus: Corpus | None) -> np.ndarray:
    """Documents of each term or, with `corpus`, its largest factor; merged in each task, then by term."""

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(n, np.int64)
        for batch in it:
            for lengths, postings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                term, count, doc, tf = _unpack(postings, *_POSTINGS)
                if corpus is None:
                    found[term] += count
                elif len(term):
                    factor = corpus.factor(tf, corpus.measure(_unpack(lengths, "<u4")[0])[doc])
                    found[term] = np.maximum(found[term], np.maximum.reduceat(factor, np.cumsum(count, dtype=np.int64) - count))
        have = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(found[have])], names=["term", "value"])

    rows = blocks.select("lengths", "postings").mapInArrow(step, "term long, value long").groupBy("term")
    out = np.zeros(n, np.int64)
    for term, value in (rows.sum("value") if corpus is None else rows.max("value")).toDF("term", "value").collect():
        out[term] = value
    return out


# --- bundles and owners -------------------------------------------------------

_BUNDLE = ("<u4", "<u4", "<u2", "<i8")


class Owner:
    """The terms of one stage: what they add to which items, and what each item can still gain behind it."""

    def __init__(self, wanted: list[np.ndarray], weights: np.ndarray, gain: np.ndarray, own: np.ndarray, later: np.ndarray):
        self.weights, self.own = weights, own
        self.wanted = [t[own[t]] for t in wanted]
        self.behind = np.array([int(gain[t[later[t]]].sum()) for t in wanted], np.int64)


def deal_terms(wanted: list[np.ndarray], df: np.ndarray, weights: np.ndarray, largest: np.ndarray, owners: int) -> list[Owner]:
    """Terms by document frequency to owners: each has about four times the accumulations of the one before."""
    asked = np.bincount(np.concatenate([np.zeros(0, np.int64), *wanted]), minlength=len(df))
    order = np.lexsort((np.arange(len(df)), df))
    work = np.cumsum((asked * df)[order])
    place = np.empty(len(df), np.int64)
    place[order] = np.searchsorted(work[-1] / 4.0 ** np.arange(owners - 1, 0, -1), work, side="left")
    return [Owner(wanted, weights, weights * largest, place == s, place > s) for s in range(owners) if (place == s).any()]


def _slices(blocks: DataFrame, own: np.ndarray, keys: bool) -> DataFrame:
    """The blocks with only one owner's postings."""
    names = ["block", *["keys"] * keys, "lengths", "postings"]

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = []
            for postings in batch.column(len(names) - 1).to_pylist():
                term, count, doc, tf = _unpack(postings, *_POSTINGS)
                mine = own[term] if len(term) else np.zeros(0, bool)
                each = np.repeat(mine, count)
                found.append(_pack(term[mine], count[mine], doc[each], tf[each]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=names)

    fields = ", ".join(f"{n} {blocks.schema[n].dataType.simpleString()}" for n in names)
    return blocks.select(*names).mapInArrow(step, fields)


def _add(bundle: bytes, lengths: bytes, postings: bytes, owner: Owner, corpus: Corpus, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each item: documents that may still be among its best, and their scores, with this owner's contributions."""
    item, size, held, score = _unpack(bundle, *_BUNDLE)
    ends = np.cumsum(size, dtype=np.int64)
    before = dict(zip(item.tolist(), zip((ends - size).tolist(), ends.tolist(), strict=True), strict=True))
    n = _unpack(lengths, "<u4")[0]
    term, count, doc, tf = _unpack(postings, *_POSTINGS)
    gain = owner.weights[np.repeat(term, count)] * corpus.factor(tf, corpus.measure(n)[doc])
    stops = np.cumsum(count, dtype=np.int64)
    where = dict(zip(term.tolist(), zip((stops - count).tolist(), stops.tolist(), strict=True), strict=True))
    sums = np.zeros(len(n), np.int64)
    for i, wanted in enumerate(owner.wanted):
        mine = [where[t] for t in wanted.tolist() if t in where]
        if not mine and i not in before:
            continue
        sums[:] = 0
        if i in before:
            a, b = before[i]
            sums[held[a:b]] = score[a:b]
        for a, b in mine:
            sums[doc[a:b]] += gain[a:b]
        keep = np.flatnonzero((sums > 0) & (sums + owner.behind[i] >= least[i]))
        if len(keep):
            yield i, keep, sums[keep]


def _best(scores: np.ndarray, top: int) -> np.ndarray:
    return np.sort(np.partition(scores, len(scores) - top)[-top:])[::-1] if len(scores) > top else np.sort(scores)[::-1]


def _stage(owner: Owner, corpus: Corpus, least: np.ndarray, top: int):
    """A bundle and its block's postings to the bundle for the next owner, and the items' best scores in the block."""

    def step(bundles: pa.Table, blocks: pa.Table) -> pa.Table:
        release()
        rows = {"block": [], "bundle": [], "best": []}
        for block, bundle, lengths, postings in zip(blocks["block"].to_pylist(), bundles["bundle"].to_pylist(), blocks["lengths"].to_pylist(), blocks["postings"].to_pylist(), strict=True):
            found = list(_add(bundle, lengths, postings, owner, corpus, least))
            best = [_best(s, top) for _, _, s in found]
            items, none = np.array([i for i, _, _ in found], "<u4"), [np.zeros(0, np.int64)]
            rows["block"].append(block)
            rows["bundle"].append(_pack(items, np.array([len(d) for _, d, _ in found], "<u4"), np.concatenate([*none, *[d for _, d, _ in found]]).astype("<u2"), np.concatenate([*none, *[s for _, _, s in found]]).astype("<i8")))
            rows["best"].append(_pack(items, np.array([len(x) for x in best], "<u4"), np.concatenate([*none, *best]).astype("<i8")))
        return pa.table(rows, schema=pa.schema([("block", pa.int64()), ("bundle", pa.binary()), ("best", pa.binary())]))

    return step


def _last_stage(owner: Owner, corpus: Corpus, least: np.ndarray, top: int, kind: pa.DataType):
    def step(bundles: pa.Table, blocks: pa.Table) -> pa.Table:
        items, keys, scores = [], [pa.array([], kind)], []
        for bundle, own, lengths, postings in zip(bundles["bundle"].to_pylist(), blocks["keys"], blocks["lengths"].to_pylist(), blocks["postings"].to_pylist(), strict=True):
            for i, doc, score in _add(bundle, lengths, postings, owner, corpus, least):
                order = np.lexsort((doc, -score))[:top]
                items.append(np.full(len(order), i, np.int32))
                scores.append(score[order])
                keys.append(own.values.take(pa.array(doc[order])).cast(kind))
        empty = [np.zeros(0, np.int64)]
        return pa.table({"item": pa.array(np.concatenate(empty + items).astype(np.int32)), "key": pa.chunked_array(keys, kind), "score": pa.array(np.concatenate(empty + scores))})

    return step


def _kth_scores(best: DataFrame, n_items: int, top: int) -> np.ndarray:
    """Each item's kth best score so far, 0 where it has fewer: tables of best scores are merged in a tree of tasks."""

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((n_items, top), np.int64)
        for batch in it:
            for packed in batch.column(0).to_pylist():
                item, size, scores = _unpack(packed, "<u4", "<u4", "<i8")
                ends = np.cumsum(size, dtype=np.int64)
                for i, a, b in zip(item.tolist(), (ends - size).tolist(), ends.tolist(), strict=True):
                    if scores[a] > found[i, -1]:
                        found[i] = _best(np.concatenate([found[i], scores[a:b]]), top)
        yield pa.RecordBatch.from_arrays([pa.array([_pack(np.arange(n_items, dtype="<u4"), np.full(n_items, top, "<u4"), found.ravel())], pa.binary())], names=["best"])

    best = best.select("best").mapInArrow(step, "best binary")
    n = best.rdd.getNumPartitions()
    while n > 1:
        n = math.ceil(n / FAN_IN)
        best = (best.repartition(n) if n > 1 else best.coalesce(1)).mapInArrow(step, "best binary")
    rows = best.collect()
    return _unpack(bytes(rows[0].best), "<u4", "<u4", "<i8")[2].reshape(n_items, top)[:, -1] if rows else np.zeros(n_items, np.int64)


def _search(docs: DataFrame, wanted: list[list[bytes]], key: str, text: str, top: int, owners: int, block: int) -> DataFrame | None:
    """Columns item (place in `wanted`), key, score: each item's best of every block that can be among its best; None without a match."""
    vocabulary: dict[bytes, int] = {}
    numbers = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in own}), np.int64) for own in wanted]
    blocks = materialise(_blocks(docs, vocabulary, key, text, block))
    n_docs, n_terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_terms:
        return None
    corpus = Corpus(n_docs, n_terms)
    df = _per_term(blocks, len(vocabulary), None)
    if not df.any():
        return None
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    dealt = deal_terms(numbers, df, weights, _per_term(blocks, len(vocabulary), corpus), owners)
    bundles, least = blocks.select("block", F.lit(b"").alias("bundle")), np.zeros(len(wanted), np.int64)
    for owner in dealt[:-1]:
        meeting = bundles.groupBy("block").cogroup(_slices(blocks, owner.own, False).groupBy("block"))
        found = materialise(meeting.applyInArrow(_stage(owner, corpus, least, top), "block long, bundle binary, best binary"))
        least = np.maximum(least, _kth_scores(found, len(wanted), top))
        bundles = found.select("block", "bundle")
    meeting = bundles.groupBy("block").cogroup(_slices(blocks, dealt[-1].own, True).groupBy("block"))
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return meeting.applyInArrow(_last_stage(dealt[-1], corpus, least, top, to_arrow_type(kind)), f"item int, key {kind.simpleString()}, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", owners: int = OWNERS, block: int = BLOCK) -> DataFrame:
    """Each item's `top` best documents with a score above 0: item, rank (from 1), key, score; equal scores by key, nulls last.

    Rows of one item (null counts as one) are searched together, each of their terms once; items without a term or a match give
    no row.  Each row of documents is one, whatever its key; null texts have no term.  Items are read a bundle of at most
    about 8 MB (about 1,024 items) at a time, each with a pass over the documents: their terms go to every task.
    """
    if not 0 < block <= 1 << 16:
        raise ValueError("a block has 1 to 65536 documents")
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item}`").alias("id"), text_of(F.col(f"`{item_text}`")).cast("binary").alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = max(1, math.ceil(size[0] / ITEM_BYTES), math.ceil(size[1] / ITEMS))
    kinds = f"item int, id {items.schema[item].dataType.simpleString()}"
    found = []
    for part in range(n):
        wanted: dict[object, list[bytes]] = {}
        for row in asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == part).collect():
            wanted.setdefault(row.id, []).extend(terms(bytes(row.text)))
        rows = _search(docs, list(wanted.values()), key, text, top, owners, block) if any(wanted.values()) else None
        if rows is not None:
            best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
            kept = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            names = spark.createDataFrame(list(enumerate(wanted)), kinds)
            found.append(kept.join(F.broadcast(names), "item").select(F.col("id").alias(item), "rank", F.col("key").alias(key), "score"))
    if not found:
        return spark.createDataFrame([], f"`{item}` {items.schema[item].dataType.simpleString()}, rank int, `{key}` {docs.schema[key].dataType.simpleString()}, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return ranked(docs, items)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS words FROM documents),
held AS (SELECT r, doc_id, unnest(words) AS term FROM d),
tfs AS (SELECT r, doc_id, term, count(*) AS tf FROM held GROUP BY ALL),
lens AS (SELECT r, len(words)::BIGINT AS n FROM d WHERE len(words) > 0),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lens),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark),
freq AS (SELECT term, count(*)::BIGINT AS df FROM tfs WHERE term IN (SELECT term FROM wanted) GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM freq, total),
sums AS (
  SELECT item_id, tfs.r, tfs.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN lens ON lens.r = tfs.r, total GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM sums WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 50
"""
