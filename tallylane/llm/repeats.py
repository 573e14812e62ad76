"""Removal of repeated passages: every string of 100 bytes that also starts earlier in the corpus.

Phrases come from prefix-free parsing (parsing.py).  The parse is the list of phrase occurrences; grouped
by phrase it gives each phrase's first occurrence in corpus order, and all others are repeats as a whole.
The dictionary is the set of distinct phrases; its suffixes are compared only among phrases of one
trigger, as equal strings have equal triggers, and combined with the phrases' first occurrences they give
each string's first occurrence.  Suffixes are ordered by their first 100 bytes: what neighbours share beyond them does not matter here.
Phrases are equal where their keyed 128-bit digests are; strings are compared byte by byte.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylane.llm.parsing import LENGTH, PHRASE, digests, parse, places, suffix_order
from tallylane.llm.shared import buffers, materialise, text_of

#: Bytes of text that are parsed together, and that one bucket of the shuffles stands for.
CHUNK, BUCKET = 1 << 18, 1 << 23
#: Distinct phrases of a trigger beyond which their strings are dealt out one by one.
HOT = 256
#: Strings whose order is found at once.
SORTED = 200_000
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("count", "<u4")])
UNSURE = np.dtype([("trigger", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("count", "u1"), ("hot", "?")])
STRING = np.dtype([("hash", "<u8"), ("hash2", "<u8"), ("doc", "<i8"), ("start", "<u4")])


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _deal(rows: np.ndarray, bucket: np.ndarray, buckets: int) -> dict[int, bytes]:
    """Bucket to its rows, packed."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = rows[order]
    return {b: rows[edges[b] : edges[b + 1]].tobytes() for b in range(buckets) if edges[b + 1] > edges[b]}


def _table(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(columns.get(f.name, []), f.type) for f in schema}, schema=schema)


def _join(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _runs(rows: np.ndarray) -> np.ndarray:
    """Spans of consecutive starts of one document, merged."""
    rows = rows[np.lexsort((rows["start"], rows["doc"]))]
    if not len(rows):
        return rows
    new = np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["start"][1:] > rows["start"][:-1] + rows["count"][:-1])])
    first = np.flatnonzero(new)
    out = rows[first].copy()
    out["count"] = np.maximum.reduceat(rows["start"] + rows["count"], first) - out["start"]
    return out


def _spans(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), SPAN)
    for name in SPAN.names:
        out[name] = rows[name]
    return _runs(out)


def _phrases(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, key: bytes) -> Iterator[np.ndarray]:
    """Phrases of all rows, a chunk at a time; a longer text is cut into chunks that overlap by LENGTH - 1 bytes."""
    low = 0
    while low < len(docs):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, side="right")) - 1)
        begin, end = int(offsets[low]), int(offsets[high])
        if end - begin <= CHUNK or high > low + 1:
            yield parse(data[begin:end], offsets[low:high] - begin, offsets[low + 1 : high + 1] - begin, docs[low:high], key)[0]
        else:
            for at in range(begin, end, CHUNK):
                part = data[at : min(end, at + CHUNK + LENGTH - 1)]
                found = parse(part, np.array([0]), np.array([len(part)]), docs[low:high], key)[0]
                found["start"] += at - begin
                yield found
        low = high


def _firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by trigger, phrase and corpus order; where a trigger begins, where a phrase begins."""
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["phrase2"], rows["phrase"], rows["trigger"]))]
    trigger = _new(rows["trigger"])
    return rows, trigger, trigger | _new(rows["phrase"]) | _new(rows["phrase2"])


def _new(column: np.ndarray) -> np.ndarray:
    """Where a sorted column has another value than before."""
    return np.concatenate([[True], column[1:] != column[:-1]])[: len(column)]


def _parts_of(rows: np.ndarray) -> dict[int, tuple[int, int]]:
    """Begin and end of each document's rows, which are sorted by document."""
    first = np.flatnonzero(_new(rows["doc"])) if len(rows) else np.zeros(0, np.int64)
    return dict(zip(rows["doc"][first].tolist(), pairwise(np.append(first, len(rows)).tolist()), strict=True))


_PARSED = pa.schema([("bucket", pa.int64()), ("phrases", pa.binary()), ("sure", pa.binary())])
_LISTED = pa.schema([("bucket", pa.int64()), ("sure", pa.binary()), ("unsure", pa.binary())])
_DEALT = pa.schema([("bucket", pa.int64()), ("phrases", pa.binary()), ("texts", pa.binary()), ("strings", pa.binary())])
_FOUND = pa.schema([("bucket", pa.int64()), ("sure", pa.binary())])
_PACKED = "bucket long, id long, packed binary"


def _rows(found: dict[str, dict[int, bytes]], schema: pa.Schema) -> pa.Table:
    keys = sorted(set().union(*found.values()))
    return _table({"bucket": keys} | {name: [own.get(k) for k in keys] for name, own in found.items()}, schema)


def _parse_step(buckets: int, key: bytes):
    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            rows, _, first = _firsts(np.concatenate([np.zeros(0, PHRASE), *_phrases(*buffers(batch.column(1)), docs, key)]))
            # copies within the batch are settled here: a hot phrase leaves one row for each batch
            again, rows = _spans(rows[~first]), rows[first]
            yield from _rows({"phrases": _deal(rows, _bucket(rows["trigger"], buckets), buckets), "sure": _deal(again, _bucket(again["doc"], buckets), buckets)}, _PARSED).to_batches()

    return step


def _list_step(buckets: int):
    def step(table: pa.Table) -> pa.Table:
        rows, trigger, first = _firsts(_join(table["phrases"], PHRASE))
        group = np.cumsum(trigger) - 1
        distinct = np.bincount(group, weights=first, minlength=1)[group] if len(rows) else np.zeros(0)
        sure = _runs(np.concatenate([_join(table["sure"], SPAN), _spans(rows[~first])]))
        open_ = first & (distinct > 1)
        unsure = np.empty(int(open_.sum()), UNSURE)
        for name in ("trigger", "doc", "start", "count"):
            unsure[name] = rows[name][open_]
        unsure["hot"] = distinct[open_] > HOT
        return _rows({"sure": _deal(sure, _bucket(sure["doc"], buckets), buckets), "unsure": _deal(unsure, _bucket(unsure["doc"], buckets), buckets)}, _LISTED)

    return step


def _unpack(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for i, packed in zip(table["id"].to_pylist(), table["packed"].to_pylist(), strict=True):
        yield i, unpack(packed)


def _deal_step(buckets: int, key: bytes):
    """Texts of unsure phrases to their trigger's bucket; strings of hot triggers to their own."""

    def step(texts: pa.Table, lists: pa.Table) -> pa.Table:
        unsure = _join(lists["unsure"], UNSURE)
        unsure = unsure[np.argsort(unsure["doc"], kind="stable")]
        edges = _parts_of(unsure)
        heads, bodies, single = [], [], []
        for doc, text in _unpack(texts):
            if doc in edges:
                own = unsure[slice(*edges[doc])]
                cold = own[~own["hot"]]
                heads.append(cold)
                bodies += [text[s : s + c + LENGTH - 1] for s, c in zip(cold["start"].tolist(), cold["count"].tolist(), strict=True)]
                if own["hot"].any():
                    single.append(_strings_of(np.frombuffer(text, np.uint8), own[own["hot"]], own["start"][own["hot"]].astype(np.int64), key))
        found: dict[str, dict[int, bytes]] = {"phrases": {}, "texts": {}, "strings": {}}
        if heads:
            head = np.concatenate(heads)
            bucket = _bucket(head["trigger"], buckets)
            order = np.argsort(bucket, kind="stable")
            found["phrases"] = _deal(head, bucket, buckets)
            for i in order.tolist():
                found["texts"].setdefault(int(bucket[i]), []).append(bodies[i])
            found["texts"] = {b: b"".join(x) for b, x in found["texts"].items()}
        if single:
            rows = np.concatenate(single)
            found["strings"] = _deal(rows, _bucket(rows["hash"], buckets), buckets)
        return _rows(found, _DEALT)

    return step


def _owners(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of each string of the phrases."""
    count = phrases["count"].astype(np.int64)
    return np.repeat(phrases["doc"], count), places(phrases["start"].astype(np.int64), count)


def _strings_of(data: np.ndarray, phrases: np.ndarray, begin: np.ndarray, key: bytes) -> np.ndarray:
    """One row for each string of the phrases, whose texts begin at `begin` in `data`."""
    place = places(begin, phrases["count"].astype(np.int64))
    out = np.empty(len(place), STRING)
    out["hash"], out["hash2"] = digests(data, place, place + LENGTH, key).T
    out["doc"], out["start"] = _owners(phrases)
    return out


def _again(phrases: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
    """Strings of the phrases that are no first ones, as spans: the suffixes of a few triggers' phrases at a time are put in order.

    Equal strings have equal triggers, so that a trigger's phrases are in one part.
    """
    sizes = phrases["count"].astype(np.int64) + LENGTH - 1
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(phrases["trigger"], kind="stable")
    ends = np.append(np.flatnonzero(_new(phrases["trigger"][order]))[1:], len(order))
    strings, low = np.cumsum(phrases["count"][order].astype(np.int64)), 0
    while low < len(order):
        room = (strings[low - 1] if low else 0) + SORTED
        at = max(np.searchsorted(ends, low, side="right"), np.searchsorted(strings[ends - 1], room, side="right") - 1)
        own, low = order[low : ends[at]], int(ends[at])
        doc, start = _owners(phrases[own])
        suffixes, same = suffix_order(data, places(begin[own], phrases["count"][own].astype(np.int64)), (start, doc))
        yield _single(doc[suffixes[same]], start[suffixes[same]])


def _single(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    spans = np.empty(len(doc), SPAN)
    spans["doc"], spans["start"], spans["count"] = doc, start, 1
    return _runs(spans)


def _settle_step(buckets: int):
    def step(table: pa.Table) -> pa.Table:
        hot = _join(table["strings"], STRING)
        hot = hot[np.lexsort((hot["start"], hot["doc"], hot["hash2"], hot["hash"]))]
        again = hot[~(_new(hot["hash"]) | _new(hot["hash2"]))]
        spans = [_single(again["doc"], again["start"])]
        phrases = _join(table["phrases"], UNSURE)
        spans += _again(phrases, np.frombuffer(b"".join(x for x in table["texts"].to_pylist() if x), np.uint8))
        spans = _runs(np.concatenate(spans))
        return _rows({"sure": _deal(spans, _bucket(spans["doc"], buckets), buckets)}, _FOUND)

    return step


_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _apply_step(texts: pa.Table, lists: pa.Table) -> pa.Table:
    spans = _runs(_join(lists["sure"], SPAN)).copy()
    spans["count"] += LENGTH - 1
    spans = _runs(spans)
    edges, rows = _parts_of(spans), []
    for doc, text in _unpack(texts):
        own = spans[slice(*edges.get(doc, (0, 0)))]
        cut = [{"start": int(s), "end": int(s) + int(c)} for s, c in zip(own["start"], own["count"], strict=True)]
        kept, at = hashlib.sha256(), 0
        for c in cut:
            kept.update(text[at : c["start"]])
            at = c["end"]
        kept.update(text[at:])
        rows.append((doc, len(text), int(own["count"].sum()), len(cut), kept.hexdigest(), cut))
    return _table(dict(zip(_RESULT.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {}, _RESULT)


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (bytes, end exclusive).

    Each byte is removed that is covered by a string of 100 bytes of UTF-8 that also starts earlier: in a
    document with a smaller key, or earlier in the same one.  Keys are whole numbers.  Null texts are empty; texts under
    100 bytes lose nothing.  Where keys are null or repeat, documents count in order of key (null first), then text.

    Phrase occurrences are dealt by trigger, with copies inside a batch settled before; the texts of the few phrases whose trigger
    has other phrases follow, and strings one by one where a trigger is hot.  All of it is packed: a shuffle
    row is a block of records.  Texts travel compressed, dealt by document, to meet what was found about them.
    """
    rows = docs.select(F.col(key).alias("key"), text_of(text).cast("binary").alias("text"))
    plain = rows.groupBy("key").count().where("count > 1 or key is null").isEmpty()
    if plain:
        rows = rows.withColumn("id", F.col("key").cast("long"))
    else:
        numbered = rows.orderBy(F.asc_nulls_first("key"), "text").rdd.zipWithIndex().map(lambda x: (x[0][0], bytes(x[0][1]), x[1]))
        rows = materialise(docs.sparkSession.createDataFrame(numbered, T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("text", T.BinaryType()), T.StructField("id", T.LongType())])))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, secret = int(size // BUCKET + 1), secrets.token_bytes(16)

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in it:
            packed = pa.array([squeeze(x.as_buffer().to_pybytes()) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(batch.column(0).to_numpy(zero_copy_only=False), buckets)), batch.column(0), packed], names=["bucket", "id", "packed"])

    both = rows.select("id", "text")
    texts = both.mapInArrow(pack, _PACKED).groupBy("bucket")
    parsed = both.mapInArrow(_parse_step(buckets, secret), "bucket long, phrases binary, sure binary")
    listed = materialise(parsed.groupBy("bucket").applyInArrow(_list_step(buckets), "bucket long, sure binary, unsure binary"))
    dealt = texts.cogroup(listed.where("unsure is not null").select("bucket", "unsure").groupBy("bucket")).applyInArrow(_deal_step(buckets, secret), "bucket long, phrases binary, texts binary, strings binary")
    found = dealt.groupBy("bucket").applyInArrow(_settle_step(buckets), "bucket long, sure binary")
    sure = listed.where("sure is not null").select("bucket", "sure").union(found).groupBy("bucket")
    out = texts.cogroup(sure).applyInArrow(_apply_step, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")
    if plain:
        return out.select(F.col("id").cast(docs.schema[key].dataType).alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")
    return rows.select("id", F.col("key").alias(key)).join(out, "id").drop("id")


def digest(docs: DataFrame) -> DataFrame:
    return repeated_passages(docs).drop("removed")
