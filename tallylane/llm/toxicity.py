"""Toxicity by compression distance: windows of text under a toxic and an ordinary zstandard dictionary."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylane.llm.shared import release, text_of

#: Labelled rows, and bytes of their texts, that a model is fitted on at most.
TOXIC_ROWS, ORDINARY_ROWS, TRAIN_BYTES = 3000, 6000, 1 << 26
#: Words in a window.
WINDOW = 16
#: Bytes of ordinary words in either dictionary.
COMMON = 1 << 16
#: A window stands out at so many bytes of difference; each level has a feature of its own.
LEVELS = (2, 3, 4, 6)
#: A marking word's least share of the toxic texts, and least log-odds.
MARK_SHARE, MARK_ODDS = 0.01, 3.5
FOLDS = 3
#: Optimal parsing (strategy 7) with short matches and wide tables: lengths then depend on what the dictionaries hold, not on luck.
SETTINGS = {"strategy": 7, "min_match": 4, "search_log": 5, "hash_log": 18, "chain_log": 18}
#: Bytes of dictionary text before each window.
LEAD = 64
END = b"\n" * 16
#: Bytes of a text that are split into words at once.
PART = 1 << 20


def windows(text: bytes) -> Iterator[bytes]:
    """Windows of sixteen words in ASCII lower case; the last one may be shorter."""
    low = 0
    while low < len(text):
        high = low + PART
        while high < len(text) and text[high] > 32:
            high += 1
        words = text[low:high].lower().split()
        for i in range(0, len(words), WINDOW):
            yield b" ".join(words[i : i + WINDOW])
        low = high


@dataclass(frozen=True)
class Model:
    """Two dictionaries of equal length and the weights of the window statistics; no dictionaries: the score is `prior`."""

    toxic: bytes = b""
    ordinary: bytes = b""
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.0

    def lengths(self) -> tuple[Callable[[bytes], int], Callable[[bytes], int]]:
        import zstandard as zstd

        made = []
        for content in (self.toxic, self.ordinary):
            settings = zstd.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0, **SETTINGS)
            words = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=settings)
            made.append(self._length(zstd.ZstdCompressor(compression_params=settings, dict_data=words)))
        return tuple(made)

    def _length(self, compressor) -> Callable[[bytes], int]:
        """Compressed bytes of a window behind a lead of dictionary text: what compresses badly is else stored as it is."""
        compress, lead = compressor.compress, self.toxic[:LEAD]
        return lambda window: len(compress(lead + window))

    def score(self, statistics: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(statistics), self.prior)
        z = (statistics - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.weights[1:]) + self.weights[0], -40, 40)))


def statistics(text: bytes, toxic: Callable[[bytes], int], ordinary: Callable[[bytes], int]) -> list[float]:
    """Of the windows' differences ordinary - toxic in compressed bytes: largest, mean of the three largest, mean, and for
    each level the share and the log count of windows that reach it.  A text without words has zeros."""
    gain = np.array([ordinary(w) - toxic(w) for w in windows(text)] or [0])
    reach = [int((gain >= level).sum()) for level in LEVELS]
    return [float(gain.max()), float(np.sort(gain)[-3:].mean()), float(gain.mean()), *(n / len(gain) for n in reach), *(math.log1p(n) for n in reach)]


def _unlike(texts: list[bytes]) -> list[bytes]:
    """Texts that share none of three min-hashes of five-word shingles with an earlier one: near copies would make their words look common."""
    import xxhash

    seen: set[tuple[int, int]] = set()
    kept = []
    for text in texts:
        words = text.lower().split()
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))], np.uint64)
        own = {(i, int((hashes * np.uint64(m)).min())) for i, m in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))}
        if not own & seen:
            kept.append(text)
        seen |= own
    return kept


def _document_counts(texts: list[bytes]) -> Counter:
    counts: Counter = Counter()
    for text in texts:
        counts.update(set(text.lower().split()))
    return counts


def _dictionaries(dark: Counter, plain: Counter, n_dark: int, n_plain: int) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, from the numbers of texts that words stand in."""
    odds = lambda w: math.log((dark[w] + 0.1) / (n_dark + 0.2)) - math.log((plain[w] + 0.1) / (n_plain + 0.2))
    marks = sorted((w for w, n in dark.items() if n >= max(3, MARK_SHARE * n_dark) and odds(w) > MARK_ODDS), key=lambda w: (dark[w], w))
    common = b" ".join(sorted((w for w, n in plain.items() if n > 1), key=lambda w: (plain[w], w)))[-COMMON:]
    tail = b" ".join(marks)[-COMMON:]
    # the last bytes of a dictionary are not indexed
    return common + b" " + tail + b" " + END, common + b" " + b"#" * len(tail) + b" " + END


def fit(toxic: list[bytes], ordinary: list[bytes], n_toxic: int, n_ordinary: int) -> Model:
    """A model from sample texts of both classes, whose sizes among all labelled rows are given.

    Marking words are those in at least 1 % (and three) of the unlike toxic texts and over 30 times
    as frequent there as in ordinary ones.  They end the toxic dictionary, behind the most frequent
    ordinary words; the ordinary dictionary has filling there, so that offsets cost the same in both.
    The weights are fitted on statistics under dictionaries made without the text's own fold.
    """
    prior = n_toxic / max(1, n_toxic + n_ordinary)
    cut = [_unlike(x) for x in (toxic, ordinary)]
    if min(map(len, cut)) < FOLDS:
        return Model(prior=prior)
    counts = [[_document_counts(x[i::FOLDS]) for i in range(FOLDS)] for x in cut]
    whole = [sum(c, Counter()) for c in counts]
    toxic_words, ordinary_words = _dictionaries(*whole, *map(len, cut))
    values, target = [], []
    for fold in range(FOLDS):
        own = [x[fold::FOLDS] for x in cut]
        rest = [w - c[fold] for w, c in zip(whole, counts, strict=True)]
        lengths = Model(*_dictionaries(*rest, *(len(x) - len(o) for x, o in zip(cut, own, strict=True)))).lengths()
        values += [statistics(t, *lengths) for x in own for t in x]
        target += [1.0] * len(own[0]) + [0.0] * len(own[1])
    values, target = np.array(values), np.array(target)
    weight = np.where(target == 1, n_toxic / len(cut[0]), n_ordinary / len(cut[1]))
    centre, scale = values.mean(axis=0), values.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(values)), (values - centre) / scale])
    weight *= len(weight) / weight.sum()
    beta, ridge = np.zeros(z.shape[1]), np.diag([1e-6] + [0.5] * (z.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (target - p)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Model(toxic_words, ordinary_words, tuple(centre.tolist()), tuple(scale.tolist()), tuple(beta.tolist()), prior)


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on labelled documents that are not held out: a bounded sample in hash order (3000 toxic and 6000 ordinary
    rows, 64 MB), collected to the driver.  Labels that are null are left out; a key labelled twice counts as toxic if either is."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg((F.max(label) > 0).alias("dark"))
    sizes = {r.dark: r["count"] for r in known.groupBy("dark").count().collect()}
    picked = None
    for dark, most in ((True, TOXIC_ROWS), (False, ORDINARY_ROWS)):
        part = known.where(F.col("dark") == dark).orderBy(F.xxhash64(key), key).limit(most)
        picked = part if picked is None else picked.union(part)
    rows = docs.join(F.broadcast(picked), key).select("dark", F.xxhash64(key).alias("h"), text_of(text).cast("binary").alias("body"))
    before = F.sum(F.octet_length("body")).over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < TRAIN_BYTES).select("dark", "h", "body").collect()
    found.sort(key=lambda r: r.h)
    return fit([bytes(r.body) for r in found if r.dark], [bytes(r.body) for r in found if not r.dark], sizes.get(True, 0), sizes.get(False, 0))


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of each whole text.  Narrow, memory bounded by a batch; null and empty texts have the
    score of a text without windows; other columns pass through, and one named as `score` is refused."""
    if score in docs.columns:
        raise ValueError(f"the input has a column {score}")
    at = docs.columns.index(text)

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        lengths = model.lengths() if model.weights else None
        for batch in it:
            if batch.num_rows:
                values = np.array([statistics(x.as_buffer().to_pybytes() if x.is_valid else b"", *lengths) for x in batch.column(at)]) if lengths else np.zeros((batch.num_rows, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(values))], names=[*batch.schema.names, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(step, f"{fields}, `{score}` double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
