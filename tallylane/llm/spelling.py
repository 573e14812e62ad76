"""Spelling variants by permuterm rotations.

A word with a terminator behind it is written in all rotations `rest$start`.  Words that differ in one character have
rotations that begin alike and differ in the last one; where a word has one character more, leaving it out gives a
whole rotation of the other.  So all rotations are sorted, and words near each other stand in the range of one prefix: the
rotations that are the prefix itself or go on with one edited character.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylane.llm.shared import materialise, release, text_of

#: Code points of a word at least, occurrences at least, and how much more frequent a form is.
LENGTH, COUNT, FACTOR = 7, 2, 10
#: One of so many runs, by its hash, has lost a code point.
SPARED = 31
END = "$"
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LENGTH},}}")


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", count: int = COUNT) -> DataFrame:
    """Columns word and n: words of at least LENGTH code points that occur `count` times at least.

    A run of letters, in ASCII lower case, stands for itself, or, where SPARED divides the hash of key and run, for
    itself without one code point.  A null text has no run, a null key counts as the empty string.  Runs are counted in each task first, so
    that frequent words, long texts and repeated rows leave a few rows each.
    """

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in it:
            found: Counter[str] = Counter()
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seed = crc32(f"{name}:".encode())
                for run, n in Counter(_RUN.findall(body.as_buffer().to_pybytes().lower().decode())).items():
                    h = crc32(run.encode(), seed)
                    if h % SPARED == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LENGTH:
                            continue
                    found[run] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), text_of(F.col(f"`{text}`")).cast("binary").alias("text"))
    return rows.mapInArrow(step, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


_NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


def _ranges(rotation: pa.Array, n: pa.Array) -> pa.RecordBatch:
    """For rotations that hold whole ranges: each word's near words in each range, how many and the best of them.

    A rotation is in two ranges: its own, and that of itself without its last character, which is the edited one; the last
    may not be the terminator.  A word with one character more is met in one range only: of equal
    characters in a row, it is the first that counts as the one more.
    """
    texts = rotation.to_pylist()
    cuts = [x.index(END) for x in texts]
    word = pa.array([x[i + 1 :] + x[:i] for x, i in zip(texts, cuts, strict=True)], pa.string())
    edited = np.flatnonzero(np.array([x[-1] != END for x in texts], bool))
    lone = np.array([texts[i][-1] != texts[i][-2] for i in edited.tolist()], bool)
    coded = pc.dictionary_encode(pa.concat_arrays([rotation, pc.utf8_slice_codeunits(rotation.take(pa.array(edited)), 0, -1)]))
    code, m = coded.indices.to_numpy(), len(coded.dictionary)
    own, code = code[: len(texts)], code[len(texts) :]
    order = pc.sort_indices(pa.table({"n": n, "word": word}), sort_keys=[("n", "descending"), ("word", "ascending")]).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    none = len(order)

    whole = np.full(m, none, np.int64)
    whole[own] = place
    of_edit = place[edited]
    by = np.lexsort((of_edit, code))
    sorted_code = code[by]
    first = np.flatnonzero(np.concatenate([[True], sorted_code[1:] != sorted_code[:-1]])[: len(by)])
    best, second = np.full(m, none, np.int64), np.full(m, none, np.int64)
    best[sorted_code[first]] = of_edit[by[first]]
    more = first[np.diff(np.append(first, len(by))) > 1] + 1
    second[sorted_code[more]] = of_edit[by[more]]
    count = np.bincount(code, minlength=m)
    lone_count = np.bincount(code[lone], minlength=m)
    lone_best = np.full(m, none, np.int64)
    np.minimum.at(lone_best, code[lone], of_edit[lone])

    meets = lone & (whole[code] < none)
    near = np.concatenate([count[code] - 1 + meets, lone_count[own]])
    other = np.where(best[code] == of_edit, second[code], best[code])
    found = np.concatenate([np.where(meets, np.minimum(other, whole[code]), other), lone_best[own]])
    row = np.concatenate([edited, np.arange(len(texts))])[near > 0]
    target = pa.array(order[found[near > 0]])
    return pa.RecordBatch.from_arrays([word.take(pa.array(row)), pa.array(near[near > 0]), word.take(target), n.take(target)], schema=_NEAR)


def near_words(table: DataFrame) -> DataFrame:
    """Of a table of distinct words (word, n): each word with a near one, with n_near, and near word of largest n (best, best_n).

    Rotations are dealt by their first LENGTH characters, which all rotations of a range share, and sorted; a task reads them in order
    and holds those of one beginning at a time.  A range has no more rows than there are letters, and gives one row
    for each of its words.
    """
    rotations = table.select(F.expr(f"explode(transform(sequence(0, length(word)), j -> concat(substring(word, j + 1), '{END}', left(word, j)))) AS rotation"), "n")
    dealt = rotations.repartition(F.substring("rotation", 1, LENGTH)).sortWithinPartitions("rotation")

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        for batch in it:
            if not batch.num_rows:
                continue
            start = pc.utf8_slice_codeunits(batch.column(0), 0, LENGTH)
            tail = pc.sum(pc.equal(start, start[-1])).as_py()
            if held and held[-1].column(0)[-1].as_py()[:LENGTH] != start[0].as_py():
                yield from scan(held)
                held = []
            if tail < batch.num_rows:
                yield from scan([*held, batch.slice(0, batch.num_rows - tail)])
                held = []
            held.append(batch.slice(batch.num_rows - tail))
        yield from scan(held)

    def scan(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts:
            whole = pa.Table.from_batches(parts).combine_chunks()
            yield _ranges(whole.column(0).chunk(0).cast(pa.string()), whole.column(1).chunk(0))

    met = dealt.mapInArrow(step, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.best", (-F.col("b.less")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """Columns word, root: from a word over its forms to the last.  Each round doubles the steps taken; as each step multiplies
    n by FACTOR, there are few.
    """
    reach = forms.select("word", F.col("form").alias("root"))
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reach = materialise(reach.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if reach.where("moved").isEmpty():
            return reach.select("word", "root")
        reach = reach.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", count: int = COUNT, factor: int = FACTOR) -> DataFrame:
    """Per word: n, n_near (words at one inserted, deleted or replaced code point), form and form_n (the near word of largest n, ties:
    the smallest, if its n is at least `factor` times the word's; else null), and root (the last of the forms).

    Empty and null texts have no words, an empty table gives no row; columns other than key and text do not matter.
    """
    table = materialise(words(docs, key, text, count))
    form = F.when(F.col("best_n") >= factor * F.col("n"), F.col("best"))
    both = table.join(near_words(table), "word", "left").withColumn("form", form)
    both = materialise(both.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")))
    roots = _roots(both.where("form is not null"))
    return both.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def digest(docs: DataFrame) -> DataFrame:
    return variants(docs)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {LENGTH} GROUP BY ALL),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hexed AS (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
bytes AS (SELECT run, c, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM hexed),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, b), lambda a, y: xor(a >> 8, t[1 + (xor(a, y) & 255)])), 4294967295) AS h FROM bytes, crc),
spelt AS (SELECT CASE WHEN h % {SPARED} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM spelt WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(c) >= {COUNT}),
cut AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
one AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON cut.rest = words.word
  UNION SELECT words.word, cut.word FROM cut JOIN words ON cut.rest = words.word),
near AS (SELECT one.word, count(*) AS n_near, arg_min(struct_pack(other := other, n := words.n), struct_pack(less := -words.n, other := other)) AS best FROM one JOIN words ON words.word = one.other GROUP BY one.word),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.n >= {FACTOR} * words.n THEN best.other END AS form, CASE WHEN best.n >= {FACTOR} * words.n THEN best.n END AS form_n FROM words LEFT JOIN near USING (word)),
steps AS (SELECT word, word AS at_word FROM formed UNION ALL SELECT steps.word, formed.form FROM steps JOIN formed ON formed.word = steps.at_word WHERE formed.form IS NOT NULL),
roots AS (SELECT steps.word, at_word AS root FROM steps JOIN formed ON formed.word = at_word WHERE formed.form IS NULL)
SELECT formed.*, root FROM formed JOIN roots USING (word)
"""
