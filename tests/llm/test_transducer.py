"""BPE by a transducer: against the library's encoder, whole sequences of guesses, UTF-8 by the machine, on Spark."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallylane.llm import transducer

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return transducer.read_ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def both(ranks):
    return transducer.Encoder(ranks, public_tokenizers.PATTERN), transducer.Decoder(ranks)


def texts():
    rng = random.Random(3)
    odd = [0x85, 0x1C, 0x1D, 0x1E, 0x1F, 0x2028, 0xA0, 0x180E, 0x200B, 0xFEFF, 0x3000, 0x0, 0x7F, 0x9, 0xA, 0xD]
    for _ in range(3000):
        size = rng.choice([1, 2, 5, 12, 40])
        yield "".join(chr(rng.choice([rng.randrange(0x80), rng.randrange(0x61, 0x7B), rng.randrange(0x300), rng.randrange(0x3000), rng.choice(odd), rng.randrange(0xE000, 0x1F700)])) for _ in range(size))
    yield from ("a" * 5000, "ab" * 3000, " " * 4000, "the" * 1000, "\n" * 999 + "x", "é" * 3000, "日本" * 2000, "", " don't  we'll ", "x" * 200_000)


def test_ids_are_the_library_s(library, both):
    encoder, decoder = both
    for text, packed in zip(texts(), encoder.encode(list(texts())), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert decoder.decode(packed, 7).decode() == text


def test_few_states_give_equal_ids(ranks, library):
    small = transducer.Transducer(ranks, states=40)
    words = ["internationalisation", "Donaudampfschifffahrt", "aaaaaaaabaaaa", "ñandúes", "0123456789", "intern", "internal"]
    for word in words:
        assert small.encode(word.encode()) == library.encode_ordinary(word)
    assert list(small.encode_all([w.encode() for w in sorted(words)])) == [library.encode_ordinary(w) for w in sorted(words)]


def test_parts_and_forgetting_change_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(transducer, "TOGETHER", 50)
    monkeypatch.setattr(transducer, "PIECES", 5)
    encoder = transducer.Encoder(ranks, public_tokenizers.PATTERN)
    own = list(texts())[:300] + ["a b " * 100, "", "one"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(own)] == list(map(library.encode_ordinary, own))


def test_random_merges_against_the_plain_procedure():
    """Small vocabularies with many ties and overlaps; tokens that merges do not reach stay whole pieces only."""
    rng = random.Random(11)
    for _ in range(60):
        words, ranks = [bytes([b]) for b in b"abc"], {bytes([b]): b for b in range(256)}
        while len(ranks) < 256 + 14:
            a, b = rng.choice(words), rng.choice(words)
            if len(a + b) < 7 and a + b not in ranks:
                words.append(a + b)
                ranks[a + b] = len(ranks)
        machine = transducer.Transducer(ranks)
        for _ in range(60):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25)))
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 1:
                rank, at = min((ranks.get(x + y, 1 << 30), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 30:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            want = [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]
            try:
                assert machine.encode(piece) == want
            except ValueError as e:
                assert "before its parts" in str(e)


def test_tokens_come_after_bounded_lookahead(ranks):
    machine = transducer.Transducer(ranks)
    longest = max(map(len, ranks))
    for text in (b"internationalisation" * 40, b"ab" * 500):
        machine.encode(text)
    assert all(sum(len(machine.merges.bytes_of[t]) for t in past[1:]) <= 2 * longest for guesses in machine.guesses for past in guesses[1:])


def test_utf8_machine_knows_what_is_utf8():
    rng, machine = random.Random(5), transducer.utf8_machine()
    pool = [0x00, 0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xEC, 0xED, 0xEE, 0xEF, 0xF0, 0xF1, 0xF3, 0xF4, 0xF5, 0xFF]
    for _ in range(40000):
        body = bytes(rng.choice(pool) for _ in range(rng.randrange(1, 6)))
        state = transducer.BETWEEN
        for b in body:
            state = machine[state, b]
        try:
            body.decode()
            assert state == transducer.BETWEEN
        except UnicodeDecodeError as e:
            assert state == transducer.BAD if e.reason != "unexpected end of data" else transducer.HELD[state] == len(body) - e.start > 0


def test_streams_hand_over_whole_characters(ranks, both):
    text = "a日𝄞é" * 50
    ids = np.array([ranks[bytes([b])] for b in text.encode()], "<u4")
    parts = list(both[1].stream(ids[i : i + 1] for i in range(len(ids))))
    assert b"".join(parts).decode() == text and all(p.decode() in "a日𝄞é" for p in parts)
    for bad in (ids[:-1], ids[1:][4:], np.array([ranks[b"\xff"]], "<u4")):
        with pytest.raises(ValueError):
            list(both[1].stream([bad]))


def test_on_spark(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, None, "n"), (5, None, "n"), (5, "again", "y"), (5, "again", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(4)
    found = transducer.digest(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for key, text, _ in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want.append((key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    whole = transducer.decoded(transducer.encoded(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert sorted(map(tuple, whole.select("doc_id", "text", "n_tokens").collect()), key=str) == sorted(((a, b or "", c) for a, b, c in rows), key=str)
    assert transducer.digest(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    assert transducer.decoded(spark.createDataFrame([(1, None)], "k int, ids binary"), RANKS).first().text is None
    with pytest.raises(ValueError):
        transducer.encoded(docs, RANKS, public_tokenizers.PATTERN, ids="n_tokens")
