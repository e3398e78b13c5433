"""Token counts and packing against the library."""

import random
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from lodeframe.llm import packing
from lodeframe.llm.common import tokenizer_path
from lodeframe.llm.packing import best_fit_decreasing, packed_documents, packed_sequences, powers_of_two
from lodeframe.llm.pretokens import BYTE_PARTS, SAFE_POINTS
from lodeframe.llm.token_counts import PieceCounter, token_counts

TEXTS = [
    "Hello  world, it's 42!\n\n x", None, "", " ", "a b­ c", "naïve Straße ŉ", "日本語 text", "x <|endoftext|> y", "é İ ς ΑΣ",
    "12345 6 7", "don't DON'T 'S", "\x00\x1f\x85", "a" * 30_000, "word " * 9_000, "👩‍👩‍👧 ok", "…—“q”", "  　z", "<|startoftext|>a<|endoftext|>",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 5, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", 5, 1), (3, " ", 5, 1), (3, " ", 5, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, N_tokens int, length long")


def test_every_safe_character_splits_as_in_the_library():
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).pre_tokenizer
    for c in map(chr, SAFE_POINTS):
        for s in (f"a{c}b", f"1{c}2", f"!{c}!", f" {c} x", f"x  {c}{c}", f"\n{c}\t y", c):
            assert BYTE_PARTS.findall(s) == [s[a:b] for _, (a, b) in library.pre_tokenize_str(s)]


def test_token_counts(spark, docs):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out = token_counts(docs)
    assert out.columns == ["doc_id", "text", "length", "n_tokens"]
    for r in out.collect():
        assert r["n_tokens"] == (len(library.encode(r["text"], add_special_tokens=False)) if r["text"] else 0), r["text"]
    assert token_counts(docs.limit(0)).collect() == []


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr("lodeframe.llm.token_counts.KEPT", 3)
    counter = PieceCounter(tokenizer_path("byte_bpe_50k.json"))
    assert counter.counts(["one two three four five"] * 2) == [5, 5]


def test_best_fit_decreasing_is_best_fit():
    rng = random.Random(5)
    for window in (1, 7, 64, 2048):
        lengths = [rng.randint(1, window) for _ in range(200)]
        room: list[int] = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                room[room.index(min(fits))] -= lengths[i]
            else:
                room.append(window - lengths[i])
        placed = best_fit_decreasing(lengths, window)
        fill = [0] * (1 + max(s for s, _ in placed))
        for (s, _), n in zip(placed, lengths):
            fill[s] += n
        assert sorted(window - f for f in fill) == sorted(room) and max(fill) <= window


def test_powers_of_two():
    assert powers_of_two(0) == [] and powers_of_two(13) == [8, 4, 1] and sum(powers_of_two(2047)) == 2047


@pytest.mark.parametrize("window", [16, 2048])
def test_packing(spark, docs, window):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = packed_documents(docs, window).collect()
    encoded = {}
    for r in docs.collect():
        ids = (library.encode(r["text"], add_special_tokens=False).ids if r["text"] else []) + [1]
        encoded.setdefault(r["doc_id"], []).append(b"".join(i.to_bytes(4, "little") for i in ids))
    assert {r["doc_id"] for r in rows} == set(encoded)
    for doc_id, copies in encoded.items():
        own = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == sum(len(c) // 4 for c in copies)
        if len(set(copies)) == 1:
            for r in own:
                piece = copies[0][4 * r["start"] : 4 * (r["start"] + r["length"])]
                assert zlib.crc32(piece) == r["ids_crc32"] and r["doc_tokens"] == len(copies[0]) // 4
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert packed_documents(docs.limit(0)).collect() == []


def test_packed_sequences_hold_the_ids(spark, docs):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = {i: t for i, t in enumerate(TEXTS)} | {None: "null id"}
    seen = 0
    for r in packed_sequences(docs, 64).collect():
        for d in r["documents"]:
            text = texts[d["doc_id"]]
            ids = (library.encode(text, add_special_tokens=False).ids if text else []) + [1]
            assert r["ids"][d["offset"] : d["offset"] + d["length"]] == ids[d["start"] : d["start"] + d["length"]]
            seen += d["length"]
        assert len(r["ids"]) <= 64
    assert seen > 9_000


def in_windows(rows, window):
    """The tokens in each sequence, after a check that pieces follow one another from 0 and make their documents up."""
    sequences, own = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        own[r["uid"]].append((r["start"], r["length"], r["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    for parts in own.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == parts[0][2]
    return {s: sum(n for _, n in parts) for s, parts in sequences.items()}


@pytest.mark.parametrize(
    ("lengths", "shard", "shards"),
    [(lambda r: r.randint(1, 700), 64, 9), (lambda r: r.randint(130, 140), 64, 9), (lambda r: 137, 16, 300), (lambda r: 256, 64, 0), (lambda r: 1, 64, 9)],
)
def test_open_sequences_of_shards_are_merged(spark, monkeypatch, lengths, shard, shards):
    monkeypatch.setattr(packing, "SHARD", shard)
    rng, window = random.Random(3), 256
    rows = []
    for i in range(500):
        n = lengths(rng)
        rows.append((i, i, n, [i] * -(-n // window), [i] * bin(n % window).count("1")))
    tokens = spark.createDataFrame(rows, "uid long, doc_id long, doc_tokens long, crcs array<long>, parts array<long>")
    found = packing.pieces(tokens, window).collect()
    filled = in_windows(found, window)
    assert len({r["uid"] for r in found}) == 500 and {r["ids_crc32"] for r in found if r["uid"] == 7} == {7}
    total = sum(r[2] for r in rows)
    padding = sum(window - n for n in filled.values() if n & (n - 1))
    assert padding <= total / 32 and sum(n < window // 2 for n in filled.values()) <= shards
