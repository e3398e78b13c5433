"""Packing documents into training sequences by best-fit decreasing.

A task tokenizes texts and cuts overlong ones into full windows; what is left of each document is shorter than a
window. Those remainders are dealt by a hash into shards of about ``SHARD`` documents, whatever the size of the input,
and each shard is packed by itself: remainders in falling order go to the open sequence with the least room that still
takes them, found by a segment tree over the remaining room. The documents of sequences that stay open at a shard's end
with much room meet those of other shards in further rounds. What the last round leaves open is cut into powers of two,
which fill sequences to the end; if one sequence still has much room, each of its pieces becomes a sequence of its own,
of a power of two tokens, which takes no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, quoted, tokenizer_path, written
from .pretokens import WORD_PARTS, in_byte_letters, is_safe, special_strings

#: Documents in a shard, about.
SHARD = 4_096
#: A sequence with more room than this part of the window is dissolved.
OPEN = 1 / 32
#: Distinct words, and distinct parts of them, that a Python worker keeps the ids of at most; past it they start anew.
KEPT, KEPT_PARTS = 250_000, 200_000


class RoomTree:
    """A segment tree over the rooms 0..limit: how many open sequences have just so much room left."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(limit + 1)]

    def _add(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += change
            node >>= 1

    def push(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the open sequence with the least room of at least ``need``, which is closed."""
        count, node = self.count, self.leaves + need
        while not count[node]:
            while node & 1:  # a right child: go up until there is something to the right
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) for each length, all between 1 and ``window``; sequences are numbered from 0."""
    tree, sequences = RoomTree(window), 0
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.pop_tightest(lengths[i])
        if found is None:
            found = window, sequences
            sequences += 1
        room, sequence = found
        placed[i] = sequence, window - room
        if room > lengths[i]:
            tree.push(room - lengths[i], sequence)
    return placed


def powers_of_two(length: int) -> list[int]:
    """The powers of two that add up to ``length``, the largest first."""
    return [1 << b for b in reversed(range(length.bit_length())) if length >> b & 1]


class IdEncoder:
    """Ids of texts as little-endian 32-bit numbers, by one tokenizer file of BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = special_strings(self.tokenizer)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def learn(self, words: set[str]) -> None:
        """Words are runs without white space; each is a sequence of parts, which many words share."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > KEPT:
            self.words.clear()
            new = list(words)
        if len(self.parts) > KEPT_PARTS:
            self.parts.clear()
        for w in new:
            ids = b""
            for part in WORD_PARTS.findall(w):
                known = self.parts.get(part)
                if known is None:
                    known = self.packed([t.id for t in self.model.tokenize(in_byte_letters(part))])
                    self.parts[part] = known
                ids += known
            self.words[w] = ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not is_safe(text, self.special):
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = text.lower().split()  # no part of such a text spans white space
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            return b"".join(map(self.words.__getitem__, words))


_encoders: dict[str, IdEncoder] = {}  # by path; a worker keeps them from task to task


def tokenized(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    window: int = 2048,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    keep_ids: bool = False,
) -> DataFrame:
    """A stored row for each document: uid, doc_id, doc_tokens, crcs (of each full window, then of the rest), parts (of
    the rest, cut into powers of two) and, if asked for, ids. CRC32s are of the ids as little-endian 32-bit numbers."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), quoted(id_column).alias("doc_id"), quoted(text).alias("text"))
    schema = f"uid long, doc_id {kind}, doc_tokens long, crcs array<long>, parts array<long>, ids binary"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = tokenizer_path(tokenizer)
        encoder = _encoders.get(path) or _encoders.setdefault(path, IdEncoder(path))
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            tokens, crcs, parts, kept = [], [], [], []
            for value in batch["text"]:
                ids = encoder.ids(value) + end
                n = len(ids) // 4
                full = n // window * window
                tokens.append(n)
                crcs.append([zlib.crc32(ids[4 * a : 4 * (a + window)]) for a in range(0, n, window)])
                at, own = full, []
                for size in powers_of_two(n - full):
                    own.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at += size
                parts.append(own)
                kept.append(ids if keep_ids else None)
            yield pd.DataFrame(
                {"uid": batch["uid"], "doc_id": batch["doc_id"], "doc_tokens": tokens, "crcs": crcs, "parts": parts, "ids": kept}
            )

    return written(rows.mapInPandas(encode, schema), "pack-tokens", TEXT_ROWS)


PIECE = "uid long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _shard_packer(window: int, turn: int, cut: bool, last: bool):
    """For applyInPandas over a shard: uid, doc_id, doc_tokens, start and length of what is to be placed (in round 0 null:
    whole documents, whose full windows are given out), crcs and parts. The pieces; and for a sequence that has much room
    what it holds, with parts and without a sequence_id: that is left for another round. With ``cut`` the documents in such
    sequences are cut into powers of two, which fill sequences to the end, before anything is left. The last round leaves
    nothing: what one open sequence holds is a power of two for each binary digit of its length."""

    def loose(filled: int) -> bool:
        return window - filled > window * OPEN and filled & (filled - 1) != 0

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["uid", "start"], ignore_index=True)
        total, crcs, parts = (rows[c].tolist() for c in ("doc_tokens", "crcs", "parts"))
        out: list[tuple] = []  # row, start, length, crc, sequence, offset
        made = 0

        def place(items: list[tuple]) -> list[list[tuple]]:
            """Places items (row, start, length, crc) in sequences; what loose ones hold is returned."""
            nonlocal made
            sequences: dict[int, list[tuple]] = {}
            for x, (sequence, offset) in zip(items, best_fit_decreasing([x[2] for x in items], window)):
                sequences.setdefault(sequence, []).append((*x, offset))
            again = []
            for held in sequences.values():
                if loose(sum(x[2] for x in held)):
                    again.append([x[:4] for x in held])
                    continue
                out.extend((*x[:4], made, x[4]) for x in held)
                made += 1
            return again

        if turn:
            items = list(zip(range(len(rows)), rows["start"].tolist(), rows["length"].tolist(), [c[-1] for c in crcs]))
        else:
            items = [(i, n - n % window, n % window, crcs[i][-1]) for i, n in enumerate(total) if n % window]
            for i, n in enumerate(total):
                for k in range(n // window):
                    out.append((i, k * window, window, crcs[i][k], made, 0))
                    made += 1
        left = place(items)
        if cut:
            small = []
            for i, start, length, _ in [x for held in left for x in held]:
                for size, crc in zip(powers_of_two(length), parts[i]):
                    small.append((i, start, size, crc))
                    start += size
            left = place(small)
        if last:
            for held in left:  # all are powers of two, which fill these rooms without a gap
                rooms = [[made + k, 0, n] for k, n in enumerate(powers_of_two(sum(x[2] for x in held)))]
                made += len(rooms)
                for x in sorted(held, key=lambda x: -x[2]):
                    room = next(r for r in rooms if r[2] - r[1] >= x[2])
                    out.append((*x, room[0], room[1]))
                    room[1] += x[2]
            left = []
        rest = [x for held in left for x in held]
        base = turn << 58 | int(key[0]) << 30
        both = [x[:4] for x in out] + rest
        none = [None] * len(rest)
        return pd.DataFrame(
            {
                "uid": rows["uid"].take([x[0] for x in both]).array,
                "doc_id": rows["doc_id"].take([x[0] for x in both]).array,
                **{n: pd.array([x[k] for x in both], dtype="int64") for k, n in ((1, "start"), (2, "length"), (3, "ids_crc32"))},
                "doc_tokens": [total[x[0]] for x in both],
                "sequence_id": pd.array([base | x[4] for x in out] + none, dtype="Int64"),
                "offset": pd.array([x[5] for x in out] + none, dtype="Int64"),
                "crcs": [None] * len(out) + [[x[3]] for x in rest],
                "parts": [None] * len(out) + [[x[3]] if cut else parts[x[0]] for x in rest],
            }
        )

    return pack


def pieces(tokens: DataFrame, window: int = 2048) -> DataFrame:
    """Where each piece of the documents of ``tokens`` goes: uid, doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset. Each sequence lies in one shard of one round, which are in the upper bits of its id.

    What a round leaves, a few documents of each shard, is dealt into shards again, until it is one shard. Documents are
    cut to fill sequences in the last round, or earlier where a round has left more than half of the tokens; one that leaves
    more than half of what is cut already is followed by the last, so that rounds are log2(tokens) at most."""
    names = [c.split()[0] for c in PIECE.split(", ")]
    schema = PIECE.format(kind=tokens.schema["doc_id"].dataType.simpleString()) + ", crcs array<long>, parts array<long>"
    none = F.lit(None).cast("long")
    size = F.coalesce("length", F.col("doc_tokens") % window)
    left, turn, done, cut, last, before = tokens.withColumns({"start": none, "length": none}), 0, None, False, False, 0
    while True:
        n, held = left.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        if turn:  # a round in which less than half was placed calls for cutting, then for an end
            cut, last = cut or held > before // 2, cut and held > before // 2
        # a shard of what is left holds some windows at least, and so at most the pieces of 8 windows and a SHARD
        shards = max(1, min(-(-n // SHARD), held // (8 * window) if turn else n))
        last = last or shards == 1
        shard = F.pmod(F.xxhash64("uid", "start", F.lit(turn)), F.lit(shards)).alias("shard")
        slim = left.select(shard, "uid", "doc_id", "doc_tokens", "start", "length", "crcs", "parts")
        found = slim.groupBy("shard").applyInPandas(_shard_packer(window, turn, cut or last, last), schema)
        if last:
            found = found.select(*names)
            return found if done is None else done.unionByName(found)
        found = written(found, "pack-pieces")
        placed = found.where("sequence_id IS NOT NULL").select(*names)
        done = placed if done is None else done.unionByName(placed)
        left, before, turn = found.where("sequence_id IS NULL"), held, turn + 1


def packed_documents(docs: DataFrame, window: int = 2048, **options) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens, each id in exactly one piece.

    A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts are
    documents of their end id alone. Rows with equal ids are documents of their own; null ids stay null. A very long text
    is tokenized whole, in one task, and cut into full windows. Columns of ``docs`` beyond id and text are not read,
    whatever their names; an empty table gives an empty one.
    """
    return pieces(tokenized(docs, window=window, **options), window).drop("uid")


def packed_sequences(docs: DataFrame, window: int = 2048, **options) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array of int), and documents, an array of (doc_id, start, offset,
    length) in order. A sequence holds at most ``window`` pieces."""
    tokens = tokenized(docs, window=window, keep_ids=True, **options)
    own = pieces(tokens, window).join(tokens.select("uid", "ids"), "uid")
    cut = F.substring(F.col("ids"), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    joined = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", cut.alias("ids"))))
    sequences = own.groupBy("sequence_id").agg(joined.alias("p"))
    digits = F.hex(F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])))
    number = lambda i: F.conv(
        F.concat(*[F.substring(digits, i * 8 + 7 - 2 * k, F.lit(2)) for k in range(4)]), 16, 10
    ).cast("int")
    count = (F.length(digits) / 8).cast("int")
    return sequences.select(
        "sequence_id",
        F.transform(F.sequence(F.lit(0), count - 1), number).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"], x["start"], x["offset"], x["length"])).alias("documents"),
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
