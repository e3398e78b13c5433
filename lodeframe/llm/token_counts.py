"""Token counts without token ids.

Each text is split into pre-tokens. A task counts the pieces of each distinct pre-token once, by the library, and keeps
the counts; the pre-token frequencies of its documents join to them in memory, and the sums are the documents' counts.
Joining by a shuffle instead would write a row for each pair of document and distinct pre-token, about twice the bytes
of the documents themselves; here nothing is shuffled at all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from math import sumprod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import TEXT_ROWS, fresh, quoted, tokenizer_path, written
from .pretokens import BYTE_PARTS, in_byte_letters, is_safe, special_strings

#: Distinct pre-tokens that a Python worker keeps the counts of at most; past it the counts start anew.
KEPT = 300_000


class PieceCounter:
    """Counts tokens of texts with one tokenizer file of byte-level BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = special_strings(self.tokenizer)
        self.pieces: dict[str, int] = {}

    def learn(self, parts: Iterable[str]) -> None:
        new = [p for p in parts if p not in self.pieces]
        if len(self.pieces) + len(new) > KEPT:
            self.pieces.clear()
            new = list(parts)
        for p in new:
            self.pieces[p] = len(self.model.tokenize(in_byte_letters(p)))

    def counts(self, texts: list[str | None]) -> list[int]:
        out = []
        for text in texts:
            if not text:
                out.append(0)
            elif not is_safe(text, self.special):
                out.append(len(self.tokenizer.encode(text, add_special_tokens=False)))
            else:
                often = Counter(BYTE_PARTS.findall(text))  # the document's pre-token frequencies
                try:
                    pieces = list(map(self.pieces.__getitem__, often))
                except KeyError:
                    self.learn(often.keys())
                    pieces = list(map(self.pieces.__getitem__, often))
                out.append(sumprod(pieces, often.values()))
        return out


_counters: dict[str, PieceCounter] = {}  # by path; a worker keeps them from task to task


def token_counts(
    docs: DataFrame,
    text: str = "text",
    output: str = "n_tokens",
    tokenizer: str = "byte_bpe_50k.json",
) -> DataFrame:
    """``docs`` with a long column ``output``, which replaces one of that name.

    The count is that of the library's encode() without special tokens added; strings of special tokens in a text count
    as the library takes them. Null and empty texts have 0 tokens. Texts of any length count whole, repeated rows each
    for themselves; an empty table gives an empty one. Texts with a character outside ``SAFE_POINTS`` (most of what isn't
    Latin script) go through the library whole, and so do those with a special token's string.
    """

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        path = tokenizer_path(tokenizer)
        counter = _counters.get(path) or _counters.setdefault(path, PieceCounter(path))
        for batch in batches:
            yield pd.Series(counter.counts(batch.tolist()), dtype="int64")

    held = fresh(docs, "__tokens")
    counted = docs.withColumn(held, count(F.coalesce(quoted(text), F.lit(""))))
    kept = [quoted(c) for c in docs.columns if c.lower() != output.lower()]
    return counted.select(*kept, quoted(held).alias(output))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = token_counts(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
    )
    return written(counted, "token-counts", TEXT_ROWS)
