"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from inkwell.functions.arrow import arrow_schema

#: Where the vocabulary lies; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding(data: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    return Path(path).read_bytes()


class CountTokens:
    """Adds the number of tokens of the text in column 1; the columns behind it are passed on."""

    def __init__(self, data: bytes, ddl: str) -> None:
        self.data, self.schema = data, arrow_schema(ddl)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(self.data)
        for b in batches:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(b.column(j) for j in range(2, b.num_columns))], schema=self.schema)


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: dict[str, str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens, *keep): keep names columns and their types; a null text has 0 tokens."""
    keep = keep or {}
    ddl = ", ".join(["id long", "tokens long", *(f"`{c}` {t}" for c, t in keep.items())])
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).cast(t) for c, t in keep.items()))
    return base.mapInArrow(CountTokens(read_vocabulary(vocabulary), ddl), ddl)
