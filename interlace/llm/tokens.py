"""Tokens of a public byte-level BPE tokenizer; its file is a parameter and is read where it lies."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str = TOKENIZER):
    """The tokenizer of a .tiktoken file, loaded once per process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, name: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """`df` without its text column, with the number of tokens of the text (null for a null text) as `name`."""
    rest = [c for c in df.columns if c != text]
    schema = StructType([*[df.schema[c] for c in rest]]).add(name, LongType())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer).encode_to_numpy
        for batch in batches:
            n = [None if t is None else len(encode(t, disallowed_special=())) for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(n, pa.int64())], [*rest, name])

    return df.select(*rest, text).mapInArrow(counted, schema)
