"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how texts are divided before that vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken
    from pyspark import SparkFiles

    # A path that every executor has, or the name of a file that was sent to all of them with ``addFile``.
    path = vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary))
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, keep: dict[str, str], *, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of ``keep`` (name: type) and ``n_tokens``, the size of the whole text; null and empty texts have 0."""
    names = list(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if (t := x.as_py()) else 0 for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sizes, pa.int64())], names=[*names, "n_tokens"])

    rows = docs.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in keep.items()], F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(count, ", ".join(f"{n} {t}" for n, t in keep.items()) + ", n_tokens bigint")
