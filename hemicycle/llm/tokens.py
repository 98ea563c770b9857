"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: File of byte-level ranks; any file of the same form will do.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that splits a text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoding: dict[int, object] = {}


def _encoder(ranks: bytes):
    """One encoder per Python worker and vocabulary."""
    key = hash(ranks)
    if key not in _encoding:
        import tiktoken

        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        _encoding[key] = tiktoken.Encoding("hemicycle", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _encoding[key]


def token_counts(documents: DataFrame, text: str, ranks: str = RANKS) -> DataFrame:
    """The other columns of ``documents`` with n_tokens, which replaces a column of that name; null and empty texts have 0 tokens.

    The vocabulary is read by the driver and sent to the workers, about a megabyte whatever the data.
    """
    kept = [c for c in documents.columns if c not in (text, "n_tokens")]
    vocabulary = documents.sparkSession.sparkContext.broadcast(Path(ranks).read_bytes())
    schema = StructType([*(documents.schema[c] for c in kept), StructField("n_tokens", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary.value).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in (x.as_py() for x in batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, pa.int64())], names=[*kept, "n_tokens"])

    return documents.select(*kept, F.col(text)).mapInArrow(count, schema)
