"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.arrow_sql import spread

#: A ranks file of /opt/tokenizers; a path of one's own may be given instead.
RANKS = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    where = path if "/" in path else public_tokenizers.path(path)
    with open(where, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, keep: str, path: str = RANKS) -> DataFrame:
    """``df``'s columns ``keep`` (a schema string) and ``tokens``, the number of tokens of ``text``; a null text has 0."""
    names = [part.split()[0] for part in keep.split(",")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(text)) if text else 0 for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(sizes, pa.int64())], names=[*names, "tokens"])

    return spread(df.select(*[F.col(n) for n in names], "text")).mapInArrow(count, f"{keep}, tokens bigint")
