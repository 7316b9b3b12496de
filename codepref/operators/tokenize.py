"""Token ids of a public byte-pair vocabulary.

The vocabulary is a rank file: a line per token, its bytes in base64 and its rank. Its
path is a parameter; Spark reads it, so it may lie in any store, and the checked table
(one row per token, never trained here) is broadcast. Texts are encoded whole in Arrow
batches, by one encoder per Python worker.
"""

from __future__ import annotations

import base64
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A vocabulary has so many tokens at most.
MAX_TOKENS = 1_000_000

# Fixed value: how the vocabularies' texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict = {}


@dataclass(frozen=True)
class Vocabulary:
    """A broadcast table of token bytes and ranks, and the pattern of its words."""

    name: str
    table: Broadcast
    pattern: str = PATTERN

    def encoder(self):
        """The encoder of this process, made on first use."""
        import tiktoken

        key = (self.name, self.pattern)
        if key not in _ENCODERS:
            _ENCODERS[key] = tiktoken.Encoding(self.name, pat_str=self.pattern, mergeable_ranks=self.table.value, special_tokens={})
        return _ENCODERS[key]


def read_vocabulary(spark: SparkSession, path: str, pattern: str = PATTERN) -> Vocabulary:
    """The vocabulary of a rank file. Bytes that are no single token, a repeated rank or a
    table over ``MAX_TOKENS`` are errors."""
    lines = spark.read.text(path).where("value <> ''")
    n = lines.count()
    if n > MAX_TOKENS:
        raise ValueError(f"{path} has {n} tokens, over {MAX_TOKENS}")
    ranks = {base64.b64decode(t): int(r) for t, r in (row["value"].split() for row in lines.collect())}
    if len(set(ranks.values())) != n or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} is not a byte-level rank file")
    return Vocabulary(path, spark.sparkContext.broadcast(ranks), pattern)


def token_ids(text: Column, vocabulary: Vocabulary) -> Column:
    """The ids of a text's tokens (null: null; empty: none). Texts and ids stay in Arrow's
    arrays; of Python's own numbers a worker holds one text's at a time."""
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        e = vocabulary.encoder()
        ids, sizes = array("i"), np.zeros(len(texts) + 1, np.int32)
        for i, t in enumerate(texts, 1):
            if t.is_valid:
                before = len(ids)
                ids.extend(e.encode_ordinary(t.as_py()))
                sizes[i] = len(ids) - before
        return pa.ListArray.from_arrays(pa.array(sizes.cumsum(dtype=np.int32)), pa.array(np.frombuffer(ids, np.int32)), mask=texts.is_null())

    return encode(text)


def token_length(text: Column, vocabulary: Vocabulary) -> Column:
    """The number of a text's tokens (null: null); the ids stay in the worker."""
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        e = vocabulary.encoder()
        return texts.map(lambda t: None if t is None else len(e.encode_ordinary(t))).astype("Int32")

    return count(text)


def token_text(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        e = vocabulary.encoder()
        return rows.map(lambda r: None if r is None else e.decode([int(x) for x in r]))

    return decode(ids)
