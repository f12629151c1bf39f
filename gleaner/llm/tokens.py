"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is a file of byte ranks whose folder is a parameter; it stays where it is. Each Python
process loads it once. Special tokens' names in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.session import ship

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts a text before byte pairs are merged, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict = {}


def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    key = (folder, vocabulary)
    if key not in _LOADED:
        import tiktoken

        with open(Path(folder, vocabulary), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _LOADED[key] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def _sizes(text: str, output: str, folder: str, vocabulary: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            sizes = pa.array([None if x is None else len(enc.encode_ordinary(x)) for x in b.column(text).to_pylist()], pa.int32())
            names = [n for n in b.schema.names if keep_text or n != text]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), sizes], [*names, output])

    return run


def with_tokens(df: DataFrame, text: str = "text", output: str = "n_tokens", folder: str = FOLDER, vocabulary: str = VOCABULARY, keep_text: bool = True) -> DataFrame:
    """``df`` with the size of the whole ``text`` in tokens; null for a null text, 0 for an empty one.

    With ``keep_text`` false the text itself is dropped, so that it isn't sent back from Python. A
    column that has the output's name is replaced.
    """
    ship(df.sparkSession)
    df = df.drop(output)
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    return df.mapInArrow(_sizes(text, output, folder, vocabulary, keep_text), T.StructType([*fields, T.StructField(output, T.IntegerType())]))
