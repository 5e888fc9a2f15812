"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from factloom.session import spread

#: Fixed value: the public pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_loaded: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file, kept for the life of a Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _counter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            counts = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), *batch.columns[2:]], ["id", "n_tokens", *batch.schema.names[2:]])

    return run


def token_counts(df: DataFrame, id: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, keep: str | None = None) -> DataFrame:
    """(id, n_tokens int[, keep]) of every row; a null or empty text has no tokens. Whole texts are encoded.

    ``vocabulary`` is a file on the driver, sent to the executors with the job, or one that they all have at this place.
    """
    if os.path.exists(vocabulary):
        df.sparkSession.sparkContext.addFile(vocabulary)
    cols = [df[id].alias("id"), df[text].alias("text")] + ([df[keep].alias("keep")] if keep else [])
    kind = lambda c: df.schema[c].dataType.simpleString()
    schema = f"id {kind(id)}, n_tokens int" + (f", keep {kind(keep)}" if keep else "")
    return spread(df.select(*cols), "id").mapInArrow(_counter(vocabulary), schema)
