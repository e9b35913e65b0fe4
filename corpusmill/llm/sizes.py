"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame

from corpusmill.llm.bpe import PATTERN, TOKENIZERS, VOCABULARY, read_ranks

#: Encodings of a worker, by the vocabulary's bytes.
_ready: dict[bytes, tiktoken.Encoding] = {}


def token_sizes(documents: DataFrame, keep: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id, the columns of the DDL string `keep`, and tokens; null and empty texts have 0.

    documents: doc_id, those columns, text. The vocabulary file (under 1 MB) is broadcast.
    """
    data = read_ranks(folder, name)
    shared, digest = documents.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).digest()

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if digest not in _ready:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line)}
            _ready[digest] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = _ready[digest].encode_ordinary
        for pdf in frames:
            pdf["tokens"] = [len(encode(t)) if t else 0 for t in pdf.pop("text")]
            yield pdf

    return documents.mapInPandas(on, f"doc_id long, {keep + ', ' if keep else ''}tokens long")
