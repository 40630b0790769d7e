"""Byte-level BPE by the tiktoken library, with ranks from a local file.

Long texts are cut before white space that follows a character that isn't: no
match of the splitting pattern spans such a place, and its look-ahead only looks
at what follows, so the ids of the pieces are the ids of the text. A long text
without such a place stays whole. Decoding joins the bytes of the ids, so texts
come back even where an id ends inside a character.

Ranks are read by each Python worker from a path that is a parameter.

Defined cases: a null or empty text has no ids; special-token strings are
ordinary text; repeated rows give equal rows; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, small_batches

LONG = 1 << 16  # characters of a piece, about
SAFE = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """text in order, in parts of about size characters, cut at safe places only."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str, size: int = LONG) -> np.ndarray:
    if len(text) <= size:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), dtype="<u4") for p in pieces(text, size)])


def ids_column(text: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The ids of each text as little-endian unsigned 32-bit integers, in one binary value."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        enc = encoding(path, pattern)
        return pd.Series([encode(enc, t or "").tobytes() for t in texts])

    return run(text)


def decoded_column(ids: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes that the ids stand for."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        enc = encoding(path, pattern)
        return pd.Series([enc.decode_bytes(np.frombuffer(v, "<u4").tolist()) for v in values])

    return run(ids)


def tokenized(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of each row; only digests leave the worker."""
    small_batches(df.sparkSession)

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        enc = encoding(path, pattern)
        rows = []
        for t in texts:
            ids = encode(enc, t or "")
            raw = enc.decode_bytes(ids.tolist())
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col), run(F.col(text_col).cast("string")).alias("t")).select(id_col, "t.*")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
