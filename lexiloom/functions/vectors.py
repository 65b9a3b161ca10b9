"""Hashed term-count vectors and cosine distance.

The default embedding is a deterministic stand-in for a model: it exercises the joins,
windows and tables around it, not semantic quality. Its components are term counts, so
dot products are exact integers whatever the order of summation, and cosine distance
does not depend on a vector's scale.

A text is first *encoded* as one character per token (its bucket). Encodings
concatenate: the encoding of two texts joined by a blank is the two encodings side by
side, so a text is tokenised once however many windows and chunks it ends up in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexiloom.dimensions import EMBEDDING_DIM

_FIRST_CODE = 33  # '!': the bucket characters are printable ASCII
_TEXTS_AT_ONCE = 4_096
_CODES_AT_ONCE = 1_000_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside one expression, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits (any script)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]++"), 0)


def bucket(token: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Stable bucket of a token, from the leading hex digits of its md5."""
    leading = F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("long")
    return (leading % dim).cast("int")


def encode(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """One character per token, naming its bucket."""
    if dim > 94:
        raise ValueError("the character encoding holds at most 94 buckets")
    found = tokens(F.coalesce(text, F.lit("")))
    if 256 % dim:
        return F.array_join(F.transform(found, lambda t: F.char(bucket(t, dim) + _FIRST_CODE)), "")
    # The bucket lies in the last byte of the leading digits then; bytes become characters once a text, not once a token.
    last = F.array_join(F.transform(found, lambda t: F.substring(F.md5(t), 6, 2)), "")
    named = "".join(chr(b % dim + _FIRST_CODE) for b in range(256))
    return F.translate(F.decode(F.unhex(last), "ISO-8859-1"), "".join(map(chr, range(256))), named)


def counts(codes: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Vector of an encoded text: how often each bucket's character occurs."""
    return F.array(*[
        (F.length(codes) - F.length(F.replace(codes, F.lit(chr(_FIRST_CODE + b)), F.lit("")))).cast("float")
        for b in range(dim)
    ])


def term_vector(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Term counts of a text as ``ARRAY<FLOAT>``, inside its row: no explode, no shuffle."""
    return let(encode(text, dim), lambda codes: counts(codes, dim))


def batch_counts(dim: int = EMBEDDING_DIM) -> Callable[[Column], Column]:
    """:func:`counts` on Arrow batches: one pass over a text's characters instead of one a bucket."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(codes: pa.Array) -> pa.Array:
        made, ends, low = [np.zeros(0, np.float32)], np.cumsum(pc.binary_length(codes).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while low < len(codes):
            room = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _CODES_AT_ONCE, "right"))
            high = min(max(room, low + 1), low + _TEXTS_AT_ONCE)
            made.append(_code_counts(codes.slice(low, high - low), dim).astype(np.float32).ravel())
            low = high
        starts = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(starts, pa.array(np.concatenate(made)))

    return run


def with_term_vector(df: DataFrame, text: str, name: str = "embedding", dim: int = EMBEDDING_DIM) -> DataFrame:
    """Add the term counts of a text column; a batch carries one character per token."""
    encoded = df.withColumn("__codes", encode(F.col(text), dim))
    return encoded.withColumn(name, batch_counts(dim)(F.col("__codes"))).drop("__codes")


def dot(a: Column, b: Column) -> Column:
    """Dot product, accumulated in DOUBLE in array order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def cosine_from_dots(ab: Column, aa: Column, bb: Column) -> Column:
    """Cosine distance out of three dot products; a zero vector is at distance 1."""
    return F.when((aa == 0) | (bb == 0), F.lit(1.0)).otherwise(1.0 - ab / F.sqrt(aa * bb))


def cosine_distance(a: Column, b: Column) -> Column:
    return cosine_from_dots(dot(a, b), dot(a, a), dot(b, b))


@dataclass(frozen=True)
class Embedding:
    """A named way from texts to vectors of one length.

    A chunk table keeps the name and the length of the embedding it was made with, so that
    vectors of different ones never meet.
    """

    name: str
    dim: int
    embed: Callable[[Column], Column]
    #: Adds the vectors of a whole text column to a table (rows, text, name), where that is faster than ``embed``.
    attach: Callable[[DataFrame, str, str], DataFrame] | None = None


#: Models of this worker by the name of their embedding.
_LOADED: dict[str, Callable[[list[str]], Any]] = {}


def model_embedding(name: str, dim: int, load: Callable[[], Callable[[list[str]], Any]], batch: int = 256) -> Embedding:
    """An embedding out of a model.

    ``load`` returns a function from a list of texts to one vector per text. It is called once
    in a Python worker, whatever the number of its tasks, and the model then gets ``batch``
    texts at a time. A null text is empty.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _LOADED:
            _LOADED[name] = load()
        model = _LOADED[name]
        for texts in batches:
            held = texts.fillna("").tolist()
            made = [[float(x) for x in v] for low in range(0, len(held), batch) for v in model(held[low : low + batch])]
            yield pd.Series(made, dtype=object)

    return Embedding(name, dim, run)


_SENTENCES_AT_ONCE = 50_000


def _code_counts(codes: pa.Array, dim: int) -> np.ndarray:
    """Term counts of encoded texts, one row per text."""
    texts = codes.to_pylist()
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(codes))
    characters = np.frombuffer("".join(texts).encode("ascii"), dtype=np.uint8).astype(np.int64)
    cells = np.repeat(np.arange(len(codes)), lengths) * dim + characters - _FIRST_CODE
    return np.bincount(cells, minlength=len(codes) * dim).reshape(len(codes), dim).astype(np.float64)


def neighbour_distances(buffer: int, dim: int = EMBEDDING_DIM) -> Callable[[Column], Column]:
    """Distances between consecutive neighbourhoods of a document's encoded sentences.

    Works on Arrow batches in blocks of sentences, so that neither a batch of many
    documents nor one very long document needs more than a block's vectors at a time.
    Counts are integers, so the distances equal those of any other order of summation.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def distances(documents: pa.Array) -> pa.Array:
        sizes = documents.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = documents.flatten()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        result = np.zeros(len(codes))
        for start in range(0, len(codes), _SENTENCES_AT_ONCE):
            end = min(start + _SENTENCES_AT_ONCE, len(codes))
            low, high = max(start - buffer, 0), min(end + buffer + 1, len(codes))
            single, own = _code_counts(codes.slice(low, high - low), dim), owner[low:high]
            group = single.copy()
            for by in range(1, min(buffer, len(own) - 1) + 1):
                together = (own[by:] == own[:-by])[:, None]
                group[by:] += single[:-by] * together
                group[:-by] += single[by:] * together
            square = np.einsum("ij,ij->i", group, group)
            norm = square[:-1] * square[1:]
            cosine = np.divide(
                np.einsum("ij,ij->i", group[:-1], group[1:]), np.sqrt(norm), out=np.zeros(len(norm)), where=norm > 0
            )
            block = np.append(1.0 - cosine, 0.0)
            result[start:end] = block[start - low:end - low]
        same = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)
        offsets = np.concatenate(([0], np.cumsum(np.maximum(sizes - 1, 0)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(result[same]))

    return distances


TERM_COUNTS = Embedding("term_counts", EMBEDDING_DIM, term_vector, with_term_vector)


def has_vector(vector: Column) -> Column:
    return F.coalesce(F.size(vector), F.lit(0)) > 0


def complete_vectors(rows: DataFrame, embedding: Embedding = TERM_COUNTS, vector: str = "embedding", text: str = "text") -> DataFrame:
    """Compute the vector from the text where it is missing or empty.

    The model sees the texts of those rows only; the others' reach it as null.
    """
    if vector not in rows.columns and embedding.attach is not None:
        return embedding.attach(rows, text, vector)
    if vector not in rows.columns:
        return rows.withColumn(vector, embedding.embed(F.col(text)))
    wanted = F.when(~has_vector(F.col(vector)), F.coalesce(F.col(text), F.lit("")))
    return rows.withColumn(vector, F.when(has_vector(F.col(vector)), F.col(vector)).otherwise(embedding.embed(wanted)))


def checked_dim(vector: Column, dim: int = EMBEDDING_DIM) -> Column:
    """The vector itself; the job fails on a vector of another length."""
    return F.when(
        F.size(vector) == dim, vector
    ).otherwise(F.raise_error(F.lit(f"embedding is not of length {dim}")).cast(T.ArrayType(T.FloatType())))
