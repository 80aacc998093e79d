"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The driver reads the rank file (refused above MAX_RANK_BYTES) and broadcasts it; each Python worker builds the encoder
once. Long texts are cut at places where the splitting pattern always has a limit, so that the ids of the parts are the
ids of the whole. Decoding joins the raw bytes of the ids and checks nothing, so that any id list decodes.

Cases: a null text is encoded as the empty text (no ids, no bytes); empty tables give empty results; other columns pass
through, and columns named like a result column are replaced; repeated rows give equal rows.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlspike.llm.common import map_arrow, without

MAX_RANK_BYTES = 64 << 20
#: Texts longer than this many characters are cut at safe boundaries.
PIECE = 1 << 16
#: Rows leave a worker in batches of about this many ids.
BATCH_IDS = 1 << 18

#: Where every pattern of the GPT-2 kind ends a match, whatever follows: before white space that follows something
#: else, or between an ASCII letter and a digit. The second form serves long runs without white space.
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?)\]}>])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[^\W\d_])(?=[ \n])")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of about size characters, cut at safe boundaries alone; a stretch without one stays whole."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


@functools.lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode_text(encoding, text: str, size: int = PIECE) -> np.ndarray:
    if len(text) <= size:
        return np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)
    return np.concatenate([np.asarray(encoding.encode_to_numpy(x, disallowed_special=()), np.uint32) for x in pieces(text, size)])


def _ranks(df: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path}: a rank file of over {MAX_RANK_BYTES} bytes is not broadcast")
    return df.sparkSession.sparkContext.broadcast(data)


def _encoded(batch: pa.RecordBatch, text: str, encoding, piece: int) -> Iterator[tuple[pa.RecordBatch, pa.ListArray, list[np.ndarray]]]:
    """Runs of rows with about BATCH_IDS ids: the rows, their ids as lists, and the ids of each row."""
    texts, first, n, parts = batch.column(text), 0, 0, []
    for i in range(batch.num_rows):
        parts.append(encode_text(encoding, texts[i].as_py() or "", piece))
        n += len(parts[-1])
        if n >= BATCH_IDS or i == batch.num_rows - 1:
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32)))
            yield batch.slice(first, len(parts)), lists, parts
            first, n, parts = i + 1, 0, []


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", keep_text: bool = True, piece: int = PIECE) -> DataFrame:
    """df with the array<int> column ids of each whole text."""
    df = without(df, ids)
    kept = [c for c in df.columns if keep_text or c != text]
    ranks = _ranks(df, rank_file)
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            for rows, lists, _ in _encoded(batch, text, encoding, piece):
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], lists], names=[*kept, ids])

    return map_arrow(df, run, schema)


def round_trip(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep_text: bool = False, piece: int = PIECE) -> DataFrame:
    """df with ids of each whole text and decoded, the raw bytes of those ids: encode and decode in one pass of one worker."""
    df = without(df, ids, decoded)
    kept = [c for c in df.columns if keep_text or c != text]
    ranks = _ranks(df, rank_file)
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())])

    def run(batches):
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            for rows, lists, parts in _encoded(batch, text, encoding, piece):
                data = pa.array([encoding.decode_bytes(p.tolist()) for p in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], lists, data], names=schema.names)

    return map_arrow(df, run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the raw bytes of each id list; a null list has none."""
    df = without(df, decoded)
    ranks = _ranks(df, rank_file)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches):
        encoding = _encoding(ranks.value, pattern)
        for batch in batches:
            lists = batch.column(ids)
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256)
                data = [encoding.decode_bytes(lists[i].values.to_pylist()) if lists[i].is_valid else b"" for i in range(first, first + rows.num_rows)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(data, pa.binary())], names=[*rows.schema.names, decoded])

    return map_arrow(df, run, schema)
