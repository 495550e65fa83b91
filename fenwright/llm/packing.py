"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits
of n (1024 repeated for the part above it). Pieces of equal length form
buckets; a batch drawn from one bucket has no padding, and no sequence holds
tokens of two documents. Each piece is a sequence of its own.

Defined cases: null text counts as empty; an empty document has the end token
alone and gives one piece of length 1; repeated rows are packed once each;
columns besides doc_id and text are ignored. No shuffle takes place.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, bucket int, ids array<int>"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32()),
        ("ids", pa.list_(pa.int32())),
    ]
)


class Encoder:
    """Token ids of whole texts by a byte-level BPE file of the tokenizers library.

    The file's vocabulary and pattern also run in tiktoken, five times as fast
    with equal ids (a test compares them); a text that tiktoken refuses goes to
    the tokenizers library itself. Strings of special tokens are ordinary text.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        special = {t.content for t in self.exact.get_added_tokens_decoder().values()}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = {bytes(letters[c] for c in t): i for t, i in self.exact.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding("bpe", pat_str=self.PATTERN, mergeable_ranks=vocabulary, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for x in texts:
            try:
                ids = self.fast.encode_ordinary(x)
            except BaseException as e:  # its regex engine panics on some texts, outside Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
                ids = self.exact.encode(x, add_special_tokens=False).ids
            out.append(array("I", ids).tobytes())
        return out


def lengths(n: int, most: int) -> list[int]:
    """Piece lengths of a document of n tokens, longest first."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if (n % most) >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, sequence_length: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: its place in the document, its own sequence, its length bucket (log2) and its ids.

    sequence_id is the task's partition number and a counter within it, so a task run again gives the same ids.
    """
    if sequence_length & (sequence_length - 1) or sequence_length < 1:
        raise ValueError("sequence_length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = Encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        seq = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or "" for x in batch.column("text").to_pylist()]
                cols: list[list] = [[] for _ in range(6)]
                ids = []
                for doc_id, code in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                    code += end
                    n, start = len(code) // 4, 0
                    for length in lengths(n, sequence_length):
                        piece = code[4 * start : 4 * (start + length)]
                        for c, v in zip(cols, (doc_id, start, length, zlib.crc32(piece), n, seq), strict=True):
                            c.append(v)
                        if with_ids:
                            ids.append(piece)
                        seq += 1
                        start += length
                if not cols[0]:
                    continue
                size = np.array(cols[2], np.int64)
                bucket = np.log2(size).astype(np.int32)
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                else:
                    listed = pa.nulls(len(size), pa.list_(pa.int32()))
                arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array(np.zeros(len(size), np.int64)), pa.array(bucket), listed]
                yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per piece length, so that a reader takes batches of equal length."""
    pieces.repartition("bucket", F.pmod(F.xxhash64("sequence_id"), F.lit(64))).write.mode("overwrite").partitionBy("bucket").parquet(path)
