"""Packing by power-of-two decomposition.

A document's ids, closed by an end id, are cut from the start into pieces of the longest sequence length and then of
the falling powers of two of what remains. Pieces of one length form a bucket and each piece is a sequence of its
own, so no sequence crosses documents and none is padded. A training step draws its batch from one bucket.

Null texts count as empty (the end id alone, one piece). Repeated rows are packed once each. Null ids are kept.
Other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

def byte_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids by token bytes of a byte-level BPE tokenizers file, and ids of its special tokens by their text."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    special = {x["content"]: x["id"] for x in made["added_tokens"]}
    # The printable stand-ins of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256.
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    return {bytes(back[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}, special


def byte_bpe(path: str) -> Callable[[str], list[int]]:
    """Encoder of a byte-level BPE tokenizers file: the file's own vocabulary and pattern run by tiktoken, which is
    several times as fast; its special tokens keep their ids. Ids equal the tokenizers library's (tested), which takes
    the texts whose white space is too long for tiktoken's pattern."""
    from public_tokenizers import PATTERN

    ranks, special = byte_vocabulary(path)
    encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    library = lru_cache(maxsize=1)(lambda: library_encoder(path))

    def encode(text: str) -> list[int]:
        try:
            return encoding.encode(text, allowed_special="all")
        except BaseException as failure:  # tiktoken gives up on very long white space, by an error or a panic
            if not isinstance(failure, ValueError) and type(failure).__name__ != "PanicException":
                raise
        return library()(text)

    return encode


def library_encoder(path: str) -> Callable[[str], list[int]]:
    """The tokenizers library itself, for any of its files."""
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def lengths(n: int, longest: int) -> list[int]:
    """Piece lengths of n ids: full sequences, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         longest: int = 2048, encoder: Callable[[str], Callable[[str], list[int]]] = byte_bpe,
         with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length (its bucket), ids_crc32, doc_tokens, ids. longest is a power of two."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            take, start, length, crc, total, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("t")):
                own = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                raw, at = own.tobytes(), 0
                for size in lengths(len(own), longest):
                    take.append(row)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at:4 * (at + size)]))
                    total.append(len(own))
                    if with_ids:
                        ids.append(own[at:at + size].view("<i4"))
                    at += size
            columns = [batch.column("id").take(pa.array(take, pa.int32()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))
    # A scan's rows have a fixed place in their partition, so the numbers are unique and come out again if a task reruns.
    pieces = rows.mapInArrow(run, schema).select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.withColumnRenamed("id", id_col)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces as files by bucket: one folder per length, read alone when a batch of that length is drawn."""
    pieces.write.partitionBy("length").parquet(path)
