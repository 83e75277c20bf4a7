"""Packing: cost-balanced packing of tokenised documents into fixed-length sequences.

Documents are tokenised and an end token is added; one of more than MAX tokens is cut into near-equal pieces of at most half a
sequence. The sequences of a group of documents have capacities that add up to exactly its tokens: as many of MAX as fit, and
powers of two for the rest, which need no padding. In descending length (equal ones in the order of the rows) each piece goes
to the sequence of lowest cost, LINEAR * n + QUADRATIC * n**2 over its pieces, among those with room, the first of equals;
where none has room for all of it, it is cut to fill the roomiest. No shuffle: groups are runs of one input partition, so a
lost task makes the same again.

The ids come from the rank file, which is several times faster than the tokenizers library and equal to it for every code
point; a run of white space that is too long for its regular expression goes to the library itself.

Cases: null text is empty and yields the end token alone; texts of any length are tokenised whole; repeated rows are packed
each; of the table's columns only the two named are read, whatever the others are called; no rows give no rows.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import keyed, slices

MAX, LINEAR, QUADRATIC = 1024, 1.0, 1.0 / 1024
GROUP_DOCS, GROUP_TOKENS = 4096, 4 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
_LOADED: dict[str, tiktoken.Encoding] = {}
_LIBRARY: dict[str, Tokenizer] = {}


def encoding(rank_path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary; its end marker in a text is that token, as in the tokenizers library."""
    if rank_path not in _LOADED:
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[rank_path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
    return _LOADED[rank_path]


def ids_of(text: str, rank_path: str, json_path: str) -> list[int]:
    try:
        return encoding(rank_path).encode(text, allowed_special="all")
    except ValueError:  # white space beyond the regular expression's stack
        if json_path not in _LIBRARY:
            _LIBRARY[json_path] = Tokenizer.from_file(json_path)
            _LIBRARY[json_path].no_truncation()
            _LIBRARY[json_path].no_padding()
        return _LIBRARY[json_path].encode(text, add_special_tokens=False).ids


def cuts_of(n: int, longest: int = MAX) -> list[int]:
    """Where a document's pieces start, and its end."""
    k = 1 if n <= longest else -(-n // max(longest // 2, 1))
    return [n * i // k for i in range(k + 1)]


def assign(lengths: list[int], longest: int = MAX) -> tuple[list[list[tuple[int, int, int, int]]], list[int]]:
    """For each length its pieces (start, length, sequence, offset), and the sequences' capacities, all filled."""
    total = sum(lengths)
    caps = [longest] * (total // longest) + [1 << b for b in range(longest.bit_length(), -1, -1) if total % longest >> b & 1]
    cap = np.array(caps, np.int64)
    room, cost = cap.copy(), np.zeros(len(caps))
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    items = [(i, a, b - a) for i, n in enumerate(lengths) for a, b in itertools.pairwise(cuts_of(n, longest))]
    for i, start, left in sorted(items, key=lambda x: (-x[2], x[0], x[1])):
        while left:
            k = int(np.where(room >= left, cost, np.inf).argmin())
            if room[k] < left:
                k = int(room.argmax())
            n = min(left, int(room[k]))
            pieces[i].append((start, n, k, int(cap[k] - room[k])))
            room[k] -= n
            cost[k] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n
    return pieces, caps


def pack(docs: DataFrame, rank_path: str | None = None, json_path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence. See the module for the rule and the cases.
    rank_path, json_path: the same vocabulary, for tiktoken and for tokenizers."""
    rank_path = rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial = TaskContext.get().partitionId() << 40, 0
        group: list[tuple] = []  # (doc_id, its ids)
        held = 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal serial, group, held
            pieces, caps = assign([len(ids) for _, ids in group])
            rows = [(doc, s, k, zlib.crc32(ids[s : s + k].tobytes()), len(ids), base + serial + q, off, caps[q]) for (doc, ids), own in zip(group, pieces) for s, k, q, off in own]
            serial += len(caps)
            group, held = [], 0
            for i in range(0, len(rows), 20000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 20000])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"])

        for b in slices(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                group.append((doc, np.array([*ids_of(text or "", rank_path, json_path), end_id], "<u4")))
                held += len(group[-1][1])
                if len(group) >= GROUP_DOCS or held >= GROUP_TOKENS:
                    yield from settle()
        yield from settle()

    return keyed(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
