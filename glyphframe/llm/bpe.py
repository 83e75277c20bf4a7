"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked symbol list.

The vocabulary file's own rules prepare the text: its special tokens are cut out first, the rest is composed (NFC), lower-
cased letter by letter, and split into words; a word's UTF-8 bytes become its symbols, the last with the word-end mark.
Merges are applied in rank order, leftmost first; an entry whose symbols have changed since it was queued is skipped. Decoding
concatenates vocabulary strings, one space between, which is what a vocabulary without a decoder asks for.

Python's Unicode tables differ from the library's for some 1,900 code points, all beyond U+0557. Texts with a code point from
PLAIN on are therefore composed, lower-cased and split by the vocabulary's own normaliser and splitter as the library has them.

Cases: null text is empty: no tokens, and both digests are those of the empty string; texts and words of any length are
encoded whole; of the table's columns only the two named are read, whatever the others are called; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import keyed, slices

CACHE, LONG = 150_000, 64
PLAIN = "\u0300"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Bpe:
    WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.text = {i: s for s, i in self.vocab.items()}
        self.end = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = [(a, b, a + b) for a, b in merges]
        self.ranks = {(a, b): r for r, (a, b, _) in enumerate(self.pairs)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: s for s, i in special.items()}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.symbols = byte_symbols()
        self.bytes = {c: b for b, c in enumerate(self.symbols)}
        self.seen: dict[str, tuple[int, str, str]] = {}
        self.before: dict[str, tuple[int, str, str]] = {}
        library = Tokenizer.from_file(path)
        self.normaliser, self.splitter = library.normalizer, library.pre_tokenizer

    def merge(self, symbols: list[str]) -> list[str]:
        """The merged symbols of one word."""
        n, ranks, pairs = len(symbols), self.ranks, self.pairs
        queue = [r << 32 | i for i, r in enumerate(map(ranks.get, zip(symbols, symbols[1:]))) if r is not None]  # rank, place
        heapq.heapify(queue)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            entry = heapq.heappop(queue)
            i, (a, b, both) = entry & 0xFFFFFFFF, pairs[entry >> 32]
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # stale: a neighbour was merged meanwhile
            symbols[i], symbols[j] = both, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := ranks.get((both, symbols[k]))) is not None:
                    heapq.heappush(queue, r << 32 | i)
            if (h := left[i]) >= 0 and (r := ranks.get((symbols[h], both))) is not None:
                heapq.heappush(queue, r << 32 | h)
        return [s for s in symbols if s]

    def word(self, word: str) -> tuple[int, str, str]:
        """Number of tokens, ids and strings, joined by a space."""
        if (got := self.seen.get(word)) is None:
            if (got := self.before.get(word)) is None:
                symbols = [self.symbols[b] for b in word.encode("utf-8", "surrogateescape")]
                symbols[-1] += self.end
                merged = [s for s in self.merge(symbols) if s in self.vocab]
                got = len(merged), " ".join([str(self.vocab[s]) for s in merged]), " ".join([self.text[self.vocab[s]] for s in merged])
            if len(word) <= LONG:
                if len(self.seen) >= CACHE:  # what no word asks for until the next time is forgotten then
                    self.before, self.seen = self.seen, {}
                self.seen[word] = got
        return got

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        out = []
        for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append((1, str(self.special[piece]), piece))
                continue
            seen, word = self.seen, self.word  # of an older generation after a turn of it, whose words word() finds as well
            out.extend([seen.get(w) or word(w) for w in self.words(piece)])
        return [p for p in out if p[0]]

    def words(self, text: str) -> list[str]:
        if not text or max(text) < PLAIN:
            return self.WORD.findall(unicodedata.normalize("NFC", text).lower())
        split = self.splitter.pre_tokenize_str(self.normaliser.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in split]

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.text[i] for i in ids)


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded of each row."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in slices(batches):
            ids = [bpe.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded text, without moving either out of the worker."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        sha = lambda parts, k: hashlib.sha256(" ".join([p[k] for p in parts]).encode()).hexdigest()
        for b in slices(batches):
            rows = [(sum([p[0] for p in parts]), sha(parts, 1), sha(parts, 2)) for parts in (bpe.parts(t or "") for t in b.column("text").to_pylist())]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
