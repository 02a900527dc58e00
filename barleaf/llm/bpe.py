"""Byte-level BPE: encoding by a queue of merge ranks over a linked symbol list, decoding by vocabulary strings.

``encode``/``decode`` give what the tokenizers library gives for the same
vocabulary file with ``add_special_tokens=False`` and
``skip_special_tokens=False``. Defined results: a null text counts as empty
and gives no ids; null and repeated ``doc_id`` values pass through, one output
row per input row; an empty table gives an empty result.

A text is cut into pieces, each a run of ASCII white space and the run of
other characters after it. No pre-token crosses such a cut, so pieces are
encoded one by one and kept in a bounded cache. Texts with other Unicode
white space are not cut.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from barleaf.llm.common import pick

#: Fixed value: the pre-token pattern of this family of byte-level vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECE = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
ODD_SPACE = re.compile(r"[^\S \t\n\r\f\v]")
CACHE_WORDS, CACHE_PIECES, CACHE_CHARS = 350_000, 200_000, 48

#: Rows that leave at once where ids themselves are returned.
ROWS = 512

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class OddSpace(Exception):
    """A piece holds white space at which cutting is not safe."""


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 letters stand for themselves, the others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class HeapBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.strings = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.byte_ids = {letters[token]: i for token, i in vocab.items() if len(token) == 1}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings |= {i: text.encode() for text, i in self.specials.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.split = regex.compile(PRETOKEN).findall
        self.words, self.pieces = Words(self), Pieces(self)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank merges first, the leftmost of equal ones before the others."""
        symbols = [self.byte_ids[b] for b in word]
        n, ranks = len(symbols), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(ranks[pair][0], i, pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in ranks]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if j < 0 or symbols[i] != pair[0] or symbols[j] != pair[1]:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = ranks[pair][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if new := ranks.get(pair := (symbols[i], symbols[k])):
                    heapq.heappush(queue, (new[0], i, pair))
            if (h := before[i]) >= 0 and (new := ranks.get(pair := (symbols[h], symbols[i]))):
                heapq.heappush(queue, (new[0], h, pair))
        return [s for s in symbols if s >= 0]

    def plain(self, text: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of a text without special tokens."""
        try:
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))
        except OddSpace:
            return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        if self.special is None or not any(s in text for s in self.specials):
            return self.plain(text)
        return b"".join(np.uint32(self.specials[x]).astype("<u4").tobytes() if x in self.specials else self.plain(x) for x in self.special.split(text))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class Words(dict):
    """Pre-token -> packed ids."""

    def __init__(self, bpe: HeapBpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.bpe.merge(word.encode()), "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Pieces(dict):
    """Piece -> packed ids."""

    def __init__(self, bpe: HeapBpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if ODD_SPACE.search(piece):
            raise OddSpace
        words = self.bpe.words
        ids = b"".join([words[w] for w in self.bpe.split(piece)])
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def loaded(path: str) -> HeapBpe:
    return HeapBpe(path)


def roundtrip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: the number of ids, the digest of the ids and that of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                packed = bpe.encode(text.as_py() or "")
                ids = np.frombuffer(packed, "<u4")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document its ids themselves, and whether they decode to the text: doc_id, lang, source, n_tokens, ids, exact."""
    schema = "doc_id long, lang string, source string, n_tokens long, ids array<int>, exact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [np.frombuffer(bpe.encode(t), "<i4") for t in texts]
                exact = [bpe.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("source"), pa.array([len(i) for i in ids], pa.int64()), lists, pa.array(exact)], ["doc_id", "lang", "source", "n_tokens", "ids", "exact"])

    return pick(docs, doc_id="long", text="string", lang="string", source="string").mapInArrow(run, schema)
