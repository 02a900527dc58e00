"""Token ids in binary shards with a minimal perfect hash index over document keys.

A store is a folder of shards in ascending ``doc_id`` order and a manifest row
for each shard. A shard has

* ``.ids``: the raw ids of its documents one after another, as little-endian
  unsigned 16-bit (vocabularies up to 65,536 ids) or 32-bit integers,
* ``.idx``: a header, then in fixed layout the levels of a minimal perfect hash
  of the shard's distinct keys (512 bits and the rank before them side by side),
  by slot a 32-bit fingerprint, how many documents have the key and the first of
  them, and in file order where each document starts and its key.

A keyed read takes the header, for each level that it goes through one block of
bits, then one slot, the key it is compared with, the starts and one slice of
``.ids``: a constant number of reads of constant size besides the ids
themselves, whatever the sizes of shard and corpus. A slot whose fingerprint or
key differs means that the store doesn't hold the key. The hash is the levelled
bit-array construction of Limasset et al. 2017 ("Fast and scalable minimal
perfect hashing for massive key sets"). Documents with null keys are the first
of their shard and only counted.

Files are written under the name of the task attempt and only those of the
attempt that Spark commits get into the manifest, so lost executors and
repeated tasks leave no half shards behind. Paths are any URI that pyarrow can
open (file, hdfs, s3, gs).

Defined results: a null text counts as empty (only the end id); null keys sort
first and are found as such; repeated keys stay as rows of their own, in the
order of their texts' hashes; an empty table gives an empty store.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barleaf.llm.bpe import CACHE_CHARS, ODD_SPACE
from barleaf.llm.common import pick, pieces_for, scratch

#: Input bytes a shard is made of.
SHARD_BYTES = 64 << 20
GAMMA = 2.0
#: Pieces kept by an encoder: each up to the first number, then those that come again up to the second.
CACHE_FREELY, CACHE = 400_000, 800_000
#: Cuts between a character and white space after it, and between a Latin letter and an ASCII sign or digit after it.
PIECE = re.compile(r"[ \t\n\r\f\v]*(?:[!-@\[-`{-~]*[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\x00-\x7f]|\Z)|[^ \t\n\r\f\v]+)|[ \t\n\r\f\v]+")
MANIFEST = "shard int, path string, first_key long, last_key long, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
MAGIC = b"TOKIDX02"
#: Bits of a level that stand beside their rank; levels that distinct keys never need.
BLOCK_BITS, MOST_LEVELS = 512, 200
BLOCK = np.dtype([("rank", "<u8"), ("bits", "u1", BLOCK_BITS // 8)])
SLOT = np.dtype([("print", "<u4"), ("run", "<u4"), ("first", "<u8")])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finalizer over unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed(keys: np.ndarray) -> np.ndarray:
    """Different keys have different hashes: every step of ``mix`` can be undone."""
    return mix(keys.astype("<i8").view("u8"), 1)


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 99) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Distinct 64-bit hashes -> 0..n-1, by levels of bit arrays; what collides in a level goes to the next one."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.concatenate([[0], np.cumsum(bits[:-1], dtype="i8")]))
            base += int(bits.sum())

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, left = [], hashes
        while len(left):
            if len(levels) == MOST_LEVELS:
                raise ValueError("equal hashes in the keys of a perfect hash")
            size = max(8, int(GAMMA * len(left)))
            at = level_place(left, len(levels), size)
            counts = np.bincount(at, minlength=size)
            levels.append(counts == 1)
            left = left[counts[at] != 1]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each; -1 for those that reach no level's bit. Other foreign hashes get some slot."""
        out, left = np.full(len(hashes), -1, "i8"), np.arange(len(hashes))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = level_place(hashes[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def blocks(self) -> list[np.ndarray]:
        """Each level as BLOCK records."""
        out = []
        for bits, ranks in zip(self.levels, self.ranks, strict=True):
            rows = np.zeros(-(-len(bits) // BLOCK_BITS), BLOCK)
            rows["rank"] = ranks[::BLOCK_BITS]
            padded = np.zeros(len(rows) * BLOCK_BITS, bool)
            padded[: len(bits)] = bits
            rows["bits"] = np.packbits(padded).reshape(len(rows), -1)
            out.append(rows)
        return out


def level_place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes, 2 + level) % np.uint64(size)).astype("i8")


class Layout:
    """Where the parts of an index file are, from its header: magic, id bytes, documents, null ones, distinct keys, levels, bits of each."""

    FIXED = len(MAGIC) + 5 * 8

    def __init__(self, read):
        """read(offset, size) -> bytes."""
        head = read(0, self.FIXED + 8 * MOST_LEVELS)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not an index file")
        self.id_bytes, self.n_docs, self.n_null, self.n_keys, levels = np.frombuffer(head, "<i8", 5, len(MAGIC)).tolist()
        self.bits = np.frombuffer(head, "<i8", levels, self.FIXED).tolist()
        self.level_at, at = [], self.FIXED + 8 * levels
        for n in self.bits:
            self.level_at.append(at)
            at += -(-n // BLOCK_BITS) * BLOCK.itemsize
        self.slot_at = at
        self.start_at = at + self.n_keys * SLOT.itemsize
        self.key_at = self.start_at + 8 * (self.n_docs + 1)


class ShardIndex:
    """Of one shard, in memory: the keys of its documents in file order, null ones first, where they start, and their perfect hash."""

    def __init__(self, keys, n_null, starts, hash_, slots, id_bytes):
        self.keys, self.n_null, self.starts, self.hash, self.slots, self.id_bytes = keys, n_null, starts, hash_, slots, id_bytes

    @property
    def null(self) -> np.ndarray:
        return np.arange(len(self.keys)) < self.n_null

    @classmethod
    def build(cls, keys: np.ndarray, null: np.ndarray, lengths: np.ndarray, id_bytes: int = 4) -> ShardIndex:
        """keys: in file order, null ones first, equal ones side by side."""
        n_null, keys = int(null.sum()), keys.astype("<i8")
        own = keys[n_null:]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, "i8")
        hashes = hashed(own[first])
        hash_ = PerfectHash.build(hashes)
        slots = np.zeros(len(first), SLOT)
        at = hash_.slots(hashes)
        slots["print"][at], slots["run"][at], slots["first"][at] = fingerprints(hashes), np.diff(np.append(first, len(own))), first + n_null
        return cls(keys, n_null, np.concatenate([[0], np.cumsum(lengths)]).astype("<i8"), hash_, slots, id_bytes)

    def find(self, keys: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first document of each key and how many there are; -1 and 0 for keys that the shard doesn't hold."""
        first, run = np.full(len(keys), -1, "i8"), np.zeros(len(keys), "i8")
        if self.n_null:
            first[null], run[null] = 0, self.n_null
        if len(self.slots):
            hashes = hashed(keys)
            at = self.hash.slots(hashes)
            slot = self.slots[at]
            found = ~null & (at >= 0) & (slot["print"] == fingerprints(hashes))
            found[found] = self.keys[slot["first"][found].astype("i8")] == keys[found]
            first[found], run[found] = slot["first"][found], slot["run"][found]
        return first, run

    def dump(self) -> bytes:
        head = np.array([self.id_bytes, len(self.keys), self.n_null, len(self.slots), len(self.hash.levels), *map(len, self.hash.levels)], "<i8")
        return b"".join([MAGIC, head.tobytes(), *(x.tobytes() for x in self.hash.blocks()), self.slots.tobytes(), self.starts.tobytes(), self.keys.tobytes()])

    @classmethod
    def load(cls, data: bytes) -> ShardIndex:
        at = Layout(lambda start, size: data[start : start + size])
        levels = [np.unpackbits(np.frombuffer(data, BLOCK, -(-n // BLOCK_BITS), x)["bits"].ravel(), count=n).astype(bool) for n, x in zip(at.bits, at.level_at, strict=True)]
        part = lambda kind, n, x: np.frombuffer(data, kind, n, x)
        return cls(part("<i8", at.n_docs, at.key_at), at.n_null, part("<i8", at.n_docs + 1, at.start_at), PerfectHash(levels), part(SLOT, at.n_keys, at.slot_at), at.id_bytes)


class KeyedReader:
    """Keyed reads of a shard by ranges: ``idx`` and ``ids`` are read(offset, size) -> bytes of its two files."""

    def __init__(self, idx, ids):
        self.idx, self.ids, self.at = idx, ids, Layout(idx)
        self.kind = np.dtype(f"<u{self.at.id_bytes}")

    def find(self, key: int | None) -> tuple[int, int]:
        """The first document of a key and how many there are; (-1, 0) if the shard doesn't hold it."""
        if key is None:
            return (0, self.at.n_null) if self.at.n_null else (-1, 0)
        hash_ = hashed(np.array([key], "<i8"))
        for level, (size, start) in enumerate(zip(self.at.bits, self.at.level_at, strict=True)):
            place = int(level_place(hash_, level, size)[0])
            block = np.frombuffer(self.idx(start + place // BLOCK_BITS * BLOCK.itemsize, BLOCK.itemsize), BLOCK)[0]
            bits, inside = np.unpackbits(block["bits"]), place % BLOCK_BITS
            if not bits[inside]:
                continue
            rank = int(block["rank"]) + int(bits[:inside].sum())
            slot = np.frombuffer(self.idx(self.at.slot_at + rank * SLOT.itemsize, SLOT.itemsize), SLOT)[0]
            first = int(slot["first"])
            if slot["print"] != fingerprints(hash_)[0] or int(np.frombuffer(self.idx(self.at.key_at + 8 * first, 8), "<i8")[0]) != key:
                break
            return first, int(slot["run"])
        return -1, 0

    def documents(self, key: int | None) -> list[tuple[int, np.ndarray]]:
        """(start, ids) of each document of a key."""
        first, run = self.find(key)
        if not run:
            return []
        starts = np.frombuffer(self.idx(self.at.start_at + 8 * first, 8 * (run + 1)), "<i8")
        width = self.kind.itemsize
        return [(int(a), np.frombuffer(self.ids(int(a) * width, int(b - a) * width), self.kind)) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class LibraryEncoder:
    """The tokenizers library over the distinct pieces of many texts.

    No token crosses from a character to white space after it, or from a
    letter to a sign after it, so the ids of a text are those of its pieces
    joined; texts with other than ASCII white space or with special tokens,
    which may be cut, go to the library whole.
    With many pieces kept, further ones are from their second time on, so that
    those that come once don't push out the others.
    """

    def __init__(self, path: str):
        # Spark's tasks are the parallelism; the library's own threads would only get in each other's way
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cache: dict[str, bytes] = {}
        self.seen = bytearray(1 << 24)
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.specials = [x.content for x in self.library.get_added_tokens_decoder().values()]
        # bytes of text that each token stands for: byte-level vocabularies have a letter for each byte
        self.lengths = np.zeros(self.library.get_vocab_size(), "i8")
        for token, i in self.library.get_vocab().items():
            self.lengths[i] = len(token)
        for i, added in self.library.get_added_tokens_decoder().items():
            self.lengths[i] = len(added.content.encode())

    def whole(self, texts: list[str]) -> list[bytes]:
        return [packed(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each piece. Pieces that start with white space are encoded side by side in one text and told apart by the lengths of their tokens."""
        joined = [p for p in pieces if p[0] in " \n\t\r" and not p.isspace() and (p.isascii() or not ODD_SPACE.search(p))]
        mine = {}
        for a in range(0, len(joined), 4096):
            part = joined[a : a + 4096]
            ids = np.array(self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.lengths[ids])
            cut = 4 * np.searchsorted(ends, np.cumsum([len(p.encode()) for p in part]), side="right")
            raw = ids.tobytes()
            mine |= {p: raw[i:j] for p, i, j in zip(part, [0, *cut[:-1].tolist()], cut.tolist(), strict=True)}
        rest = [p for p in pieces if p not in mine]
        mine |= dict(zip(rest, self.whole(rest), strict=True))
        return [mine[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text, as little-endian unsigned 32-bit integers."""
        if whole := {i for i, t in enumerate(texts) if any(s in t for s in self.specials)}:
            apart = iter(self.whole([texts[i] for i in sorted(whole)]))
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in whole]))
            return [next(apart if i in whole else rest) for i in range(len(texts))]
        cut = [PIECE.findall(t) for t in texts]
        cache, seen = self.cache, self.seen
        if len(cache) > CACHE:
            cache.clear()
        new = list(set().union(*cut).difference(cache))
        odd = {p for p in new if not p.isascii() and ODD_SPACE.search(p)}
        cache.update(zip(new, self.each(new), strict=True))
        get = cache.__getitem__
        if odd:
            out = [b"".join(map(get, pieces)) if odd.isdisjoint(pieces) else self.whole([text])[0] for text, pieces in zip(texts, cut, strict=True)]
        else:
            out = [b"".join(map(get, pieces)) for pieces in cut]
        freely = len(cache) < CACHE_FREELY
        for piece in new:
            at = hash(piece) & 0xFFFFFF
            if not (freely or seen[at]) or len(piece) > CACHE_CHARS or piece in odd:
                del cache[piece]
            seen[at] = 1
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def files(uri: str):
    """(file system, path) of a URI."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where, path


def chunks(batch: pa.RecordBatch, chars: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    """The rows of a batch in runs of about so many characters."""
    ids, texts, n = [], [], 0
    for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        ids.append(key)
        texts.append(text.as_py() or "")
        n += len(texts[-1])
        if n >= chars:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> list:
    """Encode ``docs`` into a new store; its manifest, a row for each shard in key order.

    The manifest is what comes to the driver: one short row for 64 MB of input.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    docs = pick(docs, doc_id="long", text="string").withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    shards = docs.repartitionByRange(pieces_for(docs, SHARD_BYTES), F.col("doc_id").asc_nulls_first(), "tie", "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, task = encoder(tokenizer_path), TaskContext.get()
        kind = "<u4" if lib.wide or end_id >= 1 << 16 else "<u2"
        stem, keys, lengths, out = f"{path}/{task.partitionId():06d}-{task.taskAttemptId()}", [], [], None
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            for ids, texts in chunks(batch):
                if out is None:
                    where, inner = files(stem)
                    where.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(f"{inner}.ids")
                keys += ids
                for raw in lib.encode(texts):
                    own = np.frombuffer(raw, "<u4").astype(kind)
                    lengths.append(len(own) + 1)
                    out.write(own.tobytes() + end)
        if out is None:
            return
        out.close()
        null = np.array([k is None for k in keys])
        plain = np.array([k or 0 for k in keys], "i8")
        with where.open_output_stream(f"{inner}.idx") as f:
            f.write(ShardIndex.build(plain, null, np.array(lengths, "i8"), np.dtype(kind).itemsize).dump())
        row = [[task.partitionId()], [stem], [keys[0]], [keys[-1]], [len(keys)], [sum(lengths)]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["shard", "path", "first_key", "last_key", "n_docs", "n_ids"])

    return sorted(shards.select("doc_id", "text").mapInArrow(run, MANIFEST).collect(), key=lambda r: r.shard)


def load(stem: str) -> tuple[ShardIndex, np.ndarray]:
    """A whole shard."""
    where, inner = files(stem)
    with where.open_input_stream(f"{inner}.idx") as f:
        index = ShardIndex.load(f.read())
    with where.open_input_stream(f"{inner}.ids") as f:
        return index, np.frombuffer(f.read(), f"<u{index.id_bytes}")


def ranged(f):
    def read(start: int, size: int) -> bytes:
        f.seek(start)
        return f.read(size)

    return read


@contextmanager
def keyed(stem: str) -> Iterator[KeyedReader]:
    where, inner = files(stem)
    with where.open_input_file(f"{inner}.idx") as idx, where.open_input_file(f"{inner}.ids") as ids:
        yield KeyedReader(ranged(idx), ranged(ids))


def bases(manifest: list) -> list[int]:
    """Ids before each shard."""
    return [0, *np.cumsum([r.n_ids for r in manifest]).tolist()][:-1]


def read_store(spark: SparkSession, manifest: list) -> DataFrame:
    """Every document of the store, fetched by key through its shard's index: READ."""
    rows = [(r.shard, r.path, base) for r, base in zip(manifest, bases(manifest), strict=True)]
    work = spark.createDataFrame(rows, "shard int, path string, base long").repartition(max(1, len(rows)), "shard") if rows else spark.createDataFrame([], "shard int, path string, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                index, ids = load(r["path"])
                distinct = np.flatnonzero(np.concatenate([[True], (index.keys[1:] != index.keys[:-1]) | (index.null[1:] != index.null[:-1])]))
                first, run_ = index.find(index.keys[distinct], index.null[distinct])
                at = np.repeat(first, run_) + np.arange(run_.sum()) - np.repeat(np.cumsum(run_) - run_, run_)
                for k in range(0, len(at), 4096):
                    own = at[k : k + 4096]
                    crc = [zlib.crc32(ids[index.starts[i] : index.starts[i + 1]].astype("<u4")) for i in own]
                    keys = pa.array(index.keys[own], pa.int64(), mask=index.null[own])
                    yield pa.RecordBatch.from_arrays([keys, pa.array(index.starts[own] + r["base"]), pa.array(index.starts[own + 1] - index.starts[own]), pa.array(crc, pa.int64()), pa.array([r["shard"]] * len(own), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return work.mapInArrow(run, READ)


def lookup(keys: DataFrame, manifest: list) -> DataFrame:
    """The ids of the asked documents: doc_id, start, ids array<int>; nothing for keys that the store doesn't hold.

    Asked keys go to the shards whose key range holds them and are read there by
    ``KeyedReader``.
    """
    spark, schema = keys.sparkSession, "doc_id long, start long, ids array<int>"
    if not manifest:
        return spark.createDataFrame([], schema)
    # a few numbers and a path for each 64 MB of input, sent to each executor once
    filled = [r for r in manifest if r.last_key is not None]
    route_by = spark.sparkContext.broadcast((
        np.array([r.last_key for r in filled], "i8"), np.array([-(1 << 63) if r.first_key is None else r.first_key for r in filled], "i8"),
        np.array([r.shard for r in filled], "i4"), [r.shard for r in manifest if r.first_key is None],
    ))
    where = spark.sparkContext.broadcast({r.shard: (r.path, base) for r, base in zip(manifest, bases(manifest), strict=True)})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, shards, nulls = route_by.value
        for batch in batches:
            own = [nulls if k is None else shards[np.searchsorted(high, k, "left") : np.searchsorted(low, k, "right")].tolist() for k in batch.column("doc_id").to_pylist()]
            at = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array([x for xs in own for x in xs], pa.int32())], ["doc_id", "shard"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ExitStack() as held:
            reader = now = None
            for batch in batches:
                out = [[], [], []]
                for key, shard in zip(batch.column("doc_id").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                    if shard != now:
                        held.close()
                        path, base = where.value[shard]
                        reader, now = held.enter_context(keyed(path)), shard
                    for start, ids in reader.documents(key):
                        for column, x in zip(out, (key, start + base, ids.astype("i4")), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["doc_id", "start", "ids"])

    # dealt out by key, so that a shard which many keys are asked of is many tasks
    asked = pick(keys, doc_id="long").distinct().mapInArrow(route, "doc_id long, shard int")
    return asked.repartition("shard", "doc_id").sortWithinPartitions("shard").mapInArrow(fetch, schema)
