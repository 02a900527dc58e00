"""Exact Jaccard self-join on word shingles as a blocked sparse product.

The document by shingle incidence matrix is never multiplied whole:

1. *Column blocks.* Each document's shingle hashes go to column blocks; a row
   that is shuffled is a slice of the matrix (many documents by one block) as
   packed arrays. A task takes the slices of a block as they come; entries of a
   column that reaches ``LARGE`` go on at once, so that what it holds is bounded
   by the block's other columns, each below ``LARGE``. Columns of one document
   can't contribute to any product and end there. Columns of a hundredth of all
   documents or more are found before, from counts of each slice, and go
   straight to their documents, so that no task gets all of them.
2. *Row bounds.* The remaining entries return to their documents. To reach the
   threshold t with any other document, a document of n shingles must share one
   of its n - ceil(t n) + 1 rarest columns. If its unshared columns alone are
   that many, no pair can pass, and the document is done. Documents of equal
   sets become one class.
3. *Products.* For each column among the rarest of two or more documents,
   pairs whose sizes and places allow t are formed, and their overlap is counted
   over whole rows. The place of a column among a document's columns, rarest
   first, bounds what the two can share from there on; of a passing pair, their
   first common column keeps that bound. Pairs that are already connected aren't
   formed: hub rounds link each document to one hub of the column, the document
   whose columns are the most frequent, and merge what passes; then every pair
   still apart is formed, in passes of bounded size, so no link between
   different sets is lost, and a group of copies costs rows in proportion to its
   size.
4. *Components* over the links, by alternating stars.

Joins on a column or a root are between written tables, so that adaptive
execution can split the rows of a frequent one; aggregates on them combine on the
map side.

Columns are told apart by the block and 48 bits of the hash, that is by 55 bits
for half a GB and by all 64 from 256 GB on. Two columns that share these count as
one; among the columns of two texts of 1,000 words that has a chance of less than
one in 10^8 at any size.

Defined results: null or empty texts and texts of white space have an empty
set, size 0, and are linked with nothing; repeated rows are documents of their
own with equal sets; null keys take part and are ignored when the smallest key
of a component is taken; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barleaf.llm.common import drop_path, materialize, pick, pieces_for
from barleaf.llm.graph import components
from barleaf.llm.shingles import shingle_sets
from barleaf.llm.tokenstore import mix

#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Input bytes that a block of columns or a part of the documents is made of; the most blocks, as a power of two, and parts.
#: With few entries in each row that is shuffled, the rows themselves would cost more than the entries.
BLOCK_BYTES, MOST_BITS, MOST_PARTS = 4 << 20, 18, 1 << 22
#: Characters taken into one slice, for up to so many blocks; in proportion beyond that, up to the last number.
SLICE_CHARS, SLICE_BLOCKS, MOST_SLICE = 2 << 20, 1 << 15, 16 << 20
#: Entries that a block's task holds before it looks for large columns, and sorts at once; entries of a large column.
HELD, SORTED, LARGE = 8 << 20, 4 << 20, 1 << 16
#: Pairs compared by place and size in one pass, for each entry of a column that still has two groups; above that, more hub rounds go first, HUB_ROUNDS at most.
PAIRS_EACH, HUB_ROUNDS = 64, 6

ENTRIES = "block int, kind int, runs binary, sizes binary, counts binary, low binary, high binary, codes binary"
FIELDS = ["block", "kind", "runs", "sizes", "counts", "low", "high", "codes"]
TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
#: kind of a row: entries of columns; keys and sizes of documents; entries of the most frequent columns.
COLUMNS, SIZES, FREQUENT = 0, 1, 2
#: Columns of this share of all documents are the most frequent ones; all of them are found, with some of half that share.
FREQUENT_SHARE, TOP_CODE = 0.01, 255
#: Below so many documents no column needs to be set apart.
LEAST_FREQUENT = 100
LOW48 = np.uint64((1 << 48) - 1)


def table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], FIELDS)


def joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def by_group(groups: np.ndarray, runs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Entries dealt into groups: (group, entries, run of each stretch, its length). Entries of a run stay together."""
    order = np.lexsort((runs, groups))
    g, r = groups[order], runs[order]
    if not len(order):
        return
    cut = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])]))
    length = np.diff(np.append(cut, len(order)))
    first = np.flatnonzero(np.concatenate([[True], g[cut][1:] != g[cut][:-1]]))
    for a, b in zip(first, np.append(first[1:], len(cut)), strict=True):
        yield int(g[cut[a]]), order[cut[a] : cut[b - 1] + length[b - 1]], r[cut[a:b]], length[a:b]


def part_of(rid: np.ndarray, parts: int) -> np.ndarray:
    """The part that a document belongs to."""
    return (mix(rid.view("u8"), 5) % np.uint64(parts)).astype("i4")


def column_ids(block: np.ndarray | int, low: np.ndarray, bits: int) -> np.ndarray:
    """Columns by their block, the first ``bits`` of the hash, and its low 48 bits: the whole hash from 16 bits on."""
    shift = 64 - max(bits, 16)
    return (low & np.uint64((1 << shift) - 1)) | (np.asarray(block).astype("u8") << np.uint64(shift))


def texts_by_slice(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[int], list, list]]:
    """(row numbers, keys, texts) of about so many characters, whatever the batches are."""
    rows, keys, texts, chars = [], [], [], 0
    for batch in batches:
        for r, k, t in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            rows.append(r)
            keys.append(k)
            texts.append(t.as_py())
            chars += len(texts[-1] or "")
            if chars >= most:
                yield rows, keys, texts
                rows, keys, texts, chars = [], [], [], 0
    if rows:
        yield rows, keys, texts


def sets_of(texts: list) -> list[np.ndarray]:
    """The shingle sets of a slice, at most about SLICE_CHARS characters at once: hashing takes far more room than its result."""
    out, first, chars = [], 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= SLICE_CHARS or i == len(texts) - 1:
            out += shingle_sets(texts[first : i + 1])
            first, chars = i + 1, 0
    return out


def frequent_columns(numbered: DataFrame) -> np.ndarray:
    """Sorted hashes of all shingles in FREQUENT_SHARE of the documents or more.

    A shingle of that share of all has at least half of it in slices where it
    has half that share; what these slices count is summed. As a document holds
    n shingles, at most 2 n / FREQUENT_SHARE of them can pass, for the mean n,
    whatever the number of documents: that bounds what comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in texts_by_slice(batches, SLICE_CHARS):
            sets = shingle_sets(texts)
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            often = (n >= len(sets) * FREQUENT_SHARE / 2) & (n > 1)
            yield pa.RecordBatch.from_arrays([pa.array([None, *found[often].view("i8")], pa.int64()), pa.array([len(sets), *n[often]], pa.int64())], ["h", "n"])

    counts = numbered.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "counts")
    total = counts.where("h is null").first()
    found = counts.where((F.col("h").isNotNull()) & (F.col("n") >= (total.n if total else 0) * FREQUENT_SHARE / 2) & (F.col("n") >= LEAST_FREQUENT)).select("h").toArrow()
    drop_path(numbered.sparkSession, counts.scratch_path)
    return np.sort(found.column("h").to_numpy().view("u8"))


def slices(numbered: DataFrame, bits: int, parts: int, frequent: np.ndarray) -> DataFrame:
    """Step 1, map side: ENTRIES rows for 2 ** bits blocks. Documents go by a row number, which is kept with their key and size."""
    hot = numbered.sparkSession.sparkContext.broadcast(frequent)  # bounded: see frequent_columns
    most = min(MOST_SLICE, SLICE_CHARS * max(1, (1 << bits) // SLICE_BLOCKS))

    def emit(rows: list[int], keys: list, texts: list) -> pa.Table:
        sets = sets_of(texts)
        n = np.array([len(s) for s in sets], "i4")
        rid = np.array(rows, "i8")
        null, part = np.array([k is None for k in keys]), part_of(rid, parts)
        out = [(-1 - int(part[0]), SIZES, rid.tobytes(), n.tobytes(), np.packbits(null).tobytes(), np.array([k or 0 for k in keys], "i8").tobytes(), None, None)]
        every, of = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype="i4"), n)
        home = (every >> np.uint64(64 - bits)).astype("i4") if bits else np.zeros(len(every), "i4")
        often = hot.value[np.minimum(np.searchsorted(hot.value, every), len(hot.value) - 1)] == every if len(hot.value) else np.zeros(len(every), bool)
        rest = np.flatnonzero(~often)
        for b, at, runs, counts in by_group(home[rest], of[rest]):
            own = every[rest[at]] & LOW48
            out.append((b, COLUMNS, rid[runs].tobytes(), n[runs].tobytes(), counts.astype("i4").tobytes(), own.astype("u4").tobytes(), (own >> np.uint64(32)).astype("u2").tobytes(), None))
        top = np.flatnonzero(often)
        for b, at, runs, counts in by_group(part[of[top]], of[top]):
            ids = column_ids(home[top[at]], every[top[at]] & LOW48, bits)
            out.append((-1 - b, FREQUENT, rid[runs].tobytes(), n[runs].tobytes(), counts.astype("i4").tobytes(), ids.tobytes(), None, np.full(len(at), TOP_CODE, "u1").tobytes()))
        return table(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts_by_slice(batches, most):
            yield from emit(*part).to_batches()

    return numbered.mapInArrow(run, ENTRIES)


class ColumnBlock:
    """The entries of one block as they come. What is settled goes to the documents' parts: entries of large columns as soon as they are found, at the end those of all columns of two or more documents."""

    def __init__(self, block: int, bits: int, parts: int):
        self.block, self.bits, self.parts = block, bits, parts
        self.large, self.room = np.zeros(0, "u8"), HELD
        self.held: list[tuple[np.ndarray, ...]] = []  # run, size, number of entries; columns
        self.entries = 0

    def add(self, row: dict) -> Iterator[pa.Table]:
        keys = np.frombuffer(row["low"], "u4").astype("u8") | np.frombuffer(row["high"], "u2").astype("u8") << np.uint64(32)
        self.held.append((np.frombuffer(row["runs"], "i8"), np.frombuffer(row["sizes"], "i4"), np.frombuffer(row["counts"], "i4"), keys))
        self.entries += len(keys)
        if self.entries >= self.room:
            yield from self.settle(False)

    def settle(self, end: bool) -> Iterator[pa.Table]:
        runs, sizes, counts, keys = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = []
        run_of, stays = np.repeat(np.arange(len(runs), dtype="i4"), counts), np.zeros(len(keys), bool)
        ranges = -(-len(keys) // SORTED)
        place = mix(keys, 21) % np.uint64(ranges) if ranges > 1 else None
        for i in range(ranges):
            at = np.flatnonzero(place == i) if ranges > 1 else np.arange(len(keys))
            at = at[np.argsort(keys[at])]
            own = keys[at]
            new = np.concatenate([[True], own[1:] != own[:-1]])
            column = np.cumsum(new) - 1
            count = np.bincount(column)
            large = (count >= LARGE) | np.isin(own[new], self.large)
            self.large = np.union1d(self.large, own[new][large])
            df = np.where(large, LARGE, np.minimum(count, LARGE))[column]
            out = df >= (2 if end else LARGE)
            stays[at[~out]] = not end
            at, df = at[out], df[out]
            home = part_of(runs, self.parts)[run_of[at]]
            ids, code = column_ids(self.block, keys[at], self.bits), np.minimum(TOP_CODE - 1, 8 * np.log2(df)).astype("u1")
            rows = [(b, COLUMNS, runs[r].tobytes(), sizes[r].tobytes(), n.astype("i4").tobytes(), ids[e].tobytes(), None, code[e].tobytes()) for b, e, r, n in by_group(home, run_of[at])]
            if rows:
                yield table(rows)
        self.entries = int(stays.sum())
        if self.entries:
            left = np.bincount(run_of[stays], minlength=len(runs)).astype("i4")
            some = left > 0
            self.held = [(runs[some], sizes[some], left[some], keys[stays])]
        self.room = max(HELD, 2 * self.entries)


def shared_columns(entries: DataFrame, bits: int, parts: int) -> DataFrame:
    """Step 1, reduce side: entries of columns of two or more documents, dealt by document; sizes pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            # what is for documents passes through, to the documents' own part
            through = batch.filter(pc.less(batch.column("block"), 0))
            if len(through):
                part = pa.array(-1 - through.column("block").to_numpy())
                yield through.select(FIELDS).set_column(0, "block", part)
            for row in batch.filter(pc.greater_equal(batch.column("block"), 0)).to_pylist():
                if now is not None and now.block != row["block"]:
                    for t in now.settle(True) if now.held else ():
                        yield from t.to_batches()
                    now = None
                now = now or ColumnBlock(row["block"], bits, parts)
                for t in now.add(row):
                    yield from t.to_batches()
        if now is not None and now.held:
            for t in now.settle(True):
                yield from t.to_batches()

    return entries.repartition("block").sortWithinPartitions("block").mapInArrow(run, ENTRIES)


def sizes_of(entries: DataFrame) -> DataFrame:
    """rid, doc_id, n of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rid, n = np.frombuffer(r["runs"], "i8"), np.frombuffer(r["sizes"], "i4")
                null = np.unpackbits(np.frombuffer(r["counts"], "u1"), count=len(rid)).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.frombuffer(r["low"], "i8"), mask=null), pa.array(n)], ["rid", "doc_id", "n"])

    return entries.where(F.col("kind") == SIZES).select("runs", "sizes", "counts", "low").mapInArrow(run, "rid long, doc_id long, n int")


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n.astype("i8") // 100)


def candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Step 2: the documents that can still pass. ids: shared columns; rarest: those that one must share; centre: how frequent its columns are."""
    schema = "rid long, n int, unshared int, centre double, digest binary, ids array<long>, rarest array<long>"

    def run(part: pa.Table) -> pa.Table:
        runs, sizes, counts = joined(part.column("runs"), "i8"), joined(part.column("sizes"), "i4"), joined(part.column("counts"), "i4")
        ids, codes = joined(part.column("low"), "u8"), joined(part.column("codes"), "u1")
        entry_run = np.repeat(runs, counts)
        order = np.lexsort((ids, codes, entry_run))
        rid, start = np.unique(entry_run[order], return_index=True)
        size = dict(zip(runs.tolist(), sizes.tolist(), strict=True))
        n = np.array([size[r] for r in rid.tolist()], "i4")
        shared = np.diff(np.append(start, len(order))).astype("i4")
        left = n - least_overlap(n, percent) + 1 - (n - shared)
        out = [[] for _ in range(7)]
        for i in np.flatnonzero(left > 0):
            here = order[start[i] : start[i] + shared[i]]
            own = ids[here]
            whole = np.sort(own)
            for column, x in zip(out, (rid[i], n[i], n[i] - shared[i], codes[here].sum() / n[i], hashlib.sha256(whole.tobytes()).digest()[:16], whole.view("i8"), own[: left[i]].view("i8")), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["rid", "n", "unshared", "centre", "digest", "ids", "rarest"])

    return entries.where(F.col("kind") != SIZES).groupBy("block").applyInArrow(run, schema)


def allowed(percent: int) -> Column:
    """Whether sizes (n, n1) and what is left from a common column on (r, r1) allow the threshold."""
    sizes = percent * F.greatest("n", "n1") <= 100 * F.least("n", "n1")
    return sizes & ((100 + percent) * F.least("r", "r1") >= percent * (F.col("n") + F.col("n1")))


def posted(rows: DataFrame, percent: int) -> DataFrame:
    """h, rid, n, centre, r: the rarest columns of each row that another row may share, with what is left from there on."""
    single = rows.select("rid", "n", "unshared", "centre", F.posexplode("rarest").alias("at", "h")).select("h", "rid", "n", "centre", (F.col("n") - F.col("unshared") - F.col("at")).alias("r"))
    often = materialize(single.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1").select("h", "least"), "often")
    other = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    posts = materialize(single.join(often, "h").where((100 + percent) * F.col("r") >= percent * (F.col("n") + other)).drop("least"), "posts")
    drop_path(rows.sparkSession, often.scratch_path)
    return posts


def passing(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose overlap reaches the threshold."""
    left, right = (rows.select(F.col("rid").alias(k), F.col("n").alias(f"n{k}"), F.col("ids").alias(f"ids{k}")) for k in "uv")
    both = pairs.join(left, "u").join(right, "v")
    overlap = F.size(F.array_intersect("idsu", "idsv"))
    return both.select("u", "v", "nu", "nv", overlap.alias("o")).where(F.lit(100) * F.col("o") >= F.lit(percent) * (F.col("nu") + F.col("nv") - F.col("o"))).select("u", "v")


def links(rows: DataFrame, percent: int) -> DataFrame:
    """Step 3: links (u, v) that connect all rows (of distinct sets) which any chain of passing pairs connects."""
    spark, found, tested, scratch, roots = rows.sparkSession, [], [], [], None
    none = spark.createDataFrame([], "u long, v long")

    def keep(df: DataFrame, name: str) -> DataFrame:
        scratch.append(out := materialize(df, name))
        return out

    def every(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, tables, none)

    def test(meet: DataFrame) -> None:
        """Compare the new pairs (rid, rid1) over whole rows."""
        pairs = meet.select(F.least("rid", "rid1").alias("u"), F.greatest("rid", "rid1").alias("v")).distinct()
        pairs = keep(pairs.join(every(tested), ["u", "v"], "left_anti") if tested else pairs, "pairs")
        found.append(materialize(passing(pairs, rows, percent), "links"))
        tested.append(pairs)

    posts = posted(rows, percent)
    scratch.append(posts)
    for turn in range(HUB_ROUNDS + 1):
        now = posts.withColumn("c", F.col("rid")) if roots is None else posts.join(roots, posts.rid == roots.node, "left").withColumn("c", F.coalesce("root", "rid")).drop("node", "root")
        groups = now.groupBy("h", "c").agg(F.count("*").alias("k"))
        main = groups.groupBy("h").agg(F.max(F.struct("k", "c")).alias("main"), F.sum("k").alias("docs"), F.count("*").alias("parts")).where("parts > 1")
        main = keep(main.select("h", "docs", F.col("main.c").alias("main"), (F.col("docs") - F.col("main.k")).alias("minor")), "main")
        cost, entries = main.agg(F.coalesce(F.sum(F.col("minor") * F.col("docs")), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
        if not cost:
            break
        each = PAIRS_EACH * max(entries, 10_000)
        open_ = keep(now.join(main.select("h", "main"), "h"), "open")
        if turn == HUB_ROUNDS or (turn > 0 and cost <= each):
            minor = open_.where("c <> main").select("h", *(F.col(x).alias(f"{x}1") for x in ("rid", "n", "r", "c")))
            passes = -(-cost // max(1, each))
            for i in range(passes):
                mine = minor.where(F.pmod(F.xxhash64("rid1"), F.lit(passes)) == i) if passes > 1 else minor
                test(mine.join(open_, "h").where((F.col("c") != F.col("c1")) & ((F.col("c") == F.col("main")) | (F.col("rid") < F.col("rid1"))) & allowed(percent)))
                # no pair comes in two of these passes
                drop_path(spark, tested.pop().scratch_path)
                scratch.pop()
            break
        # later hubs are from outside the main component
        rank = F.struct(F.when((F.col("c") == F.col("main")) & F.lit(turn > 0), 0).otherwise(1), "centre", "rid", "n", "r", "c")
        hubs = keep(open_.groupBy("h").agg(F.max(rank).alias("hub")).select("h", *(F.col(f"hub.{x}").alias(f"{x}1") for x in ("rid", "n", "r", "c"))), "hubs")
        test(open_.join(hubs, "h").where((F.col("c") != F.col("c1")) & allowed(percent)))
        roots = components(every(found))
        scratch.append(roots)
    for table_ in scratch:
        drop_path(spark, table_.scratch_path)
    return every(found)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, row: str | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, row (a number of its own), and first: whether no other document of its component has a smaller (doc_id, row), null keys last.

    row: a column with such numbers; without it documents are numbered here.
    """
    spark, pieces = docs.sparkSession, pieces_for(docs, BLOCK_BYTES)
    bits, parts = min(MOST_BITS, max(0, pieces - 1).bit_length()), min(MOST_PARTS, pieces)
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    numbered = pick(docs, doc_id="long", text="string", **({row: "long"} if row else {})).select(number.alias("rid"), "doc_id", "text")
    entries = materialize(shared_columns(slices(numbered, bits, parts, frequent_columns(numbered)), bits, parts), "columns")
    sizes = materialize(sizes_of(entries), "documents")
    rows = materialize(candidates(entries, percent), "rows")
    drop_path(spark, entries.scratch_path)
    # documents of one set: the smallest row number stands for all
    same = rows.where("unshared = 0").select("rid", "n", "digest")
    first = materialize(same.groupBy("digest", "n").agg(F.min("rid").alias("first"), F.count("*").alias("k")).where("k > 1"), "sets")
    copies = materialize(same.join(first, ["digest", "n"]).where("rid <> first").select(F.col("rid").alias("u"), F.col("first").alias("v")), "copies")
    distinct = materialize(rows.join(copies.select(F.col("u").alias("rid")), "rid", "left_anti"), "distinct")
    drop_path(spark, rows.scratch_path)
    roots = components(links(distinct, percent).union(copies))
    drop_path(spark, distinct.scratch_path)
    # only linked documents meet their components: all others would share the key null
    grouped = roots.union(roots.select("root", "root").distinct()).toDF("rid", "root")
    linked = materialize(grouped.join(sizes, "rid").select("rid", "root", "doc_id"), "linked")
    least = materialize(linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")), "least")
    named = linked.join(least, "root").select("rid", F.col("least.doc_id").alias("component"), (F.col("least.rid") == F.col("rid")).alias("head"))
    out = sizes.join(named, "rid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.col("rid").alias("row"), F.coalesce("head", F.lit(True)).alias("first"))


#: The same by SQL: shingles as strings, all pairs that share one, and the closure of their links.
ORACLE = f"""
with recursive w as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents
), s as (
  select r, doc_id,
         case when len(words) >= 5 then list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
              when len(words) > 0 then [array_to_string(words, ' ')] else [] end as shingles
  from w
), e as (
  select r, len(shingles) as n, unnest(shingles) as h from s
), p as (
  select a.r as u, b.r as v from e a join e b on a.h = b.h and a.r < b.r and {PERCENT} * greatest(a.n, b.n) <= 100 * least(a.n, b.n)
  group by a.r, b.r, a.n, b.n having 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), l as (
  select u, v from p union all select v, u from p
), reach as (
  select r, r as x from s
  union
  select reach.r, l.v from reach join l on reach.x = l.u
)
select a.doc_id, cast(len(a.shingles) as bigint) as n_shingles, min(b.doc_id) as component_id
from s a join reach on a.r = reach.r join s b on b.r = reach.x
group by a.r, a.doc_id, len(a.shingles)
"""
