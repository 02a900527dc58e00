"""BPE, token store and media: against the library, by round trips, and on awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from barleaf.llm import bpe, media, tokenstore

from .conftest import same


@pytest.fixture(scope="module")
def library(tokenizer_path):
    return Tokenizer.from_file(tokenizer_path)


AWKWARD = [
    "", " ", "  ", "\n \n x", " x", "x ", "a  b   c\n\n\nd", "it's I'll we've 'st don't've", "x<|endoftext|> y <|endoftext|>", "123 ١٢٣ ½ 漢字 😀 é é", "  w　  x\u0085y\x1c z", "a" * 3000,
    "!?!?..., --- ###", "abc.дef.x", "12ab€.x a€b ab٣4 a…. naïve—x", "\x00\x01\x7f", "ÀÉßøÿ.", "\t\ttabs\r\nlines\r\n",
]


def test_heap_merges_equal_the_library(library, tokenizer_path):
    mine = bpe.loaded(tokenizer_path)
    rng = random.Random(1)
    noise = ["".join(rng.choice("abeht .,\n'1€é漢😀 ") for _ in range(rng.randint(0, 40))) for _ in range(600)]
    for text in AWKWARD + noise:
        ids = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(mine.encode(text), "<u4").tolist()
        assert got == ids, text
        assert mine.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_caches_stay_bounded(tokenizer_path, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    mine = bpe.HeapBpe(tokenizer_path)
    text = " ".join(f"word{i}" for i in range(50))
    first = mine.encode(text)
    assert mine.encode(text) == first
    assert len(mine.words) <= 5 and len(mine.pieces) <= 5


def test_roundtrip_rows(docs, clashing, empty, rows, library, tokenizer_path):
    def expected(r):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        return r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    want = [expected(r) for r in rows]
    assert same(bpe.roundtrip(docs, tokenizer_path).collect(), want)
    assert same(bpe.roundtrip(clashing, tokenizer_path).collect(), want)
    assert bpe.roundtrip(empty, tokenizer_path).count() == 0


def test_encoded_keeps_ids(docs, empty, rows, library, tokenizer_path):
    got = bpe.encoded(docs, tokenizer_path).collect()
    assert len(got) == len(rows) and all(r.exact and r.n_tokens == len(r.ids) for r in got)
    by = {r.doc_id: r.ids for r in got if r.doc_id is not None}
    assert all(by[r[0]] == library.encode(r[1] or "", add_special_tokens=False).ids for r in rows if r[0] is not None)
    assert bpe.encoded(empty, tokenizer_path).count() == 0


def test_library_encoder_equals_whole_texts(tokenizer_path):
    lib = tokenstore.LibraryEncoder(tokenizer_path)
    for _ in range(3):
        assert lib.encode(AWKWARD) == lib.whole(AWKWARD)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash_is_minimal(n):
    keys = tokenstore.mix(np.arange(n, dtype="u8"))
    assert sorted(tokenstore.PerfectHash.build(keys).slots(keys).tolist()) == list(range(n))


#: The key whose hash a null key once shared.
ONCE_NULL = 7641188430210629341


def readers(index, ids=b""):
    """A keyed reader over an index in memory, and the sizes of its reads."""
    data, sizes = index.dump(), []

    def of(data):
        def read(start, size):
            sizes.append(size)
            return data[start : start + size]

        return read

    return tokenstore.KeyedReader(of(data), of(ids)), sizes


def test_index_finds_keys_and_rejects_others():
    keys = np.array([0, 0, -5, -5, 7, 7, 7, 1 << 40, ONCE_NULL], "i8")
    null = np.array([True, True, *[False] * 7])
    index = tokenstore.ShardIndex.load(tokenstore.ShardIndex.build(keys, null, np.arange(1, 10)).dump())
    first, run = index.find(np.array([0, 0, -5, 7, 1 << 40, ONCE_NULL]), np.array([True, *[False] * 5]))
    assert first.tolist() == [0, -1, 2, 4, 7, 8] and run.tolist() == [2, 0, 2, 3, 1, 1]
    foreign = np.arange(100, 4100)
    assert (index.find(foreign, np.zeros(4000, bool))[0] >= 0).sum() == 0
    assert index.starts.tolist() == [0, 1, 3, 6, 10, 15, 21, 28, 36, 45]
    one, _ = readers(index)
    assert [one.find(k) for k in (None, 0, -5, 7, 1 << 40, ONCE_NULL, 99)] == [(0, 2), (-1, 0), (2, 2), (4, 3), (7, 1), (8, 1), (-1, 0)]


def test_an_equal_fingerprint_is_no_hit(monkeypatch):
    monkeypatch.setattr(tokenstore, "fingerprints", lambda hashes: np.zeros(len(hashes), "<u4"))
    index = tokenstore.ShardIndex.build(np.arange(0, 600, 2), np.zeros(300, bool), np.ones(300, "i8"))
    asked = np.arange(600)
    assert (index.find(asked, np.zeros(600, bool))[0] >= 0).tolist() == (asked % 2 == 0).tolist()
    one, _ = readers(index)
    assert [one.find(k)[1] for k in range(40)] == [1, 0] * 20


def test_equal_hashes_end():
    with pytest.raises(ValueError):
        tokenstore.PerfectHash.build(np.array([5, 5], "u8"))


def test_a_keyed_read_costs_the_same_in_every_shard():
    """Bytes of the index that 200 reads take, whatever the number of documents; and the same answers as in memory."""
    cost = {}
    for n in (1_000, 100_000):
        keys = np.arange(n) * 3
        index = tokenstore.ShardIndex.build(keys, np.zeros(n, bool), np.full(n, 2), 2)
        one, sizes = readers(index, np.arange(2 * n, dtype="<u4").astype("<u2").tobytes())
        sizes.clear()
        for k in range(0, 600, 3):
            ((start, ids),) = one.documents(k)
            assert start == 2 * k // 3 and ids.tolist() == [start, start + 1]
        cost[n] = sum(sizes), max(sizes)
        assert one.documents(1) == []
    assert abs(cost[100_000][0] / cost[1_000][0] - 1) < 0.3 and cost[100_000][1] == cost[1_000][1] == 72


def test_store_rows(spark, docs, clashing, empty, rows, library, tokenizer_path):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for table in (docs, clashing):
        manifest = tokenstore.write_store(table, tokenizer_path, 2)
        got = tokenstore.read_store(spark, manifest).collect()
        assert sum(m.n_docs for m in manifest) == len(rows)
        # starts: ids of all documents before, whatever the order of equal keys
        by_start = sorted(got, key=lambda r: r.start)
        assert [r.doc_id for r in by_start] == [r[0] for r in order]
        assert by_start[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(by_start, by_start[1:]))
        want = []
        for r in rows:
            ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((r[0], len(ids), zlib.crc32(ids.tobytes())))
        assert same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], want)
    assert tokenstore.write_store(empty, tokenizer_path, 2) == []
    assert tokenstore.read_store(spark, []).count() == 0


def test_lookup_by_key(spark, docs, rows, library, tokenizer_path):
    big = (1 << 53) + 1  # beyond what a double tells apart
    docs = docs.union(spark.createDataFrame([(big, "big", None, None, 3), (big - 1, "less", None, None, 4), (ONCE_NULL, "hashed", None, None, 6)], docs.schema))
    rows = [*rows, (big, "big"), (big - 1, "less"), (ONCE_NULL, "hashed")]
    manifest = tokenstore.write_store(docs, tokenizer_path, 2)
    asked = spark.createDataFrame([(3,), (7,), (7,), (999,), (-4,), (None,), (big,), (ONCE_NULL,)], "doc_id long")
    got = tokenstore.lookup(asked, manifest).collect()
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    want = [(r[0], ids(r[1])) for r in rows if r[0] in (3, 7, None, big, ONCE_NULL)]
    assert same([(r.doc_id, r.ids) for r in got], want)


# --- media


def test_netpbm_formats():
    gray = np.arange(12, dtype="u1").reshape(3, 4)
    p5 = b"P5\n# comment\n4 3\n255\n" + gray.tobytes()
    assert (media.decode(p5)[..., 0] == gray).all()
    p2 = b"P2 4 3 255\n" + b" ".join(str(v).encode() for v in gray.ravel())
    assert (media.decode(p2)[..., 0] == gray).all()
    colour = np.arange(24, dtype="u1").reshape(2, 4, 3)
    assert (media.decode(b"P6 4 2 255\n" + colour.tobytes()) == colour).all()
    p3 = b"P3\n4 2\n255\n" + b"\n".join(str(v).encode() for v in colour.ravel())
    assert (media.decode(p3) == colour).all()
    p1 = b"P1\n3 2\n1 0 1\n010\n"
    assert (media.decode(p1)[..., 0] == 255 * (1 - np.array([[1, 0, 1], [0, 1, 0]]))).all()
    p4 = b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])
    assert (media.decode(p4) == media.decode(p1)).all()
    wide = np.array([[0, 65535]], ">u2")
    assert media.decode(b"P5 2 1 65535\n" + wide.tobytes())[..., 0].tolist() == [[0, 255]]


def bmp(image, depth, flip=1):
    import struct

    h, w = image.shape[:2]
    stride = -(-w * depth // 32) * 4
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256)) if depth == 8 else b""
    lines = [image[y].tobytes().ljust(stride, b"\0") for y in range(h)]
    raster = b"".join(lines[::-1] if flip > 0 else lines)
    at = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", at + len(raster), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, flip * h, 1, depth, 0, len(raster), 0, 0, 256 if depth == 8 else 0, 0) + palette + raster


def test_bmp_formats():
    rng = np.random.default_rng(2)
    for channels, depth in ((1, 8), (3, 24), (4, 32)):
        image = rng.integers(0, 256, (5, 3, channels), dtype="u1")
        for flip in (1, -1):
            got = media.decode(bmp(image, depth, flip))
            want = np.repeat(image, 3, axis=2) if channels == 1 else image[:, :, 2::-1]
            assert (got == want).all()


def test_area_resize_against_supersampling():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (6, 10)).astype("f8")
    h, w = 4, 7
    big = np.kron(image, np.ones((h, w)))  # each pixel as h x w, so that areas are whole
    want = big.reshape(h, 6, w, 10).mean(axis=(1, 3))
    assert np.allclose(media.resize(media.integral(image), h, w), want)


def test_payload_rows(docs, clashing, empty, rows):
    def expected(r):
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        return r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])

    for table in (docs, clashing):
        got = media.of_payloads(table).collect()
        assert same([tuple(r)[:5] for r in got], [expected(r) for r in rows])
        values = {}
        for r in got:  # equal payloads, equal values
            assert values.setdefault(r.payload_sha256, tuple(r)[5:]) == tuple(r)[5:]
        assert all(r.media_bytes > r.payload_bytes and len(r.feature) == 32 and bytes(r.tile_npy[:6]) == b"\x93NUMPY" for r in got)
    assert media.of_payloads(empty).count() == 0


def test_features_of_other_images(spark):
    flat = b"P5 4 4 255\n" + bytes([9] * 16)
    got = media.features(spark.createDataFrame([(1, bytearray(flat)), (2, bytearray(b"junk")), (3, None)], "id int, media binary")).collect()
    by = {r.id: r for r in got}
    assert by[1].feature == "0" * 32 and by[2].feature is None and by[3].tile_npy is None


def test_broken_and_empty_images(spark):
    import struct

    head = lambda w, h, depth=24: b"BM" + struct.pack("<IHHI", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, depth, 0, 0, 0, 0, 0, 0)
    broken = [
        b"", b"P", b"P5", b"P5 0 0 255\n", b"P5 0 3 255\n", b"P5 2 2 0\n\0\0\0\0", b"P5 2 2 255\n\0", b"P5 2 2 99999\n" + b"\0" * 8, b"P2 2 1 255\n1 x", b"P2 1 1 7\n9", b"P1 0 0\n", b"P4 0 1\n",
        b"P9 1 1 255\n\0", b"P1 2 2\n1", b"\xff\xfe junk", b"BM", b"BM" + b"\0" * 60, head(0, 0), head(2, 2), head(-3, 2), head(1, 1, 16), head(1 << 30, 1 << 30), b"P5 99999999999999999999 9 255\n",
    ]
    for data in broken:
        with pytest.raises(ValueError):
            media.decode(data)
    got = media.features(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(broken)], "id int, media binary")).collect()
    assert len(got) == len(broken) and all(r.tile_npy is None and r.feature is None for r in got)
    assert media.decode(b"P5 1 1 3\n\x03").tolist() == [[[255]]]
