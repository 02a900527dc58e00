"""Small awkward tables for the training-data operators."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

#: Further columns whose names clash with operators' own or differ in case only.
CLASHING = ["TEXT", "size", "h", "rid", "n", "key", "llr", "start", "DOC_ID"]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(words) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def rows(prose):
    """(doc_id, text, lang, source, n_chars): nulls, empties, white space, long texts, repeated rows, near copies."""
    base = prose(1, 60)
    texts = [
        None, "", " \t\n ", "one two", "one two", "ONE TWO", "one two three four five", base, base, base + " extra", "start " + base, base.upper(), prose(2, 60),
        prose(3, 6000), "x" * 20_000, "a  b\n\n\tc  d e   f", "naïve café 漢字 😀 é x", "It's <|endoftext|> here", "password: hunter22secret token=ab", "12345 67890 !!! ???",
    ]
    out = [(i, t, None if i % 7 == 3 else "ab"[i % 2], None if i % 5 == 4 else f"s{i % 3}", None if i == 6 else len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[7], (None, base, "a", "s0", 9), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *(["zz"] * len(CLASHING))) for r in rows], f"{SCHEMA}, {extra}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="session")
def ranks_path():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def same(a, b):
    """Equal rows in any order, also with nulls."""
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)
