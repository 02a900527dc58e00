"""Secrets in texts: three patterns, and strings that a tokenizer's vocabulary covers badly.

Random strings need about one token for two characters where prose needs one
for four. A candidate is a run of 20 or more letters, digits and ``+/_=-``; it
counts as a secret (kind ``random``) when its characters per token fall below
``RATIO`` under a tiktoken vocabulary. In a run that does not, the parts
between separators are rated: neighbours that no well covered word stands
between count together, from 20 characters on, so that a path or a name before
a secret does not hide it.

Left out are known digests (hex of 32, 40, 56, 64, 96 or 128 digits), UUIDs,
digits with separators, and plain words, alone or joined by separators, with
up to three digits at their ends in all. Words are plain unless their
letters per token (in words of four letters or more, 12 letters at least, in
upper or lower case, whichever is better) fall below ``PLAIN``: long words of
other languages lie above it, random letters mostly below. What overlaps a
span of another kind is left out too. The ratio can't tell sequences like an
alphabet or bases of DNA from random letters.

Defined results: a null text counts as empty and has no span; null and
repeated ``doc_id`` values pass through, one row per input row; an empty table
gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from barleaf.llm.common import pick

KINDS = ("assign", "access", "hex", "random")
#: The patterns of the base kinds and the least length of what they capture.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"[0-9a-fA-F]+")
DIGEST_DIGITS = {32, 40, 56, 64, 96, 128}
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+")
WORD = r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})"
WORDS = re.compile(rf"[+/_=-]*{WORD}(?:[+/_=-]+{WORD})*[+/_=-]*")
#: Words with digits at their ends, as in utf8 or v2.
NUMBERED = re.compile(r"[+/_=-]*(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]*(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]*)*")
PART = re.compile(r"[A-Za-z0-9]+")
LETTERS = re.compile(r"[A-Za-z]{4,}")
RATIO, PLAIN, PLAIN_LETTERS, NUMBERED_DIGITS = 2.4, 2.05, 12, 3

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


class Vocabulary:
    """A tiktoken vocabulary by its file of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def tokens(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def ratio(self, text: str) -> float:
        return len(text) / self.tokens(text)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    from barleaf.llm.bpe import PRETOKEN

    return Vocabulary(path, PRETOKEN)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, leftmost and without overlap within a kind."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def plain(s: str, vocab: Vocabulary) -> bool:
    """Words, alone or joined by separators, that the vocabulary covers as words."""
    if WORDS.fullmatch(s) is None and (sum(map(str.isdigit, s)) > NUMBERED_DIGITS or NUMBERED.fullmatch(s) is None):
        return False
    words = LETTERS.findall(s)
    letters = sum(map(len, words))
    return letters < PLAIN_LETTERS or letters / sum(min(vocab.tokens(w), vocab.tokens(w.lower())) for w in words) >= PLAIN


def known(s: str, vocab: Vocabulary) -> bool:
    """A digest, an identifier or plain words."""
    return (len(s) in DIGEST_DIGITS and DIGEST.fullmatch(s) is not None) or IDENTIFIER.fullmatch(s) is not None or plain(s, vocab)


def parts(s: str, vocab: Vocabulary, ratio: float) -> Iterator[tuple[int, int]]:
    """(start, end) from one badly covered part to another, with no well covered part between them."""
    start = end = -1
    for m in PART.finditer(s):
        short = vocab.ratio(m[0]) >= ratio
        if not short and not plain(m[0], vocab):
            start, end = m.start() if start < 0 else start, m.end()
        elif short and start >= 0:
            yield start, end
            start = -1
    if start >= 0:
        yield start, end


def random_spans(text: str, taken: list[tuple[int, int, int]], vocab: Vocabulary, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    def counts(a: int, b: int) -> bool:
        return b - a >= LEAST and not any(x < b and a < y for x, _, y in taken) and not known(text[a:b], vocab) and vocab.ratio(text[a:b]) < ratio

    out = []
    for m in CANDIDATE.finditer(text):
        if counts(*m.span()):
            out.append((m.start(), 3, m.end()))
        else:
            out += [(m.start() + a, 3, m.start() + b) for a, b in parts(m[0], vocab, ratio) if counts(m.start() + a, m.start() + b)]
    return out


def all_spans(text: str, vocab: Vocabulary) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + random_spans(text, base, vocab))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Per document the counts and spans of its secrets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path)
        for batch in batches:
            counts, digest, spans = [[] for _ in KINDS], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                found = sorted(base + random_spans(text, base, vocab))
                for k, column in enumerate(counts):
                    column.append(sum(s[1] == k for s in found))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)


def redacted(text: str, vocab: Vocabulary, mark: str = "[secret]") -> str:
    """``text`` with the union of its spans replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in all_spans(text, vocab):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with secrets masked and n_chars counted anew; null texts stay null."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path)
        for batch in batches:
            text = [t if t is None else redacted(t, vocab) for t in batch.column("text").to_pylist()]
            n = [c if t is None else len(t) for t, c in zip(text, batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string()), batch.column("lang"), batch.column("source"), pa.array(n, pa.int64())], ["doc_id", "text", "lang", "source", "n_chars"])

    return pick(docs, doc_id="long", text="string", lang="string", source="string", n_chars="long").mapInArrow(run, schema)
