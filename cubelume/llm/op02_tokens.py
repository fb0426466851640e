"""Token counts, with overlap resynchronisation for huge documents.

A document longer than `chunk` characters is encoded in chunks that overlap, with offsets. Two neighbours are spliced at
a place in their overlap that is proven to be a token boundary of the whole text: after a letter, digit or ASCII sign and
before a blank. No piece of the pre-tokeniser's pattern holds such a place inside, and none looks back over it, so that
what stands left of it is split as in the whole text by the left chunk and what stands right of it by the right one.
The place counts only if both encodings have a boundary there; if none is found, the overlap is doubled, up to joining
the chunks. So any text, even one without blanks, gets the counts of its whole encoding, in memory that is bounded unless
the text has no blank for long stretches.

Defined results: null text is the empty text with 0 tokens; special strings in texts are taken as the library takes them
by default; repeated rows and further columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, slices, table

CHUNK = 32_768
OVERLAP = 512
LIMIT = 512
VOCABULARY = "byte_bpe_50k.json"
_SIGNS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: Pieces of text a worker remembers; beyond it, it starts anew (about 150 B each).
REMEMBERED = 800_000
_BLANKS = re.compile(r"\s\s")
_loaded: dict[str, object] = {}
_known: dict[str, dict[str, int]] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """One instance for each worker, on one thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def stable(text: str, p: int) -> bool:
    """Whether every encoding of this text has a token boundary at p."""
    return text[p] in " \n\t\r" and (text[p - 1].isalnum() or text[p - 1] in _SIGNS)


class _Chunk:
    """The encoding of text[a:b]: ends of tokens as places in the text."""

    def __init__(self, tok, text: str, a: int, b: int) -> None:
        self.a, self.b = a, b
        self.ends = [a + e for _, e in tok.encode(text[a:b], add_special_tokens=False).offsets]

    def upto(self, p: int) -> int:
        return bisect_right(self.ends, p)

    def bounds(self, p: int) -> bool:
        n = self.upto(p)
        return n > 0 and self.ends[n - 1] == p


def splice(text: str, left: _Chunk, right: _Chunk) -> int | None:
    """A place in the overlap where both encodings are that of the whole text; the one nearest to its middle."""
    low, high = right.a + 1, left.b - 1
    middle = (low + high) // 2
    for d in range(max(middle - low, high - middle) + 1):
        for p in (middle - d, middle + d) if d else (middle,):
            if low <= p < high and stable(text, p) and left.bounds(p) and right.bounds(p):
                return p
    return None


def count_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text longer than a chunk."""
    n, start, left = 0, 0, _Chunk(tok, text, 0, min(chunk, len(text)))
    while left.b < len(text):
        wide = overlap
        while True:
            a, b = left.b - wide, min(left.b + chunk, len(text))
            if a <= max(left.a, start):  # no place found in all of the chunk: it is encoded anew at twice its length
                left = _Chunk(tok, text, left.a, min(left.b + (left.b - left.a), len(text)))
                break
            right = _Chunk(tok, text, a, b)
            if (p := splice(text, left, right)) is not None and p > start:
                n += left.upto(p) - left.upto(start)
                start, left = p, right
                break
            wide *= 2
    return n + len(left.ends) - left.upto(start)


def _sizes(tok, texts: list[list[str]], known: dict[str, int]) -> None:
    """Puts the numbers of tokens of all pieces of the texts into known."""
    pieces = set().union(*texts)
    new = list(pieces.difference(known))
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = list(pieces)
    # letters and digits and a last full stop or comma are pieces of their own
    signed = [p for p in new if p[-1:] in (".", ",") and p[1:-1].isalnum() and (p[0] in " \n" or p[0].isalnum())]
    some = list({*new}.difference(signed).union(p[:-1] for p in signed).difference(known))
    for a in range(0, len(some), 20_000):
        part = some[a : a + 20_000]
        known.update(zip(part, map(len, tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))
    if signed:
        one = {x: len(tok.encode(x, add_special_tokens=False).ids) for x in ".,"}
        known.update([(p, known[p[:-1]] + one[p[-1]]) for p in signed])


def count_tokens(texts: list, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Long texts by count_long(); others by the pieces that begin at blanks and line feeds (each a stable place, so that a piece has
    as many tokens in any text), or whole if white space follows white space. All this is proven for VOCABULARY's pattern; with another
    file every text is encoded whole."""
    tok, known, out = tokenizer(path), _known.setdefault(path, {}), []
    if not path.endswith(VOCABULARY):
        return [n for a, b in slices(texts, 4_000_000) for n in map(len, tok.encode_batch_fast([t or "" for t in texts[a:b]], add_special_tokens=False))]
    for a, b in slices(texts, 4_000_000):
        short, whole = {}, {}
        for i in range(a, b):
            t = texts[i]
            if t and len(t) <= chunk:
                (whole if _BLANKS.search(t) else short)[i] = t
        pieces = {i: t.replace(" ", "\0 ").replace("\n", "\0\n").split("\0") for i, t in short.items() if "\0" not in t}
        whole |= {i: t for i, t in short.items() if i not in pieces}
        _sizes(tok, list(pieces.values()), known)
        n = {i: sum(map(known.__getitem__, p)) for i, p in pieces.items()}
        n |= zip(whole, map(len, tok.encode_batch_fast(list(whole.values()), add_special_tokens=False)), strict=True)
        out += [n[i] if i in n else count_long(tok, texts[i], chunk, overlap) if texts[i] else 0 for i in range(a, b)]
    return out


def token_counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens."""
    path = path or vocabulary_path()

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(count_tokens(s.tolist(), path, chunk, overlap), dtype="int64")

    text = F.coalesce(col(docs, "text"), F.lit(""))
    return docs.select(col(docs, "doc_id").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)


SQL: dict[str, str] = {}
QUERIES = {"op2_tokens": op2_tokens}
