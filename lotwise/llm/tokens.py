"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank file of the vocabulary; a parameter of everything that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, object] = {}
_ODD = re.compile(r"\s\s")


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


class Counter:
    """Counts tokens exactly, remembering what each space-separated piece comes to.

    The pattern never joins anything across a single space but the space itself with what follows,
    so the pieces between single spaces count independently; only where whitespace meets
    whitespace is a stretch encoded as a whole.
    """

    def __init__(self, path: str = VOCABULARY, most: int = 300_000):
        self.encode = _encoder(path).encode_ordinary
        self.known: dict[str, int] = {}
        self.most = most

    def count(self, text: str | None) -> int:
        """The tokens of a text; 0 for null and empty ones."""
        if not text:
            return 0
        if _ODD.search(text):
            return len(self.encode(text))
        head, *rest = text.split(" ")
        total = len(self.encode(head)) if head else 0
        known = self.known
        for piece in rest:
            n = known.get(piece)
            if n is None:
                if len(known) >= self.most:
                    known.clear()
                n = known[piece] = len(self.encode(" " + piece))
            total += n
        return total


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """The size of a text column in tokens, a bigint; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path)
        for texts in batches:
            yield texts.map(counter.count, na_action=None).astype("int64")

    return run(text)
