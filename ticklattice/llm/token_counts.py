"""Operator 1, token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ticklattice.llm._util import map_text, read_asset

#: A space between a word's end and a word's start. Neither the byte-level pattern nor an added token without spaces can
#: span it, and the space always opens the next pre-token, so the ids of the two sides simply follow each other.
SAFE = re.compile(r"(?<=[\w.,;:!?])\x20(?=\w)")
_LOADED: dict[int, object] = {}


def load_tokenizer(spec: bytes):
    """The tokenizer of a .json specification, kept for the life of the Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (key := hash(spec)) not in _LOADED:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(spec.decode())
        tok.no_truncation()
        tok.no_padding()
        _LOADED[key] = tok
    return _LOADED[key]


def safe_pieces(text: str, limit: int) -> list[str]:
    """text in pieces of about `limit` characters that are encoded apart to the same ids; longer where no safe boundary is."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit and (m := SAFE.search(text, at + limit)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def balanced(sizes: Sequence[int], limit: int) -> Iterator[range]:
    """Runs of consecutive indexes whose sizes sum to about `limit`; a larger one stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield range(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield range(start, len(sizes))


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    limit: int = 1024,
    batch_bytes: int = 1 << 20,
    split_chars: int = 1 << 15,
) -> DataFrame:
    """`keep` columns with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for every row.

    Whole texts count, without begin, end or added special tokens; special strings in a text are treated as the
    tokenizer file says. Null and empty texts give 0, 0, false; repeated rows are counted each; an empty table gives an
    empty result; other columns are ignored. Long texts are cut at safe boundaries and batches hold about batch_bytes,
    so memory does not follow the longest text.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_asset(tokenizer_path))

    def factory():
        tok = load_tokenizer(spec.value)

        def count(texts: list[str]):
            pieces, owner = [], []
            for i, t in enumerate(texts):
                for p in safe_pieces(t, split_chars):
                    pieces.append(p)
                    owner.append(i)
            lengths = np.zeros(len(pieces), np.int64)
            for run in balanced([len(p) for p in pieces], batch_bytes):
                got = tok.encode_batch_fast([pieces[i] for i in run], add_special_tokens=False)
                lengths[run.start : run.stop] = [len(x) for x in got]
            n = np.bincount(owner, weights=lengths, minlength=len(texts)).astype(np.int64)
            return [len(t.encode()) for t in texts], n.tolist(), (n > limit).tolist()

        return count

    fields = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    return map_text(docs, text_col, keep, fields, factory)
