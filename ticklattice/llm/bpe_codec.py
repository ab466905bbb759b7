"""Operator 4, byte-level BPE encoding and decoding by overlapping chunks that are stitched where pre-tokens resynchronise."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklattice.llm._util import map_text, read_asset

#: No match of the pattern looks further behind its start, and none needs more than this many characters past its end.
LOOKAHEAD = 3
_LOADED: dict[tuple, tuple] = {}


def load_ranks(ranks: bytes, pattern: str):
    """(tiktoken encoding, compiled pattern), kept for the life of the Python worker."""
    if (key := (hash(ranks), pattern)) not in _LOADED:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        enc = tiktoken.Encoding("ticklattice", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        _LOADED[key] = enc, regex.compile(pattern)
    return _LOADED[key]


def chunk_ends(pattern, text: str, start: int, stop: int) -> list[int]:
    """Ends of the pre-tokens that a scan from `start` finds, as far as they can't depend on what follows `stop`."""
    ends = [m.end() for m in pattern.finditer(text, start, stop, concurrent=True)]
    if stop < len(text):
        while ends and ends[-1] > stop - LOOKAHEAD:
            ends.pop()
    return ends


def stitch(pattern, text: str, chunk: int, overlap: int, pool: ThreadPoolExecutor | None = None) -> list[int]:
    """Cuts 0 .. len(text) that are true pre-token boundaries of the whole text.

    Chunks are scanned independently, each over its own characters and `overlap` more. A scan depends only on the place
    it starts from, so once two neighbouring scans share a boundary all later ones agree: the first shared boundary past
    the border is a true one. Where none is shared, the left scan goes on with a doubled overlap until it meets the
    right one or swallows it. A cut never follows white space: the pattern looks one character past a run of it, so the
    piece alone would be split otherwise.
    """
    n = len(text)
    starts = range(0, n, chunk)
    if len(starts) < 2:
        return [0, n]
    stops = [min(n, s + chunk + overlap) for s in starts]
    found = list((pool.map if pool else map)(lambda x: chunk_ends(pattern, text, *x), zip(starts, stops, strict=True)))
    cuts, left, stop = [0], found[0], stops[0]
    for s, right, right_stop in zip(starts[1:], found[1:], stops[1:], strict=True):
        theirs, step = set(right), overlap
        while True:
            if cut := next((p for p in left if p > max(s, cuts[-1]) and p in theirs and not text[p - 1].isspace()), 0):
                cuts.append(cut)
                left, stop = right, right_stop
                break
            if stop >= right_stop:  # the left scan has swallowed this chunk
                break
            step *= 2
            stop = min(n, stop + step)
            left = chunk_ends(pattern, text, cuts[-1], stop)
    return [*cuts, n] if cuts[-1] < n else cuts


def bpe_codec(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    output: Sequence[str] = ("n_tokens", "ids_sha256", "decoded_sha256"),
    chunk: int = 1 << 14,
    overlap: int = 1 << 9,
    threads: int = 2,
) -> DataFrame:
    """`keep` columns with the asked `output` columns for every row's whole text (null: empty).

    ids (array of int) by the ranks, each pre-token merged alone and no special tokens; n_tokens; ids_sha256 of the
    decimal ids joined by a space; decoded (binary: the ids' bytes put together, equal to the text's UTF-8) and
    decoded_sha256. An empty text has no ids and the digests of nothing; repeated rows repeat their result; an empty
    table gives an empty one. The chunks of a longer text are pre-tokenised by `threads` at once; the pattern's scan holds no
    interpreter lock. A kept column named like an output is replaced.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_asset(ranks_path))
    kinds = {
        "ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(),
        "decoded": T.BinaryType(), "decoded_sha256": T.StringType(),
    }
    want = list(output)

    def factory():
        enc, pat = load_ranks(spec.value, pattern)
        names = [str(i) for i in range(enc.max_token_value + 1)]
        pool = ThreadPoolExecutor(threads) if threads > 1 else None

        def code(texts: list[str]):
            out: dict[str, list] = {k: [] for k in want}
            for text in texts:
                cuts = stitch(pat, text, chunk, overlap, pool)
                ids: list[int] = []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    ids += enc.encode_ordinary(text[a:b])
                raw = enc.decode_bytes(ids) if "decoded" in out or "decoded_sha256" in out else b""
                for k in want:
                    if k == "ids":
                        out[k].append(ids)
                    elif k == "n_tokens":
                        out[k].append(len(ids))
                    elif k == "ids_sha256":
                        out[k].append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                    elif k == "decoded":
                        out[k].append(raw)
                    else:
                        out[k].append(hashlib.sha256(raw).hexdigest())
            return [out[k] for k in want]

        return code

    return map_text(docs, text_col, keep, [(k, kinds[k]) for k in want], factory)


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str, *, ids_col: str = "ids") -> DataFrame:
    """encoded with `decoded`, the bytes of the ids put together (null ids: no bytes)."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_asset(ranks_path))

    @F.pandas_udf(T.BinaryType(), F.PandasUDFType.SCALAR)
    def decode(ids):
        enc, _ = load_ranks(spec.value, pattern)
        return ids.map(lambda x: b"" if x is None else enc.decode_bytes([int(i) for i in x]))

    return encoded.withColumn("decoded", decode(F.col(ids_col)))
