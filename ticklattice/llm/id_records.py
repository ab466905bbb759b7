"""Operator 10, token-ID output: length-delimited binary records with masked checksums, and an offset index beside them.

A shard file is a run of frames, one a document, in ascending order of id:

    8 bytes   length of the body
    4 bytes   masked CRC-32 of those 8 bytes
    body      8 bytes document id (signed), 1 byte flags (1: null id, 2: wide), then the ids, 4 bytes each if wide, else 2
    4 bytes   masked CRC-32 of the body
    1 byte    line feed, with which the writer ends every record

All numbers are little-endian. The index is a Parquet table: shard, record, offset, body_bytes, doc_id, start, n_tokens.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklattice.llm._util import read_asset, shared_dir, slices
from ticklattice.llm.token_counts import balanced, load_tokenizer, safe_pieces

# Fixed value: the pattern of byte-level pre-tokenisers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FRAME = struct.Struct("<QI")
BODY = struct.Struct("<qB")
END = struct.Struct("<I")


def masked(crc: int) -> int:
    """The checksum rotated right by 15 bits plus a constant, so that a checksum of data with checksums stays useful."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """The frame of a document's ids (unsigned); two bytes an id where the array's type says so."""
    wide = ids.itemsize == 4
    body = BODY.pack(doc_id or 0, (doc_id is None) + 2 * wide) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = struct.pack("<Q", len(body))
    return b"".join((size, struct.pack("<I", masked(zlib.crc32(size))), body, END.pack(masked(zlib.crc32(body)))))


def frames(data: memoryview) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, body length, document id, ids as 4-byte integers) of each frame of a shard; ValueError where a checksum does not hold."""
    at = 0
    while at < len(data):
        size, crc = FRAME.unpack_from(data, at)
        if masked(zlib.crc32(data[at : at + 8])) != crc:
            raise ValueError(f"the length at byte {at} is damaged")
        start = at + FRAME.size
        body = data[start : start + size]
        if len(body) < size or masked(zlib.crc32(body)) != END.unpack_from(data, start + size)[0]:
            raise ValueError(f"the record at byte {at} is damaged")
        doc_id, flags = BODY.unpack_from(body, 0)
        yield at, size, None if flags & 1 else doc_id, np.frombuffer(body[BODY.size :], "<u4" if flags & 2 else "<u2").astype("<u4")
        at = start + size + END.size + 1


def doubtful() -> list[int]:
    """Bounds of the runs of code points that two libraries of different Unicode versions may class apart (as letter, number,
    white space or other): those that are unassigned now or that changed their class since Unicode 3.2. A code point is in a
    run if bisect_right gives an odd place."""
    import unicodedata

    import regex

    code = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    every = "".join(map(chr, code.tolist()))
    now = np.zeros(0x110000, np.uint8)
    for k, kind in enumerate((r"\p{L}", r"\p{N}", r"\s", r"\p{Cn}"), 1):
        now[[ord(c) for c in regex.findall(kind, every)]] = k
    kinds = {"L": 1, "N": 2, "Z": 3}
    then = np.fromiter((kinds.get(x[0], 0) for x in map(unicodedata.ucd_3_2_0.category, every)), np.uint8, len(every))
    odd = np.zeros(0x110001, np.int8)
    odd[code] = now[code] != then
    odd[[9, 10, 11, 12, 13, 0x85]] = 0  # white space that is no separator
    return np.flatnonzero(np.diff(odd, prepend=0)).tolist()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others in their order
    for those from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory:
    """key -> bytes in two generations of `size` keys or little more: what is not met for a whole generation is forgotten."""

    def __init__(self, size: int):
        self.size = size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}

    def get(self, key: str) -> bytes | None:
        if (x := self.new.get(key)) is None and (x := self.old.get(key)) is not None:
            self.new[key] = x
        return x


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """While it lasts, Arrow batches of so many rows, so that a task holds some MB of texts at once instead of some ten."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Chunks whose ids are put in order at once.
GATHERED = 1 << 17


def give_back() -> None:
    """Gives memory that is free back to the system, where the C library and Arrow's allocator can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class IdEncoder:
    """The ids of texts as the tokenizers library gives them, two bytes an id if the vocabulary allows, else four.

    Byte-level BPE encodes every match of PATTERN by itself, and a single space between other characters than white space
    always begins a match. So texts fall into chunks at such spaces, chunks into matches, and the library's model encodes
    matches; the ids of both are remembered, for the life of the worker. A batch's chunks are told apart and their ids put in order
    by array operations. Texts with other white space beside a space, added tokens or code points that may be classed apart
    go through the library whole, long ones in pieces cut at safe boundaries; so do all if the tokenizer is of another
    make."""

    GENERATION = 200_000

    def __init__(self, spec: bytes, bounds: Sequence[int]):
        import regex

        self.tok, self.bounds = load_tokenizer(spec), list(bounds)
        self.model = self.tok.model
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        make = json.loads(spec)
        pre, model = make.get("pre_tokenizer") or {}, make["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.apart = plain and model.get("type") == "BPE" and not model.get("dropout") and not make.get("normalizer")
        self.added = [t["content"] for t in make.get("added_tokens") or []]
        self.matches = regex.compile(PATTERN).findall
        self.letters = byte_letters()
        self.sure = frozenset(chr(c) for c in range(0x2000) if not bisect_right(self.bounds, c) & 1)  # most of what is met
        self.space = self.letters[32]
        self.names = [i.to_bytes(self.kind.itemsize, "little") for i in range(self.tok.get_vocab_size())]
        self.chunks, self.firsts = Memory(self.GENERATION), Memory(self.GENERATION // 4)  # behind a space, and not

    def __call__(self, texts: pa.Array | Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the place after each text's last."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.apart or not len(texts):
            return self._joined(self._whole(texts.to_pylist()))
        split = pc.split_pattern(texts, " ")
        at, values = split.offsets.to_numpy(), split.values
        coded = values.dictionary_encode()
        begin = at[:-1]
        ids = self._known(self.chunks, coded.dictionary.to_pylist(), " ") + self._known(self.firsts, values.take(pa.array(begin)).to_pylist(), "")
        index = coded.indices.to_numpy().astype(np.int32)
        index[begin] = len(coded.dictionary) + np.arange(len(begin))  # a text's first chunk has no space before it
        del split, values, coded
        size = np.fromiter((-1 if x is None else len(x) for x in ids), np.int32, len(ids)) // self.kind.itemsize
        table = np.frombuffer(b"".join([x for x in ids if x]), self.kind)
        odd = np.add.reduceat(size[index] < 0, begin) > 0
        for t in self.added:
            odd |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        size = np.maximum(size, 0)
        begins, count = np.cumsum(size) - size, size[index]
        ends = np.cumsum(count, dtype=np.int64)
        out = np.empty(int(ends[-1]), self.kind)
        for i in range(0, len(index), GATHERED):
            own, n = index[i : i + GATHERED], count[i : i + GATHERED]
            stop = np.cumsum(n)
            place = np.repeat(begins[own] - (stop - n), n)
            place += np.arange(len(place))
            out[int(ends[i]) - int(n[0]) :][: len(place)] = table[place]
        last = ends[at[1:] - 1]
        if not odd.any():
            return out, last
        which = np.flatnonzero(odd)
        whole = dict(zip(which.tolist(), self._whole(texts.take(pa.array(which)).to_pylist()), strict=True))
        return self._joined([whole.get(i, out[a:b]) for i, (a, b) in enumerate(zip([0, *last[:-1].tolist()], last.tolist(), strict=True))])

    @staticmethod
    def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16), np.cumsum([len(x) for x in parts], dtype=np.int64)

    def _whole(self, texts: Sequence[str], split_chars: int = 1 << 15, batch_bytes: int = 1 << 18) -> list[np.ndarray]:
        pieces, owner = [], []
        for i, t in enumerate(texts):
            for p in safe_pieces(t, split_chars):
                pieces.append(p)
                owner.append(i)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for run in balanced([len(p) for p in pieces], batch_bytes):
            for i, e in zip(run, self.tok.encode_batch_fast(pieces[run.start : run.stop], add_special_tokens=False), strict=True):
                out[owner[i]].append(np.array(e.ids, self.kind))
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _known(self, memory: Memory, chunks: list[str], lead: str) -> list[bytes | None]:
        """The ids of the chunks with `lead` before them; None of those that can't be encoded by themselves."""
        memory.turn()
        new, old = memory.new, memory.old
        out = list(map(new.get, chunks))
        lacking = [i for i, x in enumerate(out) if x is None]
        words = [chunks[i] for i in lacking]
        for i, c, x in zip(lacking, words, map(old.get, words), strict=True):
            if x is None and self._alone(c):
                x = self._ids(lead + c) if c.isalpha() else b"".join([self._match(m) for m in self.matches(lead + c)])
            if x is not None:
                out[i] = new[c] = x
        return out

    def _alone(self, chunk: str) -> bool:
        """Whether a chunk can't join what stands around it, and has no doubtful code point. An empty one stands beside another
        space, or is a whole text."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return False
        return chunk.isascii() or self.sure.issuperset(chunk) or not any(bisect_right(self.bounds, ord(c)) & 1 for c in chunk)

    def _match(self, match: str) -> bytes:
        memory, key = (self.chunks, match[1:]) if match[0] == " " and len(match) > 1 else (self.firsts, match)
        if (x := memory.get(key)) is None:
            x = memory.new[key] = self._ids(match)
        return x

    def _ids(self, match: str) -> bytes:
        letters = match.replace(" ", self.space) if match.isascii() and match.isprintable() else match.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.names[t.id] for t in self.model.tokenize(letters)])


_ENCODERS: dict[int, IdEncoder] = {}


def load_encoder(spec: bytes, bounds: Sequence[int]) -> IdEncoder:
    """The encoder of a .json specification, kept for the life of the Python worker."""
    if (key := hash(spec)) not in _ENCODERS:
        _ENCODERS[key] = IdEncoder(spec, bounds)
    return _ENCODERS[key]


def write_id_records(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    *,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = 16 << 20,
) -> None:
    """Writes the shards of docs to path/records, reads them back, and writes their index to path/index.

    Documents are dealt out by ranges of their id into files of about shard_bytes of text each, so each follows the one
    before it and a reader that holds a file whole needs some tens of MB, however large the corpus. Ids are integers. Null
    texts count as empty (the end id alone); null ids come first and are flagged; equal ids stand in the order of a hash of
    their texts, and may lie in several shards; other columns are ignored; an empty table gives an empty index. Spark's text
    writer puts the frames down as they are, on any file system and under its commit protocol, so a lost executor's task
    leaves nothing half-written.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast((read_asset(tokenizer_path), doubtful()))
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tie = F.xxhash64("text")
    dealt = src.repartitionByRange(max(1, -(-size // shard_bytes)), F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, F.col("text"))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(*spec.value)
        end = encode.kind.type(end_id)
        for big in batches:
            for b in slices(big, 1, 12 << 20):
                ids, ends = encode(b.column(1))
                parts = zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)
                rows = [frame(i, np.append(ids[a:z], end)) for i, (a, z) in zip(b.column(0).to_pylist(), parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])
                del ids, ends, parts, rows, b
        give_back()

    with small_batches(spark):
        dealt.mapInArrow(framed, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(f"{path}/records")
    scanned = _scan(spark, f"{path}/records")
    scanned.write.parquet(f"{path}/scan")
    rows = spark.read.schema(scanned.schema).parquet(f"{path}/scan")
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    base = sums.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows.join(base, "shard").select(
        "shard", "record", "offset", "body_bytes", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    ).write.parquet(f"{path}/index")


def _scan(spark: SparkSession, records: str) -> DataFrame:
    """A row a frame, read from the files, with the number of ids before it in its shard."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(records)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "record", "offset", "body_bytes", "doc_id", "before", "n_tokens", "ids_crc32"]
        types = [pa.int32(), *[pa.int64()] * 7]
        for b in batches:
            for where, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard, before, rows = int(re.search(r"part-(\d+)", where)[1]), 0, []
                for k, (at, size, doc_id, ids) in enumerate(frames(memoryview(content.as_buffer()))):
                    rows.append((shard, k, at, size, doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(
        parse, "shard int, record long, offset long, body_bytes long, doc_id long, before long, n_tokens long, ids_crc32 long"
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, as the writer found them when it read its files back and verified every checksum: shard, record,
    offset, body_bytes, doc_id, start (ids before it in the whole output), n_tokens, ids_crc32. Rows come in no order; an
    empty output has none."""
    return spark.read.parquet(f"{path}/index")


def record_at(stream, at: int, size: int) -> tuple[int | None, np.ndarray]:
    """Document id and ids of the frame whose body of that size begins after the header at byte `at`."""
    stream.seek(at)
    ((_, _, doc_id, ids),) = frames(memoryview(stream.read(FRAME.size + size + END.size + 1)))
    return doc_id, ids.astype(np.int32)


#: Schemes of paths that a worker can open and seek in by itself; shards elsewhere are read whole.
SEEKABLE = ("file", "hdfs")


def read_records(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id and ids (array of int) of the records, checksums verified; of those whose shard and offset `wanted` names (rows
    of the index, say a shuffled part of it), or all. Wanted records are read by seeking to their offsets; all, or those of a
    store that only Spark opens, from whole shards."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    shard = F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard")
    names, kinds = ["shard", "offset", "doc_id", "ids"], [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    schema = "shard int, offset long, doc_id long, ids array<int>"

    def batch(got: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*got, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield batch([(n, at, i, x.astype(np.int32)) for at, _, i, x in frames(memoryview(content.as_buffer()))])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        opened, stream = None, None
        for b in batches:
            got = []
            for where, n, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if where != opened:
                    fs, inner = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", where))
                    opened, stream = where, fs.open_input_file(inner)
                got.append((n, at, *record_at(stream, at, size)))
            yield batch(got)

    if wanted is None:
        return files.select(shard, "content").mapInArrow(parse, schema).select("doc_id", "ids")
    if path.split(":", 1)[0] not in SEEKABLE:
        return files.select(shard, "content").mapInArrow(parse, schema).join(wanted.select("shard", "offset"), ["shard", "offset"], "left_semi").select("doc_id", "ids")
    places = wanted.select("shard", "offset", "body_bytes").join(files.select("path", shard), "shard").select("path", "shard", "offset", "body_bytes")
    return places.sortWithinPartitions("path", "offset").mapInArrow(seek, schema).select("doc_id", "ids")


def new_output(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ticklattice/ids-{uuid.uuid4().hex}"
