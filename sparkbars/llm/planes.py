"""Token ids as binary shards with plane shuffling.

A shard file is ``BPZ1``, chunks, an index and a footer. A chunk holds up to
CHUNK values of one array: the values' bytes (or bits) are transposed into
planes, so that equal positions lie together, and each plane is compressed
with zstandard. The index lists for every chunk its array, offset, number of
values and the planes' lengths, so that chunks can be read alone. Arrays:
``ids`` (uint32, all documents' ids in order), ``doc`` (int64), ``null``
(uint8: the document has no id of its own) and ``len`` (uint64).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ..session import scratch_path
from .common import filesystem

MAGIC = b"BPZ1"
CHUNK = 65536
END_ID = 0
#: UTF-8 bytes of text for one shard on average, and the most shards.
SHARD_BYTES = 32 << 20
MAX_SHARDS = 20_000
#: Words whose ids a worker remembers (and 16 times as many characters).
REMEMBERED = 1_000_000
#: Code points of texts that are split at once (a longer text alone).
GROUP_CHARS = 1 << 18


def to_planes(values: np.ndarray, bits: bool = False) -> list[bytes]:
    """Byte planes (or bit planes) of little-endian values."""
    rows = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    if bits:
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        return [np.packbits(p).tobytes() for p in rows.T]
    return [p.tobytes() for p in rows.T]


def from_planes(planes: list[bytes], n: int, dtype: np.dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    if len(planes) == width:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        rows = np.packbits(np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view(dtype).reshape(-1)


DTYPES = {"ids": np.dtype("<u4"), "doc": np.dtype("<i8"), "null": np.dtype("u1"), "len": np.dtype("<u8")}


class ShardWriter:
    def __init__(self, sink, bits: bool = False, level: int = 3):
        self.sink, self.bits, self.index, self.at = sink, bits, [], len(MAGIC)
        self.held = {k: bytearray() for k in DTYPES}
        self.zip = zstandard.ZstdCompressor(level=level)
        sink.write(MAGIC)

    def add(self, array: str, raw: bytes) -> None:
        held, size = self.held[array], CHUNK * DTYPES[array].itemsize
        held += raw
        while len(held) >= size:
            self._chunk(array, bytes(held[:size]))
            del held[:size]

    def _chunk(self, array: str, raw: bytes) -> None:
        values = np.frombuffer(raw, DTYPES[array])
        planes = [self.zip.compress(p) for p in to_planes(values, self.bits)]
        self.index.append([array, self.at, len(values), [len(p) for p in planes], zlib.crc32(raw)])
        for p in planes:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> int:
        for array, held in self.held.items():
            if held:
                self._chunk(array, bytes(held))
        index = self.zip.compress(json.dumps(self.index).encode())
        self.sink.write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.sink.close()
        return self.at + len(index) + 12


class ShardReader:
    def __init__(self, source):
        self.source, size = source, source.size()
        tail = source.read_at(12, size - 12)
        if tail[8:] != MAGIC:
            raise ValueError("not a whole shard file")
        n = struct.unpack("<Q", tail[:8])[0]
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(source.read_at(n, size - 12 - n)))

    def chunks(self, array: str) -> Iterator[np.ndarray]:
        unzip = zstandard.ZstdDecompressor()
        for name, at, n, lengths, crc in self.index:
            if name != array:
                continue
            blob, ends = self.source.read_at(sum(lengths), at), np.cumsum(lengths)
            values = from_planes([unzip.decompress(blob[e - k : e]) for e, k in zip(ends, lengths)], n, DTYPES[array])
            if zlib.crc32(values.tobytes()) != crc:
                raise ValueError(f"chunk of {array} at {at} is damaged")
            yield values


#: White space next to white space; elsewhere every space begins a pre-token and every line end is one.
_BESIDE = re.compile(r"\s\s")
#: With one space in front, one pre-token (other scripts' letters go the general way).
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_PARTS = re.compile(r"(?<=\S) (?=\S)")
#: What is split off the end of a word: a pre-token never goes on from a letter to one of these.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The byte-level pre-tokenizer always begins a new token at a single space
    between two characters that are none, around a single line end, and behind
    the letters of a word. So texts are encoded part by part there, and the ids
    of parts are remembered: of parts behind a space by their characters, of
    those behind a line end with it in front. A text that holds the string of
    an added token is encoded whole, as the library does by default; with
    ``plain`` such strings are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = None if plain or not added else re.compile("|".join(map(re.escape, added)))
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        self.tokenizer.encode_special_tokens = True  # of parts, which hold no such strings otherwise
        self.known: dict[str, bytes] = {}
        self.chars = 0
        self.line_end = len(self._ids(["\n"])[0])
        self.model = self.tokenizer.model  # for what is one pre-token anyway
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        # the byte-level pre-tokenizer's character of each byte, by the code point of that value
        self.characters = {b: pre_tokenizers.ByteLevel(False, use_regex=False).pre_tokenize_str(chr(b))[0][0] for b in range(0x80)}
        self.characters |= {b: c for b in range(0x80, 0xC0) for c in [self._character(b"\xc2" + bytes([b]), 1)]}
        self.characters |= {b: self._character(bytes([b, 0x80]), 0) for b in range(0xC3, 0xE0)} | {0xC2: self._character(b"\xc2\x80", 0)}

    @staticmethod
    def _character(raw: bytes, at: int) -> str:
        return pre_tokenizers.ByteLevel(False, use_regex=False).pre_tokenize_str(raw.decode())[0][0][at]

    def _letter_ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word of _LETTERS with a space in front, by the library's model alone."""
        tokenize, characters = self.model.tokenize, self.characters
        spelled = " ".join(words).encode().decode("latin-1").translate(characters).split(characters[0x20])
        raw, space = self.raw, characters[0x20]
        return [b"".join([raw[t.id] for t in tokenize(space + w)]) for w in spelled] if words else []

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of every word for itself; one call, as a call costs more than a word."""
        if not words:
            return []
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        raw = np.array(found.ids, "<u4").tobytes()
        ends = (np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words) + 1)) * 4).tolist()
        return [raw[lo:hi] for lo, hi in zip(ends, ends[1:])]

    def _learn(self, parts: set[str]) -> None:
        known = self.known
        if len(known) > REMEMBERED or self.chars > 16 * REMEMBERED:
            known.clear()
            self.chars = 0
        new = parts.difference(known)
        ends = {}  # the marks behind a part's letters
        for p in new:
            if p and p[-1] in _MARKS:
                core = p.rstrip(_MARKS)
                if core and core[-1].isalpha():
                    ends[p] = core, p[len(core) :]
        bare = new.difference(ends).union(core for core, _ in ends.values() if core not in known)
        marks = list({m for _, m in ends.values()})
        letters = list(filter(_LETTERS.fullmatch, bare))
        known.update(zip(letters, self._letter_ids(letters)))
        others = list(bare.difference(letters))
        ids = self._ids([*(p if p[:1] == "\n" else " " + p for p in others), *marks])
        known.update(zip(others, ids))
        of_mark = dict(zip(marks, ids[len(others) :]))
        known.update((p, known[core] + of_mark[m]) for p, (core, m) in ends.items())
        self.chars += sum(map(len, bare)) + sum(map(len, ends))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        # parts of "\n" + text, unless that holds white space next to white space
        split = [None if _BESIDE.search(t) else t.replace("\n", " \n")[1:].split(" ") for t in map("\n".__add__, texts)]
        special = {k for k, t in enumerate(texts) if self.added.search(t)} if self.added else ()
        for k in special:
            split[k] = None
        parts = [p for of_text in split if of_text for p in of_text]
        ids = list(map(self.known.get, parts))
        unknown = [k for k, i in enumerate(ids) if i is None]
        if unknown:
            self._learn({parts[k] for k in unknown})
            for k in unknown:
                ids[k] = self.known[parts[k]]
        at = 0
        for k, (text, of_text) in enumerate(zip(texts, split)):
            if k in special:
                yield np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            elif of_text is None:
                first, *rest = _PARTS.split(text)
                yield b"".join(self._ids([first, *(" " + p for p in rest)]))
            else:
                yield b"".join(ids[at : at + len(of_text)])[self.line_end :]
                at += len(of_text)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """One per worker process, so that what it remembers serves later tasks."""
    if (path, plain) not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path, plain] = Encoder(path, plain)
    return _ENCODERS[path, plain]


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer: str, bits: bool = False, shard_bytes: int = SHARD_BYTES, plain: bool = False) -> DataFrame:
    """(doc_id, text) -> shard files in the shared folder; returns their list
    ``shard, path, n_docs, n_ids, n_bytes``, itself written there.

    Documents go in ascending doc_id order (null ids first, ties by text hash,
    repeated rows one after another) over range partitions; each text is
    encoded whole (null: empty) and followed by END_ID. Strings of the tokenizer's
    added tokens become those tokens, as by default in the library, or with
    ``plain`` ordinary text. A task writes to a name
    of its own and moves the finished file, so lost or repeated tasks do no harm.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    folder = scratch_path(spark, "shards")
    filesystem(folder)[0].create_dir(filesystem(folder)[1])
    shards = min(MAX_SHARDS, 1 + size // shard_bytes)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        shard, enc, out, n = TaskContext.get().partitionId(), encoder(tokenizer, plain), None, [0, 0]
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"{path}/.{shard:06d}-{uuid.uuid4().hex}"
                out = ShardWriter(fs.open_output_stream(name), bits)
            ids = batch.column("doc_id")
            out.add("doc", np.array(ids.fill_null(0), "<i8").tobytes())
            out.add("null", np.array(ids.is_null(), "u1").tobytes())
            for raw in enc.encode(text.as_py() for text in batch.column("text")):
                raw += end
                out.add("ids", raw)
                out.add("len", struct.pack("<Q", len(raw) // 4))
                n[1] += len(raw) // 4
            n[0] += batch.num_rows
        if out is not None:
            written, final = out.close(), f"{path}/shard-{shard:06d}.bpz"
            if fs.get_file_info(final).is_file:
                fs.delete_file(name)  # of another attempt at this task, with the same content
            else:
                fs.move(name, final)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [final], "n_docs": [n[0]], "n_ids": [n[1]], "n_bytes": [written]})

    schema = "shard int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"
    listing = scratch_path(spark, "shard-list")
    rows.mapInArrow(run, schema).write.parquet(listing)
    return spark.read.schema(schema).parquet(listing)


def read_documents(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """List of shards -> one row per document: ``doc_id, start`` (ids of all
    documents before it), ``n_tokens, ids_crc32`` (of its ids as stored)."""
    folder = F.col("path")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # over one row per file
    listed = shards.select("shard", folder, "n_ids").withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    root = spark.conf.get("spark.checkpoint.dir")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = filesystem(root)[0]
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                with fs.open_input_file(path) as f:
                    yield from _documents(ShardReader(f), start)

    rows = listed.select("path", "first").repartition(max(1, shards.count()), "path")
    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _documents(shard: ShardReader, start: int) -> Iterator[pa.RecordBatch]:
    ids = shard.chunks("ids")
    raw, at = b"", 0
    for doc, null, length in zip(shard.chunks("doc"), shard.chunks("null"), shard.chunks("len")):
        length, crcs = length.astype(np.int64), []
        for need in (length * 4).tolist():
            crc = 0
            while need:
                if at == len(raw):
                    raw, at = next(ids).tobytes(), 0
                took = raw[at : at + need]
                crc, need, at = zlib.crc32(took, crc), need - len(took), at + len(took)
            crcs.append(crc)
        starts = start + np.cumsum(length) - length
        start += int(length.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(starts), pa.array(length), pa.array(crcs, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])
