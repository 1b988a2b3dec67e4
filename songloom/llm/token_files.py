"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames, each holding the ids (little-endian unsigned 32-bit integers)
of some whole documents; then a frame with the index of documents; then the seek table, a skippable
frame with the packed size, the plain size and the checksum of every frame before it. Any zstandard
tool can unpack such a file, and a reader that wants a few documents unpacks only their frames.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songloom.llm.common import small_batches, table
from songloom.storage import cut_lineage, scratch_path

END_ID = 2
#: Ids after which a frame is closed; a longer document has a frame of its own.
FRAME_IDS = 1 << 18
#: Pieces of text whose ids a worker remembers.
CACHED_PIECES = 600_000
_SLICE_ROWS, _SLICE_BYTES = 1024, 1 << 21  # of texts that are encoded at once
_GROUP_PIECES = 4096  # that the library encodes at once, as it needs far more memory than their ids

# Fixed values of the published seekable zstandard format.
_SKIPPABLE, _SEEKABLE, _WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY, _FOOTER = struct.Struct("<III"), struct.Struct("<IBI")


def _checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class FileWriter:
    """Appends documents to a stream; ``close`` writes index and seek table."""

    def __init__(self, stream, frame_ids: int = FRAME_IDS):
        self.stream, self.limit = stream, 4 * frame_ids
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.entries: list[bytes] = []
        self.open: list[bytes] = []
        self.open_bytes = 0
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.frames: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        if self.open and self.open_bytes + len(ids) > self.limit:
            self._flush()
        self.keys.append(key)
        self.sizes.append(len(ids) // 4)
        self.frames.append(len(self.entries))
        self.open.append(ids)
        self.open_bytes += len(ids)

    def _flush(self) -> None:
        self._frame(b"".join(self.open))
        self.open, self.open_bytes = [], 0

    def _frame(self, plain: bytes) -> None:
        packed = self.pack.compress(plain)
        self.stream.write(packed)
        self.entries.append(_ENTRY.pack(len(packed), len(plain), _checksum(plain)))

    def close(self) -> None:
        if self.open:
            self._flush()
        self._frame(
            struct.pack("<Q", len(self.keys))
            + np.array([key or 0 for key in self.keys], "<i8").tobytes()
            + np.array([key is not None for key in self.keys], "u1").tobytes()
            + np.array(self.sizes, "<u4").tobytes()
            + np.array(self.frames, "<u4").tobytes()
        )
        table_bytes = b"".join(self.entries) + _FOOTER.pack(
            len(self.entries), _WITH_CHECKSUMS, _SEEKABLE
        )
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(table_bytes)) + table_bytes)


class FileReader:
    """Random access to the documents of a file that can seek."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, io.SEEK_END)
        source.seek(size - _FOOTER.size)
        count, flags, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != _SEEKABLE or flags != _WITH_CHECKSUMS:
            raise ValueError("not a file of frames with a seek table")
        source.seek(size - _FOOTER.size - count * _ENTRY.size)
        packed = source.read(count * _ENTRY.size)
        self.entries = list(_ENTRY.iter_unpack(packed))
        self.starts = np.concatenate([[0], np.cumsum([e[0] for e in self.entries], dtype=np.int64)])
        self.unpacked = 0
        index = self.frame(count - 1)
        (n,) = struct.unpack_from("<Q", index)
        keys = np.frombuffer(index, "<i8", n, 8)
        valid = np.frombuffer(index, "u1", n, 8 + 8 * n)
        self.keys = [int(key) if ok else None for key, ok in zip(keys, valid)]
        self.sizes = np.frombuffer(index, "<u4", n, 8 + 9 * n)
        self.frames = np.frombuffer(index, "<u4", n, 8 + 13 * n)

    def frame(self, number: int) -> bytes:
        packed, plain, checksum = self.entries[number]
        self.source.seek(int(self.starts[number]))
        data = zstandard.ZstdDecompressor().decompress(
            self.source.read(packed), max_output_size=max(plain, 1)
        )
        if len(data) != plain or _checksum(data) != checksum:
            raise ValueError(f"frame {number} is damaged")
        self.unpacked += 1
        return data

    def documents(self, wanted: set[int | None] | None = None) -> Iterator[tuple]:
        """Key, ids before it in this file, and ids of each document (or each wanted one)."""
        held, data, at, before = -1, b"", 0, 0
        for key, size, number in zip(self.keys, self.sizes.tolist(), self.frames.tolist()):
            if number != held:
                held, data, at = number, b"", 0
            if wanted is None or key in wanted:
                data = data or self.frame(number)
                yield key, before, data[at : at + 4 * size]
            at += 4 * size
            before += size


class Encoder:
    """Text to ids, through the tokenizers library.

    The vocabulary splits text before each blank that follows a word, and a newline between two
    words is a piece by itself, so such pieces have the same ids alone as in their text. Each
    distinct piece is encoded once. A text with two neighbouring white-space characters is cut
    only where a blank stands between a visible character and a letter.

    A text that holds an added token such as ``<|endoftext|>`` is encoded in whole, as the library
    finds these before it splits, and none of its pieces is remembered.
    """

    # two blanks or newlines, other white space (of Unicode, as in Python's patterns), or what marks cuts
    _DOUBLE = (
        r"[ \n][ \n]|[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    )
    _CUT = re.compile(r"(?<=\S)(?= [^\W\d_])")

    def __init__(self, path: str, end_id: int = END_ID, cached: int = CACHED_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [x for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.contents = sorted({x.content for x in added}, key=lambda x: (-len(x), x))
        self.added = re.compile("|".join(map(re.escape, self.contents))) if self.contents else None
        # such tokens are looked for in changed text, so any text may hold them
        self.changing = self.tokenizer.normalizer is not None and any(x.normalized for x in added)
        self.end = struct.pack("<I", end_id)
        self.cached, self.known = cached, {}

    def holds_added(self, text: str) -> bool:
        return self.changing or (self.added is not None and self.added.search(text) is not None)

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        encoded: dict[str, bytes] = {}
        for first in range(0, len(pieces), _GROUP_PIECES):
            group = pieces[first : first + _GROUP_PIECES]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
            flat = np.array(list(chain.from_iterable(found)), "<u4").tobytes()
            ends = list(accumulate((4 * len(ids) for ids in found), initial=0))
            encoded.update((x, flat[start:end]) for x, start, end in zip(group, ends, ends[1:]))
        return encoded

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return []
        # a copy, because Arrow's functions on texts misread an array that begins inside its buffer
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
        whole = self._whole(texts)
        odd = pc.match_substring_regex(texts, self._DOUBLE).to_numpy(zero_copy_only=False) & ~whole
        plain = np.flatnonzero(~odd & ~whole)
        encoded: list[bytes] = [b""] * len(texts)
        if len(plain):
            lists = self._cut(texts.take(pa.array(plain)))
            self._join(lists.flatten(), pc.list_value_length(lists).to_numpy(), plain, encoded)
        if odd.any():
            cut = [self._CUT.split(text) for text in texts.filter(pa.array(odd)).to_pylist()]
            flat = pa.array(list(chain.from_iterable(cut)), pa.large_string())
            self._join(flat, np.array([len(x) for x in cut]), np.flatnonzero(odd), encoded)
        if whole.any():
            found = texts.filter(pa.array(whole)).to_pylist()
            fresh = self._encode(list(set(found)))
            for n, text in zip(np.flatnonzero(whole).tolist(), found):
                encoded[n] = fresh[text] + self.end
        return encoded

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts may hold an added token."""
        found = np.full(len(texts), self.changing)
        for content in [] if self.changing else self.contents:
            found |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        return found & (pc.binary_length(texts).to_numpy() > 0)

    @staticmethod
    def _cut(texts: pa.Array) -> pa.Array:
        spaced = pc.replace_substring(texts, " ", "\x00 ")
        return pc.split_pattern(pc.replace_substring(spaced, "\n", "\x00\n\x00"), "\x00")

    def _join(self, pieces: pa.Array, counts: np.ndarray, places: np.ndarray, encoded: list[bytes]) -> None:
        """Puts the ids of texts, each of which has ``counts`` pieces, into their ``places``."""
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        values = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        # ids of the distinct pieces one after the other, gathered in the order of the texts
        flat = np.frombuffer(b"".join(values), "<u4")
        sizes = np.array([len(x) >> 2 for x in values], np.int64)
        starts, each = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        ends = np.cumsum(each)
        ids = flat[np.repeat(starts - (ends - each), each) + np.arange(int(each.sum()))]
        stops = np.concatenate([[0], ends])[np.cumsum(counts)].tolist()
        for n, start, stop in zip(places.tolist(), [0, *stops], stops):
            encoded[n] = ids[start:stop].tobytes() + self.end

    def _ids(self, distinct: list[str]) -> list[bytes]:
        known = self.known
        missing = {x for x in distinct if x not in known}
        if not missing:
            return [known[x] for x in distinct]
        # a comma or full stop after a letter is a token boundary
        bare = {x: (x[:-1], x[-1]) for x in missing if x[-1:] in (",", ".") and x[-2:-1].isalpha()}
        needed = {y for x in bare.values() for y in x if y not in known} | (missing - bare.keys())
        fresh = self._encode(list(needed)) if needed else {}
        both = fresh
        if bare:
            at = lambda x: fresh[x] if x in fresh else known[x]
            both = fresh | {x: at(word) + at(mark) for x, (word, mark) in bare.items()}
        if len(known) + len(both) <= self.cached:
            known.update(both)
            return [known[x] for x in distinct]
        return [both[x] if x in both else known[x] for x in distinct]


_encoders: dict[tuple[str, int], Encoder] = {}  # one for each worker, across its tasks


def _encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of rows and bytes of text, or one long text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    first, total = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > first and (total + size > _SLICE_BYTES or at - first == _SLICE_ROWS):
            yield batch.slice(first, at - first)
            first, total = at, 0
        total += size
    if batch.num_rows > first:
        yield batch.slice(first)


@dataclass
class TokenFiles:
    """The files of one encoded table; ``manifest`` has a row for each, in order."""

    path: str
    manifest: DataFrame


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    frame_ids: int = FRAME_IDS,
) -> TokenFiles:
    """Encode the texts of ``docs`` and write them in ascending order of integer ids.

    Null ids come first, rows with equal ids in the order of a hash of their texts; a null or empty text is
    the end id alone. An empty table gives no documents. Other columns are not read.

    Rows are range-partitioned, so that one often repeated id is spread too, and each task
    writes one file under a name of its own. Only files of successful tasks are in the manifest,
    so a repeated task leaves nothing behind that is read.
    """
    columns = (F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("body"))
    # equal rows are interchangeable, so the tie only spreads them
    rows = docs.select(*columns).withColumn("tie", F.monotonically_increasing_id())
    spread = rows.repartitionByRange("key", F.xxhash64("body"), "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, end_id)
        filesystem, folder = fs.FileSystem.from_uri(path)
        filesystem.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        n_ids = 0
        with filesystem.open_output_stream(f"{folder}/{name}", compression=None) as stream:
            writer = FileWriter(stream, frame_ids)
            for batch in batches:
                for part_of in _slices(batch):
                    encoded = encoder.encode(part_of.column(1))
                    for key, ids in zip(part_of.column(0).to_pylist(), encoded):
                        writer.add(key, ids)
                        n_ids += len(ids) // 4
                pa.default_memory_pool().release_unused()
            writer.close()
        n_docs = len(writer.keys)
        if n_docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([name]), pa.array([n_docs]), pa.array([n_ids])],
                ["part", "file", "n_docs", "n_ids"],
            )

    ordered = spread.sortWithinPartitions("key", F.xxhash64("body"), "tie").select("key", "body")
    files = ordered.mapInArrow(write, "part long, file string, n_docs long, n_ids long")
    with small_batches(docs.sparkSession):
        return TokenFiles(path, cut_lineage(files))


def read_tokens(files: TokenFiles, wanted: list[int | None] | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` from the files.

    With ``wanted``, a list of ids, only the frames that hold those documents are unpacked.
    Checksums are compared; a damaged frame raises.
    """
    return _read(files, wanted, digest=False)


def _read(files: TokenFiles, wanted: list[int | None] | None, digest: bool) -> DataFrame:
    path = files.path
    # one row for each file: as many as the writing job had tasks
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.manifest.select(
        "part", "file", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("first")
    )
    keep = None if wanted is None else set(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with filesystem.open_input_file(f"{folder}/{row['file']}") as source:
                    out, held = [], 0
                    for key, before, ids in FileReader(source).documents(keep):
                        value = zlib.crc32(ids) if digest else np.frombuffer(ids, "<u4").tolist()
                        out.append((key, row["first"] + before, len(ids) // 4, value))
                        held += len(ids)
                        if held > 1 << 24:
                            yield batch_of(out)
                            out, held = [], 0
                    yield batch_of(out)

    last = pa.int64() if digest else pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.int64(), last]
    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else ([] for _ in kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(x), kind) for x, kind in zip(columns, kinds)], names
        )

    # a number of its own, or the few rows would be merged into one task
    tasks = placed.repartition(max(1, files.manifest.count()), "file")
    schema = f"doc_id long, start long, n_tokens long, {names[3]} {'long' if digest else 'array<long>'}"
    return tasks.mapInArrow(read, schema)


def encode_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` in the shared folder, and describe every document by what the files hold."""
    files = write_tokens(docs, scratch_path(spark, "tokens"), tokenizer)
    return _read(files, None, digest=True)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    """Place, size and checksum of every document's ids, read back from the files."""
    return encode_and_read(spark, table(spark, sf_dir, "documents"), default_tokenizer())
