"""Token ids in sorted-string-table shards.

Texts are dealt by ranges of their identifier and sorted, so that each task
writes one shard in ascending order: blocks of entries whose keys are stored as
(shared prefix length, rest), each block compressed; then a sparse index (first
key, offset and length of every block), a Bloom filter of all keys, and a footer
that says where both lie. A look-up reads footer, filter and index, finds its
block by binary search and reads that block alone.

A shard is written under a name of its own attempt and then renamed, so a task
that runs again leaves the same file. All files lie in the shared folder and are
opened through pyarrow's file systems.

Ids are produced by the tokenizers library from whole texts, some megabytes of text
a call. A text over LONG characters is cut where no match of the splitting pattern
and no added token can span (before a space or line feed after a character that isn't
white space), as the library needs over a hundred bytes for each of its tokens.

Shards are made for about shard_bytes of text, a gigabyte at most, so a task's work,
its index and its filter stay the same size however large the corpus.

Entry value: n ids, running count of ids in the shard, ids as little-endian
unsigned 16-bit integers if all fit, else 32-bit.

Defined cases: a null or empty text has the end id only; null identifiers come
first; rows of one identifier are separate entries in the order of a hash of their
text, then of the text, and may lie in several shards; an empty table gives no shards;
other columns are left out.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import pieces
from .shared import documents, new_folder, small_batches

MAGIC = b"QSST0002"
FOOTER = struct.Struct("<QQQQQQ8s")  # index at, length; filter at, length; entries; ids; MAGIC
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
END_ID = 0
SHARD_BYTES = 32 << 20
MOST_SHARD_BYTES, SHARDS = 1 << 30, 4096  # shards grow once a corpus has more of them
ROW_BYTES = 64  # that a row counts for besides its text
CALL = 1 << 20  # characters that one call encodes, about
LONG = 1 << 20  # characters of a piece of a very long text, about


def encoded(tokenizer, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text, in order; a call takes about CALL characters, or one piece of a longer text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CALL):
            size += len(texts[end])
            end += 1
        if end - at > 1 or size <= LONG:
            for e in tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False):
                yield np.array(e.ids, dtype="<u4")
        else:
            yield np.concatenate([np.array(tokenizer.encode_batch_fast([p], add_special_tokens=False)[0].ids, dtype="<u4") for p in pieces(texts[at], LONG)])
        at = end


@lru_cache(maxsize=1)
def loaded(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def key_of(identifier) -> bytes:
    """Bytes that sort as the identifiers do: null first, integers by value, strings by their UTF-8."""
    if identifier is None or identifier != identifier:
        return b""
    if isinstance(identifier, str):
        return b"\x02" + identifier.encode()
    return b"\x01" + struct.pack(">Q", int(identifier) + (1 << 63))


def identifier_of(key: bytes):
    if not key:
        return None
    return key[1:].decode() if key[0] == 2 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def key_hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1


def bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = key_hashes(key)
    return [((a + i * b) & 0xFFFFFFFFFFFFFFFF) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes entries in ascending key order to an open binary stream."""

    def __init__(self, out):
        self.out, self.at, self.index = out, 0, []
        self.hashes = array("Q"), array("Q")  # 16 bytes a key
        self.block, self.size, self.first, self.last = [], 0, b"", b""
        self.entries = self.ids = 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block:
            self.first, self.last = key, b""
        shared = len(os.path.commonprefix([self.last, key]))
        short = not len(ids) or int(ids.max()) < 1 << 16
        body = ids.astype("<u2" if short else "<u4").tobytes()
        head = struct.pack("<IIIQB", shared, len(key) - shared, len(ids), self.ids, 2 if short else 4)
        self.block += [head, key[shared:], body]
        self.size += len(head) + len(key) - shared + len(body)
        self.last = key
        for known, h in zip(self.hashes, key_hashes(key)):
            known.append(h)
        self.entries += 1
        self.ids += len(ids)
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.packer.compress(b"".join(self.block))
            self.index.append((self.first, self.at, len(data)))
            self.out.write(data)
            self.at += len(data)
            self.block, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<IQI", len(k), at, n) + k for k, at, n in self.index)
        bits = max(64, self.entries * BLOOM_BITS)
        bloom = np.zeros((bits + 7) // 8 * 8, bool)
        a, b = (np.frombuffer(h, np.uint64) if h else np.zeros(0, np.uint64) for h in self.hashes)
        for i in range(BLOOM_HASHES):
            bloom[(a + np.uint64(i) * b) % np.uint64(bits)] = True  # wraps at 64 bits
        filter_ = struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + filter_)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(filter_), self.entries, self.ids, MAGIC))


class Reader:
    """A shard of which only footer, filter and index are held."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        index_at, index_n, filter_at, filter_n, self.entries, self.ids, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, at, self.firsts, self.blocks = file.read_at(index_n, index_at), 0, [], []
        while at < len(raw):
            n, offset, length = struct.unpack_from("<IQI", raw, at)
            at += 16
            self.firsts.append(raw[at : at + n])
            self.blocks.append((offset, length))
            at += n
        raw = file.read_at(filter_n, filter_at)
        self.bits, self.bloom = struct.unpack_from("<Q", raw)[0], raw[8:]

    def block(self, i: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, ids) of each entry."""
        offset, length = self.blocks[i]
        raw, at, key = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, offset)), 0, b""
        while at < len(raw):
            shared, rest, n, before, width = struct.unpack_from("<IIIQB", raw, at)
            at += 21
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, before, np.frombuffer(raw, f"<u{width}", n, at).astype("<u4")
            at += n * width

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, self.bits))

    def find(self, identifier) -> list[np.ndarray]:
        """The ids of all entries of an identifier."""
        key = key_of(identifier)
        if not self.may_hold(key):
            return []
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)  # an identifier's entries may begin in the block before
        found = []
        while i < len(self.blocks) and self.firsts[i] <= key:
            found += [ids for k, _, ids in self.block(i) if k == key]
            i += 1
        return found


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def write_shards(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int | None = None) -> DataFrame:
    """Writes df's texts; returns the manifest (shard, file, first, last, entries, ids), a row for each shard.

    A shard holds SHARD_BYTES of text, more where that makes over SHARDS of them, MOST_SHARD_BYTES at most.
    """
    spark = df.sparkSession
    small_batches(spark)
    is_text = dict(df.dtypes)[id_col] == "string"
    kind = "string" if is_text else "bigint"
    rows = df.select((F.col(id_col) if is_text else F.col(id_col).cast("bigint")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(ROW_BYTES).cast("long"))).first()[0] or 0
    shard_bytes = shard_bytes or min(max(SHARD_BYTES, size // SHARDS), MOST_SHARD_BYTES)
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(size // shard_bytes + 1, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"shard-{task.partitionId():06d}.sst"
        temporary = f"{base}/.{name}.{task.taskAttemptId()}-{uuid.uuid4().hex}"
        first = last = None
        with fs.open_output_stream(temporary) as out:
            made = Writer(out)
            for batch in batches:
                for last, ids in zip(batch.column(0).to_pylist(), encoded(loaded(tokenizer), batch.column(1).to_pylist())):
                    first = last if made.entries == 0 else first
                    made.add(key_of(last), np.append(ids, np.uint32(END_ID)).astype("<u4"))
            made.close()
        if not made.entries:
            fs.delete_file(temporary)
            return
        fs.move(temporary, f"{base}/{name}")
        key = pa.string() if is_text else pa.int64()
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()]), pa.array([name]), pa.array([first], key), pa.array([last], key), pa.array([made.entries]), pa.array([made.ids])],
            ["shard", "file", "first", "last", "entries", "ids"],
        )

    manifest = rows.mapInArrow(write, f"shard long, file string, first {kind}, last {kind}, entries long, ids long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def with_starts(manifest: DataFrame, in_a_group: int = 1024) -> DataFrame:
    """shard, file, before: the ids in all shards before each, by sums of groups of shards and then within a group."""
    group = F.floor(F.col("shard") / in_a_group)
    sums = manifest.groupBy(group.alias("g")).agg(F.sum("ids").alias("n"))
    earlier = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("g", earlier("n", Window.partitionBy(F.lit(0)).orderBy("g")).alias("above"))  # a row for each group
    rows = manifest.select("shard", "file", group.alias("g"), earlier("ids", Window.partitionBy(group).orderBy("shard")).alias("own"))
    return rows.join(sums, "g").select("shard", "file", (F.col("above") + F.col("own")).alias("before"))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry: id, start (ids before it in all shards), n_tokens, ids_crc32; the shards are dealt to as many tasks."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    kind = dict(manifest.dtypes)["first"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(folder)
        for batch in batches:
            for name, base_ids in zip(batch["file"], batch["before"]):
                with fs.open_input_file(f"{base}/{name}") as f:
                    reader = Reader(f)
                    for i in range(len(reader.blocks)):
                        rows = [(identifier_of(k), int(base_ids) + at, len(ids), zlib.crc32(ids.tobytes())) for k, at, ids in reader.block(i)]
                        out = pd.DataFrame(rows, columns=["id", "start", "n_tokens", "ids_crc32"])
                        yield out.astype({"id": "string" if kind == "string" else "Int64"})

    table = with_starts(manifest).repartition(max(1, manifest.count()), "shard")
    return table.mapInPandas(read, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, identifier) -> list[np.ndarray]:
    """The ids of one identifier: the manifest's ranges, then each shard's filter, index and block."""
    near = spark.read.parquet(f"{folder}/manifest")
    known = near.where(F.col("first").isNull() if identifier is None else (F.coalesce(F.col("first") <= F.lit(identifier), F.lit(True)) & (F.col("last") >= F.lit(identifier))))
    fs, base = file_system(folder)
    found = []
    for (name,) in known.select("file").collect():
        with fs.open_input_file(f"{base}/{name}") as f:
            found += Reader(f).find(identifier)
    return found


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "shards")
    write_shards(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(spark, folder).withColumnRenamed("id", "doc_id")


QUERIES = {"op3_sstable": op3_sstable}
ORACLE_SQL: dict[str, str] = {}
