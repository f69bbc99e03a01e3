"""Token ids as files: all ids in a row, document boundaries and ids of documents in Elias-Fano code.

File.  A head, the documents' ids (doc_id) and the ends of their token ids as two Elias-Fano sequences, the token ids themselves, two
bytes each if the vocabulary allows it, the CRC-32 of all that, and a zero byte.  Numbers are little-endian.

Elias-Fano.  Of a non-decreasing sequence the low bits stand packed; the high bits are written in unary, one set bit an
entry, so n entries up to u take about 2 + log2(u / n) bits each.  A directory of 32-bit counts, one for each 512 bits, serves
``select``: it finds the block that holds the i-th set bit, and that bit inside it; no table of 64-bit offsets is kept or made.

Order.  Documents are dealt by ranges of doc_id and sorted inside a range, so that ranges one after the other are the whole order; a
range is written as files of about FILE bytes.  A file knows its range and its number there; what stands before it
is the sum of the files before it.  Files are written by Spark's text writer, whose separator is the zero byte at the end,
and read by its binary reader, so they may stand wherever Spark reads and writes.

Encoding.  No pre-token of this vocabulary crosses white space, so a worker encodes each word that it keeps once.

Edge cases: null and empty texts are the end id alone; rows without doc_id come first, then doc_ids ascend, rows of one
doc_id by length and hash of their texts; equal rows are written each; an empty table gives no files and no rows; a damaged file
raises ValueError; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, scratch

END, VOCABULARY = 1, "word_bpe_49k.json"
#: Bytes of token ids to a file, and of text to a range, about.
FILE, RANGE = 32 * 2**20, 256 * 2**20
#: Bits that an entry of the directory stands for; positions that are looked up at once.
BLOCK, AT_ONCE = 512, 4096
#: Words that a worker keeps in each of two halves, and the longest one.
WORDS, LONGEST = 450_000, 64
MAGIC = b"EFTOKEN1"
#: After the magic: bytes of a token id, range, number of the file there, rows without doc_id, bytes of the two sequences.
HEAD = struct.Struct("<8sBIIQQQ")
READ = "part long, file long, doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of integers, in code; ``of`` makes it from integers, the constructor from bytes."""

    FORM = struct.Struct("<QqB")  # entries, first value, low bits of an entry

    def __init__(self, data: bytes | memoryview) -> None:
        self.n, self.first, self.low_bits = self.FORM.unpack_from(data)
        rest = np.frombuffer(data, np.uint8, offset=self.FORM.size)
        low = -(-self.n * self.low_bits // 8)
        # what is left is blocks of the high bits, each with its directory entry
        blocks = (len(rest) - low) // (BLOCK // 8 + 4)
        self.low = rest[:low]
        self.before = rest[low : low + 4 * blocks].view("<u4")
        self.high = rest[low + 4 * blocks :].reshape(blocks, BLOCK // 8)

    @classmethod
    def of(cls, values: np.ndarray) -> bytes:
        """values: int64, ascending."""
        n = len(values)
        if not n:
            return cls.FORM.pack(0, 0, 0)
        above = values.astype(np.uint64) - np.uint64(int(values[0]) % 2**64)  # right even where the span does not fit int64
        low_bits = max(0, (int(above[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((above[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (above >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        blocks = int(ones[-1]) // BLOCK + 1
        bits = np.zeros(blocks * BLOCK, np.uint8)
        bits[ones] = 1
        before = np.searchsorted(ones, np.arange(blocks) * BLOCK).astype("<u4")
        return cls.FORM.pack(n, int(values[0]), low_bits) + low.tobytes() + before.tobytes() + np.packbits(bits, bitorder="little").tobytes()

    def select(self, which: np.ndarray) -> np.ndarray:
        """The entries with these numbers, from 0."""
        out = np.empty(len(which), np.int64)
        for at in range(0, len(which), AT_ONCE):
            i = np.asarray(which[at : at + AT_ONCE], np.int64)
            block = np.searchsorted(self.before, i, side="right") - 1
            inside = np.unpackbits(self.high[block], axis=1, bitorder="little").cumsum(axis=1, dtype=np.int16)
            place = (inside <= (i - self.before[block])[:, None]).sum(axis=1)
            high = (block * BLOCK + place - i).astype(np.uint64)
            bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
            low = ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.uint64)
            value = (high << np.uint64(self.low_bits)) + (low << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            out[at : at + AT_ONCE] = (value + np.uint64(self.first % 2**64)).astype(np.int64)
        return out


class TokenFile:
    """A file's documents, by their number in the file."""

    def __init__(self, data: bytes) -> None:
        if len(data) < HEAD.size + 5 or data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-5]).to_bytes(4, "little") != data[-5:-1]:
            raise ValueError("not a whole file of token ids")
        _, width, self.part, self.number, self.without_id, named, ends = HEAD.unpack_from(data)
        view = memoryview(data)[HEAD.size : -5]
        self.names, self.ends = EliasFano(view[:named]), EliasFano(view[named : named + ends])
        self.ids = np.frombuffer(view[named + ends :], f"<u{width}")
        self.documents = self.ends.n

    def bounds(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents' ids start and end."""
        which = np.asarray(which)
        start = np.zeros(len(which), np.int64)
        start[which > 0] = self.ends.select(which[which > 0] - 1)
        return start, self.ends.select(which)

    def doc_ids(self, which: np.ndarray) -> list[int | None]:
        which = np.asarray(which)
        named = iter(self.names.select(which[which >= self.without_id] - self.without_id).tolist())
        return [None if i < self.without_id else next(named) for i in which.tolist()]


def token_file(part: int, number: int, docs: list[tuple[int | None, bytes]], width: int) -> bytes:
    """The file of (doc_id, ids) in order, without the zero byte at its end; rows without doc_id come first."""
    without = sum(doc is None for doc, _ in docs)
    names = EliasFano.of(np.array([doc for doc, _ in docs[without:]], np.int64))
    ends = EliasFano.of(np.cumsum([len(ids) // width for _, ids in docs], dtype=np.int64))
    data = b"".join([HEAD.pack(MAGIC, width, part, number, without, len(names), len(ends)), names, ends, *(ids for _, ids in docs)])
    return data + zlib.crc32(data).to_bytes(4, "little")


#: Letters of ASCII and Latin-1, in upper and in lower case, for words that need no normaliser but ``str.lower``.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(f"[!-~{LETTERS}]+")
#: Fixed value: the vocabulary's pre-token pattern, over the characters of PLAIN.
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, then those from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


class Parts(dict):
    """pre-token in lower case -> its ids, by the library's model."""

    def __init__(self, encoder: "Encoder") -> None:
        super().__init__()
        self.model, self.kind, self.characters = encoder.tokenizer.model, encoder.kind, byte_characters()

    def __missing__(self, part: str) -> bytes:
        ids = array(self.kind, [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.characters))]).tobytes()
        if len(part) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[part] = ids
        return ids


class Encoder(dict):
    """word -> little-endian ids; called with a text, the ids of all its words.

    Words of PLAIN are cut into pre-tokens here and encoded by the library's model; all others by the whole tokenizer.  When it is
    full, the words kept become the older half, from which those that come again are taken over."""

    def __init__(self, name: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.kind = "H" if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) < 2**16 else "I"
        self.width = array(self.kind).itemsize
        self.parts, self.older = Parts(self), {}

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode()
            if PLAIN.fullmatch(text) and "<|" not in text:
                ids = b"".join(map(self.parts.__getitem__, PARTS.findall(text.lower())))
            else:
                ids = array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


@functools.cache
def encoder(name: str) -> Encoder:
    """One for each worker, which keeps it from task to task."""
    return Encoder(name)


def batch(columns: list, names: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, file_bytes: int = FILE) -> None:
    """Writes the documents' ids under ``path``, which must be new.  Texts move once; they are encoded where they are filed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE)
    # rows that are equal are dealt by where they stand in the table
    rows = rows.withColumns({"size": F.octet_length("text"), "hash": F.xxhash64("text"), "stands": F.monotonically_increasing_id()})
    order = ["doc_id", "size", "hash", "stands"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        ids_of = encoder(vocabulary)
        tail = end.to_bytes(ids_of.width, "little")
        held, size, number, part = [], 0, 0, 0
        for b in batches:
            for r in range(b.num_rows):
                part, doc, text = (c[r].as_py() for c in b.columns)
                ids = ids_of(text) + tail
                if held and size + len(ids) > file_bytes:
                    yield batch([[token_file(part, number, held, ids_of.width)]], "file binary")
                    held, size, number = [], 0, number + 1
                held.append((doc, ids))
                size += len(ids)
        if held:
            yield batch([[token_file(part, number, held, ids_of.width)]], "file binary")

    files = dealt.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text").mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; start: ids of all documents before it."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                f = TokenFile(b.column(0)[r].as_py())
                for at in range(0, f.documents, AT_ONCE):
                    which = np.arange(at, min(at + AT_ONCE, f.documents))
                    start, end = f.bounds(which)
                    crc = [zlib.crc32(f.ids[a:z].astype("<u4")) for a, z in zip(start.tolist(), end.tolist(), strict=True)]
                    yield batch([[f.part] * len(which), [f.number] * len(which), f.doc_ids(which), start, end - start, crc], READ)

    stored = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    rows = save(stored.mapInArrow(run, READ), "read")
    files = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    order = lambda *by: Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = files.groupBy("part").agg(F.sum("n").alias("n"))
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(order("part")), F.lit(0)).alias("before"))  # a row a range
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("earlier", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(ranges, "part")
    files = files.select("part", "file", (F.col("before") + F.col("earlier")).alias("base"))
    return rows.join(files, ["part", "file"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, file_bytes: int = FILE) -> DataFrame:
    """Writes the documents to the shared folder and reads the files back."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocabulary, end, file_bytes)
    return read_token_files(docs.sparkSession, path)
