"""Best-fit packing of token pieces into sequences of fixed length, by exact-complement hashing.

Pieces.  A document's ids are those of the tokenizer and an end id.  Longer documents are cut into pieces of ``limit``
tokens, the first of which may be shorter.

Plan.  Lengths are small integers, so the driver sees one count for each length, never the pieces.  From the longest
length down, single lengths, pairs and triples of lengths that exactly fill the gap are looked up and consumed in bulk
under their availability counts; what is left is packed best-fit decreasing, in bulk too.  The plan is a list of runs,
(members, number of sequences), a few for each length.

Placement.  Pieces of one length are numbered by ranges of a hash (counts first, rows only inside a range, so no task
sees a whole length), and a piece's number within its length finds its run, its sequence and its offset by one join
with the plan, which has a bounded number of rows.

Edge cases: null and empty texts are one piece that holds the end id alone; repeated rows are packed each; rows
without doc_id too; rows of one length are dealt to ranges by a hash of all they hold and of where they stand; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

END, LIMIT = 2, 1024
#: Documents whose texts are in Python at once.
AT_ONCE = 200
#: Pieces of one length to a range, about.
RANGE = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The vocabulary's pre-token pattern, with possessive quantifiers (same matches, no backtracking).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def byte_bpe():
    """The byte-level BPE of the tokenizers file ``byte_bpe_50k.json``, from the same vocabulary in the form that the
    faster library reads; tests hold both against each other."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    coding = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return lambda text: coding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def pieces(docs: DataFrame, tokenizer=byte_bpe, limit: int = LIMIT, end: int = END) -> DataFrame:
    """PIECES of all documents; ``tokenizer`` returns, in the task, a function from a text to its ids."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        ids_of = tokenizer()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = ids_of(text or "").tobytes() + tail
                    n, start = len(ids) // 4, 0
                    stop, piece = n % limit or min(n, limit), 0
                    while start < n:
                        rows.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                        start, stop, piece = stop, stop + limit, piece + 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """Runs (lengths in a sequence, number of such sequences) that use up all counts."""
    left = np.zeros(limit + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    runs: list[tuple[list[int], int]] = []

    def pair(total: int, spare: np.ndarray) -> tuple[int, int] | None:
        """Two available lengths that sum to ``total``, the larger one as long as can be."""
        small = np.arange(1, total // 2 + 1)
        ok = small[(spare[small] > 0) & (spare[total - small] > np.where(small * 2 == total, 1, 0))]
        return (total - int(ok[0]), int(ok[0])) if len(ok) else None

    def fill(gap: int, spare: np.ndarray) -> list[int] | None:
        """One, two or three available lengths that sum to ``gap``."""
        if gap == 0:
            return []
        if spare[gap] > 0:
            return [gap]
        if two := pair(gap, spare):
            return [*two]
        for a in np.flatnonzero(spare[: gap - 1])[::-1].tolist():
            spare[a] -= 1
            two = pair(gap - a, spare)
            spare[a] += 1
            if two:
                return [a, *two]
        return None

    for length in range(limit, 0, -1):
        while left[length] > 0:
            left[length] -= 1
            rest = fill(limit - length, left)
            left[length] += 1
            if rest is None:
                break
            members = [length, *rest]
            times = min(int(left[x]) // members.count(x) for x in set(members))
            for x in members:
                left[x] -= times
            runs.append((members, times))

    # residuals: best-fit decreasing; open sequences of one content and gap are one entry
    open_: list[list] = [[] for _ in range(limit + 1)]
    for length in range(limit, 0, -1):
        count = int(left[length])
        while count > 0:
            gap = next((g for g in range(length, limit) if open_[g]), None)
            members, times = open_[gap].pop() if gap is not None else ([], count)
            room = (gap if gap is not None else limit) // length
            each = min(room, max(1, count // times))
            used = min(times, count // each)
            if used < times and gap is not None:
                open_[gap].append((members, times - used))
            elif gap is None:
                used = -(-count // room) if count < room else count // room
                each = min(room, count)
            open_[limit - sum(members) - each * length].append((members + [length] * each, used))
            count -= used * each
    return runs + [entry for entries in open_ for entry in entries]


def placements(runs: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, number after the last, first sequence_id, offset) of each member of each run."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for members, times in runs:
        offset = 0
        for x in members:
            at = used.get(x, 0)
            out.append((x, at, at + times, sequence, offset))
            used[x], offset = at + times, offset + x
        sequence += times
    return out


def in_ranges(rows: DataFrame) -> DataFrame:
    """Rows with the range of their length that they are numbered in."""
    return rows.withColumn("range", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "own"), F.col("ranges")))


def pack(docs: DataFrame, tokenizer=byte_bpe, limit: int = LIMIT, end: int = END) -> DataFrame:
    """PIECES with the sequence_id of each and its offset there."""
    spark = docs.sparkSession
    # a number of its own for each row, so that rows without doc_id and repeated ones are spread too
    made = save(pieces(docs, tokenizer, limit, end).withColumn("own", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r["count"] for r in made.groupBy("length").count().collect()}  # at most ``limit`` rows
    runs = spark.createDataFrame(placements(plan(counts, limit)), "of long, lo long, hi long, sequence long, offset long")
    sizes = spark.createDataFrame([(k, -(-n // RANGE)) for k, n in counts.items()], "size long, ranges long")

    ranged = in_ranges(made.join(F.broadcast(sizes), F.col("length") == F.col("size")))  # ``limit`` rows
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("length", "range").agg(F.count("*").alias("here")).select("length", "range", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "range").orderBy("doc_id", "piece", "ids_crc32", "own")
    numbered = ranged.withColumn("row", F.row_number().over(within)).join(starts, ["length", "range"])
    numbered = numbered.withColumn("number", F.col("base") + F.col("row") - 1)
    # the plan has a few rows for each of ``limit`` lengths, however many pieces there are
    placed = numbered.join(F.broadcast(runs), (F.col("length") == F.col("of")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi")))
    sequence = F.col("sequence") + F.col("number") - F.col("lo")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")
