"""Merkle manifest of a dataset: trees in van Emde Boas layout, cut into aligned blocks and built again over the block roots.

Tree.  A row's leaf is the SHA-256 of its fields.  Leaves of a group ascend by id; every two neighbours become a node, a last
one without a neighbour becomes a node alone, until one is left, the group's subroot.  Subroots, ordered by group, give the
root in the same way.  Digests go into digests as lower-case hex text.

Storage.  ``2 ** HEIGHT`` leaves that stand side by side are a block, the whole aligned subtree over them.  Inside a block nodes stand in van
Emde Boas order: the tree is cut at half its height, the upper part comes first, the lower ones follow, and each is
laid out in the same way.  A node's address follows from its depth and number alone (``Layout``), so neither pointers
nor a block size of the memory below are needed; parents stand before their children, so a block is built by one sweep
from its end.  Block roots are the leaves of the next tier, up to one block a group; the groups' subroots go through
the same tiers.  A tier is a written table with one row a block.

Proofs.  A path is the list of siblings from a leaf to the root.  Paths of block roots go down tier by tier, one row a block; inside
a block siblings are found by address.  No task holds more than a block, whatever the size of a group.

Edge cases: null fields count as ``-``; null groups come first; rows without id come first in their group; rows with one id
stand in order of their leaf; equal rows are leaves of their own; a group of one row has its leaf as subroot, one group alone its
subroot as root; an empty table has no root and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Levels of a block above its leaves.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCKS = "g string, block long, held int, height int, nodes binary, subtree_root binary"
PROVED = "id long, leaf string, subroot string, proof string, proof_sha256 string, folded_root string"
#: Steps of a path: a sibling before the node, one after it, none.
BEFORE, AFTER, ALONE = b"<>-"


class Layout:
    """Addresses of the nodes of a full binary tree of ``height`` levels above its leaves, in van Emde Boas order."""

    def __init__(self, height: int) -> None:
        self.height, levels = height, height + 1
        # of the roots of lower parts at each depth: depth of the upper part's root, its nodes, nodes of each lower part
        above, upper, lower = (np.zeros(levels, np.int64) for _ in range(3))

        def cut(depth: int, n: int) -> None:
            if n > 1:
                half = n // 2
                at = depth + half
                above[at], upper[at], lower[at] = depth, 2**half - 1, 2 ** (n - half) - 1
                cut(depth, half)
                cut(at, n - half)

        cut(0, levels)
        #: depth -> address of each node at that depth
        self.at = [np.zeros(1, np.int64)]
        for depth in range(1, levels):
            number = np.arange(2**depth)
            self.at.append(self.at[above[depth]][number >> (depth - above[depth])] + upper[depth] + (number & upper[depth]) * lower[depth])
        self.size = 2**levels - 1
        depth_of, number_of = np.empty(self.size, np.int64), np.empty(self.size, np.int64)
        for depth, places in enumerate(self.at):
            depth_of[places], number_of[places] = depth, np.arange(len(places))
        #: (depth, number, address of the first child, of the second) of inner nodes, children before parents
        self.sweep = [
            (d, j, int(self.at[d + 1][2 * j]), int(self.at[d + 1][2 * j + 1]))
            for d, j in zip(depth_of[::-1].tolist(), number_of[::-1].tolist(), strict=True)
            if d < height
        ]

    def held(self, leaves: int, depth: int) -> int:
        """Nodes at a depth over the first ``leaves`` leaves."""
        return -(-leaves >> (self.height - depth))

    def build(self, leaves: list[bytes]) -> bytes:
        """All nodes over the leaves (32 bytes each), in order of address; places without a node hold zeros."""
        nodes = [b""] * self.size
        for place, leaf in zip(self.at[-1].tolist(), leaves, strict=False):
            nodes[place] = leaf.hex().encode()
        for d, j, first, second in self.sweep:
            if nodes[first]:
                nodes[int(self.at[d][j])] = sha256(nodes[first] + nodes[second]).hexdigest().encode()
        return b"".join(bytes.fromhex(n.decode()) if n else bytes(32) for n in nodes)

    def path(self, nodes: bytes, leaves: int, number: int) -> bytes:
        """Steps from a leaf to the block's root: a mark each, and the sibling's digest if there is one."""
        steps = []
        for depth in range(self.height, 0, -1):
            sibling = number ^ 1
            if sibling < self.held(leaves, depth):
                place = 32 * int(self.at[depth][sibling])
                steps.append((b"<" if sibling < number else b">") + nodes[place : place + 32])
            else:
                steps.append(b"-")
            number >>= 1
        return b"".join(steps)


@functools.cache
def layout(height: int) -> Layout:
    return Layout(height)


def fold(leaf: str, path: bytes) -> str:
    """The root that a leaf's digest and its path lead to."""
    at, node = 0, leaf
    while at < len(path):
        mark = path[at]
        sibling = path[at + 1 : at + 33].hex() if mark != ALONE else ""
        node = sha256((sibling + node if mark == BEFORE else node + sibling).encode()).hexdigest()
        at += 1 if mark == ALONE else 33
    return node


def siblings(path: bytes) -> list[str]:
    """The digests of a path, without its marks."""
    at, out = 0, []
    while at < len(path):
        if path[at] != ALONE:
            out.append(path[at + 1 : at + 33].hex())
        at += 1 if path[at] == ALONE else 33
    return out


def leaf_of(fields: Sequence[Column]) -> Column:
    """Hex digest of a row: each field as its length in bytes, a colon and its value, or ``-``."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


class Manifest(NamedTuple):
    """members: (g, block, id, claim), arrays; tiers and top: BLOCKS tables, lowest first, of the groups and of their subroots;
    groups: (g, at, digest); root: hex, or None."""

    members: DataFrame
    tiers: list[DataFrame]
    groups: DataFrame
    top: list[DataFrame]
    root: str | None
    height: int


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (g, ...) with ``at``, their number in the order of their group, from 0, and ``size``, rows of the group.

    Rows are dealt by ranges, so a large group is spread; one count for each group and range goes on.  Rows that are equal in
    ``order`` are dealt by where they stand in the written table that ``rows`` is."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("stands", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts, "g", *order, "stands").sortWithinPartitions("g", *order, "stands")
    dealt = save(dealt.drop("stands").withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "dealt")
    runs = dealt.groupBy("g", "part").agg(F.min("seq").alias("first"), F.count("*").alias("here"))
    group = Window.partitionBy("g")
    before = F.sum("here").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = save(runs.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(group).alias("size")), "runs")
    return dealt.join(runs, ["g", "part"]).withColumn("at", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def cut(rows: DataFrame, height: int) -> DataFrame:
    """BLOCKS and ``size`` (blocks of the group) over rows (g, at, size, digest)."""
    block = F.shiftright("at", height).alias("block")
    groups = rows.groupBy("g", block, "size").agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("x"))

    def run(batches):
        for b in batches:
            g, blocks, size, leaves = (c.to_pylist() for c in b.columns)
            held = [len(x) for x in leaves]
            heights = [min(height, (n - 1).bit_length()) for n in size]  # a group below a block has a lower tree
            nodes = [layout(h).build(x) for h, x in zip(heights, leaves, strict=True)]
            columns = [(g, pa.string()), (blocks, pa.int64()), (held, pa.int32()), (heights, pa.int32()), (nodes, pa.binary()), ([n[:32] for n in nodes], pa.binary())]
            columns.append(([-(-n >> height) for n in size], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=[*(f.split()[0] for f in BLOCKS.split(", ")), "size"])

    return groups.select("g", "block", "size", "x.digest").mapInArrow(run, BLOCKS + ", size long")


def tiers(rows: DataFrame, height: int) -> list[DataFrame]:
    """BLOCKS tables with ``size``, lowest first, up to one block a group; each is written."""
    out = [save(cut(rows, height), "tier")]
    while (out[-1].agg(F.max("size")).first()[0] or 0) > 1:
        roots = out[-1].where("size > 1").select("g", F.col("block").alias("at"), "size", F.col("subtree_root").alias("digest"))
        out.append(save(cut(roots, height), "tier"))
    return out


def roots(levels: list[DataFrame]) -> DataFrame:
    """(g, digest) of the groups whose trees are done."""
    return functools.reduce(DataFrame.unionByName, [t.where("size = 1").select("g", F.col("subtree_root").alias("digest")) for t in levels])


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", claims: dict[str, Column] | None = None, height: int = HEIGHT) -> Manifest:
    """Builds and writes the trees.  ``claims`` replaces fields by what somebody says they are: proofs are held against it."""
    claimed = claims or {}
    # "-" sorts before ":", so null comes first
    g = F.when(F.col(group).isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col(group).cast("string")))
    claim = leaf_of([claimed.get(f, F.col(f)) for f in fields]) if claimed else F.lit(None).cast("string")
    leaf = docs.select(g.alias("g"), F.col(order).cast("long").alias("id"), F.unhex(leaf_of([F.col(f) for f in fields])).alias("digest"), F.unhex(claim).alias("claim"))
    leaf = leaf.withColumn("claim", F.when(F.col("claim") != F.col("digest"), F.col("claim")))
    rows = save(numbered(save(leaf, "leaves"), "id", "digest"), "rows")
    levels = tiers(rows.select("g", "at", "size", "digest"), height)
    members = rows.groupBy("g", F.shiftright("at", height).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "id", "claim"))).alias("x"))
    subroots = save(roots(levels).select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "subroots")
    groups = save(numbered(subroots, "name"), "groups")
    top = tiers(groups.select("g", "at", "size", "digest"), height)
    last = roots(top).first()
    groups = groups.select(F.col("name").alias("g"), "at", "digest")
    return Manifest(members.select("g", "block", "x.id", "x.claim"), levels, groups, top, last.digest.hex() if last else None, height)


def drawn_out(blocks: DataFrame, shift: int) -> DataFrame:
    """(g, at, path) of each leaf of BLOCKS with their ``path``."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                g, block, held, height, nodes, path = (c[r].as_py() for c in b.columns)
                lay = layout(height)
                columns = [
                    pa.array([g] * held, pa.string()),
                    pa.array([(block << shift) + j for j in range(held)], pa.int64()),
                    pa.array([lay.path(nodes, held, j) + path for j in range(held)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["g", "at", "path"])

    return blocks.select("g", "block", "held", "height", "nodes", "path").mapInArrow(run, "g string, at long, path binary")


def paths(levels: list[DataFrame], above: DataFrame, shift: int) -> DataFrame:
    """(g, block, path) of the blocks of the lowest level; above: (g, path) of the groups' own roots.

    The paths of a level are those of the blocks above it, drawn out to their leaves."""
    out = last = None
    for level in reversed(levels):
        mine = level.where("size = 1").select("g", "block").join(above, "g").select("g", "block", "path")
        if last is not None:
            mine = mine.unionByName(drawn_out(last.join(out, ["g", "block"]), shift).withColumnRenamed("at", "block"))
        out, last = save(mine, "paths"), level
    return out


def proofs(made: Manifest) -> DataFrame:
    """PROVED for each row of the manifest: ``proof`` holds the siblings; folded_root is that of the claim, if there is one."""
    whole = made.groups.sparkSession.createDataFrame([("", b"")], "g string, path binary")
    # a group's own path: from its place among the subroots to the root
    over = drawn_out(made.top[0].join(paths(made.top, whole, made.height), ["g", "block"]), made.height).select("at", "path")
    above = save(made.groups.join(over, "at").select("g", "path", F.lower(F.hex("digest")).alias("subroot")), "above")
    low = paths(made.tiers, above.select("g", "path"), made.height)
    blocks = made.tiers[0].join(low, ["g", "block"]).join(made.members, ["g", "block"]).join(above.select("g", "subroot"), "g")

    def run(batches):
        names = [f.split()[0] for f in PROVED.split(", ")]
        for b in batches:
            for r in range(b.num_rows):
                held, height, nodes, path, ids, claims, subroot = (c[r].as_py() for c in b.columns)
                lay, rows = layout(height), []
                for j in range(held):
                    place = 32 * int(lay.at[-1][j])
                    leaf, whole = nodes[place : place + 32].hex(), lay.path(nodes, held, j) + path
                    proof = "".join(siblings(whole))
                    claim = claims[j].hex() if claims[j] is not None else leaf
                    rows.append((ids[j], leaf, subroot, proof, sha256(proof.encode()).hexdigest(), fold(claim, whole)))
                types = [pa.int64(), *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return blocks.select("held", "height", "nodes", "path", "id", "claim", "subroot").mapInArrow(run, PROVED)


def audit(docs: DataFrame, claims: dict[str, Column]) -> DataFrame:
    """Each row's leaf, subroot, root and proof, the root that its claimed fields lead to, and whether that is the root."""
    made = manifest(docs, claims=claims)
    root = F.lit(made.root).cast("string")
    found = proofs(made).select(F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))



def _sql_leaf(**claims: str) -> str:
    return "sha256(" + " || ".join(f"case when {v} is null then '-' else strlen(({v})::varchar) || ':' || ({v}) end" for v in (claims.get(f, f) for f in FIELDS)) + ")"


def _sql_tree(name: str, leaves: str) -> str:
    """Nodes (g, level, j, h) over leaves (g, pos, h)."""
    return f"""{name}(g, level, j, h) as (select g, 0, pos, h from {leaves} union all
  select g, level + 1, j // 2, sha256(h || coalesce(following, '')) from (select *, lead(h) over (partition by g order by j) as following, count(*) over (partition by g) as c from {name}) where j % 2 = 0 and c > 1)"""


#: CRC-32 bit by bit; nodes level by level; the claim's fold step by step.
_SQL_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ord((doc_id::varchar)[i])::bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))))"""
ORACLE = f"""
with recursive d0 as (select *, row_number() over () as rid, coalesce(':' || lang, '-') as g, {_sql_leaf()} as h, {_sql_leaf(n_chars="case when " + _SQL_CRC + " % 7 = 0 then n_chars + 1 else n_chars end")} as claim from documents),
d as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as pos from d0),
{_sql_tree("t", "d")},
sub as (select g as name, arg_max(h, level) as h, max(level) as levels, '' as g, row_number() over (order by g) - 1 as pos from t group by g),
{_sql_tree("top", "sub")},
steps as (select rid, l, (d.pos >> l) & 1 as odd, t.h as sibling from (select d.g, d.pos, d.rid, unnest(range(s.levels)) as l from d join sub s on s.name = d.g) d left join t on t.g = d.g and t.level = l and t.j = xor(d.pos >> l, 1)
  union all select rid, levels + l, (x.pos >> l) & 1, top.h from (select d.rid, s.pos, s.levels, unnest(range((select max(level) from top))) as l from d join sub s on s.name = d.g) x left join top on top.level = l and top.j = xor(x.pos >> l, 1)),
proof as (select rid, sha256(coalesce(string_agg(sibling, '' order by l), '')) as proof_sha256 from d left join steps using (rid) group by rid),
fold(rid, l, h) as (select rid, 0, claim from d union all
  select f.rid, f.l + 1, sha256(case when sibling is null then h when odd = 1 then sibling || h else h || sibling end) from fold f join steps s on s.rid = f.rid and s.l = f.l),
folded as (select rid, arg_max(h, l) as folded_root from fold group by rid),
r as (select arg_max(h, level) as root from top)
select doc_id, d.h as leaf, sub.h as subroot, root, proof_sha256, folded_root, folded_root = root as verified
from d join sub on sub.name = d.g cross join r join proof using (rid) join folded using (rid)
"""
