"""Merkle manifest of a dataset, its digests stored in van Emde Boas order.

Every document is a leaf of its source's tree and every source's root is a leaf of the dataset's tree; ``FANOUT`` nodes in a row have
one parent. A tree is cut into aligned blocks of ``height`` levels, 16^height leaves each. Inside a block the levels are split at half
height: first the upper half, then the subtrees below it one after the other, each laid out the same way. Where a node lies
follows from its level and number alone (``places``), so building a block and reading siblings from it need no pointers. The roots
of the blocks are the leaves of the next tier of blocks, until a source has one block left. A run of siblings never crosses a
block, so a proof reads one block to a tier.

Leaves are numbered by ranges, not by source: a source with a third of all documents is spread over the cluster like the rest.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.llm.common import table
from tamiz.session import settle

#: Nodes to a parent, and levels to a block (4096 bottom nodes, 140 kB of digests).
FANOUT, HEIGHT = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<at:int,others:binary>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- address arithmetic --------------------------------------------------------------------

def width(n: int, level: int) -> int:
    """Nodes on a level over ``n`` bottom nodes."""
    return -(-n // FANOUT ** level)


def size(height: int, n: int) -> int:
    """Nodes of a block of ``height`` levels over ``n`` bottom nodes."""
    return sum(width(n, level) for level in range(height))


def places(height: int, n: int, level: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of a level lie in a block of ``height`` levels over ``n`` bottom nodes.

    The last subtree may be ragged; all before it are full, so its place is a multiplication too.
    """
    if height == 1:
        return index.copy()
    low = height // 2
    span, tops = FANOUT ** low, width(n, low)
    if level >= low:
        return places(height - low, tops, level - low, index)
    below = FANOUT ** (low - level)
    tree, inner = index // below, index % below
    at = size(height - low, tops) + tree * size(low, span)
    last = tree == tops - 1
    at[~last] += places(low, span, level, inner[~last])
    at[last] += places(low, n - (tops - 1) * span, level, inner[last])
    return at


@lru_cache(maxsize=64)
def _level_places(height: int, n: int) -> tuple[np.ndarray, ...]:
    return tuple(places(height, n, level, np.arange(width(n, level))) for level in range(height))


def lone_height(n: int) -> int:
    """Levels below the root of a tree of ``n`` leaves: 0 for one leaf, which is its own root."""
    height = 0
    while width(n, height) > 1:
        height += 1
    return height


def build_block(leaves: bytes, height: int) -> tuple[bytes, bytes]:
    """(layout, root) of digests of 32 bytes in a row; ``root`` is the parent of the uppermost level."""
    n = len(leaves) // 32
    layout, row = np.empty((size(height, n), 32), np.uint8), leaves
    for at in _level_places(height, n):
        layout[at] = np.frombuffer(row, np.uint8).reshape(-1, 32)
        text, run = row.hex().encode(), 64 * FANOUT
        row = b"".join(hashlib.sha256(text[k:k + run]).digest() for k in range(0, len(text), run))
    return layout.tobytes(), row


def read_level(layout: bytes, height: int, n: int, level: int) -> bytes:
    """The digests of one level, in order, read from their places."""
    return np.frombuffer(layout, np.uint8).reshape(-1, 32)[_level_places(height, n)[level]].tobytes()


def siblings(layout: bytes, height: int, n: int) -> list[list[bytes]]:
    """To each level, the other digests of the run of each of its nodes, one after the other."""
    out, run = [], 32 * FANOUT
    for level in range(height):
        row = read_level(layout, height, n, level)
        out.append([row[k - k % run:k] + row[k + 32:k - k % run + run] for k in range(0, len(row), 32)])
    return out


# --- leaves and their numbers --------------------------------------------------------------

def leaf_digest(text: Column | None = None) -> Column:
    """Lower-case hex SHA-256 of the five fields, each ``-`` or its length in bytes, a colon and its value."""
    def field(name: str) -> Column:
        value = (text if name == "text" and text is not None else F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` plus pos (from 0 in its key, by ``order``) and total (rows of the key).

    Rows are dealt out by ranges of (key, order) and counted there; a range's numbers begin after those before it.
    """
    ranged = settle(rows.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = ranged.groupBy("part", "key").agg(F.count(F.lit(1)).alias("rows"))
    one = Window.partitionBy("key")
    before = F.sum("rows").over(one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("part", "key", F.coalesce(before, F.lit(0)).alias("shift"), F.sum("rows").over(one).alias("total"))
    within = F.row_number().over(Window.partitionBy("part", "key").orderBy(*order))
    return ranged.withColumn("nth", within).join(shifts, ["part", "key"]).select(
        *rows.columns, (F.col("nth") - 1 + F.col("shift")).alias("pos"), "total")


# --- blocks --------------------------------------------------------------------------------

_BLOCK = "key string, block long, total long, n int, height int, layout binary, root binary"


def _block(most: int, key: tuple, nodes: pa.Table) -> pa.Table:
    """One block, of ``most`` levels or a whole tree, over the nodes(pos, total, digest) that share a key and a block number."""
    nodes = nodes.sort_by("pos")
    total, n = nodes["total"][0].as_py(), nodes.num_rows
    height = most if total > FANOUT ** most else lone_height(n)
    layout, root = build_block(b"".join(nodes["digest"].to_pylist()), height)
    row = {"key": key[0].as_py(), "block": key[1].as_py(), "total": total, "n": n, "height": height, "layout": layout, "root": root}
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table({name: pa.array([value], kind) for (name, value), kind in zip(row.items(), kinds)})


def tiers_of(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Tables of blocks over nodes(key, pos, total, digest), from the leaves up, each written to the shared folder.

    Their number follows from the largest key: one more for each factor of 16^height.
    """
    span, tiers = FANOUT ** height, []
    most = nodes.agg(F.max("total")).first()[0] or 0
    while not tiers or most > 1:
        grouped = nodes.select("key", F.floor(F.col("pos") / span).alias("block"), "pos", "total", "digest").groupBy("key", "block")
        tiers.append(settle(grouped.applyInArrow(lambda key, rows: _block(height, key, rows), _BLOCK), "merkle-blocks"))
        most = -(-most // span)
        nodes = tiers[-1].where(F.col("total") > span).select(
            "key", F.col("block").alias("pos"), F.ceil(F.col("total") / span).alias("total"), F.col("root").alias("digest"))
    return tiers


def roots_of(tiers: list[DataFrame], height: int) -> DataFrame:
    """(key, root): the root of the one block that is left of each key."""
    last = [t.where(F.col("total") <= FANOUT ** height).select("key", "root") for t in tiers]
    out = last[0]
    for more in last[1:]:
        out = out.unionByName(more)
    return out


def _paths(schema: pa.Schema, span: int, nodes: pa.Table, blocks: pa.Table) -> pa.Table:
    """``nodes`` with the siblings that their block holds and then those that the block's own path holds."""
    if not nodes.num_rows or not blocks.num_rows:
        return schema.empty_table()
    block = {name: blocks[name][0].as_py() for name in ("n", "height", "layout", "path", "tree_root")}
    inner = nodes["pos"].to_numpy() % span
    found = siblings(block["layout"], block["height"], block["n"])
    at, others = [], []
    for level, row in enumerate(found):
        index = inner // FANOUT ** level
        at.append(index % FANOUT)
        others.append([row[i] for i in index])
    for step in block["path"]:
        at.append(np.full(len(inner), step["at"]))
        others.append([step["others"]] * len(inner))
    steps = len(at)
    flat = pa.StructArray.from_arrays([
        pa.array(np.stack(at, 1).ravel() if steps else [], pa.int32()),
        pa.array([others[s][i] for i in range(len(inner)) for s in range(steps)], pa.binary()),
    ], names=["at", "others"])
    path = pa.ListArray.from_arrays(pa.array(np.arange(len(inner) + 1) * steps, pa.int32()), flat)
    columns = {name: nodes[name].combine_chunks() for name in nodes.column_names if name != "block"}
    columns |= {"path": path, "tree_root": pa.array([block["tree_root"]] * len(inner), pa.binary())}
    return pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema)


def _below(blocks: DataFrame, nodes: DataFrame, span: int) -> DataFrame:
    """``nodes``(key, pos, ...) plus path and tree_root, from the blocks(key, block, layout, path, ...) of ``span`` that hold them."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    step = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.binary())]))
    fields = [(name, kinds[kind]) for name, kind in nodes.dtypes] + [("path", step), ("tree_root", pa.binary())]
    schema = pa.schema(fields)
    out = ", ".join(f"{name} {kind}" for name, kind in nodes.dtypes) + f", path {_PATH}, tree_root binary"
    left = nodes.withColumn("block", F.floor(F.col("pos") / span)).groupBy("key", "block")
    right = blocks.select("key", "block", "n", "height", "layout", "path", "tree_root").groupBy("key", "block")
    return left.cogroup(right).applyInArrow(lambda key, a, b: _paths(schema, span, a, b), out)


def paths_of(tiers: list[DataFrame], nodes: DataFrame, height: int, above: DataFrame | None = None) -> DataFrame:
    """``nodes``(key, pos, ...) plus path, the siblings up to the key's root and then those of ``above``(key, path, tree_root).

    Goes down tier by tier: a block's own path is found in the block above it, so only digests of roots are
    shuffled until the leaves meet their blocks.
    """
    carried, span = None, FANOUT ** height
    for k in range(len(tiers) - 1, -1, -1):
        top = tiers[k].where(F.col("total") <= span)
        if above is None:
            top = top.withColumn("path", F.array().cast(_PATH)).withColumn("tree_root", F.col("root"))
        else:
            top = top.join(above.select("key", "path", "tree_root"), "key")
        if carried is not None:
            inner = _below(carried, tiers[k].where(F.col("total") > span).select("key", F.col("block").alias("pos")), span)
            inner = tiers[k].join(inner.select("key", F.col("pos").alias("block"), "path", "tree_root"), ["key", "block"])
            top = top.unionByName(inner)
        carried = top if k == 0 else settle(top, "merkle-paths")
    return _below(carried, nodes, span)


# --- the manifest --------------------------------------------------------------------------

@dataclass
class Manifest:
    """Stored tables of one dataset: ``leaves`` (key, pos, doc_id, leaf, changed), blocks by tier, the root (None: no rows)."""

    leaves: DataFrame
    tiers: list[DataFrame]
    sources: DataFrame
    source_tiers: list[DataFrame]
    root: str | None
    height: int

    def blocks(self) -> DataFrame:
        """(tree, tier, key, block, total, n, height, layout, root): everything a reader of proofs needs."""
        named = [("documents", k, t) for k, t in enumerate(self.tiers)] + [("sources", k, t) for k, t in enumerate(self.source_tiers)]
        out = None
        for tree, tier, blocks in named:
            rows = blocks.select(F.lit(tree).alias("tree"), F.lit(tier).alias("tier"), *blocks.columns)
            out = rows if out is None else out.unionByName(rows)
        return out

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, changed, subroot, path): to each document the siblings from its leaf to the dataset's root.

        A step of ``path`` is (at, others): the node's place in its run and the other digests of the run, 32 bytes each.
        """
        above = paths_of(self.source_tiers, self.sources.select("key", "pos", "label", "digest"), self.height)
        above = settle(above.select(F.col("label").alias("key"), "path", F.col("digest").alias("tree_root")), "merkle-above")
        found = paths_of(self.tiers, self.leaves.select("key", "pos", "doc_id", "leaf", "changed"), self.height, above)
        return found.select("doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("changed")).alias("changed"),
                            F.lower(F.hex("tree_root")).alias("subroot"), "path")


def build_manifest(docs: DataFrame, changed_text: Column | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of docs(doc_id, source, lang, n_chars, text), in blocks of ``height`` levels.

    Leaves ascend by doc_id inside a source, null first; documents of one doc_id by their digest, so repeated rows are leaves
    of their own and their order does not matter. A null source is a tree of its own, the first. Null fields, empty and
    very long texts are hashed as they are, inside Spark; only digests travel. An empty table has no root. Other columns are
    ignored. ``changed`` is the digest with ``changed_text`` for the text: what a tampered copy would hash to.
    """
    digest = F.unhex(leaf_digest())
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), digest.alias("leaf"),
        (digest if changed_text is None else F.unhex(leaf_digest(changed_text))).alias("changed"),
    ).withColumn("row", F.monotonically_increasing_id())  # parts copies of one row between ranges
    leaves = settle(numbered(settle(rows, "merkle-leaves"), "doc_id", "leaf", "row").drop("row"), "merkle-numbered")
    tiers = tiers_of(leaves.withColumn("digest", F.col("leaf")), height)
    subroots = roots_of(tiers, height).select(F.lit("").alias("key"), F.col("key").alias("label"), F.col("root").alias("digest"))
    sources = settle(numbered(settle(subroots, "merkle-subroots"), "label"), "merkle-sources")
    source_tiers = tiers_of(sources, height)
    root = roots_of(source_tiers, height).first()
    return Manifest(leaves, tiers, sources, source_tiers, root and bytes(root["root"]).hex(), height)


def proof_digest(path: Column) -> Column:
    """SHA-256 of all sibling digests of a path as hex text, in order."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda text, step: F.concat(text, F.lower(F.hex(step["others"])))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def up(node: Column, step: Column) -> Column:
        others, cut = F.lower(F.hex(step["others"])), step["at"] * 64
        return F.sha2(F.concat(F.substr(others, F.lit(1), cut), node, F.substr(others, cut + 1)), 256)

    return F.aggregate(path, leaf, up)


def tampered_text() -> Column:
    """The text with A-Z lower-cased where 5 divides the CRC-32 of the decimal doc_id; otherwise as it is."""
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(picked, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))


def audit(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each document.

    Every document's proof is read from the stored blocks and folded from its leaf after tampering.
    """
    manifest = build_manifest(docs, tampered_text(), height)
    folded_root, root = folded(F.col("changed"), F.col("path")), F.lit(manifest.root)
    return manifest.proofs().select(
        "doc_id", "leaf", "subroot", root.cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        folded_root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, *, source IS NOT NULL AS named, coalesce(source, '') AS s,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 5 = 0 AS hit
  FROM documents),
f AS (
  SELECT r, doc_id, named, s,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS bad
  FROM d),
leaves AS (
  SELECT r, doc_id, named, s, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(bad) || ':' || bad, '-')) AS changed FROM f),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY named, s ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY named, s) AS n FROM leaves),
nodes AS (
  SELECT named, s, 0 AS lvl, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT named, s, lvl + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY named, s, lvl, pos // 16),
subroots AS (SELECT named, s, lvl AS height, h AS subroot FROM nodes WHERE n = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY named, s) - 1 AS pos, count(*) OVER () AS n FROM subroots),
top AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM ranked
  UNION ALL
  SELECT lvl + 1, pos // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 16),
steps AS (
  SELECT p.r, x.lvl, string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos < (p.pos // (16 ** x.lvl)::BIGINT)) AS before,
    string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos > (p.pos // (16 ** x.lvl)::BIGINT)) AS after
  FROM placed p JOIN nodes x ON x.named = p.named AND x.s = p.s AND x.n > 1 AND x.pos // 16 = p.pos // (16 ** (x.lvl + 1))::BIGINT GROUP BY p.r, x.lvl
  UNION ALL
  SELECT p.r, q.height + x.lvl, string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos < (q.pos // (16 ** x.lvl)::BIGINT)),
    string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos > (q.pos // (16 ** x.lvl)::BIGINT))
  FROM placed p JOIN ranked q ON q.named = p.named AND q.s = p.s JOIN top x ON x.n > 1 AND x.pos // 16 = q.pos // (16 ** (x.lvl + 1))::BIGINT GROUP BY p.r, q.height, x.lvl),
climb AS (
  SELECT r, 0 AS lvl, changed AS h FROM leaves
  UNION ALL
  SELECT c.r, c.lvl + 1, sha256(coalesce(t.before, '') || c.h || coalesce(t.after, '')) FROM climb c JOIN steps t ON t.r = c.r AND t.lvl = c.lvl),
ends AS (SELECT r, arg_max(h, lvl) AS folded_root FROM climb GROUP BY r),
proof AS (SELECT r, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY lvl)) AS proof_sha256 FROM steps GROUP BY r)
SELECT p.doc_id, p.leaf, b.subroot, t.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
FROM placed p JOIN subroots b ON b.named = p.named AND b.s = p.s JOIN top t ON t.n = 1 JOIN ends e ON e.r = p.r LEFT JOIN proof q ON q.r = p.r
"""
