"""Merkle manifest of a table: a hash tree per group, one over the groups, a proof per row.

Rows become leaves; in a group they ascend by an order column, and every ``fan`` consecutive
nodes of a level become one node of the next, until one is left (a lone leaf is that node).
The nodes of the groups, in group order, go the same way to the root.

Within a block of ``fan ** depth`` consecutive rows a level is a row of window columns: nodes
of level k stand in the rows whose place is a multiple of ``fan ** k``, lag and lead columns at
fixed multiples of it, masked by slot, are the siblings, and the first child of each run hashes
the parent.  All levels of a block share one shuffle and one sort, by (group, block), so a group
of any size spreads over as many tasks as it has blocks.  The tops of the blocks are the leaves
of the next, far smaller round.

Digests are lowercase hex sha256.  Null groups are a group of their own and come first, null
order values come first, rows that tie are ordered by their leaf; repeated rows are repeated
leaves.  An empty table gives an empty manifest.  Texts are hashed where they are read and are
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.operators.rowindex import ROW, sort_index
from gridlake.session import stage

FAN, DEPTH = 8, 4
#: group tables up to this many rows (of under 200 bytes) are broadcast, larger ones are joined by shuffle
SMALL_GROUPS = 20_000
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value's text in UTF-8, a colon and that text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return digest(*map(field, fields))


def fold(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(path, leaf_digest, lambda node, step: digest(step["left"], node, step["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def _climb(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """Adds ``_path`` (siblings at each level inside the row's block) and ``_top``, the block's node.

    ``nodes`` has _tree, _pos (0, 1, 2 ... in its tree), _n (nodes of the tree) and _node.
    """
    rows = nodes.withColumn("_block", F.floor(F.col("_pos") / fan ** depth)).withColumn("_top", F.col("_node"))
    by_place = Window.partitionBy("_tree", "_block").orderBy("_pos")
    upto = by_place.rowsBetween(Window.unboundedPreceding, 0)
    for k in range(depth):
        stride = fan ** k
        several = F.col("_n") > stride  # more than one node is left at this level
        here = several & (F.col("_pos") % stride == 0)
        slot = F.floor(F.col("_pos") / stride) % fan
        # a run that ends early, or a block that does, has nothing to lead to
        before = [F.when(slot >= j, F.lag("_top", j * stride).over(by_place)) for j in range(fan - 1, 0, -1)]
        behind = [F.when(slot + j < fan, F.lead("_top", j * stride).over(by_place)) for j in range(1, fan)]
        rows = rows.withColumns({"_left": F.concat_ws("", *before), "_right": F.concat_ws("", *behind)})
        own = F.when(here, F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))
        parent = F.when(several, digest(F.col("_top"), F.col("_right"))).otherwise(F.col("_top"))
        # the rows below a node take over its siblings: the nearest row above them that holds one
        rows = rows.withColumn("_own", own).withColumns({
            f"_step{k}": F.when(several, F.last("_own", ignorenulls=True).over(upto)),
            "_top": F.when(F.col("_pos") % (stride * fan) == 0, parent),
        })
    path = F.array_compact(F.array(*[f"_step{k}" for k in range(depth)])).cast(_PATH)
    return rows.withColumns({"_path": path, "_top": F.first("_top", ignorenulls=True).over(upto)}).select(
        *nodes.columns, "_block", "_path", "_top"
    )


def hash_trees(nodes: DataFrame, fan: int = FAN, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with ``_path`` and ``_root`` of their trees, and the roots (_tree, _root).

    Each round leaves one row per block: ``fan ** depth`` times fewer.
    """
    climbed = _climb(nodes, fan, depth)
    size = fan ** depth
    tops = climbed.filter(F.col("_pos") % size == 0).select(
        "_tree", F.col("_block").alias("_pos"), F.ceil(F.col("_n") / size).alias("_n"), F.col("_top").alias("_node")
    )
    tops = stage(tops, "merkle-blocks")
    if tops.filter("_n > 1").isEmpty():
        roots = tops.select("_tree", F.col("_node").alias("_root"))
        return climbed.withColumnRenamed("_top", "_root").drop("_block"), roots
    above, roots = hash_trees(tops, fan, depth)
    above = above.select("_tree", F.col("_pos").alias("_block"), F.col("_path").alias("_above"), "_root")
    # the left side keeps the partitioning of its windows; the right one is a row per block
    joined = climbed.join(above, ["_tree", "_block"])
    return joined.withColumn("_path", F.concat("_path", "_above")).drop("_block", "_above", "_top"), roots


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_GROUPS else df


def manifest(
    docs: DataFrame, fields: tuple[str, ...], group: str, order: str, extra: dict[str, Column] | None = None,
    fan: int = FAN, depth: int = DEPTH,
) -> DataFrame:
    """(group, order, extra, leaf, subroot, root, path) of every row of ``docs``.

    ``path`` lists the left and right siblings of the row's node at each level, via the node of
    its group to the root; ``fold(leaf, path)`` is the root.  ``extra`` are more columns to
    compute where the rows are read.  ``group`` and ``order`` must not be named like the results.
    """
    extra = extra or {}
    leaves = docs.select(
        F.col(group).alias("_group"), F.col(order).alias("_order"), leaf(*[F.col(f) for f in fields]).alias("_node"),
        *[c.alias(f"_x_{name}") for name, c in extra.items()],
    )
    leaves = stage(leaves, "merkle-leaves")
    placed = sort_index(leaves, [F.col("_group").asc(), F.col("_order").asc(), F.col("_node").asc()])
    # a group is named by the place of its first row: these numbers ascend as the groups do
    groups = stage(
        placed.groupBy("_group").agg(F.min(ROW).alias("_tree"), F.count(F.lit(1)).alias("_n")), "merkle-groups"
    )
    n_groups = groups.count()
    named = _small(groups.withColumnRenamed("_group", "_g"), n_groups)
    nodes = placed.join(named, placed["_group"].eqNullSafe(named["_g"])).drop("_g")
    nodes = nodes.withColumn("_pos", F.col(ROW) - F.col("_tree")).drop(ROW)
    rows, roots = hash_trees(nodes, fan, depth)
    subroots = sort_index(roots.select("_tree", "_root"), [F.col("_tree").asc()])
    heads = subroots.select(
        F.lit(0).cast("long").alias("_tree"), F.col(ROW).alias("_pos"), F.lit(n_groups).cast("long").alias("_n"),
        F.col("_root").alias("_node"), F.col("_tree").alias("_of"),
    )
    tops, _ = hash_trees(heads, fan, depth)
    tops = stage(tops.select("_of", F.col("_path").alias("_last"), F.col("_root").alias("_whole")), "merkle-top")
    out = rows.join(_small(tops, n_groups), rows["_tree"] == tops["_of"])
    return out.select(
        F.col("_group").alias(group), F.col("_order").alias(order), *[F.col(f"_x_{n}").alias(n) for n in extra],
        F.col("_node").alias("leaf"), F.col("_root").alias("subroot"), F.col("_whole").alias("root"),
        F.concat("_path", "_last").alias("path"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tamper_check(docs: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """The manifest of documents, verified after the texts of a third of them were lower-cased.

    Tampered are ids whose crc32 is a multiple of 3; rows without an id are not.  A text without
    A-Z, or null, stays what it is and verifies.
    """
    altered = [F.translate("text", _UPPER, _LOWER) if f == "text" else F.col(f) for f in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    forged = F.when(chosen, leaf(*altered))
    rows = manifest(docs, FIELDS, "lang", "doc_id", {"forged": forged}, fan, depth)
    folded = fold(F.coalesce("forged", "leaf"), F.col("path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(text: str) -> str:
    parts = [f if f != "text" else text for f in FIELDS]
    return "sha256(concat(" + ", ".join(
        f"CASE WHEN {p} IS NULL THEN '-' ELSE strlen(({p})::VARCHAR) || ':' || ({p})::VARCHAR END" for p in parts
    ) + "))"


def _sql_climb(name: str, start: str) -> str:
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT tree, level + 1, pos // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(node, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // {FAN}, n)"""


def _sql_siblings(name: str, nodes: str) -> str:
    run = f"PARTITION BY tree, level, pos // {FAN} ORDER BY pos ROWS BETWEEN"
    return f"""{name} AS MATERIALIZED (SELECT tree, level, pos,
    coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lhs,
    coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rhs
  FROM {nodes} WHERE n > 1)"""


def _sql_fold(name: str, start: str, siblings: str) -> str:
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT f.row, f.tree, f.level + 1, f.pos // {FAN}, sha256(lhs || acc || rhs), f.proof || lhs || rhs
  FROM {name} f JOIN {siblings} s ON s.tree = f.tree AND s.level = f.level AND s.pos = f.pos)"""


#: SQL of ``tamper_check``; crc32 is spelled out, byte by byte from its table
MANIFEST_SQL = f"""WITH RECURSIVE
bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
hashed AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, lang, {_sql_leaf('text')} AS leaf,
    {_sql_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS lowered,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0 AS tampered
  FROM documents, crc),
leaves AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM hashed),
{_sql_climb('nodes', 'SELECT tree, 0 AS level, pos, n, leaf AS node FROM leaves')},
subroots AS MATERIALIZED (SELECT tree, node FROM nodes WHERE n = 1),
{_sql_climb('top', 'SELECT 0 AS tree, 0 AS level, tree - 1 AS pos, count(*) OVER () AS n, node FROM subroots')},
{_sql_siblings('sib', 'nodes')},
{_sql_siblings('top_sib', 'top')},
{_sql_fold('inner_fold', "SELECT row, tree, 0 AS level, pos, CASE WHEN tampered THEN lowered ELSE leaf END AS acc, '' AS proof FROM leaves", 'sib')},
reached AS MATERIALIZED (
  SELECT row, tree, arg_max(acc, level) AS acc, arg_max(proof, level) AS proof FROM inner_fold GROUP BY row, tree),
{_sql_fold('outer_fold', 'SELECT row, 0 AS tree, 0 AS level, tree - 1 AS pos, acc, proof FROM reached', 'top_sib')},
done AS (SELECT row, arg_max(acc, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM outer_fold GROUP BY row)
SELECT l.doc_id, l.leaf, s.node AS subroot, r.node AS root, d.proof_sha256, d.folded_root, d.folded_root = r.node AS verified
FROM leaves l JOIN done d USING (row) JOIN subroots s USING (tree), (SELECT node FROM top WHERE n = 1) r"""
