"""A Merkle manifest of a table: leaf digests, a tree for each group, one tree over the groups, and a proof per row.

Slot pivot: the children of a parent are rows with a slot (their place in the run). Conditional aggregates spread the
slots into columns, so that a parent's children are `fanout` neighbouring columns of one row; the columns joined are
hashed to the parent, and the columns without the own slot are its siblings. One shuffle serves `_depth(fanout)` levels:
the descendants of a node that many levels up become columns together (16 for pairs), and the levels between are
hashed from columns to columns. A table of n leaves takes log16(n) such passes upwards, each a sixteenth of the last, and as
many joins downwards that hand each child its parent's path. No row meets more than its run, so a group that holds
most rows is spread over all tasks like the others.

Rows are numbered inside a group by ranges: a range partitioning gives each task a stretch of (group, id), counts of the
stretches before give its offset. Nothing but those counts is collected or broadcast, and only up to a checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rostrum.llm.shared import partitions, sized, written

#: Columns that one pass spreads, at most (but one level at least).
COLUMNS = 16


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of strings set end to end; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def netstring(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value (numbers in decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """A row's leaf: the digest of its values, each with its length in front, so no two rows share an input."""
    return digest(*map(netstring, values))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path (array of structs left, right from the leaf's run upwards) give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def path_text(path: Column) -> Column:
    """The siblings of a path set end to end: level by level upwards, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _depth(fanout: int) -> int:
    """Levels that one pass climbs."""
    depth = 1
    while fanout ** (depth + 1) <= COLUMNS:
        depth += 1
    return depth


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` (a written table) with `at`, gapless from 0 inside `group` in `order` (nulls first), and `_n`, the group's
    number of rows."""
    n = max(1, partitions(rows.sparkSession))
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]]
    ranged = written(rows.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "ranged")
    before = F.sum("_rows").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = ranged.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = written(
        counts.select(group, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(W.partitionBy(group)).alias("_n")), "offsets"
    )
    within = F.row_number().over(W.partitionBy(group, "_part").orderBy(*keys[1:])) - 1
    return ranged.withColumn("at", within).join(sized(offsets), [group, "_part"]).withColumn("at", F.col("at") + F.col("_before")).drop("_part", "_before")


def _levels(n: str, fanout: int) -> Column:
    """Levels of a tree over n leaves: how often n nodes can be put into runs until one is left."""
    reach = [1]
    while reach[-1] * fanout < 1 << 62:
        reach.append(reach[-1] * fanout)
    return F.expr(f"cast(size(filter(array({', '.join(f'{r}L' for r in reach)}), r -> {n} > r)) as int)")


def _climb(nodes: DataFrame, fanout: int, first: int) -> DataFrame:
    """One pass upwards from level `first`. nodes: (grp, levels, at, item), item a struct whose first field is `node`.

    Gives (grp, levels, at, node, c0, c1, ...): the node that stands _depth levels up, and per slot a struct of its item
    and `steps`, its path inside this pass. A tree that ends on the way keeps its top. In the SQL, n<k>_<m> is the m-th
    node of level k below the new one."""
    depth = _depth(fanout)
    wide = fanout**depth
    joined = lambda names: f"concat_ws('', {', '.join(names)})" if names else "''"
    spread = nodes.groupBy("grp", "levels", F.expr(f"at div {wide}").alias("at")).agg(
        *[F.expr(f"any_value(CASE WHEN at % {wide} = {j} THEN item END, true)").alias(f"i{j}") for j in range(wide)]
    )
    level = [f"i{j}.node" for j in range(wide)]
    steps: list[list[str]] = [[] for _ in range(wide)]
    for k in range(depth):
        own = [f"n{k}_{m}" for m in range(len(level))]
        spread = spread.selectExpr("*", *[f"{e} AS {c}" for e, c in zip(level, own)])
        for j in range(wide):
            m = j // fanout**k
            a = m // fanout * fanout
            steps[j].append(f"struct({joined(own[a:m])} AS left, {joined(own[m + 1 : a + fanout])} AS right)")
        runs = [own[a : a + fanout] for a in range(0, len(own), fanout)]
        level = [f"CASE WHEN {run[0]} IS NULL THEN NULL WHEN levels > {first + k} THEN sha2({joined(run)}, 256) ELSE {run[0]} END" for run in runs]
    here = f"greatest(0, least({depth}, levels - {first}))"
    slots = [f"CASE WHEN i{j} IS NOT NULL THEN struct(i{j} AS item, slice(array({', '.join(steps[j])}), 1, {here}) AS steps) END AS c{j}" for j in range(wide)]
    return spread.selectExpr("grp", "levels", "at", f"{level[0]} AS node", *slots)


def trees(leaves: DataFrame, fanout: int = 2) -> tuple[DataFrame, DataFrame]:
    """All trees at once. leaves: (grp string, levels, at, item).

    Gives (grp, item, path) per leaf and (grp, node) per group: the top of its tree."""
    deepest = leaves.agg(F.max("levels")).first()[0] or 0
    depth = _depth(fanout)
    wide = fanout**depth
    passes, nodes, first = [], leaves, 0
    while not passes or first < deepest:
        up = written(_climb(nodes, fanout, first), "climbed")
        passes.append(up)
        nodes = up.select("grp", "levels", "at", F.struct("node").alias("item"))
        first += depth
    tops = passes[-1].select("grp", "node")
    empty = F.array().cast("array<struct<left:string,right:string>>")
    above = passes[-1].select("grp", "at", empty.alias("path"))
    slots = f"posexplode(array({', '.join(f'c{j}' for j in range(wide))}))"
    for k, up in reversed(list(enumerate(passes))):
        each = up.join(sized(above, width=96 + 2 * 64 * (fanout - 1) * (len(passes) - k) * depth), ["grp", "at"])
        children = each.select("grp", "at", "path", F.expr(slots).alias("slot", "c")).where("c IS NOT NULL")
        down = children.select("grp", (F.col("at") * wide + F.col("slot")).alias("at"), F.col("c.item").alias("item"), F.concat("c.steps", "path").alias("path"))
        above = written(down.select("grp", "at", "path"), "paths") if k else down.select("grp", "item", "path")
    return above, tops


def manifest(leaves: DataFrame, group_col: str, order_cols: list[str], leaf_col: str = "leaf", fanout: int = 2) -> DataFrame:
    """`leaves` with subroot, root and path: an array of structs (left, right), the siblings of the node that stands
    above the row, run by run up to the subroot of its group and on to the root.

    Leaves of a group ascend by `order_cols` (nulls first); every `fanout` consecutive nodes become one, the last run
    also when it is shorter or has one node, until one is left: a lone leaf is its own subroot. Groups ascend by
    their text (null first, then by bytes) and give the root alike. Rows that tie in `order_cols` are ordered by their leaf;
    equal rows get a place each. No rows give no rows. Other columns come along, but for any named subroot, root or path."""
    kept = [F.col(f"`{c}`") for c in leaves.columns if c.lower() not in ("subroot", "root", "path")]
    payload = F.struct(F.col(leaf_col).alias("node"), F.struct(*kept).alias("row"))
    grp = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    base = leaves.select(grp.alias("grp"), payload.alias("item"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], F.col(leaf_col).alias("_leaf"))
    order = [*[f"_o{i}" for i in range(len(order_cols))], "_leaf", "_salt"]
    # a number fixed by the write splits even a run of equal rows over the ranges
    placed = _numbered(written(base.withColumn("_salt", F.monotonically_increasing_id()), "leaves"), "grp", order)
    rows, tops = trees(placed.select("grp", _levels("_n", fanout).alias("levels"), "at", "item"), fanout)
    groups = _numbered(written(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.struct("node", F.col("grp").alias("name")).alias("item")), "tops"), "grp", ["name"])
    group_paths, roots = trees(groups.select("grp", _levels("_n", fanout).alias("levels"), "at", "item"), fanout)
    whole = written(
        group_paths.join(sized(roots.select("grp", F.col("node").alias("root"))), "grp").select(F.col("item.name").alias("grp"), F.col("item.node").alias("subroot"), "root", F.col("path").alias("upper")), "groups"
    )
    out = rows.join(sized(whole, width=512), "grp")
    return out.select("item.row.*", "subroot", "root", F.concat("path", "upper").alias("path"))
