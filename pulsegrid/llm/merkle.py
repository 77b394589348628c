"""Merkle manifest of a table: per group a tree over its rows in ascending key order, and a tree over the groups' roots.

Rows get their exact rank within the group without a sort of the group: keys are written as strings of hexadecimal digits, and a
hierarchy of digit histograms (groups of three digits) adds up, for each node of the trie of keys, what comes before it among its
siblings; only rows of one lowest node are ordered among themselves. The ranks, written in digits of base `FANOUT`, are then the
keys of a second trie: rows of a common prefix (all but the last three digits) meet and are reduced by longest prefix first,
three levels at a time, until one node remains. Going down again, each row gathers the siblings on its way to the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import settle

FANOUT, LEVELS = 8, 3
TOGETHER = FANOUT**LEVELS
#: Digits of a step of the histograms, and how many rows at most are ordered within one lowest node if longer prefixes can tell them apart.
DIGITS, MOST = 3, 65_536
#: Copies of one row are written out in runs of this size.
RUN = 4096


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` if null, else its length in UTF-8 bytes, a colon and itself (integers as decimals)."""
    own = value.cast("string")
    return F.when(own.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _key(key: Column) -> Column:
    """An integer as 17 digits in ascending order, null first."""
    return F.when(key.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(key.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")))


def ranks(rows: DataFrame, depth: int, longest: int) -> DataFrame:
    """rows (group, order, copies, ...) with `first`: how many copies of the group come before in the order of the strings `order`.

    `order` tells all rows of a group apart. Histograms begin with prefixes of `depth` digits and go on to longer ones, up to
    `longest`, while a prefix has more than MOST rows.
    """
    while True:
        node = F.substring("order", 1, depth)
        fine = settle(rows.groupBy("group", node.alias("node")).agg(F.sum("copies").alias("n"), F.count("*").alias("rows")), "histogram")
        if depth >= longest or (fine.agg(F.max("rows")).first()[0] or 0) <= MOST:
            break
        depth += DIGITS
    base, parent = None, 0
    for upto in [*range(DIGITS, depth, DIGITS), depth]:
        level = fine.groupBy("group", F.substring("node", 1, upto).alias("node")).agg(F.sum("n").alias("n"))
        siblings = Window.partitionBy("group", F.substring("node", 1, parent)).orderBy("node")
        level = level.select("group", "node", (F.sum("n").over(siblings) - F.col("n")).alias("before"))
        if base is not None:
            above = base.select(F.col("group").alias("_group"), F.col("node").alias("_node"), F.col("before").alias("_before"))
            level = level.join(above, (F.col("group") == F.col("_group")) & (F.substring("node", 1, parent) == F.col("_node")))
            level = level.select("group", "node", (F.col("before") + F.col("_before")).alias("before"))
        base, parent = level, upto
    base = base.select(F.col("group").alias("_group"), F.col("node").alias("_node"), "before")
    within = F.sum("copies").over(Window.partitionBy("group", "node").orderBy("order")) - F.col("copies")
    ordered = rows.withColumn("node", node).withColumn("within", within)
    found = ordered.join(base, (F.col("group") == F.col("_group")) & (F.col("node") == F.col("_node")))
    return found.select(*rows.columns, (F.col("before") + F.col("within")).alias("first"))


def _height(n: Column) -> Column:
    """Levels of a tree of n leaves."""
    return sum((n > FANOUT**k).cast("int") for k in range(21))


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * FANOUT + 1, FANOUT), "").cast("binary"), 256))


def _build(nodes: DataFrame, heights: DataFrame | Column, most: int) -> list[DataFrame]:
    """Tables from the leaves (group, rank, digest, ...) up, each of TOGETHER nodes a row: group, rank, height, members, levels l0 to l2, top.

    A tree of a group ends where one node is left, be it in the middle of a table; `heights` has the groups' levels, or is that of all.
    """
    out, level, more = [], 0, [c for c in nodes.columns if c not in ("group", "rank", "digest")]
    while True:
        member = F.struct("rank", "digest", *more)
        rows = nodes.groupBy("group", F.floor(F.col("rank") / TOGETHER).alias("up")).agg(F.sort_array(F.collect_list(member)).alias("members"))
        if isinstance(heights, Column):
            rows = rows.withColumn("height", heights)
        else:
            rows = rows.join(heights.select(F.col("group").alias("_group"), "height"), F.col("group") == F.col("_group")).drop("_group")
        rows = rows.withColumn("l0", F.transform("members", lambda m: m.digest))
        for j in range(LEVELS):
            rows = rows.withColumn(f"l{j + 1}", F.when(F.col("height") > level + j, _parents(F.col(f"l{j}"))).otherwise(F.col(f"l{j}")))
        rows = rows.select("group", F.col("up").alias("rank"), "height", "members", *(f"l{j}" for j in range(LEVELS)), F.get(f"l{LEVELS}", 0).alias("top"))
        out.append(settle(rows, "trie"))
        level, more = level + LEVELS, []
        if most <= FANOUT**level:
            return out
        nodes = out[-1].select("group", "rank", F.col("top").alias("digest"))


def _steps(level: int, at: Column) -> Column:
    """The siblings of member `at` of a row on its way up: structs (left, right) of their digests, one for each level there is."""
    found = []
    for j in range(LEVELS):
        place, nodes = F.shiftright(at, 3 * j), F.col(f"l{j}")
        start = F.shiftleft(F.shiftright(place, 3), 3)
        left, right = F.slice(nodes, start + 1, place - start), F.slice(nodes, place + 2, start + FANOUT - 1 - place)
        found.append(F.when(F.col("height") > level + j, F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))))
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def _descend(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """The leaves of _build's tables, each with what `top` (group, path, ...) has of its group; `path` begins with the leaf's own siblings."""
    kept = [c for c in top.columns if c not in ("group", "path")]
    down = top.withColumn("rank", F.lit(0).cast("long"))
    for level in range(len(tables) - 1, -1, -1):
        above = down.select(F.col("group").alias("_group"), F.col("rank").alias("_rank"), F.col("path").alias("_path"), *kept)
        met = tables[level].join(above, (F.col("group") == F.col("_group")) & (F.col("rank") == F.col("_rank")))
        each = met.select("*", F.posexplode("members").alias("_at", "_member"))
        down = each.select("group", "_member.*", F.concat(_steps(LEVELS * level, F.col("_at")), "_path").alias("path"), *kept)
    return down


def manifest(docs: DataFrame, leaf: Column, *, key: str = "doc_id", group: str = "lang", carry: dict[str, Column] | None = None) -> DataFrame:
    """(key, group, rank, leaf, the columns of `carry`, subroot, root, path) of every row of docs; `leaf` is its digest.

    A group's rows ascend by key (null first), then by leaf and carried columns. While several nodes remain, every FANOUT
    neighbours (fewer at the end, even one) become one; what remains is the group's subroot, and the subroots, by the bytes of
    the group's text (null first), give the root in the same way. `path` has the siblings to the left and right on each level,
    from the leaf to the root; `fold` walks it. Equal rows (copies) are counted before anything meets and have neighbouring
    ranks; a group of a third of all rows is cut by prefixes like any other. An empty table gives an empty result.
    """
    more = carry or {}
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(group).alias("_of"), leaf.alias("digest"), *(c.alias(n) for n, c in more.items()))
    named = own.select(F.when(F.col("_of").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("_of").cast("string"))).alias("group"), "key", "digest", *more)
    leaves = settle(named.groupBy("group", "key", "digest", *more).agg(F.count("*").alias("copies")), "leaves")
    told = leaves.withColumn("order", F.concat(_key(F.col("key")), F.col("digest"), *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in more)))
    first = ranks(told, 15, 17 + 64)
    runs = first.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))))
    copy = F.explode(F.sequence(F.col("_run") * RUN, F.least((F.col("_run") + 1) * RUN, "copies") - 1))
    nodes = runs.select("group", "key", "digest", *more, "first", copy.alias("_copy")).select("group", (F.col("first") + F.col("_copy")).alias("rank"), "digest", "key", *more)
    sizes = settle(leaves.groupBy("group").agg(F.sum("copies").alias("n")).withColumn("height", _height(F.col("n"))), "sizes")
    trees = _build(nodes, sizes, sizes.agg(F.max("n")).first()[0] or 0)
    subroots = trees[-1].select(F.col("group").alias("name"), F.col("top").alias("digest"))
    named = subroots.select(F.lit("").alias("group"), F.hex(F.encode("name", "utf-8")).alias("order"), F.lit(1).cast("long").alias("copies"), "name", "digest")
    longest = 2 * (sizes.agg(F.max(F.octet_length("group"))).first()[0] or 1)
    forest = ranks(named, DIGITS, longest).select("group", F.col("first").alias("rank"), "digest", "name")
    n = sizes.count()
    upper = _build(forest, _height(F.lit(n)), n)
    start = upper[-1].select("group", F.col("top").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    groups = _descend(upper, start).select(F.col("name").alias("group"), "path", "root", F.col("digest").alias("subroot"))
    found = _descend(trees, groups)
    kind = docs.schema[group].dataType
    return found.select(F.col("key").alias(key), F.when(F.col("group") != "0", F.substring("group", 2, 2**31 - 1)).cast(kind).alias(group), "rank", F.col("digest").alias("leaf"), *more, "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(s.left, own, s.right).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, from the leaf up, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), "")
