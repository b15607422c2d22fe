"""A Merkle manifest: a tree of digests per group of rows, a tree over the groups, and a proof for each row.

Leaves are cut into superblocks of ``arity ** levels`` consecutive ones, which are whole subtrees. A first pass
reduces every superblock to its top; the tops are proved the same way until one node is left. Then leaves and the
outer nodes that their superblock needs are cogrouped by superblock: one call finishes the local reduction, joins
the two parts of each proof and folds a presented leaf up to the root. No task holds a whole group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshelf.llm.common import forget, settle

#: Rows that go to one call, about; superblocks are dealt out so that small groups share a call.
CALL_ROWS = 4096
_NODE = "tree string, pos bigint, total bigint, digest binary"


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as UTF-8 byte count, colon and value, or ``-`` if it is NULL."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: str, proof: list[str]) -> str:
    """The root that a leaf and its proof lead to; ``proof`` has the left and the right siblings of each level in turn."""
    for left, right in zip(proof[::2], proof[1::2]):
        leaf = digest(left + leaf + right)
    return leaf


def height(total: int, arity: int) -> int:
    """Levels between a leaf and the top of a tree of so many leaves."""
    up = 0
    while total > 1:
        total, up = -(-total // arity), up + 1
    return up


def _reduce(nodes: list[str], steps: int, arity: int) -> list[list[str]]:
    """The nodes of a superblock by level, the top level last."""
    out = [nodes]
    for _ in range(steps):
        nodes = [digest("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        out.append(nodes)
    return out


def _proof(by_level: list[list[str]], at: int, arity: int) -> list[str]:
    out = []
    for nodes in by_level[:-1]:
        first = at - at % arity
        out += ["".join(nodes[first:at]), "".join(nodes[at + 1 : first + arity])]
        at //= arity
    return out


def _blocks(rows: pd.DataFrame, arity: int, levels: int) -> Iterator[tuple[tuple[str, int], pd.DataFrame, list[list[str]]]]:
    """Every superblock among the rows: its name, its rows in order, and its nodes by level."""
    rows = rows.assign(block=rows["pos"] // arity**levels).sort_values(["tree", "pos"], kind="stable")
    for name, own in rows.groupby(["tree", "block"], sort=False):
        steps = min(levels, height(int(own["total"].iat[0]), arity))
        yield name, own, _reduce([d.hex() for d in own["digest"]], steps, arity)


def numbered(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """Place of each row in its group (``pos``, from 0) and the group's size (``total``), for groups of any size.

    Rows are dealt out by ranges of group and order and written with the number of their range, so a group spans
    many ranges; a place is the place within the range and the sizes of the ranges before it.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.monotonically_increasing_id()  # rows equal in everything are spread too; any order of them is the same
    dealt = df.withColumn("_tie", tie).repartitionByRange(n, *groups, *order, F.col("_tie")).withColumn("_range", F.spark_partition_id())
    dealt = settle(dealt, "ranges")
    sizes = dealt.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*groups, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias("total"))
    local = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order, "_tie"))
    placed = dealt.withColumn("_local", local).join(sizes, [*groups, "_range"])
    out = settle(placed.withColumn("pos", (F.col("_local") + F.col("_before") - 1).cast("long")).drop("_local", "_before", "_range", "_tie"), "numbered")
    forget(dealt)
    return out


def _dealt(df: DataFrame, block: str, calls: int) -> DataFrame:
    """Rows with the call that their superblock goes to."""
    return df.withColumn("call", F.pmod(F.xxhash64("tree", F.expr(block)), F.lit(calls))).groupBy("call")


def _calls(rows: int) -> int:
    return rows // CALL_ROWS + 1


def _tops(nodes: DataFrame, arity: int, levels: int, calls: int) -> DataFrame:
    span = arity**levels

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(tree, block, -(-int(own["total"].iat[0]) // span), bytes.fromhex(by_level[-1][0])) for (tree, block), own, by_level in _blocks(rows, arity, levels)]
        return pd.DataFrame(out, columns=["tree", "pos", "total", "digest"])

    return settle(_dealt(nodes, f"pos div {span}", calls).applyInPandas(top, _NODE), "tops")


def _proved(nodes: DataFrame, outer: DataFrame | None, extra: list[str], finish: Callable, schema: str, arity: int, levels: int, calls: int) -> DataFrame:
    """``finish`` for every superblock of ``nodes`` with the outer nodes of the same superblock."""
    span = arity**levels

    def own_and_outer(rows: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        above = {(t.tree, t.pos): (list(t.proof), t.subroot, t.root) for t in tops.itertuples()}
        out = [finish(own, by_level, above.get((tree, block), ([], by_level[-1][0], by_level[-1][0]))) for (tree, block), own, by_level in _blocks(rows, arity, levels)]
        return pd.concat(out) if out else pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])

    left = _dealt(nodes.select("tree", "pos", "total", "digest", *extra), f"pos div {span}", calls)
    if outer is None:
        none = pd.DataFrame(columns=["tree", "pos", "proof", "subroot", "root"])
        return left.applyInPandas(lambda rows: own_and_outer(rows, none), schema)
    return left.cogroup(_dealt(outer, "pos", calls)).applyInPandas(own_and_outer, schema)


def _prove(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """Proof and root of every node in its tree: ``tree``, ``pos``, ``proof``, ``subroot``, ``root`` (both the tree's)."""
    most, rows = nodes.agg(F.max("total"), F.count(F.lit(1))).first()  # one row
    schema = "tree string, pos bigint, proof array<string>, subroot string, root string"

    def finish(own: pd.DataFrame, by_level: list[list[str]], above: tuple[list[str], str, str]) -> pd.DataFrame:
        proofs = [_proof(by_level, i, arity) + above[0] for i in range(len(own))]
        return pd.DataFrame({"tree": own["tree"], "pos": own["pos"], "proof": proofs, "subroot": above[1], "root": above[2]})

    outer = None
    if (most or 0) > arity**levels:
        tops = _tops(nodes, arity, levels, _calls(rows))
        outer = _prove(tops, arity, levels)
        forget(tops)
    out = settle(_proved(nodes, outer, [], finish, schema, arity, levels, _calls(rows)), "proofs")
    if outer is not None:
        forget(outer)
    return out


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "source",
    field_cols: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    presented: Column | None = None,
    arity: int = 3,
    levels: int = 6,
) -> DataFrame:
    """Digests and proof of every row: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof``, ``folded_root``.

    The leaf is the digest of ``field_cols``. The leaves of a group ascend by id; runs of ``arity`` nodes become
    one until one is left, the group's ``subroot``; the subroots, by group, become ``root`` in the same way.
    ``proof`` holds the left and the right siblings of each level from leaf to root in turn, as joined hex digests.
    ``folded_root`` is what the digest ``presented`` (the leaf itself by default) folds up to with that proof.

    NULL fields count as ``-``; NULL groups are one group, before all others, which go by their UTF-8 bytes; NULL ids
    stand first. Rows of one id stand by their leaf; rows equal in all fields are leaves each, and it does not matter
    which is first. Empty texts are texts of no bytes; a long text is hashed whole by Spark. A lone leaf is its group's
    subroot, a lone subroot the root. An empty table gives an empty table. Only the named columns are read, so others
    may have any name.
    """
    group = docs[group_col].cast("string")
    leaf = leaf_digest(*[docs[c] for c in field_cols])
    # sorts as the group does, NULL first
    tree = F.when(group.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), group))
    rows = docs.select(docs[id_col].alias("doc_id"), tree.alias("tree"), F.unhex(leaf).alias("digest"), (leaf if presented is None else presented).alias("shown"))
    # a digest that was not changed is not carried twice
    rows = rows.withColumn("shown", F.when(F.unhex("shown") != F.col("digest"), F.unhex("shown")))
    leaves = settle(rows, "leaves")
    nodes = numbered(leaves, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("shown").asc_nulls_first()])
    forget(leaves)
    calls = _calls(nodes.count())
    tops = _tops(nodes, arity, levels, calls)
    within = _prove(tops, arity, levels)
    subroots = within.groupBy("tree").agg(F.first("subroot").alias("subroot"))
    trees = numbered(subroots.select(F.lit("").alias("one"), F.col("tree").alias("name"), F.unhex("subroot").alias("digest")), ["one"], [F.col("name")])
    across = _prove(trees.withColumnRenamed("one", "tree"), arity, levels).select("pos", F.col("proof").alias("_proof"), F.col("root").alias("_root"))
    of_tree = trees.join(across, "pos").select(F.col("name").alias("tree"), "_proof", "_root")
    outer = within.join(of_tree, "tree").select("tree", "pos", F.concat("proof", "_proof").alias("proof"), "subroot", F.col("_root").alias("root"))
    outer = settle(outer, "outer")
    for done in (tops, within, trees):
        forget(done)

    def finish(own: pd.DataFrame, by_level: list[list[str]], above: tuple[list[str], str, str]) -> pd.DataFrame:
        proofs = [_proof(by_level, i, arity) + above[0] for i in range(len(own))]
        shown = [s.hex() if s is not None else leaf for s, leaf in zip(own["shown"], by_level[0])]
        folded = [fold(s, p) for s, p in zip(shown, proofs)]
        return pd.DataFrame({"doc_id": own["doc_id"], "leaf": by_level[0], "subroot": above[1], "root": above[2], "proof": proofs, "folded_root": folded})

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, leaf string, subroot string, root string, proof array<string>, folded_root string"
    return _proved(nodes, outer, ["doc_id", "shown"], finish, schema, arity, levels, calls)
