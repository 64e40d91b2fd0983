"""Prefix trie of conversations, by rollups over positional columns.

A turn's id is a 128-bit digest of its role and text. Conversations become rows with one id column per turn position, `width` positions at a time, and one
`GROUP BY node, ROLLUP (t1, ..., tw)` aggregates every prefix of that block; grouping_id tells how many columns a result row keeps, which is the
depth. Conversations that are longer and still share their prefix go on with the next block of columns, keyed by the node they reached; those alone in their
node need no more grouping, as every further turn is a node of its own. A node is named by its smallest member and its depth.

Sums over subtrees are sums over members, so a second rollup of the same blocks gives them. A member counts a leaf if it is the smallest member of a
childless node. Let m be the first depth at which a member is the smallest of its node (beyond its end if it never is), and A the bytes of its turns before m;
bytes that others keep for it are those from the node's own depth up to m. So `saved` of a node of n members is sum(A) - A(smallest) - (n - 1) x (bytes above
the node's last turn).

No task takes a whole group: rollups combine before the shuffle; members and children meet their nodes by a join in which the nodes of more than a thousandth
of all members are broadcast (at most a thousand a depth); a node's ending members are joined up in stretches of 1,024 ids, whose texts run through one digest.

Defined results: rows without a conv_id belong to no conversation and are left out; null role or text is empty; turns come by number, null first,
and equal numbers by the digest of the turn; repeated rows are turns of their own; other columns are not read; an empty table gives no rows.
Ids that leave a remainder below zero are rebuilt from the conversation at id - id % 5 with the sign that SQL gives the remainder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaforge.llm.common import arrow_schema, find, partitions, written
from qaforge.operators.ranking import row_number_by

WIDTH = 8  # turn positions in one block of columns
SHARE = 1000  # a node or conversation with more than one in so many rows is hot
GROUP, LENT = 5, 9  # conversations that share a first one, and the bound of the turns taken from it
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos from 1, id, bytes) of every turn in its order."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    named = F.unhex(F.md5(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said).cast("binary")))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), named.alias("id"), F.octet_length(said).cast("long").alias("bytes"))
    numbered = row_number_by(rows, ["conv_id"], [F.asc_nulls_first("turn"), F.col("id")], "pos")
    return numbered.select("conv_id", "pos", "id", "bytes")


def lent_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its group, by its id."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(LENT))


def rebuild(turns: DataFrame) -> DataFrame:
    """Turns of rebuilt conversations: the first h of the group's first conversation, then the own ones after the first h."""
    own = turns.filter(F.col("pos") > lent_turns(F.col("conv_id"))).withColumn("part", F.lit(1))
    near = F.transform(F.sequence(F.lit(1 - GROUP), F.lit(GROUP - 1)), lambda k: F.try_add(F.col("conv_id"), k.cast("long")))
    heads = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < LENT))
    offered = heads.withColumn("to", F.explode(near)).filter((F.col("to") - F.col("to") % GROUP == F.col("conv_id")) & (F.col("pos") <= lent_turns(F.col("to"))))
    taken = offered.join(turns.select(F.col("conv_id").alias("to")).distinct(), "to", "left_semi")
    rows = own.select("conv_id", "part", "pos", "id", "bytes").unionByName(taken.select(F.col("to").alias("conv_id"), F.lit(0).alias("part"), "pos", "id", "bytes"))
    rows = rows.withColumnRenamed("pos", "was")
    return row_number_by(rows, ["conv_id"], [F.col("part"), F.col("was")], "pos").select("conv_id", "pos", "id", "bytes")


def _ids(width: int) -> list[str]:
    return [f"t{j}" for j in range(1, width + 1)]


def _key(width: int, upto: Column | None = None) -> Column:
    """Digest of the node of the prior block and the turn ids (of the first `upto` positions only) that are there."""
    ids = [F.coalesce(F.col(f"t{j}") if upto is None else F.when(upto >= j, F.col(f"t{j}")), F.lit(b"")) for j in range(1, width + 1)]
    return F.unhex(F.md5(F.concat(F.concat(F.col("node").cast("string"), F.lit(":")).cast("binary"), *ids)))


def _rolled(wide: DataFrame, width: int, aggregates: str) -> DataFrame:
    """Every prefix of a block: node, t1..tw (null beyond the prefix), d (turns of the prefix within the block), and the aggregates."""
    ids = ", ".join(_ids(width))
    sql = f"SELECT node, {ids}, {width} - bit_count(grouping_id()) AS d, {aggregates} FROM {{wide}} GROUP BY node, ROLLUP ({ids})"
    rolled = wide.sparkSession.sql(sql, wide=wide)
    # A null at the last kept position stands for members that ended before it.
    there = reduce(lambda x, j: x | ((F.col("d") == j) & F.col(f"t{j}").isNotNull()), range(1, width + 1), F.lit(False))
    return rolled.filter(there)


def _at(width: int, prefix: str, d: Column) -> Column:
    """Value of the d-th of numbered columns."""
    return F.element_at(F.array(*[F.col(f"{prefix}{j}") for j in range(1, width + 1)]), d.cast("int"))


def _block(rows: DataFrame, members: DataFrame, done: int, width: int) -> DataFrame:
    """A row per member: conv_id, len, node, above (bytes up to the block), t1..tw and s1..sw (bytes up to each position)."""
    here = rows.filter((F.col("pos") > done) & (F.col("pos") <= done + width))
    at = [F.col("pos") == done + j for j in range(1, width + 1)]
    wide = here.groupBy("conv_id").agg(
        *[F.max(F.when(c, F.col("id"))).alias(f"t{j}") for j, c in enumerate(at, 1)], *[F.sum(F.when(c, F.col("bytes"))).alias(f"b{j}") for j, c in enumerate(at, 1)])
    both = members.join(wide, "conv_id")
    sums, total = [], F.col("above")
    for j in range(1, width + 1):
        total = total + F.coalesce(F.col(f"b{j}"), F.lit(0))
        sums.append(total.alias(f"s{j}"))
    return both.select("conv_id", "len", "node", "above", *_ids(width), *sums)


class Trie:
    """Tables of a built trie.

    nodes: (conv_id smallest member, depth, parent_conv_id, n_convs, deepest length of a member, bytes up to the node and up to its parent);
    ends: (conv_id of the node, depth, member) for every member of a shared node that ends there.
    """

    def __init__(self, rows: DataFrame, everyone: DataFrame, width: int = WIDTH):
        """`rows`: (conv_id, pos, id, bytes) of all turns; `everyone`: conv_id of all conversations, turnless ones as well."""
        self.width = width
        sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"), F.sum("bytes").alias("total"))
        self.members = written(everyone.join(sizes, "conv_id", "left").select("conv_id", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("total", F.lit(0)).alias("total")), "members")
        top = self.members.agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("len").alias("deepest"), F.sum("len").alias("turns")).first()
        self.first, self.n, self.deepest = top["first"], top["n"], top["deepest"]
        limit = self.n // SHARE
        self.blocks, shared, tails, ends = [], [], [], []
        if not self.n:
            return
        ends.append(self.members.filter("len = 0").select(F.lit(self.first).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member")))
        going = self.members.filter("len > 0").select("conv_id", "len", F.lit(self.first).alias("node"), F.lit(0).cast("long").alias("above"))
        done = 0
        while not going.isEmpty():
            wide = written(_block(rows, going, done, width), "block")
            nodes = written(self._nodes(wide, done, limit), "nodes")
            # Where each member stands at the end of the block, or of its turns.
            reached = nodes.select("key", F.col("conv_id").alias("node"), F.col("n_convs"), F.col("upto").alias("above"))
            stands = written(find(wide.select("conv_id", "len", _key(width).alias("key")), "key", reached, "n_convs", limit), "members")
            self.blocks.append(wide)
            shared.append(nodes.drop("key"))
            done += width
            ends.append(stands.filter((F.col("len") <= done) & (F.col("n_convs") > 1)).select(F.col("node").alias("conv_id"), F.col("len").alias("depth"), F.col("conv_id").alias("member")))
            tails.append(stands.filter((F.col("len") > done) & (F.col("n_convs") == 1)).select("conv_id", "len", F.lit(done).cast("long").alias("after")))
            going = stands.filter((F.col("len") > done) & (F.col("n_convs") > 1)).select("conv_id", "len", "node", "above")
        root = rows.sparkSession.createDataFrame([(self.first, 0, None, self.n, self.deepest, 0, 0)], NODES)
        self.nodes = reduce(DataFrame.unionByName, shared, root)
        self.ends = reduce(DataFrame.unionByName, ends)
        self.tails = self._tails(rows, tails, top["turns"] // SHARE)

    def _nodes(self, wide: DataFrame, done: int, limit: int) -> DataFrame:
        """Nodes of a block with their parents; `key` names a node by its block's path."""
        w = self.width
        rolled = _rolled(wide, w, ", ".join(["min(conv_id) AS conv_id", "count(*) AS n_convs", "max(len) AS deepest", "max(above) AS above", *[f"max(s{j}) AS s{j}" for j in range(1, w + 1)]]))
        d = F.col("d")
        before = F.when(d == 1, F.col("above")).otherwise(_at(w, "s", F.greatest(d - 1, F.lit(1))))
        nodes = written(rolled.select(
            _key(w).alias("key"), F.when(d > 1, _key(w, d - 1)).alias("parent"), "node", "conv_id", (d + done).cast("long").alias("depth"), "n_convs", "deepest",
            _at(w, "s", d).alias("upto"), before.alias("before")), "paths")
        out = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "deepest", "upto", "before"]
        top = nodes.filter("parent is null").withColumn("parent_conv_id", F.col("node"))
        below = nodes.filter("parent is not null")
        parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("held"))
        return top.select(out).unionByName(find(below, "parent", parents, "held", limit).select(out))

    def _tails(self, rows: DataFrame, tails: list[DataFrame], limit: int) -> DataFrame:
        """(conv_id, depth, len) of the turns of conversations beyond the block after which they share nothing."""
        if not tails:
            return rows.sparkSession.createDataFrame([], "conv_id long, depth long, len long")
        alone = reduce(DataFrame.unionByName, tails)
        return find(rows.select("conv_id", "pos"), "conv_id", alone, "len", limit).filter("pos > after").select("conv_id", F.col("pos").cast("long").alias("depth"), "len")

    def _facts(self) -> DataFrame:
        """Per member: `kept` (bytes of its turns before it is the smallest of its node) and whether it counts a leaf."""
        leads = self.nodes.filter("depth > 0").groupBy("conv_id").agg(
            F.min_by("before", "depth").alias("before"), F.max((F.col("deepest") == F.col("depth")) | (F.col("n_convs") == 1)).alias("leaf"))
        return self.members.join(leads, "conv_id", "left").select(
            "conv_id", F.coalesce("before", "total").alias("kept"), F.coalesce(F.col("leaf").cast("long"), F.lit(0)).cast("long").alias("leaf"))

    def measured(self) -> DataFrame:
        """Nodes with n_children, n_leaves, saved_tokens and ends_sha256."""
        facts = written(self._facts(), "facts")
        spark = facts.sparkSession
        sums = []
        for i, wide in enumerate(self.blocks):
            both = wide.select("conv_id", "node", *_ids(self.width)).join(facts, "conv_id")
            rolled = _rolled(both, self.width, "min(conv_id) AS conv_id, count(*) AS n, sum(kept) - min_by(kept, conv_id) AS others, sum(leaf) AS n_leaves")
            sums.append(rolled.filter("n > 1").select("conv_id", (F.col("d") + i * self.width).cast("long").alias("depth"), "others", "n_leaves"))
        whole = facts.agg(F.sum("kept") - F.min_by("kept", "conv_id"), F.sum("leaf")).first()
        leaves = whole[1] if self.deepest else 1
        sums.append(spark.createDataFrame([(self.first, 0, whole[0], leaves)], "conv_id long, depth long, others long, n_leaves long"))
        sums = reduce(DataFrame.unionByName, sums)
        children = self.nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
        many, one = self.nodes.filter("n_convs > 1"), self.nodes.filter("n_convs = 1")
        none = F.lit(NO_ENDS)
        of = ["conv_id", "depth"]
        many = many.join(sums, of).join(children, of, "left").join(end_digests(self.ends), of, "left").select(
            *of, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
            (F.col("others") - (F.col("n_convs") - 1) * F.col("before")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
        own = F.sha2(F.col("conv_id").cast("string"), 256)
        zero, single = F.lit(0).cast("long"), F.lit(1).cast("long")

        def alone(df: DataFrame, parent: str, last: Column) -> DataFrame:
            return df.select(*of, F.col(parent).alias("parent_conv_id"), single.alias("n_convs"), F.when(last, zero).otherwise(single).alias("n_children"),
                             single.alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, own).otherwise(none).alias("ends_sha256"))

        return many.unionByName(alone(one, "parent_conv_id", F.col("deepest") == F.col("depth"))).unionByName(alone(self.tails, "conv_id", F.col("depth") == F.col("len")))


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, deepest long, upto long, before long"
MEASURED = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): digest of each node's ending members in order, comma-joined."""
    stretch = F.shiftright("member", 10)
    parts = ends.groupBy("conv_id", "depth", stretch.alias("stretch")).agg(
        F.array_join(F.array_sort(F.collect_list("member")).cast("array<string>"), ",").alias("joined"))
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("ends_sha256", T.StringType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out: list[tuple] = []
            for c, d, joined in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (c, d) != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (c, d), hashlib.sha256(joined.encode())
                else:
                    digest.update(b"," + joined.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((*node, digest.hexdigest()), arrow)], schema=arrow)

    n = partitions(ends.sparkSession)
    ordered = parts.repartition(n, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "stretch")
    return ordered.select("conv_id", "depth", "joined").mapInArrow(run, schema)


def prefix_trie(turns: DataFrame, everyone: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """All nodes of the trie of conversations given as rows (conv_id, pos, id, bytes)."""
    turns = written(turns, "turns")
    trie = Trie(turns, everyone if everyone is not None else turns.select("conv_id").distinct(), width)
    return trie.measured() if trie.n else turns.sparkSession.createDataFrame([], MEASURED)


def rebuilt_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    turns = written(turn_rows(conversations), "turns")
    return prefix_trie(rebuild(turns), turns.select("conv_id").distinct(), width)
