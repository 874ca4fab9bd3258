"""The prefix trie of conversations, with subtree totals by time-forward processing.

1. Turns are put in order by ranges: a range partition numbers its own stretch of a conversation, and stretches of the few
   conversations that cross partitions are added up from their counts. So no conversation has to be in one task.
2. A prefix is named by its depth and two running sums of 61-bit hashes of (place, role, text): 122 bits, so two of N
   prefixes share a name with a chance of N^2 / 2^123. A prefix that two conversations share has one row in the end; rows
   are summed before they are shuffled, so a prefix of a third of all conversations costs a row a task.
3. A node under which at most ``room`` turns hang is light; a topmost light node heads a shard, which is all that hangs under
   it. At most rows / ``room`` nodes of a depth aren't light; ``room`` is the root of rows times depth, so neither a shard nor
   the rest above all shards grows faster than that.
4. Spark sorts the nodes of each shard by reverse level order on disk. A task walks them once: a node's subtree is complete
   when the walk gets to it, so the node takes the totals sent to it out of a priority queue and sends its own to its
   parent. The queue holds a bounded number of messages and spills sorted runs beyond that. Shard heads send to the nodes above, where
   the same walk runs once more.
5. Ids of the conversations that end at a node are sorted by ranges and joined piece by piece; one pass over the pieces of a
   node gives the hash, without its list ever being in memory.

Spilled runs are unnamed temporary files of one task, as Spark's own spills are: nothing else reads them, and a lost
executor's task starts over.

Defined results: ``conv_id`` null: not a conversation, left out; turns in the order of turn (null first), then role, then
text, so equal turn numbers have a defined order; repeated rows are repeated turns; null role or text is empty; a
conversation without turns after rebuilding is a member of the root only; an empty table has no nodes; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm import common

#: Prime modulus of the running sums.
MOD = (1 << 61) - 1
#: Conversations share openings within groups of GROUP ids, of fewer than SPAN turns.
GROUP, SPAN = 5, 9
#: Least number of turns under a node that isn't in a shard.
ROOM = 20_000
#: Messages that a queue holds in memory; and conversation ids in a piece.
HELD, PIECE = 200_000, 10_000
_NO_IDS = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """A priority queue of tuples, smallest first: a heap of at most ``held``; beyond that the heap goes to a sorted run on disk."""

    def __init__(self, held: int = HELD) -> None:
        self.held, self.heap, self.runs, self.spilled = held, [], [], 0

    def push(self, item: tuple) -> None:
        if len(self.heap) >= self.held:
            self._spill()
        heapq.heappush(self.heap, item)

    def _spill(self) -> None:
        run = tempfile.TemporaryFile()
        for item in sorted(self.heap):
            pickle.dump(item, run)
        run.seek(0)
        self.heap, self.spilled = [], self.spilled + 1
        self.runs.append([pickle.load(run), self.spilled, run])
        heapq.heapify(self.runs)

    def first(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if not (self.runs and (not self.heap or self.runs[0][0] < self.heap[0])):
            return heapq.heappop(self.heap)
        head = self.runs[0]
        item = head[0]
        try:
            head[0] = pickle.load(head[2])
            heapq.heapreplace(self.runs, head)
        except EOFError:
            head[2].close()
            heapq.heappop(self.runs)
        return item


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _running(rows: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """``rows`` (c, stretch, ...) with running sums over each conversation in ``order``: within the stretches, plus what the
    conversation's earlier stretches add up to. A border between partitions cuts one
    conversation at most, so the tables of those that are cut have no more rows than twice the partitions."""
    own = Window.partitionBy("c", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    crossing = rows.groupBy("c").agg(F.min("stretch").alias("a"), F.max("stretch").alias("b")).where("a < b").select("c")
    crossing = common.materialize(crossing, "crossing")
    totals = rows.join(F.broadcast(crossing), "c", "left_semi").groupBy("c", "stretch").agg(*(F.sum(x).alias(f"{n}_in") for n, x in sums.items()))
    carried = common.materialize(totals.select("c", "stretch", *(F.coalesce(F.sum(f"{n}_in").over(before), F.lit(0)).alias(f"{n}_before") for n in sums)), "carried")
    out = rows.select("*", *(F.sum(x).over(own).alias(n) for n, x in sums.items())).join(F.broadcast(carried), ["c", "stretch"], "left")
    return out.select(*rows.columns, *((F.col(n) + F.coalesce(F.col(f"{n}_before"), F.lit(0))).alias(n) for n in sums))


def _numbered(turns: DataFrame) -> DataFrame:
    """(c, at, turn columns, n): ``at`` counts a conversation's turns from 1 in their order, ``n`` is how many it has."""
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    dealt = turns.repartitionByRange(_partitions(turns.sparkSession), F.col("c").asc(), *order).withColumn("stretch", F.spark_partition_id())
    return _running(common.materialize(dealt, "turns"), order, {"at": F.lit(1).cast("long")})


def _hash(*what) -> Column:
    """A 61-bit hash as a decimal, so that sums of many don't overflow."""
    return F.pmod(F.xxhash64(*what), F.lit(MOD)).cast("decimal(20,0)")


def _sum_mod(x: Column) -> Column:
    return (x % F.lit(MOD).cast("decimal(20,0)")).cast("long")


def opening(c: Column) -> Column:
    """How many turns of the first conversation of its group a conversation opens with."""
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(SPAN)).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (c, n) with their length after rebuilding, and their turns (c, n, d, x, y, p, q, bytes): ``d`` is
    the depth, ``x`` and ``y`` name the prefix up to here, ``p`` and ``q`` the one before; ``bytes`` is the text's length."""
    text = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = _numbered(turns).select("c", "stretch", "at", "role", "text", opening(F.col("c")).alias("h"), (F.col("c") - F.col("c") % GROUP).alias("base"))
    rows = common.materialize(rows.select("c", "stretch", "at", "h", "base", F.octet_length("text").cast("long").alias("bytes"), "role", "text"), "numbered")
    lengths = rows.groupBy("c").agg(F.max("at").alias("n"), F.first("h").alias("h"), F.first("base").alias("base"), F.min(F.when(F.col("at") > F.col("h"), F.col("stretch"))).alias("stretch"))
    lengths = common.materialize(lengths, "lengths")
    of_base = lengths.select(F.col("c").alias("base"), F.col("n").alias("base_n")).where(F.col("base") % GROUP == 0)
    members = lengths.join(of_base, "base", "left").select("c", "base", "stretch", F.least(F.col("h"), F.coalesce("base_n", F.lit(0))).alias("lead"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
    members = common.materialize(members.select("c", "base", F.coalesce("stretch", F.lit(0)).alias("stretch"), "lead", (F.col("lead") + F.col("own")).alias("n")), "members")
    # the first turns of each group's first conversation, for all of the group, in the stretch of what follows them
    led = rows.where((F.col("at") < SPAN) & (F.col("c") % GROUP == 0)).select(F.col("c").alias("base"), F.col("at").alias("d"), "role", "text", "bytes")
    led = members.where("lead > 0").join(led, "base").where("d <= lead").select("c", "d", "role", "text", "bytes", "stretch")
    own = rows.where("at > h").join(members.select("c", "lead"), "c").select("c", (F.col("at") - F.col("h") + F.col("lead")).alias("d"), "role", "text", "bytes", "stretch")
    hashed = led.unionByName(own).select("c", "d", "bytes", "stretch", _hash("d", "role", "text").alias("hx"), _hash(F.lit("y"), "text", "role", "d").alias("hy"))
    hashed = common.materialize(hashed, "hashed")
    sums = _running(hashed, ["d"], {"sx": F.col("hx"), "sy": F.col("hy")})
    named = sums.join(members.select("c", "n"), "c").select("c", "n", "d", _sum_mod(F.col("sx")).alias("x"), _sum_mod(F.col("sy")).alias("y"), _sum_mod(F.col("sx") - F.col("hx")).alias("p"), _sum_mod(F.col("sy") - F.col("hy")).alias("q"), "bytes")
    return members.select("c", "n"), common.materialize(named, "prefixes")


def _nodes(members: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(d, x, y, p, q, conv_id, n_convs, bytes, weight): ``weight`` counts the turns that hang under a node and its own."""
    nodes = prefixes.groupBy("d", "x", "y").agg(F.first("p").alias("p"), F.first("q").alias("q"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"), F.sum(F.col("n") - F.col("d") + 1).alias("weight"))
    root = members.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("n") + 1).alias("weight")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("d"), zero.alias("x"), zero.alias("y"), F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("q"), "conv_id", "n_convs", zero.alias("bytes"), "weight")
    return common.materialize(root.unionByName(nodes), "nodes")


WALKED = "d long, x long, y long, p long, q long, n_children long, n_leaves long, saved long, head boolean"


def _walk(held: int):
    """Rows in the order of (shard, depth downwards): each node takes the totals sent to it and sends its own on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(held), None
        for batch in batches:
            out = []
            for s, d, x, y, p, q, n_convs, size, children, leaves, saved, head in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    queue, shard = SpillingQueue(held), s
                me = (-d, x, y)
                while (first := queue.first()) is not None and first[:3] <= me:
                    first = queue.pop()
                    if first[:3] == me:
                        children, leaves, saved = children + 1, leaves + first[3], saved + first[4]
                leaves, saved = leaves or 1, saved + (n_convs - 1) * size
                if not head:
                    queue.push((-(d - 1), p, q, leaves, saved))
                out.append((d, x, y, p, q, children, leaves, saved, head))
            names = [f.split()[0] for f in WALKED.split(", ")]
            kinds = [pa.int64()] * 8 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names)

    return run


def _totals(members: DataFrame, prefixes: DataFrame, nodes: DataFrame, room: int | None, held: int) -> DataFrame:
    """(d, x, y, n_children, n_leaves, saved) of all nodes."""
    spark = nodes.sparkSession
    size = prefixes.agg(F.count("*").alias("n"), F.coalesce(F.max("d"), F.lit(0)).alias("depth")).first()
    room = room or max(ROOM, math.isqrt(size.n * max(size.depth, 1)))
    above = common.materialize(nodes.where((F.col("weight") > room) | (F.col("d") == 0)), "above")
    # the shard of a conversation's light nodes is named by the topmost of them
    marks = above.select("d", "x", "y", F.lit(True).alias("is_above"))
    few = marks.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS
    light = prefixes.join(F.broadcast(marks) if few else marks, ["d", "x", "y"], "left_anti")
    shards = light.groupBy("c").agg(F.min(F.struct("d", "x", "y", "p", "q")).alias("s"))
    inside = nodes.where((F.col("weight") <= room) & (F.col("d") > 0)).join(shards, F.col("conv_id") == F.col("c"))
    zero, names = F.lit(0).cast("long"), ["shard", "d", "x", "y", "p", "q", "n_convs", "bytes", "n_children", "n_leaves", "saved", "head"]
    inside = inside.select(F.xxhash64("s.d", "s.x", "s.y").alias("shard"), "d", "x", "y", "p", "q", "n_convs", "bytes", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"), (F.col("d") == F.col("s.d")).alias("head"))
    parts = _partitions(spark)
    order = ["shard", F.col("d").desc(), "x", "y"]
    inside = common.materialize(inside.repartition(parts, "shard").sortWithinPartitions(*order).select(*names).mapInArrow(_walk(held), WALKED), "inside")
    sent = inside.where("head").groupBy((F.col("d") - 1).alias("d"), F.col("p").alias("x"), F.col("q").alias("y")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    top = above.join(sent, ["d", "x", "y"], "left").fillna(0, ["n_children", "n_leaves", "saved"])
    top = top.select(zero.alias("shard"), "d", "x", "y", "p", "q", "n_convs", "bytes", "n_children", "n_leaves", "saved", (F.col("d") == 0).alias("head"))
    top = top.repartition(parts, "shard").sortWithinPartitions(*order).select(*names).mapInArrow(_walk(held), WALKED)
    return inside.unionByName(top).select("d", "x", "y", "n_children", "n_leaves", "saved")


def _ends(members: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(d, x, y, ends_sha256) of the nodes at which conversations end."""
    spark = members.sparkSession
    parts = _partitions(spark)
    zero = F.lit(0).cast("long")
    last = prefixes.where("d = n").select("d", "x", "y", "c").unionByName(members.where("n = 0").select(zero.alias("d"), zero.alias("x"), zero.alias("y"), "c"))

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, key = [], None
            for d, x, y, c in zip(*(col.to_pylist() for col in batch.columns)):
                if (d, x, y) != key:
                    key = (d, x, y)
                    out.append((d, x, y, c, []))
                out[-1][4].append(str(c))
            yield pa.RecordBatch.from_arrays([*(pa.array([o[k] for o in out], pa.int64()) for k in range(4)), pa.array([",".join(o[4]) for o in out], pa.string())], ["d", "x", "y", "c", "ids"])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())], ["d", "x", "y", "ends_sha256"])

        for batch in batches:
            out = []
            for d, x, y, _, ids in zip(*(col.to_pylist() for col in batch.columns)):
                if (d, x, y) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (d, x, y), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield batch_of(out)
        if key is not None:
            yield batch_of([(*key, state.hexdigest())])

    with common.settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(PIECE)}):
        order = ["d", "x", "y", "c"]
        cut = last.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pieces, "d long, x long, y long, c long, ids string")
        cut = common.materialize(cut, "pieces")
    with common.settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}):
        return common.materialize(cut.repartition(parts, "d", "x", "y").sortWithinPartitions(*order).mapInArrow(digests, "d long, x long, y long, ends_sha256 string"), "digests")


def prefix_trie(conversations: DataFrame, room: int | None = None, held: int = HELD) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text), a row each: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``room``: turns under a node beyond which it is outside the shards; by default the root of turns times depth, at least
    ``ROOM``. ``held``: messages that a queue holds in memory.
    """
    common.small_batches(conversations.sparkSession)
    members, prefixes = rebuilt(conversations)
    nodes = _nodes(members, prefixes)
    key = ["d", "x", "y"]
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("x").alias("p"), F.col("y").alias("q"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, ["d", "p", "q"], "left").join(_totals(members, prefixes, nodes, room, held), key).join(_ends(members, prefixes), key, "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_IDS)).alias("ends_sha256"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of ``conversations``."""
    return prefix_trie(common.table(spark, sf_dir, "conversations"))


#: CRC-32 of a number's decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT + 4294967296, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda r, b: CASE WHEN b > 0 THEN xor(r, b - 4294967296) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))"""

SQL = f"""
WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS at
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM turns), lens AS (SELECT c, {_CRC} % 9 AS h, c - c % 5 AS base FROM ids),
lead AS (SELECT l.c, l.h, count(t.c) AS k FROM lens l LEFT JOIN turns t ON t.c = l.base AND t.at <= l.h GROUP BY ALL),
again AS (SELECT l.c, t.at AS d, t.role, t.text FROM lens l JOIN turns t ON t.c = l.base AND t.at <= l.h
  UNION ALL SELECT t.c, t.at - l.h + l.k, t.role, t.text FROM turns t JOIN lead l ON l.c = t.c WHERE t.at > l.h),
named AS (SELECT c, d, text, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS key FROM again),
paths AS (SELECT c, 0 AS d, '' AS text, '' AS key FROM ids UNION ALL SELECT c, d, text, key FROM named),
steps AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, lead(key) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM paths),
nodes AS (SELECT key, d, min(c) AS c, min(up) AS up, count(*) AS n, min(strlen(text)) AS size,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS sha FROM steps GROUP BY key, d),
kids AS (SELECT up, count(*) AS k FROM nodes WHERE up IS NOT NULL GROUP BY up),
-- each node's ancestors are the prefixes of its smallest member
above AS (SELECT a.key AS top, (n.n - 1) * n.size AS saved, CASE WHEN k.k IS NULL THEN 1 ELSE 0 END AS leaf
  FROM nodes n LEFT JOIN kids k ON k.up = n.key JOIN paths a ON a.c = n.c AND a.d <= n.d),
sums AS (SELECT top, sum(saved) AS saved, sum(leaf) AS leaves FROM above GROUP BY top)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.sha AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.key = n.up LEFT JOIN kids k ON k.up = n.key JOIN sums s ON s.top = n.key
"""
