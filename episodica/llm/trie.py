"""The prefix trie of conversations: one node for each different beginning, with what lies below it.

Turns become digests when they are read; texts are never shuffled. A prefix's digest is the digest of the sum of its turns'
digests, each bound to its depth, so that running sums over blocks of a conversation give all prefixes of however long a
conversation in parallel. Equal prefixes meet in one aggregation by digest, which also verifies that all members of a
node agree on its depth, its parent and its last turn; a collision stops the job, it never merges two nodes.

Sums over subtrees come from node tables of bounded size. A node's weight is the number of turns from it on in all its members;
it is no less than the number of nodes in its subtree, and falls along every path. Nodes of one path whose weight falls in the
same multiple of UNIT belong to one unit:

* below UNIT a unit is a whole subtree of less than UNIT nodes. Such units are dealt to shards. A shard enumerates its nodes'
  digests in a minimal perfect hash, whose slots are checked against the digests, scatters values into flat arrays by slot,
  and adds them up through the array of parents' slots, deepest nodes first;
* from UNIT on two children can't both stay in their parent's unit: such a unit is a piece of a path, of at most UNIT nodes. What
  its nodes' small subtrees came to is added up by parent, and the unit goes through the same table. Heavy units hang
  only on the last node of another heavy one; of these units there are no more than (weight / UNIT) * ln(weight / UNIT), and one
  last table sums them up.

So neither a first turn that most conversations share, nor one endless conversation, nor copies of one make a task large. Which unit a node
belongs to is read off the path of its smallest member.

Ids that end at a node are packed to chunks from a sort by (node, id), which splits the ids of one node over tasks; one
pass over the chunks of a node gives their digest.

Cases: a null role or text is empty; null turns come first, turns of one number follow by the digest of role and text, repeated rows are
turns of their own; rows with a null conversation are left out; an empty table has no nodes, not even the root. Extra columns
are not read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import cut
from episodica.llm.textops import U64, mixed_bits

# Nodes in a unit, turns in a block of one conversation, bytes of packed ids in a row.
UNIT = 1 << 18
BLOCK = 1 << 12
CHUNK = 1 << 16
# Turns that conversations may take from another one.
MOST_HEAD = 8
EMPTY = hashlib.sha256(b"").hexdigest()
LIMBS = 4


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, t, bytes) of each turn; t is the MD5 of role and text, the role's length before them."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    digest = F.md5(said).alias("t")
    rows = turns.filter(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest, F.octet_length(text).cast("long").alias("bytes"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, t, bytes): turns of each conversation numbered from 1.

    Ranges of (conversation, turn) are sorted side by side, and numbered within a range and conversation. A conversation that goes on from
    earlier ranges is the first of its range: these carries are one row a range."""
    rows = turn_digests(turns)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t")]
    schema = "conv_id long, t string, bytes long, local long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            conv = batch["conv_id"].to_numpy()
            if not len(conv):
                continue
            opens = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
            local = np.arange(len(conv)) - np.repeat(opens, np.diff(np.append(opens, len(conv))))
            if conv[0] == last:
                local[: opens[1] if len(opens) > 1 else len(conv)] += count
            last, count = conv[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["t"], batch["bytes"], pa.array(local)], ["conv_id", "t", "bytes", "local"])

    # Equal turns of one conversation are told apart, so that they too can be split over ranges.
    rows = rows.withColumn("_k", F.monotonically_increasing_id())
    ranges = rows.repartitionByRange(*order, F.col("_k")).sortWithinPartitions(*order).drop("turn", "_k")
    rows = cut(ranges.mapInArrow(number, schema).withColumn("part", F.spark_partition_id()), "numbered")
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "local")).alias("last"))
    events = ends.select(F.explode(F.array(
        F.struct(F.col("first").alias("conv_id"), "part", F.lit(0).cast("long").alias("n")),
        F.struct(F.col("last.conv_id").alias("conv_id"), F.col("part"), (F.col("last.local") + 1).alias("n")),
    )).alias("e")).select("e.*")
    before = Window.partitionBy("conv_id").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    carry = events.withColumn("before", F.sum("n").over(before)).groupBy("conv_id", "part").agg(F.max("before").alias("before"))
    carry = carry.filter("before > 0")
    # One row a range at most: as few as there are tasks.
    found = rows.join(F.broadcast(carry), ["conv_id", "part"], "left")
    return found.select("conv_id", (F.col("local") + 1 + F.coalesce("before", F.lit(0))).alias("pos"), "t", "bytes")


def rebuilt(turns: DataFrame, base: Column, heads: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another one's first turns: ((conv_id, i, t, bytes, len), (conv_id, len)).

    `base` and `heads` are expressions of conv_id: whose first turns, and how many (no more than MOST_HEAD); as many of the
    conversation's own first turns give way."""
    rows = cut(numbered(turns), "turns")
    sizes = cut(rows.groupBy("conv_id").agg(F.max("pos").alias("own")), "sizes")
    wanted = sizes.select("conv_id", "own", base.cast("long").alias("base"), heads.cast("long").alias("h"))
    given = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = wanted.join(given, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    convs = cut(convs.withColumn("len", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "convs")
    first = rows.filter(F.col("pos") <= MOST_HEAD).select(F.col("conv_id").alias("base"), "pos", "t", "bytes")
    taken = convs.filter("m > 0").select("conv_id", "base", "m", "len").join(first, "base").filter("pos <= m")
    # A conversation's shift stands ready for each of its blocks, so that no row meets a join on a conversation alone.
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("own") / BLOCK)))
    shifts = convs.filter("own > h").select("conv_id", "len", "h", (F.col("m") - F.col("h")).alias("shift"), blocks.alias("_b"))
    own = rows.withColumn("_b", F.floor(F.col("pos") / BLOCK)).join(shifts, ["conv_id", "_b"]).filter("pos > h")
    own = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("i"), "t", "bytes", "len")
    return own.unionByName(taken.select("conv_id", F.col("pos").alias("i"), "t", "bytes", "len")), convs.select("conv_id", "len")


def limbs(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(LIMBS)]


def prefix_digest(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))


def paths(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(p, q, depth, t, bytes, conv_id, rest, ends): every prefix of every conversation, with the prefix before it; rest counts the turns from
    here on, this one included."""
    bound = F.md5(F.concat_ws(",", "i", "t").cast("binary"))
    rows = rows.withColumn("_d", bound).select("conv_id", "i", "t", "bytes", "len", *[c.alias(f"_a{k}") for k, c in enumerate(limbs(F.col("_d")))])
    rows = rows.withColumn("_b", F.floor(F.col("i") / BLOCK))
    # Only conversations of several blocks carry sums from one to the next.
    totals = rows.filter(F.col("len") >= BLOCK).groupBy("conv_id", "_b").agg(*[F.sum(f"_a{k}").alias(f"_t{k}") for k in range(LIMBS)])
    before = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("conv_id", "_b", *[F.sum(f"_t{k}").over(before).alias(f"_c{k}") for k in range(LIMBS)]).filter("_b > 0")
    inside = Window.partitionBy("conv_id", "_b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(f"_a{k}").over(inside).alias(f"_l{k}") for k in range(LIMBS)])
    found = local.join(carry, ["conv_id", "_b"], "left").fillna(0, [f"_c{k}" for k in range(LIMBS)])
    now = [F.col(f"_c{k}") + F.col(f"_l{k}") for k in range(LIMBS)]
    then = [s - F.col(f"_a{k}") for k, s in enumerate(now)]
    deep = found.select(
        prefix_digest(F.col("i"), now).alias("p"), prefix_digest(F.col("i") - 1, then).alias("q"), F.col("i").alias("depth"), "t", "bytes",
        "conv_id", (F.col("len") - F.col("i") + 1).alias("rest"), (F.col("i") == F.col("len")).alias("ends"),
    )
    zero = F.lit(0).cast("long")
    top = convs.select(
        prefix_digest(zero, [zero] * LIMBS).alias("p"), F.lit(None).cast("binary").alias("q"), zero.alias("depth"), F.lit("").alias("t"),
        zero.alias("bytes"), "conv_id", (F.col("len") + 1).alias("rest"), (F.col("len") == 0).alias("ends"),
    )
    return deep.unionByName(top)


def members(path: DataFrame) -> DataFrame:
    """(p, q, depth, bytes, conv_id, n_convs, level) of every node; level is its weight in units."""
    said = F.struct(F.coalesce("q", F.lit(b"")).alias("q"), "depth", "t", "bytes")
    found = path.groupBy("p").agg(
        F.min(said).alias("s"), F.max(said).alias("other"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum("rest").alias("weight"),
    )
    sound = F.when(F.col("s") == F.col("other"), F.col("s")).otherwise(F.raise_error(F.lit("two prefixes have one digest")))
    found = found.withColumn("s", sound)
    q = F.when(F.col("s.depth") > 0, F.col("s.q")).alias("q")
    level = F.floor(F.col("weight") / F.lit(UNIT)).alias("level")
    return found.select("p", q, F.col("s.depth").alias("depth"), F.col("s.bytes").alias("bytes"), "conv_id", "n_convs", level)


def with_units(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with the digest of their unit's first node (unit) and the smallest member of that one's parent (above).

    A conversation's path passes through few units: their first nodes are the least depths of each level on it. Nodes of level 0 needn't
    be looked up for that."""
    heavy = nodes.filter("level > 0").select("p", "level", F.col("conv_id").alias("least"))
    steps = path.select("p", "conv_id", "depth").join(heavy, "p", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    runs = steps.groupBy("conv_id", "level").agg(F.min(F.struct("depth", "p")).alias("first"), F.max(F.struct("depth", "least")).alias("last"))
    above = F.lag("last.least").over(Window.partitionBy("conv_id").orderBy("first.depth"))
    units = runs.select("conv_id", "level", F.col("first.p").alias("unit"), above.alias("above"))
    return nodes.join(units, ["conv_id", "level"])


class Slots:
    """A minimal perfect hash of different 16-byte digests: keys that are alone in a cell of a level stand there, the others go on
    to the next level; a slot is the number of cells taken before. Slots are verified against the digests."""

    def __init__(self, keys: np.ndarray):
        self.levels, left, n = [], keys, 0
        for level in range(64):
            if not len(left):
                break
            cells = self.cell(left, level, 2 * len(left) + 1)
            alone = np.bincount(cells, minlength=2 * len(left) + 1) == 1
            self.levels.append((len(alone), alone, np.cumsum(alone) - 1 + n))
            n += int(alone.sum())
            left = left[~alone[cells]]
        if len(left):
            raise ValueError("a digest comes twice")
        self.keys = np.zeros((n, 2), U64)
        self.keys[self.find(keys, False)] = keys

    @staticmethod
    def cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mixed_bits(keys[:, 0] ^ mixed_bits(keys[:, 1] + U64(level * 0x9E3779B97F4A7C15 % 2**64)))
        return (h % U64(size)).astype(np.int64)

    def find(self, keys: np.ndarray, verify: bool = True) -> np.ndarray:
        """The slots of keys, -1 for digests that aren't in the table."""
        slot = np.full(len(keys), -1)
        left = np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            cells = self.cell(keys[left], level, size)
            here = alone[cells]
            slot[left[here]] = rank[cells[here]]
            left = left[~here]
        if verify:
            ok = slot >= 0
            ok[ok] = (self.keys[slot[ok]] == keys[ok]).all(axis=1)
            slot[~ok] = -1
        return slot


def digests_of(column: pa.ChunkedArray) -> np.ndarray:
    """16-byte values as pairs of integers; nulls are zeros."""
    raw = b"".join(x if x is not None else bytes(16) for x in column.to_pylist())
    return np.frombuffer(raw, U64).reshape(-1, 2)


SUMS = ("n_children", "n_leaves", "saved_tokens")
NODE = "p binary, q binary, depth long, conv_id long, n_convs long, unit binary, parent_conv_id long, " + ", ".join(f"{c} long" for c in SUMS)


def summed(table: pa.Table) -> pa.Table:
    """Nodes of whole units with their sums; what hangs below them from outside is in more_*."""
    keys = digests_of(table["p"])
    slots, n = Slots(keys), len(keys)
    at = slots.find(keys)

    def scattered(column: str) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[at] = table[column].to_numpy()
        return out

    depth, conv, convs, size = (scattered(c) for c in ("depth", "conv_id", "n_convs", "bytes"))
    children, leaves, saved = (scattered(f"more_{c}") for c in SUMS)
    level = scattered("level")
    parent = np.full(n, -1)
    parent[at] = slots.find(digests_of(table["q"]))
    # A parent in the same shard but in another unit isn't this table's affair.
    parent[(parent >= 0) & (level[parent] != level)] = -1
    has = parent >= 0
    children += np.bincount(parent[has], minlength=n)
    leaves += children == 0
    saved += (convs - 1) * size
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.diff(-depth[order], prepend=-depth[order[:1]] - 1))
    for a, b in zip(edges, np.append(edges[1:], n)):
        deep = order[a:b]
        deep = deep[parent[deep] >= 0]
        np.add.at(leaves, parent[deep], leaves[deep])
        np.add.at(saved, parent[deep], saved[deep])
    above = np.where(parent >= 0, conv[parent], -1)
    inner = parent[at] >= 0
    outer, none = pc.fill_null(table["above"], 0).to_numpy(), pc.is_null(table["above"]).to_numpy()
    above = pa.array(np.where(inner, above[at], outer), pa.int64(), mask=~inner & none)
    columns = [table["p"], table["q"], table["depth"], table["conv_id"], table["n_convs"], table["unit"], above]
    return pa.table([*columns, *[pa.array(x[at]) for x in (children, leaves, saved)]], ["p", "q", "depth", "conv_id", "n_convs", "unit", "parent_conv_id", *SUMS])


def by_units(nodes: DataFrame, label: str) -> DataFrame:
    """`summed` over shards of whole units; nodes carry more_* columns."""
    n_shards = max(1, -(-nodes.count() // UNIT))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("unit"), F.lit(n_shards)))
    return cut(dealt.groupBy("shard").applyInArrow(summed, NODE), label)


def below(found: DataFrame) -> DataFrame:
    """What first nodes of units bring to their parents outside: (p, more_*)."""
    tops = found.filter((F.col("p") == F.col("unit")) & F.col("q").isNotNull())
    return tops.groupBy(F.col("q").alias("p")).agg(
        F.count(F.lit(1)).alias("more_n_children"), *[F.sum(c).alias(f"more_{c}") for c in SUMS[1:]]
    )


def added(nodes: DataFrame, more: DataFrame | None) -> DataFrame:
    names = [f"more_{c}" for c in SUMS]
    if more is None:
        return nodes.select("*", *[F.lit(0).cast("long").alias(c) for c in names])
    return nodes.join(more, "p", "left").fillna(0, names)


def below_heavy(found: DataFrame, tops: DataFrame) -> DataFrame:
    """(unit, more_n_leaves, more_saved_tokens): what the heavy units that hang on a heavy unit came to, all below included.

    One row a unit goes into the one table: see the module's bound. Units hang on the last node of another one, so a unit's node that
    is a heavy unit's parent tells where it hangs."""
    joints = tops.filter(F.col("q").isNotNull()).select(F.col("q").alias("p")).distinct()
    homes = found.join(joints, "p", "left_semi").select(F.col("p").alias("q"), F.col("unit").alias("home"))
    rows = tops.select("unit", "q", "depth", *SUMS[1:]).join(homes, "q", "left").withColumn("_one", F.lit(0))

    def total(table: pa.Table) -> pa.Table:
        keys = digests_of(table["unit"])
        slots = Slots(keys)
        at, up = slots.find(keys), np.full(len(keys), -1)
        up[at] = slots.find(digests_of(table["home"]))
        depth = np.zeros(len(keys), np.int64)
        depth[at] = table["depth"].to_numpy()
        sums = []
        for column in SUMS[1:]:
            own, gained = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            own[at] = table[column].to_numpy()
            for k in np.argsort(-depth, kind="stable"):
                if up[k] >= 0:
                    gained[up[k]] += own[k] + gained[k]
            sums.append(pa.array(gained[at]))
        return pa.table([table["unit"], *sums], ["unit", "more_n_leaves", "more_saved_tokens"])

    return rows.groupBy("_one").applyInArrow(total, "unit binary, more_n_leaves long, more_saved_tokens long")


def subtree_sums(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node with n_children, n_leaves, saved_tokens and parent_conv_id."""
    nodes = cut(with_units(path, nodes), "units")
    light = by_units(added(nodes.filter("level = 0"), None), "light")
    heavy = nodes.filter("level > 0")
    # Children in other heavy units count as children, their sums come from the last table.
    tops = heavy.filter((F.col("p") == F.col("unit")) & F.col("q").isNotNull())
    zero = F.lit(0).cast("long")
    joints = tops.groupBy(F.col("q").alias("p")).agg(F.count(F.lit(1)).alias("more_n_children"), *[zero.alias(f"more_{c}") for c in SUMS[1:]])
    more = below(light).unionByName(joints).groupBy("p").agg(*[F.sum(f"more_{c}").alias(f"more_{c}") for c in SUMS])
    units = by_units(added(heavy, more), "heavy")
    gained = below_heavy(units, units.filter(F.col("p") == F.col("unit")))
    whole = units.join(gained, "unit")
    whole = whole.withColumns({c: F.col(c) + F.col(f"more_{c}") for c in SUMS[1:]}).select(*units.columns)
    return light.unionByName(whole)


def end_digests(path: DataFrame) -> DataFrame:
    """(p, ends_sha256) of the nodes at which conversations end."""
    ends = path.filter("ends").select("p", "conv_id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, 0, [], 0
        for batch in batches:
            rows = []
            for p, conv in zip(batch["p"].to_pylist(), batch["conv_id"].to_pylist()):
                if p != node or size >= CHUNK:
                    if ids:
                        rows.append((node, first, ",".join(ids)))
                    node, first, ids, size = p, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield batch_of(rows, [pa.binary(), pa.int64(), pa.string()], ["p", "first", "ids"])
        if ids:
            yield batch_of([(node, first, ",".join(ids))], [pa.binary(), pa.int64(), pa.string()], ["p", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            rows = []
            for p, ids in zip(batch["p"].to_pylist(), batch["ids"].to_pylist()):
                if p == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        rows.append((node, digest.hexdigest()))
                    node, digest = p, hashlib.sha256()
                digest.update(ids.encode())
            yield batch_of(rows, [pa.binary(), pa.string()], ["p", "ends_sha256"])
        if node is not None:
            yield batch_of([(node, digest.hexdigest())], [pa.binary(), pa.string()], ["p", "ends_sha256"])

    chunks = ends.repartitionByRange("p", "conv_id").sortWithinPartitions("p", "conv_id").mapInArrow(packed, "p binary, first long, ids string")
    return chunks.repartition("p").sortWithinPartitions("p", "first").mapInArrow(hashed, "p binary, ends_sha256 string")


def batch_of(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(p, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    rows (conv_id, i, t, bytes, len): turns by depth with their digests; convs (conv_id, len): all conversations, turnless ones included."""
    path = cut(paths(rows, convs), "paths")
    nodes = cut(members(path), "nodes")
    found = subtree_sums(path, nodes).join(end_digests(path), "p", "left")
    ends = F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    return found.select("p", "conv_id", "depth", "parent_conv_id", "n_convs", *SUMS, ends)


def of_conversations(turns: DataFrame) -> DataFrame:
    """The trie of conversations as they stand."""
    return trie(*rebuilt(turns, F.col("conv_id"), F.lit(0)))
