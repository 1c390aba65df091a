"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Two documents link if the Jaccard likeness of their sets of five-word shingles reaches 0.8. Any two such sets share at
least l tokens within prefixes that are l - 1 tokens longer than the shortest possible ones, under one order of all
tokens. The order here is by frequency, rare tokens first: tokens of the lower part of the hash range come first, by the number of sets that
hold them, then the others, which only sets with too few tokens in the lower part have in their prefixes at all. Counts come from one sort of the
tokens; a token of one set takes a place in its prefix but never leaves the sort. For each document the join chooses l by cost: every longer prefix means more
posting-list entries to read, but the candidates, which must now share l tokens, become fewer; the number of entries divided by l bounds them.

Equal sets are one node from the start. Large groups of near copies would fill posting lists with pairs of one group, so
links are looked for in rounds: first each document of a posting list is compared with the list's leader only; what is
linked becomes one component; lists within one component are done. When there are no more pairs between components than entries, or rounds
bring nothing more, all of them that share enough prefix tokens, and whose parities don't rule it out, are compared. A pair within a
component needs no comparison, a pair between components is never skipped: components come out exact. Each round's links are merged as edges between
the components found before, so that a group's links never pile up.

Tokens and nodes are 64-bit hashes of shingles and of whole sets; a link is counted on the full sets of both texts.

Cases: null, empty and wordless texts have an empty set and link with nothing; a text of fewer than five words is one
shingle; rows with equal sets share a component, repeated ids included; a component without any non-null id has a null
component_id; other columns aren't read, whatever their names; an empty table gives no rows. Texts are read whole.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from episodica.llm.common import cut, fresh_name, text_of
from episodica.llm.textops import LOWER, U64, mixed_bits, span_hashes, text_parts, word_spans

GRAM = 5
MOST_MATCHES = 4
# Tokens whose hash is below this share of its range come first.
COUNTED = 0.3
# Sets that make a token as frequent as the order tells.
FREQUENT = 64
PAIRS_PER_ENTRY = 1
# Rounds go on while each leaves at most this share of the pairs between components: a round costs about as much as the join of all of them.
WORTH = 0.75
PARITY_BITS = 512
# Tokens before a token by which the join sees whether a pair has met there already.
RECENT = 2 * MOST_MATCHES
GROUP_ROWS = 128
GROUP_PAIRS = 250
# Names of texts (16 bytes each) that may be sent to every task.
MOST_BROADCAST = 2_000_000
# Cost of comparing a candidate, in posting-list entries read.
COMPARE_COST = 8


def at_least(n: np.ndarray) -> np.ndarray:
    """Tokens that a set of n shares with any larger or smaller partner: four fifths of n, rounded up."""
    return (4 * n + 4) // 5


def shingle_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(document, token) of the different shingles of runs of documents, ordered by both, and the run's first and end."""
    held: list[np.ndarray] = []
    first = 0
    for i, data, bounds in text_parts(texts):
        if held and i != first:
            yield *sets_of(np.concatenate(held), np.full(sum(map(len, held)), first)), first, first + 1
            held = []
        data = LOWER[data]
        starts, ends, doc = word_spans(data, bounds)
        keys = span_hashes(data, starts, ends)
        if len(bounds) == 2:
            held.append(keys)
            first = i
        else:
            yield *sets_of(keys, doc + i), i, i + len(bounds) - 1
    if held:
        yield *sets_of(np.concatenate(held), np.full(sum(map(len, held)), first)), first, first + 1


def sets_of(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of the different shingles of documents given as word hashes."""
    if not len(words):
        return doc, words
    mark = mixed_bits(np.arange(1, GRAM + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    opens = np.flatnonzero(np.diff(doc, prepend=-1))
    count = np.diff(np.append(opens, len(doc)))
    parts, owners = [], []
    if len(words) >= GRAM:
        n = len(words) - GRAM + 1
        whole = doc[:n] == doc[GRAM - 1 :]
        token = np.zeros(n, U64)
        for k in range(GRAM):
            token += mixed_bits(words[k : k + n] * (mark[k] | U64(1)) + mark[k])
        parts.append(token[whole])
        owners.append(doc[:n][whole])
    short = opens[count < GRAM]
    if len(short):
        size = count[count < GRAM]
        token = size.astype(U64) * U64(0xD6E8FEB86659FD93)
        for k in range(GRAM - 1):
            more = size > k
            token[more] += mixed_bits(words[short[more] + k] * (mark[k] | U64(1)) + mark[k])
        parts.append(token)
        owners.append(doc[short])
    token, owner = mixed_bits(np.concatenate(parts)), np.concatenate(owners)
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], token[new]


SETS = StructType(
    [StructField("n", LongType()), StructField("node", LongType()), StructField("n_low", LongType()), StructField("parity", ArrayType(LongType())),
     StructField("tokens", ArrayType(LongType()))]
)


def longest_prefix(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, n - at_least(n) + MOST_MATCHES)


def sketch(text: Column) -> Column:
    """(n, node, n_low, parity, tokens) of each text: the size and hash of its set, how many of its tokens are low ones, for each of
    PARITY_BITS whether an odd number of its tokens fall on it, and the low tokens, or all where the longest prefix needs more."""

    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n, node, n_low = (np.zeros(len(batch), np.int64) for _ in range(3))
            kept, lengths = [np.zeros(0, np.int64)], np.zeros(len(batch), np.int64)
            parity = np.zeros((len(batch), PARITY_BITS // 64), np.int64)
            for doc, token, first, end in shingle_sets(batch):
                if not len(token):
                    continue
                at = np.searchsorted(doc, np.arange(first, end + 1))
                size = np.diff(at)
                own = np.flatnonzero(size)
                total = np.add.reduceat(mixed_bits(token ^ U64(0xA5A5A5A5A5A5A5A5)), at[:-1][own])
                n[first:end] = size
                node[first + own] = mixed_bits(total + size[own].astype(U64)).view(np.int64)
                cell = (doc - first) * PARITY_BITS + (token & U64(PARITY_BITS - 1)).astype(np.int64)
                odd = (np.bincount(cell, minlength=(end - first) * PARITY_BITS) & 1).astype(np.uint8)
                parity[first:end] = np.packbits(odd).view(np.int64).reshape(end - first, -1)
                low = token < U64(int(COUNTED * 2**64))
                n_low[first:end] = np.bincount(doc[low] - first, minlength=end - first)
                keep = low | (n_low[first:end] < longest_prefix(size))[doc - first]
                kept.append(token[keep].view(np.int64))
                lengths[first:end] = np.bincount(doc[keep] - first, minlength=end - first)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(offsets, np.concatenate(kept))
            at = np.arange(len(batch) + 1, dtype=np.int32) * (PARITY_BITS // 64)
            bits = pa.ListArray.from_arrays(at, parity.ravel())
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(node), pa.array(n_low), bits, tokens], SETS.fieldNames())

    return F.arrow_udf(sketched, SETS)(text)


HELD = StructType([StructField("token", LongType()), StructField("node", LongType()), StructField("sizes", LongType())])
SHARED = StructType([*HELD.fields, StructField("df", LongType())])


def held_tokens(sets: DataFrame) -> DataFrame:
    """(token, node, sizes): the tokens that can stand in prefixes; sizes holds n and n_low."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, one = np.unique(batch["node"].to_numpy(), return_index=True)
            part = batch.take(pa.array(one))
            lengths = np.diff(part["tokens"].offsets.to_numpy())
            sizes = part["n"].to_numpy() << 31 | part["n_low"].to_numpy()
            made = [part["tokens"].flatten().to_numpy(), np.repeat(node, lengths), np.repeat(sizes, lengths)]
            for a in range(0, max(1, len(made[0])), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 18)]) for c in made], HELD.fieldNames())

    return sets.filter("n > 0").select("n", "node", "n_low", "tokens").mapInArrow(held, HELD)


def shared_tokens(held: DataFrame) -> DataFrame:
    """The rows whose token at least two nodes have, with their number (FREQUENT at most): one pass over each sorted partition, which holds
    back fewer than FREQUENT rows of a token."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = [np.zeros(0, np.int64)] * 3
        # Rows of the last token that may be too few; or the token that surely has enough, and its last row.
        waiting, full, last = nothing, None, None
        for batch in batches:
            columns = [np.concatenate([x, batch[c].to_numpy()]) for x, c in zip(waiting, HELD.fieldNames())]
            token, node, _ = columns
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            new[:1] &= last is None or (token[:1] != last[0]) | (node[:1] != last[1])
            columns = [c[new] for c in columns]
            token, node, _ = columns
            if not len(token):
                continue
            opens = np.append(0, np.flatnonzero(token[1:] != token[:-1]) + 1)
            lengths = np.diff(np.append(opens, len(token)))
            df = np.minimum(lengths, FREQUENT)
            if token[0] == full:
                df[0] = FREQUENT
            if df[-1] < FREQUENT:
                end, waiting, full, last = opens[-1], [c[opens[-1] :] for c in columns], None, None
            else:
                end, waiting, full, last = len(token), nothing, token[-1], (token[-1], node[-1])
            df = np.repeat(df, lengths)[:end]
            yield pa.RecordBatch.from_arrays([pa.array(c[:end][df > 1]) for c in columns] + [pa.array(df[df > 1])], SHARED.fieldNames())
        n = len(waiting[0])
        if n > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in waiting] + [pa.array(np.full(n, n))], SHARED.fieldNames())

    return held.repartition("token").sortWithinPartitions("token", "node").mapInArrow(scan, SHARED)


def prefix_entries(sets: DataFrame) -> DataFrame:
    """(token, node, n, place): the shared tokens of the longest prefix of each set, with their places in the order."""
    low = (F.col("token") >= 0) & (F.col("token") < F.lit(int(COUNTED * 2**64)))
    n, n_low = F.shiftright("sizes", 31), F.col("sizes").bitwiseAND(F.lit((1 << 31) - 1))
    rows = shared_tokens(held_tokens(sets)).select("token", "node", "df", n.alias("n"), n_low.alias("n_low"), low.alias("low"))
    own = Window.partitionBy("node")
    rank = F.row_number().over(own.orderBy(F.desc("low"), "df", "token")) - 1
    shared_low, shared = F.count_if(F.col("low")).over(own), F.count(F.lit(1)).over(own)
    rows = rows.select("*", rank.alias("_r"), shared_low.alias("_low"), shared.alias("_all"))
    # Tokens of this set alone come before the shared ones of their part.
    before = F.when(F.col("low"), F.col("n_low") - F.col("_low")).otherwise(F.col("n") - F.col("_all"))
    place = (F.col("_r") + before).alias("place")
    longest = F.least("n", F.col("n") - F.floor((F.col("n") * 4 + 4) / 5) + MOST_MATCHES)
    return rows.select("token", "node", "n", place).filter(F.col("place") < longest)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) lead to, by alternating large and small stars."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link; a should be the side that many pairs share.

    The pairs of one a are dealt to parts of about GROUP_ROWS, each with a's text; parts of many a share a group of about
    GROUP_PAIRS pairs, whose sets are made together."""
    fan = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_fan"))
    n_groups = max(1, pairs.count() // GROUP_PAIRS)
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("_fan") / GROUP_ROWS))
    dealt = pairs.join(fan, "a").select("a", "b", salt.alias("salt"))
    dealt = cut(dealt.withColumn("part", F.pmod(F.xxhash64("a", "salt"), F.lit(n_groups))), "pairs")
    others = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("part", "a", "salt", F.col("b").alias("node"), "text")
    heads = dealt.select("part", "a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a")
    heads = heads.select("part", "a", "salt", F.col("a").alias("node"), "text")

    def link(table: pa.Table) -> pa.Table:
        a, salt, node = (table[c].to_pylist() for c in ("a", "salt", "node"))
        made = [(doc, token) for doc, token, _, _ in shingle_sets(table["text"].combine_chunks())]
        doc, token = (np.concatenate(x) for x in zip(*made))
        at = np.searchsorted(doc, np.arange(len(node) + 1))
        head = {(a[k], salt[k]): k for k in range(len(node)) if a[k] == node[k]}
        linked = []
        for k in range(len(node)):
            if a[k] != node[k]:
                h = head[a[k], salt[k]]
                one, other = token[at[h] : at[h + 1]], token[at[k] : at[k + 1]]
                common = len(np.intersect1d(one, other, assume_unique=True))
                if 100 * common >= 80 * (len(one) + len(other) - common):
                    linked.append(k)
        return pa.table({"a": pa.array([a[k] for k in linked], pa.int64()), "b": pa.array([node[k] for k in linked], pa.int64())})

    return heads.unionByName(others).groupBy("part").applyInArrow(link, "a long, b long")


def texts_of(docs: DataFrame, pairs: DataFrame, names: DataFrame, text_col: str) -> DataFrame:
    """(node, text) of the nodes of some pairs. Their names go to every task while they are few enough for that;
    more of them are joined by a shuffle."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = cut(names.select("node", "text_hash").join(wanted, "node", "left_semi"), "wanted")
    text = docs.select(F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text"))
    found = text.join(F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted, "text_hash")
    return cut(found.dropDuplicates(["node"]).select("node", "text"), "texts")


def with_component(entries: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return entries.withColumn("component", F.col("node"))
    return entries.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))


def merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after links (a, b) between nodes: the components found before are joined by one edge for all links of two of them."""
    a = with_component(links.select(F.col("a").alias("node"), "b"), comps).select(F.col("component").alias("a"), F.col("b").alias("node"))
    step = components(with_component(a, comps).select("a", F.col("component").alias("b")))
    if comps is None:
        return step
    moved = step.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    old = comps.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return cut(old.unionByName(step), "components")


def cross_pairs(entries: DataFrame) -> tuple[int, int]:
    """(entries of tokens with several components, pairs of them in different components), counted per posting list."""
    per = entries.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    per = per.groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.count(F.lit(1)).alias("c"))
    row = per.filter("c > 1").agg(F.sum("k"), F.sum((F.col("k").cast("double") * F.col("k") - F.col("kk")) / 2)).first()
    return row[0] or 0, row[1] or 0


def leader_pairs(entries: DataFrame, turn: int, tried: DataFrame | None, links: DataFrame | None) -> DataFrame:
    """(a, b): for each node b its two best partners a among the leaders of its posting lists, in other components.

    Leaders are drawn in even rounds; in odd ones the node that has most links by then leads, as the centre of a group links with members that
    don't link with each other."""
    order = F.xxhash64("component", F.lit(turn))
    if turn % 2 and links is not None:
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        entries = entries.join(ends, "node", "left")
        order = F.struct(-F.coalesce("degree", F.lit(0)), order)
    leader = F.min_by(F.struct("node", "n", "component"), F.struct(order, F.xxhash64("node", F.lit(turn)), "node"))
    lists = entries.groupBy("token").agg(leader.alias("l"), F.min("component").alias("x"), F.max("component").alias("y"))
    lists = lists.filter("x <> y").select("token", F.col("l.node").alias("a"), F.col("l.n").alias("an"), F.col("l.component").alias("ac"))
    pairs = entries.join(lists, "token").filter((F.col("component") != F.col("ac")) & sizes_fit(F.col("n"), F.col("an")))
    pairs = pairs.groupBy(F.col("node").alias("b"), "a").agg(F.count(F.lit(1)).alias("shared"))
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("shared"), "a"))
    return pairs.withColumn("_nth", best).filter("_nth <= 2").select("a", "b")


def candidates(entries: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b): pairs of different components that share as many prefix tokens as the larger one's l demands.

    Two sets differ in at least as many tokens as their parities differ in bits, and those that link differ in no more
    than a ninth of their sizes' sum: the join gives out no pair whose parities say otherwise.

    A pair of large sets may share hundreds of prefix tokens. Tokens stand in one order in all prefixes: where the RECENT tokens before a
    shared one already hold as many shared ones as l demands, the pair has had its rows, and the join gives out no more. The first l
    shared tokens of a pair have fewer than l before them, so they always count.

    Of a pair, the larger set (then the larger node) probes with its own l; the other offers the tokens of its prefix
    for that l, which is shorter, as its partner isn't smaller."""
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("x"), F.max("component").alias("y"))
    alive = cut(entries.join(lists.filter("x <> y").select("token", "df"), "token"), "alive")
    over = F.col("place") - (F.col("n") - F.floor((F.col("n") * 4 + 4) / 5)) + 1
    read = [F.sum(F.when(over <= m, F.col("df"))).alias(f"r{m}") for m in range(1, MOST_MATCHES + 1)]
    cost = alive.groupBy("node").agg(F.first("n").alias("n"), *read)
    best, least = F.lit(1), F.coalesce(F.col("r1"), F.lit(0)) * (1 + COMPARE_COST)
    for m in range(2, MOST_MATCHES + 1):
        own = F.coalesce(F.col(f"r{m}"), F.lit(0)) * (1 + COMPARE_COST / m)
        better = (own < least) & (F.floor((F.col("n") * 4 + 4) / 5) >= m)
        best, least = F.when(better, F.lit(m)).otherwise(best), F.when(better, own).otherwise(least)
    words = [F.col("parity")[k].alias(f"p{k}") for k in range(PARITY_BITS // 64)]
    chosen = cost.select("node", best.alias("matches")).join(names, "node").select("node", "matches", *words)
    recent = F.collect_list("token").over(Window.partitionBy("node").orderBy("place").rowsBetween(-RECENT, -1))
    alive = alive.withColumn("recent", recent).join(chosen, "node")

    def parity(side: str) -> list[Column]:
        return [F.col(f"p{k}").alias(f"{side}{k}") for k in range(PARITY_BITS // 64)]

    probe = alive.filter(over <= F.col("matches"))
    probe = probe.select("token", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("component").alias("bc"), "matches", F.col("recent").alias("br"), *parity("bp"))
    level = F.greatest(F.col("place") - (F.col("n") - F.floor((F.col("n") * 8 + 8) / 9)) + 1, F.lit(1))
    offer = alive.select("token", F.col("node").alias("a"), F.col("n").alias("an"), F.col("component").alias("ac"), level.alias("level"), F.col("recent").alias("ar"), *parity("ap"))
    offer = offer.filter(F.col("level") <= MOST_MATCHES)
    apart = F.bit_count(F.col("ap0").bitwiseXOR(F.col("bp0")))
    for k in range(1, PARITY_BITS // 64):
        apart = apart + F.bit_count(F.col(f"ap{k}").bitwiseXOR(F.col(f"bp{k}")))
    ordered = (F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b")))
    meet = (F.col("bc") != F.col("ac")) & ordered & (F.col("an") * 5 >= F.col("bn") * 4) & (F.col("level") <= F.col("matches"))
    meet &= apart * 9 <= F.col("an") + F.col("bn")
    # Last, as it costs most.
    meet &= F.size(F.array_intersect("ar", "br")) < F.col("matches")
    pairs = probe.join(offer, "token").filter(meet).groupBy("a", "b", "matches").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.filter("shared >= matches").select("a", "b")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n, node, component) for every row of docs; row_key is a hash of id and text. Rows with empty sets have no component."""
    key = row_key(id_col, text_col)
    sets = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), key.alias("row_key"), sketch(F.col(text_col)).alias("s"))
    sets = cut(sets.select("doc_id", "text_hash", "row_key", "s.*"), "sets")
    entries = cut(prefix_entries(sets), "entries")
    names = sets.filter("n > 0").groupBy("node")
    names = cut(names.agg(F.min("text_hash").alias("text_hash"), F.first("parity").alias("parity")), "names")
    comps, tried, links, before, turn = None, None, None, float("inf"), 0
    while True:
        mine = with_component(entries, comps)
        n_entries, n_pairs = cross_pairs(mine)
        # Another round must be needed, and after one drawn and one led by links the last must have been worth it.
        idle = n_pairs > WORTH * before
        if n_pairs <= PAIRS_PER_ENTRY * n_entries or (idle and turn >= 2):
            break
        before = n_pairs
        pairs = cut(leader_pairs(mine, turn, tried, links), "leaders")
        found = cut(compared(pairs, texts_of(docs, pairs, names, text_col)), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        comps, turn = merged(comps, found), turn + 1
    pairs = candidates(with_component(entries, comps), names.select("node", "parity"))
    if tried is not None:
        swapped = tried.select(F.col("b").alias("a"), F.col("a").alias("b"))
        pairs = pairs.join(tried.unionByName(swapped).distinct(), ["a", "b"], "left_anti")
    pairs = cut(pairs, "candidates")
    found = cut(compared(pairs, texts_of(docs, pairs, names, text_col)), "links")
    comps = merged(comps, found)
    rows = sets.select("doc_id", "row_key", "n", "node")
    empty = rows.filter("n = 0").withColumn("component", F.lit(None).cast("long"))
    return with_component(rows.filter("n > 0"), comps).select(*empty.columns).unionByName(empty)


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), text_of(text_col))


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    rows = linked(docs, id_col, text_col)
    # Of each set, then of each component the smallest id: rows meet one row of their set only.
    nodes = rows.filter("n > 0").groupBy("node", "component").agg(F.min("doc_id").alias("own"))
    least = nodes.groupBy("component").agg(F.min("own").alias("component_id"))
    nodes = nodes.join(least, "component").select("node", "component_id")
    full = rows.filter("n > 0").join(nodes, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, of its smallest id (null ids last), and every row with an empty set."""
    key = fresh_name(docs, "row_key")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    kept = linked(docs, id_col, text_col).filter("n > 0").groupBy("component").agg(first)
    kept = cut(kept.select(F.col("first.row_key").alias(key)), "kept")
    wordy = text_of(text_col).rlike(r"[^\x20\x09-\x0D]")
    some = docs.filter(wordy).withColumn(key, row_key(id_col, text_col)).join(kept, key, "left_semi")
    # Few rows have id and text in common: only these are moved to meet.
    same = cut(some.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key), "same")
    alone, some = some.join(same, key, "left_anti"), some.join(same, key, "left_semi")
    # Of rows with one id and text the same one on every run, whatever else they hold.
    plain = [c for c, t in docs.dtypes if "map" not in t and "variant" not in t]
    nth = fresh_name(some, "nth")
    own = Window.partitionBy(key).orderBy(F.xxhash64(*plain), *[F.col(c) for c, t in docs.dtypes if t in ("string", "bigint", "int", "double")])
    some = some.withColumn(nth, F.row_number().over(own)).filter(F.col(nth) == 1)
    return alone.drop(key).unionByName(some.drop(key, nth)).unionByName(docs.filter(~wordy))
