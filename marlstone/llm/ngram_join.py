"""N-gram Jaccard join: near-duplicate classes of texts whose shingle sets have at least a given Jaccard similarity.

A set holds the hashes of a text's distinct shingles. Sets that are equal form one class, whatever the number of
copies. Two sets can only link if they share a shingle of both prefixes in one global order: the first
n - ceil(t n) + 1 of each. The order here begins with the shingles of the lowest part of the hash range, rarest
first, and goes on with the others by hash. Only that part, half again as large as a prefix and more, has to be
counted over the corpus, and a passage that many unrelated texts share drops to the end of it, out of their
prefixes. Texts that share a prefix shingle, directly or by way of others, form a family; most texts have none.

Families too large for one block are divided by a second condition that linked sets meet: the hash range is cut into
a few segments more than two linked sets can have shingles of one only, so some of these segments are equal in both.
Sets of a family that share an equal segment, directly or by way of others, stay together; those that share none
have no links. Texts of long common passages meet in prefixes, but hardly in segments of several shingles. Before that,
sets leave a large family of which too many shingles are in no other set of such a family: a linked set shares all
but the part 1 - t of its own. That keeps most texts that only passages tie from the division and the blocks.

Inside a family the sets are joined through a prefix tree: sets in hash order are laid into a compressed trie, and
all sets of a block are carried down it at once. The overlap with an edge is added to that of the path above, which
all sets below share, and a subtree is left as soon as no set can reach the required overlap with what remains of it
and of the set. Large families are dealt into blocks by size and every pair of blocks that may hold a link is a unit
of work, so that no task holds more than two blocks. Units return links that span their classes, not all pairs.
Components of these links are the result.

Cost: three passes over the texts (classes; counts of the low part; prefixes among shared shingles), five over a copy
of those of large families (counts and choice twice; segments) and a join of the texts that are in families. Counts
combine before the shuffle, and joins on shingles, nodes and groups deal a heavy key into parts, so a shingle or a
group of a third of all texts is no load for one task.
A family of m shingles in different sets makes (m / BLOCK)**2 / 2 units.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .session import tables, texts, written
from .spread import spread_join
from .textblocks import BLANK_DELIMITED, blocks, grams, mix

#: Shingles in a block of a family, a set counting as LIGHTEST at least; a larger set is a block of its own.
BLOCK = 200_000
LIGHTEST = 300
#: Sets carried down a trie at once.
PROBES = 64
#: Bits of the table that keeps the texts of no family from being shuffled; of one size for any corpus.
BITS = 1 << 23
#: Bits of the table that keeps shingles of one set only out of the shuffle: 8 for each shared shingle, within these bounds.
SHARED_BITS, MOST_BITS = 1 << 26, 1 << 29
#: Part of the hash range that is ordered by rarity, in lengths of a prefix.
REGION = 1.6
#: Parts of the hash range in which the shingles of large families are counted, one after the other, the last for what is left.
COUNTED = (0.6, 1.0)
#: Ratio between the bounds of size classes, in which segments are equal for both sets of a pair.
RATIO = 1.5
#: Segments more than needed, so that one that is equal and not empty is certain but for sets with more empty ones.
SPARE = 2
#: Ratio between the sizes of sets in one bucket of a large family.
BUCKET = 1.1
#: Set hashes that a task remembers, so that copies give their shingles once a task.
REMEMBERED = 50_000


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words the whole sequence is one."""
    if not len(words):
        return words
    return np.unique(grams(words, min(k, len(words)))) if len(words) > k else grams(words, len(words))


def set_hash(own: np.ndarray) -> int:
    """One number for a set; with it, sets count as equal. Two of 10**9 different sets share one with odds of 3 %."""
    return int(mix(np.array([np.add.reduce(mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A))) + np.uint64(len(own))], dtype=np.uint64)).view(np.int64)[0])


def prefix_length(n: int, permille: int) -> int:
    """Shingles of which two linked sets, one of them of n, share at least one."""
    return n - -(-permille * n // 1000) + 1


def region_end(permille: int) -> int:
    """Hashes below this are ordered by rarity."""
    return min((1 << 64) - 1, int(REGION * (1000 - permille) / 1000 * (1 << 64)))


def prefix_candidates(own: np.ndarray, permille: int) -> tuple[np.ndarray, int]:
    """Shingles that may be in the set's prefix, and the prefix length less the number of those in the region.

    Where the region holds fewer than a prefix, the next by hash are added.
    """
    length, low = prefix_length(len(own), permille), int(np.searchsorted(own, np.uint64(region_end(permille))))
    return own[: max(low, length)], length - low


def class_bound(c: int) -> int:
    """Least size in a size class."""
    return math.ceil(RATIO**c)


def size_classes(n: int, permille: int) -> list[int]:
    """Size classes in which a set of n shingles seeks partners: its own, and those below where a partner may lie."""
    own = max(0, int(math.log(n, RATIO)))
    while class_bound(own + 1) <= n:
        own += 1
    while class_bound(own) > n:
        own -= 1
    out = [own]
    while out[-1] and n * permille <= (class_bound(out[-1]) - 1) * 1000:
        out.append(out[-1] - 1)
    return out


def segment_count(c: int, permille: int) -> int:
    """Segments of a size class: the largest possible difference of two linked sets, and SPARE + 1; 0 if only equal sets link."""
    most = class_bound(c + 1) - 1
    both = most + most * 1000 // permille  # with the largest partner
    differ = both * (1000 - permille) // (1000 + permille)
    return differ + 1 + SPARE if differ else 0


def segment_keys(own: np.ndarray, permille: int) -> np.ndarray:
    """Keys of the set's segments. Empty segments give keys only where a set has more of them than SPARE."""
    keys = [np.zeros(0, dtype=np.uint64)]
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(own + np.uint64(0x51ED270B1)), dtype=np.uint64)))
    for c in size_classes(len(own), permille):
        m = segment_count(c, permille)
        if not m:
            continue
        ends = np.searchsorted(own, np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m))
        ends = np.concatenate(([0], ends, [len(own)]))
        name = np.arange(m, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(c * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        key = mix(total[ends[1:]] - total[ends[:-1]] + mix(name + np.uint64(1)))
        empty = ends[1:] == ends[:-1]
        keys.append(key if empty.sum() > SPARE else key[~empty])
    return np.concatenate(keys)


def _sets(batch_column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for b in blocks(batch_column, BLANK_DELIMITED):
        for i in range(b.n):
            yield b.first + i, shingle_set(b.hashes[b.bounds[i] : b.bounds[i + 1]], k)


def row_key() -> Column:
    """Hash of doc_id (or none) and text: equal for repeated rows only."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _identities(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row (its key), n_shingles and cls, the set's hash (null for an empty set)."""

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes = [], []
            for _, own in _sets(batch.column(1), k):
                sizes.append(len(own))
                hashes.append(set_hash(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(hashes, pa.int64())], names=["doc_id", "row", "n_shingles", "cls"])

    return docs.select("doc_id", "text", row_key().alias("row")).mapInArrow(identify, "doc_id long, row long, n_shingles long, cls long")


def _candidates(docs: DataFrame, k: int, permille: int, table=None) -> DataFrame:
    """token, cls, gap of the sets' prefix candidates, with a table of bits only those whose bit is set.

    A copy's are left out where its task remembers having given them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: OrderedDict[int, None] = OrderedDict()
        for batch in batches:
            tokens, classes, gaps = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for _, own in _sets(batch.column(0), k):
                if not len(own) or (cls := set_hash(own)) in given:
                    continue
                given[cls] = None
                if len(given) > REMEMBERED:
                    given.popitem(last=False)
                some, gap = prefix_candidates(own, permille)
                if table is not None:
                    some = some[table.value.has(some)]
                tokens.append(some)
                classes.append(np.full(len(some), cls))
                gaps.append(np.full(len(some), gap, dtype=np.int32))
            columns = [np.concatenate(tokens).view(np.int64), np.concatenate(classes), np.concatenate(gaps)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "cls", "gap"])

    return docs.select("text").mapInArrow(cut, "token long, cls long, gap int")


class BitTable:
    """Bits of hashes; of bounded size for any corpus, so it may hold more than was put in."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (mix(hashes) >> self.shift).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bit_table(keys: DataFrame, name: str, size: int) -> BitTable:
    """Table of `size` bits of a long column: each task gives its bits in parts, and parts are combined before they meet."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - size.bit_length() + 1)
        for batch in batches:
            at = np.unique((mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> shift).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], names=["part", "bit"])

    marked = keys.where(F.col(name).isNotNull()).select(name).mapInArrow(mark, "part long, bit long")
    table = np.zeros((max(1, size // 32768), 4096), dtype=np.uint8)
    for r in marked.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # size / 8 bytes
        table[r.part] = np.frombuffer(r.bits, dtype=np.uint8)
    return BitTable(table.reshape(-1))


def bits_for(n: int) -> int:
    """Bits of a table of n shingles: a power of two of 8 n at least, from SHARED_BITS to MOST_BITS."""
    return min(MOST_BITS, max(SHARED_BITS, 1 << (8 * n).bit_length()))


def _families(docs: DataFrame, k: int, permille: int) -> DataFrame:
    """node, component: classes that share prefix shingles, and the family they belong to."""
    spark = docs.sparkSession
    # copies in several tasks count more than once: df orders the shingles, and is the same for all sets
    counted = _candidates(docs, k, permille).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("cls").alias("least"), F.max("cls").alias("most"))
    shared = written(counted.where("least < most").select("token", "df", "least"), "shared")
    table = spark.sparkContext.broadcast(bit_table(shared, "token", bits_for(shared.count())))
    rows = _candidates(docs, k, permille, table)
    found = spread_join(rows, shared.withColumn("n", F.col("df")), ["token"], "n", F.xxhash64("cls"))
    # one row of each class and shingle, whatever the number of tasks that met a copy of the class
    found = found.groupBy("cls", "token").agg(F.first("gap").alias("gap"), F.first("df").alias("df"), F.first("least").alias("least"))
    # as signed numbers the region's hashes are those from 0 on, then those from the least on, up to its end
    end = region_end(permille)
    low = (F.col("token") >= 0) & (F.col("token") < end) if end < 1 << 63 else (F.col("token") >= 0) | (F.col("token") < end - (1 << 64))
    of = Window.partitionBy("cls")
    ranked = found.withColumn("low", low).withColumns({"c": F.count_if("low").over(of), "rank": F.row_number().over(of.orderBy(F.desc("low"), "df", "token"))})
    edges = ranked.where("(NOT low OR rank <= gap + c) AND cls <> least").select("cls", "least").distinct()
    return written(connected_components(edges, "cls", "least"), "families")


def _maybe_among(ids: DataFrame, name: str) -> F.Column:
    """False only for values of a long column that are not in ids: a table of BITS bits, sent to every task."""
    held = ids.sparkSession.sparkContext.broadcast(bit_table(ids, name, BITS))

    @F.pandas_udf("boolean")
    def is_set(value: pd.Series) -> pd.Series:
        return pd.Series(held.value.has(value.to_numpy(dtype=np.int64).view(np.uint64)))

    return is_set(F.coalesce(F.col(name), F.lit(0)))


def _each_once(held: DataFrame, members: DataFrame, k: int, name: str, give: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rows of the members' sets: a column `name` of what `give` makes of a set, and cls. Copies give theirs once a task.

    A few sets that are not members may come along.
    """
    among = held.sparkSession.sparkContext.broadcast(bit_table(members, "cls", BITS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: OrderedDict[int, None] = OrderedDict()
        for batch in batches:
            keys, classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, own in _sets(batch.column(0), k):
                if not len(own) or (cls := set_hash(own)) in given or not among.value.has(np.array([cls]).view(np.uint64))[0]:
                    continue
                given[cls] = None
                if len(given) > REMEMBERED:
                    given.popitem(last=False)
                keys.append(give(own))
                classes.append(np.full(len(keys[-1]), cls))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(classes))], names=[name, "cls"])

    return held.select("text").mapInArrow(cut, f"{name} long, cls long")


def counted_part(own: np.ndarray, part: float) -> np.ndarray:
    """The set's shingles in so large a part of the hash range, from 0 on."""
    return own if part >= 1 else own[: int(np.searchsorted(own, np.uint64(int(part * (1 << 64)))))]


def may_link(own: np.ndarray, common: BitTable, permille: int, part: float = 1.0) -> bool:
    """False only for sets without links: more of their counted shingles are in no other set than a link leaves over."""
    some = counted_part(own, part)
    return 1000 * (len(some) - int(common.has(some).sum())) <= (1000 - permille) * len(own)


def _that_may_link(held: DataFrame, members: DataFrame, k: int, permille: int, part: float) -> DataFrame:
    """The members (cls and other columns) but those that may_link() rules out, with what two or more members have as common."""
    tokens = _each_once(held, members, k, "token", lambda own: counted_part(own, part))
    counted = tokens.groupBy("token").agg(F.min("cls").alias("least"), F.max("cls").alias("most"))
    common = written(counted.where("least < most").select("token"), "common")
    table = held.sparkSession.sparkContext.broadcast(bit_table(common, "token", bits_for(common.count())))
    left = _each_once(held, members, k, "token", lambda own: own[:1] if may_link(own, table.value, permille, part) else own[:0])
    return written(members.join(left.select("cls").distinct(), "cls", "left_semi"), "left")


def _divided(docs: DataFrame, members: DataFrame, k: int, permille: int) -> DataFrame:
    """family, cls of the members (family, cls, row) that share a segment with others of their family, in smaller families.

    Members with too many shingles of their own to link with any other leave first.
    """
    rows = docs.select("text", row_key().alias("row")).where(_maybe_among(members, "row"))
    held = written(rows.select("text"), "held")
    for part in COUNTED:
        members = _that_may_link(held, members, k, permille, part)
    keys = _each_once(held, members, k, "key", lambda own: segment_keys(own, permille))
    keyed = written(keys.join(members, "cls").select("family", "key", "cls"), "segments")
    shared = keyed.groupBy("family", "key").agg(F.min("cls").alias("least"), F.max("cls").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    edges = spread_join(keyed, written(shared, "shared"), ["family", "key"], "n", F.xxhash64("cls")).where("cls <> least").select("cls", "least").distinct()
    return connected_components(edges, "cls", "least").select(F.col("component").alias("family"), F.col("node").alias("cls"))


def _members(docs: DataFrame, classes: DataFrame, k: int, permille: int) -> DataFrame:
    """family, block, cls, row, n_shingles of all classes that may link. classes: cls, row, n_shingles."""
    weight = F.sum(F.greatest("n_shingles", F.lit(LIGHTEST)))
    families = _families(docs, k, permille).select(F.col("component").alias("family"), F.col("node").alias("cls"))
    sized = written(families.join(classes, "cls"), "sized")
    heavy = sized.groupBy("family").agg(weight.alias("weight")).where(F.col("weight") > BLOCK).select("family")
    large = written(sized.join(heavy, "family", "left_semi").select("family", "cls", "row"), "large")
    small = sized.join(heavy, "family", "left_anti")
    divided = _divided(docs, large, k, permille).join(classes, "cls").select(*small.columns)
    bucket = F.floor(F.log(BUCKET, "n_shingles")).cast("int")
    every = written(small.unionByName(divided), "families").withColumn("bucket", bucket)
    by_family = every.groupBy("family").agg(weight.alias("weight"))
    by_bucket = every.groupBy("family", "bucket").agg(F.ceil(weight / BLOCK).cast("int").alias("parts"))
    # blocks in the order of size: those of a bucket, numbered from a start of its own
    block = F.when(F.col("weight") <= BLOCK, 0).otherwise(F.col("bucket") * (1 << 20) + F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    dealt = every.join(by_family, "family").join(by_bucket, ["family", "bucket"])
    return dealt.select("family", block.alias("block"), "cls", "row", "n_shingles")


class Trie:
    """Compressed prefix tree of sets, as edges in the order of a walk: parent edge, tokens, sets that end there."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes() if sets[i].dtype == ">u8" else sets[i].astype(">u8").tobytes())
        self.edges: list[tuple[int, np.ndarray, list[int], int, int]] = []
        self._build([(i, sets[i]) for i in self.order], 0, -1)

    def _build(self, group: list[tuple[int, np.ndarray]], depth: int, parent: int) -> None:
        work = [(group, depth, parent)]
        while work:
            group, depth, parent = work.pop()
            runs: list[list[tuple[int, np.ndarray]]] = []
            for x in group:
                if len(x[1]) > depth:
                    if runs and runs[-1][0][1][depth] == x[1][depth]:
                        runs[-1].append(x)
                    else:
                        runs.append([x])
            for run in runs:
                low, high = run[0][1], run[-1][1]
                n = min(len(low), len(high))
                differ = np.flatnonzero(low[depth:n] != high[depth:n])
                end = depth + int(differ[0]) if len(differ) else n
                ends_here = [i for i, s in run if len(s) == end]
                self.edges.append((parent, low[depth:end], ends_here, min(len(s) for _, s in run), max(len(s) for _, s in run)))
                if len(run) > len(ends_here):
                    work.append((run, end, len(self.edges) - 1))


def trie_join(stored: list[np.ndarray], probes: list[np.ndarray], permille: int) -> Iterator[tuple[int, int]]:
    """Pairs (stored, probe) with 1000 x overlap >= permille x union, by one walk of the trie for PROBES probes."""
    if not stored or not probes:
        return
    trie = Trie(stored)
    for first in range(0, len(probes), PROBES):
        for i, j in _walk(trie, stored, probes[first : first + PROBES], permille):
            yield i, first + j


def _walk(trie: Trie, stored: list[np.ndarray], probes: list[np.ndarray], permille: int) -> Iterator[tuple[int, int]]:
    sizes = np.array([len(p) for p in probes])
    words, where = np.unique(np.concatenate(probes), return_inverse=True)
    held = np.zeros((len(words) + 1, len(probes)), dtype=np.int8)
    held[where, np.repeat(np.arange(len(probes)), sizes)] = 1
    overlap: list[np.ndarray | None] = []
    depth: list[int] = []
    for parent, tokens, ends_here, least, most in trie.edges:
        above = overlap[parent] if parent >= 0 else np.zeros(len(probes), dtype=np.int32)
        at = (depth[parent] if parent >= 0 else 0) + len(tokens)
        depth.append(at)
        if above is None:
            overlap.append(None)
            continue
        row = np.searchsorted(words, tokens)
        row[row == len(words)] = 0
        row = np.where(words[row] == tokens, row, len(words))
        own = above + held[row].sum(axis=0, dtype=np.int32)
        # what remains: of the longest set below, and of each probe what lies beyond the last token
        left_probe = sizes - own  # no token of a probe counts twice
        need = np.array(-(-permille * (np.maximum(least, 1) + sizes) // (1000 + permille)))
        alive = own + np.minimum(most - at, left_probe) >= need
        overlap.append(own if alive.any() else None)
        for i in ends_here:
            union = len(stored[i]) + sizes - own
            for j in np.flatnonzero(1000 * own.astype(np.int64) >= permille * union):
                yield i, int(j)


def _spanning(sets: list[np.ndarray], classes: list[int], side: list[int], permille: int) -> list[tuple[int, int]]:
    """Links that connect what a unit's sets connect, one fewer than the sets of each component."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = [i for i, s in enumerate(side) if s == 0]
    second = [i for i, s in enumerate(side) if s == 1] or first
    links = []
    for i, j in trie_join([sets[i] for i in first], [sets[j] for j in second], permille):
        a, b = find(first[i]), find(second[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((classes[first[i]], classes[second[j]]))
    return links


def _links(docs: DataFrame, members: DataFrame, k: int, permille: int) -> DataFrame:
    """a, b: links that span the classes of each family. members: family, block, cls, row, n_shingles."""
    bounds = members.groupBy("family", "block").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    left = bounds.select("family", F.col("block").alias("i"), F.col("most").alias("most_i"))
    right = bounds.select("family", F.col("block").alias("j"), F.col("least").alias("least_j"))
    # blocks are dealt by size, so j >= i holds the larger sets
    pairs = left.join(right, "family").where((F.col("i") <= F.col("j")) & (F.col("least_j") * permille <= F.col("most_i") * 1000))
    unit = F.struct("i", "j")
    either = pairs.select("family", unit.alias("unit"), F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    dealt = members.select("family", "block", "cls", "row").join(either, ["family", "block"]).withColumn("side", F.when(F.col("block") == F.col("unit.i"), 0).otherwise(1))
    per_row = dealt.groupBy("row", "cls").agg(F.collect_list(F.struct("family", "unit", "side")).alias("units"))  # at most the family's blocks
    per_row = written(per_row, "units")
    held = docs.withColumn("row", row_key()).where(_maybe_among(per_row, "row")).join(per_row.hint("merge"), "row")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: OrderedDict[int, None] = OrderedDict()  # repeated rows give their shingles once a task
        for batch in batches:
            sets = [own.view(np.int64) for _, own in _sets(batch.column("text"), k)]
            ours = []
            for own, cls in zip(sets, batch.column("cls").to_pylist(), strict=True):
                ours.append(cls not in given and set_hash(own.view(np.uint64)) == cls)
                if ours[-1]:
                    given[cls] = None
                    if len(given) > REMEMBERED:
                        given.popitem(last=False)
            keep = pa.array(ours)
            out = pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("units"), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "units", "shingles"])
            yield out.filter(keep)

    units = held.select("text", "cls", "units").mapInArrow(
        shingles, "cls long, units array<struct<family:long,unit:struct<i:int,j:int>,side:int>>, shingles array<long>"
    )
    rows = units.select("cls", "shingles", F.explode("units").alias("u")).select("u.family", "u.unit.i", "u.unit.j", "u.side", "cls", "shingles")

    def join(table: pa.Table) -> pa.Table:
        classes, at = np.unique(table.column("cls").to_numpy(), return_index=True)
        table = table.take(pa.array(at))
        flat = table.column("shingles").combine_chunks()
        sets = [np.asarray(x.values).view(np.uint64) for x in flat]
        links = _spanning(sets, classes.tolist(), table.column("side").to_pylist(), permille)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy("family", "i", "j").applyInArrow(join, "a long, b long")


def grouped(docs: DataFrame, k: int = 5, permille: int = 800) -> DataFrame:
    """One row per document row: doc_id, row (its key), n_shingles, group: one number for texts that links connect.

    Texts without words have no group (NULL). A doc_id plays no part in it.
    """
    docs = texts(docs)
    tables(docs.sparkSession)
    known = written(_identities(docs, k), "identities")
    classes = known.where("cls IS NOT NULL").groupBy("cls").agg(F.min("row").alias("row"), F.min("n_shingles").alias("n_shingles"))
    members = _members(docs, classes, k, permille)
    links = _links(docs, written(members, "members"), k, permille)
    linked = written(connected_components(links), "linked")
    of = known.join(linked.withColumnRenamed("node", "cls"), "cls", "left")
    return of.select("doc_id", "row", "n_shingles", F.coalesce("component", "cls").alias("group"))


def near_duplicates(docs: DataFrame, k: int = 5, permille: int = 800) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id.

    Texts are split at ASCII white space after lower-casing A-Z; permille is the least Jaccard similarity of linked
    sets in thousandths. component_id is the least doc_id that links lead to, the document's own included. Null and
    empty texts have no shingles and a component of their own; equal texts link; rows with a repeated doc_id are
    kept, each with its own text; a null doc_id never names a component unless all its texts have none; other columns
    are not used.
    """
    of = written(grouped(docs, k, permille), "groups")
    within, alone = of.where("group IS NOT NULL"), of.where("group IS NULL")
    least = written(within.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    named = spread_join(within, least, ["group"], "n", F.xxhash64("row", "doc_id", F.monotonically_increasing_id()))
    return named.select("doc_id", "n_shingles", "component_id").union(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
