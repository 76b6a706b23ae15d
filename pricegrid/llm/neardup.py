"""Near duplicates by ProbMinHash signatures of word shingles, banding, verification and components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrid.llm.common import (
    Prefixes,
    aside,
    byte_column,
    chunks,
    counted,
    mixed,
    restored,
    sent_by_value,
    stored,
    tasks_for,
    word_hashes,
    words,
)

sent_by_value(__name__)

SHINGLE = 5
SIMILARITY = 0.8

#: 24 bands of 4 registers of shingles that all weigh the same: registers agree with the similarity that links are judged
#: by, and two texts at the threshold miss each other in all bands about 3 times in a million. To these come 4 bands over
#: shingles weighed by their counts, which find texts that agree in what they repeat.
BANDS, ROWS, WEIGHTED_BANDS = 24, 4, 4

#: Texts that share a prefix shingle and are paired one by one; a larger group is compared in one task.
PAIRED_TEXTS = 32

#: Texts of a group, and shingles of them all, that are compared in one task; a larger group is dealt into blocks.
GROUP_TEXTS, GROUP_SHINGLES = 2048, 4_000_000

#: After how many parts of the pairs of blocks what has become one component is left out of the next part.
SPLITS = 2


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts, sorted by (text, hash): text number, hash, count.

    A text with fewer words than ``size``, but not none, has one shingle of all of them.
    """
    low, starts, ends, before = words(data, offsets)
    each, n = Prefixes(word_hashes(low, starts, ends)), np.diff(before)
    at = np.arange(len(starts))
    row = np.repeat(np.arange(len(n)), n)
    length = np.minimum(size, n)[row]
    whole = at + length <= before[1:][row]
    at, row, length = at[whole], row[whole], length[whole]
    hashed = mixed(each.of(at, at + length) + length.astype(np.uint64))
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    first = np.flatnonzero(new)
    return row[first], hashed[first], np.diff(np.append(first, len(row)))


_ARRIVAL, _REGISTER = 0xA24BAED4963EE407, 0x9FB21C651E98DF25


def prob_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """ProbMinHash signatures (n_rows x m) of weighted sets, by Poisson arrivals with early termination.

    Every element is a Poisson process of its weight's rate, driven by its own hash; an arrival falls to a register
    drawn by the same hash, and a register keeps the element that reaches it first. Two sets agree in a register with
    the probability Jaccard of their weights. An element stops once its next arrival is later than the last register
    of its set was reached. All sets advance together, one arrival a round.
    """
    best = np.full(n_rows * m, np.inf)
    taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    time, active, j = np.zeros(len(row)), np.arange(len(row)), 0
    while len(active):
        j += 1
        own = element[active]
        draw = mixed(own + np.uint64(_ARRIVAL * j % (1 << 64)))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        time[active] -= np.log(uniform) / weight[active]
        register = mixed(own ^ np.uint64(_REGISTER * j % (1 << 64))) % np.uint64(m)
        flat = row[active] * m + register.astype(np.int64)
        now = time[active]
        np.minimum.at(best, flat, now)
        first = now == best[flat]
        taken.append((flat[first], now[first], own[first]))
        last = best.reshape(n_rows, m).max(axis=1)
        active = active[now < last[row[active]]]
    signature = np.zeros(n_rows * m, np.uint64)
    for flat, now, own in taken:
        first = now == best[flat]
        signature[flat[first]] = own[first]
    return signature.reshape(n_rows, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers (n x bands)."""
    parts = mixed(signature.reshape(len(signature), bands, rows))
    key = mixed(np.arange(1, bands + 1, dtype=np.uint64))[None, :].repeat(len(signature), axis=0)
    for r in range(rows):
        key = mixed(key * np.uint64(31) + parts[:, :, r])
    return key


def signatures(texts: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, weighted: int = WEIGHTED_BANDS) -> DataFrame:
    """node, keys for every row of ``texts`` (node, text) that has a word: ``bands`` over equal weights, ``weighted`` over counts."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            for a, b in chunks(offsets):
                row, hashed, count = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                some = np.unique(row)
                keys = band_keys(prob_minhash(row, hashed, np.ones(len(row)), b - a, bands * rows)[some], bands, rows)
                if weighted:
                    # Elements of their own, so that these bands are drawn apart from the others.
                    signed = prob_minhash(row, mixed(hashed + np.uint64(1)), count.astype(np.float64), b - a, weighted * rows)
                    keys = np.concatenate([keys, mixed(band_keys(signed[some], weighted, rows))], axis=1)
                keys = keys.view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * keys.shape[1], pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(some)), lists], ["node", "keys"])

    return texts.select("node", "text").mapInArrow(sign, "node bigint, keys array<bigint>")


def node_bits(nodes: DataFrame, n: int) -> np.ndarray:
    """A bitmap with a bit for each of ``n`` ``nodes``, at the node modulo its length: ``NODE_BITS`` bits at most.

    A text whose bit is not set is none of the nodes; where a bit is, one text in sixteen is by chance.
    """
    bits = min(NODE_BITS, max(_PART_BITS, 1 << (16 * n).bit_length()))
    at = F.pmod("node", F.lit(bits))
    parts = nodes.select(F.floor(at / _PART_BITS).cast("int").alias("part"), F.pmod(at, F.lit(_PART_BITS)).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # NODE_BITS / 8 bytes
        out[r["part"] * _PART_BITS // 8 :][: _PART_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


#: 8 MB; where the nodes are more than that tells apart, more texts than needed have their shingles worked out.
NODE_BITS = 1 << 26
_PART_BITS = 1 << 15


def shingle_sets(texts: DataFrame, size: int = SHINGLE, wanted: np.ndarray | None = None) -> DataFrame:
    """node, shingles (distinct 32-bit hashes) for every row of ``texts`` (node, text), or those with a bit in ``wanted``.

    So the texts stay where they are, and only the sets that are needed are exchanged.

    Two shingles of a pair of texts with n of them fall together with a chance of n * n / 2**33, which moves a similarity
    by one shingle; in return the sets, which are most of what is exchanged, are half as large.
    """

    shared = None if wanted is None else texts.sparkSession.sparkContext.broadcast(wanted)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                at = np.asarray(batch.column(0)) % (8 * len(shared.value))
                batch = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            data, offsets = byte_column(batch.column(1))
            for a, b in chunks(offsets):
                row, hashed, _ = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                short = (hashed >> np.uint64(32)).astype(np.uint32)  # still sorted
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (short[1:] != short[:-1])
                row, short = row[new], short[new]
                ends = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(short.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(collect, "node bigint, shingles array<int>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of ``similarity`` or more."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    # Lengths alone rule out many pairs.
    near = (F.least(F.size("_a"), F.size("_b")) >= similarity * F.greatest(F.size("_a"), F.size("_b"))) & (
        both >= similarity * (F.size("_a") + F.size("_b") - both)
    )
    return pairs.join(right, "b").join(left, "a").filter(near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): the least node of its component.

    Alternates large and small stars until every node has one edge, to a root. A round is a few exchanges of the
    edges, in as many tasks as their number asks for.
    """
    spark = edges.sparkSession
    apart = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, n = counted(apart, "edges")
    while n:
        narrow = lambda df, k=tasks_for(spark, 2 * n): df.coalesce(k)
        both = edges.union(edges.select("b", "a"))
        least = stored(narrow(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))), "stars")
        large = narrow(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        large = stored(narrow(large), "edges")
        least = stored(narrow(large.groupBy("a").agg(F.min("b").alias("m"))), "stars")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = narrow(narrow(small).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        edges, n = counted(edges, "edges")
        # Stars: no node has two edges upwards, and none has edges both ways.
        ways = edges.select(F.col("a").alias("x"), F.lit(1).alias("up")).union(edges.select("b", F.lit(None).cast("int")))
        ways = ways.groupBy("x").agg(F.count("up").alias("up"), F.count(F.lit(1)).alias("all"))
        if narrow(ways.filter("up > 1 OR (up = 1 AND all > 1)")).isEmpty():
            break
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def near_links(texts: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """Components of near-duplicate texts: node, root for every node of ``texts`` (node, text) that has a partner.

    A band's bucket links its least node with the others first, which is as many pairs as rows. Open are then the texts
    of buckets of three and more that are in different components; every pair of open texts of different components
    is reached by a prefix-filter join, however many buckets or none they share.
    """
    signed = signatures(texts, bands, rows, size).dropDuplicates(["node"])
    bucketed = stored(signed.select(F.explode("keys").alias("key"), "node"), "bands")
    buckets = stored(bucketed.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members, n = counted(bucketed.join(buckets, "key"), "members")
    wanted, n_wanted = counted(members.select("node").distinct(), "nodes")
    sets = shingle_sets(texts, size, node_bits(wanted, n_wanted)).dropDuplicates(["node"])
    sets = stored(sets.withColumn("size", F.size("shingles")), "shingles")
    stars = members.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    stars = stored(stars.coalesce(tasks_for(texts.sparkSession, n)), "pairs")
    edges = stored(verified(stars, sets, similarity), "links")
    roots = stored(components(edges), "roots")

    # A bucket of two texts has no pair but the one that is judged.
    apart, n = _apart(members.filter("n > 2"), roots)
    if not n:
        return roots
    open_nodes = stored(apart.select("node", "root").distinct(), "open")
    index = stored(_prefixes(sets.join(open_nodes, "node"), similarity), "prefixes")
    groups = index.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("all"),
        (F.min("root") != F.max("root")).alias("mixed"),
        *[F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(20,0)")).alias(f"same{k}") for k in (1, 2)],
    )
    groups = stored(groups.filter("mixed"), "groups")

    one = index.join(groups.filter(F.col("n") <= PAIRED_TEXTS).select("key"), "key")
    pairs = stored(_paired(one, stars, similarity), "pairs")
    links, n = counted(verified(pairs, sets, similarity), "links")
    if n:
        edges = edges.union(links)
        roots = stored(components(edges), "roots")

    # Shingles that the same texts share would give the same pairs: one of them is enough.
    crowded = groups.filter(F.col("n") > PAIRED_TEXTS).groupBy("n", "all", "same1", "same2").agg(F.min("key").alias("key"))
    large = (F.col("n") > GROUP_TEXTS) | (F.col("all") > GROUP_SHINGLES)
    few, n = _apart(index.join(crowded.filter(~large).select("key"), "key"), roots)
    if n:
        links, n = counted(_compared(few.join(sets.drop("size"), "node"), similarity), "links")
    if n:
        edges = edges.union(links)
        roots = stored(components(edges), "roots")
    left, n = _apart(index.join(crowded.filter(large).select("key"), "key"), roots)
    if not n:
        return roots
    blocks = _blocks(left, sets, similarity)
    for part in range(SPLITS + 1):
        cells, n = _apart(_cells(blocks, part, SPLITS + 1), roots)
        links, n = counted(_compared(cells.join(sets.drop("size"), "node"), similarity), "links") if n else (None, 0)
        if n:
            edges = edges.union(links)
            roots = stored(components(edges), "roots")
    return roots


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """key, node, root, size, place: the shingles of texts (node, root, size, shingles) that a similar text must share one of.

    All texts order their shingles alike, those of fewer texts first. Two sets that are similar enough share one of
    the first ``size - ceil(similarity * size) + 1`` of each; ``place`` is the shingle's place in that order, from 0. A
    shingle that only one component has can be shared with no other, so such shingles are first in the order and are
    left out. Texts with a template and enough words of their own have no other prefix and drop out here.
    """
    each = sets.select("node", "root", "size", F.explode("shingles").alias("key"))
    held = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("_x"), F.max("root").alias("_y")).filter("_x <> _y")
    shared = each.join(held.select("key", "n"), "key").groupBy("node", "root", "size")
    shared = shared.agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    own = F.col("size") - F.size("keys")
    prefix = F.col("size") - F.ceil(F.col("size") * F.lit(similarity) - 1e-9) + 1
    first = F.slice("keys", F.lit(1), F.greatest(prefix - own, F.lit(0)).cast("int"))
    listed = shared.select("node", "root", "size", own.alias("own"), F.posexplode(first).alias("at", "found"))
    return listed.select(F.col("found.key").cast("long").alias("key"), "node", "root", "size", (F.col("own") + F.col("at")).alias("place"))


def _paired(index: DataFrame, judged: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts of different components that share a key of ``index``, once, without those ``judged``.

    The first shingle that two texts share leaves no more to share than what comes after it in either; lengths too must fit.
    """
    left, right = [index.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("node", "root", "size", "place")]) for k in (1, 2)]
    most = F.least(F.col("size1") - F.col("place1"), F.col("size2") - F.col("place2"))
    fit = (F.least("size1", "size2") >= similarity * F.greatest("size1", "size2")) & (
        most * (1 + similarity) >= similarity * (F.col("size1") + F.col("size2")) - 1e-6
    )
    pairs = left.join(right, "key").filter((F.col("node1") < F.col("node2")) & (F.col("root1") != F.col("root2")) & fit)
    pairs = pairs.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()
    return pairs.join(judged, ["a", "b"], "left_anti")


def _blocks(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """key, node, blocks, block: the texts of large groups (key, node) dealt into blocks of half of what a task compares.

    Texts are told apart by their number of shingles first: similar ones are of one class or of neighbouring classes,
    so each text goes to the group of its class and to that of the next one.
    """
    step = 1.001 * max(0.01, -math.log(max(similarity, 1e-9)))
    class_ = F.floor(F.log("size") / step)
    sized = rows.select("key", "node").join(sets.select("node", "size"), "node").withColumn("_class", class_)
    sized = stored(sized.select("key", "node", "size", "_class", F.explode(F.array("_class", F.col("_class") + 1)).alias("_group")), "classes")
    weight = sized.groupBy("key", "_group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"), F.max("_class").alias("_last"))
    # A group without a text of its own class has only pairs that the group before has too.
    weight = weight.filter("n > 1 AND _last = _group")
    one = (F.col("n") <= GROUP_TEXTS) & (F.col("all") <= GROUP_SHINGLES)
    halves = F.greatest(F.ceil(2 * F.col("n") / GROUP_TEXTS), F.ceil(2 * F.col("all") / GROUP_SHINGLES))
    blocks = F.when(one, F.lit(1)).otherwise(F.least(halves, "n")).cast("int")
    dealt = sized.join(stored(weight.select("key", "_group", blocks.alias("blocks")), "groups"), ["key", "_group"])
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block")
    return stored(dealt.select(F.xxhash64("key", "_group").alias("key"), "node", "blocks", block), "blocks")


def _cells(blocks: DataFrame, part: int, parts: int) -> DataFrame:
    """key, node of one in ``parts`` of the pairs of blocks, a key for each pair; a block is paired with itself too."""
    each = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.filter(F.abs(F.col("_other") - F.col("block")) % parts == part)
    return each.select(F.xxhash64("key", F.least("block", "_other"), F.greatest("block", "_other")).alias("key"), "node")


def _apart(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """key, node, root of the buckets or groups whose texts are in more than one component, and their number."""
    labelled = members.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = stored(labelled, "labelled")
    ends = labelled.groupBy("key").agg(F.min("root").alias("_x"), F.max("root").alias("_y")).filter("_x <> _y").select("key")
    keys, n = counted(ends, "mixed")
    return counted(labelled.join(keys, "key"), "mixed") if n else (labelled.limit(0), 0)


def cross_links(root: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each two components with a similar pair of texts, the places of one such pair (k x 2)."""
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column, both = row[order], column[order], np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        block = np.zeros((len(sets), _COLUMNS), np.float32)
        block[row[a:b], column[a:b] - first] = 1
        both += block @ block.T
    near = (both >= similarity * (size[:, None] + size[None, :] - both)) & (root[:, None] < root[None, :])
    x, y = np.nonzero(near)
    pair = np.unique(np.stack([root[x], root[y]]), axis=1, return_index=True)[1] if len(x) else x
    return np.stack([x[pair], y[pair]], axis=1)


_COLUMNS = 1024


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) across components within the groups of ``rows`` (key, node, root, shingles), a group at a time."""

    def links(group: list[tuple]) -> list[tuple[int, int]]:
        root, node = np.array([g[2] for g in group]), [g[1] for g in group]
        return [(node[x], node[y]) for x, y in cross_links(root, [g[3] for g in group], similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            key, node, root = (batch.column(i).to_pylist() for i in range(3))
            lists = batch.column(3)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k in range(len(key)):
                if group and key[k] != group[0][0]:
                    out += links(group)
                    group = []
                group.append((key[k], node[k], root[k], values[ends[k] : ends[k + 1]].copy()))
            yield _pairs(out)
        if group:
            yield _pairs(links(group))

    dealt = rows.select("key", "node", "root", "shingles").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def node_of(documents: DataFrame) -> Column:
    """A 64-bit hash that is the same for equal texts only; null counts as empty.

    Two hashes of 64 bits are taken of every text. Where texts agree in the first and differ in the second, which is
    rare by chance, both make up the node.
    """
    text = F.coalesce("text", F.lit(""))
    one, two = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    both = documents.select(one.alias("one"), two.alias("two")).groupBy("one").agg(F.min("two").alias("x"), F.max("two").alias("y"))
    clashes = [r["one"] for r in both.filter("x <> y").select("one").limit(MOST_CLASHES + 1).collect()]
    if len(clashes) > MOST_CLASHES:
        raise ValueError("too many texts agree in a 64-bit hash")
    return F.when(one.isin(clashes), F.xxhash64(F.lit(2), two)).otherwise(one) if clashes else one


#: Texts that agree in 64 bits by chance are some 70 among 5e10; far more than that means that the hash is attacked.
MOST_CLASHES = 10_000


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, node: Column | None = None) -> DataFrame:
    """Every row of ``documents`` with its class of near-duplicate texts.

    Needs doc_id and text; other columns are ignored. Returns doc_id, node, class_id (least doc_id of the class),
    class_size (rows) and kept (the row whose doc_id is class_id). Two texts are linked if the sets of their shingles,
    five consecutive words, have a Jaccard similarity of ``similarity`` or more; classes are the connected components.
    A text of one to four words has one shingle; texts without words (null, empty, only punctuation) are linked only
    to equal ones, null counting as empty. Texts are told apart by ``node``, ``node_of`` if none is given. Rows of one doc_id and text
    are all kept or none; a null doc_id is class_id only where its class has no other. An empty table gives an empty
    result.
    """
    texts = documents.select("doc_id", (node_of(documents) if node is None else node).alias("node"), "text")
    roots = stored(near_links(texts, similarity), "roots")
    slim = stored(texts.select("doc_id", "node"), "nodes")
    placed = stored(slim.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))
    classes = stored(placed.groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size")), "classes")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    return placed.join(classes, "root").select("doc_id", "node", F.col("first.doc_id").alias("class_id"), "class_size", same.alias("kept"))


def deduplicated(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``documents`` with one row of each class of near duplicates, all columns as they were."""
    node = node_of(documents)
    kept = near_duplicates(documents, similarity, node).filter("kept").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("_rows"))
    kept = stored(kept.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), "_rows"), "kept")
    rows = aside(documents, "doc_id", "text").join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (node == F.col("_node")))
    rows = rows.filter("_rows = 1").unionByName(rows.filter("_rows > 1").dropDuplicates(["_id", "_node"]))
    return restored(rows, documents.columns, "doc_id", "text")
