"""Near-duplicate classes from banded signatures: what operators 6 and 8 share.

Nodes are distinct contents, so copies are counted once. Nodes with a common band key form
a bucket. In each bucket all nodes are compared with one leader, the node that meets the
most others over all its buckets, never all with all; a pair counts only if the exact
similarity of the two sets holds. What no leader has taken in elects further leaders in
later rounds, one node for each class that is left in a bucket. Then every pair of nodes
of two classes that still share a bucket is settled: pair by pair in buckets of SMALL nodes
at most, in larger ones by a prefix filter, which leaves out only pairs that cannot reach
the similarity. So no link between nodes of one bucket is lost. Classes are the connected
components of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialise, release
from .syncmers import mix

#: Rounds of leaders in a bucket.
ROUNDS = 2
#: Nodes of a bucket that are compared pair by pair in the end.
SMALL = 12
#: Cells that the frequencies of set elements are counted in.
CELLS = 1 << 18


def tune_bands(similarity: float, recall: float, width: int) -> tuple[int, int]:
    """(bands, rows): the most rows, that is the fewest chance meetings, with which a pair
    of just that similarity meets with at least that probability in width values."""
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands * rows <= width:
            return bands, rows
    raise ValueError(f"{width} values are too few")


#: Words of 64 bits that with_likely() marks wanted keys in.
MARKS = 1 << 17


def with_likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows with the column likely: false where key, a 64-bit hash, is not among those of
    wanted. It is broadcast as MARKS words of marks at most, whatever the size of wanted;
    where very many are wanted more rows are likely that are not, which a join then settles.
    So rows that nobody wants need not be shuffled."""
    place = lambda c: F.pmod(c, F.lit(MARKS)).cast("int")
    of = F.col(key)
    marks = wanted.select(place(of).alias("_place"), F.expr(f"shiftleft(1L, cast(pmod(shiftright(`{key}`, 40), 64) AS int))").alias("_bit")).groupBy("_place").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.join(F.broadcast(marks), place(of) == F.col("_place"), "left")
    return met.select(*rows.columns, F.coalesce(F.expr(f"getbit(_bits, cast(pmod(shiftright(`{key}`, 40), 64) AS int))") == 1, F.lit(False)).alias("likely"))


def elect(bands: DataFrame) -> DataFrame:
    """(a, b): each node of a bucket of several with the bucket's leader."""
    shared = bands.join(bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "key")
    met = shared.groupBy("node").agg(F.sum("size").alias("met"))
    ranked = shared.select("key", "node").join(met, "node")
    leaders = ranked.groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("leader"))
    return shared.select("key", "node").join(leaders, "key").filter("node != leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()


#: Layouts of packed sets: distinct 64-bit items, with 32-bit counts or without.
WEIGHTED = np.dtype([("item", "<u8"), ("count", "<u4")])
PLAIN = np.dtype([("item", "<u8")])


def pack_set(items: np.ndarray, counts: np.ndarray) -> bytes:
    packed = np.empty(len(items), WEIGHTED)
    packed["item"], packed["count"] = items, counts
    return packed.tobytes()


def overlaps(x: pa.Array, y: pa.Array, kind: np.dtype) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of packed multisets. An item and its pair
    make one hash; after one sort, equal neighbours are what a pair has in common."""
    keys, counts, owners = [], [], []
    for side in (x, y):
        lengths = pa.compute.binary_length(side).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize
        packed = np.frombuffer(b"".join(side.to_pylist()), kind)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        keys.append(mix(packed["item"] + mix(owner.astype(np.uint64) + np.uint64(1))))
        counts.append(packed["count"].astype(np.float64) if "count" in kind.names else np.ones(len(packed)))
        owners.append(owner)
    n = len(x)
    total = sum(np.bincount(o, c, n) for o, c in zip(owners, counts, strict=True))
    key, count, owner = (np.concatenate(c) for c in (keys, counts, owners))
    order = np.argsort(key)
    key, count, owner = key[order], count[order], owner[order]
    twice = np.flatnonzero(key[1:] == key[:-1])
    common = np.bincount(owner[twice], np.minimum(count[twice], count[twice + 1]), n)
    return common / np.maximum(total - common, 1.0)


def verify(pairs: DataFrame, sets: DataFrame, similarity: float, kind: np.dtype) -> DataFrame:
    """The pairs (a, b) whose sets (node, items) reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, "x", 2 << 20):
            near = pa.array(overlaps(batch.column("x"), batch.column("y"), kind) >= similarity, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], ["a", "b"])

    first = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component. Labels fall to the least
    label among neighbours, then to their label's own label, until none changes."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("heard")), "b").groupBy("a").agg(F.min("heard").alias("heard"))
        lower = labels.join(heard, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        labels = materialise(lower.join(jump, "root").select("node", "old", F.least("root", "further").alias("root")), "labels")
        if labels.filter("root != old").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def crowded(bands: DataFrame) -> DataFrame:
    """(key, node) of the buckets of three nodes and more: a leader settles those of two."""
    return bands.join(bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 2"), "key").select("key", "node")


def elements(packed: bytes, kind: np.dtype) -> np.ndarray:
    """A packed multiset as a set: the i-th copy of an item is an element of its own."""
    parts = np.frombuffer(packed, kind)
    if "count" not in kind.names:
        return mix(parts["item"])
    counts = parts["count"].astype(np.int64)
    copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(parts["item"], counts) + mix(copy.astype(np.uint64)))


def prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float, kind: np.dtype) -> DataFrame:
    """(a, b): pairs of nodes (node, root) of two roots that may reach the similarity. With
    elements in one order, rare ones first, two sets with overlap o share one within the
    first |x| - o + 1 of each; o is at least 2t / (1 + t) of the smaller set and t of the
    larger. What follows their first common element bounds the overlap from above: a match
    so far behind that t / (1 + t) of both sizes cannot be reached any more is no pair. Any
    order gives all pairs; counts in CELLS cells make it a good one."""
    spark = nodes.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for packed in batch.column("items").to_pylist():
                total += np.bincount((elements(packed, kind) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    counted = sets.select("items").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(CELLS, np.int64)
    frequency[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    known = spark.sparkContext.broadcast(frequency)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, "items"):
            taken, index, sizes = [], [], []
            for packed in batch.column("items").to_pylist():
                own = elements(packed, kind)
                own = own[np.lexsort((own, known.value[(own % np.uint64(CELLS)).astype(np.int64)]))]
                n = len(own)
                taken.append(own[: n - int(np.ceil(similarity * n - 1e-6)) + 1])
                index.append(np.arange(len(taken[-1])) <= n - int(np.ceil(2 * similarity / (1 + similarity) * n - 1e-6)))
                sizes.append(n)
            lengths = [len(x) for x in taken]
            rest = np.concatenate([np.arange(n, n - m, -1) for n, m in zip(sizes, lengths, strict=True)])
            columns = [np.concatenate(taken).view(np.int64), np.repeat(batch.column("node").to_numpy(), lengths), np.repeat(batch.column("root").to_numpy(), lengths), np.repeat(np.array(sizes, np.int64), lengths), rest, np.concatenate(index)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["element", "node", "root", "n", "rest", "index"])

    rows = sets.join(nodes, "node").select("node", "root", "items").mapInArrow(prefixes, "element long, node long, root long, n long, rest long, index boolean")
    # elements of one root only give no pair
    rows = materialise(rows, "prefixes")
    met = rows.groupBy("element").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("element")
    rows = materialise(rows.join(met, "element"), "met-prefixes")
    one, other = rows.filter("index").drop("index").alias("i"), rows.drop("index").alias("p")
    larger = (F.col("i.n") < F.col("p.n")) | ((F.col("i.n") == F.col("p.n")) & (F.col("i.node") < F.col("p.node")))
    reach = F.least("i.rest", "p.rest") >= (F.col("i.n") + F.col("p.n")) * (similarity / (1 + similarity)) - 1e-6
    near = larger & (F.col("i.root") != F.col("p.root")) & (F.col("p.n") * similarity <= F.col("i.n") + 1e-6) & reach
    return one.join(other, (F.col("i.element") == F.col("p.element")) & near).select(F.least("i.node", "p.node").alias("a"), F.greatest("i.node", "p.node").alias("b")).distinct()


def unsettled(buckets: DataFrame, labels: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, kind: np.dtype) -> DataFrame:
    """(a, b): all pairs of nodes of two classes in a bucket (key, node) that may have a link."""
    members = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    members = materialise(members, "members")
    mixed = members.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key", "size")
    left = materialise(members.join(mixed, "key"), "mixed")
    few = left.filter(F.col("size") <= SMALL)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    many = left.filter(F.col("size") > SMALL).select("node", "root").distinct()
    if not many.isEmpty():
        pairs = pairs.unionByName(prefix_pairs(many, sets_of(many.select("node")), similarity, kind)).distinct()
    return pairs


def classes(
    bands: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    similarity: float,
    kind: np.dtype,
    first_pairs: Callable[[DataFrame], DataFrame] = elect,
    rounds: int = ROUNDS,
    buckets_of: Callable[[DataFrame], DataFrame] = crowded,
    allowed: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
) -> DataFrame:
    """(node, root) of all nodes with a link. bands: (key, node), each pair once.
    sets_of(nodes) gives (node, items) of those nodes; buckets_of(bands) the buckets that
    leaders may not settle; allowed(pairs) those that may be linked."""
    spark = bands.sparkSession
    tried = edges = labels = None
    for number in range(rounds + 1):
        if number == rounds:
            known = labels if labels is not None else bands.select("node", F.col("node").alias("root")).limit(0)
            pairs = allowed(unsettled(buckets_of(bands), known, sets_of, similarity, kind))
            pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        elif number and labels is not None:
            lone = bands.join(labels, "node", "left").groupBy("key", F.coalesce("root", "node").alias("root")).agg(F.min("node").alias("node"))
            pairs = elect(lone.select("key", "node")).join(tried, ["a", "b"], "left_anti")
        else:
            pairs = first_pairs(bands)
        pairs = materialise(pairs, "pairs")
        release(spark)
        if pairs.isEmpty():
            continue
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        found = materialise(verify(pairs, sets_of(nodes), similarity, kind), "links")
        release(spark)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if labels is not None and found.isEmpty():
            continue
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges)
    return labels if labels is not None else bands.select("node", F.col("node").alias("root")).limit(0)
