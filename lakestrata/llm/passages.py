"""Operator 6: substring deduplication by paragraph MinHash banding. Paragraphs are the
runs of whole sentences of at least MIN_WORDS words, one from the start of each sentence
of at least MIN_SENTENCE (the shortest of those with one end); line ends count as sentence
ends, and a sentence over MIN_WORDS words without one is cut at every MIN_WORDS.
Signatures of word shingles are banded for high recall, colliding paragraphs are verified
by exact Jaccard similarity, and components of the links are the classes of repeated
paragraphs.

A passage may begin and end anywhere in a line, so besides these there are seeds: SEED
words from each anchor. A word is an anchor if the hash of the three words from it on is
the least of REACH such in a row, which depends on those words alone. A passage of over 50
words holds a whole seed wherever it stands; equal seeds are one class.

Of each class the first occurrence, by doc_id and place, stays. Later ones that touch make a
run, which is extended word by word to both sides as far as the text agrees with that of
the first occurrence: from one seed to the next in a passage, too. Runs at most WORDS words
apart are one passage; the runs of passages with min_passage repeated words are removed,
and no word between them. In an alike paragraph its own words go with it.

Defined results. Null or empty text: nothing to remove. Passages below min_passage words (a
parameter, MIN_PASSAGE unless given) are left alone. In scripts without blanks (Chinese,
Japanese, Thai, Lao) each character is a word. Null doc_id: takes part, first in order. Repeated doc_ids with one text:
one document; the same holds for their removals. Copies of a whole text: all but the first
go. A passage repeated in one text: all but the first go. Very long texts are taken whole.
Empty table: no rows. Other columns, whatever their names, pass through clean().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bagminhash import band_keys
from .common import batched, fresh_path, materialise, release, table
from .linking import PLAIN, classes, tune_bands, with_likely
from .syncmers import mix
from .textvec import FOLDED, join, sentence_ends, span_hashes, word_spans

WORDS = 5
SIMILARITY = 0.8
MIN_WORDS = 25
#: Sentences below that begin no paragraph: it would be all but the one after it.
MIN_SENTENCE = 6
#: Words of a seed, and runs of three words among which an anchor is the least: a passage of
#: SEED + REACH - 1 = 51 words holds a seed.
SEED, REACH = 16, 36
MIN_PASSAGE = 40
#: Words to either side of a run that are compared; within that many there is another seed.
CONTEXT = REACH + 4
BANDS, ROWS = tune_bands(SIMILARITY, 0.98, 8)
#: Bits of a place that hold the first word.
PLACE = 28
_MULTIPLY = mix(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[10, 33, 46, 63]] = True


class Words:
    """The words of a batch of texts: their hashes, the text of each, and where each text's
    words begin and end."""

    def __init__(self, texts: list[bytes]):
        self.data, at = join(texts)
        self.starts, self.ends = word_spans(self.data)
        self.hashes = span_hashes(FOLDED[self.data], self.starts, self.ends)
        self.text_of = np.searchsorted(at, self.starts, "right")
        counts = np.bincount(self.text_of, minlength=len(texts))
        self.last = np.cumsum(counts)
        self.first = self.last - counts


def paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, first word and end word (counted in the batch) of each paragraph."""
    n = len(w.hashes)
    if not n:
        return (np.empty(0, np.int64),) * 3
    stops = np.concatenate([[0], np.cumsum(sentence_ends(w.data, _SENTENCE_END))])
    cut = np.zeros(n + 1, bool)  # a sentence starts at this word
    cut[0] = cut[n] = True
    cut[1:n] = stops[w.starts[1:]] > stops[w.ends[:-1]]
    cut[w.last] = True
    bounds = np.flatnonzero(cut)
    gaps = np.diff(bounds)
    if (long := np.flatnonzero(gaps > MIN_WORDS)).size:
        bounds = np.sort(np.concatenate([bounds, *(np.arange(bounds[i] + MIN_WORDS, bounds[i + 1], MIN_WORDS) for i in long)]))
    first = bounds[:-1][np.diff(bounds) >= MIN_SENTENCE]
    reach = np.searchsorted(bounds, first + MIN_WORDS)
    fits = reach < len(bounds)
    first, end = first[fits], bounds[reach[fits]]
    own = w.text_of[first]
    inside = end <= w.last[own]
    inside[:-1] &= end[1:] != end[:-1]  # of those with one end, the shortest
    return own[inside], first[inside], end[inside]


def _sliding(values: np.ndarray, best: np.ufunc) -> np.ndarray:
    """best of each REACH values in a row."""
    width = 1
    while 2 * width <= REACH:
        values, width = best(values[:-width], values[width:]), 2 * width
    rest = REACH - width
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def seeds(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """text and first word (counted in the batch) of each seed."""
    n = len(w.hashes)
    if n < REACH + 2:
        return (np.empty(0, np.int64),) * 2
    step = np.uint64(0xD1342543DE82EF95)
    gram = mix((w.hashes[:-2] * step + w.hashes[1:-1]) * step + w.hashes[2:]) | np.uint64(1)
    least = _sliding(gram, np.minimum)
    at = np.arange(len(least))
    least[at + REACH + 2 > w.last[w.text_of[: len(least)]]] = 0  # a row of one text only
    pad = np.zeros(REACH - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), np.maximum) == gram)
    chosen = chosen[chosen + SEED <= w.last[w.text_of[chosen]]]
    return w.text_of[chosen], chosen


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    total = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for i in range(WORDS):
        total = total * np.uint64(0xF1357AEA2E62A9C5) + words[i : i + len(total)]
    return mix(total)


def signatures(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """MinHash values of paragraphs, given by words of a whole batch (all in one text each).
    A paragraph has 21 to 60 shingles: two overlapping runs of 16, or of 32, span it, and
    the minima of all runs of 16 and 32 take five steps by doubling."""
    items = np.append(shingle_hashes(words), np.zeros(64, np.uint64))
    last = end - WORDS + 1
    long = last - first > 32
    out = np.empty((len(first), BANDS * ROWS), np.uint64)
    for i, m in enumerate(_MULTIPLY):
        low = items * m
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        out[:, i] = np.minimum(low[first], low[last - 16])
        if long.any():
            lower = np.minimum(low[:-16], low[16:])
            out[long, i] = np.minimum(lower[first[long]], lower[last[long] - 32])
    return out


def _doc_key() -> Column:
    return F.coalesce("doc_id", F.lit(-(2**63)))


def _content() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_doc_key().alias("key"), _content().alias("content"), F.coalesce("text", F.lit("")).alias("text"))


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode() for t in batch.column("text").to_pylist()]


def _occurrences(docs: DataFrame) -> DataFrame:
    """key, content, first, end, node, keys and seed of every paragraph and every seed,
    stored apart. keys: the bands of a paragraph."""
    names = ["key", "content", "first", "end", "node", "keys", "seed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, "text"):
            w = Words(_encoded(batch))
            for is_seed in (False, True):
                own, first, *end = seeds(w) if is_seed else paragraphs(w)
                if not len(own):
                    continue
                end = first + SEED if is_seed else end[0]
                base = w.first[own]
                keys = pa.nulls(len(own), pa.list_(pa.int64()))
                if not is_seed:
                    keys = pa.ListArray.from_arrays(np.arange(0, len(own) * BANDS + 1, BANDS, dtype=np.int32), band_keys(signatures(w.hashes, first, end), BANDS, ROWS).ravel())
                node = span_hashes(w.hashes, first, end).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(own), batch.column("content").take(own), pa.array((first - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), pa.array(node), keys, pa.array(np.full(len(own), is_seed))], names)

    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "occurrences")
    made = _keyed(docs).mapInArrow(run, "key long, content long, first int, end int, node long, keys array<long>, seed boolean")
    made.write.partitionBy("seed").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def _buckets(paragraphs: DataFrame) -> DataFrame:
    """Each paragraph of a bucket with the bucket's first, one exchange and one sort: key,
    leader and node, place and end of both. Stored, as the bands are shuffled but once.
    place is the text's hash and, in the lower PLACE bits, the paragraph's first word."""
    place = F.shiftleft("content", PLACE).bitwiseOR(F.col("first").cast("long").bitwiseAND((1 << PLACE) - 1))
    bands = paragraphs.select(F.explode("keys").alias("key"), "node", place.alias("place"), "end")
    line = Window.partitionBy("key").orderBy("node", "place")
    known = bands.select("key", F.first("node").over(line).alias("leader"), F.first("place").over(line).alias("there"), F.first("end").over(line).alias("until"), "node", "place", "end", F.lag("node").over(line).alias("last"))
    return materialise(known.filter((F.col("node") != F.col("leader")) & (F.col("node") != F.col("last"))).drop("last"), "buckets")


def _overlapping(place: Column, end: Column, there: Column, until: Column) -> Column:
    """Whether two paragraphs share words of one text: they meet often and are no repeats."""
    mask = F.lit((1 << PLACE) - 1)
    return (F.shiftright(place.bitwiseXOR(there), PLACE) == 0) & (place.bitwiseAND(mask) < until) & (there.bitwiseAND(mask) < end)


def _crowded(met: DataFrame) -> DataFrame:
    """(key, node) of the buckets that their leader may not settle."""
    keys = met.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    some = met.join(keys, "key")
    return some.select("key", "node").unionByName(some.groupBy("key").agg(F.first("leader").alias("node")))


def _at_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """text and places (array) of the texts (key, content) that places has rows of."""
    columns = [c for c in places.columns if c not in ("key", "content")]
    wanted = places.groupBy("key", "content").agg(F.collect_list(F.struct(*columns)).alias("places"))
    likely = with_likely(_keyed(docs), wanted, "content").filter("likely").drop("likely")
    return likely.join(wanted, ["key", "content"]).dropDuplicates(["key", "content"])


def _classes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root) of the paragraphs that are linked to others."""

    def sets_of(wanted: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batched(batches, "text"):
                w, nodes, packed = Words(_encoded(batch)), [], []
                for base, places in zip(w.first.tolist(), batch.column("places").to_pylist(), strict=True):
                    for p in places:
                        nodes.append(p["node"])
                        packed.append(np.unique(shingle_hashes(w.hashes[base + p["first"] : base + p["end"]])).astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], ["node", "items"])

        rep = found.join(wanted, "node").groupBy("node").agg(F.min(F.struct("key", "content", "first", "end")).alias("r"))
        texts = _at_places(docs, rep.select("r.key", "r.content", "node", "r.first", "r.end")).select("text", "places")
        return materialise(texts.mapInArrow(run, "node long, items binary"), "sets")

    met = _buckets(found)
    release(docs.sparkSession)
    places = met.select("node", "place", "end").unionByName(met.select(F.col("leader").alias("node"), F.col("there").alias("place"), F.col("until").alias("end"))).groupBy("node").agg(F.min(F.struct("place", "end")).alias("at"))

    def leaders(met: DataFrame) -> DataFrame:
        apart = ~_overlapping(F.col("place"), F.col("end"), F.col("there"), F.col("until"))
        return met.filter(apart).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()

    def allowed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(places.select(F.col("node").alias("a"), F.col("at").alias("x")), "a").join(places.select(F.col("node").alias("b"), F.col("at").alias("y")), "b")
        return both.filter(~_overlapping(F.col("x.place"), F.col("x.end"), F.col("y.place"), F.col("y.end"))).select("a", "b")

    return classes(met, sets_of, SIMILARITY, PLAIN, first_pairs=leaders, rounds=1, buckets_of=_crowded, allowed=allowed)


def _later(found: DataFrame, root: str) -> DataFrame:
    """key, content, first, end of each occurrence but the first of its class (of one root),
    and the first's as start. Occurrences that overlap the first do not count."""
    place = F.struct("key", "content", "first", "end")
    several = found.groupBy(root).agg(F.min(place).alias("start"), F.count("*").alias("n")).filter("n > 1").drop("n")
    several = materialise(several, "several")  # so that the join below can split a frequent root
    same = (F.col("key") == F.col("start.key")) & (F.col("content") == F.col("start.content"))
    return found.join(several, root).filter((place != F.col("start")) & ~(same & (F.col("first") < F.col("start.end")))).select("key", "content", "first", "end", "start")


def repeated_places(docs: DataFrame) -> DataFrame:
    """Repeats of seeds and of paragraphs, as _later() gives them, stored."""
    found = _occurrences(docs)
    release(docs.sparkSession)
    whole = found.filter(~F.col("seed")).drop("seed")
    labels = _classes(docs, whole)
    named = whole.drop("keys").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    release(docs.sparkSession)
    made = materialise(_later(named, "root"), "repeated-paragraphs")
    release(docs.sparkSession)
    from_seeds = materialise(_later(found.filter("seed").drop("keys", "seed"), "node"), "repeated-seeds")
    release(docs.sparkSession)
    return made.withColumn("seed", F.lit(False)).unionByName(from_seeds.withColumn("seed", F.lit(True)))


def runs_of(places: list[dict]) -> list[list]:
    """Runs of one text's repeats that overlap or touch: [first word, end word, places at the
    edges]. Edges: the outermost place of either kind, to the left and to the right. Paragraphs
    that are alike but not equal may be shifted against each other; seeds are not."""
    out: list[list] = []
    for p in sorted(places, key=lambda p: (p["first"], -p["end"])):
        if out and p["first"] <= out[-1][1]:
            run = out[-1]
            run[2].setdefault((True, p["seed"]), p)
            right = run[2].setdefault((False, p["seed"]), p)
            if p["end"] > right["end"]:
                run[2][False, p["seed"]] = p
            run[1] = max(run[1], p["end"])
        else:
            out.append([p["first"], p["end"], {(True, p["seed"]): p, (False, p["seed"]): p}])
    return out


def agreeing(x: bytes, y: bytes) -> int:
    """Equal words at the head of two contexts."""
    a, b = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def merged(regions: list[tuple[int, int]], min_passage: int) -> list[tuple[int, int]]:
    """Regions (first word, end word), those that overlap or touch joined. Regions at most WORDS
    words apart are one passage; passages with min_passage repeated words stay. The words
    between regions are nobody's repeats, so they are no part of what is cut."""
    whole: list[list[int]] = []
    for first, end in sorted(regions):
        if whole and first <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], end)
        else:
            whole.append([first, end])
    passages: list[list[list[int]]] = []
    for region in whole:
        if passages and region[0] <= passages[-1][-1][1] + WORDS:
            passages[-1].append(region)
        else:
            passages.append([region])
    return [(a, b) for own in passages if sum(b - a for a, b in own) >= min_passage for a, b in own]


def repeated(docs: DataFrame, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """key, content, cuts (array of first and end word, sorted) and first_keys (of the first
    documents) of each text with passages that stand earlier, stored."""
    places = repeated_places(docs)
    edge = "key long, content long, lo int, hi int, left boolean, at int, there struct<key:long,content:long,at:int>"
    kind = pa.struct([("key", pa.int64()), ("content", pa.int64()), ("at", pa.int32())])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            rows = []
            for key, content, own in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "places")), strict=True):
                for lo, hi, outermost in runs_of(own):
                    for (left, _), p in outermost.items():
                        at = "first" if left else "end"
                        rows.append((key, content, lo, hi, left, p[at], {"key": p["start"]["key"], "content": p["start"]["content"], "at": p["start"][at]}))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), kind], strict=True)], ["key", "content", "lo", "hi", "left", "at", "there"])

    by_text = places.groupBy("key", "content").agg(F.collect_list(F.struct("first", "end", "start", "seed")).alias("places"))
    ends = materialise(by_text.mapInArrow(edges, edge), "edges")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, "text"):
            w, rows = Words(_encoded(batch)), []
            for key, content, base, last, own in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist(), w.first.tolist(), w.last.tolist(), batch.column("places").to_pylist(), strict=True):
                for p in own:
                    at = base + p["at"]
                    around = w.hashes[max(base, at - CONTEXT) : at][::-1] if p["left"] else w.hashes[at : min(last, at + CONTEXT)]
                    rows.append((key, content, p["at"], p["left"], around.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()], strict=True)], ["key", "content", "at", "left", "around"])

    asked = ends.select("key", "content", "at", "left").unionByName(ends.select("there.key", "there.content", "there.at", "left")).distinct()
    around = materialise(_at_places(docs, asked).select("key", "content", "text", "places").mapInArrow(contexts, "key long, content long, at int, left boolean, around binary"), "contexts")
    release(docs.sparkSession)
    here = ends.join(around.withColumnRenamed("around", "x"), ["key", "content", "at", "left"])
    there = around.select(F.struct("key", "content", "at").alias("there"), "left", F.col("around").alias("y"))
    both = here.join(there, ["there", "left"]).select("key", "content", "lo", "hi", "left", "at", F.col("there.key").alias("first_key"), "x", "y")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            far = [agreeing(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "content", "lo", "hi", "left", "at", "first_key")), pa.array(far, pa.int32())], ["key", "content", "lo", "hi", "left", "at", "first_key", "far"])

    extended = both.mapInArrow(extend, "key long, content long, lo int, hi int, left boolean, at int, first_key long, far int")
    regions = extended.groupBy("key", "content", "lo", "hi").agg(F.min(F.when(F.col("left"), F.col("at") - F.col("far"))).alias("first"), F.max(F.when(~F.col("left"), F.col("at") + F.col("far"))).alias("end"), F.collect_set("first_key").alias("first_keys"))
    region = F.struct("first", "end", "first_keys")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            rows = []
            for key, content, own in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "regions")), strict=True):
                if cuts := merged([(r["first"], r["end"]) for r in own], min_passage):
                    keys = sorted({k for r in own if any(a <= r["first"] and r["end"] <= b for a, b in cuts) for k in r["first_keys"]})
                    rows.append((key, content, [{"first": a, "end": b} for a, b in cuts], keys))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["key", "content", "cuts", "first_keys"])

    by_text = regions.groupBy("key", "content").agg(F.collect_list(region).alias("regions"))
    return materialise(by_text.mapInArrow(finish, "key long, content long, cuts array<struct<first:int,end:int>>, first_keys array<long>"), "repeated")


def cut_words(text: str, cuts: list) -> str:
    """text without the words of cuts, each with what follows it up to the next word."""
    data = text.encode()
    array, _ = join([data])
    starts, _ = word_spans(array)
    starts = np.append(starts, len(data))
    kept, at = [], 0
    for cut in cuts:
        lo, hi = int(starts[cut["first"]]), int(starts[cut["end"]])
        if lo > at:
            kept.append(data[at:lo])
        at = max(at, hi)
    kept.append(data[at:])
    return b"".join(kept).decode()


def clean(docs: DataFrame, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """The rows of docs, all columns, with repeated passages taken out of text and n_chars,
    where docs has it, brought up to date. Texts that lose all their words go."""
    cuts = repeated(docs, min_passage).drop("first_keys")
    release(docs.sparkSession)

    @F.arrow_udf("string")
    def apply(text: pa.Array, places: pa.Array) -> pa.Array:
        return pa.array([cut_words(t or "", p) for t, p in zip(text.to_pylist(), places.to_pylist(), strict=True)], pa.string())

    # the user's columns travel in one struct, so that no name clashes
    keyed = with_likely(docs.select(_doc_key().alias("key"), _content().alias("content"), F.struct("*").alias("row")), cuts, "content")
    same = keyed.filter("not likely").select("row")
    met = keyed.filter("likely").join(cuts, ["key", "content"], "left")
    same = same.unionByName(met.filter("cuts is null").select("row"))
    row = lambda c: F.col(f"row.`{c}`")
    cut = met.filter("cuts is not null").select("row", apply("row.text", "cuts").alias("text")).filter(F.regexp_like("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10ffff}]")))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return same.select([row(c).alias(c) for c in docs.columns]).unionByName(cut.select([(new[c] if c in new else row(c)).alias(c) for c in docs.columns]))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with a passage that stands elsewhere too: doc_id, the passages
    that are removed from it, how many others have one that stands first here, and the
    documents in which its passages first stand."""
    found = repeated(table(spark, sf_dir, "documents"))
    own = found.select("key", F.size("cuts").alias("n_removed"), F.lit(0).alias("n_first"), "first_keys")
    first = found.select(F.explode("first_keys").alias("key")).groupBy("key").agg(F.count("*").alias("n_first")).select("key", F.lit(0).alias("n_removed"), "n_first", F.array("key").alias("first_keys"))
    number = lambda c: F.when(c != -(2**63), c)
    return own.unionByName(first).groupBy(number(F.col("key")).alias("doc_id")).agg(
        F.sum("n_removed").alias("n_removed"), F.sum("n_first").alias("n_first"), F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_keys")))), number).alias("first_docs")
    )
