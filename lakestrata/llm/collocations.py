"""Operator 13: phrases whose words stand together more often than chance has it, from an
FM-index for each shard of the corpus.

A shard holds the words of one language, about SHARD of them, as numbers of its own
vocabulary; 0 stands between pieces. Its index is bidirectional: the words before the
places of the text in sorted order (a Burrows-Wheeler transform, sorted by DEPTH words, as
far as phrases go), and the same of the reversed text. The places of a phrase are an
interval of both. All intervals of a level are extended at once by a word to the left or to
the right, which gives their counts and their numbers of extensions.

Counts are summed across shards, level by level. Shards are told which of their words, and
then which of their pairs, are frequent in the whole corpus: only those can be part of a
longer frequent phrase, so nothing that counts is left out.

Defined results. Null text: no words. Null lang: "und". Repeated rows count each time.
A text of any length is cut into shards that overlap by DEPTH - 1 words, whose phrases are
counted once. Ties in score and a go to the phrase that is smaller by UTF-8 bytes. Empty
table: no rows. Columns other than lang and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batched, light_batches, materialise, partitions, release, table, trim

DEPTH = 3
SHARD = 1 << 20
#: Shards' worth of words that a task gathers, of all languages, before the fullest goes out.
GATHERED = 4
#: Bytes of text that are split into words at once.
STEP = 1 << 20
#: Places of phrases that are extended at once (or those of one phrase), and rows that a task
#: returns at once.
PLACES, RETURNED = 1 << 17, 1 << 15
MIN_COUNT = 10
TOP = 2000
_BITS = 21
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
SHARDS = "shard long, lang string, words array<string>, counts array<long>, ids binary, known int"


class Vocabulary(dict):
    """Number of each word, given out as they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


@dataclass
class Gathered:
    """The words of a shard so far; the first `known` of them are counted by another one."""

    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    parts: list[np.ndarray] = field(default_factory=list)
    size: int = 0
    known: int = 0

    def add(self, words: list[bytes]) -> None:
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words))
        self.parts.append(ids[ids >= 0])
        self.size += len(self.parts[-1])


def _cut(data: bytes) -> Iterator[list[bytes]]:
    """Words and ends of pieces of a text, about STEP bytes at a time."""
    data, at = data.translate(_LOWER).replace(b"\n", b" \n "), 0
    while at < len(data):
        end = data.find(b" ", at + STEP)
        end = len(data) if end < 0 else end
        yield data[at:end].split(b" ")
        at = end


def shards(docs: DataFrame, shard_words: int = SHARD) -> DataFrame:
    """The shards of docs, of about shard_words words; see SHARDS. counts are those of words,
    ids 32-bit numbers from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ones: dict[str, Gathered] = {}
        number = TaskContext.get().partitionId() << 32

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal number
            g = open_ones.pop(lang)
            ids = np.concatenate(g.parts)
            counts = np.bincount(ids[g.known :], minlength=len(g.vocabulary) - 1)[1:]
            words = pa.array([w.decode() for w in list(g.vocabulary)[2:]], pa.string())
            number += 1
            if ids[-1]:  # the text goes on: the next shard begins with the words that phrases may start with
                back = {i: w for w, i in g.vocabulary.items()}
                tail = ids[-(DEPTH - 1) :].tolist()
                tail = tail[tail.index(0) + 1 :] if 0 in tail else tail
                open_ones[lang] = following = Gathered()
                following.add([back[i] for i in tail])
                following.known = following.size
            columns = [pa.array([number - 1], pa.int64()), pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([counts], pa.list_(pa.int64())), pa.array([ids.tobytes()], pa.binary()), pa.array([g.known], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "lang", "words", "counts", "ids", "known"])

        for batch in batched(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for words in _cut(text):
                    open_ones.setdefault(lang, Gathered()).add(words)
                    if open_ones[lang].size >= shard_words:
                        yield closed(lang)
                if lang in open_ones:
                    open_ones[lang].add([b"\n"])
                if sum(g.size for g in open_ones.values()) > GATHERED * shard_words:
                    yield closed(max(open_ones, key=lambda x: open_ones[x].size))
        while open_ones:
            yield closed(next(iter(open_ones)))

    known = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return known.mapInArrow(run, SHARDS)


# --- the index of a shard -------------------------------------------------------------------
@dataclass
class Side:
    """One direction: before[i] is the word before the i-th place in sorted order, and
    goes_to[i] the place in that order of the suffix which begins with it."""

    starts: np.ndarray
    before: np.ndarray
    goes_to: np.ndarray


def _side(ids: np.ndarray) -> Side:
    padded = np.concatenate([ids, np.zeros(DEPTH - 1, np.int32)])
    key = np.zeros(len(ids), np.int64)
    for i in range(DEPTH):
        key <<= _BITS
        key |= padded[i : i + len(ids)]
    order = np.argsort(key, kind="stable").astype(np.int32)
    del key
    before = np.where(order > 0, ids[order - 1], np.int32(0))
    goes_to = np.empty(len(ids), np.int32)
    goes_to[np.argsort(before, kind="stable")] = np.arange(len(ids), dtype=np.int32)
    return Side(np.concatenate([[0], np.cumsum(np.bincount(ids))]), before, goes_to)


@dataclass
class Level:
    """Phrases of one length: their words, and where their intervals start on both sides."""

    words: np.ndarray
    at: dict[bool, np.ndarray]
    counts: np.ndarray

    def take(self, which: np.ndarray | slice) -> Level:
        return Level(self.words[which], {s: a[which] for s, a in self.at.items()}, self.counts[which])


class Index:
    """The bidirectional index of word numbers; phrases hold no 0. Only phrases of up to
    DEPTH words have intervals. side True is the text, False the reversed text."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.concatenate([[0], ids, [0]]).astype(np.int32)
        self.sides: dict[bool, Side] = {}

    def side(self, forward: bool) -> Side:
        if forward not in self.sides:
            self.sides[forward] = _side(self.ids if forward else self.ids[::-1])
        return self.sides[forward]

    def words(self) -> Level:
        counts = np.bincount(self.ids)
        found = np.flatnonzero(counts)
        found = found[found > 0]
        at = (np.cumsum(counts) - counts)[found]  # the same on both sides
        return Level(found[:, None].astype(np.int32), {True: at, False: at}, counts[found])

    def extended(self, level: Level, left: bool = True) -> tuple[Level, np.ndarray]:
        """All phrases of a level with one word more, and the phrase each comes from. Phrases go
        in slices of about PLACES places, as many as a level has would take several times the
        memory of the index."""
        ends, at, made = np.cumsum(level.counts), 0, []
        while at < len(ends) or not made:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, "right")))
            found, own = self._extended(level.take(slice(at, end)), left)
            made.append((found, own + at))
            at = end
        levels, own = zip(*made, strict=True)
        joined = lambda of: np.concatenate([of(x) for x in levels])
        return Level(joined(lambda x: x.words), {s: joined(lambda x, s=s: x.at[s]) for s in (True, False)}, joined(lambda x: x.counts)), np.concatenate(own)

    def _extended(self, level: Level, left: bool) -> tuple[Level, np.ndarray]:
        side, starts = self.side(left), level.at[left]
        total = int(level.counts.sum())
        parent = np.repeat(np.arange(len(starts)), level.counts)
        places = np.arange(total) - np.repeat(np.cumsum(level.counts) - level.counts, level.counts) + starts[parent]
        order = np.argsort(parent << _BITS | side.before[places], kind="stable")
        parent, places = parent[order], places[order]
        word = side.before[places]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(parent) != 0) | (np.diff(word) != 0)])) if total else np.empty(0, np.int64)
        counts = np.diff(np.append(first, total))
        own, more = parent[first], word[first]
        # on the other side a phrase's interval is cut by the word that follows there
        within = first - (np.cumsum(level.counts) - level.counts)[own]
        at = {left: side.goes_to[places[first]], not left: level.at[not left][own] + within}
        words = level.words[own]
        words = np.column_stack([more, words] if left else [words, more])
        return Level(words, at, counts).take(real := more > 0), own[real]

    def extensions(self, level: Level, left: bool) -> np.ndarray:
        """How many words stand to a side of each phrase of a level."""
        return np.bincount(self.extended(level, left)[1], minlength=len(level.counts))


def _numbered(shard: pa.Table, words: pa.Table) -> tuple[Index, np.ndarray, int]:
    """Index of a shard over its frequent words, their corpus numbers, and the words at its
    head that another shard counts; words that are not frequent end a piece."""
    local, numbers = words["local"].to_numpy(), words["w1"].to_numpy()
    order = np.argsort(local)
    new = np.zeros(shard["w1"][0].as_py() + 1, np.int32)
    new[local[order]] = np.arange(1, len(local) + 1)
    return Index(new[np.frombuffer(shard["ids"][0].as_buffer(), np.int32)]), np.concatenate([[0], numbers[order]]), shard["w2"][0].as_py()


def _pairs(shard: pa.Table, words: pa.Table, _: pa.Table) -> pa.Table:
    index, numbers, known = _numbered(shard, words)
    level, _ = index.extended(index.words())
    pairs, counts = level.words, level.counts
    if known == DEPTH - 1 and index.ids[1 : known + 1].all():
        pairs, counts = np.vstack([pairs, index.ids[None, 1 : known + 1]]), np.append(counts, -1)
    return pa.table({"shard": pa.array(np.full(len(pairs), shard["shard"][0].as_py())), "w1": pa.array(numbers[pairs[:, 0]]), "w2": pa.array(numbers[pairs[:, 1]]), "n": pa.array(counts)})


def _triples(shard: pa.Table, words: pa.Table, pairs: pa.Table) -> pa.Table:
    index, numbers, _ = _numbered(shard, words)
    order = np.argsort(numbers)
    place = lambda c: order[np.searchsorted(numbers, pairs[c].to_numpy(), sorter=order)]
    packed = lambda first, second: first.astype(np.int64) << _BITS | second
    frequent = np.append(np.sort(packed(place("w1"), place("w2"))), -1)

    def among(words: np.ndarray) -> np.ndarray:
        pair = packed(words[:, 0], words[:, 1])
        return frequent[np.searchsorted(frequent[:-1], pair)] == pair

    level, _ = index.extended(index.words())
    level = level.take(among(level.words))
    more, _ = index.extended(level, left=False)
    more = more.take(among(more.words[:, 1:]))
    return pa.table({**{f"w{i + 1}": pa.array(numbers[more.words[:, i]]) for i in range(3)}, "n": pa.array(more.counts)})


def _by_shard(texts: DataFrame, told: DataFrame, tasks: int, fn: Callable[[pa.Table, pa.Table, pa.Table], pa.Table], shape: str) -> DataFrame:
    """fn of each shard that has frequent words: its row of texts, and its rows of told, first
    the words, then the pairs. Shards are dealt to tasks by number, as many to each, and rows
    reach a task sorted by shard: it holds one shard at a time."""

    def done(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(pieces)
        n = whole.num_rows - whole["local"].null_count
        if n:
            yield from fn(whole.slice(0, 1), whole.slice(1, n), whole.slice(n + 1)).to_batches(max_chunksize=RETURNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[pa.RecordBatch] = []
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]):
                if pieces and pieces[0].column("shard")[0].as_py() != shards[a]:
                    yield from done(pieces)
                    pieces = []
                pieces.append(batch.slice(a, b - a))
        if pieces:
            yield from done(pieces)
        del pieces
        trim()

    parts = partitions(texts.sparkSession)
    both = texts.withColumn("local", F.lit(None).cast("int")).unionByName(told.withColumn("ids", F.lit(None).cast("binary")))
    number = F.shiftright("shard", 32) + F.col("shard").bitwiseAND(F.lit((1 << 32) - 1)) * F.lit(tasks)
    dealt = both.repartitionById(parts, F.pmod(number, F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("shard", F.isnull("ids"), F.isnull("local")).mapInArrow(run, shape)


# --- the corpus -----------------------------------------------------------------------------
def phrases(docs: DataFrame, min_count: int = MIN_COUNT, shard_words: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(totals, words, pairs, triples), stored: words of each lang, and all words and phrases
    of at least min_count occurrences by corpus numbers of words, with their counts."""

    def stored(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
        """materialise, and let go of the step's shuffle files and of what its executors hold."""
        kept = materialise(df, name, large_rows)
        release(kept.sparkSession)
        return kept

    light_batches(docs.sparkSession)
    made = stored(shards(docs, shard_words), "shards", large_rows=True)
    totals = made.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("total"))
    own = made.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w")).select("shard", "lang", (F.col("local") + 1).alias("local"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"), (F.monotonically_increasing_id() + 1).alias("id"))
    # a word meets itself in all shards once, which gives its count and its number
    same = Window.partitionBy("lang", "word")
    local = own.withColumns({"a": F.sum("n").over(same), "number": F.min("id").over(same)}).filter(F.col("a") >= min_count)
    local = stored(local.select("shard", "local", "number", "lang", "word", "a"), "local-words")
    words = materialise(local.groupBy("lang", "word", "number").agg(F.max("a").alias("n")), "words")

    tasks = (made.agg(F.max(F.shiftright("shard", 32))).first()[0] or 0) + 1
    texts = made.select("shard", F.size("words").cast("long").alias("w1"), F.col("known").cast("long").alias("w2"), "ids")
    numbers = local.select("shard", "local", F.col("number").alias("w1"), F.lit(None).cast("long").alias("w2"))
    in_shards = _by_shard(texts, numbers, tasks, _pairs, "shard long, w1 long, w2 long, n long")
    in_shards = in_shards.withColumn("a", F.sum("n").over(Window.partitionBy("w1", "w2"))).filter((F.col("a") >= min_count) & (F.col("n") > 0))
    frequent = stored(in_shards.select("shard", "w1", "w2", "a"), "shard-pairs")
    pairs = stored(frequent.groupBy("w1", "w2").agg(F.max("a").alias("n")), "pairs")
    # words and pairs of a shard: a pair has no local number
    told = numbers.unionByName(frequent.select("shard", F.lit(None).cast("int").alias("local"), "w1", "w2"))
    per_shard = _by_shard(texts, told, tasks, _triples, "w1 long, w2 long, w3 long, n long")
    # dealt before they are summed: in a task hardly a triple comes twice, and its sums would take memory
    per_shard = per_shard.repartition("w1", "w2", "w3")
    found = stored(per_shard.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), "triples")
    return totals, words, pairs, found


def _score(a, left, right):
    """floor(1000000 a a / (l r)) in 38 digits: exact for counts below 10^15."""
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, inside_percent: int = 50, shard_words: int = SHARD) -> DataFrame:
    """Each lang's first phrases of 2 to DEPTH words by score: lang, rank, phrase, a (its
    count), l and r (counts of the parts of its lowest-scoring cut), n (words of the lang),
    score. Left out are phrases inside a longer one with inside_percent of their count."""
    totals, words, pairs, triples = phrases(docs, min_count, shard_words)
    count = lambda df, columns, name: df.select(*[F.col(w).alias(c) for w, c in columns.items()], F.col("n").alias(name))
    word = lambda c, name: count(words, {"number": c}, name)
    two = pairs.withColumnRenamed("n", "a").join(word("w1", "l"), "w1").join(word("w2", "r"), "w2").withColumn("score", _score("a", "l", "r"))
    longer = triples.select("n", F.explode(F.array(F.struct(F.col("w1").alias("x"), F.col("w2").alias("y")), F.struct(F.col("w2").alias("x"), F.col("w3").alias("y")))).alias("p"))
    longer = longer.groupBy(F.col("p.x").alias("w1"), F.col("p.y").alias("w2")).agg(F.max("n").alias("_longer"))
    kept = two.join(longer, ["w1", "w2"], "left").filter(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * inside_percent))

    three = triples.withColumnRenamed("n", "a")
    three = three.join(word("w1", "l1"), "w1").join(word("w3", "r2"), "w3")
    three = three.join(count(pairs, {"w1": "w2", "w2": "w3"}, "r1"), ["w2", "w3"]).join(count(pairs, {"w1": "w1", "w2": "w2"}, "l2"), ["w1", "w2"])
    cut = lambda k: F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    three = three.withColumn("cut", F.least(cut(1), cut(2))).select("w1", "w2", "w3", "a", "cut.l", "cut.r", "cut.score")

    found = kept.select("w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l", "r", "score").unionByName(three)
    name = lambda c: words.select(F.col("number").alias(c), *([F.col("lang")] if c == "w1" else []), F.col("word").alias(f"{c}_text"))
    found = found.join(name("w1"), "w1").join(name("w2"), "w2").join(name("w3"), "w3", "left")
    found = found.select("lang", F.concat_ws(" ", "w1_text", "w2_text", "w3_text").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    # the first of every part of a lang, then of those: no task sorts a lang
    parts = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    best = parts.withColumn("rank", first(["lang", "_part"])).filter(F.col("rank") <= top).drop("rank", "_part")
    ranked = best.withColumn("rank", first(["lang"])).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_sql(min_count: int = MIN_COUNT, top: int = TOP) -> str:
    pieces = r"regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')"
    part = lambda a, b: f"array_to_string(w[{a}:{b}], ' ')"
    return rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest({pieces}) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
g AS (SELECT lang, k, ws[i : i + k - 1] AS w FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) t(k))),
f AS (SELECT lang, k, w, array_to_string(w, ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {min_count}),
n AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
cuts AS (SELECT lang, w, phrase, k, a, c, {part(1, 'c')} AS x, {part('c + 1', 'k')} AS y FROM f, (VALUES (1), (2)) t(c) WHERE c < k),
s AS (SELECT cuts.*, p.a AS l, q.a AS r, CAST(CAST(1000000 AS HUGEINT) * cuts.a * cuts.a // (CAST(p.a AS HUGEINT) * q.a) AS BIGINT) AS score FROM cuts
  JOIN f p ON p.lang = cuts.lang AND p.phrase = x AND p.k = c JOIN f q ON q.lang = cuts.lang AND q.phrase = y AND q.k = cuts.k - c),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, c) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, {part(1, 2)} AS phrase, a FROM f WHERE k = 3 UNION ALL SELECT lang, {part(2, 3)}, a FROM f WHERE k = 3) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inside i ON i.lang = low.lang AND i.phrase = low.phrase AND low.k = 2 WHERE i.longer IS NULL OR 100 * i.longer < 50 * low.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= {top}"""
