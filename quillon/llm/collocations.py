"""Phrase collocation mining on vertical positional inverted lists.

Texts are cut into pieces and those into words. A task numbers the words of its
texts one after another, with a free place between pieces and between texts, and
writes blocks of some BLOCK places: for each (language, word) of the block the
ascending list of its places. A list's length is the word's exact frequency there;
sums over blocks tell which words are frequent everywhere.

Each further level extends the frequent phrases of every block: their lists are
merged by place with the lists of the frequent words, one place after the phrase's
end, and what meets is a list of the longer phrase, if all its words but the first are a
frequent phrase, too. A phrase is the number of its beginning and that of its last word,
so only numbers go to the sums; a block gets back which of its phrases are frequent,
never a dictionary of the corpus, and phrases are spelled out once they are known. So nothing is broadcast, a frequent phrase is one row a
block, and a task holds one block at a time. The last places of a block are also the first of
the next, where the text goes on: they end phrases and begin none.

Scores: every cut of a candidate into two parts compares its frequency with theirs,
exactly, in decimals. A candidate is dropped where a longer one that holds its words
takes SHARE percent of its occurrences or more.

Defined cases: a null text is an empty one; a null language is `und`; texts without
words count nothing; a language without candidates has no rows; ties are told apart
by phrase; repeated rows count as often as they are there; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exact_dedup import UPPER
from .shared import documents, small_batches, written

#: Fixed values.
LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words
SHARE = 80
TOP = 2000
SCALE = 2_000_000

BLOCK = 6_000_000  # places of a block, about
NUMBER = 24  # bits of a phrase's number within its block, which has fewer places
SEQUENCE = 14  # bits of a block's number within its task
PART = 1 << 20  # bytes of a text that are split at once
ROWS = 1 << 16  # of an Arrow batch that a task hands out
SALTS = 64
BREAK = b"\xff"  # no byte of UTF-8
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(UPPER.encode() + SEPARATORS + b"\t", UPPER.lower().encode() + BREAK * len(SEPARATORS) + b" ")
GAP = re.compile(rb"[ \xff]")


def tokens(text: str, part: int = PART) -> Iterator[list[bytes]]:
    """Words, and BREAK between pieces, some at a time."""
    raw, at = text.encode().translate(FOLD), 0
    while at < len(raw):
        cut = GAP.search(raw, at + part)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].replace(BREAK, b" \xff ").split()
        at = end


def packed(ascending: np.ndarray) -> bytes:
    """Lists of places one after another, as compressed differences."""
    steps = np.diff(ascending.astype(np.int32), prepend=np.int32(0)).astype("<i4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel(), dtype=np.int32)


class Block:
    """Words in the order of their places; code 0 is a free place."""

    def __init__(self) -> None:
        self.codes, self.names = array("i"), [("", BREAK)]
        self.ids: dict[str, dict[bytes, int]] = {}

    def add(self, lang: str, words: list[bytes]) -> None:
        ids = self.ids.setdefault(lang, {BREAK: 0})
        for w in dict.fromkeys(words):
            if w not in ids:
                ids[w] = len(self.names)
                self.names.append((lang, w))
        self.codes.extend(map(ids.__getitem__, words))

    def lists(self, number: int, own: int) -> pa.RecordBatch:
        codes = np.frombuffer(self.codes, np.int32)
        size, order = np.bincount(codes, minlength=len(self.names)), np.argsort(codes, kind="stable")
        count = np.bincount(codes[:own], minlength=len(self.names))
        row = [[number], [own], [[n for n, _ in self.names[1:]]], [[w.decode() for _, w in self.names[1:]]], [size[1:].astype(np.int32)], [count[1:].astype(np.int32)], [packed(order[size[0] :])]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, ARROW)], COLUMNS)


COLUMNS = ["block", "own", "langs", "words", "sizes", "counts", "places"]
ARROW = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]


def _blocks(batches: Iterator[pa.RecordBatch], places: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) as blocks of inverted lists."""
    number, block = TaskContext.get().partitionId() << SEQUENCE, Block()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for words in tokens(text, min(PART, 8 * places)):
                block.add(lang, words)
                if len(block.codes) >= places:
                    own = len(block.codes) - (LONGEST - 1)
                    guests = [block.names[code] for code in block.codes[own:]]  # there, and the first places of the next
                    yield block.lists(number, own)
                    number, block = number + 1, Block()
                    for owner, word in guests:
                        block.add(owner, [word])
            block.add(lang, [BREAK])
    if len(block.names) > 1:
        yield block.lists(number, len(block.codes))


def postings(df: DataFrame, text_col: str = "text", lang_col: str = "lang", places: int = BLOCK) -> DataFrame:
    """Blocks of inverted lists of some `places` each, written. Words that stand only at places of the next block have count 0."""
    small_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    schema = "block long, own long, langs array<string>, words array<string>, sizes array<int>, counts array<int>, places binary"
    return written(rows.mapInArrow(lambda batches: _blocks(batches, places), schema), "phrase_postings")


def meeting(ascending: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges two ascending lists: which wanted ones are there, and where those are."""
    at = np.searchsorted(ascending, wanted)
    at[at == len(ascending)] = 0
    meets = ascending[at] == wanted if len(ascending) else np.zeros(len(wanted), bool)
    return meets, at[meets]


def extended(own: int, sizes: np.ndarray, places: np.ndarray, levels: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: (number of the beginning, number of the last word, list length) of phrases one word longer than the longest known ones, ascending.

    levels: the codes of the block's frequent words and their numbers, then the places that the
    block's frequent longer phrases had in what this function returned for them, and their numbers.
    """
    order = np.argsort(levels[0][1])
    numbers = word_numbers = levels[0][1][order]
    local = np.zeros(len(sizes) + 1, np.int32)
    local[levels[0][0][order]] = np.arange(1, len(order) + 1)
    word = np.repeat(local[1:], sizes)
    place, word = places[word > 0], word[word > 0]
    order = np.argsort(place, kind="stable")
    place, word = place[order], word[order].astype(np.int64) - 1  # the frequent words' lists, merged
    start, phrase = place, word
    for level in range(1, len(levels) + 1):
        if level > 1:  # all words but the first are a frequent phrase, too
            ends = meeting(start, start + 1)[0]
            start, phrase = start[ends], phrase[ends]
        meets, at = meeting(place, start + level)
        start, key = start[meets], phrase[meets] << 32 | word[at]
        if level < len(levels):
            order = np.argsort(levels[level][0])
            known, numbers = np.unique(key)[levels[level][0][order]], levels[level][1][order]
            meets, phrase = meeting(known, key)
            start = start[meets]
    keys, n = np.unique(key, return_counts=True)
    np.subtract.at(n, np.searchsorted(keys, key[start >= own]), 1)
    return numbers[keys >> 32], word_numbers[keys & 0xFFFFFFFF], n


def _extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            block, own, sizes, places, *lists = (batch.column(c)[i] for c in range(batch.num_columns))
            lists = [x.values.to_numpy(zero_copy_only=False) for x in lists]
            made = extended(own.as_py(), sizes.values.to_numpy(zero_copy_only=False), unpacked(places.as_py()), list(zip(lists[::2], lists[1::2])))
            for at in range(0, len(made[0]), ROWS):
                some = [pa.array(x[at : at + ROWS]) for x in made]
                own_numbers = pa.array((block.as_py() << NUMBER) + np.arange(at, at + len(some[0])))
                yield pa.RecordBatch.from_arrays([some[0], some[1], own_numbers, some[2]], ["beginning", "last", "at", "n"])


def frequent_of(lengths: DataFrame, by: list[str], level: int, least: int) -> DataFrame:
    """lengths: by, at, n. Those of phrases with `least` occurrences or more in all blocks, with their sum f and the phrase's number.

    A phrase has a row for each block at most, so none is large; its number is the least `at`.
    """
    phrase = Window.partitionBy(*by)
    rows = lengths.withColumns({"f": F.sum("n").over(phrase), "number": F.min("at").over(phrase)}).where(F.col("f") >= least)
    return written(rows.select(*by, "at", "number", "f"), f"phrases_{level}")


def mined(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, places: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all frequent phrases up to `longest` words, and (lang, n)."""
    blocks = postings(df, text_col, lang_col, places)
    totals = blocks.select(F.explode(F.arrays_zip("langs", "counts")).alias("e")).groupBy(F.col("e.langs").alias("lang")).agg(F.sum("e.counts").alias("n"))
    entries = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("i", "e"))
    at = F.shiftleft("block", NUMBER) + F.col("i") + 1
    entries = entries.select(F.col("e.langs").alias("lang"), F.col("e.words").alias("phrase"), at.alias("at"), F.col("e.counts").cast("long").alias("n"))
    found = frequent_of(entries, ["lang", "phrase"], 1, least)
    block = F.shiftright("at", NUMBER).alias("block")
    code = F.col("at").bitwiseAND((1 << NUMBER) - 1).cast("int")

    def known(level: int) -> DataFrame:
        """By block, two lists in one order: its frequent phrases and their numbers."""
        return found.groupBy(block).agg(F.collect_list(code).alias(f"codes_{level}"), F.collect_list("number").alias(f"numbers_{level}"))

    rows = blocks.select("block", "own", "sizes", "places").join(known(1), "block")
    words = found.where("at = number").select("number", "lang", "phrase", "f")
    levels = [words]
    for level in range(2, longest + 1):
        found = frequent_of(rows.mapInArrow(_extensions, "beginning long, last long, at long, n long"), ["beginning", "last"], level, least)
        if level < longest:
            rows = rows.join(known(level), "block")
        named = found.where("at = number").join(levels[-1].select(F.col("number").alias("beginning"), "lang", F.col("phrase").alias("head")), "beginning")
        named = named.join(words.select(F.col("number").alias("last"), F.col("phrase").alias("tail")), "last")
        levels.append(written(named.select("number", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "f"), f"phrases_named_{level}"))
    all_ = [p.select("lang", "phrase", F.lit(k).alias("words"), "f") for k, p in enumerate(levels, 1)]
    return written(reduce(DataFrame.unionByName, all_), "phrases"), totals


def _part(first: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), F.lit(first) if isinstance(first, int) else first, length), " ")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, places: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    frequent, totals = mined(df, text_col, lang_col, least, longest, places)
    longer = frequent.where("words > 1")
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    known = frequent.select("lang", "phrase", "f")
    cuts = cuts.join(known.withColumnsRenamed({"phrase": "first", "f": "l"}), ["lang", "first"]).join(known.withColumnsRenamed({"phrase": "rest", "f": "r"}), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(8, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = frequent.where("words > 2").select("lang", "phrase", "f", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "phrase", "f", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * F.col("within") < share * F.col("a")))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))  # the best of each salt, then the best of those
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return left.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


QUERIES = {"op13_collocations": op13_collocations}
_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS words, array_to_string(list_slice(ws, i, i + {k - 1}), ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k} + 2)) AS i FROM w)" for k in range(1, LONGEST + 1))
ORACLE_SQL = {
    "op13_collocations": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[ \\t]+') IF x <> ''] AS ws FROM p),
g AS ({_GRAMS}),
f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a FROM f WHERE words > 1 AND f >= {LEAST}),
k AS (SELECT lang, phrase, a, words, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS ws FROM c),
s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, CAST((CAST({SCALE} AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score FROM k
 JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(list_slice(ws, 1, k), ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(list_slice(ws, k + 1, k.words), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND c.words > len(string_split(b.phrase, ' ')) AND 100 * c.a >= {SHARE} * b.a)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN t ON t.lang = r.lang WHERE rank <= {TOP}
"""
}
