"""SimHash near-dedup by a binary trie self-join.

Fingerprints are made of a text's 3-word shingles; equal ones are one node. Two
nodes link when at most two of their 64 bits differ. The distinct fingerprints
form a binary trie of 64 levels, and pairs of its nodes go down together from
(root, root): each step pairs the children, adds the bits in which they differ,
and drops a pair once it has more than two.

The top of the walk is done on tables of trie nodes and their sizes, STEP levels
at a time. A pair of nodes that hold at most MOST fingerprints goes to one task,
which walks on in arrays, depth first and WIDE pairs at a time; larger ones go
deeper, so hot regions of the trie are split until they are small, and copies
never meet as rows. A fingerprint is sent to the pairs of its node: some d*d/4 at
depth d, and d grows with the logarithm of the number of fingerprints.

Links become components by alternating large and small stars: minima are taken
with partial aggregates and joined back, so a hub is never gathered in one task,
and each round is cut by checkpoint() in the shared folder. Rounds go on until
nothing changes.

Defined cases: a null text is an empty one; texts without words have fingerprint
zero and link like others; fewer than three words are one shingle; a row without
doc_id belongs to its component but can't name it (null if no row there has one);
repeated rows are in one component; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents, small_batches, written

SEED = 42
SHINGLE = 3
BUDGET = 2
CHUNK = 1 << 15  # shingles whose bits are counted at once
STEP = 3  # levels of the trie that the walk over tables goes down at once
MOST = 1 << 13  # fingerprints below a pair of nodes that one task takes
WIDE = 1 << 17  # pairs of nodes that a task holds at one level
PART = 1 << 20  # bytes of a text that are split into words at once
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def hashes(text: str | None) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, part by part; the last words of a part begin the next."""
    raw, at, words, any_ = (text or "").encode().lower(), 0, [], False  # bytes: A-Z only
    digest = xxhash.xxh64_intdigest
    while at < len(raw):
        cut = BLANK.search(raw, at + PART)
        end = cut.start() if cut else len(raw)
        words += raw[at:end].split()  # ASCII white space only
        if len(words) >= SHINGLE:
            any_ = True
            yield np.array([digest(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(SHINGLE)))], dtype="<u8")
            words = words[1 - SHINGLE :]
        at = end
    if words and not any_:
        yield np.array([digest(b" ".join(words), SEED)], dtype="<u8")


def simhash(text: str | None) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for part in hashes(text):
        n += len(part)
        for at in range(0, len(part), CHUNK):
            ones += np.unpackbits(part[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0]) if n else 0


@F.pandas_udf(T.LongType())
def simhash_column(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def walk(fps: np.ndarray, roots: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of linked fingerprints below pairs of trie nodes, in parts.

    A node is a range of fps (unsigned, ascending within it) that agree above level.
    roots: rows (from, to, from, to, bits that differ so far); both nodes of a pair are
    the same one or apart. Fingerprints alone in their nodes are compared at once.
    """
    ones: dict[int, np.ndarray] = {}
    stack = [(level, roots)]
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > WIDE:
            stack += [(level, pairs[at : at + WIDE]) for at in range(0, len(pairs), WIDE)]
            continue
        a, a_end, b, b_end, spent = pairs.T
        alone = (a_end - a == 1) & (b_end - b == 1)
        apart = alone & (a != b)
        i, j = a[apart], b[apart]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= BUDGET
        if near.any():
            yield i[near], j[near]
        if alone.all():
            continue
        a, a_end, b, b_end, spent = pairs[~alone].T
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((fps >> np.uint64(level)) & np.uint64(1), dtype=np.int64)])
        n = ones[level]
        a_mid, b_mid = a_end - (n[a_end] - n[a]), b_end - (n[b_end] - n[b])  # zeros come before ones
        below = [
            (a, a_mid, b, b_mid, spent),
            (a_mid, a_end, b_mid, b_end, spent),
            (a, a_mid, b_mid, b_end, spent + 1),
            (a_mid, a_end, b, b_mid, spent + 1 + BUDGET * (a == b)),  # the other order of a node with itself
        ]
        children = np.concatenate([np.stack(x, axis=1) for x in below])
        children = children[(children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 4] <= BUDGET)]
        if len(children):
            stack.append((level - 1, children))


def stars(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Instead of all links, each node's link to the least node of its component."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[left], least[right])
        new = least.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    nodes = np.flatnonzero(least != np.arange(n))
    return nodes, least[nodes]


def _walk_deals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, a, b, fp) sorted by the first three: for each pair of trie nodes the links below it, as stars."""
    held: list[np.ndarray] = []
    size = 0

    def links(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        depths = rows[0]
        for depth in np.unique(depths):
            own = depths == depth
            a, b, fp = rows[1][own], rows[2][own], rows[3][own].view(np.uint64)
            order = np.lexsort((fp, b, a))
            a, b, fp = a[order], b[order], fp[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            last = np.r_[first[1:], len(fp)]
            code = (fp >> np.uint64(64 - depth) if depth else fp * np.uint64(0)).astype(np.int64) | (1 << int(depth))
            middle = first + np.add.reduceat((code == a).astype(np.int64), first)  # rows of node a come first
            same = a[first] == b[first]
            roots = np.stack([first, np.where(same, last, middle), np.where(same, first, middle), last, np.bitwise_count((a ^ b)[first])], axis=1)
            least = np.arange(len(fp))
            for i, j in walk(fp, roots[(roots[:, 0] < roots[:, 1]) & (roots[:, 2] < roots[:, 3])], 63 - int(depth)):
                i, j = least[i], least[j]
                new = i != j
                nodes, roots_ = stars(len(fp), i[new], j[new])
                to = np.arange(len(fp))
                to[nodes] = roots_
                least = to[least]
            nodes = np.flatnonzero(least != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[nodes].view(np.int64)), pa.array(fp[least[nodes]].view(np.int64))], ["u", "v"])

    for batch in batches:
        if not len(batch):
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        held = [np.concatenate(x) for x in zip(held, rows)] if held else rows
        size = len(held[0])
        if size < 4 * MOST:
            continue
        other = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
        cut = other[-1] + 1 if len(other) else 0  # the last pair may go on in the next batch
        if cut:
            yield from links([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held and len(held[0]):
        yield from links(held)


def trie_node(depth: int, fp: str = "fp") -> Column:
    """The node above a fingerprint: a one and its first bits."""
    return F.shiftrightunsigned(fp, 64 - depth).bitwiseOR(F.lit(1 << depth)) if depth else F.lit(1).cast("long")


def node_pairs(nodes: DataFrame, most: int = MOST) -> dict[int, DataFrame]:
    """By depth, the pairs (a, b) of trie nodes within the budget that hold at most `most` fingerprints and whose parents hold more."""
    n = nodes.count()
    pairs = nodes.sparkSession.range(1).select(F.lit(1).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    if n <= most:
        return {0: pairs}
    found, depth = {}, 0
    while True:
        depth += STEP
        sizes = written(nodes.groupBy(trie_node(depth).alias("node")).agg(F.count(F.lit(1)).alias("n")), "trie_nodes")
        side = lambda x: sizes.select(F.shiftright("node", STEP).alias(x), F.col("node").alias(f"{x}_child"), F.col("n").alias(f"{x}_n"))  # noqa: E731, B023
        down = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("a_child") <= F.col("b_child")) & (F.bit_count(F.col("a_child").bitwiseXOR(F.col("b_child"))) <= BUDGET))
        held = F.when(F.col("a_child") == F.col("b_child"), F.col("a_n")).otherwise(F.col("a_n") + F.col("b_n"))
        down = written(down.select(F.col("a_child").alias("a"), F.col("b_child").alias("b"), held.alias("held")).where("held > 1"), "trie_pairs")
        small = (F.col("held") <= most) | F.lit(depth + STEP > 60)  # 16 fingerprints at most lie below a node there
        found[depth] = down.where(small).select("a", "b")
        pairs = down.where(~small).select("a", "b")
        if not pairs.take(1):
            return found


def linked(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """(u, v): links between distinct fingerprints fp that join the same components as all links do."""
    dealt = None
    for depth, pairs in node_pairs(nodes, most).items():
        ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("end"))
        rows = nodes.select("fp", trie_node(depth).alias("end")).join(ends, "end").select(F.lit(depth).cast("long").alias("depth"), "a", "b", "fp")
        dealt = rows if dealt is None else dealt.unionByName(rows)
    return dealt.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b").mapInArrow(_walk_deals, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of edges (u, v) with the least node that it reaches, roots themselves left out."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(low, F.col("u") == F.col("x"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
        now = small.where("u <> v").distinct().checkpoint()
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp (long) and component_id of every row."""
    small_batches(df.sparkSession)
    docs = written(df.select(F.col(id_col).alias("id"), simhash_column(F.col(text_col).cast("string")).alias("fp")), "simhash")
    nodes = written(docs.groupBy("fp").agg(F.min("id").alias("least")), "simhash_nodes")
    roots = components(linked(nodes))
    nodes = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(named, "root").select("fp", "component_id")
    return docs.join(nodes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of df for each component: the least by (id_col, hash of the text, hash of the other columns), those without id_col last.

    Rows are told apart by that key, not by id_col alone; of rows that are equal in all columns one
    stays. Only the keys of rows that go, and of those that are repeated, meet the texts.
    """
    small_batches(df.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    others = [F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col)]
    key = {
        "_near_id": F.col(f"`{id_col}`"),
        "_near_a": F.xxhash64(text),
        "_near_b": F.xxhash64(F.lit(1), text),
        "_near_c": F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long"),
    }
    names = list(key)
    rows = written(df.select(*[c.alias(n) for n, c in key.items()], simhash_column(text).alias("fp")), "near_keys")
    nodes = written(rows.select("fp").distinct(), "near_nodes")
    roots = components(linked(nodes))
    roots = written(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "near_roots")
    rows = rows.groupBy("fp", *names).agg(F.count(F.lit(1)).alias("times")).join(roots, "fp")
    order = F.struct(F.col("_near_id").isNull().alias("unnamed"), *names)
    best = written(rows.groupBy("root").agg(F.min(order).alias("best")), "near_best").withColumnRenamed("root", "best_root")
    rows = written(rows.join(best, F.col("root") == F.col("best_root")).select(*names, "times", (order == F.col("best")).alias("stays")), "near_verdicts")
    side = lambda x: x.select(*[F.col(n).alias(f"{n}_") for n in names])
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    left = df.withColumns(key).join(side(rows.where("NOT stays")), same, "left_anti")
    again = side(rows.where("stays AND times > 1"))
    if not again.take(1):
        return left.select(*df.columns)
    once = left.join(again, same, "left_anti")
    return once.unionByName(left.join(again, same, "left_semi").dropDuplicates(names)).select(*df.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE_SQL: dict[str, str] = {}
