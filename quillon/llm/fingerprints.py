"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, inside the JVM.

A paragraph is a line without its break, cut after every 200 code points; its
digest is xxhash64. A sketch has three parts of cells; each digest goes into one
cell of each part, and a cell holds (count, XOR of digests, XOR of checks). Two
sketches of one size subtract cell by cell; peeling cells that hold a single
digest recovers the digests found in only one of two texts.

Where peeling the fingerprints stops early, the counts left in their cells say
about how many digests differ: a cell's count is a sum of so many signs. The
digests are then dealt by value into stripes that each hold a few differing ones,
and each stripe is sketched, subtracted and peeled; a stripe that fails is built
again with twice the cells and another hash, until it succeeds. Digests are
sorted once and a stripe is found by binary search, so the work is n log n.

Defined cases: a null text is an empty one, without paragraphs; blank lines have
no paragraph; repeated paragraphs of a text count once; two texts without
paragraphs have likeness 1; a document without doc_id stands outside the order
and has the empty text as its next; rows of one doc_id are ordered by a hash of
their text, then by it; identifiers that aren't integers are ordered by the bytes
of their text; an empty table gives an empty result; other columns are left out.
A stripe that can't be peeled at any of ATTEMPTS sizes, which takes two digests
with equal checks, is reported: its likeness is null, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, let, written

PIECE = r"[^\n]{1,200}"
BASE_WIDTH = 8  # cells in each of the three parts of the fingerprint
STRIPE_KEYS = 10  # differing digests that a stripe is meant to hold
STRIPE_WIDTH = 10  # cells in each of its three parts at first
ATTEMPTS = 12  # sizes of a stripe, each twice the one before
MARGIN = 1.3  # stripes are made for so many times the estimated difference
ROUNDS = 16
CELL = "array<struct<c:int,k:bigint,h:bigint>>"


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda piece: F.xxhash64(piece)))


def _check(key: Column, salt: int | Column) -> Column:
    return F.xxhash64(key, F.lit(salt))


def _entry(key: Column, check: Column, count: Column, width: Column) -> Column:
    """A digest with its cell (counted from 0) in each part."""
    place = lambda part: (part * width + F.pmod(F.shiftright(check, 21 * part), width)).cast("int")
    return F.struct(key.alias("k"), check.alias("h"), count.alias("c"), place(0).alias("p0"), place(1).alias("p1"), place(2).alias("p2"))


def _added(cell: Column, i: Column, entries: Column, sign: int) -> Column:
    """Cell i with the entries that fall into it."""
    own = F.filter(entries, lambda e: (e["p0"] == i) | (e["p1"] == i) | (e["p2"] == i))
    return F.aggregate(
        own, cell,
        lambda c, e: F.struct((c["c"] + e["c"] * sign).alias("c"), c["k"].bitwiseXOR(e["k"]).alias("k"), c["h"].bitwiseXOR(e["h"]).alias("h")),
    )


def sketch(keys: Column, width: Column, salt: int | Column) -> Column:
    """The cells of one sketch."""
    empty = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("h"))
    entries = F.transform(F.transform(keys, lambda k: F.struct(k.alias("k"), _check(k, salt).alias("h"))), lambda e: _entry(e["k"], e["h"], F.lit(1), width))
    return let(entries, lambda es: F.transform(F.sequence(F.lit(0), 3 * width - 1), lambda i: _added(empty, i, es, 1))).cast(CELL)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(cells: Column, width: Column, salt: int | Column) -> Column:
    """struct(ok, removed, added): the digests of the first and of the second sketch alone."""
    none = F.array().cast("array<bigint>")
    state = F.struct(cells.cast(CELL).alias("cells"), none.alias("removed"), none.alias("added"), F.lit(True).alias("open"))

    def keys_of(pure: Column, sign: int) -> Column:
        return F.transform(F.filter(pure, lambda p: p["c"] == sign), lambda p: p["k"])

    def round_(s: Column, _: Column) -> Column:
        single = F.filter(s["cells"], lambda c: (F.abs(c["c"]) == 1) & (_check(c["k"], salt) == c["h"]))
        next_ = let(
            F.transform(F.array_distinct(single), lambda p: _entry(p["k"], p["h"], p["c"], width)),
            lambda pure: F.struct(
                F.transform(s["cells"], lambda c, i: _added(c, i, pure, -1)).alias("cells"),
                F.concat(s["removed"], keys_of(pure, 1)).alias("removed"),
                F.concat(s["added"], keys_of(pure, -1)).alias("added"),
                (F.size(pure) > 0).alias("open"),
            ),
        )
        return F.when(s["open"], next_).otherwise(s)

    clear = lambda cs: ~F.exists(cs, lambda c: (c["c"] != 0) | (c["k"] != 0) | (c["h"] != 0))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), state, round_,
        lambda s: F.struct(clear(s["cells"]).alias("ok"), s["removed"].alias("removed"), s["added"].alias("added")),
    )


def estimated(cells: Column, width: int, n_a: Column, n_b: Column) -> Column:
    """About how many digests differ, from the counts of subtracted cells.

    With d differing digests of which n_a - n_b are the surplus of one side, the squares
    of a part's counts sum up to d (1 - 1 / width) + (n_a - n_b)^2 / width on average.
    """
    squares = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c["c"] * c["c"]) / 3
    d = (squares - (n_a - n_b) * (n_a - n_b) / F.lit(float(width))) / (1 - 1 / width)
    return F.least(F.greatest(F.ceil(d * MARGIN), F.abs(n_a - n_b).cast("bigint"), F.lit(STRIPE_KEYS)), (n_a + n_b).cast("bigint"))


def leading(n: Column, holds) -> Column:
    """How many of the places 1..n hold, from the first on, where those that do come first; by bisection."""
    between = F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi"))

    def step(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1).cast("int")
        halves = F.when(holds(middle + 1), F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))
        return F.when(s["lo"] < s["hi"], halves).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n.cast("bigint")))), between, step, lambda s: s["lo"])


def _stripe_difference(a: Column, b: Column) -> Column:
    """Sketches of a few digests, larger and with another hash until peeling succeeds."""
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(False).alias("ok"), none.alias("removed"), none.alias("added"))

    def attempt(s: Column, i: Column) -> Column:
        width = (F.lit(STRIPE_WIDTH) * F.pow(F.lit(2.0), i - 1)).cast("int")
        made = let(width, lambda w: peel(subtract(sketch(a, w, i), sketch(b, w, i)), w, i))
        return F.when(s["ok"], s).otherwise(made)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), start, attempt)


def _striped(a: Column, b: Column, keys: Column) -> Column:
    """The difference of two sets of digests, stripe by stripe, for about so many differing ones."""

    def dealt(x: Column) -> Column:
        def below(xs: Column, i: Column) -> Column:
            """Digests before stripe i: stripes are equal ranges of the signed 64-bit values."""
            bound = (F.floor(i * F.lit(2.0**32) / x["stripes"]) - F.lit(1 << 31)) * F.lit(1 << 32)
            return F.when(i < x["stripes"], let(bound, lambda v: leading(F.size(xs), lambda j: F.element_at(xs, j) < v))).otherwise(F.size(xs))

        def own(xs: Column, i: Column) -> Column:
            return let(below(xs, i), lambda lo: F.slice(xs, lo + 1, below(xs, i + 1) - lo))

        def stripe(i: Column) -> Column:
            return let(F.struct(own(x["a"], i).alias("a"), own(x["b"], i).alias("b")), lambda p: _stripe_difference(p["a"], p["b"]))

        return let(
            F.transform(F.sequence(F.lit(0), x["stripes"] - 1), stripe),
            lambda ps: F.struct(
                F.forall(ps, lambda p: p["ok"]).alias("ok"),
                F.flatten(F.transform(ps, lambda p: p["removed"])).alias("removed"),
                F.flatten(F.transform(ps, lambda p: p["added"])).alias("added"),
            ),
        )

    stripes = F.greatest(F.ceil(keys / STRIPE_KEYS), F.lit(1)).cast("int")
    return let(F.struct(F.sort_array(a).alias("a"), F.sort_array(b).alias("b"), stripes.alias("stripes")), dealt)


def with_difference(df: DataFrame, a: str, b: str, cells_a: str, cells_b: str, out: str) -> DataFrame:
    """Adds out: struct(ok, removed, added), first from the fingerprints, where they fail from striped sketches."""
    left = f"{out}_cells"
    df = df.withColumn(left, subtract(F.col(cells_a), F.col(cells_b)))
    df = df.withColumn(out, peel(F.col(left), F.lit(BASE_WIDTH), 0))
    keys = estimated(F.col(left), BASE_WIDTH, F.size(a), F.size(b))
    return df.withColumn(out, F.when(F.col(out)["ok"], F.col(out)).otherwise(_striped(F.col(a), F.col(b), keys))).drop(left)


def likeness(a: Column, difference: Column) -> Column:
    """Shared paragraphs by all paragraphs of both texts; null where they weren't recovered."""
    alone = F.size(difference["removed"])
    total = F.size(a) + F.size(difference["added"])
    return F.when(difference["ok"], F.when(total > 0, (F.size(a) - alone) / total).otherwise(F.lit(1.0))).cast("double")


def as_hex(cells: Column) -> Column:
    """Count (4 hex digits), digests and checks (16 each) of every cell."""
    part = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.array_join(F.transform(cells, lambda c: F.concat(part(c["c"], 4), part(c["k"], 16), part(c["h"], 16))), "")


INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _cuts(rows: DataFrame, count: int, buckets: int, in_a_range: int = 1 << 16) -> list[tuple]:
    """Every eighth (key, h) of a sample of some eight a bucket, in each of the ranges that it is sorted in."""
    sample = rows.where(F.pmod(F.xxhash64("key", "h"), F.lit(max(1, count // (8 * buckets)))) == 0).select("key", "h").distinct()
    ranges = sample.repartitionByRange(8 * buckets // in_a_range + 1, "key", "h").sortWithinPartitions("key", "h")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its range
    return [tuple(r) for r in ranges.withColumn("i", place).where("i % 8 = 0").select("key", "h").collect()]


def with_next_text(df: DataFrame, id_col: str, text_col: str, rows_per_bucket: int = 1500, most_buckets: int = 1 << 18) -> DataFrame:
    """id, text, next_text: the text of the next id in ascending order; the first one's after the last.

    Rows are dealt into buckets of neighbours, so each text is shuffled once; the first
    row of a bucket also goes to the one before it. The bounds between buckets are taken
    from a sample of the keys, some eight a bucket, which sets their sizes and nothing else. Spark sorts
    the sample; only the bounds, most_buckets and a little more, come to the driver (some 10 MB at most for integers). Equal rows
    of a repeated id are one row with a count until the end, and such an id is cut by
    a hash of its texts, so neither meets in one task.
    """
    key = F.col(id_col).cast("bigint") if dict(df.dtypes)[id_col] in INTEGERS else F.hex(F.encode(F.col(id_col).cast("string"), "UTF-8"))
    docs = df.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    unnamed = docs.where("key IS NULL").select("id", "text", F.lit("").alias("next_text"))
    rows = docs.where("key IS NOT NULL").withColumns({"h": F.lit(0).cast("bigint"), "n": F.lit(1).cast("bigint")})
    repeated = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key"), "repeated_ids")
    if repeated.take(1):
        many = rows.join(repeated, "key", "left_semi").groupBy("id", "key", "text").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(repeated, "key", "left_anti").unionByName(many.withColumn("h", F.xxhash64("text")))
    count = rows.count()
    if not count:
        return unnamed
    buckets = max(1, min(most_buckets, count // rows_per_bucket))
    cuts = [tuple(rows.agg(F.min(F.struct("key", "h"))).first()[0])]
    if buckets > 1:
        cuts = sorted({cuts[0], *_cuts(rows, count, buckets)})
    listed = lambda i, kind: F.split(F.lit(",".join(str(c[i]) for c in cuts)), ",").cast(f"array<{kind}>")  # noqa: E731  constants of the plan
    keys, hashes = listed(0, dict(rows.dtypes)["key"]), listed(1, "bigint")

    def upto(j: Column) -> Column:
        k = F.element_at(keys, j)
        return (k < F.col("key")) | ((k == F.col("key")) & (F.element_at(hashes, j) <= F.col("h")))

    rows = rows.withColumn("bucket", leading(F.lit(len(cuts)), upto))
    first = (F.element_at(keys, F.col("bucket")) == F.col("key")) & (F.element_at(hashes, F.col("bucket")) == F.col("h"))
    before = F.when(F.col("bucket") > 1, F.col("bucket") - 1).otherwise(F.lit(len(cuts)))
    home = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    both = F.array(home, F.struct(before.alias("bucket"), F.lit(True).alias("guest")))
    placed = rows.select("id", "key", "h", "n", "text", F.explode(F.when(first, both).otherwise(F.array(home))).alias("at")).select("id", "key", "h", "n", "text", "at.*")
    order = Window.partitionBy("bucket").orderBy("guest", "key", "h", "text")
    placed = placed.withColumn("after", F.lead("text").over(order)).where(~F.col("guest"))
    copies = placed.select("id", "text", "n", "after", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("i"))
    return copies.select("id", "text", F.when(F.col("i") < F.col("n"), F.col("text")).otherwise(F.col("after")).alias("next_text")).unionByName(unnamed)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, digests, cells and the fingerprint in hex of every row."""
    base = df.select(F.col(id_col), digests(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("digests"))
    return base.withColumn("cells", sketch(F.col("digests"), F.lit(BASE_WIDTH), 0)).withColumn("fingerprint", as_hex(F.col("cells")))


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edited text and against the next document's."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next_text(df, id_col, text_col)
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select(
        "id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"),
        digests(F.col("edited")).alias("changed"),
        digests(F.col("next_text")).alias("next"),
    )
    for name in ("own", "changed", "next"):
        rows = rows.withColumn(f"{name}_cells", sketch(F.col(name), F.lit(BASE_WIDTH), 0))
    rows = with_difference(rows, "own", "changed", "own_cells", "changed_cells", "to_edited")
    rows = with_difference(rows, "own", "next", "own_cells", "next_cells", "to_next")
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_hex(F.col("own_cells")).alias("fingerprint"),
        as_hex(F.col("changed_cells")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("to_edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("to_next")).alias("near_next"),
        F.size(F.col("to_edited.removed")).alias("n_removed"),
        F.size(F.col("to_edited.added")).alias("n_added"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(documents(spark, sf_dir))


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLE_SQL: dict[str, str] = {}
