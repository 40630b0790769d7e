"""Sizes that small fixtures don't have: many shards, hosts of all sizes, a conversation of thousands of turns."""

from __future__ import annotations

import hashlib

import pytest

from quillon.llm import chat, fingerprints, quality, sstable


def test_starts_over_groups_of_shards(spark):
    """Prefix sums over gaps in the numbers of shards and over many groups, ends of groups included."""
    rows = [(i, f"s{i}", (i * 37) % 11) for i in range(300) if i % 7]
    manifest = spark.createDataFrame(rows, "shard long, file string, ids long").repartition(5)
    want, before = {}, 0
    for shard, file, n in rows:
        want[shard, file] = before
        before += n
    for size in (1, 8, 1024):
        assert {(r.shard, r.file): r.before for r in sstable.with_starts(manifest, size).collect()} == want
    assert sstable.with_starts(manifest.limit(0)).count() == 0


def test_cuts_of_many_ranges(spark):
    """Bounds come from every range of the sample, in order, about one a bucket."""
    rows = spark.range(20_000).selectExpr("id * 3 AS key", "0L AS h")
    cuts = fingerprints._cuts(rows, 20_000, 400, in_a_range=500)
    assert cuts == sorted(set(cuts)) or len(set(cuts)) == len(cuts)
    assert 200 < len(cuts) < 800 and min(cuts)[0] < 3_000 and max(cuts)[0] > 57_000


def planted(sizes: dict[str, int]) -> list[tuple]:
    """40 sound hosts of 100 documents, 3 of which fail a softer rule, and hosts of which nine in ten do."""
    words = "plain words that say something new in every place of this line and then some more"
    rows = [(h * 1000 + i, f"{words} {h} {i}" + " ### $$$" * (i % 33 == 1), f"good{h}") for h in range(40) for i in range(100)]
    for n, (host, size) in enumerate(sizes.items()):
        rows += [((n + 1) * 1_000_000 + i, f"{words} {n} {i}" + " ### $$$" * (i % 10 > 0), host) for i in range(size)]
    return rows


@pytest.mark.parametrize("sizes, caught", [((5,), {5}), ((50,), {50}), ((5000,), {5000}), ((5, 50, 5000), {50, 5000})])
def test_planted_bad_hosts(spark, sizes, caught):
    """Alone among sound hosts a bad one is caught whatever its size, with all its faulty documents; clean ones stay.

    Beside a bad host that holds over half of all documents, which lifts the prior's mean, one of 5 documents is let through.
    """
    rows = planted({f"bad{n}": n for n in sizes})
    kept = {r.doc_id: r.kept for r in quality.check(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    gone = {i for i, keep in kept.items() if not keep}
    assert gone == {i for i, t, h in rows if "###" in t and h in {f"bad{n}" for n in caught}}


def test_conversation_of_many_turns(spark):
    """2,000 turns are one conversation with 1,000 examples, each with all turns before it."""
    n = 2000
    turns = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(n)]
    made = chat.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert made.where("trainable").count() == n // 2
    row = chat.digest(made).first()
    loss = "".join(x for _, _, r, x in turns if r == "assistant")
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
