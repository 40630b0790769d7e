"""Structure repair, exact dedup and collocations against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quillon.llm import chat_repair, collocations, exact_dedup

from ..conftest import SF
from .test_llm import LONG, ODD, SCHEMA

BLANK = " \t\n\x0b\x0c\r"


# Structure repair ---------------------------------------------------------------------------------


def brute_repair(rows: list[tuple[str, str]]) -> dict:
    """rows: (role, text) in order. By recursion over (row, state) with least (cost, audit), a few inserts in a row at most."""
    kinds, seen, counts = [], set(), Counter()
    for role, text in rows:
        said = text.strip(BLANK)
        kind = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "fine"
        seen.add((role, text))
        counts[kind] += 1
        kinds.append(kind)
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best: dict = {}
    n = len(rows)
    for i in range(n, -1, -1):
        for inserts in (0, 1, 2, 3):  # how many inserts may still follow at this row
            for state in step:
                ways = [(0, "")] if i == n and state in ("", "a") else []
                if i < n:
                    more = 3 if kinds[i] == "truncated" else 0
                    ways.append((4 + best[i + 1, state, 3][0], "D" + best[i + 1, state, 3][1]))
                    if kinds[i] in ("fine", "truncated"):
                        r = rows[i][0][:1]
                        if r in step[state]:
                            c, a = best[i + 1, step[state][r], 3]
                            ways.append((more + c, "K" + a))
                        for r in set(step[state]) & {"u", "a"}:
                            c, a = best[i + 1, r, 3]
                            ways.append((3 + more + c, "R" + a))
                if inserts:
                    for r in set(step[state]) & {"u", "a"}:
                        c, a = best[i, r, inserts - 1]
                        ways.append((3 + c, "I" + a))
                best[i, state, inserts] = min(ways, default=(10**9, ""))
    cost, audit = best[0, "", 3]
    out, state, i = [], "", 0
    for letter in audit:
        role, text = rows[i] if letter != "I" else ("", "")
        i += letter != "I"
        if letter == "D":
            continue
        if letter != "K":
            role = {"": "user", "s": "user", "a": "user", "u": "assistant"}[state]
        state = role[0]
        out.append(f"{role}:{text}")
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return {
        "blank": counts["blank"], "duplicate": counts["duplicate"], "truncated": counts["truncated"], "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def brute_damage(rows) -> dict:
    """rows: (conv, turn, role, text). By conversation (key, or the row itself where there is none): turns, roles and texts after damage."""
    out: dict = defaultdict(list)
    for k, (conv, turn, role, text) in enumerate(rows):
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(":".join(shown).encode()) % 20
        own = out[conv, None if conv is not None else k]
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute_op11(rows) -> list[tuple]:
    done = []
    for (conv, _), own in brute_damage(rows).items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        done.append((conv, gaps, *brute_repair([(r, t) for _, r, t in own]).values()))
    return sorted(done, key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_repair(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = shown(chat_repair.op11_chat_repair(spark, sf))
    assert got == brute_op11([tuple(r) for r in rows]) and len(got) >= 20


TALK = "conv_id long, turn int, role string, text string, conv int, loose int, absent int"


def test_repair_awkward_rows(spark):
    rows = [
        (1, 0, None, "hello.", 0, 0, 0), (1, None, "user", None, 0, 0, 0), (1, 7, "assistant", "A!", 0, 0, 0), (1, 7, "assistant", "A!", 0, 0, 0),
        (None, 1, "user", "alone.", 0, 0, 0), (None, 1, "user", "alone.", 0, 0, 0), (2, 3, "tool", "x" * 200_000 + ".", 0, 0, 0), (3, 1, "", " ", 0, 0, 0),
        (4, 1, "system", "s.", 0, 0, 0), (4, 2, "system", "t.", 0, 0, 0), (5, -3, "user", "é?", 0, 0, 0), (5, 2**30, "assistant", "no end", 0, 0, 0),
    ]
    df = spark.createDataFrame(rows, TALK)
    assert shown(chat_repair.repaired(chat_repair.damaged(df), absent_col="absent")) == brute_op11([r[:4] for r in rows])
    assert chat_repair.repaired(df.drop("absent")).count() == 7
    assert chat_repair.repaired(df.where("false")).collect() == []
    gone = chat_repair.repaired(spark.createDataFrame([(9, 0, "user", "u.", True)], "conv_id long, turn int, role string, text string, absent boolean"), absent_col="absent").collect()
    assert [tuple(r) for r in gone] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def talk(random_, n):
    texts = ["ok.", "cut", "", "yes!", "  "] + [f"text {i}{e}" for i in range(n) for e in (".", "?", "")]
    return [(random_.choice(["user", "assistant", "system", "tool"]), random_.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("part", [1, 2, 7, 512])
def test_repair_in_parts(monkeypatch, part):
    """Random conversations, searched in parts of any length, are repaired as in one."""
    monkeypatch.setattr(chat_repair, "PART", part)
    random_ = random.Random(part)
    for n in [*range(12), 40, 90]:
        for _ in range(6):
            rows = talk(random_, n)
            made = chat_repair.Conversation()
            for i, (role, text) in enumerate(rows):
                made.add(i, role, text)
            got = made.result()
            assert got.pop("gaps") == 0
            assert got == brute_repair(rows), rows


def test_repair_of_many_turns(spark):
    """20,000 turns: held rows stay few, and the cost is that of the parts' brute force on a regular pattern."""
    made, most = chat_repair.Conversation(), 0
    for i in range(20_000):
        made.add(i, ("user", "assistant")[i % 2], f"turn {i}" + ("." if i % 10 else ""))
        most = max(most, len(made.held))
    got = made.result()
    assert got["cost"] == 3 * 2000 and got["audit"] == "K" * 20_000 and most < 2000


# Exact dedup --------------------------------------------------------------------------------------


def brute_groups(rows):
    """rows: (id, text) -> (id, keep, size, sha) and the number of rows kept."""
    norm = lambda t: (t or "").encode().lower()
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t)).hexdigest()) for i, t in rows), key=str), len(groups)


CASES = [
    *[r[:2] for r in ODD],
    (20, "ÀB c"), (21, "Àb C"), (22, "àb c"), (23, LONG + "x"), (24, LONG + "X"), (25, LONG + "y"), (None, ""), (None, "only here"), (None, "ONLY here"), (26, "İ"), (27, "i̇"), (30, "Same Text of five words"),
]


def test_exact_dedup(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in CASES], "doc_id long, text string, length int, kept int")
    out = exact_dedup.exact_duplicates(df, carry={"text_sha256": exact_dedup.text_digest(F.coalesce("text", F.lit("")))}).collect()
    want, groups = brute_groups(CASES)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == want
    assert sum(r.kept for r in out) == groups and all(r.doc_id == r.keep_id for r in out if r.kept)
    left = exact_dedup.deduplicated(df)
    assert left.columns == df.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted((r.doc_id for r in out if r.kept), key=str)
    none = df.where("false")
    assert exact_dedup.exact_duplicates(none).collect() == [] and exact_dedup.deduplicated(none).collect() == []


def test_exact_dedup_refines(spark):
    """Equal lengths and beginnings alone make no copies, a full bitmap changes nothing, and of unlike rows with one id and text one stays."""
    rows = [(i, "same beginning " * 10 + f"{i % 7:04d}") for i in range(300)] + [(i, f"{i:06d} other") for i in range(300, 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_dedup.exact_duplicates(df).collect()
    assert sorted((r.doc_id for r in out if r.kept)) == [*range(293, 300), *range(300, 600)]
    keys = exact_dedup.refined(df.select(F.octet_length("text").alias("length"), F.xxhash64(F.substring("text", 1, exact_dedup.PREFIX)).alias("prefix")))
    assert keys.count() == 1
    twice = spark.createDataFrame([(1, "t", "a"), (1, "t", "b"), (1, "t", "a")], "doc_id long, text string, source string")
    assert exact_dedup.deduplicated(twice).count() == 1 and sum(r.kept for r in exact_dedup.exact_duplicates(twice).collect()) == 1


def test_exact_dedup_with_full_bitmap(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 1)
    monkeypatch.setattr(exact_dedup, "BUCKET_BITS", 1 << 15)
    monkeypatch.setattr(exact_dedup, "bitmap", lambda keys: (keys.sparkSession.sql("SELECT 0L AS _copy_bucket, unhex(repeat('FF', 4096)) AS _copy_bits"), 1 << 15))
    df = spark.createDataFrame(CASES, "doc_id long, text string")
    want, groups = brute_groups(CASES)
    out = exact_dedup.exact_duplicates(df).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out if r.doc_id) == sorted(w[:3] for w in want if w[0]) and sum(r.kept for r in out) == groups


# Collocations -------------------------------------------------------------------------------------


def brute_collocations(rows, least, top):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            ws = re.findall(rb"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            f.update((lang or "und", *ws[i : i + k]) for k in range(1, 5) for i in range(len(ws) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    within = Counter()
    for (lang, *ws), a in found.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                key = (lang, *ws[i : i + k])
                within[key] = max(within[key], a)
    by = defaultdict(list)
    for p, a in found.items():
        lang, *ws = p
        if 100 * within[p] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[(lang, *ws[:k])] + f[(lang, *ws[k:])]), k) for k in range(1, len(ws)))
        by[lang].append((-score, -a, b" ".join(ws), f[(lang, *ws[:k])], f[(lang, *ws[k:])]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, own in by.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top], 1))


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_collocations_over_many_blocks(spark):
    """Blocks far smaller than a text: phrases over their borders count once."""
    random_ = random.Random(3)
    words = "the of new york city états-unis É é \u00a0x naïve".split(" ")
    texts = [(random_.choice(["en", "fr", None]), "".join(random_.choice(words) + random_.choice([" ", " ", "  ", "\t", ". ", "\n", ",,"]) for _ in range(random_.randrange(400)))) for _ in range(60)]
    texts += [("en", None), ("en", ""), ("en", " .,;"), (None, "The OF " * 3000)]
    df = spark.createDataFrame([(lang, text, 1, 2) for lang, text in texts], "lang string, text string, n int, block int").coalesce(2)
    want = brute_collocations(texts, 30, 2000)
    assert collocations.postings(df, places=50).count() > 80 and len(want) > 20
    for places in (collocations.BLOCK, 50):
        assert want == sorted(tuple(r) for r in collocations.collocations(df, places=places).select(*COLUMNS).collect())
    assert collocations.collocations(df.where("false")).collect() == []
    few = collocations.collocations(df, top=3).select(*COLUMNS).collect()
    assert sorted(map(tuple, few)) == brute_collocations(texts, 30, 3)


@pytest.mark.parametrize("part", [1, 3, 25])
def test_tokens_in_parts(part):
    text = "Aé. b\tC  d,e!\n\nlong-word-without-a-gap f;g"
    whole = [w for ws in collocations.tokens(text) for w in ws]
    assert [w for ws in collocations.tokens(text, part) for w in ws] == whole == "aé \xff b c d \xff e \xff \xff \xff long-word-without-a-gap f \xff g".encode("latin-1").replace(b"\xe9", "é".encode()).split()


def test_copies_add_no_lists(spark, monkeypatch):
    """A level makes a row for each phrase of a block, however often it stands there."""
    seen, plain = {}, collocations.frequent_of

    def counted(lengths, by, level, least):
        seen[level] = lengths.count()
        return plain(lengths, by, level, least)

    monkeypatch.setattr(collocations, "frequent_of", counted)
    for copies in (40, 4000):
        frequent, totals = collocations.mined(spark.createDataFrame([("a b c d e f g h", "en")] * copies, "text string, lang string").coalesce(1))
        assert seen == {1: 8, 2: 7, 3: 6, 4: 5} and totals.first().n == 8 * copies
        assert [r.f for r in frequent.where("words = 4").collect()] == [copies] * 5


def test_collocation_scores_are_exact(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    big = 9 * 10**12
    phrases = spark.createDataFrame([("en", "a", 1, big + 1), ("en", "b", 1, big + 2), ("en", "a b", 2, big)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    monkeypatch.setattr(collocations, "mined", lambda *a: (phrases, totals))
    row = collocations.collocations(phrases).first()
    assert (row.score, row.a, row.l, row.r) == (2_000_000 * big // (2 * big + 3), big, big + 1, big + 2)


def test_packed_lists():
    import numpy as np

    for x in ([], [5], [0, 3, 9, 2, 4], list(range(1000)) * 3):
        assert collocations.unpacked(collocations.packed(np.array(x, np.int64))).tolist() == x


# Mended operators ---------------------------------------------------------------------------------


def stays_by_brute_force(rows):
    """rows: (id, text). Of each component of fingerprints the least (id, text) as far as that is told by id; else its texts."""
    from .test_llm import brute_components, simhash

    fp = {t: simhash.simhash(t) & (2**64 - 1) for _, t in rows}
    part = brute_components(set(fp.values()))
    groups = defaultdict(list)
    for i, t in rows:
        groups[part[fp[t]]].append((i, t))
    return groups


UNLIKE = ["alpha beta gamma delta", "one two three four five", "red green blue white black pink", "north south east west up down left"]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_near_dedup_keeps_unlike_texts_of_one_id(spark, parts):
    import corpus_pipeline

    a, b, c, d = UNLIKE
    rows = [(1, a), (2, a), (2, c), (3, b), (3, d), (4, d), (None, c), (None, b), (5, a), (1, a), (1, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
    out = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(1, a), (2, c), (3, b), (3, d)])


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_near_dedup_of_repeated_ids(spark, sf):
    """Every third row takes an id of another: each component keeps one row, one of least id."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 50).otherwise(F.col("doc_id")))
    groups = stays_by_brute_force([(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()])
    out = [(r.doc_id, r.text or "") for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()]
    of = {t: k for k, own in groups.items() for _, t in own}
    assert sorted(of[t] for _, t in out) == sorted(groups)
    assert all(i == min(x for x, _ in groups[of[t]]) for i, t in out)
    again = [(r.doc_id, r.text or "") for r in corpus_pipeline.near_dedup_stage(spark, docs.repartition(5), sf).collect()]
    assert sorted(again) == sorted(out)


def test_license_scan_is_linear_in_hits(spark):
    """Four times the text takes about four times as long, beyond what any text takes."""
    import time

    from quillon.llm import license_scan

    line = "This is under the MIT License, the Apache License 2.0 and the GNU General Public License v3 or later.\n"

    def took(n):
        df = spark.createDataFrame([(1, line * n)], "doc_id long, text string")
        runs = []
        for _ in range(2):
            began = time.time()
            row = license_scan.scan_licenses(df).first()
            runs.append(time.time() - began)
        assert row.n_base == 3 * n and row.n_words == 20 * n and row.labels == "apache,apache-2.0,gpl,gpl-3.0-or-later,mit"
        return min(runs)

    fixed, short, long = took(1), took(2000), took(8000)
    print(fixed, short, long)
    assert long - fixed < 8 * max(short - fixed, 0.5)


def test_toxic_grades_of_ties():
    import numpy as np

    from quillon.llm import toxicity

    rows = [np.array([i], np.int64) for i in range(10)]
    toxic = np.array([1] * 5 + [0] * 5)
    assert toxicity.graded(rows, toxic).tolist() == [1] * 5 + [0] * 5  # nothing is telling: mild, never severe


def test_sstable_of_long_keys(spark, tmp_path):
    import public_tokenizers

    from quillon.llm import sstable

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = ["k" * 70_000 + str(i) for i in range(3)] + ["short"]
    df = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id string, text string")
    sstable.write_shards(df, str(tmp_path / "s"), path)
    assert sorted(r.id for r in sstable.read_shards(spark, str(tmp_path / "s")).collect()) == sorted(ids)
    assert len(sstable.lookup(spark, str(tmp_path / "s"), ids[1])) == 1
