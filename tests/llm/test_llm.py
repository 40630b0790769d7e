"""Each operator against a brute-force version, on the small tables and on awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import byte_bpe, catalogue, chat, fingerprints, license_scan, line_dedup, mixing, quality, simhash, sstable, toxicity
from quillon.llm.license_rules import BASE, gates, rules
from quillon.llm.license_sentences import SENTENCES

from ..conftest import SF, same_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, h long, k string"
LONG = "\n".join(f"line {i} of a very long text with words {i * 7919 % 1013}" for i in range(4000))
ODD = [
    (1, None, "en", "a", 0, "x", 1, "k"),
    (2, "", "en", "a", 0, "x", 1, "k"),
    (3, LONG, "en", "a", len(LONG), "x", 1, "k"),
    (4, "same text of five words", "en", None, 23, "x", 1, "k"),
    (5, "same text of five words", None, None, 23, "x", 1, "k"),
    (5, "same text of five words", None, None, 23, "x", 1, "k"),
    (None, "no id here", "en", "b", 10, None, None, None),
    (7, "Released under the MIT License.\n\n CC BY-NC 4.0 \\ <|end|> é😀 \x1f!\x1c", "en", "b", 60, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def words(t):
    return t.encode().lower().split()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, duck, name):
    same_rows(catalogue.queries()[name](spark, SF), duck.execute(catalogue.oracle_sql()[name]).df())


def test_license_scan(docs, odd, empty):
    table = rules()
    assert len(SENTENCES) > 200 and all(any(g in " " + r.keyword for g in gates({r.keyword for r in table})) for r in table)
    for df in (docs, odd):
        got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan_licenses(df).collect()), key=str)
        want = []
        for i, t in texts(df):
            w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
            at = [(s, label) for p, label in BASE.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
            want.append((i if i is not None else -1, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
        assert got == sorted(want, key=str)
    labels = {r.doc_id: r.labels for r in license_scan.scan_licenses(odd).collect()}
    assert labels[7] == "cc-by,cc-by-nc-4.0,mit"
    assert license_scan.scan_licenses(empty).count() == 0


LICENCES = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the ACME Corp nor the names of its contributors may be used to endorse or promote products
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. http://www.apache.org/licenses/LICENSE-2.0
Distributed under the BSD license. Apache 2 licence, Apache 2.0 licensed. A BSD-style license. W3C Software and Document Notice and License. BigScience OpenRAIL-M license. CNRI License Agreement
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. // SPDX-License-Identifier: GPL-2.0-or-later SPDX-License-Identifier: GPL-2.0
Ce logiciel est régi par la licence CeCILL. CC BY-SA 4.0, CC BY, cc by nc 3.0; Creative Commons Attribution-ShareAlike 4.0; creativecommons.org/licenses/by-nd/3.0 all rights reserved MIT License GNU General Public License gnu general public license
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, the warranties of merchantability, fitness for a particular purpose; the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE""".split("\n")


def test_license_labels_by_brute_force(spark, docs):
    """Every rule on every text without gates or keywords; a hit goes if one sorted before it contains it and is no worse."""
    extra = [(-i - 1, t) for i, t in enumerate([*LICENCES, " ".join(LICENCES), " ".join(LICENCES * 5)])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    compiled = [(n, r, re.compile(f" (?:{r.regex})(?= )")) for n, r in enumerate(rules())]
    want = {}
    for i, t in texts(df):
        norm = " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())) + " "
        hits = []
        for n, r, regex in compiled:
            for m in regex.finditer(norm):
                first = norm[: m.start()].count(" ")
                hits.append((first, -(first + m.group().count(" ") - 1), r.priority, n, r))
        hits.sort(key=lambda h: h[:4])
        kept = [h for k, h in enumerate(hits) if not h[4].base and not any(g[1] <= h[1] and g[2] <= h[2] and not g[4].base for g in hits[:k])]
        all_ = kept + [h for h in hits if h[4].base]
        want[i] = (",".join(sorted({h[4].label for h in all_})), max((h[4].weight for h in all_), default=0.0))
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(df).collect()}
    assert got == want
    assert {r.label for r in rules()} > {"mit", "bsd-3-clause", "gpl-2.0-or-later"} <= set(want[-9][0].split(","))
    assert all(r.regex.count("[eé]") or re.search(f" (?:{r.regex})", " " + r.keyword) or r.keyword.split()[0] in r.regex for r in rules())


def test_license_suppression(spark):
    t = "Licensed under the Apache License, Version 2.0. GNU Lesser General Public License version 2.1 or any later version."
    row = license_scan.scan_licenses(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert [d.label for d in row.detections] == ["apache-2.0", "lgpl-2.1-or-later"]
    assert row.labels == "apache,apache-2.0,lgpl-2.1-or-later" and row.score == 1.0


def test_fingerprints(docs, odd, empty):
    def pieces(t):
        return set(re.findall("[^\n]{1,200}", t))

    def near(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(texts(df))
        got = {r.doc_id: r for r in fingerprints.compare_edits(df).collect()}
        assert len(got) == len(rows)
        for n, (i, t) in enumerate(rows):
            after = rows[(n + 1) % len(rows)][1]
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert r.near_edited == pytest.approx(near(pieces(t), pieces(edited)))
            assert r.near_next == pytest.approx(near(pieces(t), pieces(after)))
            assert (r.fingerprint == r.edited_fingerprint) >= (t == edited)
    assert fingerprints.compare_edits(odd).count() == len(ODD)
    assert fingerprints.compare_edits(empty).count() == 0


def test_next_text_over_many_buckets(spark, docs):
    rows = sorted(texts(docs))
    got = {r.id: r.next_text for r in fingerprints.with_next_text(docs, "doc_id", "text", rows_per_bucket=7).collect()}
    assert got == {i: rows[(n + 1) % len(rows)][1] for n, (i, _) in enumerate(rows)}
    named = docs.select(F.concat(F.lit("é,"), "doc_id").alias("name"), "text")
    rows = sorted((f"é,{i}", t) for i, t in texts(docs))
    got = {r.id: r.next_text for r in fingerprints.with_next_text(named, "name", "text", rows_per_bucket=7).collect()}
    assert got == {i: rows[(n + 1) % len(rows)][1] for n, (i, _) in enumerate(rows)}


def test_next_text_of_repeated_ids(spark):
    """A third of the rows has no id, a third one id: equal rows, others, and a cycle through all rows that have an id."""
    rows = [(None, f"t{i}") for i in range(300)] + [(50, "same")] * 150 + [(50, f"own {i}") for i in range(150)] + [(i, f"x{i}") for i in range(100) if i != 50]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprints.with_next_text(df, "doc_id", "text", rows_per_bucket=20).collect()
    assert len(got) == len(rows) and all(r.next_text == "" for r in got if r.id is None)
    named = [r for r in got if r.id is not None]
    assert sorted(r.text for r in named) == sorted(r.next_text for r in named) == sorted(t for i, t in rows if i is not None)
    assert sum((r.text, r.next_text) == ("same", "same") for r in named) == 149
    assert {r.next_text for r in named if r.id == 48} == {"x49"} and {r.next_text for r in named if r.id == 99} == {"x0"}


def test_fingerprints_of_large_differences(spark):
    """Work follows the number of paragraphs: four times as many take about four times as long."""
    import time

    took = {}
    for n in (500, 16_000, 64_000):
        a = "\n".join(f"line {i} {i * 7919 % 1013}" for i in range(n))
        b = "\n".join(f"{'other' if i % 3 else 'line'} {i} {i * 7919 % 1013}" for i in range(n))
        began = time.time()
        rows = fingerprints.compare_edits(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").coalesce(1)).collect()
        took[n] = time.time() - began
        shared, total = len(range(0, n, 3)), 2 * n - len(range(0, n, 3))
        assert [r.near_next for r in rows] == [pytest.approx(shared / total)] * 2
    assert took[64_000] < 8 * took[16_000]


def test_leading(spark):
    df = spark.range(40).select("id", fingerprints.leading(F.col("id").cast("int"), lambda j: j * 3 <= 50).alias("n"))
    assert {r.id: r.n for r in df.collect()} == {i: min(i, 16) for i in range(40)}


def test_sstable(spark, docs, odd, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    many = spark.createDataFrame([(7, f"text {i}") for i in range(3000)] + [(None, "")] * 500, "doc_id long, text string")
    for n, df in enumerate((docs, odd, many)):
        folder = str(tmp_path / str(n))
        manifest = sstable.write_shards(df, folder, path, shard_bytes=40_000)
        assert manifest.count() > (1 if n == 1 else 3)  # one hot identifier is split as well
        got = sorted(((-1 if r.id is None else r.id, r.start, r.n_tokens, r.ids_crc32) for r in sstable.read_shards(spark, folder).collect()), key=lambda r: r[1])
        want, start = [], 0
        signed = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
        for i, t in sorted(texts(df), key=lambda r: (-1 if r[0] is None else r[0], signed(r[1]), r[1].encode())):
            ids = np.array(plain.encode(t, add_special_tokens=False).ids + [0], "<u4")
            want.append((-1 if i is None else i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert got == want
        for i in (want[0][0], want[-1][0], want[len(want) // 2][0]):
            found = sstable.lookup(spark, folder, None if i < 0 else i)
            assert sorted(zlib.crc32(x.tobytes()) for x in found) == sorted(w[3] for w in want if w[0] == i)
        assert sstable.lookup(spark, folder, 10**9) == []
    sstable.write_shards(empty, str(tmp_path / "none"), path)
    assert sstable.read_shards(spark, str(tmp_path / "none")).count() == 0


def test_sstable_pieces_of_long_texts(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    alphabet = ["a", "b", " ", "  ", "'s", "T1", "é", "\n", "\t", "\r", "\x1c", "\x1f", "\x85", "\xa0", "!?", "<|endoftext|>", "<|endoftext", "|>", "😀", "\x00"]
    many = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(3000)]
    for size, call in ((1 << 20, 1 << 20), (1, 1), (9, 40)):
        monkeypatch.setattr(sstable, "LONG", size)
        monkeypatch.setattr(sstable, "CALL", call)
        for t, ids in zip(many, sstable.encoded(plain, many), strict=True):
            assert plain.encode(t, add_special_tokens=False).ids == ids.tolist(), repr(t)


def test_toxicity(spark, docs, odd):
    big = "/root/testdata/sf0.1"
    all_docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    held = labels.where("doc_id % 3 = 0")
    model = toxicity.train(all_docs, labels.where("doc_id % 3 <> 0"))
    assert (np.diff(model.cuts) > 0).all()
    rows = toxicity.score(all_docs, model).join(held.withColumnRenamed("toxic", "label"), "doc_id").select("toxic", "label", "expected_severity").toPandas()
    rows.columns = ["found", "label", "severity"]
    assert (rows["found"] == (rows["label"] == 1)).mean() > 0.95 and rows[rows.label == 0].found.mean() < 0.02
    assert rows[rows.label == 1].severity.mean() > rows[rows.label == 0].severity.mean() + 0.8  # some labelled texts hold no toxic word at all
    assert rows[rows.label == 1].found.mean() > 0.85  # labels are wrong in some 4 of 100 toxic texts
    assert toxicity.score(odd, model).count() == len(ODD)


def test_toxicity_probabilities_by_brute_force(spark, docs, odd):
    """The scored columns from the model's numbers alone, with plain arithmetic."""
    import math

    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for df in (docs, odd):
        want = []
        for i, t in texts(df):
            words_ = set(re.findall(r"[^\W\d_]+", t.lower()))
            names = words_ | {w[:n] + "*" for w in words_ for n in range(3, 9) if len(w) > n}
            s = sum(model.weights[k] for k in {xxhash.xxh32_intdigest(x) % 2**18 for x in names})
            upto = [0.0, *(1 / (1 + math.exp(s - c)) for c in model.cuts), 1.0]
            p = [upto[k + 1] - upto[k] for k in range(4)]
            want.append((str(i), p.index(max(p)), sum(k * x for k, x in enumerate(p))))
        got = sorted((str(r.doc_id), r.grade, r.expected_severity) for r in toxicity.score(df, model).collect())
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)])


def test_toxicity_defined_cases(spark, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for some, grade in ((labels.limit(0), 0), (labels.where("toxic = 0"), 0), (labels.where("toxic = 1"), 1)):
        model = toxicity.train(docs, some)
        assert {r.grade for r in toxicity.score(docs, model).select("grade").distinct().collect()} == {grade}
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    copies = spark.createDataFrame([(i % 2, f"text {i} idiot") for i in range(2000)], "doc_id long, text string")
    marks = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "doc_id long, toxic int")
    seen = []
    fit, toxicity.fit = toxicity.fit, lambda rows, grades: seen.append(len(rows)) or fit(rows, grades)
    try:
        toxicity.train(copies, marks, rows=1)
    finally:
        toxicity.fit = fit
    assert seen == [2]


def test_ordinal_recovers_order():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 600)
    rows = [np.sort(rng.choice(500, 12, replace=False) + 1000) for _ in grades]
    rows = [np.unique(np.concatenate([r[: 12 - 3 * g], rng.choice(20, 3 * g, replace=False)])) if g else r for r, g in zip(rows, grades)]
    model = toxicity.fit(rows[:400], grades[:400])
    assert np.corrcoef(model.expected(rows[400:]), grades[400:])[0, 1] > 0.9


def brute_simhash(t):
    w = words(t)
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if bin(a ^ b).count("1") <= 2:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_simhash(docs, odd, empty):
    for df in (docs, odd):
        rows = texts(df)
        fp = [brute_simhash(t) for _, t in rows]
        part = brute_components(set(fp))
        least = {}
        for (i, _), f in zip(rows, fp):
            if i is not None:
                least[part[f]] = min(i, least.get(part[f], i))
        want = sorted((str(i), f, least.get(part[f])) for (i, _), f in zip(rows, fp))
        got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect())
        assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_in_parts(monkeypatch):
    w = "the quick brown fox jumps over a lazy dog and then some more words come here".split()
    for part in (1, 9, 64):
        monkeypatch.setattr(simhash, "PART", part)
        for t in (None, "", " ", "a", "A b", "a b c", "a b c d", " ".join(w), " ".join(w * 40) + "\n\x0b x \x1c y", "z" * 300):
            assert simhash.simhash(t) % (1 << 64) == brute_simhash(t or "")


@pytest.mark.parametrize("most", [1 << 20, 60, 4])
def test_trie_links_and_components(spark, most):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for f in list(fps):  # chains and dense balls around the bases
        x = f
        for _ in range(12):
            x ^= (1 << int(rng.integers(0, 64))) | (1 << int(rng.integers(0, 64)))
            fps.add(x)
        fps |= {f ^ (1 << b) for b in range(0, 64, 5)}
    fps |= {0, 1, 3, (1 << 64) - 1, (1 << 64) - 2}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.linked(nodes, most)).collect()}
    want = brute_components(fps)
    groups = lambda pairs: sorted(sorted(v) for v in pairs.values())
    a, b = {}, {}
    for (f,) in signed:
        a.setdefault(roots.get(f, f), []).append(f % (1 << 64))
    for f in fps:
        b.setdefault(want[f], []).append(f)
    assert groups(a) == groups(b)


def test_quality(docs, odd, empty):
    for df in (docs, odd):
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.check(df).collect())
        want = []
        for i, t in texts(df):
            w = words(t)
            seen = {}
            for s in range(len(w) - 4):
                seen.setdefault(tuple(words(t)[s : s + 5]) if len(w) < 500 else tuple(w[s : s + 5]), []).append(s)
            w_case = t.encode().split()
            seen = {}
            for s in range(len(w_case) - 4):
                seen.setdefault(tuple(w_case[s : s + 5]), []).append(s)
            covered = {p for at in seen.values() if len(at) > 1 for s in at for p in range(s, s + 5)}
            lines = [x for x in t.split("\n") if x.encode().split()]
            want.append((str(i), len(w), sum(c not in " \t\n\x0b\x0c\r" for c in t), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
        assert got == sorted(want)
    assert quality.check(empty).count() == 0 and quality.filtered(empty).count() == 0
    assert quality.filtered(odd).columns == odd.columns


def test_host_verdicts_keep_clean_documents(spark):
    good = "plain words that say something new in every place of this line " * 1 + "and then some more of it to be long enough"
    bad = [(i, f"{'###$$$ ' * 8} text number {i} with a lot of symbols in it", "dirty") for i in range(60)]
    rows = bad + [(100 + i, f"{good} {i}", "dirty") for i in range(5)] + [(200 + i, f"{good} {i}", f"clean{i % 6}") for i in range(60)]
    rows += [(300, "###$$$ " * 3 + "a text with a few symbols but on a host that is otherwise fine", "clean1")]
    kept = {r.doc_id: r.kept for r in quality.check(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(kept[i] for i in range(60)) and all(kept[i] for i in kept if i >= 100)
    assert quality.prior_strength(2, 0.1, 0.1, 0.1) == 10.0 and quality.prior_strength(9, 0.1, 0.0, 0.1) == quality.MOST_PRIOR
    table = spark.createDataFrame(rows + [(400 + i, "###$$$ " * 12 + f"number {i} in no host and so on", None) for i in range(40)], "doc_id long, text string, source string")
    again = {r.doc_id: r.kept for r in quality.check(table).collect()}
    assert not any(again[400 + i] for i in range(40)) and all(again[i] for i in range(100, 105))


def test_host_verdicts_occur(docs):
    assert quality.check(docs).where("kept = base_failed").count() > 0


def test_line_dedup_edges(spark, odd, empty):
    rows = [(i, f"menu\nown line {i}\n\nfooter {i % 2}", "h") for i in range(40)] + [(99, None, "h"), (100, "menu", "small"), (101, "menu", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.line_count, r.line_dropped) for r in line_dedup.drop_boilerplate(df).collect()}
    assert got[0] == ("own line 0\n", 4, 2) and got[99] == (None, 0, 0) and got[100] == ("menu", 1, 0) and got[101] == ("menu", 1, 0)
    assert line_dedup.drop_boilerplate(odd).count() == len(ODD) and line_dedup.drop_boilerplate(empty).count() == 0


def test_line_dedup_small_hosts(spark):
    rows = [(i, f"menu\nown line {i}", "h") for i in range(19)] + [(20 + i, f"menu\nown line {i}", "three") for i in range(3)] + [(30 + i, f"menu\nown line {i}", "two") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df).collect()}
    assert got == {i: t.removeprefix("menu\n") if host != "two" else t for i, t, host in rows}
    key = df.limit(1).select(line_dedup._key(F.lit("menu")).alias("k")).first().k
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    first = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)
    assert (key.a, key.b) == (signed(xxhash.xxh64_intdigest(b"menu", 42)), signed(xxhash.xxh64_intdigest(b"menu", first)))


def test_mixing(spark, odd, empty):
    rows = spark.range(30000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'big' WHEN id % 100 = 1 THEN 'tiny' ELSE 'mid' END AS source", "'t' AS text")
    got = mixing.mix(rows, weights={"big": 1.0, "tiny": 1.0, "mid": 2.0}, total=40000)
    share = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert share["big"] == pytest.approx(10000, rel=0.05) and share["tiny"] == pytest.approx(10000, rel=0.1) and share["mid"] == pytest.approx(20000, rel=0.05)
    heavy = mixing.mix(rows.where("source = 'tiny'"), total=300.0 * 198)  # several draws a document
    assert heavy.count() == pytest.approx(300 * 198, rel=0.03)
    assert mixing.mix(empty).count() == 0 and set(odd.columns) <= set(mixing.mix(odd).columns)


def test_mixing_rows_without_own_id(spark):
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN id WHEN id % 3 = 1 THEN -1 END AS doc_id", "'s' AS source", "CASE WHEN id % 2 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    got = [tuple(r) for r in mixing.mix(rows).select("doc_id", "text", "copy", "shuffle_key").collect()]
    assert len({r[3] for r in got}) == len(got)
    for some in (lambda r: r[0] is None, lambda r: r[0] == -1, lambda r: r[0] is not None and r[0] >= 0):
        own = [r for r in got if some(r)]
        assert len(own) == pytest.approx(2000, rel=0.1) and sum(r[2] == 1 for r in own) == pytest.approx(2000 * (1 - np.exp(-1)), rel=0.1)
        assert sum(r[1] == "same" for r in own) == pytest.approx(1000, rel=0.15)
    again = [tuple(r) for r in mixing.mix(rows.repartition(7, "text")).select("doc_id", "text", "copy", "shuffle_key").collect()]
    assert sorted(again, key=str) == sorted(got, key=str)


def test_byte_bpe(docs, odd, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = byte_bpe.encoding(path, public_tokenizers.PATTERN)
    for df in (docs, odd):
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.tokenized(df, path).collect())
        want = []
        for i, t in texts(df):
            ids = enc.encode_ordinary(t)
            want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        assert got == sorted(want)
    assert byte_bpe.tokenized(empty, path).count() == 0
    text = " ".join(["ab  c\n\n d\t e", "é😀 x", "'s  12 "] * 300)
    for size in (1, 7, 100):
        assert "".join(byte_bpe.pieces(text, size)) == text
        assert byte_bpe.encode(enc, text, size).tolist() == enc.encode_ordinary(text)
    whole = "".join(np.random.default_rng(2).choice(list("abcdefgh"), 300_000))  # no place to cut
    assert list(byte_bpe.pieces(whole)) == [whole] and byte_bpe.encode(enc, whole).tolist() == enc.encode_ordinary(whole)
    back = odd.select("text", byte_bpe.decoded_column(byte_bpe.ids_column(odd["text"], path), path).alias("b")).collect()
    assert all((r.text or "").encode() == bytes(r.b) for r in back)


def test_chat(spark):
    tricky = ["", "\\", "<|", "<\\|", "<|turn|>", "<|end|>\n", "</s>[INST] ok [/INST]", "<<SYS>> <</SYS>>", "\\\\<|\\", "[\\INST]", "<\\\\|x", "a\n"]
    rows = [(c, t, "assistant" if t % 2 else "user", tricky[(c + t) % len(tricky)], "x") for c in range(12) for t in range(5)]
    rows += [(50, 0, "assistant", None, "x"), (50, 1, "user", "<|says|>", "x"), (51, 0, None, "no role", "x"), (None, 0, "user", "u", "x"), (None, 1, "assistant", "a", "x"), (52, 0, "user", "tie", "x"), (52, 0, "user", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.examples(df)
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        if c is not None:
            by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == {*by, None}
    loose = [(r.n_turns, r.turns_sha256, r.loss_chars) for r in chat.digest(made).where("conv_id IS NULL").collect()]
    assert sorted(loose) == sorted((1, hashlib.sha256(f"{r}\n{x}\n".encode()).hexdigest(), len(x) * (r == "assistant")) for r, x in (("user", "u"), ("assistant", "a")))
    long = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG * 3)], "conv_id long, turn long, role string, text string")
    row = chat.digest(chat.examples(long)).first()
    assert (row.loss_chars, row.loss_sha256) == (3 * len(LONG), hashlib.sha256((LONG * 3).encode()).hexdigest())
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert made.where("conv_id = 3 AND trainable").count() == 2
    assert chat.digest(chat.examples(df.limit(0))).count() == 0


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality rules"](spark, docs, SF)
    want = {r.doc_id for r in quality.check(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    deduped = stage["near dedup"](spark, docs, SF)
    assert sorted(r.doc_id for r in deduped.collect()) == sorted(r.component_id for r in simhash.near_duplicates(docs).select("component_id").distinct().collect())
    twice = stage["near dedup"](spark, docs.unionByName(docs), SF)
    assert twice.count() == deduped.count()
    for name, f in corpus_pipeline.STAGES[:-1]:
        for df in (odd.select(*docs.columns), docs.limit(0)):
            assert f(spark, df, SF).columns == docs.columns, name
            f(spark, df, SF).count()


def brute_pipeline(rows):
    """The five stages in plain Python over (doc_id, source, text) rows."""
    import public_tokenizers

    def measures(t):
        raw = t.encode()
        w, lines = raw.split(), [x for x in t.split("\n") if x.encode().split()]
        n, chars, symbols = len(w), sum(c not in " \t\n\x0b\x0c\r" for c in t), sum(c in "#*$%&|<>" for c in t)
        again = quality.repeated_words(w)
        base = n < 10 or 100 * again > 20 * n
        soft = symbols > 0.1 * n or len(lines) - len(set(lines)) > 0.3 * len(t.split("\n")) or chars < 2 * n or chars > 15 * n
        return base, soft

    found = [(r, *measures(r[2])) for r in rows]
    hosts = {}
    for (_, s, _), base, soft in found:
        f, n = hosts.get(s, (0, 0))
        hosts[s] = (f + (base or soft), n + 1)
    f, n = (np.array(x, float) for x in zip(*hosts.values()))
    mean = f.sum() / n.sum()
    real = (f / n).var(ddof=1) - mean * (1 - mean) * (1 / n).mean()
    k = min(50.0, max(1.0, (mean * (1 - mean) - real) / real)) if real > 0 else 50.0
    limit = mean + (mean * (1 - mean) / (k + 1)) ** 0.5
    bad = {s for s, (f, n) in hosts.items() if (f + k * mean) / (n + k) > limit}
    rows = [r for r, base, soft in found if not base and not (soft and r[1] in bad)]

    pages, holds = {}, {}
    for _, s, t in rows:
        pages[s] = pages.get(s, 0) + 1
        for line in {x for x in t.split("\n") if x.strip(" ")}:
            holds[s, line] = holds.get((s, line), 0) + 1
    drop = {(s, x) for (s, x), c in holds.items() if c >= 3 and c > 0.1 * pages[s]}
    rows = [(i, s, "\n".join(x for x in t.split("\n") if (s, x) not in drop)) for i, s, t in rows]

    fp = {i: brute_simhash(t) for i, _, t in rows}
    part, least = brute_components(set(fp.values())), {}
    for i in sorted(fp):
        least.setdefault(part[fp[i]], i)
    rows = [r for r in rows if least[part[fp[r[0]]]] == r[0]]

    sizes = {s: sum(r[1] == s for r in rows) for s in {r[1] for r in rows}}
    factor = len(rows) / sum(x**0.7 for x in sizes.values())
    enc = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = []
    for i, s, t in rows:
        u, rate = int(hashlib.md5(f"quillon-mix:{i}:1".encode()).hexdigest()[:13], 16) / 2**52, factor * sizes[s] ** 0.7 / sizes[s]
        copies, p, upto = 0, np.exp(-rate), np.exp(-rate)
        while upto <= u:
            copies += 1
            p *= rate / copies
            upto += p
        ids = enc.encode_ordinary(t)
        out += [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] * copies
    return sorted(out)


def test_pipeline_by_brute_force(spark, docs):
    import corpus_pipeline

    want = brute_pipeline([(r.doc_id, r.source, r.text or "") for r in docs.collect()])
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want and len(want) > 100


def test_clashing_columns(spark, docs, odd, tmp_path):
    import corpus_pipeline

    names = ["row", "m", "h", "key", "turn", "role", "kept", "depth", "a", "b", "n", "rate", "draws", "sums", "host", "suspect", "measure", "line_host", "line_keys", "line_count", "gone", "many", "fp", "least", "id", "bucket", "f", "t", "label_id"]
    clash = odd.select(*docs.columns, *[F.lit(1).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, SF).columns == clash.columns, name
        stage(spark, clash, SF).write.format("noop").mode("overwrite").save()
    for run in (license_scan.scan_licenses, fingerprints.compare_edits, simhash.near_duplicates, quality.check, mixing.mix, line_dedup.drop_boilerplate):
        run(clash).write.format("noop").mode("overwrite").save()
    import public_tokenizers

    sstable.write_shards(clash, str(tmp_path / "s"), public_tokenizers.path("byte_bpe_50k.json"))
    assert sstable.read_shards(spark, str(tmp_path / "s")).count() == len(ODD)
    assert byte_bpe.tokenized(clash, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).count() == len(ODD)
    model = toxicity.train(clash, spark.createDataFrame([(3, 0), (4, 1)], "doc_id long, toxic int"))
    assert toxicity.score(clash, model).count() == len(ODD)
    turns = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.examples(turns.select("*", *[F.lit(1).alias(c) for c in ("turns", "said", "whole", "example", "formatted", "context", "last")]))).count() == 1
