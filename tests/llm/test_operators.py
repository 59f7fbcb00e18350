"""Each operator against a plain-Python version on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, component_id string, kept string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ta", "re", "mi", "so", "lu", "ne", "ko"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def shingles(text, size=5):
    w = WORD.findall(lowered(text))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def variant(text, seed, changes):
    rng, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = "zz%d" % rng.randrange(1000)
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    base = [prose(k, 120) for k in range(6)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(10 + k, variant(base[k % 3], k, k % 7)) for k in range(30)]
    rows += [(50, base[0]), (51, base[0]), (51, base[0]), (52, base[0].upper()), (60, None), (61, ""), (62, " \n\t "), (63, "one two"), (64, "One  two"), (65, "a b c d e"), (66, prose(99, 30_000)), (67, "see <|endoftext|> end"), (68, "a<|startoftext|>b\n<|EndOfText|>"), (None, base[1]), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "xx", "own", "own") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def expected_of_each(texts, sets, find):
    """Of each component the first text by doc_id and hash; any of one doc_id will do, as hashes aren't known here."""
    out, seen = Counter(), {}
    for k, (i, t) in enumerate(texts):
        if not sets[k]:
            out[i, t] += 1
        elif (seen_id := seen.get(find(k), (True, None, None)))[0] and (i is not None or seen_id[1] is None) or i is not None and i < seen_id[1]:
            seen[find(k)] = (i is None, i, t)
    return out + Counter((i, t) for _, i, t in seen.values())


def test_one_of_each(spark):
    """Rows of one doc_id with different texts, copies under one doc_id and without any."""
    from lodestone.llm.ngram_join import one_of_each

    a, b, c = (prose(200 + k, 60) for k in range(3))
    near = variant(b, 1, 1)
    assert shingles(near) != shingles(b)
    rows = [(1, a), (5, a), (5, b), (6, c), (6, c), (6, c), (None, c), (None, near), (None, prose(300, 50)), (None, prose(300, 50)), (7, None), (7, None), (None, "")]
    frame = spark.createDataFrame([(*r, f"s{k}", k, 0) for k, r in enumerate(rows)], "doc_id long, text string, source string, _id int, _key int")
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, a), (5, b), (6, c), (None, prose(300, 50)), (7, None), (7, None), (None, "")])
    assert all(rows[r["_id"]] == (r["doc_id"], r["text"]) for r in kept.collect())  # whole rows


def test_jaccard_components(docs, texts, nothing):
    from lodestone.llm.ngram_join import jaccard_components, one_of_each

    sets = [shingles(t) for _, t in texts]
    part = list(range(len(sets)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                part[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    expected = Counter((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(texts))
    assert Counter(map(tuple, jaccard_components(docs).collect())) == expected
    assert jaccard_components(nothing).count() == 0
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == expected_of_each(texts, sets, find)


def test_large_groups_are_joined(spark):
    """Chains of edits whose ends don't link, and short documents around one passage that hardly link."""
    from lodestone.llm.ngram_join import jaccard_components

    passage = prose(5, 60)
    rows = [variant(prose(1, 100), k, 1 + k % 4) for k in range(60)] + [passage + " " + prose(1000 + k, 2 + k % 16) for k in range(60)]
    sets = [shingles(t) for t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                part[max(find(a), find(b))] = min(find(a), find(b))
    found = {r["doc_id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert found == {k: find(k) for k in range(len(rows))}


def test_rows_without_id_bridge(spark):
    """Two documents linked only through one that has no doc_id, and copies of such rows."""
    from lodestone.llm.ngram_join import jaccard_components

    w = prose(77, 100).split()
    middle = " ".join(w)
    left, right = " ".join(["xx", "yy"] + w[2:]), " ".join(w[:-12] + [f"q{k}" for k in range(12)])
    assert 100 * len(shingles(left) & shingles(right)) < 75 * len(shingles(left) | shingles(right))
    rows = [(1, left), (2, right), (None, middle), (None, middle), (3, prose(78, 100)), (None, prose(79, 60)), (None, None)]
    found = [tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter(found) == Counter([(1, 96, 1), (2, 96, 1), (None, 96, 1), (None, 96, 1), (3, 96, 3), (None, 56, None), (None, 0, None)])


def test_frequent_shingles(spark, monkeypatch):
    """A passage in every document, near copies on it, and blocks and slices of a few rows."""
    from lodestone.llm import ngram_join

    for name in ("BLOCK_ROWS", "SLICE_ROWS"):
        monkeypatch.setattr(ngram_join, name, 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    passage = prose(5, 40)
    rows = [f"{passage} {prose(1000 + k, 60)}" for k in range(40)] + [variant(f"{passage} {prose(1000 + k % 4, 60)}", k, 1 + k % 6) for k in range(40)] + [f"{passage} {prose(2000 + k, 4 + k % 9)}" for k in range(30)]
    sets = [shingles(t) for t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                part[max(find(a), find(b))] = min(find(a), find(b))
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert found == {k: find(k) for k in range(len(rows))} and len(set(found.values())) < 80


def test_components_of_a_path(spark):
    from lodestone.llm.components import connected_components

    nodes = spark.range(40).withColumnRenamed("id", "key")
    links = spark.createDataFrame([(k, k + 1) for k in range(30) if k != 17] + [(5, 5)], "a long, b long")
    found = {r["key"]: r["component"] for r in connected_components(nodes, links).collect()}
    assert found == {k: 0 if k <= 17 else 18 if k <= 30 else k for k in range(40)}


def test_language(spark):
    from lodestone.llm.language_id import UNKNOWN, accepted_only, held_out, identify, train

    kinds = {"aa": "kotamu", "bb": "strelg", "cc": "öäüßch"}
    rng = random.Random(3)
    rows = [(k, " ".join("".join(rng.choice(kinds[lang]) for _ in range(5)) for _ in range(20)), lang) for k, lang in enumerate(sorted(kinds) * 60)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34!", "bb"), (903, rows[0][1], None), (None, rows[1][1], "bb"), (904, rows[2][1] * 2000, "cc")]
    docs = spark.createDataFrame([(*r, "s", "x") for r in rows], "doc_id long, text string, lang string, score string, letters string")
    model = train(docs, ~held_out())
    found = identify(docs.withColumn("held_out", held_out()), model, {"doc_id": "long", "held_out": "boolean"}).collect()
    assert len(found) == len(rows)
    for r, (doc_id, text, lang) in zip(sorted(found, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        assert r["held_out"] == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if not text or not re.search(r"[^\W\d_]", text):
            assert r["lang_pred"] == UNKNOWN and not r["accepted"]
        elif lang:
            assert r["lang_pred"] == lang
    kept = accepted_only(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (900, 901, 902)").isEmpty() and kept.count() >= len(rows) - 5
    empty = spark.createDataFrame([], docs.schema)
    assert train(empty, ~held_out()) is None and accepted_only(empty).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_exact(name):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from lodestone.llm.tokens import Encoder

    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "\t", "a", "B", "é", "'s", "|", " |", ".", ",", "9", "\u00a0", "\u3000", "\x1c", "e\u0301", "<|", "中", "🎉", "word"]
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDoftext|>", "see <|endoftext|> end", "x<|startoftext|>y z<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext |>", "a <|endof\u0074ext|> b " * 400]
    texts = ["", None, " ", *special, *("".join(rng.choice([*signs, "<|endoftext|>"]) for _ in range(20)) for _ in range(40)), *("".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(400)), prose(1, 20_000)]
    encoder = Encoder(path)
    for _ in range(2):  # learnt pieces give the same
        for ids, text in zip(encoder.texts(pa.array(texts), 7), texts, strict=True):
            assert ids.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 7]


def encoded(texts, name, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_files(spark, docs, texts, nothing, tmp_path):
    import public_tokenizers

    from lodestone.llm.token_files import read_token_files, write_token_files

    path = f"file://{tmp_path}/tokens"
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    rows = sorted(read_token_files(spark, path).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    expected = Counter((i, tuple(x)) for (i, _), x in zip(texts, encoded([t for _, t in texts], "byte_bpe_50k.json", 0), strict=True))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == expected
    import pyarrow.parquet as pq

    for file in (tmp_path / "tokens").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(c for name, c in columns.items() if name.startswith("ids"))
            assert ids.has_dictionary_page and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert all(c.has_offset_index and c.has_column_index for c in columns.values() if c.path_in_schema in ("doc_id", "n_tokens"))
    # small row groups and pages: several of each, and a read of one document skips the others
    small = f"file://{tmp_path}/small"
    many = spark.range(12_000).selectExpr("id as doc_id", "concat('some words of document ', id, repeat(' and more', 20)) as text").coalesce(1)
    write_token_files(many, small, public_tokenizers.path("byte_bpe_50k.json"), 0, row_group_bytes=32 << 10, page_bytes=4 << 10)
    assert max(pq.ParquetFile(f).metadata.num_row_groups for f in (tmp_path / "small").glob("*.parquet")) > 1
    picked = read_token_files(spark, small, ("ids",)).where("doc_id = 1234")
    assert picked.count() == 1 and "EqualTo(doc_id,1234)" in str(picked._jdf.queryExecution())
    one = read_token_files(spark, path, ()).where("doc_id = 3")
    assert one.columns == ["doc_id", "start", "n_tokens"] and one.count() == 1
    write_token_files(nothing, f"file://{tmp_path}/none", public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_packing(docs, texts, nothing):
    import public_tokenizers

    from lodestone.llm.packing import pack

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = pack(docs, tokenizer, 2).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 4096 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0 and r["ids_crc32"] == crc(r["ids"])
    assert [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])] == sorted(r["length"] for r in rows)
    pieces = Counter((r["doc_id"], r["start"], tuple(r["ids"]), r["doc_tokens"]) for r in rows)
    expected = Counter()
    for (i, _), ids in zip(texts, encoded([t for _, t in texts], "word_bpe_49k.json", 2), strict=True):
        at = 0
        while at < len(ids):
            n = min(4096, 1 << (len(ids) - at).bit_length() - 1)
            expected[i, at, tuple(ids[at : at + n]), len(ids)] += 1
            at += n
    assert pieces == expected
    assert pack(nothing, tokenizer, 2).count() == 0


def test_quality(spark, docs, texts, nothing):
    from lodestone.llm.quality_rules import ALL_CONTENT, judged, kept_only, train

    extra = [(200, "a b c a b c\n\nx\n x\nx\n#$ é*|&\n" * 3), (201, "\n".join(["same line here"] * 30)), (202, "é" * 5 + "\n" + prose(3, 60))]
    whole = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    found = Counter(map(tuple, judged(whole, ALL_CONTENT, {"doc_id": "long"}).drop("content_share").collect()))
    expected = Counter()
    for i, text in [*texts, *extra]:
        w = WORD.findall(text or "")
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, repeats = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                repeats += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        expected[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), repeats, len(covered), failed, not failed] += 1
    assert found == expected
    assert judged(nothing, ALL_CONTENT, {"doc_id": "long"}).count() == 0

    rng = random.Random(2)
    good = [(k, "\n".join(prose(rng.random(), 25).capitalize() + "." for _ in range(6)), 1) for k in range(40)]
    bad = [(100 + k, "\n".join(prose(rng.random(), 12).replace(" ", " | ") + " ###" for _ in range(8)), 0) for k in range(40)]
    labelled = spark.createDataFrame([r[:2] + ("x",) for r in good + bad], "doc_id long, text string, kept_0 string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in good + bad] + [(None, 1), (3, None)], "doc_id long, quality int")
    kept = kept_only(labelled, labels)
    assert kept.columns == labelled.columns and {r["doc_id"] for r in kept.collect()} == set(range(40))
    assert train(labelled, labels.limit(0)) is ALL_CONTENT


def test_viterbi_and_fit():
    import itertools

    import numpy as np

    from lodestone.llm.quality_rules import MEASURES, Field, viterbi

    rng = np.random.default_rng(4)
    field = Field(rng.normal(size=(MEASURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = [0, 1, 5, 3, 0, 7]
    first = np.concatenate([[0], np.cumsum(lengths)])
    lines = rng.normal(size=(first[-1], MEASURES))
    labels = viterbi(field, lines, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        emit = lines[a:b] @ field.weights
        best = max(itertools.product((0, 1), repeat=b - a), key=lambda y: sum(emit[k, y[k]] + (field.start[y[k]] if k == 0 else field.moves[y[k - 1], y[k]]) for k in range(b - a)))
        assert tuple(labels[a:b]) == best


def test_language_sample_is_of_texts(spark, monkeypatch):
    from lodestone.llm import language_id

    taken = []
    monkeypatch.setattr(language_id, "_fit", lambda languages, rows: taken.append(Counter(languages[y] for *_, y in rows)))
    rows = [(prose(k, 12), "aa") for k in range(60)] + [(prose(100 + k, 12), "bb") for k in range(30)] + [(prose(200 + k, 12), "bb") for k in range(2) for _ in range(500)]
    language_id.train(spark.createDataFrame(rows, "text string, lang string"), language_id.F.lit(True), sample=40)
    assert taken == [{"aa": 20, "bb": 20}]


def test_held_out_accuracy(spark):
    """Language and quality of documents that training hasn't seen, and how sure the language is of itself."""
    import os

    from pyspark.sql import functions as F

    from lodestone.llm import language_id, quality_rules

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"{d}/{name}.parquet") for name in ("documents", "labels"))
    held = language_id.held_out()
    model = language_id.train(docs, ~held)
    rows = language_id.identify(docs.withColumn("held_out", held), model, {"held_out": "boolean", "lang": "string"}).where("held_out and lang is not null").collect()
    right = [r["lang"] == r["lang_pred"] for r in rows]
    assert len(rows) > 100 and sum(right) >= 0.98 * len(rows) and sum(r["accepted"] for r in rows) >= 0.97 * len(rows)
    assert sum((r["score"] - ok) ** 2 for r, ok in zip(rows, right, strict=True)) <= 0.02 * len(rows)
    # a language that isn't learnt is mostly not accepted
    others = language_id.train(docs.where("lang <> 'de'"), ~held)
    assert language_id.identify(docs.where("lang = 'de'"), others, {"doc_id": "long"}).agg(F.avg(F.col("accepted").cast("int"))).first()[0] < 0.2

    field = quality_rules.train(docs, labels.where(~held))
    judged = quality_rules.judged(docs.join(labels.where(held), "doc_id"), field, {"quality": "int"}).collect()
    assert len(judged) > 50 and sum((r["content_share"] >= quality_rules.CONTENT_SHARE) == bool(r["quality"]) for r in judged) >= 0.97 * len(judged)


def test_license_variants():
    from lodestone.llm.license_scan import COVERAGE, IDENTIFIERS, NOTICES, forms_of, scan

    forms = forms_of(NOTICES, COVERAGE) + forms_of(IDENTIFIERS, COVERAGE)
    header = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU %s Public License as published by the Free Software Foundation; either version %s of the License, or (at your option) any later version."
    for text, name in [
        (header % ("General", "2"), "GPL-2.0"), (header % ("General", "3"), "GPL-3.0"), (header % ("Lesser General", "2.1"), "LGPL-2.1"), (header % ("Affero General", "3"), "AGPL-3.0"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        (header % ("Lesser General", "3"), "LGPL-3.0"), ("Licensed under the GNU General Public License v3.", "GPL-3.0"), ("Released under the BSD 3-Clause License.", "BSD-3-Clause"), ("Released under the BSD License.", None), ("Released under the Apache License.", None), ("released under the new label license", None),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Released under the XYZ License.", None), ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
    ]:
        assert [r[0] for r in scan(f"{prose(1, 30)}\n{text}\n{prose(2, 30)}", forms)] == ([name] if name else []), text
    for name, all_forms in NOTICES.items():
        for form in all_forms:
            found = scan(form, forms)
            assert found[0][:2] == (name, 1.0), (name, form[:80], [r[:3] for r in found])


def test_license_names_and_tags(spark):
    from lodestone.llm.license_scan import COVERAGE, TITLES, forms_of, license_scan, scan

    cases = [
        ("MIT License", ["MIT"], []), ("BSD 3-Clause License", ["BSD-3-Clause"], []), ("GPLv3", ["GPL-3.0"], []), ("Creative Commons Attribution 4.0", ["CC-BY-4.0"], []),
        ("Creative Commons Attribution-ShareAlike 3.0", ["CC-BY-SA-3.0"], []), ("# License\n\nApache License 2.0", ["Apache-2.0"], []), ('"license": "MPL-2.0",', ["MPL-2.0"], []), ("LGPL-2.1 or AGPL 3.0", ["AGPL-3.0", "LGPL-2.1"], []),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"], ["MIT OR Apache-2.0"]), ("/* SPDX-License-Identifier: GPL-2.0-only */", ["GPL-2.0-only"], ["GPL-2.0-only"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0-or-later"], ["GPL-2.0-or-later WITH Classpath-exception-2.0"]), ("spdx-license-identifier: lgpl-3.0+", ["LGPL-3.0-or-later"], ["lgpl-3.0+"]),
        ("SPDX-License-Identifier: (LGPL-2.1-only AND MIT) OR BSD-3-Clause and more", ["BSD-3-Clause", "LGPL-2.1-only", "MIT"], ["(LGPL-2.1-only AND MIT) OR BSD-3-Clause"]), ("SPDX-License-Identifier: Zlib OR", [], ["Zlib"]), ("SPDX-License-Identifier: ", [], []), ("SPDX-License-Identifier: AND MIT", [], []),
        ("Not released under the MIT License.", [], []), ("This isn't licensed under the MIT License, but under the GPLv2.", ["GPL-2.0"], []), ("Not only released under the MIT License.", ["MIT"], []), ("It is no longer under the MIT License; Apache License 2.0 now", ["Apache-2.0"], []),
        ("It does not work. Released under the MIT License.", ["MIT"], []), ("Not under the MIT License. Later released under the MIT License.", ["MIT"], []), ("permit license", [], []), (None, [], []),
    ]
    rows = [(k, None if t is None else prose(k, 20) + ".\n\n" + t) for k, (t, *_) in enumerate(cases)]
    found = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (text, names, expressions) in enumerate(cases):
        assert (sorted(found[k]["licenses"]), found[k]["expressions"]) == (names, expressions), text
        assert (found[k]["first_word"] is None) == (not names) and (not names or found[k]["first_word"] >= 20)
    forms = forms_of(TITLES, COVERAGE)
    for name, all_forms in TITLES.items():
        for form in all_forms:
            assert scan(form, forms)[0][:2] == (name, 1.0), (name, form)
    many = "Released under the MIT License, not the GPLv3. " * 20_000
    assert [r[0] for r in scan(many, forms)] == ["MIT"]


def test_patience_against_all_subsequences():
    """Equal heads and tails, then of all increasing subsequences of words unique to both the longest one that ends last, then the gaps, in recursion."""
    from itertools import combinations

    from lodestone.llm.license_scan import patience

    def aligned(text, notice, a=0, x=0):
        if not text or not notice:
            return []
        if text[0] == notice[0]:
            return [(a, x), *aligned(text[1:], notice[1:], a + 1, x + 1)]
        if text[-1] == notice[-1]:
            return [*aligned(text[:-1], notice[:-1], a, x), (a + len(text) - 1, x + len(notice) - 1)]
        unique = [(k, notice.index(w)) for k, w in enumerate(text) if text.count(w) == notice.count(w) == 1]
        chains = [c for n in range(len(unique) + 1) for c in combinations(unique, n) if all(p[1] < q[1] for p, q in zip(c, c[1:], strict=False))]
        best = max(chains, key=lambda c: (len(c), [k for k, _ in reversed(c)]))
        if not best:
            return []
        found, ends = [(a + k, x + at) for k, at in best], [(-1, -1), *best, (len(text), len(notice))]
        for (k1, x1), (k2, x2) in zip(ends, ends[1:], strict=False):
            found += aligned(text[k1 + 1 : k2], notice[x1 + 1 : x2], a + k1 + 1, x + x1 + 1)
        return sorted(found)

    rng, longest = random.Random(8), 0
    for _ in range(1500):
        notice = [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 11))]
        text = rng.sample(notice, len(notice)) if rng.random() < 0.4 else [w for w in notice if rng.random() > 0.2] + [rng.choice("abcmnop") for _ in range(rng.randint(0, 3))]
        longest = max(longest, len(patience(text, notice)))
        assert patience(text, notice) == aligned(text, notice), (text, notice)
    assert longest > 8


def test_license_windows():
    """What windows around anchor words find, against the window around every word of a notice (around the word that tells it, if it has one)."""
    from lodestone.llm.license_scan import COVERAGE, forms_of, patience, scan

    notices = {"long": ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu *nu xi omicron"], "short": ["kept under the *oak charter"], "free": ["take give share alter print sell lend keep hold pass"]}
    forms = forms_of(notices, COVERAGE)

    def every_window(words):
        found = set()
        for form in forms:
            n = len(form.words)
            centres = {form.words[k] for k, _ in form.must} or set(form.words)
            for k in (k for k, w in enumerate(words) if w in centres):
                a = max(0, k - n)
                place = {x: a + y for y, x in patience(words[a : k + n + 1], form.words)}
                if len(place) >= COVERAGE * n and all(x in place and (not after or place.get(x - 1) == place[x] - 1) for x, after in form.must):
                    found.add(form.name)
        return found

    rng, hits = random.Random(12), 0
    for _ in range(150):
        words = prose(rng.random(), rng.randint(0, 25)).split()
        for _ in range(rng.randint(0, 2)):
            name = rng.choice(list(notices))
            own = [w for w in notices[name][0].replace("*", "").split() if rng.random() > rng.choice((0, 0.1, 0.3))]
            at = rng.randint(0, len(words))
            words[at:at] = own
        expected = every_window(words)
        hits += len(expected)
        assert {r[0] for r in scan(" ".join(words), forms)} == expected, words
    assert hits > 50
    long = prose(1, 60_000) + " kept under the oak charter " + "kept under " * 20_000
    assert [r[:2] for r in scan(long, forms)] == [("short", 1.0)]


def test_license(spark, docs, nothing):
    from lodestone.llm.license_scan import NOTICES, license_scan, patience, words_of

    rows = [(k, prose(k, 40) + "\n" + form.upper() + "\n" + prose(k + 50, 40), name) for k, (name, form) in enumerate((n, f) for n, forms in NOTICES.items() for f in forms)]
    rows += [(100, prose(1, 20) + " licensed to nobody", None), (101, None, None), (102, "", None), (103, "Released under the MIT License. " * 3, "MIT"), (104, "This work is now licensed fully under GNU General Public License version 3", "GPL-3.0")]
    found = {r["doc_id"]: r for r in license_scan(spark.createDataFrame([(*r[:2], "x") for r in rows], "doc_id long, text string, license string")).collect()}
    for i, _, name in rows:
        assert (name in found[i]["licenses"]) if name else (found[i]["license"] is None and found[i]["coverage"] == 0), i
    assert license_scan(nothing).count() == 0

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(9)
    for _ in range(200):
        b = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 12))]
        a = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 12))]
        pairs = patience(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:])) and len(pairs) <= common(a, b)
        assert len(patience(b, b)) == len(b)
    assert words_of("CC BY-NC 4.0") == ["cc", "by", "nc", "4", "0"]


def test_urls(spark):
    from lodestone.llm.url_filters import HOST_WORDS, PATH_WORDS, PATTERN_RULES, SITE_RULES, filter_urls

    urls = ["http://A.Example.ORG/es/x?y", "https://example.org/en/12#t", "https://example.org/en/2", "https://org/", "https://org", "http://x.com/fr/a", "http://com/de/", "http://xcom/de/", "http://w.com/de", "http://example.net/en/1?/es/", "a://b.org/q://c.com/de/", "http://spam-farm.example.net/x", "http://my.spammer.net/", "plain", "", None, None, "http://", "http://h.net?u=http://x.org/", "http://example.org/EN/1", "http://cheap-pills.com/fr/1", "http://a.net/x/porn", "http://a.net/porn/y?porn", "http://a.net/pornography/", "http://pharma-rx.net/", "http://torrents.x.net/a/pixel.gif", "http://essex.net/sexton", "http://A.net/Casino/"]
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    found = filter_urls(spark.createDataFrame([(k, u, "mine", "kept") for k, u in enumerate(urls)], "page_id long, url string, rule string, token string"), [*SITE_RULES, *PATTERN_RULES]).collect()
    assert len(found) == len(urls)
    for r in found:
        url = urls[r["page_id"]]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lowered(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["token"]) == (host, path, "kept")
        assert r["rule"] == (max(fits)[1] if fits else None)
        words = [w for table in HOST_WORDS.values() for w in table.split() if re.search(rf"(^|[.-]){re.escape(w)}([.-]|$)", host)] + [w for table in PATH_WORDS.values() for w in table.split() if w in path.split("/")[1:]]
        other = "block" if words else "allow"
        assert r["verdict"] == (max(fits)[2] if fits else other), url
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), SITE_RULES).count() == 0


def test_url_places(spark):
    """Rules with * against a plain comparison of host, parts of the path and parameters."""
    from fnmatch import fnmatchcase

    from lodestone.llm.url_filters import PLACE_RULES, filter_urls, wildcard_rule

    def path_fits(have, want):
        if not want:
            return not have
        if want == ["**"]:
            return True
        return bool(have) and fnmatchcase(have[0], want[0]) and path_fits(have[1:], want[1:])

    def fits(rule, host, path, query):
        place, asked, parameter = rule.partition("?")
        own, slash, folder = place.partition("/")
        labels = host.split(".")
        if not any(fnmatchcase(".".join(labels[k:]), own) for k in range(len(labels))):
            return False
        want, have = (slash + folder).split("/")[1:], path.split("/")[1:]
        if slash and want[-1] == "":
            ok = len(have) >= len(want) and path_fits(have[: len(want) - 1], want[:-1])
        else:
            ok = not slash or (path.startswith("/") and path_fits(have, want))
        return ok and (not asked or (query[:1] == "?" and any(fnmatchcase(p, parameter) for p in query[1:].split("&"))))

    rng = random.Random(4)
    rules = [*PLACE_RULES, wildcard_rule("allow", "good.ads-track.*/en/"), wildcard_rule("block", "x*y.org/a/*b/**"), wildcard_rule("block", "x.org/a*b?k*=1")]
    urls = [None, "", "plain", "http://", "http://?print=1", "a://b#x://c?print=1", "http://m.ads-track.example.com/fr/1", "http://good.ads-track.example.com/en/1", "http://a.net/x?y/wp-login.php", "http://a.net/wp-login.php#x", "http://a.net/wp-login.php/x", "http://a.net/WP-LOGIN.php", "http://ads-tracker.net/", "http://myads-track.net/", "http://x.org/a\nb?k2=1"]
    for _ in range(1500):
        rule = rng.choice(rules).name
        filled = "".join(rng.choice(["", "q", "a.b", "x-1", "/", "c/d"]) if c == "*" else c for c in rule.replace("**", "*"))
        if rng.random() < 0.3:
            at = rng.randrange(len(filled))
            filled = filled[:at] + rng.choice(["", "z", "/", "?", "&", "."]) + filled[at + rng.randint(0, 1) :]
        urls.append(rng.choice(["http://", "https://m.", "ftp://w-"]) + filled + rng.choice(["", "", "/", "x", "?p=1", "&p=1", "#t", "/y/z"]))
    found = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    hits = Counter()
    for r in found:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(\?[^#]*)?", urls[r["page_id"]] or "")
        host, path, query = (lowered(m[1]), m[2], m[3] or "") if m else ("", "", "")
        ok = [x for x in rules if fits(x.name, host, path, query)]
        best = max(ok, key=lambda x: (len(x.name), x.name)) if ok else None
        assert (r["pattern"], r["verdict"]) == ((best.name, best.verdict) if best else (None, "allow")), urls[r["page_id"]]
        hits[r["pattern"]] += 1
    assert len(found) == len(urls) and all(hits[x.name] > 2 for x in rules if x.verdict == "block") and hits[None] > 200
    assert sum(len(x.tokens) > 1 for x in PLACE_RULES) > 0.9 * len(PLACE_RULES)


def test_sharding(spark, docs, texts, nothing):
    from lodestone.llm.sharding import minimax_shards, shard_documents

    rows = shard_documents(docs, shards=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 4
        slots[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of_text.values())
    assert shard_documents(nothing).count() == 0
    # one text a third of all rows, and many of about one size
    many = [(k, prose(k, 30)) for k in range(400)] + [(1000 + k, prose(7, 30)) for k in range(200)]
    bytes_of = Counter()
    for r in shard_documents(spark.createDataFrame(many, "doc_id long, text string"), shards=6).collect():
        bytes_of[r["shard"]] += r["size"]
    least, *_, second, hot = sorted(bytes_of.values())
    assert len(bytes_of) == 6 and hot == 201 * (len(prose(7, 30)) + 16) and second - least <= 2 * max(len(t) + 16 for _, t in many)

    def needed(sizes, capacity):
        n, filled = 1, 0
        for x in sizes:
            if filled + x > capacity:
                n, filled = n + 1, 0
            filled += x
        return n

    rng = random.Random(6)
    for trial in range(3):
        sizes = [rng.randint(1, 50) for _ in range(60)] + [400] * (trial == 2)
        found = {r["cell"]: r["shard"] for r in minimax_shards(spark.createDataFrame(list(enumerate(sizes)), "cell long, size long"), 7).collect()}
        rest, open_shards = list(enumerate(sizes)), 7
        while open_shards > 1 and max(x for _, x in rest) * open_shards >= sum(x for _, x in rest):
            rest.remove(max(rest, key=lambda c: (c[1], c[0])))
            open_shards -= 1
        best = next(c for c in range(max(x for _, x in rest), sum(sizes) + 1) if needed([x for _, x in rest], c) <= open_shards)
        filled = Counter()
        for cell, x in rest:
            filled[found[cell]] += x
        order = [found[cell] for cell, _ in rest]
        assert max(filled.values()) <= best and order == sorted(order) and set(found) == set(range(len(sizes)))
        # no shard is short: each is within the largest size of an even share
        assert len(filled) == open_shards and min(filled.values()) >= sum(x for _, x in rest) / open_shards - max(x for _, x in rest)


def test_decontamination(spark, docs, texts, nothing):
    from lodestone.llm.decontamination import contained_items, without_items

    items = [(k, prose(500 + k, n)) for k, n in enumerate([4, 5, 6, 9, 20, 40, 41, 90])] + [(20, None), (21, ""), (None, prose(600, 12)), (5, prose(505, 40))]
    planted = [(300 + k, prose(k, 300) + "\n" + variant(t, k, k % 4) + " " + prose(k + 1, 3000 if k == 6 else 50)) for k, (_, t) in enumerate(items) if t]
    planted += [(400, prose(500, 4)), (401, prose(507, 90)[: len(prose(507, 90)) // 2]), (402, planted[3][1])]
    whole = spark.createDataFrame(planted, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, item string")
    expected = Counter()
    for i, text in [*planted, *texts]:
        own = shingles(text)
        for item_id, t in set(items):
            s = shingles(t)
            if s and 100 * len(s & own) >= 75 * len(s):
                expected[i, item_id, len(s), len(s & own)] += 1
    found = contained_items(whole, bench)
    assert Counter((r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_matched"]) for r in found.collect()) == expected and expected
    dirty = {i for i, *_ in expected}
    kept = without_items(whole.selectExpr("doc_id", "text", "1 as text_key", "2 as item"), bench)
    assert kept.columns == ["doc_id", "text", "text_key", "item"] and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in [*planted, *texts] if i not in dirty)
    assert contained_items(nothing, bench).count() == 0 and contained_items(whole, bench.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a>A</a></ul></nav><div class="cookie-notice">We use</div><main><article><header><h1>Title&nbsp; x</h1></header><p>one <b>two</b>&amp;three<br>four<p>five &lt;b&gt; &am <i>x</i>y<div class="ad">buy</div><ul><li>i1<li>i2</ul><form><input>sub</form><!-- c > --><aside>pull</aside><p>last</article><section id="comments"><article>cmt</article></section></main><footer>f</footer></body></html>"""


def test_html_names():
    from lodestone.llm.html_blocks import COMMENTS, NAMED, parsed

    def kept(page):
        return [b.text for b in parsed(page).blocks if b.state > NAMED]

    for wrapper in ('<body class="single comments-open">%s', '<main class="no-comments">%s</main>', '<div class="content has-sidebar">%s</div>', '<div id="page" class="no-sidebar">%s</div>', '<div class="sidebar">%s</div>', '<div class="comments"><div class="related-posts">%s</div></div>', "<header>%s</header>"):
        assert kept(wrapper % "<h1>Title</h1><article class='post has-comments'><p>text</article>") == ["Title", "text"], wrapper
    inside = '<article><h2 id="related-work">a</h2><section id="share-price">b</section><p id="notice-period">c</p><div class="site-header">d</div></article>'
    assert kept(inside) == ["a", "b", "c", "d"]
    # beside an article, names say what they say
    for named in ('<div class="related-posts"><article>x</article></div>', '<section id="comments"><article>x</article></section>', '<article class="comment">x</article>', '<div class="left-sidebar">x</div>', '<div class="cookie-notice">x</div>'):
        assert kept(f"<main><article>text</article></main>{named}") == ["text"], named
    assert [b.state for b in parsed('<article>a<p class="related">b</p><p class="comments">c</p></article>').blocks][1:] == [NAMED, COMMENTS]
    assert kept("<p>a &l<b>t;</b> z<form>f<p>g</form><p style='display: none'>h<p>i") == ["a &lt; z", "h", "i"]
    assert kept("<article><p hidden>a<svg><text>b</text></svg><p aria-hidden=true>c") == ["ab", "c"]
    # states reach any depth
    deep = "<article>" + "<div>" * 70 + "<nav>Menu</nav><form>Name</form><p>text"
    assert kept(deep) == ["text"] and [b.state for b in parsed(deep).blocks] == [parsed("<nav>x").blocks[0].state, parsed("<article>x").blocks[0].state]
    assert len(parsed(deep).blocks[1].branches) == 64
    assert kept("<noscript>a</noscript><object>b</object><p title='x>y'>c<p title=\"z>d") == ["ab", "c", "d"]


def test_html_is_linear():
    import time

    from lodestone.llm.html_blocks import parsed

    n = 50_000
    for page in ("<a" * 100_000, "<a " * n + ">", '<a "<b ' * n + ">", '<a ">' * (n + 1), "<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<div>" * n + "x", "<b>" * n + "<p>x" * n, "<div class=sidebar>" * n + "x<p>y", "<script>" + "</script " * n, "<!--" * n, "</" * 1_000_000 + ">", "<p" * 1_000_000 + ">", "<div class=sidebar>x" * n, "<li>x" * n, "<div>" * 3000 + "<p>z" * n, '<p "a>"" ' * n + "'<i>"):
        began = time.process_time()
        parsed(page)
        assert time.process_time() - began < (1 if page.startswith("<a<a") else 2 if page.startswith("</") else 10), page[:20]


def plain_text(pages):
    """Main texts of pages (host, html), by plain Python: entropies, importances with what is coarser, and the choice of blocks."""
    import math

    from lodestone.llm import html_extraction as h

    columns = h.columns_of([h.parsed(page) for _, page in pages])
    rows = [(host, *[c[k].as_py() for c in columns]) for k, (host, _) in enumerate(pages)]

    def entropy(place, path, feature):
        seen, out = defaultdict(lambda: defaultdict(Counter)), {}
        for host, *row in rows:
            for node in row[place]:
                seen[host, node[path]][node[feature]][node["page"]] += 1
        for key, features in seen.items():
            n = [math.exp(-sum(c / f.total() * math.log(c / f.total()) for c in f.values())) for f in features.values()]
            total = sum(n)
            out[key] = (-sum(x / total * math.log(x / total) for x in n) / math.log(total) if total > 1.0001 else 1.0, total)
        return out

    def by_path(path, feature, branches):
        contents, styles = entropy(3, path, "feature"), entropy(4, path, feature)
        around = {(host, b[branches][-1]): b[branches] for host, _, blocks, *_ in rows for b in blocks}
        found = {}
        for host, branch in {(host, p) for (host, _), own in around.items() for p in own}:
            under = [contents[k] for k, own in around.items() if k[0] == host and branch in own]
            mean = sum(e * n for e, n in under) / sum(n for _, n in under)
            found[host, branch] = (h.CONTENT_WEIGHT * mean + (1 - h.CONTENT_WEIGHT) * styles.get((host, branch), (0.0,))[0], max(n for _, n in under))
        return contents, found

    named, tags = by_path("path", "feature", "branches"), by_path("plain", "plain_feature", "plain")
    out = []
    for host, texts, blocks, shared, *_ in rows:

        def blended(kind, b, k, host=host):
            value, share, level = 0.0, 1.0, h.PRIOR_PAGES
            for table, column in ((tags, "plain"), (named, "branches")):
                own, n = table[kind][host, b[column][k]]
                w = max(0.0, n - 1)
                value, share = (w * own + level * value) / (w + level), share * level / (w + level)
            return value, share

        own = [[blended(1, b, k) for k in range(min(shared, len(b["branches"]) - 1), len(b["branches"]))] for b in blocks]
        known = [max(v + (1 - share) * b["prior"] for v, share in x) for b, x in zip(blocks, own, strict=True)]
        most = [max(v + (1 - share) * b["prior"] + share * b["kept"] * h.KEPT for v, share in x) for b, x in zip(blocks, own, strict=True)]
        lowest = max([h.FLOOR, *(x - h.MARGIN for x in known)])
        content = [v + share * b["kept"] for b in blocks for v, share in [blended(0, b, -1)]]
        out.append("\n\n".join(t for t, b, x, c in zip(texts, blocks, most, content, strict=True) if c >= b["least"] and x >= lowest))
    return out


def test_html_against_plain_python(spark):
    """Whole results on sites of 1 to 25 pages with names, ids of their own, menus and forms."""
    from lodestone.llm.html_extraction import main_text

    rng, pages = random.Random(4), []
    for site, n in enumerate((1, 2, 3, 5, 8, 13, 25)):
        for k in range(n):
            box = rng.choice(["Follow us on all channels", prose(rng.randrange(3), 6)])
            body = "".join(f"<p>{prose(rng.randrange(10**6), rng.randint(3, 25))}</p>" + "<ul><li>x</ul>" * rng.randint(0, 1) for _ in range(rng.randint(1, 4)))
            extra = rng.choice(["", f"<form>{prose(k, 3)}</form>", f"<div class=related>{prose(k, 9)}</div>", "<table><tr><td>a<td>b</table>"])
            pages.append((f"s{site}.net", f"<nav class=menu>{prose(site, 5)}</nav><div id=wrap-{rng.choice(['a', prose(k, 1)])}><article id=post-{k}><h1>{prose(k + 70, 4)}</h1>{body}<div class=x{site}>{box}</div>{extra}</article></div><div class=c>{prose(k, 9)}</div><footer>All rights {2000 + k % 2}</footer>"))
    found = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame([(k, f"http://{host}/{k}", page) for k, (host, page) in enumerate(pages)], "page_id long, url string, html string")).collect()}
    expected = plain_text(pages)
    assert [found[k] for k in range(len(pages))] == expected and len(set(map(len, expected))) > 40


def test_html_one_rule_for_any_number(spark):
    """A box that all pages of a site repeat goes as pages grow in number, also under ids that differ; an article's texts stay at each number."""
    from lodestone.llm.html_extraction import main_text

    def page(kind, k):
        name = {"same": "post", "number": f"post-{k}", "slug": prose(k + 900, 2).replace(" ", "-")}[kind]
        return f"<nav>Menu of all</nav><article id='{name}'><h1>{prose(k + 80, 4)}</h1><p>{prose(k, 30)}</p><div class=x>Follow us on all channels</div></article><footer>All rights</footer>"

    sizes = [1, 2, 4, 7, 12, 20, 40]
    rows = [(k, f"http://{kind}{n}.net/{k}", page(kind, k)) for kind in ("same", "number", "slug") for n in sizes for k in range(n)]
    kept = defaultdict(set)
    for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        host, k = r["url"].split("/")[2], r["page_id"]
        assert r["text"] in (both := [f"{prose(k + 80, 4)}\n\n{prose(k, 30)}", f"{prose(k + 80, 4)}\n\n{prose(k, 30)}\n\nFollow us on all channels"]), (host, r["text"])
        kept[host].add(both.index(r["text"]))
    for kind in ("same", "number", "slug"):
        found = [kept[f"{kind}{n}.net"] for n in sizes]
        # one answer for each site, and once the box goes it is gone for all larger ones
        assert found[0] == {1} and found[-1] == {0} and (kind == "slug" or found[-2] == found[-3] == {0}) and all(len(f) == 1 for f in found) and found == sorted(found, key=min, reverse=True), (kind, found)


def test_html_tree_decides(spark):
    from lodestone.llm.html_extraction import main_text

    def near(k):
        return variant(prose(500, 90), k, 1)

    sites = {
        # name of the site: page and main text by number
        "lead": lambda k: (f"<main><h1>Title {k}</h1><p>{prose(k, 9)}</p><article><p>{prose(k + 40, 30)}</p></article></main>", f"Title {k}\n\n{prose(k, 9)}\n\n{prose(k + 40, 30)}"),
        "teaser": lambda k: (f"<div id=slogan>Always first</div><div id=content>{prose(k, 60)}</div><article><p>{prose(k % 3, 5)}</p></article>", prose(k, 60)),
        "stock": lambda k: (f"<article><h1>{prose(k + 80, 4)}</h1><p>{prose(k, 30)}</p><div class=x>Follow us on all channels</div></article>", f"{prose(k + 80, 4)}\n\n{prose(k, 30)}"),
        "science": lambda k: (f"<article><p>{prose(k, 30)}</p><section class=related>{prose(k + 90, 30)}</section></article>", f"{prose(k, 30)}\n\n{prose(k + 90, 30)}"),
        # no names at all: a branch built anew on each page against ones that are built alike, whatever their texts
        "plain": lambda k: (f"<div><ul><li>{prose(k + 300, 2)}<li>{prose(k + 400, 2)}</ul></div><div>{prose(k + 500, 9)}</div><section>" + "".join(f"<p>{prose(k * 9 + j, 12)}</p>" + "<ol><li>one</ol>" * (k >> j & 1) for j in range(5)) + f"</section><div>{prose(k + 600, 6)}</div>", "\n\n".join(f"{prose(k * 9 + j, 12)}" for j in range(5))),
        # repeated branches inside main
        "inside": lambda k: (f"<main><h1>{prose(k + 700, 4)}</h1><div>Read this in our app</div><p>{prose(k, 30)}</p><div>{['Rate', 'Vote'][k % 2]} this page</div></main>", f"{prose(k + 700, 4)}\n\n{prose(k, 30)}"),
        "copies": lambda k: (f"<article><h1>One title</h1><p>{near(k)}</p></article>", f"One title\n\n{near(k)}"),
    }
    rows = [(k, f"http://{name}.net/{k}", *page(k)) for name, page in sites.items() for k in range(40)]
    few = f"<div id=slogan>Always first</div><article>{prose(1, 40)}</article>"
    rows += [(0, "http://few.net/0", few, prose(1, 40)), (1, "http://few.net/1", sites["lead"](1)[0], sites["lead"](1)[1]), (2, "http://few.net/2", f"<div id=content>{prose(2, 60)}</div><article>card</article>", prose(2, 60) + "\n\ncard")]
    found = {(r["page_id"], r["url"]): r["text"] for r in main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    for i, url, _, whole in rows:
        text = found[i, url]
        # teaser cards of three texts are of low importance, but have an article's prior
        assert text == whole or ("teaser" in url and text == f"{whole}\n\n{prose(i % 3, 5)}"), (url, text)


def test_html(spark):
    from lodestone.llm.html_extraction import main_text

    whole = "Title x\n\none two&three four\n\nfive <b> &am xy\n\ni1\n\ni2\n\nlast"
    rows = [(0, "http://a.b/1", PAGE, whole), (1, None, PAGE, whole), (1, None, PAGE, whole), (2, "http://a.b/2", None, ""), (3, "http://a.b/3", "", ""), (4, "x", "plain &eacute;  text <p>more", "plain é text\n\nmore"), (5, "http://a.b/", "<article><p>" + "long " * 100_000, ("long " * 100_000).strip()), (6, "u", "<nav>only</nav><p hidden>so", "so")]
    # a site without names that tell: its own repeated branches go
    rows += [(100 + k, f"http://soup.net/{k}", f"<body><div class=x1>Our site, your home</div><div class=x2><p>{prose(k, 30)}</p></div><div class=x3>All rights {k % 2}</div>", prose(k, 30)) for k in range(40)]
    found = main_text(spark.createDataFrame([(*r[:3], "mine") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in found) == Counter((i, u, t, len(t)) for i, u, _, t in rows)
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    import os

    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, d)
        assert after.columns == docs.columns, name
        rows = [tuple(r) for r in after.collect()]
        assert not Counter(rows) - Counter(tuple(r) for r in before.collect()) and len(rows) > 100, name
        before = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.run(spark, d).count() == corpus_pipeline.STAGES[-1][1](spark, before, d).count()
