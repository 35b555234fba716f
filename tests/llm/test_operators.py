"""The text operators against plain Python, and their defined results in odd cases."""

import collections
import hashlib
import html as entities
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tillwise.llm import queries  # noqa: F401  (they register)
from tillwise.llm.common import Scratch, table
from tillwise.llm.decontaminate import decontamination_report, drop_contaminated
from tillwise.llm.html import main_text
from tillwise.llm.licenses import license_scan
from tillwise.llm.linededup import dedup_lines
from tillwise.llm.nearcopies import keep_one_of_each, near_copy_groups
from tillwise.llm.packing import best_fit, pack_documents
from tillwise.llm.quality import keep_good, quality_scores
from tillwise.llm.registry import QUERIES
from tillwise.llm.repeats import remove_repeats
from tillwise.llm.tokenfile import Reader, read_token_files, write_token_files
from tillwise.llm.tokens import encoder
from tillwise.llm.topk import embedding_rows, top_k

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string"


def documents(spark, *texts):
    return spark.createDataFrame([(i, t, "en", None if i % 2 else "s", 0, "x") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def test_ids_are_those_of_the_library():
    rng = np.random.default_rng(1)
    signs = [*"ab'sSt rRe vEmMlLdD  \n\t\x1c\x85\xa0éÉßΣςİ1२½Ⅷ中한👍!?--_'’́", "<|endoftext|>", "'ll", "'re", "can't "]
    made = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(1500)]
    whole = Tokenizer.from_file(VOCABULARY)
    for text, ids in zip(made, encoder(VOCABULARY).encode(made)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_repeats_by_brute_force(spark, sf_dir, texts):
    seen: set[bytes] = set()
    want = {}
    for i in sorted(texts):
        data = texts[i].encode()
        covered = bytearray(len(data))
        grams = [data[k : k + 50] for k in range(len(data) - 49)]
        for k, g in enumerate(grams):
            if g in seen:
                covered[k : k + 50] = b"\1" * 50
        seen.update(grams)
        spans = sum(c and (k == 0 or not covered[k - 1]) for k, c in enumerate(covered))
        kept = bytes(b for b, c in zip(data, covered) if not c)
        want[i] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op3_repeats"](spark, sf_dir).collect()}
    assert got == want


def test_repeats_in_odd_cases(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(120))
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(documents(spark, None, "", long, "x" + long[:60] + "y" + long[30:100], "z" * 300, "z" * 80)).collect()}
    assert got[0] == got[1] == (0, 0, b"")
    assert got[2][0] == 0 and got[3] == (130, 2, b"xy")
    assert got[4][0] == 0 and got[5] == (80, 1, b"")
    assert remove_repeats(documents(spark).limit(0)).count() == 0


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else frozenset()


def test_near_copies_by_brute_force(spark, sf_dir, texts):
    sets = {i: word_set(t) for i, t in texts.items()}
    by_shingle = collections.defaultdict(list)
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = collections.Counter(j for g in sets[i] for j in by_shingle[g])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        for g in sets[i]:
            by_shingle[g].append(i)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op4_hyperminhash"](spark, sf_dir).collect()}
    assert got == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def test_near_copies_in_odd_cases(spark):
    base = [f"w{i}" for i in range(60)]
    changed = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (3, 30)]
    docs = documents(spark, None, "", " \n", "one two", "ONE two", " ".join(base), *changed, " ".join(base).upper())
    got = {r["doc_id"]: r["component_id"] for r in near_copy_groups(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 5, 8: 5}
    shared = docs.where("doc_id <> 1").union(docs.where("doc_id = 5").withColumn("doc_id", F.lit(3).cast("long")).select(docs.columns))
    got = {r["doc_id"]: r["component_id"] for r in near_copy_groups(shared).collect()}
    assert got == {0: 0, 2: 2, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 8: 3}  # both texts of id 3 link it
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 5]
    assert near_copy_groups(docs.limit(0)).count() == 0


def test_line_runs_by_brute_force(spark, texts):
    windows, first, gone = [], {}, collections.defaultdict(set)
    for i in sorted(texts):
        lines = [(k, x.strip(" ")) for k, x in enumerate(texts[i].split("\n")) if x.strip(" ")]
        for j in range(max(len(lines) - 3, 0) + 1 if lines else 0):
            part = lines[j : j + 3]
            key = tuple(x for _, x in part)
            windows.append((key, (i, part[0][0]), [k for k, _ in part]))
            first.setdefault(key, (i, part[0][0]))
    for key, at, places in windows:
        if at > first[key]:
            gone[at[0]].update(places)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs, words=None).collect()}
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}


def test_line_runs_in_odd_cases(spark):
    docs = documents(spark, "a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb", None, "", "a\nb", "q\n\n\nq2\nq3\nq\nq2\nq3")
    rows = dedup_lines(docs)
    assert rows.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in rows.collect()} == {0: "a\nb\nc\nd", 1: "x\ny", 2: "a\nb", 3: None, 4: "", 5: "", 6: "q\n\n\nq2\nq3"}
    assert sorted(r["doc_id"] for r in dedup_lines(docs, emptied=False).collect()) == [0, 1, 2, 3, 4, 6]
    assert dedup_lines(docs.limit(0)).count() == 0


def test_long_lines_between_different_neighbours(spark):
    passage, half = " ".join(f"w{i}" for i in range(60)), " ".join(f"h{i}" for i in range(30))
    short = " ".join(f"s{i}" for i in range(40))
    docs = documents(spark, f"a\n{passage}\nb", f"c\n{passage}\nd\ne", f"f\n{half}\n{half} x\ng", f"i\n{half}\n\n{half} x\nj", f"k\n{short}\nl", f"m\n{short}\nn", passage)
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    want = {r["doc_id"]: r["text"] for r in docs.collect()} | {1: "c\nd\ne", 3: "i\n\nj", 6: ""}
    assert got == want
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()} == {i: t for i, t in want.items() if t}


def test_line_runs_by_words_by_brute_force(spark, sf_dir, texts):
    first, windows, gone = {}, [], collections.defaultdict(set)
    for i in sorted(texts):
        lines = [(k, x.strip(" ")) for k, x in enumerate(texts[i].split("\n")) if x.strip(" ")]
        for j in range(len(lines)):
            sizes = [n for n in (1, 2) if j + n <= len(lines) and sum(len(x.split()) for _, x in lines[j : j + n]) >= 50]
            for n in {*sizes[:1], *([3] if j + 3 <= len(lines) or j == 0 else [])}:
                part = lines[j : j + n]
                key = tuple(x for _, x in part)
                windows.append((key, (i, part[0][0]), [k for k, _ in part]))
                first.setdefault(key, (i, part[0][0]))
    for key, at, places in windows:
        if at > first[key]:
            gone[at[0]].update(places)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}
    assert got == want
    registered = {r["doc_id"]: r["kept_sha256"] for r in QUERIES["op7_line_dedup"](spark, sf_dir).collect()}
    assert registered == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_packing_round_trip(spark, sf_dir, texts):
    whole = Tokenizer.from_file(VOCABULARY)
    want = {}
    for i, t in texts.items():
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[i, k] = (at, len(part), zlib.crc32(part.tobytes()))
    rows = QUERIES["op8_best_fit_packing"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.05 * (sum(r["length"] for r in rows) / 2048) + 1


def test_packing_in_odd_cases(spark):
    rows = pack_documents(documents(spark, None, "", "a b"), VOCABULARY, capacity=4).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == [(0, 1), (1, 1), (2, 3)]
    assert pack_documents(documents(spark, "a").limit(0), VOCABULARY).count() == 0
    assert sorted(map(sorted, best_fit([5, 5, 3, 7], 10))) == [[0, 1], [2, 3]]


def test_token_files_round_trip(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(None, "z"), (-1, None)], "doc_id long, text string")
    manifest = write_token_files(docs, Scratch(spark, "test").path("files"), VOCABULARY, row=64)
    whole = Tokenizer.from_file(VOCABULARY)
    want, at = {}, 0
    for i, t in [(-1, ""), *sorted(texts.items()), (None, "z")]:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["doc_id"]: tuple(r[1:]) for r in read_token_files(manifest).collect()} == want
    file = Reader(manifest.orderBy("part").first()["path"])
    ids, mask = file.sequence(0)
    assert len(ids) == len(mask) == 64 and np.array_equal(next(file.streams())[:64], ids[mask])
    assert read_token_files(write_token_files(docs.limit(0), Scratch(spark, "test").path("none"), VOCABULARY)).count() == 0


def test_main_text_of_given_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    got = {r["page_id"]: r["text"] for r in QUERIES["op6_main_text"](spark, sf_dir).collect()}
    for i, page in pages.items():
        inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
        assert got[i] == " ".join(entities.unescape(re.sub(r"</?(p|h1|br)>", " ", re.sub(r"</?b>", "", inside))).split())


def test_main_text_in_odd_cases(spark):
    menu = "home about contact us and all the other things we have to offer"
    pages = [
        (0, "http://a.org/1", f"<body><div>{menu}</div><div>First page says something of its own that nobody else does.</div></body>"),
        (1, "http://a.org/2", f"<body><div>{menu}</div><p>Second"),
        (2, "http://b.org/2", f"<div>{menu}</div>"),
        (3, None, None),
        (4, "x", ""),
        (5, "http://c.org", '<article>A &amp; B<br>c <i>d</i>e<div class="comments">no</div><form>no</form><script>"</article>"</script><p>f</article>g'),
    ]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {0: "First page says something of its own that nobody else does.", 1: "Second", 2: menu, 3: "", 4: "", 5: "A & B c de f"}
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_with_markup_as_evidence(spark):
    menu = "home about contact us and all the other things we have to offer"
    quote = "to be or not to be that is the question asked by many"

    def own(n):
        return " ".join(f"p{n}w{i}" for i in range(30))

    pages = [(n, f"http://a.org/{n}", f"<div>{menu}</div><article>{own(n)}</article>") for n in range(6)]
    pages += [(6, "http://a.org/6", f"<div>{own(6)}</div><article>teaser card</article>")]
    pages += [(n, f"http://b.org/{n}", f"<p>{own(n)}" + (f" {quote}</p><p>{quote}</p>" if n < 12 else "")) for n in range(10, 16)]
    pages += [(n, f"http://c.org/{n}", f"<p>{own(20)}</p>") for n in (20, 21)]
    pages += [(n, f"http://d.org/{n}", f"<article><p>{own(n)}</p><p>{menu}</p></article>") for n in range(30, 36)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {n: own(n) for n in (*range(6), *range(12, 16), *range(30, 36))}
    assert got == want | {6: f"{own(6)} teaser card", 20: own(20), 21: own(20)} | {n: f"{own(n)} {quote} {quote}" for n in (10, 11)}


def test_decontamination_in_odd_cases(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = documents(spark, None, "", f"a b {passage.upper()}. c", "short item here", f"{passage} {passage}", "x " * 500 + passage, " ".join(f"p{i}" for i in range(12)))
    bench = spark.createDataFrame([(1, passage), (10, passage), (2, "Short, item"), (3, None), (4, "...")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["item_ids"]), r["contaminated"]) for r in decontamination_report(docs, bench).collect()}
    assert got == {0: (0, 0, [], False), 1: (0, 0, [], False), 2: (23, 20, [1, 10], True), 3: (3, 2, [2], True), 4: (40, 40, [1, 10], True), 5: (520, 20, [1, 10], False), 6: (12, 0, [], False)}
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 5, 6]
    assert decontamination_report(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination_report(docs.limit(0), bench).count() == 0


def test_decontamination_compares_the_words_of_equal_hashes(spark, monkeypatch):
    hashed = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.pmod(hashed(*columns), F.lit(2)))
    passage = " ".join(f"p{i}" for i in range(20))
    docs = documents(spark, f"a b {passage} c", " ".join(f"q{i}" for i in range(40)), "one two three four")
    bench = spark.createDataFrame([(1, passage), (2, "short item")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], sorted(r["item_ids"])) for r in decontamination_report(docs, bench).collect()}
    assert got == {0: (20, [1]), 1: (0, []), 2: (0, [])}


def test_licences_in_order(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    docs = documents(spark, None, "x", f"{grant}\n\n{notice}", f"{notice}\n{grant}", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.")
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in license_scan(docs).collect()}
    assert got == {0: ([], []), 1: ([], []), 2: ([9, 10], ["MIT"]), 3: ([10, 9], []), 4: ([7, 18], ["CC-BY-NC-4.0", "MIT"])}
    assert license_scan(docs.limit(0)).count() == 0


def test_licences_in_wrapped_texts(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
    bsd = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
"""
    neither = """ * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
"""
    gpl = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
"""
    isc = """// Permission to use, copy, modify, and/or distribute this software for any
// purpose with or without fee is hereby granted, provided that the above
// copyright notice and this permission notice appear in all copies."""
    lines = "Some title\nAll rights reserved\nReleased under the MIT License\nmore words"
    apart = "Released under the\n\nMIT License\nall rights reserved by us"
    docs = documents(spark, mit, bsd, bsd + neither, gpl, isc, lines, apart, mit.replace("\n", "\r\n"))
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in license_scan(docs).collect()}
    assert got == {
        0: ([9, 10], ["MIT"]), 1: ([24, 25, 26], ["BSD-2-Clause"]), 2: ([24, 25, 26, 27], ["BSD-2-Clause", "BSD-3-Clause"]),
        3: ([13, 14, 16, 17], ["GPL-2.0-or-later"]), 4: ([28], ["ISC"]), 5: ([31, 7], ["MIT"]), 6: ([], []), 7: ([9, 10], ["MIT"]),
    }


def test_top_k_ties_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [-1.0, 0.5]), (None, [1.0, 1.0])]
    v = embedding_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in top_k(v, v.where("id = 0"), k=2).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 1024 * 1024)]
    assert top_k(v, v.where("id = 7"), k=2).count() == 0 and top_k(v.limit(0), v.limit(0)).count() == 0


def test_classifier_tells_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    train, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    scores = quality_scores(docs, train).join(held, "doc_id").selectExpr("(p_quality < 0.5) = (quality = 0) q", "(p_toxic > 0.5) = (toxic = 1) t").collect()
    assert np.mean([r["q"] for r in scores]) > 0.98 and np.mean([r["t"] for r in scores]) > 0.97


def test_classifier_without_labels_keeps_all(spark):
    docs = documents(spark, None, "", "some words")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 3
    assert keep_good(docs.limit(0), none).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = Scratch(spark, "test").keep(docs, "stage")
        assert docs.columns == names and 0 < docs.count() <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count() < before
