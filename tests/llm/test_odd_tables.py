"""Odd tables through the filtering operators and the pipeline: clashing names, missing ids, long texts, no rows."""

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tillwise.llm.common import table
from tillwise.llm.decontaminate import drop_contaminated
from tillwise.llm.linededup import dedup_lines
from tillwise.llm.nearcopies import keep_one_of_each, near_copy_groups
from tillwise.llm.quality import keep_good
from tillwise.llm.tokens import BATCH_CHARS, encoder

CLASH = ["__own_id", "__own_hash", "__OWN_PLACES", "__own_lines", "__own_text", "kept", "node", "key"]


@pytest.fixture(scope="module")
def clashing(spark):
    text = " ".join(f"word{i % 7} thing{i % 11}" for i in range(80))
    rows = [(1, text), (2, text), (None, text), (None, None), (3, ""), (4, "one line\ntwo\nthree\nfour"), (5, "one line\ntwo\nthree\nfive")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(*r, "en", None, 1, *CLASH) for r in rows], schema)


def test_clashing_columns_stay(spark, sf_dir, clashing):
    labels, items = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    for out in (dedup_lines(clashing), keep_one_of_each(clashing), keep_good(clashing, labels), drop_contaminated(clashing, items)):
        assert out.columns == clashing.columns
        assert all(r["__own_id"] == "__own_id" and r["key"] == "key" for r in out.collect())
    kept = keep_one_of_each(clashing).collect()
    assert sorted(map(str, (r["doc_id"] for r in kept))) == sorted(map(str, [1, None, None, 3, 4, 5]))


def test_near_copies_without_id(spark, clashing):
    got = [tuple(r)[:1] + tuple(r)[2:] for r in near_copy_groups(clashing).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (2, 1, False), (None, None, True), (None, None, True), (3, 3, True), (4, 4, True), (5, 5, True)], key=str)


def test_near_copies_of_long_texts(spark):
    """Over 1 MiB, cut into pieces, and with a word that fills a piece."""
    words = [f"w{i * 7919 % 100_003}" for i in range(260_000)]
    changed = [*words]
    changed[100] = changed[200_000] = "other"
    giant = "x" * 1_300_000
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, f"a b {giant} c d e f"), (4, f"A b {giant} c\td e f"), (5, f"a b {giant}x c d e f")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2][1] == 1 and got[4] == (3, 3) and got[5][1] == 5
    assert got[1][0] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_ids_of_texts_longer_than_a_batch():
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    text = " ".join(f"Word{i % 977}, it's {i}" for i in range(BATCH_CHARS // 10))
    assert len(text) > BATCH_CHARS
    (ids,) = encoder(vocabulary).encode([text])
    assert ids.tolist() == Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False).ids


def test_no_documents_go_through_all_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == table(spark, sf_dir, "documents").columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0
