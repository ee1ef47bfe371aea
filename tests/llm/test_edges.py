"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lakeseek.llm.class_lm import class_lm
from lakeseek.llm.common import P
from lakeseek.llm.decontaminate import contaminated, decontaminate
from lakeseek.llm.html_extract import extract_pages
from lakeseek.llm.language import identify, keep_identified
from lakeseek.llm.line_dedup import line_dedup
from lakeseek.llm.merkle import document_fingerprints
from lakeseek.llm.mixing import mix_sources
from lakeseek.llm.simhash import near_dedup, simhash_components
from lakeseek.llm.substring_dedup import substring_dedup
from lakeseek.llm.toxicity import toxicity

LONG = " ".join(f"long{i}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(40))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, h string, block string, fp string, score string"
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, "word", "en", "b"), (5, "two words", "en", None), (6, LONG, "en", "b"), (7, "über straße\nél\n日本語", "de", "b"),
    (8, "dup " + PASSAGE, "en", "c"), (9, PASSAGE.upper() + " tail", "en", "c"), (10, "same text\nover\nthree lines\nfour", "en", "c"), (10, "same text\nover\nthree lines\nfour", "en", "c"),
    (11, "same text\nover\nthree lines\nfive", "en", "c"), (None, "no id here", "en", None), (12, "12345 !!! ...", "en", "a"), (13, PASSAGE, "fr", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, l, s, len(t) if t is not None else None, 1, "x", "y", "z", "q") for i, t, l, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE, 0), (1, PASSAGE, 0), (2, None, 0), (3, "", 0), (None, "no id here", 0), (4, "zz yy", 0)], "item_id bigint, text string, h int")


def test_substring(docs, empty):
    got = substring_dedup(docs, with_text=True).collect()
    assert len(got) == len(ROWS) and substring_dedup(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert (by[6].n_words, by[6].n_removed) == (30_000, 0)
    assert (by[8].kept_text, by[13].kept_text, by[13].n_removed, by[8].spans) == ("dup", "", 40, [[1, 41]])
    assert by[9].n_removed == 0  # words are compared as they are


def test_substring_repeats_inside_one_text(spark):
    piece = [f"w{i}" for i in range(50)]
    text = " ".join([*piece, "middle", *piece])
    r = substring_dedup(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), with_text=True).first()
    assert (r.n_removed, r.kept_text) == (100, "middle")
    same = " ".join(["a"] * 60)
    r = substring_dedup(spark.createDataFrame([(1, same), (2, " ".join(["a"] * 35)), (3, " ".join(["b"] * 35))], "doc_id bigint, text string")).collect()
    assert sorted((x.doc_id, x.n_removed) for x in r) == [(1, 60), (2, 35), (3, 0)]


def test_decontaminate(docs, empty, items):
    found = sorted(((r[0], r.item_id, round(r.similarity, 3)) for r in contaminated(docs, items).collect()), key=repr)
    assert found == sorted([(8, 1, 1.0), (9, 1, 1.0), (13, 1, 1.0), (None, None, 1.0)], key=repr)
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    assert decontaminate(empty, items).count() == 0 and decontaminate(docs, items.limit(0)).count() == len(ROWS)


def test_lines(docs, empty):
    got = line_dedup(docs)
    assert got.columns == [*docs.columns, P + "n_lines", P + "n_removed_lines"] and line_dedup(empty).count() == 0
    rows = got.collect()
    assert len(rows) == len(ROWS)
    assert [r.text for r in rows if r.doc_id == 10] == ["same text\nover\nthree lines\nfour"] * 2
    assert [(r.text, r[P + "n_removed_lines"]) for r in rows if r.doc_id == 11] == [("five", 3)]
    assert [(r.text, r[P + "n_lines"]) for r in rows if r.doc_id == 1] == [(None, 0)]


def test_simhash(docs, empty):
    rows = simhash_components(docs).collect()
    assert len(rows) == len(ROWS) and simhash_components(empty).count() == 0
    by = {r[0]: (r[1], r[2]) for r in rows}
    assert by[1] == by[2] == by[3] == (0, 1) and by[10][1] == 10


def test_merkle(docs, empty):
    rows = document_fingerprints(docs).collect()
    assert len(rows) == len(ROWS) and document_fingerprints(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[1].n_chars == 0 and by[1].fingerprint == by[2].fingerprint and by[2].near_next == 1.0 and by[6].n_chars == len(LONG)
    ordered = sorted((r for r in ROWS if r[0] is not None), key=lambda r: (-r[0], r[1] or "")) + [r for r in ROWS if r[0] is None]
    for a, b in zip(ordered, ordered[1:] + ordered[:1]):
        if a[0] == 10:
            continue
        half = len(a[1] or "") // 2
        edited = (a[1] or "")[: len(a[1] or "") - half] + (b[1] or "")[:half]
        assert by[a[0]].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), a[0]


def test_merkle_single_row(spark):
    r = document_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id bigint, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0


def test_language(docs, empty):
    rows = identify(docs).collect()
    assert len(rows) == len(ROWS) and identify(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 12)) and by[4].lang_pred in ("en", "de", "fr")
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and not {1, 2, 3, 12} & {r.doc_id for r in kept.collect()}
    assert keep_identified(empty).count() == 0
    nothing = identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 13)] + [(4, 1, "x"), (5, None, "x"), (None, 1, "x")], "doc_id bigint, toxic int, text string")
    rows = toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows) and toxicity(empty, labels).count() == 0
    assert len({r.score for r in toxicity(docs, labels.limit(0)).collect()}) == 1
    assert len({r.score for r in rows if r.doc_id == 10}) == 1


def test_class_lm(docs, empty):
    rows = class_lm(docs).collect()
    assert len(rows) == len(ROWS) and class_lm(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == 1 and by[6].n_tokens == 30_001 and len([r for r in rows if r.doc_id == 10]) == 2
    assert all(r.score < 0 and r.base_score < 0 for r in rows)


def test_clashing_names_can_be_written(spark, docs, tmp_path):
    """The input has columns of the results' and the helpers' names: they come back as they were, and the result can be written."""
    extra = docs.withColumns({c: F.lit("kept") for c in (P + "t", P + "id", P + "row", "of", "s", "r", "epoch", "n_tokens", "order_key", "doc_key", "text.x", "a`b")}).withColumn("block", F.lit(5))
    for name, df in (("mixing", mix_sources(extra)), ("lines", line_dedup(extra)), ("near", near_dedup(extra)), ("clean", decontaminate(extra, spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string"))), ("language", keep_identified(extra))):
        df.write.parquet(str(tmp_path / name))
        back = spark.read.parquet(str(tmp_path / name))
        assert back.columns[: len(extra.columns)] == extra.columns and back.count() > 0, name
        assert {(r[P + "t"], r[P + "row"], r["epoch"], r["block"], r["a`b"]) for r in back.collect()} == {("kept", "kept", "kept", 5, "kept")}, name
    assert {"new_epoch", "new_block", "new_n_tokens", "new_order_key", "new_doc_key"} <= set(spark.read.parquet(str(tmp_path / "mixing")).columns)


def test_mixing(docs, empty):
    rows = mix_sources(docs, target_entropy=None, max_repetition=None).collect()
    assert {r.doc_id for r in rows} >= {4, 5, 6, 8} and mix_sources(empty).count() == 0
    nothing = mix_sources(docs.withColumn("text", F.lit(None).cast("string")))
    assert nothing.count() == len(ROWS) and nothing.columns[: len(docs.columns)] == docs.columns


def test_html(spark):
    pages = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "<p>a", None), (3, "<p>a", None), (None, "<div><p>" + "x " * 100_000, "u")], "page_id bigint, html string, url string")
    rows = extract_pages(pages, "page_id", "html", "url").collect()
    assert [(r.page_id, r.n_chars) for r in rows] == [(1, 0), (2, 0), (3, 1), (3, 1), (None, 199_999)]
    assert extract_pages(pages.limit(0)).count() == 0
