"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "the word of the day is long and longer than before " * 6000
ROWS = [
    (1, "Hello world this is one small text of some words", "en", "src0", 48), (2, None, None, None, None), (3, "", "en", "src0", 0), (None, "no id at all here", "en", "src1", 17),
    (1, "Hello world this is one small text of some words", "en", "src0", 48), (5, "Hello World this is one small text of some words", "en", "src0", 48), (6, LONG, "en", None, len(LONG)),
    (7, " \t\n", "de", "src0", 3), (8, "é ü 中文   x", "fr", "src2", 9), (9, "a", "en", "src0", 1), (10, "a", None, "src0", 1), (None, None, None, None, None), (11, "12345 !!! 678", "en", "src0", 13), (12, "x" * 30_000, "en", "src0", 30_000),
]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    from pyspark.sql import functions as F

    return df.withColumns({x: F.lit("mine") for x in names})


def test_quality(docs, none):
    from quillon.llm.quality import assess

    rows = assess(clashing(docs, "n_words", "kept")).toPandas()
    assert len(rows) == len(ROWS) and rows.n_words.dtype == np.int64 and set(rows.kept.unique()) <= {True, False}
    assert rows[rows.text.isna()].n_words.tolist() == [0, 0] and not rows[rows.text.isna()].kept.any()
    assert rows[rows.doc_id == 6].n_repeat_words.item() == rows[rows.doc_id == 6].n_words.item() == 66_000
    assert assess(none).count() == 0


def test_bpe(docs, none):
    from quillon.llm.bpe import encode_decode

    rows = encode_decode(clashing(docs, "n_tokens", "ids"), RANKS, public_tokenizers.PATTERN).toPandas()
    assert len(rows) == len(ROWS)
    for t, raw, ids, n in rows[["text", "decoded", "ids", "n_tokens"]].itertuples(index=False):
        assert bytes(raw) == (t or "").encode() and len(ids) == 4 * n
    assert encode_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_lm(docs, none):
    from quillon.llm.lm import score

    rows = score(clashing(docs, "score", "key", "block", "train")).toPandas()
    assert len(rows) == len(ROWS) and rows.score.notna().all() and (rows.score <= 0).all()
    assert rows[rows.doc_id == 2].n_tokens.item() == 1 and rows[rows.doc_id == 7].n_tokens.item() == 1
    assert len(rows[rows.doc_id == 1].score.unique()) == 1
    assert score(none).count() == 0


def test_lm_without_training_texts(spark):
    from quillon.llm.lm import score

    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    rows = score(spark.createDataFrame([(k, "ab c") for k in held], "doc_id bigint, text string")).toPandas()
    assert rows.held_out.all() and (rows.train_tokens == 0).all() and (rows.n_known == 0).all()
    assert rows.score.tolist() == pytest.approx([5 * np.log10(1 / 257)] * 2)


def test_minhash(docs, none):
    from quillon.llm.minhash import near_duplicates

    rows = near_duplicates(clashing(docs, "id", "n", "band", "component_id"), size=2).toPandas()
    assert len(rows) == len(ROWS)
    by = rows.dropna(subset="doc_id").set_index("doc_id")
    assert by.loc[[5]].component_id.item() == 1 and by.loc[[10]].component_id.item() == 9 and not by.loc[[10]].kept.item()
    assert by.loc[[2, 3, 7]].n_shingles.tolist() == [0, 0, 0] and by.loc[[2, 3, 7]].kept.all()
    lost = rows[rows.doc_id.isna()]
    assert len(lost) == 2 and lost.component_id.isna().all() and lost.kept.all()
    assert near_duplicates(none).count() == 0


def test_tokens(docs, none):
    from quillon.llm.tokenout import token_ids

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = token_ids(clashing(docs, "key", "part", "start"), path).toPandas()
    assert len(rows) == len(ROWS)
    rows = rows.sort_values("start", kind="stable")
    assert rows.start.tolist() == [0, *np.cumsum(rows.n_tokens)[:-1].tolist()]
    assert rows.doc_id.isna().tolist()[:2] == [True, True] and rows.doc_id.dropna().is_monotonic_increasing
    assert rows[rows.doc_id == 2].ids_crc32.item() == zlib.crc32(np.array([2], "<u4").tobytes())
    assert token_ids(none, path).count() == 0


def test_repeats(docs, none):
    from quillon.llm.suffix import remove_repeats

    rows = remove_repeats(clashing(docs, "id", "key", "row", "n_bytes"), payload="bytes", carry=["lang", "row"]).toPandas()
    assert len(rows) == len(ROWS) and set(rows.row) == {"mine"}
    by = rows.dropna(subset="doc_id").set_index("doc_id")
    assert by.loc[[12]].n_removed.item() == 29_999 and by.loc[[12]].n_spans.item() == 1 and bytes(by.loc[[12]].kept_bytes.item()) == b"x"
    unit = len("the word of the day is long and longer than before ")
    assert by.loc[[6]].n_removed.item() == len(LONG) - unit
    assert by.loc[[2]].kept_sha256.item() == hashlib.sha256(b"").hexdigest()
    assert remove_repeats(none).count() == 0


def test_main_text(spark):
    from quillon.llm.html import main_text

    pages = [(1, "http://a.b/c", "<article><p>x<p>y &amp z</article>"), (2, None, None), (None, "u", ""), (3, "http://a.b/d", "<p>" * 3000 + "deep"), (3, "http://a.b/d", "<p>" * 3000 + "deep"), (4, "//h", "a < b <!-- open"), (5, "//h", "<div>" * 3000 + "z")]
    rows = main_text(clashing(spark.createDataFrame(pages, "page_id bigint, url string, html string"), "key", "text", "block")).toPandas()
    got = {None if np.isnan(i) else int(i): t for i, t in zip(rows.page_id, rows.text, strict=True)}
    assert len(rows) == 7 and got == {1: "x\ny & z", 2: "", None: "", 3: "deep", 4: "a < b", 5: "z"}
    assert main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_style_trees_drop_what_a_host_repeats(spark):
    from quillon.llm.html import main_text

    page = lambda k: f"<body><div class=top>Our site since 1999</div><div class=story><p>Story {k} is told here.</div><div class=end>All rights</div>"
    pages = [(k, f"http://one.example/{k}", page(k)) for k in range(6)] + [(9, "http://two.example/", page(9))]
    rows = main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).toPandas().set_index("page_id").text
    assert rows[3] == "Story 3 is told here." and rows[9].startswith("Our site")


def test_warc(spark):
    from quillon.llm.warc import quarantine, read_archives, salvage, write_archives, write_record

    pages = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (5, "u", "x" * 200_000), (1, "u", "same")]
    df = clashing(spark.createDataFrame(pages, "page_id bigint, url string, html string"), "id", "sha", "first")
    archives = write_archives(df)
    rows = read_archives(archives, payload=True).toPandas()
    kinds = sorted((0 if np.isnan(i) else int(i), t, None if np.isnan(r) else int(r)) for i, t, r in zip(rows.page_id, rows.record_type, rows.refers_to, strict=True))
    assert kinds == [(0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None)]
    assert quarantine(archives).count() == 0
    assert write_archives(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    parts = [write_record(k, "u", b"body %d" % k, compress=k != 2) for k in range(5)]
    raw = bytearray(b"".join(parts))
    cut = len(parts[0])
    raw[cut + 40] ^= 255
    out = salvage(bytes(raw) + b"\x1f\x8b\x08 torn")
    assert [r.headers["warc-record-id"] for r in out.records] == [f"<urn:page:{k}>" for k in (0, 2, 3, 4)]
    assert [(a, b) for a, b, _ in out.gaps] == [(cut, cut + len(parts[1])), (len(raw), len(raw) + 8)]
    assert salvage(b"").records == [] and salvage(b"junk").gaps[0][:2] == (0, 4)


def test_leaks(docs, none, spark):
    from quillon.llm.decontaminate import find_leaks

    items = spark.createDataFrame([(1, "hello world, this is one small text of some words"), (2, None), (None, "a"), (3, "a"), (4, ""), (1, "hello world, this is one small text of some words")], "item_id bigint, text string")
    rows = find_leaks(clashing(docs, "item_ids", "row"), items).toPandas()
    assert len(rows) == len(ROWS) and set(rows.row) == {"mine"}
    assert {int(i) for i, k in zip(rows.doc_id, rows.kept, strict=True) if not k} == {1, 5}
    assert all(list(x) == [1] for x in rows[~rows.kept].item_ids)
    assert find_leaks(none, items).count() == 0 and find_leaks(docs, items.limit(0)).where("kept").count() == len(ROWS)


def test_language(docs, none):
    from quillon.llm.langid import identify

    rows = identify(clashing(docs, "language", "prior", "host")).toPandas()
    assert len(rows) == len(ROWS)
    gone = rows[~rows.kept]
    assert set(gone.doc_id.dropna()) >= {2, 3, 7, 11} and (gone[gone.text.isna()].language == "und").all()
    assert rows[rows.doc_id == 1].language.tolist() == ["en", "en"]
    assert identify(none).count() == 0


def test_language_of_pages(spark):
    from quillon.llm.langid import identify

    pages = spark.createDataFrame([(k, "abc def ghi", ("de", "en")[k % 2], f"http://x.example.org/{('de', 'en')[k % 2]}/{k}") for k in range(20)] + [(99, "abc def ghi", None, "http://x.example.org/de/1")], "doc_id bigint, text string, lang string, url string")
    rows = identify(pages, host=None, url="url", carry=["doc_id"]).toPandas().set_index("doc_id")
    assert rows.loc[99].language == "de" and rows.loc[3].language == "en"


def test_stages(spark, docs, none, sf_dir):
    import corpus_pipeline

    for table in (docs, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, clashing(table, "extra", "row", "kept"), sf_dir)
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).count() == table.count()
    kept = corpus_pipeline.STAGES[1][1](spark, docs, sf_dir).toPandas()
    assert 5 not in set(kept.doc_id) and kept.doc_id.isna().sum() == 2
    cut = corpus_pipeline.STAGES[2][1](spark, docs, sf_dir).toPandas()
    assert len(cut) == len(ROWS) and cut[cut.doc_id == 12].text.item() == "x" and cut[cut.doc_id == 12].n_chars.item() == 1
