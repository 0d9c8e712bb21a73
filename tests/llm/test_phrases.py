"""Collocations: suffix arrays and counts against loops, ties and edges, and the contract query against SQL."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pytest

from quillon.llm import phrases as p
from quillon.llm.oracles import ORACLE_SQL
from quillon.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", x) for x in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def reference(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    hidden, best = set(), defaultdict(list)
    for (lang, ws), a in candidates.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                if 100 * a >= 80 * f[lang, ws[i : i + k]]:
                    hidden.add((lang, ws[i : i + k]))
    for (lang, ws), a in candidates.items():
        score, k = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        if (lang, ws) not in hidden:
            best[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, found in best.items() for i, x in enumerate(sorted(found)[:top]))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_suffix_array_and_intervals():
    rng = np.random.default_rng(0)
    for n, vocabulary in ((0, 3), (1, 3), (50, 1), (4000, 3), (4000, 60)):
        ids = np.append(rng.integers(0, vocabulary + 1, n), 0).astype(np.int32)
        at = p.suffix_array(ids)
        piece = lambda k: tuple(ids[k : k + int(np.argmin(ids[k:]))][:4])  # noqa: E731, B023
        assert [piece(k) for k in at] == sorted(piece(k) for k in np.flatnonzero(ids))
        for k, (grams, counts) in enumerate(p.intervals(ids), 1):
            want = Counter(tuple(ids[i : i + k]) for i in range(len(ids) - k + 1) if ids[i : i + k].all())
            assert dict(zip(map(tuple, grams.tolist()), counts.tolist(), strict=True)) == want


def test_word_ids_cut_pieces_and_texts():
    known = defaultdict(count(1).__next__)
    known[b","] = 0
    ids = p.word_ids([b"A b.a\tB", b"", b"a\x0bb\r\nc\x1cd"], known)
    names = {v: k for k, v in known.items()}
    words, now = [], []
    for k in ids.tolist():
        if k:
            now.append(names[k])
        elif now:
            words.append(now)
            now = []
    assert words == [[b"a", b"b"], [b"a", b"b"], [b"a"], [b"b"], [b"c\x1cd"]]


@pytest.mark.parametrize("shard,bucket", [(16 << 20, 8 << 20), (700, 400)])
def test_against_loops(spark, shard, bucket):
    """Many shards and buckets give what one gives; near ties, overlaps and phrases inside phrases are there."""
    rng = np.random.default_rng(7)
    words = ["an", "AN", "of", "Übung", "x", "new", "york", "city", "-", "(a"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) + rng.choice([".", "! ", "\n", "", ",b"]) for _ in range(800)]
    texts += ["new york city hall. " * 3, "a a a a a a a a a a", "New\tYork  city;x"] * 12
    rows = [(k, t, [None, "en", "de", "und"][k % 4 if k % 7 else 1]) for k, t in enumerate(texts)]
    rows += [(None, None, "en"), (1, "", None), (2, " \t", "fr"), (3, "rare words here", "fr")] + rows[:5]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' phrase", "'mine' rank", "'mine' words").repartition(4)
    got = rows_of(p.collocations(df, shard=shard, bucket=bucket))
    assert got == reference(rows) and len(got) > 50
    assert rows_of(p.collocations(df, least=3, top=7, shard=shard, bucket=bucket)) == reference(rows, 3, 7)


def test_edges(spark):
    long = "one two three four five " * 20_000
    got = rows_of(p.collocations(spark.createDataFrame([(1, long, "en")], SCHEMA)))
    assert got == reference([(1, long, "en")]) and got[0][6] == 100_000
    assert p.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert p.collocations(spark.createDataFrame([(1, None, None), (2, "", "en")], SCHEMA)).count() == 0


def test_query(spark, sf_dir, duck):
    got = QUERIES["op13_phrases"](spark, sf_dir)
    want = duck.sql(ORACLE_SQL["op13_phrases"]).df()[["lang", "rank", "phrase", "a", "l", "r", "n", "score"]]
    assert rows_of(got) == sorted(map(tuple, want.itertuples(index=False)))
