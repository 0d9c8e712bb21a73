"""Each contract query on the small tables, against its SQL or against brute force."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from quillon.llm.oracles import ORACLE_SQL
from quillon.llm.queries import QUERIES


def docs_of(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, sf_dir, duck, same, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df())


def test_op2_is_tiktoken(spark, sf_dir):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = QUERIES["op2_byte_bpe"](spark, sf_dir).toPandas().set_index("doc_id")
    for i, t in docs_of(sf_dir)[["doc_id", "text"]].itertuples(index=False):
        ids = np.array(enc.encode_ordinary(t), "<u4")
        assert tuple(got.loc[i]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op3_base_and_model(spark, sf_dir):
    from quillon.llm.lm import adaptive

    docs, got = docs_of(sf_dir), QUERIES["op3_lm"](spark, sf_dir).toPandas().set_index("doc_id")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs.doc_id}
    seen: Counter = Counter()
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        if not held[i]:
            seen.update(t.encode().lower().split() + [None])
    n, v = sum(seen.values()), len(seen)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        tokens, r = t.encode().lower().split() + [None], got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(seen[x] > 0 for x in tokens), n)
        assert r.base_score == pytest.approx(sum(np.log10((seen[x] + 1) / (n + v + 1)) for x in tokens), rel=1e-9)
    some = docs.head(12)
    want = adaptive([t.encode() for t in some.text], [t.encode() for i, t in zip(docs.doc_id, docs.text, strict=True) if not held[i]])
    assert list(got.loc[some.doc_id].score) == pytest.approx(want, rel=1e-9)


def test_op5_is_the_tokenizers_library(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = QUERIES["op5_token_ids"](spark, sf_dir).toPandas().set_index("doc_id"), 0
    for i, x in docs_of(sf_dir)[["doc_id", "text"]].itertuples(index=False):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        assert tuple(got.loc[i]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op7_is_the_article(spark, sf_dir):
    import html
    import re

    pages, got = pd.read_parquet(f"{sf_dir}/pages.parquet"), QUERIES["op7_main_text"](spark, sf_dir).toPandas().set_index("page_id")
    for p, h in zip(pages.page_id, pages.html, strict=True):
        parts = re.split(r"</?(?:p|h1)>", re.search(r"(?s)<article>(.*)</article>", h)[1].replace("<br>", " "))
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", y)).split()) for y in parts) if x)
        assert got.loc[p].text == want and got.loc[p].n_chars == len(want)


def test_op9_finds_the_items(spark, sf_dir):
    """Every item against every text by plain edit distance."""
    norm = lambda s: s.translate(LOWER).translate(PUNCTUATION).split()
    items = [(i, norm(t)) for i, t in pd.read_parquet(f"{sf_dir}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False)]
    got = QUERIES["op9_decontaminate"](spark, sf_dir).toPandas().set_index("doc_id")
    docs = docs_of(sf_dir)
    want = {i: [k for k, x in sorted(items) if found(x, norm(t))] for i, t in docs[["doc_id", "text"]].itertuples(index=False)}
    assert len(got) == len(docs) and {i: list(x) for i, x in got.item_ids.items()} == want and any(want.values())


def test_op10_fuses_the_evidence(spark, sf_dir):
    """The posterior of every document by plain numpy, and the languages of texts that the model was not fitted on."""
    from quillon.llm.langid import DECLARED, HOST, PARTS, SITE, fit, identify, likelihoods

    docs = docs_of(sf_dir).set_index("doc_id")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, logs = fit(table)
    got = QUERIES["op10_langid"](spark, sf_dir).toPandas().set_index("doc_id").loc[docs.index]
    raw = [t.encode() for t in docs.text]
    sums, count = likelihoods(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), logs)
    own = np.exp(sums - sums.max(axis=1, keepdims=True))
    own = np.rint(own / own.sum(axis=1, keepdims=True) * PARTS) / PARTS * (count > 0)[:, None]
    mass = lambda of: {k: own[(of == k).to_numpy()].sum(axis=0) for k in of.unique()}
    site = docs.source.str.split(".").str[-2:].str.join(".")
    everywhere, hosts, sites = (own.sum(axis=0) + 1) / (own.sum() + len(langs)), mass(docs.source), mass(site)
    smooth = lambda x, base, weight: (x + weight * base) / (x.sum() + weight)
    for k, (i, d) in enumerate(docs.iterrows()):
        post = sums[k] + np.log(smooth(hosts[d.source], smooth(sites[site[i]], everywhere, SITE), HOST))
        post += np.log([DECLARED if x == d.lang else (1 - DECLARED) / (len(langs) - 1) for x in langs])
        p = np.exp(post - post.max()) / np.exp(post - post.max()).sum()
        assert got.n_trigrams[i] == count[k] and (count[k] == 0 or (got.language[i], got.text_language[i]) == (langs[p.argmax()], langs[sums[k].argmax()]) and got.confidence[i] == pytest.approx(p.max(), rel=1e-6))
    half = fit(table.where("doc_id % 2 = 0"))
    rest = identify(table.where("doc_id % 2 = 1"), declared=None, model=half).toPandas().set_index("doc_id")
    same = rest.language == docs.lang.loc[rest.index]
    assert same[rest.n_trigrams >= 40].mean() > 0.97


def test_pages_languages(spark, sf_dir):
    """Markup and address decide where they agree; a page whose text and address outvote its markup is named by them."""
    import re

    from quillon.llm.langid import fit, identify
    pages, got = pd.read_parquet(f"{sf_dir}/pages.parquet").set_index("page_id"), QUERIES["pages_langid"](spark, sf_dir).toPandas().set_index("page_id")
    said = pages.html.map(lambda h: re.search(r'<html lang="(\w+)', h)[1])
    assert len(got) == len(pages) and (got.loc[pages.index].language == said).mean() > 0.97
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = "der die das und nicht mit ein eine ist von zu in den auf für"
    rows = [(1, "https://a.example.de/x", None, "und"), (2, "https://a.example.com/en/x", "en", "und"), (3, "https://b.example.fr/", "fr", None), (4, None, None, text), (5, "https://c.example.at/", "en", text)]
    out = identify(spark.createDataFrame(rows, "page_id bigint, url string, declared string, text string"), declared="declared", host=None, url="url", model=model).toPandas().set_index("page_id")
    assert out.language.tolist() == ["de", "en", "und", "de", "de"] and out.kept.tolist() == [True, True, False, True, True]


def test_pipeline(spark, sf_dir):
    """The stages by brute force: the plain form of each on the rows the one before kept."""
    import corpus_pipeline
    import tiktoken

    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    docs = docs_of(sf_dir)
    words = {i: t.translate(LOWER).split() for i, t in zip(docs.doc_id, docs.text, strict=True)}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in words.items()}
    lead = {i: i for i in sets}

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((root(a), root(b)))
                lead[y] = x
    kept = [(i, t) for i, t in zip(docs.doc_id, docs.text, strict=True) if root(i) == i and any(c.isalpha() for c in t)]
    first: dict[bytes, tuple[int, int]] = {}
    raw = {i: t.encode() for i, t in kept}
    for i, b in sorted(raw.items()):
        for p in range(len(b) - 99):
            first.setdefault(b[p : p + 100], (i, p))
    left = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (i, p):
                gone[p : p + 100] = True
        left[i] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    norm = lambda s: s.translate(LOWER).translate(PUNCTUATION).split()
    items = [norm(t) for t in pd.read_parquet(f"{sf_dir}/benchmark.parquet").text]
    clean = {i for i, t in left.items() if not any(found(x, norm(t)) for x in items)}
    assert set(got.doc_id) == clean and got.doc_id.is_unique and got.round_trip.all()
    for i, n, ids_ in got[["doc_id", "n_tokens", "ids"]].itertuples(index=False):
        assert np.frombuffer(ids_, "<u4").tolist() == enc.encode_ordinary(left[i]) and n == len(ids_) // 4


LOWER = {c: c + 32 for c in range(65, 91)}
PUNCTUATION = {c: " " for c in range(128) if not chr(c).isalnum()}


def found(item: list[str], text: list[str]) -> bool:
    """Is some stretch of text within a fifth of the item's words of it?"""
    if len(item) < 5 or len(set(item) & set(text)) < 0.8 * len(set(item)) - 1:
        return False
    line = np.zeros(len(text) + 1, dtype=int)
    other, ramp = np.array(text, dtype=object), np.arange(len(text) + 1)
    for k, w in enumerate(item):
        new = np.concatenate([[k + 1], np.minimum(line[:-1] + (other != w), line[1:] + 1)])
        line = np.minimum.accumulate(new - ramp) + ramp
    return bool(line.min() <= len(item) * 20 // 100)
