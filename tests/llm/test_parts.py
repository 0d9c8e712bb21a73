"""The pieces the operators are made of, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_repetition(words):
    from quillon.llm.quality import MOST, measure

    out = measure(" ".join(words))
    seen: dict = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    assert out[5] == len({k + j for v in seen.values() if len(v) > 1 for k in v for j in range(3)})
    for n, chars in zip(MOST, out[6:], strict=True):
        before, covered = set(), set()
        for k in range(len(words) - n + 1):
            gram = tuple(words[k : k + n])
            if gram in before:
                covered |= set(range(k, k + n))
            before.add(gram)
        assert chars == len(covered)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=14).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=80), st.integers(1, 9))
def test_loser_tree(strings, runs):
    from quillon.llm.suffix import front_code, front_decode, merge, shared_prefix

    dealt = []
    for k in range(runs):
        run = sorted(strings[k::runs])
        shared, rest = front_code(run)
        assert front_decode(shared, rest) == run
        dealt.append((run, shared))
    order, lcp = merge(dealt)
    got = [dealt[r][0][k] for r, k in order]
    assert got == sorted(strings)
    assert all(lcp[k] == shared_prefix(got[k - 1], got[k], 0) for k in range(1, len(got)))


def test_repeats_by_every_path(spark, monkeypatch):
    from quillon.llm import suffix

    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(50, 400))) for _ in range(12)]
    rows = [(rng.randint(0, 10**6) * 200 + k, "".join(rng.choice([rng.choice(pool)[rng.randint(0, 80) : rng.randint(90, 400)], "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 6)))) for k in range(120)]
    monkeypatch.setattr(suffix, "BLOCK", 20_000)
    first: dict = {}
    for i, t in sorted(rows):
        b = t.encode()
        for p in range(len(b) - 99):
            first.setdefault(b[p : p + 100], (i, p))
    for hot in (10**9, 5):
        got = {r.doc_id: bytes(r.kept_bytes) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), payload="bytes", hot=hot).collect()}
        for i, t in rows:
            b = t.encode()
            gone = np.zeros(len(b), bool)
            for p in range(len(b) - 99):
                if first[b[p : p + 100]] < (i, p):
                    gone[p : p + 100] = True
            assert got[i] == np.frombuffer(b, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_superminhash_is_unbiased(share):
    from quillon.llm.minhash import signatures

    rng, off = np.random.default_rng(1), []
    for _ in range(40):
        n = 200
        common = int(2 * n * share / (1 + share))
        u = rng.integers(0, 2**63, size=2 * n - common, dtype=np.uint64)
        a, b = u[:n], np.concatenate([u[:common], u[n:]])
        s = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        off.append((s[0] == s[1]).mean() - common / len(u))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_superminhash_varies_less_than_minhash():
    from quillon.llm.common import mix
    from quillon.llm.minhash import SLOTS, signatures

    rng, ours, plain = np.random.default_rng(3), [], []
    salt = rng.integers(0, 2**63, size=SLOTS, dtype=np.uint64)
    for _ in range(1500):
        u = rng.integers(0, 2**63, size=27, dtype=np.uint64)
        a, b = u[:20], np.concatenate([u[:13], u[20:]])
        s = signatures(np.concatenate([a, b]), np.array([0, 20, 40]))
        ours.append((s[0] == s[1]).mean())
        plain.append((mix(a[:, None] ^ salt).min(axis=0) == mix(b[:, None] ^ salt).min(axis=0)).mean())
    assert np.std(ours) < 0.85 * np.std(plain) and abs(np.mean(ours) - 13 / 27) < 0.01


def test_near_duplicates_by_every_path(spark, monkeypatch):
    from quillon.llm import minhash

    rng, vocabulary, rows = random.Random(4), [f"w{k}" for k in range(400)], []
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.choice([1, 2, 3, 50])):
            t = list(base)
            for _ in range(int(len(t) * rng.uniform(0, 0.12))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append(" ".join(t))
    rows = [(k * 7 % 1000, t) for k, t in enumerate(rows)]
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for i, t in rows}
    lead = {i: i for i in sets}

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((root(a), root(b)))
                lead[y] = x
    for few, members in ((8, 1024), (3, 10)):
        monkeypatch.setattr(minhash, "FEW", few)
        monkeypatch.setattr(minhash, "MEMBERS", members)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), size=2).collect()}
        assert got == {i: root(i) for i in sets}


def test_bpe_joins(monkeypatch):
    import base64

    import public_tokenizers
    import tiktoken

    from quillon.llm.bpe import coder

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    c = coder(path, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    rng = random.Random(2)
    for k in range(400):
        t = "".join(rng.choice("abé中 ainthe  \n\t1$") for _ in range(rng.randint(0, 200)))
        t = rng.choice(["a", "ab", "ha", "é", "=", "the"]) * rng.randint(1, 3000) if k % 20 == 0 else t.replace(" ", "") if k % 3 == 0 else t
        ids = c.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t) and c.decode(ids) == t.encode()


def test_bpe_of_very_long_words():
    import base64
    import time

    import public_tokenizers
    import tiktoken

    from quillon.llm.bpe import coder

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    c = coder(path, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    rng = random.Random(3)
    for t in ("".join(rng.choice("etaoinshrdlu") for _ in range(100_000)), "ab" * 20_000, "a" * 30_001):
        begun = time.time()
        ids = c.encode(t)
        assert time.time() - begun < 20
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t) and c.decode(ids) == t.encode()


def test_salvage_of_hostile_archives():
    import time

    from quillon.llm.warc import salvage, write_record

    # a record inside the payload of a damaged one is not taken for a record
    inner = write_record(77, "u", b"inner", compress=False)
    raw = bytearray(write_record(1, "u", b"before " + inner + b" after", compress=False) + write_record(2, "u", b"fine", compress=False))
    raw[raw.index(b"before")] ^= 1
    out = salvage(bytes(raw))
    assert [r.headers["warc-record-id"] for r in out.records] == ["<urn:page:2>"] and len(out.gaps) == 1
    for false in (b"WARC/1.0\r\n" * 40_000, b"WARC/1.0\r\nA: b\r\n" * 20_000, b"WARC/1.0\r\n" + b"A: b\r\n" * 60_000):
        begun = time.time()
        out = salvage(false + write_record(3, "u", b"x", compress=False))
        assert [r.headers["warc-record-id"] for r in out.records] == ["<urn:page:3>"] and out.gaps[0][:2] == (0, len(false)) and time.time() - begun < 5


def test_salvage_inside_members():
    """Ten records in one member: a damaged payload costs one of them, a cut or a broken stream those from there on."""
    import gzip

    from quillon.llm.warc import salvage, write_record

    parts = [write_record(k, "u", b"body %d " % k + bytes(np.random.default_rng(k).integers(0, 256, 900, dtype=np.uint8)), compress=False) for k in range(10)]
    raw = bytearray(b"".join(parts))
    raw[raw.index(b"body 4") + 3] ^= 1
    after = write_record(77, "u", b"after")
    ids = lambda out: [r.headers["warc-record-id"] for r in out.records]
    page = lambda *ks: [f"<urn:page:{k}>" for k in ks]
    whole = gzip.compress(bytes(raw))
    out = salvage(whole + after)
    start = sum(map(len, parts[:4]))
    assert ids(out) == page(0, 1, 2, 3, 5, 6, 7, 8, 9, 77)
    assert out.gaps == [(0, len(whole), f"bytes {start} to {start + len(parts[4])} of the member: block digest does not fit")]
    sound = gzip.compress(b"".join(parts))
    for tail in (b"", after):
        out = salvage(sound[:-20] + tail)
        assert ids(out)[:9] == page(*range(9)) and out.gaps[0][:2] == (0, len(sound) - 20) and ("<urn:page:77>" in ids(out)) == bool(tail)
    broken = bytearray(sound)
    broken[len(sound) // 2] ^= 255
    out = salvage(bytes(broken) + after)
    assert ids(out)[:4] == page(0, 1, 2, 3) and ids(out)[-1] == "<urn:page:77>" and out.gaps[0][:2] == (0, len(sound))
    # without a digest of its own, a record of a member that fails its checksum is not trusted
    bare = re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", b"".join(parts))
    assert ids(salvage(gzip.compress(bare)[:-8])) == [] and len(ids(salvage(gzip.compress(bare)))) == 10


def test_salvage_is_linear_on_false_members():
    import time
    import zlib

    from quillon.llm.warc import salvage, write_record

    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    block = stored.compress(bytes(400_000)) + stored.flush()
    for false in (b"\x1f\x8b\x08\0\0\0\0\0\0\xff\1" * 8000 + block, b"\x1f\x8b\x08\x08aaaaaa" * 3000, (b"\x1f\x8b\x08\0\0\0\0\0\0\xff\0\x20\0\xdf\xff" + b"x" * 32) * 8000):
        begun = time.time()
        out = salvage(false + write_record(3, "u", b"x"))
        assert [r.headers["warc-record-id"] for r in out.records] == ["<urn:page:3>"] and time.time() - begun < 10


def test_foreign_archives(spark):
    from quillon.llm.warc import read_archives

    body = b"HTTP/1.1 200 OK\r\n\r\nhi"
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Length: many\r\nWARC-Block-Digest: md5:00\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    row = read_archives(spark.createDataFrame([(1, bytearray(raw))], "archive bigint, data binary")).first()
    assert (row.page_id, row.payload_bytes, row.record_type) == (None, 2, "response")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcAB ", max_size=30), min_size=1, max_size=12), st.lists(st.text("abcd ", max_size=20), min_size=1, max_size=4))
def test_ppm(train, other):
    from quillon.llm.lm import SYMBOLS, adaptive, codes, count_codes, ppm, spread

    every = [t.encode() for t in (*train, *other)]
    raw, at = np.frombuffer(b"".join(every), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in every])])
    value, to = codes(raw, at)
    known, count = count_codes(value, np.arange(len(value)) < to[len(train)])
    one = np.zeros((256, SYMBOLS), np.int64)
    np.add.at(one, (known >> 9 & 255, known & 511), count)
    log = np.zeros(len(known))
    for g in np.unique(known >> 9 & 65535):
        mine = (known >> 9 & 65535) == g
        log[mine] = ppm(known[mine], count[mine], one)
    assert spread(value, known, log).tolist() == log[np.searchsorted(known, value)].tolist()
    got = np.add.reduceat(spread(value, known, log), to[:-1])
    assert got.tolist() == pytest.approx(adaptive(every, every[: len(train)]))


def test_ppm_probabilities_sum_to_one():
    from quillon.llm.lm import adaptive

    text = [b"abracadabra", b"abba"]
    one = [adaptive([b"ab" + bytes([k])], text)[0] for k in range(256) if not 65 <= k <= 90]
    before = adaptive([b"ab"], text)[0]
    assert len(one) == 230 and before < 0  # all continuations are scored; each holds an end of its own


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 60_000), max_size=6)), max_size=60))
def test_shards(rows):
    from quillon.llm.tokenout import Shard, build_shard

    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    s = Shard(build_shard([k for k, _ in rows], [np.array(i, "<u2").tobytes() for _, i in rows], 2))
    assert [s.ids(k).tolist() for k in range(len(rows))] == [i for _, i in rows]
    count = Counter(k for k, _ in rows if k is not None)
    keys = np.array(list(count), dtype=np.int64)
    place, many = s.find(keys)
    assert [rows[p][0] for p in place] == keys.tolist() and many.tolist() == list(count.values())
    absent = np.setdiff1d(np.arange(1000, 1100), keys)
    assert (s.find(absent)[0] == -1).all()


def test_leaks_with_edits():
    from quillon.llm.decontaminate import Items, search

    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 60))] for _ in range(80)]
    found = Items(list(range(80)), [" ".join(x) for x in items], 80, 5)
    texts, want = [], []
    for k in range(400):
        j = rng.randrange(80)
        w = list(items[j])
        for _ in range(len(w) * 20 // 100):
            p, kind = rng.randrange(len(w)), rng.random()
            if kind < 0.34:
                w[p] = rng.choice(vocabulary)
            elif kind < 0.67:
                w.insert(p, rng.choice(vocabulary))
            else:
                w.pop(p)
        around = [rng.choice(vocabulary) for _ in range(40)]
        texts.append(" ".join(around[:20] + w + around[20:]))
        want.append((k, j))
    raw = [t.encode() for t in texts]
    row, item = search(found, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    got = set(zip(row.tolist(), item.tolist(), strict=True))
    assert len(got & set(want)) >= 0.98 * len(want) and len(got - set(want)) <= 2
    # no bucket, no candidate
    found.buckets.table[:] = False
    assert not len(search(found, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))[0])


def test_long_items_are_found_by_a_chunk():
    from quillon.llm.decontaminate import Items, search

    rng = random.Random(7)
    items = [" ".join(rng.choice("the of a to in it is was for on".split() + [f"w{k}" for k in range(200)]) for _ in range(n)) for n in (64, 65, 300, 5000)]
    texts = ["so it begins " + " ".join("changed" if k % 6 == 3 else w for k, w in enumerate(x.split())) + " and ends" for x in items] + ["changed " * 400, items[2][: len(items[2]) // 2], items[3] + " " + items[0], ""]
    raw = [t.encode() for t in texts]
    row, item = search(Items([0, 1, 2, 3], items, 80, 5), np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert list(zip(row.tolist(), item.tolist(), strict=True)) == [(0, 0), (1, 1), (2, 2), (3, 3), (6, 0), (6, 3)]


def test_blocks_of_items_find_what_one_finds(spark, sf_dir, monkeypatch):
    from quillon.llm import decontaminate

    docs, bench = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    one = decontaminate.find_leaks(docs, bench, carry=["doc_id", "text"]).toPandas().sort_values("doc_id")
    monkeypatch.setattr(decontaminate, "ITEMS", 15)
    many = decontaminate.find_leaks(docs, bench, carry=["doc_id", "text"]).toPandas().sort_values("doc_id")
    assert one.n_items.sum() > 0 and [list(map(list, x.item_ids)) for x in (one, many)][0] == list(map(list, many.item_ids)) and one.text.tolist() == many.text.tolist()


def test_edit_distance():
    from quillon.llm.decontaminate import distances

    rng = np.random.default_rng(3)
    for _ in range(50):
        item, region = rng.integers(1, 4, 6).astype(np.uint64), rng.integers(1, 4, 9).astype(np.uint64)
        best = 99
        for a in range(10):
            for b in range(a, 10):
                part, line = region[a:b], list(range(b - a + 1))
                for i, x in enumerate(item):
                    new = [i + 1]
                    for j, y in enumerate(part):
                        new.append(min(line[j] + (x != y), line[j + 1] + 1, new[j] + 1))
                    line = new
                best = min(best, line[-1])
        assert distances(item[None], np.array([6]), region[None])[0] == best


def thue_morse(n):
    """Two words of n letters that share every polynomial hash modulo 2^64, whatever its base."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_of_equal_hashes_have_ids_of_their_own(n):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillon.llm.minhash import word_spans
    from quillon.llm.tokenout import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    a, b = thue_morse(n)
    raw = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    at = np.array([0, len(raw)])
    assert len(set(word_spans(raw, at, plain=True)[0].tolist())) == 1 and len(set(word_spans(raw, at)[0].tolist())) == 2
    batch = [f"one {a} two {b} {a}", b, a, f"{b} {a} {b}", "hello <|endoftext|> world", "<|startoftext|>", f"<|ENDOFTEXT|> {b}", ""]
    t = Tokenizer.from_file(path)
    got = [np.frombuffer(x, f"<u{Encoder(path).width}").tolist() for x in Encoder(path)(batch)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in batch]


def test_texts_of_words_of_equal_hashes_are_not_linked(spark):
    from quillon.llm.minhash import near_duplicates

    a, b = thue_morse(1024)
    rows = near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y"), (5, a)], "doc_id bigint, text string"), size=2).toPandas().set_index("doc_id")
    assert rows.component_id[[1, 2, 3, 4, 5]].tolist() == [1, 2, 3, 4, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=20).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=1, max_size=12))
def test_same_bytes(words):
    from quillon.llm.common import same_bytes

    at = np.cumsum([0, *map(len, words)])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    size = np.minimum(np.diff(at)[a], np.diff(at)[b])
    got = same_bytes(np.frombuffer(b"".join(words), np.uint8), at[a], at[b], size)
    assert got.tolist() == [words[x][:n] == words[y][:n] for x, y, n in zip(a, b, size, strict=True)]


def test_as_bytes_of_slices_and_nulls():
    from quillon.llm.common import as_bytes

    raw, at = as_bytes(pa.array(["ab", None, "é", ""]).slice(1))
    assert raw.tobytes() == "é".encode() and at.tolist() == [0, 0, 2, 2]
