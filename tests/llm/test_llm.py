import hashlib
import re
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import byte_bpe, common, exact_dedup, language_id, license_scan, mtree_search, near_copies, packing, pretokens, registry, simhash, token_files, toxicity, url_filter, vocabularies
from gridloom.session import ship

from test_near_copies import brute_kept

SPACE = re.compile(r"[\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\t ", "a", "The  cat\tsat", "The cat sat", "the CAT sat on the mat", "é" * 300, "x" * 9000, "word " * 4000, "l'été 's 're x's\n's 12½ 你好😀", "The cat sat", "<|endoftext|> tail", "a\u0301 Σ ΟΔΟΣ İ"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name long, level int, ids binary, fp long, h1 long, uses long, rank int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, long ones, ties, repeated rows, a null id and columns whose names clash with inner ones."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, "The  cat\tsat"), (5, "The  cat\tsat"), (None, "The cat sat"), (None, None)]
    return ship(spark).createDataFrame([(i, t, None if k % 3 else "en", None, None, k, k, b"x", k, k, k, k) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_library_encoder(name):
    rng = np.random.default_rng(0)
    letters = list("ab Z's'tre'll ve 12٣ ½²\n\t éÉ'!\"-_Σσςİ你好😀é\u00a0\u3000'd'm \r")
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(2000)]
    ids, counts = vocabularies.library_encoder(P.path(name))(texts)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == library_ids(name, text), text


def library_ids(name, text, cache={}):  # noqa: B006
    if name not in cache:
        cache[name] = library(name)
    return cache[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_texts_are_encoded_in_pieces(name, monkeypatch):
    monkeypatch.setattr(pretokens, "CHUNK_CHARS", 40)
    rng = np.random.default_rng(1)
    letters = list("abZ's're 12٣\n\t éÉ'!-_Σσς你好😀é\u0301\u00a0 \r")
    for _ in range(100):
        text = "".join(rng.choice(letters, 600))
        assert len(pretokens.text_pieces(text, 40)) > 3 and "".join(pretokens.text_pieces(text, 40)) == text
        assert vocabularies.library_encoder(P.path(name))([text])[0].tolist() == library_ids(name, text)


def test_word_hash_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(pretokens, "_mix", lambda: np.ones(0x110000, np.uint64))
    cp = pretokens.code_points("abc abd abc xyz")
    begin, end = pretokens.words(cp, np.array([15]), False)
    codes, rep = pretokens.distinct(cp, begin, end)
    words = ["abc abd abc xyz"[a:b] for a, b in zip(begin, end)]
    assert [words[rep[c]] for c in codes] == words


def test_packing(odd, empty):
    cap = packing.Capacity()
    got = packing.pack_documents(odd, P.path("byte_bpe_50k.json"), 0, cap).collect()
    want = []
    for doc_id, text in texts_of(odd):
        ids = library_ids("byte_bpe_50k.json", text) + [0]
        first = len(ids) % 2048 or min(2048, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0
    whole = packing.sequences(packing.pack_documents(odd, P.path("byte_bpe_50k.json"), keep_ids=True)).collect()
    assert sum(len(r.ids) // 4 for r in whole) == sum(w[3] for w in want)


@pytest.mark.parametrize("cap", [packing.Capacity(100, 3, 5000), packing.Capacity(100, 100, 10_000, score="dot"), packing.Capacity(64, 64, 4096)])
def test_plan_respects_every_capacity(cap):
    rng = np.random.default_rng(1)
    top = min(cap.tokens, int(cap.attention**0.5))
    histogram = dict(zip(*(x.tolist() for x in np.unique(rng.integers(1, top + 1, 3000), return_counts=True)), strict=True))
    bins = {}
    for length, lo, hi, each, sequence, offset in packing.plan(histogram, cap).tolist():
        for rank in range(lo, hi):
            bins.setdefault(sequence + (rank - lo) // each, []).append((offset + (rank - lo) % each * length, length))
    assert sum(len(b) for b in bins.values()) == 3000
    for own in bins.values():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert at <= cap.tokens and len(own) <= cap.documents and sum(n * n for _, n in own) <= cap.attention
    if cap.documents >= cap.tokens:
        assert len(bins) <= 1.02 * sum(k * n for k, n in histogram.items()) / cap.tokens + 2
    with pytest.raises(ValueError):
        packing.plan({cap.tokens + 1: 1}, cap)


def test_byte_bpe(odd, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    pairs = byte_bpe.load(path)
    tok = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    done = byte_bpe.decode_documents(byte_bpe.encode_documents(odd, path), path)
    got = sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids), bytes(r.decoded)) for r in done.collect())
    want = sorted((i if i is not None else -1, np.array(tok.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in texts_of(odd))
    assert got == want
    assert byte_bpe.encode_documents(empty, path).count() == 0
    long = "abcab" * 500
    assert pairs.merge_long(long.encode()) == tok.encode_ordinary(long)


@pytest.mark.parametrize("values", [[5], [0, 2**32 - 1], list(range(2000)), [7] * 1024, [1, 1, 1, 60000] * 50])
def test_blocks_round_trip(values):
    v = np.array(values[: token_files.BLOCK], np.uint32)
    assert (token_files.unpack_block(token_files.pack_block(v), len(v)) == v).all()


def test_token_files(odd, empty, spark, tmp_path):
    name = "word_bpe_49k.json"
    shards = token_files.write_shards(odd, "file://" + str(tmp_path / "t"), P.path(name), 2)
    got = token_files.read_shards(shards).collect()
    docs = texts_of(odd)
    assert len(got) == len(docs)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids) // 4
    ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)
    want = sorted((-1 if i is None else i, crc(library_ids(name, t) + [2])) for i, t in docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(r.ids)) for r in got) == want
    assert token_files.token_files(empty, P.path(name), 2).count() == 0
    with open(shards.first().path.removeprefix("file://"), "rb") as file:
        reader = token_files.ShardReader(file)
        assert (np.concatenate([reader.document(i) for i in range(len(reader.doc_ids))]) == reader.ids(0, reader.n)).all()


def test_licenses(spark, empty):
    rows = [
        (1, "some words before. Licensed under the Apache License, Version 2.0. And some after."),
        (2, "RELEASED under\nthe   MIT license"),
        (3, "Released under the terms of nothing"),
        (4, None),
        (5, ""),
        (6, "x " * 5000 + "All rights reserved." + " y" * 5000),
        (6, "Licensed under CC BY-NC 4.0."),
        (None, "All rights reserved"),
        (7, " ".join(license_scan.TEMPLATES.values())),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x")).withColumn("class", F.lit(1))
    got = {(r.doc_id, r.license): r.containment for r in license_scan.licenses(docs).collect()}
    want = {}
    for i, t in rows:
        for (_, name), v in license_scan.brute_force({0: t}).items():
            want[i, name] = max(v, want.get((i, name), 0))
    assert got == want and (1, "Apache-2.0") in got and (2, "MIT") in got and (6, "all-rights-reserved") in got and (None, "all-rights-reserved") in got
    assert all((7, name) in got for name in license_scan.TEMPLATES)
    assert license_scan.licenses(empty).count() == 0


def test_licenses_at_every_position(spark):
    """Whole copies are found wherever they begin, whole license texts too; nothing is found that isn't there."""
    rng = np.random.default_rng(0)
    filler = [f"w{k}" for k in range(50)]
    names = list(license_scan.TEMPLATES)
    rows, whole = [], []
    for k in range(150):
        name = names[k % len(names)]
        before, after = (" ".join(rng.choice(filler, rng.integers(0, 60))) for _ in range(2))
        words = license_scan.TEMPLATES[name].split()
        if k >= 100:  # a changed word
            words[int(rng.integers(0, len(words)))] = "changed"
        else:
            whole.append((k, name))
        rows.append((k, f"{before} {' '.join(words).upper()} {after}"))
    rows += [(200, f"{license_scan.TEMPLATES['MIT-text']} {license_scan.TEMPLATES['ISC-text']} " * 30), (201, license_scan.TEMPLATES["MIT-text"][:300])]
    rows += [rows[0], rows[0]]  # repeated rows
    got = {(r.doc_id, r.license): r.containment for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[key] == 1.0 for key in whole)
    assert got == license_scan.brute_force(dict(rows))
    assert set(got) <= set(license_scan.brute_force(dict(rows), step=1))
    with pytest.raises(ValueError, match="short"):
        license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"short": "one"})
    for n in range(2, 2000):
        size, step = license_scan.size_class(n)
        assert n <= size - step + 1 and 2 * n >= size and step >= 1


def test_language(spark, odd, empty):
    rng = np.random.default_rng(0)
    stems = {"en": ["the", "and", "ing", "tion", "wh"], "fr": ["eau", "que", "ment", "é", "oi"], "de": ["sch", "ung", "ö", "keit", "ein"]}
    rows = [(i, " ".join("".join(rng.choice(stems[g], 2)) for _ in range(rng.integers(3, 60))), g) for i in range(600) for g in [list(stems)[i % 3]]]
    docs = ship(spark).createDataFrame(rows + [(1000 + i, t, None) for i, t in enumerate(ODD)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].lang_pred == g for i, g in held]) > 0.97
    for i, t in enumerate(ODD):
        r = got[1000 + i]
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id < 600").count() == 600
    assert language_id.predict(empty, model).count() == 0
    none = language_id.fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}
    # what a text is called does not matter
    again = language_id.predict(docs.withColumn("doc_id", F.col("doc_id") + 7).withColumn("lang", F.lit("fr")), model)
    assert {r.doc_id - 7: (r.lang_pred, r.score) for r in again.collect()} == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(0)
    plain = ["the", "cat", "sat", "tree", "river", "stone", "apple", "green"]
    bad = ["grok", "blarg", "zonk"]
    rows, labels = [], []
    for i in range(800):
        words = rng.choice(plain, rng.integers(5, 80)).tolist()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)) + ("s" if i % 8 else ""))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([*labels, (None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == t for i, t in held]) > 0.97
    assert model.score(["the gr0k blаrg zonk"])[0] > 0.5  # a digit and a Cyrillic letter
    assert toxicity.keep_clean(docs, model).count() == sum(r.predicted == 0 for r in got.values())
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(empty, model).count() == 0
    seed = toxicity.fit(docs, table.filter("false"))
    assert seed.score(["you stupid idiot"])[0] > 0.5 > seed.score(["a kind word"])[0]
    spared = toxicity.Model([" clown "], np.array([3.0]), toxicity.DEFAULT)
    assert spared.evidence("a clown fish") == (0.0, 0.0, 0.0) and spared.evidence("a clown")[0] > 0


def test_language_sample_of_repeated_rows_and_far_texts(spark):
    rng = np.random.default_rng(1)
    stems = {"en": ["the", "and", "ing", "tion", "wh"], "fr": ["eau", "que", "ment", "é", "oi"]}
    text = lambda g: " ".join("".join(rng.choice(stems[g], 2)) for _ in range(40))
    rows = [(1, "ñandú llama " * 10, "es")] * 3000 + [(1, None, "xx")] * 50 + [(i, text(g), g) for g in stems for i in range(2, 400)] + [(None, "nobody", "zz")]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, language_id.Settings(sample=100))
    assert set(model.languages) == {"en", "es", "fr", "xx"}  # those of one repeated text too
    picked = common.sample_of(docs.filter("lang is not null").withColumn("hash", common.text_hash("s")), docs, "lang", 100, "s").groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in picked} == {"en": 100, "fr": 100, "es": 1, "xx": 1}
    far = ["zxqv kjwq vvkz qqxj zzkk " * 20, "人人生而自由，在尊严和权利上一律平等。" * 5]
    assert model.predict(far)["rejected"].all()
    assert not model.predict([text("en"), text("fr"), "ñandú llama " * 10])["rejected"].any()
    assert language_id.keep_identified(docs, model).filter("lang in ('en', 'fr')").count() == 2 * 398


def test_trigram_counts(monkeypatch):
    texts = ["", "a", "l'été is here", None or "", "b" * 50, "Ab cd"]
    want = np.zeros((len(texts), 4096))
    for k, t in enumerate(texts):
        data = b" " + " ".join(re.findall(r"[^\W\d_]+", t)).lower().encode() + b" "
        for i in range(len(data) - 2):
            code = data[i] << 16 | data[i + 1] << 8 | data[i + 2]
            want[k, (code * 2654435761 % 2**32) >> 20] += 1
    for step in (1, 7, 10**6):
        monkeypatch.setattr(language_id, "STEP", step)
        got, letters = language_id.counts(texts, 4096)
        assert (got == want).all() and (letters > 0).tolist() == [bool(t.strip()) for t in texts]


def test_toxicity_of_odd_inputs(spark, odd, empty):
    labels = ship(spark).createDataFrame([(999, 1), (998, 0), (None, 1)], "doc_id long, toxic int")
    for docs in (empty, odd):  # labels of absent documents only
        assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == docs.count()
    repeated = spark.createDataFrame([(2, "you grok fool")] * 500 + [(3, "a fine day")] * 500 + [(3, None)] * 9, "doc_id long, text string")
    model = toxicity.fit(repeated, spark.createDataFrame([(2, 1), (3, 0), (3, None)], "doc_id long, toxic int"))
    assert toxicity.score(repeated, model).count() == 1009
    assert toxicity.fold("") == " " and toxicity.features(" ", (3,), 0.01) == []
    long = toxicity.Model([" bad "], np.array([3.0]), toxicity.DEFAULT, ("bad day",))
    assert long.evidence("bad day " * 200_000 + "bad")[0] == pytest.approx(np.log1p(3.0))
    assert long.evidence("x" * 3_000_000) == (0.0, 0.0, 0.0)
    found = toxicity.features(toxicity.fold("Grok groks a b " + "word " * 10), (3, 4), 0.1)
    assert sorted(found) == [" gro", " grok", " wor", " word", " word "]


def test_evidence_by_brute_force():
    rng = np.random.default_rng(0)
    entries = [" ab", " abc", " c ", " bca", " a "]
    weights = np.array([1.0, 2.5, 0.7, 1.2, 0.3])
    model = toxicity.Model(entries, weights, toxicity.DEFAULT, ("c ab", "a b"))
    for _ in range(200):
        words = ["".join(rng.choice(list("abc"), rng.integers(1, 4))) for _ in range(rng.integers(1, 30))]
        line = f" {' '.join(words)} "
        spared = [(m.start(), m.start() + len(p)) for p in (" c ab ", " a b ") for m in re.finditer(f"(?={p})", line)]
        best = {}
        for k, e in enumerate(entries):
            for m in re.finditer(f"(?={e})", line):
                a, b = m.start(), m.start() + len(e)
                if not any(x <= a and b <= y for x, y in spared) and (a not in best or weights[k] > weights[best[a]]):
                    best[a] = k
        total = sum(weights[k] for k in best.values())
        expected = toxicity.PASSING * len(words)
        surprise = len(best) * np.log(len(best) / expected) - len(best) + expected if best else 0.0
        want = (np.log1p(total), np.log1p(surprise * total / len(best)), np.log1p(len(set(best.values())))) if best else (0, 0, 0)
        assert model.evidence(" ".join(words)) == pytest.approx(want)


def test_url_filter(spark, tmp_path):
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/123?x=1", "https://example.org/e", "http://x.com/fr/", "http://x.com/de/9#a", "http://badexample.org/es/", "http://spam-farm.example.net/x", "ftp://a.spam-farm.example.net", "no url", None, "", "://", "http://com/de/", "http://x.org", "http://com:80/de/", "http://a.b/c?d://e.org/", "http://ex.org/a\nb", "http://a.casino-shop.example.biz/", "http://casino-other.example.biz/", "http://x.org/" + "p" * 200_000, "http://" + "h." * 500 + "com/fr/", "http://x.org", "http://x.org"]
    pages = ship(spark).createDataFrame([(None if k == 3 else k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(pages, registry.URL_RULES, registry.URL_BLOCKED).collect()
    assert len(got) == len(urls)

    def brute(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for (h, p), v in registry.URL_RULES.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        blocked = any(host == b or host.endswith("." + b) for b in registry.URL_BLOCKED)
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "block" if blocked else "allow")

    assert sorted(map(str, ((r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(str(brute(u)) for u in urls)
    assert url_filter.judge_urls(pages.filter("false"), registry.URL_RULES, registry.URL_BLOCKED).count() == 0


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "_digest", lambda text: len(text))
    base = str(tmp_path / "d")
    order = url_filter.DigestArray.write(["aa", "bb", "c"], base)
    found = url_filter.DigestArray(base).find(["bb", "aa", "zz", "c", "dddd", ""])
    assert [order[i] if i >= 0 else None for i in found] == ["bb", "aa", None, "c", None, None]


def test_top_k(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8))
    x[100:400] = x[100]  # many equal vectors
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(900)]
    rows += [(2000, None, 1), (2020, [float("nan")] * 8, 1), (2040, [float("inf")] * 8, 1), (2060, [None] * 8, 1), (None, [1.0] * 8, 1), (2080, [0.5], 1), (2100, [], 1), (20, rows[20][1], 1)]
    table = ship(spark).createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = mtree_search.top_k(table, F.col("vec_id") % 20 == 0, k=20, shard=200).collect()
    fine = [(i, np.pad(np.floor(64 * np.array(v, np.float32).astype(np.float64)), (0, 8 - len(v))).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(a is not None and np.isfinite(a) for a in v)]
    want = set()
    for q, v in {i: v for i, v in fine if i % 20 == 0}.items():
        best = sorted((-int(v @ w), i) for i, w in fine if i != q)[:20]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert mtree_search.top_k(table.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert mtree_search.top_k(table.filter("vec_id < 5"), F.col("vec_id") % 20 == 0).count() == 4
    with pytest.raises(Exception, match="too large"):
        mtree_search.top_k(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()


def test_bounds_of_the_tree_leave_vectors_out():
    """Clustered vectors of equal length: few are scored; isotropic ones: results stay exact."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 6000)] + 0.05 * rng.normal(size=(6000, 32))
    for vectors, most in ((x, 0.3), (rng.normal(size=(6000, 32)), 1.0)):
        fine = np.floor(64 * vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(int)
        tree, tally = mtree_search.MTree(np.arange(6000), fine), {}
        q, found, score = tree.search(fine[:50], np.arange(50), 20, tally)
        products = fine[:50] @ fine.T
        products[np.arange(50), np.arange(50)] = -(2**40)
        for k in range(50):
            order = np.lexsort((np.arange(6000), -products[k]))[:20]
            assert found[q == k].tolist() == order.tolist() and score[q == k].tolist() == products[k, order].tolist()
        assert tally["scored"] <= most * 50 * 6000


def brute_fingerprint(text, size=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << j for j in range(64) if 2 * sum(v >> j & 1 for v in h) > len(h))


def components_of(fps, radius):
    forest = simhash.Forest(len(fps))
    x = np.bitwise_count(fps[:, None] ^ fps[None])
    forest.join(*np.nonzero(x <= radius))
    return forest.roots()


def test_simhash(spark, odd, empty):
    rng = np.random.default_rng(0)
    base = [" ".join(rng.choice(list("abcdefghij"), 40)) for _ in range(60)]
    near = [b + " " + " ".join(rng.choice(list("abc"), k)) for b in base for k in (0, 1)]
    rows = [(100 + i, t) for i, t in enumerate(base + near)] + texts_of(odd)
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    fps = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    assert sorted(r.fp for r in got) == sorted(fps.view(np.int64).tolist())
    roots = components_of(fps, 2)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((-1 if i is None else i, least[r]) for (i, _), r in zip(rows, roots))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in got) == want
    kept = simhash.near_dedup(docs.withColumn("fp", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted(set(least.values()))
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize(("n", "radius", "direct"), [(300, 2, 64), (3000, 2, 256), (500, 3, 64), (200, 0, 16)])
def test_links_are_complete(n, radius, direct, monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = np.random.default_rng(n)
    fps = []
    for b in rng.integers(0, 2**63, n // 5).tolist():
        for _ in range(5):
            v = b
            for _ in range(rng.integers(0, 4)):
                v ^= 1 << int(rng.integers(0, 64))
            fps.append(v)
    fps = np.unique(np.array(fps, np.uint64))
    forest = simhash.Forest(len(fps))
    simhash.link(fps, np.arange(len(fps)), list(range(64)), radius, forest)
    assert (forest.roots() == components_of(fps, radius)).all()


def test_hot_bucket_of_one_key(spark):
    """Fingerprints that all share most bits: large buckets, one component or several."""
    rng = np.random.default_rng(3)
    low = np.unique(rng.integers(0, 2**16, 4000))
    fps = np.concatenate((low, low[:50] | (0xFFFF << 40))).astype(np.int64)
    distinct = ship(spark).createDataFrame([(int(v),) for v in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(distinct)).collect()}
    want = components_of(fps.view(np.uint64), 2)
    assert len({roots.get(int(v), int(v)) for v in fps}) == len(set(want.tolist()))


def test_pairs_within_limits_and_abandoned_words():
    rng = np.random.default_rng(0)
    for k, limit in ((1, 3), (1, 12), (8, 70)):
        base = rng.integers(0, 2**64, (60, k), np.uint64, endpoint=False)
        fps = np.repeat(base, 6, axis=0)
        flip = rng.random((len(fps), 64 * k)) < rng.choice([0.01, 0.05, 0.1], (len(fps), 1))
        fps ^= np.packbits(flip, axis=1, bitorder="little").view(np.uint64)
        ends = np.full(len(fps), len(fps))
        ends[:50], ends[50:131] = 50, 131
        own = np.where(np.arange(len(fps)) % 3 == 0, limit, limit + 2)
        apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=-1)
        want = {(p, q) for p, q in zip(*np.nonzero(apart < own[:, None])) if p < q < ends[p]}
        tally = {}
        got = [x for p, q in simhash.near_pairs(fps, ends, own, list(range(64 * k)), tally) for x in zip(p.tolist(), q.tolist())]
        assert len(got) == len(want) and set(got) == want and want
        assert tally["blocks"] < (0.5 if limit == 3 else 0.9) * tally["items"] * 8 * k  # the rest was abandoned


def test_hot_buckets_are_split(spark):
    rng = np.random.default_rng(5)
    fps = np.unique(np.concatenate((rng.integers(0, 2**20, 600), rng.integers(0, 2**62, 100)))).astype(np.int64)
    distinct = common.written(ship(spark).createDataFrame([(int(v),) for v in fps], "fp long"), "d")
    found = simhash.buckets(distinct, hot=50)
    masks = {r.mask for r in found.select("mask").distinct().collect()}
    assert len(masks) > 6  # finer than the six first ones
    assert all(r["count"] <= 50 or bin(r.mask & (2**64 - 1)).count("1") >= 61 for r in found.groupBy("mask", "value").count().collect())
    members = {}
    for r in found.collect():
        assert r.fp & r.mask == r.value
        members.setdefault((r.mask, r.value), set()).add(r.fp)
    x = fps.view(np.uint64)
    for p, q in zip(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 2, 1))):
        assert any({int(fps[p]), int(fps[q])} <= m for m in members.values())


def test_components(spark):
    rng = np.random.default_rng(2)
    plain = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)] + [(1000, 1000 + k) for k in range(1, 900)]  # a path, a pair, a loop, a star
    plain += [tuple(x) for x in rng.integers(5000, 5400, (300, 2)).tolist()]
    edges = ship(spark).createDataFrame(plain, "a long, b long").repartition(7)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    nodes = np.unique(np.array(plain))
    forest = simhash.Forest(len(nodes))
    forest.join(*(np.searchsorted(nodes, x) for x in np.array(plain).T))
    want = dict(zip(nodes.tolist(), nodes[forest.roots()].tolist()))
    assert {n: got.get(n, n) for n in want} == want
    assert simhash.components(edges.filter("false")).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(500)) + "\n"
    for size in (1, 3, 5):
        whole = np.concatenate(list(simhash.shingle_hashes(text, size)))
        monkeypatch.setattr(simhash, "PIECE", 10)
        assert (np.concatenate(list(simhash.shingle_hashes(text, size))) == whole).all() and len(whole) == 501 - size
        assert len(np.concatenate(list(simhash.shingle_hashes("a  b", size)))) == max(1, 3 - size)
        assert list(simhash.shingle_hashes(" \n" * 50, size)) == []
        monkeypatch.undo()


def brute_groups(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(SPACE.sub(" ", t), []).append((i is None, i or 0, k, i))
    return {k: (min(g)[3], len(g), min(g)[2] == k, hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for _, _, k, _ in g}


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_exact_dedup(spark, odd, empty, block):
    rows = texts_of(odd) + [(200, "ab" * 3000), (201, "ab" * 3000 + "c"), (202, "ab" * 3000), (203, "The \n cat sat")]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string").withColumns({"name": F.lit(1), "level": F.lit("x"), "row_id": F.lit(3)})
    got = exact_dedup.exact_groups(docs, block).collect()
    want = brute_groups(rows)
    key = lambda v: str(v)
    assert sorted((key((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got)) == sorted(key((rows[k][0], v[0], v[1], v[3])) for k, v in want.items())
    assert sum(r.kept for r in got) == sum(v[2] for v in want.values())
    kept = exact_dedup.exact_dedup(docs, block)
    assert kept.columns == docs.columns
    assert sorted(SPACE.sub(" ", r.text) for r in kept.collect()) == sorted({SPACE.sub(" ", t) for _, t in rows})
    assert exact_dedup.exact_groups(empty, block).count() == 0


def test_exact_dedup_keeps_columns_of_inner_names(spark):
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (None, "a", 4), (None, "c", 5), (2, "b", 6)]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string, _sha long").withColumns({n: F.lit(7) for n in ("sha", "_keep_sha", "_keep_id", "text_sha256", "kept", "_hot", "_item", "_row", "_salt")})
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text, r.doc_id, r._sha in (1, 2)) for r in kept.collect() if r.text != "c") == [("a", 1, True), ("b", 1, False)] and kept.count() == 3
    assert near_copies.near_dedup(docs).columns == docs.columns and simhash.near_dedup(docs).columns == docs.columns
    packed = packing.pack_documents(docs, P.path("byte_bpe_50k.json"))
    assert packed.count() == 6 and packed.select("sequence_id", "offset").distinct().count() == 6


def test_a_shared_folder_is_needed_on_a_cluster():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Cluster)


def test_attach_keeps_hot_keys_whole(spark):
    left = common.written(spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), "id"), "l")
    right = common.written(left.groupBy("k").agg(F.count("*").alias("uses"), F.min("id").alias("least")), "r")
    out = common.attach(left, right, ["k"], "uses", 5000)
    assert out.count() == 5000 and out.filter("k = 1").agg(F.min("least"), F.max("uses")).first() == (0, 4000)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(texts_of(docs))
    lang = language_id.fit(docs)
    alive = {r.doc_id for r in language_id.predict(docs, lang).collect() if not r.rejected}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    tox = toxicity.fit(docs.filter(F.col("doc_id").isin(sorted(alive))), labels)
    alive = {i for i in alive if tox.score([texts[i]])[0] < 0.5}
    first = {}
    for i in sorted(alive):
        first.setdefault(SPACE.sub(" ", texts[i]), i)
    kept = {i for i, _ in brute_kept([(i, texts[i]) for i in first.values()])}
    assert {r.doc_id for r in out} == kept
    sizes = {}
    for r in out:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(library_ids("byte_bpe_50k.json", texts[i])) + 1 for i in kept}
