import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import near_copies, simhash
from gridloom.session import ship


def brute_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute_kept(rows):
    """The (doc_id, text) that stay."""
    nodes = sorted({t or "": min(((i is None, i or 0) for i, u in rows if (u or "") == (t or ""))) for _, t in rows}.items(), key=lambda x: x[1])
    sets = [brute_set(t) for t, _ in nodes]
    forest = simhash.Forest(len(nodes))
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    if pairs:
        forest.join(*map(np.array, zip(*pairs, strict=True)))
    return {(None if nodes[r][1][0] else nodes[r][1][1], nodes[r][0]) for r in set(forest.roots().tolist())}


def changed(rng, words, k):
    out = list(words)
    for j in rng.choice(len(out), k, replace=False):
        out[j] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def test_stage_finds_all_pairs_of_similarity_08(spark):
    rng = np.random.default_rng(1)
    base = [[f"w{x}" for x in rng.integers(0, 5000, int(n))] for n in rng.integers(60, 300, 80)]
    texts = [" ".join(b) for b in base] + [changed(rng, b, k) for b in base for k in (1, 2, 4, 8)]
    line = " ".join(f"l{k}" for k in range(20))
    texts += [line + " " + " ".join(f"w{x}" for x in rng.integers(0, 5000, int(n))) for n in rng.integers(3, 40, 80)]  # a very common line
    group = [f"g{k}" for k in range(150)]
    texts += [changed(rng, group, 1) for _ in range(100)]  # a large group of near copies
    chain = [f"c{k}" for k in range(400)]
    texts += [" ".join(chain[k : k + 60]) for k in range(0, 200, 5)]  # linked one after the other only
    texts = list(dict.fromkeys(texts))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.remove_near_copies(spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in kept} == brute_kept(rows) and len(kept) == len(brute_kept(rows))


def test_wide_fingerprints():
    """Over half of the members, by plain sums; sets of similarity 0.8 stay within the limits."""
    rng = np.random.default_rng(0)
    ratio = []
    for n in (*range(1, 20), 100, 2048, 5000):
        found = np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False))
        x = found[:, None] * near_copies._SPREAD[0]
        for k, shift in ((1, 29), (2, 32)):
            x = (x ^ (x >> np.uint64(shift))) * near_copies._SPREAD[k]
        x ^= x >> np.uint64(29)
        count = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0)
        own = near_copies.wide_fingerprint(found)
        assert (own == np.packbits(2 * count > len(found), bitorder="little").view(np.uint64)).all()
        for _ in range(20):
            more = np.unique(np.concatenate((found, rng.integers(0, 2**64, len(found) // 4, np.uint64, endpoint=False))))
            ratio.append(np.bitwise_count(own ^ near_copies.wide_fingerprint(more)).sum() / near_copies.limits(np.array([n]))[0])
    assert max(ratio) < 1


def test_hot_buckets_are_split_by_further_bands(spark):
    rng = np.random.default_rng(4)
    common = [f"g{k}" for k in range(100)]
    texts = [" ".join(common + [f"w{x}" for x in rng.integers(0, 10**6, 12)]) for _ in range(120)]  # most below 0.8, all alike in much
    texts += [changed(rng, t.split(), 1) for t in texts[:40]]
    rows = list(enumerate(dict.fromkeys(texts)))
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string")
    groups = near_copies.near_groups(docs, hot=20)
    assert {r.rep for r in groups.groupBy("root").agg(F.min("rep").alias("rep")).collect()} == {i for i, _ in brute_kept(rows)}


def test_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    rows = [(7, a), (7, b + " end"), (3, b), (None, c), (None, c + " end"), (9, "x"), (9, "X"), (1, ""), (None, None), (2, "\n")]
    docs = ship(spark).createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, root long")
    kept = near_copies.near_dedup(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert len(got) == 5 and {(7, a), (3, b), (1, "")} <= set(got)
    assert sum(i is None and t.startswith("c0") for i, t in got) == 1 and sum(i == 9 for i, _ in got) == 1
    assert near_copies.near_dedup(docs.filter("false")).count() == 0
