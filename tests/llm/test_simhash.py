import math
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cragline.llm import components as comp
from cragline.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])


def print_of(text, k=4):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


TEXTS = ["", None, "  \n ", "One", "one", "a b c", "A  b\tc", "Ä ä b c d e", "x " * 5000, "same text here it is", "same text here it is", " ".join(f"w{i}" for i in range(300)),
         " ".join(f"w{i}" if i != 150 else "other" for i in range(300)), " ".join(f"w{i}" for i in range(299)), "no\x0bbreak\x0chere\x1cnow"]


def test_groups_by_brute_force(spark):
    rows = [(i, t, "clash", 0) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component int")
    got = {r.key: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: print_of(t) for i, t, *_ in rows}
    want = groups(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {i: (r.fp % 2**64, r.component) for i, r in got.items()} == {i: (fps[i], want[i]) for i in fps}


def test_null_and_repeated_keys_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "q r s t u v")], "doc_id long, text string")
    got = sorted((r.key or -1, r.component) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 7), (7, 7), (7, 7), (9, 9)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 6))
def test_trees_find_all_within_the_radius(seed, radius):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 2**63, 6, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ (np.uint64(1) << draw.integers(0, 64, 6).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 6).astype(np.uint64)) for _ in range(20)]))
    shard = np.sort(draw.integers(0, 3, len(fp)))
    got = set()
    for q, hit, apart in simhash.Forest(fp, shard).within(radius, block=16, most=64):
        got |= set(zip(q.tolist(), hit.tolist(), apart.tolist()))
    n = range(len(fp))
    assert got == {(i, j, (int(fp[i]) ^ int(fp[j])).bit_count()) for i in n for j in n if i != j and shard[i] == shard[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}


@pytest.mark.parametrize("members", [10, 10**6, 10**9, 10**12])
def test_masks_lose_no_pair(members):
    table = simhash.masks(4, members)
    draw = np.random.default_rng(1)
    for _ in range(300):
        flips = sum(1 << int(b) for b in draw.choice(64, 4, replace=False))
        assert any(not flips & m for m in table)


def test_a_crowded_shard_is_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 8)
    fps = [(int(x), int(x)) for x in {(1 << a) | (1 << b) for a in range(10) for b in range(10)}]
    distinct = spark.createDataFrame(fps, "node long, fp long")
    roots = comp.components(simhash.candidate_links(distinct, simhash.masks(4, len(fps)), lambda members: simhash.forest_links(members, 4)))
    assert {r.node for r in roots.collect()} == {f for f, _ in fps} and roots.select("root").distinct().count() == 1


def test_near_copies_by_shingles(spark):
    draw = np.random.default_rng(3)
    texts = []
    for _ in range(60):
        words = [f"v{x}" for x in draw.integers(0, 5000, draw.integers(60, 300))]
        texts.append(" ".join(words))
        if len(texts) % 3 == 0:
            words[int(draw.integers(0, len(words)))] = "changed"
            texts.append(" ".join(words))
    # two texts ruled by one repeated shingle have one fingerprint and little in common
    texts += ["same " * 200 + " ".join(f"{c}{i}" for i in range(30)) for c in "xy"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)] + [(None, "lone text", 9)], "doc_id long, text string, n_chars long")
    sets = {i: set(shingles(t, 5)) for i, t in enumerate(texts)}
    want = groups(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({*want.values()})
    assert kept.where("doc_id IS NULL").count() == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    links = spark.createDataFrame(pairs or [(0, 0)], "a long, b long")
    got = {r.node: r.root for r in comp.components(links).collect()}
    want = groups(sorted({x for p in pairs for x in p}), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_a_long_chain(spark):
    links = spark.range(400).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in comp.components(links).collect()} == {0}


def test_repeats_do_not_move_the_fingerprint_of_a_set(spark):
    words, line = " ".join(f"w{i}" for i in range(300)), " ".join(f"line{i}" for i in range(10))
    docs = spark.createDataFrame([(n, f"{words} {(line + ' ') * n}") for n in (2, 3, 15, 40)], "doc_id long, text string")
    got = simhash.shingled(docs, 5, 0.8, "text", "doc_id").collect()
    assert len({(r.node, r.fp, r.second, r.n, *r.firsts) for r in got}) == 1
    assert len({r.node for r in simhash.fingerprints(docs, 5).collect()}) > 1  # op1 counts repeats


def kept_ids(docs):
    return sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect())


def test_the_nearest_of_a_family_do_not_hide_the_partner(spark, monkeypatch):
    draw = np.random.default_rng(11)
    frame = [f"frame{i}" for i in range(240)]
    texts = [" ".join(frame + [f"t{k}w{i}" for i in range(40)]) for k in range(80)]  # 0.74 of their shingles in common
    for k in range(40, 60):  # 0.82 in common with one text: its frame, and half of what is its own
        texts.append(" ".join(frame + [f"t{k}w{i}" for i in range(14)] + [f"own{k}w{i}" for i in range(26)]))
    order = draw.permutation(len(texts)).tolist()
    texts = [texts[i] for i in order]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(shingles(t, 5)) for t in texts]
    want = groups(list(range(len(texts))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert len({*want.values()}) == 80
    monkeypatch.setattr(simhash, "FREQUENT", 50, raising=False)  # the order of shingles never decides what is found
    assert kept_ids(docs) == sorted({*want.values()})


def test_pairs_that_no_table_brings_together_are_found(spark, monkeypatch):
    draw = np.random.default_rng(5)
    texts = []
    for _ in range(80):
        words = [f"v{x}" for x in draw.integers(0, 50000, 200)]
        other = list(words)
        for at in draw.choice(np.arange(2, 40) * 5, int(draw.integers(2, 6)), replace=False):
            other[at] = f"new{at}"
        texts += [" ".join(words), " ".join(other)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(shingles(t, 5)) for t in texts]
    want = groups(list(range(len(texts))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    monkeypatch.setattr(simhash, "sampled_masks", lambda *_: [(1 << 64) - 1])
    assert 80 <= len({*want.values()}) < 160 and kept_ids(docs) == sorted({*want.values()})


@pytest.mark.parametrize("large", [128, 3])
def test_near_copies_of_a_table_by_all_pairs(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)  # 3: most nodes meet components in blocks
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    draw = np.random.default_rng(2)
    base = [f"b{i}" for i in range(150)]
    rows = [(r.doc_id, r.text) for r in docs] * 2  # every row twice
    for k in range(120):  # one large group of near copies, many of them just at the share
        words = list(base)
        for at in draw.choice(150, int(draw.integers(1, 9)), replace=False):
            words[at] = f"x{k}y{at}"
        rows.append((10_000 + k, " ".join(words)))
    sets = {i: set(shingles(t, 5)) for i, t in rows}
    ids = sorted(sets)
    want = groups(ids, lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r.key: r.component for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([0.5, 0.8, 0.9, 1.0]))
def test_first_shingles_meet(seed, share):
    draw = np.random.default_rng(seed)
    x = np.unique(draw.integers(0, 2**63, int(draw.integers(1, 60)), dtype=np.uint64))
    y = np.unique(np.r_[draw.permutation(x)[: max(1, int(len(x) * draw.uniform(share, 1)))], draw.integers(0, 2**63, int(draw.integers(0, 6)), dtype=np.uint64)])
    known = np.sort(draw.permutation(x)[: len(x) // 2])
    many = draw.integers(1, 9, len(known))
    both = len(np.intersect1d(x, y))
    met = np.intersect1d(*(simhash.first_shingles(z, share, known, many) for z in (x, y)))
    assert len(met) or both < share * (len(x) + len(y) - both)


def test_a_family_below_the_share_does_not_meet(spark):
    """1,500 texts of one template, 0.72 in common: no row of one meets a row of another, though all have first shingles of the template."""
    template = [f"t{i}" for i in range(500)]
    rows = []
    for k in range(1500):
        words = list(template)
        for at in range(20, 340, 20):  # 16 words take 80 of 496 shingles with them
            words[at] = f"own{k}w{at}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = simhash.shingled(docs, 5, 0.8, "text", "doc_id")
    nodes = marked.select("node", F.col("key").alias("least"), "n", F.col("node").alias("root"), F.lit(1).alias("size"))
    firsts = marked.select(F.explode("firsts").alias("s")).groupBy("s").count().agg(F.max("count")).first()[0]
    assert firsts > 100  # the plain prefix filter would bring all of these together
    found = simhash.shared_firsts(marked, nodes, 0.8)
    assert simhash.meetings(found, 0.8).count() < 20 * len(rows)
    sets = [set(shingles(t, 5)) for _, t in rows[:60]]
    shares = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert 0.7 < min(shares) and max(shares) < 0.75
    got = simhash.near_copies(docs)
    assert got.where("key <> component").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([0.5, 0.8, 0.9, 1.0]))
def test_early_shingles_meet_often_enough(seed, share):
    """What ``fitting`` asks of counted rows, in plain sets: no pair at the share has fewer early ones of the smaller among the first of the larger."""
    draw = np.random.default_rng(seed)
    universe = draw.permutation(1 << 20)[:200].astype(np.uint64)
    many = draw.integers(1, 4, 200)
    order = np.argsort(universe)
    known, many = universe[order], many[order]
    x = draw.permutation(universe)[: int(draw.integers(1, 120))]
    y = np.unique(np.r_[draw.permutation(x)[: max(1, int(len(x) * draw.uniform(share, 1)))], draw.permutation(universe)[: int(draw.integers(0, 12))]])
    x, y = sorted((np.unique(x), y), key=len)
    both = len(np.intersect1d(x, y))
    if both + simhash.TINY < share * (len(x) + len(y) - both):
        return
    early = simhash.first_shingles(x, share, known, many)[: len(x) - math.ceil(2 * share / (1 + share) * len(x) - simhash.TINY) + 1]
    c = len(np.intersect1d(early, simhash.first_shingles(y, share, known, many)))
    beyond = max(math.ceil(2 * share / (1 + share) * len(x) - simhash.TINY), math.ceil(share * len(y) - simhash.TINY)) - 1
    assert c >= max(1, share / (1 + share) * (len(x) + len(y)) - simhash.TINY - beyond)
