"""Shards, quality rules, URL lists, mixing and the pipeline."""

import math
import re
import struct
import zlib
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cragline.llm import mixing, queries, quality_rules, shards, url_lists

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def test_shards_by_brute_force(spark):
    rows = [(i, "x" * (i % 7) + "é") for i in range(500)] + [(None, "a"), (3, None), (3, "x"), (3, "x")]
    weights = [1.0, 2.0, 1.0, 0.5]
    got = shards.sharded(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int"), weights).collect()

    def drawn(key, weights):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        u = [((xxhash.xxh64_intdigest(struct.pack("<i", s), seed) >> 11) + 0.5) / 2**53 for s in range(len(weights))]
        return max(range(len(weights)), key=lambda s: -weights[s] / math.log(u[s]))

    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == Counter(
        (k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), drawn(k, weights), drawn(k, [*weights, 1.0])) for k, t in rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 4) for r in got)
    with pytest.raises(ValueError):
        shards.rendezvous(F.lit(1), [])
    assert shards.sharded(spark.createDataFrame([], "doc_id long, text string"), weights).count() == 0


def statistics(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:]))
    cover = set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover)


def test_text_statistics_by_brute_force(spark):
    draw = np.random.default_rng(0)
    texts = [None, "", "  \n\t", "a", "a b", "a b c", "a b c a b c", "a " * 4000, "é|<>\n\nx\r\nx\r\nx\n x", "one\x0btwo\x0cthree", "\x1cx \x85y"]
    texts += [" ".join(f"w{x}" for x in draw.integers(0, 5, draw.integers(0, 60))) + "\n" * (k % 3) + "#" * (k % 4) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.text_statistics(docs).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(t), t


def test_quality_rules(spark):
    draw = np.random.default_rng(1)

    def text(symbols):
        return " ".join(f"word{x}" + "$$$" * symbols for x in draw.integers(0, 10**6, draw.integers(60, 200)))

    rows = [(k, text(k % 10 == 0), "en" if k % 3 else None, "a" if k % 2 else None, 1, 2) for k in range(200)]
    rows += [(900, "short text", "en", "a", 1, 2), (901, None, None, None, 1, 2), (902, text(False), "xx", "alone", 1, 2), (None, text(False), "en", "a", 1, 2), (5, rows[5][1], "en", "a", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept int")
    got = quality_rules.judged(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id < 200:
            assert not r.base_failed and r.kept == (r.doc_id % 10 != 0), r
    assert {r.doc_id: r.kept for r in got if r.doc_id and r.doc_id >= 900} == {900: False, 901: False, 902: True}
    kept = quality_rules.without_rejects(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.judged(docs.limit(0)).count() == 0


def test_url_lists(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    history = spark.createDataFrame([("spam", "Bad.com", day(1), "add"), ("spam", "bad.com", day(5), "remove"), ("spam", "bad.com", day(40), "add"), ("spam", "bad.com", day(50), "add"), ("legal", "x.bad.com", day(2), "add"),
                                     ("spam", "tie.com", day(3), "add"), ("spam", "tie.com", day(3), "remove"), (None, "n.com", day(0), "add"), ("spam", "r.com", day(1), "remove")], "list string, domain string, at timestamp, action string")
    seen = [("http://bad.com/", day(0)), ("http://bad.com/", day(1)), ("HTTPS://u:p@Bad.COM.:80/a?b#c", day(4)), ("http://bad.com", day(5)), ("http://a.x.bad.com/q", day(4)), ("http://notbad.com", day(4)), ("http://bad.com", day(600)),
            (None, day(4)), ("no scheme", day(4)), ("http://bad.com", None), ("http://tie.com", day(9)), ("http://r.com", day(9)), ("http://[::1]/", day(3))]
    rows = spark.createDataFrame([(i, u, t, "x") for i, (u, t) in enumerate(seen)], "page_id long, url string, at timestamp, list string")
    got = {r.page_id: (r.allowed, r.n_active, r["list"], r.entry) for r in url_lists.evaluated(rows, history, "url", "at", "page_id").collect()}
    free = (True, 0, None, None)
    bad = (False, 1, "spam", "bad.com")
    assert got == {0: free, 1: bad, 2: bad, 3: free, 4: (False, 2, "legal", "x.bad.com"), 5: free, 6: bad, 7: free, 8: free, 9: free, 10: free, 11: free, 12: free}
    assert url_lists.evaluated(rows.limit(0), history, "url", "at", "page_id").count() == 0
    assert url_lists.evaluated(rows, history.limit(0), "url", "at", "page_id").where("NOT allowed").count() == 0


def highest_quotients(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        won[max((v / (2 * won[i] + 1), -i) for i, v in enumerate(votes) if v > 0)[1] * -1] += 1
    return won


@pytest.mark.parametrize("seed", range(6))
def test_apportionment(spark, seed):
    draw = np.random.default_rng(seed)
    votes = [int(v) for v in draw.integers(0, [10, 1000, 10**6][seed % 3], 12)] + [5, 5, 5]
    seats = int(draw.integers(0, 300))
    rows = spark.createDataFrame([(1, i, float(v), seats) for i, v in enumerate(votes)], "g int, id int, votes double, seats long")
    got = {r.id: r.quota for r in mixing.apportioned(rows, ["g"], "id", "votes", "seats", "quota").collect()}
    assert [got[i] for i in range(len(votes))] == highest_quotients(votes, seats)


def test_mixing(spark):
    draw = np.random.default_rng(2)
    rows = [(k, " ".join(["w"] * int(draw.integers(0, 200))), f"s{min(k % 9, 5)}" if k % 11 else None, 5, 0.1) for k in range(600)] + [(None, "a b c", "s0", 5, 0.1), (7, None, "s0", 5, 0.1), (7, "a b", "lone", 3, 0.1), (7, "a b", "lone", 3, 0.1), (8, "", "blank", 0, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, target double")
    got = mixing.mixed(docs.drop("target"), carry=["doc_id", "source"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.drop("target").repartition(5), carry=["doc_id", "source"]).collect()))
    size, target, taken = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert Counter(r["size"] for r in got) == Counter(len(WORD.findall(t or "")) for _, t, *_ in rows)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    total, left, share = 1.5 * sum(size.values()), dict(zip(names, [5, 2, 1] * 9)), {}
    while left:  # excess is reshared until none is above
        unit = (total - sum(share.values())) / sum(left.values())
        over = [s for s in left if left[s] * unit > 2 * size[s]]
        if not over:
            share |= {s: left[s] * unit for s in left}
            break
        share |= {s: 2.0 * size[s] for s in over}
        left = {s: w for s, w in left.items() if s not in over}
    for s in names:
        assert abs(target[s] - share[s]) < 1e-6 * max(1, share[s])
        assert abs(taken[s] - target[s]) <= 3 * mixing.BLOCK
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    assert out.select(F.sum(mixing.words("text"))).first()[0] == sum(taken.values())
    assert mixing.mixed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want)]
    got, want = (x.sort_values(list(want)).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in want:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), c


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0, name


def test_captures_after_2100_meet_open_entries(spark):
    history = spark.createDataFrame([("spam", "bad.com", datetime(2024, 1, 2), "add"), ("spam", "late.com", datetime(2150, 3, 1), "add")], "list string, domain string, at timestamp, action string")
    seen = [("http://bad.com/", datetime(2024, 1, 1)), ("http://bad.com/", datetime(2101, 5, 1)), ("http://late.com/", datetime(2150, 2, 1)), ("http://late.com/", datetime(2160, 1, 1)), ("http://bad.com/", datetime(2024, 1, 3))]
    rows = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(seen)], "page_id long, url string, at timestamp")
    got = {r.page_id: r.allowed for r in url_lists.evaluated(rows, history, "url", "at", "page_id").collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False}


def concentrated(x, start, fixed):
    """(log determinant, mean, covariance) after concentration steps from ``start``, by sorting."""
    h, best = math.ceil(0.75 * len(x)), None
    mean, cov = x[start].mean(0), np.cov(x[start].T, bias=True) * quality_rules.CONSISTENT + fixed
    while True:
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        near = np.argsort(d2, kind="stable")[:h]
        mean, cov = x[near].mean(0), np.cov(x[near].T, bias=True) * quality_rules.CONSISTENT + fixed
        now = np.linalg.slogdet(cov)[1]
        if best is not None and now > best[0] - 1e-9:
            return best
        best = (now, mean, cov)


def test_least_determinants_against_random_starts(spark):
    draw = np.random.default_rng(4)
    fixed = np.diag(np.square(quality_rules.FLOORS))
    groups = {}
    for name, n, bad in (("a", 400, 0.2), ("b", 300, 0.0), ("c", 250, 0.23)):
        turn = draw.standard_normal((5, 5)) * [2, 0.5, 0.1, 0.2, 0.2]
        x = draw.standard_normal((n, 5)) @ turn + [5, 5, 0, 0, 0]
        far = int(n * bad)
        x[:far] = draw.standard_normal((far, 5)) * 0.1 + [14, 9, 3, 3, 4]  # a tight cluster, which draws the mean of all rows
        groups[name] = x
    rows = [(k, *map(float, r)) for k, x in groups.items() for r in x] + [("lone", 1.0, 2.0, 3.0, 4.0, 5.0)] + [("same", 1.0, 1.0, 0.0, 0.0, 0.0)] * 40
    got = {r.mk: r for r in quality_rules.least_determinants(spark.createDataFrame(rows, "mk string, x1 double, x2 double, x3 double, x4 double, x5 double")).collect()}
    assert set(got) == {*groups, "lone", "same"}
    for k, x in groups.items():
        want = min((concentrated(x, draw.choice(len(x), 12, replace=False), fixed) for _ in range(60)), key=lambda e: e[0])
        assert abs(got[k].log_det - want[0]) < 0.1, k
        far = math.sqrt((np.array([got[k][f"m{i}"] for i in range(1, 6)]) - want[1]) @ np.linalg.inv(want[2]) @ (np.array([got[k][f"m{i}"] for i in range(1, 6)]) - want[1]))
        assert far < 0.1, k
    for k, x in (("lone", [1, 2, 3, 4, 5]), ("same", [1, 1, 0, 0, 0])):
        assert np.allclose([got[k][f"m{i}"] for i in range(1, 6)], x)
        assert abs(got[k].log_det - np.log(np.diag(fixed)).sum()) < 1e-4
    none = quality_rules.least_determinants(spark.createDataFrame([], "mk string, x1 double, x2 double, x3 double, x4 double, x5 double"))
    assert none.count() == 0
