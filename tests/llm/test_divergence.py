"""Divergence of sources against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from cragline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, most):
    held, counts, groups = defaultdict(set), Counter(), set()
    for k, (t, lang, source) in enumerate(rows):
        groups.add((lang or "", source or ""))
        for w in TERM.findall((t or "").translate(UPPER)):
            held[lang or "", w].add(k)
            counts[lang or "", source or "", w] += 1
    out = []
    for lang, source in groups:
        kept = [w for (x, w), docs in held.items() if x == lang and len(docs) >= least]
        others = [s for x, s in groups if x == lang]

        def shares(names):
            c = {w: sum(counts[lang, s, w] for s in names) for w in kept}
            below = sum(c.values()) + 5 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // below for w in kept}

        p, q = shares([source]), shares(others)
        pairs = [(sum(abs(p[w] - o[w]) for w in kept), s) for s in others if s != source for o in [shares([s])]]
        terms = [(p[w] - q[w], w) for w in kept if counts[lang, source, w] and p[w] > q[w]]
        for part, found, n in (("pair", pairs, len(pairs)), ("term", terms, most)):
            for r, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n]):
                out.append((lang, source, part, item, v, r + 1))
    return sorted(out)


def odd_rows(n, seed=0):
    draw = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Été", "ÉTÉ", "中文", "😀", "AbC", "x²"]
    rows = []
    for k in range(n):
        lang, source = draw.choice(["en", "en", "en", "de", None]), draw.choice(["s0", "s0", "s1", "é", "", None])
        rows.append((" 1-".join(vocabulary[min(len(vocabulary) - 1, int(draw.expovariate(0.02)) + len(source or "") * 7)] for _ in range(draw.randint(0, 60))), lang, source))
    return rows + [(None, "en", "only nulls"), ("", "xx", "blank"), ("12 34 !?", "xx", "digits"), ("lone words here", "yy", "one"), ("a" * 50_000 + " tail", "en", "s1"), ("wAA " * 20_000, "en", "s1")] + [rows[3]] * 40


@pytest.mark.parametrize("least,most", [(30, 50), (3, 4), (1, 1000)])
def test_audit_by_brute_force(spark, monkeypatch, least, most):
    monkeypatch.setattr(divergence, "FIRST", 2)  # so that the search goes on for rounds
    monkeypatch.setattr(divergence, "SLICE", 5000)
    rows = odd_rows(500)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, g int, term string, p long").repartition(5)
    got = divergence.audited(docs, least=least, most=most)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, most)


def test_many_groups_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FEW", 1)  # nothing is broadcast
    rows = odd_rows(200, 1)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audited(docs, least=5).collect())) == brute(rows, 5, 50)
    assert divergence.audited(docs.limit(0)).count() == 0


def test_sql_equals_brute_force():
    rows = odd_rows(500, 2)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["text", "lang", "source"]))
    assert sorted(con.sql(divergence.DUCK_SQL).fetchall()) == brute(rows, 30, 50)


def test_large_totals_stay_exact(spark):
    count, total, terms = 12_345_678_901_234, 98_765_432_109_876, 1_000_003
    row = spark.range(1).select(divergence.probability(*(divergence.F.lit(x) for x in (count, total, terms))).alias("p")).first()
    assert row.p == 1 + 10**9 * (count + 5) // (total + 5 * terms)


def test_corrections_are_exact_in_large_numbers():
    found, total = divergence._summed(np.array([1, 1, 2]), np.array([2**60, 1, 3]))
    assert found.tolist() == [1, 2] and total.tolist() == [2**60 + 1, 3]
