"""Exact duplicates by chunk recipes against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cragline.llm import chunks, queries

SF = "/root/testdata/sf0.001"


def brute(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=str)


def odd_rows(seed=0):
    draw = random.Random(seed)
    words = ["quite", "a", "very", "zéro", "the", "x", "\n", "中文", "😀", "end.", "9"]
    texts = [" ".join(draw.choices(words, k=n)) for n in (0, 1, 3, 40, 400, 4000, 30_000)] + ["y" * 20_000, "y" * 20_001, None, "", " ", "\x00", "a\r\n"]
    rows = [(i, draw.choice(texts)) for i in range(200)] + [(1000 + i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts)]
    return rows + [(None, "alone under null"), (None, texts[3]), (7, "two texts of one key"), (None, "null twice"), (None, "null twice")] + [(2000 + i, texts[4] + f" {i % 3}") for i in range(9)]


@pytest.mark.parametrize("bits", [64, 3])
def test_copies_by_brute_force(spark, bits):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, recipe string, n int, kept boolean").repartition(5)
    got = chunks.exact_copies(docs, bits=bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert chunks.exact_copies(docs.limit(0), bits=bits).count() == 0


def test_more_groups_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(chunks, "FEW_GROUPS", 2)
    monkeypatch.setattr(chunks, "FEW_RECIPES", 1)
    rows = odd_rows(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (64, 2):
        assert sorted(map(tuple, chunks.exact_copies(docs, bits=bits).collect()), key=str) == brute(rows)


def test_chunks_are_the_text_and_meet_again_behind_an_insertion(spark):
    draw = random.Random(3)
    text = " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(1, 9))) for _ in range(20_000))
    table = spark.createDataFrame([(text,), ("put in front " + text,)], "t string").select(chunks.chunks(F.col("t")).alias("c")).collect()
    first, second = (r.c for r in table)
    assert "".join(first) == text and "".join(second) == "put in front " + text
    assert max(map(len, first)) <= chunks.MOST + 1 and len(set(first) & set(second)) >= len(first) - 3


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = chunks.exact_copies(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_chunk_recipes(spark, SF).collect()), key=str) == brute(rows)
