import hashlib
import json
import os
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from cragline.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    words = [WORD.findall(t or "") for _, t in rows]
    key = [2**63 - 1 if k is None else k for k, _ in rows]
    least = {}
    for k, w in zip(key, words):
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            least[g] = min(k, least.get(g, k))
    out = []
    for (k0, _), k, w in zip(rows, key, words):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < k:
                gone[i : i + width] = True
        out.append((k0, len(w), int(gone.sum()), " ".join(x for x, d in zip(w, gone) if not d)))
    return sorted(out, key=str)


def rows_of(seed):
    draw = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "few words only"), (5, "z " * 3000), (6, "z " * 40), (None, "z " * 20), (7, " ".join(passage)), (7, " ".join(passage)), (None, None)]
    for k in range(10, 60):
        w = [f"v{x}" for x in draw.integers(0, 6 if k % 5 == 0 else 3000, draw.integers(1, 120))]
        if k % 3 == 0:
            a = draw.integers(0, len(w))
            w = [*w[:a], *passage[draw.integers(0, 12) :], *w[a:]]
        rows.append((k, "  ".join(w) if k % 7 == 0 else " ".join(w)))
    return rows


@pytest.mark.parametrize("width", [5, 13])
def test_by_brute_force(spark, width):
    rows = rows_of(width)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, kept string")
    got = sorted((tuple(r) for r in substring.without_repeats(docs, width).collect()), key=str)
    assert got == brute(rows, width)
    digests = substring.without_repeats(docs, width, with_text=False)
    assert sorted(r.kept for r in digests.collect()) == sorted(hashlib.sha256(x[3].encode()).hexdigest() for x in brute(rows, width))


def test_many_groups_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(substring, "GROUP_BYTES", 200)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 900)
    rows = rows_of(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in substring.without_repeats(docs).collect()), key=str) == brute(rows, 13)


def test_hot_minimisers(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(k, " ".join([*(f"a{x}" for x in draw.integers(0, 40, 11)), "one", "hot", "phrase", *(f"b{x}" for x in draw.integers(0, 40, 11))])) for k in range(60)]
    rows += [(100 + k, t) for k, t in rows[::7]] + rows_of(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substring, "SAMPLED", 1)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 600)
    assert len(substring.hot_minimisers(docs, 13, "text", "doc_id"))
    assert sorted((tuple(r) for r in substring.without_repeats(docs).collect()), key=str) == brute(rows, 13)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring, "mixed", lambda x: x * np.uint64(0))  # every window has one hash
    ids = np.array([1, 2, 3, 1, 2, 3, 9, 1, 2, 3])
    start, key = np.array([0, 1, 3, 5, 7]), np.array([5, 4, 3, 2, 1])
    assert substring.least_keys(ids, start, key, 3).tolist() == [1, 4, 1, 2, 1]


def test_texts_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text, 79), (2, f"{text}\nnew  words", 90), (3, "kept  as is", 11), (4, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in substring.texts_without_repeats(docs).collect()}
    assert got == {1: (text, len(text)), 2: ("new words", 9), 3: ("kept  as is", 11), 4: (None, None)}
    assert substring.texts_without_repeats(docs.limit(0)).count() == 0


def test_answers_hold_for_rows_in_any_order():
    rows = [r for r in rows_of(3) if r[0] is not None]
    halves = [pa.table({"k": pa.array([k for k, _ in part], pa.int64()), "t": pa.array([t for _, t in part], pa.string())}) for part in (rows[::2], rows[1::2])]
    halves = [h.append_column("c0", h["k"]) for h in halves]
    sent = [substring._send(13, 7)((pa.scalar(g),), h) for g, h in enumerate(halves)]
    met = pa.concat_tables([substring._meet(13)(x) for x in _by(pa.concat_tables(sent), "bucket")])
    draw, got = np.random.default_rng(0), []
    for g, half in enumerate(halves):
        back = met.filter(pa.compute.equal(met["grp"], g))
        plain = substring._remove(13, 7, ["c0"], True)(half, back).sort_by("c0")
        for _ in range(5):
            mixed = half.take(draw.permutation(len(half)))
            again = substring._remove(13, 7, ["c0"], True)(mixed, back.take(draw.permutation(len(back))))
            assert again.sort_by([("c0", "ascending"), ("kept", "ascending")]) == plain.sort_by([("c0", "ascending"), ("kept", "ascending")])
        got += [tuple(r.values()) for r in plain.to_pylist()]
    assert sorted(got, key=str) == brute(rows, 13)


def _by(table, column):
    return [table.filter(pa.compute.equal(table[column], x)) for x in pa.compute.unique(table[column])]


def test_query_on_rows_in_other_orders(spark, tmp_path):
    from cragline.llm import queries

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()] + [(10_000 + k, t) for k, t in rows_of(2) if k is not None]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((k, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, n, gone, kept in brute(docs, 13))
    for k, dealt in enumerate((table.coalesce(1).sortWithinPartitions("doc_id"), table.repartition(7, "text").sortWithinPartitions("text"), table.repartitionByRange(3, "doc_id"))):
        dealt.write.parquet(f"file://{tmp_path}/{k}/documents.parquet")
        assert sorted(map(tuple, queries.op3_substring_dedup(spark, f"file://{tmp_path}/{k}").collect())) == want


CLUSTER = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__
spark = (SparkSession.builder.master("local-cluster[3,1,1024]").config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "12").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", sys.argv[2]).config("spark.driver.host", "127.0.0.1").getOrCreate())
print("STARTED", flush=True)
for _ in range(2):
    rows = __spark_entry__.queries()["op3_substring_dedup"](spark, sys.argv[1]).collect()
    print("ROWS", json.dumps([[r.doc_id, r.n_words, r.n_removed, r.kept_sha256] for r in rows]))
"""


def test_on_three_executors(spark, tmp_path):
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10_000 + k, t) for k, t in rows_of(2) if k is not None]
    folder, repo = tmp_path / "in", Path(__file__).resolve().parents[2]
    spark.createDataFrame([tuple(r) for r in docs], "doc_id long, text string").repartition(24).write.parquet(f"file://{folder}/documents.parquet")
    env = os.environ | {"PYTHONPATH": str(repo), "SPARK_WORKER_DIR": str(tmp_path / "work"), "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    for name in [x for x in env if x.startswith(("PYSPARK_GATEWAY", "PYSPARK_SUBMIT"))]:
        del env[name]
    run = subprocess.run([sys.executable, "-c", CLUSTER, f"file://{folder}", f"file://{tmp_path}/shared"], env=env, cwd=repo, capture_output=True, text=True, timeout=300)
    found = [sorted(map(tuple, json.loads(x[5:]))) for x in run.stdout.splitlines() if x.startswith("ROWS ")]
    want = sorted((k, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, n, gone, kept in brute([tuple(r) for r in docs], 13))
    if "STARTED" not in run.stdout:  # the place allows no further JVMs: nothing of the query has run
        pytest.skip("a cluster of three executors can't be started here: " + run.stderr)
    assert len(found) == 2, run.stderr
    assert found == [want, want]
