import numpy as np
import pyarrow as pa
import pytest

from cragline.llm import ann, quality_model


def vectors(n=600, dims=24, seed=2):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, dims)).astype(np.float32)
    x[50:90] = x[0]  # one very common vector
    if n > 101:
        x[100] = 2 * x[101]
    return x


def table(spark, x):
    rows = [(i, [float(v) for v in r], 7) for i, r in enumerate(x)] + [(9000, None, 0), (9050, [], 0), (9100, [0.0] * x.shape[1], 0), (9150, [float("nan")] * x.shape[1], 0), (9200, [None] * x.shape[1], 0), (9250, [1.0], 0), (None, [1.0] * x.shape[1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def brute(x, k=5):
    x = x.astype(float)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in range(0, len(x), 50):
        s = (x * x[q]).sum(1) / (norm * norm[q])
        s[q] = -9
        order = np.lexsort((np.arange(len(x)), -s))[:k]
        out[q] = [(int(i), s[i]) for i in order]
    return out


@pytest.mark.parametrize("cell_rows,probed,least", [(10**6, 1, 0.98), (100, 3, 0.55), (100, 100, 0.98)])
def test_recall_and_scores(spark, cell_rows, probed, least):
    x = vectors()
    got = {}
    for r in ann.searched(table(spark, x), "vec_id % 50 = 0", cell_rows=cell_rows, probed=probed).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(x)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits >= least * 5 * len(want)
    norm = np.sqrt((x.astype(float) ** 2).sum(1))
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
        for v, s in ranks.values():
            assert v != q and abs(s - (x[v].astype(float) @ x[q].astype(float)) / norm[v] / norm[q]) < 1e-12
    assert [v for v, _ in (got[50][k] for k in range(1, 6))] == [0, 51, 52, 53, 54]  # ties: the least ids of the common vector


def test_queries_by_any_column_and_repeated_rows(spark):
    x = vectors(120)
    rows = [(i, [float(v) for v in r], i % 3 == 0, "id") for i, r in enumerate(x)]
    rows += [rows[30], (31, [float(v) for v in x[30]], False, "v")]  # a row repeated whole, and an id that repeats with another row's vector
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, not_vec_id boolean, id string")
    got = ann.searched(frame, "not_vec_id AND vec_id % 2 = 0", probed=100).collect()
    assert {r.query_id for r in got} == {i for i in range(120) if i % 6 == 0}
    assert [(r.vec_id, round(r.score, 12)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 30][:1] == [(31, 1.0)]
    assert all(r.vec_id != r.query_id for r in got)
    assert ann.searched(frame.where("false"), "vec_id % 50 = 0").count() == 0


def test_bounds_hold_mostly():
    x = ann.unit(vectors().astype(float))
    codes = ann.Codes(x, x.mean(0))
    about, error = codes.bounds(x[:80])
    assert (np.abs(about - x[:80] @ x.T) <= error).mean() > 0.9


def test_few_and_none(spark):
    x = vectors(3)
    assert ann.searched(table(spark, x), "vec_id % 50 = 0").count() == 2
    assert ann.searched(table(spark, x).limit(0), "vec_id % 50 = 0").count() == 0


def labelled(n, seed):
    draw = np.random.default_rng(seed)
    out = []
    for k in range(n):
        good = draw.random() < 0.7
        words = [f"{'clean' if good else 'junk'}{x}{'' if good else '$$'}" for x in draw.integers(0, 300, draw.integers(5, 80))]
        out.append((k, " ".join(words), int(good)))
    return out


def test_held_out_accuracy_and_inputs(spark):
    rows = labelled(900, 1)
    docs = spark.createDataFrame([(k, t, "en", "s", "x") for k, t, _ in rows] + [(5000, None, None, None, None), (5001, "", "en", "s", "x"), (None, "clean1 clean2", "en", "s", "x")], "doc_id long, text string, lang string, source string, score string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_model.scored(docs, labels).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    out = [(got[k].predicted, q) for k, _, q in rows if got[k].held_out]
    assert np.mean([p == q for p, q in out]) > 0.97 and 150 < len(out) < 300
    # held-out labels, language and source change nothing
    import zlib

    flipped = spark.createDataFrame([(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q) for k, _, q in rows], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in quality_model.scored(docs.withColumn("lang", docs["source"]), flipped).collect()}
    assert all(abs(again[k] - got[k].score) < 1e-9 for k in again)


def test_scores_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_model.scored(docs, none).collect()] == [0.5, 0.5]
    assert quality_model.scored(docs.limit(0), none).count() == 0


def test_folded_scores_equal_averages_of_vectors():
    rows = ["one two two three", "", "two", "é ü one"]
    f = quality_model.Features(pa.array(rows))
    table = np.random.default_rng(0).standard_normal(quality_model.BUCKETS)
    means = f.means(table)
    for k, (bucket, weight) in enumerate(f.rows()):
        assert abs(means[k] - (table[bucket] @ weight.astype(float) if len(bucket) else 0)) < 1e-6
