"""How the sources of a language differ in their words: the distance of every two, and the terms each has more of than the language.

Terms are counted in their tasks first. A group's distance from another one is a sum over all kept terms, but only postings are
visited: a term that one of the two lacks gives what follows from the histogram of the other's probabilities, and the postings of each term correct the
sum for pairs that both have it. The terms of a group are searched best first: buckets of terms with like counts bound what a
term in them can give by the bucket's highest probability and the least one the language has for any of its terms, and the search
ends once all bounds that are left lie below the last of the best found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.llm._spark import pinned
from cragline.llm._words import binary, flat, gather, pieces, word_spans

#: Bytes that no term holds: ASCII other than letters.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[[b for b in range(128) if not chr(b).isalpha()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes counted together in a task.
SLICE = 8 << 20
#: Probabilities are whole numbers of parts in so many; added to every count.
SCALE, PRIOR = 1_000_000_000, 5
#: Groups, and buckets due in a round, that are broadcast at most.
FEW = 100_000
#: Buckets an octave of counts; terms that a group looks at in the first round, about; growth of that from round to round.
BUCKETS, FIRST, GROWTH = 4, 256, 8
GROUP = ["lang", "source"]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the exact sum of the values of each."""
    found, which = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, which, values)
    return found, total


def _counted(part: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, c, d) of some texts; an empty term of no occurrences for each group."""
    langs, sources = (part.column(c).dictionary_encode() for c in GROUP)
    group, of = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
    data, offsets = flat(part.column("t"))
    starts, ends, first = word_spans(data, offsets, OUTSIDE)
    terms = binary(*gather(LOWER[data], starts, ends - starts)).dictionary_encode()
    many, row = max(1, len(terms.dictionary)), np.repeat(np.arange(part.num_rows), np.diff(first))
    held, times = np.unique(row * many + terms.indices.to_numpy(), return_counts=True)
    key = of[held // many] * many + held % many
    found, c = _summed(key, times)
    d = np.unique(key, return_counts=True)[1]
    group_of = np.r_[group[found // many], group]
    term = pa.concat_arrays([terms.dictionary.take(pa.array(found % many)).cast(pa.string()), pa.array([""] * len(group), pa.string())])
    none = np.zeros(len(group), np.int64)
    return pa.record_batch([langs.dictionary.take(pa.array(group_of // len(sources.dictionary))), sources.dictionary.take(pa.array(group_of % len(sources.dictionary))), term,
                            pa.array(np.r_[c, none]), pa.array(np.r_[d, none])], names=[*GROUP, "term", "c", "d"])


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lang, source, term, c, d): occurrences and documents of each term in each group; each group also has a row of the empty term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t", SLICE):
                yield _counted(part)

    read = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in GROUP), docs[text].alias("t"))
    rows = read.mapInArrow(run, "lang string, source string, term string, c long, d long")
    return rows.groupBy(*GROUP, "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 5) / (total + 5 terms)) in exact arithmetic; 0 without terms."""
    below = (total + PRIOR * terms).cast("decimal(20,0)")
    return F.when(terms == 0, F.lit(0).cast("long")).otherwise(F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)"), below))


def _small(table: DataFrame, most: int = FEW) -> DataFrame:
    """``table`` (already computed), broadcast where it has few rows."""
    return F.broadcast(table) if table.count() <= most else table


class Counts:
    """What both parts start from: ``groups`` (lang, source, g, n, v, base, own) and ``postings`` (lang, source, g, term, p, q, base)."""

    def __init__(self, docs: DataFrame, text: str, least: int):
        of_term = Window.partitionBy("lang", "term")
        rows = term_counts(docs, text).select("*", F.sum("d").over(of_term).alias("df"), F.sum("c").over(of_term).alias("lc"))
        rows = pinned(rows.where((F.col("df") >= least) | (F.col("term") == "")).select(*GROUP, "term", "c", "lc"))
        kept = rows.where("term <> ''")
        langs = kept.select("lang", "term", "lc").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lc").alias("ln"))
        groups = rows.groupBy(*GROUP).agg(F.sum("c").alias("n"), F.count_if(F.col("term") != "").alias("own")).join(langs, "lang", "left").fillna(0, ["v", "ln"])
        base = probability(F.lit(0), F.col("n"), F.col("v"))
        self.groups = pinned(groups.select("*", F.row_number().over(Window.partitionBy("lang").orderBy("source")).alias("g"), base.alias("base")))
        met = kept.join(_small(self.groups), GROUP)
        self.postings = met.select(*GROUP, "g", "term", probability(F.col("c"), F.col("n"), F.col("v")).alias("p"), probability(F.col("lc"), F.col("ln"), F.col("v")).alias("q"), "base",
                                   F.floor(BUCKETS * F.log2("c")).cast("int").alias("bucket"))


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term and two groups that have it: their distance there less what either's histogram gave."""
    for batch in batches:
        lists, langs = batch.column("held"), batch.column("lang").dictionary_encode()
        at = lists.offsets.to_numpy().astype(np.int64)
        g, p, b = (lists.values.field(c).to_numpy().astype(np.int64) for c in ("g", "p", "base"))
        lang, end = np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(at)), np.repeat(at[1:], np.diff(at))
        g, p, b, end = g[at[0] : at[-1]], p[at[0] : at[-1]], b[at[0] : at[-1]], end - at[0]
        wide, keys, sums = int(g.max(initial=0)) + 1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        i = np.arange(len(g))
        for k in range(1, int(np.diff(at).max(initial=0))):
            i = i[i + k < end[i]]
            j = i + k
            x = np.abs(p[i] - p[j]) - np.abs(p[i] - b[j]) - np.abs(p[j] - b[i]) + np.abs(b[i] - b[j])
            found, total = _summed((lang[i] * wide + g[i]) * wide + g[j], x)
            keys.append(found)
            sums.append(total)
        found, total = _summed(np.concatenate(keys), np.concatenate(sums))
        yield pa.record_batch([langs.dictionary.take(pa.array(found // wide**2)), pa.array((found // wide % wide).astype(np.int32)), pa.array((found % wide).astype(np.int32)), pa.array(total)],
                              names=["lang", "g", "t", "x"])


def source_distances(counts: Counts) -> DataFrame:
    """(lang, source, item, value): the sum over all kept terms of the difference in probability, for every two sources of a language."""
    groups, postings = counts.groups, counts.postings
    mine, other = (groups.select("lang", *(F.col(c).alias(f"{c}{x}") for c in ("source", "g", "base", "own", "v"))) for x in ("_a", "_b"))
    pairs = mine.join(other, "lang").where("g_a <> g_b")
    neither = pairs.select("lang", F.col("g_a").alias("g"), F.col("g_b").alias("t"), ((F.col("v_a") - F.col("own_a") - F.col("own_b")) * F.abs(F.col("base_a") - F.col("base_b"))).alias("x"))
    steps = postings.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("times"))
    to = groups.select("lang", F.col("g").alias("t"), "base")
    alone = steps.join(_small(to), "lang").where("g <> t").groupBy("lang", "g", "t").agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("base"))).alias("x"))
    held = postings.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("g", "p", "base"))).alias("held")).where("size(held) > 1").select("lang", "held")
    both = held.mapInArrow(_corrections, "lang string, g int, t int, x long").groupBy("lang", "g", "t").agg(F.sum("x").alias("x"))
    parts = pinned(alone.unionByName(both))
    turned = parts.select("lang", F.col("t").alias("g"), F.col("g").alias("t"), "x")
    total = neither.unionByName(parts).unionByName(turned).groupBy("lang", "g", "t").agg(F.sum("x").cast("long").alias("value"))
    names = pairs.select("lang", F.col("g_a").alias("g"), F.col("g_b").alias("t"), F.col("source_a").alias("source"), F.col("source_b").alias("item"))
    return total.join(names, ["lang", "g", "t"]).select(*GROUP, "item", "value")


def _best(rows: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def leading_terms(counts: Counts, most: int = 50) -> DataFrame:
    """(lang, source, item, value, rank): the ``most`` terms of each group whose probability exceeds the language's by most, found best first."""
    postings, key = counts.postings, [*GROUP, "bucket"]
    buckets = postings.groupBy(*key).agg((F.max("p") - F.min("q")).alias("bound"), F.count(F.lit(1)).alias("many"))
    unseen, best, budget = pinned(buckets.where("bound > 0")), None, FIRST
    while True:
        ahead = F.sum("many").over(Window.partitionBy(*GROUP).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1))
        due = pinned(unseen.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < budget).select(*key))
        found = postings.join(_small(due), key, "left_semi").where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        best = pinned(_best(found if best is None else found.unionByName(best.drop("rank")), most))
        last = best.where(F.col("rank") == most).select(*GROUP, F.col("value").alias("last"))
        unseen = pinned(unseen.join(due, key, "left_anti").join(last, GROUP, "left").where("last IS NULL OR bound >= last").select(*unseen.columns))
        if not unseen.limit(1).count():
            return best
        budget *= GROWTH


def audited(docs: DataFrame, text: str = "text", least: int = 30, most: int = 50) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank of each group of ``docs``.

    Null texts, languages and sources are empty. A language keeps the terms that ``least`` of its documents hold; one that keeps none has distances of 0
    and no terms. Equal values rank by the item's bytes; repeated rows count as often as they are; a language of one source has no pairs. An
    empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    counts = Counts(docs, text, least)
    pairs = source_distances(counts).withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))
    parts = [rows.select(*GROUP, F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for part, rows in (("pair", pairs), ("term", leading_terms(counts, most)))]
    return parts[0].unionByName(parts[1])


DUCK_SQL = r"""WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM docs),
kept AS MATERIALIZED (SELECT lang, w, count(*) AS c FROM words GROUP BY lang, w HAVING count(DISTINCT r) >= 30),
sizes AS (SELECT lang, sum(c) AS n, count(*) AS v FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, w, count(*) AS c FROM words SEMI JOIN kept USING (lang, w) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
dense AS MATERIALIZED (SELECT g.lang, g.source, k.w, coalesce(c.c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * s.v)::HUGEINT AS BIGINT) AS p,
 CAST(1 + (1000000000::HUGEINT * (k.c + 5)) // (s.n + 5 * s.v)::HUGEINT AS BIGINT) AS q FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON s.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.w = k.w),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, w AS item, p - q AS value FROM dense WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50"""
