"""Quality rules in DataFrame and SQL functions only: fixed base rules, then robust multivariate outliers.

A text's statistics become a vector of five (log words, characters a word, symbols a word, share of repeated words,
share of repeated lines). For each language and source, and for each language, the covariance of three quarters
of the rows that has the least determinant is sought. The search starts from four estimates (medians and quartile ranges;
all rows; rows drawn in by tanh; rows drawn to a sphere), makes two concentration steps from each (distances, the three quarters of the rows with
the least ones, their mean and covariance), keeps the start with the least determinant and goes on from it until
no group's determinant falls any more. Fixed small variances are added to every covariance (a regularised determinant), as clean texts
have no spread at all in some statistics. The three quarters are cut on a histogram of distances whose bins hold sums of
differences and of their products, so every step reads the rows once, with partial sums, and no group is ever sorted or collected. A source's estimate is drawn towards its
language's by ``PRIOR`` rows. A text is rejected beyond ``CUTOFF`` in squared Mahalanobis distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragline.llm._spark import counted, pinned

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
DIMS = range(1, 6)
#: Of each statistic: histogram width for the start, and standard deviation that is allowed besides the estimated one.
WIDTHS, FLOORS = (0.05, 0.02, 0.005, 0.005, 0.005), (1.0, 0.35, 0.045, 0.12, 0.15)
#: Share of the rows in an estimate, its consistency factor for five dimensions, distance bins an octave.
CORE, CONSISTENT, BINS = 0.75, 1.41, 16
#: Concentration steps from every start and at most from the best one, and the fall of a log determinant that counts as one.
TRIALS, STEPS, FALL = 2, 10, 1e-3
#: Rows that a language's estimate weighs in a source's; the 0.999999 quantile of chi-square with five degrees of freedom, rounded.
PRIOR, CUTOFF = 50, 36.0
#: Estimates that are broadcast at most (about 300 bytes each).
FEW = 20_000


def text_statistics(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The columns ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words of every whole text.

    All in one projection of the row, without a shuffle. Null reads as empty. A word's three-word windows are told apart
    by 64-bit hashes within their text: sorted with their positions in the low bits, equal ones are neighbours.
    """
    t = F.coalesce(F.col("__t"), F.lit(""))
    keep = [F.col("doc_id")] if keep is None else keep
    rows = docs.select(*keep, docs[text].alias("__t"))
    names = [c for c in rows.columns if c != "__t"]
    rows = rows.select(*names, "__t", F.split(F.expr(f"trim(BOTH '{BLANKS}' FROM coalesce(__t, ''))"), "[\\x20\\x09-\\x0D]+").alias("__w"),
                       F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__l"))
    n = F.when(F.element_at("__w", 1) == "", 0).otherwise(F.size("__w"))
    rows = rows.select(*names, n.cast("long").alias("n_words"),
                       F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
                       (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                       (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
                       F.size("__l").cast("long").alias("n_lines"), "__w")
    windows = F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("__w") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))))
    names += ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    low = F.expr("shiftleft(1L, length(bin(n_words))) - 1L")
    rows = rows.select(*names, windows.alias("__h"), low.alias("__m"))
    rows = rows.select(*names, "__h", "__m", F.array_sort(F.transform("__h", lambda x, i: x.bitwiseAND(F.bitwise_not("__m")).bitwiseOR(i.cast("long")))).alias("__p"))

    def hash_at(p: Column) -> Column:
        return F.get("__h", p.bitwiseAND(F.col("__m")).cast("int"))

    def twin(p: Column, k: Column) -> Column:
        return F.coalesce(hash_at(F.get("__p", k)) == hash_at(p), F.lit(False))

    again = F.array_sort(F.transform(F.filter("__p", lambda p, k: twin(p, k - 1) | twin(p, k + 1)), lambda p: p.bitwiseAND(F.col("__m"))))
    rows = rows.select(*names, again.alias("__r"))
    covered = F.aggregate(F.transform("__r", lambda p, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get("__r", k + 1) - p, F.lit(3).cast("long")))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*names, covered.alias("n_repeat_words"))


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: Keys of a language and of a language and source; null is a value of its own.
LANG_KEY = "coalesce(concat('=', lang), '')"
FEATURES = f"""SELECT {LANG_KEY} AS lk, concat({LANG_KEY}, '|', coalesce(concat('=', source), '')) AS gk, *,
 CAST(ln(CAST(greatest(n_words, 1) AS DOUBLE)) AS DOUBLE) AS x1, CAST(word_chars AS DOUBLE) / greatest(n_words, 1) AS x2,
 CAST(n_symbols AS DOUBLE) / greatest(n_words, 1) AS x3, CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1) AS x4,
 CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) AS x5 FROM {{stats}}"""
XS = ", ".join(f"x{i}" for i in DIMS)
PAIRS = [(i, j) for i in DIMS for j in DIMS if j <= i]
ROWS = f"SELECT lk AS mk, {XS} FROM {{features}} WHERE NOT base_failed UNION ALL SELECT gk, {XS} FROM {{features}} WHERE NOT base_failed"
START = (
    "SELECT mk, 0 AS s, CAST(max(t) AS DOUBLE) AS n, "
    + ", ".join(f"max(CASE WHEN f = {i} THEN (q2 + 0.5E0) * {w}E0 END) AS m{i}" for i, w in zip(DIMS, WIDTHS)) + ", "
    + ", ".join("0E0" + f" AS c{i}{j}" if i != j else f"max(CASE WHEN f = {i} THEN pow((q3 - q1) * {WIDTHS[i - 1]}E0 / 1.349E0, 2) END) + {FLOORS[i - 1] ** 2:.6f}E0 AS c{i}{i}" for i, j in PAIRS)
    + """ FROM (SELECT mk, f, max(t) AS t, min(CASE WHEN c >= 0.25E0 * t THEN b END) AS q1, min(CASE WHEN c >= 0.5E0 * t THEN b END) AS q2,
 min(CASE WHEN c >= 0.75E0 * t THEN b END) AS q3 FROM (SELECT mk, f, b, sum(n) OVER (PARTITION BY mk, f ORDER BY b) AS c, sum(n) OVER (PARTITION BY mk, f) AS t
 FROM (SELECT mk, f, b, count(*) AS n FROM ("""
    + " UNION ALL ".join(f"SELECT mk, {i} AS f, CAST(floor(x{i} / {w}E0) AS BIGINT) AS b FROM {{rows}}" for i, w in zip(DIMS, WIDTHS))
    + ") bins GROUP BY mk, f, b) counts) sums GROUP BY mk, f) quartiles GROUP BY mk"
)


def _moments(x: str, factor: float) -> str:
    """Mean and covariance of the columns ``x``1 to 5."""
    return ", ".join(f"avg({x}{i}) AS m{i}" for i in DIMS) + ", " + ", ".join(
        f"{factor}E0 * covar_pop({x}{i}, {x}{j})" + (f" + {FLOORS[i - 1] ** 2:.6f}E0" if i == j else "") + f" AS c{i}{j}" for i, j in PAIRS)


#: Three more starts from the first: all rows as they are, drawn in by tanh, and drawn to a sphere.
DRAWN = ("SELECT mk, s, CAST(count(*) AS DOUBLE) AS n, " + _moments("y", 1.0) + " FROM (SELECT mk, s, "
         + ", ".join(f"CASE s WHEN 1 THEN x{i} WHEN 2 THEN m{i} + w{i} * tanh(z{i}) ELSE m{i} + w{i} * z{i} * sqrt(5E0 / greatest(r2, 1E-12)) END AS y{i}" for i in DIMS)
         + " FROM (SELECT mk, explode(array(1, 2, 3)) AS s, " + ", ".join(f"x{i}, m{i}, sqrt(c{i}{i}) AS w{i}, (x{i} - m{i}) / w{i} AS z{i}" for i in DIMS)
         + ", " + " + ".join(f"z{i} * z{i}" for i in DIMS) + " AS r2 FROM {rows} r JOIN (SELECT mk AS fk, * EXCEPT (mk) FROM {start}) p ON r.mk = p.fk) scaled) drawn GROUP BY mk, s")


def _minus(i: int, j: int) -> str:
    return "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))


#: Cholesky factors of the covariances, column by column, and the logarithm of their determinants.
FACTORS = "SELECT *, " + ", ".join(
    f"sqrt(c{j}{j}{_minus(j, j)}) AS l{j}{j}" if i == j else f"(c{i}{j}{_minus(i, j)}) / l{j}{j} AS l{i}{j}"
    for j in DIMS for i in DIMS if i >= j) + ", 2 * (" + " + ".join(f"ln(l{i}{i})" for i in DIMS) + ") AS log_det FROM {estimates}"
SOLVED = ", ".join(f"(x{i} - m{i}{''.join(f' - l{i}{k} * z{k}' for k in range(1, i))}) / l{i}{i} AS z{i}" for i in DIMS)
D2 = " + ".join(f"z{i} * z{i}" for i in DIMS)
#: Differences from an estimate's mean and the bin of the distance, in one pass; sums of a bin's differences and of their products.
DISTANCES = ("SELECT mk, s, " + ", ".join(f"x{i} - m{i} AS y{i}" for i in DIMS) + f""", {SOLVED}, {D2} AS d2, CAST(floor({BINS} * log2(d2 + 0.001E0)) AS BIGINT) AS b
 FROM {{rows}} r JOIN (SELECT mk AS fk, * EXCEPT (mk) FROM {{factors}}) p ON r.mk = p.fk""")
SUMS = ("SELECT mk, s, b, count(*) AS n, " + ", ".join(f"sum(y{i}) AS t{i}" for i in DIMS) + ", " + ", ".join(f"sum(y{i} * y{j}) AS u{i}{j}" for i, j in PAIRS)
        + " FROM {distances} GROUP BY mk, s, b")
#: The bins up to the one that completes the three quarters, summed.
CORES = ("SELECT mk, s, CAST(sum(n) AS DOUBLE) AS k, " + ", ".join(f"sum({c}) AS {c}" for c in [*(f"t{i}" for i in DIMS), *(f"u{i}{j}" for i, j in PAIRS)])
         + f" FROM (SELECT *, sum(n) OVER (PARTITION BY mk, s ORDER BY b) - n AS nearer, sum(n) OVER (PARTITION BY mk, s) AS t FROM {{sums}}) bins WHERE nearer < {CORE}E0 * t GROUP BY mk, s")
#: Mean and covariance of the three quarters beside the estimate (o) that they were found by.
ESTIMATES = (f"SELECT mk, s, k / {CORE}E0 AS n, " + ", ".join(f"o.m{i} + t{i} / k AS m{i}" for i in DIMS) + ", " + ", ".join(
    f"{CONSISTENT}E0 * (u{i}{j} / k - t{i} / k * (t{j} / k))" + (f" + {FLOORS[i - 1] ** 2:.6f}E0" if i == j else "") + f" AS c{i}{j}" for i, j in PAIRS)
    + ", o FROM {cores} JOIN (SELECT mk AS fk, s AS fs, struct(*) AS o FROM {factors}) p ON mk = fk AND s = fs")
#: The start of each group with the least determinant; the first among equals.
LEAST = f"SELECT e.* FROM (SELECT mk, min_by(struct(* EXCEPT (o)), struct(floor(log_det / {FALL}E0), s)) AS e FROM {{factors}} GROUP BY mk) best"
#: A step's estimate where its determinant is less than the best known, else that.
BETTER = f"""SELECT e.*, moved FROM (SELECT IF(moved, x, o) AS e, moved FROM (SELECT struct(* EXCEPT (o)) AS x, o, coalesce(log_det < o.log_det - {FALL}E0, false) AS moved
 FROM {{factors}}) both) chosen"""
MIXED = "SELECT k.gk AS mk, " + ", ".join(
    f"(g.n * g.{c} + {PRIOR} * l.{c}) / (g.n + {PRIOR}) AS {c}" for c in [*(f"m{i}" for i in DIMS), *(f"c{i}{j}" for i, j in PAIRS)]
) + " FROM (SELECT DISTINCT lk, gk FROM {features} WHERE NOT base_failed) k JOIN {estimates} g ON k.gk = g.mk JOIN {estimates} l ON k.lk = l.mk"
VERDICTS = f"""SELECT f.*, {SOLVED}, CASE WHEN base_failed THEN false ELSE coalesce({D2} <= {CUTOFF}E0, true) END AS kept
 FROM {{features}} f LEFT JOIN (SELECT mk AS fk, * EXCEPT (mk) FROM {{factors}}) p ON f.gk = p.fk"""


def least_determinants(rows: DataFrame) -> DataFrame:
    """For each mk the mean (m1 to m5), covariance (c11 to c55), Cholesky factors and log_det of the best three quarters found.

    ``rows`` holds mk and x1 to x5, none null. A group of one row has that row as its mean and the fixed variances alone.
    """
    spark = rows.sparkSession
    start, found = counted(spark.sql(START, rows=rows))
    few = found["n"] <= FEW

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    def step(factors: DataFrame) -> DataFrame:
        sums = spark.sql(SUMS, distances=spark.sql(DISTANCES, rows=rows, factors=small(factors)))
        return spark.sql(FACTORS, estimates=spark.sql(ESTIMATES, cores=spark.sql(CORES, sums=sums), factors=small(factors)))

    starts = start.unionByName(spark.sql(DRAWN, rows=rows, start=small(start)))
    tried = pinned(spark.sql(FACTORS, estimates=starts))
    for _ in range(TRIALS - 1):
        tried = pinned(step(tried).drop("o"))
    best = pinned(spark.sql(LEAST, factors=step(tried)))
    for _ in range(STEPS):
        found, seen = counted(spark.sql(BETTER, factors=step(best)), moved=F.count_if("moved"))
        best = found.drop("moved")
        if not seen["moved"]:
            break
    return best


def judged(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id), the statistics, base_failed and kept: one row for each row of ``docs``.

    Null texts are empty and fail the base rules; null languages and sources are groups of their own; a lone
    text of a group is judged by its language's estimate, a lone one of a language is kept. An empty
    table gives an empty result. What is kept between steps is a small row of numbers for each text.
    """
    spark = docs.sparkSession
    keep = [F.col("doc_id")] if keep is None else keep
    stats = text_statistics(docs, text, [*keep, F.col("lang").alias("lang"), F.col("source").alias("source")])
    stats = stats.withColumn("base_failed", F.expr(BASE_FAILED))
    features = pinned(spark.sql(FEATURES, stats=stats))
    estimates = least_determinants(spark.sql(ROWS, features=features))
    factors, many = counted(spark.sql(FACTORS, estimates=spark.sql(MIXED, features=features, estimates=estimates)))
    if many["n"] <= FEW:
        factors = F.broadcast(factors)
    return spark.sql(VERDICTS, features=features, factors=factors)


def without_rejects(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject; all columns stay as they are.

    Rows are told apart by doc_id and a hash of their text: repeated rows have one verdict.
    """
    mark = F.xxhash64(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"))
    kept = judged(docs, keep=[mark.alias("mark")]).where("kept").select(F.col("mark").alias("__mark")).distinct()
    return docs.join(kept, mark == kept["__mark"], "left_semi")


#: The base statistics in DuckDB's SQL, by grouping windows as text.
DUCK_STATS = r"""docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
windows AS (SELECT r, i, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
counted AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat(w, ['']), 'string_agg', '')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
 CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM split LEFT JOIN covered USING (r)),
stats AS (SELECT *, """ + BASE_FAILED + " AS base_failed FROM counted)"


def duck_sql() -> str:
    """The whole operator for DuckDB, written apart from the above: order statistics and elimination instead of histograms and factors."""
    core = list(DIMS)

    def moments(x: str, factor: float) -> str:
        return ", ".join([*(f"avg({x}{i}) AS m{i}" for i in core), *(f"{factor} * covar_pop({x}{i}, {x}{j}) + {FLOORS[i - 1] ** 2 if i == j else 0} AS a{i}{j}_0" for i in core for j in core)])

    # Gaussian elimination: after k pivots a{i}{j}_k is what is left of the covariance
    solved = [f"a{i}{j}_{k - 1} - a{i}{k}_{k - 1} * a{k}{j}_{k - 1} / a{k}{k}_{k - 1} AS a{i}{j}_{k}" for k in core[:-1] for i in core[k:] for j in core[k:]]
    solved.append(" + ".join(f"ln(a{k}{k}_{k - 1})" for k in core) + " AS log_det")
    eliminated = "SELECT *, " + ", ".join(solved) + " FROM {}"
    left = [f"v{i}_{k - 1} - a{i}{k}_{k - 1} / a{k}{k}_{k - 1} * v{k}_{k - 1} AS v{i}_{k}" for k in core[:-1] for i in core[k:]]
    d2 = ", ".join([*(f"x{i} - m{i} AS v{i}_0" for i in core), *left, " + ".join(f"v{k}_{k - 1} ** 2 / a{k}{k}_{k - 1}" for k in core) + " AS d2"])
    quartile = lambda i, q: f"quantile_disc(floor(x{i} / {WIDTHS[i - 1]}), {q})"
    first = ", ".join([*(f"({quartile(i, 0.5)} + 0.5) * {WIDTHS[i - 1]} AS m{i}" for i in core), *(
        f"(({quartile(i, 0.75)} - {quartile(i, 0.25)}) * {WIDTHS[i - 1]} / 1.349) ** 2 + {FLOORS[i - 1] ** 2} AS a{i}{j}_0" if i == j else f"0.0::DOUBLE AS a{i}{j}_0" for i in core for j in core)])
    z = lambda i: f"((x{i} - m{i}) / sqrt(a{i}{i}_0))"
    r2 = "greatest(" + " + ".join(f"{z(i)} ** 2" for i in core) + ", 1e-12)"
    drawn = [("x", "x{i}"), ("t", "m{i} + sqrt(a{i}{i}_0) * tanh({z})"), ("u", "m{i} + sqrt(a{i}{i}_0) * {z} * sqrt(5 / r2)")]
    parts = [DUCK_STATS, f"""feats AS MATERIALIZED (SELECT *, coalesce('=' || lang, '') AS lang_key, lang_key || '|' || coalesce('=' || source, '') AS source_key, ln(greatest(n_words, 1)) AS x1,
 word_chars / greatest(n_words, 1) AS x2, n_symbols / greatest(n_words, 1) AS x3, n_repeat_words / greatest(n_words, 1) AS x4, n_dup_lines / greatest(n_lines, 1) AS x5 FROM stats)""",
             "points AS MATERIALIZED (SELECT unnest([lang_key, source_key]) AS g, x1, x2, x3, x4, x5 FROM feats WHERE NOT base_failed)",
             f"first AS MATERIALIZED (SELECT g, 0 AS s, count(*)::DOUBLE AS n, {first} FROM points GROUP BY g)"]
    pulled = ", ".join(f"{form.format(i=i, z=z(i))} AS {x}{i}_" for x, form in drawn for i in core)
    parts.append(f"pulled AS MATERIALIZED (SELECT g, {r2} AS r2, {pulled} FROM points JOIN first USING (g))")
    renamed = [f"SELECT g, {s} AS s, " + ", ".join(f"{x}{i}_ AS y{i}" for i in core) + " FROM pulled" for s, (x, _) in enumerate(drawn, 1)]
    parts.append(f"starts AS MATERIALIZED (SELECT * FROM first UNION ALL BY NAME SELECT g, s, count(*)::DOUBLE AS n, {moments('y', 1.0)} FROM ({' UNION ALL '.join(renamed)}) GROUP BY g, s)")
    parts.append(f"t0 AS MATERIALIZED ({eliminated.format('starts')})")

    def concentrated(before: str, name: str) -> list[str]:
        return [f"d_{name} AS MATERIALIZED (SELECT g, s, x1, x2, x3, x4, x5, floor({BINS} * log2(d2 + 0.001)) AS b FROM (SELECT *, {d2} FROM points JOIN {before} USING (g)))",
                f"n_{name} AS MATERIALIZED ({eliminated.format(f'(SELECT g, s, count(*) / {CORE} AS n, {moments(chr(120), CONSISTENT)} FROM (SELECT *, quantile_disc(b, {CORE}) OVER (PARTITION BY g, s) AS cut FROM d_{name}) WHERE b <= cut GROUP BY g, s)')})"]

    at = "t0"
    for k in range(TRIALS):
        parts += concentrated(at, f"t{k + 1}")
        at = f"n_t{k + 1}"
    parts.append(f"b0 AS MATERIALIZED (SELECT * FROM {at} QUALIFY row_number() OVER (PARTITION BY g ORDER BY floor(log_det / {FALL}), s) = 1)")
    for k in range(STEPS):
        parts += concentrated(f"b{k}", f"b{k + 1}")
        parts.append(f"""b{k + 1} AS MATERIALIZED (SELECT n.* FROM n_b{k + 1} n JOIN b{k} o USING (g) WHERE n.log_det < o.log_det - {FALL}
 UNION ALL BY NAME SELECT o.* FROM n_b{k + 1} n JOIN b{k} o USING (g) WHERE NOT n.log_det < o.log_det - {FALL})""")
    drawn_to = ", ".join(f"(o.n * o.{c} + {PRIOR} * l.{c}) / (o.n + {PRIOR}) AS {c}" for c in [*(f"m{i}" for i in core), *(f"a{i}{j}_0" for i in core for j in core)])
    parts.append(f"""mixed AS MATERIALIZED ({eliminated.format(f"""(SELECT source_key, {drawn_to} FROM (SELECT DISTINCT lang_key, source_key FROM feats WHERE NOT base_failed) k
 JOIN b{STEPS} o ON o.g = source_key JOIN b{STEPS} l ON l.g = lang_key)""")})""")
    return f"""WITH {', '.join(parts)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {CUTOFF}, true) AS kept
 FROM (SELECT *, {d2} FROM feats LEFT JOIN mixed USING (source_key))"""
