"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame and SQL functions only.

A source's documents are dealt to shards and form one stream of words in each, in a seeded order. Targets become
blocks of equal numbers of words: highest quotients apportion them to sources, and a source's blocks to its shards. A
shard takes its stream as often as its quota goes over it and then a seeded, evenly spaced choice of its blocks,
so that what a document gives follows from its place in the stream alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cragline.llm._spark import pinned

#: Words of a block; documents of a shard at least (the square root of all documents if that is more).
BLOCK, SHARD_ROWS = 32, 2048
#: Sources or shards whose quotas are broadcast at most.
FEW = 20_000


def apportioned(parties: DataFrame, within: list[str], name: str, votes: str, seats: str, quota: str) -> DataFrame:
    """``parties`` with the column ``quota``: the ``seats`` of each group given to the highest quotients votes / (2k + 1).

    No party is further from its exact share than half its share times the number of parties, plus one half: only quotients in
    that range are made and ranked, the seats below it are given at once. Ties go to the smaller ``name``. Parties
    without votes get none.
    """
    group = Window.partitionBy(*within)
    share = F.col(votes) / F.nullif(F.col("__all"), F.lit(0.0))
    rows = parties.withColumn("__all", F.sum(votes).over(group).cast("double")).withColumn("__n", F.count(F.lit(1)).over(group))
    rows = rows.withColumn("__exact", F.coalesce(share * F.col(seats), F.lit(0.0))).withColumn("__slack", F.coalesce(F.ceil(share * F.col("__n") / 2), F.lit(0)) + 2)
    rows = rows.withColumn("__low", F.greatest(F.floor("__exact") - F.col("__slack"), F.lit(0)).cast("long"))
    rows = rows.withColumn("__left", F.col(seats) - F.sum("__low").over(group))
    tried = rows.where(F.col(votes) > 0).select(*within, name, "__left", votes, F.explode(F.sequence("__low", (F.floor("__exact") + F.col("__slack")).cast("long"))).alias("__k"))
    ranked = tried.withColumn("__rank", F.row_number().over(group.orderBy((F.col(votes).cast("double") / (2 * F.col("__k") + 1)).desc(), name, "__k")))
    won = ranked.where("__rank <= __left").groupBy(*within, name).agg(F.count(F.lit(1)).alias("__won"))
    out = rows.join(won, [*within, name], "left")
    return out.select(*parties.columns, F.when(F.col(votes) > 0, F.col("__low") + F.coalesce("__won", F.lit(0))).otherwise(0).cast("long").alias(quota))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with src (its place by code point, null last) and target.

    Targets are the lesser of ``most`` times the size and one common multiple of the weight, chosen so that they sum to
    ``share`` times all sizes: what resharing every excess by weight ends in. One row for each source is sorted here.
    """
    everything = Window.partitionBy()
    rows = sources.withColumn("src", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    rows = rows.withColumn("__w", F.get(F.array(*[F.lit(int(w)) for w in weights]), F.col("src") % len(weights)))
    rows = rows.withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), "src")
    capped = F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("__w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("__level", (F.sum("source_size").over(everything) * F.lit(float(share)) - capped) / free)
    fits = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level"))
    rows = rows.withColumn("__level", F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least("__cap", F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap")))
    return rows.select("source", "source_size", "n_docs", "src", target.alias("target"))


def words(text: str) -> Column:
    trimmed = F.expr(f"trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM coalesce(`{text}`, ''))")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def _spread(seed: int, *parts: Column) -> Column:
    """32 bits of an MD5, as a long: the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])), 1, 8), 16, 10).cast("long")


FOUND = ("size", "source_size", "target", "taken", "passes", "start", "blocks", "picked", "shift")


def placed_words(docs: DataFrame, carry: list[str], weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """Columns ``carry`` as c0, c1, ..., and those of ``FOUND``.

    One row for each row of ``docs``. ``passes``: how often the whole text is taken; besides, word i of the text is
    taken where block (start + i) div ``block`` of its shard's stream is chosen (see ``chosen``). Null texts have no words. A null
    doc_id has a place of its own in the order; rows of one id lie side by side, the larger first.
    """
    mine = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(carry)]
    names = [f"c{i}" for i in range(len(carry))]
    sized = docs.select(docs["doc_id"].alias("id"), docs["source"].alias("source"), words("text").alias("size"), *mine)
    slim = set(carry) <= {"doc_id", "source"}
    counted = sized = pinned(sized) if slim else sized
    sources = pinned(targets(counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, share, most))
    total = sources.agg(F.count(F.lit(1)).alias("n"), F.sum("n_docs").alias("docs"), F.sum("target").alias("t")).first()
    rows = max(SHARD_ROWS, int((total["docs"] or 0) ** 0.5))
    blocks = int(round((total["t"] or 0.0) / block))
    sources = apportioned(sources.withColumn("__seats", F.lit(blocks).cast("long")), [], "src", "target", "__seats", "source_quota")
    sources = pinned(sources.withColumn("shards", F.ceil(F.col("n_docs") / rows).cast("int")).drop("__seats", "n_docs").withColumnRenamed("source", "its"))
    sources = F.broadcast(sources) if total["n"] <= FEW else sources
    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("its"))).drop("its").withColumn("shard", F.pmod(_spread(seed, F.col("id")), "shards").cast("int"))
    parts = placed.groupBy("src", "shard").agg(F.sum("size").alias("length"), F.first("source_quota").alias("source_quota"))
    parts = pinned(apportioned(parts, ["src"], "shard", "length", "source_quota", "quota").drop("source_quota"))
    parts = F.broadcast(parts) if parts.count() <= FEW else parts
    order = Window.partitionBy("src", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("-")))), "id", F.col("size").desc())
    placed = placed.withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(parts, ["src", "shard"])
    placed = placed.withColumn("passes", F.least(F.lit(int(most)), F.coalesce(F.expr(f"(quota * {block}) div nullif(length, 0)"), F.lit(0))).cast("long"))
    placed = placed.withColumn("blocks", F.greatest(F.ceil(F.col("length") / block), F.lit(1)).cast("long"))
    rest = F.when(F.col("passes") >= int(most), 0).otherwise(F.expr(f"round((quota * {block} - passes * length) / {block}.0D)"))
    placed = placed.withColumn("picked", F.least(F.col("blocks"), rest.cast("long"))).withColumn("shift", 1 + F.pmod(_spread(seed + 1, F.col("src"), F.col("shard")), "blocks"))
    taken = F.expr(f"passes * size + {_before('start + size', block)} - {_before('start', block)}").cast("long")
    return placed.select(*names, *[taken.alias(c) if c == "taken" else F.col(c) for c in FOUND])


def mixed(docs: DataFrame, carry: list[str] | None = None, **options) -> DataFrame:
    """Columns ``carry`` (default doc_id), size, source_size, target, taken and the numbers that say which words were taken; see ``placed_words``."""
    carry = ["doc_id"] if carry is None else carry
    return placed_words(docs, carry, **options).toDF(*carry, *FOUND)


def chosen(at: str) -> str:
    """SQL: whether the block with number ``at`` is one of the ``picked`` among ``blocks``."""
    return f"((({at}) + shift) * picked) % blocks < picked"


def _before(place: str, block: int) -> str:
    """SQL: words of the stream that lie in chosen blocks before ``place``; chosen ones are counted in closed form."""
    number = f"(({place}) div {block})"
    return (f"({block} * ((({number} + shift - 1) * picked) div blocks - ((shift - 1) * picked) div blocks)"
            f" + CASE WHEN {chosen(number)} THEN ({place}) % {block} ELSE 0 END)")


def mixed_texts(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """What the mix takes, as rows with the columns of ``docs``: each whole pass over a text, and the words chosen besides.

    A whole text stays as it is; words chosen from one are joined by one space; n_chars follows. Texts the mix takes
    nothing from leave.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, chars = (names[docs.columns.index(c)] for c in ("text", "n_chars"))
    out = placed_words(docs, docs.columns, block=block, **options)
    out = out.withColumn("part", F.expr(f"{_before('start + size', block)} - {_before('start', block)}"))
    none = F.array().cast("array<bigint>")
    copies = F.when(F.col("passes") > 0, F.sequence(F.lit(1).cast("long"), F.col("passes"))).otherwise(none)
    copies = F.concat(copies, F.when(F.col("part") > 0, F.array(F.lit(0).cast("long"))).otherwise(none))
    out = out.withColumn("copy", F.explode(copies))
    split = F.split(F.expr(f"trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM {text})"), "[\\x20\\x09-\\x0D]+")
    part = F.array_join(F.filter(split, lambda w, i: F.pmod((F.floor((F.col("start") + i) / block) + F.col("shift")) * F.col("picked"), F.col("blocks")) < F.col("picked")), " ")
    whole = (F.col("copy") > 0) | (F.col("part") == F.col("size"))
    out = out.withColumn("whole", whole).withColumn(text, F.when(whole, F.col(text)).otherwise(part))
    n_chars = F.when(F.col("whole"), F.col(chars)).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return out.withColumn(chars, n_chars).select(*names).toDF(*docs.columns)


def duck_sql(weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = BLOCK, seed: int = 17) -> str:
    """The operator in DuckDB's SQL; there every quotient of every party is made and ranked, instead of the few near its share."""
    def spread(seed: int, *parts: str) -> str:
        return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'coalesce(CAST({p} AS VARCHAR), chr(45))' for p in parts)})), 1, 8) AS BIGINT)"

    def before(place: str) -> str:
        number = f"(({place}) // {block})"
        return (f"({block} * ((({number} + shift - 1) * picked) // blocks - ((shift - 1) * picked) // blocks)"
                f" + CASE WHEN (({number} + shift) * picked) % blocks < picked THEN ({place}) % {block} ELSE 0 END)")

    return f"""WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, sum(size) AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sized GROUP BY source),
weighed AS (SELECT *, ([{', '.join(map(str, weights))}])[1 + src % {len(weights)}] AS w, source_size * {float(most)}::DOUBLE AS cap FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () * {share}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
aimed AS (SELECT *, least(cap, coalesce((SELECT arg_min(level, (cap / w, src)) FROM levels WHERE level * w <= cap) * w, cap)) AS target FROM levels),
seats AS (SELECT CAST(round(sum(target) / {block}) AS BIGINT) AS t, greatest({SHARD_ROWS}, CAST(floor(sqrt(sum(n))) AS BIGINT)) AS per FROM aimed),
won AS (SELECT src, count(*) AS quota FROM (SELECT src, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, src, k) AS r, t FROM (SELECT src, target, t, unnest(range(0, t)) AS k FROM aimed, seats WHERE target > 0)) WHERE r <= t GROUP BY src),
dealt AS (SELECT a.*, coalesce(won.quota, 0) AS source_quota, CAST(ceil(n / per::DOUBLE) AS BIGINT) AS shards FROM aimed a CROSS JOIN seats LEFT JOIN won USING (src)),
placed AS (SELECT s.doc_id, s.size, d.src, d.source_size, d.target, d.source_quota, {spread(seed, 's.doc_id')} % d.shards AS shard, md5(concat_ws(':', '{seed}', coalesce(CAST(s.doc_id AS VARCHAR), '-'))) AS h FROM sized s JOIN dealt d ON s.source IS NOT DISTINCT FROM d.source),
parts AS (SELECT src, shard, sum(size) AS length, max(source_quota) AS q FROM placed GROUP BY src, shard),
shares AS (SELECT src, shard, count(*) AS quota FROM (SELECT src, shard, q, row_number() OVER (PARTITION BY src ORDER BY CAST(length AS DOUBLE) / (2 * k + 1) DESC, shard, k) AS r FROM (SELECT src, shard, length, q, unnest(range(0, q)) AS k FROM parts WHERE length > 0)) WHERE r <= q GROUP BY src, shard),
filled AS (SELECT src, shard, CAST(length AS BIGINT) AS length, coalesce(quota, 0) AS quota FROM parts LEFT JOIN shares USING (src, shard)),
turns AS (SELECT *, least({most}, coalesce((quota * {block}) // nullif(length, 0), 0)) AS passes, greatest(CAST(ceil(length / {block}::DOUBLE) AS BIGINT), 1) AS blocks FROM filled),
picks AS (SELECT *, least(blocks, CASE WHEN passes >= {most} THEN 0 ELSE CAST(round((quota * {block} - passes * length) / {block}::DOUBLE) AS BIGINT) END) AS picked, 1 + {spread(seed + 1, 'src', 'shard')} % blocks AS shift FROM turns),
spots AS (SELECT doc_id, size, source_size, target, src, shard, CAST(sum(size) OVER (PARTITION BY src, shard ORDER BY h, doc_id, size DESC ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM placed)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(passes * size + {before('start + size')} - {before('start')} AS BIGINT) AS taken FROM spots JOIN picks USING (src, shard)"""
