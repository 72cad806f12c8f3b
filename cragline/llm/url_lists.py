"""URL filters with dated lists: a temporal as-of join of captures with list entries, in DataFrame functions only.

A list's history holds dated actions on hosts. For each list and host, an action is in force until the
next one, so the history becomes validity intervals. Captures and the starts of intervals are put in one order of time for each
domain and list; each capture takes the last interval that began at or before its fetch time and keeps it where it hasn't ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Captures of a domain in one piece, about.
PIECE = 1000
END = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user, port and a final dot; empty where there is none (null, no scheme)."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and every parent domain of it, longest first; none for an empty host."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def intervals(history: DataFrame) -> DataFrame:
    """(list, domain, valid_from, valid_to) from (list, domain, at, action): 'add' holds until the next action on the same domain.

    valid_to is exclusive. Of several actions at one time the last by name counts (remove after add). Rows with a null list,
    domain, time or action, and a removal without an addition, leave nothing. Adding again while listed splits the interval.
    """
    each = Window.partitionBy("list", "domain").orderBy("at")
    one = history.dropna(subset=["list", "domain", "at", "action"]).withColumn("domain", F.lower("domain")).groupBy("list", "domain", "at").agg(F.max("action").alias("action"))
    spans = one.withColumn("valid_to", F.coalesce(F.lead("at").over(each), F.lit(END).cast("timestamp")))
    return spans.where("action = 'add'").select("list", "domain", F.col("at").alias("valid_from"), "valid_to")


def evaluated(captures: DataFrame, history: DataFrame, url: str, fetched: str, key: str) -> DataFrame:
    """key, host, n_active, list, entry, valid_from and allowed of each row of ``captures``.

    n_active: entries in force at fetch time on the host or a parent domain. Of these the most specific decides, then the
    least list name; list, entry and valid_from are its own. ``allowed`` is false where one is in force. A null URL or time
    is allowed: nothing can be looked up. Rows of one key are judged each for itself. Times of any year are looked up.
    """
    spans = intervals(history)
    rows = captures.select(captures[key].alias("k"), captures[url].alias("u"), captures[fetched].alias("f")).withColumn("h", host_of(F.col("u")))
    # one lookup for each distinct host and time: a host of a third of all rows is looked up once a time
    asked = rows.where("h <> '' AND f IS NOT NULL").select("h", "f").distinct()
    looked = asked.withColumn("domain", F.explode(domains_of(F.col("h")))).join(spans.select("domain").distinct(), "domain", "left_semi")
    # a domain with many captures is dealt into pieces, and its entries go to each of them
    crowds = looked.groupBy("domain").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    entries = spans.join(crowds, "domain").select("domain", F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"), "list", "valid_from", "valid_to")
    lists = entries.select("domain", "piece", "list").distinct()
    looked = looked.join(crowds, "domain").withColumn("piece", F.pmod(F.xxhash64("h", "f"), "pieces").cast("int")).drop("pieces").join(lists, ["domain", "piece"])
    # the as-of join: in the order of time, each capture takes the last interval that began at or before it
    events = looked.select("domain", "piece", "list", F.col("f").alias("at"), "h", F.lit(None).cast("timestamp").alias("valid_to")).unionByName(
        entries.select("domain", "piece", "list", F.col("valid_from").alias("at"), F.lit(None).cast("string").alias("h"), "valid_to"))
    before = Window.partitionBy("domain", "piece", "list").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("h").isNull(), F.struct(F.col("at").alias("valid_from"), "valid_to")), ignorenulls=True).over(before)
    met = events.withColumn("e", last).where("h IS NOT NULL AND at < e.valid_to").select("h", F.col("at").alias("f"), "domain", "list", "e.valid_from")
    first = F.min(F.struct((-F.length("domain")).alias("l"), F.col("list"), F.col("domain").alias("entry"), F.col("valid_from")))
    found = met.groupBy(F.col("h").alias("ah"), F.col("f").alias("af")).agg(F.count(F.lit(1)).alias("n"), first.alias("e"))
    out = rows.join(found, (rows["h"] == found["ah"]) & (rows["f"] == found["af"]), "left")
    return out.select(F.col("k").alias(key), F.col("h").alias("host"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
                      F.col("e.list").alias("list"), F.col("e.entry").alias("entry"), F.col("e.valid_from").alias("valid_from"), F.col("n").isNull().alias("allowed"))
