"""URL filtering by dated lists: every capture is judged by the entries in force when it was fetched.

A list is a log of dated entries, each of which adds or removes a pattern. Per pattern and list the log becomes
validity intervals that do not overlap. A capture asks for its host, parent domains and path prefixes at
every depth that some pattern of the list has; the as-of join finds the interval of each of those patterns that holds
its fetch time.

The join is on (pattern, time bucket): intervals are written into every bucket that they touch, so a pattern with very
many entries, or a host with very many captures, is spread over as many join keys as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablekit.llm.common import col

#: Length of a time bucket in seconds.
BUCKET_SECONDS = 30 * 86_400
_FOREVER = 253_402_300_799  # the last second of the year 9999


def canonical(url: Column) -> Column:
    """Host in lower case without user, port or trailing dot, then the path without query, fragment or trailing
    slash; null for what has no host."""
    parts = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)\.?(?::\d*)?(/[^?#]*)?"
    host = F.lower(F.regexp_extract(url, parts, 1))
    path = F.regexp_replace(F.regexp_extract(url, parts, 2), "/+$", "")
    return F.when(F.length(host) > 0, F.concat(F.regexp_replace(host, r"\.+$", ""), path))


def patterns_of(address: Column, domains: list[int], paths: list[int]) -> Column:
    """Every pattern of the given depths that can match a canonical address: the domains of so many labels that its host
    is or lies in, and the host with its path up to so many pieces (the host is the first piece)."""
    pieces = F.split(address, "/")
    labels = F.split(pieces[0], r"\.")
    within = lambda depths, most: F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda k: k <= most)
    ends = F.transform(within(domains, F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, -k, k)))
    starts = F.transform(within(paths, F.size(pieces)), lambda k: F.concat_ws("/", F.slice(pieces, 1, k)))
    return F.concat(ends, starts)


def validity(entries: DataFrame) -> DataFrame:
    """(list, pattern, category, since, until) in seconds, until excluded, from entries(list, pattern, category,
    listed_at timestamp, active boolean).

    An entry holds from its date to the next entry of its list and pattern. Of entries of one date the inactive ones
    come first, then by category, so the last is an active one if there is any. Entries with a null list, pattern or
    date do not count; a null `active` means true. As in addresses, the host of a pattern counts in lower case, its path
    as it is.
    """
    pattern = F.regexp_replace(F.trim(col("pattern").cast("string")), "/+$", "")
    known = entries.select(
        col("list").cast("string").alias("list"),
        F.concat(F.lower(F.regexp_extract(pattern, "^[^/]*", 0)), F.regexp_extract(pattern, "(?s)/.*", 0)).alias("pattern"),
        F.coalesce(col("category").cast("string"), F.lit("")).alias("category"),
        F.unix_seconds(col("listed_at").cast("timestamp")).alias("since"),
        F.coalesce(col("active"), F.lit(True)).alias("active"),
    ).filter("list is not null and pattern is not null and pattern <> '' and since is not null")
    one = known.groupBy("list", "pattern", "since").agg(F.max(F.struct("active", "category")).alias("e"))
    following = F.lead("since").over(Window.partitionBy("list", "pattern").orderBy("since"))
    spans = one.select("list", "pattern", "since", F.coalesce(following, F.lit(_FOREVER)).alias("until"), "e.active", "e.category")
    return spans.filter("active").select("list", "pattern", "category", "since", "until")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id, address, fetched_at, blocked, n_matches, list, pattern, category, since): one row per capture.

    The entry shown is the most specific one in force at the fetch time: the longest pattern, then the latest date, then
    the smallest list. A capture without a host or fetch time, or with nothing in force, is not blocked and has nulls.
    Repeated captures (same id, URL and time) count once; null ids are kept. Empty lists block nothing.
    """
    known = (
        captures.select(col(id_col).alias("id"), col(url_col).cast("string").alias("url"), col(time_col).cast("timestamp").alias("fetched_at"))
        .distinct()
        .withColumn("address", canonical(F.col("url")))
        .withColumn("t", F.unix_seconds("fetched_at"))
    )
    spans = validity(entries)
    # Buckets reach from the first entry to the last one; what is in force after that lies in the last bucket. Depths are
    # those that patterns have: labels of patterns without a path, pieces of the others.
    bucket = lambda t: F.floor(t / BUCKET_SECONDS)
    pieces = F.size(F.split("pattern", "/"))
    edge = spans.agg(
        F.min("since").alias("a"),
        F.max("since").alias("b"),
        F.sort_array(F.collect_set(F.when(pieces == 1, F.size(F.split("pattern", r"\."))))).alias("domains"),
        F.sort_array(F.collect_set(F.when(pieces > 1, pieces))).alias("paths"),
    ).first()
    if edge["a"] is None:
        return _judged(known, None)
    low, high = edge["a"] // BUCKET_SECONDS, edge["b"] // BUCKET_SECONDS
    inside = lambda b: F.greatest(F.lit(low), F.least(F.lit(high), b))
    spread = spans.withColumn("bucket", F.explode(F.sequence(inside(bucket(F.col("since"))), inside(bucket(F.col("until") - 1)))))
    asked = known.filter("address is not null and t is not null").select("id", "url", "fetched_at", "t", inside(bucket(F.col("t"))).alias("bucket"), F.explode(patterns_of(F.col("address"), edge["domains"], edge["paths"])).alias("pattern"))
    met = asked.join(spread, ["pattern", "bucket"]).filter("since <= t and t < until")
    best = met.groupBy("id", "url", "fetched_at").agg(
        F.count("*").alias("n_matches"),
        F.min(F.struct((-F.length("pattern")).alias("l"), (-F.col("since")).alias("s"), "list", "pattern", "category")).alias("m"),
    )
    return _judged(known, best)


def _judged(known: DataFrame, best: DataFrame | None) -> DataFrame:
    if best is None:
        none = {"n_matches": F.lit(0).cast("long"), "list": F.lit(None).cast("string"), "pattern": F.lit(None).cast("string"), "category": F.lit(None).cast("string"), "since": F.lit(None).cast("long")}
        return known.select("id", "address", "fetched_at", F.lit(False).alias("blocked"), *[v.alias(k) for k, v in none.items()])
    best = best.select(F.col("id").alias("m_id"), F.col("url").alias("m_url"), F.col("fetched_at").alias("m_time"), "n_matches", "m")
    same = F.col("id").eqNullSafe(F.col("m_id")) & F.col("url").eqNullSafe(F.col("m_url")) & (F.col("fetched_at") == F.col("m_time"))
    return known.join(best, same, "left").select(
        "id",
        "address",
        "fetched_at",
        F.col("m").isNotNull().alias("blocked"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.col("m.list").alias("list"),
        F.col("m.pattern").alias("pattern"),
        F.col("m.category").alias("category"),
        (-F.col("m.s")).alias("since"),
    )
