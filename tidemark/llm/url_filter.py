"""URL filters from dated lists, in DataFrame functions only.

Dated list entries (added, removed) become validity intervals; a capture is blocked by the entries that
were active when it was fetched. A URL's keys are its host, the host's parent domains, and the host
with each leading part of the path; the as-of join is an equality of keys with a bound on the time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import picked


#: Labels of a host and parts of a path that a key has at most. Longer entries are looked up by so many and then compared whole.
MOST_PARTS = 32
#: Parts that the captures of one entry are dealt to.
DEALS = 16
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/?#:@]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or trailing dot; null where the URL has none.

    The user ends at the last "@" before the path. An IPv6 address is a host with its brackets.
    """
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    """Path from its first slash, without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.when(F.startswith(host, F.lit("[")), F.array(host)).otherwise(F.split(host, r"\."))


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def keys_of(url: Column) -> Column:
    """All keys that an entry could have for this URL: its host and parent domains of two labels or more, and the host with the first parts of the path.

    Of the path, and of a parent domain, MOST_PARTS parts at most: a URL's keys take that many times its length, however long it is.
    """
    host = host_of(url)
    labels, parts = _labels(host), F.slice(_parts(path_of(url)), 1, MOST_PARTS)
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    from_label = F.sequence(F.greatest(F.size(labels) - MOST_PARTS + 1, F.lit(1)), last)
    parents = F.transform(from_label, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(parents, paths))).otherwise(F.array().cast("array<string>"))


def key_of(entry: Column) -> Column:
    """The key that finds an entry, host or host/path: the entry itself, or its first MOST_PARTS parts."""
    host = F.regexp_extract(entry, "^[^/]*", 0)
    labels, parts = _labels(host), _parts(F.regexp_extract(entry, "/.*$", 0))
    short = F.slice(labels, F.greatest(F.size(labels) - MOST_PARTS + 1, F.lit(1)), F.lit(MOST_PARTS))
    return F.when(F.size(parts) > 0, F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, MOST_PARTS), "/"))).otherwise(F.array_join(short, "."))


def covers(entry: Column, url: Column) -> Column:
    """Whether the entry is the URL's host, a parent domain, or the host with whole first parts of the path."""
    host = host_of(url)
    address = F.concat(host, F.lit("/"), F.array_join(_parts(path_of(url)), "/"))
    by_path = (address == entry) | F.startswith(address, F.concat(entry, F.lit("/")))
    return F.when(F.contains(entry, F.lit("/")), by_path).otherwise((host == entry) | F.endswith(host, F.concat(F.lit("."), entry)))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (list, entry, date, action) -> (list, entry, valid_from, valid_to): active from valid_from until before valid_to.

    action is add or remove; others, and rows with a null, are left out. Of several actions on one date
    the removal counts last. Repeated adds don't start a new interval. valid_to is null while active.
    """
    bare = F.rtrim("entry", F.lit("/"))
    named = F.concat(F.lower(F.regexp_extract(bare, "^[^/]*", 0)), F.regexp_extract(bare, "/.*$", 0))  # paths keep their case
    known = entries.where(F.col("action").isin("add", "remove"))
    e = known.select("list", named.alias("entry"), F.col("date").cast("date").alias("date"), (F.col("action") == "add").alias("on")).dropna()
    e = e.groupBy("list", "entry", "date").agg(F.min("on").alias("on"))
    w = Window.partitionBy("list", "entry").orderBy("date")
    changes = e.withColumn("was", F.lag("on", 1, False).over(w)).where("on != was")
    changes = changes.withColumn("valid_to", F.lead("date").over(w))
    return changes.where("on").select("list", "entry", F.col("date").alias("valid_from"), "valid_to")


def filtered(captures: DataFrame, entries: DataFrame, *, id_col: str, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """(id, blocked, lists, entries) for each row of captures: the lists, and entries, active for its URL at its time.

    Captures of one entry are dealt to DEALS parts, and the entries, which are few beside them, copied to
    each. Null or hostless URLs and null times are never blocked; URLs may have any length. Rows that repeat an id count as one capture each and come back
    as often; no entries block nothing. Other columns of captures play no part.
    """
    c = picked(captures, id=id_col, url=url_col, t=time_col).withColumn("t", F.col("t").cast("date"))
    keys = c.select("id", "url", "t", F.pmod(F.xxhash64("id", "url", "t"), F.lit(DEALS)).cast("int").alias("deal"), F.explode(keys_of(F.col("url"))).alias("key"))
    listed = intervals(entries).withColumn("key", key_of(F.col("entry"))).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    active = keys.join(listed, ["key", "deal"]).where("t >= valid_from and (valid_to is null or t < valid_to)").where((F.col("key") == F.col("entry")) | covers(F.col("entry"), F.col("url")))
    hits = active.groupBy("id", "url", "t").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.array_sort(F.collect_set("entry")).alias("entries"))
    same = F.expr("c.id <=> h.id and c.url <=> h.url and c.t <=> h.t")
    none = F.array().cast("array<string>")
    out = c.alias("c").join(hits.alias("h"), same, "left")
    return out.select(F.col("c.id").alias(id_col), F.col("h.lists").isNotNull().alias("blocked"), F.coalesce("h.lists", none).alias("lists"), F.coalesce("h.entries", none).alias("entries"))
