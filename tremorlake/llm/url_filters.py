"""URL filters with dated lists: temporal list join.

List entries are dated: on a day a pattern is added to a category or removed from it. The entries of a
pattern in a category become validity intervals, each up to the day before the next entry of both. A capture is
evaluated against the entries active when it was fetched: its URL gives the patterns that could name it
(host, parent domains, host with each leading part of the path), and an as-of join on pattern and time
finds the active ones. The most specific (longest) pattern decides. If it is active in several
categories, ``allow``, which lifts a block, comes first, then the smallest.

Both sides are normalised alike: blanks around them, scheme, user, port, a host's case and final dot, empty
path segments, query and fragment say nothing; the case of a path does. A URL may lack its scheme (//host/x),
an entry its scheme and slashes (host/x). Addresses (1.2.3.4, [::1]) have no parent domains. Of a path the leading
parts up to the list's deepest entry are compared: a deeper one has no entry to meet.

A NULL or unparsable URL, or a NULL fetch date, matches nothing. Entries without pattern or date are
ignored. Of several entries of a pattern and category on one day an addition wins; a NULL category is the empty one.
Repeated captures are evaluated one by one. Columns other than the ones named here are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tremorlake.llm.common import BLANKS, staged

HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)"
ADDRESS = r"^(?:\[.*\]|[0-9]+(?:\.[0-9]+){3})$"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.btrim(url, F.lit(BLANKS)), HOST, 1)), r"\.+$", "")


def segments_of(url: Column) -> Column:
    parts = F.split(F.regexp_extract(F.btrim(url, F.lit(BLANKS)), PATH, 1), "/")
    return F.filter(parts, lambda p: p != "")


def entry_of(pattern: Column) -> Column:
    """A list entry in the form of ``patterns_of``; NULL if it names no host."""
    bare = F.btrim(pattern, F.lit(BLANKS))
    url = F.when(bare.rlike("^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//"), bare).otherwise(F.concat(F.lit("//"), bare))
    host = host_of(url)
    return F.when(host != "", F.concat_ws("/", host, segments_of(url)))


def patterns_of(url: Column, deepest: int) -> Column:
    """Every pattern that names the URL: domains of two labels or more (or the host), and paths of up to ``deepest`` segments."""
    host, segments = host_of(url), segments_of(url)
    labels = F.split(host, r"\.")
    most = F.when(host.rlike(ADDRESS), F.lit(1)).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))
    domains = F.transform(F.sequence(F.lit(1), most), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    n = F.least(F.size(segments), F.lit(deepest))
    ends = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    paths = F.transform(ends, lambda i: F.concat_ws("/", host, F.slice(segments, 1, i)))
    return F.when(host != "", F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to) from dated entries (pattern, category, dated, action)."""
    clean = entries.withColumn("pattern", entry_of(F.col("pattern")))
    clean = clean.where("pattern is not null and dated is not null and action in ('add', 'remove')")
    keys = ["pattern", "category", "dated"]
    clean = clean.withColumn("category", F.coalesce("category", F.lit("")))
    daily = clean.groupBy(*keys).agg(F.max(F.col("action") == "add").alias("added"))
    following = F.lead("dated").over(Window.partitionBy("pattern", "category").orderBy("dated"))
    spans = daily.select("pattern", "category", F.col("dated").alias("valid_from"), following.alias("valid_to"), "added")
    return spans.where("added").drop("added")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched, n_active, pattern, category, blocked) for every capture.

    The captures of a hot host are split by adaptive execution: nothing needs them in one task.
    """
    rows = captures.select("page_id", "url", "fetched", F.monotonically_increasing_id().alias("__row"))
    active = staged(intervals(entries), "intervals")
    deepest = active.agg(F.max(F.size(F.split("pattern", "/")))).first()[0] or 1
    asked = rows.select("*", F.explode_outer(patterns_of(F.col("url"), deepest - 1)).alias("__pattern"))
    asof = (
        (F.col("__pattern") == F.col("pattern"))
        & (F.col("fetched") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    )
    met = asked.join(active, asof, "left")
    order = F.struct((-F.char_length("pattern")).alias("n"), "pattern", (F.col("category") != "allow").alias("blocks"), "category")
    deciding = F.min(F.when(F.col("pattern").isNotNull(), order))
    judged = met.groupBy("__row", "page_id", "url", "fetched").agg(
        F.count("pattern").alias("n_active"), deciding.alias("__best")
    )
    return judged.select(
        "page_id",
        "url",
        "fetched",
        "n_active",
        F.col("__best.pattern").alias("pattern"),
        F.col("__best.category").alias("category"),
        F.coalesce(F.col("__best.category") != "allow", F.lit(False)).alias("blocked"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures of the ``pages`` table, which names no fetch date: days of one year by page id."""
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int"))
    return pages.select("page_id", "url", fetched.alias("fetched"))


def list_of(pages: DataFrame) -> DataFrame:
    """A dated list derived from the hosts and first path parts of the ``pages`` table."""
    url = F.col("url")
    named = pages.select("page_id", host_of(url).alias("host"), F.get(segments_of(url), 0).alias("part")).where("host <> ''")
    whole = named.select("page_id", F.col("host").alias("pattern"))
    parts = named.where("part is not null").select("page_id", F.concat_ws("/", "host", "part").alias("pattern"))
    seen = whole.union(parts).groupBy("pattern").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    kinds = F.element_at(F.array(*map(F.lit, ("malware", "adult", "spam", "allow"))), (F.col("low") % 4 + 1).cast("int"))
    start = F.col("low") % 200

    def entry(day: Column, action: str) -> Column:
        dated = F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int"))
        return F.struct(dated.alias("dated"), F.lit(action).alias("action"))

    dates = F.array(
        entry(start, "add"), entry(start + 20 + F.col("high") % 60, "remove"), entry(start + 120, "add"),
    )
    return seen.select("pattern", kinds.alias("category"), F.explode(dates).alias("e")).select("pattern", "category", "e.*")
