"""Independent corroboration: publishers, and how many of them report a story on their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "com.au", "net.au", "co.nz", "co.za", "com.br", "com.mx", "co.jp", "co.kr", "com.sg", "com.tr"]


def host(url: Column) -> Column:
    """The host name of an http(s) address in lower case, without its port; else ''."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[hH][tT][tT][pP][sS]?://(?:[^/?#@\s]*@)?([^/?#:\s]+)", 1))


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host, three behind a suffix of two; addresses and localhost as they are."""
    bare = F.regexp_replace(F.regexp_replace(host(url), r"^(?:www|m|amp)\.", ""), r"\.$", "")
    labels = F.split(bare, r"\.")
    last = lambda n: F.substring_index(bare, ".", -n)
    whole = (bare == "localhost") | bare.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") | (F.size(labels) <= 2)
    return F.when(whole, bare).when(last(2).isin(TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def publisher_key(name: Column, url: Column, source_type: Column) -> Column:
    """Who answers for a report: a social account, else the publisher's domain, else its name, else unknown."""
    plain, domain = text.fingerprint(name), registrable_domain(url)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://[^/]+/([^/?#]+)", 1)
    account = F.when(plain != "", plain).when(host(url) != "", F.concat(host(url), F.lit("/"), path)).otherwise("")
    return F.when((source_type == "social") & (account != ""), F.concat(F.lit("social:"), account)).when(domain != "", F.concat(F.lit("domain:"), domain)).when(plain != "", F.concat(F.lit("name:"), plain)).otherwise("unknown")


def independent_sources(reports: DataFrame, story: list[str], seq: str) -> DataFrame:
    """(story.., independent): how many publishers report each story independently, 1 at least.

    ``reports`` has (story.., seq, identity, publisher, fingerprint).  Set form of the ordered rule: of each identity
    the first report counts (those without one all do), of these the first of each known publisher, and of those each
    different fingerprint once and every one without a fingerprint.
    """
    by_identity = Window.partitionBy(*story, "identity").orderBy(seq)
    first = reports.withColumn("_i", F.row_number().over(by_identity)).where("identity is null or _i = 1").where("publisher <> 'unknown'")
    by_publisher = Window.partitionBy(*story, "publisher").orderBy(seq)
    own = first.withColumn("_p", F.row_number().over(by_publisher)).where("_p = 1")
    mark = F.nullif("fingerprint", F.lit(""))
    counted = own.groupBy(*story).agg((F.count_distinct(mark) + F.count_if(mark.isNull())).alias("_n"))
    every = reports.select(*story).distinct()
    return every.join(counted, story, "left").select(*story, F.greatest(F.lit(1), F.coalesce("_n", F.lit(0))).cast("bigint").alias("independent"))


def story_impact(stories: DataFrame, counts: DataFrame, story: list[str]) -> DataFrame:
    """``stories`` (story.., tier) with their independent publishers and impact."""
    return stories.join(counts, story, "left").withColumn("impact", scores.impact(F.col("tier"), F.coalesce("independent", F.lit(1))))
