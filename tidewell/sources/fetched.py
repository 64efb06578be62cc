"""Responses of a fetch as a table, followed from hop to hop under the rules of a safe fetch.

Fetching itself is out of the engine: `responses` (url, status, location, announced_bytes, body) holds what each URL answered, and
`addresses` (host, address) what its host resolved to. Following them is a recursive query: a level a hop, in which every request that
was redirected meets the response of its next URL. It stops where no request has a next hop, and after `most` redirects at any rate.
"""

from __future__ import annotations

import uuid
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import text as tx
from tidewell.operators import filters

# Statuses that redirect, the largest number of redirects and of bytes that may be allowed.
REDIRECTS = (301, 302, 303, 307, 308)
MOST_REDIRECTS, MOST_BYTES = 10, 10_000_000


def _joined(location: str | None, url: str | None) -> str | None:
    try:
        return urldefrag(urljoin(url or "", (location or "").strip())).url if (location or "").strip() else None
    except ValueError:
        return None


joined_udf = F.pandas_udf(lambda location, url: pd.Series([_joined(*x) for x in zip(location, url, strict=True)], dtype=object), T.StringType())


def refusal(url: Column, allowed: Column, public: Column) -> Column:  # F16, F17, F18
    """Why a hop to this URL is not made, or null. public: whether all addresses of its host are, null if it has none."""
    return (
        F.when(url.isNull() | ~filters.safe_url(url), "URL_UNSAFE")
        .when(~filters.host_allowed(tx.url_host(url), allowed), "HOST_NOT_ALLOWED")
        .when(public.isNull(), "HOST_UNRESOLVED")
        .when(~public, "ADDRESS_NOT_PUBLIC")
    )


def hosts(addresses: DataFrame) -> DataFrame:  # F18
    """host, public: whether every address of the host is public."""
    return addresses.groupBy(F.lower("host").alias("host")).agg(F.bool_and(filters.public_address(F.col("address"))).alias("public"))


def _public(url: Column, known: Column) -> Column:
    """What the table knows of the URL's host; a host that is an address speaks for itself."""
    host = tx.url_host(url)
    return F.when(host.rlike(r"^\d+\.\d+\.\d+\.\d+$"), filters.public_ipv4(host)).otherwise(known)


def answered(status: Column, announced: Column, body: Column, most_bytes: Column) -> Column:
    """Why the answer of the last hop is no payload, or null."""
    ok = status.between(200, 299)
    return (
        F.when(status.isNull(), "NOT_FETCHED")
        .when(status.isin(*REDIRECTS), "REDIRECT_WITHOUT_LOCATION")
        .when(ok & (F.greatest(F.coalesce(announced, F.lit(0)), F.coalesce(F.octet_length(body), F.lit(0))) > most_bytes), "RESPONSE_TOO_LARGE")
        .when(~ok & (status != 304), F.concat(F.lit("HTTP_"), status.cast("string")))
    )


def followed(requests: DataFrame, responses: DataFrame, addresses: DataFrame, most: int = 5) -> DataFrame:  # SC16
    """requests (key, url, allowed_domains, most_bytes) with the last URL, the hops of the way, its status and payload (null unless it
    is one; empty for 304), and the code of what ended it otherwise. One response a URL, the first in order of body if there are more."""
    if not 0 <= most <= MOST_REDIRECTS:
        raise ValueError("most must be 0 to 10")
    spark = requests.sparkSession
    asked = requests.select("key", "url", "allowed_domains", F.least(F.col("most_bytes"), F.lit(MOST_BYTES)).alias("most_bytes"))
    public = hosts(addresses)
    once = responses.groupBy("url").agg(F.min(F.struct("body", "status", "location", "announced_bytes")).alias("r")).select("url", "r.*")
    moves = once.where(F.col("status").isin(*REDIRECTS) & (F.trim("location") != "")).select("url", joined_udf("location", "url").alias("next_url"))
    moves = moves.join(public.withColumnRenamed("host", "next_host"), tx.url_host(F.col("next_url")) == F.col("next_host"), "left").select("url", "next_url", _public(F.col("next_url"), F.col("public")).alias("next_public"))
    start = asked.join(public, tx.url_host(F.col("url")) == F.col("host"), "left").select("key", "url", "allowed_domains", F.lit(0).alias("hop"), refusal(F.col("url"), F.col("allowed_domains"), _public(F.col("url"), F.col("public"))).alias("code"))
    names = {x: f"_{x}_{uuid.uuid4().hex}" for x in ("start", "moves")}
    start.createOrReplaceTempView(names["start"])
    # Of each move and each list of domains that meets it, the verdict is an expression of the pair; it stands in the recursion as a column.
    moves.createOrReplaceTempView(names["moves"])
    way = spark.sql(
        f"""
        with recursive way(key, url, allowed_domains, hop, code, next_public) max recursion level {MOST_REDIRECTS + 2} as (
          select key, url, allowed_domains, hop, code, cast(null as boolean) from {names["start"]}
          union all
          select w.key, m.next_url, w.allowed_domains, w.hop + 1, case when w.hop >= {most} then 'REDIRECT_LIMIT_EXCEEDED' end, m.next_public
          from way w join {names["moves"]} m on w.url = m.url
          where w.code is null and (w.hop = 0 or w.next_public) and w.hop <= {most})
        select * from way"""
    )
    code = F.coalesce("code", F.when(F.col("hop") > 0, refusal(F.col("url"), F.col("allowed_domains"), F.col("next_public"))))
    hops = way.select("key", "url", "hop", code.alias("code"))
    # A hop that is refused ends the way, whatever the table would have answered behind it.
    ended = hops.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("hop", "url", "code"))).alias("hops"))  # most + 2 at most
    stop = F.coalesce(F.get(F.filter("hops", lambda h: h["code"].isNotNull()), F.lit(0))["hop"], F.size("hops") - 1)
    ended = ended.withColumn("stop", stop).select("key", F.slice("hops", F.lit(1), F.col("stop") + 1).alias("hops"))
    last = F.element_at("hops", -1)
    ended = ended.select("key", last["url"].alias("last_url"), last["code"].alias("refused"), F.transform("hops", lambda h: h["url"]).alias("hops"))
    out = asked.join(ended, "key").join(once.withColumnRenamed("url", "last_url"), "last_url", "left")
    code = F.coalesce("refused", answered(F.col("status"), F.col("announced_bytes"), F.col("body"), F.col("most_bytes")))
    return out.withColumn("code", code).select("key", "url", "last_url", "hops", F.when(F.col("refused").isNull(), F.col("status")).alias("status"), F.when(F.col("code").isNull(), F.when(F.col("status") == 304, "").otherwise(F.coalesce("body", F.lit("")))).alias("payload"), "code")
