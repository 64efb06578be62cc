"""Queries that follow fetched pages from hop to hop, over the rows of `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.plans.registry import query, table
from tidewell.sources import fetched

#: Every page is asked for; of a hundred, some lead on to the next page, to another host, to themselves or nowhere.
FETCHES = """
with recursive p as (select page_id as k, length(html) as n, html from pages),
r as (
  select k, case when k % 10 in (1, 2, 3, 4, 5) then 302 when k % 10 = 6 then 301 when k % 10 = 7 then 304 when k % 100 = 8 then 404 else 200 end as status,
    case when k % 10 in (1, 2, 3) then '/p/' || (k + 1) when k % 10 = 4 then 'https://h' || (k % 3) || '.example/p/' || (k + 1) when k % 20 = 5 then '/p/' || k when k % 20 = 15 then 'https://h9.other/p/' || k end as loc from p),
u as (select p.k, h, 'https://h' || h || '.example/p/' || p.k as url, status, case when starts_with(loc, '/') then 'https://h' || h || '.example' || loc else loc end as next_url, html, n from p join r on p.k = r.k cross join (values (0), (1), (2)) as hosts(h)),
w(k, url, hop, code) as (
  select k, url, 0, case when k % 3 = 2 then 'ADDRESS_NOT_PUBLIC' end from u where h = k % 3
  union all
  select w.k, u.next_url, w.hop + 1, case when w.hop >= 3 then 'REDIRECT_LIMIT_EXCEEDED' when u.next_url like '%.other/%' then 'HOST_NOT_ALLOWED' when u.next_url like 'https://h2.%' then 'ADDRESS_NOT_PUBLIC' end
  from w join u on w.url = u.url where w.code is null and u.next_url is not null),
z as (select k, arg_max(url, hop) as last_url, max(hop) as hops, arg_max(coalesce(code, ''), hop) as refused from w group by k),
e as (
  select z.*, u.status, u.n, case when refused <> '' then refused when u.status is null then 'NOT_FETCHED' when u.status in (301, 302) then 'REDIRECT_WITHOUT_LOCATION' when u.status = 200 and octet_length(encode(html)) > 4000 then 'RESPONSE_TOO_LARGE' when u.status = 404 then 'HTTP_404' end as code
  from z left join u on u.url = z.last_url)
select k as page_id, last_url, cast(hops as integer) as redirects, code, case when code is null then case when status = 304 then 0 else n end end as n_payload from e
"""


@query("followed_redirects", FETCHES)
def followed_redirects(spark, d):  # SC16, F16, F17, F18
    k, p = F.col("page_id"), table(spark, d, "pages")
    url = lambda h: F.concat(F.lit("https://h"), h, F.lit(".example/p/"), k.cast("string"))
    status = F.when((k % 10).between(1, 5), 302).when(k % 10 == 6, 301).when(k % 10 == 7, 304).when(k % 100 == 8, 404).otherwise(200)
    ahead = F.concat(F.lit("/p/"), (k + 1).cast("string"))
    location = (
        F.when((k % 10).between(1, 3), ahead)
        .when(k % 10 == 4, F.concat(F.lit("https://h"), (k % 3).cast("string"), F.lit(".example"), ahead))
        .when(k % 20 == 5, F.concat(F.lit("/p/"), k.cast("string")))
        .when(k % 20 == 15, F.concat(F.lit("https://h9.other/p/"), k.cast("string")))
    )
    responses = p.withColumn("h", F.explode(F.array(*map(F.lit, "012")))).select(url(F.col("h")).alias("url"), status.alias("status"), location.alias("location"), F.lit(None).cast("long").alias("announced_bytes"), F.col("html").alias("body"))
    requests = p.select(k.alias("key"), url((k % 3).cast("string")).alias("url"), F.array(F.lit("example")).alias("allowed_domains"), F.lit(4000).alias("most_bytes"))
    addresses = spark.createDataFrame([("h0.example", "8.8.8.8"), ("h1.example", "1.1.1.1"), ("H1.example", "9.9.9.9"), ("h2.example", "8.8.4.4"), ("h2.example", "10.0.0.7")], "host string, address string")
    out = fetched.followed(requests, responses, addresses, 3)
    return out.select(F.col("key").alias("page_id"), "last_url", (F.size("hops") - 1).alias("redirects"), "code", F.length("payload").cast("long").alias("n_payload"))
