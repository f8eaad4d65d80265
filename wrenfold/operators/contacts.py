"""Anchors, contact pages and published routes of websites (X-09)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.functions.rows import table
from wrenfold.functions.webpage import Page, Site, contact, tier_of
from wrenfold.registry import query


class NotPublished(ValueError):
    """A value that its page doesn't have."""


def contact_pages(pages: DataFrame) -> DataFrame:
    """(url, link, tier, position) of the pages of a site that a page (url, html) calls contact pages (tier 0) or that may hold a contact (tier 1), each once, in the page's order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for url, page in zip(pdf["url"], pdf["html"], strict=True):
                out += [(url, *found) for found in Site(url).contact_links(Page(page))]
            yield pd.DataFrame(out, columns=["url", "link", "tier", "position"])

    return pages.select("url", "html").mapInPandas(run, "url string, link string, tier int, position int")


def routes(pages: DataFrame) -> DataFrame:
    """(site, channel, value, addressee, url) of what sites declare: mail and phone links, and the form of a contact page.

    ``pages``: (site, step, url, html), in the order in which they were read.  Of a value's spellings the first counts.  A value that its page doesn't have raises.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for site, step, url, html in zip(pdf["site"], pdf["step"], pdf["url"], pdf["html"], strict=True):
                own, page = Site(site), Page(html)
                for k, anchor in enumerate(page.anchors):
                    found = contact(anchor.href)
                    if found is None or not own.owns(url or "", *found):
                        continue
                    if not page.shows(found[1]):
                        raise NotPublished(f"{found[1]!r} isn't on {url}")
                    out.append((site, *found, anchor.text, url, step, k))
                if page.has_box and tier_of(url or "") == 0:
                    out.append((site, "form", url, "", url, step, 1 << 30))
            yield pd.DataFrame(out, columns=["site", "channel", "value", "addressee", "url", "step", "position"])

    found = pages.select("site", "step", "url", "html").mapInPandas(run, "site string, channel string, value string, addressee string, url string, step int, position int")
    first = found.groupBy("site", "channel", F.lower("value").alias("key")).agg(F.min(F.struct("step", "position", "value", "addressee", "url")).alias("x"))
    return first.select("site", "channel", "x.value", "x.addressee", "x.url")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a second page each; what they publish differs by id."""
    k = F.col("page_id") % 6
    own = F.lit("<footer><a href=\"mailto:&#109;d@WWW.Site")
    more = F.when(k == 0, F.concat(own, F.col("page_id").cast("string"), F.lit(".example?subject=x\">Music <b>Director</b></a>"))).when(k == 1, "<A class=x HREF='/Contact us#top'>Write</A><a href=/contact%20form>x<a href='mailto:ad@elsewhere.example'>Ad</a>")
    more = more.when(k == 2, "<a href=/zabout>Who</a><a href='http://notsite.example/contact'>n</a>").when(k == 3, "<a href=\"tel:+1 (404) 894-2468\">Ring</a>").otherwise("")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://www.site"), F.col("page_id").cast("string"), F.lit(".example/")).alias("site"), F.concat("html", more).alias("html"))
    second = F.concat(F.lit("<a href='tel:555 0100 200'>Studio</a><a href=\"mailto:DJ@x.example\">A</a><a href=\"mailto:dj@x.example\">B</a>"), F.when(k == 5, "<textarea>").otherwise("<!-- <textarea> -->"))
    one = p.select("page_id", "site", F.lit(0).alias("step"), F.col("site").alias("url"), "html")
    two = p.filter(k >= 4).select("page_id", "site", F.lit(1).alias("step"), F.concat("site", F.lit("staff")).alias("url"), second.alias("html"))
    return one.unionByName(two)


@query("x09_contact_pages", """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS l, 'https://www.site' || CAST(page_id AS VARCHAR) || '.example' AS s FROM pages),
w AS (SELECT page_id, s || l AS url, lower(l || ' ' || substr(l, 2)) AS t FROM a WHERE l LIKE '/%'), r AS (SELECT DISTINCT page_id, url, CASE WHEN regexp_matches(t, 'contact|get-in-touch|getintouch|reach-us|submi(ssion|t)|staff|(music|program)-?director') THEN 0 WHEN regexp_matches(t, 'about|people|team|music|programming|dj|connect|info') THEN 1 END AS tier FROM w)
SELECT page_id, tier, count(*) AS n FROM (SELECT page_id, tier, url FROM r WHERE tier IS NOT NULL UNION ALL SELECT page_id, 0, 'c1' FROM pages WHERE page_id % 6 = 1 UNION ALL SELECT page_id, 0, 'c2' FROM pages WHERE page_id % 6 = 1 UNION ALL SELECT page_id, 1, 'a' FROM pages WHERE page_id % 6 = 2) GROUP BY 1, 2""")
def contact_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contact_pages(_sites(spark, sf_dir).filter("step = 0"))
    return found.groupBy(F.regexp_extract("url", "site([0-9]+)", 1).cast("long").alias("page_id"), "tier").agg(F.count(F.lit(1)).alias("n"))


@query("x09_contact_routes", """WITH p AS (SELECT page_id, 'https://www.site' || CAST(page_id AS VARCHAR) || '.example/' AS site FROM pages)
SELECT site, 'email' AS channel, 'md@www.site' || CAST(page_id AS VARCHAR) || '.example' AS value, 'Music Director' AS addressee, site AS url FROM p WHERE page_id % 6 = 0
UNION ALL SELECT site, unnest(['phone', 'email']), unnest(['555 0100 200', 'DJ@x.example']), unnest(['Studio', 'A']), site || 'staff' FROM p WHERE page_id % 6 >= 4
UNION ALL SELECT site, 'form', site || 'staff', '', site || 'staff' FROM p WHERE page_id % 6 = 5""")
def contact_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes(_sites(spark, sf_dir))
