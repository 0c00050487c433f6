"""A wiki's API: requests with retries, paged lists, revisions, categories, and fetched texts.

The transport is a callable ``(params) -> (status, headers, body)``, so the operators run against a network or a
table. Waiting is a callable too.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTEMPTS, BATCH = 4, 50


class Unavailable(Exception):
    pass


class WikiApi:
    def __init__(self, transport: Callable[[dict], tuple[int, dict, dict]], wait: Callable[[float], None] = time.sleep):
        self._transport, self._wait = transport, wait

    def get(self, **params) -> dict:
        """One request. A busy server (429, 503, or an error of code ``maxlag``) is asked again after the time it
        names, else 5, 10, 20 ... seconds."""
        for attempt in range(ATTEMPTS):
            status, headers, body = self._transport(params)
            lagging = (body or {}).get("error", {}).get("code") == "maxlag"
            if status == 200 and not lagging:
                return body
            if status not in (200, 429, 503):
                raise Unavailable(f"status {status}")
            if attempt + 1 < ATTEMPTS:
                self._wait(float(headers.get("Retry-After") or 5 * 2**attempt))
        raise Unavailable("busy")

    def pages(self, **params) -> Iterator[dict]:
        """The parts of a list, following its continuation."""
        more: dict = {}
        while True:
            body = self.get(**params, **more)
            yield body
            if not body.get("continue"):
                return
            more = body["continue"]

    def latest_revisions(self, titles: Iterable[str]) -> dict[str, tuple[int, str] | None]:
        """``{title: (revision, time)}``, None for what is missing, invalid or a redirect; 50 titles a request."""
        titles, out = list(titles), {}
        for start in range(0, len(titles), BATCH):
            body = self.get(prop="revisions|info", titles="|".join(titles[start : start + BATCH]))["query"]
            asked = {n["to"]: n["from"] for n in body.get("normalized", [])}
            for page in body["pages"]:
                dead = page.get("missing") or page.get("invalid") or page.get("redirect")
                rev = None if dead else page["revisions"][0]
                out[asked.get(page["title"], page["title"])] = None if rev is None else (rev["revid"], rev["timestamp"])
        return out


def category_closure(links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """``(title)``: the articles of the root categories and of their subcategories down to ``depth``.

    ``links``: ``category, member, is_category``; ``roots``: ``category``. Breadth first with the least depth of each
    category, so a category first met at the last level is still expanded if a shorter way leads to it. One join per
    level, visited categories are not entered again, cycles end.
    """
    links = links.select("category", "member", "is_category").distinct()
    seen = front = roots.select("category").distinct()
    for _ in range(depth):
        front = front.join(links.filter("is_category"), "category").select(F.col("member").alias("category")).distinct().join(seen, "category", "left_anti")
        seen = seen.unionByName(front)
    return seen.join(links.filter("not is_category"), "category").select(F.col("member").alias("title")).distinct()


def discover(seeds: DataFrame, links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Seed titles and those of the categories."""
    return seeds.select("title").union(category_closure(links, roots, depth)).distinct()


def page_texts(titles: DataFrame, api_pages: DataFrame, api_redirects: DataFrame) -> DataFrame:
    """``(asked, title, revid, text)``: a lookup that follows redirects; null text where there is no page."""
    led = titles.join(api_redirects.select(F.col("title"), F.col("target")), "title", "left").select(F.col("title").alias("asked"), F.coalesce("target", "title").alias("title"))
    return led.join(api_pages.select("title", "revid", "text"), "title", "left").select("asked", "title", "revid", "text")


def refresh(pages: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single-page refreshes: ``(pages, rows to upsert)`` after ``fetched(asked, title, revid, text)``. A page without text
    goes; one that was renamed goes under its old title and comes under the new one."""
    gone = fetched.filter(F.col("text").isNull() | (F.col("asked") != F.col("title"))).select(F.col("asked").alias("title"))
    return pages.join(gone, "title", "left_anti"), fetched.filter("text is not null").select("title", "revid", "text")
