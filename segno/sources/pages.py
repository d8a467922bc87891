"""Ranked lists out of web pages that were fetched before."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Lists(HTMLParser):
    def __init__(self):
        super().__init__()
        self.title, self.items, self._in, self._text, self._links = "", [], None, [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("title", "h1", "li"):
            self._in, self._text, self._links = tag, [], []
        elif tag == "a" and self._in == "li":
            self._links.append(dict(attrs).get("href"))

    def handle_endtag(self, tag):
        if tag != self._in:
            return
        text = " ".join("".join(self._text).split())
        if tag == "li":
            self.items.append((text, self._links))
        elif text and (tag == "h1" or not self.title):
            self.title = text
        self._in = None

    def handle_data(self, data):
        if self._in:
            self._text.append(data)


_ENTRY = re.compile(r"^(?:#?(\d+)[.):]?\s+)?(.+?)\s+[-–—]\s+(.+)$")


def parse_list(html: str) -> list[tuple[str, int, str, str, str | None, str | None]]:
    """(page title, rank, artist, title, artist url, album url) of the entries "rank. artist - title" of a page; a missing rank is the place in the list."""
    p = _Lists()
    p.feed(html)
    out = []
    for text, links in p.items:
        m = _ENTRY.match(text)
        if m:
            out.append((p.title, int(m.group(1)) if m.group(1) else len(out) + 1, m.group(2), m.group(3), links[0] if links else None, links[1] if len(links) > 1 else None))
    return out


# Words that a list's title has and a critic's name has not; words of an address at which a list's title begins.
_LIST_WORDS = ("top", "best", "album", "favorite")
_STOP_WORDS = {"top", "best", "favorite", "favourite", "albums", "records", "10", "15", "20", "25", "50", "100"}


def critic_of(title: str, url: str) -> str:
    """Whose list it is: what stands before a colon in the title, unless it speaks of a list, else what the address begins with up to such words."""
    head, colon, _ = title.partition(": ")
    if colon and not any(w in head.lower() for w in _LIST_WORDS):
        return head.strip()
    m = re.search(r"/\d{4}/([^/?#]+)", url)
    words = m.group(1).split("-") if m else []
    cut = next((i for i, w in enumerate(words) if w.lower() in _STOP_WORDS or (w.lower() == "the" and i)), len(words))
    return " ".join(words[:cut] if 0 < cut < len(words) else words[:1]).title()


def with_critic(entries: DataFrame, key: str = "url") -> DataFrame:
    """``list_entries`` with the ``critic`` of each page, from its title and address."""

    @F.pandas_udf("string")
    def named(title: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([critic_of(t or "", u or "") for t, u in zip(title, url, strict=True)])

    return entries.withColumn("critic", named(F.col("page_title"), F.col(key)))


def list_entries(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, page_title, rank, artist, title, artist_url, album_url) of the entries of fetched pages; null pages have none."""

    @F.pandas_udf("array<struct<page_title:string,rank:int,artist:string,title:string,artist_url:string,album_url:string>>")
    def parsed(s: pd.Series) -> pd.Series:
        names = ("page_title", "rank", "artist", "title", "artist_url", "album_url")
        return pd.Series([[dict(zip(names, r, strict=True)) for r in parse_list(v)] for v in s])

    return pages.where(F.col(html).isNotNull()).select(key, F.explode(parsed(html)).alias("e")).select(key, "e.*")


def wanted_links(links: DataFrame, prefix: str, words: list[str], url: str = "url") -> DataFrame:
    """Links below a prefix, other than it, that hold one of the words."""
    return links.where(F.col(url).startswith(prefix) & (F.col(url) != prefix) & F.lower(url).rlike("|".join(map(re.escape, words)))).select(url).distinct()
