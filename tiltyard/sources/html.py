"""Captured pages: links, titles, metadata, structured data and text, extracted in Arrow batches with the standard HTML parser."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, str]] = []
        self.meta: dict[str, str] = {}
        self.title = self.canonical = ""
        self.data: list[str] = []
        self.blocks: list[str] = []
        self.form_title = ""
        self.frames: list[str] = []  # addresses of frames and links, in order
        self.items: list[dict] = []  # links with the texts of their spans and their first image
        self._span: list[str] | None = None
        self.prose: list[tuple[bool, str]] = []  # (inside main, text) of paragraphs
        self.has_main = False
        self._href: str | None = None
        self._text: list[str] = []
        self._in: list[str] = []
        self._script = False
        self._closing_main = False
        self._buf: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag not in _VOID:
            self._in.append(tag)
        if tag == "main":
            self.has_main = True
        if tag == "iframe" and a.get("src"):
            self.frames.append(a["src"])
        elif tag == "input" and a.get("id") == "contact-form-product-title":
            self.form_title = self.form_title or a.get("value", "").strip()
        elif tag == "img" and self._href is not None:
            self.items[-1]["image"] = self.items[-1]["image"] or a.get("src") or None
        elif tag == "span" and self._href is not None:
            self._span = []
        if tag == "a" and a.get("href"):
            self._href, self._text = a["href"], []
            self.frames.append(a["href"])
            self.items.append({"href": a["href"], "spans": [], "image": None})
        elif tag == "meta":
            for k in ("property", "name", "itemprop"):
                if a.get(k):
                    self.meta.setdefault(a[k].lower(), a.get("content", ""))
        elif tag == "link" and a.get("rel", "").lower() == "canonical":
            self.canonical = self.canonical or a.get("href", "")
        elif tag == "script":
            self._script = a.get("type", "").lower() == "application/ld+json"
            self._buf = []
        elif tag in ("h1", "h2", "h3", "p", "li"):
            self._flush()
            self._buf = [{"h2": "## ", "h3": "### ", "h1": "# ", "li": "- "}.get(tag, "")]

    def _flush(self) -> None:
        t = " ".join("".join(self._buf).split())
        if t.strip("#- "):
            self.blocks.append(t)
            if not t.startswith(("# ", "## ", "### ", "- ")):
                self.prose.append(("main" in self._in or self._closing_main, t))
        self._buf = []

    def handle_endtag(self, tag: str) -> None:
        self._closing_main = "main" in self._in
        if tag in self._in:
            while self._in and self._in.pop() != tag:
                pass
        if tag == "span" and self._span is not None:
            self.items[-1]["spans"].append(" ".join("".join(self._span).split()))
            self._span = None
        if tag == "a" and self._href is not None:
            self.links.append((self._href, " ".join("".join(self._text).split())))
            self._href = None
        elif tag == "script":
            if self._script:
                self.data.append("".join(self._buf))
            self._script, self._buf = False, []
        elif tag in ("h1", "h2", "h3", "p", "li"):
            self._flush()

    def handle_data(self, data: str) -> None:
        if "title" in self._in and "svg" not in self._in:
            self.title += data
        elif "style" in self._in or ("script" in self._in and not self._script):
            return
        else:
            self._buf.append(data)
            if self._href is not None:
                self._text.append(data)
            if self._span is not None:
                self._span.append(data)


def _page(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    p._flush()
    return p


def _first_product(blobs: list[str]) -> dict:
    """The first Product of JSON-LD scripts: at the root, in an array, or in @graph; malformed scripts are passed over."""
    for b in blobs:
        try:
            root = json.loads(b)
        except ValueError:
            continue
        todo = [root]
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo = x + todo
            elif isinstance(x, dict):
                kind = x.get("@type")
                if kind == "Product" or isinstance(kind, list) and "Product" in kind:
                    return x
                if isinstance(x.get("@graph"), list):
                    todo = x["@graph"] + todo
    return {}


def _find_key(x: object, key: str) -> str | None:
    """The first value of a key anywhere in a JSON value, depth first."""
    if isinstance(x, dict):
        if isinstance(x.get(key), str):
            return x[key]
        x = list(x.values())
    if isinstance(x, list):
        for v in x:
            got = _find_key(v, key)
            if got:
                return got
    return None


def links(df: DataFrame, row: str, url: str, html: str, extensions: tuple[str, ...] = (), hosts: tuple[str, ...] = ()) -> DataFrame:
    """(row, pos, href, text): links of each page, absolute, first of repeats, with an allowed extension and host where these are given."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r, u, h in f.itertuples(index=False):
                seen = set()
                for pos, (href, text) in enumerate(_page(h).links):
                    full = urljoin(u or "", href.strip())
                    p = urlparse(full)
                    if full.lower() in seen or p.scheme not in ("http", "https"):
                        continue
                    if extensions and not p.path.lower().endswith(extensions) or hosts and p.hostname not in hosts:
                        continue
                    seen.add(full.lower())
                    rows.append((r, pos, full, text))
            yield pd.DataFrame(rows, columns=["r", "pos", "href", "text"])

    t = df.schema[row].dataType.simpleString()
    return df.select(row, url, html).mapInPandas(run, f"r {t}, pos int, href string, text string").withColumnRenamed("r", row)


def metadata(df: DataFrame, row: str, html: str) -> DataFrame:
    """(row, title, published, canonical, product, price, editions, body): that of the contact form before og's before twitter's before the title element;
    the first JSON-LD product with its first offer's price; variants named in links; text as marked-down blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r, h in f.itertuples(index=False):
                p = _page(h)
                product = _first_product(p.data)
                offer = product.get("offers") or {}
                offer = offer[0] if isinstance(offer, list) and offer else offer if isinstance(offer, dict) else {}
                spec = offer.get("priceSpecification") or {}
                spec = spec[0] if isinstance(spec, list) and spec else spec if isinstance(spec, dict) else {}
                price = offer.get("price", spec.get("price"))
                published = None
                for b in p.data:
                    try:
                        published = published or _find_key(json.loads(b), "datePublished")
                    except ValueError:
                        continue
                variants = list(dict.fromkeys(v for href, _ in p.links for v in parse_qs(urlparse(href).query).get("variant", [])))
                title = p.form_title or p.meta.get("og:title") or p.meta.get("twitter:title") or " ".join(p.title.split())
                rows.append((r, title or None, published, p.canonical or None, product.get("name"), None if price is None else str(price), variants, "\n\n".join(p.blocks)))
            yield pd.DataFrame(rows, columns=["r", "title", "published", "canonical", "product", "price", "editions", "body"])

    t = df.schema[row].dataType.simpleString()
    out = df.select(row, html).mapInPandas(run, f"r {t}, title string, published string, canonical string, product string, price string, editions array<string>, body string")
    return out.withColumn("price", F.col("price").try_cast("double")).withColumnRenamed("r", row)


_VIDEO = re.compile(r"(?:youtube(?:-nocookie)?\.com/(?:embed/|watch\?(?:[^#]*&)?v=)|youtu\.be/)([\w-]{11})")


def game_content(df: DataFrame, row: str, html: str, shop: str, slug: str | None = None, consent: tuple[str, ...] = ("cookie", "consent"), least: int = 40) -> DataFrame:
    """(row, overview, trailer, shop_link, accessories, subpages) of product pages.

    overview: paragraphs of `least` characters or more, of the main element where there is one, without consent banners; null
    where none is left. trailer: the first video that a frame or link names. shop_link: the first link to a collection of the
    shop. accessories: links to its products that name one in a span, one per address, with a price where a span begins with $.
    subpages: the parts behind the page's own slug in links, in order (slug: the column with it).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r, h, own in f.itertuples(index=False):
                p = _page(h)
                prose = [t for inside, t in p.prose if (inside or not p.has_main) and len(t) >= least and not any(c in t.lower() for c in consent)]
                video = next((m[1] for u in p.frames if (m := _VIDEO.search(u))), None)
                link = next((i["href"] for i in p.items if f"{shop}/collections/" in i["href"].lower()), None)
                goods: dict[str, tuple] = {}
                for i in p.items:
                    if f"{shop}/products/" in i["href"].lower() and i["href"].lower() not in goods:
                        spans = [s for s in i["spans"] if s]
                        goods[i["href"].lower()] = (next((s for s in spans if not s.startswith("$")), None), next((s for s in spans if s.startswith("$")), None), i["href"], i["image"])
                subs = dict.fromkeys(m[1] for href, _ in p.links if own and (m := re.search(rf"/{re.escape(own)}/([\w-]+)/?(?:[?#].*)?$", href)))
                rows.append((r, "\n\n".join(prose) or None, f"https://www.youtube.com/watch?v={video}" if video else None, link, [g for g in goods.values() if g[0]], list(subs)))
            yield pd.DataFrame(rows, columns=["r", "overview", "trailer", "shop_link", "accessories", "subpages"])

    t = df.schema[row].dataType.simpleString()
    own = F.lit(None).cast("string") if slug is None else F.col(slug)
    out = df.select(F.col(row).alias("r"), F.col(html).alias("h"), own.alias("s")).mapInPandas(run, f"r {t}, overview string, trailer string, shop_link string, accessories array<struct<name:string,price:string,url:string,image:string>>, subpages array<string>")
    return out.withColumnRenamed("r", row)


def attributed(title: Column, author: Column, url: Column, body: Column) -> Column:
    """An article as marked-down text: title, who wrote it and where, then the body; missing parts are left out."""
    by = F.when(F.trim(F.coalesce(author, F.lit(""))) != "", F.concat(F.lit("By "), F.trim(author)))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), by, F.concat(F.lit("Source: "), url), F.nullif(body, F.lit("")))
