"""Article text and pictures from raw HTML: a page is read once into elements, and text and pictures are taken by element and attribute."""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: elements without article text
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "form", "svg", "button")
#: fixed values: names of bodies, and of regions with pictures, without hyphens and underscores
BODY_NAMES = (
    "articlebody", "postcontent", "entrycontent", "articlecontent", "storybody", "blogpost", "maincontent", "postbody", "postfullcontent", "articletext",
    "singlecontent", "pagecontent"
)
REGION_NAMES = (
    "articlebody", "articlecontent", "articletext", "articledetail", "postbody", "postcontent", "entrycontent", "richtext", "newscontent"
)
#: fixed values: least lengths of the texts and of a region, most paragraphs, least length and most tags a character of one
LEAST = {"article": 100, "named": 100, "json_ld": 80, "meta": 60, "paragraphs": 100, "region": 200}
PARAGRAPHS, PARAGRAPH, TAGS = 20, 40, 0.1
#: fixed values: phrases that are cut from the text
NOISE = (
    r"Subscribe to.*?(?:newsletter|updates)[.\s]", r"Sign up for.*?(?:newsletter|free)[.\s]", r"Share this.*?(?:article|story)[.\s]", r"Related (?:articles?|stories|posts)[.\s]",
    r"(?:Cookie|Privacy) (?:policy|notice)[.\s]", r"Advertisement[.\s]", r"Follow us on[.\s]",
)
#: fixed values: attributes that hold a picture's address, parts of addresses of pictures that are no content
SOURCES = ("src", "data-src", "data-original", "data-lazy-src")
PICTURE_NOISE = (
    "data:image", ".svg", "pixel", "tracking", "avatar", "logo", "badge", "emoji", "button", "arrow", "facebook.com", "twitter.com", "linkedin.com",
    "pinterest.com", "gravatar", "widget", "/ad/", "/ads-", "sponsor", "1x1", "2x2", "spacer", "blank.gif", "transparent.png", "placeholder",
    "default_avatar", "qrcode", "mini_icon", "thumb_icon", "google-analytics", "collect?v=", "/icon/", "/icons/", "_icon.", "-icon.", "favicon",
    "/social/", "share_icon", "sharebutton", "bibsonomy", "/licenses/", "license/by", "creativecommons", "cc-by", "/badges/", "badge_"
)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-z][a-z0-9-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-z_:][a-z0-9_:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)
_CUT = re.compile("|".join(f"(?:{p})" for p in NOISE), re.I)
_KNOWN = re.compile(r"&(?:nbsp|lt|gt|quot|amp|#39);")
_NUMERIC = re.compile(r"&#x?[0-9a-f]+;", re.I)


class Element(NamedTuple):
    """An element that is closed, or one without content: where its content begins and ends, the texts in it, the tags in it."""

    name: str
    attributes: dict[str, str]
    begin: int
    end: int
    texts: tuple[int, int]
    tags: int


def elements(page: str) -> tuple[list[Element], list[str]]:
    """(elements in the order of their ends, visible texts). Dropped elements have no texts; a paragraph goes to the next closing tag."""
    found, texts, stack, at, tags = [], [], [], 0, 0
    opened: Counter[str] = Counter()  # names on the stack
    endless: set[str] = set()  # dropped names that no closing tag follows
    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            texts.append(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            inner = name if opened[name] else None
            while inner is not None:  # what was left open within ends here without being an element
                inner, attributes, begin, first, seen = stack.pop()
                opened[inner] -= 1
                if inner == name:
                    found.append(Element(name, attributes, begin, m.start(), (first, len(texts)), tags - seen))
                    break
            tags += 1
            continue
        attributes = {k.lower(): v or w for k, v, w in reversed(_ATTRIBUTE.findall(m["attributes"]))} if "=" in m["attributes"] else {}
        if name in DROPPED and name not in endless:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if close is not None:
                found.append(Element(name, attributes, at, close.start(), (len(texts), len(texts)), 0))
                at = close.end()
                continue
            endless.add(name)
        tags += 1
        if name in ("meta", "img"):
            order = dict(reversed(list(attributes.items())))
            found.append(Element(name, order, at, at, (len(texts), len(texts)), 0))
        elif name != "p" or not opened["p"]:
            stack.append((name, attributes, at, len(texts), tags))
            opened[name] += 1
    texts.append(page[at:])
    return found, texts


def _clean(text: str) -> str:
    known = _KNOWN.sub(lambda m: " " if m[0] == "&nbsp;" else entities.unescape(m[0]), text)
    return " ".join(_NUMERIC.sub("", known).split())


def _named(e: Element, names: Iterable[str], keys: tuple[str, ...] = ("class", "id")) -> bool:
    given = [e.attributes.get(k, "").replace("-", "").replace("_", "").lower() for k in keys]
    return any(n in g for g in given for n in names)


def _data(page: str, found: list[Element]) -> Iterator[dict]:
    """The data blocks of a page; of a list its first member."""
    for e in found:
        if e.name == "script" and e.attributes.get("type", "").lower() == "application/ld+json":
            try:
                block = json.loads(page[e.begin : e.end])
            except ValueError:
                continue
            block = block[0] if isinstance(block, list) and block else block
            if isinstance(block, dict):
                yield block


def text_of(page: str | None, limit: int) -> str:
    """The longest of article elements, elements with a body's name, data blocks, descriptions and paragraphs, each over its least length."""
    page = page or ""
    found, texts = elements(page)
    inner = lambda e: _clean(" ".join(texts[slice(*e.texts)]))
    said = [inner(e) for e in found if e.name == "article"]
    options = [t for t in said if len(t) > LEAST["article"]]
    said = [inner(e) for e in found if e.name in ("div", "section", "main") and _named(e, BODY_NAMES)]
    options += [t for t in said if len(t) > LEAST["named"]]
    said = [b.get("articleBody") or b.get("description") for b in _data(page, found)]
    options += [_clean(re.sub("<[^>]*>", " ", t)) for t in said if isinstance(t, str) and len(t) > LEAST["json_ld"]]
    metas = [e.attributes for e in found if e.name == "meta"]
    said = [a.get("content", "") for a in metas if a.get("name") == "description" or a.get("property") == "og:description"]
    options += [_clean(t) for t in said if len(t) > LEAST["meta"]]
    paragraphs = [(inner(e), e.tags) for e in found if e.name == "p"]
    good = [t for t, tags in paragraphs if len(t) > PARAGRAPH and tags < TAGS * len(t)]
    options += [t for t in ["。".join(good[:PARAGRAPHS])] if len(t) > LEAST["paragraphs"]]
    best = max(options, key=len, default="")  # the first of the longest
    return " ".join(_CUT.sub(" ", best).split())[:limit]


def pictures_of(page: str | None, url: str | None, most: int) -> list[str]:
    """Addresses of a page's cover, of the pictures in its article, of its data blocks: whole, clean, once each."""
    page = page or ""
    found, _ = elements(page)
    covers: dict[str, list[str]] = {"og:image": [], "twitter:image": []}
    for e in found:
        kind = (e.attributes.get("property") or e.attributes.get("name") or "").lower() if e.name == "meta" else ""
        for name, held in covers.items():
            if kind == name or (kind.startswith(name + ":") and name == "og:image"):
                held.append(e.attributes.get("content", ""))
    begin, end = _region(page, found)
    inside = [
        next((v for k, v in e.attributes.items() if k in SOURCES), "") for e in found if e.name == "img" and begin <= e.begin <= end
    ]
    listed = [u for block in _data(page, found) for key in ("image", "thumbnailUrl") for u in _addresses(block.get(key))]
    out: dict[str, None] = {}
    for u in [*covers["og:image"], *covers["twitter:image"], *inside, *listed]:
        u = entities.unescape(u) if "&" in u else u
        u = "https:" + u if u.startswith("//") else urljoin(url, u) if u.startswith("/") and url else u
        if u.startswith("http") and not any(n in u.lower() for n in PICTURE_NOISE):
            out.setdefault(u)
    return list(out)[:most]


def _region(page: str, found: list[Element]) -> tuple[int, int]:
    """Where the pictures of the article stand: the first article, named box, main element or content box that is long enough, else the page."""
    tests = (
        lambda e: e.name == "article", lambda e: e.name == "div" and _named(e, REGION_NAMES, ("class",)), lambda e: e.name == "main",
        lambda e: e.name == "div" and "content" in e.attributes.get("class", "").lower()
    )
    for test in tests:
        first = min((e for e in found if test(e)), key=lambda e: e.begin, default=None)
        if first is not None and first.end - first.begin > LEAST["region"]:
            return first.begin, first.end
    return 0, len(page)


def _addresses(value: object) -> list[str]:
    """A text, an object with an address, or the first three of a list of either."""
    if isinstance(value, list):
        return [u for v in value[:3] for u in _addresses(v)]
    value = value.get("url") if isinstance(value, dict) else value
    return [value] if isinstance(value, str) else []


def body(html: Column, limit: int = 4000) -> Column:
    """text_of() of a column of pages; null is the empty page."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: text_of(p, limit))

    return run(F.coalesce(html, F.lit("")))


def pictures(html: Column, url: Column, most: int = 4) -> Column:
    """pictures_of() of columns of pages and their addresses."""

    @F.pandas_udf("array<string>")
    def run(pages: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([pictures_of(p, u, most) for p, u in zip(pages, urls, strict=True)])

    return run(F.coalesce(html, F.lit("")), F.coalesce(url, F.lit("")))
