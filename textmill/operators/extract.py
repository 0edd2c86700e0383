"""HTML to documents. Parsing needs Python: one Arrow-fed pass over the pages, no exchange."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCUMENT = (
    "url string, title string, description string, markdown string, headings array<struct<level:int,text:string>>, "
    "links array<string>, word_count int, content_hash string, error string"
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg head".split())
BOILERPLATE = frozenset("nav aside footer header form".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "number")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.number = 1  # of a list item
        self.kids: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This node and those below, in document order, without recursion."""
        stack: list[Node] = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.kids))
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                out.append(k)
            else:
                stack += reversed(k.kids)
        return "".join(out)


class _Builder(HTMLParser):
    """A tolerant tree: what is open closes by name, a paragraph closes at the next block."""

    CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
    BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = self.CLOSES.get(tag, set()) | ({"p"} if tag in self.BLOCKS else set())
        n: Node | None = self.at
        while n is not None and n.tag and n.tag not in ("ul", "ol", "table", "div", "article", "section", "body", "main", "td"):
            if n.tag in closes:
                self.at = n.up or self.root
                break
            n = n.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.at
        while n is not None and n.tag != tag:
            n = n.up
        if n is not None and n.up is not None:
            self.at = n.up

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def title(root: Node) -> str:
    """First title element, else first h1, else ""."""
    for tag in ("title", "h1"):
        found = next((n.text().strip() for n in root.walk() if n.tag == tag), "")
        if found:
            return found
    return ""


def description(root: Node) -> str:
    return next((n.attrs.get("content", "").strip() for n in root.walk() if n.tag == "meta" and n.attrs.get("name") == "description"), "")


def headings(root: Node) -> list[dict]:
    """All h1 to h6 with text, in document order, wherever they stand."""
    found = ((int(n.tag[1]), n.text().strip()) for n in root.walk() if re.fullmatch("h[1-6]", n.tag))
    return [{"level": k, "text": t} for k, t in found if t]


def resolve(base: str, ref: str) -> str | None:
    try:
        out = urldefrag(urljoin(base, ref))[0]
        return out if urlsplit(out).scheme in ("http", "https") else None
    except ValueError:
        return None


def links(root: Node, base: str) -> list[str]:
    """Distinct targets in order: http and https, without fragment; in-page and script references are dropped."""
    refs = (n.attrs["href"].strip() for n in root.walk() if n.tag == "a" and "href" in n.attrs)
    return list(dict.fromkeys(u for r in refs if r and not r.startswith(("#", "javascript:")) and (u := resolve(base, r))))


def follow_links(root: Node, base: str) -> list[str]:
    """Targets for the crawl frontier: every non-empty reference, repeats included."""
    return [u for n in root.walk() if n.tag == "a" and n.attrs.get("href") and (u := resolve(base, n.attrs["href"]))]


def markdown(node: Node) -> str:
    """Headings, paragraphs, lists, quotes, code, links and emphasis; scripts and styles are dropped."""
    out = re.sub(r"[ \t]+\n", "\n", _md(node))
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def _inline(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def _md(node: Node | str, depth: int = 0) -> str:
    if isinstance(node, str):
        return _inline(node)
    tag = node.tag
    if tag in DROPPED:
        return ""
    if tag == "pre":
        return f"\n\n```\n{node.text().strip(chr(10))}\n```\n\n"
    if tag == "br":
        return "\n"
    if tag == "hr":
        return "\n\n---\n\n"
    if depth > 200:  # deeper nesting than any real page: text only
        return _inline(node.text())
    for n, item in enumerate((k for k in node.kids if isinstance(k, Node) and k.tag == "li"), 1):
        item.number = n
    inner = "".join(_md(k, depth + 1) for k in node.kids)
    if re.fullmatch("h[1-6]", tag):
        return f"\n\n{'#' * int(tag[1])} {_inline(inner).strip()}\n\n" if inner.strip() else ""
    if tag in ("b", "strong"):
        return f"**{inner.strip()}**" if inner.strip() else ""
    if tag in ("i", "em"):
        return f"*{inner.strip()}*" if inner.strip() else ""
    if tag == "code":
        return f"`{inner}`"
    if tag == "a" and node.attrs.get("href") and inner.strip():
        return f"[{inner.strip()}]({node.attrs['href']})"
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    if tag == "li":
        return f"\n{f'{node.number}.' if node.up and node.up.tag == 'ol' else '-'} {inner.strip()}"
    if tag == "blockquote":
        return "\n\n" + "\n".join(f"> {x}" for x in inner.strip().split("\n")) + "\n\n"
    if tag in ("td", "th"):
        return f" {inner.strip()} |"
    if tag == "tr":
        return f"\n|{inner}"
    if tag in _Builder.BLOCKS or tag in ("body", "html"):
        return f"\n\n{inner}\n\n"
    return inner


def main_content(root: Node) -> Node:
    """First article, else first main, else the body without navigation and the like, else all."""
    for tag in ("article", "main"):
        found = next((n for n in root.walk() if n.tag == tag and n.text().strip()), None)
        if found:
            return found
    body = next((n for n in root.walk() if n.tag == "body"), root)
    for n in list(body.walk()):
        n.kids = [k for k in n.kids if isinstance(k, str) or k.tag not in BOILERPLATE]
    return body


def select(root: Node, selector: str) -> Node:
    """First match of a tag, .class, #id, or a mix such as div.note#top; without one, the body."""
    parts = re.fullmatch(r"([A-Za-z][\w-]*)?((?:[.#][\w-]+)*)", selector.strip())
    body = next((n for n in root.walk() if n.tag == "body"), root)
    if not parts:
        return body
    marks = re.findall(r"([.#])([\w-]+)", parts[2])

    def fits(n: Node) -> bool:
        own = {".": n.attrs.get("class", "").split(), "#": [n.attrs.get("id", "")]}
        return bool(n.tag) and (not parts[1] or n.tag == parts[1].lower()) and all(v in own[k] for k, v in marks)

    return next((n for n in root.walk() if fits(n)), body)


def document(url: str, raw: bytes, selector: str | None = None, references: tuple[str, ...] | None = None) -> tuple:
    """The columns of DOCUMENT for one page; what goes wrong stands in the last one, and the page has no content then."""
    digest = "sha256:" + hashlib.sha256(raw).hexdigest()
    try:
        html = raw.decode("utf-8", "replace")
        root = parse(html if references is None else re.sub(rf"&(?!(?:{'|'.join(references)});)", "&amp;", html))
        head = (title(root), description(root))
        tail = (headings(root), links(root, url or ""))
        md = markdown(select(root, selector) if selector else main_content(root))
    except Exception as e:  # one bad page is a row with an error, not a failed job
        return (url, "", "", "", [], [], 0, digest, f"{type(e).__name__}: {e}"[:500])
    return (url, *head, md, *tail, len(md.split()), digest, None)


def _bytes(body: object) -> bytes:
    return bytes(body) if isinstance(body, bytes | bytearray) else (body or "").encode("utf-8", "surrogatepass")


def extract(fetched: DataFrame, selector: str | None = None, key: str | None = None, references: tuple[str, ...] | None = None) -> DataFrame:
    """fetched: url, body (string or binary) -> documents. With a selector its first match is the content.

    references: names of the character references that are read, with their semicolon only, while all others stand as they
    are; without it all are read as browsers do.
    key: a column of numbers or text that goes along, for pages that share a URL.
    """
    own = [key] if key else []
    columns = ["url", "title", "description", "markdown", "headings", "links", "word_count", "content_hash", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [document(url, _bytes(body), selector, references) for url, body in zip(b["url"], b["body"], strict=True)]
            out = pd.DataFrame(rows, columns=columns)
            for k in own:
                out[k] = b[k].array
            yield out

    # as text on the way: Pandas has whole numbers with nulls as floats
    found = fetched.select("url", "body", *(F.col(k).cast("string").alias(k) for k in own)).mapInPandas(run, DOCUMENT + "".join(f", `{k}` string" for k in own))
    return found.withColumns({k: F.col(k).cast(fetched.schema[k].dataType) for k in own}) if own else found


def whole(documents: DataFrame) -> DataFrame:
    """Documents that were extracted without an error."""
    return documents.filter("error is null").drop("error")


def link_edges(fetched: DataFrame) -> DataFrame:
    """fetched: url, body -> src, dst of every followed reference, repeats included; none of a page that can't be parsed."""

    def followed(url: str, body: object) -> list[str]:
        try:
            return follow_links(parse(_bytes(body).decode("utf-8", "replace")), url)
        except Exception:
            return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, v) for u, h in zip(b["url"], b["body"], strict=True) for v in followed(u or "", h)]
            yield pd.DataFrame(rows, columns=["src", "dst"], dtype=object)

    return fetched.select("url", "body").mapInPandas(run, "src string, dst string")


MAX_BODY = 10 * 1024 * 1024


def small_enough(body: str = "body") -> F.Column:
    return F.octet_length(body) <= MAX_BODY
