"""Web pages in one pass: a tokenizer that forgives broken markup, URL references by RFC 3986, and what sites publish.

``Page(html)`` walks the text once, from sign to sign; it keeps the anchors, whether there is a text box, and the visible text.
An attribute whose quote is never closed ends with its tag; an anchor that is never closed ends where the next one begins;
comments, scripts and styles are passed over, to the end of the page if they are never closed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from typing import NamedTuple

# Words of pages that are for being contacted, and of pages where a contact may stand.
STRONG_WORDS = ("contact", "contactus", "get-in-touch", "getintouch", "reach-us", "submission", "submissions", "submit", "staff", "music-director", "musicdirector", "program-director", "programdirector")
WEAK_WORDS = ("about", "people", "team", "music", "programming", "dj", "djs", "connect", "info")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?|[\s/]*[\"']+")
_OPAQUE = ("script", "style")


class Tag(NamedTuple):
    name: str
    closes: bool
    attributes: dict[str, str]


def markup(html: str) -> Iterator[str | Tag]:
    """Texts and tags, in order."""
    at, size = 0, len(html)
    while at < size:
        sign = html.find("<", at)
        if sign != at:
            yield html[at : size if sign < 0 else sign]
            if sign < 0:
                return
        if html.startswith("<!--", sign):
            at = _behind(html, "-->", sign + 4)
            continue
        closes = html.startswith("</", sign)
        name = _NAME.match(html, sign + 1 + closes)
        if name is None:
            if html[sign + 1 : sign + 2] in ("!", "?", "/"):
                at = _behind(html, ">", sign)
            else:
                yield "<"
                at = sign + 1
            continue
        tag = Tag(name[0].lower(), closes, {})
        at = _attributes(html, name.end(), tag.attributes)
        yield tag
        if tag.name in _OPAQUE and not closes:
            end = re.compile(rf"</{tag.name}\b", re.IGNORECASE).search(html, at)
            at = size if end is None else end.start()


def _behind(html: str, end: str, at: int) -> int:
    found = html.find(end, at)
    return len(html) if found < 0 else found + len(end)


def _attributes(html: str, at: int, into: dict[str, str]) -> int:
    """The attributes from ``at`` on, of each name the first; the place behind the tag."""
    while at < len(html) and html[at] != ">":
        m = _ATTRIBUTE.match(html, at)
        if m is None or m.end() == at:
            at += 1
            continue
        at = m.end()
        if m[1] is not None:
            value = m[2] or ""
            if value[:1] in ("'", '"'):
                value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
            into.setdefault(m[1].lower(), unescape(value))
    return at + 1


class Anchor(NamedTuple):
    href: str
    text: str


class Page:
    def __init__(self, html: str | None) -> None:
        self.anchors: list[Anchor] = []
        self.has_box = False
        self._html = html or ""
        href, words = None, []

        def closed() -> None:
            if href is not None:
                self.anchors.append(Anchor(href, " ".join("".join(words).split())))

        for part in markup(self._html):
            if isinstance(part, str):
                words.append(unescape(part))
            elif part.name == "a":
                closed()
                href, words = None if part.closes else part.attributes.get("href", "").strip(), []
            else:
                self.has_box |= part.name == "textarea" and not part.closes
        closed()

    def shows(self, value: str) -> bool:
        """Whether the page has the value as it stands, but for case and character references."""
        return value.casefold() in unescape(self._html).casefold()


# The parts of a URL reference, as RFC 3986 cuts them.
_REFERENCE = re.compile(r"(?:(?P<scheme>[a-zA-Z][a-zA-Z0-9+.-]*):)?(?://(?P<host>[^/?#]*))?(?P<path>[^?#]*)(?:\?(?P<query>[^#]*))?(?:#.*)?", re.DOTALL)
#: What a path may have as it is: unreserved signs, delimiters, the slash and the percent sign.
_PATH_SIGN = re.compile(r"[^A-Za-z0-9\-._~!$&'()*+,;=:@/%]")


@dataclass(frozen=True)
class Link:
    """An absolute web address."""

    scheme: str
    authority: str
    path: str
    query: str | None

    def __str__(self) -> str:
        return f"{self.scheme}://{self.authority}{self.path}" + ("" if self.query is None else f"?{self.query}")

    @property
    def labels(self) -> tuple[str, ...]:
        """The labels of the host from the top down, without a leading ``www``."""
        host = self.authority.rpartition("@")[2].lower()
        host = host.partition("]")[0] if host.startswith("[") else host.partition(":")[0]
        parts = tuple(reversed(host.split(".")))
        return parts[:-1] if len(parts) > 1 and parts[-1] == "www" else parts


def link(reference: str, base: Link | None = None) -> Link | None:
    """Where a reference on a page leads; None where that isn't a web page (another scheme, no host, or a place on the page itself)."""
    reference = re.sub(r"[\t\r\n]", "", reference.strip())
    if not reference or reference.startswith("#"):
        return None
    m = _REFERENCE.fullmatch(reference)
    scheme, authority, path, query = (m[k] for k in ("scheme", "host", "path", "query"))
    if scheme is None:
        if base is None:
            return None
        scheme = base.scheme
        if authority is None:
            authority = base.authority
            if not path:
                path, query = base.path, base.query if query is None else query
            elif not path.startswith("/"):
                path = (base.path[: base.path.rfind("/") + 1] or "/") + path
    scheme = scheme.lower()
    if scheme not in ("http", "https") or not authority:
        return None
    return Link(scheme, authority, _PATH_SIGN.sub(lambda c: "".join(f"%{b:02X}" for b in c[0].encode("utf-8", "replace")), _straight(path)), query)


def _straight(path: str) -> str:
    """A path without ``.`` and ``..``."""
    out: list[str] = []
    parts = path.split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "..":
            if len(out) > 1:
                out.pop()
        elif part != ".":
            out.append(part)
            continue
        if last:
            out.append("")
    return "/".join(out)


def tier(path: str, text: str = "") -> int | None:
    """0 for a page that its path or link calls a contact page, 1 for one that may hold a contact, else None."""
    words = f"{path} {text}".lower()
    for k, known in enumerate((STRONG_WORDS, WEAK_WORDS)):
        if any(w in words for w in known):
            return k
    return None


def tier_of(url: str, text: str = "") -> int | None:
    """``tier`` of a reference by its path alone."""
    return tier(_REFERENCE.fullmatch(url)["path"], text)


_MAILBOX = re.compile(r"[^@\s]+@[a-z0-9-]+(\.[a-z0-9-]+)+")


def contact(href: str) -> tuple[str, str] | None:
    """(channel, value) of a mail or phone link: the first recipient with its domain in lower case, or a number of seven digits at least."""
    kind, _, rest = href.partition(":")
    match kind.lower():
        case "mailto":
            name, _, domain = rest.split("?")[0].split(",")[0].strip().partition("@")
            mailbox = f"{name}@{domain.lower()}"
            return ("email", mailbox) if _MAILBOX.fullmatch(mailbox) else None
        case "tel":
            number = "".join(c for c in rest if c in "0123456789+()-. ").strip()
            return ("phone", number) if sum(c.isdigit() for c in number) >= 7 else None
    return None


class Site:
    """A website by its address: its own host and all below it, at the boundary of a label."""

    def __init__(self, url: str) -> None:
        self.home = link(url or "")

    def covers(self, other: Link | None) -> bool:
        if self.home is None or other is None:
            return False
        own = self.home.labels
        return own != ("",) and other.labels[: len(own)] == own

    def contact_links(self, page: Page) -> Iterator[tuple[str, int, int]]:
        """(address, tier, place) of the page's links to pages of the site that may hold contacts, each address once."""
        seen = {str(self.home).rstrip("/")} if self.home else set()
        for k, anchor in enumerate(page.anchors):
            to = link(anchor.href, self.home)
            if not self.covers(to) or str(to) in seen or str(to).rstrip("/") == str(self.home).rstrip("/"):
                continue
            found = tier(to.path, anchor.text)
            if found is not None:
                seen.add(str(to))
                yield str(to), found, k

    def owns(self, url: str, channel: str, value: str) -> bool:
        """Whether a contact is the site's own: it stands on a contact page, or is a mailbox of the site's domain."""
        return tier_of(url) == 0 or (channel == "email" and self.covers(link(f"https://{value.rpartition('@')[2]}/")))
