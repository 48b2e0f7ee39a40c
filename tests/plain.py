"""Plain versions of operators, line by line in Python, that tests hold the column expressions against."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

_BLOCKS = {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "section", "article", "footer", "nav", "ul"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def strip_html(markup: str | None) -> str | None:
    """Visible text of markup: no tags, scripts or styles, entities resolved, blanks collapsed, a line for each block."""
    if markup is None:
        return None
    reader = _Text()
    reader.feed(markup)
    reader.close()
    lines = [re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in html.unescape("".join(reader.parts)).split("\n")]
    return "\n".join(x for x in lines if x)


#: Section names by the headers that open them.
SECTIONS = {
    "summary": ("summary", "profile", "objective", "about me"),
    "experience": ("experience", "work experience", "employment", "work history"),
    "education": ("education", "academic background", "qualifications"),
    "skills": ("skills", "technical skills", "core competencies"),
    "projects": ("projects", "key projects"),
    "certifications": ("certifications", "certificates", "licenses"),
}
_HEADERS = {h: s for s, hs in SECTIONS.items() for h in hs}


def sections(text: str | None) -> dict[str, str]:
    """Text by section: a header stands alone on its line, numbered or with a colon, or opens a line before a colon."""
    out: dict[str, list[str]] = {"header": []}
    now = "header"
    for line in (text or "").split("\n"):
        bare = re.sub(r"^\s*(?:\d+[.)]\s*)?|\s+$", "", line)
        if not bare or re.fullmatch(r"[-=_*~\s]+", bare):
            continue
        head, colon, rest = bare.partition(":")
        found = _HEADERS.get(head.strip().lower())
        if found and (colon or head.strip().lower() == bare.lower()):
            now = found
            out.setdefault(now, [])
            bare = rest.strip()
            if not bare:
                continue
        out[now].append(bare)
    return {k: "\n".join(v) for k, v in out.items() if v}
