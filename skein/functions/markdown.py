"""A plain dialect of markdown to HTML: headings, lists, fences, paragraphs, emphasis, code, links; raw HTML is escaped, diagrams get a div."""

from __future__ import annotations

import re
from html import escape

import pandas as pd

_LINK = re.compile(r"\[([^\]]*)\]\(([^)\s]*)\)")


def _inline(text: str) -> str:
    parts = re.split(r"(`[^`]*`)", text)
    out = []
    for p in parts:
        if len(p) > 1 and p[0] == p[-1] == "`":
            out.append(f"<code>{escape(p[1:-1])}</code>")
            continue
        p = escape(p)
        p = _LINK.sub(lambda m: f'<a href="{m[2] if "://" in m[2] else m[2].replace(".md", ".html", 1)}">{m[1]}</a>', p)
        out.append(re.sub(r"(?<!\*)\*([^*]+)\*(?!\*)", r"<em>\1</em>", re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", p)))
    return "".join(out)


def to_html(text: str) -> str:
    out, para, items, fence, code = [], [], [], None, []

    def flush() -> None:
        if para:
            out.append(f"<p>{_inline(' '.join(para))}</p>")
            para.clear()
        if items:
            out.append("<ul>" + "".join(f"<li>{_inline(i)}</li>" for i in items) + "</ul>")
            items.clear()

    def close() -> None:
        body = escape("\n".join(code))
        out.append(f'<div class="mermaid">{body}</div>' if fence == "mermaid" else f"<pre><code>{body}</code></pre>")
        code.clear()

    for line in text.replace("\r", "").split("\n"):
        if line.lstrip().startswith("```"):
            if fence is None:
                flush()
                fence = line.strip().strip("`").strip().lower()
            else:
                close()
                fence = None
        elif fence is not None:
            code.append(line)
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            flush()
            out.append(f"<h{len(m[1])}>{_inline(m[2].strip())}</h{len(m[1])}>")
        elif m := re.match(r"\s*[-*]\s+(.*)", line):
            if para:
                flush()
            items.append(m[1])
        elif line.strip():
            if items:
                flush()
            para.append(line.strip())
        else:
            flush()
    if fence is not None:
        close()
    flush()
    return "\n".join(out)


def html_series(texts: pd.Series) -> pd.Series:
    """For F.pandas_udf(html_series, 'string')."""
    return texts.map(lambda t: None if t is None else to_html(t))
