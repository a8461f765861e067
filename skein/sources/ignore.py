"""Ignore files at any level of a tree, with exceptions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


def regex(pattern: str) -> str:
    """A regular expression for a pattern's path below its directory: * and ? stay in a name, ** is any number of directories, brackets are sets of characters."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i) and (i == 0 or pattern[i - 1] == "/") and pattern[i + 2 : i + 3] in ("", "/"):
            last = i + 2 >= len(pattern)
            out, i = out + ("[^/].*" if last else "(?:[^/]+/)*"), i + (2 if last else 3)
            continue
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] in ("!", "^"))) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "(?!/)[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
            out += re.escape(pattern[i])
        i += 1
    return out


@dataclass
class Rule:
    """What one line of an ignore file says of paths below the file's directory."""

    match: re.Pattern
    ignores: bool
    directories: bool


def rules(text: str) -> list[Rule]:
    """The rules of an ignore file. A slash at the start or inside ties a pattern to the file's directory, one at the end to directories; ! makes an exception; blanks at a line's end don't count unless escaped."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        ignores = not line.startswith("!")
        body = line if ignores else line[1:]
        directories, body = body.endswith("/"), body.rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/")
        if body:
            out.append(Rule(re.compile(("" if anchored else "(?:.*/)?") + regex(body), re.S), ignores, directories))
    return out


@dataclass
class Ignored:
    """Whether paths of a tree are ignored, by the rules of its directories ('' is the root). The last rule that fits decides, deeper files after higher ones; below an ignored directory nothing comes back."""

    by_directory: dict[str, list[Rule]]
    _known: dict[str, bool] = field(default_factory=dict)

    def _decided(self, path: str, is_directory: bool) -> bool:
        parts = path.split("/")
        out = False
        for i in range(len(parts)):
            below = "/".join(parts[i:])
            for r in self.by_directory.get("/".join(parts[:i]), ()):
                if (is_directory or not r.directories) and r.match.fullmatch(below):
                    out = r.ignores
        return out

    def directory(self, path: str) -> bool:
        if path not in self._known:
            above = path.rpartition("/")[0]
            self._known[path] = bool(path) and (bool(above) and self.directory(above) or self._decided(path, True))
        return self._known[path]

    def file(self, path: str) -> bool:
        return self.directory(path.rpartition("/")[0]) or self._decided(path, False)
