"""Tokens, links, globs and byte-wise cuts as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9_-]{2,}"
LINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"


def lower(text: Column) -> Column:
    """Lower case, with a capital dotted I as a plain i."""
    return F.lower(F.translate(text, "İ", "i"))


def tokens(text: Column) -> Column:
    """Runs of two or more of a-z, 0-9, _ and - of the lower-cased text, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def trim(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def byte_slice(text: Column, start: Column | int, length: Column | int) -> Column:
    """``length`` bytes from byte ``start`` (from 1) on; a character that is cut becomes U+FFFD."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    return F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), start, length).cast("string"))


def links(text: Column) -> Column:
    """Lower-cased targets of [[target]], [[target|shown]] and [[target#part]], each once, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: lower(trim(x)))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def link_key(path: Column) -> Column:
    """Base name without its last extension, in lower case: what a link to a file is compared with."""
    base = F.regexp_replace(path, r"^.*[/\\]", "")
    return lower(F.regexp_replace(base, r"(?s)^(.+)\.[^.]*$", "$1"))


def glob_regex(pattern: str) -> str | None:
    """A regular expression for a glob whose ``*`` and ``?`` don't cross ``/``; None if the glob is malformed."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            out.append("[" + ("^" if body[0] in "^!" else "") + body.lstrip("^!").replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def matches_globs(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the path or its base name matches one of the globs; a malformed one matches nothing."""
    base = F.regexp_replace(path, r"^.*/", "")
    hit = F.lit(False)
    for p in patterns:
        rx = glob_regex(p)
        if rx is not None:
            hit = hit | path.rlike(rx) | base.rlike(rx)
    return hit


def wanted(path: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Included (everything, if no glob says what) and not excluded."""
    return matches_globs(path, include or ("*",)) & ~matches_globs(path, exclude)
