"""Visible text of web pages, and hashed text vectors: Arrow-batched, as Spark has no functions for them."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose text isn't shown, and those that end a line.
HIDDEN = {"script", "style", "nav", "header", "footer", "noscript", "iframe"}
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "section", "article"}


#: Comments, declarations and tags of a page.
_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)[^>]*>", re.S)
_RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in ("script", "style")}


def _shown(page: str) -> Iterator[str]:
    """The character data between a page's markup, where nothing hides it, and a line feed for each block's edge."""
    at, depth = 0, 0
    while tag := _MARKUP.search(page, at):
        if not depth:
            yield html.unescape(page[at : tag.start()])
        at, name = tag.end(), (tag["name"] or "").lower()
        if name in BLOCKS:
            yield "\n"
        elif name in HIDDEN:
            depth = max(depth - 1, 0) if tag["end"] else depth + 1
            if not tag["end"] and name in _RAW_END:  # its content isn't markup
                end = _RAW_END[name].search(page, at)
                at = end.start() if end else len(page)
    if not depth:
        yield html.unescape(page[at:])


def visible(page: str | None) -> str | None:
    """Text that a page shows: its lines without outer white space, single spaces in them, and no empty ones; null stays null."""
    if page is None:
        return None
    lines = (re.sub(r"[ \t\r\f\v]+", " ", line).strip() for line in "".join(_shown(page)).split("\n"))
    return "\n".join(line for line in lines if line)


@F.pandas_udf(T.StringType())
def visible_text(raw: pd.Series) -> pd.Series:
    return raw.map(visible)


def hashed_vector(text: str, dims: int = 512) -> list[float]:
    """Signed hashing of character 2- to 4-grams and ASCII words, of unit length."""
    plain = re.sub(r"\s+", "", text.lower())
    terms = Counter(plain[i : i + n] for n in (2, 3, 4) for i in range(len(plain) - n + 1))
    terms.update(re.findall(r"[a-z0-9_]+", text.lower()))
    out = np.zeros(dims)
    for term, n in terms.items():
        h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big")
        out[h % dims] += n if h >> 63 else -n
    length = float(np.linalg.norm(out))
    return (out / length if length else out).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def text_vector(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hashed_vector(t or ""))
