"""String expressions over documents, links and evidence."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tracking parameters that a link loses, by their beginnings.
TRACKING = ("utm_", "spm", "from", "source")


def normal_text(text: Column) -> Column:
    """Digits, ASCII letters and CJK ideographs only, in lower case.  What goes is named by its ranges: Java takes several times as long for all but what stays."""
    return F.lower(F.regexp_replace(text, r"[\x00-/:-@\[-`{-\x{4DFF}\x{A000}-\x{10FFFF}]+", ""))


def fingerprint(text: Column) -> Column:
    return F.sha2(normal_text(text), 256)


def normal_url(url: Column) -> Column:
    """Lower-case scheme and host, single slashes, no trailing slash, no tracking parameters, no fragment."""
    value = F.trim(url)
    bare = F.regexp_replace(value, r"(?s)#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"(?s)^([^/?]*://[^/?]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"(?s)^(?:[^/?]*://[^/?]*)?([^?]*)", 1), r"/+", "/"), r"/+$", "")
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(" + "|".join(TRACKING) + ")"))
    named = F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    tail = F.array_join(named, "&")
    return F.concat(head, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))


def gram_list(text: str | None, sizes: tuple[int, ...]) -> list[str]:
    """Every n-gram of a normalised text, for each size in turn."""
    t = re.sub(r"[^0-9a-zA-Z\u4e00-\u9fff]+", "", text or "").lower()
    return [t[i : i + n] for n in sizes for i in range(len(t) - n + 1)]


def all_grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Every n-gram of a text: Arrow-batched, as a lambda over positions would walk through the text for each."""

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: gram_list(t, sizes))

    return run(text)


#: Lower case of ASCII bytes, and those that aren't letters or digits.
_LOWER, _DROPPED = bytes(range(256)).lower(), bytes(b for b in range(128) if not chr(b).isalnum())
#: Digits and letters of either case as 1 to 36; Chinese signs, as ``normal_text`` keeps them.
_SYMBOL, _SIGN = bytes(int(chr(b), 36) + 1 if b < 128 and chr(b).isalnum() else 0 for b in range(256)), re.compile("[\u4e00-\u9fff]")


def _gram_hashes(c: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the n-grams of code points, in their places."""
    width = min(size, len(c))
    h = np.zeros(len(c) - width + 1 if width else 0, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + len(h)]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _numbers(symbols: np.ndarray, size: int) -> np.ndarray:
    """The n-grams of symbols from 1 to 36 as numbers to base 37."""
    width = min(size, len(symbols))
    h = np.zeros(len(symbols) - width + 1 if width else 0, np.uint32)
    for k in range(width):
        h = h * np.uint32(37) + symbols[k : k + len(h)]
    return h


def gram_set(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of a normalised text's distinct n-grams, in order; a shorter text is its own gram, an empty one has none."""
    text = text or ""
    if text.isascii():
        c = np.frombuffer(text.encode().translate(_LOWER, _DROPPED), np.uint8).astype(np.uint64) + np.uint64(1)
    else:
        t = re.sub(r"[^0-9a-zA-Z\u4e00-\u9fff]+", "", text).lower()
        c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = np.sort(_gram_hashes(c, size))
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


def gram_codes(text: str | None, size: int) -> tuple[np.ndarray, bool]:
    """32-bit codes of the grams of ``gram_set``, in order, and whether no two grams share one: true of texts without Chinese signs.

    Up to six letters and digits are numbers to base 37; other grams have hashes beyond these numbers, which may repeat.
    """
    text, short = text or "", size <= 6
    if short and not _SIGN.search(text):
        h = _numbers(np.frombuffer(text.encode("ascii", "ignore").translate(_SYMBOL, _DROPPED), np.uint8), size)
        h.sort()
        return (h[np.append(True, h[1:] != h[:-1])] if len(h) else h), True
    c = np.frombuffer(re.sub(r"[^0-9a-zA-Z\u4e00-\u9fff]+", "", text).lower().encode("utf-32-le"), np.uint32)
    hashes, first = np.unique(_gram_hashes(c.astype(np.uint64) + np.uint64(1), size), return_index=True)
    hashes, base = hashes.view(np.uint64), 37**size if short else 0
    codes = (np.uint64(base) + (hashes >> np.uint64(20)) % np.uint64((1 << 32) - base)).astype(np.uint32)
    if short and len(c):
        symbols = np.frombuffer(_SYMBOL, np.uint8)[np.minimum(c, 127)] * (c < 128)
        width = min(size, len(c))
        plain = np.convolve(c < 128, np.ones(width, np.int64), "valid")[first] == width
        codes = np.where(plain, _numbers(symbols, size)[first], codes)
    return np.sort(codes), False


def grams(text: Column, size: int = 5) -> Column:
    """Hashes of the distinct n-grams of a normalised text, as longs."""

    @F.pandas_udf("array<long>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: gram_set(t, size))

    return run(text)


def overlap_similarity(left: Column, right: Column) -> Column:
    """The larger of Jaccard similarity and containment of two gram sets; 0 if one is empty."""
    both, least = F.size(F.array_intersect(left, right)), F.least(F.size(left), F.size(right))
    # containment is never below Jaccard similarity, as the smaller set is no larger than the union
    return F.when(least > 0, both / least).otherwise(0.0)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[。！？!?；;])"), lambda s: F.trim(s)), lambda s: s != "")


def has_any(text: Column, words: list[str]) -> Column:
    """Plain searches that end at the first hit; halved, so that a long list is no deep expression."""
    if len(words) > 1:
        return has_any(text, words[: len(words) // 2]) | has_any(text, words[len(words) // 2 :])
    return F.contains(text, F.lit(words[0])) if words else F.lit(False)


def first_of(text: Column, words: list[str]) -> Column:
    """The first of ``words`` that the text holds, or null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words], F.lit(None).cast("string"))


def matches_groups(text: Column, groups: list[list[str]]) -> Column:
    """Every group has a word in the text."""
    out = F.lit(True)
    for group in groups:
        out = out & has_any(text, group)
    return out


def evidence(text: Column, groups: list[list[str]], limit: int = 160, parts: Column | None = None) -> Column:
    """The first sentence that matches all groups, cut to ``limit``; else a window around the first word found; else empty.  ``parts``: the text's sentences, where they are at hand."""
    whole = F.get(F.filter(sentences(text) if parts is None else parts, lambda s: matches_groups(s, groups)), F.lit(0))
    word = first_of(text, [w for g in groups for w in g])
    start = F.greatest(F.call_function("instr", text, word) - 40, F.lit(1))
    return F.coalesce(F.substring(whole, 1, limit), text.substr(start, F.lit(limit)), F.lit(""))


def cut_at_boundary(text: Column, most: int, marks: tuple[str, ...] = ("。", "；", "，", "、", " ")) -> Column:
    """At most ``most`` characters, ending with the first kind of mark that lies in the second half, if there is one."""
    head = F.substring(text, 1, most)
    out = F.lit(None).cast("string")
    for mark in reversed(marks):
        at = F.length(head) - F.instr(F.reverse(head), mark) + 1
        out = F.when((F.instr(head, mark) > 0) & (at > most / 2), head.substr(F.lit(1), at)).otherwise(out)
    return F.when(F.length(text) <= most, text).otherwise(F.coalesce(out, head))


def recovered_evidence(text: Column, wanted: Column) -> Column:
    """The span of ``text`` that equals ``wanted`` but for white space, as it stands there; null if there is none."""
    bare = F.regexp_replace(wanted, r"\s+", "")
    pattern = F.array_join(F.transform(F.split(bare, ""), lambda c: F.when(c == "", c).otherwise(F.concat(F.lit(r"\Q"), c, F.lit(r"\E")))), r"\s*")
    return F.when(bare != "", F.regexp_substr(text, pattern))


def excerpt(text: Column, terms: list[str], most: int = 4000) -> Column:
    """Sentences with any of the terms, else the first two, cut to ``most``."""
    parts = sentences(text)
    hits = F.filter(parts, lambda s: has_any(s, terms))
    return F.substring(F.array_join(F.when(F.size(hits) > 0, hits).otherwise(F.slice(parts, 1, 2)), ""), 1, most)


def visible_title(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")


def tags_stripped(text: Column) -> Column:
    """Text without tags, white space collapsed, the common named entities resolved once; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", "\u00a0"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", ""), r"[\s\x{a0}]+", " "))


def link_class(url: Column, classes: list[tuple[str, str]], default: str = "other") -> Column:
    """The class of the first host part that the link holds."""
    out = F.lit(default)
    for part, name in reversed(classes):
        out = F.when(F.contains(F.lower(url), F.lit(part)), name).otherwise(out)
    return out


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/]+"), F.lit(False))


def first_snippets(text: Column, most: int = 12) -> Column:
    """The first distinct sentences of a text, as they stand there."""
    return F.slice(F.array_distinct(sentences(text)), 1, most)
