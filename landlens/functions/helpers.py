"""Vectorised Python helpers for what built-in functions cannot do; each takes and returns whole Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    import html

    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def redecode_cp949(s: pd.Series) -> pd.Series:
    """What a text reads as if its cp949 bytes were UTF-8."""
    return s.map(lambda x: x.encode("cp949", "ignore").decode("utf-8", "ignore"), na_action="ignore")


@F.pandas_udf(StringType())
def decode_bytes(b: pd.Series) -> pd.Series:
    """Strict UTF-8, else cp949 without its errors."""

    def one(x):
        try:
            return bytes(x).decode("utf-8")
        except UnicodeDecodeError:
            return bytes(x).decode("cp949", "ignore")

    return b.map(one, na_action="ignore")


@F.pandas_udf(BooleanType())
def robots_allowed(robots: pd.Series, url: pd.Series) -> pd.Series:
    """Whether a host's robots text lets any agent read the url; no text allows all."""
    from urllib.robotparser import RobotFileParser

    parsed = {}
    for text in set(robots.dropna()):
        parsed[text] = RobotFileParser()
        parsed[text].parse(text.splitlines())
    return pd.Series([u is not None and (r not in parsed or parsed[r].can_fetch("*", u)) for r, u in zip(robots, url)], dtype=bool)


def longest_run(a: str, b: str) -> tuple[int, int, int]:
    """Start in ``a``, start in ``b`` and length of their longest common run, the first in ``a``, then in ``b``, of equals.

    A suffix automaton of ``a`` reads ``b`` once: time and memory grow with the two lengths, whatever repeats in them."""
    step, link, size, end = [{}], [-1], [0], [-1]  # of each state: transitions, suffix link, longest run, its first end in a
    last = 0
    for at, c in enumerate(a):
        new = len(step)
        step.append({}), link.append(0), size.append(size[last] + 1), end.append(at)
        p, last = last, new
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p < 0:
            continue
        q = step[p][c]
        if size[q] > size[p] + 1:  # q also stands for longer runs: the short ones get a state of their own
            part = len(step)
            step.append(dict(step[q])), link.append(link[q]), size.append(size[p] + 1), end.append(end[q])
            link[q] = part
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = part
                p = link[p]
            q = part
        link[new] = q
    best, state, n = (0, 0, 0), 0, 0
    for at, c in enumerate(b):
        while state and c not in step[state]:
            state = link[state]
            n = size[state]
        if c in step[state]:
            state, n = step[state][c], n + 1
        else:
            n = 0
        best = min(best, (-n, end[state] - n + 1, at - n + 1)) if n else best
    return best[1], best[2], -best[0]


@F.pandas_udf(StringType())
def longest_common_excerpt(opinion: pd.Series, source: pd.Series) -> pd.Series:
    """Longest common run of at least 8 characters, with 15 before and 16 after in the source; empty if none, or if a text is null."""

    def one(a, b):
        if not a or not b:
            return ""
        _, at, n = longest_run(a, b)
        return b[max(0, at - 15) : at + n + 16] if n >= 8 else ""

    return pd.Series([one(a, b) for a, b in zip(opinion, source)], dtype=object)
