"""The keyword and domain query language, compiled to column predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(word: str) -> str:
    """A word's pattern: stars at the ends drop that word boundary, inner stars match anything; the rest is a raw pattern."""
    head = "" if word.startswith("*") else r"\b"
    tail = "" if word.endswith("*") and len(word) > 1 else r"\b"
    core = word[1 if word.startswith("*") else 0 : -1 if word.endswith("*") and len(word) > 1 else None]
    return "(?U)(?d)" + (head + core.replace("*", ".*") + tail).lower()


def keyword_filter(text: Column, keys: Iterable[str]) -> Column:
    """Keys are AND-ed; ``a|b`` in a key is OR; ``!key`` rejects and is not split at ``|``.

    ``text`` is compared in lower case.  No keys at all accept every row; only negative keys reject every row; null text never matches.
    """
    keys = [k for k in keys if k]
    if not keys:
        return F.lit(True)
    low = F.lower(text)
    positive, negative = [k for k in keys if not k.startswith("!")], [k[1:] for k in keys if k.startswith("!") and len(k) > 1]
    if not positive:
        return F.lit(False)
    out = F.lit(True)
    for k in positive:
        one = F.lit(False)
        for alternative in k.split("|"):
            one = one | low.rlike(_pattern(alternative))
        out = out & one
    for k in negative:
        out = out & ~low.rlike(_pattern(k))
    return F.coalesce(out, F.lit(False))


def event_text(*maps: Column) -> Column:
    """Keys and values of maps in their order, joined by one blank."""
    parts = [F.flatten(F.transform(F.map_entries(m), lambda e: F.array(e["key"], F.coalesce(e["value"], F.lit(""))))) for m in maps]
    return F.array_join(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]), " ")


def _topic(pattern: str) -> str | None:
    """An expression for ``+`` (one level) and ``#`` (the rest); None without wildcards."""
    if "+" not in pattern and "#" not in pattern:
        return None
    levels = [r"[^/]+" if p == "+" else r".*" if p == "#" else "".join("\\" + c if not c.isalnum() else c for c in p) for p in pattern.split("/")]
    return "^" + "/".join(levels).replace(r"/.*", r"(?:/.*)?") + "$"


def domain_filter(domain: Column, specs: Iterable[str]) -> Column:
    """Positive specs are OR-ed, ``!spec`` excludes; only negative ones start from all.

    A spec matches as a part of the domain in lower case or with topic wildcards.  A null domain matches no positive spec and is never excluded.
    """
    specs = [s for s in specs if s]
    low = F.lower(domain)

    def hit(s: str) -> Column:
        topic = _topic(s.lower())
        found = F.contains(low, F.lit(s.lower()))
        return F.coalesce(found | low.rlike(topic) if topic else found, F.lit(False))

    positive, negative = [s for s in specs if not s.startswith("!")], [s[1:] for s in specs if s.startswith("!") and len(s) > 1]
    out = F.lit(not positive)
    for s in positive:
        out = out | hit(s)
    for s in negative:
        out = out & ~hit(s)
    return out
