"""URL filtering with pattern rules that are indexed by their rarest literal token.

Everything on the main path is a native expression. A URL is cut into tokens; each token fetches, from a
literal table hashed by CRC-32, the rules filed under it, and only those rules run their regular expression.
There is no join and no shuffle over the URLs; the one aggregate is the count of rule tokens in the corpus,
which decides under which token a rule is filed and has a row for each distinct rule token at most.

Rules are parameters of the operator (text in the syntax of ad-blocking lists), so their number does not grow
with the data.

Defined cases: a null URL has an empty host and path, no rule and verdict ``allow``; so has a URL without
``://`` as far as host and path go, while pattern rules still see the whole text. Of path
rules that fit, the longest host and path wins, and of pattern rules an exception wins over any block; a null id is kept;
URLs of any length are read whole; repeated rows give repeated results; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Default pattern rules. ``||`` anchors at a host label, ``|`` at an end, ``^`` is a separator or the end,
#: ``*`` any text, a leading ``@@`` marks an exception.
PATTERN_RULES = (
    "||ads-track.",
    "||adserver.",
    "||doubleclick.",
    "||tracker.",
    "/adframe/*",
    "/banners/*/click^",
    "/pixel.gif^",
    "/popunder/",
    "?ad_slot=",
    "&ad_slot=",
    "@@||ads-track.*/privacy^",
    "@@||tracker.*/opt-out^",
)

#: Default host and path rules: (verdict, host, path).
PATH_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

ENTRY = "struct<key:string,pattern:string,allow:boolean>"
PATH_ENTRY = "struct<key:string,path:string,rule:string,verdict:string>"


@dataclass(frozen=True)
class PatternRule:
    text: str
    pattern: str
    allow: bool
    tokens: tuple[str, ...]


def parse_rule(text: str) -> PatternRule:
    """The regular expression of a rule, and the literal tokens that every URL it matches must hold whole."""
    allow, body = text.startswith("@@"), text.removeprefix("@@").lower()
    host = body.startswith("||")
    start = not host and body.startswith("|")
    body = body[2 if host else 1 if start else 0 :]
    end = body.endswith("|")
    body = body[: len(body) - end]
    parts = {"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}
    pattern = "".join(parts.get(c) or re.sub(r"([^a-z0-9_ /-])", r"\\\1", c) for c in body)
    pattern = ("^[a-z][a-z0-9+.-]*://(?:[^/?#]*[.@])?" if host else "^" if start else "") + pattern + "$" * end
    tokens = []
    for m in re.finditer(r"[a-z0-9%]+", body):
        before = body[m.start() - 1] if m.start() else "|" if host or start else "*"
        after = body[m.end()] if m.end() < len(body) else "|" if end else "*"
        if before != "*" and after != "*":
            tokens.append(m[0])
    return PatternRule(text, pattern, allow, tuple(dict.fromkeys(tokens)))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL that is lower-case already."""
    return F.array_distinct(F.filter(F.split(url, "[^a-z0-9%]+"), lambda t: t != ""))


def lowered(url: Column) -> Column:
    return F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)


def token_counts(urls: DataFrame, url: str, wanted: list[str]) -> dict[str, int]:
    """How many URLs hold each of the wanted tokens; a row for each of them at most reaches the driver."""
    if not wanted:
        return {}
    mine = F.array(*[F.lit(t) for t in wanted])
    held = urls.select(F.explode(F.array_intersect(url_tokens(lowered(urls[url])), mine)).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def _buckets(entries: list[tuple[str, Column]], kind: str) -> Column:
    """A literal hash table: entries filed by the CRC-32 of their key."""
    size = max(1, 2 * len(entries))
    filed: list[list[Column]] = [[] for _ in range(size)]
    for key, entry in entries:
        filed[zlib.crc32(key.encode()) % size].append(entry)
    return F.array(*[F.array(*b).cast(f"array<{kind}>") for b in filed])


def _fetch(keys: Column, entries: list[tuple[str, Column]], kind: str) -> Column:
    if not entries:
        return F.array().cast(f"array<{kind}>")
    held, size = _buckets(entries, kind), max(1, 2 * len(entries))
    return F.flatten(
        F.transform(
            keys,
            lambda t: F.filter(
                F.element_at(held, (F.crc32(t.cast("binary")) % size + 1).cast("int")), lambda r: r["key"] == t
            ),
        )
    )


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    pattern_rules: tuple[str, ...] = PATTERN_RULES,
    path_rules: tuple[tuple[str, str, str], ...] = PATH_RULES,
) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, the longest fitting path ``rule`` or null, and ``verdict``.

    A path rule decides where one fits; else the URL is blocked if a pattern rule matches and no exception does.
    """
    rules = [parse_rule(r) for r in pattern_rules]
    counts = token_counts(pages, url, sorted({t for r in rules for t in r.tokens}))
    filed, always = [], []
    for r in rules:
        key = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None)
        entry = F.struct(F.lit(key or "").alias("key"), F.lit(r.pattern).alias("pattern"), F.lit(r.allow).alias("allow"))
        always.append(entry) if key is None else filed.append((key, entry))

    whole = F.coalesce(pages[url], F.lit(""))
    base = pages.select(
        *[pages[c] for c in keep],
        lowered(pages[url]).alias("_low"),
        F.translate(F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    candidates = F.concat(_fetch(url_tokens(F.col("_low")), filed, ENTRY), F.array(*always).cast(f"array<{ENTRY}>"))
    hits = F.filter(candidates, lambda r: F.regexp_like(F.col("_low"), r["pattern"]))

    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    by_host = [
        (h, F.struct(F.lit(h).alias("key"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in path_rules
    ]
    fitting = F.filter(_fetch(suffixes, by_host, PATH_ENTRY), lambda r: F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]), r["rule"], r["verdict"])))
    return (
        base.withColumn("_hits", hits)
        .withColumn("_rule", longest)
        .select(
            *keep,
            "host",
            "path",
            F.col("_rule.rule").alias("rule"),
            F.coalesce(
                F.col("_rule.verdict"),
                F.when(
                    F.exists("_hits", lambda r: ~r["allow"]) & ~F.exists("_hits", lambda r: r["allow"]), "block"
                ).otherwise("allow"),
            ).alias("verdict"),
        )
    )


def oracle() -> str:
    """DuckDB SQL for the default rules over ``pages``."""
    rules = [parse_rule(r) for r in PATTERN_RULES]
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    match = lambda allow: " OR ".join(
        f"regexp_matches({low}, '{r.pattern}', 's')" for r in rules if r.allow == allow
    )
    values = ", ".join(f"('{v}', '{h}', '{p}', '{h}{p}')" for v, h, p in PATH_RULES)
    return f"""
WITH u AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         CASE WHEN ({match(False)}) AND NOT ({match(True)}) THEN 'block' ELSE 'allow' END AS own
  FROM pages),
r(v, h, p, rule) AS (VALUES {values})
SELECT page_id, host, path,
       (SELECT rule FROM r WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
        ORDER BY length(rule) DESC LIMIT 1) AS rule,
       coalesce((SELECT v FROM r WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
        ORDER BY length(rule) DESC LIMIT 1), own) AS verdict
FROM u"""
