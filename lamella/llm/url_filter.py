"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A term counts only where it stands between boundaries (no letter or digit on either side).  One strict term rejects; soft
terms reject when the weights of the distinct ones found reach ``soft_limit``.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lamella.llm.common import LOWER, UPPER

#: The vocabulary, term -> weight.
STRICT = ("casino", "porn", "xxx", "viagra", "adult", "cheap-pills", "escort", "warez", "spam")
SOFT = {"free": 1, "win": 1, "bets": 1, "poker": 1, "pills": 1, "cheap": 1, "sex": 1, "loan": 1, "ads": 1, "track": 1, "farm": 1, "bonus": 1, "torrent": 1, "crack": 1}
SOFT_LIMIT = 2
#: The rules of the contract, (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased; path: then up to ``?`` or ``#``. Both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    part = lambda i: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; null where none fits. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def automaton(strict=STRICT, soft=SOFT):
    import ahocorasick
    a = ahocorasick.Automaton()
    for t in sorted({*strict, *soft}):
        a.add_word(t, (len(t), t, t in strict, soft.get(t, 0)))
    a.make_automaton()
    return a


def is_part(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def hits(a, url: str | None) -> tuple[bool, int, list[str]]:
    """(a strict term occurs, summed weight of the distinct soft terms, the terms) of a URL; A-Z lower-cased."""
    low = (url or "").translate({ord(u): l for u, l in zip(UPPER, LOWER)})
    found = {}
    for end, (n, term, strict, weight) in a.iter(low):
        start = end + 1 - n
        if (start == 0 or not is_part(low[start - 1])) and (end + 1 == len(low) or not is_part(low[end + 1])):
            found[term] = (strict, weight)
    return any(s for s, _ in found.values()), sum(w for s, w in found.values() if not s), sorted(found)


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """One row for each row of ``pages``: ``id_col, host, path, rule, verdict, strict_hit, soft_weight, terms``.

    ``verdict`` is the longest fitting rule's, else ``block`` on a strict term or on soft terms of ``soft_limit`` or more in
    all, else ``allow``.  A null or empty URL has empty host and path, no terms and is allowed.  Rules and vocabulary travel
    with the task; they are arguments, not data.
    """
    given = pages.select(pages[f"`{id_col}`"].alias("id"), pages[f"`{url_col}`"].alias("url"))

    def run(batches):
        a = automaton(strict, soft)
        for b in batches:
            rows = [hits(a, u.as_py()) for u in b.column("url")]
            yield pa.RecordBatch.from_arrays([
                b.column("id"), b.column("url"), pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["id", "url", "strict_hit", "soft_weight", "terms"])

    kind = given.schema["id"].dataType.simpleString()
    d = given.mapInArrow(run, f"id {kind}, url string, strict_hit boolean, soft_weight long, terms array<string>")
    host, path = host_and_path(F.col("url"))
    d = d.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("strict_hit") | (F.col("soft_weight") >= soft_limit), "block").otherwise("allow")
    return d.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "strict_hit", "soft_weight", "terms")


def sql(rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> str:
    """The same verdicts in SQL over ``pages``."""
    bound = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    up = f"translate(%s, '{UPPER}', '{LOWER}')"
    case = lambda out: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{out(h, p, v)}'"
        for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r), reverse=True)) + " END"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, {up % 'url'} AS low, {up % "regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's')"} AS host,
             regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM u),
v AS (SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS said,
             {' OR '.join(bound(t) for t in strict)} AS strict_hit,
             {' + '.join(f'{w} * cast({bound(t)} AS int)' for t, w in soft.items() if t not in strict)} AS soft_weight FROM p)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN strict_hit OR soft_weight >= {soft_limit} THEN 'block' ELSE 'allow' END) AS verdict FROM v"""
