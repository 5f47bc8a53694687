"""URL filter: host and path rules first, then a weighted vocabulary in the URL.

The vocabulary is an Aho-Corasick automaton over strict and soft terms.  A term counts only where
neither neighbour is a letter or digit.  One strict term, or distinct soft terms whose weights
reach the limit, reject the URL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

# Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The method's vocabulary, a parameter: strict terms, and soft terms with weights.
STRICT = ("porn", "xxx", "casino", "malware", "phishing", "spam-farm", "cheap-pills")
SOFT = {"spam": 1.0, "farm": 1.0, "pills": 1.0, "cheap": 1.0, "bonus": 1.0, "win": 1.0, "free": 1.0, "bet": 1.0, "viagra": 1.0, "adult": 1.0}
SOFT_LIMIT = 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host (or its subdomains) and the start of a path, and its verdict; null without any."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, which are longer, stand outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def vocabulary_verdict(strict=STRICT, soft=SOFT, limit: float = SOFT_LIMIT):
    """A Pandas UDF from URLs to `block` or `allow`; the automaton is built once per batch iterator."""
    terms = [(t, None) for t in strict] + list(soft.items())

    @F.pandas_udf("string")
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in terms:
            automaton.add_word(term, (term, weight))
        automaton.make_automaton()
        edge = lambda c: not (c.isascii() and c.isalnum())

        def judge(url: str | None) -> str:
            if not url:
                return "allow"
            text = "".join(c.lower() if c.isascii() else c for c in url)
            found: dict[str, float] = {}
            for end, (term, weight) in automaton.iter(text):
                start = end - len(term) + 1
                if (start == 0 or edge(text[start - 1])) and (end + 1 == len(text) or edge(text[end + 1])):
                    if weight is None:
                        return "block"
                    found[term] = weight
            return "block" if sum(found.values()) >= limit else "allow"

        for urls in batches:
            yield urls.map(judge, na_action=None).astype(object)

    return verdict


def url_filter(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, limit: float = SOFT_LIMIT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A null url, or one without `://`, has an empty host and path and fits no rule; the vocabulary still judges it
    (null: allow).  Only page_id and url are read, whatever the other columns are named; repeated rows and null ids
    each give a row, an empty table gives none.  A long url is judged as a whole.
    """
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return read.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), vocabulary_verdict(strict, soft, limit)(F.col("url")).alias("by_terms")
    ).select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_terms").alias("verdict"))


def op10_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"))


def oracle(rules=RULES, strict=STRICT, soft=SOFT, limit: float = SOFT_LIMIT) -> str:
    has = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{what}'" for what, h, p in ordered)
    return rf"""
WITH a AS (SELECT page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS u,
       coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN {" OR ".join(has(t) for t in strict)} OR {" + ".join(f"CASE WHEN {has(t)} THEN {w} ELSE 0 END" for t, w in soft.items())} >= {limit} THEN 'block' ELSE 'allow' END AS verdict
FROM b
"""
