"""URL filters: rules indexed by their rarest literal token.

A rule is a host and path prefix (`allow example.org/en/`) or a regular expression. From each, the
literal tokens that any matching url must have whole are taken; the rarest of them, by the number of urls
with the token in the whole table, is the rule's key. A url's tokens fetch candidate rules and only those run their
regular expressions. Rules without such a token are candidates for every url.

Scale: the table is read twice (token counts, judging), never shuffled by url; only rule tokens are counted. The rule list is a
parameter held by the driver and sent to every task; MAX_RULES bounds it.

Defined results: a null url, or one without `://`, has an empty host and path and takes the default
verdict unless a pattern fits its text; repeated rows are each judged; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellreach.llm.common import LOWER, UPPER, lower_ascii, row_struct

MAX_RULES = 1_000_000
_FOLD = str.maketrans(UPPER, LOWER)
_WORDS = re.compile(r"[^\W_]+")
#: Rules on host and path, as (action, rule).
SITE_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Rules on the whole lower-cased url, as (action, regular expression); they apply where no site rule fits.
PATTERN_RULES = [
    ("block", r"\bcasino\b"),
    ("block", r"\bporn\b"),
    ("block", r"/wp-login\.php"),
    ("block", r"\bviagra\b"),
    ("block", r"/phishing/"),
]


@dataclass(frozen=True)
class Rule:
    action: str
    text: str
    regex: str
    site: bool
    tokens: tuple[str, ...]


def site_rule(action: str, text: str) -> Rule:
    """A host with all its subdomains, and a path prefix; text is host, then path from the first '/'."""
    host, slash, path = text.partition("/")
    host = host.translate(_FOLD)
    whole = _WORDS.findall(host)
    parts = _WORDS.findall(path)
    open_end = bool(path) and bool(_WORDS.fullmatch(path[-1]))
    whole += parts[:-1] if open_end else parts
    regex = rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    return Rule(action, text, regex, True, tuple(t.lower() for t in whole))


def _literal_tokens(regex: str) -> list[str]:
    """Alphanumeric runs that every match has, with a boundary or other literal on both sides."""
    from re import _constants as sre
    from re import _parser

    tokens, run, left = [], "", False
    for op, arg in [*_parser.parse(regex), (None, None)]:
        char = chr(arg) if op is sre.LITERAL else None
        if char is not None and _WORDS.fullmatch(char):
            run += char
            continue
        bound = char is not None or (op is sre.AT and arg is sre.AT_BOUNDARY)
        if run and left and bound:
            tokens.append(run.lower())
        run, left = "", bound
    return tokens


def pattern_rule(action: str, regex: str) -> Rule:
    return Rule(action, regex, regex, False, tuple(_literal_tokens(regex)))


def rules_of(site_rules: Iterable[tuple[str, str]], pattern_rules: Iterable[tuple[str, str]]) -> list[Rule]:
    rules = [site_rule(*r) for r in site_rules] + [pattern_rule(*r) for r in pattern_rules]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit in a task")
    return rules


def token_counts(pages: DataFrame, url_col: str, rules: list[Rule]) -> dict[str, int]:
    """In how many urls each token of the rules occurs; a row a token reaches the driver."""
    tokens = sorted({t for r in rules for t in r.tokens})
    if not tokens:
        return {}
    wanted = pages.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    found = pages.select(F.explode(F.array_distinct(F.split(F.lower(url_col), r"[\W_]+"))).alias("token"))
    rows = found.join(F.broadcast(wanted), "token").groupBy("token").agg(F.count(F.lit(1)).alias("c")).collect()
    return {r["token"]: r["c"] for r in rows}


def _index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    index: dict[str, list[Rule]] = {}
    always = []
    for rule in rules:
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
        else:
            always.append(rule)
    return index, always


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(F.coalesce(after, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame,
    url_col: str = "url",
    site_rules: Iterable[tuple[str, str]] = tuple(SITE_RULES),
    pattern_rules: Iterable[tuple[str, str]] = tuple(PATTERN_RULES),
    default: str = "allow",
) -> DataFrame:
    """(row, host, path, rule, verdict, pattern) of every row; `row` packs the columns of pages.

    The longest site rule that fits decides; else the longest pattern that is found (block before allow
    at equal length); else the default.
    """
    rules = rules_of(site_rules, pattern_rules)
    held = pages.sparkSession.sparkContext.broadcast(_index(rules, token_counts(pages, url_col, rules)))

    @F.pandas_udf("rule string, pattern string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index, always = held.value
        compiled = {r: re.compile(r.regex) for rs in index.values() for r in rs} | {r: re.compile(r.regex) for r in always}
        for urls, hosts, paths in batches:
            out = []
            for url, host, path in zip(urls, hosts, paths, strict=True):
                lower, best, found = (url or "").lower(), None, None
                tokens = set(_WORDS.findall(lower))
                for rule in [*always, *(r for t in tokens for r in index.get(t, ()))]:
                    if rule.site:
                        if (best is None or len(rule.text) > len(best.text)) and compiled[rule].match(host + path):
                            best = rule
                    elif compiled[rule].search(lower) and (
                        found is None or (len(rule.text), rule.action) > (len(found.text), found.action)
                    ):
                        found = rule
                decided = best or found
                out.append((best and best.text, found and found.text, decided.action if decided else default))
            yield pd.DataFrame(out, columns=["rule", "pattern", "verdict"])

    url = F.col(f"row.`{url_col}`")
    rows = pages.select(row_struct(pages).alias("row")).select("row", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = rows.withColumn("j", judge(url, F.col("host"), F.col("path")))
    return judged.select(
        "row", "host", "path", F.col("j.rule").alias("rule"), F.col("j.verdict").alias("verdict"), F.col("j.pattern").alias("pattern")
    )
