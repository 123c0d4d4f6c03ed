"""URL filters whose rules are found by their rarest literal token.

Rules are filter-list patterns: `||host^` (a host and its subdomains), `|` anchors, `*` wildcards, `^` separators, `/regex/`, a
leading `@@` for exceptions. Every rule becomes a regular expression and a set of literal tokens that each matching URL
must contain as whole tokens; those of a `/regex/` rule are read off its parse tree. Token frequencies are counted over all URLs; the
index maps the rarest token of a rule to the rule. A URL's tokens fetch its candidates by a hash join, and only these run their
regular expressions. Rules without such a token are joined to every URL by one common key.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _parser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production rules.
RULES = (
    "||cheap-pills.*^",
    "||spam-farm.example.org^",
    "||casino-win.example.com^",
    "||m.*.example.net^",
    "*utm_source=feed|",
    "*?page=*&ref=x",
    "/^https?:\\/\\/blog\\.[a-z]+\\.example\\.org\\/fr\\//",
    "|http://www.",
    "/\\/[0-9]{2}(?:\\.html|[\\/#?]|$)/",
    "@@*/en/*.html|",
    "@@||blog.*.example.com^",
)
#: Rules up to this many are broadcast with their tokens, more are joined by a shuffle.
BROADCAST_RULES = 200_000
_SEPARATOR = "[^a-z0-9_.%-]"
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def regex_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that are whole in each match of a regular expression: letters and digits that it spells out, between things that can't be either.

    Only what stands in the top-level sequence (or in a group of it) is looked at; alternatives and repetitions end a token on
    both sides, as do characters and sets that may be a letter or a digit.
    """
    try:
        tree = _parser.parse(pattern)
    except re.error:
        return ()
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        return ()
    out: list[str] = []
    run: list[str] | None = None  # None: what stands in front may be part of a token

    def may_be(op, value) -> bool:
        """Whether the item can match, or leave room for, a letter or a digit."""
        if op is _parser.IN:
            if value and value[0][0] is _parser.NEGATE:
                covered = {c for kind, v in value[1:] for c in (range(v[0], v[1] + 1) if kind is _parser.RANGE else [v] if kind is _parser.LITERAL else [])}
                return not set(map(ord, _ALNUM)) <= covered
            return any(kind is _parser.CATEGORY or (kind is _parser.LITERAL and chr(v) in _ALNUM) or (kind is _parser.RANGE and any(v[0] <= ord(c) <= v[1] for c in _ALNUM)) for kind, v in value)
        return True

    def close(boundary: bool) -> None:
        nonlocal run
        if boundary and run:
            out.append("".join(run))
        run = [] if boundary else None

    def walk(items) -> None:
        nonlocal run
        for op, value in items:
            if op is _parser.LITERAL:
                c = chr(value)
                if c in _ALNUM:
                    if run is not None:
                        run.append(c)
                else:
                    close(True)
            elif op is _parser.AT and value in (_parser.AT_BEGINNING, _parser.AT_BEGINNING_STRING, _parser.AT_END, _parser.AT_END_STRING):
                close(True)
            elif op is _parser.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            else:
                close(not may_be(op, value))

    walk(tree)  # what a match ends with may go on in the URL: only a boundary closes a token
    return tuple(dict.fromkeys(out))


@dataclass(frozen=True)
class Rule:
    rule: str
    allow: bool
    pattern: str
    tokens: tuple[str, ...]


def parse(rule: str) -> Rule:
    """The pattern in lower case and the tokens that are whole in each match (bounded by separators or anchors in the rule)."""
    allow, body = rule.startswith("@@"), rule.removeprefix("@@").lower()
    if len(body) > 1 and body.startswith("/") and body.endswith("/"):
        pattern = body[1:-1].replace("\\/", "/")
        re.compile(pattern)
        return Rule(rule, allow, pattern, regex_tokens(pattern))
    host, head, tail = body.startswith("||"), body.startswith("|") and not body.startswith("||"), body.endswith("|")
    core = body.strip("|")
    pattern = "".join(".*" if c == "*" else f"(?:{_SEPARATOR}|$)" if c == "^" else re.escape(c) for c in core)
    pattern = ("^[a-z]+://(?:[^/?#]*[.])?" if host else "^" if head else "") + pattern + ("$" if tail else "")
    tokens = []
    for m in re.finditer("[a-z0-9]+", core):
        left = m.start() > 0 and core[m.start() - 1] != "*" or m.start() == 0 and (host or head)
        right = m.end() < len(core) and core[m.end()] != "*" or m.end() == len(core) and tail
        if left and right:
            tokens.append(m.group())
    return Rule(rule, allow, pattern, tuple(dict.fromkeys(tokens)))


def _tokens(url) -> "F.Column":
    """The tokens of a URL, and the empty one, which the rules without a token stand under."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(url), "[^a-z0-9]+")))


def hits(pages: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """(page_id, url, rule, allow) of each rule that matches each row.

    URLs are compared in lower case. A null URL matches nothing; an empty one what matches the empty text. A null page_id stays null, repeated rows are
    matched each, repeated rules count once, ties between equally rare tokens go to the first in the alphabet. Only page_id
    and url are read. No rules or no rows give no rows.
    """
    parsed = [parse(r) for r in dict.fromkeys(rules)]
    spark = pages.sparkSession
    urls = pages.select("page_id", "url").where("url is not null")
    wanted = sorted({t for r in parsed for t in r.tokens})
    frequency: dict[str, int] = {}
    if wanted:
        terms = spark.createDataFrame([(t,) for t in wanted], "token string")
        terms = F.broadcast(terms) if len(wanted) <= BROADCAST_RULES else terms
        counted = urls.select(F.explode(_tokens(F.col("url"))).alias("token")).join(terms, "token").groupBy("token").count()
        frequency = {r["token"]: r["count"] for r in counted.collect()}  # as many rows as rules have tokens
    keyed = [(min(r.tokens, key=lambda t: (frequency.get(t, 0), t)) if r.tokens else "", r.rule, r.allow, r.pattern) for r in parsed]
    index = spark.createDataFrame(keyed, "token string, rule string, allow boolean, pattern string")
    index = F.broadcast(index) if len(keyed) <= BROADCAST_RULES else index
    found = urls.withColumn("token", F.explode(_tokens(F.col("url")))).join(index, "token")
    return found.where(F.expr("regexp_like(lower(url), pattern)")).select("page_id", "url", "rule", "allow")


def decide(pages: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """(page_id, url, blocked, rules) of each URL that some rule matches; an exception outweighs all blocks.

    rules are the matching ones, sorted and joined by a space. Repeated rows give one result; nulls and empty tables are as in hits().
    """
    matched = hits(pages, rules).groupBy("page_id", "url")
    return matched.agg((~F.max("allow")).alias("blocked"), F.concat_ws(" ", F.array_sort(F.collect_set("rule"))).alias("rules"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _values() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(r.rule)}, {str(r.allow).lower()}, {quote(r.pattern)})" for r in map(parse, RULES))


QUERIES = {"op7_url_filters": op7_url_filters}
#: Every rule's regular expression on every URL.
ORACLE_SQL = {
    "op7_url_filters": f"""
        WITH rules(rule, allow, pattern) AS (VALUES {_values()})
        SELECT page_id, url, NOT bool_or(allow) AS blocked, string_agg(DISTINCT rule, ' ' ORDER BY rule) AS rules
        FROM pages JOIN rules ON regexp_matches(lower(url), pattern) GROUP BY page_id, url""",
}
