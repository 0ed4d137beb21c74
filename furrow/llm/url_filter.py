"""URL filter: pattern rules indexed by their rarest literal token.

Each rule is a regular expression with the literal tokens that every URL it fits must contain. How many URLs hold
each of these tokens is counted over the whole table, and a rule is filed under its rarest one. A URL's own tokens
then fetch the candidate rules, and only those run their expressions. All of it is column expressions and joins. A
short index is a constant of the plan, so that judging a URL moves no rows; a longer one is a table that the URLs'
tokens are joined with, since a map in a plan is searched entry by entry.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import common as C
from furrow.session import BROADCAST_BYTES, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Up to so many rules are part of the plan that goes to each task; more are a table.
IN_PLAN = 64
# Parts that the URLs of one token are dealt to where that table is too large to go to each task.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """Fits URLs of ``host`` and all its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over host and path joined: a host holds no slash, and a path starts with one unless it is empty."""
        # not re.escape: Java and Python agree on a backslash before what is neither letter nor digit
        escaped = re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", self.name)
        return rf"^(?:[^/]*\.)?{escaped}" + ("" if self.path else "(?:/|$)")

    @property
    def tokens(self) -> list[str]:
        """Tokens that stand whole in each URL that fits; the last one may be the start of a longer one."""
        found = re.split("[^a-z0-9]+", self.name.lower())
        open_end = self.path and re.search("[A-Za-z0-9]$", self.path)
        return sorted({t for t in (found[:-1] if open_end else found) if t})


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.split(F.translate(place, UPPER, LOWER), "[^a-z0-9]+"))


def rarest(pages: DataFrame, rules: Sequence[Rule], place: Column) -> dict[Rule, str | None]:
    """The token of each rule that the fewest URLs hold, ties to the first by alphabet; None if it has none."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = dict.fromkeys(wanted, 0)
    if wanted:
        held = F.array_intersect(_tokens(place), F.array(*[F.lit(t) for t in wanted]))
        found = pages.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("urls"))
        counts |= {r["token"]: r["urls"] for r in found.collect()}  # one row per token of the rules
    return {r: min(r.tokens, key=lambda t: (counts[t], t), default=None) for r in rules}


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row: the longest rule that fits and its verdict, else null and
    ``default``; of rules of one length the first by alphabet counts, and of rules with one name the last given.

    A null URL, or one without ``://``, has an empty host and path and fits no rule with a host. Repeated rows are
    judged each, those without an id too. An empty table gives no rows, and without rules each row gets the default.
    Other columns are not read. Any number of rules will do.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if not rules:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    ordered = sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name]))
    best = judged_in_plan(judged, ordered) if len(ordered) <= IN_PLAN else judged_by_join(judged, ordered)
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judged_in_plan(judged: DataFrame, ordered: Sequence[Rule]) -> DataFrame:
    """``judged`` with the last rule of ``ordered`` that fits, as a struct ``best``; the index is a constant map."""
    place = F.concat("host", "path")
    filed: dict[str | None, list[Column]] = {}
    token = rarest(judged, ordered, place)
    for order, rule in enumerate(ordered):
        entry = F.struct(
            F.lit(order).alias("order"), F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"), F.lit(rule.pattern).alias("pattern")
        )
        filed.setdefault(token[rule], []).append(entry)
    kind = "array<struct<order:int,rule:string,verdict:string,pattern:string>>"
    always = F.array(*filed.pop(None, [])).cast(kind)
    candidates = always
    if filed:
        index = F.create_map(*[c for t, entries in filed.items() for c in (F.lit(t), F.array(*entries))])
        fetched = F.transform(_tokens(place), lambda t: F.coalesce(F.try_element_at(index, t), F.array().cast(kind)))
        candidates = F.concat(always, F.flatten(fetched))
    fitting = F.filter(candidates, lambda r: F.rlike(place, r["pattern"]))
    return judged.withColumn("best", F.array_max(fitting))


def rule_index(held: DataFrame, ordered: Sequence[Rule]) -> DataFrame:
    """``token, order, rule, verdict, pattern``: each rule under the one of its tokens that the fewest URLs hold, ties
    to the first by alphabet; a rule without tokens is filed under the empty one, which every URL holds."""
    spark = held.sparkSession
    rows = [(k, r.name, r.verdict, r.pattern, r.tokens or [""]) for k, r in enumerate(ordered)]
    rules = spark.createDataFrame(rows, "order int, rule string, verdict string, pattern string, tokens array<string>")
    asked = rules.select("order", F.explode("tokens").alias("token"))
    counts = held.groupBy("token").agg(F.count("*").alias("urls"))
    found = asked.join(counts, "token", "left").groupBy("order").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("least"))
    return rules.join(found, "order").select(F.col("least.token").alias("token"), "order", "rule", "verdict", "pattern")


def judged_by_join(judged: DataFrame, ordered: Sequence[Rule]) -> DataFrame:
    """The same by a join of tokens. Rows get numbers in a table written once, so that equal rows stay apart and no
    host, URL or id becomes a group. An index of up to ``BROADCAST_BYTES`` goes to each task; for a larger one the
    URLs of a token are dealt to ``SALTS`` parts, each of which meets a copy of the token's rules."""
    rows = stored(judged.withColumn("row", F.monotonically_increasing_id()))
    place = F.concat("host", "path")
    held = rows.select("row", place.alias("place"), F.explode(F.array_union(_tokens(place), F.array(F.lit("")))).alias("token"))
    index = stored(rule_index(held, ordered))
    size = sum(len(f"{r.name}{r.verdict}{r.pattern}".encode()) + max((len(t) for t in r.tokens), default=0) + 100 for r in ordered)
    if size <= BROADCAST_BYTES:
        met = held.join(F.broadcast(index), "token")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = held.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"])
    fitting = met.where(F.rlike("place", F.col("pattern")))
    best = fitting.groupBy("row").agg(F.max(F.struct("order", "rule", "verdict")).alias("best"))
    return rows.join(best, "row", "left")


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """The four rules on every page; URLs that no rule fits are allowed."""
    return filter_urls(C.table(spark, sf_dir, "pages"), RULES)


OP4_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), judged AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
