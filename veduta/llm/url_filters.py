"""URL pattern rules, indexed by their rarest literal token."""

from __future__ import annotations

import json
import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The token of all urls, for rules that hold no literal token of their own.
ANY = "*"
#: More rules than this are joined by shuffle instead of broadcast.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Regular expression on host + path. A host holds no slash, so it ends where path begins.

        An empty host fits every host."""
        if not self.host:
            return rf"^[^/]*{_quoted(self.path) if self.path else '(?=/|$)'}"
        return rf"^(?:[^/]*\.)?{_quoted(self.host)}{_quoted(self.path) if self.path else '(?=/|$)'}"

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every url the rule fits holds whole: host labels, full path segments.

        A rule without any is filed under ANY, which every url has."""
        own = [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in self.path.split("/")[1:-1] if x]
        return own or [ANY]


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z])", r"\\\1", text)


#: Fixed values of the query's rule set.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path of a url; both empty if it is null or has no ``://``."""
    known = F.instr(url, "://") > 0
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)^.*?://", ""), r"(?s)[?#].*$", "")
    host = F.translate(F.substring_index(rest, "/", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.when(F.instr(rest, "/") > 0, F.substring(rest, F.instr(rest, "/"), F.length(rest))).otherwise("")
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct host labels (``h:``) and path segments (``p:``) of a url, and ANY if it has host or path."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.when(F.concat(host, path) != "", F.lit(ANY)).otherwise(F.lit(""))), labels, parts))


_RULES = "array<struct<rule_no: int, rank: int, tokens: array<string>, pattern: string, name: string, verdict: string>>"


def listed_rules(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rules as rows, from one literal. ``rank`` orders them by precedence, the strongest first:
    the longest, then the one of the longer host, then ``block``."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), -len(rules[i].host), rules[i].verdict != "block", rules[i].name))
    rank = {i: k for k, i in enumerate(order)}
    rows = [{"rule_no": i, "rank": rank[i], "tokens": r.tokens, "pattern": r.pattern, "name": r.name, "verdict": r.verdict} for i, r in enumerate(rules)]
    parsed = F.from_json(F.lit(json.dumps(rows)), _RULES)
    return spark.range(1).select(F.explode(parsed).alias("r")).select("r.*")


def rule_index(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: the token it is filed under, pattern, rank.

    The token is the rule's literal token found in the fewest rows of ``urls`` (columns host,
    path), counted over all of them; ties go to the token first in code-point order."""
    listed = listed_rules(urls.sparkSession, rules)
    each = listed.select("*", F.explode("tokens").alias("token"))
    found = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = found.join(_side(each.select("token").distinct(), len(rules)), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    best = each.join(counts, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    return listed.join(_side(best, len(rules)), "rule_no").select(F.col("best.token").alias("token"), "pattern", "rank")


def _side(df: DataFrame, rules: int) -> DataFrame:
    return F.broadcast(df) if rules <= BROADCAST_RULES else df


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule (name of the fitting rule, or null), verdict.

    The tokens of a url fetch the rules filed under them; only those rules' patterns run. Of the
    rules that fit, the longest wins (then the longer host, then ``block``). Where none fits, the
    verdict is ``default``. A null or empty url, or one without ``://``, has empty host and path and
    fits nothing. Repeated rows stay repeated; other columns are ignored."""
    host, path = host_and_path(F.col(f"`{url}`"))
    urls = pages.select(F.col(f"`{key}`").alias("page_id"), host.alias("host"), path.alias("path"))
    index = rule_index(urls, rules)
    rows = urls.withColumn("_row", F.monotonically_increasing_id()).withColumn("token", F.explode(url_tokens(F.col("host"), F.col("path"))))
    fits = (rows["token"] == index["token"]) & F.expr("concat(host, path) rlike pattern")
    candidates = rows.join(_side(index, len(rules)), fits, "left")
    # All rows of one url stand together in one task, so the partial aggregate sends one row a url.
    judged = candidates.groupBy("_row", "page_id", "host", "path").agg(F.min("rank").alias("rank"))
    names = listed_rules(pages.sparkSession, rules).select(F.col("rank").alias("_rank"), F.col("name").alias("rule"), "verdict")
    named = judged.join(_side(names, len(rules)), F.col("rank") == F.col("_rank"), "left")
    return named.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
