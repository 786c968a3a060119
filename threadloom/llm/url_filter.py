"""URL filters: rules are compiled to patterns and indexed by their rarest literal token.

A URL's tokens fetch candidate rules from the index, and only those candidates run their regular expression.
A rule is a host and a path prefix: it fits the host and all its subdomains if the path starts with its path.
The longest fitting rule decides (ties: the smaller rule string); a URL that no rule fits is allowed.

Edge cases: a null URL or one without ``://`` has empty host and path and fits no rule; repeated rows each get
their verdict; an empty table gives an empty result; other columns are carried, those named like an added one
are replaced. A URL of any length takes time in proportion to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Tokens are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. Besides, a host's last label
#: with a dot before it is one, so that every rule has a token that not every URL has.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many rules are looked up in a literal in the plan; more are joined by token.
INLINE = 64
#: A joined rule index of up to so many rules is broadcast (patterns are short: well below 100 MB); a larger one is shuffled.
BROADCAST = 200_000
ADDED = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """For host and path put together: the host holds no slash, and a path is empty or begins with one."""
        quoted = "".join("\\" + c if re.match(r"[^\w/]", c, re.ASCII) and ord(c) < 128 else c for c in self.name)
        return r"^(?:[^/]*\.)?" + quoted + ("" if self.path else r"(?:/|\z)")

    @property
    def tokens(self) -> list[str]:
        """Tokens that any URL it fits has whole: the path's last may go on in the URL, so it isn't one of them."""
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in self.name) + ("" if self.path else "/")
        return sorted({*re.findall(TOKEN + r"(?=[\x00-\x2F\x3A-\x60\x7B-\x7F])", lowered), "." + self.host.rpartition(".")[2]})


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), shared.UPPER, shared.UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, with its host's last label."""
    found = F.regexp_extract_all(shared.ascii_lower(F.concat(host, path)), F.lit(TOKEN), F.lit(0))
    return F.array_distinct(F.concat(found, F.array(F.concat(F.lit("."), F.substring_index(host, ".", -1)))))


def rarest_tokens(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[Rule, str]:
    """Each rule's indexed token: of its whole tokens that which the fewest of all URLs hold.

    ``urls`` has host and path. Only counts of tokens that rules hold reach the driver, which has the rules too.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    held = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    seen = urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    if len(rules) <= INLINE:
        seen = seen.where(F.col("token").isin(wanted))
    else:
        seen = seen.join(F.broadcast(held) if len(wanted) <= BROADCAST else held, "token", "left_semi")
    counts = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), t)) for r in rules}


def _best(found: Column) -> Column:
    """Longest rule of an array of structs (size, name, verdict); ties to the smaller name."""
    ordered = F.array_sort(found, lambda a, b: F.when(a["size"] != b["size"], b["size"] - a["size"]).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return F.get(ordered, F.lit(0))


def _judge_inline(urls: DataFrame, index: dict[Rule, str]) -> DataFrame:
    """No shuffle: each rule is fetched by its token, and its pattern, compiled once, runs only where that is there."""
    subject = F.concat("host", "path")
    as_struct = lambda r: F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
    read = urls.withColumn("__tokens", _tokens(F.col("host"), F.col("path")))
    fitting = [F.when(F.array_contains("__tokens", token) & subject.rlike(r.pattern), as_struct(r)) for r, token in index.items()]
    best = _best(F.filter(F.array(*fitting), lambda r: r.isNotNull())) if fitting else F.lit(None).cast("struct<size:int,name:string,verdict:string>")
    return read.withColumn("__best", best)


def _judge_joined(urls: DataFrame, index: dict[Rule, str]) -> DataFrame:
    """Many rules: each distinct (host, path) is judged once by a join on tokens; AQE splits a hot pair when verdicts return."""
    spark = urls.sparkSession
    rules = spark.createDataFrame([(t, len(r.name), r.name, r.verdict, r.pattern) for r, t in index.items()], "token string, size int, name string, verdict string, pattern string")
    rules = F.broadcast(rules) if len(index) <= BROADCAST else rules
    distinct = urls.select("host", "path").distinct()
    tokens = distinct.select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    fitting = tokens.join(rules, "token").where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    best = fitting.groupBy("host", "path").agg(F.min(F.struct((-F.col("size")).alias("size"), "name", "verdict")).alias("__best"))
    return urls.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", default: str = "allow", inline: int = INLINE) -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages``."""
    others = [c for c in pages.columns if c not in ADDED]
    host, path = split_url(F.col(url))
    urls = pages.select(*others, host.alias("host"), path.alias("path"))
    index = rarest_tokens(urls, tuple(rules))
    judged = _judge_inline(urls, index) if len(rules) <= inline else _judge_joined(urls, index)
    return judged.select(*others, "host", "path", F.col("__best.name").alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"))


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = shared.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
