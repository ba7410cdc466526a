"""URL filters: pattern rules behind an index of literal tokens, in DataFrame functions only.

Two kinds of rules share one index. Host rules fit a host and its subdomains under a path
prefix, and are fetched by the suffixes of a url's host. Pattern rules are globs, as public filter
lists write them; each is filed under the one of its literal tokens that the fewest urls contain,
and fetched by the tokens of a url. Only fetched rules are tested, the globs as regular expressions;
a glob without a literal token is filed under a key that every url has. Of fitting host rules the
longest decides; else a url is allowed if an exception fits or no glob does, and blocked if one does.

Up to BROADCAST_RULES rules the index is a table of hash slots that goes out with the plan, and each
row looks its keys up there: pages pass through no exchange. (Counting the tokens of rules in the
urls shuffles one row a token and task.) More rules are joined by key; then urls with a fitting
rule are combined by url and joined back.

A null url, or one without '://', has an empty host and path; no host rule fits an empty host, and no
rule a null url. Repeated rows each get their row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read

BROADCAST_RULES = 50_000
#: Rules of a filter list that pass through the driver.
MOST_RULES = 1_000_000


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


@dataclass(frozen=True)
class PatternRule:
    """A glob over the lower-cased url that blocks it, or allows it if it begins with @@.

    * is anything, ^ a separator or the end, || in front the start of a host label, | in front or at the end that of the url.
    """

    glob: str

    @property
    def verdict(self) -> str:
        return "allow" if self.glob.startswith("@@") else "block"

    @property
    def _parts(self) -> tuple[bool, bool, str, bool]:
        """Whether it starts at a host label, whether at the start of the url, the glob between, and whether it stops at the end."""
        body = self.glob.removeprefix("@@")
        label, body = body.startswith("||"), body.removeprefix("||")
        start = not label and body.startswith("|")
        stop = len(body) > start and body.endswith("|")
        return label, start, body[start : len(body) - stop], stop

    @property
    def regex(self) -> str:
        label, start, body, stop = self._parts
        parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}
        begin = r"^[^:/?#]*://(?:[^/?#]*\.)?" if label else "^" if start else ""
        return "(?s)" + begin + "".join(parts.get(c, re.sub(r"([^a-z0-9])", r"\\\1", c)) for c in body) + ("$" if stop else "")

    @property
    def tokens(self) -> list[str]:
        """The tokens that every fitting url contains whole: bounded by a separator or an anchor on both sides."""
        label, start, body, stop = self._parts
        begins = lambda m: body[m.start() - 1] != "*" if m.start() else label or start
        ends = lambda m: body[m.end()] != "*" if m.end() < len(body) else stop
        return sorted({m[0] for m in re.finditer(r"[a-z0-9]+", body) if begins(m) and ends(m)})


def pattern_rules_of(lines: Iterable[str]) -> tuple[PatternRule, ...]:
    """The rules of a public filter list, each once and in order.

    Comments, headers and rules about elements of a page are left out, and so are rules with options (after a $), which say
    what kind of request they are about: a table of urls doesn't hold that.
    """
    globs = (line.strip().lower() for line in lines)
    plain = (g for g in globs if g and g[0] not in "![" and not re.search(r"#[@?$%]*#", g) and "$" not in g and not g.strip("@|*^") == "")
    return tuple(map(PatternRule, dict.fromkeys(plain)))


def load_pattern_rules(spark: SparkSession, path: str) -> tuple[PatternRule, ...]:
    """The rules of the filter lists at path, which may hold at most MOST_RULES lines."""
    lines = [r["value"] for r in spark.read.text(path).limit(MOST_RULES + 1).collect()]
    if len(lines) > MOST_RULES:
        raise ValueError(f"{path} has more than {MOST_RULES} lines")
    return pattern_rules_of(lines)


#: The contract's host rules.
HOST_RULES = (
    HostRule("net", "", "block"),
    HostRule("example.net", "en/", "allow"),
    HostRule("example.com", "de/", "block"),
    HostRule("org", "fr/", "allow"),
)
#: Advertising, gambling, adult, pharmacy and link-farm hosts and paths.
PATTERN_RULES = tuple(
    PatternRule(g)
    for g in (
        "||ads-track.", "||free-bets.", "||casino-win.", "||cheap-pills.", "||spam-farm.", "||adult-x.",
        "||adserver.", "||doubleclick.", "/adserver/", "/banner/*/ad_", "://ads.", ".ads.", "/popunder.", "/casino/", "/poker/", "/porn/", "/xxx/",
    )
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    value = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(value, pattern, 1), upper, upper.lower()), F.regexp_extract(value, pattern, 2)


def _keys(lowered: Column, host: Column) -> Column:
    """What fetches rules: 't:' tokens of the url, 'h:' suffixes of its host, and '*'."""
    tokens = F.transform(F.array_remove(F.array_distinct(F.split(lowered, "[^a-z0-9]+")), ""), lambda t: F.concat(F.lit("t:"), t))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.concat(tokens, F.when(host == "", F.array().cast("array<string>")).otherwise(suffixes), F.array(F.lit("*")))


def _bounded(index: DataFrame, rules: int) -> DataFrame:
    return F.broadcast(index) if rules <= BROADCAST_RULES else index


def index(urls: DataFrame, host_rules: tuple[HostRule, ...], pattern_rules: tuple[PatternRule, ...]) -> DataFrame:
    """(key, host_path, regex, rule, verdict): every rule under one key, globs under their rarest token in urls (url, __keys)."""
    spark = urls.sparkSession
    literal = [(rule.glob, rule.regex, rule.verdict, f"t:{t}") for rule in pattern_rules for t in rule.tokens]
    tokens = spark.createDataFrame(literal, "rule string, regex string, verdict string, key string")
    counts = (
        urls.select(F.explode("__keys").alias("key"))
        .join(_bounded(tokens.select("key").distinct(), len(literal)), "key")
        .groupBy("key")
        .count()
    )
    rarest = tokens.join(_bounded(counts, len(literal)), "key", "left").groupBy("rule", "regex", "verdict").agg(
        F.min_by("key", F.struct(F.coalesce("count", F.lit(0)), "key")).alias("key")
    )
    unfiled = [(rule.glob, rule.regex, rule.verdict, "*") for rule in pattern_rules if not rule.tokens]
    globs = rarest.select("rule", "regex", "verdict", "key").unionByName(spark.createDataFrame(unfiled, "rule string, regex string, verdict string, key string"))
    hosts = spark.createDataFrame(
        [(f"h:{r.host}", f"/{r.path}", r.name, r.verdict) for r in host_rules], "key string, host_path string, rule string, verdict string"
    )
    return hosts.select("key", "host_path", F.lit(None).cast("string").alias("regex"), "rule", "verdict").unionByName(
        globs.select("key", F.lit(None).cast("string").alias("host_path"), "regex", "rule", "verdict")
    )


_RULE = "struct<key:string,host_path:string,regex:string,rule:string,verdict:string>"


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(F.hash(key), F.lit(slots))


def _in_row(keyed: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """keyed (path, __lowered, __keys ...) plus __fits: the rules that fit, looked up in a table of hash slots."""
    slots = 1 << max(4, n_rules.bit_length())
    table: list[list[dict]] = [[] for _ in range(slots)]
    for row in rules.withColumn("slot", _slot(F.col("key"), slots)).collect():  # at most BROADCAST_RULES
        table[row["slot"]].append({c: row[c] for c in ("key", "host_path", "regex", "rule", "verdict")})
    literal = F.from_json(F.lit(json.dumps(table)), f"array<array<{_RULE}>>")  # folded to a constant once
    fetched = F.flatten(F.transform("__keys", lambda key: F.filter(F.get(literal, _slot(key, slots)), lambda rule: rule["key"] == key)))
    return keyed.withColumn(
        "__fits",
        F.filter(fetched, lambda rule: F.when(rule["regex"].isNull(), F.startswith(F.col("path"), rule["host_path"])).otherwise(F.rlike(F.col("__lowered"), rule["regex"]))),
    )


def _by_join(keyed: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by joins on key and then on url."""
    fits = F.coalesce(F.expr("startswith(path, host_path)"), F.expr("__lowered rlike regex"))
    found = keyed.where("url is not null").select("url", "path", "__lowered", F.explode("__keys").alias("key")).join(rules, "key").where(fits)
    each = found.groupBy("url").agg(F.collect_set(F.struct("key", "host_path", "regex", "rule", "verdict")).alias("__fits"))
    return keyed.join(each, "url", "left").withColumn("__fits", F.coalesce("__fits", F.array().cast(f"array<{_RULE}>")))


def judged(
    pages: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES
) -> DataFrame:
    """page_id, url, host, path, rule (of the host rules), verdict, pattern (the first fitting glob or exception, if it decided)."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    keys = F.when(F.col("url").isNull(), F.array().cast("array<string>")).otherwise(_keys(F.col("__lowered"), F.col("host")))
    keyed = rows.withColumn("__lowered", F.lower(F.coalesce("url", F.lit("")))).withColumn("__keys", keys)
    rules, n_rules = index(keyed, host_rules, pattern_rules), len(host_rules) + len(pattern_rules)
    found = _in_row(keyed, rules, n_rules) if n_rules <= BROADCAST_RULES else _by_join(keyed, rules)
    globs = lambda verdict: F.array_min(F.transform(F.filter("__fits", lambda r: r["regex"].isNotNull() & (r["verdict"] == verdict)), lambda r: r["rule"]))
    longest = F.array_max(F.transform(F.filter("__fits", lambda r: r["regex"].isNull()), lambda r: F.struct(F.length(r["rule"]).alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    settled = found.select("page_id", "url", "host", "path", longest.alias("__host_rule"), globs("block").alias("__blocks"), globs("allow").alias("__allows"))
    # an exception decides only where something would block
    pattern = F.when(F.col("__blocks").isNotNull(), F.coalesce("__allows", "__blocks"))
    return settled.select(
        "page_id", "url", "host", "path",
        F.col("__host_rule.rule").alias("rule"),
        F.coalesce("__host_rule.verdict", F.when(F.col("__blocks").isNotNull() & F.col("__allows").isNull(), "block"), F.lit("allow")).alias("verdict"),
        F.when(F.col("__host_rule").isNull(), pattern).alias("pattern"),
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql() -> str:
    """The same verdicts with every rule tested on every url."""
    hosts = " UNION ALL ".join(f"SELECT '{r.host}' AS rh, '/{r.path}' AS rp, '{r.name}' AS rule, '{r.verdict}' AS verdict" for r in HOST_RULES)
    globs = " OR ".join(f"regexp_matches(lowered, '{r.regex}')" for r in PATTERN_RULES)
    return rf"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, lower(coalesce(url, '')) AS lowered,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r AS ({hosts}), m AS (
  SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p, r WHERE (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid
)
SELECT page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m USING (rid)
"""
