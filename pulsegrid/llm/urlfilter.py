"""URL rules found by their rarest literal token (DataFrame functions only).

A rule is a host and a path, in which ``*`` stands for any run of characters.  It fits a url whose host is the rule's or a
subdomain of it and whose path starts with the rule's.  Tokens are runs of ASCII letters and digits, those of hosts and of paths apart.
A token of a rule that is closed on both sides by literal text must be a token of every url that the rule fits, so each rule is
indexed by the one of these that the fewest urls have; a rule without such a token is indexed by a token that all urls have.
A url's tokens fetch the rules indexed by them, and only those rules' regular expressions run on it.

One scan counts the urls with each token of a rule.  A second one joins each url's tokens with the index and keeps its longest
rule: rows are combined in the task that read them, so one short row for each page is shuffled and no markup is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY = "."  # the token of all urls
TOKEN = re.compile("[A-Za-z0-9]+")
RULE = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("host_size", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("rule", "says", "pattern")]])
INDEX = T.StructType([T.StructField("token", T.StringType()), T.StructField("rules", T.ArrayType(RULE))])


@dataclass(frozen=True)
class Rule:
    """``host`` in lower case, without ``*``; ``path`` empty or from ``/``; ``says`` is ``allow`` or ``block``."""

    says: str
    host: str
    path: str = ""

    @staticmethod
    def parse(says: str, text: str) -> Rule:
        """From ``host/path`` as one text."""
        host, slash, path = text.partition("/")
        return Rule(says, host.translate(str.maketrans(UPPER, LOWER)), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """A regular expression on host and path, one after the other."""
        quoted = lambda s: re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)
        path = "[\\s\\S]*".join(map(quoted, self.path.split("*"))) if self.path else "(?:/|\\z)"
        return "\\A" + (f"(?:[^/]*\\.)?{quoted(self.host)}" if self.host else "[^/]*") + path

    @property
    def tokens(self) -> list[str]:
        """Tokens of every url that the rule fits: those of its host, and of its path those that no ``*`` and not the path's open end touch."""
        path = [("/" + m.group(), self.path[m.end() : m.end() + 1], self.path[m.start() - 1 : m.start()]) for m in TOKEN.finditer(self.path)]
        return sorted({"." + t for t in TOKEN.findall(self.host)} | {t for t, after, before in path if after not in ("", "*") and before != "*"})


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty where the url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    """A url's distinct tokens, EVERY among them."""
    found = lambda c, tag: F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)")), lambda t: F.concat(F.lit(tag), t))
    return F.array_distinct(F.concat(F.array(F.lit(EVERY)), found(host, "."), found(path, "/")))


def index(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, rules): each rule under the rarest of its tokens among ``urls`` (host, path), ties to the first in order.

    Only tokens that some rule has are counted; the counts are one row for each of those.
    """
    spark = urls.sparkSession
    wanted, counts = sorted({t for r in rules for t in r.tokens}), {}
    if wanted:
        names = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "token string"))  # bounded by the list of rules
        seen = urls.select(F.explode(tokens(F.col("host"), F.col("path"))).alias("token")).join(names, "token").groupBy("token").count()
        counts = {r["token"]: r["count"] for r in seen.collect()}
    by: dict[str, list] = {}
    for r in dict.fromkeys(rules):
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=EVERY)
        by.setdefault(token, []).append((len(r.text), len(r.host), r.text, r.says, r.pattern))
    return spark.createDataFrame(list(by.items()), INDEX)


def judge(pages: DataFrame, rules: list[Rule], otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The longest rule that fits wins; of equal length the one with the longer host, then the last in the order of their texts, then
    ``block``.  Where none fits, rule is null and the verdict is ``otherwise``.  A null url, and one without ``://``, has empty host
    and path, as has an empty one.  Null ids are kept; repeated rows come out as often as they are there; an empty table
    gives no rows; other columns are ignored.  The list of rules is the driver's, and its index is broadcast.
    """
    host, path = parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = urls.select("*", F.posexplode(tokens(F.col("host"), F.col("path"))).alias("k", "token"))
    fits = F.filter("rules", lambda r: F.rlike(F.concat("host", "path"), r["pattern"]))
    met = rows.join(F.broadcast(index(urls, rules)), "token", "left").withColumn("best", F.array_max(fits))
    out = met.groupBy("page_id", "host", "path").agg(F.max("best").alias("best"), F.count_if(F.col("k") == 0).alias("copies"))
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit(otherwise)).alias("verdict"))
