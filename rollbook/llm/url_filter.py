"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names literal tokens that any url it fits must contain.  The rule is indexed under the one of
them that the fewest urls contain; the tokens of a url fetch candidate rules by an equality join, and only
those run their regular expression.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that are lower-cased in a host: A to Z only.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text`` is the rule as written, ``pattern`` runs on ``host + "\\n" + path``.

    ``tokens`` are literal runs of ``[a-z0-9]`` that every fitting url has as whole tokens.  Among fitting
    rules the higher ``rank`` wins, then the longer text, then the smaller one.
    """

    text: str
    pattern: str
    tokens: tuple[str, ...]
    action: str
    rank: int = 0


def site_rule(action: str, text: str) -> Rule:
    """A host and a path, such as ``example.com/en/``: fits the host and its subdomains if the path starts so."""
    host, slash, rest = text.partition("/")
    path = slash + rest
    # What stands after the last slash of the path can go on in a url, so it is no whole token.
    tokens = dict.fromkeys([*_tokens(host), *_tokens(path.rpartition("/")[0])])
    if not tokens:
        raise ValueError(f"the rule {text!r} has no literal token")
    return Rule(text, rf"^(?:[^#]*\.)?{_quoted(host)}#{_quoted(path)}", tuple(tokens), action, rank=1)


def word_rule(action: str, text: str, pattern: str, words: Iterable[str]) -> Rule:
    """A pattern over host and path, with the literal tokens that it needs."""
    return Rule(text, pattern, tuple(words), action)


def _tokens(text: str) -> list[str]:
    return [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in text).split() if t]


def _quoted(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else "\\" + c for c in text)


def host_of(url: F.Column) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: F.Column) -> F.Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: F.Column) -> F.Column:
    place = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")


def judge_urls(pages: DataFrame, rules: list[Rule], otherwise: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``; ``rule`` is null if no site rule fits.

    The verdict is that of the best fitting rule, ``otherwise`` where none fits.  Urls are judged once each,
    so repeated urls (also hot ones) cost one judgement.  A null url, or one without ``://``, has an empty
    host and path and gets the verdict ``otherwise``.  Rows with equal or null ids stay as they are; other
    columns are not read.  No rules or an empty table are fine.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    sites = rows.select("host", "path").distinct()
    words = sites.withColumn("token", F.explode(F.array_distinct(F.filter(_url_tokens(), lambda t: t != ""))))
    listed = spark.createDataFrame(
        [(k, r.text, r.pattern, r.action, r.rank, list(r.tokens)) for k, r in enumerate(rules)],
        "rule_no int, text string, pattern string, action string, rank int, tokens array<string>",
    )
    needed = listed.select("rule_no", F.explode("tokens").alias("token"))
    often = words.join(needed.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        needed.join(often, "token", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
        .select("rule_no", F.col("least.token").alias("token"))
    )
    indexed = listed.join(rarest, "rule_no").select("token", "text", "pattern", "action", "rank")
    fitting = words.join(indexed, "token").where(F.expr("concat(host, '#', path) rlike pattern"))
    best = fitting.groupBy("host", "path").agg(
        F.min(F.struct((-F.col("rank")).alias("r"), (-F.length("text")).alias("l"), "text", "action")).alias("best")
    )
    judged = rows.join(best, ["host", "path"], "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.r") < 0, F.col("best.text")).alias("rule"),
        F.coalesce("best.action", F.lit(otherwise)).alias("verdict"),
    )


def _url_tokens() -> F.Column:
    return F.split(F.concat_ws("/", "host", "path"), "[^A-Za-z0-9]+")
