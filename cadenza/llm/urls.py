"""URL filters: pattern rules indexed by their rarest literal token. DataFrame operations only.

Every pattern rule names literals that a matching URL must hold, as a token or inside one
(``sessid`` is in ``phpsessid``). The tokens of all URLs are counted and the distinct ones
searched for the literals, each rule is filed under its rarest literal, and a URL fetches the
rules filed under what its own tokens hold; only those run their regular expression. Rules
without a literal run on every distinct URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

#: (host, path, verdict): holds for the host and its subdomains where the path starts so. Fixed by the task.
SITE_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: (rule, pattern, literals that every match holds in its tokens, verdict, priority). Patterns see the URL in lower case.
PATTERN_RULES = [
    ("casino hosts", r"://([^/?#]*\.)?casino-[a-z0-9-]+\.", ["casino"], "block", 3),
    ("pills hosts", r"://([^/?#]*\.)?[a-z0-9-]*cheap-pills\.", ["cheap", "pills"], "block", 3),
    ("spam farms", r"://([^/?#]*\.)?spam-farm\.", ["spam", "farm"], "block", 3),
    ("adult hosts", r"://([^/?#]*\.)?(www-)?xxx-[a-z0-9-]+\.", ["xxx"], "block", 3),
    ("poker hosts", r"://([^/?#]*\.)?[a-z0-9-]*-poker-?[a-z0-9-]*\.", ["poker"], "block", 3),
    ("torrent files", r"\.torrent([?#]|$)", ["torrent"], "block", 2),
    ("programs", r"/[^?#]*\.exe([?#]|$)", ["exe"], "block", 2),
    ("log-in pages", r"://[^/?#]+/([^?#]*/)?login(\.[a-z]+)?/?([?#]|$)", ["login"], "block", 2),
    ("carts", r"://[^/?#]+/([^?#]*/)?cart/?([?#]|$)", ["cart"], "block", 2),
    ("session ids", r"[?&](php)?sessid=", ["sessid"], "block", 2),
    ("old listings", r"[?&]page=[0-9]{4,}(&|#|$)", ["page"], "block", 1),
]
DEFAULT = "allow"


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, null if none does."""
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        choice = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(choice)
    return choice


def rule_table(spark, rules: list[tuple] = PATTERN_RULES) -> DataFrame:
    """``pattern_rule, pattern, tokens, pattern_verdict, priority``: the rules as a table."""
    return spark.createDataFrame(rules, "pattern_rule string, pattern string, tokens array<string>, pattern_verdict string, priority int")


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda x: x != ""))


def _literals(rules: DataFrame) -> DataFrame:
    """``pattern_rule, literal``: what a token can hold; other literals say nothing about tokens."""
    return rules.select("pattern_rule", F.explode("tokens").alias("literal")).filter(F.col("literal").rlike("^[a-z0-9]+$"))


def held_literals(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``token, literal, n``: the tokens of ``urls (url)`` in which a literal of ``rules`` lies, and how many rows hold the token."""
    literals = _literals(rules).select("literal").distinct()
    sizes = sorted(r[0] for r in literals.select(F.length("literal")).distinct().collect())  # at most as many as the longest literal has letters
    seen = urls.select(F.explode(tokens_of(F.col("url"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))  # combined before any shuffle
    cuts = [F.expr(f"CASE WHEN length(token) >= {k} THEN transform(sequence(1, length(token) - {k - 1}), i -> substring(token, i, {k})) ELSE array() END") for k in sizes]
    parts = F.array_distinct(F.concat(*cuts)) if cuts else F.array().cast("array<string>")
    return seen.select("token", "n", F.explode(parts).alias("literal")).join(literals, "literal").select("token", "literal", "n")


def rarest_token_index(urls: DataFrame, rules: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``rules`` with ``token``, the literal that the fewest tokens of ``urls (url)`` hold; ties by name, null for a rule without one.

    ``held`` is the table of :func:`held_literals`, if it is there already."""
    seen = (held_literals(urls, rules) if held is None else held).groupBy("literal").agg(F.sum("n").alias("n"))
    rarest = _literals(rules).join(seen, "literal", "left").groupBy("pattern_rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "literal")).alias("r"))
    return rules.join(rarest.select("pattern_rule", F.col("r.literal").alias("token")), "pattern_rule", "left")


def filter_urls(pages: DataFrame, rules: DataFrame, site_rules: list[tuple[str, str, str]] = SITE_RULES, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern_rule``: one row per row of ``pages (page_id, url)``.

    ``rules`` has the columns of :func:`rule_table` and any number of rows; whether it is
    broadcast is left to its measured size. A site rule that fits decides; else the pattern
    rule of highest priority (ties by name) does, else ``default``.

    A null url and one without ``://`` have empty host and path and fit no site rule. Rows
    that repeat page and url each get their row; null page ids are judged like others. An
    empty table gives an empty result; other columns are ignored.
    """
    pages = pages.select("page_id", "url")
    held = stage(held_literals(pages, rules), "held-literals")
    # written, so that their sizes are known before they are joined
    index = stage(rarest_token_index(pages, rules, held), "rule-index")
    filed = held.select("token", "literal").join(index.withColumnRenamed("token", "literal"), "literal").drop("literal", "tokens")
    # a rule without a literal is filed under the empty token, which every URL then has
    filed = stage(filed.unionByName(index.filter("token IS NULL").withColumn("token", F.lit("")).drop("tokens")), "rules-by-token")
    every = F.array(F.lit("")) if filed.filter("token = ''").head(1) else F.array().cast("array<string>")
    # equal URLs are judged once; rules fetched by their tokens are the only ones that run
    texts = pages.select("url").filter("url IS NOT NULL").distinct()
    fetched = texts.select("url", F.explode(F.concat(tokens_of(F.col("url")), every)).alias("token")).join(filed, "token").drop("token")
    matched = fetched.filter(F.expr("lower(url) RLIKE pattern"))
    best = matched.groupBy("url").agg(F.max_by(F.struct("pattern_rule", "pattern_verdict"), F.struct("priority", "pattern_rule")).alias("p"))
    judged = pages.join(best, "url", "left").withColumn("host", host_of()).withColumn("path", path_of())
    site = site_rule(F.col("host"), F.col("path"), site_rules)
    return judged.withColumn("s", site).select(
        "page_id", "host", "path", F.col("s.rule").alias("rule"), F.coalesce("s.verdict", "p.pattern_verdict", F.lit(default)).alias("verdict"), F.col("p.pattern_rule").alias("pattern_rule")
    )
