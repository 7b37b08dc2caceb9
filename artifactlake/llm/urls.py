"""URL filters by host-suffix and path-prefix expressions.

Every URL is expanded into the expressions that could be a rule for it: its host suffixes on label
borders, with its path prefixes, of the lengths that rules have. Expressions meet the rules in an
equi-join on a short prefix of their SHA-256; the full digests then confirm, and the most specific rule
decides. The rule table is broadcast only where Spark finds it small enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())]
)
#: hex digits of the digest that the join uses
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both empty for a null URL or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    bare = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)([^?#]*)", 0)
    host = F.translate(F.regexp_extract(bare, r"^[^/]*", 0), UPPER, LOWER)
    path = F.regexp_extract(bare, r"^[^/]*([\s\S]*)$", 1)
    return urls.withColumn("host", host).withColumn("path", path)


def judge(urls: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (host followed by path, null without a match) and ``verdict``.

    A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the
    rule's path. The longest rule wins, then the longer host, then ``block``. Without a fitting rule the
    verdict is ``default``. Columns of ``urls`` with these names are replaced; repeated rows stay.
    """
    spark = urls.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], RULE)
    expression = F.concat("host", F.lit("\u0000"), "path")
    table = rules.where("host IS NOT NULL AND host <> '' AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.sha2(expression, 256).alias("r_digest"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("r_verdict"),
        F.length("host").alias("r_host"),
        F.length("path").alias("r_path"),
    )
    # lengths that occur: at most as many as a rule has characters
    shapes = table.agg(F.collect_set(F.struct("r_host", "r_path")).alias("s"))
    shapes = [tuple(x) for x in shapes.first()["s"]]
    kinds = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in sorted(shapes)])
    parts = split_url(urls.drop("host", "path", "rule", "verdict"), url)
    rows = parts.withColumn("__row", F.monotonically_increasing_id())
    if not shapes:
        return rows.drop("__row").withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    n_host, n_path = F.length("host"), F.length("path")

    def fits(k):
        border = (n_host == k["h"]) | (F.substr("host", n_host - k["h"], F.lit(1)) == ".")
        return (k["h"] <= n_host) & (k["p"] <= n_path) & border

    def digest(k):
        suffix = F.substr("host", n_host - k["h"] + 1, k["h"])
        return F.sha2(F.concat(suffix, F.lit("\u0000"), F.substr("path", F.lit(1), k["p"])), 256)

    digests = F.transform(F.filter(kinds, fits), digest)
    # one lineage from the row to its verdict: the row number never has to agree between two reads
    spread = rows.select("__row", F.struct(*parts.columns).alias("row"), F.explode_outer(digests).alias("digest"))
    met = spread.withColumn("short", F.substr("digest", F.lit(1), F.lit(SHORT))).join(
        table.withColumn("short", F.substr("r_digest", F.lit(1), F.lit(SHORT))), "short", "left"
    )
    sure = F.col("digest") == F.col("r_digest")
    rank = F.struct(F.col("r_host") + F.col("r_path"), F.col("r_host"), F.col("r_verdict") == "block", "rule")
    best = F.max_by(F.when(sure, F.struct("rule", "r_verdict")), F.when(sure, rank))
    named = met.groupBy("__row").agg(F.first("row").alias("row"), best.alias("best"))
    return named.select(
        *[F.col("row")[c].alias(c) for c in parts.columns],
        F.col("best.rule").alias("rule"),
        F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"),
    )
