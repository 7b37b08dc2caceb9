"""URL facts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: second-level labels that belong to the public suffix of a two-letter country
SECOND_LEVEL = ("co", "com", "edu", "gov", "net", "org")

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _piece(url: Column, index: int) -> Column:
    return F.regexp_extract(url, _PARTS, index)


def registrable_domain(host: Column) -> Column:
    """Registrable part of a host; IP addresses and short hosts stay whole."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    is_ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | F.contains(host, F.lit(":"))
    tail = F.element_at(parts, -1)
    three = (F.length(tail) == 2) & F.element_at(parts, F.lit(-2)).isin(*SECOND_LEVEL)
    return (
        F.when((host == "") | is_ip | (n <= 2), host)
        .when(three, F.concat_ws(".", F.slice(parts, -3, 3)))
        .otherwise(F.concat_ws(".", F.slice(parts, -2, 2)))
    )


def _ascii_host(host: Column) -> Column:
    # the JVM's IDN table is asked only for the rare non-ASCII host
    return F.when(host.rlike(r"^[\x00-\x7f]*$"), host).otherwise(
        F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host), host)
    )


def percent_decoded(text: Column) -> Column:
    """Percent escapes decoded ('+' stays '+'); undecodable text stays as it is."""
    return F.when(
        F.contains(text, F.lit("%")),
        F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text),
    ).otherwise(text)


def percent_encoded(text: Column, safe: str) -> Column:
    """Everything but letters, digits, ``_.-~`` and ``safe`` as percent escapes."""
    allowed = rf"[A-Za-z0-9_.\-~{safe}]"
    plain = text.rlike(rf"^{allowed}*$")
    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    encoded = F.array_join(
        F.transform(
            chars,
            lambda c: F.when(c.rlike(rf"^{allowed}$"), c).otherwise(
                F.regexp_replace(F.hex(c.cast("binary")), "(..)", "%$1")
            ),
        ),
        "",
    )
    return F.when(plain, text).otherwise(encoded)


def normalize_urls(df: DataFrame, url_col: str, out: str = "url_normalization") -> DataFrame:
    """Add a struct of derived URL facts; the original text is kept untouched."""
    url = F.col(url_col)
    authority = F.regexp_replace(_piece(url, 2), r"^.*@", "")
    raw_host = F.lower(F.regexp_replace(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1), r"\.+$", ""))
    bare = F.regexp_replace(raw_host, r"[\[\]]", "")
    port = F.regexp_extract(authority, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    work = df.withColumn(
        "__u",
        F.struct(
            F.lower(_piece(url, 1)).alias("scheme"),
            bare.alias("raw_host"),
            _ascii_host(bare).alias("host"),
            port.alias("port"),
            _piece(url, 3).alias("path"),
            _piece(url, 4).alias("query"),
            _piece(url, 5).alias("fragment"),
        ),
    )
    u = {k: F.col(f"__u.{k}") for k in ("scheme", "raw_host", "host", "port", "path", "query", "fragment")}
    good_port = u["port"].rlike(r"^[0-9]{1,5}$") & (u["port"].try_cast("int") <= 65535)
    number = F.when(good_port, u["port"].cast("int"))
    default = ((u["scheme"] == "http") & (number == 80)) | ((u["scheme"] == "https") & (number == 443))
    host_text = F.when(
        F.contains(u["host"], F.lit(":")), F.concat(F.lit("["), u["host"], F.lit("]"))
    ).otherwise(u["host"])
    netloc = F.when(
        number.isNotNull() & ~F.coalesce(default, F.lit(False)),
        F.concat(host_text, F.lit(":"), number.cast("string")),
    ).otherwise(host_text)
    path = percent_encoded(percent_decoded(u["path"]), r"/%:@")
    query = percent_encoded(percent_decoded(u["query"]), r"=&?/:@+,%")
    origin = F.when((u["scheme"] != "") & (netloc != ""), F.concat(u["scheme"], F.lit("://"), netloc)).otherwise(F.lit(""))
    head = F.when(origin != "", origin).otherwise(
        F.concat(
            F.when(u["scheme"] != "", F.concat(u["scheme"], F.lit(":"))).otherwise(F.lit("")),
            F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(F.lit("")),
        )
    )
    canonical = F.concat(
        head, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    )
    pairs = F.filter(F.split(u["query"], "&"), lambda p: p != "")
    keys = F.transform(
        pairs,
        lambda p: percent_decoded(F.replace(F.element_at(F.split(p, "="), 1), F.lit("+"), F.lit(" "))),
    )
    facts = F.struct(
        F.when(canonical != "", canonical).otherwise(url).alias("canonical_url"),
        F.when(u["fragment"] != "", F.concat(canonical, F.lit("#"), u["fragment"]))
        .otherwise(canonical)
        .alias("display_url"),
        u["scheme"].alias("scheme"),
        u["host"].alias("host"),
        registrable_domain(u["host"]).alias("registrable_domain"),
        origin.alias("origin"),
        keys.alias("query_keys"),
        (u["fragment"] != "").alias("fragment_present"),
        F.array_compact(
            F.array(
                F.when(u["host"] != u["raw_host"], "idn_host_punycode_display"),
                F.when((u["port"] != "") & number.isNull(), "invalid_port"),
                F.when(u["fragment"] != "", "fragment_omitted_from_canonical_url"),
            )
        ).alias("warnings"),
    )
    return work.withColumn(out, facts).drop("__u")


def visit_collapse_key(profile: str, canonical_url: Column, utc: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col(profile), canonical_url, utc)]
    return F.concat(
        F.lit("browser-visit-collapse-"),
        F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32),
    )
