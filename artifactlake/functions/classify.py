"""Per-row classification rules as column expressions.

Every rule set is a chain of built-in expressions, so classification stays inside code generation
and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import (
    EXTENSION_MIME,
    MFT_NAMES,
    NOISE_RULES,
    NOISE_RULESET,
    NTFS_FLAGS,
    PERSONAL_MIME_PREFIXES,
    PROTECTED_EXTENSIONS,
    WALLET_NAMES,
    lookup,
)
from .text import path_suffix, present


def no_strings() -> Column:
    return F.array().cast("array<string>")


def has_any(text: Column, *fragments: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(f)) for f in fragments])


def starts_any(text: Column, *prefixes: str) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in prefixes])


def exact_round(x: Column, digits: int = 2) -> Column:
    """Half-even rounding of the exact binary value of a double in [0.01, 2), and of 0.

    Decimal-text rounding differs where a double lies just beside a tie (0.715 is below it).
    """
    one = 1 << 59
    ten = 10**digits
    # through long: a direct cast to decimal goes over the shortest decimal text
    scaled = (x * F.lit(float(one))).cast("long").cast("decimal(20,0)") * F.lit(ten)
    whole = F.floor(scaled / F.lit(one)).cast("decimal(20,0)")
    twice = (scaled - whole * F.lit(one)) * F.lit(2)
    up = (twice > one) | ((twice == one) & (whole % 2 == 1))
    return (whole + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(ten))


# --------------------------------------------------------------------------- content signature

_DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
_XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
_PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"


def _raw(hexed: str) -> Column:
    return F.unhex(F.lit(hexed))


def _ascii(text: str) -> Column:
    return F.lit(text).cast("binary")


def _verdict(signature: str, mime: str, confidence: float) -> Column:
    return F.struct(
        F.lit(signature).alias("signature"),
        F.lit(mime).alias("mime_type"),
        F.lit(confidence).alias("confidence"),
    )


def _magic(b: Column) -> Column:
    n = F.octet_length(b)

    def at(pos: int, size: int) -> Column:
        return F.substring(b, pos + 1, size)

    def begins(*values: Column) -> Column:
        return reduce(lambda x, y: x | y, [F.startswith(b, v) for v in values])

    text = b.cast("string")
    # a mail's head ends at the first blank line
    header = F.lower(F.substring_index(F.substring_index(text, "\n\n", 1), "\n\r\n", 1))
    email = F.contains(header, F.lit("from:")) & F.contains(header, F.lit("\nsubject:"))
    controls = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0b\x0e-\x1f]", ""))
    plain = (
        (n >= 4)
        & ~F.contains(b, _raw("00"))
        & F.is_valid_utf8(text)
        & (controls <= F.greatest(F.lit(1), F.floor(n / 100)))
    )
    # one character a byte; random data shows each value early, so the 256 searches end early
    single = F.decode(b, "ISO-8859-1")
    values = F.array(*[F.lit(bytes([v]).decode("latin-1")) for v in range(256)])
    random = (
        (n >= 512)
        & (F.size(F.filter(values, lambda v: F.contains(single, v))) > 200)
        & (n - F.length(F.replace(single, F.lit("\0"), F.lit(""))) < F.floor(n / 100))
    )
    ftyp = (n >= 12) & (at(4, 4) == _ascii("ftyp"))
    brand = at(8, 4)
    zipped = begins(_raw("504B0304"))
    rules = [
        (n == 0, "empty", "application/x-empty", 1.0),
        (begins(_ascii("MZ")), "pe-executable", "application/x-msdownload", 0.98),
        (begins(_raw("FFD8FF")), "jpeg", "image/jpeg", 0.98),
        (begins(_ascii("%PDF-")), "pdf", "application/pdf", 0.98),
        (begins(_raw("89504E470D0A1A0A")), "png", "image/png", 0.98),
        (begins(_ascii("GIF87a"), _ascii("GIF89a")), "gif", "image/gif", 0.95),
        (begins(_raw("49492A00"), _raw("4D4D002A")), "tiff", "image/tiff", 0.95),
        (begins(_raw("52415700")), "raw", "image/x-dcraw", 0.8),
        (
            ftyp & reduce(lambda x, y: x | y, [brand == _ascii(v) for v in ("heic", "heix", "hevc", "hevx")]),
            "heic",
            "image/heic",
            0.92,
        ),
        (ftyp & (brand == _ascii("qt  ")), "quicktime", "video/quicktime", 0.92),
        (ftyp, "mp4", "video/mp4", 0.9),
        (
            begins(_ascii("ID3"), _raw("FFFB"), _raw("FFF3"), _raw("FFF2")),
            "mp3",
            "audio/mpeg",
            0.9,
        ),
        (begins(_ascii("RIFF")) & (at(8, 4) == _ascii("WAVE")), "wav", "audio/wav", 0.92),
        (zipped & F.contains(b, _ascii("word/")), "docx", _DOCX, 0.92),
        (zipped & F.contains(b, _ascii("xl/")), "xlsx", _XLSX, 0.92),
        (zipped & F.contains(b, _ascii("ppt/")), "pptx", _PPTX, 0.92),
        (zipped, "zip", "application/zip", 0.9),
        (begins(_raw("377ABCAF271C")), "7z", "application/x-7z-compressed", 0.95),
        (begins(_raw("526172211A07")), "rar", "application/vnd.rar", 0.95),
        ((n > 262) & (at(257, 5) == _ascii("ustar")), "tar", "application/x-tar", 0.9),
        (begins(_raw("1F8B")), "gzip", "application/gzip", 0.9),
        (begins(_ascii("{\\rtf")), "rtf", "application/rtf", 0.9),
        (email, "email", "message/rfc822", 0.86),
        (plain, "text", "text/plain", 0.8),
        (random, "random", "application/octet-stream", 0.4),
    ]
    chain = None
    for cond, *verdict in rules:
        chain = F.when(cond, _verdict(*verdict)) if chain is None else chain.when(cond, _verdict(*verdict))
    return chain.otherwise(_verdict("unknown", "application/octet-stream", 0.2))


def content_signature(
    df: DataFrame,
    bytes_col: str,
    name_col: str,
    sample_limit: int | None = None,
    out: str = "signature",
) -> DataFrame:
    """Add a struct with type, MIME type, confidence, extension evidence and sample digest.

    Whole contents are looked at, or the first ``sample_limit`` bytes.
    """
    sample = F.col(bytes_col)
    if sample_limit is not None:
        sample = F.substring(sample, 1, sample_limit)
    work = df.withColumn("__b", F.coalesce(sample, F.lit("").cast("binary"))).withColumn(
        "__m", _magic(F.col("__b"))
    )
    markers = [_ascii("MZ"), _ascii("%PDF-"), _raw("504B0304"), _raw("FFD8FF"), _raw("89504E470D0A1A0A")]
    hits = sum((F.contains("__b", m).cast("int") for m in markers[1:]), F.contains("__b", markers[0]).cast("int"))
    work = work.withColumn("__poly", hits > 1).withColumn(
        "__ext", lookup(EXTENSION_MIME, path_suffix(F.replace(F.col(name_col), F.lit("\\"), F.lit("/"))))
    )
    m = {k: F.col(f"__m.{k}") for k in ("signature", "mime_type", "confidence")}
    ext, poly, b = F.col("__ext"), F.col("__poly"), F.col("__b")
    mismatch = F.coalesce(ext != m["mime_type"], F.lit(False))
    evidence = present(
        (m["signature"] == "empty", "empty_content"),
        (ext.isNotNull(), F.concat(F.lit("extension:"), ext)),
        (mismatch, "extension_mismatch"),
        (poly, "polyglot_signature"),
        (m["signature"] == "unknown", "unknown_magic"),
    )
    safe = ~m["signature"].isin("pe-executable", "unknown", "empty") & ~poly & ~mismatch
    return work.withColumn(
        out,
        F.struct(
            m["signature"].alias("signature"),
            m["mime_type"].alias("mime_type"),
            F.when(poly, F.least(m["confidence"], F.lit(0.65)))
            .otherwise(m["confidence"])
            .alias("confidence"),
            ext.alias("extension_mime"),
            safe.alias("parser_safe"),
            evidence.alias("evidence"),
            F.sha2(b, 256).alias("sample_sha256"),
            F.octet_length(b).alias("sample_size"),
        ),
    ).drop("__b", "__m", "__poly", "__ext")


# --------------------------------------------------------------------------- provenance and noise


def provenance(path: Column, allocated: Column, entry_type: Column, attributes: Column) -> Column:
    """Struct (kind, reason): deleted, trashed, hidden, carved or allocated."""
    low = F.lower(path)
    name = F.element_at(F.split(path, "/"), -1)

    def of(kind: str, reason: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))

    return (
        F.when(~allocated, of("deleted", "not_allocated"))
        .when(has_any(low, ".trash", ".trashes", "$recycle.bin", "found.000"), of("trashed", "trash_path"))
        .when(
            F.startswith(name, F.lit(".")) | F.array_contains(attributes, "hidden"),
            of("hidden", "hidden_attribute_or_dotname"),
        )
        .when(entry_type == "carved", of("carved", "carved_source"))
        .otherwise(of("allocated", "allocated_entry"))
    )


def content_boost(path: Column) -> Column:
    """Struct (boost, reason) for camera folders and portable backups."""
    low = F.lower(path)

    def of(boost: bool, reason: str) -> Column:
        return F.struct(F.lit(boost).alias("boost"), F.lit(reason).alias("reason"))

    return (
        F.when(has_any(low, "/dcim/", "/dcim_", "100ncdng", "dcim/"), of(True, "dcim_camera_content"))
        .when(
            has_any(low, "/backup", "/backups", "backup/", "portable_backup"),
            of(True, "portable_backup_content"),
        )
        .otherwise(of(False, "no_boost"))
    )


def slashed(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def noise_rules(
    df: DataFrame,
    path: str,
    mime: str,
    signature: str,
    profile_id: str,
    rules: Sequence[tuple[str, Sequence[str]]] = NOISE_RULES,
    version: str = NOISE_RULESET,
    out: str = "noise",
) -> DataFrame:
    """Add a struct (ruleset_version, visibility, rule_ids, evidence).

    A path that meets a rule is ``lower``; with personal content it is ``review``. The parts are
    staged as flat columns, so later reads of the struct do not repeat the rules.
    """
    personal = F.coalesce(starts_any(F.col(mime), *PERSONAL_MIME_PREFIXES), F.lit(False)) | (
        F.coalesce(F.col(signature) == "docx", F.lit(False))
    )
    ids, low, own = F.col("__ids"), F.col("__low"), F.col("__own")
    profile = F.col(profile_id)
    return (
        df.withColumn("__low", slashed(F.col(path)))
        .withColumn(
            "__ids", present(*[(has_any(low, *fragments), rule_id) for rule_id, fragments in rules])
        )
        .withColumn("__own", personal)
        .withColumn(
            "__vis",
            F.when((F.size(ids) > 0) & own, "review").when(F.size(ids) > 0, "lower").otherwise("normal"),
        )
        .withColumn(
            "__ev",
            present(
                (profile.isNotNull(), F.concat(F.lit("profile:"), profile)),
                (own, "personal_content_signature"),
                (F.col("__vis") == "review", "noise_rule_conflict"),
            ),
        )
        .withColumn(
            out,
            F.struct(
                F.lit(version).alias("ruleset_version"),
                F.col("__vis").alias("visibility"),
                ids.alias("rule_ids"),
                F.col("__ev").alias("evidence"),
            ),
        )
        .drop("__low", "__ids", "__own", "__vis", "__ev")
    )


# --------------------------------------------------------------------------- interest score

SCORING_VERSION = "interest-score-v1"


def interest_score(
    df: DataFrame,
    path: str,
    signature: str,
    noise: str,
    profile_id: str,
    state: str,
    application: str | None = None,
    version: str | None = None,
    out: str = "score",
) -> DataFrame:
    """Add a struct (interest_score, noise_score, confidence, evidence).

    ``signature`` and ``noise`` are struct columns of the functions above and may be NULL. Rows
    scored under another ``version`` are re-scored with slightly less confidence and a tag.
    """
    sig, mime = F.col(f"{signature}.signature"), F.col(f"{signature}.mime_type")
    known = F.col(signature).isNotNull()
    marks = F.coalesce(F.col(f"{signature}.evidence"), no_strings())
    contra = known & (
        F.array_contains(marks, "extension_mismatch") | F.array_contains(marks, "polyglot_signature")
    )
    staged = df.withColumn("__contra", contra).withColumn(
        "__upath",
        has_any(slashed(F.col(path)), "/documents/", "/desktop/", "/downloads/", "/pictures/"),
    )
    contradictory, user_path = F.col("__contra"), F.col("__upath")
    personal = known & (F.startswith(mime, F.lit("image/")) | (mime == "application/pdf"))
    document = known & ~personal & (sig == "docx")
    archive = known & ~personal & ~document & sig.isin("zip", "random", "unknown")
    profile = F.col(profile_id)
    gone = F.coalesce(F.col(state).isin("deleted", "carved"), F.lit(False))
    visibility = F.col(f"{noise}.visibility")
    lower = F.coalesce(visibility == "lower", F.lit(False))
    review = F.coalesce(visibility == "review", F.lit(False))

    def points(cond: Column, value: int) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), value).otherwise(0)

    interest = (
        F.lit(10)
        + points(personal, 30)
        + points(document, 25)
        + points(archive, 5)
        + points(contradictory, 8)
        + points(user_path, 20)
        + points(profile.isNotNull(), 10)
        + points(gone, 10)
        + points(review, 5)
    )
    noise_points = points(lower, 60) + points(review, 25)
    # added in this order: the exact value decides a rounding tie
    confidence = F.when(
        known, F.lit(0.5) + F.least(F.col(f"{signature}.confidence"), F.lit(1.0)) * 0.25
    ).otherwise(F.lit(0.5) - 0.15)
    confidence = F.when(contradictory, confidence - 0.1).otherwise(confidence)
    confidence = F.when(profile.isNotNull(), confidence + 0.1).otherwise(confidence)
    confidence = F.when(lower, confidence + 0.1).otherwise(confidence)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    app = F.col(application) if application else F.lit(None).cast("string")
    evidence = F.array_distinct(
        F.concat(
            F.array(F.lit(f"scoring_version:{SCORING_VERSION}")),
            present(
                (~known, "missing_signature"),
                (known, F.concat(F.lit("signature:"), sig)),
                (personal, "personal_mime_signal"),
                (document, "document_signal"),
                (contradictory, "contradictory_type_evidence"),
                (user_path, "well_known_user_path"),
                (profile.isNotNull(), F.concat(F.lit("profile:"), profile)),
                (gone, F.concat(F.lit("state:"), F.col(state))),
                (F.coalesce(app, F.lit("")) != "", F.concat(F.lit("application:"), app)),
                (
                    F.col(noise).isNotNull(),
                    F.concat(F.lit("noise_ruleset:"), F.col(f"{noise}.ruleset_version")),
                ),
            ),
            F.when(
                lower, F.transform(F.col(f"{noise}.rule_ids"), lambda r: F.concat(F.lit("noise_rule:"), r))
            ).otherwise(no_strings()),
            F.when(review, F.array(F.lit("noise_conflict_review"))).otherwise(no_strings()),
        )
    )
    old = (
        F.coalesce(F.col(version) != SCORING_VERSION, F.lit(False)) if version else F.lit(False)
    )
    tag = F.concat(F.lit("migrated_from:"), F.col(version)) if version else F.lit("")
    rounded, kept = F.col("__conf"), F.col("__ev")
    return (
        staged.withColumn("__raw", confidence)
        .withColumn("__conf", exact_round(F.col("__raw")))
        .withColumn("__ev", evidence)
        .withColumn("__int", F.greatest(F.lit(0), F.least(F.lit(100), interest)))
        .withColumn("__noi", F.greatest(F.lit(0), F.least(F.lit(100), noise_points)))
        .withColumn(
            "__conf", F.when(old, F.greatest(F.lit(0.0), F.bround(rounded - 0.05, 2))).otherwise(rounded)
        )
        .withColumn("__ev", F.when(old, F.array_append(kept, tag)).otherwise(kept))
        .withColumn(
            out,
            F.struct(
                F.col("__int").alias("interest_score"),
                F.col("__noi").alias("noise_score"),
                rounded.alias("confidence"),
                kept.alias("evidence"),
            ),
        )
        .drop("__contra", "__upath", "__raw", "__conf", "__ev", "__int", "__noi")
    )


# --------------------------------------------------------------------------- categories


def core_categories(
    df: DataFrame,
    path: str,
    signature: str,
    state: str,
    visibility: Column,
    noise_score: Column,
    out: str = "categories",
) -> DataFrame:
    """Add an array of (category, evidence, confidence), sorted by category.

    The reasons are gathered inside the row; explode the array to get one row per category.
    """
    clean = F.lower(F.trim(F.replace(F.col(path), F.lit("\\"), F.lit("/")), F.lit("/")))
    work = df.withColumn("__p", clean).withColumn("__x", path_suffix("__p"))
    p, x = F.col("__p"), F.col("__x")
    sig, mime = F.col(f"{signature}.signature"), F.col(f"{signature}.mime_type")
    known = F.col(signature).isNotNull()
    marks = F.coalesce(F.col(f"{signature}.evidence"), no_strings())
    gone = F.col(state)

    def first(*options: Column) -> Column:
        return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])

    def tagged(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(f"{prefix}:"), value)

    named = F.coalesce(sig, F.lit(""))
    rules: list[tuple[str, Column, Column]] = [
        ("unknown", ~known, F.lit("missing_signature")),
        ("media", known & F.startswith(mime, F.lit("image/")), tagged("mime", mime)),
        (
            "documents",
            known & ((mime == "application/pdf") | (sig == "docx") | x.isin(".txt", ".rtf", ".odt")),
            tagged("document_signal", first(mime, x)),
        ),
        (
            "archives",
            known & ((mime == "application/zip") | (sig == "zip") | x.isin(".7z", ".rar", ".tar", ".gz")),
            tagged("archive_signal", first(sig, x)),
        ),
        ("unknown", known & sig.isin("unknown", "empty"), tagged("signature", sig)),
        (
            "corrupted",
            known
            & (F.array_contains(marks, "polyglot_signature") | F.array_contains(marks, "extension_mismatch")),
            F.lit("contradictory_type_evidence"),
        ),
        (
            "messages/email",
            x.isin(".eml", ".msg", ".mbox", ".pst", ".ost") | has_any(p, "mail", "outlook"),
            tagged("path_or_extension", F.coalesce(first(x), F.lit("mail_path"))),
        ),
        (
            "browser",
            has_any(p, "browser", "chrome/user data", "firefox/profiles", "edge/user data"),
            F.lit("browser_path"),
        ),
        (
            "backups/mobile",
            has_any(p, "backup", "filehistory", "time machine", "mobilebackup")
            | x.isin(".bkf", ".bak", ".vhd", ".vhdx", ".vmdk", ".qcow2", ".ipa", ".ab"),
            tagged("backup_signal", F.coalesce(first(x), F.lit("path"))),
        ),
        (
            "wallets/vaults/keys",
            has_any(p, "wallet", "keystore", "vault", "private key", ".ssh")
            | x.isin(".key", ".pem", ".p12", ".pfx", ".kdbx"),
            tagged("sensitive_artifact_signal", F.coalesce(first(x), F.lit("path"))),
        ),
        (
            "software/code/databases",
            x.isin(
                ".exe", ".dll", ".sys", ".py", ".js", ".ts", ".json", ".db", ".sqlite", ".sqlite3", ".mdb"
            )
            | (named == "pe-executable"),
            tagged("software_code_db_signal", F.coalesce(first(named, x), F.lit(""))),
        ),
        (
            "deleted/carved",
            F.coalesce(gone.isin("deleted", "carved"), F.lit(False)),
            tagged("state", gone),
        ),
        (
            "system/noise",
            F.coalesce(visibility.isin("lower", "review"), F.lit(False)),
            tagged("noise_visibility", visibility),
        ),
        (
            "system/noise",
            ~F.coalesce(visibility.isin("lower", "review"), F.lit(False))
            & F.coalesce(noise_score > 0, F.lit(False)),
            tagged("noise_score", noise_score.cast("string")),
        ),
    ]
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(cond, F.lit(False)),
                    F.struct(F.lit(cat).alias("category"), reason.alias("reason")),
                )
                for cat, cond, reason in rules
            ]
        )
    )
    work = work.withColumn("__hits", hits).withColumn(
        "__hits",
        F.when(
            F.size("__hits") == 0,
            F.array(
                F.struct(F.lit("unknown").alias("category"), F.lit("no_category_signal").alias("reason"))
            ),
        ).otherwise(F.col("__hits")),
    )
    kinds = F.array_sort(F.array_distinct(F.transform("__hits", lambda h: h["category"])))

    def entry(cat: Column) -> Column:
        reasons = F.array_distinct(
            F.transform(F.filter("__hits", lambda h: h["category"] == cat), lambda h: h["reason"])
        )
        return F.struct(
            cat.alias("category"),
            reasons.alias("evidence"),
            F.least(F.lit(0.95), F.round(F.lit(0.55) + F.size(reasons) * 0.1, 2)).alias("confidence"),
        )

    return work.withColumn(out, F.transform(kinds, entry)).drop("__p", "__x", "__hits")


# --------------------------------------------------------------------------- protected artifacts


def protected_kind(
    df: DataFrame, path: str, mime: str, signature: str, meta: str, entropy: str, out: str = "protection"
) -> DataFrame:
    """Add a struct (protected, protection_kind, format_name, confidence, evidence, warnings).

    ``meta`` is a struct with corrupt, unsupported_encryption, encrypted, password_required,
    wallet_family, whole_volume, format, original_name and warnings (all may be NULL).
    """
    low = F.lower(F.col(path))
    x = path_suffix(low)
    m = {
        k: F.col(f"{meta}.{k}")
        for k in (
            "corrupt",
            "unsupported_encryption",
            "encrypted",
            "password_required",
            "wallet_family",
            "whole_volume",
            "format",
            "original_name",
            "warnings",
        )
    }
    kind, sig = F.col(mime), F.col(signature)

    def yes(name: str) -> Column:
        return F.coalesce(m[name], F.lit(False))

    given = F.coalesce(m["warnings"], no_strings())
    fmt = (
        F.when(m["format"].isNotNull(), m["format"])
        .when(kind == "application/pdf", "pdf")
        .when(F.startswith(kind, F.lit("application/vnd.openxmlformats")), "office-openxml")
        .when(F.startswith(kind, F.lit("application/zip")), "zip")
        .when(x != "", F.substr(x, F.lit(2)))
        .otherwise(F.coalesce(F.nullif(sig, F.lit("")), F.lit("unknown")))
    )
    corrupt = yes("corrupt") | F.array_contains(given, "corrupt_header")
    locked = yes("encrypted") | yes("password_required")
    office = F.startswith(kind, F.lit("application/vnd.openxmlformats")) | kind.isin(
        "application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint"
    )
    by_ext = lookup(PROTECTED_EXTENSIONS, x)
    wallet = has_any(low, *WALLET_NAMES) | (F.coalesce(m["wallet_family"], F.lit("")) != "")
    original = path_suffix(F.lower(F.coalesce(m["original_name"], F.col(path))))

    def of(protected: bool, what: Column, conf: float, evidence: Column, extra: str | None) -> Column:
        warn = F.array_append(given, F.lit(extra)) if extra else given
        return F.struct(
            F.lit(protected).alias("protected"),
            what.alias("protection_kind"),
            F.lit(conf).alias("confidence"),
            evidence.alias("evidence"),
            F.array_distinct(warn).alias("warnings"),
        )

    flag = F.array(F.lit("metadata_encrypted_flag"))
    archive = kind.isin("application/zip", "application/x-7z-compressed", "application/vnd.rar")
    result = (
        F.when(corrupt, of(False, F.lit("unknown"), 0.0, no_strings(), "corrupt_protection_header"))
        .when(
            yes("unsupported_encryption"),
            of(False, F.lit("unsupported"), 0.0, no_strings(), "unsupported_encryption_format"),
        )
        .when(locked & archive, of(True, F.lit("encrypted-archive"), 0.95, flag, None))
        .when(locked & (kind == "application/pdf"), of(True, F.lit("encrypted-pdf"), 0.95, flag, None))
        .when(locked & office, of(True, F.lit("encrypted-office-document"), 0.92, flag, None))
        .when(locked, of(True, F.lit("encrypted-artifact"), 0.75, flag, None))
        .when(
            by_ext.isNotNull(),
            of(True, by_ext, 0.82, F.array(F.concat(F.lit("protected_extension:"), x)), None),
        )
        .when(
            wallet,
            of(True, F.lit("wallet-or-keystore"), 0.78, F.array(F.lit("wallet_or_keystore_evidence")), None),
        )
        .when(
            yes("whole_volume"),
            of(
                True,
                F.lit("whole-volume-encryption"),
                0.9,
                F.array(F.lit("whole_volume_encryption_signature")),
                None,
            ),
        )
        .when(
            F.col(entropy) >= 7.5,
            of(False, F.lit("unknown"), 0.2, F.array(F.lit("high_entropy")), "high_entropy_weak_evidence_only"),
        )
        .when(x != original, of(False, F.lit("none"), 0.0, no_strings(), "renamed_format_evidence"))
        .otherwise(of(False, F.lit("none"), 0.0, no_strings(), None))
    )
    return df.withColumn(out, result).withColumn(f"{out}_format", fmt)


# --------------------------------------------------------------------------- filesystem flags


def ntfs_flags(df: DataFrame, facts: str = "facts") -> DataFrame:
    """Attribute and warning arrays of NTFS entries from their metadata struct."""
    f = {
        k: F.col(f"{facts}.{k}")
        for k in (
            *NTFS_FLAGS,
            "reparse_tag",
            "hard_links",
            "dos_name",
            "metadata_file",
            "recycle_bin_original_path",
        )
    }
    name, path = F.col("display_name"), F.replace(F.col("display_path"), F.lit("\\"), F.lit("/"))
    rooted = F.concat(F.lit("/"), path)
    trash = f["recycle_bin_original_path"].isNotNull() | (
        F.contains(rooted, F.lit("/$Recycle.Bin/")) & F.contains(rooted, F.lit("/$R"))
    )
    stream = F.col("alternate_stream").isNotNull()
    links = F.coalesce(F.size(f["hard_links"]) > 0, F.lit(False))
    flags = [(F.coalesce(f[k], F.lit(False)), label) for k, label in NTFS_FLAGS.items()]
    added = present(
        *flags,
        (stream, "ntfs_alternate_data_stream"),
        (links, "ntfs_hard_link"),
        (name.isin(*MFT_NAMES) | F.coalesce(f["metadata_file"], F.lit(False)), "ntfs_metadata_file"),
        (f["dos_name"].isNotNull(), "ntfs_dos_name"),
        (trash, "ntfs_recycle_bin_record"),
    )
    warned = present(
        (links, "host_link_not_followed"),
        (f["reparse_tag"].isNotNull(), "reparse_point_not_followed"),
    )
    return df.withColumn("attributes", F.array_union("attributes", added)).withColumn(
        "warnings", F.array_union("warnings", warned)
    )


def cluster_chain(chain: Column, max_clusters: int | None = None) -> Column:
    """Struct (clusters, status, warning) of a FAT cluster chain, stopped at its first problem."""
    none = F.lit(None).cast("string")
    start = F.struct(
        F.array().cast("array<bigint>").alias("clusters"), none.alias("status"), none.alias("warning")
    )
    # fixed values: end-of-chain and bad-cluster marks
    end = (0x0FFFFFF8, 0x0FFFFFFF, 0xFFFFFFFF)
    bad = (0x0FFFFFF7, 0xFFFFFFF7)

    def stop(s: Column, status: str, warning: str | None) -> Column:
        return F.struct(
            s["clusters"].alias("clusters"),
            F.lit(status).alias("status"),
            F.lit(warning).cast("string").alias("warning"),
        )

    def step(s: Column, c: Column) -> Column:
        return (
            F.when(s["status"].isNotNull(), s)
            .when(c.isin(*end), stop(s, "complete", None))
            .when(c.isin(*bad) | (c < 2), stop(s, "corrupt", "fat_bad_cluster"))
            .when(F.array_contains(s["clusters"], c), stop(s, "corrupt", "fat_cluster_loop_bounded"))
            .when(F.lit(False) if max_clusters is None else F.size(s["clusters"]) >= max_clusters, stop(s, "truncated", "fat_cluster_chain_bounded"))
            .otherwise(
                F.struct(
                    F.array_append(s["clusters"], c).alias("clusters"),
                    s["status"].alias("status"),
                    s["warning"].alias("warning"),
                )
            )
        )

    def finish(s: Column) -> Column:
        open_end = F.when(F.size(s["clusters"]) == 0, "empty").otherwise("complete")
        return F.struct(
            s["clusters"].alias("clusters"),
            F.coalesce(s["status"], open_end).alias("status"),
            s["warning"].alias("warning"),
        )

    return F.aggregate(chain, start, step, finish)


def fat_flags(df: DataFrame, facts: str = "facts", max_clusters: int | None = None) -> DataFrame:
    """Attribute and warning arrays of FAT entries from their metadata struct."""
    chain = cluster_chain(F.coalesce(F.col(f"{facts}.cluster_chain"), F.array().cast("array<bigint>")), max_clusters)
    work = df.withColumn("chain", chain)

    def filled(name: str) -> Column:
        return F.coalesce(F.col(f"{facts}.{name}"), F.lit("")) != ""

    added = present(
        (F.lit(True), F.col(f"{facts}.filesystem")),
        (~F.col("allocated"), "deleted_entry"),
        (filled("long_name") & (F.col(f"{facts}.long_name") != F.col("display_name")), "fat_long_name"),
        (filled("short_name"), "fat_short_name"),
        (filled("volume_label"), "volume_label"),
        (F.col("chain.status") != "empty", F.concat(F.lit("cluster_chain:"), F.col("chain.status"))),
    )
    stamped = F.coalesce(F.col(f"{facts}.has_timestamps"), F.lit(False))
    warned = present(
        (F.col("chain.warning").isNotNull(), F.col("chain.warning")),
        (stamped, "fat_timestamp_timezone_ambiguous"),
    )
    return (
        work.withColumn("attributes", F.array_union("attributes", added))
        .withColumn("warnings", F.array_union("warnings", warned))
        .withColumn(
            "entry_type", F.when(filled("volume_label"), "virtual").otherwise(F.col("entry_type"))
        )
    )


def extraction_state(max_size: int, read_bytes: Column | None = None) -> tuple[Column, Column]:
    """``(extraction, recovery)`` structs (state, reason) of an entry.

    Needs allocated, entry_type, size_bytes and extents. ``read_bytes`` tells how much was read; an
    entry that was read short is partial.
    """
    kind, size = F.col("entry_type"), F.col("size_bytes")
    length = F.aggregate(
        "extents", F.lit(0).cast("long"), lambda a, e: a + F.coalesce(e["length_bytes"], F.lit(0))
    )
    expected = F.coalesce(size, length)
    empty = F.coalesce(F.size("extents"), F.lit(0)) <= 0
    got = read_bytes if read_bytes is not None else expected

    def of(state: str, reason: str | None) -> Column:
        return F.struct(F.lit(state).alias("state"), F.lit(reason).cast("string").alias("reason"))

    content = (
        F.when(F.coalesce(size == 0, F.lit(False)), of("complete", None))
        .when(empty, of("skipped", "metadata_only"))
        .when(expected > max_size, of("skipped", "size_limit_exceeded"))
        .when(got < expected, of("partial", "short_read"))
        .otherwise(of("complete", None))
    )
    file_like = kind.isin("file", "deleted")
    extraction = (
        F.when(~F.col("allocated"), of("skipped", "not_allocated"))
        .when(~file_like, of("skipped", "metadata_only"))
        .otherwise(content)
    )
    recovery = (
        F.when(F.col("allocated"), of("allocated_not_deleted", None))
        .when(~file_like, of("metadata_only", "metadata_only"))
        .when(empty, of("unrecoverable", "missing_extents"))
        .when(content["state"] == "complete", of("intact", None))
        .when(content["state"] == "partial", of("partial", "short_read"))
        .when(content["reason"] == "size_limit_exceeded", of("deferred_size_limit", "size_limit_exceeded"))
        .otherwise(of("unrecoverable", "metadata_only"))
    )
    return extraction, recovery
