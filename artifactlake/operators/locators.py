"""Locators: find sensitive files, backups, profiles, software and lost volumes in entry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import has_any, no_strings
from ..functions.rules import CHROMIUM_FILES, FIREFOX_FILES, PROFILE_DIRS, SECRET_MARKERS
from ..functions.text import path_suffix, present, stable_id
from .grouped import keep_where
from .graphs import ancestors, on_ancestors, owner_by_prefix
from .joins import enrich_by_path, inside_any, path_key
from .windows import schedule_cap


def _with_owner(entries: DataFrame, roots: DataFrame | None, match_volume: bool = False) -> DataFrame:
    if roots is None:
        return entries.withColumn("profile_id", F.lit(None).cast("string"))
    owners = owner_by_prefix(entries, roots, match_volume).withColumnRenamed("owner_id", "profile_id")
    return entries.join(owners, "entry_id", "left")


def _true(text: Column) -> Column:
    """True / False of a loose flag text, NULL where it is missing."""
    return F.lower(F.trim(text)).isin("true", "1", "yes")


def _gone() -> Column:
    return (F.col("entry_type") == "deleted") | ~F.col("allocated")


def locate_sensitive(
    entries: DataFrame, metadata: DataFrame, categories: DataFrame, roots: DataFrame | None = None
) -> DataFrame:
    """Wallets, keys, vaults and recovery material with evidence; secret values never appear.

    ``metadata`` and ``categories`` are path lookups (path, ord, value) as in ``enrich_by_path``: a
    struct (indicators, encrypted) and an array of category names. Decoys are returned with the type
    ``decoy`` and a warning only.
    """
    work = enrich_by_path(entries, {"__meta": metadata, "__cats": categories})
    work = work.withColumn("__p", path_key("display_path")).withColumn("__x", path_suffix("__p"))
    p, x = F.col("__p"), F.col("__x")
    marks = F.coalesce(F.col("__meta.indicators"), no_strings())
    has = lambda name: F.array_contains(marks, name)
    browser = has_any(p, "browser", "chrome/user data", "firefox/profiles")
    decoy = has_any(p, "fake wallet", "not a wallet", "sample wallet prose")
    kind = (
        F.when(decoy, "decoy")
        .when(has_any(p, "bitcoin/wallets", "bitcoin/blocks") & F.contains(p, F.lit("wallet.dat")), "wallet")
        .when(has_any(p, "electrum/wallets") | has("electrum_wallet"), "wallet")
        .when((x == ".json") & has("web3_keystore") & has("crypto_kdf"), "keystore")
        .when(browser & has("browser_vault"), "browser_vault")
        .when(x.isin(".key", ".pem") | has_any(p, ".ssh/id_rsa", ".ssh/id_ed25519"), "private_key")
        .when(x.isin(".p12", ".pfx", ".cer", ".crt"), "certificate")
        .when((x == ".kdbx") | has("password_vault"), "password_vault")
        .when(has("bip39_mnemonic_shape") | has("seed_phrase_shape"), "recovery_material")
        .when(has_any(p, "wallet", "keystore", "vault"), "weak_name_match")
    )
    work = work.withColumn("artifact_type", kind).where("artifact_type IS NOT NULL")
    work = _with_owner(work, roots)
    kind = F.col("artifact_type")
    encrypted = _true(F.col("__meta.encrypted"))
    shown = F.when(encrypted, F.lit("encrypted:True")).when(~encrypted, F.lit("encrypted:False"))
    shaped = lambda t: t.isin("bip39_mnemonic_shape", "seed_phrase_shape")
    evidence = F.array_distinct(
        F.concat(
            present(
                (F.coalesce(F.array_contains("__cats", "wallets/vaults/keys"), F.lit(False)), "category:wallets/vaults/keys"),
                (F.lit(True), F.concat(F.lit("artifact_type:"), kind)),
                (x != "", F.concat(F.lit("extension:"), x)),
                (has_any(p, "bitcoin"), "path:bitcoin"),
                (has_any(p, "electrum"), "path:electrum"),
                (browser, "path:browser_profile"),
            ),
            F.transform(
                marks,
                lambda t: F.when(shaped(t), F.lit("validated_recovery_indicator")).otherwise(
                    F.concat(F.lit("indicator:"), t)
                ),
            ),
            F.array_compact(F.array(shown)),
        )
    )
    work = work.withColumn("__e", evidence)
    score = F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.lit(0.55) + F.size("__e") * 0.08))
    owned = F.when(
        F.col("profile_id").isNotNull(), F.array_append("__e", F.concat(F.lit("profile:"), F.col("profile_id")))
    ).otherwise(F.col("__e"))
    pattern = "|".join(SECRET_MARKERS)

    def hidden(item: Column) -> Column:
        head = F.substring_index(item, ":", 1)
        rest = F.regexp_extract(item, r"(?s)^[^:]*:(.*)$", 1)
        secret = F.lower(item).rlike(pattern) & (head != "indicator")
        short = F.substring(F.sha2(rest, 256), 1, 8)
        return F.when(secret, F.concat(head, F.lit(":<redacted:"), short, F.lit(">"))).otherwise(item)

    weak = (kind == "recovery_material") & ~F.array_contains("__e", "validated_recovery_indicator")
    real = kind != "decoy"
    return work.select(
        "entry_id",
        stable_id("sensitive-", ["volume_id", "display_path", kind]).alias("finding_id"),
        kind.alias("artifact_type"),
        "profile_id",
        F.when(_gone(), "deleted/carved").otherwise("allocated").alias("recovery_state"),
        F.when(kind.isin("wallet", "keystore", "private_key", "recovery_material"), "high")
        .otherwise("medium")
        .alias("sensitivity"),
        F.when(~real, 0.0).when(kind == "weak_name_match", 0.3).otherwise(F.round(score, 2)).alias("confidence"),
        encrypted.alias("encrypted"),
        F.when(real, F.array_distinct(F.transform(owned, hidden))).otherwise(no_strings()).alias("evidence"),
        F.when(
            real,
            present(
                (F.coalesce(encrypted, F.lit(False)), "encrypted_artifact_visible"),
                (_gone(), "deleted_or_carved_origin"),
                (weak, "weak_recovery_indicator"),
            ),
        )
        .otherwise(F.array(F.lit("decoy_name_ignored")))
        .alias("warnings"),
    )


_IMAGES = (".vhd", ".vhdx", ".vmdk", ".qcow2", ".vdi")
_NESTING = (".vhd/", ".vhdx/", ".vmdk/", ".qcow2/", ".vdi/", ".zip/")


def nested_depth(path: Column) -> Column:
    """How many container files a path leads through."""
    counts = [
        (F.length(path) - F.length(F.replace(path, F.lit(m), F.lit("")))) / F.lit(len(m)) for m in _NESTING
    ]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return total.cast("int")


def locate_backups(
    entries: DataFrame,
    metadata: DataFrame,
    categories: DataFrame,
    roots: DataFrame | None = None,
    schedule_nested: bool = False,
    max_nested_depth: int | None = None,
    max_scheduled: int | None = None,
) -> DataFrame:
    """Backup-like entries; eligible ones are scheduled: all, or the first ``max_scheduled`` in input order.

    ``metadata`` values are catalog states, ``categories`` arrays of category names.
    """
    work = enrich_by_path(entries, {"__state": metadata, "__cats": categories})
    work = work.withColumn("__p", path_key("display_path")).withColumn("__x", path_suffix("__p"))
    p, x = F.col("__p"), F.col("__x")
    mobile = F.coalesce(F.array_contains("__cats", "backups/mobile"), F.lit(False))
    signal = F.coalesce(F.nullif(x, F.lit("")), F.lit("path"))
    rules = [
        (has_any(p, "windowsimagebackup"), "windows_backup", F.lit("path:windowsimagebackup")),
        (has_any(p, "filehistory"), "file_history", F.lit("path:filehistory")),
        (x.isin(*_IMAGES), "disk_or_vm_image", F.concat(F.lit("extension:"), x)),
        (
            has_any(p, "itunes", "mobilebackup", "android backup") | x.isin(".ipa", ".ab"),
            "phone_backup",
            F.concat(F.lit("phone_backup_signal:"), signal),
        ),
        (has_any(p, "onedrive", "dropbox", "google drive"), "sync_root", F.lit("sync_root_path")),
        (
            x.isin(".bkf", ".bak") | has_any(p, "backup"),
            "generic_backup",
            F.concat(F.lit("generic_backup_signal:"), signal),
        ),
    ]
    found = None
    for cond, kind, why in rules:
        pair = F.struct(F.lit(kind).alias("kind"), why.alias("why"))
        found = F.when(cond, pair) if found is None else found.when(cond, pair)
    work = work.withColumn("__k", found).withColumn(
        "kind", F.coalesce(F.col("__k.kind"), F.when(mobile, F.lit("generic_backup")))
    )
    work = _with_owner(work.where("kind IS NOT NULL"), roots)
    work = work.withColumn("nested_depth", nested_depth(p))
    link = F.col("entry_type") == "symlink"
    depth = F.col("nested_depth")
    nested = F.lit(schedule_nested)
    if max_nested_depth is not None:
        nested = nested & (depth <= max_nested_depth)
    eligible = ~link & (F.col("kind") != "sync_root") & ((depth == 0) | nested)
    work = schedule_cap(work, eligible, "ord", max_scheduled)
    broken = F.coalesce(F.col("__state") == "broken", F.lit(False))
    return work.select(
        "entry_id",
        "ord",
        stable_id("backup-", ["volume_id", "display_path", "kind"]).alias("candidate_id"),
        "kind",
        "display_path",
        "profile_id",
        "nested_depth",
        "schedule_scan",
        F.array_distinct(
            present(
                (F.col("__k").isNotNull(), F.col("__k.why")),
                (mobile, "category:backups/mobile"),
                (broken, "catalog_state:broken"),
                (depth > 0, F.concat(F.lit("nested_depth:"), depth.cast("string"))),
                (F.col("profile_id").isNotNull(), F.concat(F.lit("profile:"), F.col("profile_id"))),
            )
        ).alias("evidence"),
        present(
            (link, "symlink_like_entry_not_scheduled"),
            (broken, "broken_catalog"),
            (~F.col("schedule_scan"), "not_scheduled_by_policy"),
        ).alias("warnings"),
    )


def locate_mobile_backups(
    entries: DataFrame, metadata: DataFrame, candidates: DataFrame | None = None
) -> DataFrame:
    """Phone backup folders and files with completeness, from paths and manifest metadata.

    ``metadata`` is a path lookup (path, ord, value) with a struct value (encrypted, device_name,
    device_identifier, supported_layout). Children meet their root by an equi-join on ancestors; per
    root only flags are aggregated.
    """
    paths = entries.select(
        path_key("display_path").alias("path"),
        F.lower(F.element_at(F.split(path_key("display_path"), "/"), -1)).alias("name"),
        "ord",
    )
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    n = F.size(parts)

    def root_at(i: Column) -> Column:
        here = F.element_at(parts, i)
        before = F.when(i > 1, F.element_at(parts, F.greatest(i - 1, F.lit(1))))
        ios = (here == "backup") & before.isin("mobilesync", "mobile sync")
        return F.when(
            (F.coalesce(ios, F.lit(False)) | (here == "android")) & (n > i),
            F.array_join(F.slice(parts, F.lit(1), i + 1), "/"),
        )

    derived = paths.select(
        F.explode(
            F.array_compact(
                F.concat(
                    F.transform(F.sequence(F.lit(1), n), root_at),
                    F.array(F.when(F.col("path").endswith(".ab"), F.col("path"))),
                )
            )
        ).alias("root")
    )
    if candidates is not None:
        other = candidates.select(path_key("display_path").alias("root"))
        derived = derived.unionByName(
            other.where(F.contains("root", F.lit("mobilebackup")) | F.col("root").endswith(".ab"))
        )
    roots = derived.distinct()
    held = paths.select("name", "ord", "path", F.explode(ancestors(F.col("path"))).alias("root"))
    named = lambda x: F.coalesce(F.bool_or(F.col("name") == x), F.lit(False))
    facts = (
        on_ancestors(held, roots, ["root"])
        .groupBy("root")
        .agg(
            F.count(F.lit(1)).alias("children"),
            (named("manifest.db") & named("manifest.plist") & named("status.plist")).alias("ios_complete"),
            (named("manifest.json") | named("backup.ab")).alias("android_complete"),
            F.min_by("path", F.when(F.col("name") == "manifest.plist", F.col("ord"))).alias("manifest"),
        )
    )
    rows = roots.join(facts, "root", "left")
    direct = F.col("root").endswith(".ab")
    around = F.concat(F.lit("/"), "root", F.lit("/"))
    ios = has_any(around, "/mobilesync/backup/", "/mobile sync/backup/")
    android = F.contains(around, F.lit("/android/"))
    platform = (
        F.when(direct, "android_ab")
        .when(F.col("children").isNull(), None)
        .when(ios, "itunes_finder")
        .when(android, "android_directory")
    )
    rows = rows.withColumn("layout", platform).where("layout IS NOT NULL")
    is_ios = F.col("layout") == "itunes_finder"
    rows = rows.withColumn(
        "__at", F.when(is_ios, F.coalesce("manifest", "root")).otherwise(F.col("root"))
    )
    meta = metadata.groupBy(path_key("path").alias("__at")).agg(F.max_by("value", "ord").alias("__m"))
    rows = rows.join(meta, "__at", "left")
    is_direct = F.col("layout") == "android_ab"
    leaf = F.element_at(F.split("root", "/"), -1)
    hashed = leaf.rlike("^[0-9a-f]{40}$")
    complete = is_direct | F.when(is_ios, F.col("ios_complete")).otherwise(F.col("android_complete"))
    supported = is_ios | is_direct | F.coalesce(F.col("__m.supported_layout"), F.lit(False))
    encrypted = _true(F.col("__m.encrypted"))
    given = F.nullif(F.trim(F.col("__m.device_identifier")), F.lit(""))
    device = F.when(is_ios, F.when(hashed, F.coalesce(given, leaf))).otherwise(given)
    family = F.when(is_ios, "ios").otherwise("android")
    return rows.select(
        stable_id("mobile-", [family, "root"]).alias("backup_id"),
        family.alias("platform"),
        "layout",
        F.col("root").alias("root_path"),
        F.nullif(F.trim(F.col("__m.device_name")), F.lit("")).alias("device_name"),
        device.alias("device_identifier"),
        encrypted.alias("encrypted"),
        complete.alias("complete"),
        supported.alias("supported"),
        present(
            (is_ios, "layout:ios_mobile_sync_backup"),
            (~is_ios, F.concat(F.lit("layout:"), F.col("layout"))),
            (is_ios & hashed, "hashed_backup_folder"),
        ).alias("evidence"),
        present(
            (is_ios & ~hashed, "moved_or_renamed_backup_folder"),
            (~complete, "partial_backup"),
            (~supported, "unsupported_android_layout_visible"),
            (F.coalesce(encrypted, F.lit(False)), "encrypted_backup_visible"),
        ).alias("warnings"),
    )


def _parts(path: str) -> Column:
    return F.filter(F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")


def discover_installs_profiles(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(installations, profiles)`` from path evidence; evidence sets hold a handful of labels."""
    work = entries.select(
        "volume_id", "owner_id", "ord", _parts("display_path").alias("parts")
    ).withColumn("low", F.transform("parts", lambda s: F.lower(s)))
    work = work.where(F.size("parts") >= 2)
    low, parts = F.col("low"), F.col("parts")
    win = work.where(low[0] == "windows").select(
        "volume_id",
        parts[0].alias("root_path"),
        F.when(low[1].isin("system32", "syswow64", "winsxs"), F.concat(F.lit("windows/"), low[1])).alias("e"),
        (F.array_join(F.slice(low, 2, 3), "/") == "system32/config/software").alias("reg"),
    )
    installs = (
        win.groupBy("volume_id", "root_path")
        .agg(F.array_sort(F.collect_set("e")).alias("evidence"), F.bool_or("reg").alias("registry_present"))
        .where(F.size("evidence") > 0)
    )
    installs = installs.select(
        stable_id("win-", ["volume_id", "root_path"]).alias("installation_id"),
        "volume_id",
        "root_path",
        "evidence",
        "registry_present",
    )
    below = F.slice(low, 2, 1_000_000)
    homes = low[0].isin("users", "documents and settings")
    known = F.arrays_overlap(below, F.array(*[F.lit(d) for d in PROFILE_DIRS]))
    root = F.when(homes, F.array_join(F.slice(parts, 1, 2), "/")).when(known, parts[0])
    hit = F.filter(low, lambda s: s.isin(*PROFILE_DIRS))
    evidence = (
        F.when(F.array_contains(low, "ntuser.dat"), "ntuser.dat")
        .when(F.size(hit) > 0, F.concat(F.lit("well_known:"), F.try_element_at(hit, F.lit(1))))
        .otherwise("profile_root")
    )
    sid = F.when(F.startswith("owner_id", F.lit("S-")), F.col("owner_id"))
    found = work.select("volume_id", root.alias("root_path"), evidence.alias("e"), sid.alias("sid"), "ord")
    profiles = (
        found.where("root_path IS NOT NULL")
        .groupBy("volume_id", "root_path")
        .agg(
            F.array_sort(F.collect_set("e")).alias("evidence"),
            F.max_by("sid", F.when(F.col("sid").isNotNull(), F.col("ord"))).alias("sid"),
        )
    )
    first = installs.groupBy("volume_id").agg(F.min_by("installation_id", "root_path").alias("installation_id"))
    low_root = F.lower("root_path")
    return installs, profiles.join(first, "volume_id", "left").select(
        stable_id("profile-", ["volume_id", "root_path", "sid"]).alias("profile_id"),
        "installation_id",
        "volume_id",
        "root_path",
        F.element_at(F.split("root_path", "/"), -1).alias("display_name"),
        "sid",
        "evidence",
        (~(F.startswith(low_root, F.lit("users/")) | F.startswith(low_root, F.lit("documents and settings/")))).alias(
            "portable"
        ),
    )


# fixed values: folder sequences that lead to browser profiles, in the order they are tried
BROWSER_FOLDERS = (
    ("google/chrome/user data", "Chrome", "chromium"),
    ("microsoft/edge/user data", "Edge", "chromium"),
    ("bravesoftware/brave-browser/user data", "Brave", "chromium"),
    ("vivaldi/user data", "Vivaldi", "chromium"),
    ("chromium/user data", "Chromium", "chromium"),
    ("opera software", "Opera", "chromium"),
    ("mozilla/firefox/profiles", "Firefox", "firefox"),
    ("tor browser/browser/torbrowser/data/browser", "Tor Browser", "firefox"),
)
PORTABLE_FOLDER = "googlechromeportable/data/profile"


def locate_browser_profiles(
    entries: DataFrame, owners: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(profiles, companions)``: browser profile folders and the entries that show them.

    Owners (profile_id, sid, volume_id, root_path, ord) must lie on the same volume.
    """
    work = entries.select("entry_id", "volume_id", "ord", _parts("display_path").alias("parts"))
    work = work.withColumn("low", F.transform("parts", lambda s: F.lower(s))).withColumn(
        "__p", F.concat(F.lit("/"), F.array_join("low", "/"), F.lit("/"))
    )
    parts, low, p = F.col("parts"), F.col("low"), F.col("__p")

    variants = [(*v, True) for v in BROWSER_FOLDERS] + [(PORTABLE_FOLDER, "Chrome", "chromium", False)]

    def profile_files(family: Column) -> Column:
        both = [F.array(*[F.lit(f) for f in files]) for files in (CHROMIUM_FILES, FIREFOX_FILES)]
        return F.when(family == "chromium", both[0]).otherwise(both[1])

    def depth_of(at: Column, folder: Column) -> Column:
        """Path parts up to the end of the marker folder."""
        head = F.substring(p, F.lit(1), at - 1)
        return F.size(F.filter(F.split(head, "/"), lambda s: s != "")) + F.size(F.split(folder, "/"))

    def matches(folder: str, family: str, own_folder: bool) -> Column:
        at = F.instr(p, f"/{folder}/")
        top = depth_of(at, F.lit(folder)) + (1 if own_folder else 0)
        rest = F.slice(low, F.greatest(top, F.lit(0)) + 1, F.size(low))
        return (at > 0) & (F.size(low) >= top) & F.arrays_overlap(rest, profile_files(F.lit(family)))

    # which variant fits is settled first and on its own, so the filter carries a number, not structs
    which = None
    for i, (folder, _browser, family, own_folder) in enumerate(variants):
        cond = matches(folder, family, own_folder)
        which = F.when(cond, F.lit(i)) if which is None else which.when(cond, F.lit(i))
    table = F.array(
        *[
            F.struct(
                F.lit(f).alias("folder"), F.lit(b).alias("name"), F.lit(fam).alias("family"), F.lit(own).alias("own")
            )
            for f, b, fam, own in variants
        ]
    )
    hit = keep_where(work.withColumn("__i", which), F.col("__i").isNotNull()).withColumn("__v", F.element_at(table, F.col("__i") + 1))
    folder, family, own = F.col("__v.folder"), F.col("__v.family"), F.col("__v.own")
    at = F.position(F.concat(F.lit("/"), folder, F.lit("/")), p)
    hit = hit.withColumn("__top", depth_of(at, folder) + F.when(own, 1).otherwise(0))
    top = F.col("__top")
    shown = F.filter(
        F.slice(low, F.greatest(top, F.lit(0)) + 1, F.size(low)), lambda s: F.array_contains(profile_files(family), s)
    )
    filled = hit.withColumn(
        "__h",
        F.struct(
            F.col("__v.name").alias("browser_name"),
            family.alias("browser_family"),
            F.array_join(F.slice(parts, F.lit(1), F.greatest(top, F.lit(0))), "/").alias("profile_path"),
            F.when(own, F.try_element_at(parts, F.greatest(top, F.lit(1)))).otherwise("profile").alias("profile_name"),
            F.try_element_at(shown, F.lit(1)).alias("evidence"),
        ),
    )
    seen = filled.select("entry_id", "volume_id", "ord", "__h.*").withColumn("__key", F.lower("profile_path"))
    keys = ["volume_id", "browser_name", "__key"]
    grouped = seen.groupBy(*keys).agg(
        F.min_by(F.struct("browser_family", "profile_path", "profile_name"), "ord").alias("f"),
        F.array_sort(F.collect_set("evidence")).alias("evidence"),
        F.count_distinct("entry_id").alias("companions"),
    )
    profiles = grouped.select(
        *keys, "f.*", "evidence", "companions", (F.size("evidence") == 1).alias("partial")
    ).withColumn("browser_profile_id", stable_id("browser-profile-", ["volume_id", "browser_name", "profile_path"]))
    companions = seen.join(profiles.select(*keys, "browser_profile_id"), keys).select(
        "browser_profile_id", "entry_id"
    )
    if owners is None:
        profiles = profiles.withColumn("owner_id", F.lit(None).cast("string"))
    else:
        held = owner_by_prefix(profiles, owners, True, "profile_path", "browser_profile_id")
        profiles = profiles.join(held, "browser_profile_id", "left")
    return profiles.withColumn("portable", F.col("owner_id").isNull()).drop("__key"), companions


def software_inventory(
    entries: DataFrame, metadata: DataFrame, categories: DataFrame, roots: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(records, evidence, warnings)`` of installed software.

    ``metadata`` values are structs (display_name, publisher, version, install_time,
    install_location). One record per (name, publisher, version); ``evidence`` lists every entry
    with its kind and install root, so a widespread program costs rows, not one huge list.
    """
    work = enrich_by_path(entries, {"__m": metadata, "__cats": categories})
    work = _with_owner(work, roots).withColumn("__p", path_key("display_path"))
    p = F.col("__p")
    parts = F.filter(F.split(p, "/"), lambda s: s != "")
    n = F.size(parts)
    leaf = F.element_at(F.split(F.replace(F.col("display_path"), F.lit("\\"), F.lit("/")), "/"), -1)
    low_leaf = F.lower(leaf)
    clean = lambda c: F.nullif(F.trim(F.col(f"__m.{c}")), F.lit(""))
    none = F.lit(None).cast("string")

    def of(name: Column, publisher: Column, version: Column, time: Column, root: Column, owner: Column, kind: str) -> Column:
        return F.struct(
            name.alias("name"),
            publisher.alias("publisher"),
            version.alias("version"),
            time.alias("install_time"),
            root.alias("install_root"),
            owner.alias("profile_id"),
            F.lit(kind).alias("kind"),
        )

    registered = F.coalesce(F.col("__m.display_name"), F.lit("")) != ""
    uninstall = F.when(F.array_contains(parts, "uninstall"), F.array_join(parts, "/"))
    package = F.try_element_at(parts, F.lit(3))
    pieces = F.split(package, "_")
    program = F.try_element_at(parts, F.lit(1)).isin("program files", "program files (x86)")
    binary = low_leaf.endswith(".exe") | low_leaf.endswith(".dll")
    depth = F.least(n, F.lit(3))
    hit = (
        F.when(
            registered,
            of(
                F.col("__m.display_name"),
                clean("publisher"),
                clean("version"),
                clean("install_time"),
                F.coalesce(clean("install_location"), uninstall, F.col("display_path")),
                none,
                "uninstall_registry",
            ),
        )
        .when(
            (n >= 3) & (F.try_element_at(parts, F.lit(1)) == "program files") & (F.try_element_at(parts, F.lit(2)) == "windowsapps"),
            of(
                F.try_element_at(pieces, F.lit(1)),
                none,
                F.try_element_at(pieces, F.lit(2)),
                none,
                F.array_join(F.slice(parts, 1, 3), "/"),
                none,
                "store_package",
            ),
        )
        .when(
            (n >= 2) & program & binary,
            of(
                F.try_element_at(parts, depth),
                none,
                none,
                none,
                F.array_join(F.slice(parts, F.lit(1), depth), "/"),
                none,
                "application_directory",
            ),
        )
        .when(
            F.col("profile_id").isNotNull() & low_leaf.endswith(".exe"),
            of(
                F.substring(leaf, F.lit(1), F.length(leaf) - 4),
                none,
                none,
                none,
                F.regexp_replace(F.col("display_path"), "/[^/]*$", ""),
                F.col("profile_id"),
                "portable_app",
            ),
        )
    )
    judged = work.withColumn("__h", hit)
    folder = (F.startswith(p, F.lit("program files/")) | F.startswith(p, F.lit("program files (x86)/"))) & ~(
        p.endswith(".exe") | p.endswith(".dll")
    )
    foreign = F.col("__cats").isNotNull() & ~F.array_contains("__cats", "software/code/databases")
    label = F.when(F.col("__h").isNull() & folder, "false_positive_folder").when(
        F.col("__h").isNotNull() & foreign, "non_software_category"
    )
    warnings = judged.where(label.isNotNull()).select(
        F.concat(label, F.lit(":"), F.col("display_path")).alias("warning")
    ).distinct()
    kept = judged.where(F.col("__h").isNotNull() & ~F.coalesce(foreign, F.lit(False))).select("entry_id", "ord", "__h.*")
    folded = F.regexp_replace(F.trim(F.regexp_replace(F.lower("name"), "[_-]", " ")), r"\s+", " ")
    key = F.concat_ws("|", folded, F.coalesce("publisher", F.lit("")), F.coalesce("version", F.lit("")))
    rows = kept.withColumn("__key", key).withColumn("inventory_id", F.concat(F.lit("software-"), F.substring(F.sha2("__key", 256), 1, 24)))
    complete = (F.col("kind") != "uninstall_registry") | (F.col("publisher").isNotNull() & F.col("version").isNotNull())
    early = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    records = rows.groupBy("inventory_id").agg(
        F.min_by("name", "ord").alias("name"),
        F.substring_index(F.min("__key"), "|", 1).alias("normalized_name"),
        early("publisher"),
        early("version"),
        early("install_time"),
        F.count(F.lit(1)).alias("evidence_count"),
        F.count_distinct("install_root").alias("root_count"),
        F.bool_and(complete).alias("complete"),
    )
    return records, rows.select("inventory_id", "entry_id", "kind", "install_root", "profile_id"), warnings


# --------------------------------------------------------------------------- lost volumes


def scan_blocks(blocks: DataFrame, partitions: DataFrame, media_size: int, max_candidates: int | None = None) -> DataFrame:
    """Blocks that look like the start of a filesystem, with overlap and staleness.

    ``blocks`` has (offset_bytes, block), ``partitions`` (slot, offset_bytes, length_bytes). With
    ``max_candidates`` the lowest offsets are kept. Without any candidate, an encrypted first block is
    reported instead.
    """
    b = F.col("block")
    n = F.octet_length(b)
    at = lambda pos, size: F.substring(b, pos + 1, size)
    text = lambda s: F.lit(s).cast("binary")
    signature = (
        F.when((n >= 11) & (at(3, 8) == text("NTFS    ")), "ntfs")
        .when((n >= 90) & (at(82, 8) == text("FAT32   ")), "fat32")
        .when((n >= 11) & (at(3, 8) == text("EXFAT   ")), "exfat")
        .when((n >= 2) & (at(0, 2) == F.unhex(F.lit("EB3C"))) & F.contains(at(0, 90), text("FAT")), "fat")
    )
    found = blocks.withColumn("signature", signature).where("signature IS NOT NULL")
    if max_candidates is not None:
        found = found.orderBy("offset_bytes").limit(max_candidates)
    ranges = partitions.select(
        F.col("offset_bytes").alias("__s"), (F.col("offset_bytes") + F.col("length_bytes")).alias("__t")
    )
    inside = inside_any(found, ranges, "offset_bytes", "__s", "__t").withColumn("__in", F.lit(True))
    work = found.join(inside, "offset_bytes", "left")
    overlap = F.coalesce("__in", F.lit(False))
    stale = F.contains(at(0, 128), text("STALE")) | F.contains(at(0, 128), text("DELETED"))
    base = (
        F.when(F.col("signature") == "ntfs", 0.9)
        .when(F.col("signature").isin("fat32", "exfat"), 0.85)
        .otherwise(0.7)
    )
    score = base - F.when(overlap, 0.25).otherwise(0.0) - F.when(stale, 0.35).otherwise(0.0)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 2)))
    length = F.least(F.lit(media_size) - F.col("offset_bytes"), F.lit(128 * 1024 * 1024))
    head = F.concat(F.col("offset_bytes").cast("string"), F.lit(":"), "signature").cast("binary")
    result = work.select(
        F.concat(F.lit("lost-volume-"), F.substring(F.sha2(F.concat(head, at(0, 64)), 256), 1, 24)).alias("candidate_id"),
        "offset_bytes",
        length.cast("long").alias("length_bytes"),
        "signature",
        confidence.alias("confidence"),
        F.when(stale, "stale").when(overlap, "overlap").otherwise("candidate").alias("status"),
        present((overlap, "overlaps_current_partition"), (stale, "stale_signature")).alias("warnings"),
        (~(overlap & (confidence < 0.75))).alias("scheduled"),
    )
    if not found.isEmpty():
        return result
    bytes_hex = F.regexp_extract_all(F.hex(at(0, 4096)), F.lit("(..)"), F.lit(1))
    marked = F.startswith(b, text("LUKS")) | F.contains(at(0, 512), text("VERACRYPT"))
    random = (F.size(F.array_distinct(bytes_hex)) > 200) & (
        F.size(F.filter(bytes_hex, lambda x: x == "00")) < F.floor(F.least(n, F.lit(4096)) / 100)
    )
    return blocks.where((F.col("offset_bytes") == 0) & (n >= 512) & marked & random).select(
        F.lit("candidate-encrypted-volume").alias("candidate_id"),
        "offset_bytes",
        F.lit(media_size).cast("long").alias("length_bytes"),
        F.lit("encrypted-unknown").alias("signature"),
        F.lit(0.35).alias("confidence"),
        F.lit("encrypted").alias("status"),
        F.array(F.lit("encrypted_or_high_entropy_volume")).alias("warnings"),
        F.lit(True).alias("scheduled"),
    )


