"""Bindings of the locators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locators as op
from ..registry import query
from .bindings import VIEWS, ctes, run_sql, view
from .graphs import ROOTS_SQL, _strict

ENTRIES = ctes("entries")
K = "lower(trim(replace(display_path, '\\', '/'), '/'))"
X = f"regexp_extract(list_last(string_split({K}, '/')), '^.+(\\.[^.]+)$', 1)"

# entries of one volume have metadata, entries with an owner have categories; both join by path
META = """SELECT display_path AS path, ord, {value} AS value FROM ({entries}) x WHERE {cond}"""


def lookup(spark, sf, value: str, cond: str):
    return run_sql(
        spark, sf, META.replace("{entries}", VIEWS["entries"]).replace("{value}", value).replace("{cond}", cond)
    )


INDICATORS = """CASE ord % 6 WHEN 0 THEN array('password_vault') WHEN 3 THEN array('bip39_mnemonic_shape', 'my_secret:zz')
    ELSE CAST(array() AS ARRAY<STRING>) END"""
IND_SQL = """CASE ord % 6 WHEN 0 THEN ['password_vault'] WHEN 3 THEN ['bip39_mnemonic_shape', 'my_secret:zz'] ELSE CAST([] AS VARCHAR[]) END"""
FLAG = "CASE ord % 9 WHEN 0 THEN 'Yes' WHEN 3 THEN 'no' END"


def _any(col: str, *frs: str) -> str:
    return "(" + " OR ".join(f"contains({col}, '{f}')" for f in frs) + ")"


# metadata is looked up by path: of entries that share a path the last one counts
SENS_SQL = f"""WITH {ENTRIES}, {ROOTS_SQL}, en AS (SELECT *, {K} AS k, {X} AS x FROM entries),
    md AS (SELECT k, arg_max({IND_SQL}, ord) AS ind, arg_max(struct_pack(f := {FLAG}), ord).f AS flag FROM en WHERE volume_id = 'vol-0' GROUP BY k),
    ct AS (SELECT k, TRUE AS wal FROM en WHERE owner_id IS NOT NULL GROUP BY k),
    ow AS (SELECT entry_id, arg_min(r.owner_id, (r.ord, r.owner_id)) AS profile_id FROM en JOIN r ON starts_with(en.k, lower(root_path) || '/') GROUP BY 1),
    j AS (SELECT en.*, coalesce(ind, CAST([] AS VARCHAR[])) AS ind, CASE WHEN flag IS NOT NULL THEN lower(flag) = 'yes' END AS enc, coalesce(wal, FALSE) AS wal, profile_id,
      {_any("en.k", "browser", "chrome/user data", "firefox/profiles")} AS br FROM en LEFT JOIN md USING (k) LEFT JOIN ct USING (k) LEFT JOIN ow ON ow.entry_id = en.entry_id),
    t AS (SELECT *, CASE WHEN {_any("k", "fake wallet")} THEN 'decoy' WHEN {_any("k", "bitcoin/wallets")} AND contains(k, 'wallet.dat') THEN 'wallet'
      WHEN x IN ('.key', '.pem') OR contains(k, '.ssh/id_rsa') THEN 'private_key' WHEN x IN ('.p12', '.pfx', '.cer', '.crt') THEN 'certificate'
      WHEN x = '.kdbx' OR list_contains(ind, 'password_vault') THEN 'password_vault' WHEN list_contains(ind, 'bip39_mnemonic_shape') THEN 'recovery_material'
      WHEN {_any("k", "wallet", "keystore", "vault")} THEN 'weak_name_match' END AS kind FROM j),
    e AS (SELECT *, list_filter([CASE WHEN wal THEN 'category:wallets/vaults/keys' END, 'artifact_type:' || kind, CASE WHEN x <> '' THEN 'extension:' || x END,
      CASE WHEN contains(k, 'bitcoin') THEN 'path:bitcoin' END, CASE WHEN br THEN 'path:browser_profile' END], lambda v: v IS NOT NULL)
      || list_transform(ind, lambda v: CASE WHEN v = 'bip39_mnemonic_shape' THEN 'validated_recovery_indicator' ELSE 'indicator:' || v END)
      || list_filter([CASE WHEN enc THEN 'encrypted:True' WHEN NOT enc THEN 'encrypted:False' END], lambda v: v IS NOT NULL) AS ev FROM t WHERE kind IS NOT NULL)"""


@query(
    "l1_locate_sensitive",
    f"""{SENS_SQL} SELECT entry_id, 'sensitive-' || substr(sha256(volume_id || chr(0) || display_path || chr(0) || kind), 1, 24) AS finding_id, kind AS artifact_type, profile_id,
      CASE WHEN NOT allocated OR entry_type = 'deleted' THEN 'deleted/carved' ELSE 'allocated' END AS recovery_state,
      CASE WHEN kind IN ('wallet', 'keystore', 'private_key', 'recovery_material') THEN 'high' ELSE 'medium' END AS sensitivity,
      CASE kind WHEN 'decoy' THEN 0.0 WHEN 'weak_name_match' THEN 0.3 ELSE round(least(0.95, 0.55 + len(ev) * 0.08), 2) END AS confidence, enc AS encrypted,
      CASE kind WHEN 'decoy' THEN '' ELSE array_to_string(list_transform(CASE WHEN profile_id IS NULL THEN ev ELSE list_append(ev, 'profile:' || profile_id) END, lambda v:
        CASE WHEN regexp_matches(v, 'secret|private_key|mnemonic|seed_phrase|password|decrypted') AND v NOT LIKE 'indicator:%'
        THEN split_part(v, ':', 1) || ':<redacted:' || substr(sha256(substr(v, strpos(v, ':') + 1)), 1, 8) || '>' ELSE v END), '|') END AS evidence,
      CASE kind WHEN 'decoy' THEN 'decoy_name_ignored' ELSE concat_ws('|', CASE WHEN enc THEN 'encrypted_artifact_visible' END,
        CASE WHEN NOT allocated OR entry_type = 'deleted' THEN 'deleted_or_carved_origin' END) END AS warnings FROM e""",
)
def l1(spark, sf):
    meta = lookup(spark, sf, f"named_struct('indicators', {INDICATORS}, 'encrypted', {FLAG})", "volume_id = 'vol-0'")
    cats = lookup(spark, sf, "array('wallets/vaults/keys')", "owner_id IS NOT NULL")
    out = op.locate_sensitive(view(spark, sf, "entries"), meta, cats, _strict(spark, sf))
    return out.withColumn("evidence", F.array_join("evidence", "|")).withColumn("warnings", F.array_join("warnings", "|"))


@query(
    "l2_locate_backups",
    f"""WITH {ENTRIES}, {ROOTS_SQL}, en AS (SELECT *, {K} AS k, {X} AS x FROM entries),
    md AS (SELECT k, TRUE AS broken FROM en WHERE volume_id = 'vol-0' GROUP BY k), ct AS (SELECT k, TRUE AS mob FROM en WHERE owner_id IS NOT NULL GROUP BY k),
    ow AS (SELECT entry_id, arg_min(r.owner_id, (r.ord, r.owner_id)) AS profile_id FROM en JOIN r ON starts_with(en.k, lower(root_path) || '/') GROUP BY 1),
    t AS (SELECT en.*, coalesce(broken, FALSE) AS broken, coalesce(mob, FALSE) AS mob, profile_id,
      CASE WHEN x IN ('.vhd', '.vhdx', '.vmdk', '.qcow2', '.vdi') THEN 'disk_or_vm_image' WHEN contains(en.k, 'mobilebackup') OR x IN ('.ipa', '.ab') THEN 'phone_backup'
        WHEN x IN ('.bkf', '.bak') OR contains(en.k, 'backup') THEN 'generic_backup' END AS rk,
      CASE WHEN contains(en.k, '.vhdx/') THEN 1 ELSE 0 END + CASE WHEN contains(en.k, '.zip/') THEN 1 ELSE 0 END AS depth
      FROM en LEFT JOIN md USING (k) LEFT JOIN ct USING (k) LEFT JOIN ow ON ow.entry_id = en.entry_id),
    u AS (SELECT *, coalesce(rk, CASE WHEN mob THEN 'generic_backup' END) AS kind FROM t),
    v AS (SELECT *, entry_type <> 'symlink' AND depth <= 2 AS ok FROM u WHERE kind IS NOT NULL),
    w AS (SELECT *, ok AND count(*) FILTER (ok) OVER (ORDER BY ord) <= 20 AS sched FROM v)
    SELECT entry_id, 'backup-' || substr(sha256(volume_id || chr(0) || display_path || chr(0) || kind), 1, 24) AS candidate_id, kind, profile_id, depth AS nested_depth, sched AS schedule_scan,
      concat_ws('|', CASE rk WHEN 'phone_backup' THEN 'phone_backup_signal:' || coalesce(nullif(x, ''), 'path') WHEN 'generic_backup' THEN 'generic_backup_signal:' || coalesce(nullif(x, ''), 'path')
        WHEN 'disk_or_vm_image' THEN 'extension:' || x END, CASE WHEN mob THEN 'category:backups/mobile' END, CASE WHEN broken THEN 'catalog_state:broken' END,
        CASE WHEN depth > 0 THEN 'nested_depth:' || depth END, 'profile:' || profile_id) AS evidence,
      concat_ws('|', CASE WHEN entry_type = 'symlink' THEN 'symlink_like_entry_not_scheduled' END, CASE WHEN broken THEN 'broken_catalog' END, CASE WHEN NOT sched THEN 'not_scheduled_by_policy' END) AS warnings FROM w""",
)
def l2(spark, sf):
    out = op.locate_backups(
        view(spark, sf, "entries"),
        lookup(spark, sf, "'broken'", "volume_id = 'vol-0'"),
        lookup(spark, sf, "array('backups/mobile')", "owner_id IS NOT NULL"),
        _strict(spark, sf),
        schedule_nested=True,
        max_nested_depth=2,
        max_scheduled=20,
    )
    return out.drop("ord", "display_path").withColumn("evidence", F.array_join("evidence", "|")).withColumn(
        "warnings", F.array_join("warnings", "|")
    )


@query(
    "l3_locate_mobile_backups",
    f"""WITH {ENTRIES}, en AS (SELECT *, {K} AS k FROM entries),
    rt AS (SELECT DISTINCT regexp_extract(k, '^(.*/mobilesync/backup/[^/]+)/', 1) AS root FROM en WHERE k LIKE '%/mobilesync/backup/%'
      UNION SELECT regexp_extract(k, '^((?:.*/)?android/[^/]+)', 1) FROM en WHERE k LIKE '%android/%' UNION SELECT k FROM en WHERE k LIKE '%.ab'),
    ch AS (SELECT root, list_last(string_split(k, '/')) AS name, k, ord FROM rt JOIN en ON starts_with(k, root || '/')),
    fa AS (SELECT root, bool_or(name = 'manifest.db') AND bool_or(name = 'manifest.plist') AND bool_or(name = 'status.plist') AS ios, bool_or(name IN ('manifest.json', 'backup.ab')) AS andr,
      arg_min(k, ord) FILTER (name = 'manifest.plist') AS mf FROM ch GROUP BY root),
    md AS (SELECT k, arg_max({FLAG.replace("ord % 9", "ord % 4").replace("WHEN 3", "WHEN 1")}, ord) AS flag, arg_max('dev' || ord, ord) AS dev FROM en WHERE volume_id <> 'vol-2' GROUP BY k),
    l AS (SELECT rt.root, CASE WHEN rt.root LIKE '%.ab' THEN 'android_ab' WHEN rt.root LIKE '%/mobilesync/backup/%' THEN 'itunes_finder' ELSE 'android_directory' END AS layout, ios, andr, mf FROM rt LEFT JOIN fa USING (root)),
    m AS (SELECT l.*, CASE WHEN flag IS NOT NULL THEN lower(flag) = 'yes' END AS enc, dev, regexp_matches(root, '/[0-9a-f]{{40}}$') AS hashed FROM l LEFT JOIN md ON md.k = CASE layout WHEN 'itunes_finder' THEN coalesce(mf, root) ELSE root END),
    c AS (SELECT *, CASE layout WHEN 'android_ab' THEN TRUE WHEN 'itunes_finder' THEN ios ELSE andr END AS complete FROM m)
    SELECT root AS root_path, layout, dev AS device_name, CASE WHEN layout = 'itunes_finder' AND hashed THEN list_last(string_split(root, '/')) END AS device_identifier, enc AS encrypted, complete, layout <> 'android_directory' AS supported,
      concat_ws('|', CASE WHEN layout = 'itunes_finder' AND NOT hashed THEN 'moved_or_renamed_backup_folder' END, CASE WHEN NOT complete THEN 'partial_backup' END,
        CASE WHEN layout = 'android_directory' THEN 'unsupported_android_layout_visible' END, CASE WHEN enc THEN 'encrypted_backup_visible' END) AS warnings FROM c""",
)
def l3(spark, sf):
    flag = FLAG.replace("ord % 9", "ord % 4").replace("WHEN 3", "WHEN 1")
    meta = lookup(
        spark,
        sf,
        f"named_struct('encrypted', {flag}, 'device_name', 'dev' || ord, 'device_identifier', '', 'supported_layout', FALSE)",
        "volume_id <> 'vol-2'",
    )
    out = op.locate_mobile_backups(view(spark, sf, "entries"), meta)
    return out.select(
        "root_path",
        "layout",
        "device_name",
        "device_identifier",
        "encrypted",
        "complete",
        "supported",
        F.array_join("warnings", "|").alias("warnings"),
    )


PARTS_SQL = f"""pt AS (SELECT *, list_filter(string_split(replace(display_path, '\\', '/'), '/'), lambda s: s <> '') AS p FROM entries),
    lo AS (SELECT *, list_transform(p, lambda s: lower(s)) AS l FROM pt WHERE len(p) >= 2),
    ins AS (SELECT volume_id, p[1] AS root, string_agg(DISTINCT CASE WHEN l[2] IN ('system32', 'syswow64', 'winsxs') THEN 'windows/' || l[2] END, '|') AS ev,
      bool_or(array_to_string(l[2:4], '/') = 'system32/config/software') AS reg FROM lo WHERE l[1] = 'windows' GROUP BY ALL HAVING count(*) FILTER (l[2] IN ('system32', 'syswow64', 'winsxs')) > 0)"""


@query(
    "l4_discover_installs",
    f"""WITH {ENTRIES}, {PARTS_SQL} SELECT 'win-' || substr(sha256(volume_id || chr(0) || root), 1, 24) AS installation_id, volume_id, root AS root_path, ev AS evidence, reg AS registry_present FROM ins""",
)
def l4(spark, sf):
    return op.discover_installs_profiles(view(spark, sf, "entries"))[0].withColumn("evidence", F.array_join("evidence", "|"))


KNOWN = "['desktop', 'documents', 'downloads', 'pictures', 'appdata']"


@query(
    "l4_discover_profiles",
    f"""WITH {ENTRIES}, {PARTS_SQL}, f AS (SELECT *, CASE WHEN l[1] IN ('users', 'documents and settings') THEN p[1] || '/' || p[2] WHEN list_has_any(l[2:], {KNOWN}) THEN p[1] END AS root,
      CASE WHEN list_contains(l, 'ntuser.dat') THEN 'ntuser.dat' WHEN list_has_any(l, {KNOWN}) THEN 'well_known:' || list_filter(l, lambda s: list_contains({KNOWN}, s))[1] ELSE 'profile_root' END AS e FROM lo),
    g AS (SELECT volume_id, root, string_agg(DISTINCT e, '|' ORDER BY e) AS ev, arg_max(owner_id, ord) FILTER (owner_id LIKE 'S-%') AS sid FROM f WHERE root IS NOT NULL GROUP BY ALL),
    i AS (SELECT volume_id, 'win-' || substr(sha256(volume_id || chr(0) || min(root)), 1, 24) AS installation_id FROM ins GROUP BY 1)
    SELECT 'profile-' || substr(sha256(volume_id || chr(0) || root || chr(0) || coalesce(sid, '')), 1, 24) AS profile_id, installation_id, volume_id, root AS root_path,
      list_last(string_split(root, '/')) AS display_name, sid, ev AS evidence, NOT regexp_matches(lower(root), '^(users|documents and settings)/') AS portable FROM g LEFT JOIN i USING (volume_id)""",
)
def l4_profiles(spark, sf):
    return op.discover_installs_profiles(view(spark, sf, "entries"))[1].withColumn("evidence", F.array_join("evidence", "|"))


BROWSER_SQL = f"""{ENTRIES}, {ROOTS_SQL}, h AS (SELECT *, CASE WHEN contains(lower(display_path), '/google/chrome/user data/') THEN 'Chrome' WHEN contains(lower(display_path), '/mozilla/firefox/profiles/') THEN 'Firefox' END AS b,
      regexp_extract(display_path, '^(.*)/[^/]+$', 1) AS folder, lower(regexp_extract(display_path, '([^/]+)$', 1)) AS f FROM entries),
    s AS (SELECT * FROM h WHERE b IS NOT NULL AND f IN ('history', 'cookies', 'places.sqlite')),
    g AS (SELECT volume_id, b, lower(folder) AS fk, arg_min(folder, ord) AS path, string_agg(DISTINCT f, '|' ORDER BY f) AS ev, count(DISTINCT f) AS n, count(*) AS companions FROM s GROUP BY ALL),
    o AS (SELECT g.volume_id, b, fk, arg_min(r.owner_id, (r.ord, r.owner_id)) AS owner_id FROM g JOIN r ON r.volume_id = g.volume_id AND starts_with(fk, lower(root_path) || '/') GROUP BY ALL)"""


@query(
    "l5_locate_browser_profiles",
    f"""WITH {BROWSER_SQL} SELECT g.volume_id, b AS browser_name, path AS profile_path, list_last(string_split(path, '/')) AS profile_name, ev AS evidence, companions, n = 1 AS partial, owner_id, owner_id IS NULL AS portable,
      'browser-profile-' || substr(sha256(g.volume_id || chr(0) || b || chr(0) || path), 1, 24) AS browser_profile_id FROM g LEFT JOIN o USING (volume_id, b, fk)""",
)
def l5(spark, sf):
    out = op.locate_browser_profiles(view(spark, sf, "entries"), _strict(spark, sf))[0]
    return out.drop("browser_family").withColumn("evidence", F.array_join("evidence", "|"))


@query(
    "l5_profile_companions",
    f"""WITH {BROWSER_SQL} SELECT entry_id, 'browser-profile-' || substr(sha256(s.volume_id || chr(0) || s.b || chr(0) || path), 1, 24) AS browser_profile_id
    FROM s JOIN g ON g.volume_id = s.volume_id AND g.b = s.b AND g.fk = lower(s.folder)""",
)
def l5_companions(spark, sf):
    return op.locate_browser_profiles(view(spark, sf, "entries"))[1]


SOFT_SQL = f"""{ENTRIES}, {ROOTS_SQL}, en AS (SELECT *, {K} AS k FROM entries),
    md AS (SELECT k, arg_max('My_App ' || (ord % 5), ord) AS name, arg_max(struct_pack(v := CASE WHEN ord % 2 = 0 THEN '1.' || (ord % 3) END), ord).v AS ver FROM en WHERE mime_type = 'application/pdf' GROUP BY k),
    ct AS (SELECT k, arg_max(CASE WHEN ord % 2 = 0 THEN 'software/code/databases' ELSE 'media' END, ord) AS cat FROM en WHERE mime_type <> 'text/plain' GROUP BY k),
    ow AS (SELECT entry_id, arg_min(r.owner_id, (r.ord, r.owner_id)) AS pid FROM en JOIN r ON starts_with(en.k, lower(root_path) || '/') GROUP BY 1),
    j AS (SELECT en.*, name, ver, cat, pid, string_split(en.k, '/') AS p, list_last(string_split(replace(display_path, '\\', '/'), '/')) AS leaf FROM en LEFT JOIN md USING (k) LEFT JOIN ct USING (k) LEFT JOIN ow ON ow.entry_id = en.entry_id),
    c AS (SELECT *, CASE WHEN name IS NOT NULL THEN 'uninstall_registry' WHEN k LIKE 'program files/windowsapps/%' THEN 'store_package' WHEN k LIKE 'program files/%' AND regexp_matches(k, '[.](exe|dll)$') THEN 'application_directory'
      WHEN pid IS NOT NULL AND k LIKE '%.exe' THEN 'portable_app' END AS kind FROM j),
    n AS (SELECT *, CASE kind WHEN 'uninstall_registry' THEN name WHEN 'store_package' THEN split_part(p[3], '_', 1) WHEN 'application_directory' THEN p[least(len(p), 3)] ELSE leaf[:-5] END AS nm,
      CASE kind WHEN 'uninstall_registry' THEN ver WHEN 'store_package' THEN nullif(split_part(p[3], '_', 2), '') END AS vr,
      CASE kind WHEN 'uninstall_registry' THEN display_path WHEN 'store_package' THEN array_to_string(p[1:3], '/') WHEN 'application_directory' THEN array_to_string(p[1:least(len(p), 3)], '/')
        ELSE regexp_replace(display_path, '/[^/]*$', '') END AS rt FROM c),
    q AS (SELECT *, regexp_replace(trim(regexp_replace(lower(nm), '[_-]', ' ', 'g')), '\\s+', ' ', 'g') || '||' || coalesce(vr, '') AS key FROM n WHERE kind IS NOT NULL AND (cat IS NULL OR cat <> 'media'))"""


def _software(spark, sf):
    meta = lookup(
        spark,
        sf,
        """named_struct('display_name', 'My_App ' || (ord % 5), 'publisher', CAST(NULL AS STRING), 'version', CASE WHEN ord % 2 = 0 THEN '1.' || (ord % 3) END,
          'install_time', CAST(NULL AS STRING), 'install_location', ' ')""",
        "mime_type = 'application/pdf'",
    )
    cats = lookup(spark, sf, "array(CASE WHEN ord % 2 = 0 THEN 'software/code/databases' ELSE 'media' END)", "mime_type <> 'text/plain'")
    return op.software_inventory(view(spark, sf, "entries"), meta, cats, _strict(spark, sf))


@query(
    "l6_software_inventory",
    f"""WITH {SOFT_SQL} SELECT 'software-' || substr(sha256(key), 1, 24) AS inventory_id, arg_min(nm, ord) AS name, split_part(key, '|', 1) AS normalized_name, max(vr) AS version,
      count(*) AS evidence_count, count(DISTINCT rt) AS root_count, bool_and(kind <> 'uninstall_registry') AS complete FROM q GROUP BY key""",
)
def l6(spark, sf):
    return _software(spark, sf)[0].drop("publisher", "install_time")


@query(
    "l6_software_evidence",
    f"""WITH {SOFT_SQL} SELECT 'software-' || substr(sha256(key), 1, 24) AS inventory_id, entry_id, kind, rt AS install_root, CASE kind WHEN 'portable_app' THEN pid END AS profile_id FROM q""",
)
def l6_evidence(spark, sf):
    return _software(spark, sf)[1]


@query(
    "l6_software_warnings",
    f"""WITH {SOFT_SQL} SELECT DISTINCT CASE WHEN kind IS NULL THEN 'false_positive_folder:' ELSE 'non_software_category:' END || display_path AS warning FROM n
    WHERE (kind IS NULL AND k LIKE 'program files/%' AND NOT regexp_matches(k, '[.](exe|dll)$')) OR (kind IS NOT NULL AND cat = 'media')""",
)
def l6_warnings(spark, sf):
    return _software(spark, sf)[2]


BLOCK_KIND = "CASE doc_id % 7 WHEN 0 THEN 'EB52904E54465320202020' WHEN 1 THEN 'EB3C90464154' WHEN 2 THEN 'EB769045584641542020205354414C45' ELSE '' END"


@query(
    "l7_scan_blocks",
    f"""WITH b AS (SELECT doc_id * 4096 AS off, doc_id % 7 AS k, from_hex({BLOCK_KIND}) || encode(text) AS bytes, text FROM documents WHERE doc_id % 7 < 3),
    p AS (SELECT n_nationkey * 200000 AS s, n_nationkey * 200000 + 90000 AS t FROM nation),
    o AS (SELECT b.*, EXISTS (SELECT 1 FROM p WHERE off >= s AND off < t) AS ov FROM b),
    c AS (SELECT *, CASE k WHEN 0 THEN 'ntfs' WHEN 1 THEN 'fat' ELSE 'exfat' END AS signature, CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.85 END - CASE WHEN ov THEN 0.25 ELSE 0 END - CASE WHEN k = 2 THEN 0.35 ELSE 0 END AS conf FROM o)
    SELECT off AS offset_bytes, signature, round(conf, 2) AS confidence, CASE WHEN k = 2 THEN 'stale' WHEN ov THEN 'overlap' ELSE 'candidate' END AS status,
      concat_ws('|', CASE WHEN ov THEN 'overlaps_current_partition' END, CASE WHEN k = 2 THEN 'stale_signature' END) AS warnings, NOT (ov AND round(conf, 2) < 0.75) AS scheduled FROM c""",
)
def l7(spark, sf):
    blocks = run_sql(
        spark, sf, f"SELECT doc_id * 4096 AS offset_bytes, concat(unhex({BLOCK_KIND}), CAST(text AS BINARY)) AS block FROM {{documents}}"
    )
    partitions = run_sql(
        spark, sf, "SELECT n_name AS slot, CAST(n_nationkey AS BIGINT) * 200000 AS offset_bytes, 90000 AS length_bytes FROM {nation}"
    )
    out = op.scan_blocks(blocks, partitions, 1 << 40)
    return out.select(
        "offset_bytes", "signature", "confidence", "status", F.array_join("warnings", "|").alias("warnings"), "scheduled"
    )
