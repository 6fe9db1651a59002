"""Details of Android files, as ordered tables of rules: within a class, the first rule that fits gives the detail.

Names of payloads of evaluated attacks are left out on purpose; users extend the engine by adding rows.
"""

from __future__ import annotations

# A package's class and how its name starts.
PACKAGES = (
    ("providers", "com.android.providers."),
    ("com_android", "com.android."),
    ("android_process", "android.process."),
    ("org_mozilla", "org.mozilla."),
    ("com_google", "com.google."),
    ("com_other", "com."),
)
#: how a family's package starts; the family keeps it, with _ for dots, before the rest
FAMILIES = ("org.mozilla.", "com.android.", "com.google.", "com.")
FENNEC = "fennec_firefox_dev"

# Class, how a path is compared, value, detail. is, start, end, has, match: the path; name, namestart, nameend,
# namematch: its last part; folder: whether it ends in the value, slashes aside; kin: family, blank and path; sub: the part below the package's
# folder; any: always. {family}, {name} and {app} stand for the path's own.
LEGACY = (
    ("unknown_file", "any", "", "unknown"),
    ("proc_cmdline", "any", "", "cmdline"),
    ("android_app_cache_file", "any", "", "{family}_cache"),
    ("android_app_private_file", "has", "/files/body/", "email_body"),
    ("android_app_private_file", "folder", "/shared_files", "shared_files"),
    ("android_app_private_file", "has", "/shared_files/", "shared_files"),
    ("android_app_private_file", "has", "csb.tracee.", "tracee_file"),
    ("android_app_private_file", "any", "", "app_private"),
    ("android_external_app_cache_file", "nameend", ".eml", "email_eml"),
    ("android_external_app_cache_file", "kin", "^app ", "external_cache"),
    ("android_external_app_cache_file", "any", "", "{family}_cache"),
    ("android_user_media_file", "nameend", ".tc-md", "camera_metadata"),
    ("android_user_media_file", "nameend", ".jpg", "camera_image"),
    ("android_user_media_file", "nameend", ".jpeg", "camera_image"),
    ("android_user_media_file", "nameend", ".png", "camera_image"),
    ("android_user_media_file", "any", "", "user_media"),
    ("android_user_storage_file", "end", "contacts.vcf.tc-md", "contacts_metadata"),
    ("android_user_storage_file", "kin", "^org_mozilla .*/files/download", "org_mozilla_download"),
    ("android_user_storage_file", "kin", "^org_mozilla .*/files/temp", "org_mozilla_temp"),
    ("android_user_storage_file", "folder", "/alarms", "alarms_dir"),
    ("android_user_storage_file", "folder", "/podcasts", "podcasts_dir"),
    ("android_user_storage_file", "any", "", "user_storage"),
    ("android_tmp_file", "any", "", "tmp_file"),
    ("android_app_install_file", "match", "/vmdl[0-9]+[.]tmp/lib/?$", "vmdl_tmp_lib"),
    ("android_app_install_file", "match", "/vmdl[0-9]+[.]tmp", "vmdl_tmp"),
    ("android_app_install_file", "match", "org[.]mozilla[.]fennec_firefox_dev.*/lib/*$", "org_mozilla_lib"),
    ("android_app_install_file", "any", "", "app_install"),
    ("android_dalvik_cache_file", "has", "boot.oat", "boot_oat"),
    ("android_dalvik_cache_file", "has", "data@app@", "app_dex_cache"),
    ("android_dalvik_cache_file", "nameend", ".dex", "app_dex_cache"),
    ("android_dalvik_cache_file", "any", "", "dalvik_cache"),
    ("native_library_file", "start", "/system/lib/hw/", "hardware_lib"),
    ("native_library_file", "match", "^/system/lib/.*webviewchromium", "webview_lib"),
    ("native_library_file", "start", "/system/lib/", "system_lib"),
    ("native_library_file", "has", "/data/app/", "app_lib"),
    ("native_library_file", "any", "", "native_lib"),
    ("android_system_dropbox_file", "namestart", "system_app_anr@", "system_app_anr"),
    ("android_system_dropbox_file", "namestart", "system_server_lowmem@", "system_server_lowmem"),
    ("android_system_dropbox_file", "namematch", "^drop.*[.]tmp$", "dropbox_tmp"),
    ("android_system_dropbox_file", "any", "", "dropbox_log"),
    ("android_recent_task_file", "nameend", ".bak", "task_backup"),
    ("android_recent_task_file", "any", "", "task_xml"),
    ("android_recent_image_file", "any", "", "thumbnail"),
    ("android_procstats_file", "nameend", ".bin", "state_bin"),
    ("android_procstats_file", "any", "", "procstats"),
    ("android_usagestats_file", "any", "", "daily"),
    ("android_user_state_file", "name", "settings_system.xml", "settings_system"),
    ("android_user_state_file", "name", "settings_secure.xml", "settings_secure"),
    ("android_user_state_file", "name", "settings_global.xml.bak", "settings_global_backup"),
    ("android_user_state_file", "name", "accounts.db", "accounts_db"),
    ("android_user_state_file", "name", "runtime-permissions.xml", "runtime_permissions"),
    ("android_user_state_file", "name", "package-restrictions.xml", "package_restrictions"),
    ("android_user_state_file", "name", "wallpaper_info.xml", "wallpaper_info"),
    ("android_user_state_file", "any", "", "user_state"),
    ("android_system_state_file", "name", "packages.xml", "packages_xml"),
    ("android_system_state_file", "has", "/sync/accounts.xml", "sync_state"),
    ("android_system_state_file", "name", "locksettings.db", "locksettings_db"),
    ("android_system_state_file", "any", "", "system_state"),
    ("android_misc_file", "has", "/shared_relro/", "shared_relro"),
    ("android_misc_file", "has", "/wifi/", "wifi_config"),
    ("android_misc_file", "has", "/bluedroid/", "bluetooth_config"),
    ("android_misc_file", "any", "", "misc_state"),
    ("android_backup_file", "has", "/pending/journal-", "backup_journal"),
    ("android_backup_file", "folder", "/pending", "backup_pending"),
    ("android_backup_file", "folder", "/fb-schedule", "backup_schedule"),
    ("android_backup_file", "any", "", "backup_state"),
    ("android_tombstone_file", "is", "/data/tombstones", "tombstone_dir"),
    ("android_tombstone_file", "any", "", "{name}"),
    ("android_socket_file", "name", "fwmarkd", "fwmarkd"),
    ("android_socket_file", "any", "", "socket"),
    ("android_device_file", "name", "null", "null_device"),
    ("android_device_file", "name", "urandom", "urandom"),
    ("android_device_file", "any", "", "device"),
    ("android_sysfs_file", "has", "/cpufreq/", "cpu_cpufreq"),
    ("android_sysfs_file", "start", "/sys/class/", "sys_class"),
    ("android_sysfs_file", "any", "", "sysfs"),
    ("android_cache_file", "is", "/cache", "cache_root"),
    ("android_cache_file", "any", "", "cache_file"),
    ("android_apk_file", "any", "", "apk"),
    ("android_policy_file", "any", "", "seapp_contexts"),
    ("android_ashmem_file", "any", "", "ashmem"),
    ("filesystem_root", "any", "", "root"),
    ("android_root_dir", "is", "/data", "data_root"),
    ("android_root_dir", "is", "/data/data", "data_data_root"),
    ("android_root_dir", "is", "/data/system", "data_system_root"),
    ("android_root_dir", "is", "/storage", "storage_root"),
    ("android_root_dir", "is", "/storage/emulated", "storage_root"),
    ("android_root_dir", "is", "/storage/emulated/0", "emulated_storage_root"),
    ("android_root_dir", "is", "/cache", "cache_root"),
    ("android_root_dir", "any", "", "root_dir"),
    ("file_other", "any", "", "other"),
    *((f"android_{top}_file", "has", f"/{top}/{part}/", f"{top}_{part}") for top in ("system", "vendor") for part in ("bin", "etc", "framework", "firmware", "lib")),
    ("android_system_file", "any", "", "system_file"),
    ("android_vendor_file", "any", "", "vendor_file"),
)
#: classes that have rules of their own here; all others keep the legacy ones
REFINED = (
    ("android_device_file", "match", "^/*dev/+graphics(/|$)", "dev_graphics"),
    ("android_device_file", "match", "^/*dev/+input(/|$)", "dev_input"),
    ("android_device_file", "match", "^/*dev/+log(/|$)", "dev_log"),
    *(("android_device_file", "name", x, f"dev_{x}") for x in ("ion", "ashmem", "pmsg0", "binder", "urandom")),
    ("android_device_file", "namestart", "kgsl", "dev_kgsl"),
    ("android_device_file", "any", "", "dev_other"),
    *(("android_socket_file", "name", x, f"socket_{x}") for x in ("logdw", "lmkd", "dnsproxyd", "netd", "zygote", "vold", "installd", "rild", "fwmarkd")),
    ("android_socket_file", "any", "", "socket_other"),
    ("android_apk_file", "match", "^/system/app/[^/]+/", "system_app_{app}_apk"),
    ("android_apk_file", "match", "^/system/priv-app/[^/]+/", "system_priv_app_{app}_apk"),
    ("android_apk_file", "match", "^/data/app/vmdl[0-9]+[.]tmp/base[.]apk$", "data_app_vmdl_base_apk"),
    ("android_apk_file", "match", "^(/data/local)?/tmp/(.*/)?[^/]*(mozilla|fennec)[^/]*$", "tmp_org_mozilla_apk"),
    ("android_apk_file", "match", "^(/data/local)?/tmp/", "tmp_apk"),
    ("android_apk_file", "any", "", "apk_other"),
    ("android_system_file", "start", "/system/media/audio/ui/", "system_media_ui"),
    ("android_system_file", "start", "/system/media/audio/notifications/", "system_media_notifications"),
    *(("android_system_file", "start", f"/system/{part}/", f"system_{part}") for part in ("fonts", "etc", "framework", "bin", "lib")),
    ("android_system_file", "any", "", "system_file"),
    ("android_app_private_file", "match", "/files/body/(.*/)?[^/]*[.]txt/*$", "email_body_txt"),
    ("android_app_private_file", "match", "/files/body/(.*/)?[^/]*[.]html/*$", "email_body_html"),
    ("android_app_private_file", "has", "/files/body/", "email_body"),
    ("android_app_private_file", "has", "/app_webview/", "{family}_app_webview"),
    ("android_app_private_file", "folder", "/app_webview", "{family}_app_webview"),
    ("android_app_private_file", "has", "/files/mozilla/", "{family}_mozilla_profile"),
    ("android_app_private_file", "match", "/data/data/[^/]+/mozilla/", "{family}_mozilla_profile"),
    ("android_app_private_file", "folder", "/shared_files", "{family}_shared_files"),
    ("android_app_private_file", "has", "/shared_files/", "{family}_shared_files"),
    ("android_app_private_file", "has", "csb.tracee.", "{family}_tracee_file"),
    *(("android_app_private_file", "sub", x, f"{{family}}_{x}") for x in ("databases", "shared_prefs", "files", "code_cache", "lib")),
    ("android_app_private_file", "any", "", "{family}_app_private"),
    ("android_app_cache_file", "kin", f"^{FENNEC} .*/cache2/doomed/", f"{FENNEC}_doomed_num"),
    ("android_app_cache_file", "kin", f"^{FENNEC} .*/cache2/entries/", f"{FENNEC}_entries_hexblob"),
    ("android_app_cache_file", "kin", f"^{FENNEC} .*safebrowsing", f"{FENNEC}_safebrowsing_cache"),
    ("android_app_cache_file", "kin", "^com_android_camera2 .*image_manager_disk_cache", "camera2_image_manager_disk_cache_mixedid"),
    ("android_app_cache_file", "any", "", "{family}_cache"),
)
MODES = ("legacy", "refined")


def rule_rows(mode: str) -> list[tuple[int, str, str, str, str]]:
    """(place, class, how, value, detail) of a mode."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    own = REFINED if mode == "refined" else ()
    mine = {r[0] for r in own}
    return [(i, *r) for i, r in enumerate((*own, *(r for r in LEGACY if r[0] not in mine)))]
