"""Semantic classes of processes and files, as ordered tables of rules: the first rule that fits gives the class.

Names of payloads of evaluated attacks are left out on purpose; users extend the engine by adding rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Class, how its values are compared, values. word: the executable's name; wordstart: its beginning; is, start,
# end, match: the path itself, its beginning, its end, a pattern; cmdstart, cmdmatch: the command line's; has: path or command
# contain it. A rule without values only names its class.
FREEBSD_PROCESS = (
    ("unknown_process", "is", ()),
    ("web_service", "word", ("nginx", "httpd", "apache")),
    ("mail_service", "word", ("imapd", "sendmail", "mail", "mail_local", "local", "smtpd", "smtp", "proxymap", "cleanup", "trivial_rewrite", "anvil", "pickup", "bounce", "postmap", "qmgr", "master", "ipop3d")),
    ("ssh_service", "wordstart", ("sshd",)),
    ("ssh_service", "word", ("ssh",)),
    ("scheduler_service", "word", ("cron", "crond", "atrun")),
    ("shell", "word", ("sh", "bash", "csh", "tcsh", "zsh")),
    ("script_interpreter", "wordstart", ("python",)),
    ("script_interpreter", "word", ("perl", "ruby", "php_fpm")),
    ("file_util", "word", ("lsof", "head", "tail", "dd", "mv", "cp", "rm", "cat", "chmod", "chown", "ln", "unlink", "mkdir", "find", "ls", "mktemp", "stat", "touch")),
    ("text_util", "word", ("grep", "egrep", "awk", "nawk", "sed", "sort", "wc", "cmp", "tee", "tr", "test", "uniq", "expr", "basename", "cut", "diff", "which")),
    ("system_monitor", "word", ("top", "vmstat", "ps", "netstat", "sockstat", "procstat")),
    ("core_util", "word", ("date", "sleep", "uname", "id", "whoami", "uptime", "hostname")),
    ("memory_util", "word", ("mlock",)),
    ("system_admin", "word", ("sysctl", "adjkerntz", "kenv", "dmesg", "newsyslog", "devd", "ntpd", "syslogd", "init", "kldstat", "lsvfs")),
    ("network_util", "word", ("route", "ifconfig", "dhclient", "ping", "inetd")),
    ("firewall_util", "word", ("pfctl", "ipfw", "ipfstat")),
    ("network_client", "word", ("wget", "links")),
    ("package_manager", "word", ("pkg",)),
    ("privilege_util", "word", ("sudo", "su")),
    ("filesystem_admin", "word", ("mount", "df")),
    ("process_control", "word", ("kill", "pwait")),
    ("compression_util", "word", ("bzcat", "bzip2", "xz")),
    ("user_interactive", "word", ("resizewin", "fortune", "alpine", "screen", "less", "msgs", "tty")),
)
FREEBSD_FILE = (
    ("filesystem_root", "is", ("/",)),
    ("freebsd_root_dir", "is", ("/bin", "/boot", "/dev", "/etc", "/home", "/lib", "/proc", "/root", "/sbin", "/tmp", "/usr", "/var")),
    ("tmp_file", "start", ("/tmp/",)),
    ("system_log_file", "start", ("/var/log/",)),
    ("var_state_file", "start", ("/var/",)),
    ("system_config_file", "start", ("/etc/",)),
    ("device_file", "start", ("/dev/",)),
    ("ports_tree_file", "start", ("/usr/ports/",)),
    ("usr_local_file", "start", ("/usr/local/",)),
    ("system_binary_file", "start", ("/usr/bin/",)),
    ("system_sbin_file", "start", ("/usr/sbin/",)),
    ("system_library_file", "start", ("/usr/lib/",)),
    ("system_share_file", "start", ("/usr/share/",)),
    ("user_home_file", "start", ("/usr/home/", "/home/")),
    ("usr_file", "start", ("/usr/",)),
    ("core_binary_file", "start", ("/bin/",)),
    ("system_sbin_file", "start", ("/sbin/",)),
    ("core_library_file", "start", ("/lib/",)),
    ("ufs_mirror_file", "start", ("/data/ufs/",)),
    ("update_build_file", "start", ("/data/update/",)),
    ("data_file", "start", ("/data/",)),
    ("web_mirror_file", "start", ("www.", "http")),
    ("native_library_file", "end", (".so",)),
)
LINUX_PROCESS = (
    ("unknown_process", "is", ()),
    ("kernel_thread", "word", ("0", "swapper")),
    ("kernel_thread", "has", ("swapper",)),
    ("kernel_thread", "wordstart", ("kworker", "kthreadd", "flush", "swapper")),
    ("scheduler_service", "word", ("cron", "anacron", "run_parts")),
    ("network_service", "wordstart", ("dhclient",)),
    ("admin_tool", "word", ("sudo", "logrotate", "mount", "umount", "sysctl")),
    ("system_daemon", "word", ("dbus_daemon", "cupsd", "init", "systemd", "console_kit_daemon")),
    ("shell", "word", ("bash", "dash", "sh", "zsh", "csh", "tcsh")),
    ("interpreter", "word", ("python", "python2", "python2_7", "python3", "perl", "ruby")),
    ("browser", "word", ("firefox", "mozilla", "plugin_container")),
    ("browser", "has", ("firefox",)),
    ("mail_client", "word", ("thunderbird",)),
    ("ssh_service", "word", ("sshd", "ssh", "scp", "sftp")),
    ("database_process", "word", ("postgres", "postmaster", "psql")),
    ("database_process", "has", ("postgresql",)),
    ("package_manager", "word", ("apt", "apt_get", "apt_config", "dpkg", "pkg", "yum", "rpm")),
    ("audio_service", "word", ("pulseaudio", "pulseaudio_kde", "speech_dispatcher")),
    ("update_notifier", "word", ("update_notifier", "update_manager")),
    ("desktop_env", "word", ("fluxbox", "gnome_terminal", "unity_2d_shell", "unity_2d_panel")),
    ("core_util", "word", ("stat", "uname", "grep", "sed", "sort", "cut", "basename", "dirname")),
    ("core_util", "word", ("awk", "gawk", "ls", "sync", "top", "ps", "cat", "readlink")),
    ("browser_helper", "word", ("chrome", "chromium")),
    ("system_user_bin", "start", ("/usr/bin/",)),
    ("system_helper", "start", ("/usr/lib/", "/usr/sbin/", "/sbin/")),
    ("core_binary", "start", ("/bin/", "/lib/")),
)
LINUX_FILE = (
    ("filesystem_root", "is", ("/",)),
    ("linux_root_dir", "is", ("/bin", "/boot", "/cdrom", "/data", "/dev", "/etc", "/lib", "/lost+found", "/proc", "/root", "/sbin", "/tmp", "/usr", "/var", "/home", "/run")),
    ("proc_cmdline", "match", ("^/proc/[0-9]+/cmdline$",)),
    ("proc_file", "start", ("/proc/",)),
    ("pseudo_proc_file", "match", ("^/[0-9]+(/|$)",)),
    ("browser_cache_file", "has", ("/.cache/mozilla/", "/cache2/entries/")),
    ("browser_profile_file", "start", ("/home/admin/.mozilla/",)),
    ("user_download_file", "start", ("/home/admin/downloads/",)),
    ("user_home_file", "start", ("/home/",)),
    ("shared_memory_file", "start", ("/run/shm/",)),
    ("runtime_state_file", "start", ("/run/",)),
    ("tmp_file", "start", ("/tmp/",)),
    ("replay_log_file", "start", ("/data/replay_logdb/",)),
    ("database_state_file", "start", ("/var/lib/postgresql/",)),
    ("system_cache_file", "start", ("/var/cache/",)),
    ("system_log_file", "start", ("/var/log/",)),
    ("var_state_file", "start", ("/var/",)),
    ("system_config_file", "start", ("/etc/",)),
    ("native_library_file", "end", (".so",)),
    ("system_binary_file", "start", ("/usr/bin/",)),
    ("system_library_file", "start", ("/usr/lib/",)),
    ("system_share_file", "start", ("/usr/share/",)),
    ("usr_file", "start", ("/usr/",)),
    ("core_binary_file", "start", ("/bin/",)),
    ("core_library_file", "start", ("/lib/",)),
    ("system_sbin_file", "start", ("/sbin/",)),
    ("device_file", "start", ("/dev/",)),
    ("sysfs_file", "start", ("/sys/",)),
    ("root_home_file", "start", ("/root/",)),
    ("boot_file", "start", ("/boot/",)),
    ("relative_or_special_file", "match", ("^[^/]",)),
)
ANDROID_PROCESS = (
    ("unknown", "is", ()),
    ("providers", "cmdstart", ("com.android.providers.",)),
    ("com_android", "cmdstart", ("com.android.",)),
    ("android_process", "cmdstart", ("android.process.",)),
    ("org_mozilla", "cmdstart", ("org.mozilla.",)),
    ("com_google", "cmdstart", ("com.google.",)),
    ("com_other", "cmdstart", ("com.",)),
    ("package_other", "cmdmatch", ("[.]",)),
)
ANDROID_FILE = (
    ("android_apk_file", "end", (".apk",)),
    ("native_library_file", "end", (".so",)),
    ("android_app_cache_file", "match", ("^/data/data/[^/]+/cache(/|$)",)),
    ("android_app_private_file", "match", ("^/data/data/[^/]+(/|$)",)),
    ("android_external_app_cache_file", "match", ("^/storage/emulated/0/android/data/[^/]+/cache(/|$)",)),
    ("android_user_media_file", "start", ("/storage/emulated/0/dcim/", "/data/media/0/dcim/")),
    ("android_user_storage_file", "start", ("/storage/emulated/0/",)),
    ("android_tmp_file", "start", ("/data/local/tmp/",)),
    ("android_app_install_file", "start", ("/data/app/",)),
    ("android_dalvik_cache_file", "start", ("/data/dalvik-cache/",)),
    ("android_misc_file", "start", ("/data/misc/",)),
    ("android_backup_file", "start", ("/data/backup/",)),
    ("android_tombstone_file", "start", ("/data/tombstones",)),
    ("android_recent_task_file", "start", ("/data/system/recent_tasks/",)),
    ("android_recent_image_file", "start", ("/data/system/recent_images/",)),
    ("android_system_dropbox_file", "start", ("/data/system/dropbox/",)),
    ("android_procstats_file", "start", ("/data/system/procstats/",)),
    ("android_usagestats_file", "start", ("/data/system/usagestats/",)),
    ("android_user_state_file", "start", ("/data/system/users/",)),
    ("android_system_state_file", "start", ("/data/system/",)),
    ("proc_cmdline", "match", ("^/proc/[0-9]+/cmdline$",)),
    ("proc_file", "start", ("/proc/",)),
    ("android_system_file", "is", ("/system",)),
    ("android_system_file", "start", ("/system/",)),
    ("android_vendor_file", "is", ("/vendor",)),
    ("android_vendor_file", "start", ("/vendor/",)),
    ("android_socket_file", "start", ("/dev/socket/",)),
    ("android_device_file", "start", ("/dev/",)),
    ("android_sysfs_file", "start", ("/sys/",)),
    ("android_cache_file", "start", ("/cache/",)),
    ("android_ashmem_file", "is", ("/ashmem",)),
    ("android_policy_file", "is", ("/seapp_contexts",)),
    ("filesystem_root", "is", ("/",)),
    ("android_root_dir", "is", ("/data", "/data/data", "/data/system", "/storage", "/storage/emulated", "/storage/emulated/0", "/cache")),
)
#: (system, kind): rules, class if none fits, class if there is nothing to look at
SYSTEMS = {
    ("freebsd", "process"): (FREEBSD_PROCESS, "process_other", "unknown_process"),
    ("freebsd", "file"): (FREEBSD_FILE, "file_other", "file"),
    ("linux", "process"): (LINUX_PROCESS, "process_other", "unknown_process"),
    ("linux", "file"): (LINUX_FILE, "file_other", "unknown_file"),
    ("android", "process"): (ANDROID_PROCESS, "native_process", "unknown"),
    ("android", "file"): (ANDROID_FILE, "file_other", "unknown_file"),
}


def rule_rows() -> list[tuple[str, str, int, str, str, str]]:
    """(system, kind, place, how, value, class)."""
    return [(system, kind, place, how, v, label) for (system, kind), (rules, _, _) in SYSTEMS.items() for place, (label, how, values) in enumerate(rules) for v in values]


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Rules and, for each system and kind, the classes of what no rule fits and of what has no attribute; users pass their own."""
    rules = spark.createDataFrame(rule_rows(), "system string, kind string, place int, how string, value string, label string")
    return rules, spark.createDataFrame([(s, k, other, nothing) for (s, k), (_, other, nothing) in SYSTEMS.items()], "system string, kind string, other string, nothing string")


def rules_sql() -> str:
    rows = ", ".join("({})".format(", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r)) for r in rule_rows())
    return f"SELECT system, kind, place, how, value, label FROM (VALUES {rows}) r(system, kind, place, how, value, label)"


def defaults_sql() -> str:
    rows = ", ".join(f"('{s}', '{k}', '{other}', '{nothing}')" for (s, k), (_, other, nothing) in SYSTEMS.items())
    return f"SELECT system, kind, other, nothing FROM (VALUES {rows}) d(system, kind, other, nothing)"
