"""Details of Android files and packages, by hand."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import node_rules
from tracewell.operators import android, attributes

# path: detail in legacy mode, in refined mode
FILES = {
    None: ("unknown", "unknown"),
    "/": ("root", "root"),
    "/data/data": ("data_data_root", "data_data_root"),
    "/proc/71/cmdline": ("cmdline", "cmdline"),
    "/proc/71/net/tcp": ("net", "net_tcp"),
    "/proc/net/xt_qtaguid/iface_stat_fmt": ("net", "net_xt_qtaguid_iface_stat"),
    "/proc/net/xt_qtaguid/ctrl": ("net", "net_xt_qtaguid_ctrl"),
    "/proc/8/task/9/stat": ("task_stat", "task_stat"),
    "/proc/8/fd/77": ("fd", "fd"),
    "/dev/null": ("null_device", "dev_other"),
    "/dev/input/event0": ("device", "dev_input"),
    "/dev/kgsl-3d0": ("device", "dev_kgsl"),
    "/dev/socket/netd": ("socket", "socket_netd"),
    "/dev/socket/fwmarkd": ("fwmarkd", "socket_fwmarkd"),
    "/system/priv-app/Old--Phone/Old.APK": ("apk", "system_priv_app_old_phone_apk"),
    "/data/app/vmdl55.tmp/base.apk": ("apk", "data_app_vmdl_base_apk"),
    "/data/local/tmp/fennec-9.apk": ("apk", "tmp_org_mozilla_apk"),
    "/tmp/fennec/x.apk": ("apk", "tmp_apk"),
    "/mnt/y.apk": ("apk", "apk_other"),
    "/data/app/vmdl55.tmp/lib/": ("vmdl_tmp_lib", "vmdl_tmp_lib"),
    "/data/app/org.mozilla.fennec_firefox_dev-1/lib": ("org_mozilla_lib", "org_mozilla_lib"),
    "/system/media/audio/ui/lock.ogg": ("system_file", "system_media_ui"),
    "/system/firmware/a.bin": ("system_firmware", "system_file"),
    "/vendor/etc/a.conf": ("vendor_etc", "vendor_etc"),
    "/system/lib/hw/gps.so": ("hardware_lib", "hardware_lib"),
    "/system/lib/libwebviewchromium.so": ("webview_lib", "webview_lib"),
    "/data/data/com.android.email/files/body/1/7.html": ("email_body", "email_body_html"),
    "/data/data/com.shop/databases/a.db": ("app_private", "com_shop_databases"),
    "/data/data/com.shop-2/shared-prefs": ("app_private", "com_shop_shared_prefs"),
    "/data/data/com.google.maps/notes": ("app_private", "com_google_maps_app_private"),
    "/data/data/com.shop/app_webview": ("app_private", "com_shop_app_webview"),
    "/data/data/org.mozilla.fennec_firefox_dev/cache/cache2/entries/ab12": ("org_mozilla_cache", "fennec_firefox_dev_entries_hexblob"),
    "/data/data/org.mozilla.focus/cache/x": ("org_mozilla_cache", "org_mozilla_focus_cache"),
    "/data/data/com.android.camera2/cache/image_manager_disk_cache/q": ("com_android_camera2_cache", "camera2_image_manager_disk_cache_mixedid"),
    "/data/data/app/cache/x": ("app_cache", "app_cache"),
    "/storage/emulated/0/Android/data/com.mail/cache/a.eml": ("email_eml", "email_eml"),
    "/storage/emulated/0/android/data/app/cache/b": ("external_cache", "external_cache"),
    "/storage/emulated/0/android/data/org.mozilla.focus/cache/b": ("org_mozilla_cache", "org_mozilla_cache"),
    "/storage/emulated/0/android/data/org.mozilla.focus/files/Download/b": ("org_mozilla_download", "org_mozilla_download"),
    "/storage/emulated/0/DCIM/camera/1.JPG": ("camera_image", "camera_image"),
    "/storage/emulated/0/alarms/": ("alarms_dir", "alarms_dir"),
    "/data/system/dropbox/drop9.tmp": ("dropbox_tmp", "dropbox_tmp"),
    "/data/system/users/0/accounts.db": ("accounts_db", "accounts_db"),
    "/data/system/sync/accounts.xml": ("sync_state", "sync_state"),
    "/data/backup/pending/": ("backup_pending", "backup_pending"),
    "/data/tombstones/tombstone_03": ("tombstone_03", "tombstone_03"),
    "/data/misc/wifi/wpa.conf": ("wifi_config", "wifi_config"),
    "/sys/class/net": ("sys_class", "sys_class"),
    "/opt/anything": ("other", "other"),
}
# command line: class and detail in legacy mode, in refined mode
PROCESSES = {
    None: ("unknown unknown", "unknown unknown"),
    "  ": ("unknown unknown", "unknown unknown"),
    "com.android.providers.media": ("providers media", "providers media"),
    "com.android.email": ("com_android email", "com_android email"),
    "com.google.android.gms:snet": ("unknown unknown", "com_google android_gms_snet"),
    "android.process.acore": ("android_process acore", "android_process acore"),
    "org.mozilla.fennec": ("org_mozilla fennec", "org_mozilla fennec"),
    "com.shop.My_App": ("com_other shop_my_app", "com_other shop_my_app"),
    "net.tool.run": ("package_other net_tool_run", "package_other net_tool_run"),
    "a..b": ("unknown unknown", "package_other a_b"),
    "kworker/0:1": ("unknown unknown", "native_process kworker_0_1"),
    "zygote": ("native_process zygote", "native_process zygote"),
    "app_process64": ("native_process app_process64", "native_process app_process64"),
    "sh -c id": ("unknown unknown", "native_process sh"),
    ":remote": ("native_process remote", "unknown remote"),
}


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("file", p, None, None) for p in FILES] + [("process", None, c, None) for c in PROCESSES] + [("netflow", None, None, a) for a in ("10.1.2.3", "::ffff:10.0.0.9", "2001:db8::2", "<unnamed fd:4>", "::", None)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "node_id long, kind string, path string, cmd string, src_addr string").withColumn("dst_addr", F.lit("1.2.3.4"))


@pytest.mark.parametrize("place,mode", list(enumerate(android.MODES)))
def test_files_and_processes(spark, nodes, place, mode):
    classes = attributes.node_classes(nodes, *node_rules.tables(spark))
    files = {r.path: r.detail for r in android.file_details(classes, mode).collect()}
    assert files == {p or "": d[place] for p, d in FILES.items()}
    assert {r.cmd: f"{r['class']} {r.detail}" for r in android.process_details(nodes, mode).collect()} == {c: d[place] for c, d in PROCESSES.items()}
    tokens = {r.node_id: r.tokens for r in android.natural_tokens(nodes, classes, mode).collect()}
    assert len(tokens) == nodes.count() and {len(t) for i, t in tokens.items()} == {1, 3} and tokens[0] == ["file", "unknown_file", "unknown"]
    assert android.natural_tokens(nodes.limit(0), classes.limit(0), mode).count() == 0


def test_sources_only_for_an_audit(spark, nodes):
    classes = attributes.node_classes(nodes, *node_rules.tables(spark))
    plain, kept = ({r.node_id: r.tokens for r in android.natural_tokens(nodes, classes, keep_source=k).where("kind = 'netflow'").collect()} for k in (False, True))
    assert set(map(tuple, plain.values())) == {("netflow",)}
    assert [kept[i][1] for i in sorted(kept)] == ["src_10_1_2_3", "src_10_0_0_9", "src_2001_db8_2", "remote_unknown", "remote_unknown", "remote_unknown"]


def test_sentences(spark):
    flow = spark.createDataFrame([("h", 1, "EVENT_WRITE", 1, 2), ("h", 2, "Clone!", 1, 1), ("h", 3, "EVENT_READ", 9, 1)], "host string, event_id long, action string, info_src long, info_dst long")
    words = spark.createDataFrame([(1, ["process", "com_other", "shop"]), (2, ["netflow"])], "node_id long, tokens array<string>")
    got = {r.event_id: r.sentence for r in android.sentences(flow, words).collect()}
    assert got == {1: "process com_other shop event event_write netflow", 2: "process com_other shop event event_clone process com_other shop"}
    assert all(android.rule_rows(m) and {r[1] for r in android.rule_rows(m) if r[2] == "any"} == {r[1] for r in android.rule_rows(m)} for m in android.MODES)
    with pytest.raises(ValueError):
        android.process_class(F.col("cmd"), "newest")
