"""Detail tokens of nodes, by hand."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import node_rules
from tracewell.operators import attributes, details

FILES = {
    "freebsd": {
        None: "unknown", " NULL ": "unknown", "/": "root", "/etc": "etc_root", "/etc/Rc.Conf": "rc_conf", "/usr/home/ann/notes/readme.md": "notes_readme_md", "/proc/12/task/7/stat": "stat", "/proc/9/": "proc",
        "/tmp//x y-z": "x_y_z", "/data/77/index": "index", "/var/log/": "var_log",
    },
    "linux": {
        None: "unknown", "/": "root", "/home": "home_root", "/proc/12/cmdline": "cmdline", "/proc/12/fd/3": "fd", "/proc/12/task/7/stat": "task_stat", "/proc/12/maps": "maps", "/proc/sys/kernel/osrelease": "osrelease",
        "/home/admin/src/": "admin_src", "0": "swapper", "/tmp/...": "unknown",
    },
}
PROCESSES = {
    "freebsd": {(None, "python -u /opt/jobs/sync.py --fast"): "sync_py", (None, "/bin/sh -c 'echo hello'"): "echo_hello", (None, "-csh"): "csh", ("/sbin/init", None): "system_admin", (None, "vi /etc/hosts"): "vi", (None, "none"): "process_other", (None, None): "unknown"},
    "linux": {("/usr/bin/perl", "perl a=/b > /tmp/o.txt /srv/run.pl"): "o_txt", ("/usr/sbin/cupsd", None): "cupsd", ("/sbin/dhclient3", "dhclient3 eth0"): "dhclient", (None, "[kworker/0:1]"): "0_1", ("swapper", "0"): "swapper", (None, "bash"): "bash", (None, "bash 'oops"): "oops"},
}


def nodes(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "node_id long, kind string, path string, cmd string, dst_addr string, dst_port string, src_addr string")


@pytest.mark.parametrize("system", details.SYSTEMS)
def test_files_and_processes(spark, system):
    df = nodes(spark, [("file", p, None, None, None, None) for p in FILES[system]] + [("process", *pc, None, None, None) for pc in PROCESSES[system]])
    classes = attributes.node_classes(df, *node_rules.tables(spark)).persist()
    assert {r.path: r.detail for r in details.file_details(classes, system).collect()} == {p or "": d for p, d in FILES[system].items()}
    found = {(r.path, r.cmd): r.detail for r in details.process_details(df, classes, system).collect()}
    assert found == {(p or "", c or ""): d for (p, c), d in PROCESSES[system].items()}
    tokens = {r.node_id: r.tokens for r in details.natural_tokens(df, classes, system).collect()}
    assert len(tokens) == df.count() and all(len(t) == 3 for t in tokens.values()) and tokens[0][0] == "file"
    assert details.natural_tokens(df.limit(0), classes.limit(0), system).count() == 0


def test_netflows(spark):
    rows = [
        ("128.55.12.9", "22", None), ("10.1.2.3", "8080", None), ("172.32.0.1", "65535", None), ("127.0.0.1", "70000", None), ("0.0.0.0", "0", "10.0.0.5"), ("", "x", "localhost"), (None, None, None), ("300.1.1.1", "5", None),
        ("::1", "443", None), ("2001:DB8::2", "443", None),
    ]
    df = nodes(spark, [("netflow", None, None, a, p, s) for a, p, s in rows])
    got = {s: {r.node_id: (r.role, r.tokens) for r in details.netflow_roles(df, s).collect()} for s in details.SYSTEMS}
    both = [
        ("net|ip_internal_env|port_system", ["netflow", "ip_internal_env", "128_55_12_9"]), ("net|ip_private|port_registered", ["netflow", "ip_private", "10_1_2_3"]), ("net|ip_public_or_external|port_ephemeral", ["netflow", "ip_public_or_external", "172_32_0_1"]),
        ("net|ip_loopback|port_invalid", ["netflow", "ip_loopback", "127_0_0_1"]), ("net|ip_unknown_or_zero|port_unknown_or_zero", ["netflow", "src_10_0_0_5"]), ("net|ip_unknown_or_zero|port_unknown_or_zero", ["netflow", "src_local"]),
        ("net|ip_unknown_or_zero|port_unknown_or_zero", ["netflow"]), ("net|ip_unknown_or_zero|port_system", ["netflow"]),
    ]
    for system in details.SYSTEMS:
        assert [got[system][i] for i in range(8)] == both
    assert got["freebsd"][8] == ("net|ip_loopback|port_system", ["netflow", "ip_loopback", "__1"]) and got["freebsd"][9][1] == ["netflow", "ip_public_or_external", "2001_db8__2"]
    assert [got["linux"][i] for i in (8, 9)] == [("net|ip_unknown_or_zero|port_system", ["netflow"])] * 2


def test_details_reach_the_word_vectors(spark):
    from tracewell.operators.learning import sentences

    df = nodes(spark, [("process", None, "sh /opt/a.sh", None, None, None), ("file", "/etc/hosts", None, None, None, None)])
    words = details.natural_tokens(df, attributes.node_classes(df, *node_rules.tables(spark)), "linux")
    flow = spark.createDataFrame([(0, 1, "EVENT_WRITE")], "info_src long, info_dst long, action string")
    assert [r.words for r in sentences(flow, words).collect()] == [["process", "shell", "a_sh", "event_write", "file", "system_config_file", "hosts"]]
    assert df.select(details.token(F.lit("  A\tb--c_ "))).first()[0] == "a_b_c"
