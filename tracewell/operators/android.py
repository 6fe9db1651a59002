"""Details of Android files and packages beside their classes, in two modes, and sentences of events made of them.

``legacy`` tells a package's name as a whole and most files by what they are for; ``refined`` also reads a process's part after
a colon, sockets, devices, /proc/net, packages' folders and installed apps. Null and blank attributes have the class and the detail
``unknown``; an address has the token ``netflow`` alone, and its source only where an audit asks for it. All functions are native.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.android_details import FAMILIES, FENNEC, MODES, PACKAGES, rule_rows
from tracewell.operators.details import IPV4, IPV6, token

NOWHERE = ("", "0", "0.0.0.0", "::", ":::", "na", "n/a", "none", "null", "unknown")


def squeezed(x: Column, most: int = 80) -> Column:
    """A token without repeated underscores."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(token(x, most), "_+", "_"), "^_|_$", ""), F.lit("")), F.lit("unknown"))


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")


def _word(mode: str):
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    return squeezed if mode == "refined" else token


# --- processes ------------------------------------------------------------------------------------------------------


def _base(cmd: Column, mode: str) -> Column:
    return _plain(F.substring_index(_plain(cmd), ":", 1)) if mode == "refined" else _plain(cmd)


def process_class(cmd: Column, mode: str = "refined") -> Column:
    """A package's class by how its name starts, package_other or native_process; legacy takes names of letters, digits and underscores only."""
    base = _base(cmd, mode)
    found = F.when(base == "", "unknown")
    if _word(mode) is token:
        dotted = base.contains(".")
        found = found.when(dotted & ~base.rlike(r"^[A-Za-z0-9_]+([.][A-Za-z0-9_]+)+$"), "unknown").when(~dotted & ~base.rlike("^[A-Za-z0-9_:-]+$"), "unknown")
    for label, start in PACKAGES:
        found = found.when(F.startswith(base, F.lit(start)), label)
    return found.when(base.contains("."), "package_other").otherwise("native_process")


def process_detail(cmd: Column, label: Column, mode: str = "refined") -> Column:
    """The package's name without what its class says, or the program; refined adds what follows a colon."""
    low = F.lower(_base(cmd, mode))
    rest = F.when(label == "package_other", low)
    for name, start in PACKAGES:
        rest = rest.when((label == name) & F.startswith(low, F.lit(start)), F.substr(low, F.lit(len(start) + 1)))
    rest = rest.otherwise(F.regexp_extract(low, r"^(\S*)", 1))
    if _word(mode) is token:
        return F.when(label == "unknown", "unknown").otherwise(token(rest))
    whole = _plain(cmd)
    after = F.lower(_plain(F.when(whole.contains(":"), F.regexp_replace(whole, "^[^:]*:", ""))))
    return squeezed(F.concat_ws("_", F.nullif(rest, F.lit("")), F.nullif(after, F.lit(""))), 60)


# --- files ----------------------------------------------------------------------------------------------------------


def family(low: Column, mode: str = "refined") -> Column:
    """The package in whose folder a path lies, its dots as underscores; ``app`` if it lies in none."""
    word, folders = _word(mode), ("/data/data/([^/]+)", "/android/data/([^/]+)", "/data/app/([^/]+)")[: 3 if mode == "refined" else 2]
    package = F.coalesce(*(F.nullif(F.regexp_extract(low, f, 1), F.lit("")) for f in folders), F.lit(""))
    if mode == "refined":
        package = F.regexp_replace(package, "-[^-]*$", "")
        found, most = F.when(package == f"org.mozilla.{FENNEC}", FENNEC), 50
    else:
        found, most = F.when(F.startswith(package, F.lit("org.mozilla.")), "org_mozilla").when(F.startswith(package, F.lit("com.android.email")), "com_android_email"), 40
    for start in FAMILIES:
        found = found.when(F.startswith(package, F.lit(start)), F.concat(F.lit(start.replace(".", "_")), word(F.substr(package, F.lit(len(start) + 1)), 40)))
    return found.when(package == "", "app").otherwise(word(package, most))


def _process_file(low: Column, mode: str) -> Column:
    """What a file of /proc is of: descriptors as one, a task's by the part after it; refined tells tables of the network."""
    word, most = _word(mode), 40 if mode == "refined" else 30
    rest = F.when(low.rlike("^/proc/[0-9]+/"), F.regexp_replace(low, "^/proc/[0-9]+/", "")).otherwise(F.regexp_replace(low, "^/proc/", ""))
    parts = F.filter(F.split(rest, "/"), lambda p: p != "")
    part = lambda i: F.get(parts, F.lit(i))
    found = F.when(F.size(parts) == 0, "proc")
    if mode == "refined":
        first, second = word(part(1), most), word(part(2), most)
        quota = F.when(second == "ctrl", "net_xt_qtaguid_ctrl").when(F.startswith(second, F.lit("iface_stat")), "net_xt_qtaguid_iface_stat").otherwise("net_xt_qtaguid")
        net = F.when(first == "xt_qtaguid", quota).when(first.isin("arp", "tcp", "udp", "unix"), F.concat(F.lit("net_"), first)).otherwise("net_other")
        found = found.when(part(0) == "net", net)
    found = found.when((part(0) == "task") & (F.size(parts) >= 3), F.concat(F.lit("task_"), word(part(2), most)))
    return found.when(part(0) == "fd", "fd").otherwise(word(part(0), most))


def file_details(classes: DataFrame, mode: str = "refined") -> DataFrame:
    """path, class, detail of files, given their classes (``attributes.node_classes``); a class without rules is its own detail.

    What rules look at is computed once for each path; then one conditional expression compares a path with its class's rules only.
    """
    label, low, name, kin = (F.col(c) for c in ("class", "__low", "__name", "__kin"))
    files = classes.where("kind = 'file' AND system = 'android'").select("path", "class").distinct().withColumn("__low", F.lower(_plain(F.col("path"))))
    files = files.withColumns({"__name": F.regexp_extract("__low", "([^/]*)/*$", 1), "__legacy": family(low, "legacy"), "__own": family(low, mode), "__process": _process_file(low, mode)})
    # the classes that legacy rules serve in refined mode take the legacy family
    of = F.when(label.isin("android_app_private_file", "android_app_cache_file"), F.col("__own")).otherwise(F.col("__legacy"))
    said = F.when(label.isin("android_device_file", "android_socket_file"), squeezed(name, 40)).otherwise(name) if mode == "refined" else name
    files = files.withColumns({
        "__kin": of, "__said": said, "__sub": squeezed(F.regexp_extract(low, "^/data/data/[^/]+/([^/]+)", 1), 40), "__app": squeezed(F.regexp_extract(low, "^/system/(?:priv-)?app/([^/]+)/", 1), 45),
        "__token": token(name), "__cut": F.regexp_replace(low, "/+$", ""),
    })

    def fits(how: str, value: str) -> Column:
        v, last = F.lit(value), F.col("__said")
        tests = {
            "any": lambda: F.lit(True), "is": lambda: low == v, "start": lambda: F.startswith(low, v), "end": lambda: F.endswith(low, v), "has": lambda: F.contains(low, v), "match": lambda: low.rlike(value),
            "name": lambda: last == v, "namestart": lambda: F.startswith(last, v), "nameend": lambda: F.endswith(last, v), "namematch": lambda: last.rlike(value),
            "folder": lambda: F.endswith(F.col("__cut"), v), "kin": lambda: F.concat_ws(" ", kin, low).rlike(value), "sub": lambda: F.col("__sub") == v,
        }
        return tests[how]()

    filled = {"{family}": kin, "{name}": F.col("__token"), "{app}": F.col("__app")}

    def written(detail: str) -> Column:
        return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), kv[1]) if kv[0] in detail else x, filled.items(), F.lit(detail))

    by_class: dict[str, list[tuple[str, str, str]]] = {}
    for _, kind, how, value, detail in rule_rows(mode):
        by_class.setdefault(kind, []).append((how, value, detail))
    out = F.when(label == "proc_file", F.col("__process"))
    for kind, rules in by_class.items():
        # a class's rules end with one that always fits
        found = F.when(F.lit(False), "")
        for how, value, detail in rules[:-1]:
            found = found.when(fits(how, value), written(detail))
        out = out.when(label == kind, found.otherwise(written(rules[-1][2])))
    return files.select("path", "class", out.otherwise(token(label)).alias("detail"))


# --- addresses, tables and sentences --------------------------------------------------------------------------------


def netflow_tokens(source: Column, keep_source: bool = False) -> Column:
    """``netflow``; for an audit also the source's address, as it is written (an IPv4 address within IPv6 as IPv4), or remote_unknown."""
    if not keep_source:
        return F.array(F.lit("netflow"))
    a = F.regexp_replace(F.lower(_plain(source)), r"^::ffff:(?=[0-9]+\.)", "")
    known = ~a.isin(*NOWHERE) & ~a.rlike("^[0:]+$") & (a.rlike(IPV4) | a.rlike(IPV6))
    return F.array(F.lit("netflow"), F.when(known, F.concat(F.lit("src_"), squeezed(a))).otherwise("remote_unknown"))


def process_details(nodes: DataFrame, mode: str = "refined") -> DataFrame:
    """cmd, class, detail of the distinct command lines of processes; null is its own row."""
    rows = nodes.where("kind = 'process'").select("cmd").distinct().withColumn("class", process_class(F.col("cmd"), mode))
    return rows.withColumn("detail", process_detail(F.col("cmd"), F.col("class"), mode))


def natural_tokens(nodes: DataFrame, classes: DataFrame, mode: str = "refined", keep_source: bool = False) -> DataFrame:
    """node_id, kind and tokens of every node: kind, class and detail, or a netflow's. ``nodes`` may have src_addr."""
    of = file_details(classes, mode).select(F.col("path").alias("__path"), "class", "detail")
    source = F.col("src_addr") if "src_addr" in nodes.columns else F.lit(None).cast("string")
    rows = nodes.select("node_id", "kind", "cmd", source.alias("source"), F.when(F.col("kind") == "file", F.coalesce("path", F.lit(""))).alias("__path"))
    named = rows.join(of, "__path", "left").withColumn("__label", process_class(F.col("cmd"), mode))
    process = F.array(F.lit("process"), F.col("__label"), process_detail(F.col("cmd"), F.col("__label"), mode))
    tokens = F.when(F.col("kind") == "process", process).when(F.col("kind") == "file", F.array("kind", "class", "detail")).when(F.col("kind") == "netflow", netflow_tokens(F.col("source"), keep_source))
    return named.select("node_id", "kind", tokens.otherwise(F.array(squeezed(F.col("kind"), 30))).alias("tokens"))


def sentences(flow: DataFrame, words: DataFrame) -> DataFrame:
    """host, event_id and sentence: the source's tokens, ``event``, the action and the destination's tokens; ``words`` has node_id and tokens."""
    src, dst = (words.select(F.col("node_id").alias(f"info_{x}"), F.col("tokens").alias(f"__{x}")) for x in ("src", "dst"))
    act = squeezed(F.col("action"), 60)
    action = F.when(F.startswith(act, F.lit("event_")), act).otherwise(F.concat(F.lit("event_"), act))
    rows = flow.select("host", "event_id", "action", "info_src", "info_dst").join(src, "info_src").join(dst, "info_dst")
    return rows.select("host", "event_id", F.array_join(F.concat("__src", F.array(F.lit("event"), action), "__dst"), " ").alias("sentence"))
