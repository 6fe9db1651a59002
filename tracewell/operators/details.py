"""Detail tokens beside a node's class: what a process runs, a file's telling name, an address with its scope.

For the systems freebsd and linux. Null and missing attributes have the detail ``unknown``, a netflow without an address the token
``netflow`` alone. All functions are native but the lexer of command lines (``attributes.process_words``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import attributes

# Spellings of nothing, names that tell nothing without their folder, programs whose argument tells what they
# run, words of a shell that aren't arguments, and programs with another name.
MISSING = ("", "none", "null", "na", "n/a", "unknown", "path_none")
GENERIC = (
    "index", "index_html", "index_shtml", "minion", "proc", "files", "file", "img", "images", "template", "cache", "log", "logs", "fd", "task", "stat", "cmdline", "maps", "environ", "status", "mounts", "mountinfo",
    "main_cpp", "main_qml", "build_gn", "qmldir", "include", "readme", "readme_md", "init___py", "manifest_json", "doc", "data", "src", "scripts", "css", "lib", "resources", "community", "video", "episode", "cast", "lc_messages",
)
INTERPRETERS = ("python", "python2", "python2_7", "python3", "perl", "ruby", "bash", "sh", "dash", "zsh", "csh", "tcsh", "php", "node")
CONTROL = ("-c", "-e", "-lc", "-l", "&", "&&", "||", "|")
SAME_PROGRAM = {"dhclient3": "dhclient", "unity_2d_shell": "unity_2d", "unity_2d_panel": "unity_2d"}
#: the monitored network, and private ones: leading octets
INTERNAL, PRIVATE = r"^128\.55\.12\.", r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4, IPV6 = rf"^{OCTET}(\.{OCTET}){{3}}$", "^[0-9a-f:.]*:[0-9a-f:.]*$"
SYSTEMS = ("freebsd", "linux")


def token(x: Column, most: int = 60) -> Column:
    """A value as a lower-case word of letters, digits and underscores; ``unknown`` if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"\s+", "_"), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(plain == "", "unknown").otherwise(plain), 1, most)


def _missing(x: Column) -> Column:
    return x.isNull() | F.lower(F.trim(x)).isin(*MISSING)


def _process_file(low: Column, system: str) -> Column:
    """What a file of /proc/<number> is of: on freebsd its last part, on linux its first, descriptors as one, a task's by the part after it."""
    parts = F.filter(F.split(F.regexp_replace(low, "^/proc/[0-9]+", ""), "/"), lambda p: p != "")
    first, n = F.get(parts, F.lit(0)), F.size(parts)
    if system == "freebsd":
        return F.when(n == 0, "proc").otherwise(token(F.get(parts, n - 1)))
    task = F.concat(F.lit("task_"), token(F.get(parts, F.lit(2)), 40))
    return F.when(n == 0, "proc").when(first == "fd", "fd").when((first == "task") & (n >= 3), task).otherwise(token(first, 40))


def path_detail(path: Column, system: str) -> Column:
    """A path's last part, with its folder's in front where it tells nothing alone and the folder isn't a number; null if there is no path."""
    cut = F.regexp_replace(F.lower(F.trim(path)), "/+$", "")
    name = token(F.regexp_extract(cut, "([^/]*)$", 1))
    above = F.regexp_extract(cut, "([^/]+)/+[^/]*$", 1)
    parent = token(above)
    named = F.when(name.isin(*GENERIC) & (above != "") & ~parent.rlike("^[0-9]+$"), F.substring(F.concat_ws("_", parent, name), 1, 60)).otherwise(name)
    found = F.when(_missing(path), None).when(cut.rlike("^/proc/[0-9]+(/|$)"), _process_file(cut, system))
    return (found.when(cut == "0", "swapper") if system == "linux" else found).otherwise(named)


def file_detail(path: Column, label: Column, system: str) -> Column:
    """A file's detail, given its class."""
    top = F.regexp_extract(F.lower(F.trim(path)), "^/*([^/]*)", 1)
    return (
        F.when(_missing(path), "unknown").when(label == "filesystem_root", "root").when(label.isin("freebsd_root_dir", "linux_root_dir"), token(F.concat(top, F.lit("_root"))))
        .when(label == "proc_cmdline", "cmdline").otherwise(path_detail(path, system))
    )


def argument(words: Column, system: str) -> Column:
    """What an interpreter was told to run: its first argument that looks like a file, else its first at all; null if it has none."""
    args = F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a: F.trim(a))
    said = F.filter(args, lambda a: (a != "") & ~a.isin(*CONTROL) & ~F.startswith(a, F.lit("-")))
    loose = lambda a: a.contains("=") | a.rlike("^(>|2>|&>)") | a.rlike("[&;]$")
    files = F.filter(said, lambda a: ~loose(a) & a.rlike("[/.]"))
    first = F.get(files, F.lit(0))
    words_only = F.filter(F.transform(said, lambda a: token(a)), lambda t: t != "unknown")
    return F.coalesce(path_detail(first, system), F.when(first.isNotNull(), token(F.regexp_extract(first, "([^/]*)/*$", 1))), F.get(words_only, F.lit(0)))


def process_detail(path: Column, words: Column, label: Column, system: str) -> Column:
    """What a process runs: an interpreter's argument, else its program, else (linux) its path's name, else its class.

    ``words`` are those of its command line, none where that is missing.
    """
    exe = F.when(F.size(words) > 0, token(F.regexp_replace(F.regexp_extract(F.get(words, F.lit(0)), "([^/]*)$", 1), "^-+", "")))
    runs = F.coalesce(F.when(exe.isin(*INTERPRETERS), argument(words, system)), exe)
    if system == "freebsd":
        return F.when(label == "unknown_process", "unknown").otherwise(F.coalesce(runs, token(label)))
    runs = F.coalesce(runs, path_detail(path, system))
    kernel = F.when(runs.isin("0", "swapper") | F.lower(F.coalesce(path, F.lit(""))).contains("swapper"), "swapper").when(F.startswith(runs, F.lit("kworker")), "kworker").when(F.startswith(runs, F.lit("flush")), "flush")
    alias = F.create_map(*(F.lit(x) for kv in SAME_PROGRAM.items() for x in kv))
    plain = F.coalesce(F.try_element_at(alias, runs), runs, token(label))
    return F.when(label == "unknown_process", "unknown").when(label == "kernel_thread", F.coalesce(kernel, runs, F.lit("kernel_thread"))).otherwise(plain)


def address_scope(address: Column, system: str, internal: str = INTERNAL) -> Column:
    """ip_unknown_or_zero, ip_loopback, ip_internal_env, ip_private or ip_public_or_external; only freebsd knows IPv6."""
    a = F.lower(F.trim(address))
    four = F.when(F.startswith(a, F.lit("0.")), "ip_unknown_or_zero").when(F.startswith(a, F.lit("127.")), "ip_loopback").when(a.rlike(internal), "ip_internal_env").when(a.rlike(PRIVATE), "ip_private").otherwise("ip_public_or_external")
    found = F.when(a.rlike(IPV4), four)
    if system == "freebsd":
        found = found.when(a.rlike(IPV6), F.when(a.rlike("^(0*:)+0*1$"), "ip_loopback").otherwise("ip_public_or_external"))
    return F.coalesce(found, F.lit("ip_unknown_or_zero"))


def port_range(port: Column) -> Column:
    p = F.trim(port).try_cast("bigint")
    return F.when(p.isNull() | (p <= 0), "port_unknown_or_zero").when(p <= 1023, "port_system").when(p <= 49151, "port_registered").when(p <= 65535, "port_ephemeral").otherwise("port_invalid")


def netflow_tokens(address: Column, source: Column, system: str) -> Column:
    """netflow, scope and address; where that is unknown, netflow and the source's address, if there is one (``local`` of a local one)."""
    scope, plain = address_scope(address, system), lambda a: F.translate(F.lower(F.trim(a)), ".:", "__")
    own = F.when(F.lower(F.trim(source)).isin("local", "localhost"), "local").when(address_scope(source, system) != "ip_unknown_or_zero", plain(source))
    back = F.array(F.lit("netflow"), F.concat(F.lit("src_"), own))
    return F.when(scope != "ip_unknown_or_zero", F.array(F.lit("netflow"), scope, plain(address))).when(own.isNotNull(), back).otherwise(F.array(F.lit("netflow")))


def netflow_roles(nodes: DataFrame, system: str) -> DataFrame:
    """node_id, role (scope and range of port) and tokens of netflows; ``nodes`` may have src_addr."""
    source = F.col("src_addr") if "src_addr" in nodes.columns else F.lit(None).cast("string")
    role = F.concat_ws("|", F.lit("net"), address_scope(F.col("dst_addr"), system), port_range(F.col("dst_port")))
    return nodes.where("kind = 'netflow'").select("node_id", role.alias("role"), netflow_tokens(F.col("dst_addr"), source, system).alias("tokens"))


def file_details(classes: DataFrame, system: str) -> DataFrame:
    """path, class, detail of files; ``classes`` as ``attributes.node_classes`` gives them."""
    files = classes.where((F.col("kind") == "file") & (F.col("system") == system)).select("path", "class").distinct()
    return files.withColumn("detail", file_detail(F.col("path"), F.col("class"), system))


def process_details(nodes: DataFrame, classes: DataFrame, system: str) -> DataFrame:
    """path, cmd, class, detail of processes; nulls as empty texts, as in ``classes``."""
    said = attributes.process_words(nodes).select(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("cmd", F.lit("")).alias("cmd"), F.when(_missing(F.col("cmd")), None).otherwise(F.col("words")).alias("words"))
    mine = classes.where((F.col("kind") == "process") & (F.col("system") == system)).select("path", "cmd", "class")
    words = F.coalesce("words", F.array().cast("array<string>"))
    detailed = mine.join(said.dropDuplicates(["path", "cmd"]), ["path", "cmd"])
    return detailed.select("path", "cmd", "class", process_detail(F.col("path"), words, F.col("class"), system).alias("detail"))


def natural_tokens(nodes: DataFrame, classes: DataFrame, system: str) -> DataFrame:
    """node_id, kind and tokens of every node: its kind, class and detail, or a netflow's tokens. They serve as words to learn vectors of."""
    of = file_details(classes, system).select(F.lit("file").alias("kind"), "path", F.lit("").alias("cmd"), "class", "detail")
    of = of.unionByName(process_details(nodes, classes, system).select(F.lit("process").alias("kind"), "path", "cmd", "class", "detail"))
    cmd = F.when(F.col("kind") == "file", "").otherwise(F.coalesce("cmd", F.lit("")))
    rows = nodes.where("kind <> 'netflow'").select("node_id", "kind", F.coalesce("path", F.lit("")).alias("path"), cmd.alias("cmd"))
    named = rows.join(of, ["kind", "path", "cmd"]).select("node_id", "kind", F.array("kind", "class", "detail").alias("tokens"))
    return named.unionByName(netflow_roles(nodes, system).select("node_id", F.lit("netflow").alias("kind"), "tokens"))
