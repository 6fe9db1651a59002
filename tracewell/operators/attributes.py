"""Tokens, signatures and scopes of node attributes: one job over distinct values, with native functions.

Pieces are lower-case; ids stand for UUIDs, long hexadecimals and numbers. Null attributes give null or no row, as stated.
"""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.prefix import partitions

# What counts as an id, the shell's signs, buckets of counts, and the most tokens of a process.
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
HEX = "^[0-9a-f]{12,}$"
SHELL = {">": "REDIR_OUT", ">>": "REDIR_APPEND", "<": "REDIR_IN", "|": "PIPE", "||": "OR", "&&": "AND", ";": "SEQ"}
COUNTS = ((1, "1"), (2, "2"), (4, "3_4"), (8, "5_8"), (16, "9_16"), (32, "17_32"), (64, "33_64"), (128, "65_128"))
MOST_COUNTS = "129p"
PROCESS_TOKENS = 8


def piece(x: Column, fallback: str, most: int = 32) -> Column:
    """A value as a short token."""
    low = F.lower(F.trim(x))
    plain = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    cut = F.regexp_replace(F.substring(plain, 1, most), "_+$", "")
    return F.when(low.rlike(UUID), "uuid").when(low.rlike(HEX), "hex").when(low.rlike("^[0-9]+$"), "num").when(plain == "", fallback).otherwise(cut)


def base_signature(name: Column) -> Column:
    """A file name's first part, and its first ending that has a letter."""
    low = F.lower(name)
    parts = F.filter(F.split(low, r"\."), lambda x: x != "")
    base = F.when(low.contains(".") & (F.size(parts) > 0), F.get(parts, F.lit(0))).otherwise(low)
    ending = F.get(F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: x.rlike(r"\p{L}")), F.lit(0))
    return F.when(low.rlike(UUID), "uuid").otherwise(F.concat_ws("_", piece(base, "path", 24), F.when(ending.isNotNull(), piece(ending, "x", 12))))


def path_tokens(path: Column) -> Column:
    """ROOT_, DIR_ and PATH_ tokens of a path; PATH_na for one without a segment."""
    clean = F.trim(F.regexp_replace(F.translate(F.trim(path), "\\", "/"), "/+", "/"))
    parts = F.filter(F.split(clean, "/"), lambda x: x != "")
    n = F.size(parts)
    root = F.when(F.startswith(clean, F.lit("/")), piece(F.get(parts, F.lit(0)), "root")).otherwise("rel")
    tokens = F.array(F.concat(F.lit("ROOT_"), root), F.when(n >= 2, F.concat(F.lit("DIR_"), piece(F.get(parts, n - 2), "dir", 20))), F.concat(F.lit("PATH_"), base_signature(F.get(parts, n - 1))))
    return F.when(path.isNotNull(), F.when(n == 0, F.array(F.lit("PATH_na"))).otherwise(F.array_distinct(F.filter(tokens, lambda x: x.isNotNull()))))


def count_bucket(prefix: str, n: Column) -> Column:
    out = F.lit(f"{prefix}_{MOST_COUNTS}")
    for most, name in reversed(COUNTS):
        out = F.when(n <= most, f"{prefix}_{name}").otherwise(out)
    return out


def value_signature(v: Column) -> Column:
    """What kind of value it is: a truth value, a bucketed number, a path's name, a bucketed list, an address, or a piece of text."""
    text = F.trim(v)
    pieces = F.size(F.filter(F.split(text, ":"), lambda x: x != ""))
    listed = F.size(F.filter(F.split(text, "[|;,]+"), lambda x: x != ""))
    octets = F.transform(F.split(text, r"\."), lambda x: F.try_to_number(x, F.lit("999")))
    ipv4 = text.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$") & F.forall(octets, lambda x: x <= 255)
    many = text.contains(":") & ~F.startswith(text, F.lit("http")) & (pieces > 2)
    last = F.element_at(F.split(F.regexp_replace(F.translate(text, "\\", "/"), "/+$", ""), "/"), -1)
    return (
        F.when(text == "", "na").when(F.lower(text).isin("true", "false"), F.lower(text)).when(text.rlike("^[0-9]+$"), count_bucket("N", F.coalesce(text.try_cast("decimal(38,0)"), F.lit(1 << 40))))
        .when(text.rlike(r"[/\\]"), F.when(last == "", "path").otherwise(base_signature(last))).when(text.rlike("[|;]"), count_bucket("L", F.greatest(listed, F.lit(1)))).when(many, count_bucket("L", pieces))
        .when(ipv4, F.concat(F.lit("IP_"), F.translate(text, ".", "_"))).otherwise(piece(text, "val", 24))
    )


def netflow_tokens(nodes: DataFrame) -> DataFrame:
    net = nodes.where("kind = 'netflow'")
    return net.select(F.concat(F.lit("IP_"), F.translate("dst_addr", ".:", "__")).alias("ip_token"), F.concat(F.lit("PORT_"), "dst_port").alias("port_token")).distinct()


def address_scope(addr: Column, internal: tuple[int, int] = (128, 55)) -> Column:
    """zero, loopback, internal_<third octet>, private or public."""
    o = [F.get(F.split(addr, r"\."), F.lit(i)).cast("int") for i in range(3)]
    private = (o[0] == 10) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & (o[1] == 168))
    return F.when(addr == "0.0.0.0", "zero").when(o[0] == 127, "loopback").when((o[0] == internal[0]) & (o[1] == internal[1]), F.concat(F.lit("internal_"), o[2].cast("string"))).when(private, "private").otherwise("public")


def port_bucket(port: Column) -> Column:
    p = port.cast("int")
    return F.when(p < 1024, "system").when(p < 49152, "registered").otherwise("ephemeral")


# --- process tokens: shell words need a lexer ----------------------------------------------------------------------


def _words(cmd: str) -> list[str]:
    try:
        return shlex.split(cmd)
    except ValueError:
        return cmd.split()


def process_words(nodes: DataFrame) -> DataFrame:
    """path, cmd, words of each distinct command line, in Arrow batches; a line that the lexer can't read is split at blanks."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for cmd in batches:
            yield cmd.map(lambda c: None if c is None else [w for w in _words(c) if w.strip()])

    words = F.pandas_udf(run, "array<string>")
    return nodes.where("kind = 'process'").select("path", "cmd").distinct().withColumn("words", words("cmd"))


def process_tokens(nodes: DataFrame, most: int = PROCESS_TOKENS) -> DataFrame:
    """path, cmd, tokens: the program, its folder, then flags with their values, settings and shell signs in order, then other arguments.

    Only the lexer is Python. Words are then numbered and classified with native functions: a flag takes the next word as its
    value unless that is a flag or a sign, and a word that is so taken has no token of its own.
    """
    rows = process_words(nodes).withColumn("all", F.filter(F.concat(F.array("path"), F.coalesce("words", F.array().cast("array<string>"))), lambda w: w.isNotNull() & (F.trim(w) != "")))
    exe = F.get("all", F.lit(0))
    name = base_signature(F.element_at(F.split(F.translate(exe, "\\", "/"), "/+"), -1))
    folder = F.get(F.filter(path_tokens(exe), lambda t: F.startswith(t, F.lit("DIR_"))), F.lit(0))
    rows = rows.withColumns({"exe": exe, "name": F.when(exe.isNotNull(), name), "folder": folder})
    # the program's own name, repeated in front
    same = lambda w: (w == F.col("exe")) | (piece(w, "x", 24) == F.col("name"))
    tail = F.slice("all", 2, F.greatest(F.size("all"), F.lit(1)))
    first = F.coalesce(F.array_min(F.filter(F.transform(tail, lambda w, i: F.when(~same(w), i + 1)), lambda i: i.isNotNull())), F.size(tail) + 1)
    rows = rows.withColumn("args", F.slice(tail, first, F.size(tail)))
    sign = lambda w: w.isin(*SHELL)
    flag = lambda w: F.startswith(w, F.lit("-")) & ~w.isin("-", "--")
    takes = lambda w, nxt: flag(w) & nxt.isNotNull() & ~sign(nxt) & ~flag(nxt)
    arg = lambda i: F.get("args", i)
    shell = F.create_map(*(F.lit(x) for kv in SHELL.items() for x in kv))

    def token(w: Column, i: Column) -> Column:
        key, value = F.substring_index(w, "=", 1), F.substring(w, F.length(F.substring_index(w, "=", 1)) + 2, F.length(w))
        taken = F.when(i > 0, takes(arg(i - 1), w)).otherwise(F.lit(False))
        named = piece(F.regexp_replace(w, "^-+", ""), "flag", 20)
        setting = w.contains("=") & ~F.startswith(w, F.lit("=")) & ~F.endswith(w, F.lit("="))
        env = F.when((F.upper(key) == key) & (F.lower(key) != key), "ENV").otherwise("KV")
        loose = F.when(w.rlike(r"[/\\]"), base_signature(F.element_at(F.split(F.regexp_replace(F.translate(w, "\\", "/"), "/+$", ""), "/"), -1))).otherwise(piece(w, "arg", 20))
        prior = F.when(sign(w), shell[w]).when(takes(w, arg(i + 1)), F.concat(F.lit("FLAG_"), named, F.lit("_"), value_signature(arg(i + 1)))).when(flag(w), F.concat(F.lit("FLAG_"), named)).when(setting, F.concat_ws("_", env, piece(key, "key", 20), value_signature(value)))
        return F.when(~taken, F.struct(prior.isNull().alias("late"), F.coalesce(prior, F.concat(F.lit("ARG_"), loose)).alias("token")))

    rows = rows.withColumn("marked", F.filter(F.transform("args", token), lambda x: x.isNotNull()))
    part = lambda late: F.transform(F.filter("marked", lambda x: x["late"] == late), lambda x: x["token"])
    head = F.filter(F.array(F.concat(F.lit("EXE_"), F.col("name")), F.col("folder")), lambda x: x.isNotNull())
    tokens = F.when(F.col("exe").isNull(), F.array(F.lit("PROC_na"))).otherwise(F.slice(F.array_distinct(F.concat(head, part(False), part(True))), 1, most))
    return rows.select("path", "cmd", tokens.alias("tokens"))


# --- classes and roles ---------------------------------------------------------------------------------------------


def node_classes(nodes: DataFrame, rules: DataFrame, defaults: DataFrame) -> DataFrame:
    """kind, path, cmd, system, class: for each system, the class of the first rule that fits a distinct pair of attributes.

    Rules and defaults are lists kept by hand (node_rules.tables), a few hundred rows.
    """
    word = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(F.substring_index(F.coalesce("cmd", F.lit("")), " ", 1), F.lit("")), F.col("path"), F.lit("")), "^.*/", ""), "^-+", "")
    seen = nodes.where("kind <> 'netflow'").select(
        "kind", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("cmd", F.lit("")).alias("cmd"), F.regexp_replace(F.lower(word), "[^a-z0-9]+", "_").alias("word"),
        F.regexp_replace(F.lower(F.coalesce("path", F.lit(""))), "/+", "/").alias("clean"), F.lower(F.concat_ws(" ", "cmd", "path")).alias("everything"),
    ).distinct()
    v = F.col("value")
    fits = (
        F.when(F.col("how") == "word", F.col("word") == v).when(F.col("how") == "wordstart", F.startswith("word", v)).when(F.col("how") == "is", F.col("clean") == v).when(F.col("how") == "start", F.startswith("clean", v))
        .when(F.col("how") == "end", F.endswith("clean", v)).when(F.col("how") == "match", F.regexp_like("clean", v)).when(F.col("how") == "cmdstart", F.startswith(F.lower("cmd"), v))
        .when(F.col("how") == "cmdmatch", F.regexp_like("cmd", v)).otherwise(F.contains("everything", v))
    )
    each = seen.join(F.broadcast(defaults), "kind")
    found = each.join(F.broadcast(rules), ["system", "kind"]).where(fits).groupBy("kind", "path", "cmd", "system").agg(F.min_by("label", "place").alias("__label"))
    bare = (F.col("path") == "") & (F.col("cmd") == "")
    return each.join(found, ["kind", "path", "cmd", "system"], "left").select("kind", "path", "cmd", "system", F.when(bare, F.col("nothing")).otherwise(F.coalesce("__label", "other")).alias("class")).distinct()


def routed(hosts: DataFrame, patterns: dict[str, str], otherwise: str = "generic") -> DataFrame:
    """host, profile: the profile of the first LIKE pattern that a host's name fits."""
    profile = F.lit(otherwise)
    for pattern, name in reversed(patterns.items()):
        profile = F.when(F.col("host").like(pattern), name).otherwise(profile)
    return hosts.select("host").distinct().withColumn("profile", profile)


def summaries(nodes: DataFrame, process_tokens_most: int = PROCESS_TOKENS) -> DataFrame:
    """node_id, kind, tokens (lower case) of every node: a process's words, a file's path, an address's scope and port.

    Nodes are a few bytes each, so that a file of millions may be one task's; cutting paths is dealt out.
    """
    said = process_tokens(nodes, process_tokens_most).select(F.col("path").alias("__path"), F.col("cmd").alias("__cmd"), F.col("tokens").alias("__process"))
    rows = nodes.repartition(partitions(nodes), "node_id").join(said, (F.col("kind") == "process") & F.col("path").eqNullSafe(F.col("__path")) & F.col("cmd").eqNullSafe(F.col("__cmd")), "left")
    net = F.array(address_scope(F.col("dst_addr")), port_bucket(F.col("dst_port")))
    tokens = F.when(F.col("kind") == "netflow", net).when(F.col("kind") == "process", F.col("__process")).otherwise(F.coalesce(path_tokens(F.col("path")), F.array(F.lit("PATH_na"))))
    return rows.select("node_id", "kind", F.transform(tokens, lambda t: F.lower(t)).alias("tokens"))


def head_roles(summary: DataFrame, most: int) -> DataFrame:
    """node_id, role: the kind and the first ``most`` tokens (both of an address)."""
    n = F.when(F.col("kind") == "netflow", 2).otherwise(most)
    return summary.select("node_id", F.array_join(F.concat(F.array("kind"), F.slice("tokens", F.lit(1), n)), "|").alias("role"))


def coarse_and_raw(summary: DataFrame) -> DataFrame:
    """node_id, coarse_role (where it lies) and raw_role (what it is)."""
    first = lambda prefix: F.get(F.filter("tokens", lambda t: F.startswith(t, F.lit(prefix))), F.lit(0))
    any_ = F.get("tokens", F.lit(0))
    coarse_file = F.when(first("root_").isNull() & first("dir_").isNull(), "file|coarse_path").otherwise(F.concat_ws("|", F.lit("file"), first("root_"), first("dir_")))
    net = F.array_join(F.concat(F.array("kind"), "tokens"), "|")
    coarse = F.when(F.col("kind") == "netflow", net).when(F.col("kind") == "file", coarse_file).otherwise(F.concat_ws("|", F.lit("process"), F.coalesce(first("dir_"), F.lit("coarse_process"))))
    raw = F.when(F.col("kind") == "netflow", net).when(F.col("kind") == "file", F.concat_ws("|", F.lit("file"), first("root_"), first("dir_"), F.coalesce(first("path_"), any_))).otherwise(F.concat_ws("|", F.lit("process"), F.coalesce(first("exe_"), any_), first("dir_")))
    return summary.select("node_id", coarse.alias("coarse_role"), raw.alias("raw_role"))
