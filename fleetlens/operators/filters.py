"""Filters and predicates: skip rules, suppression patterns, lists, flags and windows."""

from __future__ import annotations

import enum
import itertools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.times import col


class Sections(enum.IntFlag):
    """Health sections that a report can turn on."""

    OFFLINE = 1
    ONLINE = 2
    STATES = 4
    JOBS = 8
    LOGS = 16
    BACKUPS = 32
    DISKS = 64
    GROWTH = 128


#: Patterns that one expression may have; more are looked up in an index of their strings of one of these numbers of characters.
MOST_PATTERNS = 200
GRAMS = (1, 2, 3, 4, 8, 16)


def member_filter(df: DataFrame, column: str, pattern: str = "%") -> DataFrame:
    """Members whose name matches a pattern with % and _, without regard to case."""
    return df if pattern == "%" else df.where(F.col(column).ilike(pattern))


def list_rows(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """A row for each entry of a delimited list: position (from 1) and value, trimmed; empty entries go."""
    parts = F.posexplode(F.split(F.col(column), f"\\Q{separator}\\E")).alias("position", "value")
    return df.select("*", parts).withColumns({"position": F.col("position") + 1, "value": F.trim("value")}).where("value <> ''")


def exclude_names(df: DataFrame, column: str, names: Iterable[str]) -> DataFrame:
    """Without the named members; rows whose name is null stay."""
    names = [n.lower() for n in names]
    return df.where(F.col(column).isNull() | ~F.lower(F.col(column)).isin(*names)) if names else df


def skip_rules(df: DataFrame, rules: DataFrame, rule_id: int, keys: list[str], key2: str | None = None, both: bool = False) -> DataFrame:
    """Drops rows that an active rule names.

    A rule (rule_id, skip_value, skip_value2, active) fits when skip_value equals one of keys and skip_value2 is null or equals
    key2; with both, key2 must match, nulls being equal. A null skip_value never fits. Rules are equi-joined, key by key.
    """
    live = rules.where(F.col("active") & (F.col("rule_id") == rule_id) & F.col("skip_value").isNotNull())
    live = live.select(F.lower("skip_value").alias("_k1"), F.lower("skip_value2").alias("_k2")).distinct()
    second = F.lower(F.col(key2)) if key2 else F.lit(None).cast("string")
    for key in keys:
        fits = F.col("_k2").eqNullSafe(second) if both else F.col("_k2").isNull() | (F.col("_k2") == second)
        df = df.join(live, (F.lower(F.col(key)) == F.col("_k1")) & fits, "left_anti")
    return df


def _grams(text: Column, size: int | Column) -> Column:
    """Distinct hashes of the strings of `size` characters of a text, which is split into characters once."""
    n = F.char_length(text) - size
    size = F.lit(size) if isinstance(size, int) else size
    runs = lambda chars: F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.xxhash64(F.array_join(F.slice(chars, i, size), "")))
    return F.when(n >= 0, F.array_distinct(F.element_at(F.transform(F.array(F.split(text, "")), runs), 1))).otherwise(F.array().cast("array<bigint>"))


def matched_texts(texts: DataFrame, patterns: DataFrame, text: str = "text", pattern: str = "pattern") -> DataFrame:
    """Distinct values of text that fit at least one pattern with % and _ (as in LIKE), of any number of patterns. Nulls fit none.

    An inverted index: each pattern is filed under one string that every text must hold that fits it, of as many characters as the
    largest of GRAMS that its longest run between wildcards has, and of those the one that the fewest patterns have. Texts are
    joined with it by hashes of their own strings, and only pairs that meet there are tested, so a text costs about its length for
    each of GRAMS, however many patterns there are. Patterns of wildcards alone only ask for a length. All joins are on equal
    values. Joins with strings are merged: Spark takes exploded strings for as small as the file that they come from, and would
    send them all through the driver as a broadcast.
    """
    low = patterns.select(F.col(pattern).alias("_p")).where("_p is not null").distinct()
    runs = F.filter(F.split("_p", r"[%_\\\\]"), lambda x: x != "")
    low = low.withColumn("_run", F.reduce(runs, F.lit(""), lambda a, x: F.when(F.char_length(x) > F.char_length(a), x).otherwise(a)))
    low = low.withColumn("_size", F.coalesce(*(F.when(F.char_length("_run") >= n, n) for n in reversed(GRAMS)), F.lit(0)))
    grams = low.where("_size > 0").select("_p", F.explode(_grams(F.col("_run"), F.col("_size"))).alias("_gram"))
    common = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    filed = grams.join(common.hint("merge"), "_gram").groupBy("_p").agg(F.min(F.struct("_n", "_gram")).alias("_g")).select("_p", "_g._gram")
    own = texts.select(F.col(text).alias("_t")).where("_t is not null").distinct()
    sizes = [r[0] for r in low.where("_size > 0").select("_size").distinct().collect()]  # as many as GRAMS at most
    held = F.array_distinct(F.flatten(F.array(*(_grams(F.col("_t"), n) for n in sizes)))) if sizes else F.array().cast("array<bigint>")
    met = own.withColumn("_held", F.explode(held)).join(filed.hint("merge"), (F.col("_held") == F.col("_gram")) & F.like("_t", F.col("_p"))).select("_t")
    wild = low.where("_size = 0").select(F.contains(F.col("_p"), F.lit("%")).alias("_open"), F.char_length(F.replace(F.col("_p"), F.lit("%"))).alias("_length")).distinct()
    long = own.join(F.broadcast(wild.where("_open").agg(F.min("_length").alias("_least"))), F.char_length("_t") >= F.col("_least")).select("_t")  # one row
    fixed = own.join(wild.where("not _open"), F.char_length("_t") == F.col("_length"), "left_semi").select("_t")
    return met.unionByName(long).unionByName(fixed).distinct().withColumnRenamed("_t", text)


def suppress_patterns(df: DataFrame, text: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Drops rows whose text fits a pattern of a table, without regard to case; null texts stay. See matched_texts()."""
    gone = matched_texts(df.select(F.lower(F.col(text)).alias("_low")), patterns.select(F.lower(F.col(pattern)).alias("_pattern")), "_low", "_pattern")
    return df.join(gone, F.lower(F.col(text)) == F.col("_low"), "left_anti")


def skip_rules_wild(df: DataFrame, rules: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """Skip rules whose skip_value may be %, for all, and whose skip_value2 equals or is a pattern for one of texts.

    Rules that name a member are equi-joined, key by key, and the pattern is a condition of that join. Up to MOST_PATTERNS rules
    for all members become one expression; more of them are looked up in an index (see matched_texts()), with the same rows.
    """
    live = rules.where("active").select(F.lower("skip_value").alias("_k1"), F.lower("skip_value2").alias("_k2")).distinct()
    some = live.where("_k1 = '%'").select("_k2")
    for_all = [r[0] for r in some.limit(MOST_PATTERNS + 1).collect()]
    if len(for_all) <= MOST_PATTERNS:
        hit = F.lit(any(p is None for p in for_all))
        for p in (p for p in for_all if p is not None):
            for t in texts:
                hit = hit | F.coalesce(F.lower(F.col(t)).like(p), F.lit(False))
        df = df.where(~hit)
    else:
        df = df.join(F.broadcast(some.where("_k2 is null").limit(1)), F.lit(True), "left_anti")  # one row
        gone = matched_texts(df.select(F.explode(F.array(*(F.lower(F.col(t)) for t in texts))).alias("_low")), some, "_low", "_k2")
        for t in texts:
            df = df.join(gone, F.lower(F.col(t)) == F.col("_low"), "left_anti")
    second = F.col("_k2").isNull()
    for t in texts:
        second = second | F.coalesce(F.like(F.lower(F.col(t)), F.col("_k2")), F.lit(False))
    for k in keys:
        df = df.join(live.where("_k1 <> '%'"), (F.lower(F.col(k)) == F.col("_k1")) & second, "left_anti")
    return df


def skip_rules_label(df: DataFrame, rules: DataFrame, server: str, database: str, publication: str) -> DataFrame:
    """Skip rules keyed by a composed label [server].[database](publication)."""
    label = F.lower(F.concat(F.lit("["), F.col(server), F.lit("].["), F.col(database), F.lit("]("), F.col(publication), F.lit(")")))
    return df.join(rules.where("active").select(F.lower("skip_value").alias("_label")).distinct(), label == F.col("_label"), "left_anti")


def like_to_regex(pattern: str) -> str:
    """A regular expression for a pattern with % and _."""
    special = set("\\.^$|?*+()[]{}")
    return "(?is)^" + "".join(".*" if c == "%" else "." if c == "_" else f"\\{c}" if c in special else c for c in pattern) + "$"


def pattern_suppression(df: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """Drops rows whose text matches a pattern, without regard to case. Null texts stay.

    One expression, so a log of any length is read once: a word between %, or before one, is looked for in the lower-cased text,
    which needs no backtracking; only what is left of patterns is a compiled alternation.
    """
    if not patterns:
        return df
    low, hit, rest = F.lower(F.col(text)), F.lit(False), []
    for p in patterns:
        word = p.strip("%").lower()
        if "%" in word or "_" in word or not word or p.strip("%") != p[p.startswith("%") : len(p) - p.endswith("%")]:
            rest.append(f"(?:{like_to_regex(p)[5:]})")
        elif p.startswith("%"):
            hit = hit | (low.contains(word) if p.endswith("%") else low.endswith(word))
        else:
            hit = hit | (low.startswith(word) if p.endswith("%") else low == word)
    if rest:
        hit = hit | F.col(text).rlike("(?is)" + "|".join(rest))
    return df.where(F.col(text).isNull() | ~hit)


def recent(df: DataFrame, utc: str, local: str, hours: int, as_of: str, as_of_local: str | None = None) -> DataFrame:
    """Rows of the last hours by the UTC column, or by the local one where that is null."""
    back = f"timestamp_ntz'{{}}' - interval {hours} hours"
    return df.where((F.col(utc).isNotNull() & (F.col(utc) >= F.expr(back.format(as_of)))) | (F.col(utc).isNull() & (F.col(local) >= F.expr(back.format(as_of_local or as_of)))))


def flag_subset_skip(df: DataFrame, rules: DataFrame, keys: list[str], flags: int) -> DataFrame:
    """Drops rows named by a rule all of whose flags are among the flags in force; a null key of a rule fits any.

    Rules are equi-joined by the keys that they have, a join for each set of such keys; one without keys drops all rows.
    """
    live = rules.where(F.col("active") & (F.lit(flags).bitwiseAND(F.col("flags")) == F.col("flags")))
    for named in itertools.product((True, False), repeat=len(keys)):
        on = [k for k, n in zip(keys, named, strict=True) if n]
        some = live
        for k, n in zip(keys, named, strict=True):
            some = some.where(F.col(k).isNotNull() if n else F.col(k).isNull())
        df = df.join(some.select(*on).distinct(), on, "left_anti") if on else df.join(F.broadcast(some.select(F.lit(1).alias("_any")).limit(1)), F.lit(True), "left_anti")  # one row
    return df


def admitted_state(state: Column | str, admitted: str) -> Column:
    """Whether a state is in a comma list, by whole names."""
    return F.array_contains(F.transform(F.split(F.lit(admitted), ","), lambda x: F.trim(x)), F.trim(col(state)))


def without_offline_groups(df: DataFrame, files: DataFrame, group: str, offline: str) -> DataFrame:
    """Drops members of groups all of whose files are offline."""
    gone = files.groupBy(group).agg(F.min(F.col(offline).cast("int")).alias("_all")).where("_all = 1").select(group)
    return df.join(gone, group, "left_anti")


def unused(df: DataFrame, usage: DataFrame, key: str, uses: str, protected: DataFrame | None = None) -> DataFrame:
    """Members without a usage row, or with uses that sum to zero, that no protected row (a key, a reference) names."""
    used = usage.groupBy(key).agg(F.sum(uses).alias("_uses")).where("_uses <> 0").select(key)
    out = df.join(used, key, "left_anti")
    return out if protected is None else out.join(protected.select(key), key, "left_anti")


def detail_over_summary(df: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Drops a summary row (null part) where a row for a part exists."""
    detailed = df.where(F.col(part).isNotNull()).select(*keys, F.lit(True).alias("_d")).distinct()
    return df.where(F.col(part).isNotNull()).unionByName(df.where(F.col(part).isNull()).join(detailed, keys, "left_anti"))


def one_per_host(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One representative of each host and filter: the first by order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_passive_twins(df: DataFrame, name: str, host: str, active: str) -> DataFrame:
    """Active members, and passive ones of which a member of the same name on another host is active."""
    live = df.where(F.col(active)).select(F.col(name).alias("_name"), F.col(host).alias("_host")).distinct()
    twins = df.where(~F.col(active)).join(live, (F.col(name) == F.col("_name")) & (F.col(host) != F.col("_host")), "left_semi")
    return df.where(F.col(active)).unionByName(twins)
