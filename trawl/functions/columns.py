"""Derived columns and scalar functions, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """The last component; empty for a root."""
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; empty for .name, for a trailing dot and without a dot."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)\z", 1))


def stem(name: Column) -> Column:
    """Lower-cased text before the last dot, or the whole name."""
    return F.regexp_replace(F.lower(name), r"[.][^.]*\z", "")


def parent(path: Column) -> Column:
    """Text before the last separator; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*)[/\\]", 1)


def display_parent(path: Column) -> Column:
    """Like parent, but the whole path if the last separator comes first or there is none."""
    return F.when(parent(path) == "", path).otherwise(parent(path))


def name_key(name: Column) -> Column:
    """What trigrams are looked for in: the lower-cased name, filled up to three characters if it has one or two."""
    low = F.lower(name)
    return F.when(F.length(low).between(1, 2), F.rpad(low, 3, " ")).otherwise(low)


def unix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def windows_path(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"^\\\\\?\\", ""), F.lit("/"), F.lit("\\"))


def format_size(size: Column) -> Column:
    """Bytes in units of 1024 with two decimals, ties to even."""
    out = F.format_string("%d B", size)
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        scaled = F.bround(size.cast("double") / F.lit(float(1024**power)), 2)
        out = F.when(size >= 1024**power, F.format_string(f"%.2f {unit}", scaled)).otherwise(out)
    return out


def from_file_time(ticks: Column) -> Column:
    """UTC time of 100 ns ticks since 1601, in microseconds."""
    micros = F.call_function("div", ticks, F.lit(10).cast("long")) - F.lit(11_644_473_600_000_000)
    days, rest = F.call_function("div", micros, F.lit(86_400_000_000)), micros % F.lit(86_400_000_000)
    seconds = (rest.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), seconds)


def since_epoch(time: Column) -> Column:
    """Times before 1970 count as 1970."""
    return F.greatest(time, F.expr("timestamp_ntz '1970-01-01 00:00:00'"))


def derived(catalog: DataFrame) -> DataFrame:
    """The catalog with the columns that search reads. Stored with it, they let filters reach the scan."""
    return catalog.withColumns({"name_lower": F.lower("name"), "path_lower": F.lower("path"), "name_key": name_key(F.col("name")), "stem": stem(F.col("name")), "parent": parent(F.col("path"))})


def _let(value: Column, use) -> Column:
    """use(value) with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def _place(content: Column, place: Column) -> Column:
    """The character of content from which the one at ``place`` in its lower case comes.

    Capital dotted I alone has two characters in lower case; texts without it keep their places.
    """
    start = F.struct(F.lit(0).alias("low"), F.lit(0).alias("own"), F.lit(0).alias("found"))

    def piece(s: Column, p: Column) -> Column:
        n = F.length(p)
        found = F.when(s["found"] > 0, s["found"]).when(place <= s["low"] + n, s["own"] + place - s["low"]).when(place <= s["low"] + n + 2, s["own"] + n + 1).otherwise(0)
        return F.struct((s["low"] + n + 2).alias("low"), (s["own"] + n + 1).alias("own"), found.alias("found"))

    return F.aggregate(F.split(content, "\u0130"), start, piece, lambda s: s["found"])


#: Characters in which a word's end is looked for before the rest of a text is.
NEAR = 256


def snippet(content: Column, keyword: str, context: int = 60) -> Column:
    """The first match with ``context`` characters on both sides, widened to white space; null without a match.

    A match is one in lower case; places in it are taken back to the text itself.
    """

    def match(s: Column) -> Column:
        same = F.length(s["c"]) == F.length(s["low"])
        end = s["at"] + len(keyword) - 1
        return F.struct(s["c"].alias("c"), F.length(s["c"]).alias("n"), F.when(same, s["at"]).otherwise(_place(s["c"], s["at"])).alias("a"), F.when(same, end).otherwise(_place(s["c"], end)).alias("b"))

    def cut(s: Column) -> Column:
        return F.struct(s["c"].alias("c"), s["n"].alias("n"), F.greatest(s["a"] - context, F.lit(1)).alias("first"), F.least(s["b"] + context, s["n"]).alias("last"))

    def widen(s: Column) -> Column:
        c, n, first, last = s["c"], s["n"], s["first"], s["last"]
        word = r"(?U)^([^\s]*)"
        # the text before is reversed, so that the pattern is anchored; near the cut first
        back = lambda least: F.length(F.regexp_extract(F.reverse(F.substring(c, least, first - least)), word, 1))
        ahead = lambda most: F.length(F.regexp_extract(F.substring(c, last + 1, most), word, 1))
        near = F.greatest(first - NEAR, F.lit(1))
        left = _let(back(near), lambda k: F.when((k < first - near) | (near == 1), k).otherwise(back(F.lit(1))))
        right = _let(ahead(F.lit(NEAR)), lambda k: F.when((k < NEAR), k).otherwise(ahead(n)))
        # without white space on a side, the cut stays
        return F.struct(c.alias("c"), n.alias("n"), _let(left, lambda k: F.when(k < first - 1, first - k).otherwise(first)).alias("first"), _let(right, lambda k: F.when(k < n - last, last + k).otherwise(last)).alias("last"))

    def show(s: Column) -> Column:
        text = F.regexp_replace(F.substring(s["c"], s["first"], s["last"] - s["first"] + 1), r"(?U)^\s+|\s+\z", "")
        return F.concat(F.when(s["first"] > 1, F.lit("...")).otherwise(F.lit("")), text, F.when(s["last"] < s["n"], F.lit("...")).otherwise(F.lit("")))

    def found(s: Column) -> Column:
        return F.when(s["at"] > 0, _let(match(s), lambda m: _let(cut(m), lambda k: _let(widen(k), show))))

    def place(s: Column) -> Column:
        return F.struct(s["c"].alias("c"), s["low"].alias("low"), F.instr(s["low"], keyword).alias("at"))

    return _let(F.struct(content.alias("c"), F.lower(content).alias("low")), lambda s: _let(place(s), found))
