"""Symbols and timeframes: fixed dimensions and expressions over codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Timeframe, minutes, storage name, next higher, next lower.
TIMEFRAMES = (
    ("m", 4800, "1mo", None, "w"),
    ("w", 1200, "1wk", "m", "d"),
    ("d", 240, "1d", "w", "f60"),
    ("f60", 60, "1h", "d", "f30"),
    ("f30", 30, "30m", "f60", "f15"),
    ("f15", 15, "15m", "f30", "f5"),
    ("f5", 5, "5m", "f15", "f1"),
    ("f1", 1, "1m", "f5", None),
)
# Names under which a timeframe may be asked for.
TIMEFRAME_NAMES = {
    "m": ("m", "month", "月线"),
    "w": ("w", "week", "周线"),
    "d": ("d", "day", "日线"),
    "f60": ("f60", "60f", "60分钟"),
    "f30": ("f30", "30f", "30分钟"),
    "f15": ("f15", "15f", "15分钟"),
    "f5": ("f5", "5f", "5分钟"),
    "f1": ("f1", "1f", "1分钟"),
}
MINUTES = {tf: minutes for tf, minutes, *_ in TIMEFRAMES}
LOWER = {tf: lower for tf, _, _, _, lower in TIMEFRAMES}
HIGHER = {tf: higher for tf, _, _, higher, _ in TIMEFRAMES}
# Index codes that the code mapping takes for Shanghai.
SHANGHAI_INDEXES = ("000001", "000016", "000300", "000688", "000852", "000905")
# Main indexes by code, name and abbreviation.
INDEXES = (
    ("000001", "上证指数", "szzs"),
    ("000016", "上证50", "sz50"),
    ("000300", "沪深300", "hs300"),
    ("000688", "科创50", "kc50"),
    ("000905", "中证500", "zz500"),
    ("000852", "中证1000", "zz1000"),
    ("399001", "深证成指", "szcz"),
    ("399006", "创业板指", "cybz"),
    ("399005", "中小100", "zx100"),
    ("399330", "深证100", "sz100"),
)


def index_dimension(spark: SparkSession) -> DataFrame:
    """The main indexes; some codes are also those of stocks, and the vendor codes take the index."""
    return spark.createDataFrame(list(INDEXES), "symbol string, name string, abbreviation string")


def mapping(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])


def timeframe_dimension(spark: SparkSession) -> DataFrame:
    rows = [(tf, minutes, rank, name, higher, lower) for rank, (tf, minutes, name, higher, lower) in enumerate(TIMEFRAMES)]
    return spark.createDataFrame(rows, "tf string, minutes int, rank int, dir_name string, higher string, lower string")


def parse_timeframe(name: Column) -> Column:
    """Timeframe of a name in any case, else null."""
    return F.try_element_at(mapping({n: tf for tf, names in TIMEFRAME_NAMES.items() for n in names}), F.lower(name))


def storage_name(tf: Column) -> Column:
    return F.try_element_at(mapping({t: name for t, _, name, _, _ in TIMEFRAMES}), tf)


def starts(code: Column, *prefixes: str) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | code.startswith(p)
    return found


def board(code: Column) -> Column:
    """Board of a code; the order of the tests matters."""
    return (
        F.when(starts(code, "688", "689"), "star")
        .when(starts(code, "300", "301"), "gem")
        .when(starts(code, "60"), "sh_main")
        .when(starts(code, "000", "001", "002", "003"), "sz_main")
        .when(starts(code, "4", "8", "9"), "bse")
        .when(starts(code, "6"), "sh_main")
        .otherwise("other")
    )


def market(code: Column) -> Column:
    return F.when(starts(code, "BK", "88"), "BK").when(starts(code, "6", "9"), "SH").otherwise("SZ")


def is_shanghai_index(code: Column) -> Column:
    return code.isin(*SHANGHAI_INDEXES)


def is_concept_board(code: Column) -> Column:
    return starts(code, "BK", "88")


def exchange(code: Column, unknown: str = "sz") -> Column:
    """Exchange for vendor codes; concept boards have none (null)."""
    return (
        F.when(is_concept_board(code), None)
        .when(starts(code, "92", "93", "83", "43"), "bj")
        .when(is_shanghai_index(code) | starts(code, "6", "9"), "sh")
        .when(starts(code, "0", "3"), "sz")
        .when(starts(code, "4", "8"), "bj")
        .otherwise(unknown)
    )


def prefixed_code(code: Column) -> Column:
    return F.concat(exchange(code), code)


def numeric_code(code: Column) -> Column:
    number = F.when(is_concept_board(code), "90.").when(exchange(code) == "sh", "1.").otherwise("0.")
    return F.concat(number, code)


def suffixed_code(code: Column) -> Column:
    return F.concat(code, F.lit("."), F.upper(exchange(code, "sh")))


def listed_on(code: Column, name: str) -> Column:
    """Listing predicates of the boards, somewhat wider than :func:`board`."""
    return {
        "sh_main": starts(code, "60") & ~starts(code, "688"),
        "sz_main": starts(code, "00"),
        "gem": starts(code, "30"),
        "star": starts(code, "68"),
        "bse": starts(code, "8", "4", "9"),
    }[name]


def abbreviation(name: Column, characters: dict[str, str]) -> Column:
    """Initials of a name by a character table; ASCII letters and digits stay, other characters go."""
    initials = F.translate(F.lower(name), "".join(characters), "".join(characters.values())) if characters else F.lower(name)
    return F.regexp_replace(initials, "[^a-z0-9]", "")
