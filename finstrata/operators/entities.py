"""The stock dimension, its name index, and hints of symbols; names.py finds them in texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.functions.columns import strings
from finstrata.functions.lexicons import STOCKS
from finstrata.functions.text import present

# Company-name suffixes, in the order in which they are tried.
SUFFIXES = (
    ", Inc.", ", Inc", ", Corp.", ", Corp", ", Corporation", ", Ltd.", ", Ltd", ", Limited", ", LLC", ", L.L.C.", ", PLC", ", Co.",
    " Inc.", " Inc", " Corp.", " Corp", " Corporation", " Ltd.", " Ltd", " Limited", " LLC", " L.L.C.", " PLC", " Co.", " Company", " & Co.",
    "/Inc", "/DE", "/MD", "/NV", "/PA",
)
SKIPPED = ("the", "inc", "corp", "ltd", "llc", "plc", "new", "first", "american", "national", "united")
CONTEXT = {"price": "price|trading|shares|stock", "earnings": "earnings|revenue|profit|quarter", "movement": "up|down|gain|loss|rose|fell", "analyst": "analyst|rating|upgrade|downgrade|target", "market": "market|investor|portfolio|fund"}


def normalize_symbol(symbol: Column) -> Column:
    return F.translate(F.upper(F.regexp_replace(F.trim(symbol), r"^\$+", "")), ".", "-")


def stocks(spark, rows=STOCKS) -> DataFrame:
    """The stock dimension: ticker, company_name, short_name, common_names, at (its order). Of repeated tickers the last one counts.

    ``rows``: (ticker, company name) or (ticker, company name, list of common names).
    """
    full = [(i, *x, *([[]] if len(x) == 2 else [])) for i, x in enumerate(rows)]
    return dimension(spark.createDataFrame(full, "at long, ticker string, company_name string, common_names array<string>"))


def dimension(rows: DataFrame) -> DataFrame:
    """The stock dimension from a table of any size: ticker, company_name, and if there are any common_names and at. Without ``at`` the
    order is that of the tickers' hashes. Of repeated tickers the last one counts."""
    given = rows.columns
    common = F.col("common_names") if "common_names" in given else F.array().cast("array<string>")
    rows = rows.select("ticker", "company_name", common.alias("common_names"), (F.col("at") if "at" in given else F.xxhash64("ticker")).cast("long").alias("at"))
    last = rows.groupBy("ticker").agg(F.max(F.struct("at", "company_name", "common_names")).alias("r"))
    return last.select("ticker", "r.company_name", short_name(F.col("r.company_name")).alias("short_name"), "r.common_names", "r.at")


def short_name(name: Column) -> Column:
    """A company's name without the first of SUFFIXES that it ends with, a state's code, and THE before it."""
    low = F.lower(name)
    ended = F.coalesce(*(F.when(F.endswith(low, F.lit(s.lower())), F.left(name, F.length(name) - len(s))) for s in SUFFIXES), name)
    return F.trim(F.regexp_replace(F.regexp_replace(ended, r"\s*[-/]\s*[A-Z]{2}$", ""), r"(?i)^the ", ""))


def name_index(dimension: DataFrame) -> DataFrame:
    """(name, ticker, priority): full names (0; the last stock's counts), then in the stocks' order, and the first counts: common names (1),
    short ones (2), first words of more than three letters that say something (3)."""
    low = lambda c: F.lower(F.trim(c))
    first = F.lower(F.split(F.col("company_name"), r"\s+")[0])
    kind = lambda name, k: F.struct(name.alias("name"), F.lit(k).alias("priority"))
    names = F.array(kind(low(F.col("company_name")), 0), kind(low(F.col("short_name")), 2), kind(F.when((F.length(first) > 3) & ~first.isin(*SKIPPED), first).otherwise(""), 3))
    common = F.transform(F.coalesce("common_names", F.array().cast("array<string>")), lambda n: kind(low(n), 1))
    rows = dimension.select("ticker", "at", F.explode(F.concat(names, common)).alias("n")).select("n.*", "ticker", "at").filter("name <> ''")
    order = [F.col("priority") > 0, F.when(F.col("priority") == 0, -F.col("at")).otherwise(F.col("at")), "priority", "ticker"]
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy(*order))).filter("k = 1").select("name", "ticker", "priority")


def search(dimension: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Stocks whose ticker is the query, then those whose name has it."""
    exact = F.col("ticker") == query.upper()
    found = dimension.filter(exact | F.lower("company_name").contains(query.lower()))
    found = found.select("ticker", "company_name", "short_name")
    return found.withColumn("rank", F.when(exact, 0).otherwise(1)).orderBy("rank", "ticker").limit(limit)


def context_flags(text: Column) -> dict[str, Column]:
    """Which kinds of financial words a text has, and whether two or more kinds make it likely to be about stocks."""
    low = F.lower(present(text))
    flags = {f"has_{name}": low.rlike(rf"\b(?:{words})\b") for name, words in CONTEXT.items()}
    count = reduce(lambda a, b: a + b, (f.cast("int") for f in flags.values()))
    return flags | {"financial": count >= 2}


def hints(groups: Column) -> Column:
    """Symbols among search words: those of at most five letters or digits in upper case."""
    return F.array_distinct(F.filter(F.transform(groups, normalize_symbol), lambda s: s.rlike(r"^[A-Z0-9]{1,5}$")))


def symbols_in(info: Column) -> Column:
    """Symbols in a list's or dict's text form."""
    return F.array_distinct(F.regexp_extract_all(present(info), F.lit(r"['\"]([A-Z]{1,5}(?:[.-][A-Z])?)['\"]"), F.lit(1)))


def article_hints(rows: DataFrame, key: str, mentioned: Column, named: Column, related: Column, universe: DataFrame, most_related: int = 5) -> DataFrame:
    """(key, hints): the known symbols of an article, each once: its companies, then the keys and names of its entities (structs of
    company_key and normalized), then its first related companies. ``universe`` is a table of tickers."""
    none = F.array().cast("array<string>")
    of_names = F.flatten(F.transform(F.coalesce(named, F.array().cast("array<struct<company_key:string,normalized:string>>")), lambda n: F.array(n["company_key"], n["normalized"])))
    listed = F.concat(F.coalesce(mentioned, none), of_names, F.slice(F.coalesce(related, none), 1, most_related))
    symbols = rows.select(key, F.posexplode(F.transform(listed, normalize_symbol)).alias("at", "ticker"))
    first = symbols.join(universe.select("ticker").distinct(), "ticker").groupBy(key, "ticker").agg(F.min("at").alias("at"))
    found = first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "ticker"))), lambda x: x["ticker"]).alias("hints"))
    return rows.select(key).distinct().join(found, key, "left").withColumn("hints", F.coalesce("hints", none))


def union_hints(tickers: Column, more: Column, universe: list[str]) -> Column:
    return F.array_distinct(F.concat(tickers, F.filter(F.coalesce(more, strings([]).cast("array<string>")), lambda s: s.isin(universe))))
