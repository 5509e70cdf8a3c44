"""Symbols and company names in texts: candidates are taken from each text once and joined with a name table of any size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finstrata.functions.lexicons import COMPANY_NAMES, NOT_COMPANIES, NOT_TICKERS
from finstrata.functions.text import present
from finstrata.operators.entities import name_index, normalize_symbol
from finstrata.plans.tables import settle

# Patterns of symbols.
CASHTAG, BARE = r"\$([A-Za-z]{1,5}(?:\.[A-Za-z])?)\b", r"(?<![A-Za-z0-9])([A-Z]{2,5}(?:\.[A-Z])?)(?![a-z])"
# What parts clauses, in the order in which it is tried.
CLAUSE_ENDS = (r"\s+while\s+", r"\s+but\s+", r"\s+however\s+", r"\s+whereas\s+", r"\s+although\s+", r"\s+though\s+", r",\s+and\s+", r",\s+but\s+", r";\s+")
RUNS, WORD = r"(?U)\w+|\W+", r"(?U)^\w"
TAG, SYMBOL, NAME = 0, 1, 2  # kinds of mentions, in the order in which they count
FEW_WORDS = 2_000  # up to so many are looked for within each text, before its words become rows
MARKS = ("$", "=")  # what tags and symbols begin with, beside words, which begin with neither

Words = list[str] | DataFrame
Names = dict[str, str] | DataFrame


def runs(text: Column) -> Column:
    """A text's words and what stands between them, in turn."""
    return F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))


def joined(parts: Column, start: Column | int, count: int) -> Column:
    return F.array_join(F.slice(parts, start, count), "")


def column_of(spark: SparkSession, words: Words, name: str) -> DataFrame:
    """A list or the first column of a frame."""
    if isinstance(words, DataFrame):
        return words.select(F.col(words.columns[0]).cast("string").alias(name)).distinct()
    return spark.createDataFrame([(w,) for w in dict.fromkeys(words)], f"{name} string")


def name_table(spark: SparkSession, names: Names) -> DataFrame:
    """(name, ticker, at): the names in lower case, in the order in which they are looked for."""
    if isinstance(names, DataFrame):
        order = F.col("priority") if "priority" in names.columns else F.lit(0)
        return names.select(F.lower("name").alias("name"), "ticker", F.struct(order.cast("long").alias("first"), F.col("name").alias("then")).alias("at"))
    rows = [(n.lower(), t, (i, n)) for i, (n, t) in enumerate(names.items())]
    return spark.createDataFrame(rows, "name string, ticker string, at struct<first: long, then: string>")


def common_words(rows: DataFrame, text: str, share: float = 0.01) -> DataFrame:
    """(word): words of two to five letters that so large a share of the texts has in lower case, in upper case. They are no symbols
    when they stand in capitals: what a list of common words says is taken from the texts themselves."""
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(present(F.col(text)), F.lit(r"\b[a-z]{2,5}\b"), F.lit(0)))).alias("w"))
    texts = rows.agg(F.count("*").alias("texts"))
    return words.groupBy("w").agg(F.count("*").alias("n")).join(F.broadcast(texts)).filter(F.col("n") >= share * F.col("texts")).select(F.upper("w").alias("word"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): a list of words in a text file, parted by white space or commas, in upper case."""
    return spark.read.text(path).select(F.explode(F.split(F.upper("value"), r"[\s,]+")).alias("word")).filter("word <> ''").distinct()


def heads(universe: DataFrame, blocked: DataFrame, names: DataFrame) -> DataFrame:
    """(kind, word, head, name, ticker, at): what a text is searched for. The head of a name is its first word, or its first two with what
    stands between them: many names begin with the same word."""
    symbols = universe.select(F.lit(TAG).alias("kind"), F.col("ticker").alias("head"), "ticker").unionByName(universe.join(blocked, universe["ticker"] == blocked["word"], "left_anti").select(F.lit(SYMBOL).alias("kind"), F.col("ticker").alias("head"), "ticker"))
    symbols = symbols.select("kind", F.col("head").alias("word"), "head", F.lit("").alias("name"), "ticker", F.struct(F.lit(0).cast("long").alias("first"), F.lit("").alias("then")).alias("at"))
    parts = names.withColumn("parts", runs(F.col("name"))).filter(F.col("name").rlike(WORD))
    head = F.when(F.size("parts") > 2, joined(F.col("parts"), 1, 3)).otherwise(F.col("parts")[0])
    return symbols.unionByName(parts.select(F.lit(NAME).alias("kind"), F.col("parts")[0].alias("word"), head.alias("head"), "name", "ticker", "at"))


def looked_up(word: Column) -> Column:
    """A tag, symbol or word as it is looked for."""
    return F.when(F.left(word, F.lit(1)).isin(*MARKS), word).otherwise(F.lower(word))


def mentioned(text: str, longest: int, listed: list[str] | None = None) -> Column:
    """All that may be a mention: struct(word, form), tags first, then symbols, which come with a mark, then words. A word's form is the text from
    there on, a bit longer than the longest name; one pattern finds all of them. If it is ``listed`` what is looked for, all others are left out,
    and forms are made only for texts that have any of the words."""
    every = lambda pattern, group: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
    symbols = lambda pattern, mark: F.transform(every(pattern, 1), lambda s: F.struct(F.concat(F.lit(mark), normalize_symbol(s)).alias("word"), s.alias("form")))
    forms = rf"(?U)(?=(\w+(?:\W+\w+){{0,{longest // 2}}}+\W?))\w+"
    words = F.arrays_zip(every(forms, 0).alias("word"), every(forms, 1).alias("form"))
    if listed is not None:
        some = F.exists(every(r"(?U)\w+", 0), lambda w: F.lower(w).isin(listed))
        words = F.when(some, words).otherwise(F.array().cast("array<struct<word: string, form: string>>"))
    all_ = F.concat(symbols(CASHTAG, MARKS[TAG]), symbols(BARE, MARKS[SYMBOL]), words)
    return all_ if listed is None else F.filter(all_, lambda m: looked_up(m["word"]).isin(listed))


def detect_tickers(rows: DataFrame, key: str, text: str, universe: Words, names: Names | None = None, blocked: Words | None = None) -> DataFrame:
    """(key, position, ticker, mentioned_as): $tags, then bare upper-case symbols, then company names; each ticker once, in the form in
    which it is found first.

    ``universe`` holds the tickers that symbols are tested against, ``names`` company names and their tickers (a dict, or a frame like
    that of entities.name_index), ``blocked`` upper-case words that are no symbols; each may be a table of any size. Every word of
    a text is joined with the first words of names, what is left with their heads, so the plan is the same for ten names or ten thousand;
    words and heads are broadcast up to 200,000, and shuffled beyond; up to FEW_WORDS, words that are none of theirs don't become rows. Names that don't begin with a letter or digit aren't found.
    """
    spark = rows.sparkSession
    known = name_table(spark, COMPANY_NAMES if names is None else names)
    searched = heads(column_of(spark, universe, "ticker"), column_of(spark, NOT_TICKERS if blocked is None else blocked, "word"), known)
    longest = known.agg(F.max(F.size(runs(F.col("name"))))).first()[0] or 1
    marked = F.concat(F.when(F.col("kind") == TAG, MARKS[TAG]).when(F.col("kind") == SYMBOL, MARKS[SYMBOL]).otherwise(""), "word")
    searched = settle(searched.withColumn("word", marked))
    # sizes of tables that come from lists aren't known to Spark, which would shuffle all words
    light = F.broadcast if searched.count() <= 200_000 else lambda df: df
    few = [r["word"] for r in searched.select("word").distinct().limit(FEW_WORDS + 1).collect()]
    found = rows.select(key, present(F.col(text)).alias("_text")).select(key, F.posexplode(mentioned("_text", longest, few if len(few) <= FEW_WORDS else None)).alias("at", "m"))
    found = found.select(key, "at", looked_up(F.col("m.word")).alias("word"), "m.form")
    found = found.join(light(searched.select("word", "kind").distinct()), "word")  # few words are left
    two = F.lower(F.regexp_extract("form", r"(?U)^\w+\W+\w+", 0))
    own = F.when(F.col("kind") == NAME, F.col("word")).otherwise(F.substring("word", 2, 1 << 30))
    tried = F.when((F.col("kind") != NAME) | (two == "") | F.lit(longest <= 2), F.array(own)).otherwise(F.array(own, two))
    found = found.withColumn("form", F.when(F.col("kind") == TAG, F.col("word")).otherwise(F.col("form")))
    found = found.withColumn("head", F.explode(tried)).drop("word").join(light(searched.drop("word").withColumnRenamed("at", "order")), ["kind", "head"])
    # a name must end where a word ends or begins, as it does where the text goes on with the other kind of character
    size = F.length("name")
    after, last = F.substr("form", size + 1, F.lit(1)), F.right("name", F.lit(1))
    whole = (F.lower(F.left("form", size)) == F.col("name")) & ((after == "") & last.rlike(WORD) | (after != "") & (after.rlike(WORD) != last.rlike(WORD)))
    found = found.filter((F.col("kind") != NAME) | whole)
    found = found.withColumn("form", F.when(F.col("kind") == NAME, F.left("form", size)).otherwise(F.col("form")))
    order = F.struct("kind", "order", "at", "form")
    first = found.repartition(F.col(key)).groupBy(key, "ticker").agg(F.min(order).alias("m"))
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("m")).alias("position"), "ticker", F.col("m.form").alias("mentioned_as"))


# A word with single marks within it, and small words that may stand between the words of a name.
# Possessive, as there is nothing to go back for: Java's other loops over groups recurse, and overflow the stack on long runs.
LETTERS, BETWEEN = r"(?:[.&'’#-]?[\p{L}\p{Nd}])*+", r"(?:(?:of|and|the|for|&) )?"


def capitalised(text: Column) -> Column:
    """What may be names: the longest runs of words that begin with a capital or a digit, parted by single spaces or small words; the first
    begins with a capital."""
    run = rf"(?<![\p{{L}}\p{{Nd}}])\p{{Lu}}{LETTERS}(?: {BETWEEN}[\p{{Lu}}\p{{Nd}}]{LETTERS})*+"
    return F.regexp_extract_all(present(text), F.lit(run), F.lit(0))


def entity_candidates(rows: DataFrame, key: str, text: str, longest: int = 6) -> DataFrame:
    """(key, run, entity): of each run of capitalised words all parts of up to ``longest`` words that begin with a capital and don't end with
    a small word."""
    starts = rows.select(key, F.posexplode(capitalised(F.col(text))).alias("run", "_all")).withColumn("_words", F.split("_all", " "))
    ends = lambda i: F.sequence(i, F.least(F.size("_words"), i + longest - 1))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_words")), lambda i: F.transform(ends(i), lambda j: F.slice("_words", i, j - i + 1))))
    named = F.filter(parts, lambda p: p[0].rlike(r"^\p{Lu}") & F.element_at(p, -1).rlike(r"^[\p{Lu}\p{Nd}]"))
    return starts.select(key, "run", F.explode(F.array_distinct(F.transform(named, lambda p: F.array_join(p, " ")))).alias("entity"))


def entities(rows: DataFrame, key: str, text: str, dimension: DataFrame) -> DataFrame:
    """(key, run, entity, ticker): of each run of capitalised words the longest part that the name index has (of as long ones, the first in
    the alphabet)."""
    found = entity_candidates(rows, key, text).join(name_index(dimension).select("name", "ticker"), F.lower("entity") == F.col("name"))
    best = found.groupBy(key, "run").agg(F.min(F.struct((-F.length("entity")).alias("size"), "entity", "ticker")).alias("m"))
    return best.select(key, "run", "m.entity", "m.ticker")


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, a row of the table in one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence as a share of both lengths, to two digits."""
    return round(200 * common_length(a, b) / max(1, len(a) + len(b))) / 100


GRAM_PLACES, PIECE = 2048, 1024  # into how many places grams are hashed; about how many names one piece of work has of each side


def gram_counts(names: list[str]) -> np.ndarray:
    """(names, GRAM_PLACES): each name's pairs of letters, with one more at each end, counted by hash; those that repeat are numbered first."""
    letters = np.frombuffer("".join(f"\x02{n}\x03" for n in names).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(n) + 2 for n in names])
    of = np.repeat(np.arange(len(names)), sizes)
    inside = of[:-1] == of[1:]
    pairs, of = (letters[:-1] << np.uint64(32) | letters[1:])[inside], of[:-1][inside]
    order = np.lexsort((pairs, of))
    pairs, of = pairs[order], of[order]
    new = np.r_[True, (pairs[1:] != pairs[:-1]) | (of[1:] != of[:-1])]
    nth = np.arange(len(pairs)) - np.maximum.accumulate(np.where(new, np.arange(len(pairs)), 0))
    hashed = (pairs * np.uint64(0x9E3779B97F4A7C15)) ^ (nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    at = (hashed ^ hashed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(53)
    return np.bincount(of * GRAM_PLACES + at.astype(np.int64), minlength=len(names) * GRAM_PLACES).reshape(len(names), GRAM_PLACES).astype(np.float32)


def near_pairs(asked: list[str], known: list[str], bound: float) -> Iterator[tuple[str, str]]:
    """The pairs that share as many grams as a ratio of ``bound`` takes, by hash: none of these is missed, some others are among them.

    Two names of S letters together whose ratio is at least t share S (1.5 t - 1) + 1 grams or more, as a letter that is left out costs
    two grams and a letter put in one.
    """
    a, b = np.array([len(x) for x in asked]), np.array([len(x) for x in known])
    letters = a[:, None] + b
    shared = gram_counts(asked) @ gram_counts(known).T
    near = (shared >= letters * (1.5 * bound - 1) + 1 - 1e-3) & (np.abs(a[:, None] - b) <= (1 - bound) * letters + 1e-9)
    for i, j in zip(*np.nonzero(near), strict=True):
        yield asked[i], known[j]


def similar(names: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """(asked, known, score): all pairs of a name and a known one whose ratio is at least ``least`` (over 0.7).

    Names are dealt into bands of like lengths and those into parts of some 1,000; parts whose bands may have pairs meet, and one product of
    matrices counts the grams that their names share. Pairs that share enough are verified. The work is quadratic, of fixed size for
    each pair of parts, and spread over all tasks.
    """
    bound, step = least - 0.005, math.log(1.1)  # ratios are rounded
    reach = math.ceil(math.log((2 - bound) / bound) / step)  # of two lengths one is at most so much longer

    def parted(rows: DataFrame, name: str, side: str) -> tuple[DataFrame, DataFrame]:
        rows = rows.select(name).distinct().filter(F.length(name) > 0).withColumn(f"{side}_band", F.floor(F.log(F.length(name)) / step))
        sizes = settle(rows.groupBy(f"{side}_band").agg(F.ceil(F.count("*") / PIECE).alias(f"{side}_parts")))  # a row for each band
        rows = rows.join(F.broadcast(sizes), f"{side}_band").withColumn(f"{side}_part", F.pmod(F.xxhash64(name), F.col(f"{side}_parts")))
        return rows.drop(f"{side}_parts"), sizes

    (left, left_sizes), (right, right_sizes) = parted(names, "asked", "a"), parted(known, "known", "k")
    meet, key = F.abs(F.col("a_band") - F.col("k_band")) <= reach, ["a_band", "a_part", "k_band", "k_part"]
    every = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{side}_parts") - 1)).alias(f"{side}_part")
    left = left.join(F.broadcast(right_sizes), meet).select("asked", "a_band", "a_part", "k_band", every("k"))
    right = right.join(F.broadcast(left_sizes), meet).select("known", "k_band", "k_part", "a_band", every("a"))

    def scored(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        pairs = near_pairs(list(some["asked"]), list(others["known"]), bound) if len(some) and len(others) else ()
        rows = [(a, k, ratio(a, k)) for a, k in pairs]
        return pd.DataFrame([r for r in rows if r[2] >= least - 1e-9], columns=["asked", "known", "score"])

    dealt = lambda rows: rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, *key).groupBy(*key)  # noqa: E731  much work for each row
    return dealt(left).cogroup(dealt(right)).applyInPandas(scored, "asked string, known string, score double")


def resolve(names: DataFrame, dimension: DataFrame, least: float = 0.85) -> DataFrame:
    """(name, ticker, method, score): exact ticker, exact name, else the name of the index with the best ratio of at least ``least``; of equal
    ones the smallest ticker counts. Names of NOT_COMPANIES resolve to nothing; names that aren't found are left out.
    """
    index = settle(name_index(dimension).select(F.col("name").alias("known"), "ticker"))  # read several times, as the names asked for are
    asked = names.select("name").distinct().withColumn("asked", F.lower(F.trim("name"))).filter(F.col("asked") != "").filter(~F.col("asked").isin(*NOT_COMPANIES))
    asked = settle(asked.withColumn("asked", F.regexp_replace("asked", r"^\$", "")))
    match = lambda rows, order, method, score: rows.select("name", "ticker", F.lit(order).alias("order"), F.lit(method).alias("method"), score.alias("score"))
    by_ticker = match(asked.join(dimension.select("ticker").distinct(), F.translate(F.upper("asked"), ".", "-") == F.col("ticker")), 0, "ticker", F.lit(1.0))
    by_name = match(asked.join(index, F.col("asked") == F.col("known")), 1, "name", F.lit(1.0))
    rest = settle(asked.join(by_ticker.select("name"), "name", "left_anti").join(by_name.select("name"), "name", "left_anti"))
    fuzzy = match(similar(rest, index, least).join(rest, "asked").join(index, "known"), 2, "fuzzy", F.col("score"))
    best = by_ticker.unionByName(by_name).unionByName(fuzzy).groupBy("name").agg(F.min(F.struct("order", (-F.col("score")).alias("worse"), "ticker", "method")).alias("m"))
    return best.select("name", "m.ticker", "m.method", (-F.col("m.worse")).alias("score"))


def mention_start(text: Column, form: Column) -> Column:
    """Where a mention stands, from 0: symbols as they are, other forms in any case, as whole words."""
    bare = F.regexp_replace(form, r"^\$", "")
    any_case = form.startswith("$") | ~bare.rlike(r"^[A-Z.]+$")
    quoted = F.regexp_replace(F.regexp_replace(bare, r"([^\p{L}\p{Nd}\s])", r"\\$1"), r"\\-", "[.-]")
    at = F.regexp_instr(text, F.concat(F.when(any_case, "(?i)").otherwise(""), F.lit(r"\b"), quoted))
    return F.greatest(at - 1, F.lit(0))


def part_at(parts: Column, at: Column, gap: int) -> Column:
    """The first part that reaches over a place; what parts them counts as ``gap`` characters."""
    def step(acc: Column, part: Column) -> Column:
        end = acc["end"] + F.length(part)
        hit = acc["part"].isNull() & (acc["end"] <= at) & (at < end)
        return F.struct((end + gap).alias("end"), F.when(hit, part).otherwise(acc["part"]).alias("part"))

    start = F.struct(F.lit(0).alias("end"), F.lit(None).cast("string").alias("part"))
    return F.aggregate(parts, start, step, lambda acc: acc["part"])


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def mention_context(text: Column, start: Column, size: Column, around: int = 80, shortest: int = 20) -> Column:
    """The shortest clause with a mention, of what stands within ``around`` characters; if it is short, the sentence.

    Clauses are split at each of CLAUSE_ENDS in turn, and one counts if it is shorter than the best so far and longer than ten characters.
    """
    first = F.greatest(start - around, F.lit(0))
    shorter = lambda best, clause: F.when((F.length(clause) < F.length(best)) & (F.length(clause) > 10), clause).otherwise(best)

    def context(window: Column) -> Column:
        clauses = F.array(*(strip(part_at(F.split(window, f"(?i){end}", -1), start - first, 5)) for end in CLAUSE_ENDS))
        return strip(F.aggregate(clauses, window, shorter))

    window = F.substr(text, first + 1, start + size + around - first)
    found = F.get(F.transform(F.array(window), context), F.lit(0))  # the window is made once
    sentence = strip(part_at(F.split(text, r"[.!?]+", -1), start, 1))
    return F.get(F.transform(F.array(found), lambda f: F.when(F.length(f) < shortest, F.coalesce(F.nullif(sentence, F.lit("")), f)).otherwise(f)), F.lit(0))


def mentions(rows: DataFrame, key: str, text: str, universe: Words, longest: int | None = None, names: Names | None = None) -> DataFrame:
    """Each ticker that a text mentions, with its context; texts of under 10 characters are passed over. ``longest``: what of a text is read."""
    cut = rows.filter(F.length(text) >= 10)
    if longest is not None:
        cut = cut.withColumn(text, F.substring(text, 1, longest))
    found = detect_tickers(cut, key, text, universe, names).join(cut.select(key, text), key)
    found = found.withColumn("_start", mention_start(F.col(text), F.col("mentioned_as")))
    size = F.length(F.regexp_replace("mentioned_as", r"^\$", ""))
    return found.withColumn("context", mention_context(F.col(text), F.col("_start"), size)).drop(text, "_start")


def scored_mentions(rows: DataFrame, key: str, text: str, universe: Words, scorer, names: Names | None = None) -> DataFrame:
    """mentions() with the label and score of each mention's context."""
    found = scorer(mentions(rows, key, text, universe, names=names), "context")
    return found.select(key, "position", "ticker", "mentioned_as", "context", "sentiment_label", "sentiment_score")
