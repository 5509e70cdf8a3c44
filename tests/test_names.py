"""Symbols and names in texts, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from finstrata.functions.lexicons import COMPANY_NAMES, NOT_TICKERS
from finstrata.functions.sentiment import keyword_scorer
from finstrata.operators import entities as E
from finstrata.operators import names as N

UNIVERSE = ["AAPL", "BRK-B", "TSLA", "NVDA", "CEO", "COST", "SHOP", "A", "MSFT"]


def detected(text, universe, names, blocked):
    """Each rule in turn, a pattern for each name."""
    text, found = text or "", {}
    symbol = lambda s: s.upper().replace(".", "-")
    for m in re.finditer(N.CASHTAG, text, re.ASCII):
        if symbol(m[1]) in universe:
            found.setdefault(symbol(m[1]), "$" + symbol(m[1]))
    for m in re.finditer(N.BARE, text):
        if symbol(m[1]) in universe and symbol(m[1]) not in blocked:
            found.setdefault(symbol(m[1]), m[1])
    for name, ticker in names.items():
        m = re.search(rf"\b{re.escape(name)}\b", text.lower())
        if m and ticker not in found:
            found[ticker] = text[m.start() : m.end()]
    return list(found.items())


TEXTS = [
    "I like $aapl and $BRK.B", "TSLA or Tesla, TSLA", "we love Nvidia", "CEO of the USA", None, "", "morgan stanley and Morgan  Stanley", "Coca-Cola's pineapple; (Apple)",
    "The COST is high, SHOP now; $COST", "NVDAx NVDA.Bx ABCDEFG AAPLs BRK.B BRK.Ba", "éapple Appleé apple2 apple_ -apple-", "mcdonalds mcdonald mcdonald's", "Morgan", "stanley morgan stanley", "coca-cola zero coca-colas",
    "goldman sachs", "$TSLA $tsla Tesla TSLA", "visa.visa", "a b c", "the walt disney company. The Walt Disney Company!", "amazon.com Inc. amazon.com inc", "at&t corp. or AT&T", "  ibm", "ibm",
]


@pytest.mark.parametrize("names", [None, {"the walt disney company": "DIS", "walt": "W", "amazon.com inc.": "AMZN", "at&t": "T", "apple": "AAPL", "morgan stanley": "MS", "coca-cola zero": "KO"}, {"ibm": "IBM"}])
def test_tickers_against_patterns(spark, names):
    rng = random.Random(1)
    pool = [w for t in TEXTS if t for w in t.split(" ")]
    texts = TEXTS + [rng.choice([" ", "  ", ", "]).join(rng.choice(pool) for _ in range(12)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = N.detect_tickers(rows, "k", "t", UNIVERSE, names).orderBy("k", "position").collect()
    for k, text in enumerate(texts):
        assert [(r.ticker, r.mentioned_as) for r in got if r.k == k] == detected(text, UNIVERSE, COMPANY_NAMES if names is None else names, NOT_TICKERS), text


def test_ten_thousand_names_have_the_same_plan(spark):
    def joins(n):
        table = spark.range(n).select(F.concat(F.lit("Supplier#"), F.col("id").cast("string"), F.lit(" Holdings Inc.")).alias("company_name"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"))
        rows = spark.createDataFrame([(1, "Shares of supplier#77 holdings rose; Supplier#9999 Holdings Inc. fell. Supplier#8 Holding"), (2, None)], "k long, t string")
        found = N.detect_tickers(rows, "k", "t", ["AAPL"], E.name_index(E.dimension(table)))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        return sorted((r.ticker, r.mentioned_as) for r in found.collect()), len(plan)

    few, size = joins(10)
    many, same = joins(10_000)
    assert few == [("T8", "Supplier#8")] and many == [("T77", "supplier#77 holdings"), ("T8", "Supplier#8"), ("T9999", "Supplier#9999 Holdings")] and abs(same - size) < 500


def test_blocked_words_from_a_file_and_from_texts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "the COST of a SHOP, AAPL"), (2, "cost and cost, to shop"), (3, "what a cost")], "k long, t string")
    of = lambda blocked: {r.ticker for r in N.detect_tickers(rows, "k", "t", UNIVERSE, {"x y": "X"}, blocked).collect()}
    (tmp_path / "words.txt").write_text("cost, the\nOF\n")
    assert of(None) == {"COST", "SHOP", "AAPL"} and of(N.read_words(spark, str(tmp_path / "words.txt"))) == {"SHOP", "AAPL"}
    assert {r.word for r in N.common_words(rows, "t", 0.5).collect()} == {"COST"}
    assert of(N.common_words(rows, "t", 0.3)) == {"AAPL"} and of(["AAPL"]) == {"COST", "SHOP"}


def test_capitalised_candidates(spark):
    text = "Bank of America and Tesla. Apple Inc. rose; éa Été 3M of Deutsche Bank AG, x. The Goldman Sachs Group lost to A.B.C Corp"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "no names here")], "k long, t string")
    runs = [r.s for r in rows.select(F.explode(N.capitalised(F.col("t"))).alias("s")).collect()]
    assert runs == ["Bank of America and Tesla", "Apple Inc", "Été 3M of Deutsche Bank AG", "The Goldman Sachs Group", "A.B.C Corp"]
    got = {r.entity for r in N.entity_candidates(rows, "k", "t", 3).collect()}
    assert {"Bank of America", "Tesla", "America and Tesla", "Deutsche Bank AG", "Goldman Sachs Group"} <= got and not {"Bank of", "3M of Deutsche", "The Goldman Sachs Group"} & got
    found = N.entities(rows, "k", "t", E.stocks(spark, [("BAC", "Bank of America Corp"), ("TSLA", "Tesla Inc."), ("AAPL", "Apple Inc."), ("DB", "Deutsche Bank AG"), ("GS", "The Goldman Sachs Group Inc.")])).collect()
    assert sorted((r.entity, r.ticker) for r in found) == [("Apple", "AAPL"), ("Bank of America", "BAC"), ("Deutsche Bank AG", "DB"), ("Goldman Sachs Group", "GS")]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_common_length():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(80))) for _ in "ab")
        assert N.common_length(a, b) == subsequence(a, b)


@pytest.mark.parametrize("least", [0.75, 0.85, 0.95])
def test_similar_names_against_all_pairs(spark, least):
    rng = random.Random(int(100 * least))
    known = ["".join(rng.choice("aabcde o") for _ in range(rng.randrange(1, 24))) for _ in range(150)] + ["microsoft", "microsoft corporation", "aaaaaaaa", "ab", "a"]

    def edited(name):
        out = list(name)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(out) + 1)
            out[at : at + rng.randrange(2)] = rng.choice(["", "x", "a"])
        return "".join(out)

    asked = sorted({edited(n) for n in known * 2} | {"microsft", "icrosoft", "aaaaaaa", "a"} - {""})
    got = N.similar(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(k,) for k in known], "known string"), least).collect()
    want = {(a, k) for a in asked for k in set(known) if N.ratio(a, k) >= least}
    assert {(r.asked, r.known) for r in got} == want and len(got) == len(want) > 100
    assert all(r.score == N.ratio(r.asked, r.known) for r in got)


def test_grams_that_names_share_rule_most_pairs_out():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshr") + rng.choice("etaoinshr") for _ in range(rng.randrange(1, 4)))
    known = [" ".join(word() for _ in range(12))[:58] for _ in range(300)]
    asked = [n[:2] + n[3:] for n in known[:100]] + known[100:102]
    got = list(N.near_pairs(asked, known, 0.845))
    assert {(a, k) for a in asked for k in known if N.ratio(a, k) >= 0.85} <= set(got)
    assert len(got) < 0.2 * len(asked) * len(known)  # under one of its 31 rarest grams, nearly each name meets each other
    counts = N.gram_counts(["aaaa", "ab", ""])
    assert counts.sum(1).tolist() == [5, 3, 1] and counts[0].max() == 1


def test_resolve(spark):
    asked = ["$aapl", "Tesla Inc.", "Microsft Corporation", "nobody", None, "Microsft", "icrosoft", "SEC", "Fed", "brk.b", "", "Walt Disny"]
    names = spark.createDataFrame([(a,) for a in asked], "name string")
    got = {r.name: (r.ticker, r.method) for r in N.resolve(names, E.stocks(spark)).collect()}
    fuzzy = {"Microsft Corporation": "MSFT", "Microsft": "MSFT", "icrosoft": "MSFT", "Walt Disny": "DIS"}
    assert got == {"$aapl": ("AAPL", "ticker"), "Tesla Inc.": ("TSLA", "name"), "brk.b": ("BRK-B", "ticker")} | {n: (t, "fuzzy") for n, t in fuzzy.items()}


def clause(text, start, size, around=80):
    """The shortest clause with the mention, places counted as approximately as the rule says."""
    first = max(0, start - around)
    window = text[first : start + size + around]
    best, length = window, len(window)
    for end in N.CLAUSE_ENDS:
        at = 0
        for part in re.split(end, window, flags=re.IGNORECASE):
            if at <= start - first < at + len(part):
                if 10 < len(part.strip()) < length:
                    best = part.strip()
                    length = len(best)
                break
            at += len(part) + 5
    best = best.strip()
    if len(best) < 20:
        at = 0
        for sentence in re.split(r"[.!?]+", text):
            if at <= start < at + len(sentence):
                best = sentence.strip() or best
                break
            at += len(sentence) + 1
    return best


def test_mention_contexts(spark):
    rng = random.Random(4)
    glue = [" while ", " but ", ", and ", "; ", ". ", " ", " ", " however ", "  though ", " WHEREAS ", ", BUT ", "! "]
    texts = ["".join(rng.choice(["TSLA", "rose", "fell again", "the market was quiet today", "Tesla", "$TSLA", "x"]) + rng.choice(glue) for _ in range(rng.randrange(2, 30))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = N.mentions(rows, "k", "t", ["TSLA"]).join(rows, "k").collect()
    assert len(got) > 40
    for r in got:
        form = r.mentioned_as.lstrip("$")
        start = re.search(rf"\b{form}\b", r.t, 0 if form == form.upper() and r.mentioned_as[0] != "$" else re.IGNORECASE).start()
        assert r.context == clause(r.t, start, len(form)), (r.t, r.mentioned_as)
    scored = N.scored_mentions(rows, "k", "t", ["TSLA"], keyword_scorer)
    assert scored.count() == len(got)


def test_the_dimension_of_a_table(spark):
    rows = spark.createDataFrame([("B", "Beta Corp", 2), ("A", "The Alpha Company", 1), ("B", "Beta Ltd", 3)], "ticker string, company_name string, at long")
    got = {r.ticker: (r.company_name, r.short_name, r.at) for r in E.dimension(rows).collect()}
    assert got == {"B": ("Beta Ltd", "Beta", 3), "A": ("The Alpha Company", "Alpha", 1)}
    assert E.dimension(rows.drop("at")).count() == 2


def test_long_runs_of_capitals_end(spark):
    word, run = "A&B" * 30_000, " ".join(["The Bank of"] * 10_000)
    rows = spark.createDataFrame([(1, word), (2, run + " x"), (3, "see Bank of America and Other-Name, U.S. of x")], "k long, text string")
    found = N.entity_candidates(rows, "k", "text").filter("k = 1 or k = 3").collect()
    assert {r.entity for r in found if r.k == 1} == {word}
    assert {r.run for r in found if r.k == 3} == {0, 1}
    assert N.entity_candidates(rows.filter("k = 2"), "k", "text").count() == 8  # of one to six words, none with a small word at an end


def test_names_that_end_with_a_mark_and_one_longest_name(spark):
    names = {"yahoo!": "YHOO", "amazon.com inc.": "AMZN", "big blue": "IBM"}
    texts = [(1, "We like Yahoo!x and BIG BLUE."), (2, "Yahoo! and amazon.com Inc.x"), (3, "Amazon.com Inc. fell"), (4, "big  blue BIG BLUEs")]
    found = N.detect_tickers(spark.createDataFrame(texts, "k long, text string"), "k", "text", ["IBM"], names).collect()
    assert {(r.k, r.ticker, r.mentioned_as) for r in found} == {(1, "YHOO", "Yahoo!"), (1, "IBM", "BIG BLUE"), (2, "AMZN", "amazon.com Inc.")}


def test_words_become_rows_only_if_they_are_looked_for(spark, monkeypatch):
    texts = [(1, "plain words " * 50 + "and Big  Blue, =IBM $ibm IBM of Tesla"), (2, "none at all"), (3, None), (4, "TESLA İtesla Teslas tesla-x")]
    rows, names = spark.createDataFrame(texts, "k long, text string"), {"big  blue": "IBM", "tesla": "TSLA"}
    found = rows.filter("text is not null").select("k", F.size(N.mentioned("text", 3, ["big", "$IBM", "tesla"])).alias("n")).collect()
    assert {r.k: r.n for r in found} == {1: 3, 2: 0, 4: 2}
    few = sorted(N.detect_tickers(rows, "k", "text", ["IBM"], names).collect())
    monkeypatch.setattr(N, "FEW_WORDS", 0)
    assert sorted(N.detect_tickers(rows, "k", "text", ["IBM"], names).collect()) == few and len(few) == 3
