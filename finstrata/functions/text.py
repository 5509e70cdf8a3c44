"""Text functions as column expressions; a null text counts as an empty one."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from finstrata.functions.columns import half_up, strings
from finstrata.functions.lexicons import FINANCIAL_TERMS, INTENSITY_WORDS, SPAM_PATTERNS, STOP_WORDS

# Patterns.
URL = r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*(),\\]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
PLAIN_URL = r"https?://\S+"
NEGATIONS = "(?:not|no|never|neither|nobody|nothing|nowhere|n't)"
MOVEMENT = r"(?i)\b(up|down|gained?|lost|rose|fell|increased?|decreased?)\s+[\d.]+\s*[%$]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]"


def present(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def tokens(text: Column) -> Column:
    """The runs between white space."""
    return F.filter(F.split(present(text), r"\s+"), lambda t: t != "")


# Where a sentence ends and the next one begins; the rules of the Penn Treebank's tokenisation, applied in this order to each
# sentence: opening quotes, punctuation, brackets and dashes; then, between spaces, closing quotes, clitics and contractions.
SENTENCE_END = r"""([.!?]["')\]]*)\s+(["'(\[\p{Lu}\d])"""
TREEBANK_FIRST = (
    (r'^"', "``"), (r"(``)", r" \1 "), (r"""([ (\[{<])("|'{2})""", r"\1 `` "),
    (r"([:,])([^\d])", r" \1 \2"), (r"([:,])$", r" \1 "), (r"\.\.\.", r" ... "), (r"([;@#$%&])", r" \1 "), (r"""([^.])(\.)([\])}>"']*)\s*$""", r"\1 \2\3 "), (r"([?!])", r" \1 "), (r"([^'])' ", r"\1 ' "),
    (r"([\]\[(){}<>])", r" \1 "), (r"--", r" -- "),
)
TREEBANK_THEN = (
    (r'"', r" '' "), (r"(\S)('')", r"\1 \2 "), (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    (r"(?i)\b(can)(not)\b", r" \1 \2 "), (r"(?i)\b(d)('ye)\b", r" \1 \2 "), (r"(?i)\b(gim|lem)(me)\b", r" \1 \2 "), (r"(?i)\b(gon|wan)(na)\b", r" \1 \2 "), (r"(?i)\b(got)(ta)\b", r" \1 \2 "),
    (r"(?i)\b(more)('n)\b", r" \1 \2 "), (r"(?i) ('t)(is|was)\b", r" \1 \2 "),
)


# The steps of both lists in turn with what a sentence must have for any of a step's rules to match; most sentences have few of these.
TREEBANK_STEPS = (
    (("\"", "``", "''"), TREEBANK_FIRST[:3]), ((":", ","), TREEBANK_FIRST[3:5]), (("...",), TREEBANK_FIRST[5:6]), (tuple(";@#$%&"), TREEBANK_FIRST[6:7]), ((".",), TREEBANK_FIRST[7:8]),
    (("?", "!"), TREEBANK_FIRST[8:9]), (("'",), TREEBANK_FIRST[9:10]), (tuple("][(){}<>"), TREEBANK_FIRST[10:11]), (("--",), TREEBANK_FIRST[11:]),
), (
    (('"',), TREEBANK_THEN[:1]), (("'",), TREEBANK_THEN[1:4]), ("(?i)cannot|gimme|lemme|gonna|wanna|gotta|d'ye|more'n|'tis|'twas", TREEBANK_THEN[4:]),
)


def treebank(text: Column) -> Column:
    """Words as the Penn Treebank parts them: ``don't`` is ``do n't``, punctuation is by itself, only a sentence's last full stop is one."""
    java = lambda by: re.sub(r"\\(\d)", r"$\1", by)

    def step(before: Column, marks: tuple[str, ...] | str, rules: tuple) -> Column:
        def applied(t: Column) -> Column:
            out = t
            for pattern, by in rules:
                out = F.regexp_replace(out, pattern, java(by))
            has = t.rlike(marks) if isinstance(marks, str) else reduce(lambda a, b: a | b, (t.contains(m) for m in marks))
            return F.when(has, out).otherwise(t)

        return F.transform(before, applied)  # what a step begins with is made once

    first, then = TREEBANK_STEPS
    marked = F.regexp_replace(present(text), SENTENCE_END, "$1\x01$2")
    out = F.transform(F.split(marked, "\x01"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    out = reduce(lambda x, how: step(x, *how), first, out)
    out = F.transform(out, lambda s: F.concat(F.lit(" "), s, F.lit(" ")))
    return F.flatten(F.transform(reduce(lambda x, how: step(x, *how), then, out), tokens))


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def replaced(text: Column, mark: str, *steps: tuple[str, str]) -> Column:
    """Replaces the patterns one after the other in texts that have the mark, without which none of them can match."""
    def all_steps(t: Column) -> Column:
        out = t
        for pattern, by in steps:
            out = F.regexp_replace(out, pattern, by)
        return F.when(t.contains(mark), out).otherwise(t)

    return F.get(F.transform(F.array(text), all_steps), F.lit(0))  # the text is made once


def join_negations(text: Column) -> Column:
    """``not good`` becomes ``not_good``: a token that starts with a negation takes the next one in, which then joins no other."""
    # a match takes both tokens, so none is taken twice; a negation at the end stays by itself
    return F.regexp_replace(F.array_join(tokens(text), " "), rf"(?i)(?<![^ ])({NEGATIONS}\b(?:[^ ]*[^ .,!?;:])?)[.,!?;:]*+ ([^ ]+)", "$1_$2")


def normalize_text(text: Column, urls: bool = True, emails: bool = True, mentions: bool = True, hashtags: bool = True, numbers: bool = False, lower: bool = True, keep_financial: bool = False, negations: bool = False) -> Column:
    """Removes URLs, addresses, mentions, numbers and punctuation, opens hashtags; each step can be left out."""
    out = join_negations(text) if negations else present(text)
    if urls:
        out = replaced(out, "://", (URL, ""))
    if emails:
        out = replaced(out, "@", (r"\S+@\S+", ""))
    if mentions:
        out = replaced(out, "@", (r"(?U)@\w+", ""))
    if hashtags:  # camel case is opened within a tag only
        out = replaced(out, "#", (r"(?U)(?<=[a-z])(?=[A-Z])(?<=#\w{0,200})", " "), (r"(?U)#(\w+)", "$1"))
    if numbers:
        out = F.regexp_replace(out, r"\b\d+\.?\d*[kKmMbB]?\b", "")
    kept = "%$._" if keep_financial else "_" if negations else ""
    out = F.regexp_replace(out, "[" + "".join("\\" + c for c in PUNCTUATION if c not in kept) + "]+", "")
    out = one_space(out)
    return F.lower(out) if lower else out


def clean_news(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(present(text), r"<[^>]+>", ""), PLAIN_URL, "")
    return one_space(F.regexp_replace(F.regexp_replace(out, r"\[\+\d+ chars\]", ""), r"(?i)\[Removed\]", ""))


def clean_tweet(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(present(text), PLAIN_URL, ""), r"(?U)@\w+", "")
    return one_space(F.regexp_replace(out, r"(?U)#(\w+)", "$1"))


def clean_post(text: Column) -> Column:
    return one_space(F.regexp_replace(present(text), PLAIN_URL, ""))


def remove_stop_words(words: Column, custom: tuple[str, ...] = (), keep_financial: bool = True) -> Column:
    spared = {*FINANCIAL_TERMS, *INTENSITY_WORDS} if keep_financial else set()
    gone = [w for w in STOP_WORDS if w not in spared] + list(custom)
    return F.filter(words, lambda w: ~F.lower(w).isin(gone))


def lemma(word: Column) -> Column:
    """A noun's singular by rules; there is no dictionary here."""
    return (
        F.when(word.rlike("(?i)[a-z]{2,}ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(?i)(ss|us|is)$"), word)
        .when(word.rlike("(?i)(sh|ch|x|z|ss)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("(?i)[a-z]{2,}s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def lemmatize(words: Column) -> Column:
    return F.transform(words, lemma)


def cashtags(text: Column) -> Column:
    """The distinct $AAPL, in the order of their first places."""
    return F.array_distinct(F.regexp_extract_all(present(text), F.lit(r"\$[A-Z]{1,5}\b"), F.lit(0)))


def tickers(text: Column) -> Column:
    """The distinct AAPL of $AAPL, in upper case in the text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(present(text), F.lit(r"\$([A-Z]{1,5})\b"), F.lit(1))))


def tags(text: Column) -> Column:
    """The distinct symbols of $aapl in any case, of up to six letters, in upper case, in the order of their first places."""
    return F.array_distinct(F.transform(F.regexp_extract_all(present(text), F.lit(r"\$([A-Za-z]{1,6})\b"), F.lit(1)), F.upper))


def movements(text: Column) -> Column:
    """(movement, direction, raw_direction) of each ``up 5%`` and the like; amounts without a direction are passed over."""
    whole, word = (F.regexp_extract_all(present(text), F.lit(MOVEMENT), F.lit(g)) for g in (0, 1))
    good = ["gained", "gain", "rose", "increased", "increase", "up"]
    return F.transform(F.arrays_zip(whole.alias("movement"), F.transform(word, F.lower).alias("raw")), lambda x: F.struct(x["movement"].alias("movement"), F.when(x["raw"].isin(good), "positive").otherwise("negative").alias("direction"), x["raw"].alias("raw_direction")))


def quality_metrics(original: Column, processed: Column) -> dict[str, Column]:
    """Ratios of a text before and after preprocessing; all 0 without tokens."""
    before, after = tokens(original), tokens(processed)
    n = F.size(after)
    share = lambda x, digits: half_up(F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)), digits)
    low = F.lower(present(processed))
    negated = low.contains("_")
    for word in ("not", "no", "never", "neither"):
        negated = negated | low.contains(word)
    return {
        "retention_rate": half_up(F.coalesce(F.try_divide(n.cast("double"), F.size(before)), F.lit(0.0)), 3),
        "unique_token_ratio": share(F.size(F.array_distinct(after)), 3),
        "financial_term_density": share(F.size(F.filter(after, lambda w: F.lower(w).isin(FINANCIAL_TERMS))), 3),
        "avg_token_length": share(F.length(F.array_join(after, "")), 2),
        "ticker_count": F.size(cashtags(processed)),
        "has_negations": negated,
    }


def article_quality(title: Column, description: Column, content: Column) -> Column:
    """Whether a (cleaned) article is worth keeping; its raw content must not be [removed]."""
    clean = clean_news(content)
    return (F.length(clean_news(title)) >= 10) & ~F.lower(present(content)).contains("[removed]") & ((clean == "") | (F.length(clean) >= 100)) & ((clean_news(description) != "") | (clean != ""))


def tweet_quality(raw: Column, text: Column) -> Column:
    """Whether a post is no spam, long enough (less is enough with a $), and not mostly emoji or tags."""
    raw, low = present(raw), F.lower(present(text))
    count = lambda c: F.length(raw) - F.length(F.replace(raw, F.lit(c), F.lit("")))
    spam = low.rlike("|".join(f"(?:{p})" for p in SPAM_PATTERNS))
    long = F.length(F.trim(present(text))) >= F.when(raw.contains("$"), 8).otherwise(15)
    emoji = F.size(F.regexp_extract_all(raw, F.lit(EMOJI), F.lit(0)))
    return ~spam & long & (emoji <= 8) & (count("#") <= 12) & (count("$") <= 15) & ~raw.rlike(r"^[\x{1F000}-\x{1FFFF}\s]{12,}")


def engaged(likes: Column, reposts: Column, replies: Column, least: int = 5) -> Column:
    return sum((F.coalesce(c, F.lit(0)) for c in (reposts, replies)), F.coalesce(likes, F.lit(0))) >= least


def sentences(text: Column) -> Column:
    """Sentences of 12 characters or more, cut at 2000; the whole text if there is none."""
    whole = F.regexp_replace(present(text), r"^\s+|\s+$", "")
    parts = F.transform(F.split(whole, r"(?<=[.!?])\s+|\n{2,}"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    kept = F.transform(F.filter(parts, lambda s: F.length(s) >= 12), lambda s: F.substring(s, 1, 2000))
    return F.when(F.size(kept) > 0, kept).when(whole != "", F.array(F.substring(whole, 1, 2000))).otherwise(strings([]).cast("array<string>"))
