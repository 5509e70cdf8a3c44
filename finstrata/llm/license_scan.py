"""License scan by diagonal voting (operator 8), in DataFrame functions only.

The hashes of all runs of k words of the texts are joined with those of license notices. Each hit votes for a diagonal: the
distance of its places in the text and in the notice. Neighbouring diagonals, between which words were put in or left out,
are merged; a merged span counts where its hits cover enough of the notice and of the words that it spans, and no other
notice explains these words better. Phrases that name a license are runs of words like any other: they come from the same join.

The texts are read once. A text is lowered and split once, its runs are hashed and joined in the same generated loop, and
only hits, summed up by diagonal, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words: ASCII letters and digits, and all that isn't ASCII, in lower case.
BREAKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Fixed values: (label, words of a notice in public use).
NOTICES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "this work is licensed under cc by 4 0"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)


#: What stands after a text's last word; no word is empty. It is a run of its own, so a text without any hit has a row too.
END = ""


def lowered(text: Column) -> Column:
    """A-Z lowered. lower() lowers more, which parts no words; the two letters that it makes ASCII are replaced before."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131")))


def with_words(rows: DataFrame) -> DataFrame:
    """``text`` (lowered) as ``words``, and then the end; a text that begins with a break has an empty word before, which goes."""
    parts = rows.withColumn("parts", F.split(F.concat("text", F.lit(" ")), f"[{BREAKS}]+")).drop("text")
    return parts.withColumn("words", F.when(F.col("parts")[0] == "", F.slice("parts", 2, F.size("parts") - 1)).otherwise(F.col("parts"))).drop("parts")


def runs(notices: tuple[tuple[str, str], ...], k: int) -> list[tuple]:
    """(notice, label, at, size, run) of the notices' runs of k words, of whole phrases (size 0), and of the end (-1)."""
    found = [(n, label, i, len(words), words[i : i + k]) for n, (label, text) in enumerate(notices) for words in [text.split()] for i in range(len(words) - k + 1)]
    found += [(len(notices) + n, label, 0, 0, phrase.split()) for n, (phrase, label) in enumerate(PHRASES.items())]
    return [*found, (-1, "", 0, -1, [END])]


def scan_licenses(docs: DataFrame, k: int = 3, apart: int = 2, least: float = 0.7, notices: tuple[tuple[str, str], ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: _row, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of PHRASES, first_word and last_word are the smallest and largest of their starts (null if there
    are none). labels has those of base_labels, and of notices of which a span holds ``least`` or more of the words. score is
    the largest such share, 1 where a phrase stands. spans: (start, end, label, share), by start. Of spans of different labels that
    overlap, only those whose hits cover most words count; all that cover as many do.

    Null or empty texts have no words, no labels and score 0. Repeated rows are scanned each by itself, null ids stay null.
    Other columns are not read. An empty table gives no rows. k is 3 or more; notices of fewer than k words match nothing.
    Words of notices are lower-case ASCII.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(runs(notices, k), "notice int, label string, at int, size int, run array<string>")
    hashed = lambda size, word: F.xxhash64(F.lit(size), *(word(j) for j in range(size)))
    sizes = {1, k, *(len(p.split()) for p in PHRASES)}
    hash_ = F.coalesce(*(F.when(F.size("run") == n, hashed(n, lambda j: F.get("run", F.lit(j)))) for n in sorted(sizes)))
    table = table.withColumn("hash", hash_)  # some hundred rows, set by ``notices``

    body = lowered(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = with_words(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), body.alias("text")))
    here = lambda j: F.col("word") if j == 0 else F.get("words", F.col("pos") + j)
    ends = F.when(F.col("word") == END, hashed(1, here))  # a null hash joins nothing
    places = rows.select("_row", "doc_id", "words", F.posexplode("words").alias("pos", "word"))
    hits = (
        places.select("_row", "doc_id", "words", "pos", F.explode(F.array(ends, *(hashed(n, here) for n in sorted(sizes - {1})))).alias("hash"))
        .join(F.broadcast(table), "hash")
        .filter(F.slice("words", F.col("pos") + 1, F.size("run")) == F.col("run"))
        .select("_row", "doc_id", "notice", "label", "size", "pos", "at", F.when(F.col("size") > 0, F.col("pos") - F.col("at")).alias("diagonal"))
    )
    by = ["_row", "notice", "label", "size"]
    votes = hits.groupBy(*by, "diagonal").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"), F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = Window.partitionBy("_row", "notice").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > apart, F.lit(True)).cast("int")
    merged = (
        votes.withColumn("fresh", fresh)
        .withColumn("span", F.sum("fresh").over(along))
        .groupBy(*by, "span")
        .agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("first").alias("start"), F.max("last").alias("last"))
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda t: F.sequence(t, t + k - 1)))))
    spans = merged.withColumn("end", F.col("last") + k).withColumn("covered", F.when(F.col("size") > 0, covered))
    verified = F.coalesce((F.col("covered") >= least * F.col("size")) & (F.col("covered") >= least * (F.col("end") - F.col("start"))), F.lit(False))
    spans = spans.withColumn("verified", verified).filter("verified or size <= 0")
    # the spans that can overlap one start near it, so there are few
    reach = max((len(text.split()) for _, text in notices), default=0) * 2
    near = F.collect_list(F.when(F.col("verified"), F.struct("start", "end", "label", "covered"))).over(Window.partitionBy("_row").orderBy("start").rangeBetween(-reach, reach))
    better = F.exists(near, lambda x: (x["label"] != F.col("label")) & (x["covered"] > F.col("covered")) & (x["start"] < F.col("end")) & (F.col("start") < x["end"]))
    spans = spans.withColumn("counts", F.col("verified") & ~better)
    base, counts, share = F.col("size") == 0, F.col("counts"), F.col("covered") / F.col("size")
    found = spans.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("size") < 0, F.col("start"))).cast("long").alias("n_words"),
        F.coalesce(F.sum(F.when(base, F.col("n"))), F.lit(0)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        F.sort_array(F.collect_set(F.when(base, F.col("label")))).alias("base"),
        F.collect_set(F.when(counts, F.col("label"))).alias("found"),
        F.coalesce(F.max(F.when(counts, share)), F.lit(0.0)).alias("share"),
        F.sort_array(F.collect_list(F.when(counts, F.struct("start", "end", "label", share.alias("share"))))).alias("spans"),
    )
    return found.select(
        "_row", "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", "found")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("share")).alias("score"),
        "spans",
    )
