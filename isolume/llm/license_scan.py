"""License scans by diagonal voting.

A text's rolling word k-grams are joined by hash to the k-gram positions of all
templates. A hit at text word p and template word t votes for the diagonal
p - t. Neighbouring diagonals (words inserted or left out) are merged into a
span, whose diagonals lie at most DRIFT apart. A span is verified by aligning it:
the template's k-grams are taken in order, each at the first of its places in
the span behind the one before; the share that finds a place must reach `least`.
Phrases must be found whole on one diagonal. A hit counts only if its words
equal the template's, so equal hashes alone decide nothing.

Defined results: a null text is empty; a row without words or hits gets a row
with no labels and score 0; a row that is repeated gets as many result rows;
null doc_ids are kept; only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from isolume.llm.common import LOWER, UPPER, fingerprint

#: The phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public notices; a text that holds most of one gets its label.
NOTICES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl-3-notice": "licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-notice": "this is free and unencumbered software released into the public domain",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "reserved": "all rights reserved",
}

K = 2
#: Diagonals of one span lie at most this far apart: so many words may be inserted or left out.
DRIFT = 3
#: A template's votes are bits of a long.
MOST_GRAMS = 63

_ASCII = [chr(c) for c in range(128)]
_NOT_WORD = "".join(c for c in _ASCII if not (c.isdigit() or c.isalpha()))


def words_of(text: Column) -> Column:
    """The [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    plain = F.translate(F.coalesce(text, F.lit("")), _NOT_WORD + UPPER, " " * len(_NOT_WORD) + LOWER)
    return F.array_remove(F.split(plain, " "), "")


def template_grams(docs: DataFrame, phrases: Mapping[str, str], notices: Mapping[str, str]) -> DataFrame:
    """One row (tgram, h, template, tpos, n_grams, label, base) for each template position; as many rows as the templates have words."""
    rows = []
    for n, (text, label, base) in enumerate([*((p, lab, True) for p, lab in phrases.items()), *((t, lab, False) for lab, t in notices.items())]):
        words = text.split()
        grams = [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)]
        if not 0 < len(grams) <= MOST_GRAMS:
            raise ValueError(f"a template needs {K} to {MOST_GRAMS + K - 1} words: {text}")
        rows += [(g, n, i, len(grams), label, base) for i, g in enumerate(grams)]
    out = docs.sparkSession.createDataFrame(rows, "tgram string, template int, tpos int, n_grams int, label string, base boolean")
    return out.withColumn("h", F.xxhash64("tgram"))


def _aligned(span: Column, n_grams: Column) -> Column:
    """struct<t, p, n, first>: of the span's (diagonal, bits), how many k-grams stand in the template's order, and where."""
    on = lambda d: F.filter(F.sequence(F.lit(0), n_grams - 1), lambda t: F.getbit(d["bits"], t) == 1)
    hits = F.flatten(F.transform(span, lambda d: F.transform(on(d), lambda t: F.struct(t.alias("t"), (d["diagonal"] + t).alias("p")))))
    start = F.struct(F.lit(-1).alias("t"), F.lit(-1).alias("p"), F.lit(0).alias("n"), F.lit(-1).alias("first"))

    def step(acc: Column, x: Column) -> Column:
        first = F.when(acc["n"] == 0, x["p"]).otherwise(acc["first"])
        taken = F.struct(x["t"].alias("t"), x["p"].alias("p"), (acc["n"] + 1).alias("n"), first.alias("first"))
        return F.when((x["t"] > acc["t"]) & (x["p"] > acc["p"]), taken).otherwise(acc)

    return F.aggregate(F.sort_array(hits), start, step)


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES, least: float = 0.7) -> DataFrame:
    """Returns for every row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    least: the share of a notice's k-grams that verifies it. spans: (label, first word, last word, share) of every
    verified place: phrases, and of a notice's spans within DRIFT of each other the best.
    """
    templates = template_grams(docs, phrases, notices)
    rows = docs.select("doc_id", fingerprint(F.col("text")).alias("fp"), words_of(F.col("text")).alias("words"))
    n = F.size("words")
    rolling = reduce(
        lambda a, i: F.zip_with(a, F.slice("words", i + 1, F.greatest(n - (K - 1), F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y)),
        range(1, K),
        F.slice("words", 1, F.greatest(n - (K - 1), F.lit(0))),
    )
    # The last element only says how many words the row has: no k-gram starts with a blank.
    told = F.concat(F.lit(" "), n.cast("string"))
    grams = rows.select("doc_id", "fp", F.posexplode(F.concat(rolling, F.array(told))).alias("pos", "gram"))
    counted = F.startswith(F.col("gram"), F.lit(" "))
    grams = grams.withColumn("hash", F.xxhash64("gram"))
    hits = grams.join(F.broadcast(templates), F.col("hash") == F.col("h"), "left").filter(counted | (F.col("gram") == F.col("tgram")))

    # Votes are bits, so a row that is repeated votes once; the rows that count words say how often it is repeated.
    votes = hits.groupBy("doc_id", "fp", "template", "n_grams", "label", "base", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    votes = votes.agg(
        F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("bits"),
        F.max(F.when(counted, F.trim("gram").cast("long"))).alias("n_words"),
        F.sum(F.when(counted, 1)).alias("copies"),
    )
    line = Window.partitionBy("doc_id", "fp", "template").orderBy("diagonal")
    span = F.collect_list(F.struct("diagonal", "bits")).over(line.rangeBetween(0, DRIFT))
    enough = F.bit_count(F.bit_or("bits").over(line.rangeBetween(0, DRIFT))) >= least * F.col("n_grams")
    marked = votes.withColumn("span", F.when(~F.col("base") & enough, span))
    marked = marked.withColumn("aligned", F.when(F.col("span").isNotNull(), _aligned(F.col("span"), F.col("n_grams"))))
    share = F.col("aligned.n") / F.col("n_grams")
    marked = marked.withColumn("share", F.when(share >= least, share))
    place = F.when(F.col("share").isNotNull(), F.struct("share", (-F.col("diagonal")).alias("early")))
    marked = marked.withColumn("best", place == F.max(place).over(line.rangeBetween(-DRIFT, DRIFT)))

    whole = F.col("base") & (F.bit_count("bits") == F.col("n_grams"))
    found = F.when(whole, F.struct("label", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n_grams") + K - 2).alias("last"), F.lit(1.0).alias("share")))
    found = found.when(F.col("best"), F.struct("label", F.col("aligned.first").alias("first"), (F.col("aligned.p") + K - 1).alias("last"), "share"))
    out = marked.withColumn("found", found).groupBy("doc_id", "fp").agg(
        F.max("n_words").alias("n_words"),
        F.max("copies").alias("copies"),
        F.coalesce(F.sum(whole.cast("long")), F.lit(0)).alias("n_base"),
        F.min(F.when(whole, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("found.label")), ",").alias("labels"),
        F.coalesce(F.max("found.share"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list("found")).alias("spans"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
