"""License scans by diagonal voting.

The hashes of all rolling word pairs of a text are joined to the positions of the same pairs in
the license templates.  A match votes for the diagonal (place in the text minus place in the
template); neighbouring diagonals of a template are merged into a span, and a span is verified by the
share of the template's pairs that it holds.  Only built-in functions run: the pairs are made, hashed,
joined (to a table of constants, broadcast) and filtered in one generated loop, and a shuffle
sees nothing but matches and one row per text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Longer statements, found with gaps.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
#: A span holds at least this share of its template's word pairs, on diagonals at most this far apart.
LEAST_SHARE, MOST_GAP = 0.7, 2
#: What separates words once letters are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def pairs_of(spark) -> DataFrame:
    """One row per word pair of every phrase and template: a table of constants, a few hundred rows."""
    rows = []
    texts = [(True, label, text) for text, label in PHRASES.items()] + [(False, label, text) for label, many in TEMPLATES.items() for text in many]
    for i, (exact, label, text) in enumerate(texts):
        words = text.split()
        rows += [(i, exact, label, len(words) - 1, k, *pair) for k, pair in enumerate(zip(words, words[1:], strict=False))]
    out = spark.createDataFrame(rows, "template int, exact boolean, label string, pairs int, at int, t1 string, t2 string")
    return out.withColumn("hash", F.xxhash64("t1", "t2"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Votes: a row per text, template and diagonal, and one without template per text.

    Nulls and empty texts have no words; repeated rows are scanned one by one (``row_id`` tells
    them apart); other columns are left out.  Each row has the template positions (``ats``) that
    voted for the diagonal, and the first and last place in the text.
    """
    # Only two characters beyond ASCII turn into ASCII letters in lower case; they are kept apart.
    plain = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    for odd in ("\u0130", "\u212a"):
        plain = F.replace(plain, F.lit(odd), F.lit("\u0131"))
    words = F.array_remove(F.split(F.lower(plain), BETWEEN), "")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), words.alias("words"))
    rows = rows.select("row_id", "doc_id", F.size("words").alias("n_words"), "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "w1"))
    rows = rows.withColumn("w2", F.get("words", F.col("pos") + 1)).drop("words").withColumn("h", F.xxhash64("w1", "w2"))
    pairs = F.broadcast(pairs_of(docs.sparkSession))
    hits = rows.join(pairs, (F.col("h") == F.col("hash")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")), "left")
    hits = hits.where("pos = 0 or template is not null").select(
        "row_id", "doc_id", "n_words", "pos", "template", "exact", "label", "pairs", "at", (F.col("pos") - F.col("at")).alias("diagonal")
    )
    return hits.groupBy("row_id", "doc_id", "n_words", "template", "exact", "label", "pairs", "diagonal").agg(
        F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``n_base`` counts the exact places of phrases; ``labels`` adds those of verified templates;
    ``score`` is the largest share of a template found (1 at an exact place, 0 without a span).
    ``spans`` lists ``(label, exact, first_word, last_word, share)`` in order.
    """
    diagonals = scan_licenses(docs, id_col, text_col)
    by = W.partitionBy("row_id", "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(by) > MOST_GAP)
    merged = diagonals.withColumn("island", F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(by))
    spans = merged.groupBy("row_id", "doc_id", "n_words", "template", "exact", "label", "pairs", "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("found"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    share = F.col("found") / F.col("pairs")
    verified = F.when(F.col("exact"), F.col("found") == F.col("pairs")).otherwise((share >= LEAST_SHARE) & (F.col("high") - F.col("low") < F.col("pairs") + 2 * MOST_GAP))
    spans = spans.withColumn("share", F.least(share, F.lit(1.0))).withColumn("ok", F.coalesce(verified, F.lit(False)))
    base = F.col("ok") & F.col("exact")
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("row_id", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("low"))).cast("long").alias("last_word"),
        join(F.when(base, F.col("label"))).alias("base_labels"),
        join(F.when(F.col("ok"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("low", "high", "label", "exact", "share")))).alias("spans"),
    )


def op5_license_scan(spark, sf_dir):
    """Licenses named in every document."""
    from caseflow.llm.common import table

    out = license_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
