"""License notices by diagonal voting, with DataFrame functions only.

All word k-grams of all texts are hashed and joined to the places where the templates have them. A match of
place p in a text and place t in a template votes for diagonal p - t. An undisturbed notice puts all its votes
on one diagonal; words put in or left out spread them over neighbouring ones, which are merged. Diagonals tell
where the whole notice would begin and end; of the stretches about there, the one most like it is its span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import broadcast_if_small, spare, written

K = 3
#: Phrases whose exact places are counted, and their labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Notices that are recognized with small changes too.
NOTICES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
)
#: Diagonals apart that still belong to one span, and words that its ends may be off; likeness of a span. Changes
#: that LIKENESS allows can leave any notice a single k-gram, so one vote is enough to compare it.
REACH = 2
LIKENESS = 0.8
#: Runs of these are words; A-Z are lower-cased afterwards.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _template_grams(spark: SparkSession, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """hash, template, place. A row per k-gram of the templates, whose number does not grow with the texts."""
    rows = [(n, t, *words[t : t + K]) for n, (_, phrase, _) in enumerate(templates) if (words := phrase.split()) for t in range(len(words) - K + 1)]
    words = [f"w{i}" for i in range(K)]
    made = spark.createDataFrame(rows, "template int, place int, " + ", ".join(f"{w} string" for w in words))
    return made.select(F.xxhash64(*words).alias("hash"), "template", "place")


def _spans(docs: DataFrame, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """doc_id, code (hash of the text), spans (template, start, stop): where whole templates would stand."""
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    held = docs.select("doc_id", "code", words.alias("w")).filter(F.size("w") >= K)
    zipped = F.arrays_zip(*[(F.col("w") if i == 0 else F.slice("w", i + 1, F.size("w"))).alias(f"w{i}") for i in range(K)])
    grams = held.select("doc_id", "code", F.posexplode(zipped).alias("p", "g")).filter(F.col(f"g.w{K - 1}").isNotNull())
    hashed = grams.select("doc_id", "code", F.col("p"), F.xxhash64(*[F.col(f"g.w{i}") for i in range(K)]).alias("hash"))
    met = hashed.join(F.broadcast(_template_grams(spark, templates)), "hash")
    votes = met.groupBy("doc_id", "code", "template", (F.col("p") - F.col("place")).alias("diagonal")).agg(F.expr("bit_or(shiftleft(1L, place))").alias("votes"))
    # Diagonals of a text and template that follow each other closely get one number.
    along = Window.partitionBy("doc_id", "code", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > REACH).cast("int"), F.lit(0))
    size = F.element_at(F.array(*[F.lit(len(p.split())) for _, p, _ in templates]), F.col("template") + 1)
    base = F.element_at(F.array(*[F.lit(b) for _, _, b in templates]), F.col("template") + 1)
    # A phrase needs all its votes on one diagonal; a notice may spread them.
    marked = votes.withColumn("size", size).withColumn("base", base).withColumn("apart", apart)
    numbered = marked.withColumn("cluster", F.when(F.col("base"), F.col("diagonal")).otherwise(F.sum("apart").over(along).cast("int")))
    low = F.expr("bit_count((votes & -votes) - 1)")
    high = F.floor(F.log2(F.col("votes").cast("double")) + 1e-9).cast("int")
    merged = numbered.groupBy("doc_id", "code", "template", "size", "base", "cluster").agg(
        F.expr("bit_or(votes)").alias("all"), F.min_by("diagonal", F.col("diagonal") + low).alias("first"), F.max_by("diagonal", F.col("diagonal") + high).alias("last"), F.collect_set("diagonal").alias("alone")
    )
    enough = merged.filter(~F.col("base") | (F.expr("bit_count(all)") == F.col("size") - K + 1))

    def place(first: Column, last: Column) -> Column:
        return F.struct("template", first.alias("start"), (last + F.col("size")).alias("stop"))

    # From the first vote's diagonal to the last one's; and each diagonal alone, as votes merged may belong to two notices.
    places = F.array_distinct(F.concat(F.array(place(F.col("first"), F.col("last"))), F.transform("alone", lambda d: place(d, d))))
    return enough.groupBy("doc_id", "code").agg(F.flatten(F.collect_list(places)).alias("spans"))


def scan_licenses(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, notices: tuple[tuple[str, str], ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    A phrase's places are counted where its words stand one after the other; first_word and last_word are the
    smallest and largest of their starts, null if there is none. ``labels`` has the labels of verified notices
    too. ``score`` is the likeness of the best span, 1 for a phrase, 0 without any. ``spans`` lists label, start,
    stop (words from 0) and likeness. A null text has no words. Every row stays, repeated ones too; of columns
    that have one of the new names already, the new one gets an underscore in front.
    """
    templates = [(label, phrase, True) for label, phrase in phrases] + [(label, phrase, False) for label, phrase in notices]
    if any(not K <= len(p.split()) < 62 for _, p, _ in templates):
        raise ValueError(f"a template has {K} to 61 words")
    name, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    own = docs.select(name.alias("doc_id"), F.xxhash64(text).alias("code"), text.alias("text")).filter("text is not null")
    found = written(_spans(own, templates))
    key, code, spans, words, real = (spare(docs, c) for c in ("_id", "_code", "_spans", "_words", "_real"))
    # Bytes of a span in an array of rows, and of a row besides its spans and id.
    size = 40 * F.size(spans) + F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 100
    found = broadcast_if_small(found.select(F.col("doc_id").alias(key), F.col("code").alias(code), F.col("spans").alias(spans)), size)
    rows = docs.join(found, name.eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(code)), "left")
    rows = rows.withColumn(words, F.coalesce(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>")))

    def of(values: list, template: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), template + 1)

    def verified(s: Column) -> Column:
        """The stretch most like the template, with ends up to REACH words from where they would be."""
        phrase, base = of([p for _, p, _ in templates], s["template"]), of([b for _, _, b in templates], s["template"])
        off = F.when(base, F.array(F.lit(0))).otherwise(F.array(*[F.lit(i) for i in range(-REACH, REACH + 1)]))
        starts = F.array_distinct(F.transform(off, lambda i: F.greatest(s["start"] + i, F.lit(0))))
        stops = F.array_distinct(F.transform(off, lambda i: F.least(s["stop"] + i, F.size(words))))
        ends = F.filter(F.flatten(F.transform(starts, lambda a: F.transform(stops, lambda b: F.struct(a.alias("start"), b.alias("stop"))))), lambda e: e["start"] < e["stop"])

        def likeness(e: Column) -> Column:
            stretch = F.translate(F.array_join(F.slice(F.col(words), e["start"] + 1, e["stop"] - e["start"]), " "), _UPPER, _LOWER)
            return 1 - F.levenshtein(stretch, phrase) / F.greatest(F.length(stretch), F.length(phrase))

        best = F.array_max(F.transform(ends, lambda e: F.struct(likeness(e).alias("likeness"), e["start"].alias("start"), e["stop"].alias("stop"))))
        label = of([label for label, _, _ in templates], s["template"])
        return F.struct(label.alias("label"), best["start"].cast("long").alias("start"), best["stop"].cast("long").alias("stop"), best["likeness"].alias("likeness"), base.alias("base"))

    held = F.coalesce(F.col(spans), F.array().cast("array<struct<template: int, start: int, stop: int>>"))
    fine = F.array_distinct(F.filter(F.transform(held, verified), lambda s: F.when(s["base"], s["likeness"] == 1).otherwise(s["likeness"] >= LIKENESS)))

    def best_there(s: Column) -> Column:
        """Of notices that overlap, those that another one fits better go."""
        better = F.exists(real, lambda o: ~o["base"] & (o["likeness"] > s["likeness"]) & (o["start"] < s["stop"]) & (s["start"] < o["stop"]))
        return s["base"] | ~better

    rows = rows.withColumn(real, fine).withColumn(real, F.filter(real, best_there))
    base = F.filter(real, lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])

    def joined(chosen: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(chosen, lambda s: s["label"]))), ",")

    new = {
        "n_words": F.size(words).cast("long"), "n_base": F.size(base).cast("long"), "first_word": F.array_min(starts), "last_word": F.array_max(starts),
        "base_labels": joined(base), "labels": joined(F.col(real)), "score": F.coalesce(F.array_max(F.transform(real, lambda s: s["likeness"])), F.lit(0.0)),
        "spans": F.transform(real, lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["stop"].alias("stop"), s["likeness"].alias("likeness"))),
    }
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *[v.alias(spare(docs, c)) for c, v in new.items()])
