"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block is a line, and also what lies around a wrap: the last words of a line and the first ones of the
lines after it, on each side twice as many as the largest template has.  Lines of any width go on, up to one without
words, so a notice within a paragraph is in some block however narrow its lines are.
A block meets a template if it holds at least ``PERCENT`` percent of the template's distinct words.  Words are ordered by how many blocks hold them over the whole
corpus, rarest first.  A block that shares enough words with a template shares
one of the template's first ``size - needed + 1`` words (prefix filter), has at
least ``needed`` words of any template (length filter), and from the places of the
first shared word in both orders there is room for ``needed`` shared words
(positional filter).  What passes is confirmed on the whole sets.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a word: digits, a-z and all beyond ASCII, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening words of common license notices, and the labels of blocks that contain them.
TEMPLATES = {
    "this work is licensed under the gnu general public license version": "gpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "licensed under the apache license version": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-notice",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "this work is licensed under a creative commons attribution international license": "cc-by",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
#: Share of a template's words that a block needs, in percent.
PERCENT = 90
#: Bytes of template words up to which their table is broadcast.
BROADCAST_BYTES = 8 << 20


def prefix_table(docs: DataFrame, templates: dict[str, str], order: list[str], needed: dict[str, int]) -> DataFrame:
    """The prefix of each template: ``word`` and its place ``i`` from 1 in the global order, with the template's ``label``, ``tokens``, ``size`` and ``needed``."""
    place = {w: i for i, w in enumerate(order)}
    rows = []
    for text, label in templates.items():
        tokens = sorted(set(text.split()), key=place.__getitem__)
        for i, word in enumerate(tokens[: len(tokens) - needed[text] + 1]):
            rows.append((word, i + 1, label, tokens, len(tokens), needed[text]))
    made = docs.sparkSession.createDataFrame(rows, "word string, i int, label string, tokens array<string>, size int, needed int")
    return F.broadcast(made) if sum(len(w.encode()) + 16 for r in rows for w in r[3]) <= BROADCAST_BYTES else made


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def lines_of(text: Column) -> Column:
    """The words of each line of a lower-cased text."""
    return F.transform(F.split(text, "\n"), lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))


def possible(docs: DataFrame, templates: dict[str, str], needed: dict[str, int]) -> DataFrame:
    """``docs`` with ``lines``; none for a text without any of each template's ``size - needed + 1`` longest words.

    The prefix filter holds for any order of words, so no block of such a text meets a template.
    """
    first = [sorted(set(t.split()), key=lambda w: (-len(w), w))[: max(0, len(set(t.split())) - needed[t] + 1)] for t in templates]
    lowered = docs.withColumn("lowered", F.translate("text", UPPER, LOWER))
    meets = F.lit(False)
    for w in sorted({w for x in first for w in x}):
        meets = meets | F.contains("lowered", F.lit(w))
    return lowered.withColumn("lowered", F.when(meets, F.col("lowered")).otherwise("")).withColumn("lines", lines_of(F.col("lowered"))).drop("lowered")


def blocks_of(lines: Column, order: list[str], least: int, around: int) -> Column:
    """The distinct template words of each block, in the given order, for blocks with ``least`` or more of them; ``around``: words on each side of a wrap."""
    known = F.array(*[F.lit(x) for x in order])
    none = F.array().cast("array<string>")

    def more(done: Column, line: Column) -> Column:
        taken = done["open"] & (F.size(done["words"]) < around)
        return F.struct(
            F.when(taken, F.concat(done["words"], F.slice(line, F.lit(1), F.lit(around)))).otherwise(done["words"]).alias("words"),
            (taken & (F.size(line) > 0)).alias("open"),
        )

    def wrap(line: Column, i: Column) -> Column:
        before = F.slice(line, F.greatest(F.size(line) - around, F.lit(0)) + 1, F.lit(around))
        after = F.aggregate(F.slice(lines, i + 2, F.lit(around)), F.struct(none.alias("words"), F.lit(True).alias("open")), more)["words"]
        return F.when((F.size(line) > 0) & (F.size(F.get(lines, i + 1)) > 0), F.array_intersect(known, F.concat(before, F.slice(after, F.lit(1), F.lit(around)))))

    sets = F.concat(F.transform(lines, lambda x: F.array_intersect(known, x)), F.transform(lines, wrap))
    return F.filter(sets, lambda x: F.size(x) >= least)


def places(words: Column, spaced: Column, phrase: str) -> Column:
    """Starts of a phrase in ``words``, by one look at each; none is looked at where the phrase isn't in ``spaced``, the words with single spaces around each."""
    parts = phrase.split()

    def start(word: Column, i: Column) -> Column:
        here = word == parts[0]
        for k, part in enumerate(parts[1:], 1):
            here = here & (F.get(words, i + k) == part)
        return F.when(here, i)

    starts = F.filter(F.transform(words, start), lambda x: x.isNotNull())
    return F.when(F.contains(spaced, F.lit(f" {phrase} ")), starts).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and ``last_word`` (their least and
    greatest start, else null), ``base_labels``, ``labels`` (those of matched templates too; both distinct, sorted, comma-joined)
    and ``score``: 1 with a base phrase, else the largest matched share of a template, else 0.

    Null counts as the empty text: no words, no places, empty labels.  Repeated rows give repeated results.
    The prefixes of templates are broadcast up to ``BROADCAST_BYTES``, and joined by a shuffle beyond; word frequencies are one row per template word.
    Rows are kept apart by a number of their own, under which the matches of a row are combined before the one shuffle.
    """
    whole = F.coalesce("text", F.lit(""))
    vocabulary = sorted({w for t in templates for w in t.split()})
    sizes = {t: len(set(t.split())) for t in templates}
    needed = {t: max(1, -(-percent * n // 100)) for t, n in sizes.items()}
    least = min(needed.values(), default=1)
    around = 2 * max((len(t.split()) for t in templates), default=1)
    # One row per template word, whatever the corpus.
    seen = possible(docs.select(whole.alias("text")), templates, needed).select(F.explode(blocks_of(F.col("lines"), vocabulary, least, around)).alias("block")).select(F.explode("block").alias("word"))
    frequency = dict(seen.groupBy("word").agg(F.count("*").alias("n")).collect())
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    prefixes = prefix_table(docs, templates, order, needed)

    marked = docs.select("doc_id", whole.alias("text"), F.monotonically_increasing_id().alias("row"))
    worded = possible(marked, templates, needed).select("doc_id", "row", words_of(F.col("text")).alias("words"), "lines")
    worded = worded.select("doc_id", "row", "words", blocks_of(F.col("lines"), order, least, around).alias("blocks"))
    spaced = worded.withColumn("spaced", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    found = [places(F.col("words"), F.col("spaced"), p) for p in phrases]
    based = spaced.select(
        "doc_id",
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.array(*found).alias("by_phrase"),
        "blocks",
    )
    labels = F.array(*[F.lit(x) for x in phrases.values()])
    base = based.select(
        "doc_id",
        "row",
        "n_words",
        F.flatten("by_phrase").alias("starts"),
        F.filter(F.transform("by_phrase", lambda x, i: F.when(F.size(x) > 0, labels[i])), lambda x: x.isNotNull()).alias("base"),
        "blocks",
    )
    each = base.select("doc_id", "row", "n_words", "starts", "base", F.explode_outer("blocks").alias("block"))
    tokens = each.select("*", F.posexplode_outer("block").alias("j", "word"))
    met = tokens.join(prefixes, "word", "left")
    room = F.col("needed") <= 1 + F.least(F.col("size") - F.col("i"), F.size("block") - 1 - F.col("j"))
    shared = F.size(F.array_intersect("block", "tokens"))
    matched = met.withColumn("share", F.when(room & (F.size("block") >= F.col("needed")) & (shared >= F.col("needed")), shared / F.col("size")))
    return (
        matched.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.first("starts").alias("starts"),
            F.first("base").alias("base"),
            F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("more"),
            F.max("share").alias("share"),
        )
        .select(
            "doc_id",
            "n_words",
            F.size("starts").cast("long").alias("n_base"),
            F.array_min("starts").cast("long").alias("first_word"),
            F.array_max("starts").cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_distinct(F.concat("base", "more"))), ",").alias("labels"),
            F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        )
    )
