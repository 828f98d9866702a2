"""License scans (operator 7), with DataFrame functions only.

Base: the places where a phrase's words stand consecutively. The method: an exact set-similarity join of text blocks
with license templates. Blocks are lines and, for texts wrapped over lines, windows of words: a template of m words is
sought in every m / ``THRESHOLD`` consecutive words of a paragraph, so that as large a share may be foreign, as comment
marks that are words. Lines without words part paragraphs. Lines that only follow each other shall not add up, so a
window must also hold a share ``THRESHOLD`` of the template's words in their order. A template's tokens are ordered by how many documents hold them, rarest first. A block
that holds a share ``THRESHOLD`` of a template's ``n`` tokens, ``need`` of them, holds one of the first ``n - need + 1``
(prefix filter) and has ``need`` template tokens or more (length filter); and what can still follow a shared token on
both sides bounds the overlap (positional filter). Pairs that pass are counted exactly.

Texts are read twice: once for the frequencies of the templates' tokens, once for words, phrases and the blocks that
hold a prefix token: lines, and spans of the words around each prefix token, in which every window with that token lies.
Only those are exploded; a span is joined as a block is, and its windows are counted for the pairs that pass. The table of template tokens is broadcast; ``MAX_TOKENS`` bounds it.

Defined results: null text counts as empty; words are told apart after lower-casing A-Z only; without a place first
and last word are null; without a label the labels are empty strings; without a matching block the score is 0; of
several templates and blocks the best share counts, and all labels; a very long text is read whole, and only what lies
around its prefix tokens is exploded; repeated rows each give a row; an empty table gives an empty one; other columns of
the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.plans.shared import materialise

#: Share of a template's tokens that a block must hold.
THRESHOLD = 0.9
#: Tokens of all templates together; the broadcast table has no more rows.
MAX_TOKENS = 20_000

# fixed values: phrases of the base with their labels, and templates with theirs
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: What separates words, in a text whose A-Z are not yet lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What separates paragraphs: line breaks with no word between them.
_BREAK = r"\n[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def _low(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_frequencies(docs: DataFrame, tokens: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each of ``tokens`` is. One number for each token comes to the driver."""
    # lower() may turn a few other letters into ASCII ones, which only bends the order of tokens
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    held = docs.select(F.explode(F.array_intersect(F.split(text, _GAP), _strings(tokens))).alias("t"))
    found = {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}
    return {t: found.get(t, 0) for t in tokens}


def _places(low: Column, words: list[str], label: str) -> Column:
    """(i, label) where ``words`` stand consecutively in the array ``low``."""
    here = lambda i: _all([F.get(low, i + k) == w for k, w in enumerate(words)])
    at = F.filter(F.transform(low, lambda x, i: F.when(here(i), i.cast("long"))), lambda x: x.isNotNull())
    return F.transform(at, lambda i: F.struct(i.alias("i"), F.lit(label).alias("label")))


def _in_order(some: Column, words: Column) -> Column:
    """Length of the longest common subsequence of two arrays; null is no element of ``words``."""
    none = F.transform(F.concat(F.array(F.lit(0)), words), lambda _: F.lit(0))

    def longer(row: Column, x: Column) -> Column:
        best = lambda out, k: F.greatest(F.element_at(out, -1), F.get(row, k + 1), F.get(row, k) + F.get(words, k).eqNullSafe(x).cast("int"))
        places = F.sequence(F.lit(0), F.size(words) - 1)
        return F.aggregate(places, F.array(F.lit(0)), lambda out, k: F.concat(out, F.array(best(out, k))))

    return F.element_at(F.aggregate(some, none, longer), -1)


def scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    spark = docs.sparkSession
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    vocabulary = sorted({t for _, s in sets for t in s})
    if sum(len(s) for _, s in sets) > MAX_TOKENS:
        raise ValueError(f"templates hold more than {MAX_TOKENS} tokens")
    n_docs = token_frequencies(docs, vocabulary, text_col)
    order = sorted(vocabulary, key=lambda t: (n_docs[t], t))
    rank = {t: i for i, t in enumerate(order)}
    rows, prefixes, widths = [], set(), [math.ceil(len(text.split()) / threshold - 1e-9) for _, text in templates]
    for k, (label, s) in enumerate(sets):
        ranks = sorted(rank[t] for t in s)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        for at, r in enumerate(ranks[: len(ranks) - need + 1]):
            rows.append((k, label, r, at, need, len(ranks), ranks, widths[k], [rank[t] for t in templates[k][1].split()]))
            prefixes.add(order[r])
    table = spark.createDataFrame(rows, "template int, label string, rank int, at int, need int, size int, ranks array<int>, width int, words array<int>")
    reach = max(widths) - 1
    least = min(r[4] for r in rows)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def places(low: Column) -> Column:
        return F.concat(*[_places(low, phrase.split(), label) for phrase, label in phrases])

    none = F.array().cast("array<struct<i:bigint,label:string>>")
    last_words = sorted({p.split()[-1] for p, _ in phrases})
    maybe = text.rlike("(?i)(" + "|".join(last_words) + ")")

    def lines(w: Column) -> Column:
        """Word sets of the lines that hold a prefix token, if the document holds any."""
        tokens = F.transform(F.split(text, r"\n"), lambda x: F.array_distinct(_words(_low(x))))
        held = F.filter(tokens, lambda x: F.arrays_overlap(x, _strings(sorted(prefixes))) & (F.size(x) >= least))
        return F.when(F.arrays_overlap(F.split(F.lower(text), _GAP), _strings(sorted(prefixes))), held)

    def spans(low: Column) -> Column:
        """The words of a paragraph around each prefix token."""
        at = F.filter(F.transform(low, lambda x, i: F.when(x.isin(sorted(prefixes)), i)), lambda i: i.isNotNull())
        first = lambda i: F.greatest(i - reach, F.lit(0))
        around = F.array_distinct(F.transform(at, lambda i: F.slice(low, first(i) + 1, i - first(i) + reach + 1)))
        return F.filter(around, lambda x: F.size(F.array_intersect(x, _strings(order))) >= least)

    def of_paragraphs() -> Column:
        held = F.filter(F.split(text, _BREAK), lambda p: F.contains(p, F.lit("\n")))
        return F.flatten(F.transform(held, lambda p: _let(_words(_low(p)), spans)))

    wrapped = F.contains(text, F.lit("\n")) & F.arrays_overlap(F.split(F.lower(text), _GAP), _strings(sorted(prefixes)))
    of_words = _let(
        _words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.when(maybe, _let(F.transform(w, _low), places)).otherwise(none).alias("places"),
            lines(w).alias("lines"),
            F.when(wrapped, of_paragraphs()).alias("spans"),
        ),
    )
    base = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), of_words.alias("_w")).select("_row", id_col, "_w.*")
    base = materialise(base, "licenses")

    words = F.lit(None).cast("array<string>")
    own_lines = base.where("size(lines) > 0").select("_row", F.explode("lines").alias("tokens"), words.alias("words"))
    own_spans = base.where("size(spans) > 0").select("_row", F.explode("spans").alias("words")).select("_row", F.array_distinct("words").alias("tokens"), "words")
    blocks = own_lines.union(own_spans)
    by_token = F.create_map(*[F.lit(x) for t in order for x in (t, rank[t])])
    ranked = F.array_sort(F.transform(F.array_intersect("tokens", _strings(order)), lambda t: F.element_at(by_token, t)))
    blocks = blocks.select("_row", ranked.alias("b"), F.transform("words", lambda t: F.element_at(by_token, t)).alias("r")).where(F.size("b") >= least)
    probes = blocks.select("_row", "b", "r", F.posexplode("b").alias("b_at", "rank"))
    rest = F.least(F.col("size") - F.col("at"), F.size("b") - F.col("b_at"))
    pairs = probes.join(F.broadcast(table), "rank").where((F.size("b") >= F.col("need")) & (F.least("at", "b_at") + rest >= F.col("need")))
    shared = F.size(F.array_intersect("b", "ranks"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("r") - F.col("width") + 1, F.lit(1)))
    windows = F.transform(starts, lambda i: F.slice("r", i, F.col("width")))
    held = F.filter(windows, lambda x: F.size(F.array_intersect(x, "ranks")) >= F.col("need"))
    held = F.filter(held, lambda x: _in_order(x, F.col("words")) >= F.ceil(F.size("words") * threshold - 1e-9))
    in_window = F.array_max(F.transform(held, lambda x: F.size(F.array_intersect(x, "ranks"))))
    pairs = pairs.where(shared >= F.col("need")).withColumn("shared", F.when(F.col("r").isNull(), shared).otherwise(in_window))
    hits = pairs.where(F.col("shared") >= F.col("need")).select("_row", "label", (F.col("shared") / F.col("size")).alias("share"))
    by_row = hits.groupBy("_row").agg(F.collect_set("label").alias("_more"), F.max("share").alias("score"))

    at, base_labels = F.transform("places", lambda p: p["i"]), F.array_distinct(F.transform("places", lambda p: p["label"]))
    both = F.array_union(base_labels, F.coalesce("_more", F.array().cast("array<string>")))
    return base.join(by_row, "_row", "left").select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out
