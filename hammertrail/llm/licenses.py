"""License scans with a positional index of rare words, in DataFrame functions only.

``NOTICES`` are licence notices. The IDF of a word is taken over the notices; each notice is indexed by its
``INDEXED`` words of highest IDF with their positions. Every occurrence of an indexed word in a document votes for
(notice, offset) = its position minus the position in the notice; a notice is found where at least half of its indexed
words agree on one offset and its key phrase stands at its place there.

The base phrases are searched in all documents besides, as consecutive words.

Defined cases: a null text is empty; rows that agree in id and text are scanned once and answered alike; no label is
the empty string; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z is lowered, written with classes that Java matches several times faster.
ANY_CASE_WORD = r"[\p{Alnum}[^\p{ASCII}]]+"
INDEXED = 6

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, notice, key phrase. The notices are the customary wordings of public licences.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms with or without modification"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mit", "released under the mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge to any person"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
LONGEST = 8  # words of the longest key or base phrase


def postings() -> list[tuple[str, int, int, float]]:
    """(word, notice, position, idf) of the indexed words of every notice."""
    split = [notice.split() for _, notice, _ in NOTICES]
    holding = Counter(w for words in split for w in set(words))
    idf = {w: log((len(split) + 1) / n) for w, n in holding.items()}
    made = []
    for k, words in enumerate(split):
        rare = sorted(set(words), key=lambda w: (-idf[w], -len(w), w))[:INDEXED]
        made += [(w, k, at, idf[w]) for at, w in enumerate(words) if w in rare]
    return made


def key_places() -> list[tuple[list[str], int, int]]:
    """(words, notice, position) of the key phrase of every notice."""
    made = []
    for k, (_, notice, phrase) in enumerate(NOTICES):
        words, key = notice.split(), phrase.split()
        made.append((key, k, next(i for i in range(len(words)) if words[i : i + len(key)] == key)))
    return made


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of ``docs``."""
    spark = docs.sparkSession
    index, keys = postings(), key_places()
    lexicon = sorted({w for w, *_ in index} | {p.split()[0] for p in BASE} | {words[0] for words, *_ in keys})
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("_text"), text.alias("text"))
    counted = rows.select("doc_id", "_text", F.regexp_count("text", F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"))

    # One row per occurrence of a word of the lexicon, with the words that follow.
    # A base or key phrase stands only where its longest word occurs, so other texts need not be cut into words.
    anchors = sorted({max(words, key=len) for words in [*map(str.split, BASE), *(words for words, *_ in keys)]})
    may_hold = F.lit(False)
    for anchor in anchors:
        may_hold = may_hold | F.col("_lower").contains(anchor)
    scanned = rows.withColumn("_lower", F.lower("text")).filter(may_hold).drop("_lower")
    tokens = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(ANY_CASE_WORD), F.lit(0))
    at = F.filter(F.transform("_tokens", lambda word, i: F.when(word.isin(lexicon), i)), lambda i: i.isNotNull())
    here = F.transform("_at", lambda i: F.struct(i.cast("long").alias("pos"), F.slice("_tokens", i + 1, LONGEST).alias("next")))
    hits = (
        scanned.withColumn("_tokens", tokens).withColumn("_at", at).filter(F.size("_at") > 0)
        .select("doc_id", "_text", F.explode(here).alias("_hit"))
        .select("doc_id", "_text", "_hit.pos", "_hit.next", F.col("_hit.next")[0].alias("word")).distinct()
    )

    def stands(words: list[str]):
        return F.slice("next", 1, len(words)) == F.array(*map(F.lit, words))

    base = F.filter(
        F.array(*(F.when(stands(p.split()), F.lit(label)) for p, label in BASE.items())), lambda x: x.isNotNull()
    )
    # Votes of the indexed words and places of the key phrases, as (notice, kind, position in the notice, weight).
    by_word: dict[str, list] = {}
    for word, k, at, idf in index:
        by_word.setdefault(word, []).append(F.struct(F.lit(k).alias("notice"), F.lit(at).alias("at"), F.lit(idf).alias("idf")))
    lookup = F.create_map(*(x for word, made in by_word.items() for x in (F.lit(word), F.array(*made))))
    phrase = F.filter(
        F.array(*(F.when(stands(words), F.struct(F.lit(k).alias("notice"), F.lit(at).alias("at"))) for words, k, at in keys)),
        lambda x: x.isNotNull(),
    )
    key = ["doc_id", "_text"]
    found = hits.withColumn("base", base).withColumn("votes", F.try_element_at(lookup, F.col("word"))).withColumn("phrases", phrase)
    places = found.select(*key, "pos", F.explode("base").alias("label")).groupBy(*key).agg(
        F.count("*").alias("n_base"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"),
        F.collect_set("label").alias("_base"),
    )
    votes = (
        found.select(*key, "pos", F.explode("votes").alias("v"))
        .select(*key, "v.notice", (F.col("pos") - F.col("v.at")).alias("offset"), "v.at", "v.idf", F.lit(False).alias("phrase"))
    )
    phrases = found.select(*key, "pos", F.explode("phrases").alias("v")).select(
        *key, "v.notice", (F.col("pos") - F.col("v.at")).alias("offset"), F.lit(None).cast("int").alias("at"), F.lit(0.0).alias("idf"), F.lit(True).alias("phrase")
    )
    sizes = Counter(k for _, k, _, _ in index)
    weight = {k: sum(idf for _, j, _, idf in index if j == k) for k in sizes}
    needed = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(n))))
    weights = F.create_map(*(x for k, w in weight.items() for x in (F.lit(k), F.lit(w))))
    names = F.create_map(*(x for k, (label, *_) in enumerate(NOTICES) for x in (F.lit(k), F.lit(label))))
    noticed = (
        votes.unionByName(phrases).groupBy(*key, "notice", "offset")
        .agg(F.count("at").alias("agreeing"), F.sum("idf").alias("idf"), F.max("phrase").alias("verified"))
        .filter(F.col("verified") & (2 * F.col("agreeing") >= needed[F.col("notice")]))
        .groupBy(*key).agg(
            F.collect_set(names[F.col("notice")]).alias("_found"),
            F.max(F.least(F.lit(1.0), F.col("idf") / weights[F.col("notice")])).alias("_score"),
        )
    )
    for frame_name in ("places", "noticed"):
        frame = places if frame_name == "places" else noticed
        side = frame.withColumnRenamed("doc_id", "_id").withColumnRenamed("_text", "_key")
        counted = counted.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left").drop("_id", "_key")
    empty = F.array().cast("array<string>")
    base_set, found_set = F.coalesce("_base", empty), F.coalesce("_found", empty)
    return counted.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.sort_array(base_set), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_set, found_set)), ",").alias("labels"),
        F.when(F.size(base_set) > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def brute_force(text: str | None) -> tuple:
    """The base columns of one text, by plain search; for tests."""
    words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))
