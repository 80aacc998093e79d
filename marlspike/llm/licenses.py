"""Licence scans by a positional index of rare words, in DataFrame functions alone.

Templates are the paragraphs of whole licences, customary notices, and names of the form "SPDX-License-Identifier: MIT"; each has
key phrases that must all stand. One pass over the whole texts keeps, for each row, the words that occur in any template (a
small fixed vocabulary), and their places where the row has all words of some template's key phrases: no other row can have
a verified placement. Document frequencies of those words over all rows give their IDF. In each such row the licence
words of highest IDF (of each template that the row has the key words of, the SEEDS rarest) are looked up in the postings of
the templates: each of their places, less the word's place in the template, is an offset of that template. Offsets at
which all of the seeds stand are placements: the seeds are key words, so that no place of the key phrases is missed, and common
words propose nothing. A placement counts if every key phrase stands at its very place; its score is the share of the
template's IDF, from all licence words of the row that stand at their places.

Base phrases are counted apart, exactly, wherever they stand; their labels always stay.

Cases: a null text is empty and has no label and score 0; repeated rows and rows without an id are judged one by one;
a placement of a phrase is found however long the text; an empty table gives an empty result; columns named like a
result column are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import ascii_lower, table, without
from marlspike.llm.host_rules import let

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Fixed values: (label, paragraph of the licence or customary notice, key phrases in it, separated by commas).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "permission is hereby granted free of charge, copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge, copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies or substantial portions"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "the software is provided as is, authors or copyright holders be liable"),
    ("mit", "released under the mit license", "the mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "required by applicable law or agreed to in writing, distributed on an as is basis"),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form", "each contributor hereby grants to you a perpetual, irrevocable copyright license to reproduce"),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gnu general public license as published by the free software foundation, version 2 of the license"),
    ("gpl-2", "it under the terms of the gnu general public license version 2 as published by the free software foundation", "gnu general public license version 2"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gnu general public license as published by the free software foundation, version 3 of the license"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero general public license as published, version 3 of the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "this software is provided by the copyright holders and contributors, implied warranties of merchantability"),
    ("bsd", "use of this source code is governed by a bsd style license", "bsd style license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "copy of the mpl was not distributed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "the author disclaims all warranties with regard to this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "the origin of this software must not be misrepresented"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "anyone is free to copy modify publish use compile sell or distribute"),
    ("epl-2", "made available under the terms of the eclipse public license v2 0", "eclipse public license v2 0"),
    ("epl-2", "made available under the terms of the eclipse public license v 2 0", "eclipse public license v 2 0"),
    ("epl-2", "made available under the terms of the eclipse public license version 2 0", "eclipse public license version 2 0"),
    ("bsl-1", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license version 1 1"),
    ("ofl-1.1", "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell modified and unmodified copies of the font software subject to the following conditions", "copy of the font software to use study"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
)

# Names of the SPDX list with their labels.
SPDX = {
    "MIT": "mit", "Apache-2.0": "apache-2", "GPL-2.0": "gpl-2", "GPL-3.0": "gpl-3", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl-3", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "MPL-2.0": "mpl-2",
    "ISC": "isc", "Zlib": "zlib", "Unlicense": "unlicense", "EPL-2.0": "epl-2", "BSL-1.0": "bsl-1", "OFL-1.1": "ofl-1.1", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc",
}


def _spdx(name: str) -> str:
    return "spdx license identifier " + name.lower().replace("-", " ").replace(".", " ")


#: Every template: its label, words, and key phrases as (place, words).
INDEX = []
for _label, _wording, _keys in (*TEMPLATES, *((label, _spdx(name), _spdx(name)) for name, label in SPDX.items())):
    _words, _placed = _wording.split(), []
    for _key in _keys.split(", "):
        _phrase = _key.split()
        _placed.append((next(i for i in range(len(_words)) if _words[i : i + len(_phrase)] == _phrase), _phrase))
    INDEX.append((_label, _words, _placed))

#: Rarest key words of a template that must agree on its offset.
SEEDS = 3
#: The least share of a template's IDF that a placement needs.
LEAST_SCORE = 0.4
VOCABULARY = sorted({w for _, words, _ in INDEX for w in words})
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _doubled(phrase: str) -> str:
    return " " + "  ".join(phrase.split()) + " "


def _has_key_words(seen: Column) -> Column:
    """Whether the words of some template's key phrases are all among a row's licence words; the longest word of each is asked for first."""
    needed = [sorted({w for _, phrase in keys for w in phrase}, key=lambda w: (-len(w), w)) for _, _, keys in INDEX]
    longest = F.array(*[F.lit(w) for w in sorted({words[0] for words in needed})])
    rest = F.array(*[F.array(*[F.lit(w) for w in words]) for words in sorted(set(map(tuple, needed)))])
    return F.arrays_overlap(seen, longest) & F.exists(rest, lambda words: F.array_contains(seen, words[0]) & F.forall(words, lambda w: F.array_contains(seen, w)))


def scan_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with n_words, base columns, seen (distinct licence words) and hits: (place, word) of each licence word, in order, or null."""
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NOT_WORD), lambda w: w != "")

    def of_words(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.when(x.isin(VOCABULARY), F.struct(i.alias("at"), x.alias("word")))), lambda h: h.isNotNull())
        spaced = F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" "))
        return F.struct(F.size(w).cast("long").alias("n_words"), hits.alias("hits"), spaced.alias("spaced"))

    def of_text(s: Column) -> Column:
        spaced, counts, first, last = s["spaced"], [], [], []
        for phrase in PHRASES:
            needle = _doubled(phrase)
            n = F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(needle), F.lit("")))) / len(needle)).cast("long")
            counts.append(F.when(F.contains(spaced, F.lit(needle)), n).otherwise(F.lit(0).cast("long")))
            there = F.contains(spaced, F.lit(needle))
            first.append(F.when(there, F.floor(_spaces(F.substring_index(spaced, needle, 1)) / 2).cast("long")))
            behind = F.floor(_spaces(F.substring_index(spaced, needle, -1)) / 2).cast("long")
            last.append(F.when(there, s["n_words"] - behind - len(phrase.split())))
        labels = F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for c, label in zip(counts, PHRASES.values(), strict=True)]))
        return F.struct(s["n_words"].alias("n_words"), s["hits"].alias("hits"), F.array_distinct(F.transform(s["hits"], lambda h: h["word"])).alias("seen"), reduce(lambda a, b: a + b, counts).alias("n_base"), F.array_min(F.array(*first)).alias("first_word"), F.array_max(F.array(*last)).alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"))

    kept = without(docs, *ADDED, "hits", "seen", "base", "_scan")
    found = kept.withColumn("_scan", let(let(words, of_words), of_text))
    wide = found.select(*[c for c in kept.columns if c != text], "_scan.*")
    return wide.withColumn("hits", F.when(_has_key_words(F.col("seen")), F.col("hits")))


def scan(docs: DataFrame, text: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """docs without text, with n_words, n_base, first_word, last_word (long), base_labels, labels (string), score (double)."""
    spark = docs.sparkSession
    hits = table(scan_words(docs, text).withColumn("_row", F.monotonically_increasing_id()), "licence-words")
    # a row for each word of the vocabulary at most
    frequent = hits.select(F.explode("seen").alias("word")).groupBy("word").count().collect()
    rows, seen = hits.count(), {r["word"]: r["count"] for r in frequent}
    # IDF by natural logarithm, smoothed
    from math import log

    idf = {w: log((rows + 1) / (seen.get(w, 0) + 0.5)) for w in VOCABULARY}
    # postings and templates: rows of a fixed number
    postings, lookups, facts = [], [], []
    for t, (label, template, keys) in enumerate(INDEX):
        key_places = {at + i: w for at, phrase in keys for i, w in enumerate(phrase)}
        postings += [(t, i, w, idf[w], i in key_places) for i, w in enumerate(template)]
        # a place of each of the rarest words, ties by place
        seeds = {w: i for i, w in sorted(key_places.items(), reverse=True)}
        seeds = sorted(seeds.items(), key=lambda x: (-idf[x[0]], x[1]))[:SEEDS]
        lookups += [(w, t, i) for w, i in seeds]
        facts.append((t, label, sum(idf[w] for w in template), len(key_places), len(seeds)))
    posting = F.broadcast(spark.createDataFrame(postings, "template int, place int, word string, idf double, in_key boolean"))
    lookup = F.broadcast(spark.createDataFrame(lookups, "word string, template int, seed_at int"))
    fact = F.broadcast(spark.createDataFrame(facts, "template int, label string, total double, key_words int, seeds int"))

    flat = hits.where(F.col("hits").isNotNull()).select("_row", F.explode("hits").alias("h")).select("_row", F.col("h.at").alias("at"), F.col("h.word").alias("word"))
    placement = ["_row", "template", "offset"]
    offsets = flat.join(lookup, "word").select("_row", "template", (F.col("at") - F.col("seed_at")).alias("offset"))
    proposed = offsets.groupBy(*placement).agg(F.count(F.lit(1)).alias("n")).join(fact, "template").where(F.col("n") == F.col("seeds")).select(*placement)

    def standing(placements: DataFrame, words: DataFrame) -> DataFrame:
        """placements with each of the words that stands at its place there."""
        wanted = placements.join(words, "template").select(*placement, "idf", (F.col("offset") + F.col("place")).alias("at"), "word")
        return wanted.join(flat, ["_row", "at", "word"]).groupBy(*placement)

    # the key phrases first: each of their words among the row's words at the placement; then the share of the whole template
    keyed = standing(proposed, posting.where("in_key")).agg(F.count(F.lit(1)).alias("n")).join(fact, "template").where(F.col("n") == F.col("key_words")).select(*placement)
    found = standing(keyed, posting).agg(F.sum("idf").alias("found")).join(fact, "template")
    verified = found.withColumn("share", F.least(F.lit(1.0), F.col("found") / F.col("total"))).where(F.col("share") >= least_score)
    labels = verified.groupBy(F.col("_row").alias("_r")).agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    joined = hits.join(labels, hits["_row"] == labels["_r"], "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    plain = [c for c in docs.columns if c not in ADDED and c != text]
    return joined.select(*plain, "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
