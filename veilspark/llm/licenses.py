"""License scans by a positional rare-token index.

Templates (whole licence texts where they are short, the customary notices elsewhere) are cut into words. A first
pass counts in how many documents each licence word occurs; the index keeps each template's words of the highest
IDF, and the words of its mandatory key phrase, with their places. A second pass looks up each document's own
highest-IDF licence words, those that are the rarest of some key phrase, and keeps the places of indexed words
around them only. Those meet the postings; a template stands in a document where enough of its indexed words, by
IDF, agree on one relative position, all words of the key phrase among them.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, let, materialize

# Phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Fixed values: (label, notice, mandatory key phrase); the notices are the licences' own customary wording.
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("artistic-2.0", "licensed under the artistic license 2 0", "artistic license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsl-1.0", "boost software license version 1 0", "boost software license"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("creative-commons", "licensed under a creative commons attribution license", "creative commons"),
    ("epl-2.0", "eclipse public license version 2 0", "eclipse public license"),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    ("ofl-1.1", "sil open font license version 1 1", "open font license"),
    ("public-domain", "released into the public domain", "into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("wtfpl", "do what the fuck you want to public license", "you want to public license"),
    ("zlib", "this software is provided as is without any express or implied warranty", "provided as is without any express or implied warranty"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "permission is granted to anyone to use this software for any purpose"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "unless required by applicable law or agreed to in writing"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "under the terms of the gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "under the terms of the gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "anyone is free to copy modify publish use compile sell or distribute"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy of the software"),
]
RAREST, SHARE = 12, 0.5


def split(text: str) -> list[str]:
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", text)


def licence_words(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in split(text)} | {w for p in BASE for w in split(p)})


def idf_of(docs: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """IDF of each licence word over all rows of docs (text)."""
    known = licence_words(templates)
    words = F.array_distinct(F.filter(alnum_words(F.coalesce("text", F.lit(""))), lambda x: x.isin(known)))
    none = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("n"))
    held = docs.select(F.explode(F.concat(F.array(F.lit("")), words)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))  # "" once a document
    df = {r.word: r.n for r in held.unionByName(none).collect()}  # a row for each licence word
    return {w: math.log(1 + df.get("", 0) / max(1, df.get(w, 0))) for w in known}


def postings(idf: dict[str, float], templates=TEMPLATES, rarest: int = RAREST) -> list[tuple[int, str, str, int, bool, float, int, float]]:
    """(template, label, word, place, whether of the key phrase, IDF, key words, IDF of all entries), one per indexed word."""
    out = []
    for t, (label, text, phrase) in enumerate(templates):
        words, key = split(text), split(phrase)
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)  # the phrase is part of the notice
        places = set(range(at, at + len(key))) | set(sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:rarest])
        total = sum(idf[words[i]] for i in places)
        out += [(t, label, words[i], i, at <= i < at + len(key), idf[words[i]], len(key), total) for i in sorted(places)]
    return out


def gates(idf: dict[str, float], templates=TEMPLATES) -> list[str]:
    """The word of the highest IDF of each key phrase and base phrase; a document with none of them holds no notice and no phrase."""
    return sorted({max(split(p), key=lambda w: (idf[w], w)) for p in [*BASE, *[k for _, _, k in templates]]})


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per row of docs (doc_id, text): the contract's columns, and labels.

    Null texts are empty; texts without words or without any indexed word have no labels, null places and score
    0. Very long texts take time in proportion to their length. Notices found more than once, and repeated rows,
    count each; labels are distinct. Null doc_ids stay; other columns are not looked at; an empty table gives an
    empty result. score is 1 where a base phrase stands, else the largest share of a found template's indexed words,
    by IDF, that agree on one position; 0 without any label.
    """
    idf = idf_of(docs, templates)
    index = postings(idf, templates)
    vocabulary = sorted({p[2] for p in index} | {w for b in BASE for w in b.split()})
    # All that counts is near a gate word: no notice or phrase is longer than `reach` words, and each holds one.
    gate, reach = gates(idf, templates), max(len(split(t)) for _, t, _ in templates)
    words = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", alnum_words(F.coalesce("text", F.lit(""))).alias("w"))
    none = F.array().cast("array<struct<pos:int,word:string>>")

    def near(w: Column) -> Column:
        """Places of indexed words in blocks of `reach` words that hold a gate word, or beside such blocks."""
        blocks = F.sequence(F.lit(0), F.floor((F.size(w) - 1) / reach).cast("int"))
        flags = F.transform(blocks, lambda k: F.arrays_overlap(F.slice(w, k * reach + 1, reach), F.lit(gate)))

        def placed(f: Column) -> Column:
            wide = F.transform(f, lambda x, k: x | F.coalesce(F.get(f, k - 1), F.lit(False)) | F.coalesce(F.get(f, k + 1), F.lit(False)))
            return let(wide, lambda g: F.filter(F.transform(w, lambda x, i: F.struct(i.alias("pos"), x.alias("word"))), lambda s: s["word"].isin(vocabulary) & F.get(g, F.floor(s["pos"] / reach).cast("int"))))

        return let(flags, placed)

    hits = words.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.when(F.arrays_overlap("w", F.lit(gate)), let(F.col("w"), near)).otherwise(none).alias("hits"))
    table = materialize(hits, "licenses")  # one small row per document, its rid for good; read below for phrases and for templates

    def stands(phrase: str) -> Column:
        """Places where the phrase stands: its words are all indexed, so they are neighbours among the hits too."""

        def here(e: Column, k: Column) -> Column:
            same = e["word"] == phrase.split()[0]
            for i, w in enumerate(phrase.split()[1:], 1):
                other = F.get("hits", k + i)
                same = same & F.coalesce((other["word"] == w) & (other["pos"] == e["pos"] + i), F.lit(False))
            return same

        return F.transform(F.filter("hits", here), lambda e: F.struct(e["pos"].cast("long").alias("pos"), F.lit(BASE[phrase]).alias("label")))

    base = table.select("rid", "doc_id", "n_words", F.when(F.size("hits") > 0, F.concat(*[stands(p) for p in BASE])).otherwise(F.array().cast("array<struct<pos:bigint,label:string>>")).alias("found"))

    posts = F.broadcast(table.sparkSession.createDataFrame(index, "t int, label string, word string, place int, is_key boolean, idf double, n_key int, total double"))  # as many rows as the templates' words
    met = table.where(F.size("hits") > 0).select("rid", F.explode("hits").alias("h")).select("rid", "h.pos", "h.word").join(posts, "word")
    agree = met.groupBy("rid", "t", "label", "n_key", "total", (F.col("pos") - F.col("place")).alias("origin")).agg(F.sum(F.col("is_key").cast("int")).alias("key_found"), F.sum("idf").alias("mass"))
    share = F.round(F.col("mass") / F.col("total"), 6)  # summed in any order
    accepted = agree.where((F.col("key_found") == F.col("n_key")) & (share >= SHARE)).groupBy("rid").agg(F.collect_set("label").alias("own"), F.max(share).alias("share"))

    named = F.array_distinct(F.transform("found", lambda f: f["label"]))
    joined = base.join(accepted, "rid", "left")
    return joined.select(
        "doc_id", "n_words",
        F.size("found").cast("long").alias("n_base"),
        F.array_min(F.transform("found", lambda f: f["pos"])).alias("first_word"),
        F.array_max(F.transform("found", lambda f: f["pos"])).alias("last_word"),
        F.array_join(F.array_sort(named), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("found") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
