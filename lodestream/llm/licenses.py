"""Licence scan by a positional rare-token index, on DataFrame functions only.

Templates are licence notices, titles and identifiers. Their words form an index of postings (template, position); a
template's rarest words are its ``LOOKED_UP`` words of highest inverse document frequency, measured over the whole
table. For each text:

1. Those of its words that are among the rarest of some template are looked up. A template is possible if the ones that
   stand in the text carry ``MIN_MATCH`` of the weight of the template's rarest words. Each template has its own rarest
   words, so no licence hides another, however many stand in one text.
2. Each occurrence of such a word votes for (template, place of the template in the text); the votes are intersected by
   relative position: only words at the right distance from each other add up. A place is a candidate where they
   reach ``MIN_MATCH`` of the weight.
3. A candidate is found if the template's key phrases stand word for word at that place, ``SLACK`` words more or less.

``score`` is the best share of a template found, at least 0.5 where a base label stands, to six places.

Everything is local to a row but the document frequencies, which are one map-side sum over a fixed vocabulary. The texts
are read twice and nothing is written.

Defined cases: a null text is an empty one, with no words, no places and no labels; repeated rows and ties in frequency
(broken by the word) give equal results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import ascii_lower

#: Phrases and the labels they give on their own.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, notice in lower-case words, phrases that must stand at its place.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("apache org licenses license 2 0", "except in compliance with the license")),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice")),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy of the software",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "this work is licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nc-4.0", "this work is licensed under the creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0 international",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-sa-4.0", "this work is licensed under the creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0 international",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("agpl-3.0", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or", ("gnu affero general public license", "version 3")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3.0", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or", ("gnu general public license as published", "either version 3 of the license")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-2.0", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or", ("gnu general public license as published", "either version 2 of the license")),
    ("lgpl-2.1", "modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or", ("gnu lesser general public license", "version 2 1")),
    ("lgpl-3.0", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or", ("gnu lesser general public license", "version 3")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute this software for any purpose",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge to any person obtaining a copy of this software", "to deal in the software without restriction")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge to any person obtaining a copy of this software",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable for any damages arising from the use of this software",)),
)

#: Label and title, all of which must stand in the text.
TITLES = (
    ("agpl-3.0", "gnu affero general public license version 3"),
    ("apache-2.0", "apache license 2 0"),
    ("apache-2.0", "apache license version 2 0"),
    ("apache-2.0", "apache 2 0 license"),
    ("bsd-2-clause", "bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause"),
    ("bsl-1.0", "boost software license version 1 0"),
    ("cc-by-3.0", "cc by 3 0"),
    ("cc-by-3.0", "creative commons attribution 3 0"),
    ("cc-by-4.0", "cc by 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    ("cc-by-nc-nd-4.0", "creative commons attribution noncommercial noderivatives 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    ("cc-by-nc-sa-4.0", "creative commons attribution noncommercial sharealike 4 0"),
    ("cc-by-nd-4.0", "cc by nd 4 0"),
    ("cc-by-nd-4.0", "creative commons attribution noderivatives 4 0"),
    ("cc-by-sa-3.0", "cc by sa 3 0"),
    ("cc-by-sa-3.0", "creative commons attribution sharealike 3 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0"),
    ("epl-2.0", "eclipse public license 2 0"),
    ("epl-2.0", "eclipse public license v 2 0"),
    ("epl-2.0", "eclipse public license version 2 0"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1"),
    ("lgpl-3.0", "gnu lesser general public license version 3"),
    ("mit", "mit license"),
    ("mpl-2.0", "mozilla public license 2 0"),
    ("mpl-2.0", "mozilla public license version 2 0"),
)

TEMPLATES = (
    *NOTICES,
    *((label, title, (title,)) for label, title in TITLES),
    *((label, f"spdx license identifier {spelled}", (f"spdx license identifier {spelled}",)) for label, spelled in ((x, x.replace("-", " ").replace(".", " ")) for x in sorted({x[0] for x in (*NOTICES, *TITLES)}))),
)

#: Words too common in any prose to be worth a posting.
COMMON = set(
    "a above accompanying all an and any anyone are as at be by copies copy do either event except file files following for form forms free from held http in including is it kind law may must no not of on or org other our person possible provided related required source terms that has into used under the this to unless use v want what will with without work writing written www you 0 1 2 3 4".split()
)
LOOKED_UP = 8
MIN_MATCH = 0.6
#: Words that may stand between a template's place and its key phrases, beside what the template itself has there.
SLACK = 8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: word -> (template, position of the word in it)
POSTINGS: dict[str, list[tuple[int, int]]] = {}
for _t, (_, _statement, _) in enumerate(TEMPLATES):
    for _p, _w in enumerate(_statement.split()):
        if _w not in COMMON:
            POSTINGS.setdefault(_w, []).append((_t, _p))


def normalized(text: Column) -> Column:
    """The words of a text in lower-case A-Z, joined by single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    here = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    return F.filter(here, lambda i: F.array_join(F.slice(words, i + 1, len(parts)), " ") == phrase)


def _holds(phrase: str) -> Column:
    return F.col("padded").contains(f" {phrase} ")


def split_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Of each text: key, norm, its words, and the distinct ones of the index."""
    out = docs.select(F.col(key).alias("key"), normalized(F.col(text)).alias("norm")).withColumn("words", F.split("norm", " "))
    return out.withColumn("hits", F.array_intersect("words", _constant(sorted(POSTINGS), "array<string>")))


def document_frequencies(split: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows in all, and rows with each licence word. At most len(POSTINGS) + 1 rows reach the driver, at any size."""
    got = {r["w"]: r["n"] for r in split.select(F.explode(F.array_append("hits", "")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return got.pop("", 0), got


def _base(split: DataFrame) -> DataFrame:
    """With n_words, and the places and labels of the base phrases."""
    norm, words, none = F.col("norm"), F.col("words"), F.array().cast("array<int>")
    n = F.when(norm == "", F.lit(0)).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")
    out = split.withColumns({"n_words": n, "padded": F.concat(F.lit(" "), norm, F.lit(" "))})
    return out.withColumns(
        {
            "places": F.flatten(F.array(*[F.coalesce(F.when(_holds(phrase), _places(words, phrase)), none) for phrase in BASE])),
            "base": F.array_compact(F.array(*[F.when(_holds(phrase), F.lit(label)) for phrase, label in BASE.items()])),
        }
    )


def _constant(value: object, kind: str) -> Column:
    """A literal of a nested type, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), F.lit(kind))


def rarest(idf: dict[str, float], looked_up: int = LOOKED_UP) -> list[list[str]]:
    """The rarest words of each template, the rarest first, ties by the word."""
    return [sorted({w for w in statement.split() if w in POSTINGS}, key=lambda w: (-idf[w], w))[:looked_up] for _, statement, _ in TEMPLATES]


def candidates(split: DataFrame, idf: dict[str, float], looked_up: int = LOOKED_UP) -> DataFrame:
    """With ``candidates``: (template, place, share) where the rarest words stand at the right distances; null if no template is possible."""
    own = rarest(idf, looked_up)
    voting = {w: [{"t": t, "p": p, "weight": idf[w]} for t, p in ps if w in own[t]] for w, ps in POSTINGS.items()}
    whole = [math.fsum(v["weight"] for votes in voting.values() for v in votes if v["t"] == t) for t in range(len(TEMPLATES))]
    most = max((sum(v["t"] == t for votes in voting.values() for v in votes) for t in range(len(TEMPLATES))), default=0)
    postings = _constant({w: votes for w, votes in voting.items() if votes}, "map<string,array<struct<t:int,p:int,weight:double>>>")
    parts = [{"t": t, "words": [{"w": w, "weight": math.fsum(v["weight"] for v in voting[w] if v["t"] == t)} for w in words], "needed": (MIN_MATCH - 1e-6) * whole[t]} for t, words in enumerate(own) if words]
    templates = _constant(parts, "array<struct<t:int,words:array<struct<w:string,weight:double>>,needed:double>>")

    standing = lambda t: F.aggregate(F.filter(t["words"], lambda x: F.array_contains("hits", x["w"])), F.lit(0.0), lambda s, x: s + x["weight"])
    possible = F.transform(F.filter(templates, lambda t: standing(t) >= t["needed"]), lambda t: t["t"])
    out = split.withColumn("possible", F.when(F.size("hits") > 0, possible))

    voters = F.filter(F.transform("words", lambda w, i: F.when(w.isin(sorted(w for w in voting if voting[w])), F.struct(w.alias("w"), i.alias("i")))), lambda o: o.isNotNull())
    for_one = lambda o: F.transform(F.filter(F.element_at(postings, o["w"]), lambda p: F.array_contains("possible", p["t"])), lambda p: F.struct(p["t"].alias("t"), (o["i"] - p["p"]).alias("at"), p["weight"].alias("weight")))
    out = out.withColumn("votes", F.when(F.size("possible") > 0, F.sort_array(F.flatten(F.transform(voters, for_one)))))

    # the votes of one place follow each other, and each of them has another position in the template, so there are at most ``most``
    weights = _constant(whole, "array<double>")
    here = lambda v, j: F.filter(F.slice("votes", j + 1, most), lambda x: (x["t"] == v["t"]) & (x["at"] == v["at"]))
    share = lambda v, j: F.round(F.least(F.aggregate(here(v, j), F.lit(0.0), lambda s, x: s + x["weight"]) / F.get(weights, v["t"]), F.lit(1.0)), 6)
    before = lambda j: F.get(F.col("votes"), j - 1)
    first = lambda v, j: (j == 0) | (before(j)["t"] != v["t"]) | (before(j)["at"] != v["at"])
    places = F.transform("votes", lambda v, j: F.when(first(v, j), F.struct(v["t"].alias("t"), v["at"].alias("at"), share(v, j).alias("share"))))
    return out.withColumn("candidates", F.filter(places, lambda c: c["share"] >= MIN_MATCH))


def _verified(c: Column) -> Column:
    """Whether the key phrases of a candidate stand at its place."""
    known = _constant([{"words": len(statement.split()), "phrases": [f" {p} " for p in phrases]} for _, statement, phrases in TEMPLATES], "array<struct<words:int,phrases:array<string>>>")
    start = F.greatest(c["at"] - SLACK, F.lit(0))
    window = F.concat(F.lit(" "), F.array_join(F.slice("words", start + 1, c["at"] + F.get(known, c["t"])["words"] + SLACK - start), " "), F.lit(" "))
    return F.forall(F.get(known, c["t"])["phrases"], lambda p: window.contains(p))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", looked_up: int = LOOKED_UP) -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    split = split_texts(docs, key, text)
    total, df = document_frequencies(split)
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in POSTINGS}
    names = _constant([label for label, _, _ in TEMPLATES], "array<string>")
    out = candidates(_base(split), idf, looked_up)
    found = F.transform(F.filter("candidates", _verified), lambda c: F.struct(F.get(names, c["t"]).alias("label"), c["share"].alias("share")))
    out = out.withColumn("found", F.coalesce(found, F.array().cast("array<struct<label:string,share:double>>")))
    labels = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))
    return out.select(
        F.col("key").alias(key),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.concat("base", F.transform("found", lambda f: f["label"]))).alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def oracle_sql(table: str = "documents") -> str:
    """The same result in DuckDB's SQL, by plain joins over all words of all texts."""
    quoted = lambda x: "'" + x + "'"
    rows = lambda values: ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in v) + ")" for v in values)
    words = rows((w, t, p) for w, ps in sorted(POSTINGS.items()) for t, p in ps)
    phrases = rows((t, f" {p} ") for t, (_, _, ps) in enumerate(TEMPLATES) for p in sorted(set(ps)))
    base = rows((f" {p} ", label, len(p.split())) for p, label in BASE.items())
    return f"""
        WITH posting(w, t, p) AS (VALUES {words}), phrase(t, phrase) AS (VALUES {phrases}), template(t, label, n) AS (VALUES {rows((t, x[0], len(x[1].split())) for t, x in enumerate(TEMPLATES))}), base(phrase, label, n) AS (VALUES {base}),
        d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {table}),
        n AS (SELECT rid, doc_id, words, len(words) AS n_words, ' ' || array_to_string(words, ' ') || ' ' AS norm FROM d),
        word AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM d),
        place AS (SELECT n.rid, b.label, word.i FROM n JOIN base b ON contains(n.norm, b.phrase) JOIN word ON word.rid = n.rid AND ' ' || array_to_string(n.words[word.i + 1 : word.i + b.n], ' ') || ' ' = b.phrase),
        placed AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS base FROM place GROUP BY rid),
        occ AS (SELECT rid, w, i FROM word WHERE w IN (SELECT w FROM posting)),
        idf AS (SELECT w, ln(((SELECT count(*) FROM d) + 1) / (count(DISTINCT rid) + 1)) + 1e-3 AS weight FROM (SELECT DISTINCT w FROM posting) LEFT JOIN occ USING (w) GROUP BY w),
        voting AS (SELECT t, p, w, weight, dense_rank() OVER (PARTITION BY t ORDER BY weight DESC, w) AS r FROM posting JOIN idf USING (w) QUALIFY r <= {LOOKED_UP}),
        whole AS (SELECT t, sum(weight) AS weight FROM voting GROUP BY t),
        candidate AS (SELECT rid, t, spot, round(least(run / weight, 1.0), 6) AS share FROM (SELECT rid, t, i - p AS spot, sum(weight) AS run FROM voting JOIN occ USING (w) GROUP BY ALL) JOIN whole USING (t) WHERE share >= {MIN_MATCH}),
        window_of AS (SELECT rid, t, spot, label, share, ' ' || array_to_string(words[greatest(spot - {SLACK}, 0) + 1 : spot + template.n + {SLACK}], ' ') || ' ' AS around FROM candidate JOIN template USING (t) JOIN n USING (rid)),
        found AS (SELECT rid, label, max(share) AS share FROM window_of c WHERE NOT EXISTS (SELECT 1 FROM phrase WHERE phrase.t = c.t AND NOT contains(c.around, phrase.phrase)) GROUP BY rid, label),
        best AS (SELECT rid, max(share) AS share, list(label) AS labels FROM found GROUP BY rid)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(coalesce(base, []) || coalesce(labels, []))), ','), '') AS labels, CAST(greatest(coalesce(share, 0.0), CASE WHEN base IS NULL THEN 0.0 ELSE 0.5 END) AS DOUBLE) AS score
        FROM n LEFT JOIN placed USING (rid) LEFT JOIN best USING (rid)"""
