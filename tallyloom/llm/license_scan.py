"""License detection by ordered signature rules, in SQL functions only.

A text is lower-cased (A-Z) and cut into words, kept as one line with single spaces. Four fixed phrases make the base labels. Beyond them,
hundreds of rules (a regex over the words joined by single spaces, a keyword, a priority) propose intervals:
a rule runs only where its keywords occur: those of its family's name are looked for first, then those of its form. A detection
whose interval lies within that of a rule with a higher priority, or of an equal one that is longer or
comes earlier in the list, is dropped; the labels of the rest are added to the base labels.

All of it is one projection: no shuffle, no grouping, one row in and one row out.

Nulls: a NULL text is empty: no words, no labels, score 0. A NULL doc_id is kept. Repeated rows each give a row;
an empty table gives none. Only doc_id and text are read, so other columns and their names do not matter.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.native import found, word_line
from tallyloom.operators.joins import computed_once

# Fixed values of the contract: the base phrases with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Families: (label, regex of the name in words, words of which every match holds one, versions).
FAMILIES = (
    ("mit", "mit(?: license)?", ("mit",), ("",)),
    ("apache", "apache(?: software)?(?: license)?", ("apache",), ("1 0", "1 1", "2 0")),
    ("gpl", "(?:gnu general public license|general public license|gnu gpl|gpl)", ("general public license", "gpl"), ("1", "2", "3")),
    ("lgpl", "(?:gnu lesser general public license|lesser general public license|lgpl)", ("lesser", "lgpl"), ("2 1", "3")),
    ("agpl", "(?:gnu affero general public license|affero general public license|agpl)", ("affero", "agpl"), ("3",)),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?", ("bsd",), ("",)),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: license)?", ("bsd",), ("",)),
    ("mpl", "(?:mozilla public license|mpl)", ("mozilla", "mpl"), ("1 1", "2 0")),
    ("epl", "(?:eclipse public license|epl)", ("eclipse", "epl"), ("1 0", "2 0")),
    ("eupl", "(?:european union public licen[cs]e|eupl)", ("european union", "eupl"), ("1 1", "1 2")),
    ("cc0", "(?:cc0|creative commons zero)", ("cc0", "creative commons"), ("1 0",)),
    ("cc-by", "(?:cc by|creative commons attribution)", ("cc by", "creative commons"), ("2 0", "3 0", "4 0")),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)", ("cc by sa", "creative commons"), ("2 0", "3 0", "4 0")),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)", ("cc by nc", "creative commons"), ("2 0", "3 0", "4 0")),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)", ("cc by nd", "creative commons"), ("2 0", "3 0", "4 0")),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", ("cc by nc sa", "creative commons"), ("2 0", "3 0", "4 0")),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)", ("cc by nc nd", "creative commons"), ("2 0", "3 0", "4 0")),
    ("isc", "isc(?: license)?", ("isc",), ("",)),
    ("zlib", "zlib(?: libpng)?(?: license)?", ("zlib",), ("",)),
    ("unlicense", "(?:the )?unlicense", ("unlicense",), ("",)),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public license)", ("wtfpl", "do what the"), ("2",)),
    ("artistic", "artistic license", ("artistic",), ("1 0", "2 0")),
    ("boost", "(?:boost software license|bsl)", ("boost", "bsl"), ("1 0",)),
    ("ofl", "(?:sil open font license|open font license|ofl)", ("open font", "ofl"), ("1 1",)),
    ("odbl", "(?:open database license|odbl)", ("open database", "odbl"), ("1 0",)),
    ("cddl", "(?:common development and distribution license|cddl)", ("common development", "cddl"), ("1 0", "1 1")),
    ("cecill", "cecill(?: free software)?(?: license)?", ("cecill",), ("2 1",)),
    ("postgresql", "postgresql license", ("postgresql",), ("",)),
    ("python", "(?:python software foundation license|psf license)", ("python", "psf"), ("2",)),
    ("openssl", "openssl license", ("openssl",), ("",)),
)
#: Forms a name appears in: (regex around the name, words of which every match holds one, priority). A version at
#: the name's end raises the priority by 5.
FORMS = (
    ("spdx license identifier {name}", ("spdx license identifier",), 95),
    ("(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?{name}", ("licensed under", "released under", "distributed under", "published under", "available under"), 90),
    ("(?:subject to|governed by|covered by) (?:the )?(?:terms of (?:the )?)?{name}", ("subject to", "governed by", "covered by"), 80),
    ("(?:see|read) (?:the )?{name} for (?:more )?details", ("for details", "for more details"), 75),
    ("(?:licen[cs]e|licensed) (?:the )?{name}", ("license ", "licence ", "licensed "), 60),
)
#: Headings and plain mentions: the name alone, with a version or, for names that mean nothing else, without. Lowest, so that
#: a name inside a longer match stays part of it. Short names such as `mit`, a word of German, need `license` behind them.
PLAIN = 50
SHORT = {"mit": ("mit license", "mit licence"), "isc": ("isc license", "isc licence"), "zlib": ("zlib license", "zlib licence", "zlib libpng license"), "apache": ("apache license", "apache licence", "apache software license"), "boost": ("boost software license",)}
#: Rules of no family: (label, regex, keyword, priority).
SINGLES = (
    ("proprietary", "all rights reserved", "reserved", 40),
    ("proprietary", "(?:proprietary and confidential|unauthorized copying of this file)", "confidential", 60),
    ("proprietary", "unauthorized copying of this (?:file|software)", "unauthorized", 60),
    ("public-domain", "(?:released|dedicated|placed|is) (?:in|into|to) the public domain", "public domain", 60),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 85),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors may be used", "contributors", 85),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 70),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "distribute this software", 85),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance", 85),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms", "redistribute", 70),
    ("zlib", "this software is provided as is without any express or implied warranty", "warranty", 65),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy", "organization", 85),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", 20),
)


def rules() -> list[tuple[str, str, tuple[str, ...], tuple[str, ...], int]]:
    """(label, regex, words of the form, words of the name, priority), in the order that breaks ties."""
    out = []
    for label, name, words, versions in FAMILIES:
        tail = name + "(?: license)?(?: international)?(?: public license)?(?: version| v)? v?{}(?: international| or later| only)?"
        numbered = [(f"{label}-{v.replace(' ', '.')}", tail.format(v), 5) for v in versions if v]
        for form, hints, priority in FORMS:
            out += [(full, form.format(name=rx), hints, words, priority + more) for full, rx, more in [*numbered, (label, name, 0)]]
        starts = lambda some: tuple(f" {w}" for w in some)
        out += [(full, rx, starts(words), words, PLAIN + more) for full, rx, more in numbered]
        alone = SHORT.get(label, words)
        out.append((label, f"(?:{'|'.join(alone)})" if label in SHORT else name, starts(alone), words, PLAIN))
    return out + [(label, rx, (word,), (word,), priority) for label, rx, word, priority in SINGLES]


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _places(joined: Column, pattern: str | Column) -> Column:
    """Matches as word intervals of ` word word word `; (start, end) with end exclusive."""
    rx = F.concat(F.lit("(?<= )(?:"), F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(")(?= )"))
    return F.transform(
        found(joined, rx, _spaces),
        lambda s: F.struct((s["start"] - 1).alias("start"), s["end"].alias("end")),
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row with its base places, all labels and a score."""
    lines = computed_once(docs.select("doc_id", "text"), joined=word_line(F.coalesce("text", F.lit(""))))
    words = lines.select("doc_id", (_spaces(F.col("joined")) - 1).cast("long").alias("n_words"), "joined")

    base = {label: F.when(F.col("joined").contains(f" {phrase} "), F.transform(_places(F.col("joined"), phrase), lambda s: s["start"])) for phrase, label in BASE}
    nothing = F.array().cast("array<int>")
    base_places = [F.coalesce(c, nothing).alias(label) for label, c in base.items()]

    texts = lambda words: F.array(*map(F.lit, words))
    # Rules stand under the words that their name needs, so that a text without them is asked once per family.
    catalog = F.array(*[
        F.struct(texts(name).alias("name"), F.array(*[
            F.struct(F.lit(n).alias("n"), F.lit(label).alias("label"), F.lit(rx).alias("rx"), texts(form).alias("form"), F.lit(p).alias("priority"))
            for n, (label, rx, form, _, p) in own
        ]).alias("rules"))
        for name, own in groupby(enumerate(rules()), lambda r: r[1][3])
    ])
    holds = lambda words: F.exists(words, lambda w: F.col("joined").contains(w))
    near = F.flatten(F.transform(F.filter(catalog, lambda f: holds(f["name"])), lambda f: f["rules"]))
    hits = F.flatten(F.transform(
        F.filter(near, lambda r: holds(r["form"])),
        lambda r: F.transform(_places(F.col("joined"), r["rx"]), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), r["priority"].alias("priority"), r["n"].alias("n"), r["label"].alias("label"))),
    ))
    kind = "array<struct<start:int,end:int,priority:int,n:int,label:string>>"
    seen = computed_once(words, base=F.struct(*base_places), hits=F.coalesce(hits, F.array().cast(kind)))

    def outdone(a: Column) -> Column:
        size = lambda x: x["end"] - x["start"]
        return F.exists("hits", lambda b: (b["start"] <= a["start"]) & (a["end"] <= b["end"]) & (
            (b["priority"] > a["priority"])
            | ((b["priority"] == a["priority"]) & ((size(b) > size(a)) | ((size(b) == size(a)) & (b["n"] < a["n"]))))
        ))

    kept = seen.withColumn("kept", F.filter("hits", lambda a: ~outdone(a)))
    places = F.concat(*[F.col(f"base.`{label}`") for _, label in BASE])
    base_labels = F.filter(F.array(*[F.when(F.size(F.col(f"base.`{label}`")) > 0, F.lit(label)) for _, label in BASE]), lambda x: x.isNotNull())
    own = F.transform("kept", lambda a: a["label"])
    best = F.coalesce(F.array_max(F.transform("kept", lambda a: a["priority"])), F.lit(0))
    return kept.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own))), ",").alias("labels"),
        (F.greatest(best, F.when(F.size(places) > 0, F.lit(50)).otherwise(F.lit(0))) / F.lit(100.0)).alias("score"),
    )
