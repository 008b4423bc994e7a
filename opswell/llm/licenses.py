"""License scans: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from opswell.functions.text import once

#: A word of a text in lower case, and of a text as it is.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose places are always counted, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, keyword that every match holds, names. Names are regular expressions over words in lower case with one space between them.
FAMILIES = (
    ("0bsd", "0bsd", r"0bsd"),
    ("0bsd", "zero clause", r"zero clause bsd"),
    ("afl", "academic", r"academic free(?: license)?"),
    ("afl", "afl", r"afl(?: \d)?(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero(?: gpl| general public)?"),
    ("agpl", "agpl", r"agpl(?: ?v?3)?(?: 0)?"),
    ("apache", "apache", r"apache(?: software)?(?: license)?(?: version)?(?: 1 1| 2(?: 0)?)?"),
    ("apsl", "apple public", r"apple public source"),
    ("artistic", "artistic", r"(?:perl )?artistic(?: 1 0| 2 0)?"),
    ("beerware", "beer", r"beer ?ware"),
    ("bittorrent", "bittorrent", r"bittorrent open source"),
    ("bluoak", "blue oak", r"blue oak(?: model)?(?: 1 0 0)?"),
    ("boost", "boost", r"boost(?: software)?(?: 1 0)?"),
    ("bsd", "bsd", r"(?:new |modified |simplified |revised |original |[234] clause )?bsd(?: [234] clause)?"),
    ("bsl", "business source", r"business source(?: 1 1)?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4](?: [05])?)?(?: international| unported)?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc", "non commercial", r"creative commons attribution non commercial"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution noncommercial"),
    ("cc-by-nd", "no deriv", r"creative commons attribution no deriv(?:s|atives)"),
    ("cc-by-nd", "noderiv", r"creative commons attribution noderiv(?:s|atives)"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-sa", "alike", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"),
    ("cddl", "common development", r"common development and distribution"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: [12](?: [01])?)?"),
    ("cpl", "common public", r"common public(?: 1 0)?"),
    ("ecl", "educational", r"educational community(?: 2 0)?"),
    ("eiffel", "eiffel", r"eiffel forum(?: [12])?"),
    ("epl", "eclipse", r"eclipse (?:public|distribution)(?: [12] 0)?"),
    ("eupl", "european", r"european union public"),
    ("eupl", "eupl", r"eupl(?: 1 [012])?"),
    ("fdl", "free documentation", r"(?:gnu )?free documentation(?: 1 [123])?"),
    ("ftl", "freetype", r"freetype(?: project)?"),
    ("gpl", "general public", r"(?:gnu )?general public"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: ?v?[123])?(?: 0)?(?: only| or later)?"),
    ("hpnd", "historical permission", r"historical permission notice(?: and disclaimer)?"),
    ("icu", "icu", r"icu"),
    ("ijg", "jpeg", r"independent jpeg group"),
    ("ipl", "ibm public", r"ibm public(?: 1 0)?"),
    ("isc", "isc", r"isc"),
    ("latex", "latex", r"latex project public(?: 1 3c?)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser(?: gpl| general public)"),
    ("lgpl", "lgpl", r"lgpl(?: ?v?[23])?(?: [01])?(?: only| or later)?"),
    ("lgpl", "library general", r"(?:gnu )?library general public"),
    ("libpng", "libpng", r"libpng(?: 2 0)?"),
    ("mit", "expat", r"expat"),
    ("mit", "mit", r"mit(?: x11)?"),
    ("mit-0", "no attribution", r"mit no attribution"),
    ("mpl", "mozilla", r"mozilla public(?: 1 [01]| 2 0)?"),
    ("mpl", "mpl", r"mpl(?: 1 [01]| 2 0)?"),
    ("ms-pl", "microsoft public", r"microsoft public"),
    ("ms-rl", "reciprocal", r"microsoft reciprocal"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database"),
    ("ofl", "open font", r"sil open font(?: 1 [01])?"),
    ("openssl", "openssl", r"openssl(?: ssleay)?"),
    ("osl", "open software", r"open software(?: [123] [01])?"),
    ("php", "php", r"php(?: 3 0[01]?)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("psf", "python", r"python(?: software foundation)?"),
    ("qpl", "q public", r"q public"),
    ("qpl", "qpl", r"qpl"),
    ("ruby", "ruby", r"ruby"),
    ("sspl", "server side", r"server side public"),
    ("unlicense", "unlicense", r"unlicense"),
    ("upl", "universal permissive", r"universal permissive(?: 1 0)?"),
    ("vim", "vim", r"vim"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice)?"),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to public"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("zpl", "zope", r"zope public(?: [12] [01])?"),
)
#: How a name is put to use, most telling first: priority, words before the name, words after it.
FORMS = (
    (1, r"spdx license identifier ", r""),
    (2, r"(?:licensed|released|distributed|available|published|provided) (?:under|according to|subject to) (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?", r"(?: licen[cs]e)?"),
    (3, r"(?:under|subject to) the terms (?:and conditions )?of the ", r"(?: licen[cs]e)?"),
    (4, r"(?:see|read|copy of) the ", r" licen[cs]e"),
    (5, r"", r" licen[cs]ed?"),
)
#: Rules on sentences of license texts rather than on names: priority, label, keyword, expression.
SENTENCES = (
    (1, "mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    (1, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    (1, "apache", "apache org", r"(?:http )?(?:www )?apache org licenses license 2 0"),
    (1, "gpl", "free software", r"this program is free software you can redistribute it"),
    (1, "isc", "permission to use", r"permission to use copy modify and or distribute this software"),
    (1, "zlib", "express or implied", r"provided as is without any express or implied warranty in no event"),
    (1, "unlicense", "public domain", r"free and unencumbered software released into the public domain"),
    (3, "public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    (4, "copyleft", "copyleft", r"copyleft(?:ed)?"),
    (6, "copyright", "copyright", r"copyright(?: c)?(?: \d{4}){1,4}"),
    (6, "proprietary", "all rights reserved", r"all rights reserved"),
    (6, "warranty", "warrant", r"without (?:any )?warrant(?:y|ies)(?: of any kind)?"),
)


@dataclass(frozen=True)
class Rule:
    number: int
    priority: int
    label: str
    keyword: str
    expression: str
    #: Whole words, one of which every match holds.
    words: tuple[str, ...]


def wordings(expression: str) -> list[str]:
    """The texts that an expression of the rules matches, with 0 for any digit and the least number of a counted repetition."""

    def read(i: int) -> tuple[list[str], int]:
        out, now = [], [""]
        while i < len(expression) and expression[i] != ")":
            if expression[i] == "|":
                out, now, i = out + now, [""], i + 1
                continue
            if expression.startswith("(?:", i):
                one, i = read(i + 3)
                i += 1
            elif expression[i] == "[":
                until = expression.index("]", i)
                first, *rest = expression[i + 1 : until]
                one = [chr(c) for c in range(ord(first), ord(rest[1]) + 1)] if rest[:1] == ["-"] else [first, *rest]
                i = until + 1
            elif expression[i] == "\\":
                one, i = ["0"], i + 2
            else:
                one, i = [expression[i]], i + 1
            if expression[i : i + 1] == "?":
                one, i = [*one, ""], i + 1
            elif expression[i : i + 1] == "{":
                until = expression.index("}", i)
                one, i = [x * int(expression[i + 1 : until].split(",")[0]) for x in one], until + 1
            now = [a + b for a in now for b in one]
        return out + now, i

    return read(0)[0]


def _anchors(keyword: str, names: str) -> tuple[str, ...]:
    """The words of all wordings that hold the longest word of the keyword."""
    part = max(keyword.split(), key=len)
    return tuple(sorted({w for text in wordings(names) for w in text.split() if part in w}))


def rules() -> list[Rule]:
    """The rules in order: by priority, then as they are written. Several hundred: each name in each form, and the sentences."""
    own = [(p, label, keyword, expression, _anchors(keyword, expression)) for p, label, keyword, expression in SENTENCES]
    named = [(label, keyword, names, _anchors(keyword, names)) for label, keyword, names in FAMILIES]
    own += [(p, label, keyword, f"{before}(?:{names}){after}", anchors) for p, before, after in FORMS for label, keyword, names, anchors in named]
    return [Rule(i, *r) for i, r in enumerate(sorted(own, key=lambda r: r[0]))]


#: The words of all rules and base phrases: a text with a signature or a base phrase holds one of them.
GATE = tuple(sorted({w for r in rules() for w in r.words} | {phrase.split()[0] for phrase, _ in BASE}))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _places(words: Column, phrase: str) -> Column:
    """Starts of all places where the phrase's words stand consecutively."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i):
        hit = F.lit(True)
        for k, w in enumerate(parts):
            hit = hit & (F.get(words, i + k) == w)
        return hit

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def _hits(line: Column, held: Column, own: list[Rule]) -> Column:
    """Spans (first word, one after the last, rule, priority, label) of all rules of whose words the line holds one, and whose keyword it holds.

    line: the words with a space before, between and after them. held: those of
    the gate's words that the line holds. A rule's matches do not overlap. Where a match begins is told by the lengths of what stands
    between matches.
    """

    table = F.array(*[F.struct(F.lit(r.number).alias("number"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.expression).alias("expression")) for r in own])
    numbers = F.create_map(*[x for w in GATE for x in (F.lit(w), F.array(*[F.lit(r.number) for r in own if w in r.words]))])

    def of_rule(rule):
        expression = F.concat(F.lit("(?<= )(?:"), rule["expression"], F.lit(")(?= )"))
        found = F.call_function("regexp_extract_all", line, expression, F.lit(0))
        between = F.split(line, expression)
        blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(blanks(gap).alias("gap"), blanks(hit).alias("more")))
        starts = F.aggregate(
            steps,
            F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<first:int,until:int>>").alias("spans")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + s["more"]).alias("at"),
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + s["gap"]).alias("first"), (acc["at"] + s["gap"] + s["more"] + 1).alias("until")))).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )
        return F.transform(starts, lambda s: F.struct(s["first"].alias("first"), s["until"].alias("until"), rule["number"].alias("rule"), rule["priority"].alias("priority"), rule["label"].alias("label")))

    tried = F.transform(F.array_distinct(F.flatten(F.transform(held, lambda w: F.element_at(numbers, w)))), lambda n: F.element_at(table, n + 1))
    return F.flatten(F.transform(F.filter(tried, lambda r: F.contains(line, r["keyword"])), of_rule))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of `keep` with n_words, base (label and starts of each phrase) and spans (detections that stay).

    docs: text and whatever `keep` names. A text that holds none of the gate's
    words, as the rules see words, is only counted. In the others, each rule is tried
    if the text holds one of its words and its keyword. Of the matches, one that lies inside another of the same or a
    higher priority (a smaller number) is dropped; of two over the same words the
    first rule's stays. The base phrases are found apart from the rules and are
    never dropped.

    Null and empty texts have no words, no base and no spans. Equal rows are
    scanned each on its own. Without rows the result is empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # Spark's lower case also makes a few other signs ASCII letters, but leaves words as many and ASCII words as they are; so it may tell what to look at, at less cost.
    rows = once(docs.select(*keep, text.alias("_text")), _plain=F.regexp_extract_all(F.lower("_text"), F.lit(WORD), F.lit(0)))
    rows = once(rows, _held=F.array_intersect("_plain", F.array(*[F.lit(w) for w in GATE])))
    base_type = "array<struct<label:string,starts:array<int>>>"
    span_type = "array<struct<first:int,until:int,rule:int,label:string>>"
    rest = rows.filter(F.size("_held") == 0).select(*keep, F.size("_plain").cast("long").alias("n_words"), F.array().cast(base_type).alias("base"), F.array().cast(span_type).alias("spans"))

    words = F.regexp_extract_all(lowered(F.col("_text")), F.lit(WORD), F.lit(0))
    gated = rows.filter(F.size("_held") > 0).select(*keep, words.alias("_words"), "_held", F.monotonically_increasing_id().alias("_row"))
    line = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    base = F.filter(
        F.array(*[F.struct(F.lit(label).alias("label"), _places(F.col("_words"), phrase).alias("starts")) for phrase, label in BASE]),
        lambda b: F.size(b["starts"]) > 0,
    )
    found = gated.select(
        *keep, "_row", F.size("_words").cast("long").alias("n_words"), base.alias("base"), F.explode_outer(_hits(line, F.col("_held"), rules())).alias("_hit")
    ).select(*keep, "_row", "n_words", "base", "_hit.*")
    # In this order whatever holds a match comes before it, so one running maximum for each priority tells whether something does.
    before = Window.partitionBy("_row").orderBy("first", F.desc("until"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for p in sorted({r.priority for r in rules()}):
        inside = inside | ((F.col("priority") >= p) & (F.coalesce(F.max(F.when(F.col("priority") == p, F.col("until"))).over(before), F.lit(-1)) >= F.col("until")))
    kept = found.withColumn("_inside", inside)
    span = F.struct("first", "until", "rule", "label")
    some = kept.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in [*keep, "n_words", "base"]],
        F.array_sort(F.collect_list(F.when(F.col("first").isNotNull() & ~F.col("_inside"), span))).alias("spans"),
    ).drop("_row")
    return rest.unionByName(some)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last places and labels of scanned rows.

    score: 1 - 2^-(places of base phrases + half the spans): 0 without any.
    """
    starts = F.flatten(F.transform("base", lambda b: b["starts"]))
    base_labels = F.array_sort(F.transform("base", lambda b: b["label"]))
    labels = F.array_sort(F.array_union(base_labels, F.transform("spans", lambda s: s["label"])))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (1 - F.pow(F.lit(2.0), -(F.size(starts) + 0.5 * F.size("spans")))).alias("score"),
    )


#: Labels and score rest on the rules, which SQL of another engine cannot resolve; tests hold them against a plain scan.
ORACLE = None
