"""Licence scans by ordered signature rules, in DataFrame functions only.

A text is scanned as its words (ASCII lower case). A keyword prefilter decides which texts are looked at: every rule
has a keyword without which it cannot match. Around each place of a keyword a window of words is cut, and the rules are
tried on it, anchored at that place. Each match is a detection: a label, an interval of words, and the priority of its
rule. A detection that another one contains is suppressed: the longer interval wins, and of equal intervals the rule
listed first. What is left gives the labels.

Rules are of two sorts. Signatures are phrases of licence texts and notices, which need not name the licence; of the
signatures around one place the first and longest counts. Names are rules for each way of speaking of a licence, made
from the lists of names and ways. All patterns are literals, so Spark compiles each once in a task. Base phrases are
found beside them and always stay.

Defined cases: null and empty texts have no words and no labels, score 0; repeated rows get equal results; very
long texts are scanned whole; documents are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import name

#: Fixed phrases and labels that every scan reports.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Phrases of licence texts and notices by label, as words; # marks the keyword. The surer licences first.
SIGNATURES = {
    "mit": """
        permission is hereby granted free of charge to any person #obtaining a copy of this software and associated documentation files
        to deal in the software without restriction including without #limitation the rights to use copy modify merge publish
        to use copy modify merge publish distribute #sublicense and or sell copies of the software
        to permit persons to whom the software is #furnished to do so subject to the following conditions
        the above copyright notice and this permission notice shall be included in all copies or substantial #portions of the software
        in no event shall the authors or copyright #holders be liable for any claim damages or other liability
        the warranties of merchantability fitness for a particular purpose and #noninfringement in no event shall the authors
    """,
    "x11": """
        the name of the x consortium shall not be used in #advertising or otherwise to promote the sale
        except as contained in this notice the name of the authors shall not be used in #advertising or otherwise to promote
    """,
    "isc": """
        permission to use copy modify and or distribute this software for any purpose with or without fee is #hereby granted
        permission to use copy modify and distribute this software for any purpose with or without fee is #hereby granted
        the software is provided as is and the author #disclaims all warranties with regard to this software
        in no event shall the author be liable for any special direct indirect or #consequential damages or any damages whatsoever
    """,
    "0bsd": """
        permission to use copy modify and or distribute this software for any purpose with or without fee is #hereby granted the software
    """,
    "bsd-2-clause": """
        #redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        #redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        #redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
        the views and conclusions contained in the software and documentation are those of the authors and should not be #interpreted as
    """,
    "bsd-3-clause": """
        nor the names of its #contributors may be used to endorse or promote products derived from this software
        nor the names of #contributors may be used to endorse or promote products derived from this software
        the name of the author may not be used to #endorse or promote products derived from this software
        neither the name of the university nor the names of its #contributors may be used
    """,
    "bsd-4-clause": """
        all advertising materials mentioning features or use of this software must display the following #acknowledgement
        all advertising materials mentioning features or use of this software must display the following #acknowledgment
        this product includes software developed by the university of california berkeley and its #contributors
    """,
    "apache": """
        licensed under the apache license version 2 0 the license you may not use this file except in #compliance with the license
        you may obtain a copy of the license at http www #apache org licenses license 2 0
        you may obtain a copy of the license at https www #apache org licenses license 2 0
        unless required by applicable law or agreed to in writing software distributed under the license is #distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language #governing permissions
        each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free #irrevocable copyright license
        each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free #irrevocable except as stated
        you must cause any modified files to carry #prominent notices stating that you changed the files
        if the work includes a notice text file as part of its distribution then any #derivative works that you distribute must include
        the end user documentation included with the redistribution if any must include the following #acknowledgment
        this product includes software developed by the apache software #foundation
        products derived from this software may not be called #apache nor may apache appear in their name
    """,
    "agpl": """
        if your software can interact with users remotely through a computer network you should also make sure that it #provides a way
        under the terms of the gnu #affero general public license as published by the free software foundation
        your modified version must prominently offer all users interacting with it #remotely through a computer network
        the gnu #affero general public license is a free copyleft license for software and other kinds of works
        you should have received a copy of the gnu #affero general public license along with this program
    """,
    "lgpl": """
        under the terms of the gnu #lesser general public license as published by the free software foundation
        under the terms of the gnu #library general public license as published by the free software foundation
        you should have received a copy of the gnu #lesser general public license along with this
        you should have received a copy of the gnu #library general public license along with this
        a program that contains no #derivative of any portion of the library but is designed to work with the library
        the precise terms and conditions for copying distribution and #modification follow pay close attention to the difference between
        this license incorporates the terms and conditions of version 3 of the gnu general public license #supplemented by
    """,
    "gfdl": """
        permission is granted to copy distribute and or modify this document under the terms of the gnu free #documentation license
        with no #invariant sections no front cover texts and no back cover texts
        a copy of the license is included in the section entitled gnu free #documentation license
        the purpose of this license is to make a manual #textbook or other functional and useful document free in the sense
        an #opaque copy of the document or a copy that is not transparent is called
    """,
    "gpl": """
        this program is free software you can redistribute it and or modify it under the terms of the #gnu general public license
        it under the terms of the #gnu general public license as published by the free software foundation
        this program is distributed in the hope that it will be useful but without any warranty without even the implied #warranty
        without even the implied warranty of #merchantability or fitness for a particular purpose see the gnu general public license
        you should have received a copy of the #gnu general public license along with this program
        the licenses for most software are designed to take away your #freedom to share and change it
        the licenses for most software and other practical works are designed to take away your #freedom to share and change
        the gnu general public license is a free #copyleft license for software and other kinds of works
        the gnu general public license is intended to #guarantee your freedom to share and change free software
        everyone is permitted to copy and distribute #verbatim copies of this license document but changing it is not allowed
        you may copy and distribute #verbatim copies of the program s source code as you receive it in any medium
        you may convey #verbatim copies of the program s source code as you receive it in any medium
        you may charge any price or no price for each copy that you #convey and you may offer support
        the #corresponding source for a work in object code form means all the source code needed to generate install
        to convey a work means any kind of #propagation that enables other parties to make or receive copies
        this program comes with absolutely no #warranty for details type show w
    """,
    "mpl": """
        this source code form is subject to the terms of the #mozilla public license v 2 0
        this source code form is subject to the terms of the #mozilla public license v
        if a copy of the mpl was not #distributed with this file you can obtain one at
        the contents of this file are subject to the #mozilla public license version
        this source code form is #incompatible with secondary licenses as defined by the mozilla public license
        covered software means source code form to which the initial contributor has #attached the notice in exhibit a
        either express or implied see the license for the specific language #governing rights and limitations
    """,
    "epl": """
        the accompanying program is provided under the terms of this #eclipse public license agreement
        this program and the accompanying materials are made available under the terms of the #eclipse public license
        any use reproduction or distribution of the program constitutes recipient s acceptance of this #agreement
    """,
    "cpl": """
        the accompanying program is #provided under the terms of this common public license agreement
    """,
    "cddl": """
        the contents of this file are subject to the terms of the common #development and distribution license
        you can obtain a copy of the license at usr src #opensolaris license
        when distributing covered code include this #cddl header in each file
    """,
    "eupl": """
        licensed under the #eupl version 1 1 or as soon they will be approved by the european commission
        licensed under the #eupl version 1 2 or as soon they will be approved by the european commission
        you may not use this work except in #compliance with the licence you may obtain a copy of the licence
    """,
    "bsl": """
        permission is hereby granted free of charge to any person or #organization obtaining a copy of the software and accompanying documentation
        must be included in all copies of the software in whole or in part and all #derivative works of the software unless such copies
        distributed under the #boost software license version 1 0
    """,
    "zlib": """
        permission is granted to anyone to use this software for any purpose including #commercial applications and to alter it
        the origin of this software must not be #misrepresented you must not claim that you wrote the original software
        altered source versions must be plainly marked as such and must not be #misrepresented as being the original software
        this notice may not be removed or altered from any source #distribution
        this software is provided as is without any express or implied warranty in no event will the authors be held #liable
    """,
    "artistic": """
        the intent of this document is to state the conditions under which a package may be copied such that the copyright holder #maintains some semblance
        you may make and give away #verbatim copies of the source form of the standard version of this package
        everyone is permitted to copy and distribute verbatim copies of this license document this license #establishes the terms
    """,
    "unlicense": """
        this is free and #unencumbered software released into the public domain
        anyone is free to copy modify publish use #compile sell or distribute this software either in source code form or
        in #jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
        for more information please refer to http #unlicense org
        for more information please refer to https #unlicense org
    """,
    "wtfpl": """
        do what the #fuck you want to public license
        you just do what the #fuck you want to
    """,
    "ms-pl": """
        this license governs use of the #accompanying software if you use the software you accept this license
    """,
    "psf": """
        #psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform
        this license agreement is between the python software #foundation psf and the individual or organization
        #beopen hereby grants licensee a non exclusive royalty free world wide license
    """,
    "postgresql": """
        permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written #agreement is hereby granted
    """,
    "openssl": """
        this product includes software developed by the #openssl project for use in the openssl toolkit
        this product includes #cryptographic software written by eric young
    """,
    "php": """
        the name php must not be used to endorse or promote products derived from this software without prior #written permission
        products derived from this software may not be called #php nor may php appear in their name
    """,
    "ofl": """
        this font software is licensed under the #sil open font license version 1 1
        the goals of the open font license ofl are to stimulate worldwide development of #collaborative font projects
        neither the font software nor any of its individual #components in original or modified versions may be sold by itself
        the #fonts and derivatives however cannot be released under any other type of license
    """,
    "odbl": """
        this database is made available under the open #database license
        any rights in individual contents of the database are licensed under the #database contents license
    """,
    "cc0": """
        to the extent possible under law the person who associated #cc0 with this work has waived all copyright
        the person who associated a work with this deed has #dedicated the work to the public domain
        has #waived all copyright and related or neighboring rights to this work
        affirmer hereby overtly fully permanently irrevocably and unconditionally waives #abandons and surrenders
    """,
    "cc-by-nc-nd": """
        creative commons attribution noncommercial #noderivatives
        #creativecommons org licenses by nc nd
    """,
    "cc-by-nc-sa": """
        creative commons attribution noncommercial #sharealike
        #creativecommons org licenses by nc sa
    """,
    "cc-by-nc": """
        you may not exercise any of the rights granted in any manner that is #primarily intended for or directed toward commercial advantage
        the licensed rights may be exercised for #noncommercial purposes only
        #creativecommons org licenses by nc
    """,
    "cc-by-nd": """
        you may not share #adapted material under this public license
        #creativecommons org licenses by nd
    """,
    "cc-by-sa": """
        you may distribute a derivative work only under the terms of this license or a later version of this license with the same license #elements
        the #adapter s license you apply must be a creative commons license with the same license elements
        this work is licensed under the creative commons attribution #sharealike
        #creativecommons org licenses by sa
    """,
    "cc-by": """
        this work is licensed under a #creative commons attribution 4 0 international license
        this work is licensed under a #creative commons attribution 3 0 unported license
        you must give #appropriate credit provide a link to the license and indicate if changes were made
        by exercising the licensed rights you accept and agree to be bound by the terms and conditions of this #creative commons attribution
        #creativecommons org licenses by
    """,
    "public-domain": """
        this file has been put into the public #domain
        this work has been released into the public #domain
        the author disclaims #copyright to this source code in place of a legal notice here is a blessing
        this software is in the public #domain
        #placed in the public domain
        #dedicated to the public domain
    """,
    "all-rights-reserved": """
        all rights #reserved
        no part of this publication may be #reproduced distributed or transmitted in any form or by any means
        no part of this book may be #reproduced in any form
        unauthorized copying of this file via any medium is strictly #prohibited
        proprietary and #confidential
    """,
}
#: The confidence of a detection by a signature.
SURE = 0.95
#: Words of names that make a better keyword than the last word.
RARE = {"cc", "creative", "bsd", "odc", "ms"}
#: Names of licences, as words, and their labels; the first rare word, or else the last word, is the keyword.
NAMES = {
    "lgpl": "gnu lesser general public license; gnu library general public license; lesser general public license; gnu lgpl; lgpl; lgplv2; lgplv3",
    "agpl": "gnu affero general public license; affero general public license; gnu agpl; agpl; agplv3",
    "gfdl": "gnu free documentation license; free documentation license; gfdl",
    "gpl": "gnu general public license; general public license; gnu public license; gnu gpl; gpl; gplv2; gplv3",
    "apache": "apache software license; apache license; apache public license; asl",
    "mit": "mit license; mit x11 license; expat license; mit expat license",
    "x11": "x11 license; x consortium license", "isc": "isc license; internet systems consortium license", "0bsd": "bsd zero clause; bsd 0 clause; zero clause bsd license; 0bsd",
    "bsd-2-clause": "bsd 2 clause; bsd two clause; 2 clause bsd license; two clause bsd license; simplified bsd license; freebsd license",
    "bsd-3-clause": "bsd 3 clause; bsd three clause; 3 clause bsd license; three clause bsd license; new bsd license; modified bsd license; revised bsd license",
    "bsd-4-clause": "bsd 4 clause; bsd four clause; original bsd license; old bsd license", "bsd": "bsd license; berkeley software distribution license; bsd style license",
    "mpl": "mozilla public license; mplv2", "epl": "eclipse public license", "cpl": "common public license", "edl": "eclipse distribution license",
    "eupl": "european union public license; eupl", "cddl": "common development and distribution license; cddl", "bsl": "boost software license",
    "afl": "academic free license", "osl": "open software license", "artistic": "artistic license; perl artistic license; clarified artistic license",
    "zlib": "zlib license; zlib libpng license; libpng license", "unlicense": "unlicense; the unlicense", "wtfpl": "wtfpl", "ncsa": "ncsa open source license; university of illinois open source license",
    "ms-pl": "microsoft public license; ms pl", "ms-rl": "microsoft reciprocal license; ms rl", "psf": "python software foundation license; python license; psf license",
    "postgresql": "postgresql license", "openssl": "openssl license; ssleay license", "php": "php license", "ruby": "ruby license", "vim": "vim license", "ijg": "independent jpeg group license", "w3c": "w3c software license; w3c license",
    "ofl": "sil open font license; open font license", "odbl": "open database license; odbl", "odc-by": "open data commons attribution license; odc by", "pddl": "public domain dedication and license; pddl",
    "cc0": "creative commons zero; cc0; cc zero", "cc-by-nc-nd": "cc by nc nd; creative commons attribution noncommercial noderivatives; creative commons attribution non commercial no derivatives",
    "cc-by-nc-sa": "cc by nc sa; creative commons attribution noncommercial sharealike; creative commons attribution non commercial share alike",
    "cc-by-nc": "cc by nc; creative commons attribution noncommercial; creative commons attribution non commercial", "cc-by-nd": "cc by nd; creative commons attribution noderivatives; creative commons attribution no derivatives",
    "cc-by-sa": "cc by sa; creative commons attribution sharealike; creative commons attribution share alike", "cc-by": "cc by; creative commons attribution", "public-domain": "public domain",
}
#: Ways of speaking of a licence, the surest first, with the confidence of a detection. {} is a name.
WAYS = [
    ("spdx license identifier {}(?: [0-9]+){{0,2}}(?: only| or later)?", 1.0),
    ("(?:licensed|released|distributed|published|available|licenced) under (?:the |a |an )?(?:terms of (?:the )?)?{}(?: (?:version |v )?[0-9]+(?: [0-9]+)?)?", 0.95),
    ("(?:under the terms of|in accordance with|subject to|governed by) (?:the )?{}", 0.9),
    ("{} (?:version |v )?[0-9]+(?: [0-9]+)?", 0.9),
    ("{}", 0.7),
]
#: Words before and after a keyword's place that a rule can reach.
BEFORE, AFTER = 26, 26
#: What stands between words, and what words are made of.
GAP, IN_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def signatures() -> dict[str, str]:
    """Phrases, # before the keyword, and their labels, in order."""
    out: dict[str, str] = {}
    for label, lines in SIGNATURES.items():
        for line in filter(None, map(str.strip, lines.splitlines())):
            out.setdefault(line, label)
    return out


def names() -> dict[str, str]:
    """Names in both spellings of license, # before the keyword, and their labels."""
    out: dict[str, str] = {}
    for label, some in NAMES.items():
        for known in some.split("; "):
            for spelt in (known, known.replace("license", "licence")):
                words = spelt.split(" ")
                rare = next((i for i, w in enumerate(words) if w in RARE), len(words) - 1)
                out.setdefault(" ".join([*words[:rare], "#" + words[rare], *words[rare + 1 :]]), label)
    return out


def rules() -> list[dict]:
    """priority, phrase (the keyword marked), way, label and confidence of every rule."""
    some = [(phrase, "{}", label, SURE) for phrase, label in signatures().items()]
    some += [(known, way, label, confidence) for way, confidence in WAYS for known, label in names().items()]
    return [{"priority": i, "phrase": p, "way": w, "label": l, "confidence": c} for i, (p, w, l, c) in enumerate(some)]


def keywords() -> list[str]:
    return sorted({phrase.split("#")[1].split(" ")[0] for phrase in [*signatures(), *names()]})


def _either(phrases) -> str:
    """The longest first, so that it wins among those that begin at one place."""
    return "(" + "|".join(sorted(phrases, key=lambda p: (-len(p), p))) + ")"


def _matchers() -> list[tuple[str, dict[str, str], int, float]]:
    """Pattern over a window, labels by the phrase that its group holds, priority and confidence."""
    out = [("(?<= )" + _either(signatures()) + "(?= )", signatures(), 0, SURE)]
    for i, (way, confidence) in enumerate(WAYS, 1):
        out.append(("(?<= )" + way.format(_either(names())) + "(?= )", names(), i, confidence))
    return out


def count_words(text: Column) -> Column:
    """Every word with what stands around it becomes one letter, so the length is the number of words."""
    return F.when(text.rlike(IN_WORD), F.length(F.regexp_replace(text, f"{GAP}*{IN_WORD}+{GAP}*", "w"))).otherwise(0).cast("long")


def _any_word(some: set[str]) -> str:
    """Pattern for any of these words, whole and in either case, told apart by their first letters."""
    first: dict[str, list[str]] = {}
    for w in sorted(some):
        first.setdefault(w[0], []).append(w[1:])
    return f"(?i)(?<!{IN_WORD})(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items()) + f")(?!{IN_WORD})"


def _words(text: Column) -> Column:
    """The text's words in ASCII lower case, one space before, between and behind them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP + "+", " ")), F.lit(" "))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row and column of docs in `row`, with n_words, base_places (word and label of each place of a base
    phrase), base_labels, labels and score."""
    known = keywords()
    body = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
    # a word of a rule or of a base phrase
    gate = body.rlike(_any_word({*known, "cc", "license", "gnu", "apache", "mit"}))
    found = docs.select(F.struct(*[F.col(name(c)) for c in docs.columns]).alias("row")).select(
        "row", count_words(body).alias("n_words"), F.when(gate, F.split(F.trim(_words(body)), " ")).alias("words")
    )
    words = F.col("words")
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*known), i)), lambda i: i.isNotNull())
    base = F.flatten(F.array(*[_places(phrase, label) for phrase, label in BASE]))

    def window(i: Column) -> Column:
        start = F.greatest(i - BEFORE, F.lit(0))
        return F.struct(
            i.alias("at"),
            F.concat(
                F.lit(" "), F.array_join(F.slice(words, start + 1, i - start), " "), F.when(i > start, F.lit(" ")).otherwise(F.lit("")),
                F.lit("#"), F.array_join(F.slice(words, i + 1, F.lit(AFTER + 1)), " "), F.lit(" "),
            ).alias("window"),
        )

    def tried(x: Column) -> Column:
        """Detections of the rules at the window's keyword."""
        out = []
        for pattern, labels, priority, confidence in _matchers():
            table = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
            hit = F.regexp_extract(x["window"], pattern, 0)
            # the words of a match up to its keyword, and all of them
            start = x["at"] - _spaces(F.substring_index(hit, "#", 1))
            out.append(
                F.when(
                    hit != "",
                    F.struct(
                        start.alias("start"), (-(start + _spaces(hit) + 1)).alias("back"), F.lit(priority).alias("priority"),
                        F.try_element_at(table, F.regexp_extract(x["window"], pattern, 1)).alias("label"), F.lit(confidence).alias("confidence"),
                    ),
                )
            )
        return F.array(*out)

    detections = F.filter(F.flatten(F.transform(F.transform("places", window), tried)), lambda d: d.isNotNull())
    ranked = F.array_sort("detections")
    # sorted so, a detection is contained in an earlier one just when it ends no later than the farthest end yet
    left = F.aggregate(
        ranked,
        F.expr("named_struct('reach', -1, 'labels', cast(array() as array<string>), 'score', 0.0D)"),
        lambda s, d: F.when(-d["back"] <= s["reach"], s).otherwise(
            F.struct((-d["back"]).alias("reach"), F.array_union(s["labels"], F.array(d["label"])).alias("labels"), F.greatest(s["score"], d["confidence"]).alias("score"))
        ),
    )
    return (
        found.select("*", F.coalesce(places, F.expr("cast(array() as array<int>)")).alias("places"), F.coalesce(F.array_sort(base), F.expr("cast(array() as array<struct<word:int,label:string>>)")).alias("base_places"))
        .select("row", "n_words", "base_places", detections.alias("detections"))
        .select("row", "n_words", "base_places", left.alias("left"))
        .select(
            "row", "n_words", "base_places",
            F.array_sort(F.array_distinct(F.transform("base_places", lambda p: p["label"]))).alias("base_labels"),
            F.array_sort(F.array_union(F.transform("base_places", lambda p: p["label"]), F.col("left.labels"))).alias("labels"),
            F.when(F.size("base_places") > 0, F.lit(1.0)).otherwise(F.col("left.score")).alias("score"),
        )
    )


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " ", ""))


def _places(phrase: str, label: str) -> Column:
    """word and label of every place where the phrase's words stand consecutively."""
    parts, words = phrase.split(" "), F.col("words")

    def at(w: Column, i: Column) -> Column:
        same = w == parts[0]
        for k, p in enumerate(parts[1:], 1):
            same = same & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(same, F.struct(i.alias("word"), F.lit(label).alias("label")))

    return F.filter(F.transform(words, at), lambda x: x.isNotNull())
