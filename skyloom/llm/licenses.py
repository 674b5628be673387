"""Licence scans by sentence rules, with DataFrame functions only.

Texts are cut into sentences, the sentences are normalised and looked up among known licence
sentences, and the identifiers that are found, in their order, are matched against ordered
rules: a licence is found if all identifiers of one of its rules occur in that order.
Everything happens within a row; nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, as they are written once normalised.
SENTENCES = {
    "mit-name": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-title-abbr": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2-name": "licensed under the apache license version 2 0",
    "apache2-released": "released under the apache license version 2 0",
    "apache2-the": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-law": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-name": "this work is licensed under the gnu general public license version 3",
    "gpl3-licensed": "licensed under the gnu general public license version 3",
    "gpl2-name": "this work is licensed under the gnu general public license version 2",
    "gpl2-licensed": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software",
    "gpl3-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "cc-by-nc4": "licensed under cc by nc 4 0",
    "cc-by-nc4-work": "this work is licensed under cc by nc 4 0",
    "cc-by4": "licensed under cc by 4 0",
    "cc-by4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa4": "licensed under cc by sa 4 0",
    "cc-by-sa4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0": "licensed under cc0 1 0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache2": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
    "spdx-gpl3-only": "spdx license identifier gpl 3 0 only",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-bsd2": "spdx license identifier bsd 2 clause",
}
#: Ordered rules of each licence.
RULES = {
    "Apache-2.0": [["apache2-name"], ["apache2-released"], ["apache2-the"], ["apache2-comply", "apache2-copy", "apache2-law"], ["spdx-apache2"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"], ["spdx-bsd2"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"], ["spdx-bsd3"]],
    "CC-BY-4.0": [["cc-by4"], ["cc-by4-work"]],
    "CC-BY-NC-4.0": [["cc-by-nc4"], ["cc-by-nc4-work"]],
    "CC-BY-SA-4.0": [["cc-by-sa4"], ["cc-by-sa4-work"]],
    "CC0-1.0": [["cc0"]],
    "GPL-2.0": [["gpl2-name"], ["gpl2-licensed"], ["gpl-free", "gpl2-later", "gpl-hope"]],
    "GPL-3.0": [["gpl3-name"], ["gpl3-licensed"], ["gpl-free", "gpl3-later", "gpl-hope"], ["spdx-gpl3"], ["spdx-gpl3-only"]],
    "ISC": [["isc-grant"]],
    "MIT": [["mit-name"], ["mit-licensed"], ["mit-title"], ["mit-title-short"], ["mit-title-abbr"], ["mit-grant", "mit-notice", "mit-warranty"], ["spdx-mit"]],
    "Unlicense": [["unlicense-free"]],
}
#: Licences whose finding says that another, whose rule they contain, was not meant.
COVERS = {"BSD-2-Clause": "BSD-3-Clause"}
#: Ends of sentences; the second also where lines are not sentences but wrap.
ENDS = (r"[.;:!?][.;:!?]*[ \t\r\n]+|[\r\n]+", r"[.;:!?][.;:!?]*[ \t\r\n]+")

#: Ends of the third reading, in which lines wrap, but blank ones and notices of copyright end what stands before them.
WRAPPED = r"[.;:!?][.;:!?]*[ \t\r\n]+|\n(?:[^A-Za-z0-9\n]*\n)+|(?i:copyright)[ \t]*(?:\((?i:c)\)|\x{A9}|[0-9]{4})[^\n]*(?:\n|$)"
#: Sentences and rules of the third reading besides the others: GPL notices with a semicolon within their first sentence.
MORE_SENTENCES = {
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2-either": "either version 2 of the license or at your option any later version",
    "gpl3-either": "either version 3 of the license or at your option any later version",
}
MORE_RULES = {f"GPL-{n}.0": ["gpl-free", "gpl-terms", f"gpl{n}-either", "gpl-hope"] for n in (2, 3)}
#: How a sentence names its licence, once normalised, and the names.
NAMING = r"(?:(?:this|the) [a-z]+(?: [a-z]+)? (?:is|are) )?(?:licensed|released|distributed|(?:made )?available) under (?:the )?(?:terms of (?:the )?)?"
NAMES = {
    "Apache-2.0": "apache (?:software )?(?:license )?(?:version )?v?2(?: 0)?(?: license)?",
    "BSD-2-Clause": "bsd 2 clause(?: simplified)?(?: license)?|2 clause bsd(?: license)?",
    "BSD-3-Clause": "bsd 3 clause(?: new| revised)*(?: license)?|3 clause bsd(?: license)?",
    "CC-BY-4.0": "(?:creative commons attribution|cc by) 4 0(?: international)?(?: license)?",
    "CC-BY-NC-4.0": "(?:creative commons attribution non ?commercial|cc by nc) 4 0(?: international)?(?: license)?",
    "CC-BY-SA-4.0": "(?:creative commons attribution share ?alike|cc by sa) 4 0(?: international)?(?: license)?",
    "CC0-1.0": "(?:creative commons )?cc0 1 0(?: universal)?(?: license)?",
    "GPL-2.0": "(?:gnu )?(?:general public license|gpl)(?: version)? v?2(?: 0)?(?: license)?(?: only| or later)?",
    "GPL-3.0": "(?:gnu )?(?:general public license|gpl)(?: version)? v?3(?: 0)?(?: license)?(?: only| or later)?",
    "ISC": "isc(?: license)?",
    "MIT": "(?:expat )?mit(?: license)?",
    "Unlicense": "unlicense(?: license)?",
}
AFTER = "(?: see .*)?"
#: Fixed value: a BSD-2-Clause match that no BSD-3-Clause match goes on from, among the identifiers of a text.
_NO_BSD3 = "(?:(?! bsd-(?:grant|names) ).)*"
OWN_BSD2 = f" bsd-grant {_NO_BSD3} bsd-source {_NO_BSD3} bsd-binary {_NO_BSD3}(?: bsd-grant |$)| spdx-bsd2 "


def normalised(sentence: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(sentence, "[^A-Za-z0-9]+", " ")))


def sentences(text: Column, ends: str) -> Column:
    return F.transform(F.split(text, ends), normalised)


def sentence_ids(read: Column, known: dict[str, str]) -> Column:
    """Identifiers of the known ones among normalised sentences, in order."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable((s, k) for k, s in known.items())])
    return F.transform(F.filter(read, lambda s: s.isin(*known.values())), lambda s: F.element_at(names, s))


def matches(ids: Column, rule: list[str]) -> Column:
    """Whether the identifiers of the rule occur in this order in ``ids``, a string of them, each between spaces."""
    return ids.rlike(" " + " (?:.* )?".join(rule) + " ")


def find_licences(df: DataFrame) -> DataFrame:
    """doc_id, n_known, sentence_ids and licences (comma-joined, by name) of every row of ``df`` (doc_id, text).

    Sentences end at a stop with white space after it, or at a line's end. A second reading
    takes line ends for white space, for texts whose sentences wrap; a third does so too, but ends
    sentences at blank lines and notices of copyright. A licence counts if one reading matches
    one of its rules, or if a sentence of the first or third says that something is under it.
    BSD-2-Clause counts beside BSD-3-Clause only with a match of its own. sentence_ids and n_known
    are of the first reading. A null or empty text has none; repeated rows are scanned one by
    one; texts of any length are scanned whole.
    """
    text = F.coalesce("text", F.lit(""))
    cut = df.select("doc_id", *[sentences(text, e).alias(f"read{k}") for k, e in enumerate([*ENDS, WRAPPED])])
    naming = F.concat(*[F.filter(F.col(f"read{k}"), lambda s: s.rlike(f"^{NAMING}")) for k in (0, 2)])
    read = cut.select("doc_id", *[sentence_ids(F.col(f"read{k}"), SENTENCES if k < 2 else SENTENCES | MORE_SENTENCES).alias(f"ids{k}") for k in range(3)], F.array_join(naming, "\n").alias("naming"))
    seq = read.select("doc_id", "naming", F.size("ids0").cast("long").alias("n_known"), F.array_join("ids0", ",").alias("sentence_ids"),
                      *[F.concat(F.lit(" "), F.array_join(f"ids{k}", "  "), F.lit(" ")).alias(f"seq{k}") for k in range(3)])
    named = {name: F.col("naming").rlike(f"(?m)^{NAMING}(?:{form}){AFTER}$") for name, form in NAMES.items()}
    hit = {
        name: reduce(Column.__or__, [matches(F.col(f"seq{k}"), r) for r in rules for k in range(3)]) | named[name] for name, rules in RULES.items()
    }
    hit |= {name: hit[name] | matches(F.col("seq2"), rule) for name, rule in MORE_RULES.items()}
    own = reduce(Column.__or__, [F.col(f"seq{k}").rlike(OWN_BSD2) for k in range(3)]) | named["BSD-2-Clause"]
    shown = [F.when(h & (~hit[COVERS[n]] | own) if n in COVERS else h, F.lit(n)) for n, h in sorted(hit.items())]
    nothing = reduce(Column.__and__, [F.col(f"seq{k}") == "  " for k in range(3)]) & (F.col("naming") == "")
    found = F.when(nothing, F.lit("")).otherwise(F.concat_ws(",", *shown))
    return seq.select("doc_id", "n_known", "sentence_ids", found.alias("licences"))
