"""Licence recognition by sentences: known sentences become identifiers, ordered rules match their sequence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences (lower case, letters and digits, single spaces).
REFERENCE_VERBS = ["licensed under", "released under", "distributed under", "available under"]
SUBJECTS = ["this work", "this project", "this file", "this software", "this program", "this code", "this library", "this package"]
REFERENCES = {
    "apache2_ref": ["the apache license version 2 0", "apache license 2 0"],
    "mit_ref": ["the mit license", "mit license"],
    "gpl3_ref": ["the gnu general public license version 3", "the gnu gpl version 3", "gpl v3"],
    "gpl2_ref": ["the gnu general public license version 2", "the gnu gpl version 2", "gpl v2"],
    "lgpl3_ref": ["the gnu lesser general public license version 3"],
    "mpl2_ref": ["the mozilla public license version 2 0"],
    "bsd3_ref": ["the 3 clause bsd license", "the bsd 3 clause license"],
    "bsd2_ref": ["the 2 clause bsd license", "the bsd 2 clause license"],
    "isc_ref": ["the isc license"],
    "cc_by_ref": ["cc by 4 0", "the creative commons attribution 4 0 international license"],
    "cc_by_sa_ref": ["cc by sa 4 0"],
    "cc_by_nc_ref": ["cc by nc 4 0"],
    "cc0_ref": ["cc0 1 0"],
}
GRANT = "you can redistribute it and or modify it under the terms of the"
FSF = "as published by the free software foundation"
LATER = "of the license or at your option any later version"
SENTENCES = {
    "apache2_comply": ["you may not use this file except in compliance with the license"],
    # The address mostly stands apart, below a blank line.
    "apache2_copy": [
        "you may obtain a copy of the license at",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may obtain a copy of the license at https www apache org licenses license 2 0",
    ],
    "apache2_asis": [
        "unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "apache2_see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit_grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation"
        " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and"
        " to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit_notice": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of the software"
    ],
    "mit_asis": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to"
        " the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "isc_grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "bsd_intro": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met"
    ],
    "bsd_source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer"
    ],
    "bsd_binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "bsd_names": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission"
    ],
    # "This program is free software" ends at ":" or ";" in the published headers; so does the grant at ";".
    "gpl_grant": [f"{free}{GRANT} gnu general public license {FSF}" for free in ("", "this program is free software ")],
    "gpl_or_later": [f"either version 3 {LATER}"],
    "gpl2_or_later": [f"either version 2 {LATER}"],
    "gpl3_whole": [f"{GRANT} gnu general public license {FSF} either version 3 {LATER}"],
    "gpl2_whole": [f"{GRANT} gnu general public license {FSF} either version 2 {LATER}"],
    "gpl2_only": [f"{GRANT} gnu general public license version 2 {FSF}", f"{GRANT} gnu general public license {FSF} version 2"],
    "lgpl_grant": [f"{GRANT} gnu lesser general public license {FSF}"],
    "lgpl21_or_later": [f"either version 2 1 {LATER}"],
    "lgpl3_whole": [f"{GRANT} gnu lesser general public license {FSF} either version 3 {LATER}"],
    "lgpl21_whole": [f"{GRANT} gnu lesser general public license {FSF} either version 2 1 {LATER}"],
    "mpl2_form": ["this source code form is subject to the terms of the mozilla public license v"],
    "spdx": ["spdx license identifier"],
}
# SPDX identifiers, a sentence of their own behind "SPDX-License-Identifier:".
SPDX = {
    "Apache-2.0": [""], "MIT": [""], "ISC": [""], "BSD-3-Clause": [""], "BSD-2-Clause": [""], "MPL-2.0": [""],
    "GPL-3.0": ["", "-only"], "GPL-3.0-or-later": [""], "GPL-2.0": ["", "-only"], "GPL-2.0-or-later": [""],
    "LGPL-3.0": ["", "-only"], "LGPL-3.0-or-later": [""], "LGPL-2.1-or-later": [""],
    "CC-BY-4.0": [""], "CC-BY-SA-4.0": [""], "CC-BY-NC-4.0": [""], "CC0-1.0": [""],
}
# Ordered rules: the first that fits takes its sentences, so longer sequences stand before their parts.
RULES = [
    ("Apache-2.0", ["apache2_ref", "apache2_comply", "apache2_copy", "apache2_asis", "apache2_see"]),
    ("Apache-2.0", ["apache2_ref", "apache2_comply", "apache2_copy"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_asis"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("ISC", ["isc_grant"]),
    ("BSD-3-Clause", ["bsd_intro", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_intro", "bsd_source", "bsd_binary"]),
    ("GPL-3.0-or-later", ["gpl_grant", "gpl_or_later"]),
    ("GPL-2.0-or-later", ["gpl_grant", "gpl2_or_later"]),
    ("LGPL-3.0-or-later", ["lgpl_grant", "gpl_or_later"]),
    ("LGPL-2.1-or-later", ["lgpl_grant", "lgpl21_or_later"]),
    ("GPL-3.0-or-later", ["gpl3_whole"]),
    ("GPL-2.0-or-later", ["gpl2_whole"]),
    ("LGPL-3.0-or-later", ["lgpl3_whole"]),
    ("LGPL-2.1-or-later", ["lgpl21_whole"]),
    ("GPL-2.0", ["gpl2_only"]),
    ("MPL-2.0", ["mpl2_form"]),
    *[(name, ["spdx", f"spdx_{name}"]) for name in SPDX],
    ("Apache-2.0", ["apache2_ref"]),
    ("MIT", ["mit_ref"]),
    ("GPL-3.0", ["gpl3_ref"]),
    ("GPL-2.0", ["gpl2_ref"]),
    ("LGPL-3.0", ["lgpl3_ref"]),
    ("MPL-2.0", ["mpl2_ref"]),
    ("BSD-3-Clause", ["bsd3_ref"]),
    ("BSD-2-Clause", ["bsd2_ref"]),
    ("ISC", ["isc_ref"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_ref"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_ref"]),
    ("CC-BY-4.0", ["cc_by_ref"]),
    ("CC0-1.0", ["cc0_ref"]),
]
# A wrapped sentence goes on in lower case, or in a word that licences write in capitals and that starts no sentence,
# perhaps behind a comment mark; sentences end at line ends and stops.
CAPITALS = (
    "IS|BASIS|WITHOUT|WARRANTY|WARRANTIES|OR|CONDITIONS|OF|ANY|KIND|EXPRESS|IMPLIED|INCLUDING|BUT|NOT|LIMITED|TO|AND|FITNESS|FOR"
    "|PARTICULAR|PURPOSE|MERCHANTABILITY|NONINFRINGEMENT|PROVIDED|SOFTWARE|GNU|License|Version|General|Lesser|Public|Free"
    "|Software|Foundation|Commons|Attribution|International|Apache|Mozilla"
)
MARKS = r"[ \t*#/%;-]*"
# Nothing is joined to an SPDX line: its line end is kept in the first group.  The \b only parts what is no plain text.
WRAPPED = (
    rf"(SPDX-License-Identifier:[^\n]*\n{MARKS}|[^.!?:;\s])(?:[ \t]*\n{MARKS}|\b)"
    rf"([a-z]|\(at your option|\(the .?(?:License|Software)|.?AS IS|(?:{CAPITALS})\b|[0-9]+\.[0-9]|[0-9]+ of\b)"
)
SENTENCE_END = r"[.!?;:]*[ \t]*\n\s*|[.!?;:]+[ \t]+"
NOT_PLAIN = r"[^a-z0-9]+"


def sentence_table() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    verbs = REFERENCE_VERBS + [f"{s} is {verb}" for s in SUBJECTS for verb in REFERENCE_VERBS]
    known = {f"{verb} {name}": key for key, names in REFERENCES.items() for name in names for verb in verbs}
    known |= {f"{text} the license": key for text, key in known.items() if key == "apache2_ref"}
    bare = {f"{name}{end}": f"spdx_{name}" for name, ends in SPDX.items() for end in ends}
    known |= {re.sub(NOT_PLAIN, " ", text.lower()).strip(): key for text, key in bare.items()}
    return known | {text: key for key, texts in SENTENCES.items() for text in texts}


def sentences(text: Column) -> Column:
    """array<string> of normalised sentences of the whole text."""
    joined = F.regexp_replace(text, WRAPPED, "$1 $2")
    return F.transform(F.split(joined, SENTENCE_END), lambda s: F.trim(F.regexp_replace(F.lower(s), NOT_PLAIN, " ")))


def matched_rules(sequence: Column) -> tuple[Column, Column]:
    """(array of licence names in rule order, what is left of the sequence).

    The sequence is text, one "<identifier>" after another; each rule replaces its matches by "<>", so what one
    rule took no later rule sees, and what stood on either side does not become adjacent.
    """
    names, left = [], sequence
    for name, ids in RULES:
        pattern = "".join(f"<{i}>" for i in ids)
        names.append(F.when(F.contains(left, F.lit(pattern)), F.lit(name)))
        left = F.replace(left, F.lit(pattern), F.lit("<>"))
    return F.array_compact(F.array(*names)), left


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_sentences, `sequence`, `licenses` (sorted, distinct), `unmatched`.

    `sequence` lists the identifiers of known sentences in text order, `unmatched` counts those no rule took.
    Sentences that are not known neither break nor join a sequence.  A null or empty text has no sentence and
    no licence.  Each document is scanned where it is read: nothing is shuffled.
    """
    known = F.create_map(*[F.lit(x) for pair in sentence_table().items() for x in pair])
    parts = F.filter(sentences(F.coalesce(F.col(text_col), F.lit(""))), lambda s: s != "")
    rows = docs.select(F.col(id_col), parts.alias("__s"))
    found = F.array_compact(F.transform("__s", lambda s: F.element_at(known, s)))
    rows = rows.select(id_col, F.size("__s").alias("n_sentences"), found.alias("__ids"))
    rows = rows.withColumn(
        "sequence", F.array_join(F.transform("__ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    )
    names, left = matched_rules(F.col("sequence"))
    bare = F.regexp_replace(left, "<>", "")
    return rows.select(
        id_col,
        "n_sentences",
        "sequence",
        F.array_join(F.array_sort(F.array_distinct(names)), "|").alias("licenses"),
        (F.length(bare) - F.length(F.replace(bare, F.lit("<"), F.lit("")))).alias("unmatched"),
    )
