"""Operator 7: license scans by sentence-rule recognition, DataFrame functions only.

A text is split into sentences; normalised sentences that are known are mapped
to identifiers; a rule is an ordered sequence of identifiers and holds where
they occur in that order.  Rules are tried in the order listed, full texts
before references; a rule whose identifiers are all among those of an earlier
rule that holds is part of it and is not reported (BSD-2-Clause in BSD-3-Clause).  One scan, no shuffle; the tables of sentences and rules are
fixed and small, and travel inside the plan.

A known sentence begins and ends at a line end or a sentence end.  Inside it any
space may be one line end with a comment leader (signs, ``dnl`` or ``rem``), so
wrapped texts and source headers are read; a blank line ends every sentence.
Where it holds sentence ends itself (``v. 2.0``), the text must hold them too.
``n_sentences`` counts stretches between line ends and sentence ends.

Defined cases: a null or empty text has no sentences, identifiers or licenses;
rows are independent, so repeated rows, null ids and other columns change
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


#: Fixed texts: identifier -> licence sentence, as the licences have them.
SENTENCES = {
    "mit-ref": "Released under the MIT License.",
    "mit-ref2": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache2-ref": "Licensed under the Apache License, Version 2.0.",
    "apache2-grant": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache2-comply": "you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "bsd-redist": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-ref": "Licensed under the BSD 3-Clause License.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "Released under CC0 1.0.",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "mit-project": "This project is licensed under the MIT License.",
    "apache2-project": "This project is licensed under the Apache License 2.0.",
    "apache2-short": "Licensed under the Apache License 2.0.",
    "gpl3-short": "Licensed under the GNU GPL v3.",
    "gpl3-long": "Licensed under the GNU General Public License v3.0.",
    "gpl2-short": "Licensed under the GNU GPL v2.",
    "lgpl-short": "Licensed under the GNU LGPL v3.",
    "agpl3-short": "Licensed under the GNU AGPL v3.",
    "bsd2-ref": "Licensed under the BSD 2-Clause License.",
    "isc-ref": "Licensed under the ISC License.",
    "mpl2-ref": "Licensed under the Mozilla Public License 2.0.",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4": "Licensed under CC BY-NC-ND 4.0.",
    "all-rights": "All rights reserved.",
}
#: Licences that a source header may name by its identifier.
TAGGED = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0")
SENTENCES |= {f"tag-{normalised(name).replace(' ', '-')}": f"SPDX-License-Identifier: {name}" for name in TAGGED}
#: Ordered rules: (licence, identifiers in order).
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("Apache-2.0", ("apache2-grant", "apache2-comply", "apache2-copy")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("BSD-3-Clause", ("bsd-redist", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redist",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope")),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("MIT-reference", ("mit-ref",)),
    ("MIT-reference", ("mit-project",)),
    ("Apache-2.0-reference", ("apache2-project",)),
    ("Apache-2.0-reference", ("apache2-short",)),
    ("GPL-3.0-reference", ("gpl3-short",)),
    ("GPL-3.0-reference", ("gpl3-long",)),
    ("GPL-2.0-reference", ("gpl2-short",)),
    ("LGPL-3.0-reference", ("lgpl-short",)),
    ("AGPL-3.0-reference", ("agpl3-short",)),
    ("BSD-2-Clause-reference", ("bsd2-ref",)),
    ("ISC-reference", ("isc-ref",)),
    ("MPL-2.0-reference", ("mpl2-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("MIT-reference", ("mit-ref2",)),
    ("Apache-2.0-reference", ("apache2-ref",)),
    ("GPL-3.0-reference", ("gpl3-ref",)),
    ("BSD-3-Clause-reference", ("bsd-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl2",)),
    ("All-rights-reserved", ("all-rights",)),
    *((f"{name}-reference", (f"tag-{normalised(name).replace(' ', '-')}",)) for name in TAGGED),
)
_BREAK = r"([.!?:;])[\x20\x09-\x0D]+"
_LEADER = r"(?:(?:dnl|rem) )?"
_WRAP = rf" ?(?:\n ?{_LEADER})?"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text; they end at line ends and at ``.!?:;`` before white space."""
    lines = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _BREAK, "$1\n")
    parts = F.split(F.regexp_replace(lines, r"[^a-z0-9\n]+", " "), "\n")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def _parted(sentence: str) -> str:
    """A known sentence, normalised between the sentence ends inside it, which are ``S``."""
    return "S".join(filter(None, map(normalised, re.sub(_BREAK, r"\1\n", sentence).split("\n"))))


def _expression(known: dict[str, str]) -> str:
    """Known sentences in ``_marked`` texts, the longest first."""
    texts = sorted({_parted(s) for s in known.values()}, key=lambda s: (-len(s), s))
    within = lambda s: s.replace(" ", _WRAP).replace("S", rf"[ \n]*S[ \nS]*{_LEADER}")
    return rf"[S\n] ?{_LEADER}({'|'.join(within(s) for s in texts)})(?= ?[S\n])"


def _marked(text: Column) -> Column:
    """The words of a text, parted by spaces, line ends and ``S`` at sentence ends."""
    ends = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _BREAK, "S")
    return F.concat(F.lit("\n"), F.regexp_replace(ends, r"[^a-z0-9S\n]+", " "), F.lit("\n"))


def _in_order(ids: tuple[str, ...]) -> str:
    """Matches ``,id,id,...,`` lines that hold the identifiers in order."""
    return ",(?:.*,)?".join(f"{i}" for i in ids).join((",", ","))


def wider(rules, i: int) -> list[int]:
    """Earlier rules that a rule is a proper part of."""
    return [j for j in range(i) if set(rules[i][1]) < set(rules[j][1])]


def scan_licenses(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", known: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """One row per document: doc_id, n_sentences, sentence_ids (array), licenses (array)."""
    table = F.create_map(*[F.lit(x) for name, sentence in known.items() for x in (normalised(sentence), name)])
    text = F.col(text_column).cast("string")
    hits = F.regexp_extract_all(_marked(text), F.lit(_expression(known)), F.lit(1))
    found = docs.select(F.col(id_column).alias("doc_id"), F.size(sentences(text)).cast("long").alias("n_sentences"), hits.alias("hits"))
    plain = lambda x: F.regexp_replace(x, rf"[ \nS]+{_LEADER}", " ")
    found = found.select("doc_id", "n_sentences", F.transform("hits", lambda x: F.element_at(table, plain(x))).alias("sentence_ids"))
    line = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    holds = [line.rlike(pattern) for pattern in map(_in_order, (ids for _, ids in rules))]
    held = []
    for i, (name, _) in enumerate(rules):
        whole = [~holds[j] for j in wider(rules, i)]
        held.append(F.when(reduce(and_, [holds[i], *whole]), F.lit(name)))
    return found.select("doc_id", "n_sentences", "sentence_ids", F.array_distinct(F.array_compact(F.array(*held))).alias("licenses"))


def license_sql() -> str:
    """The query in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {quote(normalised(s))} THEN {quote(n)}" for n, s in SENTENCES.items())
    matches = [f"regexp_matches(line, {quote(_in_order(ids))})" for _, ids in RULES]
    held = ", ".join(f"CASE WHEN {' AND '.join([matches[i], *(f'NOT {matches[j]}' for j in wider(RULES, i))])} THEN {quote(name)} END" for i, (name, _) in enumerate(RULES))
    return rf"""
WITH parts AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '([.!?:;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s
  FROM documents),
ids AS (
  SELECT doc_id, len(s) AS n_sentences, list_filter(list_transform(s, lambda x: CASE x {cases} END), lambda x: x IS NOT NULL) AS i FROM parts),
lines AS (
  SELECT doc_id, n_sentences, coalesce(array_to_string(i, ','), '') AS sentence_ids, ',' || coalesce(array_to_string(i, ','), '') || ',' AS line FROM ids),
held AS (
  SELECT doc_id, n_sentences, sentence_ids, list_filter([{held}], lambda x: x IS NOT NULL) AS h FROM lines)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, sentence_ids,
       coalesce(array_to_string(list_filter(h, lambda x, k: list_position(h, x) = k), ','), '') AS licenses
FROM held"""
