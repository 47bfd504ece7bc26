"""Licence scan by sentence rules, in DataFrame functions only.

A known licence sentence is found where its words follow each other in the text, from the start of a sentence,
clause or line to the end of one: it may be wrapped over lines and hold ';' or ':', but not a full stop. Each
gives its identifier, and the identifiers in text order are matched against licence rules. A rule is a
list of identifiers that must occur in this order (others may stand between); the first rule that fits
gives the licence. Nothing is shuffled: the table of sentences and the rules are a few literals.

Null and empty texts have no hits and a null licence. Repeated rows are scanned each by itself. Extra
columns are ignored, so names cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, table

#: Identifier and normalised sentence (a-z and 0-9, single spaces between).
SENTENCES = (
    ("A", "licensed under the apache license version 2 0"),
    ("B", "you may not use this file except in compliance with the license"),
    ("C", "distributed on an as is basis without warranties or conditions of any kind"),
    ("G", "this work is licensed under the gnu general public license version 3"),
    ("H", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3"),
    ("L", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("M", "released under the mit license"),
    ("P", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("Q", "the above copyright notice and this permission notice shall be included in all copies"),
    ("N", "licensed under cc by nc 4 0"),
    ("Y", "licensed under cc by 4 0"),
    ("Z", "licensed under cc by sa 4 0"),
    ("D", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("E", "neither the name of the copyright holder nor the names of its contributors may be used to endorse products"),
    ("V", "the software is provided as is without warranty of any kind"),
    ("R", "all rights reserved"),
)
_GNU = "is free software you can redistribute it and or modify it under the terms of the gnu"
_FSF = "as published by the free software foundation"
_LATER = "of the license or at your option any later version"
#: Identifiers and kinds of the Creative Commons licences, versions 4.0 and 3.0.
CC4 = (("Y", ""), ("N", " noncommercial"), ("Z", " sharealike"), ("K", " noderivatives"), ("O", " noncommercial sharealike"), ("T", " noncommercial noderivatives"))
CC3 = (("S", ""), ("U", " noncommercial"), ("W", " sharealike"), ("X", " noderivs"), ("I", " noncommercial sharealike"), ("J", " noncommercial noderivs"))
#: The same identifiers' sentences in the full wording of the standard licence texts and notices. ORACLE knows
#: SENTENCES alone, which is all that the given tables hold.
FULL = (
    ("A", "licensed under the apache license version 2 0 the license"),
    ("C", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    *(("H", f"this program {_GNU} general public license {end}") for end in (
        f"{_FSF} either version 3 {_LATER}", f"{_FSF} either version 3 of the license", f"{_FSF} version 3", f"{_FSF} version 3 of the license", f"version 3 {_FSF}")),
    *(("L", f"this library {_GNU} lesser general public license {end}") for v in ("2 1", "3") for end in (
        f"{_FSF} either version {v} {_LATER}", f"{_FSF} either version {v} of the license", f"{_FSF} version {v}", f"{_FSF} version {v} of the license", f"version {v} {_FSF}")),
    ("P", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("Q", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("Q", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("V", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    *(("M", f"{start} the {terms}mit license") for start in ("licensed under", "this project is licensed under", "this software is released under") for terms in ("", "terms of the ")),
    ("D", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("E", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    *((key, f"this work is licensed under {a} creative commons attribution{kind} 4 0 international license") for a in ("a", "the") for key, kind in CC4),
    *((key, f"this work is licensed under {a} creative commons attribution{kind} 3 0 unported license") for a in ("a", "the") for key, kind in CC3),
    *(("g", f"this program {_GNU} general public license {end}") for end in (
        f"{_FSF} either version 2 {_LATER}", f"{_FSF} either version 2 of the license", f"{_FSF} version 2", f"{_FSF} version 2 of the license", f"version 2 {_FSF}")),
    *(("a", f"this program {_GNU} affero general public license {end}") for end in (
        f"{_FSF} either version 3 {_LATER}", f"{_FSF} either version 3 of the license", f"{_FSF} version 3", f"{_FSF} version 3 of the license", f"version 3 {_FSF}")),
    *(("1", f"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 {v} or any later version published by the free software foundation") for v in (1, 2, 3)),
    ("m", "this source code form is subject to the terms of the mozilla public license v"),
    ("e", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("3", "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html"),
    ("3", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html"),
    ("i", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("i", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("z", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("u", "this is free and unencumbered software released into the public domain"),
    ("b", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("b", "distributed under the boost software license version 1 0"),
    ("c", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("o", "this font software is licensed under the sil open font license version 1 1"),
    ("s", "this license governs use of the accompanying software"),
    ("k", "the contents of this file are subject to the terms of the common development and distribution license the license"),
    ("y", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence"),
    ("p", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("h", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("n", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("f", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("x", "the end user documentation included with the redistribution if any must include the following acknowledgment"),
    ("j", "the software shall be used for good not evil"),
    ("d", "this database is made available under the open database license"),
    ("5", "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation"),
    ("6", "this product includes software developed by the openssl project for use in the openssl toolkit http www openssl org"),
    ("9", "you can use this software according to the terms and conditions of the mulan psl v2"),
)
#: Places where a sentence names its own work or owner: the words there, and the pattern of what may stand for them.
NAMES = (
    ("neither the name of the copyright holder nor the names of its", "neither the name of ", "(?:[a-z0-9]+[ SH]+){1,12}", "nor the names of its"),
    (f"this program {_GNU} general", "", "(?:[a-z0-9]+[ S]+){1,6}", f"{_GNU} general"),
    (f"this program {_GNU} affero", "", "(?:[a-z0-9]+[ S]+){1,6}", f"{_GNU} affero"),
    (f"this library {_GNU} lesser", "", "(?:[a-z0-9]+[ S]+){1,6}", f"{_GNU} lesser"),
)
#: Licence and the identifiers it asks for in order; the first rule that fits wins.
RULES = (
    ("gpl-3.0", "G"),
    ("gpl-3.0", "H"),
    ("lgpl", "L"),
    ("cc-by-nc-4.0", "N"),
    ("cc-by-sa-4.0", "Z"),
    ("cc-by-4.0", "Y"),
    ("cc-by-nc-sa-4.0", "O"),
    ("cc-by-nc-nd-4.0", "T"),
    ("cc-by-nd-4.0", "K"),
    ("cc-by-nc-sa-3.0", "I"),
    ("cc-by-nc-nd-3.0", "J"),
    ("cc-by-nd-3.0", "X"),
    ("cc-by-nc-3.0", "U"),
    ("cc-by-sa-3.0", "W"),
    ("cc-by-3.0", "S"),
    ("agpl-3.0", "a"),
    ("gpl-2.0", "g"),
    ("gfdl-1", "1"),
    ("mpl-2.0", "m"),
    ("epl-2.0", "e"),
    ("epl-1.0", "3"),
    ("eupl-1.2", "y"),
    ("cddl-1.0", "k"),
    ("odbl-1.0", "d"),
    ("ofl-1.1", "o"),
    ("openssl", "D6"),
    ("apache-1.1", "Dx"),
    ("bsd-4-clause", "Df"),
    ("ncsa", "n"),
    ("json", "Pj"),
    ("isc", "i"),
    ("0bsd", "0"),
    ("zlib", "z"),
    ("unlicense", "u"),
    ("bsl-1.0", "b"),
    ("cc0-1.0", "c"),
    ("ms-pl", "s"),
    ("postgresql", "p"),
    ("hpnd", "h"),
    ("python-2.0", "5"),
    ("mulan-psl-2.0", "9"),
    ("apache-2.0", "AB"),
    ("apache-2.0", "A"),
    ("apache-2.0", "BC"),
    ("bsd-3-clause", "DE"),
    ("bsd-2-clause", "D"),
    ("mit", "PQV"),
    ("mit", "M"),
    ("mit", "PV"),
    ("proprietary", "R"),
)
#: Every known sentence holds one of these, so other texts need no cutting.
ANCHORS = ("licen", "software", "redistribut", "warrant", "copyright", "rights")
_WHITE = r"[ \t\n\x0B\f\r]"
#: In lower-case text: H stands for the end of a sentence, S for the end of a clause or line.
HARD = rf"(?<![.!?;:])[;:]*+[.!?][.!?;:]*+(?={_WHITE}|\z)"
SOFT = rf"(?<![;:])[;:]++(?={_WHITE}|\z)|[\r\n]++"


def _pattern(sentence: str) -> str:
    """Java pattern of the sentence's words, wrapped anyhow."""
    def wrapped(words):
        return words.replace(" ", "[ S]++")

    for plain, before, name, after in NAMES:
        if sentence.startswith(plain):
            return wrapped(before) + name + wrapped(after + sentence[len(plain) :])
    return wrapped(sentence)


def scan(text: Column) -> tuple[Column, Column]:
    """Columns of the hits (a string of identifiers in text order) and of the licence, or null."""
    listed = SENTENCES + FULL
    assert all(any(a in s for a in ANCHORS) for _, s in listed)
    known = F.create_map(*(F.lit(x) for key, s in listed for x in (s, key)))
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    marked = F.regexp_replace(F.regexp_replace(lower, HARD, "H"), SOFT, "S")
    plain = F.concat(F.lit("H"), F.regexp_replace(marked, "[^a-z0-9HS]+", " "), F.lit("H"))
    longest = sorted({_pattern(s) for _, s in listed}, key=lambda p: (-len(p), p))
    # A list's number may stand before a sentence, as in '3) Neither the name'.
    hits = F.regexp_extract_all(plain, F.lit(rf"(?<=[HS] ?)(?:[0-9]{{1,2}} )?({'|'.join(longest)})(?= ?[HS])"), 1)

    def identifier(hit: Column) -> Column:
        words = F.regexp_replace(hit, "[ HS]+", " ")
        for own, before, _, after in NAMES:
            words = F.regexp_replace(words, f"^{before}.+? {after}", own)
        return F.element_at(known, words)

    maybe = reduce(lambda a, b: a | b, (F.contains(lower, F.lit(a)) for a in ANCHORS))
    return F.when(maybe, F.array_join(F.transform(hits, identifier), "")).otherwise(F.lit("")), licence(F.col("hits"))


def licence(hits: Column) -> Column:
    cases = None
    for name, ids in RULES:
        fits = hits.rlike(".*".join(ids))
        cases = F.when(fits, name) if cases is None else cases.when(fits, name)
    return cases


def license_scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, licence (null: none), sentence_ids (comma-separated), n_hits."""
    hits, name = scan(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), hits.alias("hits")).select(
        "doc_id",
        name.alias("licence"),
        F.array_join(F.split("hits", ""), ",").alias("sentence_ids"),
        F.length("hits").cast("long").alias("n_hits"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


_known = ", ".join(f"'{s}': '{k}'" for k, s in SENTENCES)
_cases = " ".join(f"when regexp_matches(hits, '{'.*'.join(ids)}') then '{name}'" for name, ids in RULES)
ORACLE = rf"""
with h as (
  select doc_id, list_filter(list_transform(
      string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                         '[.!?;:]+(?:[ \t\n\x0B\f\r]+|\z)|[\r\n]+'),
      lambda s: (map {{{_known}}})[trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))]),
    lambda x: x is not null) as found
  from documents),
s as (select doc_id, coalesce(array_to_string(found, ''), '') as hits, coalesce(array_to_string(found, ','), '') as sentence_ids from h)
select doc_id, case {_cases} end as licence, sentence_ids, length(hits)::bigint as n_hits from s
"""
