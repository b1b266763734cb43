"""Licence scans by ordered signature rules.

A text is brought to its words, joined by single spaces. A rule is a regular expression over that form,
with a label, a priority, a weight, and keywords of which the text must have one before the expression
is tried. Signatures of licence bodies, headers, exceptions and choices are written one by one
(``SIGNATURES``, ``NOTICES``); mentions of licences are written as families, of which each licence's
names and versions are multiplied by the ways of granting it (``NAMED``, ``CREATIVE``, ``GRANTS``).
Detections are taken in order of priority, then length; one whose words lie within a detection taken
before is dropped. Base phrases are rules too, but always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.words import slices

# The base phrases of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence names as their words are spelled, with labels; version words follow a name.
NAMED = {
    "mit": "mit license|mit licence|expat license",
    "apache": "apache license|apache software license|apache public license",
    "bsd": "bsd license|bsd style license|berkeley software distribution license",
    "isc": "isc license|internet systems consortium license",
    "mpl": "mozilla public license|mpl",
    "epl": "eclipse public license|epl",
    "cddl": "common development and distribution license|cddl",
    "cpl": "common public license",
    "eupl": "european union public licence|european union public license|eupl",
    "artistic": "artistic license|perl artistic license",
    "zlib": "zlib license|zlib libpng license",
    "boost": "boost software license",
    "unlicense": "unlicense",
    "wtfpl": "do what the fuck you want to public license|wtfpl",
    "python": "python software foundation license|psf license",
    "ruby": "ruby license",
    "postgresql": "postgresql license",
    "openssl": "openssl license",
    "odbl": "open database license|open data commons open database license|odbl",
    "ofl": "sil open font license|open font license",
    "ms-pl": "microsoft public license|ms pl",
    "ms-rl": "microsoft reciprocal license|ms rl",
    "agpl": "gnu affero general public license|affero general public license|agpl|agplv3",
    "lgpl": "gnu lesser general public license|lesser general public license|gnu library general public license|lgpl|lgplv2|lgplv3",
    "gpl": "gnu general public license|gnu gpl|gpl|gplv2|gplv3",
    "gfdl": "gnu free documentation license|gfdl",
    "cecill": "cecill license|cecill",
    "php": "php license",
    "vim": "vim license",
    "ncsa": "university of illinois ncsa open source license|ncsa open source license",
    "osl": "open software license",
    "afl": "academic free license",
    "elastic": "elastic license",
    "sspl": "server side public license|sspl",
    "busl": "business source license|busl",
    "commons-clause": "commons clause",
}
# Parts of licences of one series, as their words are spelled.
CREATIVE = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:atives|s)?", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:atives|s)?"}
# Ways in which a text grants a licence, with their weights.
GRANTS = {
    r"(?:is |are |be )?licensed (?:to you )?under (?:the )?(?:terms of )?(?:the )?": 0.95,
    r"(?:is |are |be )?released under (?:the )?(?:terms of )?(?:the )?": 0.9,
    r"(?:is |are |be )?distributed under (?:the )?(?:terms of )?(?:the )?": 0.9,
    r"(?:is |are |be )?available under (?:the )?(?:terms of )?(?:the )?": 0.85,
    r"under (?:the )?terms (?:and conditions )?of (?:the )?": 0.8,
    r"subject to (?:the )?(?:terms of )?(?:the )?": 0.7,
    r"spdx license identifier ": 1.0,
}
_VERSION = r"(?: (?:version|v) ?\d+(?: \d+)?| \d+ \d+| v\d+(?: \d+)?)?"
# Phrases of notices, with labels, keywords and weights.
NOTICES = [
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 0.6),
    ("copyright", r"copyright (?:c )?(?:by|of) \w+", "copyright", 0.5),
    ("proprietary", r"proprietary and confidential", "proprietary", 0.9),
    ("proprietary", r"unauthorized (?:copying|use|distribution) (?:of this \w+ )?is (?:strictly )?prohibited", "unauthorized", 0.9),
    ("proprietary", r"may not be (?:reproduced|copied|redistributed)(?: \w+){0,6} without (?:the )?(?:prior )?(?:written )?permission", "permission", 0.8),
    ("public-domain", r"(?:released |dedicated |placed |is )?(?:in|into|to) the public domain", "domain", 0.8),
    ("public-domain", r"no copyright (?:is )?(?:reserved|claimed)", "copyright", 0.6),
    ("permissive", r"permission is hereby granted free of charge", "hereby", 0.95),
    ("permissive", r"permission to use copy modify and (?:or )?distribute", "permission", 0.9),
    ("permissive", r"redistribution and use in source and binary forms", "redistribution", 0.95),
    ("warranty", r"(?:is )?provided as is(?: without warranty)?", "provided", 0.4),
    ("warranty", r"without (?:any )?warranty of any kind", "warranty", 0.4),
    ("some-rights", r"some rights reserved", "reserved", 0.6),
    ("no-rights", r"no rights reserved", "reserved", 0.6),
]


# Written signatures of licence bodies, headers, exceptions and choices, with labels and a keyword.
SIGNATURES = [
    ("mit", r"to deal in the software without restriction", "restriction"),
    ("mit", r"to use copy modify merge publish distribute sublicense and or sell", "sublicense"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "notice"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim", "holders"),
    ("mit-0", r"mit no attribution", "attribution"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", "fee"),
    ("isc", r"the author disclaims all warranties with regard to this software", "disclaims"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions"),
    ("bsd", r"this software is provided by the copyright holders and contributors as is", "contributors"),
    ("bsd-3", r"neither the name of (?:the )?\w+(?: \w+){0,6} nor the names of its contributors may be used", "neither"),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display", "advertising"),
    ("bsd-2", r"(?:simplified|2 clause|two clause) bsd", "bsd"),
    ("bsd-3", r"(?:new|modified|revised|3 clause|three clause) bsd", "bsd"),
    ("0bsd", r"zero clause bsd", "zero"),
    ("apache", r"you may not use this file except in compliance with the license", "compliance"),
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the license", "writing"),
    ("apache", r"licensed to the apache software foundation asf under one or more contributor license agreements", "asf"),
    ("apache", r"grant of copyright license subject to the terms and conditions of this license each contributor", "contributor"),
    ("apache", r"grant of patent license", "patent"),
    ("apache", r"www apache org licenses license 2 0", "apache"),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "redistribute"),
    ("gpl", r"either version [23] of the license or at your option any later version", "option"),
    ("gpl", r"you should have received a copy of the gnu general public license", "received"),
    ("gpl", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom", "freedom"),
    ("gpl", r"this program comes with absolutely no warranty", "absolutely"),
    ("gpl", r"when we speak of free software we are referring to freedom not price", "freedom"),
    ("gpl-only", r"gpl ?v?[23](?: 0)? only", "only"),
    ("gpl-or-later", r"gpl ?v?[23](?: 0)? or (?:any )?later", "later"),
    ("gpl-or-later", r"gnu general public license (?:version|v) ?[23](?: 0)? or (?:at your option )?(?:any )?later", "later"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", "library"),
    ("lgpl", r"a program that contains no derivative of any portion of the library", "derivative"),
    ("lgpl", r"you should have received a copy of the gnu lesser general public license", "lesser"),
    ("lgpl-or-later", r"lgpl ?v?(?:2 1|3)(?: 0)? or (?:any )?later", "later"),
    ("agpl", r"remote network interaction use with the gnu general public license", "remote"),
    ("agpl", r"interacting with it remotely through a computer network", "remotely"),
    ("agpl", r"you should have received a copy of the gnu affero general public license", "affero"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document", "document"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", "invariant"),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("mpl", r"if a copy of the mpl was not distributed with this file", "mpl"),
    ("mpl", r"incompatible with secondary licenses", "secondary"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse", "accompanying"),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license", "eclipse"),
    ("cddl", r"the contents of this file are subject to the terms of the common development", "contents"),
    ("cpl", r"the accompanying program is provided under the terms of this common public license", "accompanying"),
    ("eupl", r"licensed under the eupl", "eupl"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "package"),
    ("zlib", r"the origin of this software must not be misrepresented", "misrepresented"),
    ("zlib", r"altered source versions must be plainly marked as such", "altered"),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "organization"),
    ("boost", r"distributed under the boost software license", "boost"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "compile"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", "verbatim"),
    ("fsf", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim"),
    ("python", r"psf is making python available to licensee on an as is basis", "licensee"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee", "documentation"),
    ("openssl", r"this product includes software developed by the openssl project", "openssl"),
    ("ssleay", r"this product includes cryptographic software written by eric young", "cryptographic"),
    ("php", r"this product includes php software freely available from", "php"),
    ("x11", r"except as contained in this notice the name of the x consortium", "consortium"),
    ("ncsa", r"to deal with the software without restriction", "restriction"),
    ("ofl", r"the font software may be sold as part of a larger software package but may not be sold by itself", "font"),
    ("ofl", r"reserved font name", "font"),
    ("odbl", r"any individual contents of the database are licensed under the database contents license", "database"),
    ("pddl", r"public domain dedication and licen[cs]e", "dedication"),
    ("odc-by", r"open data commons attribution licen[cs]e", "commons"),
    ("cdla-permissive", r"community data license agreement permissive", "community"),
    ("cdla-sharing", r"community data license agreement sharing", "community"),
    ("cc0", r"to the extent possible under law (?:the )?\w+(?: \w+){0,6} (?:has|have) waived all copyright", "waived"),
    ("cc0", r"no rights reserved cc0", "cc0"),
    ("cc", r"you are free to share copy and redistribute the material", "redistribute"),
    ("cc", r"you must give appropriate credit provide a link to the license", "credit"),
    ("cc", r"this work is licensed under a creative commons", "creative"),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same license", "remix"),
    ("cc-by-nc", r"you may not use the material for commercial purposes", "commercial"),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", "remix"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", "governs"),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service", "hosted"),
    ("sspl", r"offering the program as a service", "offering"),
    ("busl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "licensor"),
    ("busl", r"change license", "change"),
    ("commons-clause", r"the license does not grant to you the right to sell the software", "sell"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|free trial)", "polyform"),
    ("prosperity", r"prosperity public license", "prosperity"),
    ("parity", r"parity public license", "parity"),
    ("hippocratic", r"hippocratic license", "hippocratic"),
    ("json", r"the software shall be used for good not evil", "evil"),
    ("beerware", r"you can buy me a beer in return", "beer"),
    ("ccdl", r"creative commons developing nations", "nations"),
    ("openrail", r"(?:creativeml )?open ?rail", "openrail|open"),
    ("openrail", r"responsible ai license", "responsible"),
    ("llama", r"llama (?:\d )?community license", "llama"),
    ("gemma", r"gemma terms of use", "gemma"),
    ("ogl-uk", r"open government licen[cs]e", "government"),
    ("crown", r"crown copyright", "crown"),
    ("etalab", r"licence ouverte", "ouverte"),
    ("dl-de", r"datenlizenz deutschland", "datenlizenz"),
    ("cern-ohl", r"cern open hardware licen[cs]e", "cern"),
    ("tapr-ohl", r"tapr open hardware license", "tapr"),
    ("solderpad", r"solderpad hardware licen[cs]e", "solderpad"),
    ("mulan", r"mulan p(?:ermissive|ublic) ?(?:software )?license", "mulan"),
    ("classpath-exception", r"classpath exception", "classpath"),
    ("classpath-exception", r"as a special exception the copyright holders of this library give you permission to link", "exception"),
    ("gcc-exception", r"gcc runtime library exception", "gcc"),
    ("linking-exception", r"(?:static )?linking exception", "linking"),
    ("font-exception", r"font (?:embedding )?exception", "font"),
    ("autoconf-exception", r"autoconf (?:configure script )?exception", "autoconf"),
    ("bison-exception", r"bison exception", "bison"),
    ("llvm-exception", r"llvm exceptions?", "llvm"),
    ("openssl-exception", r"openssl (?:linking )?exception", "openssl"),
    ("syscall-note", r"linux syscall note", "syscall"),
    ("dual", r"dual licensed under", "dual"),
    ("dual", r"licensed under (?:either of|both)", "licensed"),
    ("dual", r"at your option either", "option"),
    ("dual", r"mit or apache(?: 2 0)?", "mit"),
    ("dual", r"available under (?:a )?commercial licen[cs]e", "commercial"),
    ("spdx", r"spdx (?:license identifier|filecopyrighttext)", "spdx"),
    ("see-license", r"see (?:the )?(?:accompanying |included |file )?(?:license|licence|copying|notice)(?: txt| md)? (?:file )?for (?:details|more|the full|full)", "see"),
    ("see-license", r"for the full copyright and license information", "information"),
    ("contributor-agreement", r"contributor license agreement", "contributor"),
    ("contributor-agreement", r"developer certificate of origin", "certificate"),
    ("trademark", r"(?:is|are) (?:a )?(?:registered )?trademarks? of", "trademark|trademarks"),
    ("patents", r"patent pending", "patent"),
    ("confidential", r"(?:strictly |company )confidential(?: information)?", "confidential"),
    ("confidential", r"trade secrets? of", "secret|secrets"),
    ("no-commercial", r"(?:for )?non ?commercial (?:use|purposes) only", "only"),
    ("no-commercial", r"not for commercial use", "commercial"),
    ("personal-use", r"for (?:personal|private) use only", "only"),
    ("evaluation", r"for evaluation purposes only", "evaluation"),
    ("academic", r"for (?:academic|research|educational) (?:use|purposes) only", "only"),
    ("government-rights", r"u s government (?:users )?restricted rights", "restricted"),
    ("government-rights", r"commercial computer software as defined in", "commercial"),
    ("no-redistribution", r"redistribution (?:is )?(?:not permitted|prohibited)", "redistribution"),
    ("written-consent", r"without (?:the )?(?:express(?:ed)? |prior )?written (?:consent|permission|approval)", "written"),
    ("reserved", r"alle rechte vorbehalten", "vorbehalten"),
    ("reserved", r"tous droits r\w+serv\w+s", "tous"),
    ("reserved", r"todos los derechos reservados", "derechos"),
    ("reserved", r"todos os direitos reservados", "direitos"),
    ("reserved", r"tutti i diritti riservati", "diritti"),
    ("public-domain", r"has been (?:placed|dedicated|released) (?:in|to|into) the public domain", "domain"),
    ("public-domain", r"this work is free of known copyright restrictions", "restrictions"),
    ("eula", r"end user licen[cs]e agreement", "agreement"),
    ("eula", r"by (?:installing|downloading|copying|using) (?:the|this) software you agree", "installing|downloading|copying|using"),
    ("subscription", r"this software is licensed not sold", "licensed"),
    ("shareware", r"shareware", "shareware"),
    ("freeware", r"freeware", "freeware"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: frozenset
    priority: int
    weight: float
    base: bool = False


def _first_words(names: str) -> frozenset:
    return frozenset(n.split()[0] for n in names.split("|"))


def build_rules() -> list[Rule]:
    """All rules in order: grants of named licences and series, bare names, notices, base phrases."""
    edge = lambda p: re.compile(rf"(?<![^ ])(?:{p})(?![^ ])")
    out = []
    series = {"cc0": (r"cc0|cc zero|creative commons zero", frozenset(["cc0", "cc", "creative"]))}
    for short, long in CREATIVE.items():
        series["cc-" + short.replace(" ", "-")] = (rf"cc {short}|ccby{short[2:].replace(' ', '')}|creative commons {long}(?: license)?", frozenset(["cc", "creative", "ccby" + short[2:].replace(" ", "")]))
    families = {k: (v, _first_words(v)) for k, v in NAMED.items()} | series
    for label, (names, keywords) in families.items():
        for words, weight in GRANTS.items():
            out.append(Rule(label, edge(rf"{words}(?:{names}){_VERSION}"), keywords, 3, weight))
        bare = 0.5 if " " in names.split("|")[0] else 0.3
        out.append(Rule(label, edge(rf"(?:{names}){_VERSION}"), keywords, 2, bare))
    for label, pattern, keywords in SIGNATURES:
        out.append(Rule(label, edge(pattern), frozenset(keywords.split("|")), 4, 0.9))
    for label, pattern, keyword, weight in NOTICES:
        out.append(Rule(label, edge(pattern), frozenset([keyword]), 1, weight))
    for phrase, label in BASE.items():
        out.append(Rule(label, edge(phrase), frozenset([phrase.split()[-1]]), 0, 0.5, base=True))
    return out


# A-Z lowered, everything that is not in a word a space
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Detection:
    begin: int
    end: int
    rule: Rule


def outermost(found: list[Detection]) -> list[Detection]:
    """By priority, then length, those that lie within none taken before; in n log n.

    A Fenwick tree over begins holds the farthest end of what was taken up to each begin.
    """
    place = {x: k + 1 for k, x in enumerate(sorted({d.begin for d in found}))}
    reach = [-1] * (len(place) + 1)
    kept = []
    for d in sorted(found, key=lambda d: (-d.rule.priority, d.begin - d.end, d.begin, -d.rule.weight, d.rule.label)):
        k, farthest = place[d.begin], -1
        while k:
            farthest = max(farthest, reach[k])
            k -= k & -k
        if farthest >= d.end:
            continue
        kept.append(d)
        k = place[d.begin]
        while k < len(reach):
            reach[k] = max(reach[k], d.end)
            k += k & -k
    return kept


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        self.rules = build_rules() if rules is None else rules
        self.by_keyword: dict[str, list[int]] = {}
        for k, r in enumerate(self.rules):
            for w in r.keywords:
                self.by_keyword.setdefault(w, []).append(k)
        self.keywords = {w.encode() for w in self.by_keyword}

    def scan(self, text: bytes) -> tuple[int, list[Detection], list[Detection]]:
        """Number of words, detections of base phrases, and the other detections that remain."""
        words = text.translate(_WORD_BYTES).split()
        present = self.keywords.intersection(words)
        if not present:
            return len(words), [], []
        form = b" ".join(words).decode("utf-8", "replace")
        tried = sorted({k for w in present for k in self.by_keyword[w.decode()]})
        found = [(m.start(), m.end(), self.rules[k]) for k in tried for m in self.rules[k].pattern.finditer(form)]
        marks = sorted({x for a, b, _ in found for x in (a, b)})
        place, at, n = {}, 0, 0
        for x in marks:  # words before each mark, counted in one walk
            n += form.count(" ", at, x)
            place[x], at = n, x
        every = [Detection(place[a], place[b] + 1, r) for a, b, r in found]
        base = [d for d in every if d.rule.base]
        return len(words), base, outermost([d for d in every if not d.rule.base])


def _scan(rules: list[Rule] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch, data, offsets in slices(batches, "text"):
            whole, rows = data.tobytes(), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n, base, other = scanner.scan(whole[a:b])
                miss = 1.0
                for d in {d.rule.label: d for d in sorted([*base, *other], key=lambda d: d.rule.weight)}.values():
                    miss *= 1 - d.rule.weight
                starts, labels = [d.begin for d in base], sorted({d.rule.label for d in base})
                rows.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(labels), ",".join(sorted({*labels, *(d.rule.label for d in other)})), round(1 - miss, 9), [{"label": d.rule.label, "begin": d.begin, "end": d.end, "weight": d.rule.weight} for d in [*base, *other]]))
            found = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), found]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Licence detections of every whole text.

    (id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections): places of base
    phrases and the first and last of them, labels of base phrases and of all detections (distinct,
    sorted, comma-joined), 1 minus the product over labels of 1 minus the largest weight, and the
    detections with their words (begin, end exclusive). Null and empty texts have no words, empty
    labels and score 0. Repeated rows and null ids stay, an empty table gives no rows, texts of any length
    are scanned whole; other columns are left out. Of detections of one priority and length the earlier,
    then the heavier, then the smaller label is taken first.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    form = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,begin:long,end:long,weight:double>>"
    return rows.mapInArrow(_scan(rules), form).withColumnRenamed("id", id_col)


def op9(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
