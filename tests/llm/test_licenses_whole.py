"""License rules without any prefilter, in plain Python."""

from __future__ import annotations

import collections
import re

from flowlens.llm import licenses
from flowlens.llm.queries import op8_licenses

from .test_native import LICENSE_TEXTS, lower

#: Texts without a word such as license, and the label each must get.
BARE = {
    "(c) 2020 Acme. All rights reserved.": "proprietary",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee": "isc",
    "Neither the name of the University nor its staff may be used to endorse or promote products": "bsd-3-clause",
    "The origin of this software must not be misrepresented;": "zlib",
    "All advertising materials mentioning features or use of this software": "bsd-4-clause",
    "Released under MIT": "mit", "Apache 2.0": "apache", "CC0 1.0": "cc0",
    "SPDX-License-Identifier: AGPL-3.0": "agpl", "SPDX-License-Identifier: MPL-2.0": "mpl", "SPDX-License-Identifier: GPL-2.0-only": "gpl",
    "FreeBSD license": "bsd-2-clause", "Creative Commons Attribution-NoDerivatives 4.0": "cc-by-nd", "Creative Commons Attribution noncommercial 4.0": "cc-by-nc",
}


def plain(text):
    norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))) + " "
    found = [(p, m.start(), m.end(), label, score) for label, regex, p, score in licenses.rules() for m in re.finditer(rf" {regex}(?= )", norm)]
    inside = lambda a, b: b[1] <= a[1] and a[2] <= b[2] and (b[0] > a[0] or (b[0] == a[0] and b[2] - b[1] > a[2] - a[1]))
    return collections.Counter(a for a in found if not any(inside(a, b) for b in found))


def test_every_rule_is_reached(spark):
    texts = [*BARE, *LICENSE_TEXTS, *[f"x {x} y" for label, regex, *_ in licenses.rules() for x in [re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", regex)] if re.fullmatch(r"[a-z0-9 ]+", x)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["detections"] for r in licenses.scan_licenses(docs).collect()}
    for i, t in enumerate(texts):
        assert collections.Counter(tuple(d) for d in rows[i]) == plain(t), t


def test_labels_without_gate_words(spark, tmp_path):
    spark.createDataFrame(list(enumerate(BARE)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    named = {r["doc_id"]: r["labels"].split(",") for r in op8_licenses(spark, str(tmp_path)).collect()}
    for i, (t, label) in enumerate(BARE.items()):
        assert label in named[i], t


#: Notices as projects write them, and all labels that they must get.
NOTICES = {
    "Neither the name of the University of California, Berkeley nor of the Lawrence Berkeley National Laboratory nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
    "The name of the authors, the institutes that they work for and all of the people who have ever helped them in any way may not be used to endorse or promote products": "bsd-3-clause",
    "MIT Licensed": "mit", "Released under MIT/X11": "mit", "MIT/X11": "mit", '"license": "ISC"': "isc", '"license": "MIT"': "mit", '"license": "AGPL"': "agpl", "Released under the terms of the GNU LGPL": "lgpl",
    "Public Domain": "public-domain", "under the same license as Perl": "artistic", "You may use it under the same terms as Perl itself.": "artistic", "Dual licensed under the MIT and GPL licenses": "dual,gpl,mit",
    "Released under the BSD 3-Clause License": "bsd-3-clause", "distributed under the terms of the Simplified BSD License": "bsd-2-clause", "Licensed under the Frobnicator Public Software Sharing And Caring License": "unknown",
}


def test_notices_get_their_labels(spark, tmp_path):
    spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    named = {r["doc_id"]: r["labels"] for r in op8_licenses(spark, str(tmp_path)).collect()}
    assert {t: named[i] for i, t in enumerate(NOTICES)} == NOTICES


def test_no_rule_counts_words(spark):
    """No rule stops at a number of words or looks on without end."""
    assert not [regex for _, regex, *_ in licenses.rules() if "{" in regex or "[^ ]" in regex]


def test_equal_intervals_of_equal_priority_stay(spark):
    docs = spark.createDataFrame([(1, "GNU GPL license")], "doc_id long, text string")
    kept = [tuple(d) for d in licenses.scan_licenses(docs).first()["detections"]]
    assert collections.Counter(kept) == plain("GNU GPL license")
