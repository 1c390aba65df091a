"""License scans beside a plain search for phrases, and expressions beside Python's own precedence."""

import re
import random

import pytest
from pyspark.sql import functions as F

from episodica.llm import licenses, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "...", "Released under the MIT License.", "UNDER\nTHE -- mit (license) under the mit licensee", "cc by nc cc by nc", "CC-BY-NC/CC BY\tNC 4.0",
    "Apache License,\n# Version 2.0, under the MIT license Apache License version 21", "licence mit ünder the mit license", "under the mit licenseé x",
    "cc by " * 3000 + "nc", "x" * 200_000 + " cc by nc", "Ⅷ under_the_mit_license K under the mit license",
]


def test_base_equals_a_plain_search(frame, odd):
    docs = frame(list(enumerate(TEXTS))).unionByName(odd)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, *plain(r.text)) for r in docs.collect()), key=str)
    got = licenses.digests(docs.withColumn("labels", F.lit("mine")).withColumn("_l", F.lit(1))).collect()
    rows = [(r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    assert sorted(rows, key=str) == want
    for r in got:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and (r.score > 0) == (r.labels != "")
    assert licenses.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,labels,score",
    [
        ("SPDX-License-Identifier: MIT", "mit", 0.2),
        ("// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */", "gpl-2-with-classpath-exception-2.0", 0.4),
        ("spdx-license-identifier: (MIT OR GPL-3.0-only) AND CC-BY-NC-4.0", "cc-by-nc,gpl-3,mit", 1.0),
        ("SPDX-License-Identifier: MIT OR GPL-3.0+ AND CC-BY-NC-4.0", "cc-by-nc,gpl-3,mit", 0.2),
        ("SPDX-License-Identifier: MIT OR (GPL-3.0 AND", "mit", 0.2),
        ("SPDX-License-Identifier: (MIT", "", 0.0),
        ("SPDX-License-Identifier: Frob-1.0 and more words", "frob-1.0,more", 0.8),
        ("SPDX-License-Identifier:\nMIT", "", 0.0),
        ('license = "MIT/Apache-2.0"', "apache-2,mit", 0.2),
        ("The license of this house is old", "", 0.0),
        ("dual-licensed under the BSD-3-Clause or LGPL-2.1", "bsd-3,lgpl", 0.2),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3", 0.6),
        ("Licensed under the Apache License, Version 2.0.", "apache-2", 0.2),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc", 1.0),
        ("Creative Commons Attribution-NonCommercial-ShareAlike", "cc-by-nc-sa", 1.0),
        ("SPDX-License-Identifier: MIT WITH", "mit", 0.2),
        ("SPDX-License-Identifier: (MIT OR ISC) WITH x", "isc,mit", 0.2),
        ("SPDX-License-Identifier: " + "(" * 50_000 + "MIT" + ")" * 50_000, "mit", 0.2),
        ("SPDX-License-Identifier: " + " OR ".join(f"Own-{i}" for i in range(3000)), None, 0.8),
    ],
)
def test_expressions(text, labels, score):
    got = licenses.scan(text)
    assert (labels is None or got[5] == labels) and got[6] == pytest.approx(score)


def test_random_expressions():
    """Operators' ranks and parentheses beside Python's, which ranks | below & alike: or as |, and as &, on ordered burdens."""

    class Burden:
        def __init__(self, x):
            self.x = x

        def __and__(self, o):
            return Burden(max(self.x, o.x))

        def __or__(self, o):
            return Burden(min(self.x, o.x))

    rng, names = random.Random(5), ["mit", "gpl-3.0", "mpl-2.0", "cc-by-nc-4.0", "cc0-1.0", "agpl-3.0"]
    scope = {f"v{k}": Burden(licenses.identify(n)[1]) for k, n in enumerate(names)}

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            k = rng.randrange(len(names))
            return names[k], f"v{k}"
        (a, x), (b, y) = make(depth - 1), make(depth - 1)
        word, sign = rng.choice([("AND", "&"), ("or", "|")])
        return (f"({a} {word} {b})", f"({x} {sign} {y})") if rng.random() < 0.5 else (f"{a} {word} {b}", f"{x} {sign} {y}")

    for _ in range(300):
        said, python = make(5)
        want = eval(python, scope).x
        assert licenses.scan("SPDX-License-Identifier: " + said)[6] == pytest.approx(want)


def test_with_licenses_and_query(spark, sf, frame):
    docs = frame([(1, "SPDX-License-Identifier: MIT"), (2, "all rights reserved"), (3, None)])
    assert sorted(r.doc_id for r in licenses.with_licenses(docs, 0.5).collect()) == [1, 3]
    got = {r.doc_id: r for r in queries.QUERIES["op13_license_scan"](spark, sf).collect()}
    texts = queries.documents(spark, sf).collect()
    assert len(got) == len(texts)
    for t in texts:
        r = got[t.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(t.text)
