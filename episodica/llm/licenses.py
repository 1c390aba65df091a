"""License scans: notices and identifier tags by Aho-Corasick, expressions by a shunting yard.

One automaton holds all phrases as words with single spaces between them and is run over the words of the text, so
punctuation, line breaks and comment marks between words don't matter. A phrase is a notice (it names a licence), or a tag that says
that an expression follows. Behind a tag the original text is read on as an expression: identifiers, `and`, `or`, `with`
and parentheses, `with` binding closest and `or` least (`/` reads as `or`, `+` at an identifier's end as any later version). The longest
beginning that is a whole expression counts; what follows it is prose.

Every licence has a burden from 0 (none) to 1 (uses are excluded). `or` leaves the choice, so the lower burden counts; under `and` both bind,
the higher counts; an exception after `with` takes a step off. A text's score is its heaviest statement's burden, 0
without any statement; an identifier that is in no list counts as UNKNOWN.

Labels: a notice gives its licence's, an expression those of all its identifiers (an exception as `licence-with-exception`);
a family's label (gpl) gives way to a version of it (gpl-3) in the same text.

Cases: null, empty and wordless texts have no words and no places: null first and last word, empty labels, score 0. Equal texts give
equal results, ids may repeat or be null, other columns are not read, an empty table gives no rows. Texts are scanned
whole, however long; of one row no more than its text and its words are held.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from episodica.llm.common import struct_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Burdens of kinds of licences.
PUBLIC_DOMAIN, PERMISSIVE, WEAK_COPYLEFT, STRONG_COPYLEFT, NETWORK_COPYLEFT, UNKNOWN, EXCLUDING = 0.1, 0.2, 0.4, 0.6, 0.7, 0.8, 1.0
STEP = 0.2

# Public licence identifiers by their beginnings, with label and burden.
IDENTIFIERS = {
    "mit": ("mit", PERMISSIVE),
    "apache-2": ("apache-2", PERMISSIVE),
    "apache": ("apache", PERMISSIVE),
    "bsd-2": ("bsd-2", PERMISSIVE),
    "bsd-3": ("bsd-3", PERMISSIVE),
    "bsd": ("bsd", PERMISSIVE),
    "isc": ("isc", PERMISSIVE),
    "zlib": ("zlib", PERMISSIVE),
    "bsl-1": ("boost", PERMISSIVE),
    "artistic": ("artistic", PERMISSIVE),
    "psf": ("psf", PERMISSIVE),
    "unlicense": ("unlicense", PUBLIC_DOMAIN),
    "cc0": ("cc0", PUBLIC_DOMAIN),
    "wtfpl": ("wtfpl", PUBLIC_DOMAIN),
    "mpl": ("mpl", WEAK_COPYLEFT),
    "epl": ("epl", WEAK_COPYLEFT),
    "lgpl": ("lgpl", WEAK_COPYLEFT),
    "gpl-2": ("gpl-2", STRONG_COPYLEFT),
    "gpl-3": ("gpl-3", STRONG_COPYLEFT),
    "gpl": ("gpl", STRONG_COPYLEFT),
    "agpl": ("agpl", NETWORK_COPYLEFT),
    "cc-by-nc-nd": ("cc-by-nc-nd", EXCLUDING),
    "cc-by-nc-sa": ("cc-by-nc-sa", EXCLUDING),
    "cc-by-nc": ("cc-by-nc", EXCLUDING),
    "cc-by-nd": ("cc-by-nd", EXCLUDING),
    "cc-by-sa": ("cc-by-sa", STRONG_COPYLEFT),
    "cc-by": ("cc-by", PERMISSIVE),
    "proprietary": ("proprietary", EXCLUDING),
}

# Labels that name a family only: they give way to a version of it in the same text.
FAMILIES = ("apache", "bsd", "gpl")

# Phrases of notices and the identifier that each stands for.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2",
    "apache 2 0 license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "2 clause bsd": "bsd-2",
    "bsd 2 clause": "bsd-2",
    "3 clause bsd": "bsd-3",
    "bsd 3 clause": "bsd-3",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl-1",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "cc0",
    "cc0 1 0": "cc0",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license v2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license v3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noderivs": "cc-by-nd",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "all rights reserved": "proprietary",
}

# Phrases that an expression follows. Behind the second kind only listed identifiers make one, as prose may follow too.
TAGS = ("spdx license identifier", "license expression")
LOOSE_TAGS = ("license", "licence", "licensed under", "licensed under the", "released under", "released under the")

TOKEN = re.compile(r"[()/]|[0-9a-z][0-9a-z.+-]*")
GAP = re.compile(r"[ \t\"'`:=]*")
# What binds closer stands higher.
BINDS = {"or": 1, "/": 1, "and": 2, "with": 3}


def identify(name: str) -> tuple[str, float] | None:
    """(label, burden) of an identifier: the longest listed beginning that ends where a part of the name does."""
    plain = name.rstrip("+.-")
    while plain:
        if plain in IDENTIFIERS:
            return IDENTIFIERS[plain]
        cut = max(plain.rfind("-"), plain.rfind("."))
        if cut < 0:
            return None
        plain = plain[:cut]
    return None


def applied(op: str, left: float, right: float) -> float:
    if op == "with":
        return max(0.0, round(left - STEP, 6))
    return max(left, right) if op == "and" else min(left, right)


def parse(text: str, at: int, only_listed: bool) -> tuple[list[str], float, int] | None:
    """(labels, burden, end) of the longest expression that begins at `at` of a lower-cased text, read to the end of its line.

    A shunting yard: values and ops are its two stacks. Each closed state, in which no parenthesis is open and an operand came last, is a
    whole expression; the last one counts."""
    values: list[float] = []
    ops: list[str] = []
    labels: list[str] = []
    depth, whole, want, exception, single = 0, None, True, False, False

    def reduce(least: int) -> None:
        while ops and ops[-1] != "(" and BINDS[ops[-1]] >= least:
            right, left = values.pop(), values.pop()
            values.append(applied(ops.pop(), left, right))

    at = GAP.match(text, at).end()
    while (found := TOKEN.match(text, at)) is not None:
        word, at = found.group(), GAP.match(text, found.end()).end()
        if want:
            if word == "(" and not exception:
                ops.append(word)
                depth += 1
                continue
            if word in BINDS or word in "()":
                break
            if exception:
                labels[-1] += "-with-" + word.rstrip("+.-")
                values.append(0.0)
            else:
                known = identify(word)
                if known is None and only_listed:
                    break
                label, burden = known or (word.rstrip("+.-"), UNKNOWN)
                labels.append(label)
                values.append(burden)
            single, want, exception = not exception, False, False
        elif word == ")":
            if not depth:
                break
            reduce(1)
            ops.pop()
            depth -= 1
            single = False
        elif word in BINDS and (word != "with" or single):
            # An exception belongs to one licence.
            reduce(BINDS[word])
            ops.append(word)
            want, exception = True, word == "with"
            continue
        else:
            break
        if not depth:
            whole = len(labels), resolved(values, ops), labels[-1], at
    if whole is None:
        return None
    n, burden, last, at = whole
    return [*labels[: n - 1], last], burden, at


def resolved(values: list[float], ops: list[str]) -> float:
    """The value of a closed state; the stacks stay as they are, and hold no more operators than there are ranks."""
    out = values[-1]
    for k in range(len(ops) - 1, -1, -1):
        out = applied(ops[k], values[k], out)
    return out


BASE_PLACE, NOTICE, TAG, LOOSE_TAG = range(4)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All phrases with a space before and behind; of a phrase, its number of words and what it is: (kind, label) pairs."""
    meaning: dict[str, list] = {}
    for phrase, label in BASE.items():
        meaning.setdefault(phrase, []).append((BASE_PLACE, label))
    for phrase, name in NOTICES.items():
        meaning.setdefault(phrase, []).append((NOTICE, name))
    for kind, phrases in ((TAG, TAGS), (LOOSE_TAG, LOOSE_TAGS)):
        for phrase in phrases:
            meaning.setdefault(phrase, []).append((kind, ""))
    made = ahocorasick.Automaton()
    for phrase, what in meaning.items():
        made.add_word(f" {phrase} ", (phrase.count(" ") + 1, tuple(what)))
    made.make_automaton()
    return made


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    text = (text or "").translate(LOWER)
    words = WORD.findall(text)
    joined = " " + " ".join(words) + " "
    places, base, notices, tags = [], set(), [], []
    word, seen = 0, 0
    for end, (n_words, what) in automaton().iter(joined):
        # Words up to here: a match begins at the space before its first one. Matches come in the order of their ends.
        word += joined.count(" ", seen, end + 1)
        seen = end + 1
        first = word - 1 - n_words
        for kind, label in what:
            if kind == BASE_PLACE:
                places.append(first)
                base.add(label)
            if kind in (BASE_PLACE, NOTICE):
                notices.append((first, first + n_words, label))
            else:
                tags.append((first + n_words, kind == LOOSE_TAG))
    labels, score = set(base), 0.0
    spans = []
    for named, burden, span in expressions(text, tags):
        labels.update(named)
        score = max(score, burden)
        spans.append(span)
    for label, burden in longest(notices, spans):
        labels.add(label)
        score = max(score, burden)
    labels = {x for x in labels if x not in FAMILIES or not any(y.startswith(x + "-") for y in labels)}
    firsts = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *firsts, ",".join(sorted(base)), ",".join(sorted(labels)), float(score)


def longest(notices: list[tuple[int, int, str]], spans: list[tuple[int, int]]) -> Iterator[tuple[str, float]]:
    """What the notices say, given by their words, that lie in no longer one and in no expression."""
    reach = 0
    ranges = [(first, end, None) for first, end in spans] + notices
    for _, end, name in sorted(ranges, key=lambda r: (r[0], -r[1], r[2] is not None)):
        if end > reach:
            reach = end
            if name is not None:
                yield identify(name)


def expressions(text: str, tags: list[tuple[int, bool]]) -> Iterator[tuple[list[str], float, tuple[int, int]]]:
    """(labels, burden, range of words) of the expressions behind the tags, which are given by the number of words before what follows them."""
    if not tags:
        return
    wanted = dict(sorted(tags, key=lambda t: -t[1]))
    last = max(wanted)
    for k, word in enumerate(WORD.finditer(text), 1):
        if k in wanted:
            found = parse(text, word.end(), wanted[k])
            if found is not None:
                named, burden, end = found
                yield named, burden, (k, k + len(WORD.findall(text, word.end(), end)))
        if k >= last:
            return


FOUND = pa.struct(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)


def licenses(text: Column) -> Column:
    """What `scan` finds in each text, as a struct."""

    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield struct_array([scan(text.as_py()) for text in batch], FOUND)

    return F.arrow_udf(scanned, from_arrow_type(FOUND))(text)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs."""
    return docs.select(F.col(id_col).alias("doc_id"), licenses(F.col(text_col)).alias("_l")).select("doc_id", "_l.*")


def with_licenses(docs: DataFrame, most: float = 1.0, text_col: str = "text") -> DataFrame:
    """The documents whose statements burden them no more than `most`."""
    return docs.filter(licenses(F.col(text_col))["score"] <= most)
