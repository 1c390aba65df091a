"""Sanitisation of personal data: protected entities by pattern, and the terms that reveal them by corpus co-occurrence.

Entities are e-mail addresses, IP addresses, card numbers and telephone numbers, found by patterns. A term (a run of
letters and digits outside of entities, lower-cased) reveals an entity if meeting it tells nearly all that the entity's
name tells: the pointwise mutual information of both, PMI = log2(n(t, c) N / (n(t) n(c))), as a share of the entity's
information content, IC = log2(N / n(c)). All four count different texts, read whole, so that copies of a document
neither add nor remove evidence. Terms whose share reaches DISCLOSURE, and surely SURE, are generalised (to the entity's
kind) wherever they stand, or removed if they stand nowhere else. All of this is DataFrame functions.

The sure share takes n(t, c) at its lower confidence limit (Poisson, one-sided, Z). The first text in which both stand
only proposes the pair, so that the limit is of the others; texts that share a sketch, as near copies do, count once
there. One text is never evidence, and two are in corpora of about a thousand texts or more.

Cases: null and empty texts have no spans; repeated rows get equal spans; overlapping base spans of two kinds are both
reported, and replaced once in texts; a term within a base span is no span of its own; patterns are written without
unbounded recursion or backtracking, so that very long runs of one character are safe; other columns pass through
`sanitised` untouched, and clashing names of helpers are avoided.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import cut, fresh_name, text_of, words
from episodica.llm.rules import let

KINDS = ("email", "ip", "card", "phone")
TERM = r"[\p{L}\p{M}\p{N}]++"
DISCLOSURE, SURE = 0.9, 0.5
Z = 1.645
# Words in a shingle of a text's sketch.
SHINGLE = 8

LABEL = r"\.[A-Za-z0-9-]++"
# A chain of labels of any length, matched in atomic groups within atomic groups: no deep recursion.
LABELS = rf"(?>(?>(?:{LABEL}){{1,200}}){{1,200}}){{1,200}}"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++{LABELS}",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPANS = "array<struct<start: int, end: int, value: string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    at = F.sequence(F.lit(1), F.length(number))

    def weighed(i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        return F.when((F.length(number) - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(at, weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: str, keep) -> Column:
    """Spans of the matches of a pattern that keep() accepts; offsets in code points."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def add(state: Column, x: Column) -> Column:
        a = state["at"] + F.length(x["gap"])
        b = a + F.length(x["value"])
        span = F.array(F.struct(a.alias("start"), b.alias("end"), x["value"].alias("value")))
        return F.struct(b.alias("at"), F.when(keep(x["value"]), F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    def walk(m: Column) -> Column:
        pairs = F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
        return F.aggregate(pairs, start, add, lambda s: s["out"])

    return let(matches, lambda m: F.when(F.size(m) > 0, walk(m)).otherwise(F.array().cast(SPANS)))


def base_spans(text: Column) -> Column:
    """A struct with an array of spans for each kind of entity."""
    likely = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.contains("+")}
    none = F.array().cast(SPANS)
    return F.struct(*[F.when(likely[k], located(text, PATTERNS[k], accept(k))).otherwise(none).alias(k) for k in KINDS])


def accept(kind: str):
    return lambda value: passes(kind, value)


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def in_order(spans: Column) -> Column:
    """All base spans of a text as (start, end)."""
    return F.array_sort(F.concat(*[F.transform(spans[k], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]))


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of its base spans; nothing else moves."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, s: Column) -> Column:
        a, b = F.greatest(s["start"], state["at"]), F.greatest(s["end"], state["at"])
        parts = F.array(F.substring(text, state["at"] + 1, a - state["at"]), F.repeat(F.lit(" "), b - a))
        return F.struct(b.alias("at"), F.concat(state["out"], parts).alias("out"))

    def join(state: Column) -> Column:
        return F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    return let(in_order(spans), lambda o: F.when(F.size(o) > 0, F.aggregate(o, start, add, join)).otherwise(text))


def tagged(kind: str):
    def named(s: Column) -> Column:
        value = digits(s["value"]) if kind in ("card", "phone") else F.lower(s["value"])
        return F.struct(F.lit(kind).alias("kind"), value.alias("entity"))

    return named


def sketch(text: Column) -> Column:
    """The least and the greatest hash of a text's shingles, which near copies seldom change both."""

    def ends(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1)))
        return let(F.transform(at, lambda i: F.xxhash64(F.slice(w, i, SHINGLE))), lambda h: F.struct(F.array_min(h).alias("least"), F.array_max(h).alias("most")))

    return let(words(text), ends)


def different_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, terms, entities, sketch): a row for each different text; its MD5, terms and entities once each, sketch if it has any."""
    text = text_of(text_col)
    t = docs.select(text.alias("t"), F.md5(text.cast("binary")).alias("key")).withColumn("b", base_spans(F.col("t")))
    named = F.array_distinct(F.concat(*[F.transform(f"b.{k}", tagged(k)) for k in KINDS]))
    # Terms hold no blanks; one string of them takes less room in the exchange than an array.
    t = t.select("key", F.array_join(terms_of(blanked(F.col("t"), F.col("b"))), " ").alias("terms"), named.alias("entities"), "t")
    t = t.select("key", F.struct("terms", "entities", F.when(F.size("entities") > 0, sketch(F.col("t"))).alias("sketch")).alias("x"))
    one = t.groupBy("key").agg(F.first("x").alias("x"))
    return cut(one.select("key", F.filter(F.split("x.terms", " "), lambda w: w != "").alias("terms"), "x.entities", "x.sketch"), "texts")


def lower_limit(n: Column) -> Column:
    """The lower confidence limit of a Poisson mean after n events, by Wilson and Hilferty; 0 for none."""
    return F.when(n > 0, n * F.pow(F.greatest(1 - 1 / (9 * n) - Z / (3 * F.sqrt(n)), F.lit(0.0)), F.lit(3.0))).otherwise(0.0)


def revealing(texts: DataFrame, disclosure: float = DISCLOSURE, sure: float = SURE) -> DataFrame:
    """(term, label) for rows of different_texts."""
    n = float(texts.count())
    held = texts.filter(F.size("entities") > 0).select("key", F.explode("entities").alias("e")).select("key", "e.*")
    entities = held.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n_entity")).filter((F.col("n_entity") > 1) & (F.col("n_entity") < n))
    # A share of DISCLOSURE needs n(t) <= n(t, c) (N / n(c)) ** (1 - DISCLOSURE), and n(t, c) is n(c) at most.
    most = F.pow(F.col("n_entity"), F.lit(disclosure)) * F.pow(F.lit(max(n, 1.0)), F.lit(1 - disclosure)) + 1e-6
    entities = cut(entities.withColumn("most", most), "entities")
    widest = entities.agg(F.max("most")).collect()[0][0]
    if widest is None:
        return texts.sparkSession.createDataFrame([], "term string, label string")
    # The entities of a text that can be told by anything, and its terms that are rare enough to tell one of them.
    of_text = held.join(entities, ["kind", "entity"]).groupBy("key").agg(F.collect_list(F.struct("kind", "entity", "n_entity", "most")).alias("held"))
    of_text = cut(of_text, "held")
    counts = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    rare = cut(counts.filter((F.col("n_term") > 1) & (F.col("n_term") <= widest)), "rare")
    near = texts.join(of_text, "key").select("sketch", "held", F.explode("terms").alias("term")).join(rare, "term")
    near = near.withColumn("held", F.filter("held", lambda e: e["most"] >= F.col("n_term"))).filter(F.size("held") > 0)
    pairs = near.select("term", "n_term", "sketch", F.explode("held").alias("e")).groupBy("term", "n_term", "e.kind", "e.entity", "e.n_entity", "sketch")
    pairs = pairs.agg(F.count(F.lit(1)).alias("m")).groupBy("term", "n_term", "kind", "entity", "n_entity")
    pairs = pairs.agg(F.sum("m").alias("n_both"), F.count_distinct("sketch.least").alias("least"), F.count_distinct("sketch.most").alias("most"))
    told = F.log2(F.col("n_both") * F.lit(n) / (F.col("n_term") * F.col("n_entity")))
    whole = F.log2(F.lit(n) / F.col("n_entity"))
    others = F.least("least", "most") - 1
    certain = F.when(lower_limit(others) > 0, told + F.log2(lower_limit(others) / others))
    found = pairs.filter((told >= disclosure * whole) & (certain >= sure * whole))
    label = F.when(F.col("n_term") <= F.col("n_both"), F.lit("")).otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit(" DETAIL]")))
    return cut(found.groupBy("term").agg(F.min(label).alias("label")), "revealing")


def revealing_terms(docs: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE, sure: float = SURE) -> DataFrame:
    """(term, label): terms to replace, and by what. A term that reveals several entities takes the first label."""
    return revealing(different_texts(docs, text_col), disclosure, sure)


def with_spans(docs: DataFrame, out: str, text_col: str = "text") -> DataFrame:
    """docs with a struct column: the base kinds' spans, and `term`, spans with the label as their value."""
    texts = different_texts(docs, text_col)
    key, mine = fresh_name(docs, "pii_key"), fresh_name(docs, "pii_terms")
    hits = texts.select(F.col("key").alias(key), F.explode("terms").alias("term")).join(revealing(texts), "term")
    hits = cut(hits.groupBy(key).agg(F.collect_set(F.struct("term", "label")).alias(mine)), "term_hits")
    text = text_of(text_col)
    rows = docs.join(hits, F.md5(text.cast("binary")) == F.col(key), "left").withColumn(out, base_spans(text))
    known = F.transform(mine, lambda x: x["term"])

    def labelled(s: Column) -> Column:
        label = F.filter(F.col(mine), lambda x: x["term"] == F.lower(s["value"]))[0]["label"]
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), label.alias("value"))

    free = let(blanked(text, F.col(out)), lambda t: located(t, TERM, lambda v: F.array_contains(known, F.lower(v))))
    term = F.when(F.col(mine).isNotNull(), F.transform(free, labelled)).otherwise(F.array().cast(SPANS))
    return rows.withColumn(out, F.struct(*[F.col(f"{out}.{k}").alias(k) for k in KINDS], term.alias("term"))).drop(key, mine)


def written(spans: Column, kind: str) -> Column:
    return F.transform(spans[kind], lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts by kind, base_sha256, spans) for every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = with_spans(docs, "found")
    found = F.col("found")
    base = F.concat(*[written(found, k) for k in KINDS])
    sha = F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256")
    spans = F.array_join(F.concat(base, written(found, "term")), ",").alias("spans")
    return rows.select("doc_id", *[F.size(found[k]).cast("long").alias(f"n_{k}") for k in KINDS], sha, spans)


def replaced(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the label of the first."""
    kinds = [F.transform(spans[k], lambda_label(k)) for k in (*KINDS, "term")]
    ordered = F.array_sort(F.concat(*kinds))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, s: Column) -> Column:
        parts = F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), s["label"])
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], parts)).otherwise(state["out"])
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), out.alias("out"))

    def join(state: Column) -> Column:
        return F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    return let(ordered, lambda o: F.when(F.size(o) > 0, F.aggregate(o, start, add, join)).otherwise(text))


def lambda_label(kind: str):
    label = (lambda s: s["value"]) if kind == "term" else (lambda s: F.lit(f"[{kind.upper()}]"))
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"))


def sanitised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data and revealing terms replaced in their texts; a null text stays null."""
    out = fresh_name(docs, "pii_spans")
    rows = with_spans(docs, out, text_col)
    return rows.withColumn(text_col, replaced(F.col(text_col), F.col(out))).select(*docs.columns)
