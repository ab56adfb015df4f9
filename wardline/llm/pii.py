"""Personal data: spans of four base kinds, and terms that reveal them.

Base spans come from regular expressions. A protected entity is a value found by them. Following information-theoretic
sanitisation, document counts of the whole corpus tell how strongly a term that shares documents with an entity reveals
it: pointwise mutual information of the two against the entity's information content. With n documents, of which n_e have
the entity, n_t the term and n_both the two, a term discloses the entity if

    log2(n_both n / (n_e (n_t + SMOOTHING))) >= log2(n / n_e) / ALPHA

and the two don't share documents by chance. Of the V words that n_t documents have, were they dealt at random, no more than

    V (n_e / n)^n_both, times (e n_t / n_both)^n_both where n_both is less than n_t

would be expected in as many of the entity's documents; a term counts only if this is CHANCE or less. So evidence grows with each
shared document, and what one document is worth depends on the corpus: where every document has words of its own, a
word seen once says nothing about an address beside it; where hardly any has, it does. SMOOTHING is what a count is
short of certainty. A term is a word of TERM_CHARS letters or more, anywhere in the document outside base spans. Each of its occurrences in a
document of an entity that it discloses is a span of kind ``term``. Where it stands in documents of that entity only, it is
removed; else it is generalised: cut to its longest prefix that some word has whose documents are too many to disclose
any entity of the document, or removed if there is none.

Only DataFrame functions are used. Entities of the same documents have the same counts, so they are one class, and pairs are
those of a document's classes and of its terms that are rare enough to disclose the commonest of them. All counts are
summed map-side. Texts are read for base spans and terms, for the documents of every word, and, where a document has
spans of terms, for their places. Patterns take linear time on any text: runs are possessive and entered at their first
character only.

Defined cases: a null text is empty; each row counts as a document, repeated ones too; a null doc_id is an id of its own; offsets
are code points, ends exclusive; extra columns are ignored by ``digest`` and kept by ``sanitised``; no input rows give no
output rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.exprs import let, matches, prefix_maxima
from wardline.llm.sieve import sifted
from wardline.llm.storage import carried, staged

KINDS = ("email", "ip", "card", "phone", "term")
ALPHA, SMOOTHING, CHANCE, TERM_CHARS = 1.1, 0.5, 0.5, 4
NULL_ID = -(2**63)

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: A local part starts where no local character stands before, or right after the match before.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A whole word: no letter before it, and neither side cut by a span, which is blanked to CUT.
CUT = "\x00"
WORD = rf"(?<![\p{{L}}\x00])\p{{L}}{{{TERM_CHARS},}}+(?!\x00)"

KEYS = ["__id", "__text"]
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.char_length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), let(_digits(value), luhn)).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """What makes two matches the same entity."""
    return F.concat(F.lit(f"{kind}:"), {"email": F.lower(value), "ip": value}.get(kind, _digits(value)))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds in order of start, then kind; the value names the entity."""

    def of(k: int, kind: str, pattern: str, needs: str) -> Column:
        good = F.filter(matches(text, pattern), lambda m: _valid(kind, m["value"]))
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), _entity(kind, m["value"]).alias("value"))).cast(SPAN)
        return F.when(text.rlike(needs), spans).otherwise(F.array().cast(SPAN))

    kinds = ((0, "email", EMAIL, "@"), (1, "ip", IP, r"[0-9]\.[0-9]"), (2, "card", CARD, r"[0-9][\x20-]?[0-9]"), (3, "phone", PHONE, r"\+[0-9]"))
    return F.array_sort(F.concat(*(of(*k) for k in kinds)))


def pieces(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with each run of overlapping spans written as the mark of its first span. spans: in order of start."""
    ends = prefix_maxima(F.transform(spans, lambda s: s["end"]))

    def rewritten(reach: Column) -> Column:
        # a span begins a run if none before it reaches over its start; text goes on where the run's longest reach ends
        begins = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: F.get(spans, i)["start"] >= F.get(reach, i))

        def joined(runs: Column) -> Column:
            gap = lambda i, r: F.substr(text, F.get(reach, r) + 1, F.get(spans, r)["start"] - F.get(reach, r))
            parts = F.flatten(F.transform(runs, lambda r, i: F.array(gap(i, r), mark(F.get(spans, r)))))
            return F.array_join(F.concat(parts, F.array(F.substr(text, F.element_at(reach, -1) + 1, F.char_length(text)))), "")

        return let(begins, joined)

    return F.when(F.size(spans) == 0, text).otherwise(let(ends, rewritten))


def _words(text: Column) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def plain(text: Column) -> Column:
    """The text that spans and words are looked for in: none is null, and instead of CUT it has another control character."""
    return F.translate(F.coalesce(text, F.lit("")), CUT, "\x01")


def keys() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text")]


def detected(docs: DataFrame) -> DataFrame:
    """A number, keys, doc_id, base spans and, where there are any, distinct terms of each row."""
    rows = docs.select("doc_id", *keys(), plain(F.col("text")).alias("text"))
    spans = rows.withColumn("spans", base_spans(F.col("text")))
    terms = F.when(F.size("spans") > 0, _words(pieces(F.col("text"), F.col("spans"), lambda s: F.lit(CUT))))
    return staged(spans.select(F.monotonically_increasing_id().alias("row"), "doc_id", *KEYS, "spans", terms.alias("terms")), "pii")


def _bound(n_entity: Column, n: int) -> Column:
    """A term in all of the entity's documents discloses it only if the term's documents are no more than this."""
    return n_entity * F.pow(F.lit(float(n)) / n_entity, F.lit(1 - 1 / ALPHA)) - SMOOTHING


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(row, term, full, written): what each row's terms over the threshold become; full if one of its entities is in all of
    the term's documents."""
    n = found.count()
    rows = found.where(F.size("spans") > 0)
    held = rows.select("row", F.explode(F.array_distinct("spans.value")).alias("entity"))
    hashed = F.xxhash64("row")
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity"), F.bit_xor(hashed).alias("x"), F.sum(F.pmod(hashed, F.lit(1 << 31))).alias("s"))
    classes = staged(entities.where(F.col("n_entity") < n).select("entity", "n_entity", F.xxhash64("n_entity", "x", "s").alias("class")), "entities")
    kind = F.collect_set(F.struct("class", "n_entity")).alias("classes")
    own = held.join(classes, "entity").groupBy("row").agg(kind, F.max("n_entity").alias("most"))
    words = docs.select(F.explode(_words(plain(F.col("text")))).alias("term"))
    vocabulary = staged(words.groupBy("term").agg(F.count("*").alias("n_term")), "vocabulary")
    alike = staged(vocabulary.groupBy("n_term").agg(F.count("*").alias("n_words")), "words-by-documents")
    near = rows.join(own, "row").select("row", "classes", "most", F.explode("terms").alias("term")).join(vocabulary, "term")
    rare = staged(near.where(F.col("n_term") <= _bound(F.col("most"), n) * (1 + 1e-9)).select("row", "classes", "term", "n_term"), "rare-terms")
    pairs = rare.select("row", F.explode("classes").alias("c"), "term", "n_term").select("row", "c.*", "term", "n_term")
    counted = pairs.groupBy("class", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    share = F.log2(F.col("n_both") * n / (F.col("n_entity") * (F.col("n_term") + SMOOTHING)))
    over = counted.where(share >= F.log2(F.lit(n) / F.col("n_entity")) / ALPHA - 1e-9).join(alike, "n_term")
    choices = F.when(F.col("n_both") < F.col("n_term"), math.e * F.col("n_term") / F.col("n_both")).otherwise(F.lit(1.0))
    by_chance = F.col("n_words") * F.pow(F.col("n_entity") / n * choices, "n_both")
    over = over.where(by_chance <= CHANCE * (1 + 1e-9))
    judged = staged(over.select("class", "term", (F.col("n_both") == F.col("n_term")).alias("full")), "disclosing")
    hits = pairs.join(judged, ["class", "term"]).groupBy("row", "term").agg(F.bool_or("full").alias("full"))
    # all entities of a row are safe from a prefix that the commonest is safe from
    partly = hits.where("NOT full").join(own.select("row", _bound(F.col("most"), n).alias("bound")), "row")
    cut = lambda: F.explode(F.transform(F.sequence(F.lit(2), F.char_length("term") - 1), lambda k: F.substr(F.col("term"), F.lit(1), k))).alias("prefix")
    wanted = staged(partly.select("row", "term", "bound", cut()), "prefixes")
    # only words of more documents than the least bound can make a prefix safe, and of their prefixes only wanted ones move
    least = wanted.agg(F.min("bound")).collect()[0][0]
    safe = vocabulary.where(F.col("n_term") > (math.inf if least is None else least)).select("n_term", cut())
    usual = sifted(safe, wanted.select("prefix"), ["prefix"])[0].groupBy("prefix").agg(F.max("n_term").alias("usual"))
    general = wanted.join(usual, "prefix").where(F.col("usual") > F.col("bound")).groupBy("row", "term").agg(F.max(F.struct(F.char_length("prefix").alias("size"), "prefix")).alias("best"))
    return hits.join(general, ["row", "term"], "left").select("row", "term", "full", F.coalesce(F.concat("best.prefix", F.lit("*")), F.lit("")).alias("written"))


def all_spans(docs: DataFrame) -> DataFrame:
    """Keys, doc_id and spans of each row, terms included, with value: the entity, or what the term becomes."""
    found = detected(docs)
    hits = disclosing(docs, found).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "written"))).alias("hits"))
    touched = staged(found.join(hits, "row").select(*KEYS, "spans", "hits").dropDuplicates(KEYS), "touched")
    texts, _ = sifted(docs.select(*keys(), plain(F.col("text")).alias("text")), touched, KEYS)
    texts = texts.join(touched.hint("merge"), KEYS)
    apart = lambda m: ~F.exists("spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
    places = F.filter(matches(F.col("text"), WORD), lambda m: F.map_contains_key("hits", F.lower(m["value"])) & apart(m))
    added = F.transform(places, lambda m: F.struct(m["start"].alias("start"), F.lit(4).alias("kind"), m["end"].alias("end"), F.element_at("hits", F.lower(m["value"])).alias("value"))).cast(SPAN)
    both = staged(texts.select(*KEYS, F.array_sort(F.concat("spans", added)).alias("all_spans")).dropDuplicates(KEYS), "term-spans")
    return found.join(both, KEYS, "left").select("doc_id", *KEYS, "spans", F.coalesce("all_spans", "spans").alias("all_spans"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return all_spans(docs).select("doc_id", *map(count, range(4)), F.sha2(_written(F.col("spans")), 256).alias("base_sha256"), _written(F.col("all_spans")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with ``clean_text``: each run of overlapping spans written as its first kind's mark, terms as what they become."""
    return carried(docs.drop("clean_text"), _sanitised)


def _sanitised(docs: DataFrame) -> DataFrame:
    marks = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS[:4]))
    mark = lambda s: F.when(s["kind"] == 4, s["value"]).otherwise(F.get(marks, s["kind"]))
    found = staged(all_spans(docs).where(F.size("all_spans") > 0).select(*KEYS, F.col("all_spans").alias("__spans")).dropDuplicates(KEYS), "spans")
    perhaps, clean = sifted(docs.withColumns(dict(zip(KEYS, keys(), strict=True))), found, KEYS)
    text = F.coalesce("text", F.lit(""))
    hit = perhaps.join(found.hint("merge"), KEYS, "left").withColumn("__spans", F.coalesce("__spans", F.array().cast(SPAN)))
    written = hit.withColumn("clean_text", pieces(text, F.col("__spans"), mark)).drop("__spans")
    return written.unionByName(clean.withColumn("clean_text", text)).drop(*KEYS)
