"""Personal data by patterns and by information-theoretic sanitisation (DataFrame functions only).

Patterns find emails, IPv4 addresses, cards and phone numbers. Each different value found is a
protected entity. A term may give the entity away even when the mention is gone: the corpus tells
how much. With df(t), df(e) and df(e, t) the numbers of documents that hold the term, the entity,
and both, the pointwise mutual information PMI(e; t) = log2(N df(e, t) / (df(e) df(t))) is the part
of the entity's information IC(e) = log2(N / df(e)) that the term reveals. Terms whose share
reaches the disclosure threshold, seen with the entity in least_support documents, are found too,
as kind ``term``, wherever they stand: all over the entity's documents and in those without it.
Sanitising replaces entities by their kind and such terms by a general one, or removes them.

A null text counts as empty. Documents without an entity are left as they are. Rows that repeat
a doc_id are kept apart by a hash of their text. An empty table gives an empty result; columns
other than id and text are not read, but for those that sanitised() passes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.shared import free_names, written

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the fixed patterns: they match the same, in linear time, from a run's start or the last match's end.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match; saves the search elsewhere.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: A term: a whole word of two letters or more, in lower case.
TERM = r"[\p{L}]{2,}+"
LEAST_SUPPORT, DISCLOSURE = 3, 0.8
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
#: Bits of the sieve that most words fall through before they meet the telling terms.
SIEVE = 1 << 20
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    digits = F.regexp_replace(value, r"[^0-9]", "")
    size = F.length(digits)
    return F.when(size.between(13, 19), F.call_function("luhn_check", digits)).otherwise(False) if kind == "card" else size.between(9, 15)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks_of(items: Column) -> Column:
    """An array in blocks of the root of its length: what is appended to in each, and over all, stays short."""

    def cut(x: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(x))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda k: F.slice(x, k * size + 1, size))

    return let(items, lambda x: F.when(F.size(x) > 0, cut(x)))


def walked(text: Column, pattern: str, hit: Callable[[Column], Column]) -> Column:
    """array<struct<start, end, value>> of the pattern's matches that are hits, in code points, from the pieces between all matches.

    Only hits are kept. Places are added up within blocks and then over them, so the work grows
    little faster than the number of matches.
    """
    spans = "array<struct<start:bigint,end:bigint,value:string>>"
    state = f"struct<at:bigint,out:{spans}>"
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans).alias("out")).cast(state)

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + F.length(m["value"])
        span = F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(hit(m["value"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")).cast(state)

    def shifted(blocks: Column) -> Column:
        begins = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        move = F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), lambda b, by: F.transform(b["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"))))
        return F.flatten(move)

    def matches(values: Column) -> Column:
        pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
        return F.zip_with(values, F.slice(pieces, F.lit(1), F.size(values)), lambda v, p: F.struct(v.alias("value"), p.alias("gap")))

    def found(values: Column) -> Column:
        done = F.transform(blocks_of(matches(values)), lambda b: F.aggregate(b, first, step))
        return F.when(F.size(values) > 0, let(done, shifted))

    return F.coalesce(let(F.regexp_extract_all(text, F.lit(pattern), 0), found), F.array().cast(spans))


def _found(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, value>> of one pattern's valid matches."""
    spans = F.transform(walked(text, PATTERNS[kind], lambda v: _valid(kind, v)), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    possible = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(r"[0-9][\x20-]?[0-9]")
    return F.when(possible, spans).otherwise(F.array().cast(SPANS))


def spans(text: Column) -> Column:
    """All base spans of a whole text: array<struct<kind, start, end, value>> by kind, then start; code points, end exclusive."""
    return F.concat(*[_found(text, k) for k in KINDS])


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def joined(found: Column) -> Column:
    """kind:start:end of spans in their order, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def keyed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, same (hash of the text), text: rows that repeat a doc_id are told apart by their text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole).alias("same"), whole.alias("text"))


def detected(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, same, found (base spans) and, where there are any, own (the text's different terms)."""
    rows = keyed(docs, id_col, text).withColumn("found", spans(F.col("text")))
    return rows.select("doc_id", "same", "found", F.when(F.size("found") > 0, terms_of(F.col("text"))).alias("own"))


def terms_of(text: Column) -> Column:
    """The different terms of a whole text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), 0))


def term_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): number of documents that hold each term, over all documents; terms are made different in each and pre-aggregated before the shuffle."""
    return docs.select(F.explode(terms_of(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _on_document(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["same"] == right["same"])


def telling_terms(found: DataFrame, docs: DataFrame, id_col: str, text: str, least_support: int, disclosure: float) -> DataFrame:
    """(entity, term) where the term reveals at least the disclosure threshold's share of the entity.

    As df(e, t) is at most df(e), such a term is in at most N^(1 - d) df(e)^d documents: commoner
    ones are left out before terms meet entities, which drops no pair that could pass.
    """
    held = found.where(F.size("found") > 0).select("doc_id", "same", F.explode(F.array_distinct(F.transform("found", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))).alias("entity"))
    held = held.groupBy("doc_id", "same", "entity").agg(F.count("*").alias("rows"))
    entities = held.groupBy("entity").agg(F.sum("rows").alias("df_entity")).where(F.col("df_entity") >= least_support)
    held = written(held.join(entities, "entity"), "held")
    total, most = docs.count(), held.agg(F.max("df_entity")).first()[0]
    none = held.select("entity", F.col("entity").alias("term")).where("false")
    if not most:
        return none
    commonest = total ** (1 - disclosure) * most**disclosure
    terms = written(term_frequency(docs, text), "terms").where(F.col("df").between(least_support, commonest * (1 + 1e-9)))
    terms = written(terms, "rare-terms")
    words = found.where(F.size("found") > 0).select("doc_id", "same", F.explode("own").alias("term")).join(terms, "term").distinct()
    both = held.join(words, _on_document(held, words)).where(F.col("df") <= F.pow(F.lit(float(total)), F.lit(1 - disclosure)) * F.pow("df_entity", F.lit(disclosure)) * (1 + 1e-9))
    pairs = both.groupBy("entity", "term").agg(F.sum("rows").alias("df_both"), F.first("df").alias("df"), F.first("df_entity").alias("df_entity")).where(F.col("df_both") >= least_support)
    n = F.lit(float(total))
    information, pmi = F.log2(n / F.col("df_entity")), F.log2(n * F.col("df_both") / (F.col("df_entity") * F.col("df")))
    return written(pairs.where((information > 0) & (pmi >= disclosure * information)).select("entity", "term"), "telling")


def sieve(terms: DataFrame) -> DataFrame:
    """One row with column sieve: SIEVE bits, set where the hash of a term falls. Its size is fixed; what it lets through meets the terms themselves."""
    at = F.pmod(F.xxhash64("term"), F.lit(SIEVE))
    words = terms.select(F.shiftright(at, 6).alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("k").agg(F.bit_or("bit").alias("bits"))
    all_words = terms.sparkSession.range(SIEVE // 64).join(words, F.col("id") == F.col("k"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return all_words.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("sieve"))


def _passes(bits: Column, term: Column) -> Column:
    at = F.pmod(F.xxhash64(term), F.lit(SIEVE))
    return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def occurrences(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, same, start, end of every occurrence of the terms as whole words, in all documents.

    Texts stay where they are: their words pass the sieve or not, and the places of those that do
    are joined with the terms.
    """
    wanted = written(terms.select("term").distinct(), "wanted")
    rows = keyed(docs, id_col, text).crossJoin(F.broadcast(written(sieve(wanted), "sieve")))
    some = F.exists(terms_of(F.col("text")), lambda t: _passes(F.col("sieve"), t))
    places = F.when(some, walked(F.col("text"), TERM, lambda v: _passes(F.col("sieve"), F.lower(v))))
    met = rows.select("doc_id", "same", F.explode(places).alias("p")).select("doc_id", "same", F.lower("p.value").alias("term"), "p.start", "p.end")
    return met.join(wanted, "term").select("doc_id", "same", "start", "end").distinct()


def disclosing(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_support: int = LEAST_SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, same, start, end: terms that give an entity away, wherever they stand."""
    return occurrences(docs, telling_terms(found, docs, id_col, text, least_support, disclosure), id_col, text)


def all_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_support: int = LEAST_SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, same, found (base spans), terms (spans of kind ``term`` outside the base spans, by start)."""
    found = written(detected(docs, id_col, text), "pii")
    more = disclosing(found, docs, id_col, text, least_support, disclosure).groupBy("doc_id", "same").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("places"))
    both = found.select("doc_id", "same", "found").join(more, (found["doc_id"].eqNullSafe(more["doc_id"])) & (found["same"] == more["same"]), "left").select(found["doc_id"], found["same"], "found", "places")
    outside = F.filter(F.col("places"), lambda t: ~F.exists(F.col("found"), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    terms = F.transform(outside, lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), F.lit(None).cast("string").alias("value")))
    return both.select("doc_id", "same", "found", F.coalesce(terms, F.array().cast(SPANS)).alias("terms"))


#: Code points of a piece of text from which the gaps between spans are taken.
PIECE = 1_000


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text in pieces of PIECE."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    head = F.substring(F.get(pieces, first), (start % PIECE + 1).cast("int"), (end - start).cast("int"))
    tail = F.substring(F.get(pieces, last), F.lit(1), (end - last * PIECE).cast("int"))
    middle = F.when(last - first > 1, F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")).otherwise("")
    return F.when(end <= start, "").when(first == last, head).otherwise(F.concat(head, middle, tail))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text: str = "text", remove: bool = False, **how) -> DataFrame:
    """docs with text_clean: spans replaced by their general form, or removed. Of overlapping spans the one that starts first stands for all it touches."""
    own, same, found = free_names(docs, "_id", "_same", "_spans")
    spans_of = all_spans(docs, id_col, text, **how).select(F.col("doc_id").alias(own), F.col("same").alias(same), F.concat("found", "terms").alias(found)).dropDuplicates([own, same])
    whole = F.coalesce(F.col(text), F.lit(""))
    ordered = F.array_sort(F.transform(F.col(found), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    general = F.create_map(*[F.lit(x) for k, v in GENERAL.items() for x in (k, "" if remove else v)])
    state = "struct<at:bigint,out:array<string>>"

    def clean(pieces: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            new = F.struct((-s["back"]).alias("at"), F.concat(acc["out"], F.array(_between(pieces, acc["at"], s["start"]), general[s["kind"]])).alias("out")).cast(state)
            return F.when(s["start"] >= acc["at"], new).otherwise(F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), acc["out"].alias("out")).cast(state))

        def block(acc: Column, b: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
            return let(F.aggregate(b, start, step), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(d["out"], ""))).alias("out")).cast(state))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
        return F.aggregate(blocks_of(ordered), start, block, lambda acc: F.concat(F.array_join(acc["out"], ""), _between(pieces, acc["at"], F.length(whole).cast("long"))))

    made = F.when(F.size(found) > 0, let(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}"), 0), clean)).otherwise(whole)
    columns = [c for c in docs.columns if c != "text_clean"]
    return docs.join(spans_of, F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(whole) == F.col(same))).select(*columns, made.alias("text_clean"))
