"""Personal data, and the words near it that would give it away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.llm.native import let, once, sums_before, total
from landgrid.llm.shared import numbered, renamed, shared_path, text_key, written
from landgrid.session import scratch

#: Kinds in their order. The patterns match what the published ones match, leftmost and
#: without overlap, but never try a run of characters twice, which keeps long runs linear: a
#: run is taken whole (++), and an e-mail begins where its run begins or the last match ended.
#: Cards need twelve digits and so ask for them at once.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match must contain.
_HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "general": "[TERM]", "removed": ""}
#: Characters before and after a match in which words are counted as its company.
CONTEXT = 100
TERM = r"[\p{L}\p{N}]{3,}"
#: Standard errors of the lower confidence bound (95 %) of a word's share.
CONFIDENCE = 1.96
#: Shares of a datum's information that a word may give: from the first on it is generalised, from the second removed.
GENERALISE, REMOVE = 0.75, 0.95
#: Revealing words of a datum up to which all of them are looked for in each of its texts.
FEW_TERMS = 64
_SPAN = "struct<start:bigint,place:int,end:bigint,kind:string>"


def _luhn(digits: Column) -> Column:
    def value(k: Column) -> Column:
        x = F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return (x - F.when(x > 9, 9).otherwise(0)).cast("bigint")

    return total(F.transform(F.sequence(F.lit(1), F.length(digits)), value)) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """Whether a match counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    return let(F.regexp_replace(match, "[^0-9]", ""), lambda d: (F.length(d).between(12, 19) & _luhn(d)) if kind == "card" else F.length(d).between(9, 15))


def matches(text: Column, pattern: str) -> Column:
    """(match, start, end) of every leftmost match, in code points, end exclusive."""

    def placed(found: Column, between: Column) -> Column:
        lengths = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(m).cast("bigint").alias("own"), F.length(g).cast("bigint").alias("gap"), m.alias("match")))
        return let(lengths, lambda rows: F.zip_with(rows, sums_before(F.transform(rows, lambda r: r["own"] + r["gap"])), lambda r, b: F.struct(
            r["match"].alias("match"), (b + r["gap"]).alias("start"), (b + r["gap"] + r["own"]).alias("end"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda between: placed(found, between)))


def base_spans(text: Column) -> Column:
    """(start, place, end, kind, datum) of all personal data, by start and kind."""

    def of(place: int, kind: str) -> Column:
        rows = F.transform(F.filter(matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["match"])), lambda m: F.struct(
            m["start"].alias("start"), F.lit(place).alias("place"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lower(m["match"]).alias("datum")))
        none = F.expr("cast(array() as array<struct<start:bigint,place:int,end:bigint,kind:string,datum:string>>)")
        return F.when(text.rlike(_HINTS[kind]), rows).otherwise(none)

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def _company(text: Column, spans: Column) -> Column:
    """(datum, term, start, end): whole words within ``CONTEXT`` characters of each datum and outside all data."""

    def near(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
        part = F.substring(text, (begin + 1).cast("int"), (s["end"] + CONTEXT - begin).cast("int"))
        last = begin + F.length(part)
        words = let(begin, lambda b: F.transform(matches(part, TERM), lambda m: F.struct(
            s["datum"].alias("datum"), F.lower(m["match"]).alias("term"), (b + m["start"]).alias("start"), (b + m["end"]).alias("end"))))
        # A word at the border of the part may go on beyond it.
        whole = F.filter(words, lambda w: ((w["start"] > begin) | (begin == 0)) & ((w["end"] < last) | (last < s["end"] + CONTEXT)))
        return F.filter(whole, lambda w: ~F.exists(spans, lambda x: (w["start"] < x["end"]) & (w["end"] > x["start"])))

    return F.array_distinct(F.flatten(F.transform(spans, near)))


def lower_bound(hits: Column, of: Column) -> Column:
    """Wilson's lower confidence bound of a share of which ``hits`` in ``of`` were seen."""
    p, z = hits / of, CONFIDENCE**2
    return (p + z / (2 * of) - CONFIDENCE * F.sqrt(p * (1 - p) / of + z / (4 * of * of))) / (1 + z / of)


def _revealing(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(datum, term, kind) of the words that give too much of a datum away; ``rows`` has each text with data once.

    With counts n of distinct texts, the pointwise mutual information of word and datum is
    log(n(both) N / n(word) n(datum)), and the datum's information log(N / n(datum)). The word's
    share of it is 1 - log(1 / P) / log(N / n(datum)) with P = n(both) / n(word), so a lower
    confidence bound of P gives one of the share.
    """
    source = docs[text_col].cast("string")
    texts = docs.select(text_key(source).alias("copy"), F.coalesce(source, F.lit("")).alias("text")).dropDuplicates(["copy"])
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    # Counted before the join, so that a task sends each of its words once; '' stands for all texts.
    terms = written(texts.select(F.explode(F.concat(F.array(F.lit("")), words)).alias("term")).groupBy("term").agg(F.count("*").alias("of_term")))
    every = terms.where("term = ''").agg(F.coalesce(F.max("of_term"), F.lit(0))).first()[0]
    data = rows.select(F.explode(F.array_distinct(F.transform("spans", lambda s: s["datum"]))).alias("datum")).groupBy("datum").agg(F.count("*").alias("own"))
    pairs = rows.select(F.explode(F.array_distinct(F.transform("company", lambda c: F.struct(c["datum"].alias("datum"), c["term"].alias("term"))))).alias("p"))
    pairs = pairs.groupBy("p.datum", "p.term").agg(F.count("*").alias("both"))
    told = pairs.join(data, "datum").join(terms, "term").where(F.col("own") < every)

    def share(p: Column) -> Column:
        return 1 + F.log(p) / F.log(F.lit(every) / F.col("own"))

    sure = share(lower_bound(F.col("both"), F.col("of_term"))) >= GENERALISE
    return told.where(sure).select("datum", "term", F.when(share(F.col("both") / F.col("of_term")) >= REMOVE, "removed").otherwise("general").alias("kind"))


def _to_mark(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(_more_copy, _general, _removed): for each distinct text with data the words to mark in it.

    A datum of up to ``FEW_TERMS`` words brings them all to its texts. A datum of more is
    joined on the words that a text has, so that a datum which many texts hold, each with
    words of its own near it, does not bring all of these words to all of these texts.
    """
    rows = written(rows.where("size(_f.spans) > 0 and _place >= 0").select("copy", "_f.spans", F.transform("_f.company", lambda c: F.struct(c["datum"].alias("datum"), c["term"].alias("term"))).alias("company")).dropDuplicates(["copy"]))
    told = written(_revealing(rows, docs, text_col))
    held = rows.select("copy", F.explode(F.array_distinct(F.transform("spans", lambda s: s["datum"]))).alias("datum"))
    many = told.groupBy("datum").agg(F.count("*").alias("terms")).where(F.col("terms") > FEW_TERMS).select("datum")
    more = held.join(told.join(many, "datum", "left_anti"), "datum").select("copy", "term", "kind")
    hot = written(held.join(many, "datum", "left_semi"))
    source = docs[text_col].cast("string")
    copies = docs.select(text_key(source).alias("copy"), source.alias("text")).join(hot.select("copy").distinct(), "copy", "left_semi").dropDuplicates(["copy"])
    words = copies.select("copy", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    hit = words.join(hot, "copy").join(told.join(many, "datum", "left_semi"), ["datum", "term"])
    more = more.unionByName(hit.select("copy", "term", "kind")).groupBy("copy", "term").agg(F.max("kind").alias("kind"))
    more = more.groupBy("copy").agg(*[F.collect_list(F.when(F.col("kind") == kind, F.col("term"))).alias(f"_{kind}") for kind in ("general", "removed")])
    return more.withColumnRenamed("copy", "_more_copy")


def found(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``_spans``: personal data and revealing words of each whole text.

    Data are e-mails, IPv4 addresses, card numbers (Luhn) and phone numbers. How strongly a
    nearby word reveals a datum is estimated from their co-occurrence in all distinct texts, as
    the share of the datum's information that the word gives. Every pair is judged: where the
    share's lower confidence bound reaches ``GENERALISE`` the word is marked to be generalised,
    or to be removed if the share itself reaches ``REMOVE``, everywhere in the texts that hold
    that datum, as a whole word and outside of data. So a word seen once, with a datum seen
    once, is marked if there are enough other texts (549) to make that telling. Texts without
    personal data are never touched. Spans are (kind, start, end) in code points, end exclusive,
    by start, then kind.

    Null and empty texts have no spans. Repeated rows are marked alike; copies of a text count
    as one. Columns of ``keep`` pass unchanged, but one named ``_spans`` is left out. An empty
    table gives an empty result.
    """
    own = [c for c in keep if c != "_spans"]
    source = docs[text_col].cast("string")
    text, copy = F.coalesce(source, F.lit("")), text_key(source)
    # Texts with data, which are few, with the words around; the others are counted.
    rows = once(docs.select(copy.alias("copy"), let(text, lambda t: let(base_spans(t), lambda s: F.struct(s.alias("spans"), F.when(F.size(s) > 0, _company(t, s)).alias("company")))).alias("_f")))
    path = shared_path(docs.sparkSession, "revealing")
    with scratch(docs.sparkSession):  # the tables in between go when the words to mark are written
        _to_mark(rows, docs, text_col).write.parquet(path)
    more = docs.sparkSession.read.parquet(path)

    def marked(t: Column, spans: Column) -> Column:
        terms = F.concat("_general", "_removed")
        hits = F.filter(matches(t, TERM), lambda m: F.array_contains(terms, F.lower(m["match"])))
        free = F.filter(hits, lambda m: ~F.exists(spans, lambda x: (m["start"] < x["end"]) & (m["end"] > x["start"])))

        def span(m: Column) -> Column:
            gone = F.array_contains("_removed", F.lower(m["match"]))
            place = F.when(gone, len(KINDS) + 1).otherwise(len(KINDS)).cast("int")
            return F.struct(m["start"].alias("start"), place.alias("place"), m["end"].alias("end"), F.when(gone, "removed").otherwise("general").alias("kind"))

        return F.when(F.col("_more_copy").isNotNull(), F.transform(free, span)).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))

    def plain(spans: Column, t: Column) -> Column:
        base = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
        every = F.array_sort(F.concat(base, marked(t, spans)))
        return F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    out = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)], copy.alias("_copy"), let(text, base_spans).alias("_base"), text.alias("_text"))
    if text_col in own:  # passes anyway
        whole = F.coalesce(F.col(f"c{own.index(text_col)}").cast("string"), F.lit(""))
        out = out.drop("_text")
    else:
        out, whole = out.withColumn("_text", F.when(F.size("_base") > 0, F.col("_text"))), F.col("_text")
    out = out.join(more, F.col("_copy") == F.col("_more_copy"), "left")
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(own)], plain(F.col("_base"), whole).alias("_spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind's mask; of overlapping spans, by that of the first."""

    def disjoint() -> Column:
        empty = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)")

        def step(out: Column, s: Column) -> Column:
            last = F.element_at(out, -1)
            grown = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
            return F.when((F.size(out) > 0) & (s["start"] < F.get(out, F.size(out) - 1)["end"]), grown).otherwise(F.concat(out, F.array(s)))

        return F.aggregate(spans, empty, step)

    def rebuilt(d: Column) -> Column:
        masks = F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair])

        def piece(s: Column, k: Column) -> Column:
            begin = F.when(k > 0, F.get(d, k - 1)["end"]).otherwise(F.lit(0))
            return F.concat(F.substring(text, (begin + 1).cast("int"), (s["start"] - begin).cast("int")), masks[s["kind"]])

        tail = F.substring(text, (F.element_at(d, -1)["end"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(d, piece), ""), tail)

    return F.when(F.size(spans) > 0, let(disjoint(), rebuilt)).otherwise(text)


def sanitised(docs: DataFrame, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """``docs`` with its texts masked; ``size_col``, if there, gets the new number of characters.

    Null texts stay null, empty ones empty; repeated rows are masked alike. Columns may have
    any name. An empty table stays empty.
    """
    plain, names = numbered(docs)
    text = f"n{names.index(text_col)}"
    rows = found(plain, plain.columns, text)
    rows = rows.withColumn(text, masked(F.col(text), F.col("_spans")))
    if size_col in names:
        rows = rows.withColumn(f"n{names.index(size_col)}", F.length(text).cast(docs.schema[size_col].dataType))
    return renamed(rows, names)
