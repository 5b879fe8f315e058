"""Quality rules: repetition counts and the divergence of a text from its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landgrid.llm.native import NOT_SPACES, let, once, total, words_of
from landgrid.llm.shared import numbered, renamed, written

#: Common words of four languages. Fixed values.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "at", "this", "are", "from"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "pas", "plus"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an"],
    "es": ["el", "y", "los", "se", "las", "por", "con", "no", "una", "su", "para", "al", "lo", "como", "más", "o", "pero", "sus", "si", "ya"],
}
_LIST = sorted({w for own in COMMON_WORDS.values() for w in own})
#: Words of a window that must not come twice, and the share of words in such windows that fails a text.
WINDOW = 8
#: Texts of fewer words are too short for a comparison of character classes, or of common words. From 100
#: words on, a text drawn word by word from its reference stays within ``MOST_WORDS`` by three standard
#: errors, with 20 common words that fall as 1 / rank and make up 35 % of the reference.
LEAST_WORDS, LEAST_COMMON = 60, 100
#: The same where the language has no reference of its own, and the mean of all languages stands in.
LEAST_MIXED = 250
#: Languages of fewer texts have no reference of their own.
LEAST_TEXTS = 30
#: Largest distances (0 to 1) of the histograms of character classes and of common words.
MOST_CLASSES, MOST_WORDS = 0.32, 0.28


def _repeated(hashes: Column) -> Column:
    """Words in windows that come twice or more."""

    def windows(h: Column) -> Column:
        every = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
        return F.slice(every, F.lit(1), F.size(h) - (WINDOW - 1))

    def places(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # Equal windows are neighbours now.
        twice = let(pairs, lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, k - 1)["h"]))))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return total(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))).cast("bigint")))

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(let(places(w), covered))

    return let(hashes, lambda h: F.when(F.size(h) > WINDOW, let(windows(h), count)).otherwise(F.lit(0).cast("bigint")))


def _left(text: Column, others: str) -> Column:
    """Characters that remain when runs of the others are gone."""
    return F.length(F.regexp_replace(text, others, "")).cast("bigint")


def measures(text: Column) -> Column:
    """One struct of counts and histograms of a text; null counts as empty."""

    def common(words: Column) -> Column:
        known = F.filter(words, lambda w: (F.length(w) <= 5) & F.lower(w).isin(_LIST))
        places = F.transform(known, lambda w: F.array_position(F.array(*map(F.lit, _LIST)), F.lower(w)).cast("int"))
        return let(places, lambda p: F.concat(
            F.transform(F.sequence(F.lit(1), F.lit(len(_LIST))), lambda k: F.size(p) - F.size(F.array_remove(p, k))),
            F.array(F.size(words) - F.size(p)),
        ))

    def made(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(NOT_SPACES[:-1]))
        size, spaces = F.length(t).cast("bigint"), _left(t, NOT_SPACES)
        symbols, digits, upper, beyond = _left(t, r"[^#*$%&|<>]+"), _left(t, "[^0-9]+"), _left(t, "[^A-Z]+"), _left(t, r"[\x00-\x7F]+")
        lower = _left(t, "[^a-z]+")
        words = let(words_of(t), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeated(F.transform(w, lambda x: F.xxhash64(x))).alias("repeated"), common(w).alias("common")))
        return let(F.struct(size.alias("size"), spaces.alias("spaces"), symbols.alias("symbols"), digits.alias("digits"), upper.alias("upper"), lower.alias("lower"), beyond.alias("beyond"), words.alias("words")), lambda m: F.struct(
            m["words"]["n"].alias("n_words"), (m["size"] - m["spaces"]).alias("word_chars"), m["symbols"].alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"), m["words"]["repeated"].alias("n_repeat_words"),
            F.array(m["lower"], m["upper"], m["digits"], m["spaces"], m["symbols"], m["beyond"],
                    m["size"] - m["lower"] - m["upper"] - m["digits"] - m["spaces"] - m["symbols"] - m["beyond"]).alias("classes"),
            m["words"]["common"].alias("common"),
        ))

    return let(F.coalesce(text.cast("string"), F.lit("")), made)


def _shares(counts: Column) -> Column:
    return let(total(F.transform(counts, lambda x: x.cast("bigint"))), lambda n: F.transform(counts, lambda x: x / n))


def divergence(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares, 0 to 1."""

    def part(x: Column, y: Column) -> Column:
        def one(a: Column) -> Column:
            return F.when(a > 0, a * F.log2(2 * a / (x + y))).otherwise(0.0)

        return (one(x) + one(y)) / 2

    return F.sqrt(F.greatest(total(F.zip_with(own, reference, part), "double"), F.lit(0.0)))


def _references(measured: DataFrame, lang: str, least_words: int, least_texts: int) -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms of the texts that pass the base rules: of each listed language and, under '*', of all."""
    sizes = {"classes": 7, "common": len(_LIST) + 1}
    good = once(measured).where(~F.col("_q.base_failed") & (F.col("_q.n_words") >= least_words) & (F.col("_place") >= 0))
    good = good.select(F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).otherwise("*").alias("key"), *[_shares(F.col(f"_q.{c}")).alias(c) for c in sizes])
    sums = [F.sum(F.col(c)[k]).alias(f"{c}{k}") for c, n in sizes.items() for k in range(n)]
    rows = good.groupBy("key").agg(F.count("*").alias("n"), *sums).collect()  # a row for each listed language and one more
    if not rows:
        return {}

    def mean(some: list) -> tuple[list[float], list[float]]:
        n = sum(r["n"] for r in some)
        return tuple([sum(r[f"{c}{k}"] for r in some) / n for k in range(size)] for c, size in sizes.items())

    return {"*": mean(rows), **{r["key"]: mean([r]) for r in rows if r["key"] != "*" and r["n"] >= least_texts}}


def judged(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", least_words: int = LEAST_WORDS,
           least_common: int = LEAST_COMMON, least_texts: int = LEAST_TEXTS, most_classes: float = MOST_CLASSES, most_words: float = MOST_WORDS,
           store: bool = True) -> DataFrame:
    """The ``keep`` columns and a struct ``_q``: counts, base_failed, the two distances and kept.

    A text fails the base rules with fewer than 20 words or over 30 % of its words in repeated
    windows of eight. Of the others, texts of at least ``least_words`` words are compared with
    their language's mean histograms (the mean of all texts if the language is unknown, null,
    or has fewer than ``least_texts`` texts) and rejected if the Jensen-Shannon distance of
    the character classes is too large or, from ``least_common`` words on (``LEAST_MIXED`` at
    least without a reference of their language), that of the common words. Distances are null where nothing is compared. References cover all documents; they are a few numbers a language.

    With ``store`` the measures and the ``keep`` columns are a table in between; without, texts
    are measured once for the references and again for the verdicts, and nothing is written.

    Null and empty texts have no words and fail. Repeated rows are judged alike, each on its
    own. Columns of ``keep`` pass unchanged, but one named ``_q`` is left out. An empty table
    gives an empty result.
    """
    own = [c for c in keep if c != "_q"]
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)], lang.alias("lang"), measures(docs[text_col]).alias("_q"))
    failed = (F.col("_q.n_words") < 20) | (100 * F.col("_q.n_repeat_words") > 30 * F.col("_q.n_words"))
    rows = rows.withColumn("_q", F.struct("_q.*", failed.alias("base_failed")))
    rows = written(rows) if store else rows
    known = _references(rows, "lang", least_words, least_texts)

    def of(kind: int) -> Column:
        def numbers(name: str) -> Column:
            return F.array(*[F.lit(float(x)) for x in known[name][kind]])

        out = numbers("*")
        for name in known:
            if name != "*":
                out = F.when(F.col("lang") == name, numbers(name)).otherwise(out)
        return out

    compared = ~F.col("_q.base_failed") & (F.col("_q.n_words") >= least_words)
    nothing = F.lit(None).cast("double")
    classes = F.when(compared, divergence(_shares(F.col("_q.classes")), of(0))) if known else nothing
    enough = F.when(F.col("lang").isin(*known), least_common).otherwise(max(least_common, LEAST_MIXED))
    common = F.when(compared & (F.col("_q.n_words") >= enough), divergence(_shares(F.col("_q.common")), of(1))) if known else nothing
    rows = rows.withColumn("_d", F.struct(classes.alias("classes"), common.alias("common")))
    far = (F.coalesce("_d.classes", F.lit(0.0)) > most_classes) | (F.coalesce("_d.common", F.lit(0.0)) > most_words)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = F.struct(*[F.col(f"_q.{n}").alias(n) for n in names], F.col("_d.classes").alias("class_distance"), F.col("_d.common").alias("word_distance"), (~F.col("_q.base_failed") & ~far).alias("kept"))
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(own)], found.alias("_q"))


def good_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with all their columns unchanged; nulls, empty texts and repeated rows as in ``judged``."""
    plain, names = numbered(docs)
    at = {name: f"n{k}" for k, name in enumerate(names)}
    options = {"text_col": "text", "lang_col": "lang", **options}
    options |= {c: at.get(options[c], "") for c in ("text_col", "lang_col")}
    rows = once(judged(plain, plain.columns, store=False, **options)).where("_q.kept and _place >= 0")
    return renamed(rows, names)
