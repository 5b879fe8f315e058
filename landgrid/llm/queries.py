"""The dealt operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm.decontaminate import marked
from landgrid.llm.disclosure import KINDS, found as personal_data
from landgrid.llm.jaccard_join import jaccard_components
from landgrid.llm.lexical import ranked
from landgrid.llm.licences import LEAST, TEMPLATES, licence_units, size_bounds, template_words
from landgrid.llm.packing import packed
from landgrid.llm import quality
from landgrid.llm.secret_ledger import scan_versions
from landgrid.llm.shared import read_documents
from landgrid.llm.spans import digest_columns
from landgrid.llm.spelling import spelling_variants, vocabulary
from landgrid.llm.threshold import exact_top_k
from landgrid.llm.toxicity import fit, scored
from landgrid.llm.url_lists import host_of, listed
from landgrid.llm.warc import archived


def op1_quality_divergence(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.judged(read_documents(spark, folder), ["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select("doc_id", *[f"_q.{n}" for n in names])


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_documents(spark, folder)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out)
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", held_out.alias("held_out"), "_found.score", (F.col("_found.score") >= 0.5).cast("int").alias("predicted"))


def op3_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    rows = personal_data(read_documents(spark, folder), ["doc_id"])
    return rows.select("doc_id", *digest_columns(F.col("_spans"), KINDS))


def op4_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = licence_units(read_documents(spark, folder), ["doc_id"])
    names = F.array_sort(F.array_distinct(F.transform("_licences", lambda e: e["licence"])))
    best = F.array_max(F.transform("_licences", lambda e: e["dice"]))
    return rows.select("doc_id", F.size("_licences").cast("bigint").alias("n_matches"), F.array_join(names, ",").alias("licences"), F.round(best, 6).alias("best_dice"))


def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(read_documents(spark, folder), size=3, share=(90, 100))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived(spark.read.parquet(f"{folder}/pages.parquet"))


DAY = 86_400
#: Captures have no time of their own: one follows from the page's id, within the year 2024.
FIRST_DAY = 1_704_067_200


def capture_times(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return pages.withColumn("fetched_at", FIRST_DAY + F.col("page_id") * 37 % 366 * DAY + F.col("page_id") * 53 % 1440 * 60)


def list_entries(captures: DataFrame) -> DataFrame:
    """Every host, and every domain of two labels, is listed, taken off and listed again on days that follow from its name."""
    host = host_of(F.col("url"))
    domain = F.substring_index(host, ".", -2)
    names = captures.select(F.explode(F.array(host, domain)).alias("pattern")).where("pattern is not null").distinct()
    seed = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("bigint")
    category = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (seed % 3 + 1).cast("int"))
    day, held = seed % 200, 20 + F.floor(seed / 200) % 60
    events = F.array(*[F.struct(F.lit(a).alias("action"), (FIRST_DAY + d * DAY).alias("at")) for a, d in (("add", day), ("remove", day + held), ("add", day + held + 40))])
    return names.select("pattern", category.alias("category"), F.explode(events).alias("e")).select("pattern", "category", "e.action", "e.at")


def op7_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    captures = capture_times(spark, folder)
    rows = listed(captures, list_entries(captures), keep=["page_id"])
    return rows.select("page_id", "_listed.*")


def op8_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan_versions(read_documents(spark, folder))
    return rows.select("doc_id", *digest_columns(F.col("spans"), ["assign", "access", "hex"]))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    rows = marked(read_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    items = F.array_sort("_found.items")
    return rows.select(
        "doc_id", "_found.n_words", "_found.n_hit", F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("_found.n_hit") > 0).alias("contaminated"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_hilbert_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(read_documents(spark, folder), tokenizer_path(), with_ids=False)


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(vocabulary(read_documents(spark, folder)))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(read_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op13_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_divergence": op1_quality_divergence,
    "op2_toxicity": op2_toxicity,
    "op3_disclosure": op3_disclosure,
    "op4_licence_scan": op4_licence_scan,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_warc": op6_warc,
    "op7_url_lists": op7_url_lists,
    "op8_secret_ledger": op8_secret_ledger,
    "op9_decontamination": op9_decontamination,
    "op10_hilbert_packing": op10_hilbert_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_top_k": op13_exact_top_k,
}

def _licence_oracle() -> str:
    rows = []
    for number, (name, text) in enumerate(TEMPLATES):
        words = template_words(text)
        pairs = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))
        low, high = size_bounds(len(pairs), LEAST)
        listed_pairs = ", ".join(f"'{p}'" for p in pairs)
        rows.append(f"select {number} as template, '{name}' as licence, [{listed_pairs}] as grams, {low} as low, {high} as high")
    return f"""
    with t as ({' union all '.join(rows)}),
    l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines, list_filter(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t]*\\n'), lambda p: contains(p, chr(10))) as blocks from documents),
    u as (select doc_id, unnest(lines || blocks) as unit, generate_subscripts(lines || blocks, 1) as k from l),
    w as (select doc_id, k, list_filter(string_split(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as ws from u),
    g as (select doc_id, k, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as own from w where len(ws) > 1),
    m as (select doc_id, k, licence, max(2.0 * len(list_intersect(own, grams)) / (len(own) + len(grams))) as dice from g join t on len(own) between low and high group by 1, 2, 3),
    h as (select doc_id, count(*) as n, string_agg(distinct licence, ',' order by licence) as licences, max(dice) as dice from m where dice * 100 >= {LEAST} group by 1)
    select d.doc_id, coalesce(n, 0) as n_matches, coalesce(licences, '') as licences, round(dice, 6) as best_dice from documents d left join h using (doc_id)"""


def _matches_sql(source: str, kind: str, place: int, pattern: str, test: str, group: int = 0) -> str:
    """SQL: start and end of a pattern's matches that pass a test of ``m``, or of ``m`` 's group."""
    return f"""
    select doc_id, {place} as place, '{kind}' as kind, start, start + length(whole) as stop from (
      select doc_id, whole, m, gap_sum + own_sum - length(whole) as start from (
        select doc_id, whole, m, sum(length(gap)) over w as gap_sum, sum(length(whole)) over w as own_sum from (
          select doc_id, unnest(regexp_extract_all(text, '{pattern}')) as whole, unnest(regexp_extract_all(text, '{pattern}', {group})) as m,
            unnest(string_split_regex(text, '{pattern}')[:len(regexp_extract_all(text, '{pattern}'))]) as gap, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) as k from {source})
        window w as (partition by doc_id order by k))) where {test}"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

def _quality_oracle() -> str:
    langs = ", ".join(f"'{x}'" for x in quality.COMMON_WORDS)
    common = ", ".join(f"'{x}'" for x in sorted({w for own in quality.COMMON_WORDS.values() for w in own}))
    classes = {"lower": "[^a-z]+", "upper": "[^A-Z]+", "digits": "[^0-9]+", "spaces": "[^\\x20\\x09-\\x0D]+", "symbols": "[^#*$%&|<>]+", "beyond": "[\\x00-\\x7F]+"}
    counts = ", ".join(f"length(regexp_replace(t, '{pattern}', '', 'g')) as {name}" for name, pattern in classes.items())
    bins = " union all ".join(f"select doc_id, 'c' as kind, '{name}' as bin, {name} / size as own from c where size > 0" for name in classes)
    rest = "size - " + " - ".join(classes)
    return f"""
    with d as (select doc_id, case when lang in ({langs}) then lang else '*' end as key, coalesce(text, '') as t from documents),
    c as (select doc_id, length(t) as size, {counts} from d),
    w as (select doc_id, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from d),
    v as (select doc_id, i, count(*) over (partition by doc_id, win) as n from (select doc_id, unnest(range(1, len(ws) - 6)) as i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) as win from w)),
    r as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from v where n > 1) group by 1),
    l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
    b as (select d.doc_id, key, len(ws) as n_words, size - spaces as word_chars, symbols as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
      len(ws) < 20 or 100 * coalesce(r.n, 0) > 30 * len(ws) as base_failed from d join c using (doc_id) join w using (doc_id) left join r using (doc_id) left join l using (doc_id)),
    k as (select doc_id, word, count(*) as n from (select doc_id, lower(unnest(ws)) as word, length(unnest(ws)) as size from w) where size <= 5 and word in ({common}) group by 1, 2),
    a as (select doc_id, word, n from k union all select b.doc_id, '', n_words - coalesce((select sum(n) from k where k.doc_id = b.doc_id), 0) from b),
    o as ({bins} union all select doc_id, 'c', 'other', ({rest}) / size from c where size > 0
      union all select a.doc_id, 'w', word, a.n / n_words from a join b using (doc_id) where n_words > 0),
    g as (select doc_id, key from b where not base_failed and n_words >= {quality.LEAST_WORDS}),
    f as (select '*' as key, count(*) as n from g union all select key, count(*) from g where key <> '*' group by 1 having count(*) >= {quality.LEAST_TEXTS}),
    q as (select f.key, kind, bin, sum(own) / any_value(f.n) as ref from f join g on f.key = '*' or f.key = g.key join o using (doc_id) group by 1, 2, 3),
    u as (select g.doc_id, coalesce(f.key, '*') as key from g left join f on f.key = g.key),
    m as (select u.doc_id, q.kind, ref, coalesce(own, 0) as own from u join q using (key) left join o on o.doc_id = u.doc_id and o.kind = q.kind and o.bin = q.bin
      union all select u.doc_id, o.kind, 0, own from u join o using (doc_id) where not exists (select 1 from q where q.key = u.key and q.kind = o.kind and q.bin = o.bin)),
    j as (select doc_id, kind, sqrt(greatest(sum(case when own > 0 then own * log2(2 * own / (own + ref)) else 0 end + case when ref > 0 then ref * log2(2 * ref / (own + ref)) else 0 end) / 2, 0)) as far from m group by 1, 2),
    x as (select doc_id, bool_or(kind = 'c' and far > {quality.MOST_CLASSES}) as c, bool_or(kind = 'w' and far > {quality.MOST_WORDS}) as w from j group by 1)
    select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or coalesce(x.c, false) or (coalesce(x.w, false) and n_words >= {quality.LEAST_COMMON})) as kept
    from b left join x using (doc_id)"""


HOST_SQL = "nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '[.]+$', ''), '')"

ORACLES: dict[str, str] = {
    "op1_quality_divergence": _quality_oracle(),
    "op4_licence_scan": _licence_oracle(),
    "op5_ngram_jaccard": r"""
    with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
    s as (select doc_id, unnest(list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end)) as g from w),
    n as (select doc_id, count(*) as n from s group by 1),
    b as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
    l as (select a, b from b join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 90 * (x.n + y.n - shared)),
    r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on l.a = r.b)
    select r.a as doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.b) as component_id from r left join n on n.doc_id = r.a group by 1""",
    "op6_warc": """
    with p as (select page_id, coalesce(html, '') as h from pages), f as (select h, min(page_id) as first from p where strlen(h) >= 100 group by h)
    select page_id, strlen(p.h) as payload_bytes, sha256(p.h) as payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
      case when first <> page_id then first end as refers_to from p left join f on f.h = p.h""",
    "op7_url_lists": f"""
    with c as (select page_id, {HOST_SQL} as host, {FIRST_DAY} + page_id * 37 % 366 * {DAY} + page_id * 53 % 1440 * 60 as fetched from pages),
    p as (select distinct unnest([host, array_to_string(string_split(host, '.')[-2:], '.')]) as pattern from c where host is not null),
    s as (select pattern, ('0x' || substr(md5(pattern), 1, 6))::bigint as seed from p),
    d as (select pattern, ['adult', 'malware', 'spam'][seed % 3 + 1] as category, seed % 200 as day, 20 + (seed // 200) % 60 as held from s),
    v as (select pattern, category, {FIRST_DAY} + day * {DAY} as valid_from, {FIRST_DAY} + (day + held) * {DAY} as valid_to from d
      union all select pattern, category, {FIRST_DAY} + (day + held + 40) * {DAY}, null from d),
    m as (select page_id, pattern, category, valid_from, count(*) over (partition by page_id) as n, row_number() over (partition by page_id order by length(pattern) desc, valid_from desc, category) as k
      from c join v on (host = pattern or ends_with(host, '.' || pattern)) and valid_from <= fetched and (valid_to is null or fetched < valid_to))
    select c.page_id, host, coalesce(n, 0) as n_active, pattern, category, valid_from from c left join m on m.page_id = c.page_id and k = 1""",
    "op8_secret_ledger": f"""
    with d as (select doc_id, coalesce(text, '') as text from documents),
    m as ({_matches_sql("d", "assign", 0, _ASSIGN, "length(m) >= 12", 1)} union all {_matches_sql("d", "access", 1, "AKIA[A-Z0-9]+", "length(m) >= 18")}
      union all {_matches_sql("d", "hex", 2, "[0-9a-f]+", "length(m) >= 16")} union all {_matches_sql("d", "pem", 3, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true")}),
    j as (select doc_id, count(*) filter (where place = 0) as a, count(*) filter (where place = 1) as k, count(*) filter (where place = 2) as h,
      string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) as spans, string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) filter (where place < 3) as base from m group by 1)
    select d.doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join j using (doc_id)""",
    "op9_decontamination": r"""
    with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
    iw as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
    v as (select item, least(len(ws), 10) as size, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) as win from iw where len(ws) > 0),
    z as (select distinct size from v),
    x as (select doc_id, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) as win, unnest(range(1, len(ws) - size + 2)) as i from dw join z on len(ws) >= size),
    h as (select distinct doc_id, i, size, item from x join v using (size, win)),
    c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from h) group by 1),
    q as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by 1)
    select dw.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
    from dw left join c using (doc_id) left join q using (doc_id)""",
    "op11_spelling_variants": r"""
    with steps as (select list_transform(range(256), lambda i: list_reduce([i::ubigint] || list_transform(range(8), lambda k: 0::ubigint), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) as t),
    r as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
    g as (select doc_id, run, count(*) as n, hex(encode(doc_id || ':' || run)) as h from r group by 1, 2),
    c as (select run, n, xor(list_reduce([4294967295::ubigint] || list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::ubigint), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::bigint])), 4294967295::ubigint) as crc from g, steps),
    v as (select case when crc % 97 = 0 then substr(run, 1, (crc % length(run))::int) || substr(run, (crc % length(run))::int + 2) else run end as word, sum(n)::bigint as n from c group by 1),
    w as (select word, n from v where length(word) >= 5 and n >= 3),
    d as (select word, n, unnest(range(1, length(word) + 1)) as i from w),
    e as (select word, n, length(word) as size, i, substr(word, 1, i - 1) || substr(word, i + 1) as less from d),
    p as (select x.word as a, y.word as b, y.n from e x join e y on x.less = y.less and x.i = y.i and x.size = y.size and x.word <> y.word
      union select e.word, w.word, w.n from e join w on w.word = e.less union select w.word, e.word, e.n from e join w on w.word = e.less),
    k as (select a, b, n, row_number() over (partition by a order by n desc, encode(b)) as k, count(*) over (partition by a) as n_near from p),
    f as (select w.word, case when k.n >= 2 * w.n then k.b end as form, w.n, coalesce(n_near, 0) as n_near, case when k.n >= 2 * w.n then k.n end as form_n from w left join k on k.a = w.word and k.k = 1),
    o as (with recursive u as (select word, word as root, form as up from f union all select u.word, u.up, f.form from u join f on f.word = u.up) select word, root from u where up is null)
    select f.word, form, root, n, n_near, form_n from f join o using (word)""",
    "op12_lexical_search": r"""
    with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
    c as (select doc_id, term, count(*) as tf from t group by 1, 2),
    n as (select doc_id, count(*) as n from t group by 1),
    s as (select count(*) as docs, sum(n)::bigint as len from n),
    m as (select doc_id, 25 + (75 * n * docs) // len as m from n, s),
    w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*) as df from c group by 1), s),
    i as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by 1, 2),
    r as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from i join c using (term) join w using (term) join m using (doc_id) group by 1, 2)
    select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0) where rank <= 10""",
    "op13_exact_top_k": """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
    select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
}
