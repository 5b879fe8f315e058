"""Secrets in texts, scanned once per distinct text and rule version."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.llm.shared import shared_path, written

#: Kinds in their order, each with its version, pattern, least length and the group that must have it. Fixed values.
RULES: dict[str, tuple[int, str, int, int]] = {
    "assign": (1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    "access": (1, r"AKIA[A-Z0-9]+", 18, 0),
    "hex": (1, r"[0-9a-f]+", 16, 0),
    "pem": (1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1, 0),
}
#: A text without any of these, lower-cased, has no match of the rule.
_HINTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "pem": ("private key-----",)}
#: Runs that can be long enough, which is all that matters for the rule; they are as long as the pattern's.
_SEARCH = {"hex": r"[0-9a-f]{16,}"}
_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_secrets(text: str, kind: str) -> list[tuple[int, int]]:
    """Spans of one rule: leftmost non-overlapping matches that are long enough."""
    _, pattern, least, group = RULES[kind]
    if kind in _HINTS:
        lower = text.lower()
        if not any(h in lower for h in _HINTS[kind]):
            return []
    flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
    return [m.span() for m in re.compile(_SEARCH.get(kind, pattern), flags).finditer(text) if len(m[group]) >= least]


def _scan(texts: DataFrame) -> DataFrame:
    """(blob, rule, version, spans) for each (blob, text, rules)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            blobs, rules, versions, spans = [], [], [], []
            for blob, text, wanted in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                for kind in wanted.as_py():
                    blobs.append(blob.as_py()), rules.append(kind), versions.append(RULES[kind][0])
                    spans.append([{"kind": kind, "start": a, "end": b} for a, b in find_secrets(text, kind)])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(rules, pa.string()), pa.array(versions, pa.int32()), pa.array(spans, kinds)], names=["blob", "rule", "version", "spans"])

    return texts.mapInArrow(scan, f"blob binary, rule string, version int, spans {_SPANS}")


def ledger_rows(spark, path: str) -> DataFrame:
    """What the ledger holds; empty while its folder does not exist."""
    schema = f"blob binary, rule string, version int, spans {_SPANS}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def scan_versions(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the sorted secret spans of every row, through a ledger of scanned texts.

    Every row is a version of the text at a path (``id_col``). A version is addressed by the
    SHA-256 of its text. Pairs of a text and a rule version that the ledger lacks are scanned,
    once however many paths hold the text, and appended; findings then join back to all paths.
    A second call with the same ledger folder scans only what is new. Spans are code points,
    end exclusive, ordered by start, then by the rule's place.

    A ledger may hold an entry more than once, as calls at the same time leave it; each counts
    once. Null texts are empty, very long ones are scanned whole. Repeated rows stay; null ids take part. Other columns are ignored,
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ledger = ledger or shared_path(spark, "ledger")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    source = docs.select(docs[id_col].alias("id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
    paths = written(source.select("id", "blob"))
    pairs = paths.groupBy("blob").agg(F.min("id").alias("id")).withColumn("rule", F.explode(F.array(*map(F.lit, RULES))))
    versions = F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (k, v[0])])
    seen = ledger_rows(spark, ledger).where(F.col("version") == versions[F.col("rule")]).select("blob", "rule")
    unseen = written(pairs.join(seen, ["blob", "rule"], "left_anti").groupBy("blob").agg(F.first("id").alias("id"), F.sort_array(F.collect_set("rule")).alias("rules")))
    texts = source.join(unseen.select(F.xxhash64("id").alias("key"), F.col("blob").alias("own"), "rules"), (F.xxhash64("id") == F.col("key")) & (F.col("blob") == F.col("own")))
    _scan(texts.select("blob", "text", "rules")).dropDuplicates(["blob", "rule"]).write.mode("append").parquet(ledger)

    order = F.create_map(*[F.lit(x) for n, k in enumerate(RULES) for x in (k, n)])
    found = ledger_rows(spark, ledger).where((F.col("version") == versions[F.col("rule")]) & (F.size("spans") > 0))
    found = found.dropDuplicates(["blob", "rule"])  # two calls at a time may have scanned the same text
    found = written(found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"], order[s["kind"]].alias("place"), s["end"], s["kind"]))))).alias("spans")))
    spans = F.coalesce(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), F.expr(f"cast(array() as {_SPANS})"))
    return paths.join(found, "blob", "left").select(F.col("id").alias(id_col), spans.alias("spans"))
