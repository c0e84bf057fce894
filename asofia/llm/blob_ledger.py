"""Secret scan with an incremental ledger of content-addressed blobs.

Every version of a file is addressed by the SHA-256 of its text. A text is read
by the rules once for each rule version, however many paths, copies or
historical versions hold it: only (blob, rule version) pairs that the ledger
lacks are scanned, their findings are appended, and findings are joined back to
all paths. Copies inside one task are dropped before the exchange, so a text
that makes up a third of all rows crosses the network once for each task.

Defined cases: a null text is the empty blob; texts of any length are scanned
whole; repeated rows and paths each get their row; a null path is kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from asofia.llm import base

# Fixed patterns of the base kinds, in the order in which ties are listed; the
# third entry is the group whose length counts and the fourth the least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),   # runs are maximal, so a short one never hides a long one
)
# Added kinds: private key blocks (the pattern finds their first line, key_end() the rest), signed web tokens, tokens
# with a provider prefix.
ADDED = (
    ("pem", r"-----BEGIN ([A-Z ]{0,30}PRIVATE KEY)-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("prefixed", r"(?:gh[pousr]_|xox[abprs]-|sk_live_)[A-Za-z0-9_-]{20,}", 0, 0),
)
KINDS = BASE + ADDED
# A text without any of these (lower case) cannot match the kind.
HINTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "pem": ("-----begin ",),
         "jwt": ("eyj",), "prefixed": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_")}
SALTS = 16   # keys of a text that many rows share
RULE_VERSION = "2.1"

FINDINGS = "blob string, rule_version string, spans array<struct<kind:string,start:int,end:int>>"
_COMPILED = [(kind, re.compile(p, re.ASCII), group, least) for kind, p, group, least in KINDS]


# What follows the first line of a key whose END line is missing: headers, then runs of base64 and a shorter last line.
# Line breaks may be written as escapes, and lines may be quoted.
_BREAK = r"""(?:[\s"'>#|,]|\\[nrt])"""
_KEY_LINES = re.compile(rf"""(?:{_BREAK}+(?:Proc-Type|DEK-Info|Comment|Version):[^\r\n\\]*)*(?:{_BREAK}+[A-Za-z0-9+/=]{{16,}})+"""
                        rf"""(?:[\x20\t"',]*(?:\r?\n|(?:\\r)?\\n)[\x20\t"'>#|]*[A-Za-z0-9+/=]{{1,15}}(?=[\s"',\\]|\Z))?""", re.ASCII)


def key_end(text: str, begin: re.Match) -> int:
    """Where the private key block ends whose first line is `begin`: behind its END line, else behind its last key-like line."""
    after = begin.end()
    other = text.find("-----BEGIN ", after)
    last = f"-----END {begin[1]}-----"
    at = text.find(last, after, other if other >= 0 else len(text))
    if at >= 0:
        return at + len(last)
    lines = _KEY_LINES.match(text, after)
    return lines.end() if lines else after


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind as listed."""
    low = text.lower()
    found = []
    for order, (kind, pattern, group, least) in enumerate(_COMPILED):
        if kind in HINTS and not any(h in low for h in HINTS[kind]):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, key_end(text, m) if kind == "pem" else m.end()))
    return [(KINDS[order][0], a, b) for a, order, b in sorted(found)]


def blob_of(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _first_of_each(batches):
    """One row for each distinct text of a task."""
    seen: set[bytes] = set()
    for part in base.slices(batches):
        blobs, texts = [], []
        for t in part.column("text").to_pylist():
            d = hashlib.sha256((t or "").encode("utf-8", "surrogatepass"))
            if d.digest() not in seen:
                seen.add(d.digest())
                blobs.append(d.hexdigest())
                texts.append(t or "")
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(texts, pa.string())], names=["blob", "text"])


def open_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """Findings recorded so far, or None for a new ledger."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(FINDINGS).parquet(f"{folder}/run=*")


def extend_ledger(spark: SparkSession, versions: DataFrame, folder: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs of `versions` (text) that the ledger has not seen under this rule version; return the ledger.

    Each call appends one run folder, committed as a whole by Spark's writer,
    so a run that dies leaves nothing that would count as scanned.
    """
    known = open_ledger(spark, folder)
    fresh = base.map_batches(base.dealt(versions.select("text")), _first_of_each, "blob string, text string")
    if known is not None:
        done = known.where(F.col("rule_version") == rule_version).select("blob")
        fresh = fresh.join(done, "blob", "left_anti")

    def scan(batches):
        seen: set[str] = set()
        for part in base.slices(batches):
            blobs, spans = [], []
            for b, t in zip(part.column("blob").to_pylist(), part.column("text").to_pylist()):
                if b not in seen:
                    seen.add(b)
                    blobs.append(b)
                    spans.append([{"kind": k, "start": i, "end": j} for k, i, j in find_spans(t)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array([rule_version] * len(blobs), pa.string()),
                                              pa.array(spans, kind)], names=["blob", "rule_version", "spans"])

    base.map_batches(fresh.repartition("blob"), scan, FINDINGS).write.parquet(f"{folder}/run={uuid.uuid4().hex}")
    return open_ledger(spark, folder)


def findings_by_path(versions: DataFrame, ledger: DataFrame, path: str = "doc_id", rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, spans) of every row of `versions` (path, text)."""
    addressed = versions.select(F.col(path), blob_of(F.col("text")).alias("blob"))
    return addressed.join(ledger.where(F.col("rule_version") == rule_version).select("blob", "spans"), "blob")


def redact(docs: DataFrame, ledger: DataFrame, mask: str = "[secret]", rule_version: str = RULE_VERSION) -> DataFrame:
    """The rows of docs with every span of the text replaced; n_chars follows the text. All columns stay.

    A text that many rows share meets its spans under SALTS keys. A null text
    stays null, an empty table empty; repeated rows are all replaced; other
    columns, whatever their names, are passed on.
    """
    columns = docs.columns
    blob, salt, found = base.free_names(columns, "blob", "salt", "spans_found")
    hits = (ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
            .select(F.col("blob").alias(blob), F.col("spans").alias(found), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt)))
    rows = docs.withColumns({blob: blob_of(F.col("text")), salt: F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")}).join(hits, [blob, salt], "left").drop(blob, salt)

    def run(batches):
        for part in base.slices(batches):
            texts = part.column("text").to_pylist()
            for i, spans in enumerate(part.column(found).to_pylist()):
                if spans:
                    out, at = [], 0
                    for s in spans:
                        if s["start"] >= at:
                            out += [texts[i][at:s["start"]], mask]
                        at = max(at, s["end"])
                    texts[i] = "".join(out) + texts[i][at:]
            new = dict(zip(part.schema.names, part.columns)) | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([new[c] for c in columns], names=columns)

    out = base.map_batches(rows, run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def op10_blob_ledger(spark, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = extend_ledger(spark, docs, base.shared_folder(spark))
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    basic = F.filter("spans", lambda s: s["kind"].isin([k[0] for k in BASE]))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return findings_by_path(docs, ledger).select(
        "doc_id", *[number(k[0]).alias(f"n_{k[0]}") for k in BASE],
        F.sha2(F.array_join(F.transform(basic, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"))
