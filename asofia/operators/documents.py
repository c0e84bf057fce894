"""Terms, dates, amounts and links from document text.

Operators are built-in expressions over whole texts, and a document is never
cut. The exceptions are ``contexts``, the list of matches with their places, and
``names_in_text``, many patterns at once, which no built-in function gives:
Arrow batches with one scan of each text.
Exploding operators emit rows per document in proportion to its length, so a few
huge documents spread like any other rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from asofia.functions.norm import DATE_IN_TEXT, clean_number, contains_any, first_reason
from asofia.operators.joins import match_status

NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
ISO_DATE = r"([0-9]{4}[-./][0-9]{2}[-./][0-9]{2})"
# Markup entities.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
# Labelled patterns of a dividend decision.
DECISION_PATTERNS = {
    "common_cash_dividend_per_share": r"1주당\s*배당금\s*\(원\)\s*보통주식\s*([0-9][0-9,.]*)",
    "preferred_cash_dividend_per_share": r"1주당\s*배당금\s*\(원\).*?종류주식\s*([0-9][0-9,.]*)",
    "dividend_record_date": r"배당기준일\s*" + ISO_DATE,
    "payment_scheduled_date": r"배당금지급\s*예정일자\s*" + ISO_DATE,
    "board_decision_date": r"이사회결의일\s*\(결정일\)\s*" + ISO_DATE,
}


def _c(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def without_code(c: Column | str) -> Column:
    """Markup without its scripts and styles."""
    t = F.regexp_replace(_c(c), r"(?is)<script\b.*?</script\s*>", " ")
    return F.regexp_replace(t, r"(?is)<style\b.*?</style\s*>", " ")


def plain(c: Column) -> Column:
    """Text of a piece of markup: no tags, entities decoded, blanks collapsed."""
    t = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    decoded = t
    for entity, char in ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    t = F.when(F.contains(t, F.lit("&")), decoded).otherwise(t)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def strip_markup(c: Column | str) -> Column:
    """Text of a whole page."""
    return plain(without_code(c))


def table_rows(docs: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row_no, cells): the cells of every table row."""
    parts = F.slice(F.split(without_code(html), r"(?i)<tr\b"), 2, 1 << 30)
    rows = docs.select(key, F.posexplode(parts).alias("row_no", "_row"))
    cells = F.transform(F.regexp_extract_all("_row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1), plain)
    return rows.withColumn("cells", cells).where(F.size("cells") > 0).drop("_row")


def row_terms(rows: DataFrame, key: str, labels: dict[str, str]) -> DataFrame:
    """Value in the last cell of the last row whose blank-free first cell starts with a label."""
    label = F.regexp_replace(F.element_at("cells", 1), r"\s", "")
    value = F.element_at("cells", -1)
    return rows.where(F.size("cells") >= 2).groupBy(key).agg(*[
        F.max_by(F.when(label.startswith(prefix), value), F.when(label.startswith(prefix), F.col("row_no"))).alias(name)
        for name, prefix in labels.items()])


def last_match(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise("")


def decision_terms(df: DataFrame, text: str) -> DataFrame:
    """Five labelled values of a dividend decision and whether the needed ones were found."""
    t = strip_markup(text)
    cols = {name: last_match(t, "(?i)" + p) for name, p in DECISION_PATTERNS.items()}
    for name in cols:
        cols[name] = (F.regexp_replace(cols[name], r"[./]", "-") if name.endswith("_date")
                      else F.regexp_replace(cols[name], r"[^0-9.]", ""))
    df = df.withColumns(cols)
    ok = (F.col("common_cash_dividend_per_share") != "") & (F.col("dividend_record_date") != "")
    return df.withColumn("parse_status", F.when(ok, "PARSED").otherwise("INCOMPLETE"))


def date_after_label(df: DataFrame, text: str, labels: Sequence[str], width: int = 180, out: str = "label_date") -> DataFrame:
    """Dates within ``width`` characters after a label: the only one, or ambiguous, or none."""
    words = "|".join(re.escape(w) for w in labels)
    pattern = rf"(?s)(?:{words}).{{0,{width}}}?" + DATE_IN_TEXT
    y, m, d = (F.regexp_extract_all(_c(text), F.lit(pattern), i) for i in (1, 2, 3))
    df = df.withColumns({"_y": y, "_m": m, "_d": d})
    found = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_y")), lambda i: F.concat(
        F.element_at("_y", i), F.lpad(F.element_at("_m", i), 2, "0"), F.lpad(F.element_at("_d", i), 2, "0"))))
    df = df.withColumn("_all", F.when(F.size("_y") > 0, found).otherwise(F.array().cast("array<string>")))
    return df.withColumns({out: F.when(F.size("_all") == 1, F.element_at("_all", 1)),
                           f"{out}_status": match_status(F.size("_all"))}).drop("_y", "_m", "_d", "_all")


def amount_after_label(text: str, labels: Sequence[str], width: int = 120) -> Column:
    words = "|".join(re.escape(w) for w in labels)
    return clean_number(F.regexp_extract(_c(text), rf"(?s)(?:{words}).{{0,{width}}}?{NUMBER}", 1))


def contexts(docs: DataFrame, key: str, text: str, patterns: Sequence[str], before: int, after: int) -> DataFrame:
    """(key, pattern, start, groups, context) of every match of every pattern in each text.

    ``context`` reaches from ``before`` characters ahead of the match to ``after``
    behind it; ``pattern`` counts from 0. Matches of one text leave in small batches.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, pattern int, start int, groups array<string>, context string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = [re.compile(p) for p in patterns]
        for batch in batches:
            names, rows = [key, "pattern", "start", "groups", "context"], []

            def made() -> pa.RecordBatch:
                keys, *rest = zip(*rows)
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()]
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((keys, *rest), kinds)], names=names)

            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, one in enumerate(find):
                    for m in one.finditer(t or ""):
                        rows.append((k, i, m.start(), list(m.groups()), t[max(0, m.start() - before):m.end() + after]))
                        if len(rows) >= 4_096:
                            yield made()
                            rows = []
            if rows:
                yield made()

    return docs.select(key, text).mapInArrow(run, schema)


# A date as it is written in running text.
DATE_NEAR = r"(20[0-9]{2})[-./년\s]+([0-9]{1,2})[-./월\s]+([0-9]{1,2})"


def date_amount_pairs(docs: DataFrame, key: str, text: str, keywords: Sequence[str], unit: str = "원", before: int = 250,
                      after: int = 350, cutoff: str | None = None) -> DataFrame:
    """Every date that has a keyword near it with every distinct positive amount near it.

    Near is the stretch from ``before`` characters ahead of the date to ``after``
    behind it, blanks collapsed; each date has a stretch of its own. Dates after
    ``cutoff`` are left out.
    """
    compact = docs.select(key, F.regexp_replace(_c(text), r"(?U)\s+", " ").alias("_text"))
    near = contexts(compact, key, "_text", [DATE_NEAR], before, after).where(contains_any("context", keywords))
    day = F.concat(F.col("groups")[0], F.lpad(F.col("groups")[1], 2, "0"), F.lpad(F.col("groups")[2], 2, "0"))
    amounts = F.transform(F.regexp_extract_all("context", F.lit(NUMBER + r"\s*" + unit), 1), clean_number)
    pairs = near.select(key, day.alias("event_date"), F.explode(F.array_distinct(amounts)).alias("amount")).where(F.col("amount") > 0)
    return (pairs if cutoff is None else pairs.where(F.col("event_date") <= cutoff)).distinct()


def date_lists(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    y, m, d = (F.regexp_extract_all(_c(text), F.lit(pattern), i) for i in (1, 2, 3))
    df = docs.select(key, y.alias("_y"), m.alias("_m"), d.alias("_d")).where(F.size("_y") > 0)
    return df.select(key, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_y")), lambda i: F.concat(
        F.element_at("_y", i), F.lpad(F.element_at("_m", i), 2, "0"), F.lpad(F.element_at("_d", i), 2, "0")))).alias("dates"))


def action_terms(df: DataFrame, text: str, known_at: str, hint: str, cutoff: str) -> DataFrame:
    """Record, listing and reduction dates, ratios and the eligibility class of a capital action."""
    t = _c(text)
    for name, labels in (("allotment_date", ("신주배정기준일",)), ("listing_date", ("신주의 상장 예정일", "신주상장예정일")),
                         ("reduction_date", ("감자기준일",))):
        p = rf"(?s)(?:{'|'.join(labels)}).{{0,80}}?" + DATE_IN_TEXT
        y = F.regexp_extract(t, p, 1)
        df = df.withColumn(name, F.when(y != "", F.concat(y, F.lpad(F.regexp_extract(t, p, 2), 2, "0"),
                                                          F.lpad(F.regexp_extract(t, p, 3), 2, "0"))).otherwise(""))
    df = df.withColumns({
        "allotment_ratio": clean_number(F.regexp_extract(t, r"1주당 신주배정주식수 \(주\)\D{0,40}?" + NUMBER, 1)),
        "reduction_ratio": clean_number(F.regexp_extract(t, r"감자비율.{0,60}?보통주식 \(%\)\D{0,40}?" + NUMBER, 1))})
    event = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("allotment_date", "reduction_date", "listing_date")])
    df = df.withColumn("event_date", F.coalesce(event, F.lit("")))
    h, day = F.col(hint), F.col("event_date")
    return df.withColumn("eligibility", first_reason([
        (day == "", "MISSING_OFFICIAL_EFFECTIVE_DATE"), (day > cutoff, "EVENT_AFTER_RESEARCH_CUTOFF"),
        (F.col(known_at) > day, "KNOWN_AT_AFTER_EVENT_DATE"),
        ((h == "REVERSE_SPLIT") & F.coalesce(F.col("reduction_ratio") < 1, F.lit(False)), "MINOR_CAPITAL_REDUCTION_NEEDS_SEMANTIC_REVIEW"),
        ((h == "RIGHTS") & (F.col("allotment_date") == ""), "NO_SHAREHOLDER_ALLOTMENT_DATE")], "CANDIDATE"))


def contains_mechanic(text: Column | str, families: dict[str, Sequence[str]]) -> Column:
    """Names of the families with a keyword in the text."""
    t = _c(text)
    return F.array_compact(F.array(*[F.when(contains_any(t, words), F.lit(name)) for name, words in families.items()]))


def json_fields(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Path and value of every leaf of JSON records, with date-like and amount-like marks.

    Objects and arrays of any depth are walked, one level for each round; array
    members have their position in the path. A record that is one scalar has an
    empty path; a null record or one that is not JSON has no row; a JSON null is
    a leaf without value; an empty object or array has no leaf.
    """
    explode = df.sparkSession.tvf.variant_explode
    container = lambda c: F.schema_of_variant(c).rlike("^(OBJECT|ARRAY)")
    level = df.select(F.col(key).alias("_key"), F.lit("").alias("path"), F.try_parse_json(_c(payload)).alias("_v")).where("_v IS NOT NULL")
    leaves = []
    while True:
        leaves.append(level.where(~container(F.col("_v"))))
        level = level.where(container(F.col("_v")))
        if level.isEmpty():
            break
        inner = level.lateralJoin(explode(F.col("_v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(
            F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), F.col("key")))
        level = inner.select("_key", F.concat("path", step).alias("path"), F.col("value").alias("_v"))
    flat = reduce(DataFrame.unionByName, leaves).select(F.col("_key").alias(key), "path", F.col("_v").cast("string").alias("value"))
    digits = F.regexp_replace("value", r"[-./]", "")
    return flat.withColumns({"date_like": digits.rlike(r"^(19|20)[0-9]{6}$"), "amount_like": clean_number("value").isNotNull()})


def notice_terms(df: DataFrame, url: str, text: str, name: str) -> DataFrame:
    """Application date in the text, publication date in the path, membership of the name."""
    t = _c(text)
    p = r"(?s)적용일.{0,40}?" + DATE_IN_TEXT
    applied = F.concat(F.regexp_extract(t, p, 1), F.lpad(F.regexp_extract(t, p, 2), 2, "0"), F.lpad(F.regexp_extract(t, p, 3), 2, "0"))
    return df.withColumns({
        "application_date": F.when(F.regexp_extract(t, p, 1) != "", applied).otherwise(""),
        "publication_date": F.regexp_replace(F.regexp_extract(_c(url), r"/(20[0-9]{2}/?[0-9]{2}/?[0-9]{2})/", 1), "/", ""),
        "is_member": F.contains(t, F.col(name))})


def doc_ids(df: DataFrame, html: str) -> DataFrame:
    """Fourteen-digit ids, the document number of the selected option, the viewer path and the first external address of a page.

    The number stands before a ``|Y`` or ``|N`` in the value of the selected
    option, whatever the order of its attributes, else anywhere in the page.
    """
    h = _c(html)
    for entity, char in ENTITIES:
        h = F.replace(h, F.lit(entity), F.lit(char))
    number = r"([0-9]{14})\s*\|\s*[YNyn]"
    option = F.regexp_extract(h, r"(?is)(<option\b(?=[^>]*\bselected\b)[^>]*>)", 1)
    value = F.regexp_extract(option, r"""(?i)\bvalue\s*=\s*['"]([^'"]+)['"]""", 1)
    return df.withColumns({
        "ids": F.array_sort(F.array_distinct(F.regexp_extract_all(h, F.lit(r"(?<![0-9])([0-9]{14})(?![0-9])"), 1))),
        "selected_option": value,
        "document_no": F.coalesce(F.nullif(F.regexp_extract(value, number, 1), F.lit("")), F.regexp_extract(h, number, 1)),
        "viewer_url": F.regexp_extract(h, r"""(?i)parent\.setPath\(\s*['"][^'"]*['"]\s*,\s*['"](https?://[^'"]+)['"]""", 1),
        "external_url": F.regexp_extract(h, r'(?i)(?:href|src)="(https?://[^"]+)"', 1)})


# How addresses are written in pages and scripts.
LINK_PATTERNS = (
    r"""["']((?:https?:)?//[^"' ]+)["']""",
    r"""["'](/[^"' ]+)["']""",
    r"""(?i:url|action|data-url)\s*[:=]\s*["']([^"']+)["']""",
    r"""(?i:fetch)\(\s*["']([^"']+)["']""",
)
LINK_BEFORE, LINK_AFTER, CONTEXT_LENGTH, FIRST_CONTEXTS = 180, 220, 500, 3


def keyword_count(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords the text holds, in any case."""
    low, found = F.lower(text), F.lit(0)
    for w in keywords:
        found = found + F.contains(low, F.lit(w.lower())).cast("int")
    return found


def links(pages: DataFrame, key: str, url: str, body: str, keywords: Sequence[str], same_host: bool = False, least: int = 0) -> DataFrame:
    """Addresses in pages and their scripts: link, score, hits, sources, contexts.

    Every pattern that matches counts as a hit. The score of a hit is the number
    of keywords in the address and the text around it; a link has its highest
    score and the first three contexts by page and place. Hits under ``least``
    are left out.
    """
    found = contexts(pages, key, body, LINK_PATTERNS, LINK_BEFORE, LINK_AFTER)
    rows = found.join(pages.select(key, F.col(url).alias("_page")), key).withColumn("_raw", F.trim(F.col("groups")[0]))
    rows = rows.where((F.col("_raw") != "") & ~F.col("_raw").rlike(r"(?i)^(javascript:|#)"))
    raw = F.col("_raw")
    full = (F.when(raw.rlike(r"(?i)^https?://"), raw)
            .when(raw.startswith("//"), F.concat(F.regexp_extract("_page", r"^(https?:)", 1), raw))
            .when(raw.startswith("/"), F.concat(F.regexp_extract("_page", r"^(https?://[^/?#]+)", 1), raw))
            .otherwise(F.concat(F.regexp_replace("_page", r"/[^/]*$", "/"), raw)))
    score = keyword_count(F.concat_ws(" ", raw, "context"), keywords)
    rows = rows.select(key, "_page", "pattern", "start", full.alias("link"), score.alias("_score"),
                       F.substring(F.regexp_replace("context", r"\s+", " "), 1, CONTEXT_LENGTH).alias("context")).where(F.col("_score") >= least)
    if same_host:
        host = lambda c: F.regexp_extract(c, r"^https?://([^/?#]+)", 1)
        rows = rows.where(host(F.col("link")) == host(F.col("_page")))
    place = Window.partitionBy("link").orderBy(key, "start", "pattern")   # a limit per task comes before the exchange
    first = rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= FIRST_CONTEXTS)
    said = first.groupBy("link").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "context"))), lambda x: x["context"]).alias("contexts"))
    return rows.groupBy("link").agg(F.max("_score").alias("score"), F.count(F.lit(1)).alias("hits"), F.countDistinct(key).alias("sources")).join(said, "link")


def rank_endpoints(found: DataFrame, keywords: Sequence[str], n: int) -> DataFrame:
    """Best n endpoints by 10 x score + hits + 3 x keywords in the contexts (a top-n report)."""
    bonus = keyword_count(F.array_join("contexts", " "), keywords)
    return found.withColumn("rank_score", F.col("score") * 10 + F.col("hits") + bonus * 3).orderBy(
        F.desc("rank_score"), F.desc("score"), F.desc("hits"), "link").limit(n)


def membership_rank(field: str, text: str, name: str) -> Column:
    """1 when the company field equals the name, 2 when the text holds it."""
    return F.when(F.trim(_c(field)) == F.col(name), 1).when(F.contains(_c(text), F.col(name)), 2)


def best_notice(df: DataFrame, by: str, days: Column, limit: int = 5) -> DataFrame:
    """The only notice of best membership within 0..limit days."""
    near = df.where(F.col("membership").isNotNull() & days.between(0, limit))
    best = near.groupBy(by).agg(F.min("membership").alias("_b"))
    top = near.join(best, by).where(F.col("membership") == F.col("_b"))
    return top.groupBy(by).agg(F.count(F.lit(1)).alias("notices"), F.max("notice_id").alias("_n")).select(
        by, "notices", F.when(F.col("notices") == 1, F.col("_n")).alias("notice_id"), match_status(F.col("notices")).alias("notice_status"))


def common_notice(notices: DataFrame, by: str, title: str, preferred: str = r"우[BC]?$|\(우\)") -> DataFrame:
    """The only notice of a group whose title is not about a preferred class."""
    kept = notices.where(~F.trim(title).rlike(preferred))
    return kept.groupBy(by).agg(F.count(F.lit(1)).alias("notices"), F.max("notice_id").alias("_n")).select(
        by, "notices", F.when(F.col("notices") == 1, F.col("_n")).alias("notice_id"))


def class_amount(rows: DataFrame) -> DataFrame:
    """Common amount for the first code of an issuer, preferred amount for its siblings."""
    first = rows.groupBy("corp_code").agg(F.min("code").alias("_first"))
    return rows.join(first, "corp_code").withColumn("class_amount", F.when(
        F.col("code") == F.col("_first"), F.col("common_amount")).otherwise(F.col("preferred_amount"))).drop("_first")


def coded_value(html: Column | str, code: str) -> Column:
    """Text of the last element that carries the given ``acode``."""
    p = rf'(?is)<[^>]*\bacode="{re.escape(code)}"[^>]*>(.*?)</'
    return strip_markup(last_match(_c(html), p))


def none_after(text: Column | str, label: str, width: int = 40, words: Sequence[str] = ("해당사항 없음", "해당없음", "없음")) -> Column:
    return _c(text).rlike(rf"(?s){re.escape(label)}.{{0,{width}}}?(?:{'|'.join(words)})")


NAME_BYTES = 1 << 20   # names that one automaton holds


def names_in_text(names: DataFrame, docs: DataFrame, name: str, key: str, text: str, most_bytes: int = NAME_BYTES) -> DataFrame:
    """(key, name) for every name that occurs in a text.

    Each task scans its texts once for all names, by an automaton; only hits
    leave it. Names go through in groups of bounded bytes, each with a scan of
    its own, so an automaton never grows with the table of names.
    """
    wanted = names.select(F.col(name).alias("_name")).where(F.length("_name") > 0).distinct()
    total = wanted.agg(F.sum(F.octet_length("_name"))).first()[0] or 0
    groups = -(-total // most_bytes)
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {name} string"
    out = docs.sparkSession.createDataFrame([], schema)
    for g in range(groups):
        words = [r[0] for r in wanted.where(F.pmod(F.xxhash64("_name"), F.lit(groups)) == g).collect()]   # bounded by most_bytes, or by one name

        def run(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            import ahocorasick
            found = ahocorasick.Automaton()
            for w in words:
                found.add_word(w, w)
            found.make_automaton()
            for batch in batches:
                keys, hits = [], []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = {w for _, w in found.iter(t)} if t else ()
                    keys += [k] * len(own)
                    hits += own
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(hits, pa.string())], names=[key, name])

        if words:
            out = out.unionByName(docs.select(key, text).mapInArrow(run, schema))
    return out.distinct()
