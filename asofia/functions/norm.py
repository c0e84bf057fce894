"""Normalisation and predicate expressions used at ingest and in rules.

All of them are built-in column expressions, so they stay inside whole-stage
code generation and can be pushed below exchanges.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Words that mark a source reference as not filled in.
PLACEHOLDER_WORDS = ("REPLACE_WITH", "PLACEHOLDER", "EXAMPLE")
PLACEHOLDER_WORDS_EVENTS = ("REPLACE_WITH", "PLACEHOLDER", "EXAMPLE", "TODO", "TBD")
# Spellings of true in boolean text columns.
TRUE_WORDS = ("1", "true", "yes", "y")
FALSE_WORDS = ("0", "false", "no", "n")
# Industry words that mark a financial firm.
FINANCIAL_WORDS = ("금융", "은행", "증권", "보험")
# Label words for cash dividends and for common stock.
CASH_LABEL_WORDS = ("주당현금배당금", "주당배당금", "현금배당금(원)")
RESEARCH_CUTOFF = "20260709"
OPEN_END = "99991231"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_code(c: Column | str) -> Column:
    """Trim and zero-fill to six characters; longer codes are left alone."""
    t = F.trim(_col(c))
    return F.when(F.length(t) < 6, F.lpad(t, 6, "0")).otherwise(t)


def norm_date(c: Column | str) -> Column:
    """Loose date key: null becomes '', separators are dropped."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[-.]", ""))


def strict_date(c: Column | str) -> Column:
    """Digits only; '' unless they are exactly a real yyyymmdd date."""
    digits = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[^0-9]", "")
    ok = (F.length(digits) == 8) & F.try_to_date(digits, "yyyyMMdd").isNotNull()
    return F.when(ok, digits).otherwise(F.lit(""))


def to_day(c: Column | str) -> Column:
    """yyyymmdd text to DateType, null when it is not a date."""
    return F.try_to_date(_col(c), "yyyyMMdd")


def day_number(c: Column | str) -> Column:
    """Days since 1970-01-01 of a yyyymmdd text, for range frames."""
    return F.unix_date(to_day(c))


# Year 2000-2099, one or two separators or unit words, month, day.
DATE_IN_TEXT = r"(20[0-9]{2})\s*[-./년]\s*([0-9]{1,2})\s*[-./월]\s*([0-9]{1,2})"


def first_date(c: Column | str) -> Column:
    """First date written in running text, as yyyymmdd, '' if none."""
    t = F.coalesce(_col(c), F.lit(""))
    year = F.regexp_extract(t, DATE_IN_TEXT, 1)
    month = F.lpad(F.regexp_extract(t, DATE_IN_TEXT, 2), 2, "0")
    day = F.lpad(F.regexp_extract(t, DATE_IN_TEXT, 3), 2, "0")
    return F.when(year != "", F.concat(year, month, day)).otherwise(F.lit(""))


def clean_number(c: Column | str) -> Column:
    """Drop thousands separators and unit marks; '-', '' and junk become null."""
    t = F.regexp_replace(F.trim(_col(c)), r"[,원%\s]", "")
    return F.when(~t.isin("", "-"), t.try_cast("double"))


def is_placeholder(c: Column | str, words: Sequence[str] = PLACEHOLDER_WORDS) -> Column:
    return F.upper(F.coalesce(_col(c), F.lit(""))).rlike("|".join(words))


def before_cutoff(c: Column | str, cutoff: str = RESEARCH_CUTOFF) -> Column:
    return _col(c) <= F.lit(cutoff)


def pct_ratio(n: Column | str, d: Column | str, digits: int | None = None) -> Column:
    """n / d * 100; null when an input is null or the denominator is zero."""
    value = F.when(_col(d) != 0, _col(n) / _col(d) * 100)
    return value if digits is None else F.round(value, digits)


def norm_text(c: Column | str) -> Column:
    """Lower-case without blanks and underscores."""
    return F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[ _]", ""))


def base_title(c: Column | str) -> Column:
    """Title without leading amendment / attachment tags and without blanks."""
    compact = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s", "")
    return F.regexp_replace(compact, r"^(\[[^\]]*(정정|첨부|추가)[^\]]*\])+", "")


def contains_any(c: Column | str, words: Iterable[str]) -> Column:
    """True when the text holds any of the literal words."""
    words = list(words)
    test = F.lit(False)
    for word in words:
        test = test | F.coalesce(_col(c), F.lit("")).contains(word)
    return test


def contains_all(c: Column | str, words: Iterable[str]) -> Column:
    test = F.lit(True)
    for word in words:
        test = test & F.coalesce(_col(c), F.lit("")).contains(word)
    return test


def is_cash_label(c: Column | str, words: Sequence[str] = CASH_LABEL_WORDS) -> Column:
    return contains_any(norm_text(c), words)


def is_common_stock(c: Column | str, preferred: Sequence[str] = ("우선",),
                    common: Sequence[str] = ("보통",)) -> Column:
    """Blank and '-' count as common stock; preferred classes never do."""
    t = norm_text(c)
    return (t.isin("", "-") | contains_any(t, common)) & ~contains_any(t, preferred)


def is_financial(c: Column | str, words: Sequence[str] = FINANCIAL_WORDS) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike("|".join(words))


def mask_columns(df: DataFrame, columns: Sequence[str], hide: Column) -> DataFrame:
    """Null the given columns on the rows where ``hide`` holds."""
    return df.withColumns({c: F.when(~hide, F.col(c)) for c in columns})


def parse_bool(c: Column | str) -> Column:
    """True / false from text, null for anything else."""
    t = F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))
    return F.when(t.isin(*TRUE_WORDS), F.lit(True)).when(t.isin(*FALSE_WORDS), F.lit(False))


def finite(c: Column | str) -> Column:
    """NaN and infinities become null."""
    x = _col(c)
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~bad, x)


def join_reasons(conditions: Sequence[tuple[Column, str]], separator: str = " | ") -> Column:
    """Labels of all conditions that hold, in the given order."""
    return F.concat_ws(separator, *[F.when(cond, F.lit(label)) for cond, label in conditions])


def first_reason(conditions: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Label of the first condition that holds (an ordered rule table)."""
    out: Column | None = None
    for cond, label in conditions:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out if otherwise is None else out.otherwise(F.lit(otherwise))


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Raise with the sorted list of missing columns, else pass through."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def apply_rules(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add ``reasons`` (names of the broken rules) and ``row_valid``.

    Each rule is a name and the condition under which the row is bad; a null
    condition counts as bad, so an unreadable value never passes.
    """
    broken = F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]))
    return df.withColumn("reasons", broken).withColumn("row_valid", F.size("reasons") == 0)
