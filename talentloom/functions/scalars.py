"""Column -> Column helpers: coercion, text, scoring arithmetic and formatting.

All of them are built-in expressions, so they stay inside the JVM. The one
exception is Unicode NFKD folding, which Spark lacks (an Arrow UDF that only
receives texts holding non-ASCII characters).
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentloom import settings as S

# str.isspace() also counts the four separator controls 1C-1F.
SPACE = r"(?U)[\s\x1c-\x1f]+"
_FLOAT_TEXT = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$"
_INT_TEXT = r"^\s*[+-]?\d+\s*$"


def build_once(builder: Callable) -> Callable:
    """Keep the Columns a builder returns, per JVM and arguments.

    Columns name their inputs and are resolved per query, so one tree serves every
    DataFrame. Building a large one costs thousands of gateway calls.
    """
    memo: dict = {}

    @functools.wraps(builder)
    def built(*args):
        gateway = SparkContext._gateway
        if memo.get("gateway") is not gateway:  # another JVM: its Columns are of no use
            memo.clear()
            memo["gateway"] = gateway
        if args not in memo:
            memo[args] = builder(*args)
        return memo[args]
    return built


def element_rows(df: DataFrame, array: str, *keep: str, pos: str = "pos", element: str = "element") -> DataFrame:
    """One row per array element with its position (1 = first); no row for empty arrays.

    The plain explode makes the optimizer infer a filter on the array, which it
    pushes down by copying the array's whole expression into the predicate. The
    outer form with a filter on the generated position computes the array once.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("_pos", element)).where("_pos IS NOT NULL")
    return rows.select(*keep, (F.col("_pos") + 1).alias(pos), element)


def fence(df: DataFrame) -> DataFrame:
    """Same rows, but filters above are not pushed into the expressions below."""
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))


def step(df: DataFrame) -> DataFrame:
    """Same rows in the same tasks; what is selected above is compiled apart from what lies below.

    Projections in a row become one Java method, and the JVM leaves a method of more than 8000 bytes to its interpreter. A coalesce to
    more partitions than there are moves nothing and ends the method; columns that nobody selects are still pruned through it.
    """
    return df.coalesce(1 << 20)


# -- coercion of VARIANT leaves ------------------------------------------------

def _kind(leaf: Column) -> Column:
    return F.schema_of_variant(leaf)


def variant_float(leaf: Column, default: float = 0.0) -> Column:
    """Float of a JSON leaf; missing, null and unparseable values give the default."""
    text = F.try_variant_get(leaf, "$", "string")
    kind = _kind(leaf)
    parsed = (
        F.when(kind == "STRING", F.when(text.rlike(_FLOAT_TEXT), F.trim(text).try_cast("double")))
        .when(kind == "BOOLEAN", F.try_variant_get(leaf, "$", "boolean").cast("int").cast("double"))
        .otherwise(F.try_variant_get(leaf, "$", "double"))
    )
    return F.coalesce(parsed, F.lit(default))


def variant_int(leaf: Column, default: int = 0) -> Column:
    """Int of a JSON leaf: 12.7 is cut to 12, "12" is 12, "12.5" gives the default."""
    text = F.try_variant_get(leaf, "$", "string")
    kind = _kind(leaf)
    parsed = (
        F.when(kind == "STRING", F.when(text.rlike(_INT_TEXT), F.trim(text).try_cast("bigint")))
        .when(kind == "BOOLEAN", F.try_variant_get(leaf, "$", "boolean").cast("bigint"))
        .otherwise(F.coalesce(F.when(kind == "BIGINT", F.try_variant_get(leaf, "$", "bigint")),
                             F.try_variant_get(leaf, "$", "double").try_cast("bigint")))
    )
    return F.coalesce(parsed, F.lit(default).cast("bigint"))


def variant_bool(leaf: Column, default: bool = False) -> Column:
    """Only a JSON boolean counts; "true" and 1 give the default."""
    return F.coalesce(
        F.when(_kind(leaf) == "BOOLEAN", F.try_variant_get(leaf, "$", "boolean")), F.lit(default)
    )


def variant_str(leaf: Column, default: str | None = "") -> Column:
    """Text of any JSON leaf; null and missing give the default."""
    text = F.try_variant_get(leaf, "$", "string")
    text = F.when(_kind(leaf) == "BOOLEAN", F.initcap(text)).otherwise(text)
    return text if default is None else F.coalesce(text, F.lit(default))


def to_list(values: Column, element_type: str) -> Column:
    """NULL lists become empty lists."""
    return F.coalesce(values, F.array().cast(f"array<{element_type}>"))


# -- text ----------------------------------------------------------------------

@F.pandas_udf(T.StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def fold_unicode(text: Column) -> Column:
    """NFKD form. ASCII texts never leave the JVM: the UDF sees NULL for them."""
    foreign = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.coalesce(_nfkd(foreign), text)


def squeeze_spaces(text: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_text(text: Column) -> Column:
    return squeeze_spaces(fold_unicode(F.coalesce(text, F.lit(""))))


def clean_text(text: Column) -> Column:
    """Normalised text without control, format, surrogate and unassigned characters."""
    return F.trim(F.regexp_replace(normalize_text(text), r"\p{C}", ""))


def lower_or_empty(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def words(text: Column) -> Column:
    """Non-empty tokens between white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Pieces after . ! ? and white space, trimmed, without empties."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])(?U)[\s\x1c-\x1f]+")
    trimmed = F.transform(pieces, lambda p: F.regexp_replace(p, r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+$", ""))
    return F.filter(trimmed, lambda p: p != "")


#: Characters that count as white space around a field.
WHITE = (" \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
         "\u2028\u2029\u202f\u205f\u3000")


def join_fields(*fields: Column, separator: str = " ") -> Column:
    """The fields that are not blank, without the white space around them."""
    return F.concat_ws(separator, *[F.nullif(F.btrim(f, F.lit(WHITE)), F.lit("")) for f in fields])


def contains_any(text: Column, terms: Sequence[str], ignore_case: bool = True) -> Column:
    """True if any term occurs; plain OR of literals, so codegen and short-circuit hold."""
    body = F.lower(text) if ignore_case else text
    hit = F.lit(False)
    for term in terms:
        hit = hit | body.contains(term.lower() if ignore_case else term)
    return F.coalesce((text != "") & hit, F.lit(False))


def count_occurrences(text: Column, term: Column, ignore_case: bool = True) -> Column:
    """Non-overlapping occurrences of a term; 0 when either is empty."""
    body, needle = (F.lower(text), F.lower(term)) if ignore_case else (text, term)
    removed = F.octet_length(body) - F.octet_length(F.replace(body, needle, F.lit("")))  # bytes need no scan
    count = F.when((text != "") & (term != ""), F.floor(removed / F.octet_length(needle)).cast("int"))
    return F.coalesce(count, F.lit(0))


def truncate_words(text: Column, max_length: int = 500) -> Column:
    """Cut at max_length, at the last blank if it lies in the last fifth, and add dots."""
    head = F.substring(text, 1, max_length)
    from_end = F.locate(" ", F.reverse(head))
    last_blank = F.when(from_end > 0, max_length - from_end).otherwise(F.lit(-1))
    cut = F.when(last_blank > max_length * 0.8, head.substr(F.lit(1), last_blank)).otherwise(head)
    return F.when(F.length(text) <= max_length, text).otherwise(F.concat(cut, F.lit("...")))


def seniority(title: Column, levels: Mapping[str, int] = S.SENIORITY_LEVELS,
              floor: int = S.SENIORITY_FLOOR) -> Column:
    """Highest level whose keyword is a substring of the title, never below the floor."""
    return let(lower_or_empty(title), lambda lowered: F.greatest(
        F.lit(floor), *[F.when(F.contains(lowered, F.lit(word)), F.lit(level)) for word, level in levels.items()]))


def company_size_level(size: Column, sizes: Sequence[str] = S.COMPANY_SIZES) -> Column:
    """1 for the smallest band upwards, 0 for anything unknown."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in sizes]), size), F.lit(0)).cast("int")


def text_relevance(text: Column, keywords: Column) -> Column:
    """0.15 per keyword found in the text, at most 1."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(text, k)))
    score = clip(hits * 0.15)
    return F.when((text != "") & (F.size(keywords) > 0), score).otherwise(F.lit(0.0))


# -- arithmetic ----------------------------------------------------------------

def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(float(default))).otherwise(F.try_divide(a, b))


def weighted_average(values: Sequence[Column], weights: Sequence[Column | float]) -> Column:
    """Sum of value * weight over the sum of weights; 0 when the weights sum to 0."""
    if not values or not weights:
        return F.lit(0.0)
    cols = [w if isinstance(w, Column) else F.lit(float(w)) for w in weights]
    total = cols[0]
    dot = values[0] * cols[0]
    for value, weight in zip(values[1:], cols[1:]):
        total = total + weight
        dot = dot + value * weight
    return F.when(total == 0, F.lit(0.0)).otherwise(dot / total)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -500.0, 500.0)))


def sum_of(values: Column) -> Column:
    """Sum of an array of numbers, in array order, as double."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value so that the body may use it often at the price of one evaluation.

    Catalyst shares repeated expressions of a projection, but not inside lambdas.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean_of(values: Column) -> Column:
    """Mean of an array of numbers, 0 for an empty one."""
    return let(values, lambda v: F.when(F.size(v) > 0, sum_of(v) / F.size(v)).otherwise(F.lit(0.0)))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


# -- number formatting -----------------------------------------------------------
# format_number rounds the exact binary value half-even, as the expected output
# does; format_string and round work on the decimal text and differ on ties.

def fixed(x: Column, digits: int) -> Column:
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def percent(x: Column) -> Column:
    return F.concat(fixed(x * 100, 0), F.lit("%"))


def round_exact(x: Column, digits: int) -> Column:
    """Round as the formatter does. For final (top-K) rows; it goes through text."""
    return fixed(x, digits).cast("double")
