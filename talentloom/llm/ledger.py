"""A ledger of quality rules: every rule is evaluated once per document and kept as one bit, beside what was measured.

Policies are versions: masks over the rule bits. A new policy, its verdicts, and what each of its rules does alone or
together with others come from the stored bits by bitwise work, without reading a text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import text_batches, utf8

#: Characters that count as symbols, in their order.
SYMBOLS = b"#*$%&|<>"
#: Characters that begin a list item.
BULLETS = tuple(x.encode() for x in "-*•")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_capitals",
            "n_small", "n_digits", "n_calls", "n_bullets")
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS, _SMALL, _DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_LETTER = re.compile(rb"[A-Za-z\x80-\xFF]")

#: Rules in the order of their bits; a rule that is true fails the document. Add new ones at the end.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 100000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "few_letters": "100 * n_letter_words < 80 * n_words",
    "capitals": "100 * n_capitals > 40 * (n_capitals + n_small)",
    "digits": "100 * n_digits > 20 * word_chars",
    "exclamations": "100 * n_calls > 20 * n_words",
    "bullets": "100 * n_bullets > 90 * n_lines",
}
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that a version applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "text-1": (*BASE, "many_words", "short_words", "long_words", "symbols", "few_letters"),
    "text-2": tuple(RULES),
}
LATEST = "text-2"


def mask_of(rules: Iterable[str], known: Iterable[str] = RULES) -> int:
    """The bits of the named rules."""
    order = {name: i for i, name in enumerate(known)}
    return reduce(lambda m, name: m | 1 << order[name], rules, 0)


def _tokens(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers in the order of the text, and the distinct words. A long text is cut at white space, so that no more than a
    piece of it is held as words."""
    seen: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(data):
        stop = _SPACE.search(data, at + _PIECE)
        end = stop.start() if stop else len(data)
        words = data[at:end].split()
        parts.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words)))
        at = end
    return (np.concatenate(parts) if parts else np.array([], dtype=np.int64)), list(seen)


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words found at least twice."""
    if len(ids) < 3:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = order[np.r_[same, False] | np.r_[False, same]]
    marked = np.zeros(len(ids), dtype=bool)
    for step in range(3):
        marked[twice + step] = True
    return int(marked.sum())


def measure(data: bytes) -> tuple[int, ...]:
    """The ``MEASURES`` of a text in UTF-8."""
    ids, words = _tokens(data)
    lines = [line for line in (x.strip() for x in data.split(b"\n")) if line]
    whole = [line for line in data.split(b"\n") if line.strip()]
    count = lambda of: len(data) - len(data.translate(None, of))
    lettered = np.fromiter((_LETTER.search(w) is not None for w in words), dtype=bool, count=len(words))
    return (len(ids), len(data.translate(None, b" \t\n\v\f\r").decode("utf-8", "replace")), count(SYMBOLS), len(lines),
            len(whole) - len(set(whole)), _repeated(ids, len(words)), int(lettered[ids].sum()) if len(ids) else 0,
            count(_CAPITALS), count(_SMALL), count(_DIGITS), count(b"!"), sum(line.startswith(BULLETS) for line in lines))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures in place of the text; columns of these names are replaced."""
    kept = [c for c in docs.columns if c != text and c not in MEASURES]
    schema = docs.select(*kept, *[F.lit(0).cast("long").alias(m) for m in MEASURES]).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = np.array([measure(x) for x in utf8(batch.column(text))], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x) for x in found.T)],
                                             names=[*kept, *MEASURES])

    return docs.select(*kept, text).mapInArrow(run, schema)


def ledger(docs: DataFrame, rules: Mapping[str, Column | str] = RULES) -> DataFrame:
    """``docs`` without the text, with the measures and ``failed``: bit i is set where rule i fails the document.

    Null and blank texts have no words: they fail the rule on few words and no rule that compares shares. Repeated rows and null
    ids stay as they are. At most 63 rules."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules")
    bits = [F.when(F.expr(r) if isinstance(r, str) else r, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
            for i, r in enumerate(rules.values())]
    return measured(docs.drop("failed")).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long")))


def _against(mask: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask).cast("long"))


def judge(book: DataFrame, policies: Mapping[str, Iterable[str]] = POLICIES, rules: Iterable[str] = RULES) -> DataFrame:
    """``book`` with ``verdicts``: for each policy version, whether the document is kept. Texts are not read."""
    rules = list(rules)
    pairs = [x for version, names in policies.items() for x in (F.lit(version), _against(mask_of(names, rules)) == 0)]
    return book.withColumn("verdicts", F.create_map(*pairs))


def patterns(book: DataFrame, policy: Iterable[str], rules: Iterable[str] = RULES, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, failed, n): documents by the set of the policy's rules that they fail; combined before the shuffle. There are never
    more rows than distinct sets."""
    return book.groupBy(*by, _against(mask_of(policy, list(rules))).alias("failed")).agg(F.count(F.lit(1)).alias("n"))


def ablations(book: DataFrame, policy: Iterable[str], rules: Iterable[str] = RULES, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, rule, n_docs, n_failed, n_alone, kept, kept_without, failed_with, always_with) for each rule of the policy.

    n_failed fail the rule, n_alone fail no other rule of the policy, so the policy without it keeps ``kept_without``.
    ``failed_with`` has the bits of all rules that fail together with it somewhere, ``always_with`` of those that always do
    (both 0 where no document fails it)."""
    rules, policy = list(rules), list(policy)
    sets = patterns(book, policy, rules, by)
    bits = [F.struct(F.lit(name).alias("rule"), F.lit(1 << rules.index(name)).cast("long").alias("bit")) for name in policy]
    if not bits:
        raise ValueError("a policy has at least one rule")
    each = sets.select(*by, "failed", "n", F.explode(F.array(*bits)).alias("_r")).select(
        *by, "failed", "n", "_r.rule", "_r.bit", (F.col("failed").bitwiseAND(F.col("_r.bit")) != 0).alias("_hit"))
    number = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    others = F.when(F.col("_hit"), F.col("failed").bitwiseAND(F.bitwise_not("bit")))
    return each.groupBy(*by, "rule").agg(
        number(F.lit(True)).alias("n_docs"), number(F.col("_hit")).alias("n_failed"),
        number(F.col("failed") == F.col("bit")).alias("n_alone"), number(F.col("failed") == 0).alias("kept"),
        number((F.col("failed") == 0) | (F.col("failed") == F.col("bit"))).alias("kept_without"),
        F.coalesce(F.bit_or(others), F.lit(0)).alias("failed_with"), F.coalesce(F.bit_and(others), F.lit(0)).alias("always_with"))


def keep(docs: DataFrame, version: str = LATEST) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed, policy) of every row."""
    book = ledger(docs.select("doc_id", "text"))
    base = _against(mask_of(BASE)) != 0
    verdict = _against(mask_of(POLICIES[version])) == 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base.alias("base_failed"), (~base & verdict).alias("kept"), "failed", F.lit(version).alias("policy"))
