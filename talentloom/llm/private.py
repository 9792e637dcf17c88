"""Personal data behind disguises, found on a normalised copy of the text and mapped back to the source.

A transducer reads the text once and writes a plain copy: look-alike letters and digits become ASCII, spelled digits
become digits, and "(at)", "[dot]" and the like become the signs they stand for. Every written character carries the span
of source characters it came from, so a span found in the copy has exact source offsets.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from talentloom.llm.common import strings, text_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its first digit only: if that fails, so does every later one
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like ASCII letters, by the letter they pass for.
LOOKALIKES = {"a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "k": "κ", "l": "ӏ",
              "m": "м", "n": "п", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υս", "v": "ѵν", "w": "ԝω",
              "x": "хχ", "y": "уү", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ",
              "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
              "@": "＠﹫", ".": "．。․﹒｡", "-": "‐‑‒–−﹣－",
              "+": "\uff0b\ufe62", " ": "\u00a0\u2002\u2003\u2009\u202f\u3000"}
#: Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
           "seven": "7", "eight": "8", "nine": "9"}
_PLAIN = {c: plain for plain, others in LOOKALIKES.items() for c in others}
_UNSEEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_ODD = re.compile(r"[^\x00-\x7f]")
_BRACKETED = r"[\(\[\{<]\s*(?:%s)\s*[\)\]\}>]"
_AT = re.compile(_BRACKETED % "at|@", re.I)
_DOT = re.compile(_BRACKETED % r"dot|punto|point|punkt|\.", re.I)
_TOKEN = re.compile(r"\S+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
#: Endings of domains that a spoken address may have. Country codes that are common words are left out.
ENDINGS = frozenset("""com org net edu gov mil int info biz io app dev name pro co online site shop store tech cloud email mail
    blog news example test invalid local lan uk de fr es it nl be ch at se dk fi pl cz ru ua eu us ca mx br ar cl au nz jp cn
    kr hk tw sg ie pt gr hu ro tr za il ae""".split())
#: Words that stand before "at" in prose and are no mailbox.
PROSE = frozenset("""a about again alive all also am an and any anyone are as ask available back be been being bought but buy call
    came check click come contact did do eat everyone find for found free from get go goes gone good had has have he her here
    him his home hosted i in is it its join just keep kept know learn left live lived lives located look looks made me meet
    met more my near not now of off on one online only open or order our out page people read reach see seen sell sent set she
    shop site sit sold so someone start stay stop sure team than that the their them then there these they this those time to
    today up us visit was we website well went were what when where who will with work works write you your""".split())
_NUMBER_WORD = re.compile(r"(?<![A-Za-z])(?:%s)(?![A-Za-z])" % "|".join(SPELLED), re.I)
_NUMERAL = re.compile(r"(?:(?<![A-Za-z])(?:%s)(?![A-Za-z])|(?<![A-Za-z0-9])[0-9]+(?![A-Za-z0-9]))" % "|".join(SPELLED), re.I)
_MIXED = re.compile(r"[0-9](?:[\s,.()-]+|\s*dot\s*)(?:%s)(?![A-Za-z])|(?<![A-Za-z])(?:%s)(?:[\s,.()-]+|\s*dot\s*)[0-9]"
                    % (("|".join(SPELLED),) * 2), re.I)
_DOT_OF_NUMBERS = re.compile(r"(?<=[0-9])\s+dot\s+(?=[0-9])", re.I)
_DOTS_SPOKEN = re.compile(r"\s*dot\s*", re.I)
_TRIGGERS = re.compile(r"[\(\[\{<]\s*(?:at|@|dot|punto|point|punkt|\.)\s*[\)\]\}>]|\sdot\s"
                       r"|[A-Za-z0-9_%+-]\s+at\s+[A-Za-z0-9-]+\.[A-Za-z0-9]", re.I)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _octet(part: str) -> bool:
    value = part.lstrip("0") or "0"
    return len(value) <= 3 and int(value) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        x = int(c) * (1 + at % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of undisguised identifiers, leftmost and non-overlapping for each kind. Time is linear."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    if any(d in text for d in "0123456789"):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class _Copy:
    """A text under rewriting: characters, and the source span of each."""

    def __init__(self, text: str):
        self.text, self.starts = text, np.arange(len(text))
        self.ends = self.starts + 1

    def replace(self, changes: list[tuple[int, int, str]]) -> None:
        """Puts new text for the given spans (ascending, not empty); each new character stands for the whole of its span."""
        if not changes:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in changes:
            text += [self.text[at:a], new]
            starts += [self.starts[at:a], np.full(len(new), self.starts[a])]
            ends += [self.ends[at:a], np.full(len(new), self.ends[b - 1])]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]])


def _fold_letters(copy: _Copy) -> None:
    changes = []
    for m in _ODD.finditer(copy.text):
        c = m.group()
        new = "" if c in _UNSEEN else _PLAIN.get(c)
        if new is None:
            folded = unicodedata.normalize("NFKC", c)
            digit = unicodedata.decimal(c, None)
            new = str(digit) if digit is not None else folded if len(folded) == 1 and folded.isascii() else None
        if new is not None:
            changes.append((m.start(), m.end(), new))
    copy.replace(changes)


def _around(text: str, pattern: re.Pattern, sign: str) -> list[tuple[int, int, str]]:
    """Replacements of the matches with the white space on either side, which is walked from the match outwards."""
    out, last = [], 0
    for m in pattern.finditer(text):
        a, b = m.span()
        while a > last and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        out.append((a, b, sign))
        last = b
    return out


def _mailbox(text: str, tokens: list[tuple[int, int]], words: list[str], at: int, last: int) -> int:
    """The first token of the local part that ends before the token ``at``; ``at`` itself if there is none."""
    first = at
    while first > last:
        a, b = tokens[first - 1]
        local = _LOCAL_END.search(text, max(a, b - 320), b)
        if not local or words[first - 1] == "at":
            break
        first -= 1
        if local.start() > a or first - 2 < last or words[first - 1] != "dot":
            break
        first -= 1
    if first < at and words[first] == "dot":
        first += 1
    return first


def _spoken(text: str) -> list[tuple[int, int, str]]:
    """Replacements for " at " and " dot " of spoken addresses, in one pass over the tokens.

    A domain has a spoken dot or is plainly dotted, and ends in a known ending; the word before "at" is none that prose puts
    there. A dot also goes on an address whose sign is already written."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    words = [text[a:b].lower() if b - a <= 3 else "" for a, b in tokens]
    between = lambda k: (tokens[k - 1][1], tokens[k + 1][0])
    out, last, k = [], 0, 1
    while k < len(tokens) - 1:
        if words[k] == "dot" and "@" in text[tokens[k - 1][0]:tokens[k - 1][1]]:
            while k < len(tokens) - 1 and words[k] == "dot" and text[tokens[k - 1][1] - 1].isalnum() and text[tokens[k + 1][0]].isalnum():
                out.append((*between(k), "."))
                k += 2
            last = k
        elif words[k] == "at":
            after, dots, label = k + 1, [], None
            while after < len(tokens) and words[after] not in ("at", "dot"):
                label = _LABELS.match(text, *tokens[after])
                if not label or label.end() < tokens[after][1] or after + 2 >= len(tokens) or words[after + 1] != "dot":
                    break
                dots.append(after + 1)
                after += 2
            if label is None and dots:
                dots.pop()
            first = _mailbox(text, tokens, words, k, last)
            ending = label.group().rpartition(".")[2].lower() if label else ""
            box = _LOCAL_END.search(text, *tokens[first]).group() if first < k else ""
            prose = first + 1 == k and (box.lower() in PROSE or (box.isalpha() and len(box) > 5 and box.lower().endswith(("ed", "ing"))))
            if box and label and (dots or "." in label.group()) and ending in ENDINGS and not prose:
                out += [(*between(x), ".") for x in range(first + 1, k, 2)]
                out.append((*between(k), "@"))
                out += [(*between(x), ".") for x in dots]
                last = k = after
        k += 1
    return out


def _fold_signs(copy: _Copy) -> None:
    copy.replace(_around(copy.text, _AT, "@"))
    copy.replace(_around(copy.text, _DOT, "."))
    if re.search(r"\s(?:dot|at)\s", copy.text, re.I):
        copy.replace(_spoken(copy.text))
        copy.replace([(*m.span(), ".") for m in _DOT_OF_NUMBERS.finditer(copy.text)])


def _fold_numbers(copy: _Copy) -> None:
    """Runs of at least four digits, spelled ones and numerals together, become one number if any is spelled; "plus" before
    a run becomes +, "dot" and a full stop next to a numeral a full stop. Which runs are identifiers is left to the patterns."""
    runs: list[list[re.Match]] = []
    for m in _NUMERAL.finditer(copy.text):
        gap = copy.text[runs[-1][-1].end():m.start()] if runs else None
        numeral = runs and (m.group()[0].isdigit() or runs[-1][-1].group()[0].isdigit())
        if runs and (not gap.strip(" \t\n\r,.-()" if numeral else " \t\n\r,.-") or _DOTS_SPOKEN.fullmatch(gap)):
            runs[-1].append(m)
        else:
            runs.append([m])
    changes = []
    for run in runs:
        words = [m.group() for m in run]
        if all(w[0].isdigit() for w in words) or sum(len(w) if w[0].isdigit() else 1 for w in words) < 4:
            continue
        dotted = any(_DOTS_SPOKEN.fullmatch(g) or g == "." for a, b in zip(run, run[1:]) for g in [copy.text[a.end():b.start()]])
        before = re.search(r"plus[\s,]+\Z", copy.text[max(0, run[0].start() - 12):run[0].start()], re.I)
        if before:
            changes.append((run[0].start() - len(before.group()), run[0].start(), "+"))
        for i, m in enumerate(run):
            if i:
                gap = copy.text[run[i - 1].end():m.start()]
                numerals = words[i - 1][0].isdigit() + words[i][0].isdigit()
                if _DOTS_SPOKEN.fullmatch(gap) or (gap == "." and numerals):
                    changes.append((run[i - 1].end(), m.start(), "."))
                elif numerals < 2 or ("," in gap and not dotted):  # else what parts two numerals is left as it is
                    changes.append((run[i - 1].end(), m.start(), ""))
            if not words[i][0].isdigit():
                changes.append((*m.span(), SPELLED[words[i].lower()]))
    copy.replace(changes)


def normalise(text: str) -> _Copy:
    copy = _Copy(text)
    _fold_letters(copy)
    _fold_signs(copy)
    _fold_numbers(copy)
    return copy


def _disguised(text: str) -> bool:
    """Whether a transducer may find something to rewrite that matters: an accent alone is no disguise."""
    if _TRIGGERS.search(text) or _MIXED.search(text):
        return True
    if not text.isascii() and any(c in _UNSEEN or c in _PLAIN or unicodedata.normalize("NFKC", c).isascii()
                                  or unicodedata.decimal(c, None) is not None for c in set(text) if c > "\x7f"):
        return True
    return any(i >= 3 for i, _ in zip(range(4), _NUMBER_WORD.finditer(text), strict=False))


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Plain spans, and those found behind disguises: mapped to source offsets, and only where they overlap no plain span
    or hold plain spans of their own kind in full (a disguise may leave a part of an identifier in plain sight)."""
    base = plain_spans(text)
    if not _disguised(text):
        return base, []
    copy = normalise(text)
    if copy.text == text:
        return base, []
    more = []
    for a, b, kind in plain_spans(copy.text):
        start, end = int(copy.starts[a]), int(copy.ends[b - 1])
        met = [x for x in base if x[0] < end and start < x[1]]
        if all(start <= x and y <= end and (start, end) != (x, y) and k == kind for x, y, k in met):
            more.append((start, end, kind))
    return base, more


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_private(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    The counts and the hash are those of the undisguised matches; ``spans`` also lists the ``n_added`` disguised ones, in
    code points of the source. A null or empty text has no spans (the hash of the empty text, and an empty list).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            out = []
            for text in strings(batch.column("text")):
                base, more = find(text)
                counts = [sum(k == kind_ for _, _, k in base) for kind_ in KINDS]
                out.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4]),
                 pa.array(columns[5]), pa.array(columns[6], pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, "
                                                         "n_phone long, base_sha256 string, spans string, n_added long")
