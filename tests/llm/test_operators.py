"""Every operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from talentloom.llm import (common, crf, feistel, graph, imatch, lattice, pivotal, private, ranking, simhash, suffixes,
                            tiling)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, fp string, _n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOWELS = ("ba", "ke", "ti", "no", "ru", "sa", "mi", "lo")


def words(rng, n):
    return " ".join("".join(rng.choice(VOWELS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(seed=1):
    """Ids, texts, languages, sources; with nulls, an empty and a long text, copies, near copies and a repeated row."""
    rng = random.Random(seed)
    out = [(i, words(rng, rng.randint(3, 60)), rng.choice(["xx", "yy"]), rng.choice(["a", "b", "c", None])) for i in range(40)]
    out += [(100, out[3][1], "xx", "a"), (101, out[3][1].upper(), "xx", "a"), (102, out[3][1] + " ende", "xx", "b"),
            (103, None, None, None), (104, "", "yy", "a"), (105, " \t\n", "xx", "a"), (106, words(rng, 3000), "xx", "c"),
            (107, "1234 !!", "xx", "b"), (None, "ba ke", "xx", "a"), (None, None, "xx", "b")]
    return out + [out[5]]


def table(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(i, t, lang, s, 0, 0.5, 7, "x", 3) for i, t, lang, s in data], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


# shared helpers

def test_row_numbers_follow_the_order_and_have_no_gaps(spark, docs):
    got = common.numbered(docs.select("doc_id", "text"), [F.col("doc_id"), F.col("text")], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(len(rows())))
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


def test_components_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 130)] + [(7, 7), (101, 100)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 130)}}


# 1

def brute_lattice(word, pieces):
    """Sum over every segmentation, by recursion on the first piece."""
    mark = "▁" + word

    def total(at):
        if at == len(mark):
            return 1.0
        spelled = math.prod(math.exp(pieces.bytes_[b]) for b in mark[at].encode())
        out = spelled * total(at + 1)
        for end in range(at + 1, len(mark) + 1):
            if mark[at:end] in scores:
                out += scores[mark[at:end]] * total(end)
        return out

    scores = brute_lattice.scores
    return math.log(total(0))


def test_lattice_sums_all_segmentations():
    texts, values = ["▁", "▁a", "a", "b", "ab", "▁ab", "aba", ""], [-1] * 7 + [ord("c")]
    pieces = lattice.pieces_from(texts, values, {0: 3, 1: 5, 2: 4, 3: 7, 4: 2, 5: 9, 6: 1, 7: 1}, 6)
    total = 32 + 6 + 0.1 * 9
    brute_lattice.scores = {t: (c + 0.1) / total for t, c in zip(texts[:7], (3, 5, 4, 7, 2, 9, 1), strict=True)}
    known = ["a", "ab", "abab", "cab", "é", "b" * 20, "ababababa"]
    assert np.allclose(lattice.word_scores(known, pieces), [brute_lattice(w, pieces) for w in known])


def test_lattice_scores_of_a_table(spark, docs, empty):
    got = lattice.score_query(docs).collect()
    assert len(got) == len(rows())
    train = [t for i, t, *_ in rows() if crc(i) % 10]
    counts = Counter(w for t in train for w in WORD.findall(lower(t)))
    n, kinds = sum(counts.values()) + len(train), len(counts) + 1
    whole = math.log10(n + 0.1 * (kinds + 1))
    want = Counter()
    for i, t, *_ in rows():
        found = WORD.findall(lower(t))
        base = sum(math.log10(counts[w] + 0.1) - whole for w in found) + math.log10(len(train) + 0.1) - whole
        want[i, crc(i) % 10 == 0, len(found) + 1, sum(counts[w] > 0 for w in found) + 1, n, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                   for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lattice.score_query(empty).count() == 0


# 2

def test_imatch_edits_and_likeness(spark, docs, empty):
    got = imatch.compare_edits(docs, (0.0, 1.0)).collect()
    order = sorted(((i, t or "") for i, t, *_ in rows() if i is not None), reverse=True)
    nulls = [(None, "ba ke"), (None, "")]
    prints = {}
    want = Counter()
    for tail in (nulls, nulls[::-1]):  # which null id comes first depends on a hash
        chain = order + tail
        seen = Counter()
        for k, (i, t) in enumerate(chain):
            following = chain[(k + 1) % len(chain)][1]
            third = len(t) // 3
            seen[i, len(t), hashlib.sha256((t[:len(t) - third] + following[:third]).encode()).hexdigest()] += 1
        want |= seen
    have = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got)
    assert sum(have.values()) == len(rows()) and not have - want
    text_of = {i: t for i, t, *_ in rows() if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert prints.setdefault(text_of[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    alike = [r["near_edited"] for r in got if r["n_chars"] > 100]
    apart = [r["near_next"] for r in got if r["n_chars"] > 100]
    assert np.mean(alike) > np.mean(apart)
    assert imatch.compare_edits(empty).count() == 0
    alone = imatch.compare_edits(table(spark, [(1, "ba ke ti", None, None)])).first()
    assert alone["near_next"] == 1.0


def test_imatch_fingerprint_by_hand():
    kept = {"ba": 0b01, "ke": 0b11, "no": 0b10}
    value, filled = imatch.fingerprint("Ke ba, ti ke", kept)
    digest = xxhash.xxh64_intdigest
    whole = np.array([digest(b"ba"), digest(b"ke")], dtype=np.uint64).tobytes()
    assert filled == 0b11 and value[:4] == f"{digest(whole) & 0xFFFF:04x}"
    assert imatch.fingerprint("", kept)[0] == imatch.fingerprint(None or "", kept)[0]


def test_imatch_sees_every_term_of_the_lexicon():
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(3000)]
    kept = {t: imatch.memberships(t) for t in names}
    assert all(kept.values())
    base = names[:12]
    own = imatch.fingerprint(" ".join(base), kept)
    for t in names[12:512]:  # one more term, and one in place of another
        assert imatch.fingerprint(" ".join([*base, t]), kept)[0] != own[0]
        assert imatch.fingerprint(" ".join([*base[1:], t]), kept)[0] != own[0]


def test_imatch_of_texts_without_lexicon_terms():
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(2000)]
    likes = []
    for k in range(60):  # one changed term of thirty leaves a part of the subsets
        part = names[30 * k:30 * k + 30]
        a, b = (imatch.fingerprint(" ".join(x), {}) for x in (part, [*part[1:], "neu"]))
        assert a[0] != b[0]
        likes.append(imatch.likeness(a, b))
    assert min(likes) > 0 and 0.3 < np.mean(likes) < 1
    assert len({imatch.fingerprint(t, {})[0] for t in names}) == len(names)
    assert len({imatch.fingerprint("!" * n, {})[0] for n in range(1, 1500)}) == 1499  # 16 bits held about 17 pairs


# 3

def brute_repeats(texts, length):
    counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        yield int(gone.sum()), runs, bytes(b for b, x in zip(t, gone, strict=True) if not x)


@pytest.mark.parametrize("limit", [100_000, 1])
def test_suffix_repeats(spark, limit):
    rng = random.Random(4)
    common_part = words(rng, 40)
    data = [(i, words(rng, 20) + common_part[i % 7:150 + i] + words(rng, 10) + "é", None, None) for i in range(12)]
    data += [(50, data[0][1], None, None), (51, "ab" * 200, None, None), (52, None, None, None), (53, "", None, None),
             (54, "short", None, None), (None, data[1][1][:90], None, None)]
    got = suffixes.remove_repeats(table(spark, data), 60, 16, limit).collect()
    texts = [(t or "").encode() for _, t, *_ in data]
    want = Counter((i, len(t), n, runs, hashlib.sha256(kept).hexdigest(), kept)
                   for (i, *_), t, (n, runs, kept) in zip(data, texts, brute_repeats(texts, 60), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in got) == want


def test_suffix_repeats_of_whole_tables(spark, docs, empty):
    got = suffixes.remove_repeats(docs).collect()
    texts = [(t or "").encode() for _, t, *_ in rows()]
    want = Counter((i, n, runs) for (i, *_), (n, runs, _) in zip(rows(), brute_repeats(texts, 200), strict=True))
    assert Counter((r["doc_id"], r["n_removed"], r["n_spans"]) for r in got) == want
    assert suffixes.remove_repeats(empty).count() == 0


def test_suffix_order_equals_sorted_and_collisions_are_noticed():
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    groups = np.repeat(np.arange(6), 10)
    found = suffixes._Suffixes(parts)
    order, shared = found.sort(groups)
    for g in range(6):
        assert [parts[i] for i in order[10 * g:10 * g + 10]] == sorted(parts[10 * g:10 * g + 10])
    assert found.verified(order, shared)
    at = next(i for i in range(1, 60) if i % 10 and shared[i] == 0 and parts[order[i]] and parts[order[i - 1]])
    wrong = shared.copy()
    wrong[at] = 1
    assert not found.verified(order, wrong)


# 4

def brute_tiles(pattern, text, least):
    used_p, used_t, total = [False] * len(pattern), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                k = 0
                while (p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] >= 0
                       and not used_p[p + k] and not used_t[t + k]):
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        if best[0] < least:
            return total
        k, p, t = best
        for i in range(k):
            used_p[p + i] = used_t[t + i] = True
        total += k


def test_tiles_cover_what_the_plain_algorithm_covers():
    rng = random.Random(7)
    for _ in range(120):
        pattern = [rng.randint(0, 4) for _ in range(rng.randint(1, 25))]
        text = [rng.randint(-1, 4) for _ in range(rng.randint(0, 60))]
        got = tiling.tiles(pattern, text, 3)
        for p, t, k in got:
            assert pattern[p:p + k] == text[t:t + k] and k >= 3
        assert len({p + i for p, _, k in got for i in range(k)}) == sum(k for *_, k in got)
        assert sum(k for *_, k in got) == brute_tiles(pattern, text, 3)


@pytest.mark.parametrize("block", [tiling.BLOCK_BYTES, 300])
def test_contamination(spark, docs, empty, block):
    rng = random.Random(9)
    items = [(i, words(rng, 30)) for i in range(6)] + [(6, "ba ke no"), (7, None), (8, ""), (None, words(rng, 25))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    first, second = items[0][1].split(), items[1][1].split()
    data = rows() + [
        (200, words(rng, 50) + " " + items[0][1].upper() + ". " + words(rng, 9), None, None),
        (201, " ".join([*second[20:], "mitte", *second[10:20], "mitte", *second[:10]]), None, None),
        (202, " ".join(first[:20]), None, None), (203, "x ba ke no y", None, None), (204, items[9][1], None, None)]
    found = tiling.contaminated(table(spark, data), bench, block_bytes=block).collect()
    got = {(r["doc_id"], r["item_id"]): r for r in found}
    assert {(200, 0), (201, 1), (203, 6), (204, None)} <= set(got) and (202, 0) not in got
    assert got[201, 1]["tiles"] == 3 and got[201, 1]["coverage"] == 1.0
    want = set()
    for i, t, *_ in data:
        have = tiling.words(t or "")
        for k, x in items:
            pattern = tiling.words(x or "")
            if pattern and brute_cover(pattern, have) >= 0.8 * len(pattern):
                want.add((i, k))
    assert set(got) == want
    left = tiling.decontaminated(table(spark, data), bench, block_bytes=block)
    assert left.columns == table(spark, data).columns
    bad = {i for i, _ in want}
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, *_ in data if i not in bad)
    assert tiling.contaminated(empty, bench).count() == 0
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0


def brute_cover(pattern, have):
    code = defaultdict(lambda: len(code))
    if not set(pattern) & set(have):
        return 0
    text = [code[w] for w in have]
    least = min(5, len(pattern))
    grams = {tuple(pattern[i:i + least]) for i in range(len(pattern) - least + 1)}
    if not any(tuple(have[i:i + least]) in grams for i in range(len(have) - least + 1)):
        return 0
    return brute_tiles([code[w] for w in pattern], text, least)


# 5

@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 1000])
def test_feistel_is_a_bijection(n):
    assert sorted(feistel.permute(np.arange(n), n, 5).tolist()) == list(range(n))
    assert n < 64 or feistel.permute(np.arange(n), n, 5).tolist() != feistel.permute(np.arange(n), n, 6).tolist()


def test_shards(spark, docs, empty):
    got = feistel.shard_documents(docs).collect()
    assert len(got) == len(rows())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    again = feistel.shard_documents(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert feistel.shard_documents(empty).count() == 0
    kept = feistel.assign(docs, [F.col("doc_id"), F.col("text")], 3)
    assert "text" in kept.columns and kept.columns.count("shard") == 1


# 6

def quality_table(spark):
    rng = random.Random(3)
    good = [(i, words(rng, 40) + ".", None, None) for i in range(60)]
    bad = [(100 + i, " ".join(["SPAM!!"] * rng.randint(20, 40)), None, None) for i in range(40)]
    labels = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(40)] + [(None, 1), (5000, 0), (3, 1), (7, None)]
    return table(spark, good + bad + [(300, None, None, None), (301, "", None, None), (None, "ba", None, None), good[0]]), \
        spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_scores(spark, docs, empty):
    data, labels = quality_table(spark)
    got = {r["doc_id"]: r for r in ranking.score_documents(data, labels).collect()}
    for i in [*range(60), *range(100, 140)]:
        assert got[i]["predicted"] == (i < 60) and got[i]["held_out"] == (crc(i) % 3 == 1)
    assert got[300]["score"] == got[301]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert ranking.score_documents(data, labels).count() == data.count()
    assert {r["score"] for r in ranking.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert ranking.score_documents(empty, labels).count() == 0


def test_quality_learns_from_every_labelled_row(spark):
    rng = random.Random(4)
    data = [(i, words(rng, rng.randint(2, 9)) + (" !" if rng.random() < (0.7 if i % 4 else 0.2) else ""), None, None) for i in range(7000)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(7000)], "doc_id long, quality int")
    rows = ranking.featured(table(spark, data).repartition(5))
    model = ranking.train(rows, labels, F.col("doc_id") % 10 != 0)
    mine = {r["doc_id"]: r["features"] for r in rows.collect()}
    ids = [i for i in range(7000) if i % 10]  # more than 3,000 of label 0, all of which count
    good = np.array([i % 4 == 0 for i in ids])
    local = ranking.fit(np.array([mine[i] for i in ids]), good, float((~good).mean()))
    assert np.allclose(model.edges, local.edges) and np.allclose(model.weights, local.weights, atol=1e-6)
    strengths = np.sort(local.strengths(np.array([mine[i] for i in ids])))
    assert model.threshold == pytest.approx(strengths[(~good).sum() - 1:(~good).sum() + 1].mean(), abs=1e-6)
    again = ranking.train(rows.repartition(2), labels, F.col("doc_id") % 10 != 0)
    assert (model.weights == again.weights).all() and model.threshold == again.threshold


# 7

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_plain(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)
    out = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and private.luhn(digits(m.group()))]
    out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], private.KINDS.index(s[2])))


def test_plain_spans_equal_the_patterns():
    rng = random.Random(5)
    pieces = ["a", "b.c", "@", ".", "-", "1", "23", "4111 1111 1111 1111", "+1 (555) 123-4567", "10.0.0.255", "256.1.1.1",
              "x@y.zz", " ", "é", "\n", "_", "+", "0"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert private.plain_spans(text) == brute_plain(text), text
    assert private.luhn("4111111111111111") and not private.luhn("4111111111111112")


@pytest.mark.parametrize("text,kind,source", [
    ("mail me: jane.doe (at) mail [dot] example.com now", "email", "jane.doe (at) mail [dot] example.com"),
    ("write jane at example dot com today", "email", "jane at example dot com"),
    ("to mаria@exаmple.com!", "email", "mаria@exаmple.com"),
    ("call +１ 555 ２３４ 9876", "phone", "+１ 555 ２３４ 9876"),
    ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
    ("card four one one one, one one one one, one one one one, one one one one ok", "card",
     "four one one one, one one one one, one one one one, one one one one"),
    ("at 10[.]0[.]0[.]7 port", "ip", "10[.]0[.]0[.]7"),
    ("host one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ("zero​width jo​hn@mail.com", "email", "zero"),
])
def test_disguises_map_back(text, kind, source):
    base, more = private.find(text)
    assert base == brute_plain(text)
    found = [text[a:b] for a, b, k in more if k == kind]
    assert source in found or (source == "zero" and "jo​hn@mail.com" in found), (found, base)


@pytest.mark.parametrize("text,kind,source", [
    ("host 192 dot 168 dot 1 dot 10 up", "ip", "192 dot 168 dot 1 dot 10"),
    ("host 192.168.one.10 up", "ip", "192.168.one.10"),
    ("host 192 dot 168 dot one dot 1, 500 users", "ip", "192 dot 168 dot one dot 1"),
    ("host 192 dot one six eight dot 1 dot one zero up", "ip", "192 dot one six eight dot 1 dot one zero"),
    ("write jane at example.com today", "email", "jane at example.com"),
    ("write jane dot doe at mail.example.co.uk.", "email", "jane dot doe at mail.example.co.uk"),
    ("call +1 202 five five five 01 two three now", "phone", "+1 202 five five five 01 two three"),
    ("call +44 20 seven nine four 6 oh nine 58", "phone", "+44 20 seven nine four 6 oh nine 58"),
    ("call +1 (202) 555 01 two three", "phone", "+1 (202) 555 01 two three"),
    ("card 4111 one one one one 1111 11 one one ok", "card", "4111 one one one one 1111 11 one one"),
])
def test_partly_spelled_identifiers(text, kind, source):
    base, more = private.find(text)
    assert base == brute_plain(text)
    assert source in [text[a:b] for a, b, k in more if k == kind], more


def test_numbers_in_prose_are_no_identifiers():
    for text in ("in 1999, 2004, one of 300", "at 10.5 dot 3", "we met at noon.Then one went", "two at 3.4 and 5 dot 6 or seven", "oh 10, 5 at 2.15"):
        assert private.find(text) == ([], []), text


def test_clean_texts_get_no_spans():
    for text in ("we met at noon and a dot of paint", "one or two of three", "привет мир", "café 10.5 at 3.4", ""):
        assert private.find(text) == ([], [])


@pytest.mark.parametrize("text", [
    "meet me at noon.then we go", "we arrived at node.js today", "look at config.yaml first", "He was at home.com again",
    "contact us at example.com", "sold out at shop.de", "we stayed at hotel.com", "at at at", "dot at dot dot com", "a dot of paint at a dot b"])
def test_prose_before_at_is_no_mailbox(text):
    assert private.find(text) == ([], [])


@pytest.mark.parametrize("text,source", [
    ("x@mail dot example dot com", "x@mail dot example dot com"), ("ann.b_7 at foo.de", "ann.b_7 at foo.de"),
    ("(jane at example.com)", "jane at example.com"), ("to bob at corp dot example dot org, thanks", "bob at corp dot example dot org")])
def test_spoken_addresses(text, source):
    assert source in [text[a:b] for a, b, kind in private.find(text)[1] if kind == "email"]


@pytest.mark.parametrize("text", [
    "price 3\u20134 euro" + " " * 10 ** 6, "price 3\u20134 euro" + "\n" * 10 ** 6, "( dot  at " + "(" * 10 ** 6, "( dot  at " + "( " * 500_000,
    "a dot " * 170_000, "at dot " * 150_000, "\u2013 a at " + "x" * 10 ** 6 + " at a.com", "\u2013 b at " + "a." * 500_000])
def test_long_texts_take_seconds(text):
    begin = time.process_time()
    private.find(text)
    assert time.process_time() - begin < 20


def test_private_table(spark, docs, empty):
    data = rows() + [(300, "\U0001F600 a@b.cc and 10.0.0.1", None, None), (301, "x" * 200_000 + "@", None, None)]
    got = {r["doc_id"]: r for r in private.find_private(table(spark, data)).collect()}
    assert got[300]["spans"] == "email:2:8,ip:13:21" and got[300]["base_sha256"] == hashlib.sha256(b"email:2:8,ip:13:21").hexdigest()
    assert (got[300]["n_email"], got[300]["n_ip"], got[300]["n_card"], got[300]["n_phone"]) == (1, 1, 0, 0)
    assert got[103]["spans"] == "" and got[103]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert private.find_private(docs).count() == len(rows())
    assert private.find_private(empty).count() == 0


# 8

def brute_print(text, width=4):
    found = WORD.findall(lower(text))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i:i + width]).encode(), 42) for i in range(max(1, len(found) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_simhash_links_of_dense_and_sparse_clusters(spark):
    rng = random.Random(8)
    values = {rng.getrandbits(64) for _ in range(150)}
    for centre in (rng.getrandbits(64), 0, (1 << 64) - 1):
        for _ in range(60):
            value = centre
            for b in rng.sample(range(64), rng.randint(0, 7)):
                value ^= 1 << b
            values.add(value)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), "fp", ["fp"], ["fp"], 4).collect()
    place = {v: i for i, v in enumerate(signed)}
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for r in found:
        assert (values[place[r["a"]]] ^ values[place[r["b"]]]).bit_count() <= 4
        parent[root(place[r["a"]])] = root(place[r["b"]])
    want = brute_components(values, 4)
    pairs = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in set(labels)}
    assert pairs([root(i) for i in range(len(values))]) == pairs(want)


def test_near_duplicates(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    values = [brute_print(t) for _, t, *_ in rows()]
    roots = brute_components(values, 4)
    least = {}
    for (i, *_), r in zip(rows(), roots, strict=True):
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (least.get(r), i) != (None, None) else None
    want = Counter((i, v, least[r]) for (i, *_), v, r in zip(rows(), values, roots, strict=True))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in kept.collect()) == sorted((x is not None, x) for x in least.values())
    assert simhash.keep_one(empty).count() == 0


def test_one_row_of_each_group_stays(spark, docs, empty):
    """Against all pairs of fingerprints; columns of the operator's own names pass through."""
    rng = random.Random(12)
    data = []
    for g in range(12):
        text = words(rng, 400).split()
        for copy in range(6):
            changed = list(text)
            if copy:
                changed[rng.randrange(400)] = "neu" + str(rng.randrange(10 ** 6))
            data.append((10 * g + copy, " ".join(changed), "xx", "a"))
    data += [(500 + i, words(rng, 300), None, None) for i in range(20)] + [(900, None, None, None), (901, "", None, None)]
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t, *_ in data}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    named = table(spark, data).withColumns({"_key": F.lit("mine"), "component": F.lit(1), "key": F.lit("k"), "_KEY_": F.lit(2)})
    kept = simhash.keep_one(named)
    found = kept.collect()
    assert kept.columns == named.columns and {r["_key"] for r in found} == {"mine"}
    assert sorted(r["doc_id"] for r in found) == sorted({find(i) for i in prints}) and 900 in {r["doc_id"] for r in found}
    assert simhash.keep_one(docs).filter("doc_id is null").count() == 1  # of the blank ones an id comes first


def test_mix_leaves_columns_of_its_own_names_alone(spark, docs):
    named = docs.withColumns({"_key": F.lit("mine"), "_copy": F.lit(5), "key": F.lit("k"), "copies": F.lit(9)})
    made = pivotal.mixed(named)
    assert made.columns == named.columns
    assert {(r["_key"], r["_copy"], r["key"], r["copies"]) for r in made.collect()} == {("mine", 5, "k", 9)}
    plain = Counter((r["doc_id"], r["text"]) for r in pivotal.mixed(docs).collect())
    assert Counter((r["doc_id"], r["text"]) for r in made.collect()) == plain


# 9

def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        goal = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if goal[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in capped else goal[s] for s in names}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 1, "b": 1, "c": 1}, {"x": 0, "y": 9},
                                   {"a": 100, "b": 90, "c": 1, "d": 2, "e": 700, None: 3}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in pivotal.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mix(spark, docs, empty):
    got = pivotal.mix(docs, seed=1).collect()
    assert len(got) == len(rows())
    sizes, longest = Counter(), defaultdict(int)
    for _, t, _, s in rows():
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        longest[s] = max(longest[s], n)
    want, source = brute_targets(dict(sizes)), {}
    for i, _, _, s in rows():
        source[i] = s
    taken, targets = Counter(), {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        if r["doc_id"] is not None:
            taken[source[r["doc_id"]]] += r["taken"]
            targets[source[r["doc_id"]]] = r["target"]
    for s, target in targets.items():
        assert abs(target - want[s]) < 1e-6 and abs(taken[s] - target) <= longest[s] + 10
    again = pivotal.mix(docs.repartition(5), seed=1).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert pivotal.mix(empty).count() == 0
    made = pivotal.mixed(docs, seed=1)
    assert made.columns == docs.columns and made.count() == sum(r["copies"] for r in got)
    assert pivotal.mixed(empty).count() == 0


def test_rounding_keeps_sums_and_expectations(spark):
    rng = random.Random(6)
    items = [(i % 2, i, float(rng.randint(1, 50)), 0.3 if i % 2 else 0.6) for i in range(400)]
    df = spark.createDataFrame(items, "source_no int, n long, size double, p double")
    ups = Counter()
    for seed in range(12):
        up = {r["n"]: r["up"] for r in pivotal.round_copies(df, 400, seed, group=8).collect()}
        assert len(up) == 400
        for s in (0, 1):
            mass = sum(z for g, n, z, _ in items if g == s and up[n])
            assert abs(mass - sum(z * p for g, _, z, p in items if g == s)) <= 50
        ups.update(n for n, x in up.items() if x)
    assert abs(sum(v for n, v in ups.items() if n % 2) / 12 / 200 - 0.3) < 0.05


# 10

def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    scores, moves, lengths = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([4, 1, 2])
    got = crf.forward_backward(scores, lengths, moves)
    at = 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            weight = math.exp(sum(scores[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                want[t, y] += weight
        assert np.allclose(got[at:at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_language(spark, docs, empty):
    rng = random.Random(11)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(20))
    kinds = {"xx": ("ba", "ke", "ti", "no"), "yy": ("él", "ou", "ça", "eu")}
    data = [(i, make(kinds[k]), k, None) for i in range(60) for k in (["xx", "yy"][i % 2],)]
    mixed = make(kinds["xx"]) + "\n" + make(kinds["yy"])
    data += [(500, None, "xx", None), (501, "", "xx", None), (502, "12 !", "yy", None), (503, mixed, None, None),
             (None, make(kinds["yy"]), None, None)]
    got = {r["doc_id"]: r for r in crf.identify(table(spark, data)).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, _ in data if i is not None and i < 60)
    assert all(got[i]["held_out"] == (crc(i) % 5 == 0) for i in range(60))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (500, 501, 502))
    assert got[None]["lang_pred"] == "yy" and 0.35 < got[503]["score"] < 0.65
    model = crf.train(table(spark, data))
    line = kinds["xx"][0] * 2 + " nobake tiba keno " + "élou çaeu euél ouou"
    chance = crf.forward_backward(crf.emissions(crf.words(line), model.weights), np.array([len(crf.words(line))]), model.transitions)
    assert (chance.argmax(axis=1) == [0] * 4 + [1] * 4).all()  # switched within a line
    kept = crf.with_language(table(spark, data))
    assert kept.columns == table(spark, data).columns and not {500, 501, 502} & {r["doc_id"] for r in kept.collect()}
    assert crf.identify(empty).count() == 0 and crf.with_language(empty).count() == 0
    assert {r["lang_pred"] for r in crf.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_short_texts_of_a_language_are_learned_beside_long_ones(spark, monkeypatch):
    rng = random.Random(5)
    kinds = {"xx": ("ba", "ke", "ti", "no"), "yy": ("él", "ou", "ça", "eu"), "zz": ("wy", "öd", "üf", "gä")}
    make = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    data = [(i, make("xx", 300), "xx", None) for i in range(80)] + [(100, make("xx", 60_000), "xx", None)]
    data += [(200 + i, make("yy", 10), "yy", None) for i in range(10)] + [(300 + i, make("zz", 30), "zz", None) for i in range(20)]
    drawn, fit = [], crf.fit
    monkeypatch.setattr(crf, "fit", lambda runs: drawn.extend(runs) or fit(runs))
    model = crf.train(table(spark, data), runs=400)
    counts = Counter(k for _, k in drawn)
    assert counts == {"yy": 10, "zz": 60, "xx": 330} and model.labels == ["xx", "yy", "zz"]
    assert sum(" ".join(r) in data[80][1] for r, k in drawn if k == "xx") < 20
    assert crf.predict(model, [make("yy", 12)])[0] == ["yy"]


def test_mixed_texts_stay(spark):
    rng = random.Random(9)
    kinds = {"ww": ("pli", "gru", "sko"), "xx": ("ba", "ke", "ti", "no"), "yy": ("él", "ou", "ça", "eu"), "zz": ("wy", "öd", "üf", "gä")}
    make = lambda k: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 3))) for _ in range(20))
    data = [(i, make(k), k, None) for i in range(80) for k in (["ww", "xx", "yy", "zz"][i % 4],)]
    data += [(500, "\n".join(map(make, kinds)), None, None), (501, "\n".join(map(make, ["xx", "yy", "zz"])), None, None),
             (502, "12 !", None, None)]
    scores = {r["doc_id"]: r["score"] for r in crf.identify(table(spark, data)).collect()}
    assert scores[500] < 0.4 and scores[501] < 0.4
    kept = {r["doc_id"] for r in crf.with_language(table(spark, data)).collect()}
    assert {500, 501} <= kept and 502 not in kept and len(kept) == 82


def test_tiling_memory_does_not_follow_a_passage_that_all_items_and_texts_repeat():
    import tracemalloc
    shared = " ".join(f"w{i}" for i in range(12))
    items = tiling.Items([(i, f"{shared} own{i}") for i in range(60)])
    texts = [f"{shared} . " * 300] * 10
    tracemalloc.start()
    try:
        found = list(items.scan([*texts, f"{shared} own7"], 1.0))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == [(10, 7, 13, 13, 1)]
    assert peak < 30 << 20


def test_tiling_scan_gives_the_same_text_by_text(monkeypatch):
    items = tiling.Items([(1, "a b c d e f"), (2, "b c"), (3, "c d e f g a b"), (4, "")])
    texts = ["a b c d e f g a b c", "", "b c", "x " * 50, "c d e f g a b . b c", "a b"]
    whole = list(items.scan(texts, 0.5))
    monkeypatch.setattr(tiling, "SCAN_CHARS", 4)
    assert whole and list(items.scan(texts, 0.5)) == whole
