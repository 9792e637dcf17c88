"""The conversation trie, the rule ledger and the spelling variants against brute force and their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from talentloom.llm import ledger, queries, trie, variants

# 11

TURNS = "conv_id long, turn long, role string, text string, key string, parent long, depth string, _part int, id string, n int"


def conversations(spark, data):
    return spark.createDataFrame([(*row, "k", 1, "d", 2, "i", 3) for row in data], TURNS).repartition(3)


def brute_trie(data):
    own = defaultdict(list)
    for c, t, r, x in data:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32] + str(len(x.encode()))
            own[c].append(((t is not None, t or 0, tie), (r, x)))
    own = {c: [turn for _, turn in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(c - 5 * int(c / 5)), [])[:h] + ts[h:]
    return brute_nodes(made)


def brute_nodes(made):
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest())
                   for p, m in members.items()), key=str)


def found_trie(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_trie_follows_shared_openings(spark):
    rng = random.Random(3)
    data = []
    for c in [*range(-12, 60), 10**12, 10**12 + 3]:
        opening = rng.randint(0, 3)
        for t in range(rng.choice([1, 2, 5, 8, 9, 16, 17])):
            text = f"opening {opening} {t} ä" if t < 4 else rng.choice(["x", "", None, f"own {c} {t}"])
            data.append((c, rng.choice([t, t, None]) if c % 7 == 0 else t, rng.choice(["user", None]) if c % 3 == 0 else "user", text))
    data += [(1, 3, "user", "tie"), (1, 3, "user", "tie"), (1, 3, "a", "tie"), (None, 0, "user", "lost"), (7, None, None, None)]
    got = found_trie(trie.conversation_trie(conversations(spark, data)))
    assert got == brute_trie(data)
    assert trie.conversation_trie(conversations(spark, data)).columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_of_long_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "PORTION", 3)
    monkeypatch.setattr(trie, "PIECE", 2)
    data = [(5 * c, t, "user", f"{t % 5}" if t < 90 - c % 3 else f"{c}") for c in range(12) for t in range(100 + c % 2)]
    data += [(1000 + 5 * c, 0, "user", "same") for c in range(30)] + [(2001, 0, "u", "a"), (2002, 0, "u", "b"), (2006, 1, "u", "b")]
    assert found_trie(trie.conversation_trie(conversations(spark, data))) == brute_trie(data)


def test_trie_has_a_root_for_turnless_conversations_and_nothing_for_none(spark):
    lengths = spark.createDataFrame([(4, 0), (2, 0), (9, 1)], "conv_id long, length long")
    placed = spark.createDataFrame([(9, 0, "f" * 32 + "7")], "conv_id long, pos long, id string")
    got = found_trie(trie.prefix_trie(placed, lengths))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == [(2, 0, None, 3, 1, 1, 0, digest("2,4")), (9, 1, 2, 1, 0, 1, 0, digest("9"))]
    assert trie.conversation_trie(conversations(spark, [])).count() == 0
    assert trie.conversation_trie(conversations(spark, [(None, 1, "u", "x")])).count() == 0


def test_trie_query_is_one_rollup(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, *["a"] * 8)], "conv_id long, block long, a long, b long, " + ", ".join(f"t{i} string" for i in range(1, 9)))
    plan = trie.prefixes(rows, {"n": "count(1)"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1


# 12

DOCS = "doc_id long, text string, failed long, n_words string, kept int, policy string, verdicts int"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 1, "n", 0, "p", 2) for i, t in texts], DOCS).repartition(3)


def brute_measures(text):
    words = [w for w in SPACE.split(text or "") if w]
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum((text or "").count(x) for x in "#*$%&|<>"),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(again))


def some_texts():
    rng = random.Random(5)
    few = ["ab", "cd", "ef", "gh"]
    texts = [" ".join(rng.choice(few if k % 2 else [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}ä" for i in range(400)]) for _ in range(rng.randint(1, 150))) for k in range(40)]
    texts += [None, "", " \t\n\v\f\r ", "a b", "a b c", "a b c a b c", "x " * 120, "one line\n" * 9 + "one line", "a b c \x1c d",
              "\n\n a \n a \n", "# * $ % & | < >" * 30, "- item one two\n" * 3, "LOUD!! WORDS!! " * 60, "12 34 5678 " * 80,
              " ".join(f"wort{i}" for i in range(30_000)), "lang" * 60_000]
    return list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (None, texts[0]), (None, None)]


def test_ledger_measures_and_verdicts(spark):
    texts = some_texts()
    got = Counter(tuple(r)[:8] for r in ledger.keep(documents(spark, texts)).collect())
    expected = Counter()
    for i, t in texts:
        m = brute_measures(t)
        base = m[0] < 50 or 100 * m[4] > 50 * m[0]
        expected[(i, *m, base)] += 1
    assert Counter({k[:7]: 0 for k in got} | {}) == Counter({k[:7]: 0 for k in expected})
    assert sum(got.values()) == len(texts)
    for row in got:
        assert not (row[6] and row[7])
    kept = {row[0] for row in got if row[7]}
    assert kept & set(range(0, 40, 2)) and not kept & {40, 41, 42, 50, 51, 52, 53}  # empty, symbols, list, capitals, digits
    assert ledger.keep(documents(spark, [])).count() == 0


def test_words_of_long_texts_are_read_in_pieces(monkeypatch):
    text = ("eins zwei drei vier\tfünf " * 300).encode()
    whole = ledger.measure(text)
    monkeypatch.setattr(ledger, "_PIECE", 7)
    assert ledger.measure(text) == whole


def test_policies_need_only_the_bits(spark):
    book = ledger.ledger(documents(spark, some_texts())).cache()
    names = list(ledger.RULES)
    rows = ledger.judge(book, {"none": (), "all": names, "one": ("symbols",)}).collect()
    for r in rows:
        assert r["verdicts"] == {"none": True, "all": r["failed"] == 0, "one": not r["failed"] >> names.index("symbols") & 1}
    policy = ("few_words", "repeated_words", "symbols", "capitals")
    bits = {n: 1 << names.index(n) for n in policy}
    for found in ledger.ablations(book, policy).collect():
        bit, seen = bits[found["rule"]], [r["failed"] & sum(bits.values()) for r in rows]
        others = [f & ~bit for f in seen if f & bit]
        either, both = 0, -1 if others else 0
        for f in others:
            either, both = either | f, both & f
        assert tuple(found)[1:] == (len(seen), len(others), seen.count(bit), seen.count(0), seen.count(0) + seen.count(bit), either, both)
    by = ledger.ablations(book.withColumn("half", F.col("n_words") % 2), policy, by=("half",)).groupBy("rule").agg(F.sum("n_docs")).collect()
    assert {r[1] for r in by} == {len(rows)}


def test_a_new_rule_does_not_move_the_old_bits(spark):
    docs = documents(spark, some_texts())
    more = {**ledger.RULES, "starts_small": F.col("n_small") > 0}
    old = Counter(r["failed"] for r in ledger.ledger(docs).collect())
    new = Counter(r["failed"] & (1 << len(ledger.RULES)) - 1 for r in ledger.ledger(docs, more).collect())
    assert old == new
    with pytest.raises(ValueError):
        ledger.ledger(docs, {str(i): "n_words < 1" for i in range(64)})


# 13

def brute_near(counts, oftener=5):
    near = {w: set() for w in counts}
    for a in counts:
        for b in counts:
            if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].add(b)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda u: (-counts[u], u))
            if counts[best] >= oftener * counts[w]:
                form[w] = best
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(rows)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def some_words(seed, letters, count, shortest=6):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(shortest, shortest + 3))) for _ in range(count)}
    for w in list(words)[: count // 2]:
        at = rng.randrange(len(w))
        words |= {w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:], w * 3, w[0] * len(w)}
    return {w: rng.choice([5, 6, 30, 31, 200, 1000]) for w in words if len(w) >= shortest}


def test_near_words_equal_all_pairs(spark):
    for seed, letters in ((1, "ab"), (2, "abcß×"), (3, "aÀÿ")):
        counts = some_words(seed, letters, 120)
        words = spark.createDataFrame(list(counts.items()), "word string, n long")
        for block_words in (variants.BLOCK_WORDS, 10):  # of ten words: halves are divided among blocks
            assert sorted(map(tuple, variants.grouped(words, block_words=block_words).collect())) == brute_near(counts)


def test_index_ranks_are_those_of_the_sorted_rotations():
    words = sorted(some_words(4, "abc", 30))
    index = variants.Index(words)
    text = "".join("\0" + w for w in words)
    rotations = sorted(text[i:] + text[:i] for i in range(len(text)))
    for part in ("a", "ab", "bca", "\0a", "c\0", "abcabc", "zz"):
        state = index.everything(1)
        for letter in part:
            state = index.extend(state, [0 if letter == "\0" else int("abc".find(letter)) + 1 or -1], True)
        count = sum(r.startswith(part) for r in rotations)
        assert state[2][0] == count
        if count:
            assert rotations[state[0][0]].startswith(part) and not rotations[state[0][0] - 1].startswith(part)
        back = index.everything(1)
        for letter in reversed(part):
            back = index.extend(back, [0 if letter == "\0" else int("abc".find(letter)) + 1 or -1], False)
        assert back[2][0] == count and (not count or (back[0][0], back[1][0]) == (state[0][0], state[1][0]))


def test_a_long_word_and_no_word(spark):
    long = "abcdefghij" * 3000
    counts = {long: 5, long[:9000] + long[9001:]: 40, long + "x": 7}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, variants.grouped(words).collect())) == brute_near(counts)
    assert variants.grouped(words.limit(0)).count() == 0


def brute_occurrences(rows):
    low = {c: c + 32 for c in range(65, 91)}
    counts = Counter()
    for i, x in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", x or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]
            if len(word) >= 6:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def test_spelling_variants_of_documents(spark):
    rng = random.Random(9)
    pool = ["Straßen", "straßen", "ÄPFELBAUM", "äpfelbaum", "kurz", "lettering", "letterings", "Éclairs", "fünf×sechs"]
    rows = [(i, " ".join(rng.choice(pool) + rng.choice([" ", ", ", "1", "\n"]) for _ in range(rng.randint(0, 400)))) for i in range(60)]
    rows += [(None, "Straßen " * 9), (None, None), (3, None), (4, ""), rows[5], rows[5]]
    docs = spark.createDataFrame([(i, t, "w", 1, "h", "x") for i, t in rows], "doc_id long, text string, word string, n int, half string, run string")
    got = sorted(map(tuple, variants.spelling_variants(docs).collect()))
    assert got == brute_near(brute_occurrences(rows)) and any(r[1] for r in got)
    assert variants.spelling_variants(docs.limit(0)).count() == 0


# the SQL

def test_sql_gives_the_same_rows(spark, tmp_path):
    """Over tables with nulls, repeats and ties that the given ones lack."""
    rng = random.Random(2)
    talks = [(c, rng.choice([t, None]), rng.choice(["u", None]), rng.choice(["a", "bü", None])) for c in range(30) for t in range(c % 11)]
    texts = some_texts()[:50] + [(i, "lettering letterings lettering straßen " * 40) for i in range(200, 205)]
    texts += [(None, "lettering strasen " * 9), (None, None)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    sql = queries.oracle_sql()
    for name in ("op11_conversation_trie", "op12_rule_ledger", "op13_spelling_variants"):
        frame = queries.queries()[name](spark, str(tmp_path))
        there = con.execute(sql[name])
        order = [[d[0] for d in there.description].index(c) for c in frame.columns]
        assert Counter(map(tuple, frame.collect())) == Counter(tuple(r[i] for i in order) for r in there.fetchall()), name
