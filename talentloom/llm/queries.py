"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm import (crf, feistel, imatch, lattice, ledger, pivotal, private, ranking, simhash, suffixes, tiling, trie,
                            variants)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_query(_table(spark, sf_dir, "documents"), lattice.session_vocabulary(spark))


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edits(_table(spark, sf_dir, "documents"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.shard_documents(_table(spark, sf_dir, "documents"))


def op6_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.find_private(_table(spark, sf_dir, "documents"))


def op8_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal.mix(_table(spark, sf_dir, "documents"))


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.identify(_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.keep(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lattice_score, op2_imatch_fingerprints, op3_suffix_repeats, op4_string_tiling, op5_feistel_shards,
                                    op6_pairwise_quality, op7_private_spans, op8_simhash_variants, op9_pivotal_mix, op10_crf_language,
                                    op11_conversation_trie, op12_rule_ledger, op13_spelling_variants, pipeline)}


#: The usual table of the checksum, as one row with the list ``t``.
_CRC_TABLE = """tab AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_concat([k], range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS k)))"""


def _bytes(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"


def _crc(listed: str) -> str:
    """CRC-32 of a list of bytes, where the table ``tab`` is at hand."""
    return (f"xor(list_reduce(list_concat([4294967295], {listed}), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


def _shard_sql(shards: int = 24, seed: int = 0) -> str:
    """The permutation in SQL: rounds as nested selects, the walk as a recursive query."""
    def rounds(source: str) -> str:
        sql = f"SELECT n, x >> (SELECT b FROM dom) AS l, x & (SELECT m FROM dom) AS r FROM ({source})"
        for key in feistel.round_keys(seed):
            sql = (f"SELECT n, r AS l, xor(l, xor(f, f >> {feistel.SHIFT}) & (SELECT m FROM dom)) AS r FROM "
                   f"(SELECT n, l, r, CAST(xor(r, {key}) * {feistel.MULTIPLIER} % {1 << 61} AS BIGINT) AS f FROM ({sql}))")
        return f"SELECT n, (l << (SELECT b FROM dom)) | r AS x FROM ({sql})"

    return f"""WITH RECURSIVE {_CRC_TABLE},
    docs AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_bytes("coalesce(text, '')")} AS bytes FROM documents),
    summed AS (SELECT doc_id, size, {_crc("bytes")} AS text_crc32 FROM docs, tab),
    numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS n FROM summed),
    dom AS (SELECT b, (1 << b) - 1 AS m, c FROM (SELECT greatest(1, CAST(ceil(ceil(log2(greatest(c, 2))) / 2) AS INTEGER)) AS b, c
        FROM (SELECT count(*) AS c FROM numbered))),
    walk AS ({rounds('SELECT n, n AS x FROM numbered')} UNION ALL
        {rounds('SELECT n, x FROM walk WHERE x >= (SELECT c FROM dom)')})
    SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, x // {shards} AS slot,
        CAST(NULL AS INTEGER) AS grown_shard FROM walk JOIN numbered USING (n) WHERE x < (SELECT c FROM dom)"""


def _trie_sql(share: int = trie.SHARE, family: int = trie.FAMILY) -> str:
    """Conversations as lists, their prefixes as list slices; a node adds itself to every prefix of its own."""
    return f"""WITH {_CRC_TABLE},
    given AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
        WHERE conv_id IS NOT NULL),
    own AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST,
        sha256(strlen(r) || ':' || r || x)[1:32] || strlen(x)) AS v FROM given GROUP BY c),
    shared AS (SELECT c, v, {_crc("bytes")} % {share} AS h FROM (SELECT *, {_bytes("CAST(c AS VARCHAR)")} AS bytes FROM own), tab),
    made AS (SELECT s.c, list_concat(coalesce(b.v[1:h], []), s.v[h + 1:]) AS v FROM shared s LEFT JOIN own b
        ON b.c = s.c - s.c % {family}),
    members AS (SELECT c, v, unnest(range(len(v) + 1)) AS d FROM made),
    nodes AS (SELECT d, v[1:d] AS p, min(c) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CASE WHEN len(v) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
        FROM members GROUP BY d, v[1:d]),
    children AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
    known AS (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(k, 0) AS n_children FROM nodes n
        LEFT JOIN children c ON c.d = n.d AND c.p = n.p LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]),
    up AS (SELECT p[1:a] AS p, a AS d, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves,
        sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(p[d].x) END) AS saved_tokens
        FROM (SELECT *, unnest(range(d + 1)) AS a FROM known) GROUP BY p[1:a], a)
    SELECT k.conv_id, k.d AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
        CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM known k JOIN up ON up.d = k.d AND up.p = k.p"""


def _ledger_sql(version: str = ledger.LATEST) -> str:
    """The measures with list functions, windows of three words by lead(), and the rules in their own words, which are SQL."""
    without = lambda of, by="text": f"length({by}) - length(translate({by}, '{of}', ''))"
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(ledger.RULES.values()))
    base, mask = ledger.mask_of(ledger.BASE), ledger.mask_of(ledger.POLICIES[version])
    marks = ", ".join(f"'{x.decode()}'" for x in ledger.BULLETS)
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    split AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)),
        lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs),
    words AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM split),
    windows AS (SELECT *, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
    twice AS (SELECT r, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
    marked AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
    measured AS (SELECT doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS word_chars_,
        {without(ledger.SYMBOLS.decode())} AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]'))) AS n_letter_words,
        {without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} AS n_capitals, {without("abcdefghijklmnopqrstuvwxyz")} AS n_small,
        {without("0123456789")} AS n_digits, {without("!")} AS n_calls,
        len(list_filter(lines, lambda x: regexp_extract(x, '[^\\x20\\x09-\\x0D]') IN ({marks}))) AS n_bullets
        FROM split LEFT JOIN marked USING (r)),
    judged AS (SELECT *, {bits} AS failed FROM (SELECT *, coalesce(word_chars_, 0) AS word_chars FROM measured))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {base} <> 0 AS base_failed,
        failed & {base | mask} = 0 AS kept, CAST(failed AS BIGINT) AS failed, '{version}' AS policy FROM judged"""


def _variants_sql(shortest: int = variants.SHORTEST, rarest: int = variants.RAREST, oftener: int = variants.OFTENER) -> str:
    """Near words through shared patterns: a word with one letter taken out (inserted or deleted letters) or blanked (replaced)."""
    return f"""WITH RECURSIVE {_CRC_TABLE},
    runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{variants.LETTERS}]+')) AS run FROM documents),
    low AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        AS run, count(*) AS n FROM runs GROUP BY ALL HAVING length(run) >= {shortest}),
    hashed AS (SELECT run, n, {_crc("bytes")} AS h FROM (SELECT *, {_bytes("id || ':' || run")} AS bytes FROM low), tab),
    thinned AS (SELECT CASE WHEN h % {variants.THINNED} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
    vocabulary AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM thinned WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {rarest}),
    places AS (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary),
    cuts AS MATERIALIZED (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM places),
    near AS (SELECT a.word, b.word AS u, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT c.word, v.word, v.n FROM cuts c JOIN vocabulary v ON c.rest = v.word
        UNION SELECT v.word, c.word, c.n FROM cuts c JOIN vocabulary v ON c.rest = v.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(u, (-m, u)) AS u, max(m) AS m FROM near GROUP BY word),
    formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {oftener} * n THEN u END AS form,
        CASE WHEN m >= {oftener} * n THEN m END AS form_n FROM vocabulary LEFT JOIN best USING (word)),
    climb AS (SELECT word, word AS root FROM formed UNION ALL
        SELECT c.word, f.form FROM climb c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
    roots AS (SELECT c.word, c.root FROM climb c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are held against brute force in the tests."""
    return {"op5_feistel_shards": _shard_sql(), "op11_conversation_trie": _trie_sql(), "op12_rule_ledger": _ledger_sql(),
            "op13_spelling_variants": _variants_sql()}
