"""The registered queries of this subpackage, and their SQL where it exists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import langid, minhash, packing, pii, prefixes, quality, simhash, substring, suffix, unigram, urls, variants, wavelet
from chronofold.llm.common import documents, stage_table


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed sequences.  A null text is its end id; null and repeated ids are kept, each row for itself; an empty table gives no rows."""
    return packing.pack_documents(documents(spark, sf_dir))


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids, read back from the shard files.  A null text is its end id; rows with equal ids are all kept; null ids come first; an empty table gives no rows."""
    return wavelet.read_digest(wavelet.with_starts(wavelet.encode_shards(documents(spark, sf_dir))))


def op3_certified_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of each document.  A null text has no words; without labels only the base test rejects; an empty table gives no rows."""
    out = quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data.  A null text has none; null and repeated ids give a row each; an empty table gives no rows."""
    docs = documents(spark, sf_dir)
    return pii.find_spans(docs, pii.fit(pii.training_texts(docs)))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints beside those of the edited text and of the next document.  Null texts are empty and null ids come first; an empty table gives no rows."""
    return simhash.neighbours_digest(documents(spark, sf_dir))


def op6_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each document without repeats of 35 words.  Null texts have no words; equal rows repeat each other; null and repeated ids do no harm; an empty table gives no rows."""
    return substring.remove_repeats(documents(spark, sf_dir), span=35, with_text=False)


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document at a similarity of 0.8 on pairs of words.  Null texts link with nothing; rows with equal or null ids link by their own texts; an empty table gives no rows."""
    return minhash.near_duplicates(documents(spark, sf_dir), words=2)


def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of each document without repeats of 400 bytes.  Null texts have no bytes; equal rows repeat each other; null and repeated ids do no harm; an empty table gives no rows."""
    return suffix.remove_repeats(documents(spark, sf_dir), with_bytes=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document.  A null text, or one without a letter, is und with score 0; without labels all are; a null id is not held out; an empty table gives no rows."""
    docs = documents(spark, sf_dir)
    rows = langid.training_rows(docs.where(~langid.held_out()))
    model = langid.fit([t for t, _ in rows], [x for _, x in rows])
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "lang_rejected")


def op10_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each document and whether they decode to its text.  A null text has none; null and repeated ids give a row each; an empty table gives no rows."""
    return unigram.encode_documents(documents(spark, sf_dir))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and verdict of each page.  A null URL, or one without ``://``, has neither and is judged by the patterns; null and repeated ids give a row each; an empty table gives no rows."""
    out = urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "host", "path", "rule", "verdict", "pattern")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations.  Null turns come first, null roles and texts are empty, rows without a conv_id are left out; an empty table gives no rows."""
    return prefixes.shared_beginnings(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their forms and roots.  A null text has no words, a null id is an empty one, repeated rows count again; an empty table gives no rows."""
    return variants.group_variants(documents(spark, sf_dir))


def simhash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is divisible by 100, and how many others have a fingerprint within RADIUS bits of theirs.

    The search goes through the block tables, between distinct fingerprints;
    copies are counted, not paired.  A null id is no query.
    """
    prints = stage_table(simhash.add_fingerprints(documents(spark, sf_dir)), "fingerprints")
    wanted = prints.where("doc_id % 100 = 0")
    near = simhash.within_radius(wanted, prints, radius=simhash.RADIUS, blocks=simhash.BLOCKS)
    members = prints.groupBy(F.col("hi").alias("hi2"), F.col("lo").alias("lo2")).agg(F.count("*").alias("n"))
    found = near.join(members, ["hi2", "lo2"]).groupBy("hi", "lo").agg((F.sum("n") - 1).alias("n_near"), F.min("bits").alias("least"), F.max("bits").alias("most"))
    return wanted.join(found, ["hi", "lo"]).select("doc_id", "n_near", "least", "most")


#: What a sequence of conversations holds: each of the three limits is reached by some.
CONVERSATION_LIMITS = packing.Limits(tokens=3584, segments=18, loss=2800)


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations in sequences with limits on tokens, turns and tokens of answers.  Null texts are empty; an empty table gives no rows."""
    sizes = packing.conversation_sizes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return packing.pack_whole(stage_table(sizes, "conversation-sizes"), CONVERSATION_LIMITS)


def wavelet_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token id that is divisible by 100 occurs in all documents, and where first and last, looked up in the shard files."""
    shards = wavelet.with_starts(wavelet.encode_shards(documents(spark, sf_dir)))
    return wavelet.occurrences(shards, list(range(0, 50_257, 100)))


def queries() -> dict:
    named = {"simhash_search": simhash_search, "packing_conversations": packing_conversations, "wavelet_occurrences": wavelet_occurrences}
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | named


def _op3_sql() -> str:
    risk, rules = quality.Risk(), quality.RULES
    length = len(rules[0].ladder)

    def step(i: int, r: quality.Rule) -> str:
        top, low = r.measure.split(" / ")
        beyond = " + ".join(f"CAST(({top}) / nullif({low}, 0) {'>' if r.high else '<'} CAST({c} AS DOUBLE) AS INTEGER)" for c in r.ladder)
        return f"CASE WHEN {low} <> 0 AND {beyond} > 0 THEN ({length} - ({beyond})) * {len(rules)} + {i} END"

    rate = risk.rate
    term = f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate!r}) + (n - j) * ln(1 - {rate!r}))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '(null)') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 4]) AS k FROM g),
p AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS q FROM r WHERE k > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN p USING (doc_id)),
m AS (SELECT *, least({', '.join(step(i, r) for i, r in enumerate(rules))}) AS step FROM s),
l AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
good AS (SELECT m.* FROM m JOIN l USING (doc_id)),
sizes AS (SELECT stratum, count(*) AS c, count(*) * {quality.STRATA} >= (SELECT count(*) FROM good) AS large FROM good GROUP BY stratum),
named AS (SELECT CASE WHEN large THEN stratum ELSE '{quality.POOLED}' END AS stratum, step FROM good JOIN sizes USING (stratum)),
tests AS (SELECT stratum, place, count(*) AS n, count(*) FILTER (step <= place) AS k FROM named, range({length * len(rules)}) v(place) GROUP BY ALL),
proved AS (SELECT *, CASE WHEN k < n * {rate!r} THEN list_sum(list_transform(range(0, k + 1), lambda j: {term})) ELSE 1.0 END AS p FROM tests),
best AS (SELECT stratum, max(place) FILTER (p <= {risk.error!r} / (SELECT count(DISTINCT stratum) FROM tests)) AS upto FROM proved GROUP BY stratum),
v AS (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(step <= upto, false) AS failed
      FROM m LEFT JOIN sizes z USING (stratum) LEFT JOIN best b ON b.stratum = CASE WHEN z.large THEN m.stratum ELSE '{quality.POOLED}' END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept FROM v"""


_OP7_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws]
             ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM s),
c AS (SELECT list_sort(g) AS g, min(doc_id) AS rep FROM s WHERE len(g) > 0 GROUP BY ALL),
f AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM f a JOIN f b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(v, m) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v WHERE r.m < e.b),
l AS (SELECT v, min(m) AS m FROM r GROUP BY v)
SELECT n.doc_id, n.n_shingles, coalesce(l.m, n.doc_id) AS component_id, coalesce(l.m, n.doc_id) = n.doc_id AS kept
FROM n JOIN s USING (doc_id) LEFT JOIN c ON c.g = list_sort(s.g) AND len(s.g) > 0 LEFT JOIN l ON l.v = c.rep"""


_OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS m FROM w),
r AS (SELECT doc_id, i FROM h WHERE m IN (SELECT m FROM h GROUP BY m HAVING count(*) > 1)),
c AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r) GROUP BY doc_id),
k AS (SELECT d.doc_id, ws, coalesce(ps, []) AS ps FROM d LEFT JOIN c USING (doc_id)),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM k),
g AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x
      LEFT JOIN (SELECT doc_id, unnest(ps) AS p, true AS gone FROM k) USING (doc_id, p) WHERE gone IS NULL GROUP BY x.doc_id)
SELECT k.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN g USING (doc_id)"""


#: zlib's checksum of the bytes ``b`` (a list of numbers), by a table of 256 entries made from its polynomial.
_CRC_TABLE = f"""crc_table AS (SELECT list(list_reduce(list_prepend(v, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, {0xEDB88320}) ELSE c // 2 END) ORDER BY v) AS tab FROM range(256) t(v))"""


def _crc(b: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {b}), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295)"


def _op11_sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def fits(r: urls.Rule) -> str:
        if r.on_host:
            host, _, path = r.name.partition("/")
            return f"(host = {quoted(host)} OR ends_with(host, {quoted('.' + host)})) AND starts_with(path, {quoted('/' + path)})"
        told = {"*": ".*", "+": "[^/?#]*", "^": "\\b"}
        return f"regexp_matches(low, {quoted(''.join(told.get(c) or re.escape(c) for c in r.pattern))}, 's')"

    def longest(rules) -> str:
        placed = sorted(enumerate(rules), key=lambda x: (-len(x[1].name), not x[1].block, x[0]))
        return "CASE " + " ".join(f"WHEN {fits(r)} THEN {quoted(r.name)}" for _, r in placed) + " END"

    blocked = ", ".join(quoted(r.name) for r in (*urls.BASE, *urls.PATTERNS) if r.block)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) END, '') AS after,
             translate(coalesce(url, ''), '{upper}_', '{lower}-') AS low FROM pages),
h AS (SELECT page_id, low, translate(regexp_extract(after, '^[^/?#]*', 0, 's'), '{upper}', '{lower}') AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r AS (SELECT page_id, host, path, {longest(urls.BASE)} AS rule, {longest(urls.PATTERNS)} AS pattern FROM h)
SELECT page_id, host, path, rule, pattern, CASE WHEN coalesce(rule, pattern) IN ({blocked}) THEN 'block' ELSE 'allow' END AS verdict FROM r"""


_OP12_SQL = f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, {_crc("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))")} % 6 AS h FROM t, crc_table),
c AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h], h.turns[h + 1:]) AS turns FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS d, unnest(range(len(turns) + 1)) AS depth, turns FROM c),
m AS (SELECT conv_id, d, depth, turns[1:depth] AS k, CASE WHEN depth > 0 THEN turns[1:depth - 1] END AS up, CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS size FROM p),
n AS (SELECT k, up, depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = depth), '')) AS ends_sha256 FROM m GROUP BY k, up, depth),
q AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
o AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN q ON q.up = n.k),
s AS (SELECT a.k, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved_tokens
      FROM (SELECT *, unnest(range(depth + 1)) AS cut FROM o) b JOIN o a ON a.depth = b.cut AND a.k = b.k[1:b.cut] GROUP BY a.k)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(o.n_convs AS BIGINT) AS n_convs, CAST(o.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM o JOIN s ON s.k = o.k LEFT JOIN n u ON u.k = o.up"""


_OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
h AS (SELECT run, {_crc("flatten(list_transform(string_split(id || ':' || run, ''), lambda ch: CASE WHEN ord(ch) > 127 THEN [CAST(195 AS BIGINT), ord(ch) - 64] ELSE [CAST(ord(ch) AS BIGINT)] END))")} AS h FROM r, crc_table),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
x AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
         UNION SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON v.word = less UNION SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON v.word = less),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, struct_pack(m := -other_n, w := encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (SELECT word, other AS form, other_n AS form_n FROM best WHERE other_n >= 2 * n),
steps AS (SELECT word, form AS root FROM f UNION SELECT s.word, f.form FROM steps s JOIN f ON f.word = s.root),
ends AS (SELECT word, root FROM steps WHERE root NOT IN (SELECT word FROM f))
SELECT v.word, f.form, coalesce(e.root, v.word) AS root, CAST(v.n AS BIGINT) AS n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM v LEFT JOIN best USING (word) LEFT JOIN f USING (word) LEFT JOIN ends e USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {"op11_url_filters": _op11_sql(), "op12_prefix_trie": _OP12_SQL, "op13_spelling_variants": _OP13_SQL, "op6_seed_extend": _OP6_SQL, "op3_certified_quality": _op3_sql(), "op7_hyperminhash": _OP7_SQL}
