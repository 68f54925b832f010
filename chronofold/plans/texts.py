"""Queries on texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.functions import text
from chronofold.plans.base import register, table

QUERIES: list = []
query = register(QUERIES)

#: A lexicon for the queries below: some negative words, and two that the test texts have.
NEGATIVE = ["loss", "default", "adverse", "decline", "failure", "the", "on"]


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS n_words, len(regexp_extract_all(text, '[\p{L}\p{N}_\p{M}]+')) AS n_unicode FROM documents")
def fn_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(text.words_ascii(F.col("text"))).cast("long").alias("n_words"), text.words_unicode(F.col("text")).cast("long").alias("n_unicode"))


_IN = ", ".join(f"'{w}'" for w in NEGATIVE)


@query(f"SELECT doc_id, round(coalesce(len(list_filter(w, lambda x: x IN ({_IN}))) / nullif(len(w), 0), 0), 8) AS density FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)")
def fn_lexicon_density(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(text.lexicon_density(F.col("text"), NEGATIVE), 8).alias("density"))


@query("SELECT doc_id, round(len(regexp_extract_all(text, '(?i)th[ae]')) * 10000.0 / nullif(len(regexp_extract_all(text, '[a-zA-Z]+')), 0), 4) AS rate FROM documents")
def fn_term_rate(spark, sf_dir):
    n = F.regexp_count("text", F.lit("[a-zA-Z]+"))
    return _docs(spark, sf_dir).select("doc_id", F.round(text.term_rate(F.col("text"), "(?i)th[ae]", n), 4).alias("rate"))


@query("""WITH t AS (SELECT conv_id, turn, lower(text) AS t, lead(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM conversations)
SELECT conv_id, turn, CAST(greatest((length(u) - length(replace(u, 'the', ''))) // 3 - (length(t) - length(replace(t, 'the', ''))) // 3, 0) AS INTEGER) AS delta FROM t WHERE u IS NOT NULL""")
def fn_phrase_delta(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("later")).where("later IS NOT NULL")
    return c.select("conv_id", "turn", F.greatest(text.phrase_count(F.col("later"), "the") - text.phrase_count(F.col("text"), "the"), F.lit(0)).alias("delta"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(translate(text, chr(160), ' '), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM documents""")
def fn_normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<head\b.*?</head\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM pages""")
def fn_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.plain_html(F.col("html")).alias("text"))


_BLOCK_TAGS = "|".join(sorted(text.BLOCKS, key=lambda t: (-len(t), t)))


@query(rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->', ' ', 'g'), '\s+', ' ', 'g') AS h FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</?({_BLOCK_TAGS})(\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM b),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&copy;', chr(169)), '&middot;', chr(183)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM t)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM e""")
def fn_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.visible_text("html").alias("text"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[.!?;][ \t\n\x0B\f\r]+[A-Z0-9"'']')) + 1 AS INTEGER) AS n_sentences FROM documents""")
def fn_sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


@query(r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
b AS (SELECT doc_id, ws, len(ws) AS n, list_filter(range(1, len(ws) + 1), lambda i: regexp_matches(ws[i], '[.!?]["'')]*$')) AS ends FROM w WHERE len(ws) > 0),
c(doc_id, i, s, e) AS (
 SELECT doc_id, 0, 0, CASE WHEN n <= 500 THEN n ELSE coalesce(list_max(list_filter(ends, lambda x: x > 50 AND x <= 500)), 500) END FROM b
 UNION ALL
 SELECT doc_id, i + 1, t, CASE WHEN n <= t + 500 THEN n ELSE coalesce(list_max(list_filter(ends, lambda x: x > t + 50 AND x <= t + 500)), t + 500) END
 FROM (SELECT c.doc_id, i, greatest(s + 1, e - 50) AS t, n, ends FROM c JOIN b USING (doc_id) WHERE e < n))
SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, array_to_string(ws[s + 1:e], ' ') AS chunk FROM c JOIN b USING (doc_id)""")
def fn_chunk(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(text.chunk_text(F.col("text"))).alias("i", "chunk")).select("doc_id", F.col("i").cast("long").alias("chunk_index"), "chunk")


@query("SELECT doc_id, i AS chunk_index, array_to_string(w[i * 450 + 1:i * 450 + 500], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - 50) / 450) AS BIGINT)))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents) WHERE len(w) > 0)")
def win_chunk_index(spark, sf_dir):
    """Chunks of a fixed stride, all in SQL."""
    w = _docs(spark, sf_dir).select("doc_id", F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - 50) / 450) - 1).cast("long")
    return w.select("doc_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_index")).select("doc_id", "chunk_index", F.array_join(F.slice("w", (F.col("chunk_index") * 450 + 1).cast("int"), F.lit(500)), " ").alias("chunk"))


_T = "coalesce(text, '')"


_NONE = r"""'^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$'"""


@query(rf"""WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS annual, {_T} AS t FROM documents),
b AS (SELECT doc_id, 'risk_factors' AS section, concat('Item 1A.', chr(10), 'Risk Factors', chr(10), '{{', doc_id, '}} ', t) AS body FROM d
 UNION ALL SELECT doc_id, 'management_discussion', concat(CASE WHEN annual THEN 'Item 7. ' ELSE 'PART I Item 2. ' END, 'Management''s Discussion and Analysis', chr(10), t) FROM d WHERE doc_id % 3 > 0)
SELECT doc_id, section, regexp_replace(body, {_NONE}, '', 'g') AS body FROM b WHERE len(regexp_extract_all(body, '[^ \t\n\x0B\f\r]+')) >= 12""")
def fn_extract_sections(spark, sf_dir):
    """Annual and quarterly filings after a table of contents.

    The title of the risk factors stands on a line of its own; an item of the
    same number without that title is no section; of every third filing the
    discussion has no end, so it is not told.
    """
    t, annual, line = F.coalesce("text", F.lit("")), F.col("doc_id") % 2 == 0, F.lit("\n")
    toc = F.lit("Item 1A. Risk Factors\nItem 2. Properties\nItem 7. Management's Discussion\nItem 8. Statements\n")
    other = F.concat(F.lit("Item 1A. Nothing of the kind\n"), F.repeat(F.lit("word "), F.lit(300)), line)
    risk = F.concat(F.lit("Item 1A.\nRisk Factors\n{"), F.col("doc_id").cast("string"), F.lit("} "), t, F.lit("\nItem 3. Staff\n"))
    discussion = F.concat(F.when(annual, "Item 7. ").otherwise("PART I Item 2. "), F.lit("Management's Discussion and Analysis\n"), t, line)
    filing = F.concat(toc, other, risk, discussion, F.when(F.col("doc_id") % 3 > 0, "Item 9. Controls\nnone").otherwise(""))
    found = text.section_bodies(filing, F.when(annual, "10-K").otherwise("10-Q"))
    return _docs(spark, sf_dir).select("doc_id", F.explode(found).alias("section", "body"))


_SQUARE = "' \t\n\x0B\f\r'"


@query(f"""WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS annual, trim(concat('[', doc_id, '] ', {_T}), {_SQUARE}) AS b FROM documents)
SELECT doc_id, CASE WHEN annual THEN '10-K' ELSE '10-Q' END AS form, 'Item 1A Risk Factors' AS section, b AS body FROM d WHERE length(b) > 100
UNION ALL SELECT doc_id, '10-K', 'Item 7 Management''s Discussion and Analysis', trim(left(concat('. ', b), 250000), {_SQUARE}) FROM d WHERE annual AND length(b) + 2 > 100""")
def fn_split_sections(spark, sf_dir):
    """Filings of two forms: risk factors up to the next item, and in annual ones a discussion without an end."""
    d = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.coalesce("text", F.lit(""))).alias("b"))
    annual = d.where("doc_id % 2 = 0").select("doc_id", F.lit("10-K").alias("form"), F.explode(text.anchored_sections(F.concat(F.lit("\n PART I Item 1A. Risk&nbsp;Factors "), "b", F.lit("\nItem 1B. Staff\nItem 7. Management's Discussion and Analysis. "), "b"), "10-K")).alias("s"))
    quarter = d.where("doc_id % 2 = 1").select("doc_id", F.lit("10-Q").alias("form"), F.explode(text.anchored_sections(F.concat(F.lit("\nItem 1A Risk Factors "), "b", F.lit("\n PART II Item 2. Unregistered")), "10-Q")).alias("s"))
    return annual.unionByName(quarter).select("doc_id", "form", "s.section", F.col("s.text").alias("body"))


#: What is said in the middle of each document, by its id, once or twice: denied, plain, an auditor's phrase, nothing of the kind, and plain with a denial beyond reach.
SAID = ["We do not have sufficient cash.", "There is insufficient liquidity.", "Our responsibility covers insufficient capital.", "All is well.", "There is insufficient liquidity" + " and so on" * 20 + " and no default."]


def _said():
    """Documents with the sentence after their first half, and for odd ids again at the end."""
    pick = F.element_at(F.array(*[F.lit(x) for x in SAID]), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    t = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    again = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit(". "), pick)).otherwise("")
    return F.concat(F.left(t, half), F.lit(". "), pick, F.lit(" "), F.substr(t, half + 1), again)


_TIMES = "CASE WHEN doc_id % 5 IN ({0}) THEN 1 + doc_id % 2 ELSE 0 END"


@query(f"SELECT doc_id, CAST({_TIMES.format('1, 4')} AS INTEGER) AS n_plain, CAST({_TIMES.format('0')} AS INTEGER) AS n_negated, CAST({_TIMES.format('2')} AS INTEGER) AS n_boilerplate FROM documents")
def fn_context_rate(spark, sf_dir):
    c = _docs(spark, sf_dir).select("doc_id", _said().alias("t")).select("doc_id", text.context_rate(text.SHORTFALL)("t").alias("c"))
    return c.select("doc_id", *[F.col("c")[n].alias(f"n_{n}") for n in ("plain", "negated", "boilerplate")])


@query(f"SELECT doc_id, CAST({_TIMES.format('0, 1, 4')} AS INTEGER) AS included, CAST(-({_TIMES.format('0')}) AS INTEGER) AS delta FROM documents")
def fn_corrected_liquidity(spark, sf_dir):
    """Under the narrower denial the first of the five is a shortfall."""
    return _docs(spark, sf_dir).select("doc_id", _said().alias("t")).select("doc_id", text.corrected_liquidity("t").alias("c")).select("doc_id", "c.*")


@query("""WITH p AS (SELECT doc_id, text, string_split_regex(text, '(?i)that') AS parts FROM documents),
m AS (SELECT doc_id, text, k, list_sum(list_transform(parts[1:k], lambda x: length(x))) + 4 * (k - 1) AS start FROM (SELECT *, unnest(range(1, least(len(parts), 4))) AS k FROM p))
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + 4 AS INTEGER) AS "end", sha256(substring(text, CAST(greatest(start - 100, 0) AS BIGINT) + 1, CAST(start + 104 - greatest(start - 100, 0) AS BIGINT))) AS sha256 FROM m""")
def fn_match_proofs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.inline(text.proofs("that")("text")))


#: What filings say, with the day they were filed on, and what is told of it: day, chapter, whether the company is named; None if it is no petition.
PETITIONS = [
    ("On March 1, 2020, Acme Inc. filed a voluntary petition under chapter 11.", "2020-03-15", ("2020-03-01", "11", True)),
    ("As said, on May 5, 2020 (the \"Petition Date\"), the Company and its parent commenced cases under chapter 7 of the code.", "2020-05-05", ("2020-05-05", "7", True)),
    ("On July 1, 2022 its creditors filed an involuntary petition under chapter 7.", "2022-07-02", None),
    ("On July 1, 2022 our landlord, Stone Ltd, filed a petition under chapter 11.", "2022-07-02", ("2022-07-01", "11", False)),
    ("On July 1, 2022 the Company agreed that its parent filed a petition under chapter 11.", "2022-07-02", None),
    ("On July 1, 2022 the Company filed a petition under chapter 15.", "2022-07-02", None),
    ("On January 1, 2022 the Company filed a petition under chapter 11.", "2022-07-02", None),
    ("On July 9, 2022 the Company filed a petition under chapter 11.", "2022-07-02", None),
    ("On June 3, 2022 the Company filed a petition under chapter 11. On June 9, 2022, Acme Incorporated commenced a case; on June 10, 2022, Acme Corp and others filed their joint petitions under chapter 7.", "2022-06-20", ("2022-06-03", "11", True)),
]


def _petition_sql() -> str:
    told = ", ".join(f"({i}, '{day}', '{chapter}', {str(named).lower()})" for i, (_, _, x) in enumerate(PETITIONS) if x for day, chapter, named in [x])
    told += ", (8, '2022-06-10', '7', false)"
    return f"SELECT doc_id, CAST(d AS DATE) AS petition_date, c AS chapter, n AS issuer_included FROM documents JOIN (VALUES {told}) v(i, d, c, n) ON doc_id % {len(PETITIONS)} = i"


@query(_petition_sql())
def fn_petition_extract(spark, sf_dir):
    """A statement in the middle of each document: petitions in several words, one of another party, and what is no petition of the kind."""
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in PETITIONS]), (F.col("doc_id") % len(PETITIONS) + 1).cast("int"))
    t = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    said = F.concat(F.left(t, half), F.lit(". "), pick(0), F.lit(" "), F.substr(t, half + 1))
    filings = _docs(spark, sf_dir).select("doc_id", said.alias("said"), pick(1).cast("date").alias("filed"), F.array(F.lit("Acme, Incorporated")).alias("names"))
    return text.petitions(filings, text="said", filed="filed", names="names").select("doc_id", "petition_date", "chapter", "issuer_included")


@query("SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x IN ('the', 'on', 'la', 'der'))) AS n_hits FROM documents")
def fn_screen_terms(spark, sf_dir):
    hits = F.filter(text.words_ascii(F.col("text")), lambda x: x.isin("the", "on", "la", "der"))
    return _docs(spark, sf_dir).select("doc_id", F.size(hits).cast("long").alias("n_hits"))


def _turns(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("later")).where("later IS NOT NULL")


@query()
def fn_seq_diff(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", text.seq_diff("text", "later").alias("d")).select("conv_id", "turn", "d.*")


@query("""WITH t AS (SELECT conv_id, turn, string_split(text, '. ') AS a, string_split(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '. ') AS b FROM conversations)
SELECT conv_id, turn, len(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))) AS added, len(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS removed FROM t WHERE b IS NOT NULL""")
def fn_set_diff(spark, sf_dir):
    """Sentences added and removed, as sets: the part of the comparison that SQL can express."""
    a, b = F.split("text", r"\. "), F.split("later", r"\. ")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.size(F.array_except(b, a)).cast("long").alias("added"), F.size(F.array_except(a, b)).cast("long").alias("removed"))


@query("""SELECT CASE c_custkey // 100 % 4 WHEN 0 THEN lower(c_name) WHEN 1 THEN replace(c_name, '#', ' no. ') WHEN 2 THEN c_name || ', Inc.' ELSE c_name END AS name, c_name AS suggestion FROM customer WHERE c_custkey % 100 = 0
UNION ALL SELECT concat('Zz ', c_custkey, ' !!') , NULL FROM customer WHERE c_custkey % 100 = 1""")
def join_fuzzy_name(spark, sf_dir):
    """A stated set of names against the whole registry: names in other case, with marks or more words, known ones, and some that are like none.

    All names of the registry differ in digits only, so each is like all that
    are asked for; the closest one is that with all of the digits in their order.
    """
    c, name = table(spark, sf_dir, "customer"), F.col("c_name")
    known = c.select(name.alias("name"))
    way = F.floor(F.col("c_custkey") / 100) % 4
    told = F.when(way == 0, F.lower(name)).when(way == 1, F.replace(name, F.lit("#"), F.lit(" no. "))).when(way == 2, F.concat(name, F.lit(", Inc."))).otherwise(name)
    names = c.where("c_custkey % 100 = 0").select(told.alias("name")).unionByName(c.where("c_custkey % 100 = 1").select(F.concat(F.lit("Zz "), "c_custkey", F.lit(" !!")).alias("name")))
    return text.fuzzy_names(names, known, name="name")
