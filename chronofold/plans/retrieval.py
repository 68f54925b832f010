"""Retrieval queries: benchmark items and vectors against documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import latent
from chronofold.operators import retrieval as r
from chronofold.plans.base import register, table
from chronofold.staging import written

QUERIES: list = []
query = register(QUERIES)

_STOP = ", ".join(f"'{w}'" for w in r.STOPWORDS)
_Q = f"""q AS (SELECT item_id AS query, list(w ORDER BY i) AS terms FROM (SELECT item_id, w, i, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM (SELECT item_id, w, min(i) AS i FROM
 (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark)) WHERE w NOT IN ({_STOP}) GROUP BY item_id, w)) WHERE r <= 64 GROUP BY item_id)"""


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), r.terms(F.col("text")).alias("terms"))


def _index(spark, sf_dir):
    return r.question_index(table(spark, sf_dir, "documents").select("doc_id", "text"), _queries(spark, sf_dir), key="doc_id", text="text")


@query(f"WITH {_Q} SELECT query, terms FROM q")
def ret_terms(spark, sf_dir):
    return _queries(spark, sf_dir).where("size(terms) > 0")


_GROUPS = ", ".join(f"[{', '.join(repr(w) for w in sorted(g))}]" for g in r.TOPICS.values())


@query(f"""WITH t AS (SELECT conv_id, turn, i, w FROM (SELECT conv_id, turn, w, min(i) AS i FROM (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM
 (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM conversations)) WHERE w NOT IN ({_STOP}) GROUP BY ALL)),
o AS (SELECT conv_id, turn, list(w ORDER BY i)[1:64] AS own FROM t GROUP BY ALL),
g AS (SELECT conv_id, turn, own, list_reduce([own] || list_filter([{_GROUPS}], lambda x: list_has_any(own, x)), lambda a, b: a || list_filter(b, lambda y: NOT list_contains(a, y))) AS terms FROM o)
SELECT conv_id, turn, terms FROM g""")
def ret_expand(spark, sf_dir):
    """All turns of all conversations as questions: their terms, and the words of each topic they touch."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", r.terms(F.col("text")).alias("own")).where("size(own) > 0")
    return c.select("conv_id", "turn", r.expanded(F.col("own")).alias("terms"))


_BM25 = f"""{_Q}, d AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents), t AS (SELECT count(*) AS nd, avg(len(ws)) AS av FROM d),
p AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(ws) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS n FROM p GROUP BY term),
s AS (SELECT query, key, -sum(greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / av))) AS score FROM (SELECT query, unnest(terms) AS term FROM q) JOIN p USING (term) JOIN f USING (term) JOIN d USING (key), t GROUP BY query, key),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9), key) AS rank FROM s)"""


@query(f"WITH {_BM25} SELECT query, key, round(score, 6) AS score, rank FROM b WHERE rank <= 10")
def ret_bm25(spark, sf_dir):
    return r.bm25(_queries(spark, sf_dir), _index(spark, sf_dir), k=10).select("query", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25} SELECT query, key, rank FROM b WHERE rank <= 5")
def topk_bm25(spark, sf_dir):
    return r.bm25(_queries(spark, sf_dir), _index(spark, sf_dir), k=5).select("query", "key", F.col("rank").cast("long").alias("rank"))


_COS = """s AS (SELECT a.vec_id AS query, b.vec_id AS key, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 6) DESC, key) AS rank FROM s)"""


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.where("vec_id % 100 = 0"), e


@query(f"WITH {_COS} SELECT query, key, round(similarity, 5) AS similarity, rank FROM c WHERE rank <= 10")
def ret_vector(spark, sf_dir):
    q, e = _vectors(spark, sf_dir)
    return r.nearest(q, e, query="vec_id", key="vec_id", vector="embedding", k=10).select("query", "key", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))


topk_vector = ret_vector


@query(f"WITH {_COS} SELECT query, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 6) DESC, key) AS rank FROM s WHERE similarity >= 0.2) WHERE rank <= 20".replace(", rank FROM (SELECT *", ", rank FROM (SELECT query, key"))
def topk_cosine_lsa(spark, sf_dir):
    q, e = _vectors(spark, sf_dir)
    return r.nearest(q, e, query="vec_id", key="vec_id", vector="embedding", k=20, least=0.2).select("query", "key", F.col("rank").cast("long").alias("rank"))


_TFIDF = f"""{_BM25}, w AS (SELECT key, unnest(list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1]))) AS g FROM d WHERE len(ws) > 1),
gq AS (SELECT DISTINCT query, unnest(list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1]))) AS g FROM (SELECT item_id AS query, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark) WHERE len(ws) > 1),
gt AS (SELECT key, g, 1 + ln(count(*)) AS tf FROM w WHERE g IN (SELECT g FROM gq) GROUP BY ALL),
gi AS (SELECT g, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM gt GROUP BY g),
gs AS (SELECT query, key, sum(tf * idf * idf) AS score FROM gq JOIN gt USING (g) JOIN gi USING (g) GROUP BY ALL),
gr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, key) AS rank FROM gs),
m AS (SELECT query, key, rank FROM b WHERE rank <= 20 UNION ALL SELECT query, key, rank FROM gr WHERE rank <= 20), u AS (SELECT query, key, sum(1.0 / (60 + rank)) AS score FROM m GROUP BY ALL)"""


@query(f"WITH {_TFIDF} SELECT query, key, round(score, 8) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, key) AS rank FROM u QUALIFY rank <= 10")
def ret_hybrid_rrf(spark, sf_dir):
    """Fusion of the lexical list with a second one over two-word terms, sublinear and weighted by rarity."""
    top = r.bm25(_queries(spark, sf_dir), _index(spark, sf_dir), k=20)
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    second = r.phrase_list(words, table(spark, sf_dir, "documents").select("doc_id", "text"), query="query", key="doc_id", text="text", k=20)
    return r.fuse([top, second], k=10).select("query", "key", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_BM25}, j AS (SELECT b.query, key, b.rank, len(list_intersect(terms, ws)) / len(terms) AS share FROM b JOIN q USING (query) JOIN d USING (key) WHERE b.rank <= 20)
SELECT query, key, round(share, 8) AS share, row_number() OVER (PARTITION BY query ORDER BY share DESC, rank) AS rank FROM j QUALIFY row_number() OVER (PARTITION BY query ORDER BY share DESC, j.rank) <= 5""".replace("ORDER BY share DESC, rank)", "ORDER BY share DESC, j.rank)"))
def ret_rerank(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query", "key", F.round("share", 8).alias("share"), F.col("rank").cast("long").alias("rank"))


def _reranked(spark, sf_dir):
    q = _queries(spark, sf_dir)
    top = r.bm25(q, _index(spark, sf_dir), k=20).withColumnRenamed("rank", "before")
    rows = top.join(F.broadcast(q), "query").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"), "key")
    return r.rerank(rows, query_terms="terms", text="text", order="before", by="query", k=5)


_RISK = ", ".join(f"'{w}'" for w in sorted(r.TOPICS["risk"]))
_TOPIC = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in sorted(g))}) THEN [{', '.join(repr(x) for x in sorted(g))}]" for g in r.TOPICS.values()) + " ELSE [w] END"
#: Passages: documents with an entity, a date and a section of their own, and a chunk id that pairs of them share; questions with an entity and a date, every third about risks.
_PASSAGES = """x AS (SELECT doc_id AS key, text, lang AS entity, DATE '2020-01-01' + CAST(doc_id % 400 AS INTEGER) AS filed, CASE WHEN doc_id % 5 = 0 THEN 'Risk_Factors' WHEN doc_id % 5 = 1 THEN 'business' END AS section, doc_id // 2 AS chunk, source FROM documents)"""
_ASKED = f"""k AS (SELECT item_id AS query, CASE item_id % 3 WHEN 0 THEN 'Risks and uncertainty?' WHEN 1 THEN concat('What risk ', text) ELSE text END AS question, CASE item_id % 4 WHEN 3 THEN 'xx' ELSE 'en' END AS entity, DATE '2020-06-01' + CAST(item_id % 90 AS INTEGER) AS as_of FROM benchmark),
kq AS (SELECT query, question, entity, as_of, list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP}))) AS words FROM k)"""


def _passages(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    section = F.when(i % 5 == 0, "Risk_Factors").when(i % 5 == 1, "business")
    return d.select(i.alias("key"), "text", F.col("lang").alias("entity"), F.date_add(F.lit("2020-01-01").cast("date"), (i % 400).cast("int")).alias("filed"), section.alias("section"), F.floor(i / 2).alias("chunk"), "source")


def _asked(spark, sf_dir):
    """Questions about risks alone, about risks and more, and about other things; of an entity that is not there, too."""
    b, i = table(spark, sf_dir, "benchmark"), F.col("item_id")
    question = F.when(i % 3 == 0, "Risks and uncertainty?").when(i % 3 == 1, F.concat(F.lit("What risk "), "text")).otherwise(F.col("text"))
    q = b.select(i.alias("query"), question.alias("question"), F.when(i % 4 == 3, "xx").otherwise("en").alias("asked_entity"), F.date_add(F.lit("2020-06-01").cast("date"), (i % 90).cast("int")).alias("as_of"))
    return q.withColumn("words", r.terms(F.col("question"))).withColumn("terms", r.expanded(F.col("words")))


#: The expanded question's best twenty of its entity by its date, ranked by the rule, in SQL.
_EVIDENCE = f"""{_PASSAGES}, {_ASKED},
ke AS (SELECT query, list_reduce([words[1:64]] || list_filter([{_GROUPS}], lambda g: list_has_any(words[1:64], g)), lambda a, b: a || list_filter(b, lambda y: NOT list_contains(a, y))) AS terms FROM kq),
d AS (SELECT key, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM x), t AS (SELECT count(*) AS nd, avg(len(ws)) AS av FROM d),
p AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(ws) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS n FROM p GROUP BY term),
s AS (SELECT query, key, -sum(greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / av))) AS score FROM (SELECT query, unnest(terms) AS term FROM ke) JOIN p USING (term) JOIN f USING (term) JOIN d USING (key), t GROUP BY query, key),
c AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY round(score, 9), key) AS before FROM s JOIN kq USING (query) JOIN x USING (key) WHERE x.entity = kq.entity AND x.filed <= kq.as_of QUALIFY before <= 20),
j AS (SELECT query, key, before, chunk, section, source, words[1:64] AS words, list_distinct(list_filter(ws, lambda w: w NOT IN ({_STOP}))) AS tokens, coalesce(lower(section) IN ('risk_factors', 'risk factors', 'item_1a'), false) AS there FROM c JOIN kq USING (query) JOIN x USING (key) JOIN d USING (key)),
m AS (SELECT *, len(list_filter(words, lambda w: list_has_any({_TOPIC}, tokens))) AS matched, list_has_any(words, [{_RISK}]) AS asks, list_has_any(words, [{_RISK}]) AND len(list_filter(words, lambda w: w NOT IN ({_RISK}))) <= 1 AS alone FROM j),
z AS (SELECT *, matched / greatest(len(words), 1) + CASE WHEN asks AND there THEN 2 ELSE 0 END AS score FROM m WHERE (NOT alone OR there) AND (len(words) = 0 OR matched > 0 OR (alone AND there)) QUALIFY row_number() OVER (PARTITION BY query, chunk ORDER BY before) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, before) AS rank FROM z QUALIFY rank <= 5)"""


def _evidence(spark, sf_dir):
    """The best five passages of each question, which may only come from its entity and from before its date."""
    asked, passages = _asked(spark, sf_dir), _passages(spark, sf_dir)
    about = passages.select("key", "entity", "filed")
    wanted = asked.select("query", "asked_entity", "as_of")

    def known(scored):
        rows = scored.join(about, "key").join(F.broadcast(wanted), "query")
        return r.guarded(rows, cited=F.lit(True), entity=F.col("entity") == F.col("asked_entity"), dated=F.col("filed") <= F.col("as_of")).select("query", "key", "score")

    index = r.question_index(passages.select("key", "text"), asked, key="key", text="text")
    top = r.bm25(asked.select("query", "terms"), index, k=20, keep=known).select("query", "key", F.col("rank").alias("before"))
    rows = top.join(F.broadcast(asked.select("query", "words")), "query").join(passages, "key")
    return r.rank_evidence(rows, by="query", question_terms="words", text="text", section="section", chunk="chunk", order="before", k=5)


@query(f"WITH {_EVIDENCE} SELECT query, key, round(score, 8) AS score, rank FROM top")
def ret_rank_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir).select("query", "key", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


_RERANK = f"""{_BM25}, j AS (SELECT b.query, b.key, b.rank AS before, len(list_intersect(terms, ws)) / len(terms) AS share, lang, source, n_chars FROM b JOIN q USING (query) JOIN d USING (key) JOIN documents x ON x.doc_id = b.key WHERE b.rank <= 20),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY share DESC, before) AS place FROM j QUALIFY place <= 5)"""


@query(f"WITH {_EVIDENCE} SELECT kq.query, CAST(row_number() OVER (PARTITION BY kq.query ORDER BY rank) AS INTEGER) AS citation, key, source, CASE WHEN key IS NULL THEN 'unavailable' ELSE 'evidence_found' END AS status FROM kq LEFT JOIN (FROM top WHERE source IS NOT NULL) USING (query) QUALIFY citation <= 3".replace("kq.query, CAST(row_number() OVER (PARTITION BY kq.query ORDER BY rank) AS INTEGER)", "kq.query AS query, CASE WHEN key IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY kq.query ORDER BY rank) AS INTEGER) END").replace("QUALIFY citation <= 3", "QUALIFY row_number() OVER (PARTITION BY kq.query ORDER BY rank) <= 3"))
def ret_qa(spark, sf_dir):
    """Expanded question, retrieval by entity and date, ranking, and numbered citations of passages with a source; without any the answer is unavailable."""
    cited = _evidence(spark, sf_dir).where("source IS NOT NULL").withColumnRenamed("rank", "place")
    found = r.ranked(cited, by="query", order=[F.col("place")], k=3).select("query", F.col("rank").alias("citation"), "key", "source")
    out = _asked(spark, sf_dir).select("query").join(found, "query", "left")
    return out.select("query", "citation", "key", "source", F.when(F.col("key").isNull(), "unavailable").otherwise("evidence_found").alias("status"))


@query(f"WITH {_RERANK} SELECT query, key, source FROM top WHERE source IS NOT NULL AND n_chars >= 200 AND key % 4 <> query % 4")
def ret_evidence(spark, sf_dir):
    """Reranked passages that are cited, of the entity asked for, and not dated after the question; here by source, id and length."""
    rows = _reranked(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", "n_chars"), "key")
    return r.guarded(rows, cited=F.col("source").isNotNull(), entity=F.col("key") % 4 != F.col("query") % 4, dated=F.col("n_chars") >= 200).select("query", "key", "source")


@query(f"""WITH {_BM25}, x AS (SELECT query, key, rank FROM b WHERE rank <= 10), v AS (SELECT b.item_id AS query, d.doc_id AS key FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT query, min(rank) AS f FROM x JOIN v USING (query, key) WHERE rank <= 5 GROUP BY query), n AS (SELECT query, count(*) AS n FROM x GROUP BY query)
SELECT round(avg(CASE WHEN p.query IS NOT NULL THEN CASE WHEN f IS NOT NULL THEN 1.0 ELSE 0.0 END END), 6) AS hit, round(avg(CASE WHEN p.query IS NOT NULL THEN coalesce(1.0 / f, 0) END), 6) AS mrr, count(*) FILTER (p.query IS NULL AND n IS NULL) AS abstained
FROM q LEFT JOIN (SELECT DISTINCT query FROM v) p USING (query) LEFT JOIN h USING (query) LEFT JOIN n USING (query)""")
def ret_eval(spark, sf_dir):
    """Documents that quote an item whole are relevant to it; items are a stated, small query set."""
    q = _queries(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("t"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    relevant = written(r.quoting(d, items, key="key", text="text", query="query", said="t"), "relevant")
    e = r.evaluate(r.bm25(q, _index(spark, sf_dir), k=10), relevant, q)
    return e.select(F.round("hit", 6).alias("hit"), F.round("mrr", 6).alias("mrr"), "abstained")


@query("SELECT sha256(text) AS evidence, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY text")
def ret_memo_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("evidence")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT source AS kase, doc_id AS id, concat(text, CASE WHEN doc_id % 7 = 0 THEN ' Working Capital and a covenant.' WHEN doc_id % 7 = 1 THEN ' Debts, salesman.' ELSE '' END) AS t FROM documents WHERE source IS NOT NULL AND doc_id % 3 > 0),
k AS (SELECT source AS kase, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 UNION ALL SELECT 'no passages', 2),
v AS (SELECT * FROM (VALUES (0, 'Liquidity and cash runway', ['current_ratio', 'cash_to_assets', 'cashflow_to_assets', 'operating_cash_burn_to_cash'], '\\b(liquidity|cash|funding|working capital)\\b'),
 (1, 'Debt and repayment', ['liabilities_to_assets', 'net_debt_proxy_to_assets', 'interest_coverage'], '\\b(debt|borrowings|maturities|maturity|covenant|interest)\\b'),
 (2, 'Profitability and operating performance', ['operating_margin', 'ebit_to_ta', 'cashflow_margin'], '\\b(profit|profitability|operating income|operating loss|margin)\\b'),
 (3, 'Growth and business outlook', ['revenue_growth_yoy', 'sales_to_ta'], '\\b(revenue|sales|growth|competition|demand)\\b')) v(i, theme, names, p)),
s AS (SELECT kase, theme, count(DISTINCT id) AS n_sources, min(id) AS first_source FROM c, v WHERE regexp_matches(t, p, 'i') GROUP BY ALL)
SELECT kase AS company, theme, coalesce(n_sources, 0) AS n_sources, first_source, len(names) AS n_inputs, CASE WHEN i = 0 THEN CAST(n AS DOUBLE) END AS first_value, CASE WHEN i IN (0, 3) AND n_sources > 0 AND (i = 0 OR n % 2 = 0) THEN 'inputs_and_evidence' ELSE 'partial_coverage' END AS status
FROM k CROSS JOIN v LEFT JOIN s USING (kase, theme)""")
def ret_theme_link(spark, sf_dir):
    """Sources as companies: passages, some of which tell of a theme, and inputs, some of which are missing; one company has no passages."""
    d, i = table(spark, sf_dir, "documents").where("source IS NOT NULL"), F.col("doc_id")
    said = F.concat("text", F.when(i % 7 == 0, " Working Capital and a covenant.").when(i % 7 == 1, " Debts, salesman.").otherwise(""))
    citations = d.where(i % 3 > 0).select(F.col("source").alias("company"), i.alias("id"), said.alias("text"))
    n = F.col("n").cast("double")
    inputs = F.map_from_arrays(F.array(F.lit("current_ratio"), F.lit("other"), F.lit("sales_to_ta")), F.array(n, n, F.when(F.col("n") % 2 == 0, n)))
    counts = d.groupBy(F.col("source").alias("company")).agg(F.count("*").alias("n")).unionByName(spark.range(1).select(F.lit("no passages").alias("company"), F.lit(2).cast("long").alias("n")))
    out = r.link_themes(counts.select("company", inputs.alias("inputs")), citations, case="company", citation="id", text="text", inputs="inputs")
    return out.select("company", "theme", F.size("source_ids").cast("long").alias("n_sources"), F.get("source_ids", F.lit(0)).alias("first_source"), F.size("inputs").cast("long").alias("n_inputs"), F.col("inputs")[0]["value"].alias("first_value"), "status")


def latent_vectors(rows, *, key: str, text: str):
    """(key, u): unit vectors of whole texts in the space of their own corpus; no rows if there are too few for one."""
    terms = latent.with_terms(rows, key=key, text=text).where("size(terms) > 0")
    space = latent.fit_space(terms)
    if space is None:
        return rows.sparkSession.createDataFrame([], f"{key} {rows.schema[key].dataType.simpleString()}, u array<double>")
    return latent.vectors(terms, space).withColumnRenamed("key", key)


@query()
def ret_lsa(spark, sf_dir):
    """Latent semantic vectors of whole documents; every row whose id is divisible by 100 is a query."""
    u = written(latent_vectors(table(spark, sf_dir, "documents"), key="doc_id", text="text"), "latent")
    return r.nearest(u.where("doc_id % 100 = 0"), u, query="doc_id", key="doc_id", vector="u", k=5, least=0.2)


@query()
def ret_hybrid_latent(spark, sf_dir):
    """The lexical list and the semantic one over the passages of one entity up to a date, fused; questions are expanded for both."""
    rows = _passages(spark, sf_dir).where("entity = 'en' AND filed <= DATE'2020-09-01'").select("key", "text")
    asked = _asked(spark, sf_dir).select("query", "terms")
    return r.hybrid(asked, rows, k=10)
