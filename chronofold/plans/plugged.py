"""Queries through the places where a caller's own part is plugged in."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import retrieval as r
from chronofold.operators import surfaces
from chronofold.plans.base import ORDERS, SCORED, orders, register, scored, table
from chronofold.plans.evaluation import _CELLS, _cells
from chronofold.plans.retrieval import _BM25, _index, _queries

QUERIES: list = []
query = register(QUERIES)


@query(f"""WITH {_BM25}, x AS (SELECT b.query, b.key, b.rank FROM b JOIN documents d ON d.doc_id = b.key WHERE b.rank <= 20 AND source IS NOT NULL AND lang = 'en' AND n_chars >= 200)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY rank) AS INTEGER) AS citation, key FROM x QUALIFY citation <= 3""")
def api_retriever(spark, sf_dir):
    """Answers through a plugged lexical retriever, with guards on citation, entity and date."""
    passages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", "lang", "n_chars")
    index = _index(spark, sf_dir)
    return surfaces.cited_answers(_queries(spark, sf_dir), lambda q, k: r.bm25(q, index, k=k), passages, k=3, cited=F.col("source").isNotNull(), entity=F.col("lang") == "en", dated=F.col("n_chars") >= 200)


@query(f"""WITH {SCORED} SELECT unit, fold, round((SELECT sum(w * y) / sum(w) FROM s t WHERE t.fold <> s.fold AND t.lang = s.lang), 8) AS score FROM s""")
def api_trainer(spark, sf_dir):
    """Scores of a plugged trainer: the weighted rate of the row's language in the other folds."""

    def trainer(train, features, target):
        rates = train.groupBy(*features).agg((F.sum(F.col("w") * F.col(target)) / F.sum("w")).alias("score"))
        return lambda rows: rows.join(rates, list(features), "left")

    out = surfaces.cross_fitted(scored(spark, sf_dir), trainer, features=["lang"], target="y", fold="fold")
    return out.select("unit", "fold", F.round("score", 8).alias("score"))


@query(f"WITH {ORDERS} SELECT accession, CASE WHEN accession % 3 = 0 THEN cents ELSE cents + 1 END AS cents FROM o WHERE accession % 3 = 0 OR status <> 'P'")
def api_fetcher(spark, sf_dir):
    """What is known stays, and a plugged fetcher is asked for the rest; it does not have everything."""
    o = orders(spark, sf_dir).select("accession", "cents", "status")
    origin = o.where("status <> 'P'").select("accession", (F.col("cents") + 1).alias("cents"))
    return surfaces.fetched(o, lambda keys: origin.join(keys, "accession", "left_semi"), o.where("accession % 3 = 0").select("accession", "cents"), key="accession")


@query(f"WITH {_CELLS} SELECT k, CASE WHEN x IS NOT NULL THEN round(least(greatest(x, (SELECT quantile_cont(x, 0.05) FROM v WHERE tr)), (SELECT quantile_cont(x, 0.95) FROM v WHERE tr)), 4) END AS x FROM v")
def api_transformer(spark, sf_dir):
    """A transformer that is fitted on the training rows and applied to all."""
    rows, train = _cells(spark, sf_dir)
    return surfaces.QuantileClipper(["x"], 0.05, 0.95).fit(train).transform(rows).select("k", F.round("x", 4).alias("x"))
