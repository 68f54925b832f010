"""Scans and sinks, exercised on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.plans.base import ORDERS, day, fresh_folder, orders, register, table
from chronofold.sources import filings, generators, origin, readers, sinks
from chronofold.sources.members import ZipLines
from chronofold.sources.origin import PagedSearch
from chronofold.staging import written

QUERIES: list = []
query = register(QUERIES)


def _folder(spark) -> str:
    return fresh_folder(spark, "io")


@query("SELECT r_regionkey, r_name FROM region")
def scan_parquet(spark, sf_dir):
    """A table that is read only if its files are the pinned ones; the pins are those of a copy made here."""
    copy = _folder(spark)
    table(spark, sf_dir, "region").write.parquet(copy)
    pins = {r.path.rpartition("/")[2]: r.sha256 for r in sinks.manifest(spark, copy).where("path LIKE '%.parquet'").collect()}
    return readers.read_parquet(spark, copy, pinned=pins)


@query("SELECT n_nationkey, n_name FROM nation")
def scan_csv(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, "n_nationkey int, n_name string")


@query("SELECT n_nationkey, n_name FROM nation")
def scan_jsonl(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.json(path)
    return readers.read_jsonl(spark, path, "n_nationkey int, n_name string")


@query(f"WITH {ORDERS} SELECT cik, accession, filed, form FROM o WHERE form IN ('1-URGENT', '2-HIGH') AND filed BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def scan_json_soa(spark, sf_dir):
    fields = ["accession", "filed", "form"]
    packed = orders(spark, sf_dir).groupBy("cik").agg(F.struct(*[F.array_sort(F.collect_list(F.struct("accession", "filed", "form"))).getField(f).alias(f) for f in fields]).alias("recent"))
    rows = readers.soa_rows(packed, "recent", fields, ["cik"])
    return rows.where(F.col("form").isin("1-URGENT", "2-HIGH") & F.col("filed").between("1996-01-01", "1998-12-31"))


@query(f"WITH {ORDERS} SELECT cik, CASE accession % 2 WHEN 0 THEN 'Assets' ELSE 'Cash' END AS tag, filed AS \"end\", CAST(cents AS DOUBLE) AS val, CASE status WHEN 'F' THEN '10-K' ELSE '10-Q' END AS form, filed + 30 AS filed, concat('a', accession) AS accn FROM o WHERE status <> 'P'")
def scan_facts_json(spark, sf_dir):
    """A document for each company and tag with all its facts, in dollars and another unit."""
    form = F.when(F.col("status") == "F", "10-K").when(F.col("status") == "O", "10-Q").otherwise("8-K")
    fact = F.struct(F.col("filed").cast("string").alias("end"), F.col("cents").cast("double").alias("val"), form.alias("form"), F.date_add("filed", 30).cast("string").alias("filed"), F.concat(F.lit("a"), "accession").alias("accn"))
    tag = F.when(F.col("accession") % 2 == 0, "Assets").otherwise("Cash")
    facts = orders(spark, sf_dir).groupBy("cik", tag.alias("tag")).agg(F.collect_list(fact).alias("usd"))
    text = F.concat(F.lit('{"'), "tag", F.lit('":{"units":{"EUR":[{"end":"2020-12-31","val":1.0,"form":"10-K"}],"USD":'), F.to_json("usd"), F.lit("}}}"))
    return readers.fact_rows(facts.select("cik", text.alias("j")), "j", ["cik"], ["10-K", "10-Q"])


@query(f"WITH {ORDERS} SELECT CAST(cik AS VARCHAR) AS cik, form, filed FROM o")
def scan_pipe_index(spark, sf_dir):
    lines = orders(spark, sf_dir).select(F.concat_ws("|", "cik", F.lit("name"), "form", "filed", F.lit("f.txt")).alias("value"))
    lines = lines.unionByName(spark.range(1).select(F.lit("CIK|Company|Form|Date|File").alias("value")))
    return readers.pipe_index(lines).select("cik", "form", "filed")


_BLOCK = """concat(chr(10), '<TYPE>', kind, chr(10), '<FILENAME>', name, chr(10), '<TEXT>', body, '</TEXT>', chr(10))"""
#: A PDF of one page in its encoded form: what its text objects show.
_SHOWN = "A printed loss than (never) seen"
_DOCS = """d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, position, kind, name, body, said FROM (SELECT doc_id, t, replace(replace(t, '&', '&amp;'), '<', '&lt;') AS e FROM d),
 LATERAL (VALUES (0, '10-K', 'main.htm', concat('<p>', e, '</p>'), t), (1, 'EX-99.1', 'note.txt', concat('x <b>loss</b> ', CAST(doc_id AS VARCHAR)), concat('x loss ', doc_id)), (2, 'EX-101', 'logo.jpg', 'zz', NULL), (3, 'EX-13', 'a.pdf', 'no', NULL), (5, 'EX-14', 'b.pdf', '{pdf}', '{shown}')) v(position, kind, name, body, said)),
s AS (SELECT *, trim(regexp_replace(said, '\\s+', ' ', 'g')) AS plain FROM b)"""


def _encoded_pdf() -> str:
    """A small PDF file, uuencoded."""
    import binascii
    import zlib

    page = zlib.compress(b"BT /F1 12 Tf 72 712 Td [(A printed ) -20 (lo) 3 (ss)] TJ (than \\(never\\)) Tj <7365656E> Tj ET")
    data = b"%PDF-1.4\n4 0 obj\n<< /Filter /FlateDecode /Length " + str(len(page)).encode() + b" >>\nstream\n" + page + b"\nendstream\nendobj\n%%EOF\n"
    lines = [binascii.b2a_uu(data[i : i + 45]).decode().rstrip("\n") for i in range(0, len(data), 45)]
    return "\n".join(["", "<PDF>", "begin 644 b.pdf", *lines, "`", "end", "</PDF>", ""])


@query(f"""WITH {_DOCS.replace("{pdf}", _encoded_pdf().replace("'", "''")).replace("{shown}", _SHOWN)} SELECT CAST(doc_id AS VARCHAR) AS key, CAST(position AS INTEGER) AS position, kind AS type, name AS filename, sha256({_BLOCK}) AS content_sha256,
 CASE WHEN position = 0 THEN 'primary_report' ELSE 'exhibit' END AS scope, CASE position WHEN 2 THEN 'unsupported_format_requires_review' WHEN 3 THEN 'unreadable_text_requires_review' ELSE 'screened' END AS status,
 CAST(len(regexp_extract_all(said, '(?i)loss|th[ae]')) AS INTEGER) AS keyword_matches,
 CASE WHEN regexp_matches(plain, '(?i)loss|th[ae]') THEN substring(plain, greatest(length(regexp_extract(plain, '(?is)^(.*?)(loss|th[ae])', 1)) - 250, 0) + 1, least(length(regexp_extract(plain, '(?is)^(.*?)(loss|th[ae])', 1)), 250) + length(regexp_extract(plain, '(?i)loss|th[ae]')) + 450) END AS first_excerpt FROM s""")
def scan_sgml(spark, sf_dir):
    """A submission for each document: a report, a text exhibit, a picture, a PDF that cannot be read, a cover that is left out, and a PDF."""
    e = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    block = lambda kind, name, body: F.concat(F.lit(f"<DOCUMENT>\n<TYPE>{kind}\n<FILENAME>{name}\n<TEXT>"), body, F.lit("</TEXT>\n</DOCUMENT>\n"))  # noqa: E731
    parts = [block("10-K", "main.htm", F.concat(F.lit("<p>"), e, F.lit("</p>"))), block("EX-99.1", "note.txt", F.concat(F.lit("x <b>loss</b> "), F.col("doc_id").cast("string"))), block("EX-101", "logo.jpg", F.lit("zz")), block("EX-13", "a.pdf", F.lit("no")), block("COVER", "c.htm", F.lit("loss")), block("EX-14", "b.pdf", F.lit(_encoded_pdf()))]
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("raw"))
    told = filings.screen_submissions(d, key="doc_id", raw="raw", forms=["10-K", "10-Q"], terms="loss|th[ae]")
    return told.select("*", F.get("excerpts", F.lit(0)).alias("first_excerpt")).drop("excerpts")


_TX = f"""WITH {ORDERS}, t AS (SELECT lpad(CAST(cik AS VARCHAR), 10, '0') AS cik, CAST(row_number() OVER (PARTITION BY cik ORDER BY accession) - 1 AS INTEGER) AS transaction_index, CAST(filed AS VARCHAR) AS transaction_date,
 CASE status WHEN 'F' THEN 'P' WHEN 'O' THEN 'S' ELSE 'A' END AS transaction_code, CASE WHEN accession % 5 > 0 THEN CAST(accession AS DOUBLE) END AS shares, CASE WHEN accession % 3 > 0 THEN CAST(cents AS DOUBLE) END AS price_per_share, 'D' AS acquired_disposed FROM o)"""


def _ownership(spark, sf_dir):
    """A document for each company, a transaction for each of its orders; some lack the price, some the shares."""
    x = lambda tag, value: F.concat(F.lit(f"<x:{tag}>"), value, F.lit(f"</x:{tag}>"))  # noqa: E731
    given = lambda tag, value, when: F.when(when, x(tag, x("value", value))).otherwise("")  # noqa: E731
    code = F.when(F.col("status") == "F", "P").when(F.col("status") == "O", "S").otherwise("A")
    amounts = F.concat(given("transactionShares", F.col("accession").cast("string"), F.col("accession") % 5 > 0), given("transactionPricePerShare", F.col("cents").cast("string"), F.col("accession") % 3 > 0), x("transactionAcquiredDisposedCode", x("value", F.lit("D"))))
    tx = x("nonDerivativeTransaction", F.concat(x("transactionDate", x("value", F.concat(F.lit(" "), F.col("filed").cast("string")))), x("transactionCoding", x("transactionCode", code)), x("transactionAmounts", amounts)))
    docs = orders(spark, sf_dir).groupBy("cik").agg(F.transform(F.array_sort(F.collect_list(F.struct("accession", tx.alias("x")))), lambda r: r["x"]).alias("all"))
    owner = F.concat(x("reportingOwnerId", F.concat(x("rptOwnerCik", F.lit("77")), x("rptOwnerName", F.lit("Ann Example")))), x("reportingOwnerRelationship", F.concat(x("isDirector", (F.col("cik") % 2).cast("string")), x("officerTitle", F.lit("Clerk")))))
    body = F.concat(x("issuer", x("issuerCik", F.col("cik").cast("string"))), x("reportingOwner", owner), F.array_join("all", ""))
    return docs.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), F.concat(F.lit('<x:ownershipDocument xmlns:x="urn:y">'), body, F.lit("</x:ownershipDocument>")).alias("xml"))


@query(f"{_TX} SELECT *, CASE transaction_code WHEN 'P' THEN 'purchase' WHEN 'S' THEN 'sale' ELSE 'other' END AS purchase_sale_signal FROM t")
def scan_xml_tx(spark, sf_dir):
    return filings.ownership_transactions(_ownership(spark, sf_dir), "xml", ["cik"], issuer="cik").drop("security_title")


@query(f"{_TX} SELECT cik, '77' AS owner_cik, 'Ann Example' AS owner_name, CAST(cik AS BIGINT) % 2 = 1 AS is_director, false AS is_officer, 'Clerk' AS officer_title, false AS is_ten_percent_owner, transaction_index, transaction_date, transaction_code, coalesce(shares, 0) AS shares, coalesce(price_per_share, 0) AS price_per_share, acquired_disposed FROM t")
def scan_xml_form4(spark, sf_dir):
    """With the owner, and with missing numbers as zero."""
    return filings.ownership_documents(_ownership(spark, sf_dir), "xml", ["cik"]).drop("security_title")


def _archives(rows, members):
    """(path, content): a ZIP for each value of ``path``; members: file name, which may have {path} in it -> (column of its lines, head line)."""

    def pack(pdf):
        import io
        import zipfile

        import pandas as pd

        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, (column, head) in members.items():
                lines = [head, *sorted(x for part in pdf[column] if part is not None for x in part)]
                z.writestr(name.format(path=pdf["path"].iloc[0]), "\n".join(lines).encode("cp1252") + b"\n")
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [data.getvalue()]})

    return rows.groupBy("path").applyInPandas(pack, "path string, content binary")


@query("SELECT CAST(c_custkey AS DOUBLE) AS k, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS r FROM customer")
def scan_arff(spark, sf_dir):
    """Archives of five thousand customers with one data file each; a missing number is a question mark."""
    c = table(spark, sf_dir, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal").cast("string")).otherwise("?"))
    files = _archives(c.select(F.floor(F.col("c_custkey") / 5000).cast("string").alias("path"), F.array(line).alias("lines")), {"year{path}.arff": ("lines", "@relation x\n@attribute k numeric\n@data"), "note.txt": ("lines", "")})
    return readers.arff_rows(filings.archive_lines(files, ".arff"), ["k", "r"])


@query(f"""WITH {ORDERS}, f AS (SELECT *, 1 + accession % 4 AS q FROM o WHERE status <> 'P')
SELECT lpad(CAST(cik AS VARCHAR), 10, '0') AS cik, concat('a', accession) AS adsh, tag, CAST(CASE tag WHEN 'Assets' THEN cents ELSE cents - 5 END AS DOUBLE) AS value, filed + 40 AS filing_date, filed AS fiscal_period_end, '2020' AS fy,
 CASE WHEN q = 4 THEN 'FY' ELSE concat('Q', q) END AS fp, concat(year(filed), 'Q', quarter(filed)) AS fiscal_quarter FROM f, (VALUES ('Assets'), ('Cash')) t(tag)""")
def scan_tsv_zip(spark, sf_dir):
    """An archive for each five thousand accessions, with both tables; of six facts for each filing two are left."""
    o = orders(spark, sf_dir)
    text = lambda d: F.date_format(d, "yyyyMMdd")  # noqa: E731
    a, end, cents, q = F.concat(F.lit("a"), F.col("accession").cast("string")), text("filed"), F.col("cents"), 1 + F.col("accession") % 4
    fp, form = F.when(q == 4, "FY").otherwise(F.concat(F.lit("Q"), q.cast("string"))), F.when(F.col("status") == "P", "8-K").otherwise("10-Q")
    line = lambda *c: F.concat_ws("\t", *[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in c])  # noqa: E731
    sub = F.array(line(a, F.col("cik"), "a name", text(F.date_add("filed", 40)), end, "2020", fp, form))
    num = F.array(
        line(a, "Assets", "us-gaap/2020", cents, end, "0", "USD", "", ""), line(a, "Cash", "us-gaap/2020", cents - 5, end, q, "USD", "", ""), line(a, "Assets", "us-gaap/2020", cents, end, "0", "EUR", "", ""),
        line(a, "Assets", "custom/1", cents, end, "0", "USD", "", ""), line(a, "Cash", "us-gaap/2020", cents, text(F.date_sub("filed", 90)), "0", "USD", "", ""), line(a, "Other", "us-gaap/2020", cents, end, "0", "USD", "", ""),
    )  # fmt: skip
    rows = o.select(F.concat(F.lit("z"), F.floor(F.col("accession") / 5000).cast("string")).alias("path"), sub.alias("sub"), num.alias("num"))
    files = _archives(rows, {"sub.txt": ("sub", "adsh\tcik\tname\tfiled\tperiod\tfy\tfp\tform"), "num.txt": ("num", "adsh\ttag\tversion\tvalue\tddate\tqtrs\tuom\tcoreg\tsegments")})
    return filings.archive_facts(written(files, "archives"), tags=["Assets", "Cash"])  # made once, for both members


@query(f"WITH {ORDERS} SELECT concat('Caf', chr(233), ' ', cik) AS \"NameCorp\", CAST(accession AS VARCHAR) AS \"PrimaryKey\", filed AS \"DateFiled\", concat('set_1-12-2023_', accession // 5000, '.csv') AS member FROM o")
def scan_csv_in_zip_checked(spark, sf_dir):
    """Releases in cp1252 with exactly one CSV each; keys are unique over all of them."""
    o = orders(spark, sf_dir)
    bucket = F.floor(F.col("accession") / 5000).cast("string")
    line = F.concat_ws(",", F.concat(F.lit("Café "), F.col("cik").cast("string")), F.col("accession").cast("string"), F.date_format("filed", "MM/dd/yyyy"))
    files = _archives(o.select(bucket.alias("path"), F.array(line).alias("lines")), {"set_1-12-2023_{path}.csv": ("lines", "NameCorp,PrimaryKey,DateFiled"), "readme.txt": ("lines", "")})
    return filings.checked_release(files, release="1-12-2023", columns=["NameCorp"], key="PrimaryKey", day="DateFiled", until="2023-12-01").drop("member_sha256")


@query(f"""WITH {ORDERS}, p AS (SELECT CAST(cik AS VARCHAR) AS key, concat('T', accession) AS t, filed, accession % 3 AS m FROM o)
SELECT key, t AS ticker, filed AS added_date, NULL::DATE AS removed_date, NULL::VARCHAR AS removal_reason FROM p WHERE m <> 1
UNION ALL SELECT key, concat('X', t), NULL, filed, CASE m WHEN 0 THEN 'merged' ELSE 'unknown' END FROM p WHERE m <> 2""")
def scan_html_table(spark, sf_dir):
    """A page for each company: a table of no interest, and one of changes with two head rows."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))  # noqa: E731
    t, m = F.concat(F.lit("t"), F.col("accession").cast("string")), F.col("accession") % 3
    row = F.concat(F.lit("<tr>"), cell(F.date_format("filed", "MMMM d, yyyy")), cell(F.when(m != 1, t).otherwise("")), cell(F.lit("A &amp; B")), cell(F.when(m != 2, F.concat(F.lit("x"), t)).otherwise("")), cell(F.lit("")), cell(F.when(m == 0, "merged").otherwise("")), F.lit("</tr>"))
    head = '<table><tr><td>1</td></tr></table><table><tr><th rowspan="2">Date</th><th colspan="2">Added</th><th colspan="2">Removed</th><th rowspan="2">Reason</th></tr><tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr>'
    pages = orders(spark, sf_dir).groupBy("cik").agg(F.concat(F.lit(head), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    return filings.membership_table(pages, key="cik", html="html")


@query(f"""WITH {ORDERS} SELECT CAST(cik AS VARCHAR) AS key, concat('a:F', accession % 3) AS name, concat('c', accession) AS context, CASE accession % 2 WHEN 1 THEN -1 ELSE 1 END * CAST(accession * 1234 * 1000 AS DOUBLE) AS value, 'usd' AS unit,
 accession % 5 = 0 AS dimensional, CASE WHEN accession % 3 = 0 THEN CAST(filed AS VARCHAR) END AS instant, CASE WHEN accession % 3 > 0 THEN CAST(filed - 90 AS VARCHAR) END AS start, CASE WHEN accession % 3 > 0 THEN CAST(filed AS VARCHAR) END AS "end" FROM o WHERE accession % 7 > 0 AND accession % 11 > 0""")
def scan_inline_facts(spark, sf_dir):
    """A page for each company: contexts, some with dimensions, and numbers, some in other formats or continued."""
    a = F.col("accession")
    day_ = lambda tag, d: F.concat(F.lit(f"<xbrli:{tag}>"), d.cast("string"), F.lit(f"</xbrli:{tag}>"))  # noqa: E731
    dates = F.when(a % 3 == 0, day_("instant", F.col("filed"))).otherwise(F.concat(day_("startDate", F.date_sub("filed", 90)), day_("endDate", F.col("filed"))))
    context = F.concat(F.lit('<xbrli:context id="c'), a.cast("string"), F.lit('">'), F.when(a % 5 == 0, '<xbrldi:explicitMember dimension="d">m</xbrldi:explicitMember>').otherwise(""), dates, F.lit("</xbrli:context>"))
    extra = F.when(a % 2 == 1, ' sign="-"').otherwise("")
    extra = F.concat(extra, F.when(a % 7 == 0, ' format="ixt:num-comma-decimal"').when(a % 11 == 0, ' continuedAt="x"').otherwise(' format="ixt:num-dot-decimal"'))
    number = F.format_number(a * 1234, 0)
    fact = F.concat(F.lit('<ix:nonFraction unitRef="usd" scale="3" name="a:F'), (a % 3).cast("string"), F.lit('" contextRef="c'), a.cast("string"), F.lit('"'), extra, F.lit("><span>"), number, F.lit("</span></ix:nonFraction>"))
    pages = orders(spark, sf_dir).groupBy("cik").agg(F.concat(F.array_join(F.collect_list(fact), " "), F.array_join(F.collect_list(context), "")).alias("html"))
    return filings.inline_facts(pages, key="cik", html="html")


@query("""WITH p AS (SELECT CAST(o_orderkey // 100 AS INTEGER) AS page, count(*) AS n, bool_or(o_orderkey % 997 = 0) AS stray FROM orders GROUP BY 1), t AS (SELECT count(*) AS total, max(o_orderkey // 100) + 1 AS pages FROM orders), z AS (SELECT count(*) AS n_pages FROM p)
SELECT page, CAST(n + CASE WHEN stray THEN 1 ELSE 0 END AS INTEGER) AS n, CASE WHEN page = 3 THEN false ELSE true END AND (SELECT count(*) = 0 FROM p WHERE page = 4) AS stable, NOT stray AS no_duplicates,
 n + CASE WHEN stray THEN 1 ELSE 0 END = least(100, greatest(total, total + CASE WHEN EXISTS (FROM p WHERE page = 4) THEN 1 ELSE 0 END) - page * 100) AS "full", n_pages = ceil((total + CASE WHEN EXISTS (FROM p WHERE page = 4) THEN 1 ELSE 0 END) / 100) AS complete FROM p, t, z""")
def scan_search_pages(spark, sf_dir):
    """Pages of a hundred orders, with faults: an estimated total, another total, and ids that stand on a page twice."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 100).cast("int").alias("page"))
    total = o.agg(F.count("*").alias("total"))
    again = o.where("o_orderkey % 997 = 0").groupBy("page").agg(F.min("o_orderkey").alias("o_orderkey"))
    pages = o.unionByName(again).groupBy("page").agg(F.collect_list("o_orderkey").alias("ids")).join(F.broadcast(total))
    pages = pages.withColumn("total", F.col("total") + (F.col("page") == 4).cast("int")).withColumn("relation", F.when(F.col("page") == 3, "gte").otherwise("eq"))
    return readers.page_checks(pages, page="page", size=100)


@query(f"""WITH {ORDERS} SELECT accession, CASE WHEN accession % 2 = 0 THEN 'local' WHEN accession % 3 = 0 THEN 'shared' WHEN status <> 'P' THEN 'origin' END AS layer,
 CASE WHEN accession % 2 = 0 THEN cents WHEN accession % 3 = 0 THEN cents + 1 WHEN status <> 'P' THEN cents + 2 END AS cents FROM o""")
def src_cache(spark, sf_dir):
    """What each of three layers holds, asked in order; a key that none has stays without a layer."""
    o = orders(spark, sf_dir).select("accession", "cents", "status")
    layers = {"local": o.where("accession % 2 = 0"), "shared": o.where("accession % 3 = 0").withColumn("cents", F.col("cents") + 1), "origin": o.where("status <> 'P'").withColumn("cents", F.col("cents") + 2)}
    return origin.restored(o, layers, key="accession", value="cents")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'en' ORDER BY doc_id LIMIT 2000")
def scan_sqlite(spark, sf_dir):
    """The bounded scan of passage stores: filtered in each store, then the first 2,000 in order, as a feature."""

    def pack(pdf):
        import sqlite3

        import pandas as pd

        con = sqlite3.connect(":memory:")
        con.execute("CREATE TABLE passages (doc_id INTEGER PRIMARY KEY, lang TEXT, n_chars INTEGER)")
        con.executemany("INSERT INTO passages VALUES (?, ?, ?)", zip(pdf["doc_id"].tolist(), pdf["lang"].tolist(), pdf["n_chars"].tolist(), strict=True))
        con.commit()
        data = con.serialize()
        con.close()
        return pd.DataFrame({"path": [str(pdf["path"].iloc[0])], "content": [data]})

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.floor(F.col("doc_id") / 500).cast("string").alias("path"))
    files = d.groupBy("path").applyInPandas(pack, "path string, content binary")
    rows = filings.sqlite_rows(files, "SELECT doc_id, lang, n_chars FROM passages WHERE lang <> 'en'", "doc_id long, lang string, n_chars long")
    return rows.orderBy("doc_id").limit(2000)


@query("SELECT s_suppkey, s_name FROM supplier")
def sink_csv(spark, sf_dir):
    return sinks.write_new(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), _folder(spark), "csv")


@query("SELECT s_suppkey, s_name FROM supplier")
def sink_json(spark, sf_dir):
    return sinks.write_new(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), _folder(spark), "json")


@query("SELECT c_custkey, c_custkey % 2 AS batch FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 1")
def sink_append_new(spark, sf_dir):
    """Appended rows whose key is there already are left out."""
    path = _folder(spark)
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 2).alias("batch"))
    c.where("c_custkey % 2 = 0").write.parquet(path)
    sinks.append_new(c.where("c_custkey % 2 = 0 OR c_custkey % 3 = 1"), path, ["c_custkey"])
    return spark.read.parquet(path)


@query("SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term HAVING count(*) > 20")
def sink_index(spark, sf_dir):
    from chronofold.operators.retrieval import build_index

    postings = build_index(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), key="doc_id", text="text", source="source")[0]
    return sinks.write_new(postings, _folder(spark)).groupBy("term").agg(F.count("*").alias("df")).where("df > 20")


@query("SELECT md5(concat(user_id, '_', event_type)) AS id, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id, event_type")
def sink_vectors(spark, sf_dir):
    """Upsert by a deterministic id: the last row of an id stays."""
    from chronofold.functions.scalar import md5_id

    e = table(spark, sf_dir, "events").select(md5_id(F.col("user_id"), F.col("event_type")).alias("id"), "event_id")
    return sinks.latest_by_id(e, "id", "event_id")


@query("SELECT c_custkey, c_mktsegment AS role, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal END AS target FROM customer")
def sink_export_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("role"), F.col("c_acctbal").alias("target"))
    return sinks.export_roles(c, _folder(spark), role="role", target="target", closed="MACHINERY").select("c_custkey", F.col("role").cast("string").alias("role"), "target")


@query(f"""WITH {ORDERS}, l AS (SELECT cik, last_day(filed) AS period, arg_max(cents, (filed, accession)) AS cents FROM o GROUP BY ALL)
SELECT cik, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY period DESC) AS r FROM l) WHERE r <= 12 GROUP BY cik""")
def sink_frontend(spark, sf_dir):
    from chronofold.operators.sampling import head_per_group

    latest = orders(spark, sf_dir).groupBy("cik", F.last_day("filed").alias("period")).agg(F.max_by("cents", F.struct("filed", "accession")).alias("cents"))
    return head_per_group(latest, ["cik"], [F.desc("period")], 12).groupBy("cik").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("SELECT n_nationkey, n_name FROM nation")
def sink_snapshot(spark, sf_dir):
    root = _folder(spark)
    sinks.publish(spark, table(spark, sf_dir, "region"), root)
    sinks.publish(spark, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), root)
    return sinks.current(spark, root)


@query("SELECT true AS equal, false AS other_equal")
def backup_compare(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    copy = sinks.write_new(n, _folder(spark))
    return spark.range(1).select(F.lit(sinks.same_rows(n, copy)).alias("equal"), F.lit(sinks.same_rows(n, copy.where("n_nationkey > 3"))).alias("other_equal"))


@query("SELECT concat('| r_regionkey | r_name |', chr(10), '|---|---|', chr(10), string_agg(concat('| ', r_regionkey, ' | ', r_name, ' |'), chr(10) ORDER BY r_regionkey)) AS report FROM region")
def sink_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    return spark.createDataFrame([(sinks.markdown(rows, ["r_regionkey", "r_name"]),)], "report string")


def _written_by_tasks(spark, rows, by: str, name: str, pack):
    """A folder of files, one for each value of ``by``, written by tasks: ``pack`` gives a file's name and bytes."""
    folder = fresh_folder(spark, name)

    def put(key, pdf):
        import pandas as pd

        from chronofold.staging import arrow_file

        store, path = arrow_file(folder)
        store.create_dir(path, recursive=True)
        file, data = pack(key[0], pdf)
        with store.open_output_stream(f"{path}/{file}") as out:
            out.write(data)
        return pd.DataFrame({"file": [file]})

    rows.groupBy(by).applyInPandas(put, "file string").write.format("noop").mode("overwrite").save()
    return folder


@query("SELECT CAST(o_orderkey // 100 AS INTEGER) AS page, (SELECT count(*) FROM orders) AS total, count(*) AS n, CAST(min(o_orderkey) AS VARCHAR) AS first_id, count(*) = least(100, (SELECT count(*) FROM orders) - o_orderkey // 100 * 100) AS \"full\" FROM orders GROUP BY o_orderkey // 100")
def scan_paged_search(spark, sf_dir):
    """Pages of a hundred orders, read page by page through the data source from a folder in which each page is a file."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 100).cast("int").alias("page"))
    total = o.agg(F.count("*").alias("total"))

    def pack(page, pdf):
        import json

        return f"{page}.json", json.dumps({"total": int(pdf["total"].iloc[0]), "ids": sorted(pdf["o_orderkey"].tolist())}).encode()

    folder = _written_by_tasks(spark, o.join(F.broadcast(total)), "page", "search", pack)
    spark.dataSource.register(PagedSearch)
    pages = spark.read.format("paged_search").option("url", folder + "/{page}.json").option("size", 100).load()
    return pages.select("page", "total", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("first_id"), (F.size("ids") == F.least(F.lit(100), F.col("total") - F.col("page") * 100)).alias("full"))


@query(f"WITH {ORDERS} SELECT concat('year', accession // 5000, '.zip') AS archive, concat(form, '.txt') AS member, CAST(row_number() OVER (PARTITION BY accession // 5000, form ORDER BY accession) - 1 AS BIGINT) AS number, concat(accession, '|', cents) AS line FROM o")
def scan_zip_members(spark, sf_dir):
    """Archives of five thousand filings with a member for each form: each member is read by a task of its own."""
    rows = orders(spark, sf_dir).select(F.floor(F.col("accession") / 5000).alias("year"), "accession", "form", F.concat_ws("|", "accession", "cents").alias("line"))

    def pack(year, pdf):
        import io
        import zipfile

        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for form, part in pdf.sort_values("accession").groupby("form"):
                z.writestr(f"{form}.txt", "\n".join(part["line"]) + "\n")
        return f"year{year}.zip", data.getvalue()

    folder = _written_by_tasks(spark, rows, "year", "archives", pack)
    spark.dataSource.register(ZipLines)
    lines = spark.read.format("zip_lines").option("path", folder).option("members", "*.txt").load()
    return lines.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "member", "number", "line")


def _with_functions(spark, df, name):
    generators.register_all(spark)
    df.createOrReplaceTempView(name)


@query(f"WITH {ORDERS} SELECT CAST(cik AS VARCHAR) AS file, CAST(cik AS VARCHAR) AS cik, concat('Company ', cik) AS company, form, CAST(filed AS VARCHAR) AS filed, concat('a/', accession, '.txt') AS path FROM o")
def gen_index_lines(spark, sf_dir):
    """An index for each company, as lines: a head, a rule of dashes, entries, and a line that is none; read by a table function."""
    o = orders(spark, sf_dir)
    entry = F.concat_ws("|", "cik", F.concat(F.lit("Company "), "cik"), "form", "filed", F.concat(F.lit("a/"), "accession", F.lit(".txt")))
    lines = o.select(F.col("cik").cast("string").alias("file_id"), F.col("accession").alias("number"), entry.alias("line"))
    extra = F.explode(F.array(F.struct(F.lit(-3).alias("n"), F.lit("0|x|10-K|2020-01-01|head").alias("l")), F.struct(F.lit(-2).alias("n"), F.lit("-----").alias("l")), F.struct(F.lit(-1).alias("n"), F.lit("no entry").alias("l"))))
    heads = o.select("cik").distinct().select(F.col("cik").cast("string").alias("file_id"), extra.alias("e")).select("file_id", F.col("e.n").cast("long").alias("number"), F.col("e.l").alias("line"))
    _with_functions(spark, lines.unionByName(heads), "index_input")
    return spark.sql("SELECT cik AS file, cik, company, form, filed, file AS path FROM index_lines(TABLE(index_input) PARTITION BY file_id ORDER BY number)")


@query("""SELECT CAST(conv_id AS VARCHAR) AS accession, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS place, role AS type, concat(turn, '.txt') AS filename,
 CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, sha256(concat(text, chr(10))) AS sha256 FROM conversations""")
def gen_submissions(spark, sf_dir):
    """Conversations as submissions, line by line, a document for each turn; its name ends in the turn and begins with the accession."""
    c = table(spark, sf_dir, "conversations")
    head = F.array(F.lit("<DOCUMENT>"), F.concat(F.lit("<TYPE>"), "role"), F.concat(F.lit("<FILENAME>"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt")), F.lit("<TEXT>"))
    lines = c.select("conv_id", "turn", F.posexplode(F.concat(head, F.split("text", "\n", -1), F.array(F.lit("</TEXT>"), F.lit("</DOCUMENT>")))).alias("i", "line"))
    _with_functions(spark, lines.select("conv_id", F.struct("turn", "i").alias("number"), "line"), "submission_input")
    told = spark.sql("SELECT * FROM submission_parts(TABLE(submission_input) PARTITION BY conv_id ORDER BY number)")
    return told.select(F.split("filename", "/")[0].alias("accession"), "place", "type", F.split("filename", "/")[1].alias("filename"), "n_lines", "sha256")


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
w AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^ 	

]+')) AS n FROM l),
d AS (SELECT doc_id, list(i ORDER BY i) AS ids, list(line ORDER BY i) AS ls, list(c ORDER BY i) AS cum FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM w WHERE n > 0) GROUP BY doc_id),
r(doc_id, k, s, e) AS (
 SELECT doc_id, 0, 1, coalesce(list_max(list_filter(range(1, len(ids) + 1), lambda i: cum[i] <= 500)), 1) FROM d
 UNION ALL SELECT d.doc_id, k + 1, e + 1, coalesce(list_max(list_filter(range(e + 1, len(ids) + 1), lambda i: cum[i] - cum[e] <= 500)), e + 1) FROM r JOIN d USING (doc_id) WHERE e < len(ids))
SELECT CAST(k AS INTEGER) AS chunk, ids[s] AS "first", ids[e] AS "last", CAST(cum[e] - CASE WHEN s > 1 THEN cum[s - 1] ELSE 0 END AS INTEGER) AS n_words, array_to_string(ls[s:e], ' ') AS text FROM r JOIN d USING (doc_id)""")
def gen_chunks(spark, sf_dir):
    """Lines of documents packed into chunks of at most 500 words by a table function."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "sentence"))
    _with_functions(spark, d.select("doc_id", F.col("i").cast("long").alias("number"), "sentence"), "chunk_input")
    return spark.sql("SELECT chunk, first, last, n_words, text FROM sentence_chunks(TABLE(chunk_input) PARTITION BY doc_id ORDER BY (number), 500)")
