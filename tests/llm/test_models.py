"""Quality rules, personal data, language identification, unigram coding, and the pipeline."""

import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronofold.llm import langid, pii, quality, unigram
from tests.llm.test_dedup import words_of


#: Arithmetic that overflows or divides by zero is a fault, not a note.
pytestmark = pytest.mark.filterwarnings("error::RuntimeWarning")


def brute_stats(t):
    t = t or ""
    w = words_of(t)
    seen: dict = {}
    for p in range(len(w) - 4):
        seen.setdefault(tuple(w[p : p + 5]), []).append(p)
    covered = {p + k for places in seen.values() if len(places) > 1 for p in places for k in range(5)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark, frame):
    texts = [None, "", " \n", "a b c d e a b c d e f", "x\nx\n y\nx", "#a *b\t$c|<>", "é" * 30, "w " * 400, "p q r s t u p q r s t p q r s t", "a\x0bb\x0cc\rd", "one\n\n\none"]
    rng = random.Random(0)
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    got = quality.statistics(frame(list(enumerate(texts)))).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(texts[r.doc_id]), texts[r.doc_id]


def test_binomial_tail(spark):
    cases = [(0, 50, 0.01), (3, 400, 0.02), (120, 20_000, 0.008), (5, 5, 0.5), (0, 0, 0.1)]
    for k, n, rate in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), rate)).first()[0]
        want = 1.0 if n == 0 or k >= n * rate else sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(rate) + (n - j) * math.log1p(-rate)) for j in range(k + 1))
        assert got == pytest.approx(want, rel=1e-8)


def test_certified_cutoffs(spark, frame):
    """Enough good documents prove a cutoff; too few prove none, and nothing is rejected there."""
    docs = [(i, "plain words in a line of some length here ok") for i in range(6000)]
    docs += [(10_000 + i, "#### $$$$ words with very many %%%% symbols &&&& in it") for i in range(20)]
    df = frame(docs).withColumn("lang", F.lit("en")).unionByName(frame([(20_000 + i, t) for i, (_, t) in enumerate(docs[-20:])]).withColumn("lang", F.lit("xx")))
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    kept = {r.doc_id: r.kept for r in quality.judge(df, labels).collect()}
    assert not any(kept[10_000 + i] for i in range(20)) and sum(not kept[i] for i in range(6000)) == sum(not kept[0] for _ in range(6000))
    few = {r.doc_id: r.kept for r in quality.judge(df, labels.where("doc_id < 100"), quality.Risk(rate=0.02)).collect()}
    assert all(few[10_000 + i] == (len(docs[-1][1].split()) >= 10) for i in range(20))
    assert quality.judge(frame([]), labels).count() == 0 and quality.judge(frame([(None, None), (1, "a")]), labels.limit(0)).count() == 2


def brute_emails(text):
    return [m.span() for m in re.finditer(pii._EMAIL.pattern, text)]


def brute_spans(text):
    """The four base patterns as plain regular expressions."""
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        doubled = [x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], ["email", "ip", "card", "phone"].index(s[2])))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(17)
    alphabets = ["0123456789.", "01 -", "+0123456789() .-", "ab1@.-_%+", "0123456789.+-@ ()aZ_%\u00b2\u0661 \u00e9"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(70))) for a in alphabets for _ in range(1500)]
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "0" * 14, "0" * 20]
    texts += [rng.choice(cards) + rng.choice(["", " ", "-", "1", ".1.1.1", "@x.y"]) + rng.choice(cards) for _ in range(300)]
    texts += ["0" * 4000 + ".1.1.1", "1.2.3." + "0" * 4000 + "7", "1.1.1.1" * 40]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


def test_long_and_odd_digit_runs(spark, frame):
    """Neither crash nor take time that grows with the square of a run."""
    field = pii.fit([])
    texts = ["9" * 5000 + ".1.1.1", "0" * 5000 + ".1.1.1", "1.2.3.\u00b2", "\u0661.\u0662.\u0663.\u0664", "7" * 2_000_000, "1." * 300_000, "+1" * 200_000, "a@" * 200_000, "@" * 300_000]
    began = time.perf_counter()
    for t in texts[:7]:
        pii.spans(t, field)
    for t in texts[7:]:
        assert pii.base_spans(t) == []
    assert time.perf_counter() - began < 60
    rows = [(i, t) for i, t in enumerate(texts[:4])]
    out = {r.doc_id: r for r in pii.find_spans(frame(rows).selectExpr("*", "1 AS spans", "2 AS n_ip", "3 AS field"), field).collect()}
    assert [out[i].n_ip for i in range(4)] == [0, 1, 0, 0]


def test_base_patterns():
    texts = ["a@b.c", "x@@y.z @a.b a.b@c", "a@b a@b.c@d.e", "über.x@mail.example.com.", "..@-.-", "a@b.c,d@e.f", "@", "w" * 50 + "@x.y", "p@q.r@s.t"]
    for t in texts:
        assert [(s, e) for s, e, k in pii.base_spans(t) if k == "email"] == brute_emails(t), t
    assert pii.base_spans("10.0.0.1 and 999.1.1.1 and 1.2.3.4.5.6.7.8")[0] == (0, 8, "ip")
    assert [k for *_, k in pii.base_spans("4111 1111 1111 1111 or 4111 1111 1111 1112")] == ["card"]
    assert [k for *_, k in pii.base_spans("+1 (487) 555-7209 and +12")] == ["phone"]
    assert pii.joined(pii.base_spans("é a@b.co")) == "email:2:8"


def test_skip_chain_marks_repeats(spark, frame):
    rng = random.Random(3)
    hexa = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f"some words here token = \"{hexa()}\" and year 1999 then 12 items mail{i}@example.com end" for i in range(120)]
    field = pii.fit(texts)
    secret = hexa()
    text = f"first token = \"{secret}\" then plain words for a while and 42 things, later again {secret} alone"
    found = pii.spans(text, field)[1]
    assert [text[s:e] for s, e, k in found if k == "secret"] == [secret, secret]
    assert not [s for s in found if text[s[0] : s[1]] == "42"]
    assert pii.masked("a x@y.zz b", pii.base_spans("a x@y.zz b")) == "a <EMAIL> b"
    nothing = pii.fit([])
    assert pii.spans(text, nothing) == ([], [])
    rows = [(1, None), (2, ""), (None, "q@r.st"), (2, "no data")]
    out = pii.find_spans(frame(rows), field).collect()
    assert len(out) == 4 and sum(r.n_email for r in out) == 1 and {r.base_sha256 for r in out if r.doc_id is not None} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_spans(frame([]), field).count() == 0


def test_belief_propagation_is_exact_on_a_chain():
    """Without loops the messages give the true marginals."""
    field = pii.Field({}, np.zeros((0, 6)), np.random.default_rng(0).normal(size=(6, 6)), np.zeros((6, 6)))
    nodes = [pii.Node(10 * i, 10 * i + 3, f"{i}{i}{i}", "", "", 0) for i in range(3)]
    unary = np.random.default_rng(1).normal(size=(3, 6))
    field.unary = lambda _: unary.copy()
    got = pii.marginals(field, nodes, rounds=60, damping=0.0)
    want = np.zeros((3, 6))
    for y in itertools.product(range(6), repeat=3):
        w = math.exp(sum(unary[i, y[i]] for i in range(3)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]])
        for i in range(3):
            want[i, y[i]] += w
    assert got == pytest.approx(want / want.sum(axis=1, keepdims=True), abs=1e-6)


def test_language(spark, frame):
    rng = random.Random(1)
    words = {"aa": ["the", "and", "house", "with"], "bb": ["und", "der", "haus", "mit"], "cc": ["que", "casa", "con", "los"]}
    text = lambda l, n: " ".join(rng.choice(words[l]) for _ in range(n))
    pairs = [(text(l, rng.randrange(5, 60)), l) for l in words for _ in range(80)]
    model = langid.fit([t for t, _ in pairs], [l for _, l in pairs])
    test = [(i, text("abc"[i % 3] * 2, 30)) for i in range(60)] + [(100, None), (101, ""), (102, "123 !!"), (103, "é")]
    out = {r.doc_id: r for r in langid.predict(frame(test).withColumn("score", F.lit("clash")), model).collect()}
    assert sum(out[i].lang_pred == "abc"[i % 3] * 2 for i in range(60)) >= 59
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and out[i].lang_rejected for i in (100, 101, 102))
    assert out[103].lang_pred in words and all(0 <= r.score <= 1 for r in out.values())
    empty = langid.fit([], [])
    assert [r.lang_pred for r in langid.predict(frame([(1, "words")]), empty).collect()] == ["und"]
    assert langid.training_rows(frame([])) == []


@pytest.mark.parametrize("seed", range(5))
def test_training_stays_finite(seed):
    """Few rows, odd texts and labels without a pattern do not make it diverge."""
    rng = random.Random(seed)
    pairs = [("".join(rng.choice("abcdefgh ") for _ in range(rng.choice([1, 3, 9, 80]))), rng.choice(["x", "y", "z"])) for _ in range(rng.choice([5, 84, 300]))]
    pairs += [("", "x"), ("zz", "y"), ("zzz", "only")]
    model = langid.fit([t for t, _ in pairs], [l for _, l in pairs])
    assert np.isfinite(model.table).all() and np.isfinite(model.bias).all() and np.isfinite(model.least) and model.temperature > 0


def brute_best(u, segment):
    """The best score over all ways to cut a short segment."""
    text, best = segment, {0: 0.0}
    known = {u.pieces.texts[i]: u.scores[i] for i, k in enumerate(u.pieces.kinds) if k in (1, 4)}
    for end in range(1, len(text) + 1):
        options = [best[s] + known[text[s:end]] for s in range(end) if text[s:end] in known and s in best]
        if text[end - 1] not in known:
            options.append(best[end - 1] + u.penalty)
        if options:
            best[end] = max(options)
    return best[len(text)]


def test_unigram():
    u = unigram.unigram(unigram.model_path())
    texts = ["the house", "", None, "a  b", " lead", "trail ", "line\nbreak\n\nx", "日本語 text", "nul\0inside here", "marker ▁ here", "\x85odd　space", "x" * 3000, "ünïcode 😀 ok"]
    ids = u.encode(texts)
    for t, x in zip(texts, ids, strict=True):
        assert u.decode(x) == (t or "").replace("▁", " "), t
    for segment in ("▁house", "▁unbelievable", "▁日本x", "abc", "▁▁a", "▁ünï"):
        got = u.solve(segment)
        score, run = 0.0, []
        for i in got:
            if u.pieces.kinds[i] == unigram.BYTE:
                run.append(int(u.pieces.texts[i][3:5], 16))
                continue
            score += u.scores[i]
        score += u.penalty * len(bytes(run).decode())
        assert score == pytest.approx(brute_best(u, segment))
    small = unigram.DoubleArray([b"a", b"ab", b"b", b"abc"], [0, 1, 2, 3])
    assert list(small.prefixes(b"abcd", 0)) == [(1, 0), (2, 1), (3, 3)] and list(small.prefixes(b"xa", 0)) == []


def test_unigram_documents(spark, frame):
    out = unigram.encode_documents(frame([(1, "a b"), (1, "a b"), (2, None), (None, "c")])).collect()
    assert len(out) == 4 and all(r.round_trip for r in out)
    assert unigram.encode_documents(frame([])).count() == 0


def test_field_on_a_cycle():
    """Loopy messages on a graph with a cycle against all assignments: close, and with the same labels; a long text is no trouble."""
    rng = np.random.default_rng(3)
    skip = rng.normal(size=(6, 6)) * 0.5
    field = pii.Field({}, np.zeros((0, 6)), rng.normal(size=(6, 6)) * 0.5, (skip + skip.T) / 2)
    nodes = [pii.Node(10 * i, 10 * i + 3, t, "", "", f) for i, (t, f) in enumerate((("11111", 0), ("22222", 2), ("33333", 0), ("11111", 0), ("22222", 0)))]
    chain, far = pii.links(nodes)
    assert len(chain) == 4 and {(0, 3), (1, 4)} <= set(far), "chain and skip links close cycles"
    unary = field.unary(nodes)
    exact = np.zeros((5, 6))
    for labels in itertools.product(range(6), repeat=5):
        score = sum(unary[i, y] for i, y in enumerate(labels)) + sum(field.chain[labels[i], labels[j]] for i, j in chain) + sum(field.skip[labels[i], labels[j]] for i, j in far)
        exact[range(5), labels] += np.exp(score)
    exact /= exact.sum(axis=1, keepdims=True)
    got = pii.marginals(field, nodes, rounds=100)
    assert np.abs(got - exact).max() < 0.08 and (got.argmax(axis=1) == exact.argmax(axis=1)).all()
    alone = pii.marginals(field, nodes, rounds=100, skips=False)
    assert np.abs(alone - exact).max() > np.abs(got - exact).max(), "the skip links matter"
    many = [pii.Node(10 * i, 10 * i + 3, f"key{i % 50:04d}", "", "", 0) for i in range(20_000)]
    assert np.allclose(pii.marginals(field, many, rounds=2).sum(axis=1), 1)


def test_pipeline_stages(spark, frame, tmp_path):
    rng = random.Random(9)
    words = {"aa": [f"the{i}" for i in range(90)], "bb": [f"und{i}" for i in range(90)]}
    text = lambda l, n: " ".join(rng.choice(words[l]) for _ in range(n))
    rows = [(i, text("ab"[i % 2] * 2, 60)) for i in range(80)]
    passage = text("aa", 55)
    rows += [(100, rows[0][1]), (101, rows[2][1] + " tail"), (102, text("aa", 40) + " " + passage), (103, passage + " " + text("aa", 40)), (104, "12 34"), (105, "mail me x.y@example.com " + text("aa", 30))]
    docs = frame(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        path = f"file://{tmp_path}/{number}"
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        got = {r.doc_id: r for r in docs.collect()} if name != "packing" else {}
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            assert 104 not in got and len(got) >= 84
        if name == "near_dedup":
            assert 100 not in got and 101 not in got and {0, 2, 102, 103} <= set(got)
        if name == "substring_dedup":
            assert passage not in got[102].text and len(got[102].text.split()) == 40 and got[102].n_chars == len(got[102].text)
            assert got[4].text == dict(rows)[4]
        if name == "pii":
            assert "<EMAIL>" in got[105].text and "example.com" not in got[105].text
    assert docs.count() >= len(got) and "sequence_id" in docs.columns


def test_pipeline_keeps_one_row_of_repeated_and_null_ids(spark, frame, tmp_path):
    """One row of each group stays, so the next stage does not lose the text; equal ids with other texts stand alone."""
    rng = random.Random(21)
    text = lambda: " ".join(rng.choice([f"v{i}" for i in range(300)]) for _ in range(70))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (None, c), (7, c), (8, c + " tail"), (9, d), (9, e), (None, None), (2, " ")]
    made = corpus_pipeline.drop_near_duplicates(spark, frame(rows), str(tmp_path))
    path = f"file://{tmp_path}/near"
    made.write.parquet(path)
    near = spark.read.parquet(path)
    whole = sorted([(1, a), (None, b), (7, c), (9, d), (9, e)], key=str)
    assert sorted([(r.doc_id, r.text) for r in near.collect()], key=str) == sorted([*whole, (None, None), (2, " ")], key=str)
    left = corpus_pipeline.drop_repeated_passages(spark, near, str(tmp_path))
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=str) == whole


def test_pipeline_without_labels_and_with_other_columns(spark, frame, tmp_path):
    """Without any language nothing is rejected; users' columns of any name survive every stage; an empty table stays empty."""
    text = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, text), (2, "some other words that are here for the second row"), (None, None), (4, "")]
    extra = ["'mine' AS score", "'own' AS lang_pred", "1 AS lang_rejected", "2 AS _text", "3 AS _k", "4 AS _whole", "5 AS _some", "6 AS k", "7 AS items", "8 AS c1", "9 AS cid", "10 AS `a.b`"]
    for lang in (None, "en"):
        docs = frame(rows).withColumn("lang", F.lit(lang).cast("string")).selectExpr("*", *extra)
        columns = docs.columns
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            made = stage(spark, docs, str(tmp_path))
            path = f"file://{tmp_path}/{lang}{number}"
            made.write.parquet(path)
            docs = spark.read.schema(made.schema).parquet(path)
            assert docs.columns == columns, name
            assert {(r.score, r.lang_pred, r._text, r._k, r._whole, r._some) for r in docs.collect()} == {("mine", "own", 2, 3, 4, 5)}, name
            if name == "language_id":
                assert docs.count() == (4 if lang is None else 2)
        assert sorted(r.doc_id for r in docs.collect()) == [1, 2]
        assert {r.doc_id for r in corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()} == {1, 2}
    docs = frame([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_pipeline_runs_from_files(spark, frame, tmp_path):
    """``run`` gives the rows of its stages one after another."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["house", "with", "and", "water", "green", "light", "stone"]) + str(rng.randrange(40)) for _ in range(60))) for i in range(30)]
    rows += [(50, rows[3][1]), (51, "12 34"), (52, None)]
    frame(rows).withColumn("lang", F.lit("en")).write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted({r.doc_id for r in out}) == list(range(30))
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())


def test_path_of_cutoffs(spark, frame):
    """The first step at which a document falls, and the last step that the labels prove, against plain counting."""
    rules = quality.RULES
    rng = random.Random(6)
    text = lambda i: " ".join(rng.choice(["word", "ab", "##", "longerwordthanmost", "x"]) for _ in range(rng.choice([12, 30]))) + ("\nsame line here\nsame line here" if i % 9 == 0 else "")
    rows = [(i, text(i)) for i in range(600)]
    stats = quality.statistics(frame(rows)).withColumn("step", quality.first_step()).collect()
    value = {"symbols": lambda r: (r.n_symbols, r.word_chars), "dup_lines": lambda r: (10 * r.n_dup_lines, r.n_words), "repeats": lambda r: (r.n_repeat_words, r.n_words), "long_words": lambda r: (r.word_chars, r.n_words), "short_words": lambda r: (r.word_chars, r.n_words)}
    path = [(rule, rule.ladder[len(rule.ladder) - 1 - level]) for level in range(len(rules[0].ladder)) for rule in rules]

    def falls(r):
        for t, (rule, cut) in enumerate(path):
            top, low = value[rule.name](r)
            if low and (top / low > cut if rule.high else top / low < cut):
                return t
        return None

    assert [r.step for r in stats] == [falls(r) for r in stats]
    labels = spark.range(600).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    risk = quality.Risk(rate=0.1)
    got = quality.certify(quality.statistics(frame(rows)).withColumn("stratum", F.lit("one")).withColumn("good", F.lit(True)), risk).first()
    tail = lambda k: sum(math.comb(600, j) * 0.1**j * 0.9 ** (600 - j) for j in range(k + 1))
    want = None
    for t in range(len(path)):
        k = sum(r.step is not None and r.step <= t for r in stats)
        if tail(k) > risk.error:
            break
        want = t, k
    assert (got.step, got.k) == want and got.p == pytest.approx(tail(got.k), rel=1e-6)
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(frame(rows).withColumn("lang", F.lit("one")), labels, risk).collect()}
    assert {r.doc_id: not kept[r.doc_id][0] and not (r.step is not None and r.step <= want[0]) for r in stats} == {i: k for i, (_, k) in kept.items()}


def test_zipf_scores():
    """Log scores of a model that was made by merging are log probabilities in the order of its merges."""
    pieces = unigram.Pieces.load(unigram.model_path())
    usable = [i for i, k in enumerate(pieces.kinds) if k in (unigram.NORMAL, unigram.USER)]
    assert sum(math.exp(pieces.scores[i]) for i in usable) == pytest.approx(1.0)
    assert unigram.zipf([0.0, -1.0, 5.0, -1.0], [True, True, False, True]) == pytest.approx([-math.log(11 / 6), -math.log(11 / 3), 0.0, -math.log(11 / 2)])


def test_registered_search_against_brute_force(spark, frame, tmp_path):
    from chronofold.llm import queries, simhash

    rng = random.Random(31)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    rows = [(i * 50, base if i % 3 else base + f" tail{i}") for i in range(24)] + [(7 + i, " ".join(f"v{rng.randrange(900)}" for _ in range(50))) for i in range(20)] + [(None, base), (5000, None), (5001, "")]
    frame(rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_near, r.least, r.most) for r in queries.simhash_search(spark, f"file://{tmp_path}").collect()}
    import pyarrow as pa

    prints = [int.from_bytes(x.tobytes(), "little") for x in simhash.fingerprints(pa.array([t for _, t in rows], pa.large_string()))]
    want = set()
    for (i, _), a in zip(rows, prints, strict=True):
        if i is not None and i % 100 == 0:
            bits = [d for d in ((a ^ b).bit_count() for b in prints) if d <= simhash.RADIUS]
            want.add((i, len(bits) - 1, min(bits), max(bits)))
    assert got == want and len(want) > 10


def test_votes_of_fingerprints():
    """Each bit is the sign of the weighted votes of all occurrences of terms, counted plainly."""
    import pyarrow as pa

    from chronofold.llm import simhash
    from chronofold.llm.common import text_bytes

    texts = ["one two three four two three " * 3, "alpha beta gamma delta epsilon", "nospaceatallinthistext" * 4, "", "short"]
    raw, offsets = text_bytes(pa.array(texts, pa.large_string()))
    row, h, w = simhash._terms(raw, offsets)
    for i, got in enumerate(simhash.fingerprints(pa.array(texts, pa.large_string()))):
        votes = [0.0] * simhash.BITS
        for r, code, weight in zip(row.tolist(), h.tolist(), w.tolist(), strict=True):
            if r == i:
                second = int(simhash.mix64(np.array([code ^ 0x94D049BB133111EB], np.uint64))[0])
                for b in range(64):
                    votes[b] += weight if code >> b & 1 else -weight
                    votes[64 + b] += weight if second >> b & 1 else -weight
        assert int.from_bytes(got.tobytes(), "little") == sum(1 << b for b, v in enumerate(votes) if v > 0)
