"""Toxicity, quality rules, nearest neighbours, HTML and WARC."""

import base64
import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, html_text, queries, toxicity, warc


def test_fold():
    assert toxicity.fold("Idi0t, 1D10T! ｉｄｉｏｔ іdіоt") == " idiot idiot idiot idiot "
    assert toxicity.fold("2024 a$$et cost $5 the$$$ Élan") == " 2024 asset cost 5 the élan "
    assert toxicity.fold(None) == toxicity.fold(" \n") == "  "


def test_exceptions_and_weights():
    lex = toxicity.Lexicon({"clow": 1.0, "clown ": 3.0, "trash ": 2.0}, (-2.0, 1.0, 1.0), ("clown fish", "trash can"))
    assert lex.sums("A clown! clowns")[:2] == (2, 4.0)
    assert lex.sums("a clown fish in a trash can")[:2] == (0, 0.0)
    assert lex.sums("unclown")[:2] == (0, 0.0)
    assert 0 <= lex.score(*lex.sums("")) < lex.score(*lex.sums("clown trash")) <= 1


def test_toxicity_held_out(spark, data):
    out = queries.op1_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = out.join(labels, "doc_id").where("held_out").agg(F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1)).alias("hit"), F.count_if(F.col("toxic") == 1).alias("all"), F.count_if((F.col("toxic") == 0) & (F.col("predicted") == 1)).alias("wrong")).first()
    assert r["hit"] >= 0.75 * r["all"] and r["wrong"] <= 2
    assert out.where("score is null or score < 0 or score > 1").count() == 0


def brute_lexicon(rows, least_weight=1.0):
    """Terms, exceptions and curve of (text, label) rows by plain loops."""
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    has: dict = {}
    for t, y in rows:
        words = set(toxicity.fold(t).split())
        for f in {w + " " for w in words} | {w[:k] for w in words for k in range(4, 9) if len(w) >= k}:
            has.setdefault(f, [0, 0])[y] += 1
    weight = lambda b, a: np.log((a + 0.5) / (n1 + 1)) - np.log((b + 1) / (n0 + 1))
    good = {f: weight(b, a) for f, (b, a) in has.items() if a >= max(4, n1 // 100) and weight(b, a) - 1.645 * np.sqrt(1 / (a + 0.5) + 1 / (b + 1)) >= least_weight}
    terms: dict = {}
    for f in sorted(good, key=lambda f: (len(f), f)):
        if not any(f[:n] in terms and terms[f[:n]] >= good[f] - 0.5 for n in range(4, min(9, len(f)))):
            terms[f] = good[f]
    pairs: dict = {}
    for t, y in rows:
        w = toxicity.fold(t).split()
        hit = [any(x + " " == k or (not k.endswith(" ") and x.startswith(k)) for k in terms) for x in w]
        for p in {f"{w[i]} {w[i + 1]}" for i in range(len(w) - 1) if hit[i] or hit[i + 1]}:
            pairs.setdefault(p, [0, 0])[y] += 1
    safe = sorted(p for p, (b, a) in pairs.items() if a == 0 and b >= max(4, n0 // 1000) and weight(b, a) <= -1)
    return terms, tuple(safe)


def test_fit_and_score_equal_brute_force(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lex = toxicity.fit(docs, labels)
    rows = [(r["text"], r["label"]) for r in docs.join(labels, "doc_id").select("text", "label").collect()]
    terms, safe = brute_lexicon(rows)
    assert lex.terms.keys() == terms.keys() and all(abs(lex.terms[t] - w) < 1e-5 for t, w in terms.items()) and lex.exceptions == safe
    for r in toxicity.score(documents, lex).join(documents, "doc_id").collect():
        t, at = toxicity.fold(r["text"]), 0
        total = 0.0
        for w in t.split():
            own = [lex.terms[x] for x in (w + " ", *(w[:k] for k in range(4, len(w) + 1))) if x in lex.terms]
            total += max(own, default=0.0)
        assert safe or abs(r["weight"] - total) < 1e-6
        z = lex.curve[0] + lex.curve[1] * np.log1p(total) + lex.curve[2] * np.log1p(1000 * total / max(200, len(t)))
        assert safe or abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-6


def test_exceptions_are_learnt(spark):
    """A word insults in label 1; in one phrase of label 0 it doesn't."""
    rows = [(i, f"you are a scumm{'' if i % 3 else ' indeed'} fellow number n{i}", 1) for i in range(60)]
    rows += [(100 + i, f"the pond scumm of lake l{i} is green", 0) for i in range(20)] + [(200 + i, f"a clean text about t{i} things", 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label INT")
    lex = toxicity.fit(df.drop("label"), df.select("doc_id", "label"))
    assert "pond scumm" in lex.exceptions and any(t.startswith("scum") for t in lex.terms)
    assert lex.sums("a pond scumm")[0] == 0 and lex.sums("a scumm")[0] == 1


def test_toxicity_odd(spark, odd_docs, clashing, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (8, 1), (2, 0), (4, 0), (4, 1), (None, 1), (5, None)], "doc_id BIGINT, label INT")
    lex = toxicity.fit(odd_docs, labels)
    assert toxicity.score(clashing, lex).count() == odd_docs.count()
    none = toxicity.fit(odd_docs, labels.where("label = 9"))
    assert none.terms == {} and toxicity.score(odd_docs, none).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.score(no_docs, lex).count() == 0
    many = odd_docs.where("doc_id = 1").crossJoin(spark.range(50)).drop("id")  # one id in many rows is one text
    assert toxicity.fit(many.unionByName(odd_docs), labels, max_rows=3).curve


@pytest.fixture(scope="module")
def vectors(spark, data):
    return spark.read.parquet(f"{data}/embeddings.parquet")


def exact(rows, k, modulus):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in rows:
        if q % modulus == 0:
            s = sorted((-float(v @ w), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = [i for _, i in s[:k]]
    return out


def found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_nearest(spark, vectors, data):
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = exact(rows, 20, 20)
    assert found(ann.nearest(vectors, factor=1.0, shard_rows=150, block=7)) == want
    got = found(queries.op4_ann(spark, data))
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.9


def test_nearest_odd(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(i, rng.normal(size=2).tolist()) for i in range(30, 60)]
    rows += [(60, None), (61, []), (62, [0.0, 0.0]), (63, [float("nan"), 1.0]), (64, [float("inf"), 1.0]), (65, [None, 1.0]), (None, [1.0, 1.0]), (80, [1.0, 2.0, 3.0]), (81, [1.0, 0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>").withColumn("id", F.lit(1)).withColumn("score", F.lit(1)).withColumn("dim", F.lit(1))
    got = ann.nearest(df, k=5, query_modulus=20, factor=1.0, shard_rows=20)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert found(got) == exact(rows, 5, 20)
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows", [10, 1000])
def test_nearest_repeated_ids(spark, shard_rows):
    """Query rows of one id share a top k, repeated candidates are found each time."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.integers(-8, 9, 3).tolist()) for i in range(1, 60)] + [(20, [1, 2, 3]), (20, [-3, 0, 1]), (20, [1, 2, 3]), (7, [8, 8, 8]), (7, [8, 8, 8]), (9, [-8, 1, 0])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, k=6, query_modulus=20, factor=1.0, shard_rows=shard_rows).collect())
    want = []
    for q in (20, 40):
        pairs = sorted((-float(np.dot(a, b)), j) for i, a in rows if i == q and any(a) for j, b in rows if j != q and any(b))
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(pairs[:6])]
    assert got == want


def test_factor_one_is_exact_over_many_cells(spark):
    """Clusters, so that cells and nodes are skipped; and copies, which tie."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16)) * 3
    v = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.3
    v[1000:1040] = v[20]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    want = exact(rows, 20, 20)
    assert found(ann.nearest(df, factor=1.0, shard_rows=100)) == want
    got = found(ann.nearest(df, shard_rows=100))
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_factors_fit_the_data():
    rng = np.random.default_rng(10)
    assert ann.fitted_factor(rng.normal(size=(3000, 64)), 20) > 2.5 >= ann.fitted_factor(rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)] * 3 + rng.normal(size=(3000, 16)) * 0.3, 20)
    assert ann.fitted_factor(rng.normal(size=(30, 64)), 20) == 1.0


def test_trees_and_cells_prune():
    rng = np.random.default_rng(9)
    v = rng.normal(size=(10, 8))[rng.integers(0, 10, 3000)] * 5 + rng.normal(size=(3000, 8)) * 0.1
    tree = ann.VPTree(np.arange(3000), v, 64)
    score, ids = tree.search(np.arange(40), v[:40], 5, 1.0)
    assert tree.scored < 0.5 * 40 * 3000
    s = v[:40] @ v.T
    s[np.arange(40), np.arange(40)] = -np.inf
    assert np.allclose(score, -np.sort(-s, axis=1)[:, :5])
    cells = ann.Cells(v[::10], float((v * v).sum(axis=1).max()), 8)
    of, bound = cells.of(v), cells.bounds(v[:40])
    lift = np.sqrt(np.maximum(cells.top - (v * v).sum(axis=1), 0))
    far = np.sqrt(((v[:40, None] - v[None]) ** 2).sum(axis=2) + lift[None] ** 2)
    assert all((far[:, of == c] >= bound[:, [c]] - 1e-6).all() for c in range(cells.n))
    assert (bound > 0).mean() > 0.5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- c --><div class="cookie-notice">We use cookies, many of them.</div>
<div id="main"><h1>A &amp; B</h1><p>First   paragraph, with <b>bold</b> text &mdash; long enough to count.<p>Second one, unclosed; it has words too.<br>And a line.<div class="sidebar"><p>Other stories, quite long as well, yes.</p></div>
<table><tr><td>cell one<td>cell two</table><form><input>Send</form><section id="comments"><p>Great read, thanks!</p></section></div><aside>Aside text here.</aside><footer>&copy; us</footer></body></html>"""


def test_extract():
    assert html_text.extract(PAGE) == "A & B\nFirst paragraph, with bold text — long enough to count.\nSecond one, unclosed; it has words too. And a line.\ncell one\ncell two"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<p></p>") == ""
    assert html_text.extract("plain text") == "plain text"
    assert html_text.extract("<article><p>a < b</p><p>&#x41;&nbsp;x") == "a < b\nA x"
    for broken in ("<", "<!--", "<script>x", "<p", "</p></div>", "<a href='x", "<" * 50):
        html_text.extract(broken)


def test_extract_query(spark, data):
    from html import unescape

    got = {r["page_id"]: r for r in queries.op8_html(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_extract_keeps_the_whole_article():
    x = html_text.extract
    text = "A sentence, and one more. "
    assert x(f'<div id="page" class="has-sidebar"><article><p>{text}</p></article></div>') == text.strip()
    assert x(f'<body class="with-comments"><div class="post no-comments"><p>{text}</p></div></body>') == text.strip()
    assert x("<body><p>" + "\u0130" * 20 + "</p><script>x</script><p>After, there is text.</p></body>").endswith("After, there is text.")
    assert x("<p title=Bob's>Hello, it's here.</p><p>More.</p>") == "Hello, it's here.\nMore."
    figure = "<figure><img src=a><figcaption>A caption</figcaption></figure>"
    assert x(f"<article><p>{text * 5}</p>{figure}<p>x <math><mi>y</mi></math> z</p></article>") == f"{(text * 5).strip()}\nA caption\nx y z"
    lead = f"<body><nav><a href=a>Home</a></nav><h1>Title</h1><p>Lead</p><div><p>{text * 20}</p><p>{text * 30}</p></div><footer>Foot</footer></body>"
    assert x(lead).split("\n")[:2] == ["Title", "Lead"] and "Home" not in x(lead) and "Foot" not in x(lead)
    assert x(f"<article><p>{text}</p><ul><li>one</li><li>two</li></ul><h2>Sub</h2><p><a href=a>See</a></p><div>By me</div></article>") == f"{text.strip()}\none\ntwo\nSub\nSee\nBy me"


def test_path_scores_decide(monkeypatch, spark, data):
    menu = "<div><p>First, with some text in it.</p><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><p>Second, with text and <a href=3>a link</a>.</p></div>"
    assert html_text.extract(menu) == "First, with some text in it.\nSecond, with text and a link."
    comments = f"<main><h1>T</h1><p>Short article, with text.</p><section id=comments><p>{'I think, yes. ' * 30}</p></section></main>"
    assert html_text.extract(comments) == "T\nShort article, with text."
    pages = [r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").limit(20).collect()]
    before = [html_text.extract(h) for h in pages]
    monkeypatch.setattr(html_text.Blocks, "scores", html_text.Blocks.priors)  # tags and names alone
    assert all(html_text.extract(h) != b for h, b in zip(pages, before))
    assert "Home" in html_text.extract(menu)


PARA = "A sentence that says something, and then another clause of it. It goes on, for a while, as articles do; then it ends."


@pytest.mark.parametrize("inside", [
    '<p class="share-price">The share closed at 10 EUR.</p>', '<div class="side-effects">Headache, and a dry mouth.</div>', "<ul><li><a href=1>First book</a></li><li><a href=2>Second book</a></li></ul>",
    '<ol class="references"><li><a href=1>First book</a></li></ol>', '<table class="data"><tr><td>1</td></tr></table>', '<h2 class="sub">Sub</h2>', f'<div class="row"><p>{PARA[:60]}</p></div>', "<div>By me</div>"])
def test_parts_of_the_article_stay(inside):
    text = " ".join(re.sub("<[^>]*>", " ", inside).split())
    for around in ("article",) if "href" in inside else ("article", "main"):  # elsewhere a list of short links is a menu
        got = html_text.extract(f"<body><nav><a href=/>Home</a></nav><{around}><h1>T</h1>{f'<p>{PARA}</p>' * 6}{inside}</{around}></body>").split("\n")
        assert got[:7] == ["T"] + [PARA] * 6
        assert " ".join(got[7:]) == text


@pytest.mark.parametrize("extra", [
    '<article class="teaser"><h2>Other</h2><p>A short teaser, see more.</p></article>', '<div class="werbung">Jetzt kaufen, nur heute bei uns!</div>', '<div class="xyz">Buy now!</div>', '<div class="publicité"><p>Achetez ici.</p></div>',
    '<div class="ad-container">Buy this, today.</div>', "<aside>More of it.</aside>", f'<section id="comments"><article class="comment"><p>{PARA * 9}</p></article></section>', f'<div class="cookie-notice">{PARA}</div>'])
def test_extras_go(extra):
    body = f"<h1>T</h1>{f'<p>{PARA}</p>' * 6}"
    want = "\n".join(["T"] + [PARA] * 6)
    for page in (f"<body><article>{body}</article>{extra}</body>", f"<body>{extra}<article>{body}</article></body>", f"<body><main><article>{body}</article>{extra}</main></body>", f"<body><article>{body}{extra}</article></body>",
                 f"<body><div class=post>{body}{extra}</div></body>"):
        assert html_text.extract(page) == want


@pytest.mark.parametrize("page", [
    "<a '" * 250_000, '<a ="' * 200_000, "<a ='x\">" * 120_000, "<b>" * 300_000, "<div>" * 200_000 + "x", "<b>" * 1000 + "<p>x" * 100_000, "<!--" * 250_000,
    "<svg>" * 200_000, "< " * 500_000, "<i>" * 50_000 + "</p></a></u>" * 50_000, "<p><table><td>" + "<b>" * 50_000 + "<div></div>" * 50_000, "<b><td>" + "<i>" * 50_000 + "</b>" * 50_000, "<ul><li>" * 60_000 + "x"])
def test_malformed_pages_take_linear_time(page):
    start = time.time()
    html_text.extract(page)
    assert time.time() - start < 20


def test_extract_odd(spark):
    df = spark.createDataFrame([(1, None, "x", None, "old"), (1, "<p>y</p>", None, 2, "old"), (None, "", "", 3, None)], "page_id INT, html STRING, url STRING, n_chars INT, text STRING")
    assert sorted(tuple(r) for r in html_text.extract_text(df).select("n_chars", "text").collect()) == [(0, ""), (0, ""), (1, "y")]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_warc_query(spark, data, same_rows):
    same_rows(queries.op10_warc(spark, data), queries.ORACLE["op10_warc"])


def test_smallest_ids_that_repeat_are_responses(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "c", "x"), (3, "d", "y")], "page_id BIGINT, url STRING, html STRING")
    got = sorted((r["url"], r["record_type"], r["refers_to"]) for r in warc.read_records(warc.write_archives(df)).collect())
    assert got == [("a", "response", None), ("b", "response", None), ("c", "revisit", 1), ("d", "response", None)]


def test_archives_are_read_by_many_tasks(spark):
    """One archive of 48 blocks, spread over the tasks its bytes ask for."""
    assert (warc.read_tasks(0, 8), warc.read_tasks(5 << 20, 8), warc.read_tasks(5 << 30, 8), warc.read_tasks(1 << 40, 8)) == (1, 5, 20, 4096)
    index = spark.range(480).selectExpr("'f' as folder", "'a' as file", f"id * {warc.READ // 10} as offset", f"cast({warc.READ // 10} as long) as length", "id as page_id", "'' as url", "'' as digest", "0L as payload_bytes")
    seen = []
    kept = type(index).mapInArrow
    type(index).mapInArrow = lambda self, f, schema: seen.append(self) or kept(self, f, schema)
    try:
        warc.read_records(index)
    finally:
        type(index).mapInArrow = kept
    counts = [len(x) for x in seen[0].rdd.glom().collect()]
    assert len(counts) == warc.read_tasks(48 * warc.READ, spark.sparkContext.defaultParallelism) and max(counts) <= 2 * 480 / len(counts)


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/\r\nX: y", "<p>é</p>"), (3, None, "<p>é</p>"), (7, "u", "<p>é</p>"), (1, "http://b", None), (2, "c d", ""), (9, "e", "x" * 300_000), (None, "n", "x" * 300_000), (4, "f", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").withColumn("first", F.lit(1)).withColumn("file", F.lit("x"))
    index = warc.write_archives(df, f"file://{tmp_path}/w", min_revisit_bytes=1)
    got = {r["page_id"]: r for r in warc.read_records(index, payloads=True).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        raw, r = (html or "").encode(), got[page]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == raw
    assert {p: got[p]["refers_to"] for p in got} == {5: 3, 3: None, 7: 3, 1: None, 2: None, 9: None, None: 9, 4: None}
    some = warc.read_records(index.where("page_id in (3, 9)"))
    assert sorted(r["page_id"] for r in some.collect()) == [3, 9]
    assert warc.read_records(warc.write_archives(df.limit(0), f"file://{tmp_path}/e")).count() == 0
