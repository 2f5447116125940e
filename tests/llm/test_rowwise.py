"""Operators that judge each row by itself: language, tokens, pages, quality."""

import math

import cases
import numpy as np
import pytest
from tokenizers import Tokenizer

from originline.llm import jobs, language, pages, quality, tokens

SF = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


def brute_bits(model, lang, text):
    """Code length of a text by walking its bytes one at a time."""
    data = [c for c in (" " + "".join(ch if ch.isalpha() else " " for ch in text.lower())).encode()]
    folded = [b for i, b in enumerate(data) if not (b == 32 and i and data[i - 1] == 32)]
    width, k, total = model.child.shape[1], model.languages.index(lang), 0.0
    for i, byte in enumerate(folded):
        best, column = 1, model.symbols[byte]
        for size in range(1, model.depth + 1):
            if size > i:
                break
            node = 1
            for b in folded[i - size : i]:
                node = model.child[node, model.symbols[b]] if node else 0
            best = node or best
        total += model.cost[best * width + column, k]
    return total


def test_language_bits_equal_a_walk_byte_by_byte(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    text = "the erred of ing"
    import pyarrow as pa

    bits = model.bits(*language.normal_bytes(pa.array([text, "", text])), chunk=7)
    for k, lang in enumerate(model.languages):
        assert bits[0, k] == pytest.approx(brute_bits(model, lang, text), rel=1e-4)
        assert bits[2, k] == pytest.approx(bits[0, k], rel=1e-6)


def test_context_rows_are_distributions(spark):
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = model.cost.reshape(model.child.shape[0], model.child.shape[1], -1)[1:]
    assert np.allclose(np.exp2(-rows).sum(axis=1), 1.0, atol=1e-3)


def test_language_held_out_accuracy(spark):
    out = jobs.QUERIES["op1_language"](spark, SMALL).toPandas()
    known = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas()
    held = out.merge(known, on="doc_id").query("held_out")
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.98


def test_language_edges(spark):
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    out = language.identify(cases.table(spark), model).toPandas()
    assert len(out) == len(cases.ROWS) and out.score.between(0, 1).all()
    und = set(out[out.lang_pred == "und"].doc_id.dropna().astype(int))
    assert und == {2, 3, 4, 5}
    assert language.train(cases.empty(spark)) is None
    assert set(language.identify(cases.table(spark), None).toPandas().lang_pred) == {"und"}
    assert language.identify(cases.empty(spark), model).count() == 0


def test_tokens_equal_the_library(spark):
    path = jobs.tokenizer_path("word_bpe_49k.json")
    texts = [r[1] for r in cases.ROWS] + ["a<|endoftext|>b <|startoftext|>", "é ﬁ x\x85y", "ΣΊΣΥΦΟΣ I'm don't"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    out = tokens.token_counts(cases.table(spark, rows), path, room=50).toPandas().sort_values("doc_id")
    plain = Tokenizer.from_file(path)
    want = [len(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert out.n_tokens.tolist() == want
    assert out.n_bytes.tolist() == [len((t or "").encode()) for t in texts]
    assert out.over_limit.tolist() == [n > 2048 for n in want]
    assert tokens.token_counts(cases.empty(spark), path).count() == 0


HTML = [
    (1, "u", "<html><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy now</div><article><h1>Title &amp; more</h1>"
             "<p>First  paragraph of\n the article.<p>Second one with <b>bold</b>&nbsp;text.</article>"
             "<section class='comments'><p>I like it a lot, really.</p></section><footer>&copy; us</footer></body></html>",
     "Title & more\n\nFirst paragraph of the article.\n\nSecond one with bold text."),
    (2, "u", None, ""), (3, None, "", ""), (None, "u", "<script>var t='</p>'</script>", ""),
    (4, "u", "plain words", "plain words"),
    (5, "u", "<body><form>Name</form><aside>x</aside><main><p>Kept</p></main><!-- c --></body>", "Kept"),
    (6, "u", "<body><div>" * 3000 + "deep" + "</div>" * 10, "deep"),
]


def test_pages(spark):
    rows = [(a, b, c, "clash") for a, b, c, _ in HTML] + [(1, "u", HTML[0][2], "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = pages.extract(df).collect()
    found = {r["page_id"]: r for r in out}
    assert len(out) == len(rows)
    for page_id, _, _, want in HTML:
        assert found[page_id]["text"] == want and found[page_id]["n_chars"] == len(want)
    assert pages.extract(df.limit(0)).count() == 0


def test_pages_of_the_table_equal_their_articles(spark):
    import html
    import re

    out = {r["page_id"]: r["text"] for r in jobs.QUERIES["op10_pages"](spark, SF).collect()}
    for row in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert out[row["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_density_grows_with_text_and_falls_with_links():
    def of(body):
        tree = pages.Tree()
        tree.feed(f"<body><div>{body}</div><div><a>menu entry</a></div></body>")
        return pages.densities(tree)[0][2]

    assert of("<p>" + "word " * 50 + "</p>") > of("<p>word word</p>")
    assert of("<p>" + "word " * 50 + "</p>") > of("<p><a>" + "word " * 50 + "</a></p>")


def test_quality_on_labelled_rows(spark):
    out = jobs.QUERIES["op9_quality"](spark, SMALL).toPandas()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    both = out.merge(labels, on="doc_id")
    assert (both.accepted == (both.quality == 1)).mean() > 0.97
    assert both[both.quality == 1].accepted.mean() > 0.99
    assert len(out) == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_quality_edges(spark):
    docs, labels = cases.table(spark), spark.createDataFrame(
        [(1, 1, 0), (5, 0, 0), (7, None, 0), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).toPandas()
    assert len(out) == len(cases.ROWS) and out.score.between(0, 1).all()
    none = quality.classify(docs, labels.limit(0)).toPandas()
    assert none.accepted.all() and none.score.isna().all()
    assert quality.classify(docs, labels.where("quality = 1")).toPandas().accepted.all()
    assert quality.classify(cases.empty(spark), labels).count() == 0
    kept = quality.accepted_rows(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(cases.ROWS)


def test_word_products_equal_dense_ones(monkeypatch):
    """Rows without features, features outside the fit, and slices that end inside the rows."""
    monkeypatch.setattr(quality.Design, "STEP", 7)
    rng = np.random.default_rng(1)
    held = [np.sort(rng.choice(40, n, replace=False)) for n in (0, 5, 12, 0, 1, 30, 0)]
    known = np.sort(rng.choice(40, 11, replace=False))
    design = quality.Design(known, np.concatenate(held), np.concatenate([[0], np.cumsum([len(h) for h in held])]))
    dense = np.array([[float(k in h) for k in known] for h in held])
    w, r = rng.normal(size=11), rng.normal(size=len(held))
    assert np.allclose(design.sums(w), dense @ w) and np.allclose(design.totals(r), dense.T @ r)
    nothing = quality.Design(known, np.zeros(0, np.int64), np.zeros(1, np.int64))
    assert len(nothing.sums(w)) == 0 and not nothing.totals(np.zeros(0)).any()


def test_views_help_each_other():
    """A text view with few labels learns from what the page view is sure of."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 4000).astype(float)
    a = y[:, None] * 1.2 + rng.normal(size=(4000, 12))
    b = y[:, None] * 5.0 + rng.normal(size=(4000, 1))
    few, pool = slice(0, 40), slice(40, 3000)
    alone = quality.co_train(a[few], b[few], y[few], a[:0], b[:0])
    both = quality.co_train(a[few], b[few], y[few], a[pool], b[pool])
    score = lambda m: (((m.text.margin(a[3000:]) > 0) == (y[3000:] > 0.5)).mean())
    assert score(both) >= score(alone)
    assert math.isfinite(both.prior)


def test_words_alone_mark_toxic_and_low_texts(spark):
    """Texts of one typography: only a word tells the toxic ones, only a pair of words the low ones."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{'abcdefghij'[k]}x" for k in rng.integers(0, 10, 60)]
        toxic, low = i % 5 == 0, i % 3 == 0
        words[20] = "wzx" if toxic else words[20]
        words[40:42] = ["wpx", "wqx"] if low else ["wqx", "wpx"]
        rows.append((i, " ".join(words), "en", "a", 300))
        labels.append((i, int(not low), int(toxic)))
    docs, known = cases.table(spark, rows), spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, known).toPandas().set_index("doc_id").loc[600:]
    want = {i: (q, t) for i, q, t in labels}
    assert all(out.toxic[i] == (want[i][1] == 1) and out.accepted[i] == (want[i][0] == 1) for i in out.index)
    kept = {r["doc_id"] for r in quality.accepted_rows(docs, known).collect() if r["doc_id"] >= 600}
    assert kept == {i for i in range(600, 900) if want[i] == (1, 0)}
    assert not quality.classify(docs, known.drop("toxic")).toPandas().toxic.any()
