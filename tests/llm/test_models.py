"""Operators 1, 5, 6 and 7: planted structure, round trips, held-out accuracy and awkward rows."""

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import frame, prose
from watchtide.llm import common, html_text, langid, toxicity, warc

SYLLABLES = {"aa": ["tor", "ven", "sil", "gra"], "bb": ["mu", "ka", "lo", "ri"], "cc": ["çé", "xy", "öß", "wq"]}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_held_out(spark):
    rows = spark.createDataFrame([(i,) for i in [None, *range(200)]], "doc_id long").select("doc_id", common.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) for r in rows)


@pytest.fixture(scope="module")
def spoken_docs(spark):
    rng = random.Random(1)
    rows = [(i, spoken(rng, lang, rng.randrange(2, 60)), lang, "x", "x") for i, lang in enumerate(rng.choices(list(SYLLABLES), k=400))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score string")


def test_language_held_out_accuracy(spark, spoken_docs, monkeypatch):
    monkeypatch.setattr(langid, "WORDS_PER_LANGUAGE", 1500)
    model = langid.train(spoken_docs)
    assert model.languages == ["aa", "bb", "cc"]
    joined = langid.identify(spoken_docs, model).join(spoken_docs.select("doc_id", "lang"), "doc_id").where(common.held_out()).collect()
    assert len(joined) > 60 and sum(r["lang"] == r["lang_pred"] for r in joined) / len(joined) > 0.95
    assert all(0 <= r["score"] <= 1 for r in joined)
    odd = frame(spark, [None, "", "  ", "12 34 !?", "\U0001f600", "tor " * 30_000, "a" * 5000], [1, None, 3, 3, 5, 1 << 60, 7])
    got = langid.identify(odd, model).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"] or -1)][:5] == ["und"] * 5
    assert {r["lang_pred"] for r in got if r["doc_id"] == 1 << 60} == {"aa"}
    assert langid.identify(frame(spark, []), model).collect() == []


def test_language_without_training_rows(spark):
    model = langid.train(frame(spark, ["some text"], lang=None))
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(frame(spark, ["some text"]), model).collect()] == [("und", 0.0)]


def test_language_gradients():
    """Backpropagation against differences."""
    rng = np.random.default_rng(1)
    w = {"V": rng.normal(0, 1, (6, 2)), "c": np.zeros(2)}
    for way in "fb":
        w["E" + way], w["U" + way] = rng.normal(0, 1, (256, 9)), rng.normal(0, 1, (3, 9))
    codes, target = rng.integers(97, 100, (4, 5)), np.array([0, 1, 1, 0])

    def loss():
        p = langid.position_probabilities(w, codes)
        return -np.log(p[:, np.arange(4), target]).mean()
    g = langid._gradients(w, codes, target)
    for name, at in (("V", (2, 1)), ("Ef", (98, 4)), ("Eb", (97, 7)), ("Uf", (1, 8)), ("Ub", (2, 3))):
        old, step = w[name][at], 1e-3
        w[name][at] = old + step
        up = loss()
        w[name][at] = old - step
        down = loss()
        w[name][at] = old
        assert abs((up - down) / (2 * step) - g[name][at]) < 1e-3


def toxic_corpus(spark, n=500):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = prose(rng, rng.randrange(5, 120), 300).split()
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgle", "Blarfed", "SNORP!!", "zоrgle", "sn0rp"]))
        elif rng.random() < 0.1:
            words[1:1] = ["snorp", "clinic"]
        docs.append((i, " ".join(words), "x", 0))
        labels.append((i, 0, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus(spark)
    lexicon = toxicity.learn(docs, labels)
    assert " snorp clinic " in lexicon.exceptions
    rows = toxicity.score(docs, lexicon).join(labels, "doc_id").where(common.held_out()).collect()
    assert len(rows) > 80 and sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.97
    odd = toxicity.score(frame(spark, [None, "", "zorgle " * 20_000, "x"], [1, None, 3, 3]), lexicon).collect()
    assert len(odd) == 4 and all(0 <= r["score"] <= 1 for r in odd)
    assert sorted(r["predicted"] for r in odd) == [0, 0, 0, 1]
    assert toxicity.score(frame(spark, []), lexicon).collect() == []


def test_toxicity_without_labels(spark):
    docs, labels = toxic_corpus(spark, 20)
    lexicon = toxicity.learn(docs, labels.where("false"))
    assert [r["predicted"] for r in toxicity.score(docs, lexicon).collect()] == [0] * 20


def test_fold():
    assert toxicity.fold("") == toxicity.fold(" 12 !") == "  "
    assert toxicity.fold("Іdiоt") == toxicity.fold("ＩＤＩＯＴ") == toxicity.fold("1 id1ot!!") == " idiot "
    assert toxicity.fold("a.b\nc***") == " a b c "


PAGES = [
    '<html><head><title>T</title><script>"<p>no</p>"</script></head><body><nav><ul><li><a href="/a">Home</a></li><li>News</li></ul></nav>'
    '<div class="ad">Buy &amp; save now.</div><article><h1>Head &lt;1&gt;</h1><p><b>Open bold.<br><p>Two\n  lines &eacute; here.</p>'
    "<!-- <p>not this</p> --><p>Last one.</article><footer>&copy; me</footer></body></html>"]


def test_blocks():
    found = [(b.step.text, b.text) for b in html_text.blocks(PAGES[0])]
    assert found == [("li", "Home"), ("li", "News"), ("div ad", "Buy & save now."), ("h1", "Head <1>"), ("p", "Open bold."), ("p", "Two lines é here."),
                     ("p", "Last one."), ("footer", "© me")]
    assert html_text.blocks(None) == html_text.blocks("") == html_text.blocks("<p> <br></p><!-- open") == []
    assert [b.text for b in html_text.blocks("a < b <p>c</div>d<li>e")] == ["a < b", "c", "d", "e"]


@pytest.mark.parametrize("piece", ["if (a <b) ", "<a ", "<p x='", "<svg>", "<div>x", "<p '>' ", "<p x='>\"", "</p>", "<script ", "<!-", "<p a=\"'\" b='"])
def test_broken_markup_takes_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_text.Features()(html_text.blocks(page)[:1000])
    assert time.process_time() - began < 4


def test_broken_markup_is_text_or_dropped():
    text = lambda page: [b.text for b in html_text.blocks(page)]
    assert text("if (a <b) c") == ["if (a <b) c"]
    assert text("x <p y='never closed") == ["x <p y='never closed"]
    assert text("a < b <!-- open <p>c</p>") == ["a < b"]
    assert text("<p>a</p> 1 < 2 <!-- open") == ["a", "1 < 2"]
    assert text("<svg><p>kept</p>") == ["kept"] and text("<p>a<script>b") == ["a"]


def test_stretches_give_what_the_whole_page_gives():
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(1, 40), 300) for _ in range(60)]
    weights = html_text.fit(PAGES)
    for _ in range(10):
        found, _ = html_text._composed(rng, texts)
        if found:
            whole = html_text.probabilities(weights, [html_text.Features()(found)])[0]
            for stretch in (1, 3, 7):
                assert np.allclose(whole, html_text.long_probabilities(weights, found, html_text.Features(), stretch), atol=1e-5)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(7)
    d, h = 5, 3
    w = {"v": rng.normal(size=2 * h), "c": rng.normal(size=1)}
    for way in "fb":
        w |= {"W" + way: rng.normal(size=(d, 4 * h)), "U" + way: rng.normal(size=(h, 4 * h)), "b" + way: rng.normal(size=4 * h)}
    w = {k: v.astype(np.float64) for k, v in w.items()}
    x, lengths = rng.normal(size=(2, 4, d)), np.array([4, 2])
    target = rng.integers(0, 2, (2, 4)).astype(float)
    mask = np.arange(4)[None, :] < lengths[:, None]

    def loss():
        p = html_text._forward(w, x, lengths)[0]
        return -float(((target * np.log(p) + (1 - target) * np.log(1 - p)) * mask).sum() / mask.sum())
    found = html_text._gradients(w, x, lengths, target)
    for k, v in w.items():
        flat = v.reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-3 - found[k].reshape(-1)[i]) < 2e-3, k


#: Pages written by hand, in layouts that the training pages do not have, and their main text.
HAND = [
    ("""<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><div id="topbar"><a href="/">Start</a> <a href="/b">Blog</a></div>
<nav class="menu main-menu"><a href="/1">One</a><a href="/2">Two</a></nav><main role="main"><article><h1>On keeping bees</h1>
<p>Bees need water close to the hive, and more of it when the days get long and hot.</p><ul><li>Place a shallow dish nearby.</li>
<li>Put stones into it, so that none of them drowns.</li></ul><p>Then leave them alone for a while &amp; watch.</p></article></main>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/p">Honey</a></li></ul></aside><footer><p>Copyright 2024</p></footer></body></html>""",
     ["On keeping bees", "Bees need water close to the hive, and more of it when the days get long and hot.", "Place a shallow dish nearby.",
      "Put stones into it, so that none of them drowns.", "Then leave them alone for a while & watch."]),
    ("""<body><header class="site-header"><h2>Daily paper</h2></header><div class="cookie-banner">We use cookies. <button>Fine</button></div>
<article class="story"><h1>Bridge opens</h1><div class="ad">Buy a car today!</div><p>The bridge over the river was opened on Monday after three years of work.</p>
<blockquote>It is a good day, said the mayor.</blockquote></article><section class="comments"><h2>Comments</h2><div class="comment"><p>I like the new bridge a lot, it is nice.</p></div></section>
<div class="newsletter"><form><label>Mail</label><input></form></div></body>""",
     ["Bridge opens", "The bridge over the river was opened on Monday after three years of work.", "It is a good day, said the mayor."])]


def test_hand_written_pages(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(3, 50), 2000) for _ in range(200)]
    weights = html_text.fit(PAGES + [html_text.compose(rng, texts).replace("\x02", "").replace("\x03", "") for _ in range(60)])
    pages = spark.createDataFrame([(i, "u", page) for i, (page, _) in enumerate(HAND)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in html_text.extract(pages, weights).collect()}
    for i, (_, want) in enumerate(HAND):
        assert got[i] == want


def test_main_text(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 60), 3000) for _ in range(300)]
    weights = html_text.fit(PAGES)
    wrong = total = 0
    for _ in range(150):
        found, label = html_text._composed(rng, texts)
        if found:
            wrong += int(((html_text.probabilities(weights, [html_text.Features()(found)])[0] > 0.5) != (label > 0.5)).sum())
            total += len(found)
    assert wrong / total < 0.01
    rows = [(1, "u", PAGES[0]), (None, None, None), (3, "", ""), (3, "v", "<main>" + "<p>one line</p>" * 9000 + "</main>"), (1, "u", PAGES[0])]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, n_blocks string")
    got = html_text.extract(pages, weights).collect()
    assert sorted((r["page_id"] or -1, r["text"]) for r in got) == [
        (-1, ""), *[(1, "Head <1>\nOpen bold.\nTwo lines é here.\nLast one.")] * 2, (3, ""), (3, "\n".join(["one line"] * 9000))]
    empty = pages.where("false")
    assert html_text.extract(empty, html_text.train(empty)).collect() == []


def test_warc_round_trip(spark):
    html = [None, "", "<p>x</p>", "<p>x</p>", "é\r\n\r\nWARC/1.1\r\nContent-Length: 4\r\n\r\n", "long " * 50_000, "<p>x</p>", "tie", "tie"]
    ids = [5, 4, 3, 2, 8, 9, None, 7, 7]
    urls = ["http://a.b/c?d#e", None, "no uri", "x\r\nWARC-Type: request", "", "http://a", "http://ü", "u", "u"]
    pages = spark.createDataFrame([(*r, "x") for r in zip(ids, urls, html)], "page_id long, url string, html string, first string")
    path = common.shared_path(spark, "warc")
    warc.write(pages, path)
    got = warc.captures(spark, path, with_payload=True).collect()
    assert len(got) == len(html) and all(r["request"]["concurrent_to"] == r["main"]["record_id"] == r["metadata"]["concurrent_to"] for r in got)
    want = []
    for i, h in zip(ids, html):
        raw = (h or "").encode()
        want.append((-1 if i is None else i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()))
    assert sorted((-1 if r["page_id"] is None else r["page_id"], r["main"]["payload_bytes"], r["main"]["payload_digest"]) for r in got) == sorted(want)
    kinds = sorted((-1 if r["page_id"] is None else r["page_id"], r["main"]["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(-1, "response", None), (2, "revisit", None), (3, "revisit", None), (4, "response", None), (5, "revisit", 4),
                     (7, "response", None), (7, "revisit", 7), (8, "response", None), (9, "response", None)]
    assert all(r["main"]["digest_holds"] and bytes(r["main"]["payload"]) in {(h or "").encode() for h in html} for r in got if r["main"]["record_type"] == "response")
    path = common.shared_path(spark, "warc")
    warc.write(pages, path, least_bytes=1 << 20)
    assert {r["main"]["record_type"] for r in warc.captures(spark, path).collect()} == {"response"}
    path = common.shared_path(spark, "warc")
    warc.write(pages.where("false"), path)
    assert warc.captures(spark, path).collect() == []
    assert spark.createDataFrame([("da39a3ee5e6b4b0d3255bfef95601890afd80709",)], "h string").select(warc.base32(F.col("h"))).first()[0] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_names_that_begin_like_raw_elements_and_unclosed_ones():
    def texts(page):
        return [b.text for b in html_text.blocks(page)]
    for tag in ("video-js", "title-bar", "math-field", "object-view", "script-x"):
        assert texts(f"<p>a</p><{tag} id=x>in</{tag}><p>b</p>") == ["a", "in", "b"]
    for tag in ("svg", "object", "canvas", "audio", "video"):
        assert texts(f"<p>a</p><{tag} id=x><p>b</p>") == ["a", "b"]
        assert texts(f"<p>a</p><{tag}>no</{tag}><p>b</p>") == ["a", "b"]
    for tag in ("script", "style", "title", "textarea"):
        assert texts(f"<p>a</p><{tag}>no<p>no</p>") == texts(f"<p>a</p><{tag}\n>no") == ["a"]


def test_all_exception_phrases_stay(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ENTRIES", 1)
    rng = random.Random(3)
    added = ["snorp"] * 40 + ["snorp aisle"] * 12 + ["snorp clinic"] * 12 + [""] * 100
    docs = frame(spark, [f"{prose(rng, 12)} {a} {prose(rng, 12)}" for a in added])
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(len(added))], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert {" snorp aisle ", " snorp clinic "} <= set(lexicon.exceptions)
