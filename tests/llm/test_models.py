import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import html_extract, language
from tidemark.llm.dom import Page
from tidemark.llm.page_samples import sample_pages

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trees(spark):
    return html_extract.fit_trees(spark)


def test_trees_on_unseen_pages(trees):
    right = total = 0
    for html in sample_pages(120, 77):
        p = Page(html)
        kept = np.array(p.decode(trees.log_odds(p.features())))
        seen = ~np.array(p.hidden)
        right += (kept == (p.labels() > 0))[seen].sum()
        total += seen.sum()
    assert right / total > 0.97


def test_kept_elements_have_kept_ancestors(trees):
    for html in sample_pages(30, 78):
        p = Page(html)
        kept = p.decode(trees.log_odds(p.features()))
        assert all(kept[p.parents[i]] for i in range(1, len(kept)) if kept[i])


def test_pages(spark, trees):
    html = '<body><nav><ul><li><a href="/">Home page</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  line\nof text, with <b>bold</b> words.<br>More of it here.<p>Second block, of some words.</article><div class="comments"><div class="comment"><p>I like it, very much.</p></div></div><footer>&copy; me</footer>'
    rows = [(1, "u", html, 1), (2, None, None, 1), (3, "u", "", 1), (None, "u", "<<>&", 1), (1, "u", html, 1)]
    d = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), trees)
    got = [r["text"] for r in d.collect()]
    assert got[0] == got[4] == "A & B\n\nFirst line of text, with bold words. More of it here.\n\nSecond block, of some words." and got[1] == got[2] == ""


PLAIN = "The council met on Tuesday evening, and it decided to repair the old bridge. Work begins in May. " * 6


@pytest.mark.parametrize(("html", "want"), [
    (PLAIN, [PLAIN]), (f"{PLAIN}<p>{PLAIN}</p>{PLAIN}", [PLAIN] * 3), (f"<p>{PLAIN}</p>{PLAIN}", [PLAIN] * 2),
    (f"<html><head><title>t</title><meta charset=x><article><p>{PLAIN}</p></article>", [PLAIN]), (f"<head><title>t</title>{PLAIN}", [PLAIN]),
    (f"<html><body><article><p>{PLAIN}</p></article></body></html>{PLAIN}", [PLAIN] * 2)])
def test_pages_without_body_or_head_end(trees, html, want):
    p = Page(html)
    seen = [t for i, t in p.flow if t and t.strip() and i and not p.hidden[i]]
    assert seen == want
    assert html_extract.extract_texts(trees, [html]) == ["\n\n".join(" ".join(t.split()) for t in want)]


def test_language(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "12 .", "en", 1), (3, "the house and the garden", "en", 1), (4, "das Haus und der Garten", "de", 1), (5, "the tree and the bird", None, 1), (None, "der Baum und das Tier", None, 1)], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[5][0] in ("en", "de") and all(0 <= s <= 1 for _, s in got.values())
    assert sorted(r["doc_id"] or 0 for r in language.keep_identified(docs).collect()) == [0, 3, 4, 5]
    assert language.identify(docs.limit(0)).count() == 0
    nothing = language.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_sample_is_bounded(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(language, "fit", lambda rows, *_: taken.append([lang for lang, _ in rows]))
    docs = spark.range(900).selectExpr("if(id < 600, null, 7) doc_id", "if(id % 3 = 0, 'same words', concat('the house ', id)) text", "if(id % 2 = 0, 'en', 'de') lang")
    language.train(docs, sample=100)
    assert taken[0].count("en") == taken[0].count("de") == 100


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    rows = [r for r in language.op2_language(spark, SMALL).collect() if r["held_out"]]
    assert len(rows) > 20 and sum(lang[r["doc_id"]] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_a_dirty_language_column_and_long_texts(spark):
    from tidemark.llm import language

    docs = spark.range(3000).selectExpr("id as doc_id", "concat('some words of text ', id) as text", "case when id % 3 = 0 then 'en' else concat('lang', id) end as lang")
    rows = language.identify(docs).collect()
    assert len(rows) == 3000 and len({r["lang_pred"] for r in rows}) <= language.LANGUAGES
    words = [" ".join(f"w{i * 7919 % 4001}é" for i in range(150_000)), "short", None, "x" * 3]
    bits, letters = language.presence(words)
    apart = [language.presence([w])[0][0] for w in words]
    assert (bits == apart).all() and letters.tolist() == [True, True, False, True]


def test_presence_in_chunks_is_presence_at_once(monkeypatch):
    from tidemark.llm import language

    texts = ["the quick brown fox", "", None, "jumps over the lazy dog " * 9, "a", "çé"]
    want = language.presence(texts)[0]
    monkeypatch.setattr(language, "CHUNK", 7)
    assert (language.presence(texts)[0] == want).all()
