"""Classifiers on held-out rows and awkward inputs, page extraction, the pipeline, and the queries
without SQL against brute force."""

import hashlib
import random
import re
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import language_id, main_text, quality, queries, toxicity
from shelfspark.llm.common import in_part, prepared, table
from test_text_operators import AWKWARD, DOCS, brute_components, brute_hits, brute_removed

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ready(spark):
    return prepared(spark)


def held_out(ready, name, label):
    rows = (queries.QUERIES[name](ready, FOLDER.replace("0.001", "0.01"))
            .join(table(ready, FOLDER.replace("0.001", "0.01"), "labels"), "doc_id").where("held_out").select("score", label).collect())
    ones = [r[0] for r in rows if r[1] == 1]
    zeros = [r[0] for r in rows if r[1] == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


# --- toxicity ------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def toxic_model(ready):
    random.seed(6)
    plain = "the house by river was quiet and people walked along its banks with their dogs until evening came".split()
    rows, labels = [], []
    for i in range(400):
        words = random.choices(plain, k=40)
        toxic = i % 4 == 0
        if toxic:
            words[random.randrange(40)] = random.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = ready.createDataFrame(rows, DOCS)
    return toxicity.train(docs, ready.createDataFrame(labels + labels[:3], "doc_id long, toxic int"))


@pytest.mark.parametrize("word", ["idiot", "IDIOT", "1d10t", "i d i o t", "i.d.i.o.t", "iiidiooot", "m0r0n", "m-o-r-o-n", "$cum"])
def test_restored_words_are_scored(toxic_model, word):
    texts = pa.array([f"the people by the river {word} walked along", "the people by the river walked along", None, ""])
    found = toxic_model.score(texts)
    assert found[0] > 0.5 and (found[1:] < 0.3).all() and found[2] == found[3]


def test_plain_text_is_left_alone(toxic_model):
    for text in ["The people walked.", "In 1984 it was so.", "", "Ça va très bien!"]:
        assert toxic_model.restorer.text(text) == text


def test_vectorised_screening_misses_no_span():
    random.seed(3)
    for _ in range(3000):
        text = "".join(random.choice("abc  .-_*01@$!|é€£\n") for _ in range(random.randrange(24)))
        if toxicity.SPACED.search(text) or toxicity.MIXED.search(text):
            raw = np.frombuffer(text.encode(), np.uint8)
            assert len(raw) < 3 or toxicity.suspicious(raw, np.array([0, len(raw)]))[0], repr(text)


def test_toxic_rows_go_and_columns_stay(ready, toxic_model):
    docs = ready.createDataFrame([(k, t, 9.0) for k, t in AWKWARD] + [(77, "you idiot", None)], DOCS + ", score double")
    kept = toxicity.without_toxic(docs, toxic_model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, _ in AWKWARD}
    assert toxicity.restore_texts(docs.where("doc_id = 77").withColumn("text", F.lit("1d10t")), toxic_model).collect()[0]["restored"] == "idiot"
    none = toxicity.train(docs, ready.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.where("false"), toxic_model).count() == 0


def test_toxicity_held_out(ready):
    assert held_out(ready, "op7_toxicity", "toxic") > 0.7


# --- quality -------------------------------------------------------------------------------------

def test_quality_held_out(ready):
    assert held_out(ready, "op5_quality", "quality") > 0.85


def test_quality_of_awkward_rows(ready):
    docs = ready.createDataFrame(AWKWARD, DOCS).withColumn("score", F.lit("mine"))
    none = quality.train(docs, ready.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    few = quality.train(docs, ready.createDataFrame([(1, 0), (7, 1), (7, 1), (8, None)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, few).collect()}
    assert all(0 <= x <= 1 for x in got.values()) and got[1] == got[2] and got[4] == got[5]
    assert quality.score(docs.where("false"), few).count() == 0


def test_word_vectors_sum_over_all_neighbours(ready):
    texts = ["a b a", "b", None, "a b"]
    data = [(i, t) for i, t in enumerate(texts)]
    vectors = quality.word_vectors(ready.createDataFrame(data, DOCS).repartition(3))
    _, slot, _ = quality.tokens(np.frombuffer(b"a b", np.uint8), np.array([0, 3]))
    def index(s):
        v = np.zeros(quality.SIZE)
        np.add.at(v, quality.PLACES[s], quality.SIGNS[s])
        return v
    want = 3 * index(slot[1])       # a stands beside b three times
    assert np.allclose(vectors[slot[0]], want / max(np.linalg.norm(want), 1))


# --- languages -----------------------------------------------------------------------------------

def test_language_held_out(ready):
    folder = FOLDER.replace("0.001", "0.01")
    rows = queries.QUERIES["op1_language_id"](ready, folder).join(table(ready, folder, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.9


def test_language_of_awkward_rows(ready):
    english, german = "the people of the river and their houses ", "die Häuser der Leute am Fluss und ihre "
    rows = [(i, (english if i % 2 else german) * (1 + i % 7), "en" if i % 2 else "de") for i in range(60)]
    network = language_id.fit(ready.createDataFrame(rows + [(99, "x", None), (98, None, "en")], DOCS + ", lang string"))
    assert network.languages == ["de", "en"]
    docs = ready.createDataFrame(AWKWARD + [(20, english * 3000), (21, "123 !?"), (22, "÷×"), (23, german)], DOCS).withColumn("lang_pred", F.lit(1))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, network).collect()}
    assert {k for k, v in got.items() if v == ("und", 0.0)} == {1, 2, 3, 21, 22}
    assert got[20][0] == "en" and got[23][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    nothing = language_id.fit(ready.createDataFrame([], DOCS + ", lang string"))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_windows_cover_the_text():
    for n in (0, 1, 191, 192, 193, 400, 5000):
        data = (np.arange(n) % 251 + 1).astype(np.uint8)
        windows, doc = language_id.cut_windows(data, np.array([0, 0, n]))
        rebuilt = b"".join(w[:language_id.STEP].tobytes() for w in windows[:-1]) + (windows[-1].tobytes().rstrip(b"\0") if n else b"")
        assert rebuilt == data.tobytes() and set(doc.tolist()) <= {1}


# --- pages ---------------------------------------------------------------------------------------

BODY = ["A first long sentence of the story, which goes on.", "Short.", "Another <em>long</em> sentence &amp; more,\n with  breaks<br>and parts."]
WANT = "Heading A first long sentence of the story, which goes on. Short. Another long sentence & more, with breaks and parts."


@pytest.mark.parametrize("page", [
    "<nav><ul><li><a href=x>One</a></li><li>Two</li></ul></nav><article><h1>Heading</h1>{}</article><footer>&copy; us, all rights.</footer>",
    "<body><header>Site name</header><div class='menu top'>Menu</div><div id=content><h1>Heading</h1>{}</div><div class=\"comments\"><p>A reader's long comment, with a lot of words in it.</p></div>",
    "<body><main><h1>Heading</h1>{}<aside><p>Aside, with some words in it.</p></aside><div class=ad>Buy this now, it is cheap.</div></main><script>var x='<p>no</p>';</script>",
    "<title>No</title><style>p{{}}</style><body><div class='cookie-notice'>We use cookies, as you know.</div><h1>Heading</h1>{}<form><p>Your name, please.</p></form>",
])
def test_main_text(page):
    assert main_text.main_text(page.format("".join(f"<p>{p}</p>" for p in BODY))) == WANT
    assert main_text.main_text(page.format("".join(f"<p>{p}" for p in BODY))) == WANT


SENTENCES = [f"Paragraph {k} of a long story, with a clause, goes on until it ends here." for k in range(11)]
LAST = "The last paragraph of the story, in a section of its own, goes on to the end."


@pytest.mark.parametrize("page", [
    "<body><div class=top><a href=x>Home</a> <a href=y>About</a></div><article>{}</article><div class=end><a href=z>Imprint</a></div>",
    "<body><div class=top><a href=x>Home</a> <a href=y>About</a></div><main><div>{}</div></main><div class=end>Made by us</div>",
    "<body><div class=top><a href=x>Home</a> <a href=y>About</a></div><div id=story>{}</div><div class=end>Made by us</div>",
    "<body><div class=top><a href=x>Home</a> <a href=y>About</a></div>{}<div class=end><a href=z>Imprint</a></div>",
])
def test_small_parts_of_an_article_stay(page):
    first = "<section>" + "".join(f"<p>{x}</p>" for x in SENTENCES) + "</section>"
    table = "<table><tr><td>Cell</td><td>12</td></tr></table><dl><dt>Term</dt><dd>Meaning</dd></dl><figure><figcaption>Caption</figcaption></figure>"
    want = " ".join([*SENTENCES, "Cell 12 Term Meaning Caption", LAST])
    assert main_text.main_text(page.format(f"{first}{table}<section><p>{LAST}</p></section>")) == want


def test_content_beside_an_article_stays():
    first = "".join(f"<p>{x}</p>" for x in SENTENCES)
    page = f"<body><div class=top>Home</div><article><div>{first}</div></article><div class=more><p>{LAST}</p></div>"
    assert main_text.main_text(page) == " ".join([*SENTENCES, LAST])


@pytest.mark.parametrize("page", [
    "<div class='content no-sidebar'><article>{}</article></div>",
    "<div class='has-sidebar'><div>{}</div></div><div class=sidebar><p>Beside it, some words.</p></div>",
    "<div class='layout with-sidebar'><main>{}</main><div class=sidebar><p>Beside it, some words.</p></div></div>",
    "<div id='main has-footer'>{}</div><div class=footer>Made by us.</div>",
    "<div class='layout sidebar-right'><article>{}</article></div><div id=masthead><h1>Our site</h1></div>",
    "<div class=logo><h1>Our site</h1></div><div class='page sidebar-left'><article>{}</article></div>",
    "<div class='search-page'><div>{}</div></div><div class=end>Made by us</div>",
    "<form id=page><div class=menu>Menu</div><article>{}</article><div class=comments><article><p>A reader's comment, with words.</p></article></div></form>",
    "<form id=page><div>{}</div><div class=share>Share this, please.</div></form>",
    "<article>{}</article><div class='comments'><article><h1>Comments</h1><p>A reader's comment, with words.</p></article></div>",
    "<article>{}</article><div class='sidebar'><h1>About us</h1><p>Beside it, some words.</p></div><form><p>Your name, please.</p></form>",
])
def test_layouts_named_for_what_lies_beside_them(page):
    story = "".join(f"<p>{x}</p>" for x in SENTENCES)
    assert main_text.main_text("<body>" + page.format(story)) == " ".join(SENTENCES)
    assert main_text.main_text("<body>" + page.format("<h1>Title</h1>" + story)) == " ".join(["Title", *SENTENCES])


def test_main_text_of_awkward_pages(ready):
    pages = [(1, None), (2, ""), (3, "<"), (4, "<p>cut off in a ta<g"), (5, "no tags at all, only text"), (6, "<script>x"), (7, "<p>" * 300 + "deep, text."),
             (8, "<p>&lt;b&gt; &#128512; &nbsp;x &bogus;</p>"), (9, "<div><p>a, b.</p>" * 3000)]
    df = ready.createDataFrame([(k, h, "u") for k, h in pages], "page_id long, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in main_text.extract(df).collect()}
    assert [got[k][0] for k in (1, 2, 6)] == ["", "", ""] and got[5][0] == "no tags at all, only text" and got[8][0] == "<b> 😀 x &bogus;"
    assert got[9][0] == " ".join(["a, b."] * 3000) and all(n == len(t) for t, n in got.values())
    assert main_text.extract(df.where("false")).count() == 0


def test_pages_of_the_fixture_give_their_articles(ready):
    pages = table(ready, FOLDER, "pages").collect()
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op9_main_text"](ready, FOLDER).collect()}
    for row in pages:
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        assert got[row["page_id"]] == " ".join(unescape(re.sub("<[^>]*>", " ", article)).split())


# --- queries without SQL, and the pipeline -------------------------------------------------------

def test_counts_and_pieces_of_the_fixture(ready):
    import public_tokenizers
    import tokenizers
    docs = {r["doc_id"]: r["text"] for r in table(ready, FOLDER, "documents").collect()}
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in queries.QUERIES["op2_token_counts"](ready, FOLDER).collect():
        n = len(library.encode(docs[r["doc_id"]], add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 2048)
    for r in queries.QUERIES["op10_pieces"](ready, FOLDER).collect():
        assert r["round_trip"] and r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_fingerprints_of_the_fixture(ready):
    docs = sorted(((r["doc_id"], r["text"]) for r in table(ready, FOLDER, "documents").collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_fingerprints"](ready, FOLDER).collect()}
    assert len(got) == len(docs)
    for n, (key, text) in enumerate(docs):
        third = len(text) // 3
        edited = text[:len(text) - third] + docs[(n + 1) % len(docs)][1][:third]
        assert got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[key]["n_chars"] == len(text)


def test_pipeline_stage_by_stage(ready):
    docs = table(ready, FOLDER, "documents")
    items = [(r["item_id"], r["text"]) for r in table(ready, FOLDER, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(ready, docs, FOLDER)
        after = {r["doc_id"]: r for r in out.collect()}
        pairs = [(k, r["text"]) for k, r in before.items()]
        if name != "piece_encoding":
            assert out.columns == docs.columns
        if name == "toxicity":
            scored = toxicity.score(docs, toxicity.train(docs, table(ready, FOLDER, "labels"), learn=~in_part(2, 4)))
            assert set(after) == {r["doc_id"] for r in scored.where("score < 0.3").collect()}
        elif name == "minhash_near_dedup":
            assert set(after) == {k for k, (_, c) in brute_components(pairs).items() if k == c}
        elif name == "suffix_array_dedup":
            assert set(after) == set(before)
            for k, (size, removed, _, digest) in brute_removed(pairs, 200).items():
                assert after[k]["n_chars"] == len(after[k]["text"])
                assert removed == 0 or size - removed - 6 <= len(after[k]["text"].encode()) <= size - removed
        elif name == "benchmark_decontamination":
            assert set(after) == {k for k, t in pairs if not brute_hits(t, items, 10)[1]}
        else:
            assert set(after) == set(before) and all(r["round_trip"] and r["n_tokens"] == len(r["tokens"]) for r in after.values())
        docs = ready.createDataFrame(out.collect(), out.schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(ready, FOLDER).collect()) == sorted(after)


def test_pipeline_on_rows_with_nulls(ready):
    rows = [(k, t, None, None, None) for k, t in AWKWARD if k is not None]
    docs = ready.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(ready, docs, FOLDER)
        assert stage(ready, docs.where("false"), FOLDER).count() == 0
    assert 1 in {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("piece", ["<b>x ", "<font>x ", "<ul><li>x ", "<div>x, y. ", "<p>x</i>", "<table><tr><td>x ", "</zz>x<b>"])
def test_deep_nesting_is_read_in_linear_time(piece):
    """200,000 unclosed elements cost about ten times as much as 20,000."""
    import time

    def spent(n):
        begin = time.process_time()
        main_text.main_text(piece * n)
        return time.process_time() - begin
    spent(2_000)
    short, long = spent(20_000), spent(200_000)
    assert long < 30 * short + 0.5 and long < 15
