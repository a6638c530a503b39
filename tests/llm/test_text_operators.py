"""Operators on training text against brute force, on small and awkward inputs."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import decontamination, fingerprints, minhash, pieces, suffix_dedup, token_counts
from shelfspark.llm.common import Words, blocks, merged, prepared, runs, text_bytes

DOCS = "doc_id long, text string"
AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "é" * 300), (7, "word " * 5000), (None, "lost key"), (8, "🎉 ▁ \x00 x")]


@pytest.fixture(scope="module")
def ready(spark):
    return prepared(spark)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- shared helpers ------------------------------------------------------------------------------

def test_words_and_runs():
    column = pa.array(["a b  c", None, "", "Abc é\n", " x"])
    data, offsets = text_bytes(column)
    words = Words(data, offsets, minhash.KIND)
    assert [bytes(data[s:e]) for s, e in zip(words.start, words.end)] == [b"a", b"b", b"c", b"Abc", "é".encode(), b"x"]
    assert words.doc.tolist() == [0, 0, 0, 3, 3, 4] and words.at.tolist() == [0, 3, 3, 3, 5, 6]
    same = Words(*text_bytes(pa.array(["abc ABC"])), minhash.KIND)
    assert same.hash[0] == same.hash[1]
    values = np.arange(12, dtype=np.uint64)
    assert len(runs(values, 5)) == 8 and len(runs(values[:4], 5)) == 0
    assert runs(values, 5)[3] == runs(values[3:8], 5)[0]


def test_blocks_cover_every_document_once():
    sizes = [0, 10, 0, 700, 3, 3, 3, 0]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    assert [i for a, b in blocks(offsets, 16) for i in range(a, b)] == list(range(len(sizes)))


def test_merged_intervals():
    begin, stop = merged(np.array([5, 0, 3, 20]), np.array([7, 3, 4, 30]))
    assert list(zip(begin.tolist(), stop.tolist())) == [(0, 4), (5, 7), (20, 30)]


# --- decontamination -----------------------------------------------------------------------------

def brute_hits(text, items, n):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower() if (text or "").isascii() else "".join(c.lower() if c < "\x80" else c for c in text))
    hit, found = set(), set()
    for item, other in items:
        theirs = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in other or ""))
        width = min(n, len(theirs))
        for i in range(len(theirs) - width + 1 if width else 0):
            for k in range(len(words) - width + 1):
                if words[k:k + width] == theirs[i:i + width]:
                    hit |= set(range(k, k + width))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_contamination(ready, block):
    items = [(10, "a b c d e f g"), (11, "Short, one!"), (12, None), (13, "..."), (14, "a b c d e f g"), (15, "é à ü ö ß")]
    docs = [(1, "x a B, c d e f g y"), (2, "short one short one"), (3, "a b c"), (4, "zz é à ü ö ß zz"), (5, "a b c d x b c d e"), *[(k, t) for k, t in AWKWARD if k not in (1, 2, 3, 4, 5)]]
    docs_df, bench = ready.createDataFrame(docs, DOCS), ready.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.contamination(docs_df, bench, n=4, block_bytes=block).collect()}
    for key, text in docs:
        n_words, n_hit, found = brute_hits(text, items, 4)
        row = got[key]
        assert (row["n_words"], sum(s["last"] - s["first"] for s in row["spans"]), sorted(row["items"])) == (n_words, n_hit, found), text
    kept = decontamination.without_contaminated(docs_df.withColumn("items", F.lit("mine")), bench, n=4, block_bytes=block)
    assert kept.columns == ["doc_id", "text", "items"]
    assert {r["doc_id"] for r in kept.collect()} == {k for k, t in docs if not brute_hits(t, items, 4)[1]}
    cut = {r["doc_id"]: r["text"] for r in decontamination.without_spans(docs_df, bench, n=4, block_bytes=block).where("doc_id < 6").collect()}
    assert cut == {1: "x  y", 2: "", 3: "a b c", 4: "zz  zz", 5: " x "}


def test_contamination_of_repeated_and_null_ids_whatever_the_benchmark_size(ready):
    rows = [(None, "one two three four five six"), (None, "nothing of it here"), (None, None), (7, "zero five six seven eight zero"), (7, "zero five six seven eight zero"),
            (8, "one two three four nine ten eleven twelve four five six seven x"), (9, "three four five six seven eight")]
    items = [("a", "one two three four"), ("b", "five six seven eight"), ("c", "three four five six"), ("d", "two three four five"),
             ("e", "nine ten eleven twelve"), ("f", "four five six seven"), ("g", None)]
    docs, bench = ready.createDataFrame(rows, DOCS), ready.createDataFrame(items, "item_id string, text string")
    whole, parts = (sorted(map(repr, decontamination.contamination(docs, bench, n=4, block_bytes=size).collect())) for size in (1 << 20, 1))
    assert len(whole) == len(rows) and whole == parts


def test_contamination_without_rows(ready):
    empty = ready.createDataFrame([], "item_id long, text string")
    docs = ready.createDataFrame([(1, "a b c")], DOCS)
    assert decontamination.contamination(docs, empty).collect()[0]["items"] == []
    assert decontamination.contamination(docs.where("false"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


# --- pieces --------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    return pieces.Vocabulary(public_tokenizers.path(pieces.MODEL))


def as_ids(raw):
    return np.frombuffer(raw, np.int32).tolist()


def test_double_array_finds_what_was_put_in():
    strings = {s.encode(): i for i, s in enumerate(["a", "ab", "abc", "b", "é", "bcd"])}
    trie = pieces.DoubleArray(strings)

    def look(string):
        node = 0
        for byte in string:
            step = trie.base[node] + byte
            if trie.check[step] != node:
                return -1
            node = step
        return trie.value[node]
    assert [look(s) for s in strings] == list(range(6))
    assert [look(s) for s in (b"c", b"abd", b"bc", b"\xc3", b"")] == [-1] * 5


def test_pieces_round_trip_and_best_score(vocabulary):
    random.seed(3)
    alphabet = "abcde  \n\tthe▁é🎉$1長\x00"
    texts = ["".join(random.choice(alphabet) for _ in range(n)) for n in (0, 1, 2, 5, 30, 80, 300)] + ["the " * 40 + "x" * 200, "  two  blanks "]
    for text, raw in zip(texts, pieces.encode_texts(vocabulary, texts)):
        ids = as_ids(raw)
        assert pieces.decode_ids(vocabulary, ids) == text
        if pieces.MARK not in text:     # the whole text searched as one unit
            whole = as_ids(vocabulary.single((" " + text).encode())) if text else []
            assert abs(score_of(vocabulary, ids) - score_of(vocabulary, whole)) < 1e-6


def score_of(vocabulary, ids):
    total, i = 0.0, 0
    raw = set(vocabulary.fallback.tolist())
    while i < len(ids):
        if ids[i] in raw:
            lead = vocabulary.bytes_of[ids[i]][0]
            total, i = total + vocabulary.unknown, i + (1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4)
        else:
            total, i = total + vocabulary.score[ids[i]], i + 1
    return total


def test_pieces_equal_the_library_on_the_same_scores(vocabulary):
    import public_tokenizers
    import sentencepiece
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    with open(public_tokenizers.path(pieces.MODEL), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        if piece.type == 1:
            piece.score = float(vocabulary.score[i])
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ["Of the people, by the people.", "ein Satz über Äpfel", "mañana será otro día", "x" * 30, "梦想のは 🎉"]:
        ids = as_ids(pieces.encode_texts(vocabulary, [text])[0])
        assert abs(score_of(vocabulary, ids) - score_of(vocabulary, library.encode(text))) < 1e-3


def test_pieces_of_awkward_rows(ready):
    docs = ready.createDataFrame([(k, t, "mine") for k, t in AWKWARD], DOCS + ", tokens string")
    rows = pieces.decode(pieces.encode(docs)).collect()
    assert all(r["text"] == r["decoded"] for r in rows) and len(rows) == len(AWKWARD)
    assert [r["tokens"] for r in rows if r["text"] is None] == [None] and [r["tokens"] for r in rows if r["text"] == ""] == [[]]
    assert pieces.encode(docs.where("false")).count() == 0


# --- near-duplicates -----------------------------------------------------------------------------

def brute_components(docs, width=5):
    sets = {}
    for key, text in docs:
        words = words_of(text)
        sets[key] = {tuple(words[i:i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


def near_copies():
    random.seed(11)
    docs, key = [], 100
    for _ in range(12):
        base = [f"w{random.randrange(5000)}" for _ in range(random.choice([3, 20, 90]))]
        for _ in range(random.choice([1, 4, 9])):
            own = list(base)
            for _ in range(random.randrange(4)):
                own[random.randrange(len(own))] = f"v{random.randrange(5000)}"
            docs.append((key, " ".join(own)))
            key += 1
    chain = [f"c{i}" for i in range(80)]        # links only between neighbours in the chain
    for step in range(12):
        docs.append((key, " ".join(chain[step * 3:] + [f"d{i}" for i in range(step * 3)])))
        key += 1
    return docs + [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three four five"), (7, "x " * 3000)]


def test_near_duplicates(ready):
    docs = near_copies()
    random.shuffle(docs)
    df = ready.createDataFrame(docs, DOCS).withColumn("component_id", F.lit("mine"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    want = brute_components(docs)
    assert got == want
    kept = minhash.without_near_duplicates(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, (_, c) in want.items() if k == c}
    assert minhash.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [3, 40])
def test_second_comparison_finds_links_between_components(n):
    """Outsiders against all others, by the full sets; one link for two components."""
    random.seed(n)
    sets = [np.array(sorted(random.sample(range(12), random.randrange(8, 12)))) for _ in range(n)]
    outside = np.array([i % 3 == 0 for i in range(n)])
    component = np.array([i if i % 3 == 0 else 1000 + i % 2 for i in range(n)])
    links = minhash.cross_links(outside, component, sets, 75)
    joined = {c: c for c in component.tolist()}

    def merge(pairs):
        for i, j in pairs:
            x, y = joined[component[i]], joined[component[j]]
            joined.update({c: min(x, y) for c, v in joined.items() if v in (x, y)})
        return dict(joined)
    got = merge(links)
    near = lambda a, b: 100 * len(set(a) & set(b)) >= 75 * len(set(a) | set(b))      # noqa: E731
    assert all(outside[i] and not outside[j] and near(sets[i], sets[j]) for i, j in links) and len(links) < len(set(component.tolist()))
    assert merge([(i, j) for i in range(n) for j in range(n) if outside[i] and not outside[j] and near(sets[i], sets[j])]) == got


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    hashes = np.concatenate([x[:300], x[100:]])
    signed = minhash.signatures(hashes, np.array([0, 300]), 512)
    assert abs((signed[0] == signed[1]).mean() - 0.5) < 0.1


# --- repeated substrings -------------------------------------------------------------------------

def brute_removed(docs, length):
    seen, spans = {}, {}
    raws = [(k, (t or "").encode()) for k, t in docs]
    for n, (_, raw) in enumerate(raws):
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i:i + length], []).append((n, i))
    gone = [np.zeros(len(raw), bool) for _, raw in raws]
    for places in seen.values():
        if len(places) > 1:
            for n, i in places:
                gone[n][i:i + length] = True
    for n, (key, raw) in enumerate(raws):
        flags = np.concatenate([[False], gone[n], [False]])
        spans[key] = (len(raw), int(gone[n].sum()), int((np.diff(flags.astype(int)) == 1).sum()),
                      hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone[n]])).hexdigest())
    return spans


def passages():
    random.seed(4)
    rand = lambda n: "".join(random.choice("abcd é") for _ in range(n))      # noqa: E731
    shared = [rand(70) for _ in range(4)]
    docs = [(k, rand(random.randrange(80)) + random.choice(shared)[random.randrange(9):] + rand(random.randrange(80))) for k in range(60)]
    return docs + [(100, None), (101, ""), (102, "a" * 500), (103, "ab" * 200), (104, docs[0][1]), (105, shared[0])]


@pytest.mark.parametrize("hot", [2000, 3])
def test_repeated_bytes_of_rows_without_a_key_of_their_own(ready, hot):
    """Null and repeated ids, equal and different texts under them: rows are rows."""
    docs, length = passages(), 40
    ids = [None if k % 3 == 0 else k % 7 for k, _ in docs]
    df = ready.createDataFrame([(i, t) for i, (_, t) in zip(ids, docs)], DOCS).repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.removal_report(df, length=length, seed=12, hot=hot).collect()), key=str)
    want = brute_removed(docs, length)
    assert got == sorted(((i, *want[k]) for i, (k, _) in zip(ids, docs)), key=str)


@pytest.mark.parametrize("hot", [2000, 3])
def test_repeated_bytes(ready, hot):
    docs, length = passages(), 40
    df = ready.createDataFrame(docs, DOCS).withColumn("begin", F.lit("mine"))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removal_report(df, length=length, seed=12, hot=hot).collect()}
    assert got == brute_removed(docs, length)
    kept = suffix_dedup.without_repeats(df, length=length, seed=12, hot=hot)
    assert kept.columns == df.columns
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert rows[100] is None and rows[101] == "" and rows[102] == "" and len(rows) == len(docs)
    assert suffix_dedup.removal_report(df.where("false")).count() == 0


def test_long_document_is_read_in_pieces():
    random.seed(9)
    raw = bytes(random.choice(b"abcdefgh") for _ in range(700_000))
    raw += raw[300_000:300_500]
    data = np.frombuffer(raw, np.uint8)
    doc, start, more, _, _, _ = suffix_dedup.anchors(data, np.array([0, len(raw)]))
    covered = np.zeros(len(raw) - 199, int)
    for a, b in zip(start, start + more):
        covered[a:b + 1] += 1
    assert (covered >= 1).all() and set(doc.tolist()) == {0}


def test_blind_trie_orders_and_joins_equal_strings():
    random.seed(2)
    strings = [bytes(random.choice(b"ab") for _ in range(6)) for _ in range(200)]
    trie = suffix_dedup.BlindTrie()
    for n, s in enumerate(strings):
        trie.insert(s, n)
    leaves = list(trie.leaves())
    assert [s for s, _ in leaves] == sorted(set(strings))
    assert all({strings[n] for n in numbers} == {s} for s, numbers in leaves) and sum(len(n) for _, n in leaves) == 200


# --- token counts --------------------------------------------------------------------------------

TEXTS = ["", "Hello World's  it'S", "<|endoftext|> a <|ENDOFTEXT|><|startoftext|>", "É é ½ ² 123 a1b2", "İstanbul ǅ 長い文", "á   x y", "''s ''' 're", "\x00\x01"]


def test_counts_equal_the_library(ready, tmp_path):
    import public_tokenizers
    import tokenizers
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (51, TEXTS[1]), (None, "no key"), (52, "word " * 4000)]
    docs = ready.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("mine"))
    cache = str(tmp_path / "cache")
    for _ in range(2):          # the second time every content is stored
        got = {(r["doc_id"], r["n_bytes"]): r["n_tokens"] for r in token_counts.count_tokens(docs, cache).collect()}
        assert got == {(k, len((t or "").encode())): len(library.encode(t or "", add_special_tokens=False)) for k, t in rows}
        stored = ready.read.parquet(cache)
        assert stored.count() == stored.select("content").distinct().count() == len({t or "" for _, t in rows})
    assert token_counts.count_tokens(docs.where("false"), str(tmp_path / "none")).count() == 0


def test_another_tokenizer_has_its_own_entries(ready, tmp_path):
    import public_tokenizers
    docs, cache = ready.createDataFrame([(1, "Hello big  world 123")], DOCS), str(tmp_path / "cache")
    a = token_counts.count_tokens(docs, cache).collect()[0]["n_tokens"]
    b = token_counts.count_tokens(docs, cache, public_tokenizers.path("byte_bpe_50k.json")).collect()[0]["n_tokens"]
    import tokenizers
    assert b == len(tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode("Hello big  world 123", add_special_tokens=False).ids)
    assert a > 0 and ready.read.parquet(cache).select("tokenizer").distinct().count() == 2


# --- fingerprints --------------------------------------------------------------------------------

def test_fingerprints(ready):
    random.seed(8)
    vocab = [f"word{i}" for i in range(400)]
    docs = [(i, " ".join(random.choices(vocab, k=120))) for i in range(20)] + [(30, None), (31, ""), (32, "é è"), (33, docs_text := "same text here"), (34, docs_text)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(ready.createDataFrame(docs, DOCS).withColumn("side", F.lit(1))).collect()}
    order = sorted(((k, t or "") for k, t in docs), reverse=True)
    for n, (key, text) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        row = got[key]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    assert got[33]["fingerprint"] == got[34]["fingerprint"] and got[34]["near_next"] == 1.0 and got[30]["fingerprint"] == got[31]["fingerprint"]
    edits = np.mean([got[i]["near_edited"] for i in range(20)])
    assert 0.3 < edits < 0.75 and edits > np.mean([got[i]["near_next"] for i in range(1, 20)]) + 0.1


def test_fingerprints_estimate_generalised_jaccard(ready):
    random.seed(1)
    vocab = [f"term{i}" for i in range(60)]
    rows = [(i, " ".join(random.choices(vocab[i % 3 * 10:], k=200))) for i in range(12)]
    codes = {r["doc_id"]: r["codes0"] for r in fingerprints.sign(ready.createDataFrame(rows, DOCS), samples=64).collect()}
    error = []
    for i in range(12):
        for j in range(i):
            a, b = ({w: t.split().count(w) * len(w) for w in set(t.split())} for t in (rows[i][1], rows[j][1]))
            exact = sum(min(a.get(w, 0), b.get(w, 0)) for w in vocab) / sum(max(a.get(w, 0), b.get(w, 0)) for w in vocab)
            error.append(np.mean([x == y for x, y in zip(codes[i], codes[j])]) - exact)
    assert abs(np.mean(error)) < 0.05 and np.std(error) < 0.1


def test_fingerprints_of_few_rows(ready):
    one = fingerprints.fingerprints(ready.createDataFrame([(5, "abc def")], DOCS)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.fingerprints(ready.createDataFrame([], DOCS)).count() == 0
