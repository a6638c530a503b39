"""Collocations, archives and tokenizer alignment against brute force, on small and awkward inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from shelfspark.llm import alignment, archives, collocations
from shelfspark.llm.common import prepared
from shelfspark.session import scratch

AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "é" * 300), (7, "word " * 5000), (None, "lost key"), (8, "🎉 ▁ \x00 x")]


@pytest.fixture(scope="module")
def ready(spark):
    return prepared(spark)


# --- collocations --------------------------------------------------------------------------------

def brute_collocations(rows, least, places):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                counts[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if a >= least}
        covered = {(q, a) for p, a in kept.items() if len(p) > 2 for q in (p[1:], p[:-1])}
        scored = []
        for p, a in kept.items():
            if len(p) > 1 and (p, a) not in covered:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:places], 1)]
    return sorted(out)


def made_texts(seed, n):
    rng = random.Random(seed)
    words = ["la", "LA", "mer", "Été", "x" * 70, "to", "be", "or", "not", "a", "b", "ß", "🎉"] + [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(0, 60)):
            text.append(rng.choices(words, weights)[0] if rng.random() < 0.8 else "new york city hall")
            text.append(rng.choice([" ", "  ", "\t", " ", " ", ", ", ".\n", "!x "]))
        rows.append((rng.choice(["en", "fr", None, "und"]), "".join(text)))
    return rows + [("en", None), ("de", ""), ("xx", "  . , "), ("en", "la " * 400)]


@pytest.mark.parametrize("least,places", [(3, 5), (2, 40), (3, 2000)])
def test_collocations_equal_brute_force(ready, least, places):
    rows = made_texts(least * places, 250)
    df = ready.createDataFrame(rows, "lang string, text string").withColumn("rank", F.lit(7)).withColumn("phrase", F.lit("x"))
    got = sorted(tuple(r) for r in collocations.collocations(df, least=least, places=places).collect())
    assert got == brute_collocations(rows, least, places)


def test_collocations_stop_before_common_words(ready, monkeypatch):
    """With many good phrases of rare words the frontier ends early, and the result is the same."""
    rng = random.Random(5)
    rows = [("en", " ".join(f"a{i} b{i}" if rng.random() < 0.5 else "the of" for i in rng.sample(range(60), 20))) for _ in range(300)]
    rounds = []
    grown = collocations._grown
    monkeypatch.setattr(collocations, "_grown", lambda *a: (rounds.append(1), grown(*a)))
    df = ready.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in collocations.collocations(df, least=5, places=10).collect())
    assert got == brute_collocations(rows, 5, 10) and len(rounds) < len(collocations.SHARES)


def test_collocations_of_full_tables(ready, monkeypatch):
    """Word flags and phrase sets of a few slots let everything through and lose nothing."""
    monkeypatch.setattr(collocations, "SLOTS", 4)
    monkeypatch.setattr(collocations, "BITS", 64)
    rows = made_texts(1, 120)
    df = ready.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in collocations.collocations(df, least=3, places=30).collect())
    assert got == brute_collocations(rows, 3, 30)


def test_collocations_of_nothing(ready):
    assert collocations.collocations(ready.createDataFrame([], "lang string, text string")).collect() == []


# --- archives ------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "x" * 200


def made_pages():
    rng = random.Random(3)
    rows = [(i, f"http://e/{i}", LONG if rng.random() < 0.4 else rng.choice(["", None, "short", "é" * 60, f"page {i} " * rng.randrange(1, 3000)])) for i in range(300)]
    return rows + [(1000, None, LONG), (1001, "http://e/\r\nX: y", "own " * 40), (None, "u", LONG), (None, "u", "lone " * 60)]


def test_archives_give_every_record_back(ready):
    rows = made_pages()
    folder = scratch(ready, "test-archives")
    df = ready.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)).withColumn("key", F.lit("x")).repartition(3)
    index = archives.write_archives(df, folder)
    back = archives.read_archives(index).collect()
    assert len(back) == len(rows) == index.count()
    text = {r.record_id: (r.payload.decode(), r.key) for r in back if r.record_type == "response"}
    first = {}
    for key, _, html in rows:
        size = len((html or "").encode())
        if size >= 100 and key is not None:
            first[html] = min(key, first.get(html, key))
    got = Counter()
    for r in back:
        payload, holder = text[r.refers_id] if r.record_type == "revisit" else (r.payload.decode(), None)
        assert hashlib.sha256(payload.encode()).hexdigest() == r.digest
        got[(r.key, payload, holder)] += 1
    want = Counter((None if k is None else str(k), h or "", str(first[h]) if h in first and first[h] != k else None) for k, _, h in rows)
    assert got == want
    assert {r.url for r in back if r.key == "1001"} == {"http://e/%0D%0AX: y"}


def test_archive_lookup_opens_frames_by_the_seek_table(ready):
    rows = [(i, "u", f"text {i} " * 200) for i in range(60)]
    folder = scratch(ready, "test-archives")
    index = archives.write_archives(ready.createDataFrame(rows, PAGES).repartition(2), folder, frame=1 << 12)
    assert index.agg(F.max("frame")).first()[0] > 5
    some = archives.record_id(hashlib.sha256(rows[41][2].encode()).hexdigest(), "41")
    found = archives.lookup(index, ready.createDataFrame([(some,), (some,), ("none",)], "record_id string")).collect()
    assert [(r.key, r.payload.decode()) for r in found] == [("41", rows[41][2])]
    path = index.where(F.col("record_id") == some).first()
    reader = archives.Reader(path.bundle)
    fields, _ = archives.parsed(reader.frame(path.frame)[path.offset:path.offset + path.length])
    assert fields["warc-record-id"] == some
    import zstandard
    with open(path.bundle.removeprefix("file:"), "rb") as file:     # a plain reader sees one stream of records
        whole = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\n") and whole.count(b"WARC-Type: response") >= 1


def test_archives_of_equal_rows(ready):
    rows = [(5, "u", LONG)] * 3 + [(7, "v", LONG), (None, "w", LONG + "y"), (None, "w", LONG + "y")]
    folder = scratch(ready, "test-archives")
    back = archives.read_archives(archives.write_archives(ready.createDataFrame(rows, PAGES), folder)).collect()
    kinds = Counter((r.key, r.record_type) for r in back)
    assert kinds == {("5", "response"): 1, ("5", "revisit"): 2, ("7", "revisit"): 1, (None, "response"): 1, (None, "revisit"): 1}
    responses = {r.record_id for r in back if r.record_type == "response"}
    assert all(r.refers_id in responses for r in back if r.record_type == "revisit")


def test_archives_sweep_and_nothing(ready):
    import os
    folder = scratch(ready, "test-archives")
    index = archives.write_archives(ready.createDataFrame([(1, "u", "x")], PAGES), folder)
    lost = folder.removeprefix("file:") + "/bundles/lost.warc.zst"
    with open(lost, "wb") as file:
        file.write(b"half a frame")
    archives.sweep(folder, index)
    assert not os.path.exists(lost) and archives.read_archives(index).count() == 1
    empty = archives.write_archives(ready.createDataFrame([], PAGES), scratch(ready, "test-archives"))
    assert archives.read_archives(empty).collect() == []


# --- alignment -----------------------------------------------------------------------------------

def brute_alignment(rows):
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment._byte_letters()
    table, out = [], []
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        theirs = b.encode(text) if text else []
        parts = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids]
        others = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in theirs]
        if not text or b"".join(parts) != raw or b"".join(others) != raw:
            table.append((doc_id, [], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in (parts, others)]
        begins = [[0] + e[:-1] for e in ends]
        links = [(i, j) for x, i in enumerate(ids) for y, j in enumerate(theirs) if begins[0][x] < ends[1][y] and begins[1][y] < ends[0][x]]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = []
        for low, high in zip([0] + cuts[:-1], cuts):
            groups.append(",".join(str(i) for i, e in zip(ids, ends[0]) if low < e <= high) + "|" + ",".join(str(i) for i, e in zip(theirs, ends[1]) if low < e <= high))
        table.append((doc_id, ids, theirs, groups, links))
    count = Counter(p for *_, links in table for p in set(links))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    for doc_id, ids, theirs, groups, links in table:
        out.append((doc_id, len(ids), len(theirs), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


ODD = [(20, "Hello, world! don't stop 1234567 naïve café 日本語テキスト 한국어"), (21, "a  b   c\n\n d\te \n"), (22, "tail \n "), (23, " lead"), (24, "<|endoftext|> <s> <0x0A> </s>"),
       (25, "x y z \x1c w\x85v"), (26, "if (x) {\r\n\treturn;\r\n}"), (27, "\n\nx"), (28, " "), (29, "\n"), (30, "🎉🎉 👩‍👩‍👧"), (31, "ﬁ Å"), (32, "A" * 500), (33, "a　b c퟿"), (33, "word " * 7)]


def columns(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"run": 300, "fan": 2, "block": 3, "side": 2}])
def test_alignment_equals_brute_force(ready, sizes):
    rng = random.Random(8)
    rows = [r for r in AWKWARD if not sizes or len(r[1] or "") < 1000] + ODD + [
        (100 + i, "".join(rng.choice(["the", "sea", "l'été", "x1", "\n", "\t", " ", "  ", "...", "été", "\r\n", "(a)", "A"]) for _ in range(rng.randrange(1, 40)))) for i in range(40)]
    df = ready.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("x")).withColumn("kind", F.lit(1)).repartition(2)
    assert columns(alignment.aligned(df, **sizes)) == brute_alignment(rows)


def test_alignment_of_nothing(ready):
    assert columns(alignment.aligned(ready.createDataFrame([], "doc_id string, text string"))) == []
    only = alignment.aligned(ready.createDataFrame([("a", None), (None, "")], "doc_id string, text string"))
    assert columns(only) == [("a", 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_blobs_round_trip():
    arrays = [np.array([], np.int64), np.array([0, 255]), np.array([70_000, 3]), np.array([1 << 40])]
    assert [x.tolist() for x in alignment.unpack(alignment.pack(*arrays))] == [x.tolist() for x in arrays]
    pairs = np.array([5, (1 << 32) | 3, (1 << 32) | 900_000, (7 << 32)], np.int64)
    got, n = alignment.unpack_pairs(alignment.pack_pairs(pairs, np.arange(4)))
    assert got.tolist() == pairs.tolist() and n.tolist() == [0, 1, 2, 3]


def test_merge_of_overlapping_blocks():
    rng = np.random.default_rng(1)
    blocks, want = [], Counter()
    for _ in range(30):
        keys = np.unique(rng.integers(0, 60, 25))
        for k in range(0, len(keys), 2):
            blocks.append((keys[k:k + 2].astype(np.int64), rng.integers(1, 9, len(keys[k:k + 2]))))
    for keys, counts in blocks:
        want.update(dict(zip(keys.tolist(), counts.tolist())))
    merge, got = alignment.Merge(waiting=16), []
    for keys, counts in sorted(blocks, key=lambda b: int(b[0][0])):
        done = merge.add(keys, counts)
        got += list(zip(*(x.tolist() for x in done))) if done else []
    got += list(zip(*(x.tolist() for x in merge.below(None))))
    assert got == sorted(want.items())
