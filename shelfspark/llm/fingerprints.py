"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a weighted set: its words, lower-cased, each weighing the characters it covers.  For
sample k every word gets r and c from Gamma(2, 1) and beta from the uniform distribution, all fixed
by a hash of (word, k); with weight w it takes ``t = floor(ln w / r + beta)`` and the value
``ln a = ln c - r (t - beta) - r``.  The word with the least value is the sample, and two documents
share sample k with a probability equal to their generalised Jaccard similarity, the sum of smaller
over the sum of larger weights.  A fingerprint is the 16-bit digest of (word, t) of each sample;
the share of equal places estimates the similarity.

Plan: documents are dealt once by id range, so that each document meets its successor, and words are
counted and sampled within that partitioning: no word is ever shuffled.

Cases: null counts as empty; a text without words is the set of one empty word, so such texts are
alike (1) and unlike all others; equal texts have equal fingerprints; equal doc_ids are ordered by
text; a table of one row is its own successor; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import query, table

SAMPLES = 32
RANGES_PER_PARTITION = 4


def _samples(word: Column, log_weights: list[Column], samples: int) -> list[Column]:
    """Per sample and weight the least value: a long that orders like ln a and carries the sample's
    digest in its low 16 bits.  One hash of (word, k) gives r, c, beta and the word's part of the
    digest; a word without weight takes no part."""
    def uniform(z, shift, bits):
        return (F.shiftrightunsigned(z, shift).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5) / float(1 << bits)
    out = []
    for k in range(samples):
        z = F.xxhash64(word, F.lit(k))
        r = -F.ln(uniform(z, 0, 14) * uniform(z, 14, 14))
        log_c = F.ln(-F.ln(uniform(z, 28, 12) * uniform(z, 40, 12)))
        beta = uniform(z, 52, 12)
        for side, log_weight in enumerate(log_weights):
            t = F.floor(log_weight / r + beta)
            log_a = log_c - r * (t - beta + 1)
            digest = F.xxhash64(z, t).bitwiseAND(F.lit(0xFFFF))
            out.append(F.min(F.shiftleft(F.floor(log_a * float(1 << 24)), 16).bitwiseOR(digest)).alias(f"s{side}_{k}"))
    return out


def _plain(text: str) -> Column:
    """White space as blanks."""
    return F.translate(text, "\t\n\x0b\x0c\r", "     ")


def signed(pieces: DataFrame, keys: list[str], sides: int, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``codes0``, ``codes1``, ...: the samples' digests of ``sides`` texts per key, given
    by rows (keys, sides: array<int> of 0 and 1, piece: string, marker: boolean): a piece belongs
    to the texts that have 1.  A marker row stands for one empty word.  If the rows are dealt by
    some of the keys already, nothing is shuffled."""
    words = (pieces.select(*keys, "sides", "marker", F.explode(F.split(F.lower(_plain("piece")), " ")).alias("word"))
             .where("word <> '' or marker"))
    length = F.greatest(F.length("word"), F.lit(1)).cast("long")
    weights = [F.sum(F.col("sides")[i] * length).alias(f"w{i}") for i in range(sides)]
    weighed = words.select(*keys, "sides", F.xxhash64("word").alias("hash"), "word").groupBy(*keys, "hash").agg(*weights)
    weighed = weighed.select(*keys, "hash", *[F.when(F.col(f"w{i}") > 0, F.ln(f"w{i}")).alias(f"w{i}") for i in range(sides)])
    found = weighed.groupBy(*keys).agg(*_samples(F.col("hash"), [F.col(f"w{i}") for i in range(sides)], samples))
    return found.select(*keys, *[F.array(*[F.col(f"s{i}_{k}").bitwiseAND(F.lit(0xFFFF)).cast("int") for k in range(samples)]).alias(f"codes{i}")
                                 for i in range(sides)])


def sign(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """key and ``codes0``, the fingerprint of ``text``; ``key`` identifies the rows."""
    whole = F.coalesce(text, F.lit(""))
    pieces = docs.select(key, F.array(F.lit(1)).alias("sides"), whole.alias("piece")).withColumn("marker", F.trim(_plain("piece")) == "")
    return signed(pieces, [key], 1, samples)


def likeness(a: str, b: str) -> Column:
    """Share of equal places of two fingerprints."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def as_text(codes: str) -> Column:
    """A fingerprint in hexadecimal, four digits a sample."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 4, "0"))), "")


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, last, doc_id, text): rows dealt to ranges of doc_id.  Each range also gets, with
    ``last`` true, a copy of the row that follows its lowest one in descending order (the highest
    of all after the lowest of all).  At most ``ranges`` bounds reach the driver."""
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []
    limits = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<long>")
    dealt = docs.select(F.size(F.filter(limits, lambda b: b < F.col("doc_id"))).alias("range"), "doc_id", "text")
    heads = sorted(tuple(r) for r in dealt.groupBy("range").agg(F.max("doc_id")).collect())
    follow = [(of, head, heads[i + 1][0] if i + 1 < len(heads) else heads[0][0]) for i, (of, head) in enumerate(heads)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    heads = docs.sparkSession.createDataFrame(follow, f"of int, head {kind}, into int")
    own = F.array(F.struct("range", F.lit(False).alias("last")))
    both = F.array(F.struct("range", F.lit(False).alias("last")), F.struct(F.col("into").alias("range"), F.lit(True).alias("last")))
    return (dealt.join(F.broadcast(heads), (F.col("of") == F.col("range")) & F.col("head").eqNullSafe(F.col("doc_id")), "left")
            .select(F.explode(F.when(F.col("into").isNull(), own).otherwise(both)).alias("at"), "doc_id", "text")
            .select("at.range", "at.last", "doc_id", "text"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per row: fingerprint of its text, of the text with its last third replaced by the beginning
    of its successor, and how alike it is to that text and to its successor."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("range").orderBy("last", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    third = F.floor(F.length("text") / 3).cast("int")
    rows = (in_ranges(docs, ranges).withColumn("next", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))
            .select("range", "place", "last", "doc_id", "text", F.substring("text", F.lit(1), F.length("text") - third).alias("head"),
                    F.when(~F.col("last"), F.substring("next", F.lit(1), third)).alias("tail")))
    # up to its last blank the head is shared by both texts, word for word
    back = F.locate(" ", F.reverse(_plain("head")))
    cut = F.when(back > 0, F.length("head") - back + 1).otherwise(0)
    piece = lambda own, other, text, marker=False: F.struct(      # noqa: E731
        F.array(F.lit(own) if isinstance(own, int) else own, F.lit(other) if isinstance(other, int) else other).alias("sides"), text.alias("piece"), F.lit(marker).alias("marker"))
    rest = F.substring("head", cut + 1, F.length("head"))
    blank = [(F.trim(_plain("text")) == "").cast("int"), F.when(F.col("last"), 0).otherwise((F.trim(_plain("head")) == "").cast("int") * (F.trim(_plain("tail")) == "").cast("int"))]
    pieces = F.concat(
        F.when(F.col("last"), F.array(piece(1, 0, F.col("text")))).otherwise(F.array(
            piece(1, 1, F.substring("head", F.lit(1), cut)), piece(1, 0, F.substring("text", cut + 1, F.length("text"))), piece(0, 1, F.concat(rest, "tail")))),
        F.when((blank[0] + blank[1]) > 0, F.array(piece(blank[0], blank[1], F.lit(""), True))).otherwise(F.array()))
    codes = signed(rows.select("range", "place", F.explode(pieces).alias("x")).select("range", "place", "x.*"), ["range", "place"], 2, samples)
    pairs = codes.select("range", "place", F.col("codes0").alias("own"), F.col("codes1").alias("other"))
    pairs = pairs.withColumn("following", F.lead("own").over(Window.partitionBy("range").orderBy("place")))
    compared = pairs.select(
        "range", "place", as_text("own").alias("fingerprint"), as_text("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"), likeness("own", "following").alias("near_next"))
    facts = rows.where("not last").select("range", "place", F.col("doc_id").alias(key), F.length("text").cast("long").alias("n_chars"),
                                          F.sha2(F.encode(F.concat("head", "tail"), "utf-8"), 256).alias("edited_sha256"))
    return facts.join(compared, ["range", "place"]).drop("range", "place")


@query("op3_fingerprints")
def op3_fingerprints(spark, folder):
    """Fingerprint of every document and of its edited text."""
    return fingerprints(table(spark, folder, "documents"))
