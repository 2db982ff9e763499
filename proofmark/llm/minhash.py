"""One-permutation MinHash fingerprints in DataFrame functions alone.

Each shingle of five words is hashed once.  The top bits of a hash choose its
bin, and each bin keeps its least hash.  An empty bin takes the value of the
first filled one among independent draws of its own (optimal densification);
after ``DRAWS`` draws an order of all bins by hash goes on, so this always ends.
Of each bin the low ``BITS`` bits are kept, packed as hex.  Likeness corrects the
share of equal bins for those equal by chance.

Words are runs of other than ASCII white space, in lower case.  A text of fewer
than five words is one shingle of all its words; a text without words is one
shingle of none, so all such texts are alike.  Null texts count as empty.  Equal
texts have equal fingerprints.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SHINGLE, BINS, BITS = 5, 128, 8
#: Independent draws of a filled bin before an order of all bins decides.
DRAWS = 24


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the low bits of the ``BINS`` values of the fingerprint of column ``text``."""
    w, h, s = f"{out}_words", f"{out}_hashes", f"{out}_sorted"
    df = df.withColumn(w, words(F.col(text)))
    n = F.size(w)
    long = F.transform(F.slice(w, 1, F.greatest(n - (SHINGLE - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, SHINGLE))))
    short = F.array(F.xxhash64(F.array_join(w, " ")))
    # In order of hash, the first of each bin (the top bits) is the bin's least.
    df = df.withColumn(s, F.sort_array(F.when(n >= SHINGLE, long).otherwise(short))).drop(w)
    shift = 64 - BINS.bit_length() + 1
    df = df.withColumn(h, F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x.bitwiseXOR(F.get(s, i - 1)), shift) != 0))).drop(s)
    # Hashes are signed, so bins count from the most negative one, in the order of the array.
    bin_of = lambda x: F.shiftright(x, shift).cast("int") + BINS // 2
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    full = F.size(h) == BINS
    df = df.withColumn(w, F.when(~full, F.map_from_arrays(F.transform(h, bin_of), h)))
    df = df.withColumn(s, F.when(full, F.col(h)).otherwise(F.transform(every, lambda b: F.element_at(w, b))))

    def tried(b: Column) -> Column:
        draws = [F.get(s, F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(DRAWS)]
        # Where all draws met empty bins, the filled ones stand in their order of hash with this bin; only a value's low bits matter.
        low = (1 << BITS) - 1
        rest = F.array_min(F.transform(h, lambda x: F.xxhash64(b, bin_of(x)).bitwiseAND(~low).bitwiseOR(x.bitwiseAND(low))))
        return F.coalesce(F.get(s, b), *draws, rest)

    filled = F.when(full, F.col(s)).otherwise(F.transform(every, tried))
    return df.withColumn(out, F.transform(filled, lambda x: x.bitwiseAND((1 << BITS) - 1).cast("int"))).drop(w, h, s)


def packed(bins: Column) -> Column:
    """The low bits of all bins as hex digits."""
    return F.lower(F.array_join(F.transform(bins, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of shingles in common, from the share of equal bins; bins of different values agree in their low bits by chance once in 2^BITS."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x) / BINS
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every text."""
    return with_bins(common.texts_of(docs), "text", "bins").select("doc_id", packed(F.col("bins")).alias("fingerprint"))


def dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """``doc_id``, ``text``, ``digest`` (of the text) and ``cell`` of every row: cells follow descending order of ``doc_id``, then of digest.

    Cells are ranges of ids whose bounds are quantiles.  An id that is a quantile more than
    once has a cell of its own, and so have null ids, which come last; such a cell is
    parted by ranges of the digest, so no id's rows meet in one task, however many they are.
    """
    texts = common.texts_of(docs).withColumn("digest", F.sha2("text", 256))
    found = texts.select("doc_id").approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], min(0.01, 0.25 / buckets))
    often = {x for x in found if found.count(x) > 1}
    # The cut behind such an id lies at the next number, so its range holds nothing else.
    cuts = sorted({float(x) for x in found} | {math.nextafter(x, math.inf) for x in often})
    deal = Bucketizer(splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol="at", outputCol="bucket", handleInvalid="keep")
    # Bucketizer wants a double; its order follows that of doc_id, which is all that matters here.
    ranged = deal.transform(texts.select(F.col("doc_id").cast("double").alias("at"), F.col("doc_id").alias("id"), "text", "digest"))
    bucket = F.when(F.col("id").isNull(), -1).otherwise(F.col("bucket").cast("int"))
    # Large ids that are one double are several ids: their cell isn't parted.
    alone = F.col("at").isin(*often) & (F.abs("at") < 2.0**53) if often else F.lit(False)
    part = F.when(F.col("id").isNull() | alone, F.conv(F.substring("digest", 1, 4), 16, 10).cast("int") * buckets / 65_536).otherwise(0).cast("int")
    return ranged.select(F.col("id").alias("doc_id"), "text", "digest", (bucket.cast("long") * buckets + (buckets - 1 - part)).alias("cell"))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document with the text and bins of the next one in descending order of ``doc_id``, rows of one id in order of their digests; after the last comes the first.

    Documents are dealt into cells (see ``dealt``) and ordered within each, so
    no task orders all of them.  The first document of each cell (at most one
    for each cell) is also put at the end of the cell before it.
    """
    n = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = dealt(docs, n)
    first = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id").cast("decimal(20,0)")).alias("down"), "digest")
    ends = ranged.groupBy("cell").agg(F.min(first).alias("first"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell"))
    # One row per cell.
    before = ends.withColumn("to", F.coalesce(F.lag("cell").over(order), F.min("cell").over(Window.partitionBy(F.lit(0)))))
    firsts = ranged.join(F.broadcast(before.select(F.col("cell").alias("c"), F.col("first.none").alias("none"), (-F.col("first.down")).cast("long").alias("d"), F.col("first.digest").alias("x"), "to")), F.expr("cell = c and digest = x and doc_id <=> d"))
    firsts = firsts.groupBy("to", "doc_id", "digest").agg(F.min("text").alias("text")).select("doc_id", "text", "digest", F.col("to").alias("cell"), F.lit(True).alias("copy"))
    every = with_bins(ranged.withColumn("copy", F.lit(False)).unionByName(firsts), "text", "bins")
    turn = Window.partitionBy("cell").orderBy("copy", F.desc_nulls_last("doc_id"), "digest")
    return every.withColumns({"next_text": F.lead("text").over(turn), "next_bins": F.lead("bins").over(turn)}).where(~F.col("copy")).drop("copy", "cell", "digest")


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last half replaced by the beginning of the next document), and their likeness."""
    every = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = every.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))).drop("next_text", "text")
    both = with_bins(edited, "edited", "edited_bins")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
