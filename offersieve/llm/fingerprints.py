"""Document fingerprints: a threshold-scaled sketch, which keeps every shingle hash below a fixed fraction of all hashes.

Shingles are five words in a row, A-Z lower-cased (all words, if there are fewer); a hash is the beginning of the md5 in
hex, and those below KEEP stay, an eighth. The rule does not look at the document's size, so sketches of very unequal
texts are samples of the same hashes: the sketch of texts together is the union of theirs (`merged`), and the share of one
sketch that is in another estimates containment (`contained`). Only DataFrame functions, no Python on the executors.

`compare` sets each document against an edited form of itself and against the next document in order of doc_id. Ids are
cut into ranges; each range finds its next ids by a window of its own, and ranges are joined up by their first ids. The
next document then sends its beginning and its sketch over; no text is ever sorted.

Defined results: a null text is empty; an empty text has no shingles; likeness is the Jaccard similarity of the two
sketches, and where both are empty 1 for equal texts (by a digest that the fingerprint begins with), else 0; a null
doc_id comes after all others; rows that share a doc_id share the next document, which is, of several rows with the next
id, the one with the least beginning, then sketch; a single id is its own next; an empty table gives no rows; very long
texts are one row's work; columns but doc_id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offersieve.llm.common import SPACE, write_table

WIDTH = 5
#: Hashes below this stay: in hex, a first digit of 0 or 1, an eighth of all.
KEEP = "2"
#: Hex digits of a hash, of 48 bits; and of the digest of the whole text.
DIGITS, WHOLE = 12, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_EMPTY = "array<string>"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sketch(text: Column, keep: str = KEEP) -> Column:
    """The sorted distinct hashes that a text keeps."""

    def kept(words: Column) -> Column:
        shingle = lambda i: F.array_join(F.slice(words, i, WIDTH), " ")
        shingles = F.when(F.size(words) >= WIDTH, F.transform(F.sequence(F.lit(1), F.size(words) - (WIDTH - 1)), shingle)).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast(_EMPTY))
        below = F.filter(F.transform(shingles, lambda s: F.md5(s)), lambda h: h < keep)
        return F.array_sort(F.array_distinct(F.transform(below, lambda h: F.substring(h, 1, DIGITS))))

    words = F.array_remove(F.split(lowered(text), f"{SPACE}+"), "")
    return F.transform(F.array(words), kept)[0]  # the words are made once


def fingerprint(text: Column, hashes: Column) -> Column:
    """A digest of the lower-cased text and the sketch, as one string."""
    return F.concat(F.substring(F.md5(lowered(text)), 1, WHOLE), F.lit(":"), F.array_join(hashes, ","))


def hashes_of(print_: Column) -> Column:
    """The sketch of a fingerprint."""
    return F.array_remove(F.split(F.substring(print_, WHOLE + 2, 1 << 30), ","), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, from 0 to 1."""

    def of(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        either = F.size(x) + F.size(y) - both
        same = (F.substring(a, 1, WHOLE) == F.substring(b, 1, WHOLE)).cast("double")
        return F.when(either == 0, same).otherwise(both / F.greatest(either, F.lit(1)))

    return F.transform(F.array(F.struct(hashes_of(a).alias("x"), hashes_of(b).alias("y"))), lambda p: of(p["x"], p["y"]))[0]


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of a that b has; null if the sketch of a is empty."""
    n = F.size(hashes_of(a))
    return F.when(n > 0, F.size(F.array_intersect(hashes_of(a), hashes_of(b))) / n)


def merged(prints: DataFrame, by: str, column: str = "fingerprint") -> DataFrame:
    """by, hash: the sketches of groups of documents. Rows, as a group may hold a third of all documents."""
    return prints.select(F.col(by), F.explode(hashes_of(F.col(column))).alias("hash")).distinct()


def contained(prints: DataFrame, groups: DataFrame, by: str, column: str = "fingerprint") -> DataFrame:
    """doc_id, by, share: which share of a document's hashes the group's sketch has, for each document and group with any
    in common. groups is what merged() returns, so a hash meets each group once."""
    of = prints.select("doc_id", F.xxhash64("doc_id", column).alias("row"), F.size(hashes_of(F.col(column))).alias("n"), F.explode(hashes_of(F.col(column))).alias("hash"))
    met = of.join(groups, "hash").groupBy("doc_id", "row", "n", by).agg(F.countDistinct("hash").alias("both"))
    return met.select("doc_id", by, (F.col("both") / F.col("n")).alias("share"))


def _next_ids(base: DataFrame) -> DataFrame:
    """next_no, next_id, cur_no, cur_id, most: for each id the one after it, and the longest text of its own rows."""
    parts = 4 * int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = base.groupBy("no", "id").agg(F.max(F.length("text")).alias("most"))
    ranged = write_table(ids.repartitionByRange(parts, "no", "id").withColumn("part", F.spark_partition_id()))
    here = F.struct("no", "id")
    after = F.lead(here).over(Window.partitionBy("part").orderBy("no", "id"))
    firsts = ranged.groupBy("part").agg(F.min(here).alias("first"))
    order = Window.orderBy("part")  # a row for each range
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("follows"))
    linked = ranged.withColumn("after", after).join(firsts, "part").withColumn("after", F.coalesce("after", "follows"))
    return linked.select(F.col("after.no").alias("next_no"), F.col("after.id").alias("next_id"), F.col("no").alias("cur_no"), F.col("id").alias("cur_id"), "most")


def compare(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col("doc_id").isNull().alias("no"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), body.alias("text"))
    links = _next_ids(base)
    printed = base.withColumn("hashes", sketch(F.col("text"))).select("no", "id", "text", fingerprint(F.col("text"), F.col("hashes")).alias("own"))
    sent = printed.join(links, (F.col("no") == F.col("next_no")) & (F.col("id") == F.col("next_id")))
    sent = sent.select("cur_no", "cur_id", F.struct(F.substring(F.col("text"), F.lit(1), F.floor(F.col("most") / 2).cast("int")).alias("begin"), F.col("own").alias("next")).alias("sent"))
    sent = sent.groupBy("cur_no", "cur_id").agg(F.min("sent").alias("sent"))
    met = printed.join(sent, (F.col("no") == F.col("cur_no")) & (F.col("id") == F.col("cur_id")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("sent.begin"), F.lit(1), half))
    met = met.select("no", "id", n.cast("long").alias("n_chars"), "own", F.col("sent.next").alias("next"), edited.alias("edited"))
    met = met.withColumn("hashes", sketch(F.col("edited"))).withColumn("other", fingerprint(F.col("edited"), F.col("hashes")))
    doc_id = F.when(~F.col("no"), F.col("id"))
    near = likeness(F.col("own"), F.col("other")), likeness(F.col("own"), F.col("next"))
    return met.select(doc_id.alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("own").alias("fingerprint"), F.col("other").alias("edited_fingerprint"), near[0].alias("near_edited"), near[1].alias("near_next"))
