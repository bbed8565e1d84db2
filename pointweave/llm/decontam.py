"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Of each ``window`` consecutive
words, that is of ``window - k + 1`` consecutive k-grams, the k-gram with the least hash (the leftmost of equal ones) is a
fingerprint. Two texts that share a window share its fingerprint at the same place in it, so joining documents' and
items' fingerprints misses no shared window, while only about 2 of ``window - k + 2`` k-grams are joined. Each hit is then
extended word by word to both sides, as far as any window around it can reach; where that makes a window, its words are
hit. An item with fewer words than the window is one window itself, and is looked for among the documents' grams of its
length; at most window - 1 such lengths exist.

Items' fingerprints are broadcast while they are few (counted: ``broadcast_rows`` of about 300 bytes), and are joined by
shuffle beyond that, with the hits going back to their documents for the extension.

Defined results: null and empty texts have no words, no hits, and are not contaminated; such items match nothing. Rows
with equal ids and texts share one result, a row each; a null id is an id like any other. Items with equal ids are one
item; an item without an id hits words but is not listed or counted. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import few, fresh
from pointweave.storage import scratch, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Low bits of a fingerprint that hold its place; a text has fewer words.
PLACE_BITS = 30
#: No fingerprint: those have 64 - PLACE_BITS bits.
OWN = 1 << 62


def words_of(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, NOT_WORD, -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once. (An alias that a lambda uses once is put into the lambda by the optimizer,
    and would be computed anew for each element.)"""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(words: Column, length: int, tag: int) -> Column:
    """For each gram, its hash's high bits above its place. tag keeps grams of different use apart."""

    def packed(i: Column) -> Column:
        hashed = F.xxhash64(F.lit(tag), F.slice(words, i + 1, length))
        return F.shiftleft(F.shiftright(hashed, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("bigint"))

    n = F.size(words)
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), packed)).otherwise(F.array().cast("array<bigint>"))


def shifted(array: Column, n: int) -> Column:
    return F.slice(array, n + 1, F.greatest(F.size(array) - n, F.lit(0)))


def chained(array: Column, length: int, join: Callable[[Column, Column], Column]) -> Column:
    """join over each ``length`` neighbours (a shorter run at the end), by doubling; runs overlap, so of another than a
    power of 2 some neighbours are joined twice."""

    def joined(step: int) -> Callable[[Column], Column]:
        return lambda a: F.zip_with(a, shifted(a, step), join)

    size = 1
    while size < length:
        step = min(size, length - size)
        array, size = let(array, joined(step)), size + step
    return array


#: Bytes of items' words up to which they are broadcast.
BROADCAST_BYTES = 64 << 20


def chosen(words: Column, window: int, k: int) -> Column:
    """The winnowed fingerprints."""
    hashed = chained(words, k, lambda x, y: F.xxhash64(x, y)) if k > 1 else F.transform(words, lambda x: F.xxhash64(x))
    place = lambda x, i: F.shiftleft(F.shiftright(x, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("bigint"))
    packed = F.slice(F.transform(hashed, place), 1, F.size(words) - k + 1)
    least = F.slice(chained(packed, window - k + 1, lambda x, y: F.least(x, y)), 1, F.size(words) - window + 1)
    return F.when(F.size(words) >= window, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def with_marks(df: DataFrame, window: int, k: int, lengths: list[int]) -> DataFrame:
    """df (with ``words``) with ``marks``: the fingerprints and the grams of those lengths."""
    every = lambda w: reduce(F.concat, (grams(w, x, x) for x in lengths), chosen(w, window, k))
    return df.withColumn("marks", let(F.col("words"), every))


def split_mark(df: DataFrame) -> DataFrame:
    """mark to its hash's bits and its place; null, which stands for the document itself, to OWN."""
    place = F.col("mark").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    return df.withColumn("place", place).withColumn("mark", F.coalesce(F.shiftright("mark", PLACE_BITS), F.lit(OWN)))


def run(own: Column, own_at: Column, other: Column, other_at: int, step: int, count: int) -> Column:
    """How many of ``count`` words in a row are equal, from the two places on, forward (step 1) or back (-1).

    A fold, which is evaluated above the join, for its hits only: conditions in a row would be compiled into the join's
    loop, which the JVM leaves to its interpreter when it gets long."""

    def more(n: Column, j: Column) -> Column:
        equal = F.get(own, own_at + j * step) == F.get(other, F.lit(other_at) + j * step)
        return F.when((n == j) & equal, n + 1).otherwise(n)

    return F.aggregate(F.sequence(F.lit(0), F.lit(count - 1)), F.lit(0), more) if count else F.lit(0)


def marked_items(benchmark: DataFrame, item_id: str, item_text: str, window: int, k: int) -> tuple[DataFrame, list[int]]:
    """mark, item_id, the words around it, and how many equal words in a row make a hit."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    lengths = [r[0] for r in items.select(F.size("words")).where(F.size("words") < window).distinct().collect()]  # under window
    back, n = window - k, F.size("words")
    marks = split_mark(with_marks(items, window, k, sorted(lengths)).select("item_id", "words", F.explode("marks").alias("mark")))
    # a short item's grams of shorter items' lengths are not its window
    marks = marks.withColumn("need", F.least(n, F.lit(window)))
    whole = [F.xxhash64(F.lit(x), F.col("words")) for x in lengths]
    own = reduce(lambda a, b: a | b, [(n == x) & (F.col("mark") == F.shiftright(h, PLACE_BITS)) for x, h in zip(lengths, whole, strict=True)], n >= window)
    around = F.transform(F.sequence(F.lit(-back), F.lit(window - 1)), lambda j: F.get(F.col("words"), F.col("place") + j))
    return marks.where(own).select("mark", "item_id", "need", around.alias("around")).distinct(), sorted(lengths)


def spans(docs: DataFrame, items: DataFrame, lengths: list[int], window: int, k: int, broadcast_rows: int) -> DataFrame:
    """docs: (id, th, words). Gives a row (id, th, n_words) per document, and (id, th, item_id, start, end, need) of each
    equal run of words around a shared fingerprint."""
    back = window - k
    marked = with_marks(docs, window, k, lengths).withColumn("n_words", F.size("words"))
    size = F.sum(F.coalesce(F.octet_length(F.array_join("around", " ")), F.lit(0)))
    n_items, n_bytes = items.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()  # items is a written table
    if n_items <= broadcast_rows and n_bytes <= BROADCAST_BYTES:
        # one more mark stands for the document itself and meets a row without an item. The join gives hits and that row
        # only, so that the words, which go with each mark, are copied for no others.
        every = F.concat("marks", F.array(F.lit(None).cast("bigint")))
        rows = split_mark(marked.select("id", "th", "words", "n_words", F.explode(every).alias("mark")))
        none = items.sparkSession.range(1).select(F.lit(OWN).alias("mark"))
        found = rows.join(F.broadcast(items.unionByName(none, allowMissingColumns=True)), "mark")
    else:
        rows = split_mark(marked.select("id", "th", F.explode("marks").alias("mark")))
        # marks meet without the words; the words of the documents that meet an item alone are fetched
        hits = written(rows.join(items, "mark"), "meetings")
        same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th"))
        met = few(written(hits.select(F.col("id").alias("own_id"), F.col("th").alias("own_th")).distinct(), "meetingdocs"))
        texts = docs.join(met, same, "left_semi").dropDuplicates(["id", "th"]).withColumnsRenamed({"id": "own_id", "th": "own_th"})
        hits = hits.join(texts, same).drop("own_id", "own_th")
        found = docs.select("id", "th", F.size("words").alias("n_words")).unionByName(hits, allowMissingColumns=True)
    # in the join's own loop only a hit's neighbourhood is cut out, so no hit carries its whole text
    hit, low = F.col("need").isNotNull(), F.greatest(F.col("place") - back, F.lit(0))
    near = F.when(hit, F.slice("words", low + 1, window + back)).alias("near")
    found = found.select("id", "th", "item_id", "place", (F.col("place") - low).alias("own"), "need", "around", near, F.when(~hit, F.col("n_words")).alias("n_words"))
    left = run(F.col("near"), F.col("own") - 1, F.col("around"), back - 1, -1, back)
    right = run(F.col("near"), F.col("own"), F.col("around"), back, 1, window)
    found = found.select("id", "th", "n_words", "item_id", (F.col("place") - left).alias("start"), (F.col("place") + right).alias("end"), "need")
    # judged as read again: as a condition of the join it would take the join out of generated code
    return written(found, "hits")


def hits_of(found: DataFrame) -> DataFrame:
    """The rows of spans that cover a window."""
    return found.where(F.col("end") - F.col("start") >= F.col("need"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 4, broadcast_rows: int = 100_000) -> DataFrame:
    """A row per document: id, n_words, n_hit, n_items, items (the hit items' ids, sorted as strings), contaminated."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), words_of(text).alias("words"))
    items, lengths = marked_items(benchmark, item_id, item_text, window, k)
    with scratch(docs.sparkSession) as keep:
        found = keep(spans(rows, written(items, "benchmark"), lengths, window, k, broadcast_rows))
    base, hits = found.where("n_words IS NOT NULL"), hits_of(found)
    # a word and an item at a time before a document: no task needs all hits of one
    spanned = hits.select("id", "th", "start", "end").distinct()
    covered = spanned.select("id", "th", F.explode(F.sequence("start", F.col("end") - 1)).alias("at")).distinct()
    n_hit = covered.groupBy("id", "th").agg(F.count("*").alias("n_hit"))
    named = hits.select("id", "th", "item_id").distinct().groupBy("id", "th").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    own = lambda df: df.withColumnsRenamed({"id": "hit_id", "th": "hit_th"})
    same = F.col("hit_id").eqNullSafe(F.col("id")) & (F.col("hit_th") == F.col("th"))
    joined = base.select("id", "th", "n_words").join(own(n_hit), same, "left").drop("hit_id", "hit_th").join(own(named), same, "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_col), F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"), listed.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 4, broadcast_rows: int = 100_000) -> DataFrame:
    """The documents without a hit, with all their columns. Hits meet their documents by id and hash of the text."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), words_of(text).alias("words"))
    items, lengths = marked_items(benchmark, item_id, item_text, window, k)
    with scratch(docs.sparkSession) as keep:
        found = spans(rows, written(items, "benchmark"), lengths, window, k, broadcast_rows)
        found = few(keep(written(hits_of(found).select("id", "th").distinct(), "hitdocs")))
    own, owner = fresh(docs, "text_hash"), fresh(docs, "text_owner")
    found = found.select(F.col("id").alias(owner), F.col("th").alias(f"{owner}_hash"))
    same = F.col(id_col).eqNullSafe(F.col(owner)) & (F.col(own) == F.col(f"{owner}_hash"))
    return docs.withColumn(own, F.xxhash64(text)).join(found, same, "left_anti").drop(own)
