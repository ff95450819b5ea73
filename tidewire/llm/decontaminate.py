"""Benchmark decontamination by winnowing, on DataFrame functions alone.

Documents are cut into blocks of words.  In each block the hashes of all k-grams are taken, and of every window of
consecutive k-grams the smallest is kept as the fingerprint.  A window of L words holds L - k + 1 k-grams, so equal
windows keep equal fingerprints: no shared span of L words can be missed.  Fingerprints found among the benchmark's
are extended to the windows that keep them, and those are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, column, sized, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a block, besides those that its last windows reach into the next one.
BLOCK = 128
#: Words of a k-gram; shorter windows are one k-gram.
GRAM = 5


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is.  lower() is faster and the same where no other letter is upper case."""
    return F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def winnowed(blocks: DataFrame, length: int) -> DataFrame:
    """``blocks`` (.., w: words) with ``kept``: the fingerprint of each window of ``length`` words."""
    k = min(GRAM, length)
    span = length - k + 1
    at = lambda a, n: ", ".join(f"{a}[i + {j}]" for j in range(n))
    hashed = blocks.where(F.size("w") >= length).withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    grams = hashed.withColumn("g", F.expr(f"transform(sequence(0, size(h) - {k}), i -> xxhash64({at('h', k)}))"))
    least = f"least({at('g', span)})" if span > 1 else "g[i]"
    return grams.withColumn("kept", F.expr(f"transform(sequence(0, size(g) - {span}), i -> {least})")).drop("h", "g")


def hits(docs: DataFrame, keys: list[str], items: DataFrame, window: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Occurrences of the windows of ``items`` (item_id, text) in ``docs`` (keys.., text).

    Returns (keys.., pos, length, window_id), the first word of each occurrence, and (window_id, item_id).
    Windows are ``window`` consecutive words of an item; an item of fewer, but not none, is one window.
    Up to ``broadcast_rows`` fingerprints are broadcast; beyond that they are joined by a shuffle that carries no words.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    item = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    item = item.withColumn("length", F.least(F.size("w"), F.lit(window)))
    item = item.withColumn("i", F.explode(F.expr("sequence(0, size(w) - length)")))
    item = item.select("item_id", "length", F.expr("slice(w, i + 1, length)").alias("w"))
    item = item.withColumn("window", F.array_join("w", " ")).withColumn("window_id", F.md5("window"))
    item = scratch.save(item, "windows")
    lengths = [r[0] for r in item.select("length").distinct().orderBy("length").collect()]  # at most ``window`` numbers
    block = docs.select(*keys, words(F.col("text")).alias("all")).where(F.size("all") > 0)
    found = None
    for length in lengths:
        own = item.where(F.col("length") == length).dropDuplicates(["window_id"])
        own = winnowed(own.select("w", "window", "window_id"), length).select(F.col("kept")[0].alias("fingerprint"), "window", "window_id")
        own = scratch.save(own, f"own-{length}")
        prints = sized(scratch.save(own.select("fingerprint").distinct(), f"prints-{length}"), broadcast_rows)
        small = own.limit(broadcast_rows + 1).count() <= broadcast_rows
        cut = F.expr(f"transform(sequence(0, size(all) - 1, {BLOCK}), s -> struct(s as start, slice(all, s + 1, {BLOCK + length - 1}) as w))")
        blocks = winnowed(block.select(*keys, F.explode(cut).alias("b")).select(*keys, "b.start", "b.w"), length)
        if small:
            met = blocks.withColumn("fingerprint", F.explode(F.array_distinct("kept"))).join(prints, "fingerprint")
        else:
            slim = blocks.select(*keys, "start", F.explode(F.array_distinct("kept")).alias("fingerprint")).join(prints, "fingerprint", "left_semi")
            slim = slim.select(*[F.col(c).alias(f"_{c}") for c in [*keys, "start"]], "fingerprint").distinct()
            same = F.lit(True)
            for c in [*keys, "start"]:
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            met = blocks.join(slim, same)
        spread = met.withColumn("i", F.explode(F.expr("filter(sequence(0, size(kept) - 1), i -> kept[i] = fingerprint)")))
        spread = spread.select(*keys, (F.col("start") + F.col("i")).cast("bigint").alias("pos"), F.array_join(F.expr(f"slice(w, i + 1, {length})"), " ").alias("window"))
        one = own.select("window", "window_id")
        one = spread.join(F.broadcast(one) if small else one, "window").select(*keys, "pos", F.lit(length).alias("length"), "window_id")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.select(*keys, F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("length"), F.lit("").alias("window_id")).where("false")
    return found, item.select("window_id", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (ids as sorted strings), contaminated.

    A word inside any occurrence of an item's window is hit.  Null and empty texts have no words and are clean; an
    empty benchmark leaves all clean.  Rows repeat as given, null ids included; rows that share an id but not a text
    are told apart.  An item whose id is null hits words but is not listed.  Only the named columns are read.
    """
    keyed = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    bench = items.select(column(item_id_col).alias("item_id"), column(item_text_col).alias("text"))
    found, owners = hits(keyed, ["doc_id", "text_key"], bench, window, broadcast_rows)
    per = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("pos", "length")).alias("spans"), F.collect_set("window_id").alias("windows"))
    per = Scratch(docs.sparkSession, "contamination").save(per, "found")  # read twice below, and far smaller than the texts
    covered = """aggregate(array_sort(spans), struct(0L as total, 0L as reached),
        (a, s) -> struct(a.total + greatest(0L, s.pos + s.length - greatest(a.reached, s.pos)) as total, greatest(a.reached, s.pos + s.length) as reached), a -> a.total)"""
    listed = per.select("doc_id", "text_key", F.explode("windows").alias("window_id")).join(owners, "window_id")
    listed = listed.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    counted = per.select("doc_id", "text_key", F.expr(covered).alias("n_hit"))
    named = lambda d, p: d.select(F.col("doc_id").alias(f"{p}_id"), F.col("text_key").alias(f"{p}_key"), *[c for c in d.columns if c not in ("doc_id", "text_key")])
    on = lambda p: (F.col("text_key") == F.col(f"{p}_key")) & F.col("doc_id").eqNullSafe(F.col(f"{p}_id"))
    base = keyed.select("doc_id", "text_key", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    out = base.join(named(counted, "c"), on("c"), "left").join(named(listed, "l"), on("l"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` that share no window with ``items``, all columns as they came, whatever their names.

    A row goes if its own text holds a window; rows that share its id, or have none, are judged by their own texts.
    Null and empty texts stay, an empty benchmark leaves all, and rows repeat as given.
    """
    id_, key, bad_id, bad_key = unused(docs, "_id", "_key", "_bad_id", "_bad_key")
    text = column(text_col).cast("string")
    marked = docs.withColumns({id_: column(id_col), key: F.xxhash64(text)})
    bench = items.select(column(item_id_col).alias("item_id"), column(item_text_col).alias("text"))
    found, _ = hits(docs.select(column(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")), ["doc_id", "text_key"], bench, window)
    bad = found.select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
    bad = sized(Scratch(docs.sparkSession, "contamination").save(bad, "bad"))
    return marked.join(bad, (F.col(key) == F.col(bad_key)) & F.col(id_).eqNullSafe(F.col(bad_id)), "left_anti").drop(id_, key)
