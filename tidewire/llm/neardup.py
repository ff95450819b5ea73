"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard verification, components.

A circulant signature takes two permutations of the 32-bit numbers: the first scatters the shingles, the second,
circularly shifted by one more step for each coordinate, gives all coordinates.  Bands of four coordinates name the
buckets.  Candidates are confirmed on the full sets of 64-bit shingle hashes, so a reported link is exact; with 32
bands a pair at similarity 0.8 goes unseen once in 2e7.

Work stays linear in the size of a bucket: equal sets become one node first, each node of a bucket then meets the
bucket's smallest node, then a few drawn ones of other components, and only nodes that are not connected by then meet
each other: in small buckets as pairs, in large ones group by group inside a task, which emits new links alone.  Parity
sketches rule out pairs that cannot be linked, and no others, before any set is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytes_np import mix64, shingle_sets
from .common import LOOKUP_ROWS, Scratch, column, lookup_join, salted_join, sized, unused
from .components import connected_components

U32 = np.uint32
ROWS_PER_BAND = 4
#: Bits of the sketch that rules out pairs which cannot be linked.
PARITY_BITS = 4096
#: Nodes of a bucket, drawn by a hash, that its others meet before any two of them do.
PIVOTS = 8
#: Buckets of more nodes are split, so that no task compares more than about twice as many with each other.
BLOCK = 256


def permute32(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    np.right_shift(x, U32(16), out=spare)
    x ^= spare
    x *= U32(0x85EBCA6B)
    np.right_shift(x, U32(13), out=spare)
    x ^= spare
    x *= U32(0xC2B2AE35)
    np.right_shift(x, U32(16), out=spare)
    x ^= spare
    return x


def circulant_signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """``size`` minima of the second permutation, circularly shifted, over the first permutation of the set."""
    scattered = (mix64(hashes) >> np.uint64(32)).astype(U32)
    shifts = (np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B1) % np.uint64(1 << 32)).astype(U32)[:, None]
    out = np.full(size, 0xFFFFFFFF, U32)
    step = max(1, (1 << 16) // size)
    for i in range(0, len(scattered), step):
        shifted = scattered[None, i : i + step] + shifts
        np.minimum(out, permute32(shifted, np.empty_like(shifted)).min(axis=1), out=out)
    return out


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bits that each element of a set flips once, as 64-bit numbers.

    Two sets' sketches differ in no more bits than the sets have elements that only one of them holds.
    """
    at = (hashes >> np.uint64(20)).astype(np.int64) % PARITY_BITS
    flipped = (np.bincount(at, minlength=PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(flipped).view(np.int64)


def set_digest(s: np.ndarray) -> bytes | None:
    """A 128-bit digest of a set, none for an empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text, as text_key and text_key2; a null text has them too."""
    return F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit("second"), text).alias("text_key2")


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int) -> DataFrame:
    """(doc_id, text_key, text_key2, n_shingles, set_key, bands, parity): the set's key is a 128-bit digest, null for an empty one."""
    size = bands * ROWS_PER_BAND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs, parities = [], [], [], []
            for s in shingle_sets(batch.column(3), k):
                n.append(len(s))
                keys.append(set_digest(s))
                sigs.append(circulant_signature(s, size) if len(s) else np.zeros(size, U32))
                parities.append(parity_sketch(s))
            sig = np.array(sigs, U32).reshape(-1, bands, ROWS_PER_BAND).astype(np.uint64)
            band = np.arange(bands, dtype=np.uint64)[None, :].repeat(len(n), 0)
            with np.errstate(over="ignore"):
                for i in range(ROWS_PER_BAND):
                    band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
            parity = np.array(parities, np.int64).reshape(len(n), -1)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), pa.int64())) for x in (band.astype(np.int64), parity)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(n, pa.int64()),
                    pa.array(keys, pa.binary()),
                    *lists,
                ],
                ["doc_id", "text_key", "text_key2", "n_shingles", "set_key", "bands", "parity"],
            )

    schema = "doc_id bigint, text_key bigint, text_key2 bigint, n_shingles bigint, set_key binary, bands array<bigint>, parity array<bigint>"
    text = column(text_col).cast("string")
    return docs.select(column(id_col).cast("bigint").alias("doc_id"), *text_keys(text), text.alias("text")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, items): the sorted 64-bit hashes of the whole set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), k)]
            for i in range(0, len(sets), 256):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), pa.array(sets[i : i + 256], pa.binary())], ["node", "items"])

    return docs.mapInArrow(run, "node bigint, items binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets have 100 * intersection >= percent * union."""
    # sets are long: only those of the pairs are dealt out
    ends = lambda c: sets.toDF(c, f"{c}_items").join(sized(scratch.save(pairs.select(c).distinct(), f"{name}-{c}")), c, "left_semi")
    a, b = ends("a"), ends("b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = salted_join(pairs, a, "a").join(b, "b").select("a", "b", "a_items", "b_items")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _close(percent: int):
    """A filter on two rows x and y of sizes and parity sketches, which every linked pair passes.

    100 i >= percent u, for sets of x and y elements with i in common, u in all and d in one alone, is the same as
    d (100 + percent) <= (x + y) (100 - percent); the sketches differ in d bits at most.
    """
    differ = F.expr(" + ".join(f"bit_count(x_sig[{i}] ^ y_sig[{i}])" for i in range(PARITY_BITS // 64)))
    return (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent) & (differ * (100 + percent) <= (F.col("x_n") + F.col("y_n")) * (100 - percent))


def _labelled(members: DataFrame, labels: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(bucket, node, label): the nodes of the buckets with their components so far."""
    out = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
    return scratch.save(out, name)


def _lifted(labels: DataFrame, more: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Components of ``links``, labelled so far by ``labels``, and of ``more`` links between these components."""
    ca, cb = (labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    lifted = more.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    return connected_components(lifted.union(links), scratch, name)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: the components of the links between word-shingle sets.

    Words are what ASCII white space separates, A-Z in lower case; a text of fewer than ``k`` words is one shingle.
    Two documents are linked if 100 * intersection >= percent * union.  ``component_id`` is the smallest id reachable,
    and ``kept`` is true on rows of that id.

    Null or empty texts have no set and are linked with nothing.  A row whose id is null is linked like others, but
    never names a component: its component is null (and it is kept) if no row with an id can be reached from it.  Repeated rows
    each return.  Texts that differ and share an id are each linked with what they are like, not with each other, and
    the order of rows makes no difference.  Ids are cast to bigint.  Other columns are ignored.  One text must fit a task's memory about 40 times.
    """
    return grouped(docs, id_col, text_col, k, percent, bands).drop("text_key", "text_key2")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns as they came, whatever their names.

    A row goes if its own text is a copy: rows that share its id and hold another text, or have no id, are judged by
    their own texts.  Rows that repeat both an id and a text stay together.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    gone = grouped(docs, id_col, text_col, k, percent).where("not kept").select("doc_id", "text_key", "text_key2").distinct()
    id_, key, key2, g_id, g_key, g_key2 = unused(docs, "_id", "_key", "_key2", "_gone_id", "_gone_key", "_gone_key2")
    gone = sized(scratch.save(gone.toDF(g_id, g_key, g_key2), "gone"))
    one, two = text_keys(column(text_col).cast("string"))
    marked = docs.withColumns({id_: column(id_col).cast("bigint"), key: one, key2: two})
    same = (F.col(key) == F.col(g_key)) & (F.col(key2) == F.col(g_key2)) & F.col(id_).eqNullSafe(F.col(g_id))
    return marked.join(gone, same, "left_anti").drop(id_, key, key2)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32) -> DataFrame:
    """``near_duplicates`` with each row's text_key and text_key2."""
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = scratch.save(sketch(docs, id_col, text_col, k, bands).withColumn("row", F.monotonically_increasing_id()), "sketch")
    # a node for each different set, of which one row stands for all; ids come in at the end
    classes = scratch.save(rows.where("set_key is not null").groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("held")), "classes")
    # nodes are what is left without the other rows of a set: rows are long and these are few, so no row is dealt out
    twice = classes.where("held > 1").select("set_key", "node", "held")
    repeats = scratch.save(lookup_join(rows.select("set_key", "row"), twice, "set_key", held="held").where("row <> node").select("row"), "repeats")
    nodes = rows.where("set_key is not null").join(sized(repeats), "row", "left_anti").withColumnRenamed("row", "node")
    nodes = scratch.save(nodes.select("node", "doc_id", "text_key", "text_key2", F.col("n_shingles").alias("n"), "bands", "parity"), "nodes")

    # members are dealt out once, as two numbers; no bucket has more than one in ``bands`` of them
    of = Window.partitionBy("bucket")
    members = nodes.select("node", F.explode("bands").alias("bucket")).withColumns({"least": F.min("node").over(of), "most": F.max("node").over(of)})
    members = scratch.save(members.where("least < most").select("bucket", "node", "least"), "members")
    # the others are linked with nothing, so what is long of them goes no further
    met_ids = scratch.save(members.select("node").distinct(), "met-ids")
    nodes = scratch.save(nodes.drop("bands").join(sized(met_ids), "node", "left_semi"), "alike")
    scratch.drop("repeats", "nodes", "met-ids")

    # first round: each node and the smallest node of its buckets that looks most alike
    traits = nodes.select("node", "n", "parity")
    x = traits.select(F.col("node").alias("a"), F.col("n").alias("x_n"), F.col("parity").alias("x_sig"))
    y = traits.select(F.col("node").alias("b"), F.col("n").alias("y_n"), F.col("parity").alias("y_sig"))
    close = _close(percent)
    stars = scratch.save(members.where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "hubs")
    stars = salted_join(stars, x, "a").join(y, "b").where(close).groupBy("b").agg(F.min("a").alias("a"))
    stars = scratch.save(stars, "stars")

    sets = scratch.save(_node_sets(docs, id_col, text_col, nodes, rows, k, scratch), "sets")
    links = scratch.save(confirmed(stars, sets, percent, scratch, "ends-1"), "links-1")
    labels = scratch.save(connected_components(links, scratch, "first"), "labels-1")

    # second round: nodes of buckets that are still torn meet a few nodes of the bucket, drawn by a hash
    labelled = _labelled(members, labels, scratch, "labelled-1")
    pivot = lambda i: F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("draw"), F.col("node").alias("a"), F.col("label").alias("a_label")))
    ends = F.min("label").alias("low"), F.max("label").alias("high")
    drawn = labelled.groupBy("bucket").agg(*ends, *[pivot(i).alias(f"p{i}") for i in range(PIVOTS)]).where("low < high")
    drawn = scratch.save(drawn.select("bucket", F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("drawn")), "drawn")
    met = lookup_join(labelled, drawn, "bucket", limit=LOOKUP_ROWS // PIVOTS).select("node", "label", F.explode("drawn").alias("p")).where("p.a_label <> label")
    met = scratch.save(met.select(F.col("p.a").alias("a"), F.col("node").alias("b"), F.col("p.a_label").alias("a_label")).distinct(), "draws")
    met = salted_join(met, x, "a").join(y, "b").where(close).groupBy("b", "a_label").agg(F.min("a").alias("a"))
    more = scratch.save(confirmed(scratch.save(met.select("a", "b"), "met"), sets, percent, scratch, "ends-2"), "links-2")
    labels = scratch.save(_lifted(labels, more, links, scratch, "second"), "labels-2")

    # last round: what is not connected by then
    labelled = _labelled(members, labels, scratch, "labelled-2")
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    torn = sizes.groupBy("bucket").agg(F.sum("size").alias("held"), F.max(F.struct("size", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    torn = scratch.save(torn.select("bucket", "held", F.col("most.label").alias("major"), (F.col("held") - F.col("most.size")).alias("others")), "torn")
    open_ = scratch.save(lookup_join(labelled, torn, "bucket"), "open")
    last = scratch.save(_in_small_buckets(open_, nodes, sets, percent, scratch).unionByName(_in_large_buckets(open_, sets, percent, scratch)), "links-3")
    final = scratch.save(_lifted(labels, last, links.union(more), scratch, "last"), "labels")
    scratch.drop("members", "hubs", "stars", "sets", "wanted", "links-1", "links-2", "links-3", "labels-1", "labels-2", "labelled-1", "labelled-2", "drawn", "draws", "met", "torn", "open", "rest", "alike", "small", "large-ids", "ends-1-a", "ends-1-b", "ends-2-a", "ends-2-b", "ends-3-a", "ends-3-b")

    # the smallest id of each component, where a row with an id is in it
    classes = scratch.save(classes.join(final, "node", "left").select("set_key", "least", F.coalesce("component", "node").alias("component")), "parts")
    firsts = scratch.save(classes.groupBy("component").agg(F.min("least").alias("first")), "firsts")
    named = scratch.save(lookup_join(classes.drop("least"), firsts, "component").select("set_key", F.col("first").alias("component")), "named")
    scratch.drop("classes", "labels", "parts", "firsts")
    out = lookup_join(rows.drop("bands", "parity", "row"), named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_key", "text_key2").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _node_sets(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, rows: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(node, items) of ``nodes``, each once, from the texts as they are read again."""
    wanted = scratch.save(nodes.select("node", "doc_id", "text_key", "text_key2"), "wanted")
    one, two = text_keys(column(text_col).cast("string"))
    texts = docs.select(column(id_col).cast("bigint").alias("t_id"), one.alias("t_key"), two.alias("t_key2"), column(text_col).cast("string").alias("text")).where("text <> ''")
    rep = sized(wanted)
    same = (F.col("t_key") == F.col("text_key")) & (F.col("t_key2") == F.col("text_key2")) & F.col("t_id").eqNullSafe(F.col("doc_id"))
    sets = full_sets(texts.join(rep, same).select("node", "text"), k)
    # rows that repeat both id and text bring a node more than once
    twin = rows.select(F.col("doc_id").alias("t_id"), F.col("text_key").alias("t_key"), F.col("text_key2").alias("t_key2"))
    twice = twin.join(rep, same).groupBy("node").count().where("count > 1").limit(1).count() > 0
    return sets.dropDuplicates(["node"]) if twice else sets


def _in_small_buckets(open_: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of close pairs that are not connected, in buckets of at most ``BLOCK`` nodes; each in the first bucket it shares."""
    # pairs meet in these buckets alone, so of a node's others nothing has to be known
    small = open_.where(F.col("held") <= BLOCK).groupBy("node").agg(F.min("label").alias("label"), F.collect_set("bucket").alias("within"))
    small = scratch.save(small, "small")
    nodes = nodes.join(sized(small.select("node")), "node", "left_semi")
    small = small.join(nodes.select("node", "n", "parity"), "node").withColumn("bucket", F.explode("within"))
    x = small.select("bucket", F.col("node").alias("a"), F.col("label").alias("x_label"), F.col("n").alias("x_n"), F.col("parity").alias("x_sig"), F.col("within").alias("x_within"))
    y = small.select("bucket", F.col("node").alias("b"), F.col("label").alias("y_label"), F.col("n").alias("y_n"), F.col("parity").alias("y_sig"), F.col("within").alias("y_within"))
    first_shared = F.array_min(F.array_intersect("x_within", "y_within")) == x["bucket"]
    rest = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("a") < F.col("b")) & (F.col("x_label") != F.col("y_label")) & _close(percent) & first_shared)
    return confirmed(scratch.save(rest.select("a", "b"), "rest"), sets, percent, scratch, "ends-3")


def _in_large_buckets(open_: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect nodes of buckets of more than ``BLOCK`` nodes.

    Of a bucket, only nodes outside its largest component have to meet all nodes.  Both are split into groups of
    about ``BLOCK``, and two groups, with their sets, are the work of one task, which compares them in place: only links that
    connect something new in it become rows.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        node, label, asks = rows["node"].to_numpy(), rows["label"].to_numpy(), rows["asks"].to_numpy(zero_copy_only=False)
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["items"].combine_chunks()]
        n = np.array([len(x) for x in own])
        bits = np.array([parity_sketch(x) for x in own]).view(np.uint64)
        a_, b_ = [], []
        for i in np.flatnonzero(asks).tolist():
            at = np.flatnonzero(~asks & (label != label[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent))
            at = at[np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64) * (100 + percent) <= (n[at] + n[i]) * (100 - percent)]
            for j in at.tolist():
                if label[i] == label[j]:
                    continue  # connected meanwhile
                both = len(np.intersect1d(own[i], own[j], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    a_.append(min(node[i], node[j]))
                    b_.append(max(node[i], node[j]))
                    label = np.where(label == label[j], label[i], label)
        return pa.table({"a": pa.array(a_, pa.int64()), "b": pa.array(b_, pa.int64())})

    groups = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    large = open_.where(F.col("held") > BLOCK).withColumns({"few": groups("others"), "all": groups("held")})
    sets = sets.join(sized(scratch.save(large.select("node").distinct(), "large-ids")), "node", "left_semi")
    group = lambda of: F.pmod(F.xxhash64("node", F.lit(of)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asking = large.where("label <> major").select("bucket", "node", "label", group("few").alias("i"), every("all").alias("j"), F.lit(True).alias("asks"))
    asked = large.select("bucket", "node", "label", every("few").alias("i"), group("all").alias("j"), F.lit(False).alias("asks"))
    return asking.union(asked).join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(run, "a bigint, b bigint")
