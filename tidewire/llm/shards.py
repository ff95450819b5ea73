"""K-d tree sharding: shards of near-equal bytes, cut at weighted medians of metadata dimensions.

The tree is grown level by level.  Each level picks for every open node the dimension along which its rows lie widest
(as a share of that dimension's whole range), and finds the weighted median by a few histogram passes: each pass sums
the bytes of a few thousand bins per node on the executors, and the bin that holds the median is cut again.  The driver
sees those sums alone, at most bins x nodes of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column

BINS = 4096
#: Numbers that a row which stands for many equal ones is spread out to at a time.
RUN = 4096
#: Ties on every dimension are cut by this last one, of which equal texts have equal values.
TIE = "tie"
#: A group of equal texts that would tilt a cut too far is cut by this one.
ROW = "row_tie"
#: Shares of a shard that a cut may be off its target so that equal values, or equal texts, stay together.
VALUE_TILT, GROUP_TILT = 1e-3, 1e-2


@dataclass
class Node:
    """A box of the tree: ``shards`` leaves to be made of it, from number ``first`` on."""

    where: Column
    first: int
    shards: int
    #: The rules (dimension, value) that are settled ties, then the cut: rows at or below go left.
    cut: list[tuple[str, int]] = field(default_factory=list)
    left: Node | None = None
    right: Node | None = None


def _at_or_below(cut: list[tuple[str, int]]) -> Column:
    """Rows whose values on the cut's dimensions are, in that order, at or below the cut."""
    *ties, (name, value) = cut
    out = F.col(name) <= value
    for dim, v in reversed(ties):
        out = (F.col(dim) < v) | ((F.col(dim) == v) & out)
    return out


def _spans(points: DataFrame, nodes: list[Node], dims: list[str]) -> dict[int, dict]:
    number = _number(nodes)
    ranges = [f(c).alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))]
    return {r["node"]: r.asDict() for r in points.groupBy(number.alias("node")).agg(F.sum("size").alias("bytes"), *ranges).where("node is not null").collect()}


def _number(nodes: list[Node]) -> Column:
    out = F.lit(None).cast("int")
    for i, n in enumerate(nodes):
        out = F.when(n.where, F.lit(i)).otherwise(out)
    return out


def _medians(points: DataFrame, nodes: list[Node], targets: dict[int, float], dims: dict[int, str], low: dict[int, int], high: dict[int, int]) -> dict[int, tuple[int, float, float]]:
    """For each node the largest value at which the bytes below it don't exceed the target: (value, bytes below, bytes at)."""
    below = dict.fromkeys(targets, 0.0)
    mass: dict[int, float] = {}
    low, high = dict(low), dict(high)
    while True:
        open_ = {i for i in targets if low[i] < high[i] or i not in mass}
        if not open_:
            return {i: (low[i], below[i], mass[i]) for i in targets}
        node = b = F.lit(None).cast("int")
        for i in open_:
            width = -(-(high[i] - low[i] + 1) // BINS)
            x = F.col(dims[i])
            inside = nodes[i].where & x.between(low[i], high[i])
            node = F.when(inside, F.lit(i)).otherwise(node)
            b = F.when(inside, F.floor((x - low[i]) / width).cast("int")).otherwise(b)  # all dimensions span 33 bits at most
        sums = points.select(node.alias("node"), b.alias("bin"), "size").where("node is not null").groupBy("node", "bin").agg(F.sum("size").alias("s"))
        by: dict[int, list] = {}
        for r in sums.collect():  # at most BINS numbers a node
            by.setdefault(r["node"], []).append((r["bin"], float(r["s"])))
        for i in open_:
            width = -(-(high[i] - low[i] + 1) // BINS)
            done = below[i]
            for k, s in sorted(by[i]):
                if done + s > targets[i] or k == max(by[i])[0]:
                    break
                done += s
            below[i], mass[i] = done, s
            low[i], high[i] = low[i] + k * width, min(high[i], low[i] + (k + 1) * width - 1)


def kd_tree(points: DataFrame, dims: list[str], shards: int) -> Node:
    """Grow the tree over ``points`` (size, the bigint ``dims``, tie, row_tie), none null, until each leaf is one shard.

    A cut takes the median's value to the side that leaves the bytes nearer to their target.  Where a group of equal
    texts would tilt that by more than a hundredth of a leaf, it is cut by row.
    """
    root = Node(F.lit(True), 0, shards)
    open_ = [root]
    whole = None
    while open_ := [n for n in open_ if n.shards > 1]:
        spans = _spans(points, open_, [*dims, TIE, ROW])
        if not spans:
            return root
        whole = whole or spans[0]
        grain = whole["bytes"] / shards
        live = {i: n for i, n in enumerate(open_) if i in spans}
        share = lambda i, c: (spans[i][f"hi_{c}"] - spans[i][f"lo_{c}"]) / max(1, whole[f"hi_{c}"] - whole[f"lo_{c}"])  # noqa: E731, B023
        order = {i: [max(dims, key=lambda c: share(i, c)), TIE, ROW] for i in live}  # noqa: B023
        pending = {i: (0, float(spans[i]["bytes"]) * (n.shards // 2) / n.shards) for i, n in live.items()}
        ties: dict[int, Column] = {i: n.where for i, n in live.items()}
        while pending:
            scoped = [Node(ties.get(i, F.lit(False)), 0, 0) for i in range(len(open_))]
            names = {i: order[i][k] for i, (k, _) in pending.items()}
            lo = {i: spans[i][f"lo_{names[i]}"] for i in pending}
            hi = {i: spans[i][f"hi_{names[i]}"] for i in pending}
            found = _medians(points, scoped, {i: t for i, (_, t) in pending.items()}, names, lo, hi)
            for i, (value, below, at) in found.items():
                k, target = pending.pop(i)
                node, name = live[i], names[i]
                tied = ties[i] & (F.col(name) == value)
                # what lies at the median goes to one side if that tilts the cut little; else it is cut by the next rule
                tilt = min(abs(below + at - target), abs(below - target))
                if name == ROW or tilt <= grain * (GROUP_TILT if name == TIE else VALUE_TILT):
                    edge = value if abs(below + at - target) <= abs(below - target) else value - 1
                    node.cut.append((name, edge))
                else:
                    node.cut.append((name, value))
                    ties[i] = tied
                    pending[i] = (k + 1, target - below)
        after = []
        for n in live.values():
            left = _at_or_below(n.cut)
            n.left = Node(n.where & left, n.first, n.shards // 2)
            n.right = Node(n.where & ~left, n.first + n.shards // 2, n.shards - n.shards // 2)
            after += [n.left, n.right]
        open_ = after
    return root


def shard_of(node: Node) -> Column:
    """The tree as one expression: the shard of a row."""
    if node.left is None or node.right is None:
        return F.lit(node.first)
    return F.when(_at_or_below(node.cut), shard_of(node.left)).otherwise(shard_of(node.right))


def number_rows(df: DataFrame, shard: str, scratch: Scratch, rows_per_part: int = 2000) -> DataFrame:
    """``df`` with ``slot``: 0, 1, .. within each shard, without gaps and without a task that holds a whole shard.

    Rows that are equal in all columns are counted first, so that however many there are they are one row of a part.
    Different rows are dealt to parts by a hash; the driver's plan adds up the parts' counts, and a group's numbers go
    on from those of its part and of the groups before it there.  They are spread out in runs of ``RUN``.
    """
    groups = scratch.save(df.groupBy(*df.columns).agg(F.count("*").alias("_n")), "groups")
    rows, most = groups.agg(F.count("*"), F.max("_n")).first()
    parts = max(1, min(4096, rows // max(1, rows_per_part * 16)))
    dealt = groups.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(shard, "_part").agg(F.sum("_n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.save(counts.select(shard, "_part", F.coalesce(F.sum("n").over(before(shard).orderBy("_part")), F.lit(0)).alias("_start")), "starts")
    inner = F.coalesce(F.sum("_n").over(before(shard, "_part").orderBy(*df.columns)), F.lit(0))
    placed = dealt.withColumn("_inner", inner).join(F.broadcast(starts), [shard, "_part"])
    runs = placed.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(RUN).cast("bigint"))))
    if (most or 0) > 16 * RUN:
        runs = runs.repartition(F.col(shard), F.col("_run"))
    each = runs.withColumn("_at", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + (RUN - 1), F.col("_n") - 1))))
    return each.select(*df.columns, (F.col("_start") + F.col("_inner") + F.col("_at")).cast("bigint").alias("slot"))


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, log_size, log_lines, log_words, tie, row_tie) of each row, none null but doc_id."""
    raw = F.coalesce(column(text_col).cast("string"), F.lit(""))
    log = lambda n: (F.log2(n + F.lit(1.0)) * 65536).cast("bigint")
    without = lambda mark: F.length(raw) - F.length(F.replace(raw, F.lit(mark), F.lit("")))
    return docs.select(
        column(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        log(F.octet_length(raw)).alias("log_size"),
        log(without("\n")).alias("log_lines"),
        log(without(" ")).alias("log_words"),
        F.shiftright(F.xxhash64(raw), 32).alias(TIE),
        F.shiftright(F.xxhash64(column(id_col)), 32).alias(ROW),
    )


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): ``shards`` shards of near-equal bytes.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1.  The dimensions are the size, the lines and the
    words (both on a logarithmic scale) and the CRC-32 of the text, all of the text alone; so equal texts share a
    shard, except for groups so large that a cut has to run through them to keep the sizes near equal.  ``slot`` numbers a shard's rows from 0.
    Repeated rows and null ids are kept, each with a slot of its own; an empty table gives none.  Other columns are not
    read, and a text is never held beside another.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    points = scratch.save(metadata(docs, id_col, text_col), "points")
    tree = kd_tree(points, ["log_size", "log_lines", "log_words", "text_crc32"], shards)
    placed = points.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard_of(tree).cast("int").alias("shard"), TIE)
    out = number_rows(placed, "shard", scratch)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
