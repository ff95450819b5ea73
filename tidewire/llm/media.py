"""Media columns: lossless 8-bit samples in a content-defined chunk store.

A payload becomes a WAV file of unsigned 8-bit mono samples.  A rolling gear hash cuts the file where the bits of the
last 32 bytes say so, so equal passages make equal chunks wherever they stand.  Chunk digests meet in Spark joins: one
row owns each different chunk and stores its bytes, all others keep a reference, and the ordered chunk list of a media
file gives its bytes back, which are verified against its digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import BYTE_CODES
from .common import Scratch, column, lookup_join, sized

#: Payloads are padded with zero bytes to a positive multiple of this.
BLOCK = 64
#: Bits of the gear hash that are zero at a cut: chunks of 2 KB beyond the least size, on average.
CUT_BITS = 11
LEAST, MOST = 1024, 16384
GEAR = (BYTE_CODES >> np.uint64(32)).astype(np.uint32)
WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")
RATE = 8000


def payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % BLOCK or (0 if text else BLOCK))


def to_wav(samples: bytes) -> bytes:
    head = WAV.pack(b"RIFF", (36 + len(samples)) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples) & 0xFFFFFFFF)
    return head + samples


def from_wav(media: bytes) -> bytes:
    riff, _, wave, fmt, _, kind, channels, _, _, _, bits, data, size = WAV.unpack_from(media)
    samples = media[WAV.size :]
    if (riff, wave, fmt, kind, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 1, 1, 8, b"data") or size != len(samples) & 0xFFFFFFFF:
        raise ValueError("not an 8-bit mono WAV file")
    return samples


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash h = 2 h + gear[byte] modulo 2**32, which the last 32 bytes alone decide; by doubling."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift)
    return h


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks: the first byte from ``LEAST`` on whose hash ends in zero bits, at ``MOST`` at the latest."""
    marks = np.flatnonzero(gear_hashes(np.frombuffer(media, np.uint8)) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1
    out, start, n = [], 0, len(media)
    while n - start > LEAST:
        i = int(np.searchsorted(marks, start + LEAST))
        start = min(int(marks[i]) if i < len(marks) else n, start + MOST, n)
        out.append(start)
    if start < n:
        out.append(n)
    return out


def split(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def encode_column(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text_key, text) as (id, text_key, n_bytes, media_key, chunks): the media's SHA-256 and its chunk list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, lists = [], [], []
            for text in batch.column(2):
                raw = text.as_py() or b""
                media = to_wav(payload(raw))
                n.append(len(raw))
                keys.append(hashlib.sha256(media).digest())
                lists.append([digest(c) for c in split(media)])
            made = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "text_key", "n_bytes", "media_key", "chunks"])

    return docs.mapInArrow(run, "id bigint, text_key bigint, n_bytes bigint, media_key binary, chunks array<binary>")


def store_chunks(owners: DataFrame) -> DataFrame:
    """``owners`` (text, refs: the places of chunks that others own) as (media_key, chunks): bytes, or null for a reference."""
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                keys, lists = [], []
                for text, refs in zip(part.column(0), part.column(1), strict=True):
                    media = to_wav(payload(text.as_py() or b""))
                    foreign = set(refs.as_py() or ())
                    keys.append(hashlib.sha256(media).digest())
                    lists.append([{"digest": digest(c), "bytes": None if k in foreign else c} for k, c in enumerate(split(media))])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lists, kind)], ["media_key", "chunks"])

    return owners.mapInArrow(run, "media_key binary, chunks array<struct<digest: binary, bytes: binary>>")


def feature(samples: np.ndarray) -> str:
    """Mean, root mean square about the mid level, zero crossings and the levels' entropy, as text."""
    x = samples.astype(np.float64) - 128
    share = np.bincount(samples, minlength=256) / len(samples)
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zc={crossings};entropy={entropy:.4f}"


FEATURES = "media_key binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def describe(key: bytes, media: bytes) -> tuple:
    """What a read-back media file says; a file that does not match its digest is an error."""
    if hashlib.sha256(media).digest() != key:
        raise ValueError(f"media {key.hex()} was not rebuilt as it was stored")
    samples = from_wav(media)
    return key, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(media), key.hex(), feature(np.frombuffer(samples, np.uint8))


def rebuild(lists: DataFrame) -> DataFrame:
    """``lists`` (media_key, parts: the chunks' bytes in order) put together, verified and described."""
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [describe(k.as_py(), b"".join(p.as_py())) for k, p in zip(batch.column(0), batch.column(1), strict=True)]
            columns = list(zip(*told, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return lists.select("media_key", "parts").mapInArrow(run, FEATURES)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media in a deduplicated chunk store, read it back and describe it.

    Returns (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), a row
    for each row of ``docs``.  A null or empty text is one block of zero bytes.  Equal texts share one media file and
    so all values; null and repeated ids are kept as they are, and other columns are not read.  Rows that repeat an id
    and a text are stored once, too.  The store stays in the shared folder, for as long as that lives.  One text has to
    fit a task a few times over.
    """
    scratch = Scratch(docs.sparkSession, "media")
    text = column(text_col).cast("string")
    keyed = docs.select(column(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))
    rows = scratch.save(encode_column(keyed), "rows")
    # of rows with equal media one stores it; of equal chunks the first place of the smallest media stores it
    who = F.struct(F.coalesce("id", F.lit(-(2**63))).alias("id"), "text_key")
    medias = rows.groupBy("media_key").agg(F.min(who).alias("owner"))
    owners = scratch.save(medias.select("media_key", "owner.id", "owner.text_key"), "owners")
    theirs = owners.select("media_key", F.col("id").alias("o_id"), F.col("text_key").alias("o_key"))
    told = lookup_join(rows.select(who.alias("w"), "media_key"), theirs, "media_key", limit=0).select("w.id", "w.text_key", "o_id", "o_key")
    told = scratch.save(told.groupBy("id", "text_key", F.expr("id <> o_id or text_key <> o_key").alias("skip")).agg((F.count("*") > 1).alias("many")), "told")
    copies = told.where("skip").select("id", "text_key")
    lists = rows.select(who.alias("w"), "media_key", "chunks").select("w.id", "w.text_key", "media_key", "chunks").join(owners, ["id", "text_key", "media_key"], "left_semi")
    places = lists.dropDuplicates(["media_key"]).select("id", "text_key", F.posexplode("chunks").alias("place", "digest"))
    places = scratch.save(places, "places")
    place = F.struct("id", "text_key", "place")
    firsts = places.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("uses")).where("uses > 1").select("digest", "first")
    again = places.withColumn("own", place).join(firsts, "digest").where("own <> first")
    refs = again.groupBy("id", "text_key").agg(F.collect_list("place").alias("refs"))
    # owners that repeat both id and text are stored once
    repeats = told.where("many and not skip").select("id", "text_key", F.lit(False).alias("skip"), F.lit(True).alias("many"))
    notes = copies.select("id", "text_key", F.lit(True).alias("skip"), F.lit(False).alias("many"), F.lit(None).cast("array<int>").alias("refs"))
    own = refs.join(repeats.drop("skip"), ["id", "text_key"], "full").select("id", "text_key", F.lit(False).alias("skip"), F.coalesce("many", F.lit(False)).alias("many"), "refs")
    notes = sized(scratch.save(notes.unionByName(own), "notes"))
    kept = keyed.withColumn("id", F.coalesce("id", F.lit(-(2**63)))).join(notes, ["id", "text_key"], "left").where("skip is null or not skip")
    if told.where("many and not skip").limit(1).count():
        single = F.coalesce("many", F.lit(False))
        kept = kept.where(~single).unionByName(kept.where(single).dropDuplicates(["id", "text_key"]))
    store = scratch.save(store_chunks(kept.select("text", "refs")), "store")

    missing = "exists(chunks, c -> c.bytes is null)"
    whole = store.where(f"not {missing}").select("media_key", F.expr("transform(chunks, c -> c.bytes)").alias("parts"))
    broken = store.where(missing).dropDuplicates(["media_key"]).select("media_key", F.posexplode("chunks").alias("place", "c"))
    lent = scratch.save(again.select("digest").distinct(), "lent")
    lent = store.select(F.explode("chunks").alias("c")).where("c.bytes is not null").select("c.digest", "c.bytes").join(sized(lent), "digest", "left_semi")
    lent = sized(scratch.save(lent.dropDuplicates(["digest"]), "lent-bytes"), 2000)
    owned = broken.where("c.bytes is not null").select("media_key", "place", "c.bytes")
    fetched = broken.where("c.bytes is null").select("media_key", "place", "c.digest").join(lent, "digest").select("media_key", "place", "bytes")
    joined = owned.unionByName(fetched).groupBy("media_key").agg(F.array_sort(F.collect_list(F.struct("place", "bytes"))).alias("p"))
    mended = joined.select("media_key", F.expr("transform(p, x -> x.bytes)").alias("parts"))
    features = scratch.save(rebuild(whole).unionByName(rebuild(mended)).dropDuplicates(["media_key"]), "features")
    scratch.drop("owners", "told", "places", "notes", "lent", "lent-bytes")
    out = lookup_join(rows.select(F.col("id").alias("doc_id"), "n_bytes", "media_key"), features, "media_key", limit=0)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
