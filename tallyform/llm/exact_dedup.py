"""Exact dedup as a keyed stream: disk-backed state without expiry, full bytes checked on hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import located, new_path, remove, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The bit table of repeated digests has this many rows of 32,768 bits each: 4 MB at any size of corpus.
BIT_ROWS = 1024
#: Bytes of arrivals (digests and locators, not texts) in a micro-batch.
BATCH_BYTES = 128 << 20


def normalised(text) -> F.Column:
    """A-Z in lower case and nothing else; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stream_state(arrivals: DataFrame, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Digest, stable identifier (largest id, then locator), that row's locator and the count, from a stream over ``path``.

    The state of each digest lives in RocksDB, never expires and is checkpointed in the shared folder; micro-batches
    are bounded by batch_bytes (one file at least), and each emits the digests that it changed. The last state of a digest is its largest count.
    """
    spark = arrivals.sparkSession
    out, at = new_path(spark, "state"), new_path(spark, "stream")
    rocks = "spark.sql.streaming.stateStore.rocksdb"
    keys = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB, f"{rocks}.changelogCheckpointing.enabled": "true",
        f"{rocks}.boundedMemoryUsage": "true", f"{rocks}.maxMemoryUsageMB": "192", f"{rocks}.writeBufferSizeMB": "4", f"{rocks}.maxWriteBufferNumber": "2", f"{rocks}.blockCacheSizeMB": "4",
        f"{rocks}.allowFAllocate": "false",  # else each partition's store takes megabytes of disk before it has a row
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        state = (
            spark.readStream.schema(arrivals.schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(path)
            .groupBy("digest").agg(F.max(F.struct("doc_id", "loc_file", "loc_row")).alias("top"), F.count("*").alias("n"))
        )
        query = state.writeStream.outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    batches = spark.read.schema(T.StructType([*state.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    if query.lastProgress is None or query.lastProgress["batchId"] == 0:
        return batches.select("digest", "top", "n")
    last = F.max(F.struct("n", "top")).alias("s")
    return batches.groupBy("digest").agg(last).select("digest", F.col("s.top").alias("top"), F.col("s.n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, loc_file, loc_row.

    Rows are equal when their normalised texts have the same bytes. The digest (SHA-256; ``digest`` is a weaker one
    for tests) only proposes: each repeated digest's rows are compared byte for byte with the text at the state's
    locator, and those that differ are grouped by their text. Of equal texts the largest id stays (a null id is
    the smallest; between repeated rows of one id the last locator stays). Empty and null texts are equal; an empty
    table gives no rows. Columns of other names are not read.
    """
    return _dedup(located(docs), id_col, text_col, digest, batch_bytes)


def _dedup(base: DataFrame, id_col: str, text_col: str, digest=None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    spark = base.sparkSession
    text, doc_id = F.col(f"row.`{text_col}`"), F.col(f"row.`{id_col}`").cast("long")
    key = digest or (lambda t: F.unhex(F.sha2(t, 256)))
    rows = base.select(doc_id.alias("doc_id"), "loc_file", "loc_row", normalised(text).alias("t"))
    sha = [F.sha2("t", 256).alias("text_sha256")] if digest else []
    arrivals, path = written(rows.select("doc_id", "loc_file", "loc_row", key(F.col("t")).alias("digest"), *sha), "arrivals")
    state, held = written(stream_state(arrivals, path, batch_bytes), "digests")
    repeated = state.where("n > 1")
    off = _differing(rows.withColumn("digest", key(F.col("t"))), repeated)
    regrouped, n_off, off_path = None, 0, None
    if off is not None:
        off, off_path = written(off, "collisions")
        n_off = off.count()
    placed = arrivals.join(state, "digest")
    if not digest:
        placed = placed.withColumn("text_sha256", F.lower(F.hex("digest")))
    if n_off:
        groups = off.groupBy("digest", "t").agg(F.max(F.struct("doc_id", "loc_file", "loc_row")).alias("own_top"), F.count("*").alias("own_n"))
        regrouped = off.join(groups, ["digest", "t"]).select("loc_file", "loc_row", "own_top", "own_n")
        less = off.groupBy("digest").agg(F.count("*").alias("less"))
        placed = placed.join(less, "digest", "left").join(regrouped, ["loc_file", "loc_row"], "left")
        placed = placed.withColumn("top", F.coalesce("own_top", "top")).withColumn("n", F.coalesce("own_n", F.col("n") - F.coalesce("less", F.lit(0))))
    elif off_path:
        remove(spark, off_path)
    return placed.select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("top.loc_file") == F.col("loc_file")) & (F.col("top.loc_row") == F.col("loc_row"))).alias("kept"), "text_sha256", "loc_file", "loc_row",
    )


def _differing(rows: DataFrame, repeated: DataFrame) -> DataFrame | None:
    """Rows of a repeated digest whose bytes are not those at the locator that the state holds.

    A bit table of fixed size (broadcast: at most BIT_ROWS x 4 KB) drops nearly all rows of single digests before
    any text is shuffled. The comparing join has one text of the state per digest, so a hot digest's rows split freely.
    """
    spread = F.xxhash64("digest")
    row, bit = F.pmod(spread, F.lit(BIT_ROWS)).cast("int"), F.pmod(F.shiftright(spread, 20), F.lit(32768))
    bits = repeated.select(row.alias("bit_row"), bit.alias("bit")).groupBy("bit_row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hits = rows.withColumn("bit_row", row).withColumn("bit", bit).join(F.broadcast(bits), "bit_row").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0).drop("bits", "bit", "bit_row")
    hits, _ = written(hits, "hits")
    seen = repeated.select(F.col("top.loc_file").alias("loc_file"), F.col("top.loc_row").alias("loc_row"), F.col("digest").alias("d"))
    kept = hits.join(seen, ["loc_file", "loc_row"], "left_semi").select("digest", F.col("t").alias("kept_t"))
    return hits.join(kept, "digest").where("t <> kept_t").drop("kept_t")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies that exact_dedup drops, in their own columns."""
    base = located(docs)
    gone = _dedup(base, id_col, text_col).where("not kept").select("loc_file", "loc_row")
    return base.join(gone, ["loc_file", "loc_row"], "left_anti").select("row.*")
