"""Sharding by fixed virtual slots.

Every record hashes by its id and its text's checksum into one of a fixed number of slots. Bytes are summed per slot, and a map
slot -> shard is laid out so that shards get nearly equal bytes. The map is a small versioned table: adding a
shard appends edits of a new version, and only the edited slots' records move. The query writes its map and the edits
of one more shard to the shared folder and reads both versions back.

All steps are DataFrame operations. What is gathered in one row or broadcast has one entry per slot, a number
fixed by parameter whatever the input's size.

Defined cases: a null text counts as no bytes, a null id hashes as the empty string; rows that repeat an id spread by
their texts, rows that repeat both share a slot, are counted before they are shuffled, and each gets its own position;
an empty table gives a map of empty slots and no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import shared_dir, stored

SLOTS = 8192
SHARDS = 40
ROW_BYTES = 16


def slot_of(record_id: Column, checksum: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: 32 bits of the MD5 of its id's and its checksum's decimal text."""
    digest = F.md5(F.concat_ws("-", F.coalesce(record_id.cast("string"), F.lit("")), checksum))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % slots).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot; size: UTF-8 bytes of the text and a fixed cost of each row."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("bigint").alias("text_crc32"),
    ).withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots))


def slot_sizes(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """A row for each slot: virtual_slot, n_rows, n_bytes; empty slots too."""
    found = recs.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))
    every = recs.sparkSession.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(found, "virtual_slot", "left").na.fill(0, ["n_rows", "n_bytes"])


def slot_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """virtual_slot, shard, version (1): slots by falling bytes, each to the shard with the least bytes so far.

    An empty slot counts as one byte, so that slots without records spread too. Ties go to the smaller number.
    """
    ordered = sizes.agg(
        F.array_sort(
            F.collect_list(F.struct((-F.greatest("n_bytes", F.lit(1))).alias("neg"), F.col("virtual_slot")))
        ).alias("s")
    )
    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), shards).alias("load"), F.array().cast("array<int>").alias("to")
    )

    def deal(state: Column, slot: Column) -> Column:
        least = F.array_position(state["load"], F.array_min(state["load"])).cast("int")

        def put(at: Column) -> Column:
            return F.struct(
                F.transform(
                    state["load"], lambda x, i: F.when(i == at - 1, x - slot["neg"]).otherwise(x)
                ).alias("load"),
                F.concat(state["to"], F.array(at - 1)).alias("to"),
            )

        return F.element_at(F.transform(F.array(least), put), 1)

    dealt = ordered.select("s", F.aggregate("s", start, deal)["to"].alias("to"))
    pairs = dealt.select(F.explode(F.arrays_zip("s", "to")).alias("p"))
    return pairs.select(
        F.col("p.s.virtual_slot").alias("virtual_slot"), F.col("p.to").alias("shard"), F.lit(1).alias("version")
    )


def with_one_more_shard(current: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Edits of the next version: slots that leave for shard number `shards`, so that all get nearly equal bytes.

    Each old shard gives slots, by number, as long as their bytes stay within what it holds over the new mean.
    """
    held = current.join(sizes, "virtual_slot")
    w = Window.partitionBy("shard")
    total = held.agg(F.sum("n_bytes").alias("total"))
    left = held.crossJoin(F.broadcast(total)).select(
        "virtual_slot",
        "version",
        F.sum("n_bytes").over(w.orderBy("virtual_slot")).alias("gone"),
        (F.sum("n_bytes").over(w) - F.expr(f"total div {shards + 1}")).alias("over"),
    )
    return left.where(F.col("gone") <= F.col("over")).select(
        "virtual_slot", F.lit(shards).alias("shard"), (F.col("version") + 1).alias("version")
    )


def save_edits(edits: DataFrame, path: str) -> None:
    """Appends a version's entries to the stored map."""
    edits.coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map as of a version (the last by default): of each slot the latest entry."""
    rows = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is not None:
        rows = rows.where(F.col("version") <= version)
    return rows.groupBy("virtual_slot").agg(
        F.max(F.struct("version", "shard")).alias("last")
    ).select("virtual_slot", "last.shard", "last.version")


def assign(recs: DataFrame, mapped: DataFrame, sizes: DataFrame, block: int = 10_000) -> DataFrame:
    """Each record's shard and its position there, gapless from 0; with other columns of mapped.

    A slot's records start where the slots before it on that shard end, so positions are counted within slots
    only, and no task sees a whole shard. Equal records are one row with a number until their positions are known.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = mapped.join(sizes, "virtual_slot").select(
        *mapped.columns, F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start")
    )
    keys = ["virtual_slot", "doc_id", "size", "text_crc32"]
    equal = recs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = equal.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = ranked.join(F.broadcast(starts), "virtual_slot").withColumn("first", F.col("start") + F.col("first"))
    blocks = placed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(block).cast("bigint"))))
    step = F.sequence(F.col("at"), F.least(F.col("at") + block, F.col("n")) - 1)
    return blocks.withColumn("nth", F.explode(step)).select(
        "doc_id", "size", "text_crc32", *mapped.columns, (F.col("first") + F.col("nth")).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, **cols: str) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot (position in the shard), version, next_shard (with one more
    shard, by the edits of the next version). The versioned map stays in the shared folder."""
    spark = docs.sparkSession
    recs = records(docs, slots=slots, **cols)
    sizes = stored(slot_sizes(recs, slots), "slot-sizes")
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    save_edits(slot_map(sizes, shards), path)
    first = load_map(spark, path, 1)
    save_edits(with_one_more_shard(first, sizes, shards), path)
    grown = load_map(spark, path).select("virtual_slot", F.col("shard").alias("next_shard"))
    return assign(recs, load_map(spark, path, 1).join(grown, "virtual_slot"), sizes)


# ---- query ----


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in 40 shards of nearly equal bytes."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("next_shard").cast("int").alias("next_shard"),
    )


ORACLE = f"""
with recursive bit(i, c, k) as (
  select i, i, 0 from range(256) t(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bit where k < 8),
tab as (select list(c order by i) as t from bit where k = 8),
hexed as (select doc_id, text, hex(encode(coalesce(text, ''))) as h from documents),
rec as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(h) // 2),
      lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) as text_crc32,
    (('0x' || left(md5(coalesce(doc_id::varchar, '') || '-' || text_crc32), 8))::bigint % {SLOTS})::int as virtual_slot
  from hexed, tab),
sized as (
  select s::int as virtual_slot, count(rec.virtual_slot) as n_rows, coalesce(sum(size), 0)::bigint as n_bytes
  from range({SLOTS}) t(s) left join rec on rec.virtual_slot = s group by s),
ranked as (
  select *, row_number() over (order by greatest(n_bytes, 1) desc, virtual_slot) as r from sized),
deal(r, load, at_) as (
  select 0::bigint, list_transform(range({SHARDS}), lambda i: 0::bigint), 0::bigint
  union all
  select k.r, list_transform(d.load, lambda x, i: case when i = list_position(d.load, list_min(d.load))
      then x + greatest(k.n_bytes, 1) else x end), list_position(d.load, list_min(d.load))
  from deal d join ranked k on k.r = d.r + 1),
mapped as (
  select k.virtual_slot, (d.at_ - 1)::int as shard, k.n_rows, k.n_bytes from ranked k join deal d using (r)),
starts as (
  select virtual_slot, shard, coalesce(sum(n_rows) over (partition by shard order by virtual_slot
    rows between unbounded preceding and 1 preceding), 0) as start,
    case when sum(n_bytes) over (partition by shard order by virtual_slot) <= sum(n_bytes) over (partition by shard)
      - (select sum(n_bytes) from mapped) // {SHARDS + 1} then {SHARDS} else shard end::int as next_shard from mapped)
select r.doc_id, r.size, r.text_crc32, 'bytes' as law, s.shard,
  (s.start + row_number() over (partition by r.virtual_slot order by r.doc_id, r.size, r.text_crc32) - 1)::bigint as slot,
  null::int as grown_shard, r.virtual_slot, s.next_shard
from rec r join starts s using (virtual_slot)
"""
