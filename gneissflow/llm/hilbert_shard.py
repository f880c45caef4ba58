"""Shards of near-equal bytes cut from a Hilbert-curve order of the metadata.

Each dimension is quantised to ``ORDER`` bits in the order of its values: names by ranges that hold
about equal numbers of rows, sizes by their number of bits.  The cell's index on the Hilbert curve
sorts the rows, so one shard covers a compact box of every dimension and a reader can skip shards by
their minima and maxima.  Runs of the order are cut where the running byte total passes k/n of the
sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

ORDER = 4


def hilbert_index(dims: list[Column], order: int = ORDER) -> Column:
    """Index on the Hilbert curve of a point whose coordinates are ints in [0, 2**order).

    The axes are turned into the curve's transposed form (exclusive-or and exchange per bit plane,
    then Gray coding) as one fold over a small array, and its bits are interleaved.
    """
    n = len(dims)
    x = F.array(*[d.cast("long") for d in dims])

    def put(a: Column, i: int, v: Column) -> Column:
        return F.transform(a, lambda e, k: F.when(k == i, v).otherwise(e))

    # inverse undo: planes from the top, axes in order
    for plane in range(order - 1, 0, -1):
        q = 1 << plane
        low = q - 1
        for i in range(n):
            def turn(a: Column) -> Column:
                first, own = a[0], a[i]
                swap = first.bitwiseXOR(own).bitwiseAND(F.lit(low).cast("long"))
                on = own.bitwiseAND(F.lit(q).cast("long")) != 0
                flipped = put(a, 0, first.bitwiseXOR(F.lit(low).cast("long")))
                swapped = put(put(a, i, own.bitwiseXOR(swap)), 0, first.bitwiseXOR(swap)) if i else a
                return F.when(on, flipped).otherwise(swapped)

            x = F.transform(F.array(x), turn)[0]

    def gray(a: Column) -> Column:
        step = [a[0]]
        for i in range(1, n):
            step.append(a[i].bitwiseXOR(step[-1]))
        t = F.lit(0).cast("long")
        for plane in range(order - 1, 0, -1):
            t = t.bitwiseXOR(F.when(step[-1].bitwiseAND(F.lit(1 << plane).cast("long")) != 0, F.lit((1 << plane) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.array(F.array(*step), F.array(t))

    coded = F.transform(F.array(x), gray)[0]

    def weave(c: Column) -> Column:
        out = F.lit(0).cast("long")
        for plane in range(order - 1, -1, -1):
            for i in range(n):
                bit = F.shiftright(c[0][i].bitwiseXOR(c[1][0]), plane).bitwiseAND(F.lit(1).cast("long"))
                out = F.shiftleft(out, 1).bitwiseOR(bit)
        return out

    return F.transform(F.array(coded), weave)[0]


def text_size(col: str = "text") -> Column:
    return F.coalesce(F.octet_length(col).cast("long"), F.lit(0).cast("long")) + 1


def name_cells(docs: DataFrame, column: str, order: int = ORDER) -> Column:
    """Cells 0 to 2**order - 1 of a column of names, in their order; null counts as the empty text.

    A value's cell is the share of rows with smaller values, so a value of many rows has a cell of
    its own.  The window runs over one row for each distinct value; only the first value of each cell
    comes to the driver.
    """
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    counted = docs.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.select("v", ahead.alias("a"), F.sum("n").over(Window.partitionBy()).alias("all"))
    first = placed.select("v", F.expr(f"(a * {1 << order}) div all").alias("cell")).groupBy("cell").agg(F.min("v").alias("v")).collect()
    cell = F.lit(0)
    for r in sorted(first, key=lambda r: r["cell"]):
        cell = F.when(value >= r["v"], int(r["cell"])).otherwise(cell)
    return cell


def document_dims(docs: DataFrame, order: int = ORDER) -> list[Column]:
    """lang, source, and the number of bits of the size."""
    bits = F.length(F.bin(text_size())) - 1
    return [name_cells(docs, "lang", order), name_cells(docs, "source", order), F.least(bits, F.lit((1 << order) - 1))]


def shards(docs: DataFrame, n_shards: int = 8, dims: list[Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot for every row.

    Size: UTF-8 bytes of the text (null: none) plus 1.  A row belongs to the shard in which its
    first byte lies, so shard sizes differ by less than the longest text.  Order: curve index, then
    the text's CRC-32 (equal texts of a cell are neighbours), then doc_id; slot counts from 0 in each
    shard.  Null texts have CRC 0; null ids come first; repeated rows get slots of their own.  An
    empty table gives no rows.  The order is cut into ranges by the row's whole sort key, so a cell,
    text or source that holds most rows is still spread over all tasks.
    """
    dims = document_dims(docs) if dims is None else dims
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_size().alias("size"), crc.alias("text_crc32"),
        hilbert_index(dims).alias("curve"), F.xxhash64("text").alias("__g_th"),
    )
    rows = materialize(rows, "curve")
    key = ["curve", "text_crc32", "doc_id", "__g_th"]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = materialize(rows.repartitionByRange(parts, *key).withColumn("_part", F.spark_partition_id()), "ranged")
    total = ranged.groupBy("_part").agg(F.sum("size").alias("_b"))  # one row for each task of the range step
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    ahead = total.select("_part", summed("_b", Window.orderBy("_part")).alias("_ahead"), F.sum("_b").over(Window.partitionBy()).alias("_all"))
    at = ranged.withColumn("_start", summed("size", Window.partitionBy("_part").orderBy(*key))).join(F.broadcast(ahead), "_part")
    shard = F.floor((F.col("_start") + F.col("_ahead")).cast("decimal(38,0)") * n_shards / F.col("_all"))
    at = at.withColumn("shard", F.least(shard, F.lit(n_shards - 1)).cast("int"))
    at = at.withColumn("_nth", F.row_number().over(Window.partitionBy("_part", "shard").orderBy("_start", *key)))
    counts = at.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("__g_n"))
    start = counts.select("shard", "_part", summed("__g_n", Window.partitionBy("shard").orderBy("_part")).alias("_before"))
    slot = (F.col("_nth") - 1 + F.col("_before")).cast("long").alias("slot")
    return at.join(start, ["shard", "_part"]).select("doc_id", "size", "text_crc32", "curve", "shard", slot, "__g_th")


def assign(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """``docs`` with curve, shard and slot; columns of ``docs`` with these names are replaced.

    Repeated rows (same id and text) share out their slots in the order of their other columns.
    """
    own = shards(docs, n_shards).select(F.col("doc_id").alias("__g_id"), F.col("__g_th"), "curve", "shard", "slot")
    own = materialize(own, "slots")
    left = docs.drop("curve", "shard", "slot").withColumn("__g_h", F.xxhash64("text"))
    on = F.col("__g_id").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("__g_th") == F.col("__g_h"))
    if not own.groupBy("__g_id", "__g_th").count().where("count > 1").isEmpty():
        own = own.withColumn("__g_k", F.row_number().over(Window.partitionBy("__g_id", "__g_th").orderBy("slot")))
        order = Window.partitionBy("doc_id", "__g_h").orderBy(F.to_json(F.struct(*[f"`{c}`" for c in left.columns])))
        left = left.withColumn("__g_n", F.row_number().over(order))
        on = on & (F.col("__g_k") == F.col("__g_n"))
    return left.join(own, on).drop("__g_id", "__g_th", "__g_h", "__g_k", "__g_n")


def oracle_sql(n_shards: int = 8, order: int = ORDER) -> str:
    """DuckDB SQL of the query over ``documents``: cells, curve, CRC-32 and running totals by plain SQL."""
    top = 1 << order
    cells = [
        f"{c}v AS (SELECT coalesce({c}, '') AS v, count(*) AS n FROM documents GROUP BY 1),\n"
        f"{c}c AS (SELECT v, CAST((sum(n) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - n) * {top} // sum(n) OVER () AS BIGINT) AS x FROM {c}v)"
        for c in ("lang", "source")
    ]
    curve = f"""SELECT doc_id, text, size, l.x AS x0, s.x AS x1, least(length(bin(size)) - 1, {top - 1}) AS x2
  FROM d JOIN langc l ON l.v = coalesce(d.lang, '') JOIN sourcec s ON s.v = coalesce(d.source, '')"""
    for plane in range(order - 1, 0, -1):
        q, low = 1 << plane, (1 << plane) - 1
        for i in range(3):
            swap = f"xor(x0, x{i}) & {low}"
            own = f", CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {swap}) END AS x{i}" if i else ""
            curve = f"SELECT * REPLACE (CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {low}) ELSE xor(x0, {swap}) END AS x0{own}) FROM ({curve})"
    curve = f"SELECT doc_id, text, size, x0, xor(x1, x0) AS x1, xor(x2, xor(x1, x0)) AS x2 FROM ({curve})"
    flips = " ".join(f"WHEN {p} THEN {(1 << p) - 1}" for p in range(order - 1, 0, -1))
    turn = f"list_reduce([0] || list_transform(list_filter(range(1, {order}), lambda p: (x2 >> p) & 1 = 1), lambda p: CASE p {flips} END), lambda a, b: xor(a, b))"
    woven = " + ".join(f"(((xor(x{i}, t) >> {p}) & 1) << {3 * p + 2 - i})" for p in range(order) for i in range(3))
    table = "list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"
    crc = "xor(list_reduce(b, lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)]), 4294967295), 4294967295)"
    return f"""
WITH d AS (SELECT doc_id, text, lang, source, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size FROM documents),
{cells[0]},
{cells[1]},
c AS (SELECT doc_id, CAST({woven} AS BIGINT) AS curve, size FROM (SELECT *, {turn} AS t FROM ({curve}))),
k AS (SELECT doc_id, {crc} AS text_crc32 FROM (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents), (SELECT {table} AS t)),
o AS (SELECT doc_id, size, text_crc32, curve, sum(size) OVER (ORDER BY curve, text_crc32, doc_id ROWS UNBOUNDED PRECEDING) - size AS ahead, sum(size) OVER () AS total FROM c JOIN k USING (doc_id)),
s AS (SELECT *, CAST(least(ahead * {n_shards} // total, {n_shards - 1}) AS INT) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY ahead) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, curve FROM s"""
