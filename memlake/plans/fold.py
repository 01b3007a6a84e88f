"""Exact parallel forms of row-by-row merge loops.

A loop that handles rows in order, comparing each with what is stored by then, looks
sequential, but its outcome depends only on who is similar to whom and on the order.
The functions here compute that outcome in rounds of joins and aggregates over the
similarity edges; no group of rows is ever gathered in one place. Where what a row does hangs on
each row before it, a family of similar texts is read in order by one task, as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from memlake.session import checkpointed, rewritten


def followers(edges: DataFrame) -> DataFrame:
    """Nodes that are *not* stored as new when nodes are handled in order.

    ``edges``: (a, b, seq_a, seq_b), both directions. A node is stored unless an earlier
    neighbour was; that is the first maximal independent set in the given order. Each
    round settles every node that is earliest among its open neighbours.
    """
    open_edges = checkpointed(edges)
    found = open_edges.select("a").limit(0)
    while not open_edges.isEmpty():
        first = (
            open_edges.groupBy("a")
            .agg(F.min("seq_a").alias("_own"), F.min("seq_b").alias("_other"))
            .filter(F.col("_own") < F.col("_other"))
            .select("a")
        )
        covered = checkpointed(open_edges.join(first.withColumnRenamed("a", "b"), "b", "left_semi").select("a").distinct())
        found = found.unionByName(covered)
        gone = first.unionByName(covered)
        open_edges = checkpointed(
            open_edges.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti")
        )
    return found


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], out: str) -> DataFrame:
    """Rows of each key numbered from 1 in a total ``order``, in two levels.

    Rows are sorted over range partitions and numbered inside them; what a key has in the partitions before is
    carried on. A key that holds most of the rows is numbered by as many tasks as it has partitions.
    """
    placed = checkpointed(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the key
    carry = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy("_id"))
    return placed.withColumn("_row", local).join(carry, [*keys, "_part"]).withColumn(out, F.col("_before") + F.col("_row")).drop("_id", "_part", "_before", "_row")


def families(pairs: DataFrame) -> DataFrame:
    """(row, head): of every node of ``pairs`` (a, b) that isn't the smallest of its connected component, the smallest one.

    Each round hangs a node below its smallest neighbour, follows these links to their ends and goes on with the pairs
    of different ends, so the number of components that still have pairs halves at least.
    """
    ordered = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, found = rewritten(ordered(pairs)), None
    while found is None or not edges.isEmpty():
        heads = rewritten(chain_heads(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("row"), F.col("b").alias("target"))))
        for side in ("a", "b"):
            edges = edges.join(heads.select(F.col("row").alias(side), "head"), side, "left").withColumn(side, F.coalesce("head", side)).drop("head")
        edges = rewritten(ordered(edges.filter("a <> b")).distinct())
        if found is not None:
            further = heads.select(F.col("row").alias("head"), F.col("head").alias("_to"))
            heads = found.join(further, "head", "left").select("row", F.coalesce("_to", "head").alias("head")).unionByName(heads)
        found = rewritten(heads)
    return found


_STORED_AT = -(2**63)


class _Holders:
    """Who holds the texts of one family at a moment: of each text the row that wrote it last, if none has taken that over, and free stored rows."""

    def __init__(self, texts: list[int], held: list[int], time: list[int], name: list[str]):
        self.texts, self.place = np.array(texts, np.int64), {t: i for i, t in enumerate(texts)}
        self.left, self.time, self.name, self.seats = held, time, name, [0] * len(texts)
        self.free = np.array(held, np.int64) > 0  # whether a text has a holder
        self.at = np.full(len(texts), _STORED_AT)
        self.row: list = [None] * len(texts)

    def best(self, near: np.ndarray, score: np.ndarray) -> int | None:
        """The text to take over: by score, then the most recently written one, stored ones by time and name."""
        at = np.searchsorted(self.texts, near)
        free = self.free[at]
        at, score = at[free], score[free]
        for by in (lambda: score, lambda: self.at[at]):
            if len(at) > 1:
                most = by()
                keep = most == most.max()
                at, score = at[keep], score[keep]
        return max(at.tolist(), key=lambda i: (self.time[i], self.name[i]), default=None)

    def arrive(self, text: int, seq: int, row: object, near: np.ndarray, score: np.ndarray) -> tuple[object, int | None, int | None] | None:
        """What ``row`` takes: a row, or a text and which of its stored rows; None if there is nothing."""
        own = self.place[text]
        of = own if self.free[own] else self.best(near, score)
        taken = None
        if of is not None:
            if self.row[of] is not None:
                taken, self.row[of], self.at[of] = (self.row[of], None, None), None, _STORED_AT
            else:
                self.left[of] -= 1
                self.seats[of] += 1
                taken = (None, int(self.texts[of]), self.seats[of])
            self.free[of] = self.left[of] > 0
        self.row[own], self.at[own], self.free[own] = row, seq, True
        return taken


def take_in_turn(arrived: DataFrame, near: DataFrame, sets: DataFrame, chunk: int) -> DataFrame:
    """Each arrived row, in order, takes over the most similar text there is by then; its own takes the place.

    ``arrived``: (id, seq, text), ``near``: (a, b, similarity) of different texts, in both directions, ``sets``: (text, held,
    held_time, name) of all texts, ``held`` of them stored. Texts are longs, a text is most similar to itself. Equal scores go to the row written last, then to
    the latest ``held_time``. Returns (row, owner, text, seat): what each row took, a row or a text's stored row, seats from 1.

    What a row takes hangs on all rows before it among the texts like its own, one after the other; families of texts
    without a pair between them do not touch. Each is therefore read in order by one task, which holds
    a few numbers for each text; a row brings the texts near its own. Rows of texts with nothing near are found by a running maximum.
    """
    arrived = rewritten(arrived.dropDuplicates(["id", "seq", "text"]))
    near = rewritten(near)
    kind = arrived.schema["id"].dataType
    alone = arrived.join(near.select(F.col("a").alias("text")).distinct(), "text", "left_anti")
    stored = sets.filter("held > 0").select("text", F.lit(1).alias("_stored"))

    # a mark counts from the next sequence number on, so a row never meets itself
    asks = alone.select("text", "id", "seq", F.lit(None).cast("long").alias("_at"), F.lit(1).alias("_asks"))
    marks = alone.select("text", F.lit(None).cast(kind).alias("id"), (F.col("seq") + 1).alias("seq"), F.col("seq").alias("_at"), F.lit(0).alias("_asks"))
    timeline = running_max(asks.unionByName(marks), ["text"], ["seq", "_asks"], F.floor(F.col("seq") / chunk), "_at", "latest").filter("id is not null")
    owners = alone.select("text", F.col("seq").alias("latest"), F.col("id").alias("owner"))
    no_seat = [F.lit(None).cast("long").alias("text"), F.lit(None).cast("int").alias("seat")]
    again = timeline.filter("latest < seq").join(owners, ["text", "latest"]).select(F.col("id").alias("row"), "owner", *no_seat)
    first = timeline.filter("latest is null").join(stored, "text").select(
        F.col("id").alias("row"), F.lit(None).cast(kind).alias("owner"), "text", F.lit(1).alias("seat"))

    family = families(near).select(F.col("row").alias("text"), "head")
    lists = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "similarity"))).alias("_near")).select(F.col("a").alias("text"), F.col("_near.b").alias("near"), F.col("_near.similarity").alias("score"))
    linked = near.select(F.col("a").alias("text")).unionByName(near.select(F.col("b").alias("text"))).distinct()
    of_family = rewritten(linked.join(family, "text", "left").select("text", F.coalesce("head", "text").alias("family")))
    none = {c: F.lit(None).cast(t) for c, t in (("id", kind), ("seq", "long"), ("near", "array<long>"), ("score", "array<double>"), ("held", "long"), ("time", "long"), ("name", "string"))}
    columns = ["family", "_side", "text", *none]
    holders = sets.join(of_family, "text").withColumns({**none, "_side": F.lit(0), "held": F.col("held").cast("long"), "name": F.col("name"), "time": F.coalesce(
        F.unix_micros(F.col("held_time").cast("timestamp")), F.lit(_STORED_AT))}).select(*columns)
    rows = arrived.join(of_family, "text").join(lists, "text").withColumns({c: v for c, v in none.items() if c in ("held", "time", "name")}).withColumn("_side", F.lit(1)).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, told, holding = None, [], None
        for batch in batches:
            own = [batch.column(c).to_pylist() for c in ("family", "_side", "text", "held", "time", "name", "id", "seq")]
            near, score = batch.column(batch.schema.get_field_index("near")), batch.column(batch.schema.get_field_index("score"))
            bounds = near.offsets.to_numpy() - near.offsets[0].as_py()
            near, score = near.flatten().to_numpy(), score.flatten().to_numpy()
            taken = []
            for i, (family, side, text, held, time, name, row, seq) in enumerate(zip(*own)):
                if family != current:
                    current, told, holding = family, [], None
                if side == 0:
                    told.append((text, held, time, name))
                    continue
                if holding is None:
                    holding, told = _Holders(*map(list, zip(*told))), []
                got = holding.arrive(text, seq, row, near[bounds[i] : bounds[i + 1]], score[bounds[i] : bounds[i + 1]])
                if got is not None:
                    taken.append((row, *got))
            parts = zip(*taken) if taken else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, types)], ["row", "owner", "text", "seat"])

    types = [to_arrow_type(kind)] * 2 + [pa.int64(), pa.int32()]
    out = T.StructType([T.StructField("row", kind), T.StructField("owner", kind), T.StructField("text", T.LongType()), T.StructField("seat", T.IntegerType())])
    dealt = holders.unionByName(rows).repartition("family").sortWithinPartitions("family", "_side", "seq", "id", "text")
    return rewritten(dealt.mapInArrow(run, out).unionByName(again).unionByName(first))


def chain_heads(links: DataFrame) -> DataFrame:
    """(row, head): where following ``links`` (row -> target) ends, by pointer doubling.

    Each round is read again from files: sizes that Spark estimates over joins of joins would double their digits with each.
    """
    heads = links.select("target").distinct().join(links.select(F.col("row").alias("target")), "target", "left_anti")
    done = rewritten(links.join(heads, "target", "left_semi").select("row", F.col("target").alias("head")))
    walking = rewritten(links.join(heads, "target", "left_anti"))
    results = [done]
    while not walking.isEmpty():
        finished = results[0]
        for part in results[1:]:
            finished = finished.unionByName(part)
        reached = rewritten(
            walking.join(finished.select(F.col("row").alias("target"), "head"), "target").select("row", "head")
        )
        hop = walking.select(F.col("row").alias("target"), F.col("target").alias("_next"))
        walking = rewritten(
            walking.join(reached.select("row"), "row", "left_anti")
            .join(hop, "target")
            .select("row", F.col("_next").alias("target"))
        )
        results.append(reached)
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out


def running_max(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str, out: str) -> DataFrame:
    """Running maximum per key up to and including each row, in two levels.

    ``chunk`` coarsens the order; chunks are scanned in parallel and only one value per
    chunk is carried, so a key holding most of the rows is not scanned by one task.
    """
    tagged = df.withColumn("_chunk", chunk)
    totals = tagged.groupBy(*keys, "_chunk").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("_carry", F.max("_top").over(before)).drop("_top")
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = tagged.withColumn("_local", F.max(value).over(local)).join(carry, [*keys, "_chunk"])
    return joined.withColumn(out, F.greatest("_carry", "_local")).drop("_chunk", "_carry", "_local")
