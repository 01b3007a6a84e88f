"""Merkle manifest of a data set, checked leaf by leaf by a recursive query that climbs the tree.

Every row is a leaf; the leaves of a language, in id order, form a tree of runs of two, and the
roots of the languages form one tree on top. Built levels are stored as parent-linked node
rows: a row stands for a node of every ``STRIDE``-th level and holds its id, its ancestor's id
and the siblings on the way there. The check is a recursive common table expression: from its
leaf (with the tampered content, where there is one) each row joins its node by id, appends the
siblings to its proof, folds its hash over them and goes on from the ancestor until there is none.

How it spreads: leaves are numbered by a range-partitioned sort and the row counts of the partitions
before. A level is built from blocks of ``2**STRIDE`` nodes, so a language that holds most rows is
as many blocks as it needs. In the climb, a node above more than ``ROWS_PER_SALT`` leaves is stored once
for each salt, and rows pick a salt by their number; the topmost levels, ``TOP_NODES`` rows at most,
are broadcast in a climb of their own.

Defined results: a null value is ``-`` in its leaf; a null language is a language of its own, the first;
a null id comes first in its language and is never tampered with; rows of one id stand in the order of
their leaves; a null ``n_chars`` can't be tampered with; texts are hashed whole; one row alone is leaf, subroot and
root with the proof of no siblings; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import discard, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one row of the node table, and one step of the climb, goes up.
STRIDE = 8
TOP_NODES = 1 << 12
ROWS_PER_SALT = 1 << 16
#: Blocks whose path rows are built at once.
BLOCKS = 32
_PATH = (
    "id long, leaves long, up long, up_leaves long, steps array<struct<sibling:binary,left:boolean>>, subroot string, root string, "
    "grp_at long, start long, size long, pos long, top binary, last boolean"
)


def leaf_hash(values: Sequence[Column]) -> Column:
    """SHA-256 of the values one after the other: ``-`` for null, else byte count, colon and value."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tampered_seventh(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", counter: str = "n_chars") -> DataFrame:
    """``key``, ``grp``, ``leaf`` and ``seen`` (the leaf as a reader meets it: tampered rows have one more in ``counter``)."""
    more = (F.col(counter).cast("decimal(20,0)") + 1).cast("string")
    seen = leaf_hash([more if f == counter else F.col(f) for f in fields])
    leaf = leaf_hash([F.col(f) for f in fields])
    return docs.select(
        F.col(key).alias("doc_id"), F.col(group).cast("string").alias("grp"), F.unhex(leaf).alias("leaf"),
        F.when(tampered_seventh(key), F.unhex(seen)).alias("seen"),
    )


def numbered(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``df`` written in the order of ``order`` (nulls first) with each row's place ``at`` and its partition ``part``."""
    placed = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), label)
    rows = placed.withColumns({"part": F.shiftright("_id", 33).cast("int"), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    # one count for each partition: as many numbers as the sort had tasks
    counts = sorted(tuple(r) for r in rows.groupBy("part").agg(F.count(F.lit(1))).collect())
    before = [(part, sum(n for _, n in counts[:i])) for i, (part, _) in enumerate(counts)]
    starts = df.sparkSession.createDataFrame(before, "part int, _before long")
    return rows.join(F.broadcast(starts), "part").withColumn("at", F.col("_before") + F.col("_row")).drop("_before", "_row")


def _digest(a: bytes, b: bytes = b"") -> bytes:
    """Parent of one or two nodes; digests go in as hex text."""
    return hashlib.sha256(a.hex().encode() + b.hex().encode()).digest()


def _climbed(block: list[bytes], levels: int) -> tuple[list[list[tuple[bytes | None, bool]]], bytes]:
    """For each node of a block its sibling (if any) on each of ``levels`` levels, and the node the block becomes."""
    steps: list[list[tuple[bytes | None, bool]]] = [[] for _ in block]
    now = block
    for level in range(levels):
        for i, held in enumerate(steps):
            other = (i >> level) ^ 1
            held.append((now[other] if other < len(now) else None, bool(i >> level & 1)))
        now = [_digest(*now[i : i + 2]) for i in range(0, len(now), 2)]
    return steps, now[0]


def _height(size: int) -> int:
    return max(0, (size - 1).bit_length())


def _paths(nodes: DataFrame, base: int, stride: int, upper: bool) -> DataFrame:
    """Path rows of the stored level ``base``; the row of a block's first node also has the node that the block becomes.

    ``nodes``: ``grp_at`` (number of the group; 0 in the tree of subroots), ``start`` and ``size`` of the group, ``pos`` (of
    the node's first leaf in it), ``leaves`` (rows of the data below), ``hash``. An id is made of first leaf and level, and is
    negative in the tree of subroots.
    """
    steps_type = pa.list_(pa.struct([("sibling", pa.binary()), ("left", pa.bool_())]))
    schema = pa.schema([
        ("id", pa.int64()), ("leaves", pa.int64()), ("up", pa.int64()), ("up_leaves", pa.int64()), ("steps", steps_type), ("subroot", pa.string()),
        ("root", pa.string()), ("grp_at", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("pos", pa.int64()), ("top", pa.binary()), ("last", pa.bool_())])

    def name(leaf: int, level: int) -> int:
        return -1 - (leaf * 64 + level) if upper else leaf * 64 + level

    def rows(block: dict) -> Iterator[dict]:
        held = sorted((x["pos"], x["hash"], x["leaves"]) for x in block["held"])
        start, height, first = block["start"], _height(block["size"]), held[0][0]
        levels = max(0, min(stride, height - base))
        last = base + levels >= height
        steps, top = _climbed([h for _, h, _ in held], levels)
        # the root of a group goes on as a leaf of the tree of subroots, whose own root ends the climb
        up = name(start + first, base + levels) if not last else None if upper else -1 - block["grp_at"] * 64
        below = sum(n for _, _, n in held)
        for i, ((pos, own, n), path) in enumerate(zip(held, steps)):
            yield {
                "id": name(start + pos, base), "leaves": n, "up": up, "up_leaves": below,
                "steps": [{"sibling": s, "left": left} for s, left in path],
                "subroot": own.hex() if upper and not base else None, "root": top.hex() if up is None else None,
                "grp_at": block["grp_at"], "start": start, "size": block["size"], "pos": pos, "top": None if i else top, "last": last,
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCKS):
                yield pa.RecordBatch.from_pylist([r for block in batch.slice(at, BLOCKS).to_pylist() for r in rows(block)], schema=schema)

    # at most 2**stride nodes in a block
    blocks = nodes.groupBy("grp_at", "start", "size", F.shiftright("pos", base + stride).alias("block")).agg(
        F.collect_list(F.struct("pos", "hash", "leaves")).alias("held"))
    return blocks.select("grp_at", "start", "size", "held").mapInArrow(run, _PATH)


def _levels(nodes: DataFrame, highest: int, stride: int, upper: bool) -> tuple[list[DataFrame], DataFrame]:
    """All stored levels of the trees of ``nodes``, up to the largest group, and the last node of each tree."""
    stored: list[DataFrame] = []
    for base in range(0, max(1, _height(highest)), stride):
        stored.append(written(_paths(nodes, base, stride, upper), "merkle-nodes"))
        nodes = stored[-1].filter("top is not null and not last").select(
            "grp_at", "start", "size", "pos", F.col("up_leaves").alias("leaves"), F.col("top").alias("hash"))
    ends = [built.filter("top is not null and last").select("grp_at", F.col("up_leaves").alias("leaves"), "top") for built in stored]
    return stored, reduce(DataFrame.unionByName, ends)


@contextmanager
def _recursion(spark: SparkSession):
    """Recursive queries without a bound on rows; they end where the tree ends."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def climb(start: DataFrame, nodes: DataFrame, small: bool) -> DataFrame:
    """The rows of ``start`` where the stored ``nodes`` have led them, by a recursive query.

    A row has ``node`` and ``salts`` (where it stands and how often that node is stored), ``folded`` and ``proof``; ``stop``
    says that its next node isn't among ``nodes``. ``small``: the nodes are few enough to be sent to every task.
    """
    spark = start.sparkSession
    held, tree = f"merkle_start_{uuid.uuid4().hex}", f"merkle_nodes_{uuid.uuid4().hex}"
    start.createOrReplaceTempView(held)
    nodes.createOrReplaceTempView(tree)
    try:
        found = spark.sql(f"""
            with recursive climb(doc_id, leaf, number, node, salts, stop, folded, proof, subroot, root) as (
              select doc_id, leaf, number, node, salts, stop, folded, proof, subroot, root from {held}
              union all
              select {'/*+ broadcast(n) */' if small else ''} c.doc_id, c.leaf, c.number, n.up, n.up_salts, n.stop,
                aggregate(n.steps, c.folded, (h, s) -> unhex(sha2(cast(
                  case when s.left then concat(lower(hex(s.sibling)), lower(hex(h))) when s.sibling is null then lower(hex(h))
                    else concat(lower(hex(h)), lower(hex(s.sibling))) end as binary), 256))),
                concat(c.proof, aggregate(n.steps, cast('' as binary), (p, s) -> case when s.sibling is null then p else concat(p, s.sibling) end)),
                coalesce(c.subroot, n.subroot), n.root
              from climb c join {tree} n on c.node = n.id and pmod(c.number, c.salts) = n.salt
              where not c.stop
            )
            select * from climb where stop""")
        with _recursion(spark):
            return written(found, "merkle-climb")
    finally:
        spark.catalog.dropTempView(held)
        spark.catalog.dropTempView(tree)


def manifest(docs: DataFrame, stride: int = STRIDE, top_nodes: int = TOP_NODES, rows_per_salt: int = ROWS_PER_SALT, **names) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of every row."""
    hashed = written(leaves(docs, **names).withColumn("number", F.monotonically_increasing_id()), "merkle-leaves")
    # the number only tells rows apart that are equal in all of the rest
    placed = numbered(hashed, ["grp", "doc_id", "leaf", "number"], "merkle-order")
    runs = written(placed.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-runs")
    groups = numbered(runs.groupBy("grp").agg(F.min("first").alias("start"), F.sum("n").alias("size")), ["start"], "merkle-groups")
    groups = groups.select(F.col("grp").alias("_grp"), "start", "size", F.col("at").alias("grp_at"))
    of_run = runs.join(groups, F.col("grp").eqNullSafe(F.col("_grp"))).select(F.col("part").alias("_part"), "_grp", "start", "size", "grp_at")
    # joined by partition and group, so that a group of many rows is as many keys as it has partitions
    rows = written(
        placed.join(of_run, (F.col("part") == F.col("_part")) & F.col("grp").eqNullSafe(F.col("_grp"))).select(
            "doc_id", "leaf", "seen", "number", "grp_at", "start", "size", "at"), "merkle-rows")
    discard(hashed, placed)

    span = 1 << stride
    nodes_at = [F.sum(F.when((F.lit(k) == 0) | (F.col("size") > span**k), F.ceil(F.col("size") / float(span**k)))) for k in range(-(-40 // stride))]
    sizes = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.array(*nodes_at).alias("nodes")).first()
    base = rows.select("grp_at", "start", "size", (F.col("at") - F.col("start")).alias("pos"), F.lit(1).cast("long").alias("leaves"), F.col("leaf").alias("hash"))
    low, tops = _levels(base, sizes["largest"], stride, False)
    zero = F.lit(0).cast("long")
    subroots = tops.select(
        zero.alias("grp_at"), zero.alias("start"), F.lit(sizes["groups"]).cast("long").alias("size"), F.col("grp_at").alias("pos"), "leaves", F.col("top").alias("hash"))
    high, _ = _levels(subroots, sizes["groups"], stride, True)
    stored = low + high

    # the levels from the top down that together are small enough to be sent to every task
    counts = [sizes["nodes"][k] or 0 for k in range(len(low))] + [-(-sizes["groups"] // span**k) for k in range(len(high))]
    cut = len(stored)
    while cut and sum(counts[cut - 1 :]) <= top_nodes:
        cut -= 1

    def salts(n: Column, last: int) -> Column:
        return F.ceil(n / float(rows_per_salt)).cast("int") if last < cut else F.lit(1)

    def nodes_of(levels: range) -> DataFrame:
        parts = []
        for k in levels:
            # a node's ancestor is in the next stored level of its tree, or in the first of the tree of subroots
            up_level = F.when(F.col("up").isNull(), F.lit(len(stored))).when((F.col("up") < 0) & F.lit(k < len(low)), F.lit(len(low))).otherwise(F.lit(k + 1))
            stop = ~up_level.isin(list(levels))
            parts.append(stored[k].select(
                "id", "up", F.when(stop, F.lit(1)).otherwise(salts(F.col("up_leaves"), k)).alias("up_salts"), stop.alias("stop"), "steps", "subroot", "root",
                F.explode(F.sequence(F.lit(0), salts(F.col("leaves"), k) - 1)).alias("salt")))
        return reduce(DataFrame.unionByName, parts)

    none = F.lit(None).cast("string")
    at = rows.select(
        "doc_id", "leaf", "number", (F.col("at") * 64).alias("node"), F.lit(1).alias("salts"), F.lit(False).alias("stop"),
        F.coalesce("seen", "leaf").alias("folded"), F.lit(b"").alias("proof"), none.alias("subroot"), none.alias("root"))
    for levels, small in ((range(cut), False), (range(cut, len(stored)), True)):
        if levels:
            done = at
            at = climb(at.withColumns({"salts": F.lit(1), "stop": F.col("node").isNull()}) if small else at, nodes_of(levels), small)
            discard(done)
    discard(runs, *stored)
    text = lambda c: F.lower(F.hex(c))
    return at.select(
        "doc_id", text("leaf").alias("leaf"), "subroot", "root", F.sha2(text("proof").cast("binary"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"), (text("folded") == F.col("root")).alias("verified"))
