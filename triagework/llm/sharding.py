"""Sharding by balanced label propagation, in DataFrame operations only.

Every shard has room for its share of the rows; shares differ by at most one. Rows that share a link (here: equal texts)
are neighbours. In the first round every link asks for the shard where most of its rows were dealt; a shard takes links,
larger ones first, as long as they fit its room as a whole. A link that was turned away asks in the next round for a shard
that still has room for all of it, and rounds go on until none is left that any shard has room for: then splitting it is
forced by the sizes, given the links that were placed before. A link with more rows than a shard is cut into pieces of a
shard each, and a rest that goes on like a link of its own.

Links that are left are laid end to end over the rooms that are left, so each is cut as seldom as the rooms allow; rows
without a neighbour come last and fill what remains. ``link_shards`` tells over how many shards a row's link lies.

Links of one size class are ranked inside salted parts of a shard; only sums per shard, class and part are kept together,
and 24 numbers a round reach the driver.

Null and empty texts are equal and have size 8. Repeated rows are rows of their own and linked. With fewer rows than
shards some shards are empty; no rows give no rows. Other columns are not read.
"""

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagework.llm.common import read_table, salted_rank, scratch
from triagework.session import broadcast_if_small

SHARDS = 24
LINKS_PER_PART = 200_000


def dealt(docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Stored rows with size, checksum, link and first shard; ``link`` is null for a text that occurs once."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = scratch(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.lit(7), text).alias("h2"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "rows",
    )
    part = F.shiftright("row", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(part.alias("part"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    texts = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("link"))
    shared = scratch(texts.where("n > 1").select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), "link"), "shared")
    place = F.col("start") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    return scratch(
        rows.join(F.broadcast(starts), part == F.col("part"))
        .withColumn("shard", F.pmod(place, F.lit(shards)).cast("int"))
        .join(shared, (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2")), "left")
        .select("row", "doc_id", "size", "text_crc32", "link", "shard"),
        "dealt",
    )


def asked_first(state: DataFrame, shards: int, room: int) -> DataFrame:
    """Pieces of links as ``link``, ``piece``, ``n`` and the shard they ask for in the first round (``to``).

    A link of ``room`` rows or fewer is one piece and asks for the shard where most of its rows are. The pieces of a
    larger one ask for the shards with most of its rows in turn.
    """
    place = F.struct(F.col("n").alias("n"), F.xxhash64("link", "shard").alias("tie"), F.col("shard").alias("shard"))
    links = (
        state.where("link is not null")
        .groupBy("link", "shard")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("link")
        .agg(F.sum("n").alias("rows"), F.sort_array(F.collect_list(place), asc=False).alias("places"))
    )
    pieces = F.sequence(F.lit(0), F.ceil(F.col("rows") / F.lit(max(1, room))).cast("int") - 1)
    cut = links.select("link", "rows", "places", F.explode(pieces).alias("piece"))
    n = F.least(F.lit(room).cast("long"), F.col("rows") - F.col("piece") * F.lit(room))
    turn = F.get("places", F.pmod("piece", F.size("places")))
    return cut.select("link", "piece", n.alias("n"), turn["shard"].alias("to")).where("n > 0")


def granted(asks: DataFrame, rooms: list[int], parts: int, turn: int) -> DataFrame:
    """The pieces with ``fits``: whether their shard has room for them after all that rank before them.

    Pieces rank by the size class, larger first, then by the part they are dealt to, then by their hash.
    """
    size_class = -F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    tie = F.xxhash64("link", "piece", F.lit(turn))
    ranked = asks.withColumns({"class": size_class, "part": F.pmod(tie, F.lit(parts)).cast("int"), "tie": tie})
    sums = ranked.groupBy("to", "class", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("to").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("to").alias("s_to"), F.col("class").alias("s_class"), F.col("part").alias("s_part"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
    )
    inside = Window.partitionBy("to", "class", "part").orderBy("tie", "link", "piece")
    room = F.get(F.array(*[F.lit(r).cast("long") for r in rooms]), F.col("to"))
    same = (F.col("to") == F.col("s_to")) & (F.col("class") == F.col("s_class")) & (F.col("part") == F.col("s_part"))
    return (
        ranked.withColumn("upto", F.sum("n").over(inside))
        .join(F.broadcast(starts), same)
        .select("link", "piece", "n", "to", (F.col("start") + F.col("upto") <= room).alias("fits"))
    )


def asked_again(left: DataFrame, rooms: list[int], turn: int) -> DataFrame:
    """Pieces that some shard has room for, with the shard they ask for now: by chance, in proportion to the rooms."""
    order = sorted(range(len(rooms)), key=lambda s: (-rooms[s], s))
    enough = F.size(F.filter(F.array(*[F.lit(rooms[s]).cast("long") for s in order]), lambda r: r >= F.col("n")))
    ends = [sum(rooms[s] for s in order[: i + 1]) for i in range(len(order))]
    known = left.withColumn("enough", enough).where("enough > 0")
    total = F.get(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("enough") - 1)
    drawn = F.pmod(F.xxhash64("link", "piece", F.lit(-turn)), total)
    place = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= drawn))
    to = F.get(F.array(*[F.lit(s) for s in order]), place)
    return known.select("link", "piece", "n", to.alias("to"))


def placed(asks: DataFrame, rooms: list[int]) -> tuple[DataFrame, DataFrame, list[int]]:
    """Pieces with their shard, pieces that no shard has room for, and the rooms that are left. Every round is stored."""
    first = scratch(asks, "pieces")
    parts = max(1, math.ceil(first.count() / (len(rooms) * LINKS_PER_PART)))
    done, left, turn = first.limit(0).select("link", "piece", "n", "to"), first, 0
    asks = first
    while True:
        told = scratch(granted(asks, rooms, parts, turn), "granted")
        rooms = list(rooms)
        for row in told.where("fits").groupBy("to").agg(F.sum("n").alias("n")).collect():
            rooms[row["to"]] -= row["n"]
        done = done.unionByName(told.where("fits").drop("fits"))
        rest = told.where("not fits").select("link", "piece", "n")
        turn += 1
        asks = scratch(asked_again(rest, rooms, turn), "asks")
        # Rooms only shrink: what fits nowhere now never will.
        stuck = rest.join(asks.select("link", "piece"), ["link", "piece"], "left_anti")
        left = stuck if turn == 1 else left.unionByName(stuck)
        if asks.isEmpty():
            return done, left, rooms


def propagated(state: DataFrame, shards: int) -> DataFrame:
    """The rows with their last ``shard``."""
    total = state.count()
    rooms = [total // shards + (s < total % shards) for s in range(shards)]
    piece_rows = max(1, total // shards)
    done, left, rooms = placed(asked_first(state, shards, piece_rows), rooms)
    # Links laid end to end: where each begins, from sums of salted parts; rows without a neighbour follow.
    left = scratch(left, "left")
    parts = max(1, math.ceil(left.count() / LINKS_PER_PART))
    part = F.pmod(F.xxhash64("link"), F.lit(parts))
    dealt_out = left.withColumn("part", part)
    before = Window.orderBy("s_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt_out.groupBy(F.col("part").alias("s_part")).agg(F.sum("n").alias("n")).select(
        "s_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("part").orderBy("link", "piece").rowsBetween(Window.unboundedPreceding, -1)
    begins = dealt_out.join(F.broadcast(starts), F.col("part") == F.col("s_part")).select(
        "link", "piece", "n", F.lit(None).cast("int").alias("to"),
        (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("begin"),
    )
    goals = scratch(done.withColumn("begin", F.lit(None).cast("long")).unionByName(begins), "goals")
    left_rows = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    ends = [sum(rooms[: s + 1]) for s in range(shards)]
    shard_at = lambda place: F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= place))
    names = ["row", "doc_id", "size", "text_crc32", "link"]
    # Only rows of links that are cut need their rank; all others go where their link goes.
    cut = goals.groupBy("link").agg(F.count(F.lit(1)).alias("pieces"), F.count("begin").alias("spread"))
    cut = scratch(cut.where("pieces > 1 or spread > 0").select(F.col("link").alias("c_link")), "cut")
    linked = state.where("link is not null")
    split = linked.join(cut, F.col("link") == F.col("c_link"), "left_semi").select(names)
    whole = linked.join(cut, F.col("link") == F.col("c_link"), "left_anti").select(names)
    goal = goals.select(F.col("link").alias("g_link"), "piece", "to", "begin")
    whole = whole.join(goal, F.col("link") == F.col("g_link")).select(*names, F.col("to").alias("shard"))
    numbered = salted_rank(split, ["link"], ["row"], "rank")
    piece = F.floor(F.col("rank") / F.lit(piece_rows))
    place = F.col("begin") + F.col("rank") - F.col("piece") * F.lit(piece_rows)
    split = numbered.join(goal, (F.col("link") == F.col("g_link")) & (piece == F.col("piece"))).select(
        *names, F.coalesce("to", shard_at(place)).alias("shard")
    )
    single = salted_rank(state.where("link is null").select(names), ["link"], ["row"], "rank")
    single = single.select(*names, shard_at(F.col("rank") + F.lit(left_rows)).alias("shard"))
    return scratch(whole.unionByName(split).unionByName(single), "shards")


def sharded(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, ``link``,
    ``link_shards``.
    """
    state = propagated(dealt(docs, shards, id_column, text_column), shards)
    spread = (
        state.where("link is not null")
        .groupBy("link", "shard")
        .agg(F.lit(1).alias("one"))
        .groupBy(F.col("link").alias("l_link"))
        .agg(F.sum("one").alias("link_shards"))
    )
    # Most links lie in one shard; only the others are looked up.
    split = broadcast_if_small(scratch(spread.where("link_shards > 1"), "split"))
    ranked = salted_rank(state, ["shard"], ["row"], "slot").join(split, F.col("link") == F.col("l_link"), "left")
    return ranked.select(
        F.col("doc_id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
        "link",
        F.when(F.col("link").isNotNull(), F.coalesce("link_shards", F.lit(1))).alias("link_shards"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read_table(spark, sf_dir, "documents"))
