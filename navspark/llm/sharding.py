"""Balanced label propagation: linked documents gather in shards under exact quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navspark.llm.common import ranked
from navspark.session import stage

SHARDS = 40
ROUNDS = 12
_STEPS = 64
#: Linked rows of a group move in this many pieces for each shard.
_PIECES = 16


def _literal(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _wishes(pieces: DataFrame, room: list[int], turn: int) -> DataFrame:
    """Adds to pieces (grp, home, n, shard) the shard each aims for, if any, and its place in that shard's queue.

    A piece wants the strongest shard of its group that has room for it, if that is stronger than its own; equal
    strengths are decided by a hash of group and shard, so two halves never swap for ever.
    """
    own = F.struct(
        F.sum("n").over(Window.partitionBy("grp", "shard")).alias("n"), F.xxhash64("grp", "shard").alias("tie"), F.col("shard")
    )
    strong = pieces.repartition("grp").withColumn("own", own)
    # One entry for each shard that the group is in.
    strong = strong.withColumn("all", F.collect_set("own").over(Window.partitionBy("grp")))
    fitting = F.filter("all", lambda x: F.element_at(_literal(room), x["shard"] + 1) >= F.col("n"))
    strong = strong.withColumn("best", F.array_max(fitting))
    step = F.pmod(F.xxhash64("grp", "home", F.lit(turn)), F.lit(_STEPS))
    code = (63 - F.floor(F.log2("best.n"))) * _STEPS + step
    wants = F.col("best") > F.col("own")
    return strong.select(
        "grp", "home", "n", "shard", F.when(wants, F.col("best.shard")).alias("aim"), F.when(wants, code).cast("long").alias("code")
    )


def _propagate(pieces: DataFrame, quotas: list[int], rounds: int) -> DataFrame:
    """Move pieces towards the shards where their group is strongest, as far as quotas let them.

    Each round compares the linked pieces of a group across shards. Wishes are let in by strength until a
    shard's room is used; the rest tries again next round. The sum of squared counts rises
    with each move, so the rounds end. The driver sees sums per shard and step of the queue only.
    """
    shards = len(quotas)

    def by_shard(frame: DataFrame) -> list[int]:
        found = {r["shard"]: r["n"] for r in frame.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        return [found.get(s, 0) for s in range(shards)]

    held, state, closed = by_shard(pieces), pieces, set()
    for turn in range(rounds + 1):
        room = [0 if s in closed else max(0, q - h) for s, (q, h) in enumerate(zip(quotas, held, strict=True))]
        state = stage(_wishes(state, room, turn), "pieces")
        queues: dict[int, list] = {}
        for r in state.where("aim IS NOT NULL").groupBy("aim", "code").agg(F.sum("n").alias("n")).collect():
            queues.setdefault(r["aim"], []).append((r["code"], r["n"]))
        if not queues or turn == rounds:
            break
        limits = []
        for s in range(shards):
            used, limit = 0, -1
            for code, n in sorted(queues.get(s, ())):
                used += n
                if used > room[s]:
                    break
                limit = code
            limits.append(limit)
            if s in queues and limit < 0:
                closed.add(s)  # the first in the queue together are more than the room: look elsewhere
        moves = F.col("aim").isNotNull() & (F.col("code") <= F.element_at(_literal(limits), F.col("aim") + 1))
        state = state.select("grp", "home", "n", F.when(moves, F.col("aim")).otherwise(F.col("shard")).alias("shard"))
        held = by_shard(state)
    return state


def balanced_shards(
    docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, group: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Put every row of ``docs`` into a shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows of one ``group`` (by default: of equal, non-null text) are linked. Shards get the same
    number of rows, at most one apart, under the law ``rows``; linked rows gather in as few
    shards as these quotas allow and unlinked rows fill what is left. Slots number a
    shard's rows from 0 without gaps. Size is the UTF-8 bytes of the text plus 16; a null
    text has size 16, no checksum and no links. Repeated rows are linked rows like any other.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.col(text_col)
    linked_by = F.md5(text.cast("binary")) if group is None else group.cast("string")
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), linked_by.alias("grp"),
            F.pmod(F.xxhash64(F.col(id_col), F.lit("home")), F.lit(shards * _PIECES)).cast("int").alias("home"),
        ),
        "rows",
    )
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    starts = rows.where("grp IS NOT NULL").groupBy("grp", "home").agg(F.count("*").alias("n"))
    linked = starts.withColumn("_all", F.sum("n").over(Window.partitionBy("grp"))).where("_all > 1").drop("_all")
    pieces = stage(linked.withColumn("shard", F.col("home") % shards), "pieces")
    placed = _propagate(pieces, quotas, rounds).select("grp", "home", "shard")
    held = rows.join(placed, ["grp", "home"], "left").withColumn("shard", F.coalesce("shard", F.lit(shards)))
    # All unlinked rows share one number and need more buckets than a shard's linked rows.
    buckets = F.when(F.col("shard") == shards, max(1, total // 500)).otherwise(max(1, total // 20000))
    spread = F.pmod(F.xxhash64("doc_id"), buckets)
    order = [F.col(c) for c in ("doc_id", "text_crc32", "size")]
    queued = stage(ranked(held, ["shard"], order, spread, "place"), "queued")
    counts = {r["shard"]: r["n"] for r in queued.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    # Rows beyond a shard's quota, if chance gave it too many linked ones, join the unlinked rows.
    kept = [min(counts.get(s, 0), quotas[s]) for s in range(shards)]
    shed, offset = [], counts.get(shards, 0)
    for s in range(shards):
        shed.append(offset - kept[s])
        offset += counts.get(s, 0) - kept[s]
    opens, at = [], 0
    for s in range(shards):
        opens.append(at)
        at += quotas[s] - kept[s]
    kept_at, shed_at = F.element_at(_literal([*kept, 0]), F.col("shard") + 1), F.element_at(_literal([*shed, 0]), F.col("shard") + 1)
    turn = F.when(F.col("place") >= kept_at, F.col("place") + shed_at)
    # The last shard whose free places begin at or before the row's turn and that has any.
    free = [(s, opens[s]) for s in range(shards) if quotas[s] > kept[s]]
    goal = F.lit(None).cast("int")
    base = F.lit(None).cast("long")
    if free:
        bounds = _literal([o for _, o in free])
        index = F.size(F.filter(bounds, lambda o: o <= F.col("turn")))
        goal = F.element_at(F.array(*[F.lit(s) for s, _ in free]), index)
        base = F.element_at(_literal([kept[s] - o for s, o in free]), index)
    out = queued.withColumn("turn", turn)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(F.col("turn").isNull(), F.col("shard")).otherwise(goal).cast("int").alias("shard"),
        F.when(F.col("turn").isNull(), F.col("place")).otherwise(F.col("turn") + base).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
