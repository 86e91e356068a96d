"""Data placement, quorum, clocks and conflict resolution as batch queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIRTUAL_NODES, REPLICAS, IMBALANCE, STALE_SECONDS = 150, 3, 0.15, 10
RING = 1 << 31


def ring_hash(x) -> Column:
    """A place on the ring from a long: two multiplicative rounds in 31 bits, exact in any engine."""
    v = F.pmod((F.col(x) if isinstance(x, str) else x).cast("long"), F.lit(RING))
    a = F.pmod(v * 1103515245 + 12345, F.lit(RING))
    return F.pmod(a.bitwiseXOR(F.shiftright(a, 15)) * 1103515245 + 12345, F.lit(RING))


def ring(spark, nodes: Sequence[int], virtual: int = VIRTUAL_NODES, dead: Sequence[int] = ()) -> DataFrame:
    """(hash, node_id, virtual_id, alive): as many rows as nodes x virtual nodes."""
    n = spark.createDataFrame([(int(i), i not in set(dead)) for i in nodes], "node_id long, alive boolean")
    v = n.select("node_id", "alive", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("virtual_id"))
    return v.select(ring_hash(F.col("node_id") * 100_003 + F.col("virtual_id") * 7919).alias("hash"), "node_id", "virtual_id", "alive")


def walk(r: DataFrame, replicas: int = REPLICAS) -> DataFrame:
    """(low, high, nodes): each arc of the ring of live nodes with the first distinct nodes clockwise from its end."""
    live = r.where("alive").groupBy("hash").agg(F.min("node_id").alias("node_id"))
    # the ring is small (nodes x virtual nodes): one sorted array of it
    whole = live.agg(F.array_sort(F.collect_list(F.struct("hash", "node_id"))).alias("r"))
    arcs = whole.select("r", F.posexplode("r").alias("i", "x"))
    ahead = F.expr("transform(concat(slice(r, i + 1, size(r)), slice(r, 1, i)), y -> y.node_id)")
    return arcs.select(F.expr("CASE WHEN i = 0 THEN -1L ELSE r[i - 1].hash END").alias("low"), F.col("x.hash").alias("high"), F.slice(F.array_distinct(ahead), 1, replicas).alias("nodes"), F.col("i"), F.expr("size(r)").alias("n"))


def place(keys: DataFrame, r: DataFrame, key: str = "key", replicas: int = REPLICAS) -> DataFrame:
    """keys with ``nodes``: the primary, then replicas. An as-of lookup in the ring's sorted array, which goes to all tasks (its size is
    the ring's, whatever the keys); keys are never shuffled."""
    arcs = walk(r, replicas)
    table = arcs.agg(F.array_sort(F.collect_list(F.struct("high", "nodes"))).alias("t"))
    # the first arc whose end is at or after the hash, or the first arc of all: halves of the sorted array, log2(size) steps
    hashed = keys.withColumn("h", ring_hash(key)).join(F.broadcast(table))
    search = F.expr(
        "aggregate(sequence(1, 20), named_struct('lo', 0, 'hi', size(t)), (s, _) -> CASE WHEN s.lo >= s.hi THEN s "
        "WHEN t[cast((s.lo + s.hi) / 2 as int)].high < h THEN named_struct('lo', cast((s.lo + s.hi) / 2 as int) + 1, 'hi', s.hi) "
        "ELSE named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) / 2 as int)) END, s -> s.lo)"
    )
    return hashed.withColumn("at", search).withColumn("nodes", F.expr("CASE WHEN at < size(t) THEN t[at].nodes ELSE t[0].nodes END")).drop("t", "at")


def load(placed: DataFrame) -> DataFrame:
    """(node_id, items, share) by primary."""
    n = placed.groupBy(F.col("nodes")[0].alias("node_id")).agg(F.count("*").alias("items"))
    total = n.agg(F.sum("items").alias("total"))
    return n.join(F.broadcast(total)).select("node_id", "items", (F.col("items") / F.col("total")).alias("share"))


def needs_rebalance(shares: DataFrame, most: float = IMBALANCE) -> DataFrame:
    return shares.agg((F.max("share") - F.min("share")).alias("spread")).select("spread", (F.col("spread") > most).alias("rebalance"))


def quorum(members: DataFrame, min_quorum: int = 2) -> DataFrame:
    """(members, reachable, needed, has_quorum) of members(node_id, reachable)."""
    n, up = F.count("*"), F.sum(F.col("reachable").cast("long"))
    needed = F.greatest(F.floor(n / 2) + 1, F.lit(min_quorum))
    return members.agg(n.alias("members"), up.alias("reachable"), needed.cast("long").alias("needed"), (up >= needed).alias("has_quorum"))


def cluster_health(members: DataFrame) -> DataFrame:
    """(members, healthy, healthy_percent, state) of members(reachable)."""
    n, up = F.count("*"), F.sum(F.col("reachable").cast("long"))
    percent = up * 100.0 / n
    return members.agg(n.alias("members"), up.alias("healthy"), percent.alias("healthy_percent"), F.when(up == n, "healthy").when(up >= F.floor(n / 2) + 1, "recovering").otherwise("failed").alias("state"))


def leader(members: DataFrame) -> DataFrame:
    """The healthy member with the largest log index, ties to the smaller id."""
    return members.where("reachable").agg(F.max_by("node_id", F.struct("log_index", -F.col("node_id"))).alias("leader"))


def member_table(gossip: DataFrame) -> DataFrame:
    """The state with the highest incarnation of each member."""
    return gossip.groupBy("node_id").agg(F.max_by("state", "incarnation").alias("state"), F.max("incarnation").alias("incarnation"))


def partitioned(members: DataFrame, as_of, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """Members that are unreachable, or not seen for longer."""
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    return members.where(~F.col("reachable") | (age > stale_seconds * 1_000_000))


def resolve_latest(versions: DataFrame) -> DataFrame:
    """Last write wins, ties to the higher node."""
    return versions.groupBy("data_key").agg(F.max_by("value", F.struct("ts", "node_id")).alias("value"))


def resolve_highest_node(versions: DataFrame) -> DataFrame:
    return versions.groupBy("data_key").agg(F.max_by("value", F.struct("node_id", "ts")).alias("value"))


def resolve_merge(versions: DataFrame) -> DataFrame:
    """All distinct values in order, with a pipe between them."""
    return versions.groupBy("data_key").agg(F.concat_ws("|", F.array_sort(F.collect_set("value"))).alias("value"))


def clock_merge(a, b) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def clock_tick(clock, node_id) -> Column:
    c, n = F.col(clock), F.lit(node_id).cast("long")
    others = F.map_filter(c, lambda k, v: k != n)
    return F.map_concat(others, F.create_map(n, F.coalesce(F.element_at(c, n), F.lit(0).cast("long")) + 1))


def dominates(a, b) -> Column:
    """Clock a is at least b for every node, and more for one."""
    d = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    return F.forall(d, lambda x: x >= 0) & F.exists(d, lambda x: x > 0)


def compare_clocks(a, b) -> Column:
    return F.when(dominates(a, b), "after").when(dominates(b, a), "before").when(F.forall(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))), lambda x: x == 0), "equal").otherwise("concurrent")


def resolve_clock(versions: DataFrame) -> DataFrame:
    """The value that no other version's clock dominates; of several, the last written, then the higher node's."""
    rows = versions.groupBy("data_key").agg(F.collect_list(F.struct("ts", "node_id", "clock", "value")).alias("vs"))  # a key's versions: one per replica
    kept = F.filter("vs", lambda a: ~F.exists(F.col("vs"), lambda b: dominates(b["clock"], a["clock"])))
    ordered = F.array_sort(F.transform(kept, lambda v: F.struct(v["ts"].alias("ts"), v["node_id"].alias("node_id"), v["value"].alias("value"))))
    return rows.select("data_key", F.element_at(ordered, -1)["value"].alias("value"))


def resolved_manual(versions: DataFrame) -> DataFrame:
    """Keys in conflict, for a person to settle, with their number of distinct values."""
    return versions.groupBy("data_key").agg(F.countDistinct("value").alias("values")).where("values > 1")


def ranked(versions: DataFrame) -> DataFrame:
    return versions.withColumn("rank", F.row_number().over(Window.partitionBy("data_key").orderBy(F.desc("ts"), F.desc("node_id"))))


def partition_statistics(placed: DataFrame) -> DataFrame:
    """(nodes, items, mean, least, most) over the primaries of placed keys."""
    return load(placed).agg(F.count("*").alias("nodes"), F.sum("items").alias("items"), F.avg("items").alias("mean"), F.min("items").alias("least"), F.max("items").alias("most"))


def recovery_mode(gap: str = "gap", has_snapshot: str = "has_snapshot", most: int = 1000) -> Column:
    """fast (from a snapshot) if a member lags by over ``most`` entries and there is a snapshot; else it replays the log."""
    return F.when((F.col(gap) > most) & F.col(has_snapshot), "fast").otherwise("replay")


def grants_vote(term: str, own_term: str, voted_for: str, candidate: str, last: tuple[str, str], own_last: tuple[str, str]) -> Column:
    """Whether a member votes for a candidate: its term is not older, no other has the vote in this term, and its log (last term, last index) is up to date."""
    free = (F.col(term) > F.col(own_term)) | F.col(voted_for).isNull() | (F.col(voted_for) == F.col(candidate))
    fresh = (F.col(last[0]) > F.col(own_last[0])) | ((F.col(last[0]) == F.col(own_last[0])) & (F.col(last[1]) >= F.col(own_last[1])))
    return (F.col(term) >= F.col(own_term)) & free & fresh


def accepts_entries(term: str, own_term: str, prev_index: str, prev_term: str, own_prev_term: str) -> Column:
    """Whether a member takes a leader's entries: the term is not older and the entry before them is the same in both logs (index 0: there is none)."""
    return (F.col(term) >= F.col(own_term)) & ((F.col(prev_index) == 0) | F.coalesce(F.col(prev_term) == F.col(own_prev_term), F.lit(False)))
