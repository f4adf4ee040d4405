"""Long-lived memory of subjects: upsert with supersession, scored fetch, summary, triples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import dot
from ..functions.rules import effective_distance, ema, recency_score, source_bucket, source_weight
from ..session import small_side
from .corpus import keep_first
from .nearest import matrix
from .retrieval import top_k

#: Types of which a room has one active value.
EXCLUSIVE = ("anatomy", "condition", "imaging")


def upsert(observations: DataFrame) -> DataFrame:
    """State after all observations (subject, room, type, value, confidence, ord) were applied in order.

    A value seen again while active moves its confidence; another value of an exclusive type in the room supersedes it, so a
    value that returns begins anew (``superseded_by``: the observation that ended it, or -1).  A run is an island of equal values of an exclusive slot, or all of a value otherwise.
    """
    exclusive = F.col("type").isin(*EXCLUSIVE) & F.col("room").isNotNull()
    own = observations.where(F.trim("value") != "").withColumn("slot", F.when(exclusive, F.lit("")).otherwise(F.col("value")))
    room = F.coalesce("room", F.lit(""))
    order = Window.partitionBy("subject", room, "type", "slot").orderBy("ord")
    own = own.withColumn("_new", F.when(F.lag("value").over(order).eqNullSafe(F.col("value")), 0).otherwise(1))
    own = own.withColumn("run", F.sum("_new").over(order))
    seen = F.array_sort(F.collect_list(F.struct("ord", "confidence")))
    runs = own.groupBy("subject", "room", "type", "slot", "run", "value").agg(ema(F.transform(seen, lambda x: x["confidence"])).alias("e"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    after = Window.partitionBy("subject", F.coalesce("room", F.lit("")), "type", "slot").orderBy("run")
    return runs.select(
        "subject", "room", "type", "value", F.round("e.c", 6).alias("confidence"), F.col("e.n").cast("long").alias("evidence"), "first_ord", "last_ord",
        F.coalesce(F.lead("first_ord").over(after), F.lit(-1)).cast("long").alias("superseded_by"),
    )


def fetch(memory: DataFrame, now: Column, newest: int = 64, k: int = 8) -> DataFrame:
    """The best ``k`` of the ``newest`` active rows (subject, value, confidence, evidence, ts, ord) of each subject."""
    recent = top_k(memory, "subject", [F.desc("ts"), F.desc("ord")], newest, "age_rank")
    hours = F.greatest((F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9, F.lit(0.0))
    scored = recent.withColumn("score", F.round(recency_score(F.col("confidence"), hours, F.col("evidence")), 6))
    return top_k(scored, "subject", [F.desc("score"), F.desc("ts"), F.desc("ord")], k)


def summary(memory: DataFrame, newest: int = 12) -> DataFrame:
    """For each subject and type the distinct values of the newest rows, in the order of their last sight."""
    recent = top_k(memory, "subject", [F.desc("ts"), F.desc("ord")], newest, "age_rank")
    first = recent.groupBy("subject", "type", "value").agg(F.min("age_rank").alias("r"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]), ",")
    return first.groupBy("subject", "type").agg(names.alias("distinct_values"), F.count(F.lit(1)).alias("n"))


#: Predicate of a type of entity.
PREDICATES = {"click": "clicked", "view": "viewed", "purchase": "bought"}


def triples(entities: DataFrame) -> DataFrame:
    """subject, predicate, object: what it was, and where."""
    predicate = F.lit("has")
    for t, p in PREDICATES.items():
        predicate = F.when(F.col("type") == t, p).otherwise(predicate)
    both = F.array(F.struct(predicate.alias("predicate"), F.col("value").alias("object")), F.struct(F.lit("in_room").alias("predicate"), F.col("room").alias("object")))
    return entities.select("subject", F.explode(both).alias("t")).select("subject", "t.predicate", "t.object").where("object is not null").distinct()


LOCUS = "subject string, room string, type string, value string, confidence double, evidence bigint, first_ord bigint, last_ord bigint, superseded_by bigint"


def recorded(rows: list[tuple], seen: list[tuple[int, str, float]], exclusive: bool) -> list[tuple]:
    """The loci (value, confidence, evidence, first_ord, last_ord, superseded_by) of one subject, room and type after further observations
    (ord, value, confidence) in order; ``superseded_by`` is -1 for active ones."""
    done = [r for r in rows if r[5] != -1]
    active = {r[0]: list(r) for r in rows if r[5] == -1}
    for at, value, c in sorted(seen):
        old = active.get(value)
        if old is None:
            active[value] = [value, max(0.05, min(1.0, c)), 1, at, at, -1]
        else:
            alpha = 0.35 if old[2] < 3 else 0.2
            old[1:3] = max(0.05, min(1.0, (1 - alpha) * old[1] + alpha * c)), min(old[2] + 1, 12)
            old[4] = at
        if exclusive:
            now = active[value]
            done += [(*r[:5], now[3]) for v, r in active.items() if v != value]
            active = {value: now}
    return done + [tuple(r) for r in active.values()]


def merged(stored: DataFrame, observations: DataFrame) -> DataFrame:
    """Stored loci after further observations (subject, room, type, value, confidence, ord), which come after all that is stored.

    The same as ``upsert`` over all observations so far, and as ``recorded`` for each subject, room and type: an active locus begins the run
    of its slot, and windows and sums say the rest, so groups may be as many or as large as Spark sorts.
    """
    keys = ["subject", "room", "type"]
    names = [x.split()[0] for x in LOCUS.split(", ")]
    plain = lambda df, *cols: df.select(F.col("subject").cast("string").alias("subject"), F.coalesce("room", F.lit("")).alias("room"), F.coalesce("type", F.lit("")).alias("type"), *cols)
    own, none = plain(stored, *names[3:]), F.lit(None)
    held = F.struct(F.col("confidence").alias("c"), F.col("evidence").cast("int").alias("n"), "first_ord", "last_ord")
    old = own.where("superseded_by = -1").select(*keys, "value", held.alias("held"), none.cast("long").alias("ord"), none.cast("double").alias("confidence"))
    new = plain(observations.where(F.trim("value") != ""), "value", none.cast(old.schema["held"].dataType).alias("held"), F.col("ord").cast("long").alias("ord"), F.col("confidence").cast("double").alias("confidence"))
    exclusive = F.col("type").isin(*EXCLUSIVE) & (F.col("room") != "")
    rows = old.unionByName(new).withColumn("slot", F.when(exclusive, F.lit("")).otherwise(F.col("value")))
    # what is stored has no ord and comes first
    order = Window.partitionBy(*keys, "slot").orderBy(F.asc_nulls_first("ord"), "value", "confidence")
    rows = rows.withColumn("_new", F.when(F.lag("value").over(order).eqNullSafe(F.col("value")), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("_new").over(order))
    seen = F.array_sort(F.collect_list(F.when(F.col("held").isNull(), F.struct("ord", "confidence"))))
    runs = rows.groupBy(*keys, "slot", "run", "value").agg(F.max("held").alias("held"), seen.alias("seen"))
    ords = F.transform("seen", lambda x: x["ord"])
    after = Window.partitionBy(*keys, "slot").orderBy("run")
    moved = ema(F.transform("seen", lambda x: x["confidence"]), F.col("held"))
    runs = runs.select(*keys, "slot", "run", "value", moved.alias("e"), F.coalesce("held.first_ord", F.array_min(ords)).alias("first_ord"), F.coalesce(F.array_max(ords), "held.last_ord").alias("last_ord"))
    runs = runs.select(*keys, "value", F.col("e.c").alias("confidence"), F.col("e.n").cast("long").alias("evidence"), "first_ord", "last_ord", F.coalesce(F.lead("first_ord").over(after), F.lit(-1)).cast("long").alias("superseded_by"))
    return runs.unionByName(own.where("superseded_by != -1")).withColumn("room", F.nullif("room", F.lit(""))).select(*names)


#: Memories and queries of a group that meet in one call, and queries multiplied at a time.
TILE, ASKED, BLOCK = 8192, 16_384, 256
#: What a product of matrices may differ from the sum in order, in units of the sixth place; vectors of less than a million components stay far below.
SLACK = 1e-3


def near_pairs(v: np.ndarray, n: np.ndarray, q: np.ndarray, qn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (place of query, place of memory, 1 - cosine) that hold each query's ``k`` first by that distance to six places and the place of the memory.

    Products of matrices find them, with the few more that their last digits leave in doubt; of these the products are summed in order, as Spark does it.
    """
    out = []
    place = np.arange(n.size, dtype=np.float64)
    for at in range(0, qn.size, BLOCK):
        with np.errstate(all="ignore"):
            x = np.abs(1 - (q[at : at + BLOCK] @ v.T) / (qn[at : at + BLOCK, None] * n)) * 1e6 + 0.5
        x[~np.isfinite(x)] = 4e6  # NaN comes last
        low = np.floor(x - SLACK) * n.size + place
        if n.size > k:
            high = np.floor(x + SLACK) * n.size + place
            a, b = np.nonzero(low <= np.partition(high, k - 1, axis=1)[:, k - 1 : k])
        else:
            a, b = np.nonzero(np.ones_like(low))
        a += at
        for part in range(0, a.size, 1 << 16):
            i, m = a[part : part + (1 << 16)], b[part : part + (1 << 16)]
            total = np.zeros(i.size)
            with np.errstate(all="ignore"):
                for c in range(v.shape[1]):
                    total += v[m, c] * q[i, c]
                out.append((i, m, 1 - total / (n[m] * qn[i])))
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def near_candidates(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Of each query (query_id, subject, _asked, _q, _qn) its ``k`` nearest memories (with _n, the length of the vector) of the subject and room and some more: as ``held`` without the
    vector, with ``distance``.

    Memories and queries of a subject and room (or of all rooms) meet tile by tile, so a task holds one tile of either side however large a group is, and about
    ``k`` rows a query and tile leave it. Every pair of a group is compared: that is the exact search.
    """
    spark = held.sparkSession
    kept = [c for c in held.columns if c not in ("subject", "vector", "_n")]
    group = ["subject", "_every", "_room"]
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = asked.where("subject is not null").withColumns({"subject": F.col("subject").cast(held.schema["subject"].dataType), "_every": F.col("_asked").isNull(), "_room": F.coalesce("_asked", F.lit(""))})
    rooms = F.array(F.struct(F.lit(True).alias("e"), F.lit("").alias("r")), F.struct(F.lit(False).alias("e"), F.col("room").alias("r")))
    items = held.withColumn("_g", F.explode(rooms)).where("_g.r is not null").withColumns({"_every": F.col("_g.e"), "_room": F.col("_g.r")}).drop("_g")
    # only groups that are asked travel; those of more than a tile, at most one a tile of rows, are counted before
    groups = small_side(asked.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("_blocks")))
    counted = items.join(groups.select(*group), group, "left_semi").groupBy(*group).count().where(F.col("count") > TILE)
    large = spark.createDataFrame(counted.select(*group, F.ceil(F.col("count") / TILE).cast("int").alias("_tiles")).toArrow())
    large = small_side(large.select(*(F.col(c).cast(items.schema[c].dataType).alias(c) for c in group), F.col("_tiles").cast("int").alias("_tiles")))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(F.col(n), F.lit(1))).cast("int")
    left = items.join(groups, group).join(large, group, "left").withColumn("_tile", deal("ord", "_tiles")).withColumn("_block", every(F.col("_blocks"))).drop("_tiles", "_blocks")
    right = asked.join(large, group, "left").join(groups, group).withColumn("_block", deal("query_id", "_blocks")).withColumn("_tile", every(F.coalesce("_tiles", F.lit(1)))).drop("_tiles", "_blocks")
    # vectors of different lengths do not compare
    left, right = left.withColumn("_dim", F.size("vector")), right.withColumn("_dim", F.size("_q"))
    types = {"query_id": asked.schema["query_id"].dataType, "_asked": asked.schema["_asked"].dataType} | {c: held.schema[c].dataType for c in kept}

    def pair(own: pa.Table, other: pa.Table) -> pa.Table:
        # places follow ord, nulls first, as Spark sorts
        own = own.take(pc.sort_indices(own, sort_keys=[("ord", "ascending")], null_placement="at_start")).combine_chunks()
        other = other.combine_chunks()
        i, m, x = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if own.num_rows and other.num_rows:
            dim = own["_dim"][0].as_py()
            (v, n), (q, qn) = ((matrix(t[a].combine_chunks(), dim), t[b].to_numpy()) for t, a, b in ((own, "vector", "_n"), (other, "_q", "_qn")))
            i, m, x = near_pairs(v, n, q, qn, k)
        queries, memories = other.select(["query_id", "_asked"]).take(pa.array(i)), own.select(kept).take(pa.array(m))
        return pa.table([*queries.columns, *memories.columns, pa.array(x)], names=["query_id", "_asked", *kept, "distance"])

    by = [*group, "_tile", "_block", "_dim"]
    schema = ", ".join(f"`{c}` {t.simpleString()}" for c, t in types.items()) + ", distance double"
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(pair, schema)


def nearest(memory: DataFrame, queries: DataFrame, n: int = 6, penalty: Column | None = None) -> DataFrame:
    """query_id, rank, room, type, value, distance, effective: the best ``n`` memories of the query's own subject.

    ``memory``: subject, room, type, value, vector, confidence, source, ord; ``queries``: query_id, subject, rooms (none: all), vector.
    For each room the ``3 n`` nearest by cosine distance (12 at least) are taken, of equal room, type and value the nearest; these are ranked by the
    distance plus ``penalty`` and what an unsure memory or a weak source adds. Subjects meet by an equal key alone: there is no
    global search. Rows without a subject, a value or a vector of positive length have no part, nor have pairs of vectors of unequal numbers of components.
    """
    length = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    asked = queries.select("query_id", "subject", F.explode_outer("rooms").alias("_asked"), F.col("vector").alias("_q")).withColumn("_qn", length("_q")).where("_qn > 0")
    held = memory.where(F.trim("value") != "").withColumn("_n", length("vector")).where("_n > 0")
    held = held.select("subject", "room", "type", "value", "confidence", "source", "ord", F.col("vector").cast("array<double>").alias("vector"), "_n")
    asked = asked.withColumn("_q", F.col("_q").cast("array<double>"))
    both = near_candidates(held, asked, max(3 * n, 12)).withColumns({"_asked": F.coalesce("_asked", F.lit("")), "distance": F.abs(F.round("distance", 6))})
    near = both.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_asked").orderBy("distance", "ord"))).where(F.col("_r") <= max(3 * n, 12))
    near = keep_first(near.withColumn("_v", F.lower(F.trim("value"))), ["query_id", "room", "type", "_v"], ["distance", "ord"])
    weight = source_weight(source_bucket(F.col("source")))
    far = effective_distance(F.col("distance"), penalty if penalty is not None else F.lit(0.0), F.col("confidence"), weight)
    best = top_k(near.withColumn("effective", F.round(far, 6)), "query_id", [F.asc("effective"), F.asc("distance"), F.asc("ord")], n)
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "room", "type", "value", "ord", "distance", "effective")


def bucket_of(subject: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(subject).cast("string") if isinstance(subject, str) else subject.cast("string")), F.lit(buckets)).cast("int")


def keep_vectors(memory: DataFrame, path: str, buckets: int = 256) -> None:
    """Memory with vectors in folders by the hash of the subject, and within by room, so that a query reads its own bucket."""
    own = memory.withColumn("bucket", bucket_of("subject", buckets))
    own.repartition("bucket", F.pmod(F.xxhash64("subject", "ord"), F.lit(8))).sortWithinPartitions("bucket", "subject", "room").write.mode("overwrite").partitionBy("bucket").parquet(path)


def kept_vectors(spark, path: str, queries: DataFrame, buckets: int = 256) -> DataFrame:
    """The rows of the buckets of the queries' subjects: one scan, pruned by its folders, and by room where all queries name rooms."""
    asked = [r[0] for r in queries.select(bucket_of("subject", buckets)).distinct().collect()]  # as many as there are buckets at most
    rows = spark.read.parquet(path).where(F.col("bucket").isin(asked))
    rooms = queries.agg(F.collect_set(F.when(F.size("rooms") > 0, F.lit(1)).otherwise(0)).alias("named"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("rooms")))).alias("rooms")).first()
    return (rows.where(F.col("room").isin(rooms.rooms)) if rooms.named == [1] else rows).drop("bucket")
