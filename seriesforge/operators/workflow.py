"""Resumable work queues, latest-wins records, content fingerprints and freshness along a graph of stages."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.scalars import allowed_transition, hash_fraction
from seriesforge.sources.tables import checkpointed


def enqueue(queue: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The queue with rows of `new` whose key it does not hold yet (insert or ignore)."""
    fresh = new.join(queue.select(*keys), keys, "left_anti")
    return queue.unionByName(fresh, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The table with rows replaced by key; of several new rows for a key the last by `order` counts."""
    fields = [c for c in table.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in fields])
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last)


def transition(queue: DataFrame, results: DataFrame, key: str, terminal: list[str]) -> DataFrame:
    """The queue with status moved where the move is allowed; other results are left out."""
    moved = results.select(key, F.col("status").alias("_to"))
    joined = queue.join(moved, key, "left")
    return joined.withColumn("status", F.when(allowed_transition("status", "_to", terminal), F.col("_to")).otherwise(F.col("status"))).drop("_to")


def next_chunk(queue: DataFrame, order: list[str], n: int) -> DataFrame:
    """The next n pending rows."""
    return queue.where("status = 'pending'").orderBy(*order).limit(n)


def status_counts(queue: DataFrame, keys: list[str], states: list[str]) -> DataFrame:
    """keys and a count for every status, zero included."""
    return queue.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key, by an aggregate and not a sort of its history."""
    fields = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in fields])


def stratified_sample(df: DataFrame, strata: list[str], row_id: str, n: int, seed: str) -> DataFrame:
    """At most n rows of each stratum, those with the least hash of seed and id. Groups shrink to n rows before they meet: a
    first pass keeps n for each stratum and hash slice."""
    keyed = df.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), F.col(row_id).cast("string")), 256)).withColumn("_s", F.substring("_h", 1, 2))
    first = Window.partitionBy(*strata, "_s").orderBy("_h", row_id)
    some = keyed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n)
    last = Window.partitionBy(*strata).orderBy("_h", row_id)
    return some.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_h", "_s", "_n")


def holdout(df: DataFrame, parts: list[Column], fraction: float, salt: str) -> DataFrame:
    """df with `held`, fixed by a hash of salt and key."""
    return df.withColumn("held", hash_fraction([F.lit(salt), *parts]) < fraction)


def pinned_ids(keys: DataFrame, registry: DataFrame, key: str, id_name: str) -> DataFrame:
    """key, id: ids issued before stay; new keys get the next numbers in the order of the key.

    Numbers are given in ranges of keys: each range counts for itself and adds the totals before it.
    """
    known = keys.select(key).distinct().join(registry.select(key, id_name), key, "left")
    top = F.lit(registry.agg(F.coalesce(F.max(id_name), F.lit(0)).alias("m")).first()["m"])
    new = checkpointed(known.where(F.col(id_name).isNull()).select(key).repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    before = new.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    numbered = new.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(key))).join(before, "_p")
    return known.where(F.col(id_name).isNotNull()).unionByName(numbered.select(key, (top + F.col("_before") + F.col("_n")).alias(id_name)))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and content: a digest that does not depend on the order of rows, so it is one aggregate at any size.

    Each field is preceded by its length, so no text can look like two, NULL differs from '', and -0.0 equals 0.0.
    """

    def canon(c: str) -> Column:
        x = F.col(c)
        if df.schema[c].dataType.simpleString() in ("double", "float"):
            x = F.when(x == 0, F.lit(0.0)).otherwise(x)
        text = x.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))

    digest = F.sha2(F.concat(*[canon(c) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *[F.coalesce(part(i), F.lit(0)).cast("string") for i in range(4)]).alias("content"))


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: everything downstream of the seeds along edges (src, dst). A round is a join; rounds are as many as the graph is deep."""
    seen = checkpointed(seeds.select("node").distinct())
    front = seen
    while not front.isEmpty():
        step = edges.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        front = checkpointed(step.join(seen, "node", "left_anti"))
        seen = checkpointed(seen.unionByName(front))
    return seen


def levels(nodes: DataFrame, edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """node, level: one more than the highest level before it. Nodes that nothing left leads to are peeled off, a level a round; where
    none can be, the rest has a cycle, which raises. Edges from unknown nodes don't count. most_rounds: raise on deeper graphs."""
    left = checkpointed(nodes.select("node").distinct())
    rest = checkpointed(edges.select("src", "dst").join(left.withColumnRenamed("node", "src"), "src", "left_semi"))
    out, level = None, 0
    while not left.isEmpty():
        free = checkpointed(left.join(rest.select(F.col("dst").alias("node")), "node", "left_anti"))
        if free.isEmpty() or (most_rounds is not None and level >= most_rounds):
            raise ValueError("the graph has a cycle" if free.isEmpty() else f"the graph is deeper than {most_rounds}")
        found = free.select("node", F.lit(level).alias("level"))
        out = found if out is None else out.unionByName(found)
        left = checkpointed(left.join(free, "node", "left_anti"))
        rest = checkpointed(rest.join(free.withColumnRenamed("node", "src"), "src", "left_anti"))
        level += 1
    return out if out is not None else nodes.select("node", F.lit(0).alias("level"))


def unmet(tasks: DataFrame, needs: DataFrame, done: list[str]) -> DataFrame:
    """task, missing: the needs (task, need) of open tasks (task, status) that are not done, in order; a need that is no task is never done."""
    state = tasks.select(F.col("task").alias("need"), F.col("status").alias("_s"))
    waits = needs.join(tasks.where(~F.col("status").isin(done)).select("task"), "task").join(state, "need", "left").where(~F.coalesce(F.col("_s").isin(done), F.lit(False)))
    return waits.groupBy("task").agg(F.sort_array(F.collect_set("need")).alias("missing"))


def next_up(tasks: DataFrame, needs: DataFrame, done: list[str], order: list[str], n: int) -> DataFrame:
    """The first n open tasks without unmet needs."""
    return tasks.where(~F.col("status").isin(done)).join(unmet(tasks, needs, done).select("task"), "task", "left_anti").orderBy(*order).limit(n)


def rerun_plan(states: DataFrame, depth: DataFrame) -> DataFrame:
    """stage, position of what is not FRESH, what others depend on first. Few rows: one for each stage."""
    open_ = states.where("verdict <> 'FRESH'").join(depth.withColumnRenamed("node", "stage"), "stage")
    return open_.select("stage", F.row_number().over(Window.orderBy("level", "stage")).alias("position"))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, after raising if a key has several rows."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"several rows of one key, such as {twice[0]}")
    return df


def verdicts(stages: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """stage, verdict: MISSING (no record), REDEFINED (other code), STALE (other input content) or FRESH."""
    joined = stages.join(recorded, "stage", "left").join(current, "stage", "left")
    return joined.select(
        "stage",
        F.when(F.col("recorded_content").isNull(), "MISSING").when(~F.col("recorded_code").eqNullSafe(F.col("code")), "REDEFINED").when(~F.col("recorded_content").eqNullSafe(F.col("content")), "STALE").otherwise("FRESH").alias("verdict"),
    )
