"""Mixing sources to target weights by Pfair scheduling.

A source of integer weight n among live weights that add up to D releases its block k at slot
floor(k D / n) and must have emitted it by slot ceil((k + 1) D / n).  Taking the released block of
the earliest deadline in every slot (ties: the source named first) keeps every source within
less than one block of its share at every slot.  When a source runs out, the weights of
the live ones share the slots anew from there on, so that every row is kept.

The schedule of a phase repeats every D slots.  It depends only on the weights and on one block
count per source group, so the driver computes a period per phase and the rows look their slots
up in it: the plan holds groups x D entries whatever the input's size.  Rows are ordered within a
source by the MD5 of their id; ranks come from counts per slice of the hash space, so that a
source that holds a third of all rows is numbered by many tasks.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseflow.llm.common import free_prefix

#: Shares of the sources of documents; nulls and unknown names belong to the group of REST.  src8 to src19
#: divide what they had as part of that group, 12, so that the shares of src0 to src7 stay what they were.
WEIGHTS = {"src0": 8, "src1": 6, "src2": 5, "src3": 4, "src4": 4, "src5": 3, "src6": 3, "src7": 3, **{f"src{i}": 1 for i in range(8, 20)}}
REST, REST_WEIGHT = "*", 12
BLOCK_ROWS = 8
#: Bounds of the plan: the sum of all weights, and slices of the hash space per source.
MOST_WEIGHT, LEAST_SLICES, MOST_SLICES, ROWS_PER_SLICE = 10_000, 256, 65_536, 20_000


def period(weights: dict[str, int]) -> list[str]:
    """The source of each slot of one period: earliest deadline first among released blocks."""
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    slots = []
    for t in range(total):
        released = [(-(-(done[s] + 1) * total // n), i, s) for i, (s, n) in enumerate(weights.items()) if done[s] * total // n <= t]
        source = min(released)[2]
        done[source] += 1
        slots.append(source)
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """For each set of live sources: first slot, blocks of each source before it, and the period."""
    taken, start, out = dict.fromkeys(weights, 0), 0, []
    while live := {s: n for s, n in weights.items() if taken[s] < blocks.get(s, 0)}:
        slots = period(live)
        places = {s: [t for t, x in enumerate(slots) if x == s] for s in live}
        ends = {}
        for s, n in live.items():
            k = blocks[s] - taken[s] - 1
            ends[s] = k // n * len(slots) + places[s][k % n] + 1
        length = min(ends.values())
        out.append({"start": start, "taken": dict(taken), "slots": len(slots), "places": places})
        for s, n in live.items():
            taken[s] += length // len(slots) * n + sum(t < length % len(slots) for t in places[s])
        start += length
    return out


#: Phases of each source and short blocks, as the rows look them up.
PLAN, SHORTS = "map<string,array<struct<taken:bigint,start:bigint,slots:bigint,places:array<bigint>>>>", "array<struct<at:bigint,missing:bigint>>"


def literal(value: dict | list, kind: str) -> Column:
    """One constant, whatever its size: an expression per entry would outgrow what Spark compiles."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def mix_sources(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    rest_weight: int = REST_WEIGHT,
    block_rows: int = BLOCK_ROWS,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Adds ``mix_group, mix_block, mix_slot, mix_position`` to all rows.

    ``mix_position`` numbers the rows of the mixed stream from 0 without gaps.  Nulls and
    unnamed sources belong to the group ``*``.  Repeated rows and null ids keep their places
    (ties have any order among equals).  An empty table stays empty.  Existing columns of
    these names are replaced.  Two shuffles of the rows' columns: one here, by source and hash slice.
    """
    weights = {**(WEIGHTS if weights is None else weights), REST: rest_weight}
    if min(weights.values()) < 1 or sum(weights.values()) > MOST_WEIGHT:
        raise ValueError(f"weights must be integers of at least 1 that add up to {MOST_WEIGHT} at most")
    names = list(weights)
    docs = docs.drop("mix_group", "mix_block", "mix_slot", "mix_position")
    source = F.col(source_col).cast("string")
    group = F.when(source.isin(names[:-1]), source).otherwise(F.lit(REST))

    counts = docs.groupBy(group.alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col(id_col).isNull()).alias("nameless")).collect()  # a row per weight at most
    sizes, nameless = {r["g"]: r["n"] for r in counts}, sum(r["nameless"] for r in counts)
    rows = sum(sizes.values())
    if not rows:
        empty = F.lit(None).cast("long")
        return docs.select("*", group.alias("mix_group"), empty.alias("mix_block"), empty.alias("mix_slot"), empty.alias("mix_position"))
    slices = min(MOST_SLICES, max(LEAST_SLICES, -(-rows // ROWS_PER_SLICE)))
    plan = phases({s: -(-n // block_rows) for s, n in sizes.items()}, weights)

    p = free_prefix(docs.columns)
    # Rows without id are spread over the slices by what else they hold.
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if nameless and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.xxhash64(*others).cast("string")) if nameless else F.lit("")))
    numbered = docs.select("*", group.alias("mix_group"), digest.alias(f"{p}digest"))
    numbered = numbered.withColumn(f"{p}slice", F.expr(f"conv(substr({p}digest, 1, 4), 16, 10)::bigint * {slices} div 65536"))
    before = (
        docs.select(group.alias("mix_group"), digest.alias(f"{p}digest"))
        .select("mix_group", F.expr(f"conv(substr({p}digest, 1, 4), 16, 10)::bigint * {slices} div 65536").alias(f"{p}slice"))
        .groupBy("mix_group", f"{p}slice")
        .agg(F.count("*").alias("n"))
        .select("mix_group", f"{p}slice", (F.sum("n").over(W.partitionBy("mix_group").orderBy(f"{p}slice")) - F.col("n")).alias(f"{p}before"))
    )
    within = F.row_number().over(W.partitionBy("mix_group", f"{p}slice").orderBy(f"{p}digest", F.col(id_col)))
    ranked = numbered.withColumn(f"{p}within", within.cast("long") - 1).join(before, ["mix_group", f"{p}slice"]).withColumn(f"{p}rank", F.col(f"{p}before") + F.col(f"{p}within"))
    ranked = ranked.withColumn("mix_block", F.expr(f"{p}rank div {block_rows}"))

    by_group = {s: [{"taken": x["taken"][s], "start": x["start"], "slots": x["slots"], "places": x["places"][s]} for x in plan if s in x["places"]] for s in sizes}
    shorts = []  # the last block of a source may be short
    for name in [s for s in names if sizes.get(s, 0) % block_rows]:
        last = -(-sizes[name] // block_rows) - 1
        phase = [x for x in by_group[name] if x["taken"] <= last][-1]
        k, n = last - phase["taken"], len(phase["places"])
        shorts.append({"at": phase["start"] + k // n * phase["slots"] + phase["places"][k % n], "missing": block_rows - sizes[name] % block_rows})
    ranked = ranked.withColumn(f"{p}phase", F.element_at(F.filter(F.element_at(literal(by_group, PLAN), F.col("mix_group")), lambda x: x["taken"] <= F.col("mix_block")), -1))
    ranked = ranked.withColumn("mix_slot", F.expr(f"""{p}phase.start + (mix_block - {p}phase.taken) div size({p}phase.places) * {p}phase.slots
        + element_at({p}phase.places, cast((mix_block - {p}phase.taken) % size({p}phase.places) + 1 as int))"""))
    short = F.aggregate(literal(shorts, SHORTS), F.lit(0).cast("long"), lambda n, x: n + F.when(F.col("mix_slot") > x["at"], x["missing"]).otherwise(0))
    position = F.col("mix_slot") * block_rows + F.col(f"{p}rank") % block_rows - short
    return ranked.withColumn("mix_position", position).select(*docs.columns, "mix_group", "mix_block", "mix_slot", "mix_position")


def in_mixed_order(mixed: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` rows of ``mix_sources`` in mixed order: partition p holds the p-th stretch of positions, sorted."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("mix_position") * n / max(1, rows)).cast("int")
    return mixed.repartitionById(n, F.coalesce(part, F.lit(0))).sortWithinPartitions("mix_position")


def op1_mix_sources(spark, sf_dir):
    """Every document's place in the mixed stream."""
    from caseflow.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", "mix_group", "mix_block", "mix_slot", "mix_position")


def op1_sql() -> str:
    """The same by simulating every slot: a recursive query over the count of blocks that each source has emitted."""
    names, n = [*WEIGHTS, REST], [*WEIGHTS.values(), REST_WEIGHT]
    g = "CASE WHEN source IN (" + ", ".join(f"'{s}'" for s in WEIGHTS) + f") THEN source ELSE '{REST}' END"
    total = "list_sum(list_transform(range(1, 10), lambda i: CASE WHEN base[i] < blocks[i] THEN w[i] ELSE 0 END))"
    pick = (
        "list_min(list_transform(range(1, 10), lambda i: CASE WHEN base[i] < blocks[i] AND ((taken[i] - base[i]) * total) // w[i] <= t - start "
        "THEN ((((taken[i] - base[i] + 1) * total + w[i] - 1) // w[i]) * 100 + i) ELSE 1000000000000 END))"
    ).replace("range(1, 10)", f"range(1, {len(names) + 1})")
    total = total.replace("range(1, 10)", f"range(1, {len(names) + 1})")
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, {g} AS mix_group,
         row_number() OVER (PARTITION BY {g} ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rk
  FROM documents),
conf AS (
  SELECT CAST([{", ".join(map(str, n))}] AS BIGINT[]) AS w, CAST([{", ".join(f"(SELECT (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} FROM docs WHERE mix_group = '{s}')" for s in names)}] AS BIGINT[]) AS blocks),
sim(t, start, base, taken, src) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), list_transform(w, lambda x: CAST(0 AS BIGINT)), list_transform(w, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM conf
  UNION ALL
  SELECT t, CASE WHEN ended THEN t + 1 ELSE start END, CASE WHEN ended THEN now ELSE base END, now, src FROM (
    SELECT t, start, base, now, src, blocks, now[src] = blocks[src] AS ended FROM (
      SELECT t, start, base, blocks, src, list_transform(range(1, {len(names) + 1}), lambda i: taken[i] + CASE WHEN i = src THEN 1 ELSE 0 END) AS now FROM (
        SELECT t, start, base, taken, blocks, CAST({pick} % 100 AS BIGINT) AS src FROM (
          SELECT s.t + 1 AS t, s.start, s.base, s.taken, c.w, c.blocks, CAST({total.replace("base[", "s.base[").replace("blocks[", "c.blocks[").replace("w[", "c.w[")} AS BIGINT) AS total
          FROM sim s, conf c WHERE list_sum(s.taken) < list_sum(c.blocks)) a) b) d) e),
slots AS (
  SELECT t AS mix_slot, [{", ".join(f"'{s}'" for s in names)}][src] AS mix_group, taken[src] - 1 AS mix_block FROM sim WHERE t >= 0)
SELECT doc_id, source, d.mix_group, CAST(d.rk // {BLOCK_ROWS} AS BIGINT) AS mix_block, CAST(s.mix_slot AS BIGINT) AS mix_slot,
       CAST(row_number() OVER (ORDER BY s.mix_slot, d.rk) - 1 AS BIGINT) AS mix_position
FROM docs d JOIN slots s ON s.mix_group = d.mix_group AND s.mix_block = d.rk // {BLOCK_ROWS}"""
