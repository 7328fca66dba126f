"""Spans, business flows, network flows and similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .graph import written

#: Vectors, and queries, that a task of the similarity search holds at once, on average.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 512


def red(spans: DataFrame, keys: list[str], target_ms: float = 300) -> DataFrame:
    """Calls, errors, mean, longest, quantiles and Apdex."""
    h = spans.withColumn("_b", stats.bucket(F.col("duration_ms"))).groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"), F.max("duration_ms").alias("max_ms"), stats.histogram(F.col("_b")).alias("h"))
    quantiles = [F.round(stats.quantile(F.col("h"), p), 6).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)]
    return h.select(*keys, "calls", "errors", F.round(F.col("errors") / F.col("calls"), 5).alias("error_rate"), "avg_ms", "max_ms", *quantiles, F.round(stats.apdex(F.col("h"), target_ms), 6).alias("apdex"))


def search(spans: DataFrame, least_ms: float, most: int) -> DataFrame:
    """Longest traces of at least a duration, with their first span's service."""
    t = spans.groupBy("trace_id").agg(F.count("*").alias("spans"), F.count_if("error").alias("errors"), F.min("start_ms").alias("lo"), F.max(F.col("start_ms") + F.col("duration_ms")).alias("hi"), F.min_by("service", F.struct("start_ms", "span_id")).alias("root"))
    return t.withColumn("length_ms", F.col("hi") - F.col("lo")).where(F.col("length_ms") >= least_ms).orderBy(F.desc("length_ms"), "trace_id").limit(most).select("trace_id", "spans", "errors", "length_ms", "root")


#: Powers of two up to which a span's length in ms goes: a day. Spans of a trace whose enclosers are looked for among all of them.
LENGTHS, SMALL = 27, 64


def parents(spans: DataFrame, slack_ms: float = 0.5, small: int = SMALL) -> DataFrame:
    """The parent of each span: the one it names, else the tightest earlier span of the trace that encloses it.

    Earlier is by start, then longer first, then identifier; of equally tight
    ones the last. The encloser must be of another service, or the span a call
    outwards from one that isn't, or the encloser a user's or a device's.

    Spans of a trace of up to `small` ones, as nearly all are, look at each other.
    In larger ones an encloser lies in the one or two slots of its own length's
    power of two, and a span looks into one slot of each power: no key holds a
    whole large trace.
    """
    length = lambda ms: F.least(F.lit(LENGTHS), F.ceil(F.log2(ms + 2 * slack_ms + 1)).cast("int"))
    slot = lambda at, level: F.floor(at / F.pow(F.lit(2.0), level)).cast("bigint")
    # At most one row for each `small` spans.
    large = written(spans.groupBy("trace_id").agg(F.count("*").alias("n")).where(F.col("n") > small).select("trace_id"))
    named = spans.select("trace_id", F.col("span_id").alias("parent_ref"), F.col("service").alias("n_service"))
    refers = spans.where("parent_ref IS NOT NULL AND parent_ref <> span_id").select("trace_id", "parent_ref").distinct()
    # Only spans that some other names are looked up.
    named = named.join(refers, ["trace_id", "parent_ref"], "left_semi")
    known = written(spans.join(named, ["trace_id", "parent_ref"], "left").withColumn("named", F.coalesce(F.col("n_service").isNotNull() & (F.col("parent_ref") != F.col("span_id")), F.lit(False))))
    p = spans.where("kind <> 'log'").select("trace_id", F.col("span_id").alias("p_id"), F.col("service").alias("p_service"), F.col("kind").alias("p_kind"), F.col("start_ms").alias("p_start"), F.col("duration_ms").alias("p_ms"))
    c = known.where("NOT named").select("trace_id", "span_id", "service", "kind", "start_ms", "duration_ms")
    few = c.join(large, "trace_id", "left_anti").join(p, "trace_id")
    leveled = p.join(large, "trace_id", "left_semi").withColumn("level", length(F.col("p_ms")))
    first = slot(F.col("p_start") - slack_ms, F.col("level"))
    leveled = leveled.select("*", F.explode(F.array(first, first + 1)).alias("slot"))
    looks = c.join(large, "trace_id", "left_semi").select("*", F.explode(F.sequence(F.greatest(F.lit(0), length(F.col("duration_ms")) - 2), F.lit(LENGTHS))).alias("level"))
    many = looks.withColumn("slot", slot(F.col("start_ms"), F.col("level"))).join(leveled, ["trace_id", "level", "slot"]).drop("level", "slot")
    inside = (F.col("p_start") <= F.col("start_ms") + slack_ms) & (F.col("start_ms") + F.col("duration_ms") <= F.col("p_start") + F.col("p_ms") + slack_ms)
    earlier = F.struct("p_start", -F.col("p_ms"), "p_id") < F.struct("start_ms", -F.col("duration_ms"), "span_id")
    out = ("db", "client", "external", "producer")
    fits = (F.col("p_service") != F.col("service")) | (F.col("kind").isin(*out) & ~F.col("p_kind").isin(*out)) | F.col("p_kind").isin("user", "mobile")
    tightest = F.min_by(F.struct("p_id", "p_service"), F.struct("p_ms", -F.col("p_start"), -F.col("p_id"))).alias("b")
    best = lambda j: j.where(inside & earlier & fits).groupBy("trace_id", "span_id").agg(tightest)
    made = known.join(best(few).unionByName(best(many)), ["trace_id", "span_id"], "left")
    pick = lambda own, other: F.when(F.col("named"), F.col(own)).otherwise(F.col(other))
    return made.select("trace_id", "span_id", "service", "kind", "start_ms", "duration_ms", "error", pick("parent_ref", "b.p_id").alias("parent_id"), pick("n_service", "b.p_service").alias("parent_service"), (~F.col("named") & F.col("b").isNotNull()).alias("inferred"))


def _at(share: float) -> Column:
    """Aggregate: the duration at index floor(share x n) of the sorted ones."""
    return F.expr(f"percentile_disc({share} + 1e-12D) WITHIN GROUP (ORDER BY duration_ms)")


def edges(with_parents: DataFrame) -> DataFrame:
    """Calls that cross services: how many, with errors, by inference, and the p50 and p95 of their durations."""
    crossing = with_parents.where("parent_id IS NOT NULL AND parent_service <> service AND kind <> 'log'")
    return crossing.groupBy(F.col("parent_service").alias("src"), F.col("service").alias("dst")).agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"), F.count_if("inferred").alias("inferred"), _at(0.5).alias("p50"), _at(0.95).alias("p95"))


def self_times(spans: DataFrame, with_parents: DataFrame, *also: str) -> DataFrame:
    """Duration less that of the children, at least 0, and the columns `also` of `spans`."""
    kids = with_parents.where("parent_id IS NOT NULL AND kind <> 'log'").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("duration_ms").alias("kids_ms"))
    return spans.join(kids, ["trace_id", "span_id"], "left").select("trace_id", "span_id", F.greatest(F.lit(0.0), F.col("duration_ms") - F.coalesce("kids_ms", F.lit(0.0))).alias("self_ms"), *also)


def depths(with_parents: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth): how many spans lie on the way up from a span, itself not counted.

    Each round doubles the distance that pointers reach, until all have ended. In
    a circle of parents, which ends nowhere, the way stops at a span that it has
    met, which counts once more: its length is that of the way into the circle and
    the circle together.
    """
    ways = ["trace_id", "span_id", "up", "depth"]
    at = with_parents.select("trace_id", "span_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))
    longest = at.groupBy("trace_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # Ways that have ended are written once; a round writes only those that go on.
    ended, going = at.where("up IS NULL"), written(at.where("up IS NOT NULL"))
    ended = written(ended)
    reach = 1
    while reach < 2 * longest and not going.isEmpty():
        above = ended.unionByName(going).select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        after = written(going.join(above, ["trace_id", "up"], "left").select("trace_id", "span_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        ended, going = ended.unionByName(after.where("up IS NULL").select(*ways)), after.where("up IS NOT NULL")
        reach *= 2
    ended = ended.select("trace_id", "span_id", "depth")
    # Pointers that are left lie on circles by now, since they have gone further than any trace has spans.
    stuck = going.select("trace_id", "span_id")
    edges = with_parents.select("trace_id", "span_id", "parent_id").join(stuck, ["trace_id", "span_id"], "left_semi")

    def walk(rows: pa.Table) -> pa.Table:
        up = dict(zip(rows.column("span_id").to_pylist(), rows.column("parent_id").to_pylist()))
        out = []
        for s in up:
            seen = {s}
            at = up[s]
            while at not in seen:
                seen.add(at)
                at = up[at]
            out.append(len(seen))
        return pa.table({"trace_id": rows.column("trace_id")[: len(out)], "span_id": pa.array(list(up), rows.schema.field("span_id").type), "depth": pa.array(out, pa.int64())})

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    circles = edges.dropDuplicates(["trace_id", "span_id"]).groupBy("trace_id").applyInArrow(walk, f"trace_id {kinds['trace_id']}, span_id {kinds['span_id']}, depth long")
    return ended.unionByName(circles)


def funnel(events: DataFrame, steps: int, now_s: int) -> DataFrame:
    """Reached, conversion, gaps and stuck items for each step; the first event of a key and step counts.

    Median and p95 are of all gaps, also negative ones. Stuck: waiting at its last
    step for over max(60, 1.5 x the p95 of the gaps that aren't negative), or 900 s
    with fewer than five of these.
    """
    first = events.groupBy("key", "step").agg(F.min("t").alias("t"))
    wide = first.groupBy("key").pivot("step", list(range(steps))).agg(F.first("t"))
    gaps = wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), (F.col(str(i + 1)) - F.col(str(i))).alias("g")) for i in range(steps - 1)])).alias("x")).select("x.step", "x.g").where("g IS NOT NULL")
    at = lambda g: F.expr(f"percentile_disc(0.95 + 1e-12D) WITHIN GROUP (ORDER BY {g})")
    per = gaps.withColumn("good", F.when(F.col("g") >= 0, F.col("g"))).groupBy("step").agg(F.median("g").alias("median_s"), at("g").alias("p95_s"), at("good").alias("p95"), F.count("good").alias("gaps"))
    limits = per.select("step", F.when(F.col("gaps") >= 5, F.greatest(F.lit(60.0), F.col("p95") * 1.5)).otherwise(900.0).alias("limit_s"))
    last = first.groupBy("key").agg(F.max_by("t", "step").alias("t"), F.max("step").alias("step")).where(F.col("step") < steps - 1)
    stuck = last.join(limits, "step", "left").where(now_s - F.col("t") > F.coalesce("limit_s", F.lit(900.0))).groupBy("step").agg(F.count("*").alias("stuck"))
    reached = first.groupBy("step").agg(F.count("*").alias("reached"))
    # One row for each step from here on.
    steps_in_order = Window.partitionBy(F.lit(0)).orderBy("step")
    out = reached.join(per.select("step", "median_s", "p95_s"), "step", "left").join(stuck, "step", "left")
    share = lambda n: F.round(F.col("reached") / n, 4)
    return out.select("step", "reached", share(F.first("reached").over(steps_in_order)).alias("of_first"), share(F.lag("reached").over(steps_in_order)).alias("from_prev"), "median_s", "p95_s", F.coalesce("stuck", F.lit(0)).alias("stuck"))


def flow_edges(flows: DataFrame) -> DataFrame:
    """Connections between two ends with how many parties and how long seen."""
    return flows.groupBy("src", "dst").agg(F.count("*").alias("connections"), F.countDistinct("party").alias("parties"), F.max("t").alias("last_t"))


def _best(k: int):
    """The `k` best vectors for each query of a block among one block of vectors."""

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        rows = [np.zeros(width) if x is None else np.array(x, np.float64) for x in column.to_pylist()]
        return np.stack(rows) if rows else np.zeros((0, width))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        width = max((len(x) for c in (left.column("embedding"), right.column("q")) for x in c.to_pylist() if x is not None), default=0)
        v, q = matrix(left.column("embedding"), width), matrix(right.column("q"), width)
        ids, asked = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        out = []
        if len(ids) and len(asked):
            size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
            cosine = np.round(np.divide(q @ v.T, size, out=np.zeros(size.shape), where=size > 0), 6)
            for a, row in zip(asked, cosine, strict=True):
                others = np.flatnonzero(ids != a)
                if len(others) > k:
                    others = others[row[others] >= np.partition(row[others], len(others) - k)[len(others) - k]]
                others = others[np.lexsort((ids[others], -row[others]))[:k]]
                out.append((np.full(len(others), a), ids[others], row[others]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "cosine": pa.array(columns[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The `k` vectors of largest cosine for each query (query_id, q); ties: smaller id.

    Every query meets every vector: a task scores one block of queries against
    one block of vectors, both of bounded size, and gives out its best `k` of
    each query; these are merged by query. Null vectors and those of length 0
    have cosine 0; rows without an identifier are left out.
    """
    v = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    q = queries.where("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "q")
    blocks = [max(1, -(-df.count() // most)) for df, most in ((v, vector_block), (q, query_block))]
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.select("*", own("vec_id", blocks[0]).alias("vb"), every(blocks[1]).alias("qb"))
    q = q.select("*", own("query_id", blocks[1]).alias("qb"), every(blocks[0]).alias("vb"))
    scored = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInArrow(_best(k), "query_id long, vec_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
