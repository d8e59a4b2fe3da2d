"""Mixing sources to target weights by Pareto order sampling (Rosen 1997).

Each source has a target in words. Whole copies that are certain, floor(target / size of the source),
go to every document. For the rest, `rest` words, each document has an inclusion probability in
proportion to its size, p = k * size, where k makes the expected words sum(p * size) equal `rest`;
documents for which k * size would exceed 1 are certain, too, and the others share what is left.
Documents are ranked by random odds over inclusion odds, [u / (1 - u)] / [p / (1 - p)], and taken in
that order until the source's words are spent: a sample of fixed size with unequal probabilities.
The document at the boundary is taken if that brings the source nearer to its target.

u comes from md5 of the identifier and the text's md5, so reruns agree. All of it is DataFrame code.
No source is sorted in one task: ranks are cut into BUCKETS ranges whose word sums (partial
aggregates) locate the boundary; only the rows of the boundary range are ordered. k comes from the
counts of sizes, of which a source has no more than its longest text has words.

Sources are broadcast while there are at most FEW of them; beyond that targets and cuts are joined on
the source, and sources are ordered by range partitions.

Defined cases: null text has size 0, and size 0 is never sampled; a null source is a source of its
own, last in order; ids may be null or repeat: every row has copies of its own, and of rows that
repeat id, source and text any may be the one at the boundary; a very long text is one document;
sources without words have target 0; other columns pass through (`mix_rows`) or are not read; an
empty table gives no rows. Inputs must not have columns whose names start with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import WORD, materialize, table

BUCKETS = 4096
SEED = "mix-2"
#: Sources whose targets one task computes and a broadcast carries.
FEW = 100_000
_LAST = (1 << 63) - 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fingerprint(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def uniform(doc_id: Column, print_: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the identifier and a fingerprint: 52 bits of an md5, centred."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), print_, F.lit(":" + seed))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, few: bool = True) -> DataFrame:
    """Targets of (source, source_size): weights by turns in code-point order, capped, the excess reshared.

    Resharing by weight until none is above its cap ends at target = min(cap * size, level * weight)
    for one level. With sources ordered by cap * size / weight, those at their cap come first.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    rows = numbered(sizes, by_name, "_turn", one_task=few)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_turn") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("limit", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    rows = numbered(rows, [F.col("ratio"), *by_name], "_turn", {"limit": "_limits", "weight": "_weights"}, one_task=few)
    total = F.broadcast(rows.agg(F.sum("source_size").alias("_size"), F.sum("weight").alias("_weight")))  # one row
    level = (F.lit(share) * F.col("_size") - (F.col("_limits") - F.col("limit"))) / (F.col("_weight") - (F.col("_weights") - F.col("weight")))
    rows = rows.join(total, F.lit(True)).withColumn("level", level)
    # The first level that its own source does not cap; later ones are lower.
    best = F.broadcast(rows.agg(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).alias("_level")))
    target = F.least("limit", F.coalesce(F.col("_level"), F.col("ratio")) * F.col("weight"))
    return rows.join(best, F.lit(True)).select("source", "source_size", target.alias("target"))


def _plan(slim: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> tuple[DataFrame, bool]:
    """(_of, source_size, target, _certain, _k, _rest) of each source, and whether sources are few."""
    by_size = materialize(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    few = sizes.count() <= FEW
    targets = source_targets(sizes, weights, share, cap, few)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("_certain", F.floor(ratio)).withColumn("_rest", (ratio - F.floor(ratio)) * F.col("source_size")).withColumnRenamed("source", "_of")
    # k if all documents above a size are certain, and it holds if it leaves none above 1.
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    words, squares = (F.col("n").cast("decimal(38,0)") * F.col("size") * x for x in (F.lit(1), F.col("size")))
    above = F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    below = F.sum(squares).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double")
    steps = by_size.where("size > 0").withColumn("_above", above).withColumn("_below", below)
    steps = _with_source(steps, targets.select("_of", "_rest"), few, "inner").withColumn("_k", (F.col("_rest") - F.col("_above")) / F.col("_below"))
    k = steps.where("_rest > 0 and _k * size <= 1").groupBy(F.col("source").alias("_same")).agg(F.max_by("_k", "size").alias("_k"))
    plan = targets.join(F.broadcast(k) if few else k, F.col("_of").eqNullSafe(F.col("_same")), "left").drop("_same")
    return materialize(plan), few


def _with_source(rows: DataFrame, sources: DataFrame, few: bool, how: str) -> DataFrame:
    return rows.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("_of")), how).drop("_of")


def _ranked(rows: DataFrame, plan: DataFrame, few: bool, seed: str) -> DataFrame:
    """Add the plan of the source and _q, which orders the documents, and its range."""
    rows = _with_source(rows, plan, few, "inner")
    p, u = F.col("_k") * F.col("size"), uniform(F.col("doc_id"), F.col("_print"), seed)
    q = F.when((F.col("size") > 0) & F.col("_k").isNotNull(), F.when(p >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (p / (1 - p))))
    # q / (1 + q) lies in [0, 1) and keeps the order of q.
    return rows.withColumn("_q", q).withColumn("_bucket", F.floor(F.col("_q") / (1 + F.col("_q")) * BUCKETS).cast("int")).withColumn("_id", F.coalesce("doc_id", F.lit(_LAST)))


_KEY = ["_q", "_id", "size", "_print"]


def _cuts(ranked: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """For each source the key at which its words are spent and how many of the rows with that key are taken."""
    sums = ranked.where("_q is not null").groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("source").orderBy("_bucket")
    sums = _with_source(sums.withColumn("_before", F.sum("_words").over(upto) - F.col("_words")), plan.select("_of", "_rest"), few, "inner")
    edge = sums.where("_before < _rest and _before + _words >= _rest").select(F.col("source").alias("_of"), F.col("_bucket").alias("_edge"), "_before")
    inside = _with_source(ranked, edge, few, "inner").where("_bucket = _edge")
    keys = inside.groupBy("source", *_KEY, "_before", "_rest").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("source").orderBy(*_KEY)
    keys = keys.withColumn("_before", F.col("_before") + F.sum(F.col("_n") * F.col("size")).over(own) - F.col("_n") * F.col("size"))
    at = keys.where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_n") * F.col("size") >= F.col("_rest")))
    # The row before which b words are taken is nearer with it if it takes at most twice what is open.
    taken = F.least(F.col("_n"), F.floor((F.col("_rest") - F.col("_before")) / F.col("size") + F.lit(0.5)))
    return at.select(F.col("source").alias("_of"), *[F.col(c).alias(f"_cut{c}") for c in _KEY], F.col("_n").alias("_ties"), taken.alias("_take"))


def mix(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """Add source_size, target, copies and taken to rows of (doc_id, source, size, _print, ...).

    Rows are read once more after their (doc_id, source, size, _print) were written, and only those
    that tie at the boundary are shuffled.
    """
    slim = materialize(rows.select("doc_id", "source", "size", "_print"))
    plan, few = _plan(slim, weights, share, cap)
    cuts = materialize(_cuts(_ranked(slim, plan, few, seed), plan, few))
    marked = _with_source(_ranked(rows, plan, few, seed), cuts, few, "left")
    key, cut = F.struct(*_KEY), F.struct(*[F.col(f"_cut{c}").alias(c) for c in _KEY])
    tied = F.coalesce((key == cut) & (F.col("_take") > 0) & (F.col("_take") < F.col("_ties")), F.lit(False))
    before = F.col("_q").isNotNull() & (F.col("_cut_q").isNull() | (key < cut) | ((key == cut) & (F.col("_take") == F.col("_ties"))))
    extra = F.coalesce(before, F.lit(False)).cast("long")
    if cuts.where("_take > 0 and _take < _ties").limit(1).count():  # some of equal rows are taken
        ties = _numbered_ties(marked.where(tied)).withColumn("_extra", (F.col("_nth") <= F.col("_take")).cast("long")).drop("_nth")
        out = marked.where(~tied).withColumn("_extra", extra).unionByName(ties)
    else:
        out = marked.withColumn("_extra", extra)
    copies = (F.col("_certain") + F.col("_extra")).cast("long")
    out = out.withColumn("copies", copies).withColumn("taken", (copies * F.col("size")).cast("long"))
    return out.select(*rows.columns, "source_size", "target", "copies", "taken")


def _numbered_ties(ties: DataFrame) -> DataFrame:
    """Number equal rows of a source from 1, task by task, so that no task holds all of them."""
    ties = ties.withColumn("_task", F.spark_partition_id())
    counts = ties.groupBy("source", "_task").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("source").orderBy("_task")
    counts = counts.select(F.col("source").alias("_of"), F.col("_task").alias("_where"), (F.sum("_c").over(upto) - F.col("_c")).alias("_less"))
    own = Window.partitionBy("source", "_task").orderBy("_print")
    numbered_ = ties.withColumn("_nth", F.row_number().over(own))
    joined = numbered_.join(counts, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_task") == F.col("_where")))
    return joined.withColumn("_nth", F.col("_nth") + F.col("_less")).drop("_of", "_where", "_less", "_task")


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("_print", fingerprint(F.col("text")))


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = materialize(sized(docs).drop("text"))
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


def mix_rows(docs: DataFrame) -> DataFrame:
    """The documents of the mix in their own columns: a document taken twice comes twice."""
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_own_{c}") for c in docs.columns], "doc_id", "source", word_count(F.col("text")).alias("size"), fingerprint(F.col("text")).alias("_print"))
    out = mix(plain).where("copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"`_own_{c}`").alias(c) for c in docs.columns])


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS print,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':mix-2'), 1, 13) AS UBIGINT) AS DOUBLE)
           + 0.5) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight FROM s),
r AS (SELECT *, CAST(2 AS DOUBLE) * source_size AS lim, CAST(2 AS DOUBLE) * source_size / weight AS ratio FROM w),
l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER ()
             - coalesce(sum(lim) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)))
            / sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size,
         least(lim, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), ratio) * weight) AS target
  FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS certain,
         CASE WHEN source_size > 0 THEN (target / source_size - floor(target / source_size)) * source_size ELSE 0 END AS rest
  FROM t),
z AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size),
y AS (
  SELECT source, size,
         CAST(coalesce(sum(CAST(n AS HUGEINT) * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS above,
         CAST(sum(CAST(n AS HUGEINT) * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS below
  FROM z),
x AS (SELECT y.source, y.size, (rest - above) / below AS k FROM y JOIN e ON y.source IS NOT DISTINCT FROM e.source WHERE rest > 0),
k AS (SELECT source, arg_max(k, size) AS k FROM x WHERE k * size <= 1 GROUP BY source),
j AS (
  SELECT d.*, e.source_size, e.target, certain, rest, k.k * d.size AS p
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source),
q AS (SELECT *, CASE WHEN size > 0 THEN CASE WHEN p >= 1 THEN 0 ELSE (u / (1 - u)) / (p / (1 - p)) END END AS q FROM j),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, coalesce(doc_id, 9223372036854775807), size, print ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM q WHERE q IS NOT NULL
  UNION ALL SELECT *, 0 AS before FROM q WHERE q IS NULL)
SELECT doc_id, size, source_size, target,
       CAST((certain + CASE WHEN q IS NOT NULL AND before < rest AND 2 * (rest - before) >= size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c
"""
