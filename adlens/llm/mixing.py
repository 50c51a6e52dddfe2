"""Mixing sources to target weights by Pareto order sampling (operator 2).

Built-in DataFrame functions only.  Steps:

1. Size of a document = its words; per source and size class one row of sums.
2. Targets: sources in code-point order (null last) get the weights in turn; a target is
   ``share`` of all words by weight, at most ``most`` times the source's words, the
   excess reshared by weight (a fixpoint over the source table, a few aggregates).
3. Expected copies of a document are ``most`` at the most and otherwise proportional to its worth, by
   default the bit length of its size (a long document is worth a little more); the
   factor that meets the source's target is solved from the class sums.
4. Whole copies are certain.  The fraction left is an inclusion probability p: documents
   are ranked by their odds u/(1-u) over p/(1-p), u a hash of seed and row, and the
   first of each source are taken until their words meet what is left of the target (the
   prefix that comes nearest).  The cut is found by two histograms of 1024 bins and then a
   window over the one remaining bin, never by sorting a whole source.

A row is its doc_id, a hash of its text (``mark``) and, among rows of a source equal in both, a
number (``nth``); so rows without an id and rows that repeat one draw each on their own.  The
plan is one row per source; a row's copies follow from it and the row alone, so texts are not
shuffled, but for those of equal rows, which are written once and numbered by salted ranks.
Null and blank texts have size 0; a null doc_id sorts first.  An empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlens.llm.tables import materialize, rank_within
from adlens.operators.sizing import maybe_broadcast

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
BINS = 1024
_MAX_ID = (1 << 63) - 1
_SPREAD = 1 << 14  # numbers made from one row at once


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _worth(size: Column) -> Column:
    """Bit length of the size; 1 for an empty document."""
    return F.length(F.bin(size)).cast("double")


def _odds_rank(p: Column, seed: str) -> Column:
    """Row's odds over inclusion odds, q, as q / (1 + q): in 0 to 1, in the order of q."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "mark", "nth")
    u = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    up, down = u * (1 - p), p * (1 - u)
    return up / (up + down)


def _sources(sizes: DataFrame, weights, share: float, most: float) -> DataFrame:
    """``(source, source_size, target)``."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source: the window sees the configuration, not the documents.
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = materialize(per.select("source", "source_size", F.element_at(
        turn, ((nth - 1) % len(weights) + 1).cast("int")).alias("weight")), "sources")
    cap = F.col("source_size") * most
    level = 0.0
    while True:
        full = cap < F.col("weight") * level
        row = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap).otherwise(0.0)).alias("capped"),
                      F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["all"] or not row["open"]:
            break
        risen = (share * row["all"] - row["capped"]) / row["open"]
        if risen <= level:
            break
        level = risen
    return per.select("source", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def _factor(classes: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """Adds ``factor``: expected copies = least(most, factor * worth) make up the target."""
    c = classes.join(sources, classes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    worthy = Window.partitionBy("source").orderBy(F.desc("worth"))
    above = F.coalesce(F.sum("words").over(worthy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("worth") * F.col("words")).over(worthy.rowsBetween(0, Window.unboundedFollowing))
    tried = c.select("source", "worth", ((F.col("target") - most * above) / below).alias("factor"))
    fits = F.when(F.col("factor") * F.col("worth") <= most, F.struct(-F.col("worth"), "factor"))
    solved = tried.groupBy("source").agg(F.min(fits)["factor"].alias("factor"))
    return sources.join(solved, sources["source"].eqNullSafe(solved["source"])).drop(solved["source"]) \
        .withColumn("factor", F.coalesce("factor", F.lit(float(most))))


def _drawn(rows: DataFrame, sources: DataFrame, most: float, seed: str) -> DataFrame:
    """Rows with their source's columns, ``whole`` copies, and ``t`` (null: no fraction to draw)."""
    side = maybe_broadcast(sources.withColumnRenamed("source", "_of"), row_bytes=512)
    copies = F.least(F.lit(float(most)), F.col("factor") * _worth(F.col("size")))
    out = rows.join(side, rows["source"].eqNullSafe(side["_of"])).drop("_of") \
        .withColumn("whole", F.floor(copies).cast("long")).withColumn("p", copies - F.floor(copies))
    return out.withColumn("t", F.when(F.col("p") > 0, _odds_rank(F.col("p"), seed))).drop("p")


def _first_reaching(sums: DataFrame, bin_col: str, start: Column, goal: str) -> DataFrame:
    """Per source the first bin at whose end the words reach the goal, and the words before it."""
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(bin_col))
    run = sums.withColumn("end", start + upto).where(F.col("end") >= F.col(goal))
    pick = F.min(F.struct(bin_col, (F.col("end") - F.col("words")).alias("before")))
    return run.groupBy("source").agg(pick.alias("_p")).select("source", f"_p.{bin_col}", "_p.before")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per source: ``(source, source_size, target, factor, cut)``.  Rows
    of the source are drawn up to and with the cut, (t, doc_id, mark, nth)."""
    # Equal rows differ in their numbers alone, so which row has which does not matter here.
    many = F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(_SPREAD).cast("long"))
    sizes = materialize(_rows(docs).groupBy("source", "doc_id", "mark", "size").count().withColumn("from", F.explode(many))
                        .withColumn("nth", F.explode(F.sequence("from", F.least(F.col("from") + _SPREAD, "count") - 1)))
                        .drop("from", "count"), "sizes")
    classes = materialize(sizes.groupBy("source", _worth(F.col("size")).alias("worth")).agg(F.sum("size").alias("words")),
                          "size-classes")
    sources = _factor(classes.where("words > 0"), _sources(sizes, weights, share, most), most)
    missing = _sources_without_words(classes)
    sources = materialize(sources.unionByName(missing), "source-plan")
    certain = _drawn_classes(classes, sources, most)
    sources = materialize(sources.join(certain, sources["source"].eqNullSafe(certain["source"])).drop(certain["source"])
                          .withColumn("rest", F.col("target") - F.col("certain")).drop("certain"), "source-rest")

    rows = _drawn(sizes, sources, most, seed).where("t is not null") \
        .select("source", "doc_id", "mark", "nth", "size", "rest", "t", F.floor(F.col("t") * BINS).alias("b1"),
                F.pmod(F.floor(F.col("t") * (BINS * BINS)), F.lit(BINS)).alias("b2"))
    top = rows.groupBy("source", "rest", "b1").agg(F.sum("size").alias("words"))
    one = materialize(_first_reaching(top, "b1", F.lit(0), "rest"), "first-cut").toDF("_s1", "_b1", "before1")
    fine = rows.join(maybe_broadcast(one, 512), rows["source"].eqNullSafe(one["_s1"]) & (rows["b1"] == one["_b1"]))
    low = fine.groupBy("source", "rest", "before1", "b2").agg(F.sum("size").alias("words"))
    two = materialize(_first_reaching(low, "b2", F.col("before1"), "rest"), "second-cut").toDF("_s2", "_b2", "before2")
    last = fine.join(maybe_broadcast(two, 512), fine["source"].eqNullSafe(two["_s2"]) & (fine["b2"] == two["_b2"]))
    order = Window.partitionBy("source").orderBy("t", "doc_id", "mark", "nth").rowsBetween(Window.unboundedPreceding, 0)
    near = last.withColumn("upto", F.col("before2") + F.sum("size").over(order)) \
        .withColumn("under", F.col("upto") - F.col("size"))
    # Up to the row that passes the goal, and with it if that comes nearer.
    taken = near.where((F.col("upto") <= F.col("rest")) |
                       ((F.col("under") < F.col("rest")) & (F.col("upto") - F.col("rest") < F.col("rest") - F.col("under"))))
    edge = taken.groupBy("source").agg(F.max(_place()).alias("e"))
    none = (F.col("_b1") * BINS + F.col("_b2")) / float(BINS * BINS)
    reached = one.join(two, one["_s1"].eqNullSafe(two["_s2"]), "left") \
        .join(edge, one["_s1"].eqNullSafe(edge["source"]), "left") \
        .select("_s1", F.coalesce("e", _place(none)).alias("cut"))
    # Where the draws never reach the goal all are taken.
    return materialize(sources.join(reached, sources["source"].eqNullSafe(reached["_s1"]), "left")
                       .select("source", "source_size", "target", "factor", F.coalesce("cut", _place(F.lit(2.0))).alias("cut")),
                       "mix-plan")


def _place(t: Column | None = None) -> Column:
    """A row's place in the order of the draw; with ``t`` the place before all rows that have it."""
    if t is not None:
        least = F.lit(-_MAX_ID - 1).cast("long")
        return F.struct(t.alias("t"), least.alias("id"), least.alias("mark"), least.alias("nth"))
    return F.struct("t", F.coalesce("doc_id", F.lit(-_MAX_ID)).alias("id"), "mark", "nth")


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "source", size_of(F.col("text")).alias("size"),
                       F.xxhash64("text").alias("mark"), *more)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``: the number of a row among those equal in source, doc_id and mark."""
    key = ["source", "doc_id", "mark"]
    counts = materialize(rows.groupBy(*key).count().where("count > 1"), "equal-rows")
    many = counts.agg(F.sum("count")).first()[0]
    if not many:
        return rows.withColumn("nth", F.lit(0).cast("long"))
    side = counts.select(*[F.col(k).alias(f"_{k}_") for k in key])
    same = functools.reduce(lambda a, b: a & b, [rows[k].eqNullSafe(side[f"_{k}_"]) for k in key])
    equal = materialize(rows.join(side, same, "left_semi").select(rows.columns)
                        .withColumns({"_place": F.monotonically_increasing_id(), "_key": F.xxhash64(*key)}), "numbered-rows")
    ranks = rank_within(equal.select("_key", "_place"), "_key", ["_place"], many, "nth")
    numbered = equal.join(ranks.select("_place", "nth"), "_place").select(*rows.columns, "nth")
    return rows.join(side, same, "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("nth")).unionByName(numbered)


def _sources_without_words(classes: DataFrame) -> DataFrame:
    return classes.groupBy("source").agg(F.sum("words").alias("source_size")).where("source_size = 0") \
        .select("source", "source_size", F.lit(0.0).alias("target"), F.lit(0.0).alias("factor"))


def _drawn_classes(classes: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """Words of the whole copies per source."""
    s = sources.select(F.col("source").alias("_of"), "factor")
    return classes.join(s, classes["source"].eqNullSafe(s["_of"])).groupBy("source").agg(
        F.sum(F.floor(F.least(F.lit(float(most)), F.col("factor") * F.col("worth"))) * F.col("words")).alias("certain"))


def copies(docs: DataFrame, planned: DataFrame, most: float = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` (with ``doc_id, source, size`` and ``text`` or its ``mark``) with the plan's columns
    and ``copies``."""
    rows = docs if "mark" in docs.columns else docs.withColumn("mark", F.xxhash64("text"))
    out = _drawn(_numbered(rows), planned, most, seed)
    drawn = F.col("t").isNotNull() & (_place() <= F.col("cut"))
    return out.withColumn("copies", F.col("whole") + drawn.cast("long"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` of every document."""
    planned = plan(docs, **settings)
    most, seed = settings.get("most", MOST), settings.get("seed", SEED)
    return copies(_rows(docs), planned, most, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents themselves: each row as often as it has copies, columns as given."""
    planned = plan(docs, **settings)
    most, seed = settings.get("most", MOST), settings.get("seed", SEED)
    rows = _rows(docs, F.struct(*docs.columns).alias("row"))
    chosen = copies(rows, planned, most, seed).where("copies > 0")
    return chosen.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("nth_copy")).select("row.*")
