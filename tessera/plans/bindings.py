"""Inputs of the operators, derived from the given tables.

There are no slides among them, so events stand for pixels of a case (the
user), line items for hint boxes, and so on; every row of a table is used.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, path, raster, regions
from ..settings import Settings
from .staging import keep

THUMB = 1600
FULL = 16000
SETTINGS = Settings()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark, d) -> DataFrame:
    """Pixels of users: place and colour from the event's number, errors in a strong red, every third user's pixels darker,
    every fifth one's in separate blocks."""
    e, error = F.col("event_id"), F.col("event_type") == "error"
    block = F.col("user_id") % 5 == 0
    dark = F.when(block | (F.col("user_id") % 3 == 0), 70).otherwise(0)
    colour = lambda k, strong: F.when(error, strong).otherwise(150 - dark + e * k % 60).cast("int")
    return table(spark, d, "events").select(
        F.col("user_id").alias("case_id"), F.when(block, F.expr("4 * (event_id div 16 % 4) + event_id div 3 % 2")).otherwise(F.expr("event_id div 16 % 16")).cast("int").alias("gy"),
        F.when(block, F.expr("4 * (event_id % 4) + event_id div 7 % 2")).otherwise(e % 16).cast("int").alias("gx"),
        colour(7, 255).alias("r"), colour(13, 60).alias("g"), colour(29, 60).alias("b"))


def cases(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"))


def cells(spark, d) -> DataFrame:
    return raster.grid_cells(pixels(spark, d), SETTINGS)


def components(spark, d) -> DataFrame:
    return regions.connected(cells(spark, d), SETTINGS)


def proposals(spark, d) -> DataFrame:
    found = regions.proposals(components(spark, d), SETTINGS, THUMB, THUMB)
    return regions.fallback(cases(spark, d), found, THUMB, THUMB)


def hints(spark, d) -> DataFrame:
    x, y, w = F.col("l_partkey") % 1500, F.col("l_orderkey") % 1500, (F.col("l_quantity") * 5).cast("int")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("case_id"), x.cast("int").alias("hx1"), y.cast("int").alias("hy1"), (x + w).cast("int").alias("hx2"), (y + w).cast("int").alias("hy2"),
        F.col("l_discount").alias("score"))


def scored(spark, d) -> DataFrame:
    return regions.scored(regions.with_hints(proposals(spark, d), hints(spark, d)), SETTINGS)


def top(spark, d) -> DataFrame:
    return regions.top_regions(scored(spark, d), SETTINGS)


def crop_pixels(spark, d) -> DataFrame:
    """Pixels of vectors: brightness by the vector's number, the rest by its values."""
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    q = F.abs(F.floor(F.col("v").cast("double") * 100).cast("long") * 7 + F.col("i") * 13)
    tone, spread = 110 + F.col("vec_id") * 37 % 145, 6 + F.col("vec_id") * 11 % 40
    return v.withColumn("q", q).select("vec_id", *[F.least(F.lit(255), tone + F.col("q") * k % spread).cast("int").alias(n) for n, k in (("r", 1), ("g", 5), ("b", 11))])


def full_size(found: DataFrame) -> DataFrame:
    return found.withColumns({c: (F.col(c) * (FULL // THUMB)).cast("int") for c in ("x1", "y1", "x2", "y2")})


class Chain:
    """The stages from regions to checklists; each is computed once and kept."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    @cached_property
    def top(self) -> DataFrame:
        return keep(top(self.spark, self.d), "top")

    @cached_property
    def steps(self) -> DataFrame:
        return keep(path.trajectory(full_size(self.top), FULL, FULL, SETTINGS), "steps")

    @cached_property
    def seen(self) -> DataFrame:
        """Steps with the shares of the vector that stands for the crop."""
        shares = raster.crop_statistics(crop_pixels(self.spark, self.d), "vec_id")
        n = table(self.spark, self.d, "embeddings").agg(F.count("*").alias("n"))  # one row
        walked = evidence.drop_stops(self.steps).select("case_id", "step_id", "ord").join(F.broadcast(n)).withColumn("vec_id", (F.col("case_id") * 9 + F.col("ord")) % F.col("n"))
        crops = walked.join(shares, "vec_id").select("case_id", "step_id", "background", "tissue", "pale")
        return evidence.observed(self.steps, crops, self.top)

    @cached_property
    def hits(self) -> DataFrame:
        return keep(evidence.hits(self.seen, SETTINGS), "hits")

    @cached_property
    def faulty(self) -> DataFrame:
        """Steps with faults in some cases, so that every audit rule finds something."""
        c = F.col
        broken = lambda k, r: (c("case_id") % k == r) & (c("ord") == 0)
        some = self.steps.filter(~((c("case_id") % 7 == 1) & (c("stage_gate") == "level_2")))
        return some.withColumns({
            "m": F.when(broken(11, 2), 7.5).otherwise(c("m")), "need_to_see": F.when(broken(11, 3), "").otherwise(c("need_to_see")),
            "review_goal": F.when(~broken(11, 4), c("review_goal")), "stage_gate": F.when(~broken(11, 5), c("stage_gate"))})

    @cached_property
    def mislabelled(self) -> DataFrame:
        return self.top.withColumn("l", F.when((F.col("case_id") % 11 == 6) & (F.col("rank") == 1), "unknown").otherwise(F.col("l")))

    @cached_property
    def assessed(self) -> DataFrame:
        """Assessments with their report; some cases lack one, or the assessment."""
        from ..operators import assess

        made = assess.assess(evidence.counts(self.checklist), self.suspicious)
        text = assess.report(made, assess.supporting_lines(self.checklist))
        c = F.col("case_id") % 13
        out = made.join(text.withColumn("report", F.when(c != 1, F.col("report"))), "case_id")
        return keep(out.withColumn("serrated_label", F.when(c != 2, F.col("serrated_label"))), "assessed")

    @cached_property
    def everyone(self) -> DataFrame:
        return cases(self.spark, self.d).unionByName(self.top.select("case_id")).distinct()

    @cached_property
    def checklist(self) -> DataFrame:
        return keep(evidence.checklist(self.everyone, evidence.merge(self.hits, "case_id"), evidence.criteria(self.spark)), "checklist")

    @cached_property
    def suspicious(self) -> DataFrame:
        return self.top.groupBy("case_id").agg(F.bool_or(F.col("l") == "serrated_suspicious_mucosa").alias("suspicious"))


#: Criteria as another runtime file might list them: one known, one with a rule of its own, one that no rule finds.
OTHER = {"layers": {"serrated": ["serrated_lesion_context", "pale_rim"], "dysplasia": ["unseen"]},
         "rules": {"pale_rim": [["pale > {pale_high} AND tissue < 5000", "supporting"], ["m >= 5 AND pale <= {pale}", "opposing"], ["pale > {pale}", "uncertain"]]}}


def event_hits(spark, d) -> DataFrame:
    """Hits of users: event types as criteria, status by the value's band, in order of time."""
    v = F.col("value")
    status = F.when(v < 20, "supporting").when(v < 60, "opposing").when(v < 120, "uncertain").otherwise("not_assessed")
    return table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("criterion"), F.struct("ts", "event_id").alias("ord"), F.col("event_id").alias("step_id"), status.alias("status"))


def labelled(spark, d) -> DataFrame:
    """Documents with targets from their labels and predictions by rule on length and language."""
    from ..operators.labels import member, with_labels

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), "lang", "n_chars")
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "case_id")
    out = with_labels(docs, labels, "case_id", F.struct("quality", "toxic"))
    return out.select("case_id", "lang", "n_chars", member(F.col("quality"), [1]).alias("quality_target"), member(F.col("toxic"), [1]).alias("toxic_target"),
                      (F.col("n_chars") > 400).cast("int").alias("quality_pred"), (F.col("lang") == "en").cast("int").alias("toxic_pred"))


def sizes(spark, d) -> DataFrame:
    """Cases whose images have one of three sizes; the full image is not just ten times the thumbnail."""
    k = F.pmod(F.col("c_custkey"), F.lit(3))
    pick = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).otherwise(c)
    out = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), pick(1600, 1210, 2000).alias("thumb_w"), pick(1600, 900, 777).alias("thumb_h"))
    return out.withColumn("full_w", F.col("thumb_w") * 10 + 3).withColumn("full_h", F.col("thumb_h") * 9 - 1)


def listed(spark, d) -> DataFrame:
    """Cases as a faulty manifest lists them: some without a size, some twice."""
    out = sizes(spark, d).withColumn("thumb_w", F.when(F.col("case_id") % 29 != 3, F.col("thumb_w")))
    return out.unionByName(out.filter("case_id % 31 = 5"))


def placed_pixels(spark, d) -> DataFrame:
    """Pixels of users by their place; errors of some users lie outside of the image."""
    e = table(spark, d, "events").select(F.col("user_id").alias("case_id"), "event_id", "event_type")
    x = F.when((F.col("event_type") == "error") & (F.col("case_id") % 37 == 2), 5000).otherwise(F.col("event_id") % 1200)
    return e.select("case_id", x.cast("int").alias("x"), (F.col("event_id") * 7 % 700).cast("int").alias("y"))


def region_answers(spark, d) -> DataFrame:
    """What a provider says of regions, some of which it made up."""
    e = table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.concat(F.lit("cluster_0"), F.col("event_id") % 2).alias("cluster_id"), (F.col("event_id") % 6).cast("int").alias("s"))
    return e.groupBy("case_id", "cluster_id").agg(F.max("s").alias("s"))
