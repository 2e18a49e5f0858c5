"""Layered assessments of a case and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import LAYERS


def _score(hundredths: Column) -> Column:
    return F.least(F.lit(95), F.greatest(F.lit(5), hundredths)).cast("double") / 100.0


def assess(counts: DataFrame, suspicious: DataFrame, case: str = "case_id") -> DataFrame:
    """Label, positive and score of each layer and the impression, one row per case.

    ``counts`` has the status counts of each layer, ``suspicious`` one boolean
    per case: whether any region is suspicious (a case without a row has none).
    """
    wide = {f"{layer[0:3]}_{n}": F.coalesce(F.max(F.when(F.col("layer") == layer, F.col(n))), F.lit(0)) for layer in LAYERS for n in ("supporting", "opposing", "uncertain", "assessed", "structural")}
    out = counts.groupBy(case).agg(*[v.alias(k) for k, v in wide.items()]).join(suspicious, case, "left")
    c = F.col
    trace = F.coalesce(c("suspicious"), F.lit(False))
    first = trace | (c("ser_supporting") >= 2)
    second = first & (c("ssl_supporting") >= 3) & (c("ssl_structural") >= 1)
    third = c("dys_supporting") >= 2
    second_label = (F.when(~first, "not_applicable_non_serrated").when(second, "ssl_like_supported")
                    .when((c("ssl_supporting") == 0) & (c("ssl_uncertain") > 0), "indeterminate_ssl_like").otherwise("serrated_but_non_ssl_like"))
    # The impressions.
    impression = (F.when(~first, "Overall impression favors a non-serrated lesion.")
                  .when(second & third, "Overall impression favors a serrated lesion with SSL-like crypt architecture and dysplasia / atypia.")
                  .when(second, "Overall impression favors a serrated lesion with SSL-like crypt architecture without convincing dysplasia.")
                  .when(second_label == "serrated_but_non_ssl_like", "Overall impression favors a serrated lesion without convincing SSL-like crypt disorder.")
                  .otherwise("Overall impression remains within the serrated pathway but SSL-like architecture is indeterminate."))
    return out.select(
        case, F.when(first, "serrated_lesion").otherwise("non_serrated_lesion").alias("serrated_label"), first.alias("serrated_positive"),
        _score(20 + 16 * c("ser_supporting") + 10 * trace.cast("int") - 8 * c("ser_opposing")).alias("serrated_score"),
        second_label.alias("ssl_like_label"), second.alias("ssl_like_positive"), _score(18 + 10 * c("ssl_supporting") + 8 * c("ssl_structural")).alias("ssl_like_score"),
        F.when(third, "dysplasia_supported").when(c("dys_assessed") == 0, "dysplasia_indeterminate").otherwise("dysplasia_not_supported").alias("dysplasia_label"),
        third.alias("dysplasia_positive"), _score(15 + 12 * c("dys_supporting")).alias("dysplasia_score"), impression.alias("impression"))


# Fixed value: what is said of a layer without a finding.
NO_FINDING = "No decisive supporting item recorded."


def supporting_lines(listed: DataFrame, none: str = NO_FINDING, case: str = "case_id") -> DataFrame:
    """(case, layer, line): "name (step, step)" of the supporting criteria in configured order, or the sentence ``none``."""
    place = F.array_position(F.array(*[F.lit(c) for names in LAYERS.values() for c in names]), F.col("criterion"))
    part = F.when(F.col("status") == "supporting", F.struct(place.alias("place"), F.concat("criterion", F.lit(" ("), F.replace("evidence_steps", F.lit(","), F.lit(", ")), F.lit(")")).alias("t")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "; ")
    return listed.groupBy(case, "layer").agg(joined.alias("line")).withColumn("line", F.when(F.col("line") == "", F.lit(none)).otherwise(F.col("line")))


def report(assessed: DataFrame, lines: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, report): the fixed layout, a line for each layer's label and findings."""
    wide = lines.groupBy(case).agg(*[F.max(F.when(F.col("layer") == layer, F.col("line"))).alias(f"__{layer}") for layer in LAYERS])
    # The headings.
    titles = {"serrated": "Serrated lesion assessment:", "ssl_like": "SSL-like crypt architecture assessment:", "dysplasia": "Dysplasia assessment:"}
    rows = [F.lit("Integrated Pathological Report"), F.lit("Task: serrated lesion -> SSL-like architecture -> dysplasia"), F.lit("")]
    for layer, title in titles.items():
        rows += [F.lit(title), F.concat(F.lit("- Impression: "), F.col(f"{layer}_label")), F.concat(F.lit("- Supporting findings: "), F.col(f"__{layer}")), F.lit("")]
    rows += [F.lit("Integrated impression:"), F.concat(F.lit("- "), F.col("impression"))]
    return assessed.join(wide, case).select(case, F.concat_ws("\n", *rows).alias("report"))
