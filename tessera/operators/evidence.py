"""Findings of each step, and their merge into layered checklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import KEYWORDS, LAYERS, STATUSES, STRUCTURAL, Settings
from . import faults

def drop_stops(steps: DataFrame) -> DataFrame:
    """Steps that are no stop; a missing action is no stop."""
    return steps.filter(~F.col("action").eqNullSafe("stop"))


def unknown_steps(steps: DataFrame, crops: DataFrame, case: str = "case_id") -> DataFrame:
    """Faults of crops whose step is not among ``steps``."""
    left = crops.join(drop_stops(steps).select(case, "step_id"), [case, "step_id"], "left_anti")
    return faults.fault(left, F.lit(True), "observe", F.concat(F.lit("no step "), F.coalesce("step_id", F.lit("None"))), case)


def observed(steps: DataFrame, crops: DataFrame, regions: DataFrame, case: str = "case_id", strict: bool = True) -> DataFrame:
    """Crops with their step and region; a crop without a region has priority 0.

    One of an unknown step is an error; without ``strict`` it is left out (:func:`unknown_steps` finds it).
    """
    about = regions.select(case, "cluster_id", "l", "s", "d", "risk")
    known = drop_stops(steps).withColumn("__known", F.lit(True))
    unknown = F.raise_error(F.concat(F.lit("no step "), F.col("step_id"))).cast("string")
    found = crops.join(known, [case, "step_id"], "left" if strict else "inner").withColumn("step_id", F.when(F.col("__known"), F.col("step_id")).otherwise(unknown)).drop("__known")
    out = found.join(about, [case, "cluster_id"], "left")
    return out.withColumn("s", F.coalesce("s", F.lit(0))).withColumn("risk", F.coalesce("risk", "s"))


def rule(criterion: str, settings: Settings) -> Column:
    """Status of a criterion: that of its first condition that holds, else not assessed, as for a criterion without conditions.

    A condition that is null does not hold. One over columns that a view lacks fails when the plan is made; an unknown
    setting or status is an error here.
    """
    numbers = {k: v for k, v in vars(settings).items() if isinstance(v, (int, float))}
    status = None
    for condition, said in dict(settings.rules).get(criterion, ()):
        if said not in STATUSES:
            raise ValueError(f"{criterion}: unknown status {said!r}")
        try:
            holds = F.expr(condition.format_map(numbers))
        except KeyError as e:
            raise ValueError(f"{criterion}: no setting {e} with a number") from None
        status = (F if status is None else status).when(holds, F.lit(said))
    return F.lit("not_assessed") if status is None else status.otherwise(F.lit("not_assessed"))


def hits(seen: DataFrame, settings: Settings) -> DataFrame:
    """A row for each step and criterion of the settings: layer, criterion, status."""
    rows = F.array(*[F.struct(F.lit(layer).alias("layer"), F.lit(n).alias("criterion"), rule(n, settings).alias("status")) for layer, names in settings.layers for n in names])
    return seen.withColumn("__h", F.explode(rows)).select(*seen.columns, "__h.layer", "__h.criterion", "__h.status")


def confidence(tissue: Column, pale: Column, support: Column, priority: Column) -> Column:
    """Weighted sum between 0.05 and 0.95, to four places; computed in whole millionths."""
    n = F.lit(200000) + tissue * 20 + pale * 10 + support * 80000 + priority * 40000
    n = F.least(F.lit(950000), F.greatest(F.lit(50000), n)).cast("long")
    return F.floor((n + 50) / 100) / 10000.0


def decision(goal: Column, found: Column) -> Column:
    """The stage decision of a step, by whether its layer has a supporting finding."""
    pick = lambda yes, no: F.when(found, yes).otherwise(no)
    return (F.when(goal == "serrated_lesion_assessment", pick("supports_serrated_lesion", "leans_non_serrated_or_indeterminate"))
            .when(goal == "ssl_like_architecture_assessment", pick("supports_ssl_like_architecture", "serrated_but_non_ssl_like_or_indeterminate"))
            .otherwise(pick("dysplasia_supported", "dysplasia_not_supported_or_indeterminate")))


def wording(goal: Column, background: Column) -> Column:
    """What is said of a crop; one that is mostly background overrides the goal."""
    # The sentences.
    return (F.when(background > 7000, "The crop is background-heavy and provides limited diagnostic tissue.")
            .when(goal == "serrated_lesion_assessment", "Low magnification preserves the overall lesion contour and mucosal context.")
            .when(goal == "ssl_like_architecture_assessment", "Intermediate magnification targets crypt architecture and the distribution of abnormal serration.")
            .otherwise("High magnification focuses on cytologic atypia and dysplasia after structural review."))


def reasoning(goal: Column) -> Column:
    """Why a view is taken."""
    # The sentences.
    return (F.when(goal == "serrated_lesion_assessment", "This view is used to decide whether the lesion belongs to the serrated pathway before structural crypt review.")
            .when(goal == "ssl_like_architecture_assessment", "This view evaluates whether the crypt pattern supports SSL-like structural disorder.")
            .otherwise("This view evaluates dysplasia or atypia after completing the structural crypt review."))


def next_step(goal: Column, flagged: Column) -> Column:
    """What follows a view, by whether its region is flagged for structural review."""
    # The sentences.
    first = F.when(F.coalesce(flagged, F.lit(False)), "Proceed to structural crypt review.").otherwise("Consolidate as a serrated lesion without strong SSL-like crypt disorder.")
    return (F.when(goal == "serrated_lesion_assessment", first)
            .when(goal == "ssl_like_architecture_assessment", "Proceed to routine high-magnification cytology review after the crypt review step.")
            .otherwise("Integrate serrated, structural, and cytologic evidence into the final layered report."))


def reasoning_state(seen: DataFrame, case: str = "case_id", most: int = 8) -> DataFrame:
    """(case, supporting_evidence, conflicts, observations): the first ``most`` reasons in order, and the background-heavy crops.

    ``seen`` has one row a step (step_id, ord, review_goal, background).
    """
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("ord", c.alias("t")))), lambda x: x["t"])
    heavy = F.when(F.col("background") > 7000, F.concat(F.lit("Background-heavy crop at "), "step_id"))
    return seen.groupBy(case).agg(
        F.slice(ordered(reasoning(F.col("review_goal"))), 1, most).alias("supporting_evidence"),
        F.filter(ordered(heavy), lambda t: t.isNotNull()).alias("conflicts"), F.count("*").alias("observations"))


def text_driven(texts: DataFrame, key: str, goal: str, column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """What a provider's text says of a step: (key, goal, observation, reasoning, next_step, stage_decision, findings of each layer, confidence).

    The decision is the goal's own, whatever the findings; the confidence is fixed.
    """
    g = F.col(goal)
    # Decisions and sentences.
    decided = F.when(g == "serrated_lesion_assessment", "supports_serrated_lesion").when(g == "ssl_like_architecture_assessment", "supports_ssl_like_architecture").otherwise("dysplasia_supported")
    then = (F.when(g == "serrated_lesion_assessment", "Proceed to structural crypt review if the lesion remains within the serrated pathway.")
            .when(g == "ssl_like_architecture_assessment", "Proceed to high-magnification cytology review after structural crypt review.")
            .otherwise("Integrate the layered impression and finalize the report."))
    listed = [(F.lit(c), F.lit(layer)) for layer, names in settings.layers for c in names]
    layer_of = F.create_map(*[x for pair in listed for x in pair]) if listed else F.create_map().cast("map<string,string>")
    found = keyword_hits(texts, key, column, dict(settings.keywords)).withColumn("layer", F.try_element_at(layer_of, "criterion"))
    names = step_findings(found, key, layers=dict(settings.layers)).drop("support").na.fill("", [f"{layer}_findings" for layer in LAYERS])
    said = texts.select(
        key, goal, last_line(F.coalesce(column, F.lit(""))).alias("observation"), F.lit("Local Patho-R1 textual evidence was used to summarize the requested diagnostic layer.").alias("reasoning"),
        then.alias("next_step"), decided.alias("stage_decision"), F.lit(0.62).alias("confidence"))
    return said.join(names, key)


def step_findings(rows: DataFrame, *keys: str, layers: dict = LAYERS) -> DataFrame:
    """Supporting criteria of each layer, in order of the criteria, as joined strings."""
    order = F.array_position(F.array(*[F.lit(c) for names in layers.values() for c in names]).cast("array<string>"), F.col("criterion"))
    listed = rows.filter("status = 'supporting'").withColumn("__o", order)
    names = [
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("layer") == layer, F.struct("__o", "criterion")))), lambda x: x["criterion"]), ",").alias(f"{layer}_findings")
        for layer in LAYERS
    ]
    return rows.select(*keys).distinct().join(listed.groupBy(*keys).agg(*names, F.count("*").alias("support")), list(keys), "left")


def keyword_hits(text: DataFrame, key: str, column: str = "text", keywords: dict = KEYWORDS) -> DataFrame:
    """(key, criterion, status): supporting where the lower-cased text holds one of the words, else uncertain."""
    lowered = text.select(key, F.lower(F.coalesce(F.col(column), F.lit(""))).alias("__low"))
    low, rows = F.col("__low"), []
    for name, words in keywords.items():
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w))
        rows.append(F.struct(F.lit(name).alias("criterion"), F.when(found, "supporting").otherwise("uncertain").alias("status")))
    return lowered.select(key, F.explode(F.array(*rows)).alias("h")).select(key, "h.criterion", "h.status")


def last_line(text: Column) -> Column:
    """The last line of the stripped text, 320 characters at most."""
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    stripped = F.regexp_replace(text, r"^[\s\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$", "")
    return F.substring(F.element_at(F.split(stripped, breaks), -1), 1, 320)


def merge(rows: DataFrame, *keys: str, order: str = "ord", step: str = "step_id") -> DataFrame:
    """Checklist rows (keys, criterion, status, evidence_steps) of hit rows (keys, criterion, status, ord, step).

    Supporting absorbs; otherwise the last assessed status wins. Every assessed
    step is evidence, in order, also one that was only uncertain.
    """
    seen = rows.filter("status <> 'not_assessed'")
    return seen.groupBy(*keys, "criterion").agg(
        F.when(F.bool_or(F.col("status") == "supporting"), "supporting").otherwise(F.max_by("status", order)).alias("status"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, step))), lambda x: x[step].cast("string")), ",").alias("evidence_steps"),
    )


def checklist(cases: DataFrame, merged: DataFrame, criteria: DataFrame, case: str = "case_id") -> DataFrame:
    """Every criterion (layer, criterion) of every case; not assessed where no step looked at it.

    ``criteria`` is the configured list, a dozen rows, so it is broadcast.
    """
    every = cases.select(case).distinct().crossJoin(F.broadcast(criteria))
    return every.join(merged, [case, "criterion"], "left").select(
        case, "layer", "criterion", F.coalesce("status", F.lit("not_assessed")).alias("status"), F.coalesce("evidence_steps", F.lit("")).alias("evidence_steps"))


def criteria(spark, settings: Settings | None = None) -> DataFrame:
    """(layer, criterion) of the settings."""
    layers = dict(settings.layers) if settings else LAYERS
    return spark.createDataFrame([(layer, c) for layer, names in layers.items() for c in names], "layer string, criterion string")


def counts(listed: DataFrame, case: str = "case_id", structural=STRUCTURAL) -> DataFrame:
    """Per case and layer: supporting, opposing, uncertain, assessed, supporting structural, and all criteria."""
    is_ = lambda s: F.col("status") == s
    return listed.groupBy(case, "layer").agg(
        F.count_if(is_("supporting")).alias("supporting"), F.count_if(is_("opposing")).alias("opposing"), F.count_if(is_("uncertain")).alias("uncertain"),
        F.count_if(~is_("not_assessed")).alias("assessed"), F.count_if(is_("supporting") & F.col("criterion").isin(*structural)).alias("structural"),
        F.count("*").alias("criteria"))
