"""A whole triage run: all cases at once, as one plan. A case with a fault is set aside, and the others finish."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import assess, audit, evidence, faults, labels, memo, metrics, path, raster, regions, timeline
from ..settings import LAYERS, Settings
from ..sources import io, providers


@dataclass
class Run:
    cases: DataFrame
    clusters: DataFrame
    steps: DataFrame
    hits: DataFrame
    checklist: DataFrame
    assessed: DataFrame
    violations: DataFrame
    status: DataFrame
    results: DataFrame
    log: DataFrame
    outcomes: DataFrame
    attempts: DataFrame
    patches: DataFrame
    windows: DataFrame


#: The size of a case's thumbnail and of its full image.
SIZES = ("thumb_w", "thumb_h", "full_w", "full_h")
PATCHES = 16


def read_cases(spark: SparkSession, manifest: str, label_csv: str, settings: Settings) -> DataFrame:
    """Cases of a manifest (slide_id, slide_filename, slide_path) with the targets of their last label row (slide_id, type, grade)."""
    cases = io.read_rows(spark, manifest, ["slide_id", "slide_filename", "slide_path"], "seq")
    rows = io.read_rows(spark, label_csv, ["slide_id", "type", "grade"], "__seq")
    out = labels.with_labels(cases, rows, "slide_id", F.col("__seq")).drop("__seq")
    return out.select(
        F.col("slide_id").alias("case_id"), "slide_filename", "slide_path", F.col("type").alias("label"), "grade", "seq",
        labels.member(F.col("type"), settings.serrated_labels).alias("serrated_target"), labels.member(F.col("type"), settings.ssl_like_labels).alias("ssl_like_target"),
        labels.member(F.col("grade"), settings.dysplasia_grades).alias("dysplasia_proxy_target"))


def single_case(spark: SparkSession, slide_path: str) -> DataFrame:
    """A case made from a path: its id is the file's stem, its targets are null."""
    none = {c: F.lit(None).cast(k).alias(c) for c, k in (("label", "string"), ("serrated_target", "int"), ("ssl_like_target", "int"), ("dysplasia_proxy_target", "int"))}
    return spark.range(1).select(io.stem(F.lit(slide_path)).alias("case_id"), F.lit(slide_path).alias("slide_path"), *none.values())


@dataclass(frozen=True)
class Interventions:
    """What an operator asks of a run. Boxes replace the hints; the rest is recorded in the log."""

    override_roi: str | None = None
    force_zoom: float | None = None
    early_stop: int | None = None
    operator_note: str | None = None


def chosen_hints(cases: DataFrame, hints: DataFrame, mode: str | None, boxes: str | None) -> DataFrame:
    """Manual boxes "x1,y1,x2,y2;..." for every case; else, of hints with a mode, each case's first mode of the plan that has any."""
    if boxes:
        made = cases.select("case_id", F.explode(memo.parse_boxes(F.lit(boxes))).alias("e"))
        return made.select("case_id", *[F.col(f"e.{c}").alias(f"h{c}") for c in ("x1", "y1", "x2", "y2")], F.lit(1.0).alias("score"))
    if "mode" not in hints.columns:
        return hints
    planned = hints.withColumn("__at", F.array_position(memo.mode_plan(F.lit(None), F.lit(mode or "auto"), ("patho-r1", "heuristic")), F.col("mode"))).filter("__at > 0")
    best = planned.groupBy("case_id").agg(F.min("__at").alias("__at"))
    return planned.join(best, ["case_id", "__at"]).drop("__at", "mode")


def sized(cases: DataFrame, hints: DataFrame, thumb: tuple[int, int] | None, full: tuple[int, int] | None) -> DataFrame:
    """Cases with their SIZES: their own, else those of their hints, else the given ones, else null."""
    given = dict(zip(SIZES, (*(thumb or (None, None)), *(full or (None, None)))))
    if set(SIZES) <= set(hints.columns):
        told = hints.groupBy("case_id").agg(*[F.max(c).alias(f"__{c}") for c in SIZES])
        cases = cases.join(told, "case_id", "left")
    known = lambda c: [F.col(n) for n in (c, f"__{c}") if n in cases.columns]
    return cases.withColumns({c: F.coalesce(*known(c), F.lit(v)).cast("int") for c, v in given.items()}).drop(*[f"__{c}" for c in SIZES])


#: What a provider answers about a case's regions; numbers and booleans as text, so that their types can be held against the rules.
TRACE_ANSWER = "struct<clusters:array<struct<cluster_id:string,l:string,s:string,d:string,crypt_disorder_risk:string,desc:string>>>"


def _typed(output, settings: Settings):
    """Is an answer well formed: a list of regions with known labels, whole priorities and risks, and boolean flags?"""
    whole = lambda v: F.coalesce(v.rlike("^-?[0-9]{1,9}$"), F.lit(False))
    fine = lambda x: x["cluster_id"].isNotNull() & F.coalesce(x["l"].isin(*settings.trace_labels), F.lit(False)) & whole(x["s"]) & whole(x["crypt_disorder_risk"]) & F.coalesce(x["d"].isin("true", "false"), F.lit(False))
    return F.coalesce(F.forall(F.from_json(output, TRACE_ANSWER)["clusters"], fine), F.lit(False))


def _asked_trace(scored: DataFrame, chain, keep, store, settings: Settings):
    """(regions as the providers label them where they answer, attempts a case, faults of answers about unknown regions)."""
    one = F.struct("cluster_id", "x1", "y1", "x2", "y2", "cell_count", "tissue", "pale", "artifact", "area_fraction", "hint_overlap")
    requests = scored.groupBy("case_id").agg(F.sort_array(F.collect_list(one)).alias("proposals"))
    requests = requests.withColumn("request", F.to_json(F.struct(F.lit("trace").alias("stage"), F.col("case_id").cast("string").alias("case_id"), "proposals"))).withColumn("key", memo.content_key("request"))
    requests = keep(requests.select("case_id", "key", "request"), "trace_keys")
    asked = providers.ask("trace", requests, chain, keep, store, settings.max_attempts, lambda out: _typed(out, settings))
    told = requests.join(asked.answers, "key").select("case_id", F.explode(F.from_json("output", TRACE_ANSWER)["clusters"]).alias("a"))
    told = told.select("case_id", "a.cluster_id", "a.l", F.col("a.s").cast("int").alias("s"), (F.col("a.d") == "true").alias("d"), F.col("a.crypt_disorder_risk").cast("int").alias("risk"), F.col("a.desc").alias("description"))
    told = keep(told, "trace_told")
    labelled = scored.drop("l", "s", "d", "risk", "description").join(told, ["case_id", "cluster_id"])
    found = faults.set_aside(scored, told).unionByName(labelled.select(scored.columns))
    return found, requests.select("case_id", "key").join(asked.attempts, "key"), regions.unknown_answers(scored, told)


#: What a provider answers about a case's path; numbers as text, as above. A step without a size has that of its magnification.
NAVIGATE_ANSWER = ("struct<steps:array<struct<step_id:string,x:string,y:string,m:string,o:string,review_goal:string,stage_gate:string,"
                   "metadata:struct<cluster_id:string,action:string,region_size_level0:string>>>>")


def _walkable(output):
    """Is an answer well formed: steps of different ids, each with a goal, a gate, whole coordinates, a magnification, and a size or none?"""
    steps = F.from_json(output, NAVIGATE_ANSWER)["steps"]
    like = lambda v, pattern: F.coalesce(v.rlike(pattern), F.lit(False))
    size = lambda x: F.coalesce(x["metadata"]["region_size_level0"].rlike("^[1-9][0-9]{0,8}$"), F.lit(True))
    named = lambda x: x["step_id"].isNotNull() & x["review_goal"].isNotNull() & x["stage_gate"].isNotNull()
    fine = lambda x: F.coalesce(named(x), F.lit(False)) & like(x["x"], "^-?[0-9]{1,9}$") & like(x["y"], "^-?[0-9]{1,9}$") & like(x["m"], "^[0-9]{1,4}([.][0-9]{1,6})?$") & size(x)
    ids = F.transform(steps, lambda x: x["step_id"])
    return F.coalesce((F.size(steps) > 0) & F.forall(steps, fine) & (F.size(F.array_distinct(ids)) == F.size(ids)), F.lit(False))


def _asked_navigate(steps: DataFrame, large: DataFrame, chain, keep, store, settings: Settings):
    """(steps as the providers plan them where they answer, else ``steps``; attempts a case). Bounds, gates and missing words are the audit's."""
    one = F.struct("rank", "cluster_id", "x1", "y1", "x2", "y2", "l", "s", "d", "risk")
    about = large.groupBy("case_id", "full_w", "full_h").agg(F.sort_array(F.collect_list(one)).alias("clusters"))
    request = F.to_json(F.struct(F.lit("navigate").alias("stage"), F.col("case_id").cast("string").alias("case_id"), "full_w", "full_h", "clusters"))
    requests = keep(about.withColumn("request", request).withColumn("key", memo.content_key("request")).select("case_id", "full_w", "full_h", "key", "request"), "navigate_keys")
    asked = providers.ask("navigate", requests, chain, keep, store, settings.max_attempts, _walkable)
    told = requests.join(asked.answers, "key").select("case_id", "full_w", "full_h", F.posexplode(F.from_json("output", NAVIGATE_ANSWER)["steps"]).alias("ord", "e"))
    told = told.select("case_id", "full_w", "full_h", "ord", "e.step_id", *[F.col(f"e.{c}").cast("int").alias(c) for c in ("x", "y")], F.col("e.m").cast("double").alias("m"), "e.review_goal", "e.stage_gate",
                       F.col("e.metadata.region_size_level0").cast("int").alias("size"), "e.metadata.cluster_id", "e.metadata.action", F.col("e.o").alias("need_to_see"))
    span = F.lit(settings.default_region)
    for m, size in settings.regions:
        span = F.when(F.col("m") == m, size).otherwise(span)
    told = told.withColumns({"size": F.coalesce("size", span), "x_millionths": geometry.millionths(F.col("x"), F.col("full_w")), "y_millionths": geometry.millionths(F.col("y"), F.col("full_h"))})
    told = keep(told.select([F.col(f.name).cast(f.dataType) for f in steps.schema]), "navigate_told")
    return faults.set_aside(steps, told).unionByName(told), requests.select("case_id", "key").join(asked.attempts, "key")


def _asked_observe(seen: DataFrame, hits: DataFrame, chain, keep, store, settings: Settings):
    """(hits, read from the providers' texts where they answer, attempts a case)."""
    about = F.struct(F.lit("observe_step").alias("stage"), F.col("case_id").cast("string").alias("case_id"), "step_id", "m", "cluster_id", "review_goal", "background", "tissue", "pale")
    requests = keep(seen.withColumn("request", F.to_json(about)).withColumn("key", memo.content_key("request")).select("case_id", "step_id", "key", "request"), "observe_keys")
    text = lambda out: F.from_json(out, "text string")["text"]
    asked = providers.ask("observe", requests, chain, keep, store, settings.max_attempts, lambda out: text(out).isNotNull())
    told = requests.join(asked.answers, "key").select("case_id", "step_id", F.struct("case_id", "step_id").alias("__step"), text(F.col("output")).alias("text"))
    found = evidence.keyword_hits(told, "__step", keywords=dict(settings.keywords)).select("__step.case_id", "__step.step_id", "criterion", F.col("status").alias("__said"))
    hits = hits.join(found, ["case_id", "step_id", "criterion"], "left")
    return hits.withColumn("status", F.coalesce("__said", "status")).drop("__said"), requests.select("case_id", "key").join(asked.attempts, "key")


def run(cases: DataFrame, pixels: DataFrame, hints: DataFrame, crop_pixels: DataFrame, settings: Settings, thumb: tuple[int, int] | None, full: tuple[int, int] | None, keep,
        mode: str | None = None, asked: Interventions = Interventions(), backends: dict | None = None, store=None) -> Run:
    """Triage ``cases`` from thumbnail pixels (case_id, y, x, r, g, b), hint boxes and full-size pixels (case_id, py, px, r, g, b).

    Images have the sizes of their case (SIZES), of its hints, or ``thumb`` and
    ``full``. ``backends`` has for "trace", "navigate" and "observe" the providers to
    ask, in order; what none answers goes by rule. ``store`` (:class:`tessera.sources.store.Store`)
    keeps their answers across runs. ``keep(df, name)`` writes a stage's table and
    reads it back, so that the stages after it do not repeat it. Each stage's time
    is that of all cases. A case without a size, listed twice, with a pixel outside
    of its image, or with an answer about an unknown region fails alone.
    """
    timings, began, started = {}, time.time(), F.lit(time.strftime("%Y-%m-%dT%H:%M:%S"))
    backends = backends or {}

    def done_with(stage: str, since=[began]):  # noqa: B006
        timings[f"{stage}_runtime_ms"] = int(round((time.time() - since[0]) * 1000))
        since[0] = time.time()

    everyone = keep(sized(cases, hints, thumb, full), "sized")
    bad = keep(faults.together([faults.ingest_faults(everyone, pixels)]), "ingest_faults")
    cases = keep(faults.set_aside(everyone, bad), "cases")
    sizes = cases.select("case_id", *SIZES)
    hints = chosen_hints(cases, hints, mode, asked.override_roi).filter("hx1 IS NOT NULL").select("case_id", "hx1", "hy1", "hx2", "hy2", "score")
    placed = pixels.join(sizes, "case_id").withColumn("gy", raster.cell_of(F.col("y"), F.col("thumb_h"), settings.grid)).withColumn("gx", raster.cell_of(F.col("x"), F.col("thumb_w"), settings.grid))
    grouped = regions.connected(raster.grid_cells(placed, settings), settings).join(sizes.select("case_id", "thumb_w", "thumb_h"), "case_id")
    found = regions.fallback(cases, regions.proposals(grouped, settings, "thumb_w", "thumb_h"), "thumb_w", "thumb_h")
    scored = regions.scored(regions.with_hints(found, hints), settings)
    attempts = []
    if backends.get("trace"):
        scored, tried, unknown = _asked_trace(keep(scored, "scored"), backends["trace"], keep, store, settings)
        bad = keep(bad.unionByName(unknown), "trace_faults")
        cases, scored = keep(faults.set_aside(cases, bad), "traced_cases"), faults.set_aside(scored, bad)
        attempts.append(keep(tried, "trace_attempts"))
    sizes = cases.select("case_id", *SIZES)
    clusters = keep(regions.top_regions(scored, settings), "clusters")
    done_with("trace")
    on_full = lambda c, i: F.bround(F.col(c) * F.col(SIZES[2 + i % 2]) / F.col(SIZES[i % 2])).cast("int")
    boxes = hints.join(sizes, "case_id").select("case_id", *[on_full(f"h{c}", i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    patches = keep(raster.tiles(boxes, keep=PATCHES, order=("x1", "y1", "x2", "y2")).select("case_id", "tile", "tx", "ty"), "patches")
    done_with("export")
    large = clusters.join(sizes.select("case_id", "full_w", "full_h"), "case_id").withColumns({c: on_full(c, i) for i, c in enumerate(("x1", "y1", "x2", "y2"))})
    steps = path.trajectory(large, "full_w", "full_h", settings)
    if backends.get("navigate"):
        steps, tried = _asked_navigate(steps, large, backends["navigate"], keep, store, settings)
        attempts.append(keep(tried, "navigate_attempts"))
    steps = keep(steps, "steps")
    done_with("navigate")
    windows = raster.crop_window(crop_pixels, evidence.drop_stops(steps).select("case_id", "step_id", "m", "x", "y", "size"))
    crops = raster.crop_statistics(windows, "case_id", "step_id")
    seen = evidence.observed(steps, crops, clusters, strict=False)
    if backends.get("observe"):
        seen = keep(seen, "seen")
        hits, tried = _asked_observe(seen, evidence.hits(seen, settings), backends["observe"], keep, store, settings)
        attempts.append(keep(tried, "observe_attempts"))
    else:
        hits = evidence.hits(seen, settings)
    hits = keep(hits, "hits")
    listed = keep(evidence.checklist(cases, evidence.merge(hits, "case_id"), evidence.criteria(cases.sparkSession, settings)), "checklist")
    counts = evidence.counts(listed)
    suspicious = clusters.groupBy("case_id").agg(F.bool_or(F.col("l") == "serrated_suspicious_mucosa").alias("suspicious"))
    made = assess.assess(counts, suspicious)
    assessed = keep(made.join(assess.report(made, assess.supporting_lines(listed)), "case_id"), "assessed")
    observed = keep(_observations(hits, settings), "observations")
    done_with("observe")
    # boxes that hold no whole patch export nothing: that is what an export fails by
    exported = boxes.select("case_id").distinct().join(patches.groupBy("case_id").agg(F.count("*").alias("n")), "case_id", "left")
    exports = cases.select("case_id").join(exported.select("case_id", F.when(F.col("n") > 0, 0).otherwise(1).alias("returncode")), "case_id", "left").na.fill(0, ["returncode"])
    measured = steps.join(sizes.select("case_id", "full_w", "full_h"), "case_id")
    found_bad = keep(audit.union([
        audit.step_violations(measured, "full_w", "full_h"), audit.label_violations(clusters, labels=settings.trace_labels), audit.artifact_violations(cases, hits, assessed, listed), audit.export_violations(exports),
        audit.support_warnings(counts)]), "violations")
    status = audit.status(cases, found_bad)
    timings["total_runtime_ms"] = int(round((time.time() - began) * 1000))
    tried = reduce(DataFrame.unionByName, attempts) if attempts else None
    results = keep(_results(cases, clusters, steps, observed, listed, counts, assessed, found_bad, status, settings, timings, tried), "results")
    log = keep(_log(cases, clusters, steps, observed, status, exports, asked, started, timings), "events")
    if tried is None:
        tried = cases.select("case_id").limit(0).selectExpr("case_id", "'' AS key", "0 AS priority", "'' AS provider", "'' AS status", "'' AS output", "0L AS latency_ms", "0 AS attempt", "'' AS stage")
    return Run(cases, clusters, steps, hits, listed, assessed, found_bad, status, results, log, faults.outcomes(everyone, bad), tried, patches, windows)


def _observations(hits: DataFrame, settings: Settings) -> DataFrame:
    """One row a step: what was seen, why, what follows, findings and confidence."""
    keys = ("case_id", "step_id", "ord", "review_goal", "background", "tissue", "pale", "s", "d")
    out = evidence.step_findings(hits, *keys, layers=dict(settings.layers)).na.fill("", [f"{layer}_findings" for layer in LAYERS]).na.fill(0, ["support"])
    c, goal = F.col, F.col("review_goal")
    mine = F.when(goal == "serrated_lesion_assessment", c("serrated_findings")).when(goal == "ssl_like_architecture_assessment", c("ssl_like_findings")).otherwise(c("dysplasia_findings"))
    return out.select(
        *keys, *[f"{layer}_findings" for layer in LAYERS], evidence.wording(goal, c("background")).alias("observation"), evidence.reasoning(goal).alias("reasoning"),
        evidence.next_step(goal, c("d")).alias("next_step"), evidence.decision(goal, mine != "").alias("stage_decision"),
        evidence.confidence(c("tissue"), c("pale"), c("support"), c("s")).alias("confidence"))


def _log(cases, clusters, steps, observed, status, exports, asked: Interventions, started, timings) -> DataFrame:
    """Events of all cases as the log's readers take them, with ``seq``, their order in a case."""
    none, now = F.lit(None).cast("string"), timeline.now_iso()

    def event(rows, seq, at, state, agent, source, target, latency=None, said="ok", **payload):
        about = F.create_map(*[x for k, v in payload.items() for x in (F.lit(k), v.cast("string"))]) if payload else F.create_map().cast("map<string,string>")
        text = lambda v: v if not isinstance(v, str) else F.lit(v)
        return rows.select("case_id", seq.cast("long").alias("seq"), at.alias("timestamp"), F.lit(state).alias("state"), F.lit(agent).alias("agent"), source.cast("string").alias("input_ref"),
                           target.cast("string").alias("output_ref"), F.lit(latency).cast("long").alias("latency_ms"), text(said).alias("status"), F.map_filter(about, lambda k, v: v.isNotNull()).alias("payload"))

    wanted = {k: F.lit(v) for k, v in vars(asked).items()}
    n = clusters.groupBy("case_id").agg(F.count("*").alias("n"))
    slide = F.col("slide_path")
    walked = evidence.drop_stops(steps)
    return audit.union([
        event(cases, F.lit(0), started, "START", "Orchestrator", slide, none, **wanted),
        event(cases.join(n, "case_id"), F.lit(1), now, "TRACE", "TraceAgent", slide, F.lit("clusters"), timings["trace_runtime_ms"], cluster_count=F.col("n")),
        event(cases, F.lit(2), now, "TRACE_TO_SEGMENT", "CoordsAdapter", slide, F.lit("boxes"), 0),
        event(exports, F.lit(3), now, "PATCH_EXPORT", "PatchExportAdapter", F.lit("boxes"), F.lit("patches"), timings["export_runtime_ms"], F.when(F.col("returncode") == 0, "ok").otherwise("error")),
        event(steps, 100 + F.col("ord"), now, "NAVIGATE", "NavigateAgent", F.col("cluster_id"), F.col("step_id"), review_goal=F.col("review_goal")),
        event(observed.join(walked.select("case_id", "step_id"), ["case_id", "step_id"]), 200 + F.col("ord"), now, "OBSERVE", "ObserveReasonAgent", F.col("step_id"), F.col("step_id"), stage_decision=F.col("stage_decision")),
        event(status, F.lit(1000), now, "END", "AuditAgent", none, F.lit("case_results"), 0, F.col("status"), errors=F.col("errors"), warnings=F.col("warnings")),
    ])


def _results(cases, clusters, steps, observed, listed, counts, assessed, violations, status, settings, timings, attempts) -> DataFrame:
    """One nested row a case, in the shape that :func:`tessera.sources.io.read_run` reads."""
    c = F.col
    costs = metrics.cost_units(cases, clusters, evidence.drop_stops(steps), attempts.filter("stage = 'trace'") if attempts is not None else None)
    chain = observed.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("ord", "step_id", "observation", "reasoning", "next_step", "stage_decision", "confidence", "serrated_findings", "ssl_like_findings", "dysplasia_findings"))).alias("evidence_chain"))
    state = evidence.reasoning_state(observed).select("case_id", F.struct("supporting_evidence", "conflicts").alias("reasoning_state"))
    sums = counts.groupBy("case_id").agg(*[F.max(F.when(c("layer") == k, c("supporting"))).alias(f"__{k}_support") for k in LAYERS])
    walked = evidence.drop_stops(steps).groupBy("case_id").agg(F.count("*").alias("n_steps"))
    path_of = steps.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("ord", "step_id", "x", "y", "m", "need_to_see", "review_goal", "stage_gate", "cluster_id", "action", F.struct((c("x_millionths") / 1e6).alias("x"), (c("y_millionths") / 1e6).alias("y")).alias("normalized_center")))).alias("trajectory"))
    regions_of = clusters.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("rank", "cluster_id", "x1", "y1", "x2", "y2", "l", "s", "d", "risk", "description"))).alias("trace_clusters"))
    entry = lambda layer: F.map_from_entries(F.collect_list(F.when(c("layer") == layer, F.struct(c("criterion"), F.struct("status", F.filter(F.split("evidence_steps", ","), lambda s: s != "").alias("evidence_steps"))))))
    share = lambda layer: metrics.four(F.count_if((c("layer") == layer) & (c("status") != "not_assessed")), F.count_if(c("layer") == layer))
    names = {"serrated": "serrated_checklist", "ssl_like": "ssl_like_crypt_checklist", "dysplasia": "dysplasia_checklist"}
    lists = listed.groupBy("case_id").agg(*[entry(k).alias(v) for k, v in names.items()], *[share(k).alias(f"__{k}") for k in LAYERS])
    said = lambda s: F.sort_array(F.collect_list(F.when(c("severity") == s, F.concat_ws(" ", "rule", "ref")))).alias(f"{s}s")
    bad = violations.groupBy("case_id").agg(said("warning"), said("error"))
    made = lambda n: F.struct(c(f"{n}_label").alias("label"), c(f"{n}_positive").alias("positive"), c(f"{n}_score").alias("score"))
    out = cases
    for other in (status.select("case_id", "status"), regions_of, path_of, lists, assessed, bad, walked, costs, chain, state, sums):
        out = out.join(other, "case_id", "left")
    none = F.array().cast("array<string>")
    targets = {"serrated": "serrated_target", "ssl_like": "ssl_like_target", "dysplasia": "dysplasia_proxy_target"}
    right = [F.when(c(t).isNotNull() & c(f"{k}_positive").isNotNull(), c(f"{k}_positive").cast("int") == c(t)).alias(f"{k}_proxy_correct") for k, t in targets.items()]
    return out.select(
        "case_id", "label", "status", "serrated_target", "ssl_like_target", "dysplasia_proxy_target",
        F.struct(made("serrated").alias("serrated_lesion_assessment"), made("ssl_like").alias("ssl_like_architecture_assessment"), made("dysplasia").alias("dysplasia_assessment"),
                 c("impression").alias("integrated_impression")).alias("hierarchical_prediction"),
        *names.values(), "trace_clusters", "trajectory", c("report").alias("integrated_report"),
        F.struct(F.coalesce("warnings", none).alias("warnings"), F.coalesce("errors", none).alias("errors"), F.struct(
            F.size(F.coalesce("trace_clusters", F.array())).alias("trace_cluster_count"), F.coalesce("n_steps", F.lit(0)).alias("trajectory_length"),
            F.size(F.coalesce("evidence_chain", F.array())).alias("observation_count"), *[c(f"__{k}").alias(f"{k}_checklist_completeness") for k in LAYERS], *right,
            F.lit(settings.overlap_threshold).alias("navigate_overlap_threshold"), *[c(f"__{k}_support").alias(f"{k}_support_count") for k in LAYERS]).alias("metrics")).alias("audit"),
        "evidence_chain", "reasoning_state", F.struct(*[F.lit(v).cast("long").alias(k) for k, v in timings.items()]).alias("timing"),
        F.struct("estimated_case_cost_units", "trace_attempts", "observation_steps").alias("cost"))


def crop_files(done: Run, output: int = 256) -> DataFrame:
    """(case_id, name, body): the PNG of each step's window, under the name that the crop manifest gives it."""
    placed = done.windows.select("case_id", "step_id", "m", "size", F.col("py").alias("y"), F.col("px").alias("x"), "r", "g", "b")
    drawn = io.crops(placed, "case_id", "step_id", "m", "size", output=output)
    return drawn.select("case_id", io.crop_name(F.col("step_id"), F.col("m"), F.col("size")).alias("name"), F.col("png").alias("body"))


def batch_summary(done: Run) -> DataFrame:
    """(case_id, outcome, stage, error) of every case: completed, or failed with the stage and the error."""
    return done.outcomes


def evaluate(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one summary row, metrics a layer) of results as read by read_run."""
    p = "hierarchical_prediction"
    pairs = {"serrated": ("serrated_target", f"{p}.serrated_lesion_assessment.positive"), "ssl_like": ("ssl_like_target", f"{p}.ssl_like_architecture_assessment.positive"),
             "dysplasia_proxy": ("dysplasia_proxy_target", f"{p}.dysplasia_assessment.positive")}
    flat = results.select("case_id", "status", *[x for k, (t, q) in pairs.items() for x in (F.col(t).alias(f"{k}_t"), F.col(q).cast("int").alias(f"{k}_p"))],
                          F.col("audit.metrics.trajectory_length").alias("trajectory_length"), F.col("cost.estimated_case_cost_units").alias("cost_units"), F.col("timing.total_runtime_ms").alias("runtime_ms"),
                          *[(F.coalesce(F.col(f"audit.metrics.{k}_checklist_completeness"), F.lit(0.0)) * 10000).cast("long").alias(f"{k}_completeness") for k in LAYERS])
    summary = metrics.run_summary(flat, ["trajectory_length", "cost_units", "runtime_ms", *[f"{k}_completeness" for k in LAYERS]])
    summary = summary.withColumns({f"avg_{k}_completeness": F.round(F.col(f"avg_{k}_completeness") / 10000, 4) for k in LAYERS})
    return summary, metrics.layer_metrics(metrics.unpivot_layers(flat, {k: (f"{k}_t", f"{k}_p") for k in pairs}, "case_id"))
