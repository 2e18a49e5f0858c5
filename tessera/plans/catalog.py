"""Queries over the given tables, one for each operator or small group of operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import pixels
from ..operators import assess, audit, evidence, faults, labels, memo, metrics, path, raster, timeline
from ..operators import regions as regions_op
from ..settings import LAYERS, adapted
from ..sources import io, providers, store
from . import bindings as b
from . import staging
from .oracle import SQL

def case_targets(spark, d):
    return b.labelled(spark, d).select("case_id", "lang", "quality_target", "toxic_target")


def last_order(spark, d):
    orders = b.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return labels.last_row(orders, "o_custkey", F.struct("o_orderdate", "o_orderkey")).drop("o_orderdate")


def pilot_subset(spark, d):
    return labels.pilot(case_targets(spark, d).drop("toxic_target"), "quality_target", "case_id", 12, 12)


def pixel_masks(spark, d):
    p = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") * 7 % 256).cast("int").alias("g"), (F.col("l_orderkey") % 256).cast("int").alias("b"))
    rgb = [F.col(c) for c in "rgb"]
    return p.select("l_orderkey", "l_linenumber", *[f(*rgb).alias(f"is_{f.__name__}") for f in (pixels.tissue, pixels.pale, pixels.artifact, pixels.background)])


def array_block_stats(spark, d):
    v = b.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    q = F.floor(F.col("v").cast("double") * 100).cast("long")
    p = v.withColumn("q", q).select("vec_id", *[(F.abs(e) % 256).cast("int").alias(n) for n, e in (("r", F.col("q") * 3), ("g", F.col("q") * 5 + F.col("i")), ("b", F.col("q") * 7 + F.col("i") * 2))])
    return raster.crop_statistics(p, "vec_id")


def regions(spark, d):
    return b.components(spark, d).select("case_id", "gy", "gx", "root", "component")


def hint_overlap(spark, d):
    return b.scored(spark, d).select("case_id", "cluster_id", "hint_overlap", "hint_score")


def region_scores(spark, d):
    return b.scored(spark, d).select("case_id", "cluster_id", "l", "s", "risk", "d", "description")


def top_regions(spark, d):
    return b.top(spark, d).select("case_id", "cluster_id", "rank", "s")


def box_geometry(spark, d):
    n = lambda e: F.expr(f"CAST({e} AS INT)")
    rows = b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", geo.box(n("l_partkey % 1000"), n("l_suppkey % 800"), n("l_partkey % 1000 + l_quantity"), n("l_suppkey % 800 + l_quantity * 2")).alias("p"),
        geo.box(n("l_orderkey % 900"), n("l_orderkey % 700"), n("l_orderkey % 900 + 120"), n("l_orderkey % 700 + 90")).alias("q"))
    p, q = F.col("p"), F.col("q")
    cx, cy = geo.center(p)
    wx, _ = geo.clamp_center(p["x1"], p["y1"], F.lit(256), F.lit(1000), F.lit(1000))
    return rows.select(
        "l_orderkey", "l_linenumber", geo.area(p).alias("area"), cx.alias("cx"), cy.alias("cy"), geo.area(geo.intersection(p, q)).alias("common"), geo.overlap_ratio(p, q).alias("overlap"),
        geo.clamp_box(p, F.lit(900), F.lit(900))["x2"].alias("clamped_x2"), geo.scale_box(p, F.lit(1000.0), F.lit(1000.0), F.lit(4000), F.lit(4000))["x1"].alias("full_x1"),
        geo.millionths(F.least(p["x2"], F.lit(1000)), F.lit(1000)).alias("x2_millionths"), wx.alias("window_x"))


def tiles(spark, d):
    n = lambda e: F.expr(f"CAST({e} AS INT)")
    boxes = b.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("case_id"), "l_orderkey", "l_linenumber", n("l_partkey % 700").alias("x1"), n("l_orderkey % 500").alias("y1"),
        (n("l_partkey % 700") + n("l_quantity * 20")).alias("x2"), (n("l_orderkey % 500") + n("l_quantity * 15")).alias("y2"))
    return raster.tiles(boxes, 256, 16, order=("l_orderkey", "l_linenumber")).select("case_id", "l_orderkey", "l_linenumber", "tx", "ty", "tile")


def crop_window(spark, d):
    p = b.table(spark, d, "events").select(F.col("user_id").alias("case_id"), "event_id", (F.col("event_id") * 97 % 16000).cast("int").alias("px"), (F.col("event_id") * 61 % 16000).cast("int").alias("py"))
    return raster.crop_window(p, evidence.drop_stops(b.Chain(spark, d).steps)).select("case_id", "step_id", "event_id")


def gate_order(spark, d):
    turns = b.table(spark, d, "conversations").withColumn("group", F.lit("all"))
    return audit.early_gate(turns, "conv_id", "group", "role", "user", "system", "turn").select("conv_id", "turn")


def step_bounds(spark, d):
    steps = b.Chain(spark, d).faulty
    return audit.step_violations(steps, 14500, 14500).filter("rule <> 'gate_order'")


def hits_long(spark, d):
    return b.Chain(spark, d).hits.select("case_id", "step_id", "layer", "criterion", "status")


def step_findings(spark, d):
    keys = ("case_id", "step_id", "background", "review_goal", "d")
    out = evidence.step_findings(b.Chain(spark, d).hits, *keys).na.fill("", ["serrated_findings", "ssl_like_findings", "dysplasia_findings"])
    mine = F.when(F.col("review_goal") == "serrated_lesion_assessment", F.col("serrated_findings")).when(F.col("review_goal") == "ssl_like_architecture_assessment", F.col("ssl_like_findings")).otherwise(F.col("dysplasia_findings"))
    return out.select(*keys, "serrated_findings", "ssl_like_findings", "dysplasia_findings", F.when(F.col("background") > 7000, F.concat(F.lit("Background-heavy crop at "), "step_id")).alias("conflict"),
                      evidence.decision(F.col("review_goal"), mine != "").alias("stage_decision"), evidence.wording(F.col("review_goal"), F.col("background")).alias("observation"),
                      evidence.reasoning(F.col("review_goal")).alias("reasoning"), evidence.next_step(F.col("review_goal"), F.col("d")).alias("next_step")).drop("d")


def confidence(spark, d):
    n = b.Chain(spark, d).hits.groupBy("case_id", "step_id", "tissue", "pale", "s").agg(F.count_if(F.col("status") == "supporting").alias("support"))
    return n.select("case_id", "step_id", evidence.confidence(F.col("tissue"), F.col("pale"), F.col("support"), F.col("s")).alias("confidence"))


def keyword_hits(spark, d):
    return evidence.keyword_hits(b.table(spark, d, "documents"), "doc_id")


def event_checklist(spark, d):
    return evidence.merge(b.event_hits(spark, d), "case_id")


def other_criteria(spark, d):
    """The checklist under a runtime file with other criteria and rules."""
    chain, st = b.Chain(spark, d), adapted(b.SETTINGS, b.OTHER)
    return evidence.checklist(chain.everyone, evidence.merge(evidence.hits(chain.seen, st), "case_id"), evidence.criteria(spark, st))


def completeness(spark, d):
    return evidence.counts(b.Chain(spark, d).checklist).select("case_id", "layer", metrics.four(F.col("assessed"), F.col("criteria")).alias("completeness"))


def assessment(spark, d):
    chain = b.Chain(spark, d)
    return assess.assess(evidence.counts(chain.checklist), chain.suspicious)


def report_text(spark, d):
    chain = b.Chain(spark, d)
    assessed = assess.assess(evidence.counts(chain.checklist), chain.suspicious)
    return assess.report(assessed, assess.supporting_lines(chain.checklist))


def _violations(chain):
    listed = chain.checklist
    for i, layer in enumerate(LAYERS):
        listed = listed.filter(~((F.col("case_id") % 17 == i) & (F.col("layer") == layer)))
    exports = chain.everyone.select("case_id", F.when(F.col("case_id") % 19 == 0, 1).when(F.col("case_id") % 19 != 1, 0).alias("returncode"))
    return audit.union([
        audit.step_violations(chain.faulty, 14500, 14500), audit.label_violations(chain.mislabelled),
        audit.artifact_violations(chain.everyone, evidence.drop_stops(chain.steps), chain.assessed, listed),
        audit.export_violations(exports), audit.support_warnings(evidence.counts(chain.checklist))])


def violations(spark, d):
    return _violations(b.Chain(spark, d))


def audit_status(spark, d):
    chain = b.Chain(spark, d)
    return audit.status(chain.everyone, _violations(chain))


def run_summary(spark, d):
    chain = b.Chain(spark, d)
    walked = evidence.drop_stops(chain.steps).groupBy("case_id").agg(F.count("*").alias("steps"))
    costs = metrics.cost_units(chain.everyone, chain.top, evidence.drop_stops(chain.steps), None).select("case_id", "estimated_case_cost_units")
    spent = memo.latency(b.table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.when(F.col("event_type") != "view", F.col("event_id") % 500).alias("latency_ms")), "case_id").withColumnRenamed("latency_ms", "runtime_ms")
    rows = audit.status(chain.everyone, _violations(chain)).join(walked, "case_id", "left").join(costs, "case_id", "left").join(spent, "case_id", "left")
    return metrics.run_summary(rows, ["steps", "errors", "estimated_case_cost_units", "runtime_ms"])


def reasoning_state(spark, d):
    seen = b.Chain(spark, d).hits.select("case_id", "step_id", "ord", "review_goal", "background").distinct()
    out = evidence.reasoning_state(seen)
    return out.select("case_id", F.array_join("supporting_evidence", "|").alias("supporting_evidence"), F.array_join("conflicts", "|").alias("conflicts"), "observations")


def text_observation(spark, d):
    goals = F.element_at(F.array(*[F.lit(g) for _, g, _ in path.GOALS]), (F.col("doc_id") % 3 + 1).cast("int"))
    return evidence.text_driven(b.table(spark, d, "documents").withColumn("goal", goals), "doc_id", "goal")


def backend_clusters(spark, d):
    found = b.proposals(spark, d)
    answers = b.table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.concat(F.lit("cluster_0"), F.col("event_id") % 2).alias("cluster_id"), (F.col("event_id") % 6).cast("int").alias("s"))
    answers = answers.groupBy("case_id", "cluster_id").agg(F.max("s").alias("s")).join(found.select("case_id", "cluster_id"), ["case_id", "cluster_id"])
    return regions_op.annotated(found, answers)


def crop_manifest(spark, d):
    return io.crop_manifest(evidence.drop_stops(b.Chain(spark, d).steps), "crops/").select("case_id", "step_id", "image_path", "x", "y", "m", "o", "region_size_level0")


def map_merge(spark, d):
    left = F.create_map(F.lit("k"), F.lit("none"), F.lit("type"), F.col("event_type"))
    right = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user"), F.col("user_id").cast("string"))
    made = b.table(spark, d, "events").withColumn("m", memo.merged(left, F.map_filter(right, lambda k, v: v.isNotNull())))
    return made.select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("k", "type", "user")], F.size("m").alias("entries"))


def latency_sum(spark, d):
    return memo.latency(b.table(spark, d, "events").select("user_id", "event_type", F.when(F.col("value") < 100, F.col("event_id") % 500).alias("latency_ms")), "user_id", "event_type")


def typed_ingest(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    rows = b.table(spark, d, "events").select(F.col("user_id").alias("case_id"), "event_id", F.when(F.col("event_type") == "error", F.concat(k, F.lit(".5"))).otherwise(k).alias("s"), F.when(F.col("event_type") == "view", "maybe").otherwise("true").alias("d"))
    return audit.typed_violations(rows, "s", "d", "event_id")


def trajectory_text(spark, d):
    return b.Chain(spark, d).steps.select("case_id", "step_id", "need_to_see", "x_millionths", "y_millionths")


def trajectory(spark, d):
    return b.Chain(spark, d).steps.drop("need_to_see", "x_millionths", "y_millionths")


def checklist(spark, d):
    return b.Chain(spark, d).checklist


def layer_metrics(spark, d):
    layers = {"quality": ("quality_target", "quality_pred"), "toxic": ("toxic_target", "toxic_pred")}
    return metrics.layer_metrics(metrics.unpivot_layers(b.labelled(spark, d), layers, "case_id"))


def predictions(spark, d):
    c = F.col
    correct = F.when(c("quality_target").isNotNull() & c("quality_pred").isNotNull(), c("quality_target") == c("quality_pred"))
    return b.labelled(spark, d).select("case_id", c("lang").alias("label"), "quality_target", "toxic_target", (c("quality_pred") == 1).alias("quality_positive"), (c("toxic_pred") == 1).alias("toxic_positive"), correct.alias("quality_correct"))


def timelines(spark, d):
    line = timeline.event_line(F.col("turn"), F.col("role"), F.lit("chat"), F.lit("ok"), F.lit(None), F.length("text"))
    return timeline.timeline(b.table(spark, d, "conversations").withColumn("line", line), "conv_id", ["turn", "role", "text"])


def json_payload(spark, d):
    k = F.from_json("props", "k long")["k"]
    return b.table(spark, d, "events").select("event_id", F.coalesce(k, F.lit(0)).cast("long").alias("k"))


def content_cache(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))
    return memo.first_seen(docs, "key", "doc_id")


def fallback_chain(spark, d):
    e = b.table(spark, d, "events")
    ok = lambda c, no: F.when(c, "ok").otherwise(no)
    asked = [("external", ok(F.col("event_id") % 3 == 0, "unavailable")), ("local", ok(F.col("value") < 50, "error")), ("rules", ok(F.col("event_type") != "error", "error"))]
    rows = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(n).alias("provider"), s.alias("status"), F.concat("event_type", F.lit(f":{i}")).alias("output")) for i, (n, s) in enumerate(asked)])
    return memo.first_success(e.select("event_id", F.inline(rows)), "event_id")


def retry_log(spark, d):
    e = b.table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", F.when(F.col("value") < 40, "ok").otherwise("error").alias("status"))
    return memo.retries(e, ["user_id", "event_type"], ["ts", "event_id"], b.SETTINGS.max_attempts).drop("ts")


def mode_plan(spark, d):
    manual, mode = F.when(F.col("l_returnflag") == "R", "0,0,1,1"), F.when(F.col("l_linestatus") == "O", "auto").otherwise(F.col("l_linestatus"))
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(memo.mode_plan(manual, mode), ",").alias("modes"))


def box_spec(spark, d):
    x, y = F.col("l_partkey") % 100, F.col("l_linenumber")
    one = lambda i: F.concat_ws(",", x + i, y, x + i + 10, y + 20)
    rows = b.table(spark, d, "lineitem").withColumn("spec", F.concat_ws(";", one(0), one(1)))
    return rows.select("l_orderkey", "l_linenumber", F.posexplode(memo.parse_boxes(F.col("spec"))).alias("box", "e")).select("l_orderkey", "l_linenumber", "box", "e.*")


def event_metrics(spark, d):
    e = b.table(spark, d, "events")
    return metrics.event_metrics(e.select((F.col("event_id") % 500).alias("latency_ms"), (F.col("value") < 50).alias("cache_hit"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status")))


def last_line(spark, d):
    return b.table(spark, d, "documents").select("doc_id", evidence.last_line(F.coalesce("text", F.lit(""))).alias("last_line"))


def case_geometry(spark, d):
    """Regions and paths of cases whose images differ in size."""
    sizes = b.sizes(spark, d)
    grouped = b.components(spark, d).join(sizes.select("case_id", "thumb_w", "thumb_h"), "case_id")
    found = regions_op.fallback(sizes, regions_op.proposals(grouped, b.SETTINGS, "thumb_w", "thumb_h"), "thumb_w", "thumb_h")
    top = regions_op.top_regions(regions_op.scored(regions_op.with_hints(found, b.hints(spark, d)), b.SETTINGS), b.SETTINGS)
    on_full = {c: F.bround(F.col(c) * F.col(f"full_{n}") / F.col(f"thumb_{n}")).cast("int") for c, n in (("x1", "w"), ("y1", "h"), ("x2", "w"), ("y2", "h"))}
    large = top.join(sizes.select("case_id", "full_w", "full_h"), "case_id").withColumns(on_full)
    return path.trajectory(large, "full_w", "full_h", b.SETTINGS).drop("need_to_see")


def failed_cases(spark, d):
    """Every case of a faulty batch: completed, or failed with its first fault; no fault stops the others."""
    listed = b.listed(spark, d)
    found = faults.together([faults.ingest_faults(listed, b.placed_pixels(spark, d)), regions_op.unknown_answers(b.proposals(spark, d), b.region_answers(spark, d))])
    return faults.outcomes(listed.select("case_id").unionByName(found.select("case_id")), found)


def stage_attempts(spark, d):
    """What a chain of providers tried for each request, who answered, and who answers when it is asked again."""
    n = F.get_json_object("request", "$.customer").cast("long")
    says = lambda status, output: lambda rows: rows.select("key", status.alias("status"), output.alias("output"), F.lit(3).cast("long").alias("latency_ms"))
    chain = [
        ("external", says(F.when(n % 3 == 0, "ok").otherwise("unavailable"), F.format_string('{"v": %d}', n))),
        ("local", says(F.when(n % 5 == 0, "error").otherwise("ok"), F.when(n % 7 == 1, "no answer").otherwise(F.format_string('{"v": %d}', -n)))),
        ("rules", says(F.when(n % 11 == 4, "error").otherwise("ok"), F.lit('{"v": 0}')))]
    requests = b.table(spark, d, "orders").select(F.to_json(F.struct(F.col("o_custkey").alias("customer"))).alias("request")).withColumn("key", memo.content_key("request"))
    held = store.Store(spark, f"{staging.shared_folder(spark)}/tessera-{uuid.uuid4().hex}/store")
    valid = lambda out: F.get_json_object(out, "$.v").isNotNull()
    first = providers.ask("trace", requests, chain, staging.keep, held, 2, valid)
    again = providers.ask("trace", requests, chain, staging.keep, held, 1, valid)
    said = F.sort_array(F.collect_list(F.struct("priority", "attempt", F.concat_ws(":", "provider", "status").alias("t"))))
    tried = first.attempts.groupBy("key").agg(F.array_join(F.transform(said, lambda x: x["t"]), ",").alias("attempts"), F.sum("latency_ms").alias("latency_ms"))
    who = first.answers.select("key", "provider", F.get_json_object("output", "$.v").cast("long").alias("answer"))
    asked = requests.groupBy("key").agg(F.first(F.get_json_object("request", "$.customer").cast("long")).alias("customer"), F.count("*").alias("requests"))
    out = asked.join(tried, "key").join(who, "key", "left").join(again.answers.select("key", F.col("provider").alias("provider_again")), "key", "left")
    return out.drop("key")


def open_records(spark, d):
    """Open JSON records as VARIANT: typed fields where they are of their type, a violation where not, all keys kept."""
    made = F.when(F.col("event_type") == "error", F.replace("props", F.lit("}"), F.lit(', "more": [1, "x"]}'))).when(F.col("event_type") == "purchase", F.replace("props", F.lit("}"), F.lit(".5}"))).when(F.col("event_type") == "view", F.replace("props", F.lit(": "), F.lit(': "n'))).otherwise(F.col("props"))
    rows = b.table(spark, d, "events").select(F.col("user_id").alias("case_id"), "event_id", made.alias("record"))
    return audit.open_records(rows, "record", {"k": "long"}, "case_id", "event_id")


QUERIES = {
    "case_geometry": case_geometry, "failed_cases": failed_cases, "stage_attempts": stage_attempts, "open_records": open_records,
    "case_targets": case_targets, "last_order": last_order, "pilot_subset": pilot_subset, "pixel_masks": pixel_masks, "array_block_stats": array_block_stats, "grid_cells": b.cells, "regions": regions,
    "region_fallback": b.proposals, "hint_overlap": hint_overlap, "region_scores": region_scores, "top_regions": top_regions, "trajectory": trajectory, "box_geometry": box_geometry, "tiles": tiles,
    "crop_window": crop_window, "gate_order": gate_order, "hits_long": hits_long, "step_findings": step_findings, "confidence": confidence, "keyword_hits": keyword_hits, "event_checklist": event_checklist,
    "checklist": checklist, "other_criteria": other_criteria, "completeness": completeness, "assessment": assessment, "report_text": report_text, "violations": violations, "audit_status": audit_status, "run_summary": run_summary,
    "layer_metrics": layer_metrics, "predictions": predictions, "timeline": timelines, "json_payload": json_payload, "content_cache": content_cache, "fallback_chain": fallback_chain, "retry_log": retry_log,
    "step_bounds": step_bounds, "reasoning_state": reasoning_state, "text_observation": text_observation, "backend_clusters": backend_clusters, "crop_manifest": crop_manifest, "map_merge": map_merge,
    "latency_sum": latency_sum, "typed_ingest": typed_ingest, "trajectory_text": trajectory_text, "mode_plan": mode_plan, "box_spec": box_spec, "event_metrics": event_metrics, "last_line": last_line,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: SQL[k] for k in QUERIES if k in SQL}
