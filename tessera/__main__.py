"""python -m tessera run-batch | run-case | build-pilot | replay-case | eval-run: all over Spark tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import labels, timeline
from .plans import run as plan
from .settings import load
from .sources import files, io, providers
from .sources.store import Store

#: Providers that a runtime file's chains may name; a program adds its own before it calls main().
PROVIDERS: dict[str, providers.Provider] = {}


def _keep(root: str):
    def keep(df, name):
        path = f"{root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return keep


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    top.add_argument("--runtime")
    top.add_argument("--budget")
    sub = top.add_subparsers(dest="what", required=True)
    for name in ("run-batch", "run-case", "build-pilot"):
        p = sub.add_parser(name)
        p.add_argument("--manifest")
        p.add_argument("--labels")
        p.add_argument("--output-root", required=True)
        if name != "build-pilot":
            for table in ("pixels", "hints", "crops"):
                p.add_argument(f"--{table}", required=table != "hints", help="Parquet path")
            p.add_argument("--thumb", type=int, nargs=2, help="size of thumbnails whose case and hints have none")
            p.add_argument("--full", type=int, nargs=2, help="size of full images whose case and hints have none")
            p.add_argument("--selector", help="selector outputs (JSON, a file a case) in the place of --hints")
            p.add_argument("--store", help="folder with providers' answers of earlier runs")
        if name == "run-batch":
            p.add_argument("--limit", type=int)
        if name != "build-pilot":
            p.add_argument("--trace-mode", choices=["auto", "patho-r1", "heuristic", "manual"])
        if name == "run-case":
            p.add_argument("--case-id")
            p.add_argument("--slide-path")
            p.add_argument("--override-box-thumb", help="manual boxes x1,y1,x2,y2;...")
            p.add_argument("--force-zoom", type=float)
            p.add_argument("--early-stop-after", type=int)
            p.add_argument("--operator-note")
        if name == "build-pilot":
            p.add_argument("--positives", type=int, default=12)
            p.add_argument("--negatives", type=int, default=12)
    p = sub.add_parser("replay-case")
    p.add_argument("--case-dir", help="a folder with events.jsonl and case_result.json")
    p.add_argument("--output-root", help="of a run of this engine, with --case-id")
    p.add_argument("--case-id")
    p.add_argument("--write", action="store_true")
    p = sub.add_parser("eval-run")
    p.add_argument("--run-dir", required=True)
    p.add_argument("--own", action="store_true", help="a run of this engine (case_results), not one folder a case")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    settings = load(a.runtime, a.budget)
    if a.what in ("run-batch", "run-case", "build-pilot"):
        if a.what == "run-case" and a.slide_path:
            cases = plan.single_case(spark, a.slide_path)
        else:
            cases = plan.read_cases(spark, a.manifest, a.labels, settings)
        if a.what == "build-pilot":
            picked = labels.pilot(cases, "serrated_target", "seq", a.positives, a.negatives)
            rows = F.collect_list(F.struct("case_id", "slide_path", "label", "serrated_target", "ssl_like_target", "dysplasia_proxy_target", "pilot_split", "selection_reason"))
            about = [F.lit("serrated_lesion_vs_non_serrated").alias("pilot_target"), F.lit(a.positives).alias("positives_requested"), F.lit(a.negatives).alias("negatives_requested")]
            one = picked.coalesce(1).agg(rows.alias("cases"))  # as many cases as were asked for
            io.write_documents(one.select(*about, F.size("cases").alias("selected_case_count"), "cases"), f"{a.output_root}/pilot_{a.positives}_{a.negatives}")
            return
        if a.what == "run-case" and a.case_id:
            cases = labels.case_by_id(cases, "case_id", a.case_id, "seq")
        if a.what == "run-batch" and a.limit is not None:
            n = a.limit if a.limit >= 0 else max(0, cases.count() + a.limit)
            cases = cases.orderBy("seq").limit(n)
        pixels, crops = (spark.read.parquet(x) for x in (a.pixels, a.crops))
        hints = io.read_hints(spark, a.selector) if a.selector else spark.read.parquet(a.hints)
        asked = plan.Interventions(a.override_box_thumb, a.force_zoom, a.early_stop_after, a.operator_note) if a.what == "run-case" else plan.Interventions()
        backends = {stage: providers.named(names, PROVIDERS) for stage, names in settings.chains}
        done = plan.run(cases, pixels, hints, crops, settings, a.thumb and tuple(a.thumb), a.full and tuple(a.full), _keep(f"{a.output_root}/tables"), a.trace_mode, asked, backends, Store(spark, a.store) if a.store else None)
        io.write_documents(done.results, f"{a.output_root}/case_results")
        io.write_documents(done.log, f"{a.output_root}/events")
        io.write_documents(done.attempts, f"{a.output_root}/attempts")
        io.write_documents(plan.batch_summary(done), f"{a.output_root}/batch_summary")
        files.write_cases(plan.crop_files(done), f"{a.output_root}/crops")
        drawn = done.windows.select("case_id", "step_id").distinct()  # a window without pixels has no image
        where = F.concat(F.lit("crops/"), files.folder_of("case_id"), F.lit("/"), F.col("case_id"), F.lit("/"))
        io.write_crop_manifest(done.steps.join(drawn, ["case_id", "step_id"]), f"{a.output_root}/crop_manifest", where)
        io.write_predictions(done.results, f"{a.output_root}/case_predictions")
    elif a.what == "replay-case":
        text = replay(spark, a.case_dir) if a.case_dir else replay_of_run(spark, a.output_root, a.case_id)
        if a.write:
            io.write_text(text, "replay", f"{a.case_dir}/replay" if a.case_dir else f"{a.output_root}/replay/{a.case_id}")
        else:
            print(text.first().replay, end="")
    else:
        results = io.read_results(spark, f"{a.run_dir}/case_results") if a.own else io.read_run(spark, a.run_dir)
        summary, layers = plan.evaluate(results)
        io.write_documents(summary, f"{a.run_dir}/evaluation_summary")
        io.write_documents(layers, f"{a.run_dir}/evaluation_layers")
        io.write_predictions(results, f"{a.run_dir}/predictions")
        summary.show(truncate=False)
        layers.show(truncate=False)


def replay(spark: SparkSession, case_dir: str):
    """The replay text of a case folder (events.jsonl, case_result.json)."""
    name = case_dir.rstrip("/").rsplit("/", 1)[-1]
    events = io.read_log(spark, f"{case_dir}/events.jsonl").withColumn("seq", F.monotonically_increasing_id()).withColumn("case_id", F.lit(name))
    return _replay(events, io.read_document(spark, f"{case_dir}/case_result.json", io.RESULT), name)


def replay_of_run(spark: SparkSession, output_root: str, case_id: str):
    """The replay text of one case of a run of this engine."""
    events = io.read_log(spark, f"{output_root}/events", f"{io.EVENT}, seq long").filter(F.col("case_id") == case_id)
    return _replay(events, io.read_results(spark, f"{output_root}/case_results").filter(F.col("case_id") == case_id), case_id)


def _replay(events, r, name: str):
    line = timeline.event_line(*[F.col(c) for c in ("timestamp", "state", "agent", "status", "input_ref", "output_ref")])
    lines = timeline.timeline(events.withColumn("line", line), "case_id", ["seq"])
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    p = "hierarchical_prediction"
    listed = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.coalesce(e["value"]["status"], F.lit("None")))), "\n")
    flat = r.select(
        F.lit(name).alias("case_id"), "status", n("trace_clusters").alias("trace_clusters"), n("trajectory").alias("trajectory_steps"), "serrated_target", "ssl_like_target", "dysplasia_proxy_target",
        n("audit.warnings").alias("warnings"), n("audit.errors").alias("errors"), F.col(f"{p}.serrated_lesion_assessment.label").alias("serrated_label"),
        F.col(f"{p}.ssl_like_architecture_assessment.label").alias("ssl_like_label"), F.col(f"{p}.dysplasia_assessment.label").alias("dysplasia_label"),
        listed("serrated_checklist").alias("serrated_list"), listed("ssl_like_crypt_checklist").alias("ssl_like_list"), listed("dysplasia_checklist").alias("dysplasia_list"))
    return timeline.replay(lines, flat)


if __name__ == "__main__":
    main()
