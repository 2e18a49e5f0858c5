"""Operators on small hand-made rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as geo
from tessera.functions import pixels
from tessera.operators import assess, audit, evidence, labels, memo, metrics, path, raster, regions, timeline
from tessera.settings import LAYERS, Settings
from tessera.sources import io, providers

S = Settings(serrated_labels=("HP", "SSL", "TSA"), ssl_like_labels=("SSL",))


def box(*v):
    return geo.box(*[F.lit(x) for x in v])


def value(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_geometry(spark):
    cx, cy = geo.center(box(10, 20, 30, 40))
    hx, _ = geo.center(box(0, 0, 5, 0))
    moved = geo.scale_box(box(100, 50, 300, 250), *[F.lit(x) for x in (1000.0, 500.0, 4000, 2000)])
    r = value(spark, cx, cy, hx, moved, geo.overlap_ratio(box(0, 0, 10, 10), box(2, 2, 4, 4)), geo.area(geo.intersection(box(0, 0, 2, 2), box(2, 0, 4, 2))),
              geo.clamp(F.lit(5), F.lit(8), F.lit(3)), geo.clamp(F.lit(None).cast("int"), F.lit(0), F.lit(3)), geo.overlap_ratio(box(0, 0, 0, 0), box(0, 0, 5, 5)))
    assert list(r) == [20, 30, 2, (400, 200, 1200, 1000), 1.0, 0, 8, None, 0.0]


def test_membership_keeps_null_apart_from_empty(spark):
    rows = spark.createDataFrame([("SSL",), ("HP",), ("",), (None,)], "t string").select(labels.member(F.col("t"), ["SSL"]).alias("m"))
    assert [r.m for r in rows.collect()] == [1, 0, 0, None]


def test_last_label_row_wins_and_pilot(spark):
    cases = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "k int, seq int")
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 2), (3, "b", 3)], "k int, v string, o int")
    got = labels.with_labels(cases, rows, "k", F.col("o")).withColumn("t", labels.member(F.col("v"), ["b"]))
    assert {r.k: r.t for r in got.collect()} == {1: 1, 2: 0, 3: 1, 4: None}
    assert sorted(r.k for r in labels.pilot(got, "t", "seq", 1, 5).collect()) == [1, 2]
    with pytest.raises(KeyError):
        labels.case_by_id(cases, "k", 9, "seq")


def test_components_touch_at_corners_and_ids_have_gaps(spark):
    cells = [(1, 0, 0), (1, 2, 2), (1, 3, 3), (1, 3, 4), (2, 15, 15)]
    rows = spark.createDataFrame([(*c, 4, 10000, 0, 0) for c in cells], "case_id int, gy int, gx int, n long, tissue long, pale long, artifact long")
    found = regions.connected(rows, S)
    assert {(r.case_id, r.gy, r.gx): r.component for r in found.collect()} == {(1, 0, 0): 0, (1, 2, 2): 1, (1, 3, 3): 1, (1, 3, 4): 1, (2, 15, 15): 0}
    boxes = regions.proposals(found, S, 160, 160).collect()
    assert [(r.case_id, r.cluster_id, r.x1, r.y1, r.x2, r.y2, r.cell_count) for r in boxes] == [(1, "cluster_01", 20, 20, 50, 40, 3)]
    everyone = spark.createDataFrame([(1,), (2,)], "case_id int")
    filled = regions.fallback(everyone, regions.proposals(found, S, 160, 160), 160, 160)
    assert {(r.case_id, r.cluster_id, r.x1, r.x2) for r in filled.collect()} == {(1, "cluster_01", 20, 50), (2, "cluster_00", 32, 128)}


def test_components_against_search(spark):
    import random

    rnd = random.Random(5)
    cells = {k: {(y, x) for y in range(16) for x in range(16) if rnd.random() < 0.35} for k in range(12)}
    rows = spark.createDataFrame([(k, y, x) for k, s in cells.items() for y, x in s], "case_id int, gy int, gx int")
    got = {(r.case_id, r.gy, r.gx): r.component for r in regions.connected(rows, S).collect()}
    for k, left in cells.items():
        left, n = set(left), 0
        while left:
            todo = [min(left)]
            while todo:
                c = todo.pop()
                if c in left:
                    left.remove(c)
                    assert got[k, *c] == n
                    todo += [(c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            n += 1


def test_scores_reach_priority_four_at_most(spark):
    rows = [("a", 500, 9000, 0, 300, 9999), ("b", 9000, 0, 2801, 300, 0), ("c", 9000, 1801, 0, 300, 501), ("d", 9000, 0, 0, 10, 0), ("e", 9000, 1001, 0, 10, 0)]
    r = regions.scored(spark.createDataFrame(rows, "k string, tissue long, pale long, artifact long, area_fraction long, hint_overlap long"), S)
    got = {x.k: (x.l, x.s, x.risk, x.d) for x in r.collect()}
    assert got == {"a": ("background", 0, 0, False), "b": ("artifact", 0, 0, False), "c": ("serrated_suspicious_mucosa", 4, 5, True),
                   "d": ("non_serrated_mucosa", 1, 1, False), "e": ("serrated_suspicious_mucosa", 2, 2, False)}


def walk(spark, rows, settings=S):
    df = spark.createDataFrame(rows, "case_id int, cluster_id string, x1 int, y1 int, x2 int, y2 int, l string, s int, d boolean")
    return [tuple(r) for r in path.trajectory(df, 16000, 16000, settings).orderBy("case_id", "ord").select("step_id", "m", "cluster_id", "x", "y", "action").collect()]


def test_trajectory(spark):
    lesion = "serrated_suspicious_mucosa"
    got = walk(spark, [(1, "cluster_00", 0, 0, 100, 100, lesion, 3, False), (1, "cluster_01", 100, 0, 300, 100, lesion, 3, True), (1, "cluster_02", 9000, 9000, 9100, 9100, "artifact", 0, False)])
    # the higher id goes first; the other's low window overlaps it and is passed over
    assert got == [("step_00", 1.0, "cluster_01", 512, 512, "inspect"), ("step_01", 2.5, "cluster_01", 256, 256, "inspect"), ("step_02", 5.0, "cluster_01", 200, 128, "inspect"), ("step_03", 1.0, None, 200, 128, "stop")]
    assert walk(spark, [(1, "cluster_00", 0, 0, 9, 9, "background", 0, False)]) == [("step_00", 1.0, None, 0, 0, "stop")]
    many = [(1, f"cluster_{i:02d}", 4000 * i, 4000 * i, 4000 * i + 10, 4000 * i + 10, lesion, 5, True) for i in range(4)]
    assert len(walk(spark, many)) == 9


def test_gate_order_error_can_follow_from_suppression(spark):
    rows = [("c", "k", i, g) for i, g in enumerate(["level_1", "level_3", "level_2", "level_3"])]
    df = spark.createDataFrame(rows, "case_id string, cluster_id string, ord int, stage_gate string")
    assert [r.ord for r in audit.early_gate(df).collect()] == [1]


def test_merge_is_the_ordered_fold(spark):
    from itertools import product

    status = ["supporting", "opposing", "uncertain", "not_assessed"]
    rows, want = [], {}
    for i, seq in enumerate(product(status, repeat=4)):
        now, steps = None, []
        for j, s in enumerate(seq):
            rows.append((i, "c", j, f"s{j}", s))
            if s != "not_assessed":
                now = "supporting" if "supporting" in (now, s) else s
                steps.append(f"s{j}")
        if now:
            want[i] = (now, ",".join(steps))
    df = spark.createDataFrame(rows, "case_id int, criterion string, ord int, step_id string, status string")
    assert {r.case_id: (r.status, r.evidence_steps) for r in evidence.merge(df, "case_id").collect()} == want


def test_checklist_assessment_and_report(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id int")
    merged = spark.createDataFrame([(1, "mucus_cap", "supporting", "step_00,step_01"), (1, "crypt_branching", "supporting", "step_01"), (1, "basal_dilatation", "supporting", "step_01"),
                                    (1, "no_such_criterion", "supporting", "step_00")], "case_id int, criterion string, status string, evidence_steps string")
    listed = evidence.checklist(cases, merged, evidence.criteria(spark))
    assert listed.count() == 2 * sum(map(len, LAYERS.values()))
    suspicious = spark.createDataFrame([(1, True)], "case_id int, suspicious boolean")
    a = assess.assess(evidence.counts(listed), suspicious)
    got = {r.case_id: r for r in a.collect()}
    assert (got[1].serrated_score, got[1].ssl_like_label, got[1].ssl_like_score, got[1].dysplasia_label) == (0.3, "ssl_like_supported", 0.64, "dysplasia_indeterminate")
    assert (got[2].serrated_positive, got[2].ssl_like_label, got[2].dysplasia_score) == (False, "not_applicable_non_serrated", 0.15)
    text = {r.case_id: r.report for r in assess.report(a, assess.supporting_lines(listed)).collect()}
    assert "- Supporting findings: basal_dilatation (step_01); crypt_branching (step_01); mucus_cap (step_00, step_01)" in text[1].split("\n")
    assert "- Supporting findings: No decisive supporting item recorded." in text[2].split("\n")
    both = spark.createDataFrame([(3, "serrated", c, "supporting", "step_00") for c in ("serrated_lesion_context", "mucus_rich_surface", "serrated_surface_pattern")], "case_id int, layer string, criterion string, status string, evidence_steps string")
    assert assess.supporting_lines(both).first().line == "serrated_surface_pattern (step_00); mucus_rich_surface (step_00); serrated_lesion_context (step_00)"
    assert len(text[2].split("\n")) == 17


def test_audit_status(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    bad = spark.createDataFrame([(1, "error", "x", ""), (1, "warning", "y", ""), (2, "warning", "y", "")], "case_id int, severity string, rule string, ref string")
    assert {r.case_id: r.status for r in audit.status(cases, bad).collect()} == {1: "fail", 2: "warn", 3: "ok"}
    exports = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "case_id int, returncode int")
    assert sorted(r.case_id for r in audit.export_violations(exports).collect()) == [2, 3]


def test_metrics_without_cases(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", 1, None), ("b", 2, 1), ("b", 1, 1)], "layer string, target int, pred int")
    got = {r.layer: (r.cases, r.accuracy, r.recall, r.specificity) for r in metrics.layer_metrics(rows).collect()}
    assert got == {"a": (0, None, 0.0, 0.0), "b": (2, 0.5, 1.0, 0.0)}
    empty = spark.createDataFrame([], "status string, steps long")
    assert tuple(metrics.run_summary(empty, ["steps"]).first()) == (0, 0, 0, 0.0)


def test_fallback_and_retries(spark):
    rows = [(1, 0, "a", "error", None), (1, 1, "b", "ok", "B"), (1, 2, "c", "ok", "C"), (2, 0, "a", "unavailable", None)]
    got = {r.k: (r.provider, r.output, r.attempts) for r in memo.first_success(spark.createDataFrame(rows, "k int, priority int, provider string, status string, output string"), "k").collect()}
    assert got == {1: ("b", "B", "a:error,b:ok"), 2: (None, None, "a:unavailable")}


def test_cache_keys_and_lookup(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("", None)], "x string, y int").withColumn("key", memo.content_key("x", "y"))
    assert rows.select("key").distinct().count() == 2
    cache = rows.select("key").limit(1).withColumn("v", F.lit(1))
    hit, miss = memo.lookup(rows, cache)
    assert hit.count() + miss.count() == 3
    assert memo.remember(cache, rows.select("key").distinct().withColumn("v", F.lit(2))).filter("v = 2").count() == 2


def test_boxes_and_modes(spark):
    r = value(spark, memo.parse_boxes(F.lit("1,2,3,4; ;5,x,7")), memo.mode_plan(F.lit("1,2,3,4"), F.lit("auto")), memo.mode_plan(F.lit(None), F.lit("auto")), memo.mode_plan(F.lit(""), F.lit("m")))
    assert [tuple(b) for b in r.c0] == [(1, 2, 3, 4), (5, None, 7, None)]
    assert (r.c1, r.c2, r.c3) == (["manual"], ["model", "heuristic"], ["m"])


def test_text_evidence(spark):
    r = value(spark, evidence.last_line(F.lit("a\r\nb  last \n\n")), evidence.last_line(F.lit("")), evidence.last_line(F.lit("x" * 400)))
    assert (r.c0, r.c1, len(r.c2)) == (" last", "", 320)
    texts = spark.createDataFrame([(1, "Serration TO THE BASE"), (2, None)], "k int, text string")
    got = {(x.k, x.criterion): x.status for x in evidence.keyword_hits(texts, "k").collect()}
    assert got[1, "serration_to_base"] == "supporting" and got[1, "mucus_cap"] == "uncertain" and got[2, "hyperchromasia"] == "uncertain"


def test_masks_are_the_float_masks(spark):
    import random

    rnd = random.Random(1)
    rows = [tuple(rnd.randrange(256) for _ in range(3)) for _ in range(400)]
    got = spark.createDataFrame(rows, "r int, g int, b int").select("r", "g", "b", *[f(F.col("r"), F.col("g"), F.col("b")).alias(f.__name__) for f in (pixels.tissue, pixels.pale, pixels.artifact)])
    for x in got.collect():
        mean, sat = (x.r + x.g + x.b) / 3, max(x.r, x.g, x.b) - min(x.r, x.g, x.b)
        tissue = mean < 235 and sat > 8
        assert (x.tissue, x.pale, x.artifact) == (tissue, tissue and mean > 165 and sat < 28, sat > 75 and (x.r > 1.25 * x.g or x.b > 1.25 * x.g or x.g > 1.25 * x.r))


def test_csv_image_and_run_folder(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b"\xef\xbb\xbfslide_id,slide_filename,slide_path\na,fa,/x/a.svs\nb,,/x/b.svs\n")
    rows = io.read_rows(spark, str(tmp_path / "m.csv"), ["slide_id", "slide_filename", "slide_path"]).orderBy("slide_id").collect()
    assert [tuple(r) for r in rows] == [("a", "fa", "/x/a.svs"), ("b", "", "/x/b.svs")]
    (tmp_path / "s.csv").write_text('slide_id,type,grade\na,,low\nb,"x, y"\nc,"",\n')
    rows = io.read_rows(spark, str(tmp_path / "s.csv"), ["slide_id", "type", "grade"]).orderBy("slide_id").collect()
    assert [tuple(r) for r in rows] == [("a", "", "low"), ("b", "x, y", None), ("c", "", "")]
    assert value(spark, io.stem(F.lit("/x/y/case.one.svs"))).c0 == "case.one"
    (tmp_path / "i.png").write_bytes(io.encode_png(2, 1, bytes([10, 20, 30, 40, 50, 60])))
    got = io.read_images(spark, str(tmp_path / "i.png")).orderBy("x").collect()
    assert [(r.y, r.x, r.r, r.g, r.b) for r in got] == [(0, 0, 10, 20, 30), (0, 1, 40, 50, 60)]
    png = io.crops(spark.createDataFrame([(1, y, x, 9, 9, 9) for y in range(4) for x in range(4)], "k int, y int, x int, r int, g int, b int"), "k", output=2).first().png
    assert bytes(png)[:8] == b"\x89PNG\r\n\x1a\n"
    case = tmp_path / "run" / "case_1"
    case.mkdir(parents=True)
    (tmp_path / "run" / "empty").mkdir()
    made = {"label": "serrated_lesion", "positive": True, "score": 0.5}
    (case / "case_result.json").write_text(json.dumps({
        "status": "warn", "serrated_target": 1, "ssl_like_target": 0, "hierarchical_prediction": {"serrated_lesion_assessment": made, "ssl_like_architecture_assessment": made | {"positive": False}},
        "serrated_checklist": {"b": {"status": "supporting"}, "a": {"status": "uncertain"}}, "audit": {"warnings": ["w"], "metrics": {"trajectory_length": 3, "serrated_checklist_completeness": 1.0}}}))
    (case / "events.jsonl").write_text('{"timestamp": "t1", "state": "START", "agent": "a", "status": "ok"}\n\n{"timestamp": "t2", "state": "END", "agent": "b", "status": "ok", "output_ref": "o"}\n')
    from tessera.__main__ import replay
    from tessera.plans.run import evaluate

    summary, layers = evaluate(io.read_run(spark, str(tmp_path / "run")))
    s = summary.first()
    assert (s.case_count, s.warn_cases, s.avg_trajectory_length, s.avg_serrated_completeness) == (1, 1, 3.0, 1.0)
    assert {r.layer: (r.cases, r.accuracy) for r in layers.collect()} == {"serrated": (1, 1.0), "ssl_like": (1, 1.0), "dysplasia_proxy": (0, None)}
    text = replay(spark, str(case)).first().replay
    assert text.startswith("# Replay for case_1\n\n## Timeline\n\n- [t1] START/a status=ok input=None output=None\n- [t2]") and "- a: uncertain\n- b: supporting\n" in text and text.endswith("\n")
    io.write_predictions(io.read_run(spark, str(tmp_path / "run")), str(tmp_path / "p"))
    head, row = spark.read.text(str(tmp_path / "p")).collect()
    assert head.value == ",".join(io.PREDICTIONS) and ",True,0.5," in row.value


def test_providers(spark, tmp_path):
    from tessera.plans.staging import keep

    script = tmp_path / "p.py"
    script.write_text("import sys, json\na = sys.argv\nr = json.load(open(a[a.index('--request-json') + 1]))\nif r['n'] == 2: sys.exit(3)\njson.dump({'n': r['n'] + 1}, open(a[a.index('--response-json') + 1], 'w'))\n")
    rows = spark.createDataFrame([(str(n), json.dumps({"n": n})) for n in (1, 2)], "key string, request string")
    import sys

    chain = [("none", providers.command([], "s")), ("outside", providers.command([sys.executable, str(script)], "s")), ("rules", providers.rules(F.lit("{}")))]
    got = memo.first_success(providers.chain(rows, chain, keep), "key")
    assert {r.key: (r.provider, r.output, r.attempts) for r in got.collect()} == {"1": ("outside", '{"n": 2}', "none:unavailable,outside:ok"), "2": ("rules", "{}", "none:unavailable,outside:error,rules:ok")}


def test_whole_run(spark, tmp_path):
    from tessera.plans import run as plan
    from tessera.plans.staging import keep

    (tmp_path / "m.csv").write_text("slide_id,slide_filename,slide_path\ncase_ssl,a,/a.svs\ncase_hp,b,/b.svs\ncase_ta,c,/c.svs\n")
    (tmp_path / "l.csv").write_text("slide_id,type,grade\ncase_ssl,HP,low\ncase_ssl,SSL,low\ncase_hp,HP,low\ncase_ta,TA,high\n")
    cases = plan.read_cases(spark, str(tmp_path / "m.csv"), str(tmp_path / "l.csv"), S)
    assert {r.case_id: (r.serrated_target, r.ssl_like_target, r.dysplasia_proxy_target) for r in cases.collect()} == {"case_ssl": (1, 1, 0), "case_hp": (1, 0, 0), "case_ta": (0, 0, 1)}
    assert labels.pilot(cases, "serrated_target", "seq", 2, 1).count() == 3
    thumb = [("case_ssl", y, x, 190, 180, 170) for y in range(16, 48) for x in range(16, 48)]
    pix = spark.createDataFrame(thumb, "case_id string, y int, x int, r int, g int, b int")
    hint = spark.createDataFrame([("case_ssl", 16, 16, 40, 40, 0.9)], "case_id string, hx1 int, hy1 int, hx2 int, hy2 int, score double")
    crop = spark.createDataFrame([("case_ssl", y, x, 190, 180, 170) for y in range(1900, 2100, 8) for x in range(1900, 2100, 8)], "case_id string, py int, px int, r int, g int, b int")
    done = plan.run(cases, pix, hint, crop, S, (64, 64), (4000, 4000), keep)
    got = {r.case_id: r for r in done.results.collect()}
    assert {k: v.status for k, v in got.items()} == {"case_ssl": "ok", "case_hp": "fail", "case_ta": "fail"}
    assert got["case_ssl"].hierarchical_prediction.serrated_lesion_assessment.positive
    assert got["case_hp"].trajectory[0].action == "stop"
    out = tmp_path / "run"
    for k in got:
        os.makedirs(out / k)
        (out / k / "case_result.json").write_text(done.results.filter(F.col("case_id") == k).select(F.to_json(F.struct("*")).alias("j")).first().j)
    summary, layers = plan.evaluate(io.read_run(spark, str(out)))
    assert summary.first().fail_cases == 2 and summary.first().avg_runtime_ms > 0
    assert {r.layer: r.cases for r in layers.collect()} == {"serrated": 3, "ssl_like": 3, "dysplasia_proxy": 3}
    ssl = got["case_ssl"]
    assert ssl.timing.total_runtime_ms >= ssl.timing.trace_runtime_ms > 0 and ssl.cost.observation_steps == ssl.audit.metrics.observation_count == len(ssl.evidence_chain) > 0
    assert ssl.audit.metrics.serrated_proxy_correct is True and ssl.reasoning_state.supporting_evidence[0].startswith("This view")
    assert ssl.trajectory[0].need_to_see.startswith("Confirm") and got["case_hp"].trajectory[0].need_to_see.endswith("no reviewable lesion cluster was retained.")
    io.write_documents(done.log, str(tmp_path / "root" / "events"))
    io.write_documents(done.results, str(tmp_path / "root" / "case_results"))
    from tessera.__main__ import replay_of_run

    text = replay_of_run(spark, str(tmp_path / "root"), "case_ssl").first().replay
    states = [x.split("] ")[1].split("/")[0] for x in text.split("\n") if x.startswith("- [")]
    assert states[0] == "START" and states[1] == "TRACE" and states[-1] == "END" and "NAVIGATE" in states and "OBSERVE" in states and "- serrated_target: 1" in text
    assert {r.case_id: r.outcome for r in plan.batch_summary(done).collect()} == {"case_ssl": "completed", "case_hp": "completed", "case_ta": "completed"}
    plain = plan.read_cases(spark, str(tmp_path / "m.csv"), str(tmp_path / "l.csv"), Settings(serrated_labels=("HP",)))
    assert {r.case_id: r.ssl_like_target for r in plain.collect()} == {"case_ssl": 0, "case_hp": 0, "case_ta": 0}
    assert Settings(ssl_like_labels=()).ssl_like_labels == Settings().ssl_like_labels != ()


def test_hints_by_mode_and_by_hand(spark):
    from tessera.plans import run as plan

    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    hints = spark.createDataFrame([("a", "heuristic", 1), ("a", "patho-r1", 2), ("b", "heuristic", 3)], "case_id string, mode string, hx1 int")
    assert {(r.case_id, r.hx1) for r in plan.chosen_hints(cases, hints, None, None).collect()} == {("a", 2), ("b", 3)}
    assert {(r.case_id, r.hx1) for r in plan.chosen_hints(cases, hints, "heuristic", None).collect()} == {("a", 1), ("b", 3)}
    assert sorted((r.case_id, r.hx1, r.hy2) for r in plan.chosen_hints(cases, hints, None, "1,2,3,4;5,6,7,8").collect()) == [("a", 1, 4), ("a", 5, 8), ("b", 1, 4), ("b", 5, 8)]


def test_unknown_ids_and_names_are_errors(spark):
    steps = spark.createDataFrame([(1, "step_00", "k", "inspect", "g")], "case_id int, step_id string, cluster_id string, action string, review_goal string")
    about = spark.createDataFrame([(1, "k", "l", 2, True, 3)], "case_id int, cluster_id string, l string, s int, d boolean, risk int")
    crops = lambda s: spark.createDataFrame([(1, s, 5)], "case_id int, step_id string, tissue int")
    assert evidence.observed(steps, crops("step_00"), about).first().risk == 3
    with pytest.raises(Exception, match="no step step_09"):
        evidence.observed(steps, crops("step_09"), about).collect()
    found = spark.createDataFrame([(1, "cluster_00", 0, 0, 1, 1, 4)], "case_id int, cluster_id string, x1 int, y1 int, x2 int, y2 int, cell_count int")
    answers = lambda k: spark.createDataFrame([(1, k, 2)], "case_id int, cluster_id string, s int")
    assert regions.annotated(found, answers("cluster_00")).first().s == 2
    with pytest.raises(Exception, match="no proposal cluster_07"):
        regions.annotated(found, answers("cluster_07")).collect()
    failed = spark.createDataFrame([(1, 0, "a", "error", None)], "k int, priority int, provider string, status string, output string")
    with pytest.raises(Exception, match="all providers failed: a:error"):
        memo.first_success(failed, "k", strict=True).collect()
    with pytest.raises(KeyError):
        providers.named(["rules", "nobody"], {"rules": None})


def test_crop_manifest(spark, tmp_path):
    steps = spark.createDataFrame([(1, 1, "step_01", 5, 6, 2.5, 512, "k", "g", "level_2", "inspect", "see"), (1, 0, "step_00", 3, 4, 1.0, 1024, "k", "g", "level_1", "inspect", "look")],
                                  "case_id int, ord int, step_id string, x int, y int, m double, size int, cluster_id string, review_goal string, stage_gate string, action string, need_to_see string")
    io.write_crop_manifest(steps, str(tmp_path / "c"), "crops/")
    crops = json.loads(spark.read.text(str(tmp_path / "c")).first().value)["crops"]
    assert [c["image_path"] for c in crops] == ["crops/step_00_mag1.0_1024.png", "crops/step_01_mag2.5_512.png"] and crops[1]["o"] == "see" and crops[0]["metadata"]["cluster_id"] == "k"


def test_stream_of_events(spark, tmp_path):
    from tessera.streaming import log

    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("".join(json.dumps({"timestamp": f"2024-01-01T00:00:{i:02d}", "case_id": "c", "state": "TRACE", "status": "ok" if i else "error", "latency_ms": 5}) + "\n" for i in range(3)))
    q = log.stage_latency(log.read_events(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("latency").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT state, events, failures, latency_ms FROM latency").first()
    assert tuple(r) == ("TRACE", 3, 1, 15)


def test_settings(tmp_path, monkeypatch):
    from tessera.settings import load

    (tmp_path / "r.yaml").write_text("serrated_labels: [a, b]\nregions: [[1.0, 10]]\n")
    monkeypatch.setenv("TESSERA_BUDGET", "")
    assert load(str(tmp_path / "r.yaml")).regions == ((1.0, 10),)
    (tmp_path / "r.yaml").write_text("nothing: 1\n")
    with pytest.raises(ValueError):
        load(str(tmp_path / "r.yaml"))


def test_tiles_keep_whole_ones(spark):
    b = spark.createDataFrame([(1, 0, 0, 600, 300), (2, 0, 0, 255, 900)], "case_id int, x1 int, y1 int, x2 int, y2 int")
    assert [(r.case_id, r.tx, r.ty) for r in raster.tiles(b).orderBy("tx").collect()] == [(1, 0, 0), (1, 256, 0)]


def test_timeline_without_results(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "case_id int, seq int, line string")
    assert timeline.timeline(rows, "case_id", ["seq"]).first().timeline == "a\nb"
