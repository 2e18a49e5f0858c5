"""Runs with faults, sizes by case, providers and a store; file order; open records."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, evidence, faults, raster, regions
from tessera.plans import bindings
from tessera.plans import run as plan
from tessera.plans.staging import keep
from tessera.settings import Settings, adapted, load
from tessera.sources import io, providers
from tessera.sources.store import Store

S = Settings(serrated_labels=("HP", "SSL"), ssl_like_labels=("SSL",))
CASE = "case_id string, slide_path string, label string, serrated_target int, ssl_like_target int, dysplasia_proxy_target int, thumb_w int, thumb_h int, full_w int, full_h int"


def tables(spark, names=("a", "b"), odd=()):
    sizes = {"a": (64, 64, 4000, 4000), "b": (32, 48, 2000, 6000)}
    cases = spark.createDataFrame([(k, f"/{k}.svs", "SSL", 1, 1, 0, *sizes.get(k, sizes["a"])) for k in names] + list(odd), CASE)
    pix = spark.createDataFrame([(k, y, x, 190, 180, 170) for k in names for y in range(16, 48) for x in range(8, 24)], "case_id string, y int, x int, r int, g int, b int")
    hints = spark.createDataFrame([(k, 8, 16, 24, 40, 0.9) for k in names], "case_id string, hx1 int, hy1 int, hx2 int, hy2 int, score double")
    crop = spark.createDataFrame([(k, y, x, 190, 180, 170) for k in names for y in range(1500, 4400, 40) for x in range(600, 1600, 40)], "case_id string, py int, px int, r int, g int, b int")
    return cases, pix, hints, crop


def test_sizes_of_each_case(spark):
    done = plan.run(*tables(spark), S, None, None, keep)
    boxes = {(r.case_id, r.x1, r.y1, r.x2, r.y2) for r in done.clusters.collect()}
    assert boxes == {("a", 8, 16, 24, 48), ("b", 8, 15, 24, 48)}
    first = {r.case_id: (r.x, r.y) for r in done.steps.filter("ord = 0").collect()}
    # the middle of the box on each full image, moved inside by half a window
    assert first == {"a": (1000, 2000), "b": (1000, 3938)}
    assert done.violations.filter("rule = 'step_out_of_bounds'").count() == 0
    assert {(r.case_id, r.n) for r in done.patches.groupBy("case_id").agg(F.count("*").alias("n")).collect()} == {("a", 15), ("b", 16)}
    states = {(r.state, r.status) for r in done.log.filter("case_id = 'a'").collect()}
    assert {("TRACE_TO_SEGMENT", "ok"), ("PATCH_EXPORT", "ok")} <= states


def test_two_bad_cases_of_ten(spark):
    names = [f"c{i}" for i in range(8)]
    odd = [("none", "/n.svs", "SSL", 1, 1, 0, None, 64, 4000, 4000), ("out", "/o.svs", "HP", 1, 0, 0, 64, 64, 4000, 4000)]
    cases, pix, hints, crop = tables(spark, names, odd)
    pix = pix.unionByName(spark.createDataFrame([("out", 5, 64, 1, 2, 3), ("none", 1, 1, 1, 2, 3)], pix.schema))
    done = plan.run(cases, pix, hints, crop, S, None, None, keep)
    got = {r.case_id: (r.outcome, r.stage, r.error) for r in plan.batch_summary(done).collect()}
    assert got == {k: ("completed", None, None) for k in names} | {"none": ("failed", "ingest", "no image size"), "out": ("failed", "ingest", "pixel outside of the image")}
    assert sorted(r.case_id for r in done.results.collect()) == names


def test_small_boxes_fail_their_export(spark):
    cases, pix, hints, crop = tables(spark)
    hints = hints.filter("case_id = 'a'").unionByName(spark.createDataFrame([("b", 8, 16, 9, 17, 0.9)], hints.schema))
    done = plan.run(cases, pix, hints, crop, S, None, None, keep)
    assert {r.case_id for r in done.violations.filter("rule = 'export_failed'").collect()} == {"b"}


def test_providers_in_a_run(spark, tmp_path):
    asked = []
    answer = lambda k: F.format_string('{"clusters": [{"cluster_id": "%s", "l": "serrated_suspicious_mucosa", "s": 5, "d": true, "crypt_disorder_risk": 5, "desc": "seen"}]}', k)
    case = F.get_json_object("request", "$.case_id")

    def of(name, status, output):
        def ask(rows):
            asked.append(name)
            return rows.select("key", status.alias("status"), output.alias("output"), F.lit(7).cast("long").alias("latency_ms"))
        return name, ask

    names = ("a", "b", "c", "e")
    chain = {
        "trace": [of("first", F.when(case == "a", "error").otherwise("unavailable"), F.lit(None).cast("string")),
                  # c gets a priority that is no number, e a region that does not exist
                  of("second", F.lit("ok"), F.when(case == "c", F.replace(answer(F.lit("cluster_00")), F.lit(": 5"), F.lit(': "high"'))).when(case == "e", answer(F.lit("cluster_77"))).otherwise(answer(F.lit("cluster_00"))))],
        "observe": [of("texts", F.lit("ok"), F.lit('{"text": "Marked hyperchromasia and mitotic figures."}'))]}
    store = Store(spark, str(tmp_path / "store"))
    done = plan.run(*tables(spark, names), S, None, None, keep, backends=chain, store=store)
    got = {r.case_id: r for r in done.results.collect()}
    assert sorted(got) == ["a", "b", "c"] and {r.case_id: r.error for r in done.outcomes.filter("outcome = 'failed'").collect()} == {"e": "no proposal cluster_77"}
    top = {r.case_id: (r.s, r.risk, r.description) for r in done.clusters.collect()}
    assert top["a"] == top["b"] == (5, 5, "seen") and top["c"][0] < 5
    # an error is asked again, what is unavailable is not
    assert {k: v.cost.trace_attempts for k, v in got.items()} == {"a": 3, "b": 2, "c": 3}
    said = {(r.criterion, r.status) for r in done.hits.filter("case_id = 'c'").collect()}
    assert {("hyperchromasia", "supporting"), ("mitotic_activity_atypia", "supporting"), ("mucus_cap", "uncertain")} <= said
    before = len(asked)
    again = plan.run(*tables(spark, ("a", "b")), S, None, None, keep, backends=chain, store=store)
    assert again.attempts.count() == 0 and len(asked) > before  # the plans are made, but there is no request in them
    assert {r.case_id: r.s for r in again.clusters.collect()} == {"a": 5, "b": 5}
    assert {r.case_id: r.cost.trace_attempts for r in again.results.collect()} == {"a": 0, "b": 0}


def test_providers_plan_paths(spark, tmp_path):
    """The first valid path holds; one with a repeated id, a coordinate that is no number, or no step is an error; the rest goes by rule."""
    case = F.get_json_object("request", "$.case_id")
    step = lambda i, x, **more: {"step_id": f"step_{i:02d}", "x": x, "y": 2000, "m": 2.5, "o": "Look.", "review_goal": "dysplasia_assessment", "stage_gate": "level_3", **more}
    stop = step(1, 900, m=1.0, review_goal="integrated_impression", stage_gate="end", metadata={"action": "stop", "region_size_level0": 256})
    said = {"a": [step(0, 900, metadata={"cluster_id": "cluster_00", "action": "inspect"}), stop], "b": [step(0, 1), step(0, 2)], "c": [step(0, "far")], "e": []}
    answers = F.create_map(*[x for k, v in said.items() for x in (F.lit(k), F.lit(json.dumps({"steps": v})))])
    asked = []

    def planner(rows):
        asked.append(1)
        return rows.select("key", F.lit("ok").alias("status"), F.element_at(answers, case).alias("output"), F.lit(3).cast("long").alias("latency_ms"))

    names, store = ("a", "b", "c", "e"), Store(spark, str(tmp_path / "store"))
    plain = plan.run(*tables(spark, names), S, None, None, keep)
    done = plan.run(*tables(spark, names), S, None, None, keep, backends={"navigate": [("planner", planner)]}, store=store)
    assert done.steps.schema.simpleString() == plain.steps.schema.simpleString()
    got = [(r.step_id, r.x, r.y, r.m, r.size, r.cluster_id, r.action, r.need_to_see, r.x_millionths) for r in done.steps.filter("case_id = 'a'").orderBy("ord").collect()]
    assert got == [("step_00", 900, 2000, 2.5, 512, "cluster_00", "inspect", "Look.", 225000), ("step_01", 900, 2000, 1.0, 256, None, "stop", "Look.", 225000)]
    rest = lambda run: sorted(map(str, run.steps.filter("case_id <> 'a'").collect()))
    assert rest(done) == rest(plain)
    assert {(r.case_id, r.status, r.n) for r in done.attempts.groupBy("case_id", "status").agg(F.count("*").alias("n")).collect()} == {("a", "ok", 1), *((k, "error", 2) for k in "bce")}
    bad = {r.rule for r in done.violations.filter("case_id = 'a'").collect()}
    assert "gate_order" in bad  # the third level without the second: the audit says so
    assert {r.case_id: r.cost.observation_steps for r in done.results.collect()}["a"] == 1
    again = plan.run(*tables(spark, ("a",)), S, None, None, keep, backends={"navigate": [("planner", planner)]}, store=store)
    assert again.attempts.count() == 0 and again.steps.filter("x = 900").count() == 2


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, stage string, output string")


def test_store_of_two_writers(spark, tmp_path):
    path = str(tmp_path / "s")
    errors = []

    def write(who):
        try:
            for i in range(4):
                Store(spark, path).add(entries(spark, (f"{i}{who}ff", "trace", f"{who}{i}")))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = Store(spark, path)
    want = {f"{i}{k}ff": f"{k}{i}" for i in range(4) for k in "ab"}
    assert not errors and {r.key: r.output for r in store.entries().collect()} == want
    hit, miss = store.lookup(spark.createDataFrame([("1aff",), ("ffff",)], "key string"))
    assert [(r.key, r.output) for r in hit.collect()] == [("1aff", "a1")] and [r.key for r in miss.collect()] == ["ffff"]
    files = store.entries(["1a"]).inputFiles()
    assert files and "prefix" in store.entries(["1a"])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]
    before = store.commits()
    store.add(entries(spark, ("1aff", "trace", "newer"), (None, "trace", "no key")))
    store.compact()
    late = Store(spark, path).add(entries(spark, ("zz00", "observe", "late")))
    assert len(store.commits()) == 2 and late in store.commits()
    assert {r.key: r.output for r in store.entries().collect()} == want | {"1aff": "newer", "zz00": "late"}
    assert store.vacuum() == len(before) + 1 and store.entries().count() == 9
    assert store.add(entries(spark).limit(0)) is None and Store(spark, str(tmp_path / "none")).entries().count() == 0
    assert Store(spark, str(tmp_path / "none")).lookup(spark.createDataFrame([("ab",)], "key string"))[1].count() == 1


def test_faults_keep_the_first_stage(spark):
    rows = spark.createDataFrame([("a", "observe", "late"), ("a", "trace", "z"), ("a", "trace", "early"), ("b", "observe", "x")], "case_id string, stage string, error string")
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    assert {r.case_id: (r.outcome, r.stage, r.error) for r in faults.outcomes(cases, rows).collect()} == {"a": ("failed", "trace", "early"), "b": ("failed", "observe", "x"), "c": ("completed", None, None)}
    assert [r.case_id for r in faults.set_aside(cases, rows).collect()] == ["c"]
    steps = spark.createDataFrame([("a", "step_00", "k", "inspect")], "case_id string, step_id string, cluster_id string, action string")
    crops = spark.createDataFrame([("a", "step_00", 1), ("a", "step_09", 1)], "case_id string, step_id string, tissue int")
    about = spark.createDataFrame([("a", "k", "l", 2, True, 3)], "case_id string, cluster_id string, l string, s int, d boolean, risk int")
    assert [r.step_id for r in evidence.observed(steps, crops, about, strict=False).collect()] == ["step_00"]
    assert [tuple(r) for r in evidence.unknown_steps(steps, crops).collect()] == [("a", "observe", "no step step_09")]
    found = spark.createDataFrame([("a", "cluster_00", 0, 0, 1, 1, 4)], "case_id string, cluster_id string, x1 int, y1 int, x2 int, y2 int, cell_count int")
    answers = spark.createDataFrame([("a", "cluster_00", 2), ("b", "cluster_00", 2)], "case_id string, cluster_id string, s int")
    assert [r.case_id for r in regions.annotated(found, answers, strict=False).collect()] == ["a"]
    assert [r.case_id for r in regions.unknown_answers(found, answers).collect()] == ["b"]


def test_last_row_of_several_files(spark, tmp_path):
    for name, label in (("a", "first"), ("b", "second"), ("c", "third")):
        (tmp_path / f"{name}.csv").write_text("slide_id,type,grade\n" + "".join(f"{k},{label}{i},low\n" for i in range(200) for k in ("x", "y") if (k, name) != ("y", "c")))
    from tessera.operators import labels

    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for parts in ("1k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", parts)
            rows = io.read_rows(spark, str(tmp_path), ["slide_id", "type", "grade"], "at")
            assert {r.slide_id: r.type for r in labels.last_row(rows, "slide_id", F.col("at")).collect()} == {"x": "third199", "y": "second199"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_selector_outputs_keep_mode_and_sizes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"mode": "heuristic", "thumbnail_meta": {"slide_dimensions_level0": [4000, 3000], "thumbnail_size": [40, 30]}, "boxes": [{"x1": 1, "y1": 2, "x2": 3, "y2": 4, "score": 0.5}]}))
    (tmp_path / "b.json").write_text(json.dumps({"mode": "patho-r1", "thumbnail_meta": {"thumbnail_size": [20, 10]}, "boxes": []}))
    hints = io.read_hints(spark, str(tmp_path))
    assert {tuple(r)[:1] + tuple(r)[2:8] for r in hints.collect()} == {("a", "heuristic", 40, 30, 4000, 3000, 1), ("b", "patho-r1", 20, 10, None, None, None)}
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    got = {r.case_id: tuple(r[c] for c in plan.SIZES) for r in plan.sized(cases, hints, None, (900, 800)).collect()}
    assert got == {"a": (40, 30, 4000, 3000), "b": (20, 10, 900, 800), "c": (None, None, 900, 800)}


def test_a_runtime_file_adds_a_criterion(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("layers: {serrated: [serrated_lesion_context, glow]}\nkeywords: {glow: [shining]}\ntrace_labels: [x]\nchains: {observe: [one, two]}\n")
    made = load(str(tmp_path / "r.yaml"))
    assert made.trace_labels == ("x",) and made.chains == (("observe", ("one", "two")),)
    assert [tuple(r) for r in evidence.criteria(spark, made).collect()] == [("serrated", "serrated_lesion_context"), ("serrated", "glow")]
    texts = spark.createDataFrame([(1, "A SHINING rim")], "k int, text string")
    assert [(r.criterion, r.status) for r in evidence.keyword_hits(texts, "k", keywords=dict(made.keywords)).collect()] == [("glow", "supporting")]


def test_a_runtime_file_brings_its_rules(spark, tmp_path):
    """A condition is SQL over the view and the settings' numbers; the first that holds decides, a null one does not hold."""
    (tmp_path / "r.yaml").write_text("layers: {serrated: [glow, serrated_lesion_context, dull]}\npale: 700\nrules: {glow: [['pale > {pale} AND s >= 2', supporting], ['pale > {pale}', uncertain], ['m >= 5', opposing]]}\n")
    made = load(str(tmp_path / "r.yaml"))
    rows = [(1, "s", 5.0, 3, 1, 701, 0), (2, None, 5.0, None, 1, 701, 0), (3, "non_serrated_mucosa", 5.0, 3, 1, 700, 0), (4, "s", 1.0, 3, 1, None, 0)]
    seen = spark.createDataFrame(rows, "k int, l string, m double, s int, risk int, pale int, tissue int")
    got = {(r.k, r.criterion): r.status for r in evidence.hits(seen, made).collect()}
    assert [got[k, "glow"] for k in (1, 2, 3, 4)] == ["supporting", "uncertain", "opposing", "not_assessed"]
    assert [got[k, "serrated_lesion_context"] for k in (1, 3)] == ["not_assessed", "opposing"] and {got[k, "dull"] for k in (1, 2, 3, 4)} == {"not_assessed"}
    for rules, word in (({"glow": [["pale > {glare}", "supporting"]]}, "glare"), ({"glow": [["pale > 1", "maybe"]]}, "maybe")):
        with pytest.raises(ValueError, match=word):
            evidence.hits(seen, adapted(made, {"rules": rules}))


def test_hints_of_all_sizes_move_once(spark):
    """Boxes from a point to a million wide, empty ones, and corners below zero: greatest overlap as by brute force, and one row a hint."""
    import random

    rnd = random.Random(4)
    box = lambda most: (x := rnd.randint(-most, 900), y := rnd.randint(-most, 900), x + rnd.randint(-1, most), y + rnd.randint(-1, most))
    ours = [box(300) for _ in range(30)]
    theirs = [box(most) for most in (1, 2, 31, 32, 33, 64, 65, 500, 1_000_000) for _ in range(8)] + [(x, y, x + n, y + n) for n in (32, 64, 128, 1 << 20) for x, y in ((0, 0), (-n, 64), (31, 1 - n))]
    cases = [(c, v) for v in theirs for c in ((1, 2) if v[0] < 500 else (1,))]
    found = spark.createDataFrame([(c, f"k{i:02d}", *v) for c in (1, 2, 3) for i, v in enumerate(ours)], "case_id int, cluster_id string, x1 int, y1 int, x2 int, y2 int")
    hints = spark.createDataFrame([(c, *v, 0.5) for c, v in cases] + [(3, 5, 5, 5, 9, 0.25)], "case_id int, hx1 int, hy1 int, hx2 int, hy2 int, score double")
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    common = lambda a, b: area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))
    part = lambda a, b: (common(a, b) * 20000 + (n := max(1, min(area(a), area(b))))) // (2 * n)
    want = {(c, f"k{i:02d}"): max((part(a, b) for k, b in cases if k == c), default=0) for c in (1, 2, 3) for i, a in enumerate(ours)}
    got = regions.with_hints(found, hints, tile=32).collect()
    assert {(r.case_id, r.cluster_id): r.hint_overlap for r in got} == want
    assert {(r.case_id, r.hint_score) for r in got} == {(1, 0.5), (2, 0.5), (3, 0.25)}
    assert regions._placed(hints, 32).count() == hints.count()


def test_a_hint_is_placed_once_in_a_plan(spark, small):
    """Spark's tests of join keys for nulls don't repeat the level of a hint: it is worked out for the case's levels, and for the join."""
    made = bindings.scored(spark, small).select("case_id", "l")._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("length(bin(") == 2


def test_boxes_meet_once(spark):
    import random

    rnd = random.Random(3)
    box = lambda: (x := rnd.randint(-40, 900), y := rnd.randint(-40, 900), x + rnd.randint(-5, 400), y + rnd.randint(-5, 400))
    ours, theirs = [box() for _ in range(40)], [box() for _ in range(40)]
    found = spark.createDataFrame([(1, f"k{i:02d}", *v) for i, v in enumerate(ours)], "case_id int, cluster_id string, x1 int, y1 int, x2 int, y2 int")
    hints = spark.createDataFrame([(1, *v, 0.5) for v in theirs], "case_id int, hx1 int, hy1 int, hx2 int, hy2 int, score double")
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    common = lambda a, b: area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))
    part = lambda a, b: (common(a, b) * 20000 + (n := max(1, min(area(a), area(b))))) // (2 * n)
    want = {f"k{i:02d}": max(part(a, b) for b in theirs) for i, a in enumerate(ours)}
    assert {r.cluster_id: r.hint_overlap for r in regions.with_hints(found, hints, tile=64).collect()} == want
    pix = spark.createDataFrame([(1, x, y) for x in range(0, 300, 7) for y in range(0, 300, 11)], "case_id int, px int, py int")
    steps = [(1, f"s{i}", rnd.randint(-20, 320), rnd.randint(-20, 320), rnd.choice((0, 1, 33, 64, 200))) for i in range(20)]
    got = raster.crop_window(pix, spark.createDataFrame(steps, "case_id int, step_id string, x int, y int, size int"), tile=32)
    near = {(s[1], x, y) for s in steps for x in range(0, 300, 7) for y in range(0, 300, 11) if -(s[4] // 2) <= x - s[2] < s[4] // 2 and -(s[4] // 2) <= y - s[3] < s[4] // 2}
    rows = [(r.step_id, r.px, r.py) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == near


@pytest.mark.parametrize("text,want", [
    ('{"k": 3, "z": null}', (3, None, 2)), ('{"z": 1}', (None, None, 1)), ('{"k": "3"}', (None, "k_not_long", 1)), ('{"k": null}', (None, None, 1)),
    ('{"k": 2.5}', (None, "k_not_long", 1)), ("[1]", (None, "no_record", None)), ("{", (None, "no_record", None)), (None, (None, "no_record", None))])
def test_open_records(spark, text, want):
    r = audit.open_records(spark.createDataFrame([(1, text)], "id int, t string"), "t", {"k": "long"}, "id").first()
    assert (r.k, r.violation, r.n_keys) == want


def test_files_of_cases_all_or_none(spark, tmp_path):
    import os

    from tessera.sources import files

    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"c{i}", f"{k}.png", bytes([i, k])) for i in range(9) for k in range(3)] + [("e", "x", None)], "case_id string, name string, body binary")
    files.write_cases(rows, out)
    there = {os.path.relpath(os.path.join(d, n), out) for d, _, names in os.walk(out) for n in names if not n.endswith(".crc")}
    named = rows.select(files.folder_of("case_id").alias("f"), "case_id", "name").collect()
    assert there == {f"{r.f}/{r.case_id}/{r.name}" for r in named}
    place = next(f"{r.f}/{r.case_id}/{r.name}" for r in named if (r.case_id, r.name) == ("c7", "2.png"))
    assert open(f"{out}/{place}", "rb").read() == bytes([7, 2])
    fresh = str(tmp_path / "fresh")
    with pytest.raises(Exception, match="no file name"):
        files.write_cases(rows.unionByName(spark.createDataFrame([("a/b", "x", None)], rows.schema)), fresh)
    assert not os.path.exists(fresh) or os.listdir(fresh) == []
    with pytest.raises(Exception):
        files.write_cases(rows, out, overwrite=False)
    assert {os.path.relpath(os.path.join(d, n), out) for d, _, names in os.walk(out) for n in names} == there


def test_files_of_a_task_that_outlives_its_job(tmp_path):
    """A job fails while a task is at work, or before it begins: what the task writes then does not stay."""
    import os

    import pyarrow as pa

    from tessera.sources import files

    out = str(tmp_path / "out")
    writer = files.CaseFiles({"path": out, "job": f"{out}/.job-1"}).writer(None, True)
    os.makedirs(writer.job)
    part = lambda case: pa.RecordBatch.from_pydict({"folder": ["0a"], "case_id": [case], "name": ["1.png"], "body": [b"x"]})

    def rows():
        yield part("a")
        assert os.listdir(writer.job)
        writer.abort([])
        yield part("b")

    for late in (rows(), iter([part("c")])):
        with pytest.raises(OSError):
            writer.write(late)
        assert os.listdir(out) == []


def test_command_line_run(spark, tmp_path):
    import os

    from tessera.__main__ import main

    cases, pix, hints, crop = tables(spark)
    for name, df in (("p", pix), ("h", hints), ("c", crop)):
        df.write.parquet(str(tmp_path / name))
    (tmp_path / "m.csv").write_text("slide_id,slide_filename,slide_path\na,a,/a.svs\nb,b,/b.svs\n")
    (tmp_path / "l.csv").write_text("slide_id,type,grade\na,SSL,low\nb,HP,low\n")
    root = str(tmp_path / "root")
    at = {k: str(tmp_path / k) for k in "phc"}
    main(["run-batch", "--manifest", str(tmp_path / "m.csv"), "--labels", str(tmp_path / "l.csv"), "--pixels", at["p"], "--hints", at["h"], "--crops", at["c"],
          "--thumb", "64", "64", "--full", "4000", "4000", "--output-root", root, "--store", str(tmp_path / "store")])
    told = [json.loads(r.value) for r in spark.read.text(f"{root}/crop_manifest").collect()]
    images = [c["image_path"] for t in told for c in t["crops"]]
    assert images and all(open(f"{root}/{i}", "rb").read(4) == b"\x89PNG" for i in images)
    assert {r.case_id: r.outcome for r in spark.read.json(f"{root}/batch_summary").collect()} == {"a": "completed", "b": "completed"}
    assert os.path.isdir(f"{root}/attempts") and spark.read.option("header", True).csv(f"{root}/case_predictions").count() == 2


def test_a_crop_reads_its_tiles_alone(spark, tmp_path):
    from tessera.sources import tiles

    path = str(tmp_path / "t")
    value = lambda k, y, x: (k, y, x, (x * 7 + y) % 256, x % 256, y % 256)
    rows = [value(k, y, x) for k in ("a", "b") for y in range(0, 96) for x in range(0, 80)]
    tiles.write_tiles(spark.createDataFrame(rows, tiles.SCHEMA), path, 32)
    all_of = tiles.read_tiles(spark, path, 32)
    assert sorted(tuple(r) for r in all_of.collect()) == sorted(rows) and all_of.rdd.getNumPartitions() == 6
    crop = tiles.read_tiles(spark, path, 32).filter("case_id = 'b' AND y >= 40 AND y < 60 AND x > 31 AND x <= 63")
    assert crop.rdd.getNumPartitions() == 1
    assert sorted(tuple(r) for r in crop.collect()) == [value("b", y, x) for y in range(40, 60) for x in range(32, 64)]
    reader = tiles.TileReader(path, 32)
    assert list(reader.pushFilters([tiles.EqualTo(("case_id",), "b"), tiles.GreaterThanOrEqual(("y",), 40), tiles.LessThan(("y",), 60), tiles.GreaterThan(("x",), 31), tiles.LessThanOrEqual(("x",), 63)]))
    assert [(p.case, p.ty, p.tx) for p in reader.partitions()] == [("b", 1, (1,))]
    assert tiles.read_tiles(spark, path, 32).filter("case_id = 'nobody'").count() == 0


def test_png_filters_of_other_writers():
    import struct
    import zlib

    import numpy as np

    from tessera.sources import io as files, tiles

    rnd = np.random.default_rng(2)
    a = rnd.integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (tiles.decode_png(files.encode_png(5, 7, a.tobytes())) == a).all()
    # the same rows with each of the five filters
    wide, lines = np.zeros((8, 6, 3), int), []
    wide[1:, 1:] = a
    for y in range(7):
        left, up, corner = wide[y + 1, :-1], wide[y, 1:], wide[y, :-1]
        p = left + up - corner
        d = [abs(p - v) for v in (left, up, corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        guess = [np.zeros_like(left), left, up, (left + up) // 2, paeth][y % 5]
        lines.append(bytes([y % 5]) + ((a[y] - guess) % 256).astype(np.uint8).tobytes())
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (tiles.decode_png(raw) == a).all()
    with pytest.raises(ValueError):
        tiles.decode_png(b"GIF89a")


def test_a_shuffled_stream_gives_the_batch_timeline(spark, tmp_path):
    import random

    from tessera.operators import timeline
    from tessera.streaming import log

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", log.ROCKSDB)
    events = [(f"c{c}", i, "START" if i == 0 else "END" if i == 9 else "OBSERVE", f"{c}/{i}") for c in range(5) for i in range(10)]
    late = [("c0", 10, "OBSERVE", "after the end"), ("c1", 3, "OBSERVE", "1/3"), (None, 1, "x", "x"), ("c2", None, "x", "x")]
    rnd = random.Random(1)
    rnd.shuffle(events)
    schema = "case_id string, seq long, state string, line string"
    source, sink, n = str(tmp_path / "in"), str(tmp_path / "out"), 0
    stream = log.in_order(spark.readStream.schema(schema).json(source + "/*")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).outputMode("append")
    for part in (events[:20], events[20:35], events[35:] + late):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{source}/{n}")
        n += 1
        q = stream.trigger(availableNow=True).start(sink)  # each time from the checkpoint
        q.awaitTermination(120)
        assert q.exception() is None
    rows = spark.read.parquet(sink)
    assert rows.count() == 50
    want = {r.case_id: r.timeline for r in timeline.timeline(spark.createDataFrame(events, schema), "case_id", ["seq"]).collect()}
    assert {r.case_id: r.timeline for r in timeline.timeline(rows, "case_id", ["seq"]).collect()} == want
    held = log.in_order(spark.createDataFrame([e for e in events if e[1] != 4], schema))
    assert {r.case_id: r.n for r in held.groupBy("case_id").agg(F.count("*").alias("n")).collect()} == {f"c{c}": 4 for c in range(5)}
