"""Closed forms, small fixtures and round trips."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from stressframe.__main__ import main
from stressframe.functions import encode
from stressframe.functions import tensor as T
from stressframe.operators import contact, doe, extremes, graph, joins, mesh, output, quantile, series, sphere
from stressframe.operators import joins as J
from stressframe.operators import parts as P
from stressframe.operators import results as R
from stressframe.operators.query import Query
from stressframe.operators.select import Parts, Quantities, States, Values
from stressframe.plans import templates
from stressframe.sources import binary, sinks, text
from stressframe.streaming import arrivals


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def lit(*v):
    return T.Tensor(*map(F.lit, map(float, v)))


def test_tensor_closed_forms(spark):
    h, u, s = T.hydrostatic(F.lit(5.0)), T.uniaxial(F.lit(-7.0)), T.pure_shear(F.lit(3.0))
    r = one(spark, h.von_mises(), h.pressure(), *h.principals(), u.von_mises(), u.signed_von_mises(), *u.principals(), s.von_mises(), *s.principals(), s.max_shear())
    assert list(r) == pytest.approx([0, -5, 5, 5, 5, 7, -7, 0, 0, -7, 3 * math.sqrt(3), 3, 0, -3, 3], abs=1e-9)
    t = lit(1, 2, 3, 4, 5, 6)
    want = sorted(np.linalg.eigvalsh([[1, 4, 6], [4, 2, 5], [6, 5, 3]]), reverse=True)
    assert list(one(spark, *t.principals())) == pytest.approx(want)
    assert one(spark, lit(0, 0, 0, 0, 0, 0).is_zero())[0] is True


def test_vectors(spark):
    a, b = T.Vector(*map(F.lit, (1.0, 0.0, 0.0))), T.Vector(*map(F.lit, (0.0, 2.0, 0.0)))
    zero = a - a
    assert list(one(spark, *a.cross(b), a.angle(b), b.length(), *b.normalized(), *a.lerp(b, 0.5))) == pytest.approx([0, 0, 2, 90, 2, 0, 1, 0, 0.5, 1, 0])
    assert list(one(spark, zero.angle(a), *zero.normalized())) == [None, 0, 0, 0]


def states(spark):
    rows = [(1, 1, 0, 0.0, 1.0), (2, 1, 0, 0.0, 5.0), (1, 1, 1, 0.1, 5.0), (3, 2, 1, 0.1, None), (3, 2, 0, 0.0, 2.0)]
    return spark.createDataFrame(rows, "element_id int, part_id int, state_idx int, time double, sxx double").withColumns({c: F.lit(0.0) for c in ("syy", "szz", "txy", "tyz", "tzx", "eps")})


def test_results_ties_nulls_and_single_values(spark):
    r = {x["part_id"]: x for x in R.statistics(states(spark), "sxx", ("part_id",)).collect()}
    assert (r[1]["max_element"], r[1]["max_state"]) == (2, 0) and r[2]["sd"] == 0.0 and r[2]["count"] == 1
    assert R.scalar(states(spark).limit(0), "sxx", "max").first()["value"] == 0.0
    h = {x["element_id"]: [s["value"] for s in x["series"]] for x in R.history(states(spark), "sxx").collect()}
    assert h[1] == [1.0, 5.0]


def test_query(spark):
    q = Query(states(spark)).parts(Parts.by_name("Part_1")).states(States.all()).quantities("vm", "x_stress").where(Values.compare("von_mises", ">", 2))
    assert {(r["element_id"], r["state_idx"]) for r in q.run().collect()} == {(2, 0), (1, 1)} and q.validate() == []
    assert Query(states(spark)).parts(Parts.by_id(99)).run().count() == 0
    assert {r["state_idx"] for r in Query(states(spark)).run().collect()} == {1}
    assert Values.extreme_n(states(spark), "sxx", 1).count() == 2 and Values.extreme_n(states(spark), "sxx", 0).count() == 0
    names = Quantities(["stress"]).remove("von_mises").names
    assert "von_mises" not in names and "x_stress" in names


def test_templates_and_jobs(spark):
    assert templates.search("*history") == ["element_history", "max_strain_history", "max_stress_history"]
    assert templates.TEMPLATES["critical_zones"].run(states(spark), limit=4.0).count() == 2
    out = templates.run_jobs({"element_states": states(spark)}, templates.load_jobs('[{"type": "von_mises", "parts": [1]}, {"type": "eff_plastic_strain", "parts": [1]}]'))
    assert list(out) == ["parts_1"] and {"von_mises_max", "effective_plastic_strain_max"} <= set(out["parts_1"].columns)
    with pytest.raises(ValueError):
        templates.load_jobs('[{"type": "other"}]')


def test_encodings_round_trip(spark):
    df = spark.createDataFrame([(1, i, v, int(v * 10)) for i, v in enumerate([3.0, -2.5, 400.25, 400.25])], "k int, i int, v double, q long")
    w = encode.series(["k"], ["i"])
    out = df.withColumns({"d": encode.delta(F.col("v"), w), "x": encode.xor_delta(F.col("q"), w)}).withColumns({"dv": encode.undelta(F.col("d"), w), "xv": encode.unxor(F.col("x"), w)})
    assert all(r["dv"] == r["v"] and r["xv"] == r["q"] for r in out.collect())
    rng = np.random.default_rng(42)
    values = spark.createDataFrame([(float(v),) for v in 10 ** rng.uniform(-2, 3, 500)], "v double").withColumns({"a": F.lit(0.01), "b": F.lit(1000.0)})
    back = values.select("v", encode.unlinear(encode.linear(F.col("v"), F.col("a"), F.col("b")), F.col("a"), F.col("b")).alias("l"), encode.unlogarithmic(encode.logarithmic(F.col("v"), 0.01, F.col("b")), 0.01, F.col("b")).alias("g")).collect()
    assert all(abs(r["l"] - r["v"]) <= 1000 / 65535 for r in back) and all(abs(r["g"] / r["v"] - 1) < 1e-3 for r in back)
    assert encode.bits_for(256) == 8 and encode.bits_for(257) == 9


def test_unit_hexahedron(spark):
    p = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    nodes = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "node_id int, x double, y double, z double")
    solids = spark.createDataFrame([("SOLID", 0, 1, 1, list(range(8)))], "etype string, elem_idx int, elem_id int, part_id int, node_ids array<int>")
    faces = mesh.face_geometry(mesh.with_corners(mesh.exterior_faces(solids), nodes)).collect()
    assert len(faces) == 6 and all(f["area"] == pytest.approx(1) for f in faces)
    assert all((f["nx"] * (f["cx"] - 0.5) + f["ny"] * (f["cy"] - 0.5) + f["nz"] * (f["cz"] - 0.5)) == pytest.approx(0.5) for f in faces)
    point = lambda v: F.struct(*(F.lit(float(c)).alias(n) for c, n in zip(v, "xyz")))
    q = mesh.element_quality(spark.range(1).select(F.lit(1).alias("part_id"), F.lit(1).alias("elem_id"), F.lit(0).alias("state_idx"), *(point(v).alias(f"p{i}") for i, v in enumerate(p)))).first()
    assert (q["aspect"], q["volume"], q["jacobian"], q["volume_ratio"]) == pytest.approx((1, 1, 1, 1))
    cut = mesh.section_clip(solids, nodes, (0.25, 0, 0), (1, 0, 0)).first()
    assert cut["corners"] == 4 and all(c["x"] == pytest.approx(0.25) for c in cut["polygon"])


def test_spectra(spark):
    rows = [(1, i / 1000, math.sin(2 * math.pi * 50 * i / 1000)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, t double, v double")
    assert series.dominant_frequency(df, "k", "t", "v").first()["frequency"] == pytest.approx(50, abs=1)
    srs = series.shock_spectrum(df, "k", "t", "v", 10, 200).toPandas()
    assert srs.loc[srs.response.idxmax(), "frequency"] == pytest.approx(50, rel=0.15)


def test_pulse_behavior_and_energy(spark):
    rows = [(1, t / 10, 0.0, 0.0, 0.0, 0.0, 0.0, -3.0 if t < 3 else 2.5, 9.0 if t < 3 else 6.0, t == 3) for t in range(8)] + [(2, t / 10, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0, 1.0, False) for t in range(4)]
    rows += [(3, t / 10, 0.0, 0.0, -0.1 * t, 0.0, 0.0, -3.0 if t < 3 else 0.001, 9.0 if t < 3 else 0.5, t == 3) for t in range(8)]
    rows += [(4, t / 10, 0.0, 0.0, 0.0, 0.0 if t < 3 else 2.0, 0.0, -3.0 if t < 3 else 0.1, 9.0 if t < 3 else 4.0, t == 3) for t in range(8)]
    rows += [(5, t / 10, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False) for t in range(3)]
    df = spark.createDataFrame(rows, "run_id int, t double, pos_x double, pos_y double, pos_z double, vel_x double, vel_y double, vel_z double, ke double, contact_engaged boolean")
    got = {r["run_id"]: r for r in contact.restitution(contact.behavior(contact.trajectory_summary(df))).collect()}
    assert [got[k]["behavior"] for k in range(1, 6)] == ["bounce", "no-contact", "embed", "slide", "unknown"]
    assert got[1]["restitution"] == pytest.approx(math.sqrt(6 / 9)) and got[3]["depth"] == pytest.approx(0.4)
    audit = series.energy_audit(spark.createDataFrame([(1, 0.0, 1.0, 0.0, 0.0, 0.0, 10.0), (1, 1.0, 1.0, 0.0, 1.5, 0.0, 10.7)], "run_id int, t double, ke double, ie double, hourglass double, sliding double, total double")).first()
    assert (audit["drift_level"], audit["hourglass_level"], audit["sliding_level"], audit["verdict"]) == ("fail", None, "pass", "fail")


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 0.25), ("x", "y", 1.0)], "src string, dst string, impulse double")
    source = spark.createDataFrame([("a",)], "id string")
    assert {r["id"]: r["depth"] for r in graph.depths(edges, source).collect()} == {"a": 0, "b": 1, "c": 1}
    assert {r["id"]: round(r["cost"], 6) for r in graph.cheapest_paths(edges, source).collect()} == {"a": 0.0, "b": 1.0, "c": 2.0}


def test_long_chains_of_a_graph(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 1.0) for i in range(120)], "src string, dst string, impulse double")
    source = spark.createDataFrame([("n000",)], "id string")
    assert {r["id"]: r["depth"] for r in graph.depths(edges, source).collect()} == {f"n{i:03d}": i for i in range(121)}


def test_the_larger_side_of_a_contact_counts(spark):
    rows = [(1, 172, side, t / 10, f * (0.2 if side == 0 else 36251.0), 0.0, 0.0) for side in (0, 1) for t, f in enumerate((0.0, 0.5, 1.0, 0.5, 0.0))]
    rows += [(1, 7, side, t / 10, f * (10.0 if side == 0 else -9.0), 0.0, 0.0) for side in (0, 1) for t, f in enumerate((0.0, 1.0, 0.0))]
    got = {r["interface_id"]: r for r in contact.contact_metrics(spark.createDataFrame(rows, "run_id int, interface_id int, side int, t double, fx double, fy double, fz double")).collect()}
    assert got[172]["side_used"] == 1 and got[172]["peak_force"] == 36251 and got[172]["one_sided"] and got[172]["balance"] is None
    assert got[7]["side_used"] == 0 and got[7]["balance"] == pytest.approx(0.1) and not got[7]["one_sided"] and got[7]["impulse"] == pytest.approx(1.0)


def test_exact_percentiles_by_histograms(spark, monkeypatch):
    monkeypatch.setattr(quantile, "FEW", 5)
    monkeypatch.setattr(quantile, "BINS", 7)
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=500), np.repeat([1.0, 2.0, 2.0, 7.5], 60), np.array([3.0]), np.concatenate([rng.normal(size=100) * 1e-9, [1e12]])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
        assert quantile.order_statistics(df, "v", shares) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12, abs=1e-18)
    assert quantile.order_statistics(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_by_growing_cells(spark, k):
    """Clusters, points far out, points at one place, groups of one point."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(80, 2)), rng.normal(size=(30, 2)) * 0.01 + 5, [[400.0, -300.0]], np.zeros((12, 2))])
    rows = [(i, 0 if i < 110 else i % 2, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, 7, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, g int, x double, y double")
    near = joins.k_nearest(df, df.select("g", F.col("id").alias("__b"), F.col("x").alias("__x"), F.col("y").alias("__y")), "id", ["g"], k)
    got = {}
    for r in near.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["__b"])
    for i, g, a, b in rows:
        want = sorted((math.hypot(a - c, b - e), j) for j, h, c, e in rows if h == g)[:k]
        assert got[i] == [j for _, j in want]


def test_deck_files_begin_with_their_card(spark, tmp_path):
    nodes = spark.range(500).select(F.col("id").cast("int").alias("node_id"), *(F.rand(1).alias(c) for c in "xyz"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        sinks.write_deck(sinks.keyword_nodes(nodes), "*NODE", str(tmp_path / "deck"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f.read_text().splitlines() for f in (tmp_path / "deck").glob("part-*")]
    assert len(files) > 1 and all(f[:2] == ["*KEYWORD", "*NODE"] for f in files) and sum(len(f) - 2 for f in files) == 500


def test_job_list_from_the_command_line(spark, tmp_path, capsys):
    rows = [(1, 10 * i, k, k * 0.1, float(i + k)) for i in range(5) for k in range(3)]
    states = spark.createDataFrame(rows, "part_id int, element_id int, state_idx int, time double, eps double")
    states.write.parquet(str(tmp_path / "in" / "element_states.parquet"))
    (tmp_path / "jobs.json").write_text(json.dumps([{"type": "eff_plastic_strain"}]))
    main([str(tmp_path / "in"), str(tmp_path / "jobs.json"), str(tmp_path / "out"), "--set", "digits=3"])
    got = spark.read.parquet(str(tmp_path / "out" / "parts_all")).orderBy("state_idx").collect()
    assert [r["effective_plastic_strain_max"] for r in got] == [4.0, 5.0, 6.0] and "parts_all" in capsys.readouterr().out


def test_templates_of_a_folder(tmp_path):
    saved = templates.Template("critical_zones", templates.TEMPLATES["critical_zones"].answer, "stress", {"limit": 90.0})
    (tmp_path / "hot.json").write_text(templates.save(saved))
    assert templates.load_folder(str(tmp_path)) == ["hot"] and templates.TEMPLATES["hot"].parameters == {"quantity": "von_mises", "limit": 90.0}
    del templates.TEMPLATES["hot"]


def test_output_specification_checks_and_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0, 0.0, 1.23456789, 2.0)], "element_id int, part_id int, state_idx int, time double, s double, d double")
    spec = output.OutputSpec(metadata={"by": "test"}).with_fields("s").with_unit("s", "MPa", "Pa").as_form("json")
    assert spec.validate(df.columns) == [] and len(output.OutputSpec().with_fields("q").with_unit("s", "MPa", "?").as_form("xml").validate(df.columns)) == 3
    spec.write(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["s"] == pytest.approx(1234567.89) and spark.read.json(str(tmp_path / "out.metadata")).first()["value"] == "test"


def test_hull_components_and_clusters(spark):
    few = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 1.0)], "face int, x double, y double")
    assert doe.convex_hull(few, "face").count() == 0
    pts = spark.createDataFrame([(1, float(x), float(y)) for x in range(3) for y in range(3)], "face int, x double, y double")
    assert {(r["x"], r["y"]) for r in doe.convex_hull(pts, "face").collect()} == {(0, 0), (2, 0), (2, 2), (0, 2)}
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ np.diag([5, 1, 0.1])
    modes, shares = doe.principal_components(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"), ["a", "b", "c"])
    y = x / np.abs(x).max(0)
    values = np.linalg.eigvalsh(np.cov(y.T, bias=True))[::-1]
    assert np.allclose(shares, values / values.sum()) and all(m[np.abs(m).argmax()] > 0 for m in modes)
    assert doe.correlation_clusters([("a", "b", 0.9), ("b", "c", 0.8), ("d", "e", 0.75), ("a", "d", 0.1)]) == [{"a", "b", "c"}, {"d", "e"}]


def _vector(roll, pitch):
    r, p = math.radians(roll), math.radians(pitch)
    return math.cos(r) * math.cos(p), math.cos(r) * math.sin(p), math.sin(r)


def test_even_directions(spark):
    """Latitudes and golden angles by hand; an even grid covers the sphere, a cluster does not."""
    grid = sphere.even_grid(spark, 200)
    rows = {r["i"]: (r["roll"], r["pitch"]) for r in grid.collect()}
    ga = math.pi * (3 - math.sqrt(5))
    for i in (0, 1, 2, 57, 199):
        assert rows[i] == pytest.approx((math.degrees(math.asin(1 - (2 * i + 1) / 200)), math.degrees(math.atan2(math.sin(ga * i), math.cos(ga * i)))), abs=1e-5)
    r = sphere.coverage(grid).first()
    assert 5 < r["mean_nearest"] < 20 and r["coverage"] == 1.0
    assert sphere.coverage(spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 179.0)], "i int, roll double, pitch double")).first()["coverage"] == pytest.approx((math.degrees(math.sqrt(2 * math.pi)) / 179) ** 2)


def test_nearest_directions_match_brute_force(spark):
    """A dense cluster, poles, repeated directions and lone ones; no pair of tables is multiplied."""
    rng = random.Random(6)
    samples = [(i, rng.gauss(80, 1), rng.gauss(0, 5)) for i in range(150)] + [(200 + i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(60)] + [(300, 90.0, 0.0), (301, -90.0, 77.0)] + [(400 + i, 10.0, 20.0) for i in range(6)]
    targets = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(60)] + [(100, 10.0, 20.0), (101, 89.9, -180.0)]
    s = spark.createDataFrame([(*x, float(x[0])) for x in samples] + [(999, None, 0.0, 1.0)], "j int, roll double, pitch double, v double")
    t = spark.createDataFrame([*targets, (998, None, 1.0)], "i int, roll double, pitch double")
    got = {}
    for r in sphere.nearest(t, "i", s, "j", 4, ["v"]).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["other"], r["angle"], r["v"]))
    assert set(got) == {i for i, *_ in targets}
    for i, roll, pitch in targets:
        a = _vector(roll, pitch)
        want = sorted((round(math.degrees(math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(a, _vector(p, q), strict=True)))))), 6), j) for j, p, q in samples)[:4]
        have = sorted(got[i])
        assert [round(h[2], 5) for h in have] == pytest.approx([w[0] for w in want], abs=2e-5) and all(h[3] == h[1] for h in have)
    assert sphere.nearest(t, "i", s.limit(0), "j", 4).count() == 0
    found = {r["i"]: r for r in sphere.interpolate(t, "i", s, "j", "v").collect()}
    assert (found[100]["source"], found[100]["v"], found[100]["offset"]) == ("exact", 400.0, 0.0)


def test_segment_parents(spark):
    solids = spark.createDataFrame([(0, list(range(8))), (1, [4, 5, 6, 7, 8, 9, 10, 11])], "elem_idx int, node_ids array<int>")
    segments = spark.createDataFrame([(1, [4, 5, 6, 7]), (2, [8, 9, 10]), (3, [0, 8])], "segment_id int, node_ids array<int>")
    assert {r["segment_id"]: r["elem_idx"] for r in P.segment_parents(segments, solids).collect()} == {1: 0, 2: 1}


def test_binary_family(spark, tmp_path):
    """Five nodes, four beams in two parts, two states in two files; the second word is a decoy."""
    for order, size in (("<", 4), (">", 8)):
        base = tmp_path / f"res{size}"
        cells = {"BEAM": np.array([[i, i + 1, 0, 0, 0, 1 if i < 3 else 2] for i in range(1, 5)])}
        raw = binary.pack_mesh("beams", {"iu": 1, "nglbv": 6, "nv1d": 2}, np.array([[i, 0.0, 0.0] for i in range(5)]), cells, order, size)
        rows = [np.concatenate([[0.001 * s], np.zeros(6), np.zeros(15), *[[a * (1 + s), 9999] for a in (100, -250, 40, 60)]]) for s in range(2)]
        base.write_bytes(raw + binary.pack_states(rows[:1], order, size))
        (tmp_path / f"res{size}01").write_bytes(binary.pack_states(rows[1:], order, size))
        (tmp_path / f"res{size}03").write_bytes(b"beyond the gap")
        at = binary.layout(spark, str(base))
        assert (at.order, at.size, at.title, at.n["nel2"]) == (order, size, "beams", 4)
        assert binary.nodes(spark, str(base)).count() == 5
        parts = {r["elem_idx"]: (r["part_id"], list(r["node_ids"])) for r in binary.elements(spark, str(base)).collect()}
        assert parts[0] == (1, [0, 1]) and parts[3] == (2, [3, 4])
        got = binary.element_states(spark, str(base), "BEAM").orderBy("part", "elem_idx").collect()
        assert [r["words"][0] for r in got] == [100, -250, 40, 60, 200, -500, 80, 120]
        beams = binary.element_states(spark, str(base), "BEAM").join(binary.elements(spark, str(base)), "elem_idx").select("part_id", F.col("elem_id").alias("element_id"), F.col("part").alias("state_idx"), "words")
        first = {r["part_id"]: r for r in P.beam_resultants(beams, ("axial",)).where("state_idx = 0").collect()}
        assert (first[1]["max"], first[1]["max_element"], first[1]["min"], first[1]["min_element"]) == (100, 1, -250, 2) and (first[2]["max"], first[2]["min"]) == (60, 40)
    with pytest.raises(ValueError):
        binary.detect(struct.pack("<64i", *range(64)))


DECK = """$ comment
*KEYWORD
*NODE
       1             0.0             1.0          -2.5
       2,1.5D+01,2.0,3.0
*ELEMENT_SOLID
       7       3       1       2       3       4       5       6       7       8
*PART
first part
         3         1         5
*MAT_ELASTIC
         5   7.8E-9  2.1E+5       0.3     235.0
*SET_NODE_LIST_TITLE
a title
         1
         1         2         3         4         5         6         7         8
         9
*set_node_list_generate
        10
         1         3        11        12
*SET_SEGMENT
        20
         1         2         3         4
         5         6         7
*SET_PART_COLUMN
        30
         4       0.0
         6       0.0
*SET_NODE_ADD
        77
         1        10
*SET_NODE_GENERAL
        40
NODE,1,2
BOX,3
*END
*SET_NODE_LIST
        99
         1
"""


def test_keyword_deck(spark, tmp_path):
    (tmp_path / "deck.k").write_text(DECK)
    path = str(tmp_path / "deck.k")
    assert {r["node_id"]: (r["x"], r["y"], r["z"]) for r in text.keyword_nodes(spark, path).collect()} == {1: (0.0, 1.0, -2.5), 2: (15.0, 2.0, 3.0)}
    e = text.keyword_elements(spark, path).first()
    assert (e["etype"], e["elem_id"], e["part_id"], list(e["node_ids"])) == ("SOLID", 7, 3, list(range(1, 9)))
    sets = {r["set_id"]: r for r in text.keyword_sets(spark, path).collect()}
    assert set(sets) == {1, 10, 20, 30, 40, 77}
    assert list(sets[1]["ids"]) == list(range(1, 10)) and list(sets[10]["ids"]) == [1, 2, 3, 11, 12] and list(sets[30]["ids"]) == [4, 6] and list(sets[40]["ids"]) == [1, 2]
    assert [list(s) for s in sets[20]["segments"]] == [[1, 2, 3, 4], [5, 6, 7]] and sets[77]["warning"] and sets[40]["warning"] and not sets[1]["warning"]
    p = text.keyword_parts(spark, path).first()
    assert (p["part_id"], p["name"], p["material_id"]) == (3, "first part", 5)
    m = text.keyword_materials(spark, path).first()
    assert (m["material_id"], m["density"], m["yield_stress"]) == (5, 7.8e-9, 235.0)


def test_logs_and_series(spark, tmp_path):
    (tmp_path / "log").write_text(" time...........................   0.00000E+00\n kinetic energy.................   1.00000E+01\n total energy...................   1.0+1\n time...........................   1.00000E-03\n kinetic energy.................   8.0\n N o r m a l    t e r m i n a t i o n\n")
    rows = sorted((r["t"], r["ke"], r["total"]) for r in text.energy_log(spark, str(tmp_path / "log")).collect())
    assert rows == [(0.0, 10.0, 10.0), (0.001, 8.0, None)]
    assert text.terminations(spark, str(tmp_path / "log")).first()["status"] == "normal"
    (tmp_path / "s.csv").write_text("Time,Max_vm,Min_vm,Avg_vm,Max_Element_ID\n0.0,1.5,0.5,1.0,7\n")
    r = text.series_csv(spark, str(tmp_path / "s.csv")).first()
    assert (r["time"], r["max"], r["min"], r["avg"], r["max_element"]) == (0.0, 1.5, 0.5, 1.0, 7)


def test_sinks_and_stream(spark, tmp_path):
    df = states(spark)
    sinks.write_query_csv(df.withColumnRenamed("sxx", "x_stress"), ["x_stress"], str(tmp_path / "csv"))
    lines = [x for f in (tmp_path / "csv").glob("*.csv") for x in f.read_text().splitlines()]
    assert "element_id,part_id,state,time,x_stress" in lines and "1,1,0,0.000000,1.000000" in lines and "3,2,1,0.100000," in lines
    sinks.write_parquet(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).where("state_idx = 1").count() == 2
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    q = arrivals.each_batch(arrivals.states(spark, str(tmp_path / "in"), df.schema), lambda b, i: got.append(b.count()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sum(got) == df.count()


def test_matrix_query_has_all_revisions(spark, sf):
    from stressframe.plans import registry, tables

    got = {(r["category"], r["rev"]): r["worst"] for r in registry.QUERIES["category_matrix_long"](spark, sf).collect()}
    want = {(r["category"], r["rev"]): r["w"] for r in tables.cells(spark, sf).groupBy("category", "rev").agg(F.max("g").alias("w")).collect()}
    assert got == pytest.approx(want, abs=1e-3) and max(rev for _, rev in got) > 2


def test_graphs_deeper_than_fifty_are_whole(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(53)], "src int, dst int, impulse double")
    source = spark.createDataFrame([(0,)], "id int")
    assert {r["id"]: r["depth"] for r in graph.depths(edges, source).collect()} == {i: i for i in range(54)}
    assert {r["id"]: round(r["cost"], 6) for r in graph.cheapest_paths(edges, source).collect()} == {i: float(i) for i in range(54)}
    with pytest.raises(RuntimeError):
        graph.cheapest_paths(edges, source, 5)


def test_extremes_of_all_kinds_of_doubles(spark):
    """Keys order as the bits of doubles do, subnormal and infinite ones too; ties go to the least id, and NULL is no extreme."""
    rng = random.Random(1)
    special = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, math.nan]
    powers = [f(math.ldexp(1, e)) for e in range(-1000, 1023, 7) for f in (float, lambda v: math.nextafter(v, 0), lambda v: math.nextafter(v, math.inf))]
    values = special + powers + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]

    def bits(v):
        if v != v:
            return (2047 << 52) + 1
        b = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        return -b if v < 0 else b

    rows = extremes.with_order_keys(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), ["v"]).collect()
    assert all(r["__k_v"] == (None if r["v"] is None else bits(r["v"])) for r in rows)
    groups = {g: [(rng.choice([-2.5, 3.25, 3.25, 7.0, -math.inf, None]), i) for i in rng.sample(range(1000), 6)] for g in range(200)}
    df = spark.createDataFrame([(g, v, i) for g, rows in groups.items() for v, i in rows], "g int, v double, i long")
    got = extremes.with_extremes(df, ["v"], F.col("i")).groupBy("g").agg(extremes.at_largest("i", "v").alias("a"), extremes.at_least("i", "v").alias("b")).collect()
    for r in got:
        own = [(v, i) for v, i in groups[r["g"]] if v is not None]
        assert (r["a"], r["b"]) == ((min((-v, i) for v, i in own)[1], min(own)[1]) if own else (None, None))
    with pytest.raises(Exception, match="out of the range"):
        extremes.with_extremes(df.limit(1), ["v"], F.lit(-1).cast("long")).collect()


def test_energy_audit_by_hand(spark):
    """Shares have bases of their own: first total, largest internal and first kinetic energy; gates where these are nothing."""
    rows = [(1, 0.0, 100.0, 0.0, 0.0, 0.0, 100.0), (1, 1.0, 40.0, 50.0, 6.0, -7.0, 97.5), (1, 2.0, 30.0, 40.0, 2.0, 1.0, math.nan)]
    rows += [(2, 0.0, 100.0, 0.01, 0.005, 0.0, 0.0), (2, 1.0, 99.8, 0.02, 0.01, 0.0, 5.0), (3, 0.0, 0.0, 0.0, None, None, 0.0)]
    got = {r["run_id"]: r for r in series.energy_audit(spark.createDataFrame(rows, "run_id int, t double, ke double, ie double, hourglass double, sliding double, total double")).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one["dissipated_pct"], one["drift_pct"], one["hourglass_pct"], one["sliding_pct"]) == (70.0, 2.5, 12.0, 7.0)
    assert (one["drift_level"], one["hourglass_level"], one["sliding_level"], one["verdict"], one["impact_visible"]) == ("warn", "warn", "warn", "warn", True)
    assert (two["impact_visible"], two["dissipated_pct"], two["internal_significant"], two["hourglass_pct"], two["hourglass_level"], two["drift_pct"], two["verdict"]) == (False, None, False, 50.0, None, None, "pass")
    assert (three["verdict"], three["sliding_pct"], three["hourglass_pct"]) == ("unknown", None, None)


def test_pulses_by_hand(spark):
    """Density over all samples, and the time to the deepest place while engaged."""
    rows = [(1, t, z, e) for t, z, e in ((0.0, 9.0, False), (1.0, 5.0, True), (2.0, 3.0, True), (3.0, 1.0, False), (4.0, 4.0, True), (5.0, 9.0, False), (6.0, 9.0, False), (7.0, 9.0, False))] + [(2, 0.0, 1.0, False), (3, 0.0, 1.0, True)]
    df = spark.createDataFrame(rows, "run int, t double, z double, engaged boolean")
    got = {r["run"]: r for r in series.pulses(df, "run", "t", "z").collect()}
    assert set(got) == {1, 3} and (got[1]["duration"], got[1]["density"], got[1]["to_peak"], got[1]["contact_steps"]) == (3.0, 0.375, 1.0, 3)
    named = spark.createDataFrame([(3, "no-contact"), (2, "bounce")], "run int, behavior string")
    got = {r["run"]: r for r in series.pulses(df, "run", "t", "z", named).collect()}
    assert set(got) == {1, 2} and (got[2]["duration"], got[2]["density"], got[2]["to_peak"]) == (None, 0.0, None)


def test_recovery_by_hand(spark):
    """The worst position by the sum of peaks; the first sample at or under 5 % of the peak; damping by the sign changes' frequency."""
    a = [0, 1, 100, -20, 60, -10, 4, 30, 1, 0]
    rows = [(1, 7, float(t), float(v)) for t, v in enumerate(a)] + [(1, 8, float(t), 1.0) for t in range(4)] + [(2, 7, float(t), 50.0) for t in range(10)]
    got = {r["part_id"]: r for r in series.recovery(spark.createDataFrame(rows, "pos_id int, part_id int, t double, acc double")).collect()}
    mean = sum(a[2:]) / 8
    signs = [math.copysign(1, v - mean) for v in a[2:]]
    turns = sum(x != y for x, y in zip(signs, signs[1:], strict=False))
    assert set(got) == {7, 8} and got[7]["recovery"] == 1.0 and got[7]["sign_changes"] == turns and not got[8]["has_data"] and got[8]["recovery"] is None
    assert got[7]["damping"] == pytest.approx(min(1.0, math.log(20) / (2 * math.pi * 0.5 * turns / 7 * 1.0)))
    known = spark.createDataFrame([(7, 2.0)], "part_id int, frequency double")
    assert {r["part_id"]: r["damping"] for r in series.recovery(spark.createDataFrame(rows, "pos_id int, part_id int, t double, acc double"), known).collect()}[7] == pytest.approx(math.log(20) / (4 * math.pi))


def test_names_of_directions(spark):
    names = spark.createDataFrame([("F1_Back",), ("E3_edge",), ("C2",), ("P0001",), ("f1",), ("",), (None,)], "n string")
    assert [r["k"] for r in names.select(doe.angle_category(F.col("n")).alias("k")).collect()] == ["face", "edge", "corner", "fibonacci", "unknown", "unknown", "unknown"]


def test_wave_speed_gates(spark):
    """A speed by hand; no contact, a peak before it and a speed beyond the limit are no samples."""
    peaks = spark.createDataFrame([(1, 5, 0.002, 3.0, 4.0, 0.0), (2, 5, 0.002, 0.0, 0.0, 0.0), (3, 5, 0.0005, 3.0, 4.0, 0.0), (4, 5, 0.001000001, 3.0, 400.0, 0.0)], "pos_id int, part_id int, t_peak double, x double, y double, z double")
    runs = spark.createDataFrame([(1, 0.001, 0.0, "bounce"), (2, 0.001, 0.0, "no-contact"), (3, 0.001, 0.0, "bounce"), (4, 0.001, 0.0, "slide")], "pos_id int, t_contact double, z double, behavior string")
    places = spark.createDataFrame([(i, 0.0, 0.0) for i in range(1, 5)], "pos_id int, x double, y double")
    r = doe.wave_speed(peaks, runs, places).first()
    assert (r["samples"], r["mean"], r["mean_delay"]) == (1, pytest.approx(5.0), pytest.approx(0.001))


def test_quality_of_tetrahedra_and_shells(spark):
    point = lambda v: F.struct(*(F.lit(float(c)).alias(n) for c, n in zip(v, "xyz")))
    tet = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    for nodes, volume in (([0, 1, 2, 3, 3, 3, 3, 3], 1 / 6), ([1, 0, 2, 3, 3, 3, 3, 3], -1 / 6)):
        q = mesh.element_quality(spark.range(1).select(F.lit(1).alias("part_id"), F.lit(1).alias("elem_id"), F.lit(0).alias("state_idx"), F.array(*map(F.lit, nodes)).alias("node_ids"), *(point(tet[k]).alias(f"p{i}") for i, k in enumerate(nodes))))
        r = q.first()
        assert r["volume"] == pytest.approx(volume) and r["jacobian"] is None and r["volume_ratio"] is None and r["inverted"] == (volume < 0)
        assert mesh.part_quality(q).first()["n_negative_jacobian"] == (volume < 0)
    quads = {"square": [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], "bent": [(0, 0, 0), (1, 0, 0), (1, 1, 1), (0, 1, 0)], "triangle": [(0, 0, 0), (3, 0, 0), (0, 4, 0), (0, 4, 0)], "flat": [(0, 0, 0), (0, 0, 0), (1, 1, 0), (0, 1, 0)]}
    rows = None
    for name, p in quads.items():
        ids = [0, 1, 2, 2] if name == "triangle" else [0, 1, 2, 3]
        for state, size in ((0, 1.0), (1, 2.0)):
            one = spark.range(1).select(F.lit(name).alias("part_id"), F.lit(name).alias("elem_id"), F.lit(state).alias("state_idx"), F.array(*map(F.lit, ids)).alias("node_ids"), *(point([c * size for c in v]).alias(f"p{i}") for i, v in enumerate(p)))
            rows = one if rows is None else rows.union(one)
    got = {(r["elem_id"], r["state_idx"]): r for r in mesh.quad_quality(rows).collect()}
    assert (got["square", 1]["aspect"], got["square", 1]["skewness"], got["square", 1]["warpage"], got["square", 1]["area_ratio"]) == pytest.approx((1, 0, 0, 4), abs=1e-9)
    assert got["bent", 0]["warpage"] == pytest.approx(60.0) and got["bent", 0]["skewness"] == pytest.approx(1 / 3)
    assert (got["triangle", 0]["aspect"], got["triangle", 0]["skewness"], got["triangle", 0]["area"]) == (pytest.approx(5 / 3), None, pytest.approx(6))
    assert got["flat", 0]["aspect"] is None and got["flat", 0]["area_ratio"] is None


def test_percentiles_with_values_of_all_sizes(spark, monkeypatch):
    """Infinite values, and values over all powers of two, end in a few rounds."""
    monkeypatch.setattr(quantile, "FEW", 50)
    rng = random.Random(5)
    values = [math.inf] * 3 + [-math.inf] * 2 + [rng.choice([-1, 1]) * 2.0 ** rng.randint(-900, 900) for _ in range(3000)] + [1.5] * 500 + [math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    own = sorted(v for v in values if v is not None and v == v)
    for share in (0.0, 0.0001, 0.25, 0.5, 0.61, 0.999, 1.0):
        place = share * (len(own) - 1)
        a, b = own[math.floor(place)], own[math.ceil(place)]
        want = a if a == b else a + (b - a) * (place - math.floor(place))
        assert quantile.order_statistics(df, "v", [share])[0] == pytest.approx(want)


def test_drop_zones_and_recommendations_by_hand(spark):
    rows = [("F", i, p, float(g), float(st), float(x)) for i, p, g, st, x in ((1, 1, 10, 10, 1), (1, 2, 20, 10, 1), (2, 1, 60, 10, 1), (2, 2, 10, 50, 9), (3, 1, 10, 10, 1), (4, 1, 10, 10, 1))] + [("F", 3, 9, 1e9, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "face string, pos_id int, part_id int, peak_g double, peak_stress double, peak_disp double")
    kinds = spark.createDataFrame([(4, "no-contact"), (2, "bounce")], "pos_id int, behavior string")
    got = {r["pos_id"]: r for r in doe.drop_zones(df, kinds, 9).collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "safe", 2: "at-risk", 3: "safe", 4: "no-contact"}
    assert (got[2]["worst_metric"], got[2]["worst_value"], got[2]["worst_part"]) == ("peak_disp", 9.0, 2)  # nine times the quartile, against 3 and 5
    places = spark.createDataFrame([(1, -1.0), (2, 1.0), (3, -2.0), (4, 0.0)], "pos_id int, x double")
    quality = spark.createDataFrame([(False, "fail"), (True, "pass"), (True, "fail")], "impact_visible boolean, verdict string")
    runs = spark.createDataFrame([(0.8, "bounce"), (1.0, "no-contact"), (0.7, None)], "ke_retention double, behavior string")
    yields = spark.createDataFrame([(1, 100.0), (2, 60.0)], "part_id int, yield_stress double")
    found = {r["rule"]: (r["severity"], r["metric"], r["subject"]) for r in doe.recommendations(df.where("part_id < 9"), places, quality, runs, yields).collect()}
    assert found == {
        "runs without contact": ("critical", 1.0, None), "energy balance fails": ("critical", 2.0, None), "largest response": ("critical", 60.0, "2/1"), "asymmetry along x": ("critical", round(22.5 / 23.75 * 100, 1), None),
        "energy absorption": ("warning", 25.0, "low"), "share of the yield": ("warning", 0.83, "2"),
    }
    assert {r["rule"] for r in doe.recommendations(df.limit(0), places).collect()} == set()


@pytest.mark.parametrize("few", [20_000, 3])
def test_percentiles_of_groups(spark, few):
    """All groups together by rounds: a large one, ties, single values, infinite and missing ones, a null group."""
    rng = random.Random(9)
    groups = {"a": [rng.gauss(0, 1e3) for _ in range(900)], "b": [5.0] * 60 + [7.0] * 61, "c": [1.25], "d": [math.inf, -math.inf, 0.0, -0.0, 1e-300], None: [rng.random() for _ in range(40)], "e": [None, math.nan]}
    df = spark.createDataFrame([(g, v, 1) for g, vs in groups.items() for v in vs], "g string, v double, n int").repartition(3)
    shares = [0.95, 0.5, 0.25, 0.0, 1.0, None]
    got = {r["g"]: r for r in quantile.group_order_statistics(df, ["g"], "v", shares, few).collect()}
    assert set(got) == set(groups) - {"e"}
    for g, r in got.items():
        own = sorted(groups[g])
        assert r["n"] == len(own)
        for j, share in enumerate(shares):
            place = len(own) // 2 if share is None else share * (len(own) - 1)
            a, b = own[math.floor(place)], own[math.ceil(place)]
            assert r[f"q{j}"] == pytest.approx(a if a == b else a + (b - a) * (place - math.floor(place)))


@pytest.mark.parametrize("by", [(), ("face",)])
def test_leave_one_out_sums_places_first(spark, monkeypatch, by):
    """As pair by pair, in blocks of a few places: places shared by many points, repeated keys, values that are missing or infinite, places that are not known."""
    monkeypatch.setattr(doe, "BLOCK", 3)
    rng = random.Random(5)
    rows = [(k, k % 3, float(rng.randint(0, 4)), float(rng.randint(0, 3)), round(rng.uniform(-1000, 1000), 2)) for k in range(90)]
    rows += [(7, 1, 2.0, 9.0, 5.0), (200, 0, None, 1.0, 4.0), (201, 0, None, 1.0, None), (202, 1, 30.0, 30.0, float("inf")), (203, 1, 30.0, 30.0, 8.0), (None, 1, 1.0, 1.0, 3.0), (204, 5, 1.0, 1.0, 2.0)]
    points = spark.createDataFrame(rows, "point_id int, face int, x double, y double, value double")
    want = {}
    for a in rows:
        for b in rows:
            if a[0] is not None and b[0] is not None and a[0] != b[0] and (not by or a[1] == b[1]):
                d2 = 1e-18 if None in (a[2], b[2]) else max((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, 1e-18)
                own = want.setdefault((*((a[1],) if by else ()), a[0], a[4]), [None, 0.0])
                own[0] = own[0] if b[4] is None else (own[0] or 0.0) + b[4] / d2
                own[1] += 1 / d2
    got = {tuple(r)[:-1]: r["estimate"] for r in doe.leave_one_out(points, "point_id", "value", by=by).collect()}
    assert got.keys() == want.keys()
    for k, (above, below) in want.items():
        assert got[k] == (None if above is None else pytest.approx(above / below, rel=1e-9))


def test_leave_one_out_meets_places_not_points(spark):
    """40,000 points at 12 places are 144 pairs; pair by pair they would be 1.6 billion."""
    points = spark.range(40_000).select(F.col("id").alias("point_id"), (F.col("id") % 4).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"), (F.col("id") % 100).cast("double").alias("value"))
    assert doe.leave_one_out(points, "point_id", "value").agg(F.count("*"), F.max("estimate") < 99).first()[:] == (40_000, True)
