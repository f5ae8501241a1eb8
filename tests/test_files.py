"""Binary families and histories: strides by hand, ranges, the distributed writer, broken files."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from stressframe.sources import binary, history, sinks, text


def at_of(**n):
    return binary.Layout("<", 4, "t", dict.fromkeys(binary.HEADER, 0) | {"ndim": 4} | n)


def test_ten_node_solids_take_more_words():
    """Two ten-node solids over five nodes: 64 words, 15 of places, 18 of cards and 4 of further nodes; then a shell."""
    at = at_of(numnp=5, nel8=-2, nel4=1, nv3d=7, nv2d=3)
    assert at.count("SOLID") == 2 and at.cards_at("SHELL") == 64 + 15 + 18 + 4 and at.mesh_words == 64 + 15 + 18 + 4 + 5
    assert at.state_words == 1 + 14 + 3


def test_words_of_nodes_and_deletions():
    """Temperatures by the units of their code, mass scaling behind the kinematics, deletions by the sign of the points."""
    assert at_of(numnp=4, it=12, iu=1, ia=1).nodal() == (1 + 12 + 12 + 12 + 4, {"temperature": (1, 3), "place": (13, 3), "acceleration": (25, 3), "mass": (37, 1)})
    assert at_of(numnp=4, nel8=-2, nel2=1).deletion_words == 0
    assert at_of(numnp=4, nel8=-2, nel2=1, maxint=-3).deletion_words == 4
    assert at_of(numnp=4, nel8=-2, nel2=1, maxint=-10003).deletion_words == 3


@pytest.mark.parametrize(("order", "size"), [("<", 4), (">", 8)])
def test_small_family_by_ranges(spark, tmp_path, order, size):
    """All classes, user ids in the order of the file, padding behind the end mark; ranges of a few bytes give the same."""
    cells = {"SOLID": np.array([[1, 2, 3, 4, 5, 6, 7, 8, 3]] * 2), "THICK_SHELL": np.array([[8, 7, 6, 5, 4, 3, 2, 1, 4]]), "BEAM": np.array([[1, 2, 0, 0, 0, 5]]), "SHELL": np.array([[1, 2, 3, 4, 6]] * 3)}
    ids = binary.pack_ids({"node": 100 + np.arange(8), "SOLID": [11, 12], "THICK_SHELL": [21], "BEAM": [31], "SHELL": [41, 42, 43]})
    counters = {"iu": 1, "nglbv": 2, "nv3d": 2, "nv3dt": 1, "nv1d": 1, "nv2d": 3, "nel8": -2, "maxint": -3}
    mesh = binary.pack_mesh("all", counters, np.arange(24.0).reshape(8, 3), cells, order, size, ids=ids)
    at = binary.detect(mesh)
    states = [np.arange(at.state_words) + 1000.0 * k for k in range(5)]
    base = f"{tmp_path}/res"
    binary.write_bytes(base, mesh + binary.pack_states([], order, size), [binary.pack_states(states[:3], order, size) + bytes(7 * at.state_words * size), b"".join(np.asarray(s, at.real).tobytes() for s in states[3:])])
    assert [(r["part"], r["place"], r["time"]) for r in binary.times(spark, base).orderBy("part", "place").collect()] == [(1, 0, 0), (1, 1, 1000), (1, 2, 2000), (2, 0, 3000), (2, 1, 4000)]
    found = {(r["etype"], r["elem_idx"]): (r["elem_id"], r["part_id"], r["node_ids"]) for r in binary.elements(spark, base, 1).collect()}
    assert found["THICK_SHELL", 0] == (21, 4, [7, 6, 5, 4, 3, 2, 1, 0]) and found["BEAM", 0] == (31, 5, [0, 1]) and [found["SHELL", k][0] for k in range(3)] == [41, 42, 43] and len(found) == 7
    assert [r["node_id"] for r in binary.nodes(spark, base, 20).orderBy("node_idx").collect()] == list(range(100, 108))
    for span in (1, 50, 1 << 20):
        for kind in binary.CLASSES:
            start, width = at.values_at(kind)
            got = [(r["part"], r["place"], r["elem_idx"], r["words"]) for r in binary.element_states(spark, base, kind, span=span).orderBy("part", "place", "elem_idx").collect()]
            want = [(1 + (k > 2), k - 3 * (k > 2), e, list(s[start + e * width : start + (e + 1) * width])) for k, s in enumerate(states) for e in range(at.count(kind))]
            assert got == want
    some = binary.node_states(spark, base, ("place",), 30).where("part = 1 and state >= 1")
    assert [(r["state"], r["node_idx"], r["x"], r["vx"]) for r in some.orderBy("state", "node_idx").collect()] == [(k, i, states[k][3 + 3 * i], None) for k in (1, 2) for i in range(8)]


def test_filters_and_ranges_make_the_tasks(spark, tmp_path):
    base = f"{tmp_path}/res"
    mesh = binary.pack_mesh("many", {"nv1d": 1}, np.zeros((2, 3)), {"BEAM": np.array([[1, 2, 0, 0, 0, 1]] * 1000)})
    binary.write_bytes(base, mesh, [binary.pack_states([np.full(1001, k, float) for k in range(20)]) for _ in range(3)])
    rows = binary.element_states(spark, base, "BEAM", span=4000)
    assert rows.rdd.getNumPartitions() == 60 and rows.count() == 60_000
    few = rows.where("part = 2 and place in (3, 4, 9)")
    assert few.rdd.getNumPartitions() == 3 and few.count() == 3000
    assert binary.element_states(spark, base, "BEAM", span=1000).rdd.getNumPartitions() == 240
    assert rows.where("part = 9").count() == 0


def test_small_spans_of_a_large_family_make_few_tasks(spark, tmp_path):
    """Ranges of a few bytes grow until there are some hundred tasks, and all is read."""
    base = f"{tmp_path}/res"
    mesh = binary.pack_mesh("many", {"nv1d": 1, "iu": 1}, np.zeros((3000, 3)), {"BEAM": np.array([[1, 2, 0, 0, 0, 1]] * 2000)})
    states = [np.arange(9000 + 2001) + 7.0 * k for k in range(30)]
    binary.write_bytes(base, mesh, [binary.pack_states(states[:20]), binary.pack_states(states[20:])])
    rows, motion = binary.element_states(spark, base, "BEAM", span=16), binary.node_states(spark, base, ("place",), 16)
    assert all(df.rdd.getNumPartitions() <= 2 * binary.RANGES for df in (rows, motion, binary.nodes(spark, base, 16), binary.elements(spark, base, 16)))
    assert rows.agg(F.count("*"), F.sum(F.col("words")[0])).first()[:] == (60_000, float(sum(s[9001:].sum() for s in states)))
    assert motion.agg(F.count("*"), F.sum(F.col("x") + F.col("y") + F.col("z"))).first()[:] == (90_000, float(sum(s[1:9001].sum() for s in states)))


def test_writer_scatters_rows_with_gaps(spark, tmp_path):
    """Rows between which nothing, little or much stands are where they belong, and all else is zero."""
    places = [0, 1, 2, 5, 6, 900, 901, 2900, 2999]
    nodes = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0)], "node_idx int, node_id int, x double, y double, z double")
    elements = spark.createDataFrame([("BEAM", 2999, 7, 3, [0, 0])], "etype string, elem_idx int, elem_id int, material_id int, node_ids array<int>")
    states = spark.createDataFrame([(k, k + 0.5, [1.0]) for k in range(3)], "state_idx int, time double, globals array<double>")
    words = spark.createDataFrame([(k, e, [e + 1.0, k + 1.0]) for k in range(3) for e in places], "state_idx int, elem_idx int, words array<double>")
    base = f"file://{tmp_path}/a/res"
    binary.write_family(base, "x", nodes, elements, states, None, {"BEAM": words}, "<", 8, 2, widths={"BEAM": 2})
    got = [(r["part"] * 2 - 2 + r["place"], r["elem_idx"], r["words"]) for r in binary.element_states(spark, base, "BEAM").collect()]
    assert sorted(got) == [(k, e, [e + 1.0, k + 1.0] if e in places else [0.0, 0.0]) for k in range(3) for e in range(3000)]
    with pytest.raises(Exception, match="more than 1 words"):
        binary.write_family(f"file://{tmp_path}/b/res", "x", nodes, elements, states, None, {"BEAM": words}, "<", 8, 2, widths={"BEAM": 1})


def test_writer_fills_with_zeros_and_refuses_doubles(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 7, 1.0, 2.0, 3.0), (2, 9, 4.0, 5.0, 6.0)], "node_idx int, node_id int, x double, y double, z double")
    elements = spark.createDataFrame([("SHELL", 1, 5, 3, [0, 1, 2, 2])], "etype string, elem_idx int, elem_id int, material_id int, node_ids array<int>")
    states = spark.createDataFrame([(0, 0.5, [1.0]), (3, 2.0, [4.0])], "state_idx int, time double, globals array<double>")
    words = spark.createDataFrame([(3, 0, [1.0, 2.0])], "state_idx int, elem_idx int, words array<double>")
    base = f"file://{tmp_path}/a/res"
    at = binary.write_family(base, "x", nodes, elements, states, None, {"SHELL": words}, ">", 8, 2)
    assert binary.layout(spark, base) == at and not [p for p in (tmp_path / "a").iterdir() if "temporary" in p.name]
    assert [(r["node_id"], r["x"], r["z"]) for r in binary.nodes(spark, base).orderBy("node_idx").collect()] == [(7, 1, 3), (0, 0, 0), (9, 4, 6)]
    assert [(r["part"], r["place"], r["time"]) for r in binary.times(spark, base).orderBy("part", "place").collect()] == [(1, 0, 0.5), (1, 1, 0), (2, 0, 0), (2, 1, 2.0)]
    assert [r["words"] for r in binary.element_states(spark, base, "SHELL").where("part = 2 and place = 1").orderBy("elem_idx").collect()] == [[1, 2], [0, 0]]
    with pytest.raises(Exception, match="two rows"):
        binary.write_family(f"file://{tmp_path}/b/res", "x", nodes, elements, states, None, {"SHELL": words.union(words)})
    assert not (tmp_path / "b/res").exists()


def test_family_without_states_or_elements(spark, tmp_path):
    base = f"{tmp_path}/res"
    binary.write_bytes(base, binary.pack_mesh("none", {}, np.zeros((0, 3)), {}), [])
    assert binary.nodes(spark, base).count() == binary.elements(spark, base).count() == binary.times(spark, base).count() == binary.element_states(spark, base, "SOLID").count() == 0


@pytest.mark.parametrize("little", [True, False])
def test_history_that_breaks_off(spark, tmp_path, little):
    """What is whole is read; a later file wins for a time of both; unknown types and other branches are passed over."""
    first = history.pack([("/glstat/metadata", [("title", np.frombuffer(b"a run", np.int8))]), ("/glstat/d000001", [("time", np.array([0.0])), ("kinetic_energy", np.array([5.0], np.float32))]), ("../d000002", [("time", np.array([1.0])), ("kinetic_energy", np.array([6.0]))])], little)
    second = history.pack([("/glstat/d000001", [("time", np.array([1.0])), ("kinetic_energy", np.array([7.0]))]), ("/other/d000001", [("time", np.array([9.0]))])], little)
    (tmp_path / "binout0000").write_bytes(first)
    (tmp_path / "binout0001").write_bytes(second + second[8:60])
    (tmp_path / "binout0002").write_bytes(b"short")
    rows = history.read(spark, f"{tmp_path}/binout*")
    assert sorted((r["t"], r["ke"]) for r in history.energies(rows).collect()) == [(0, 5), (1, 7)]
    assert {r["branch"] for r in rows.select("branch").distinct().collect()} == {"glstat", "other"}
    assert history.read(spark, f"{tmp_path}/binout*", ["other"]).select(F.col("values")[0]).first()[0] == 9.0


def test_numbers_of_cards_are_rounded_by_their_exact_values(spark):
    """100.05 is a little less in binary and 0.10005 a little more; 1000.5 and 1001.5 are exact halves, which go to the even one."""
    rows = spark.createDataFrame([(1, 100.05, 0.10005, -1000.5), (2, 1001.5, None, 0.0)], "node_id int, vx double, vy double, vz double")
    assert [r["value"] for r in sinks.keyword_velocities(rows).orderBy("node_id").collect()] == ["         1 1.000e+02" + " 1.001e-01" + "-1.000e+03", "         2 1.002e+03" + "      null" + " 0.000e+00"]


def deck_text(rng):
    """Cards of many lines, comments, blank lines, an end in the middle of a file."""
    out = ["*KEYWORD", "$ a comment"]
    for k in range(40):
        out += [["*NODE", "*node", "*SET_NODE_LIST", "*PART", "*ELEMENT_SHELL"][k % 5]] + ([str(k)] if k % 5 == 2 else [])
        for j in range(rng.randint(0, 25)):
            out += ["$ between"] * rng.randint(0, 1) + [f"{100 * k + j + 1},{j},{k},1.5,{j + 2},{j + 3}"]
    return out


@pytest.mark.parametrize("size", [40, 300, 1 << 20])
def test_deck_in_many_splits(spark, tmp_path, size):
    """Lines and cards are the same however files are split; a card goes on over splits, and nothing counts behind the end."""
    rng = __import__("random").Random(3)
    decks = {"a.k": deck_text(rng), "b.k": [*deck_text(rng), "*END", "*NODE", "9,9,9,9"], "c.k": ["no card", "*NODE"], "d.k": []}
    want_lines, want_cards = [], []
    for name, rows in decks.items():
        (tmp_path / name).write_text("\r\n".join(rows) + "\n" if rows else "")
        card, heads, i = None, 0, 0
        for n, row in enumerate(rows):
            want_lines.append((name, n, row))
            if row.startswith("$"):
                continue
            if row.startswith("*"):
                card, heads, i = row.upper(), heads + 1, 0
                if card == "*END":
                    break
            elif card:
                want_cards.append((name, heads, card, i, row))
                i += 1
        want_lines += [(name, n, row) for n, row in enumerate(rows) if (name, n, row) not in want_lines]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        paths = [f"{tmp_path}/{name}" for name in decks]
        base = F.regexp_extract("file", "[^/]*$", 0).alias("file")
        got = sorted((r["file"], r["n"], r["value"]) for r in text.lines(spark, paths).select(base, "n", "value").collect())
        assert got == sorted(want_lines)
        rows = text.cards(spark, paths).select(base, "card", "card_n", "i", "value").collect()
        heads = {key: k for name in decks for k, key in enumerate(sorted({(r["file"], r["card_n"]) for r in rows if r["file"] == name}))}
        known = {}
        for name, k, *_ in want_cards:
            known.setdefault(name, []).append(k)
        place = {(name, j): sorted(set(ks))[j] for name, ks in known.items() for j in range(len(set(ks)))}
        assert sorted((r["file"], place[r["file"], heads[r["file"], r["card_n"]]], r["card"], r["i"], r["value"]) for r in rows) == sorted(want_cards)
        assert (size > 40) or text.cards(spark, paths).rdd.getNumPartitions() > 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_headers_leave_no_families(spark, sf, monkeypatch):
    """A family of which the header has been read is deleted before the next is written."""
    from pathlib import Path

    from stressframe.plans import queries_files, registry

    written, there, write = [], [], queries_files._family

    def family(*of):
        there.append([Path(base.removeprefix("file://")).exists() for base in written])
        written.append(write(*of))
        return written[-1]

    monkeypatch.setattr(queries_files, "_family", family)
    assert registry.QUERIES["result_headers"](spark, sf).count() == 2 and there == [[], [False]]
    assert not [base for base in written if Path(base.removeprefix("file://")).parent.exists()]


def test_history_is_written_by_batches_and_many_files_by_few_tasks(spark, tmp_path):
    """Forms and lengths of all kinds, files that go on over batches: as ``pack`` has them; 5000 files are not 5000 tasks."""
    assert [history.tasks(n) for n in (0, 1, 150, 5000, 100_000)] == [1, 1, 150, 200, 3125]
    assert [history.tasks(n, n << 20) for n in (0, 50, 600, 64_000)] == [1, 50, 64, 2000] and history.tasks(600, 600 << 30) == 600
    kinds, rows, want = [("a", "f8", [1.5, -2.0]), ("bb", "i4", [7.0]), ("none", "f4", []), ("ccc", "i1", [1.0, 2.0, 3.0])], [], {}
    for f in range(3):
        for k in range(40):
            own = [(name, form, [v + k for v in values]) for name, form, values in kinds]
            rows += [(f"x{f}", 10 * k + j, f"/glstat/d{k:06d}", name, form, values) for j, (name, form, values) in enumerate(own)]
            want.setdefault(f"x{f}", []).append((f"/glstat/d{k:06d}", [(name, np.array(values, form)) for name, form, values in own]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        history.write(spark.createDataFrame(rows, "file string, at long, folder string, name string, form string, values array<double>"), f"{tmp_path}/h", False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {p.name: p.read_bytes() for p in (tmp_path / "h").iterdir() if not p.name.startswith((".", "_"))} == {name: history.pack(folders, False) for name, folders in want.items()}


@pytest.mark.parametrize("chunk", [8, 30, 1 << 20])
def test_history_records_over_the_ends_of_reads(monkeypatch, chunk):
    monkeypatch.setattr(history, "CHUNK", max(chunk, 9))
    raw = history.pack([(f"/glstat/d{k:06d}", [("time", np.array([float(k)])), ("many", np.arange(50.0) + k), ("none", np.zeros(0))]) for k in range(5)] + [("/other/d000001", [("time", np.array([9.0]))])])
    got = [(folder, name, list(values)) for folder, name, values in history.records(lambda place, length: raw[place : place + length], len(raw), ["glstat"])]
    assert got == [(f"/glstat/d{k:06d}", name, list(values)) for k in range(5) for name, values in (("time", np.array([float(k)])), ("many", np.arange(50.0) + k), ("none", np.zeros(0)))]


def test_cells_of_a_family_are_dealt_once_as_rows(spark, sf, monkeypatch):
    """Words are summed up behind the shuffle, and no pass over them counts their length."""
    from stressframe.plans import queries_files

    seen = {}
    monkeypatch.setattr(queries_files.binary, "write_family", lambda *of, widths=None: seen.update(rows=of[6]["SOLID"], widths=widths))
    queries_files._family(spark, sf)
    lines = seen["rows"]._jdf.queryExecution().executedPlan().toString().split("\n")
    dealt = [k for k, line in enumerate(lines) if "Exchange" in line]
    assert len(dealt) == 1 and not [line for line in lines[dealt[0] :] if "Aggregate" in line]
    assert seen["widths"] == {"SOLID": 7, "BEAM": 6}
