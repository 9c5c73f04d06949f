from tiltyard.llm import scanned

CLEAN = ["Check the wire at connector nine of the driver board before replacing any parts.", "Tighten the left-hand set screw of the scoop slowly, then test the action again.", "The end-of-stroke switch must open when the flipper is fully extended.", "Route the white-brown harness behind the lamp so that the ball cannot catch it."]


def wrap(text, width=40):
    import textwrap

    return "\n".join(textwrap.wrap(text, width, break_on_hyphens=False))


def chunks(spark):
    rows = [(f"c{i}", f"d{i}", "Solar Rodeo", "quillon", wrap(" ".join(CLEAN[(i + j) % 4] for j in range(4))), 3, 4) for i in range(40)]
    rows += [(f"h{i}", f"e{i}", "Solar Rodeo", "quillon", wrap(CLEAN[0]) + "\nSolar Rodeo - Service Notes\n" + wrap(CLEAN[1]), 3, 4) for i in range(6)]
    rows += [
        ("hy", "f1", None, None, "Check the wire at connec-\ntor nine of the driver board.\nRoute the white-\nbrown harness behind the lamp.", 3, 4),
        ("own", "f2", None, None, "Route the white-\nbrown harness behind the lamp. The end-\nof-stroke switch must open.", 3, 4),
        ("soft", "f3", None, None, "Tighten the left-hand set scr¬\n[4]\new of the scoop slowly.", 3, 4),
        ("ch", "f4", None, None, "Cbeck the wlre at c0nnector nine of the drivcr board.", 3, 4),
        ("pg", "f5", None, None, wrap(CLEAN[2]) + "\nPage 4\n" + wrap(CLEAN[3]) + "\nAdjustment 3\n4\n", 3, 4),
        ("far", "f6", None, None, CLEAN[0] + "\n77\n", 3, 4),
        ("nul", "f7", None, None, None, None, None),
        ("emp", "f8", None, None, "", 3, 4),
        ("lng", "f9", None, None, " ".join(CLEAN * 2000), 3, 4),
    ]
    rows.append(rows[0])
    return spark.createDataFrame([(*r, "z") for r in rows], "chunk_id string, document_id string, machine_title string, manufacturer string, content string, page_start int, page_end int, noise string")


def test_kinds_and_text(spark):
    got = {r.chunk_id: (r.noise, r.text) for r in scanned.repaired(chunks(spark)).collect()}
    assert got["c1"][0] == [] and got["h1"][0] == ["header"] and got["hy"][0] == ["hyphen"] and got["own"][0] == []
    assert got["soft"][0] == ["hyphen", "page_number"] and got["ch"][0] == ["chars"] and got["pg"][0] == ["page_number"] and got["far"][0] == []
    assert got["nul"] == ([], "") and got["emp"] == ([], "") and got["lng"][0] == []
    assert got["ch"][1] == "Check the wire at connector nine of the driver board."
    assert got["hy"][1].startswith("Check the wire at connector nine") and "white-brown harness" in got["hy"][1]
    assert got["h1"][1] == f"{CLEAN[0]} {CLEAN[1]}" and len(got) == 55


def test_decode_splits_and_merges():
    m = scanned.Model({"driver": 50, "board": 50, "the": 90, "switch": 40}, {"drlver": "driver"}, frozenset(), total=230)
    assert scanned.decode(["drlver"], m) == (["driver"], True)
    assert scanned.decode(["driverboard"], m)[0] == ["driver", "board"]
    assert scanned.decode(["swi", "tch"], m)[0] == ["switch"]


def test_empty(spark):
    assert scanned.repaired(chunks(spark).limit(0)).count() == 0


def test_no_word_or_running_line_is_left_out(spark, monkeypatch):
    # more corrections and running patterns than were once sent, all before those of the chunks
    from pyspark.sql import functions as F

    fixes, lines = scanned.corrections, scanned.running_lines
    monkeypatch.setattr(scanned, "corrections", lambda w: fixes(w).unionByName(spark.range(300_000).select(F.concat(F.lit("!"), "id").alias("bad"), F.lit("x").alias("good"))))
    monkeypatch.setattr(scanned, "running_lines", lambda *a: lines(*a).unionByName(spark.range(10_000).select(F.concat(F.lit("! <t> "), "id").alias("pattern"), F.lit(10**6).cast("long").alias("docs"))))
    got = {r.chunk_id: (r.noise, r.text) for r in scanned.repaired(chunks(spark)).collect()}
    assert got["ch"] == (["chars"], "Check the wire at connector nine of the driver board.") and got["h1"][0] == ["header"]


def test_patterns_fit_lines_with_any_name(spark):
    store = scanned.Store.write(spark.createDataFrame([("wire", 3, None), ("wlre", None, "wire")], "w string, n long, good string"), spark.createDataFrame([("<t> - service notes",), ("<m> <t> rev #",), ("manual of <t>",), *((f"<t> x{i} <m>",) for i in range(1200))], "pattern string"))
    assert store.fits("solar rodeo - service notes") and store.fits("quillon solar rodeo rev #") and store.fits("manual of solar rodeo") and store.fits("solar x1199 quillon") and store.fits("solar x1199 quillon")
    assert not store.fits("solar rodeo - service note") and not store.fits("a manual of solar rodeo") and not store.fits("solar y quillon")
    assert "manual of <t>" in store and "manual" not in store and store.word("wlre") == (None, "wire") and store.total() == 3


def test_one_lattice_over_all_lines():
    m = scanned.Model({"driver": 50, "board": 50, "the": 90, "switch": 40, "check": 9, "connector": 30}, {"drlver": "driver"}, frozenset({"<t> service notes"}), total=400)
    kinds, text = scanned.repair("Check the con-\nMars Service Notes\n7\nnector", "Mars", None, 7, 7, m)
    # a word may go on behind the running line and the page number
    assert (kinds, text) == (["header", "hyphen", "page_number"], "Check the connector")
    kinds, text = scanned.repair("Check the drl-\nver board", "Mars", None, 7, 7, m)
    assert (kinds, text) == (["chars", "hyphen"], "Check the driver board")
    assert scanned.repair("Check the swi\ntch", None, None, None, None, m) == ([], "Check the switch")
    # a run of any number of unknown words is one stretch of the lattice
    odd = " ".join(f"zq{i}x" for i in range(40))
    assert scanned.repair(f"{odd} drlver {odd}", None, None, None, None, m) == (["chars"], f"{odd} driver {odd}")
    assert scanned.repair("con-", None, None, None, None, m) == ([], "con-") and scanned.repair("", None, None, None, None, m) == ([], "")
