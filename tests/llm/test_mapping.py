from tiltyard.llm import mapping, strings

MAKERS = [("brasswick", "Brasswick Pinball", None), ("quillon", "Quillon Coin Works", None), ("lumierebay", "Lumiere Bay Games", None)]
EDITIONS = [("pro", "Pro", None), ("premium", "Premium", None), ("limited", "Limited Edition", None), ("launch", "Launch Edition", None), ("collector", "Collector's Edition", None), ("anniversary", "Anniversary Edition", None), ("standard", "Standard", None), ("prototype", "Prototype", None)]
GROUPS = [("G1", "Crystal Harbor", "quillon"), ("G2", "Crystal Harbor", "brasswick"), ("G3", "Wooden Quarry II", "quillon"), ("G4", "Wooden Quarry", "quillon"), ("G5", "Opal Quarry: Crown of Ash", "quillon"), ("G6", "Nimble Hurricane: Deep Vault", "quillon")]


def test_osa():
    assert strings.osa("abcd", "abdc", 3) == 1 and strings.osa("abc", "xyz", 1) == 2 and strings.osa("", "ab", 3) == 2


def test_forms():
    e, m, g = (mapping.Index(x, mapping.RULES[n]) for x, n in ((EDITIONS, "edition"), (MAKERS, "manufacturer"), (GROUPS, "group")))
    for v, k in {"LE": "limited", "ltd. edition #12": "limited", "C.E.": "collector", "25th anniv.": "anniversary", "Premuim / EU": "premium", "std": "standard", "blue": "unmatched", "second run": "unmatched", "???": "unmatched", " ": "unmatched"}.items():
        assert e.resolve(v)[0] == k, v
    for v, k in {"Brasswick": "brasswick", "QUILLON Ltd": "quillon", "Lumiere By Games": "lumierebay", "Haldane Billiards": "unmatched"}.items():
        assert m.resolve(v)[0] == k, v
    assert g.resolve("crystal harbor")[0] == "unmatched" and g.resolve("Crystl Harbor", "brasswick")[0] == "G2"
    for v, k in {"Woden Quarry": "G4", "wooden-quarry-ii": "G3", "woodenquarryii": "G3", "opal quarry": "G5", "NHDV": "G6", "Wooden Harbor": "unmatched", "n/a": "unmatched", "x" * 5000: "unmatched"}.items():
        assert g.resolve(v)[0] == k, v


def test_blocks_agree_and_nulls(spark):
    v = spark.createDataFrame([("Woden Quarry", "z"), ("Woden Quarry", "z"), (None, "z"), ("blue", "z")], "value string, score string")
    rules = mapping.RULES["group"]
    one = {(r.value, r.canon_key) for r in mapping.map_values(v, GROUPS, rules).collect()}
    two = {(r.value, r.canon_key) for r in mapping.map_values(v, GROUPS, rules, block=4).collect()}
    assert one == two == {("Woden Quarry", "G4"), ("blue", "unmatched")}
    assert mapping.map_values(v.limit(0), GROUPS, rules).count() == 0


def test_blocks_change_no_result(spark):
    # near-equal entries in different blocks, a value that is ambiguous in one block only, words that are rare in one block only
    canon = [*GROUPS, ("G7", "Wooden Quary", "brasswick"), *((f"H{i}", f"{w} Meadow", "quillon") for i, w in enumerate("Amber Birch Cedar Dusky Ember Fabled Golden Hollow".split())), ("G8", "Silent Meadow", "brasswick"), ("G9", "Silent Meadows", "quillon")]
    rows = [(v, h) for v in ("Crystl Harbor", "Woden Quarry", "wooden quarry", "silent meadw", "Birch Medow", "NHDV", "opal quarry", "meadow", "g3", "n/a") for h in (None, "quillon", "brasswick")]
    v = spark.createDataFrame(rows, "value string, maker string")
    rules = mapping.RULES["group"]
    want = {(r.value, r.maker): (r.canon_key, round(r.score, 9)) for r in mapping.map_values(v, canon, rules, hint="maker").collect()}
    for block in (1, 4):
        assert {(r.value, r.maker): (r.canon_key, round(r.score, 9)) for r in mapping.map_values(v, canon, rules, hint="maker", block=block).collect()} == want
    assert want["Crystl Harbor", None][0] == "unmatched" and want["Crystl Harbor", "quillon"][0] == "G1" and len(want) == 30


def test_no_entry_is_lost_by_cosine():
    # many short entries share more n-grams with the typed value than the long one that is like it word by word
    canon = [("T", "Extraordinarily Thunderstruck Manorhouses", None), *((f"N{a}{b}", f"{a}{b} {b}{b}", None) for a in ("Ex", "Th", "Ma") for b in "bdgkpwz")]
    x = mapping.Index(canon, mapping.RULES["group"])
    assert x.resolve("Ex. Th. Ma.")[0] == "T"
    for v in ("Ex. Th. Ma.", "exb thz", "manor thundr", "zz", ""):
        ws = mapping.words(v)
        every = max((0.98 * strings.likeness(ws, f, x.weights) + 0.02 * c for (f, _), c in zip(x.forms, x.cosines(ws))), default=0.0)
        assert abs(x.resolve(v)[1] - every) < 1e-9
