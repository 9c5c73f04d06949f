from tiltyard.llm import endings, pairs


def test_empty():
    for a in (None, "", " \n", "​", "-", "N/A", "null", "<p></p>", "(no answer)", '""', "...", "[]"):
        assert pairs.is_empty(a), a
    for a in ("9.", "Yes.", "No", "F7"):
        assert not pairs.is_empty(a), a


def test_copy():
    q = "Where can I find the manual for Solar Rodeo?"
    for a in (q, q.upper(), f"{q} {q}", f'You asked: "{q}"', f"Re: {q}", "  Where  can  I find the manual for Solar Rodeo?\n", "Where can I find the?"):
        assert pairs.is_copy(q, a), a
    for a in (f"{q} It is in the library on page four of the index.", "The manual.", "Solar Rodeo has its manual on the service page of the maker.", ""):
        assert not pairs.is_copy(q, a), a
    assert not pairs.is_copy(None, "x y z") and pairs.tiles(list("abcxabc"), list("abc")) == [(0, 0, 3), (4, 0, 3)]


def test_refusal():
    for a in ("I do not know the answer to that.", "Sorry, I can't help with that question. Is there something else I can look up?", "Diese Frage kann ich nicht beantworten.", "No encuentro ninguna fuente, por lo que no puedo responder.", "Je ne peux pas répondre.", "At present I have to pass on this one; please narrow the question."):
        assert pairs.is_refusal(a), a
    for a in ("I could not confirm the year. Still, the bulletin covers your point: the fuse is F4.", "The scoop cannot be adjusted without lifting the playfield.", "Lubricate nothing on the magnet; the bushings run dry.", "Yes."):
        assert not pairs.is_refusal(a), a


def test_language():
    q = "Which fuse protects the sound board of Mystic Quest?"
    assert pairs.other_language(q, "Der Modus beginnt, sobald die Rampe 8 Mal getroffen wurde.")
    assert pairs.other_language(q, "Замените предохранитель на плате звука.")
    assert not pairs.other_language(q, "Two locks.") and not pairs.other_language(q, 'The label reads "Achtung: Netzstecker ziehen". Clean the coil with a brush.')
    assert not pairs.other_language("Warum zündet der Auswurf an meinem Gerät?", "Die Feder ist abgenutzt und muss ersetzt werden.")


def test_structure():
    for a in ("see [the notes](https://a.exa", "He said \"never", "Compare **Mirror", "```\ncode", "(see the manual, p", "A list:\n1. Open the", "It is o-", "Source: https://catalog.example/mach"):
        assert pairs.shape_of_end(a)[0] == "cut", a
    for a in ("Done. (p. 42)", "Done. [1]", "Steps:\n1) open it.\n2) close it.", 'He said "never".', "Use a 1/4\" bolt and wait."):
        assert pairs.shape_of_end(a)[0] == "stop", a
    assert endings.finished("week 13...")[0] == "dots" and endings.finished("up to Read more")[0] == "marker" and endings.finished("a contact&nbs")[0] == "markup" and endings.finished(" ")[0] == "blank"


def test_defects_with_clashing_columns_and_long_texts(spark):
    body = "Adjust the gap of the switch until the leaves are parallel. Clean the coil with a soft brush and let it dry. "
    rows = [(i, "Which fuse protects the board?", body + f"See https://a.example/notes/{10 + i}", "x", 1) for i in range(30)]
    rows += [(100, None, None, "x", 1), (100, None, None, "x", 1), (101, "Which fuse protects the board?", body + "Clean the coil with a so", "x", 1), (102, None, body * 3000, "x", 1), (103, "Q?", body + "Adjust the gap of...", "x", 1)]
    df = spark.createDataFrame(rows, "id long, q string, a string, r string, kind int")
    got = {r.id: r.defect for r in pairs.defects(df, "id", "q", "a").collect()}
    assert got == {100: "empty", 101: "truncated", 103: "truncated"}
    assert pairs.defects(df.limit(0), "id", "q", "a").count() == 0


def test_no_rule_is_hidden_by_the_cues():
    import re

    # sentences made of the rules: each alternative of each category in turn, gaps empty
    def words(c):
        return [re.sub(r"\\w[+*]|\(\?:|\)|\?", "", w) for w in re.split(r"\|(?![^(]*\))", pairs.LEXICON[c])]

    said = [f"I {w} answer" for w in words("CANT")] + [f"I must {w} it" for w in words("DECLINE")] + [f"this cannot be {w}" for w in words("DONE")] + [f"beyond {w}" for w in words("REMIT")] + [f"we stick to {w}" for w in words("SUBJECT")]
    said += [f"the pages {w}" for w in ("stay silent", "say nothing", "end before it", "stop short of it", "don't cover it", "lack it", "hold nothing")] + [f"sorry, {w}" for w in ("no", "not", "nothing")] + ["I have no idea", "I don't know", "there is no record", "nothing was found", "not appropriate"]
    said += ["je ne peux pas", "aucune source", "kann ich nicht", "keine Angaben", "no puedo", "ninguna fuente", "non posso", "nessuna fonte", "kan ik niet", "geen bron", "não sei", "lo siento", "mi dispiace", "helaas", "leider", "désolé"]
    hidden = [s for s in said if any(r.search(s) for _, r in pairs.REFUSALS) and not pairs.refuses(s)]
    assert not hidden and sum(bool(pairs.refuses(s)) for s in said) > 40
