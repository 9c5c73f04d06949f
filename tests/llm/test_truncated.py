import html
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tiltyard.llm import truncated

S = ["Adjust the gap of the switch until the leaves are parallel.", "Clean the coil with a soft brush and let it dry.", "Players with patience will find the ball returns safely.", "Take the safe award when you are ahead."]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='aé€😀<>&"\'\n\t\\', max_size=40))
def test_measures(t):
    m = dict(zip(truncated.ENCODINGS, truncated.measures(t)))
    assert m["utf8"] == len(t.encode()) and m["utf16"] == len(t.encode("utf-16-le")) // 2
    assert m["chars_html"] == len(html.escape(t).replace("&#x27;", "&#39;")) and m["utf8_crlf"] == len(t.replace("\n", "\r\n").encode())
    assert m["chars_json"] == len(json.dumps(t, ensure_ascii=False)) - 2 and m["ascii_json"] == len(json.dumps(t)) - 2


def docs():
    rows, k = [], 0
    for i in range(120):
        text = " ".join(S[(i + j) % 4] for j in range(12))
        rows.append((k, "cutter", text[:300]))
        rows.append((k + 1, "whole", text + ("\n\nFiled under coils" if i % 2 else "")))
        k += 2
    text = " ".join(S)
    rows += [(k, "whole", text[:-20]), (k + 1, "whole", text + " More next week..."), (k + 2, "whole", text + " Clean the coil with..."), (k + 3, "whole", None), (k + 4, None, ""), (k + 5, None, text[:-5] + " Read more"), (k + 6, "whole", text * 2000)]
    return rows, k


def test_found_and_limits(spark):
    rows, k = docs()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, source string, text string, kind string, size int")
    c = truncated.cut_texts(df, "id", "text", "source")
    cut = {r.id for r in c.filter("cut").collect()}
    want = {r[0] for r in rows if r[1] == "cutter" and not r[2].rstrip().endswith(".")} | {k, k + 2, k + 5}
    assert cut == want
    by = {r.source: r for r in truncated.by_source(c, "source").collect()}
    assert by["cutter"].limits == "300 chars" and by["whole"].limits is None and by["cutter"].cut_at_limit == by["cutter"].cut_texts
    assert truncated.cut_texts(df.limit(0), "id", "text", "source").count() == 0


def test_a_long_last_line_has_the_head_of_its_start(spark):
    from tiltyard.llm import endings

    h = endings._Hashes()
    long = "Clean the coil with " + ", ".join(f"brush number {i}" for i in range(900))
    for before in ("", "Adjust the gap. ", "Adjust the gap\n"):
        assert endings.keys_of_end(before + long, h)[3] == endings.keys_of_end("Clean the", h)[3], before
        assert endings.last_tokens(before + long)[-5:] == endings.tokens(before + long)[-5:]
    df = spark.createDataFrame([(1, "Adjust the gap. " + long, "s")], "id long, text string, source string")
    assert truncated.inspect(df, "id", "text", "source").first()["keys"][3] == endings.keys_of_end("Clean the", h)[3]


def test_all_limits_of_a_source_are_kept(spark):
    # two field limits in one store: one counts characters, the other bytes; all texts differ
    body = lambda i: "".join(f"Type {i} é{'é' * (i % 7)} needs {j} parts more than unit {i + j} has to spare. " for j in range(14))
    rows = [(i, "two", body(i)[:253]) for i in range(60)]
    rows += [(i, "two", body(i).encode()[:422].decode(errors="ignore")) for i in range(60, 120)]
    rows += [(i, "free", body(i) + "x" * (i - 110) + ".") for i in range(120, 200)]
    c = truncated.cut_texts(spark.createDataFrame(rows, "id long, source string, text string"), "id", "text", "source")
    by = {r.source: r.limits for r in truncated.by_source(c, "source").collect()}
    assert "253 chars" in by["two"] and "422 utf8" in by["two"] and by["free"] is None, by
