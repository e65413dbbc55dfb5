"""Cut texts: hidden limits and endings."""

from veilmark.llm import truncation

S = "page_id string, element_id string, site string, tag string, text string, t string"
WHOLE = [
    "The folio was closed before noon. Nobody finished the manuscript with a single tool.",
    "Ask for the temporary volume before noon. The reader can be repaired with a single tool.",
    "We inspected every narrow binding before noon. Whoever finds the manuscript first may repair the folio.",
    "A good manuscript lasts for years before noon. The temporary folio was inspected by the reader.",
]


def corpus():
    rows = [("p", f"w{i}", "s.example", "p", WHOLE[i % 4] + f" Number {i} was closed before noon.", "clash") for i in range(80)]
    rows += [("p", f"h{i}", "s.example", "h1", f"Notes on the temporary folio {i}", None) for i in range(10)]
    return rows


def cut(spark, *extra):
    df = spark.createDataFrame(corpus() + list(extra), S)
    return {r["element_id"] for r in truncation.cut_elements(df).collect()}


def row(i, text, site="t.example"):
    return ("q", i, site, "p", text, None)


def test_endings(spark):
    got = cut(
        spark,
        row("mid_word", "Nobody finished the manusc"),
        row("mid_sentence", "The folio was closed before noon. Nobody finished the"),
        row("marked", "Whoever finds the manuscript first may rep…"),
        row("bracketed", "Whoever finds the manuscript first may […]"),
        row("comma", "The folio was closed before noon. Ask for the temporary volume,"),
        row("no_stop", "Nobody finished the manuscript with a single tool"),
        row("whole", "The folio was closed before noon."),
        row("short", "More..."),
        row("empty", ""),
        row("none", None),
        row("number", "QQ 54 49 53 A"),
    )
    assert got == {"mid_word", "mid_sentence", "marked", "bracketed", "comma"}


def test_repeated_rows_once(spark):
    r = row("x", "Nobody finished the manusc")
    df = spark.createDataFrame(corpus() + [r, r], S)
    assert truncation.cut_elements(df).count() == 1


def test_stock_endings_are_no_cuts(spark):
    extra = [row(f"s{i}", f"The folio number {i} was closed before noon. More to follow…") for i in range(12)]
    assert not cut(spark, *extra) & {f"s{i}" for i in range(12)}


def test_hidden_limit_in_bytes(spark):
    base = "Über the narrow binding the reader was closed before noon. Ask for the temporary volume before noon. "
    rows = []
    for i in range(9):
        text = f"{base[i:]}{WHOLE[i % 4]} {WHOLE[(i + 1) % 4]}".encode()[:120].decode(errors="ignore")
        rows.append(row(f"b{i}", text, "limit.example"))
    # of the limit's length, with an ending of its own that the corpus knows as whole
    whole = "Über the narrow binding, the reader, the volume, the folio and the noon: the reader can be repaired with a single tool"
    rows.append(row("whole", whole + "s" * (120 - len(whole.encode())), "limit.example"))
    df = spark.createDataFrame(corpus() + rows, S)
    judged = truncation.judged(df).filter("site = 'limit.example'")
    assert {(r["length"]) for r in truncation.limits(judged).filter("form = 'bytes'").collect()} == {120}
    got = judged.collect()
    assert len(got) > 4 and {r["evidence"] for r in got} == {"limit"}
    assert not all(r["bad"] for r in got)


def test_short_limits_count_too(spark):
    """No length is too short for a limit: the pile-up and the endings decide."""
    words = ["Nobody finished the manusc", "Whoever finds the manuscri", "The temporary folio was in", "We inspected every narrow ", "A good manuscript lasts fo", "Ask for the temporary volu"]
    df = spark.createDataFrame(corpus() + [row(f"s{i}", t.strip() if len(t.strip()) == 26 else t[:25] + "x", "small.example") for i, t in enumerate(words)], S)
    judged = truncation.judged(df)
    assert truncation.limits(judged.filter("site = 'small.example'")).filter("form = 'chars' AND length = 26").count() == 1


def test_continued(spark):
    entries = spark.createDataFrame([("a", 1), ("ab", 2), ("abc", 4), ("abcdefghij", 8), ("abcdefghijk", 16), ("ab cd", 32), ("b", 64)], "word string, n long")
    asked = spark.createDataFrame([("a",), ("ab",), ("abcdefghi",), ("abcdefghij",), ("zz",), ("b",)], "word string")
    for k in (2, 3, 8, 40):
        got = {r["word"]: r["longer"] for r in truncation.continued(entries, asked, k).collect()}
        assert got == {"a": 62, "ab": 28, "abcdefghi": 24, "abcdefghij": 16}


def test_one_very_long_word(spark):
    """A token of a million letters is one entry, not a million prefixes."""
    df = spark.createDataFrame(corpus() + [row("huge", "x" * 1_000_000), row("cut", "Nobody finished the manusc")], S)
    assert {r["element_id"] for r in truncation.cut_elements(df).collect()} == {"cut"}


def test_lengths():
    got = dict(zip(truncation.FORMS, truncation.lengths('a&<"\'é😀\n'), strict=True))
    assert got == {"chars": 8, "bytes": 12, "utf16": 9, "html": 8 + 4 + 3 + 5 + 4, "html_bytes": 12 + 16, "json": 9 + 2 + 5 * 3, "crlf": 9}


def test_rates_and_empty(spark):
    df = spark.createDataFrame(corpus() + [row("x", "Nobody finished the manusc"), row("y", "The folio was closed before noon.")], S)
    rates = {r["site"]: (r["n_texts"], r["n_cut"], r["cut_share"]) for r in truncation.site_rates(df).collect()}
    assert rates["t.example"] == (2, 1, 0.5)
    assert truncation.cut_elements(df.limit(0)).count() == 0
    assert truncation.cut_elements(spark.createDataFrame([row("long", "word " * 100_000)], S)).count() == 1  # within the text, this word always goes on


def test_short_texts(spark):
    labels = [row(f"label{i}", "Notes of fol", f"s{i}.example") for i in range(3)]
    got = cut(
        spark,
        row("two", "Nobody finis"),
        row("three", "Ask for th"),
        row("letter", "The folio w"),
        row("alone", "Nobod"),
        row("unseen", "Silent manuscr"),
        row("marked", "Whoever finds th…"),
        row("whole", "Nobody finished"),
        row("marked_whole", "Nobody finished…"),
        row("plan", "Plan W"),
        row("fragment_alone", "Manuscr"),
        *labels,
    )
    assert got == {"two", "three", "letter", "alone", "unseen", "marked"}
