"""Personal data: formal entities, names by disclosure, placeholders."""

import re

import pytest

from veilmark.llm import pii_patterns as P
from veilmark.llm import privacy

S = "page_id string, element_id string, text string, label string, placeholder string, alt string, v string"


def py(pattern):
    import regex

    return regex.compile(pattern)


@pytest.mark.parametrize("t", ["a.b+c@x.example", "MAILTO A@B.EXAMPLE", "kofi (at) uni.tarrow.example", "wren-z [at] corp [dot] moor [dot] example"])
def test_emails(t):
    assert py(P.EMAIL).search(t)


@pytest.mark.parametrize("t", ["@handle", "you@…", "a@b", "see at the end."])
def test_no_emails(t):
    assert not py(P.EMAIL).search(t)


@pytest.mark.parametrize(
    "t",
    ["+1 415 555 0135", "+44.20.7946.0435 ext. 092", "+49 30 23125 396", "+33 1 99 00 77 96", "+12025550113", "415 555 0151 x17", "(312) 555-0122", "312.555.0153", "020 7946 0412", "(02) 5550 9346", "01 99 00 86 73", "030/23125707", "0044 (0)20 7946 0448", "0151 496 0239"],
)
def test_phones(t):
    assert py(P.PHONE).fullmatch(t)


@pytest.mark.parametrize(
    "t", ["4673-3610", "000-4471-93", "2025-02-11", "12/03/2025", "1,249.00", "INV-2025-00413", "0099 8123", "99-204-746", "51.50538, 0.12538", "#00184417", "1461-9707-1877", "0258 7647 3530", "ZX10388 0012", "666-16-1295", "20-25 min", "Between 1987 and 2016"]
)
def test_no_phones(t):
    assert not py(P.PHONE).search(t)


@pytest.mark.parametrize("t", ["1461-9707-1877", "1774 2931 3484", "666-16-1295", "LRPPA1234B", "QQ 18 75 03 C", "QQ456104C", "00002103-P", "PM72R426", "K4931492"])
def test_ids(t):
    assert py(P.ID).fullmatch(t)


@pytest.mark.parametrize("t", ["4111 1111 1111 1111", "000-4471-93", "ZX10388 0012", "99-204-746", "2025-02-11", "Order 4471-0982"])
def test_no_ids(t):
    assert not py(P.ID).search(t)


@pytest.mark.parametrize(
    "t",
    ["163 Kestrel Avenue", "206b Osier Terrace", "4780 Larkfield St.", "Hafenweg 29", "Gerberstraße 12", "Am Mühlbach 34", "Obere Gasse 88", "Calle del Molino 24", "Avenida de la Fuente 17", "233 impasse des Lilas", "84 avenue du Vieux Port", "102 boulevard de la Forge"],
)
def test_addresses(t):
    assert py(P.ADDRESS).search(t)


@pytest.mark.parametrize("t", ["The stop at Kingfisher Lane is closed", 'Read the "Green Lantern Street" chapter', "Room 214, level 3", "In 2019 the reader", "Im Jahr 2016"])
def test_no_addresses(t):
    assert not py(P.ADDRESS).search(t)


ROWS = [
    ("p", "1", "Ask Talia Varnosso at talia.varnosso@x.example", None, None, None, "clash"),
    ("p", "2", "Later Talia Quistholt took over the desk.", None, None, None, None),
    ("p", "3", "Leave a message for Prof. E. Tarrarro, +49 30 23125 617.", None, "Quistholt, Talia", "Avatar of TALIA van OSTVSTAD", None),
    ("p", "4", "Marlow & Finch Ltd supplied the panels. The Brightwell Kettle won a prize.", "Account of Opalgate Works", None, None, None),
    ("p", "5", "Mаіl: k​ofi@x.example", None, "", None, None),
    ("p", "6", None, None, None, None, None),
    *[("p", f"f{i}", f"The reader of desk {i} asked whether the folio can be closed before noon in most cases, and the clerk answered that it can.", None, None, None, None) for i in range(40)],
]


def test_findings(spark):
    got = {(r["element_id"], r["field"], r["pii_type"]) for r in privacy.findings(spark.createDataFrame(ROWS * 2, S)).collect()}
    assert got == {("1", "text", "email"), ("1", "text", "name"), ("2", "text", "name"), ("3", "text", "name"), ("3", "text", "phone"), ("3", "placeholder", "name"), ("3", "alt", "name"), ("5", "text", "email")}


def test_redacted(spark):
    got = {(r["element_id"], r["field"]): r["redacted"] for r in privacy.redacted(spark.createDataFrame(ROWS * 2, S)).collect()}
    assert got == {
        ("1", "text"): "Ask [NAME] at [EMAIL]", ("2", "text"): "Later [NAME] took over the desk.", ("3", "text"): "Leave a message for [NAME], [PHONE].", ("3", "placeholder"): "[NAME]", ("3", "alt"): "Avatar of [NAME]", ("5", "text"): "Mаіl: [EMAIL]",
    }


def test_empty_and_long(spark):
    df = spark.createDataFrame(ROWS, S)
    assert privacy.findings(df.limit(0)).count() == 0
    long = "The folio is closed. " * 20_000 + "Write to a@b.example."
    assert privacy.findings(spark.createDataFrame([("p", "1", long, None, None, None, None)], S)).count() == 1


def test_nothing_leaks(spark):
    """What is found is gone from the redacted value."""
    for r in privacy.redacted(spark.createDataFrame(ROWS, S)).collect():
        assert not re.search(r"@|Varnosso|Quistholt|OSTVSTAD|Tarrarro|23125", r["redacted"])


@pytest.mark.parametrize("t", ["KOFI (AT) UNI.EXAMPLE", "kofi [At] uni.example"])
def test_spelled_out_at_in_any_case(t):
    assert [(f, a, b) for f, a, b, *_ in privacy.spans(t)[0]] == [("email", 0, len(t))]


def test_terms():
    assert privacy.shape("+44.20.7946.0912 ext. 432") == "+99.99.9999.9999" and privacy.shape("QQ 18 75 03 C") == "AA 99 99 99 A"
    assert [privacy.street(a) for a in ("163 Kestrel Avenue", "Gerberstraße 12", "Calle del Molino 24", "Am Mühlbach 34", "233 impasse des Lilas")] == ["avenue", "straße", "calle", "am", "impasse"]
    got, rest = privacy.spans("Mrs. Zell, passport no. K4931492, order 4471-0982")
    assert {(f, t, h) for f, _, _, t, _, h in got} == {("titled", "zell", "name"), ("id", "A9999999", "id"), ("number", "9999-9999", "id")}
    assert "K4931492" not in rest and len(rest) == len("Mrs. Zell, passport no. K4931492, order 4471-0982")


def numbers(*more):
    """Fields that say what they hold: the corpus that shapes are judged by."""
    rows = [("n", f"o{i}", f"7415-{1000 + i}", "Order number", None, None, None) for i in range(60)]
    rows += [("n", f"p{i}", f"+49 30 23125 {100 + i}", "Phone", None, None, None) for i in range(30)]
    rows += [("n", f"m{i}", f"Z77/{10000 + i}/Q", "Passport", None, None, None) for i in range(60)]
    return rows + list(more)


def test_the_corpus_decides(spark):
    """A shape no pattern knows is personal where its fields say so; the same digits as an order number are not."""
    df = spark.createDataFrame(numbers(("p", "x", "Keep 7415-9999 and Z77/99999/Q and +49 30 23125 999.", None, None, None, None)), S)
    found = privacy.cut(privacy.read(privacy.values(df, ["page_id", "element_id"])))
    share = {(r["form"], r["term"]): (r["type"], r["share"]) for r in privacy.form_disclosure(found).collect()}
    assert share["number", "9999-9999"][1] < 0 < 0.2 < share["phone", "+99 99 99999 999"][1]
    got = {(r["field"], r["pii_type"]) for r in privacy.findings(df).filter("element_id = 'x'").collect()}
    assert got == {("text", "phone"), ("text", "id")}


def test_other_scripts_stay(spark):
    """Only the finding is replaced, whatever the script or the disguise around it."""
    rows = [("p", "r", "Москва и СССР: пишите на ivan@x.example, \u2003спасибо", None, None, None, None), ("p", "f", "Ｍａｉｌ： ｋｏｆｉ＠ｘ．example  ＯＫ", None, None, None, None)]
    got = {r["element_id"]: r["redacted"] for r in privacy.redacted(spark.createDataFrame(rows, S)).collect()}
    assert got == {"r": "Москва и СССР: пишите на [EMAIL], \u2003спасибо", "f": "Ｍａｉｌ： [EMAIL]  ＯＫ"}


def test_overlapping_names(spark):
    rows = [("n", f"e{i}", f"talia.quist{c}@x.example", None, None, None, None) for i, c in enumerate("abcdefgh")]
    rows += [("p", "1", "Signed: Mr Talia Quistholt Marnow. Bye", None, None, None, None)]
    got = {r["element_id"]: r["redacted"] for r in privacy.redacted(spark.createDataFrame(rows + ROWS, S)).filter("page_id = 'p'").collect()}
    assert got["1"].count("[NAME]") >= 1 and "Talia" not in got["1"] and "Quistholt" not in got["1"]
