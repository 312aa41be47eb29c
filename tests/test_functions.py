import pytest
from pyspark.sql import functions as F

from pricelens.functions import cleaning, hooks, markup, prompts, scoring
from pricelens.functions.pytext import json_string, list_literal, money, quoted, strip

a = None


@pytest.fixture(autouse=True)
def input_column(spark):
    global a
    a = F.col("a")


@pytest.mark.parametrize("text, expected", [
    ("19.6", 19.6), (" 7 ", 7.0), ("1e2", 100.0), ("1_000", 1000.0), (".5", 0.5), ("5.", 5.0),
    ("None", None), ("12d", None), ("", None), ("$5", None), ("nan", None), ("1__0", None),
])
def test_number(one, text, expected):
    assert one(cleaning.number(a), a=text) == expected


@pytest.mark.parametrize("text", ["plain", "it's", 'say "x"', "both ' and \"", "a\nb\tc\r", "back\\slash", "nb\xa0sp", "zero​width", "é ü", "\U0001f600 ok", "\x07", "　", ""])
def test_quoted_is_the_printed_form(one, text):
    assert one(quoted(a), a=text) == repr(text)


def test_list_literal(one):
    assert one(list_literal(a), a=["a", "b's", 'c"']) == str(["a", "b's", 'c"'])
    assert one(list_literal(a), a=[]) == "[]"


@pytest.mark.parametrize("text", ["plain", 'q"b\\', "é", "\U0001f600", "tab\t", "\x01\x7f", "\n"])
def test_json_string(one, text):
    import json

    assert one(json_string(a), a=text) == json.dumps(text)


@pytest.mark.parametrize("text", ["  a ", "\x1f a\x85", "", "a​", "\n\n"])
def test_strip(one, text):
    assert one(strip(a), a=text) == text.strip()


@pytest.mark.parametrize("text, expected", [
    ("buy AB12345 now", "buy  now"), ("ABC1234567", ""), ("AB1234", "AB1234"), ("ABCDEFGH", "ABCDEFGH"),
    ("12345678 and X", " and X"), ("12345678\nX", "12345678\nX"), ("ABCDEFG then 5", " then 5"),
    ("éABC1234567", "éABC1234567"), ("x_ABC1234567", "x_ABC1234567"), ("abc12345678", "abc12345678"),
])
def test_strip_codes(one, text, expected):
    assert one(cleaning.strip_codes(a), a=text) == expected


@pytest.mark.parametrize("text, expected", [
    ("907.184 Grams", 2.0), ("5 stones", 0.0), ("x pounds", 0.0), ("5", 0.0), ("5 hundredths", 0.0), ("", 0.0), (None, 0.0),
    ("31 hundredths Pounds", 0.31), ("40 OUNCES", 2.5), ("7.5 Pounds extra", 7.5), ("0.453592 kilograms", 1.0),
])
def test_weight(one, text, expected):
    assert one(cleaning.weight_pounds(a), a=text) == pytest.approx(expected)


def test_details(one):
    text = '{"Brand": "Ünï", "Part Number": "X1", "n": 5, "ok": true, "none": null}'
    clean = cleaning.drop_noise_keys(cleaning.details_map(a))
    assert one(cleaning.details_json(clean), a=text) == '{"Brand": "\\u00dcn\\u00ef", "n": 5, "ok": true, "none": null}'
    import json

    text = '{"z": 5.0, "a": {"y": [1, 2.50, "p, q: r"], "b": "é"}, "z": "last", "e": {}, "f": [], "big": 1e5}'
    assert one(cleaning.details_json(clean), a=text).startswith('{"z": "last", "a": {"y": [1, 2.5')
    assert json.loads(one(cleaning.details_json(clean), a=text)) == json.loads(text)
    flat = '{"w": 5.0, "n": -3, "t": "5.0", "o": {"k": 1, "a": 2}}'
    assert one(cleaning.details_json(clean), a=flat) == json.dumps(json.loads(flat))
    twice = '{"Item Weight": "1 pounds", "Item Weight": "3 pounds"}'
    assert one(cleaning.weight_pounds(cleaning.detail_text(cleaning.details_map(a), "Item Weight")), a=twice) == 3.0
    assert one(cleaning.bad_details(a), a="{bad") is True
    assert one(cleaning.bad_details(a), a="") is False


def test_simplify(one):
    values = ["a  b", "c\nd", " e "]
    expected = str(values).replace("\n", " ").replace("\r", "").replace("\t", "").replace("  ", " ").strip()
    assert one(cleaning.simplify(a), a=values) == expected
    assert len(one(cleaning.simplify(a), a=["x" * 5000])) == 3000


@pytest.mark.parametrize("text, expected", [
    ("-5", 5.0), ("-5.5", -5.5), (".5", 0.5), ("somewhere near 310 or 320", 310.0), ("$88,000", 88000.0), ("unknown", 0.0), ("12.", 12.0),
])
def test_extract_price(one, text, expected):
    assert one(scoring.extract_price(a), a=text) == expected


def test_prompts(one):
    assert one(prompts.whole_dollars(a), a=20.5) == "20.00"
    assert one(prompts.whole_dollars(a), a=21.5) == "22.00"
    assert one(prompts.truncate(a, 2), a="red kettle with lid") == "red kettle"
    assert one(prompts.truncate(a, 5), a=" one  two ") == " one  two "
    assert one(prompts.completion(a, F.lit("train")), a=19.6) == "20.00"
    assert one(prompts.completion(a, F.lit("test")), a=19.6) == "19.6"
    full = prompts.training_prompt(a, F.lit(3.2))
    assert one(full, a="T") == "What does this cost to the nearest dollar?\n\nT\n\nPrice is $3.00"
    assert one(prompts.open_prompt(full), a="T").endswith("\n\nPrice is $")
    assert one(prompts.content_key(a), a="abc") == "a9993e364706816a"


@pytest.mark.parametrize("title, description, features, details, lines", [
    ("Kettle AB12345", ["Boils  water.\nFast.", "x"], ["Steel body! Nice"], '{"Brand": "Acme"}', ["Kettle ", "Acme", "Boils water.", "Steel body!"]),
    (" ", [], ["One. Two.", "Three"], '{"Part Number": "1", "Colour": "red"}', ["Unknown", "Unknown", "One.", "Three"]),
    ("T", None, ["Only one"], '{"Brand": " ", "Colour": "red", "Size": "2"}', ["T", "Unknown", "Only one", "Colour: red"]),
    ("T", ["  \t", "No end"], None, '{"Weight": 2.75}', ["T", "Unknown", "No end", "Weight: 2.75"]),
    ("T", [], [], "", ["T", "Unknown", "Unknown", "Unknown"]),
])
def test_summary_card(spark, title, description, features, details, lines):
    """Sections that are given, and each one missing."""
    row = spark.createDataFrame([(title, description, features, details)], "t string, d array<string>, f array<string>, m string")
    card = prompts.summary_card(F.col("t"), F.lit("Office_Products"), F.col("d"), F.col("f"), cleaning.details_map(F.col("m")))
    names = ("Title", "Brand", "Description", "Details")
    wanted = [f"{n}: {x}" for n, x in zip(names, lines)]
    assert row.select(card).first()[0].split("\n") == [wanted[0], "Category: Office Products", *wanted[1:]]


def test_context(one):
    near = F.array(F.struct(F.lit("A").alias("document"), F.lit(2.5).alias("price")))
    assert one(prompts.context_text(near)).endswith("\n\nPotentially related product:\nA\nPrice is $2.50\n\n")


@pytest.mark.parametrize("error, truth, band", [
    (10, 100, "green"), (60, 100, "orange"), (200, 100, "red"), (50, 500, "green"), (100, 300, "orange"), (90, 0, "red"),
])
def test_error_band(one, error, truth, band):
    assert one(scoring.error_band(F.lit(float(error)), F.lit(float(truth)))) == band


def test_titles(one):
    assert one(scoring.prompt_title(a), a="x Title: " + "t" * 50 + "\nrest") == "t" * 40 + "..."
    assert one(scoring.prompt_title(a), a="no heading") == "no heading"
    assert one(scoring.model_label(a), a="gpt__4o_mini") == "GPT.4O Mini"
    assert one(scoring.model_label(a), a="linear_regression_pricer") == "Linear Regression Pricer"


def test_money_rounds_half_even(one):
    assert [one(money(a), a=v) for v in (0.125, 2.5, 1234.5)] == ["$0.12", "$2.50", "$1234.50"]


def test_metrics_text(one):
    text = scoring.metrics_text(F.lit("M"), F.lit(1234.5), F.lit(2.0), F.lit(14550.2), F.lit(49.84))
    assert one(text) == "M: error=$1,234.50 ±$2.00 mse=14,550 r²=49.8%"


def test_markup(one):
    html = '<div class="snippet summary"><b>Good</b> <i>deal</i> &amp; more</div>'
    assert one(markup.clean_html(a), a=html) == "Good deal & more"
    nested = '<p>x</p><div class="snippet summary"><div>in &eacute;&#8364;</div> after &amp;lt;i&amp;gt; <script>no()</script><br>end</div> out'
    assert one(markup.clean_html(a), a=nested) == "in é€ after  end"
    assert one(markup.clean_html(a), a='<div class="summary">a</div>\nb') == '<div class="summary">a</div> b'
    assert one(markup.page_section(a), a='<article id="m">a<article>b</article>c</article>d') == "abc"
    assert one(markup.clean_html(a), a="plain\ntext") == "plain text"
    assert one(markup.page_section(a), a="<article><p>a</p>b</article>") == "ab"
    assert one(markup.page_section(a), a="<p>none</p>") == ""
    title, details, features = markup.deal_fields(F.lit("t" * 150), a)
    text = "Nice\nmore thing\nFeatures: x Features y"
    assert one(F.length(title), a=text) == 100
    assert one(details, a=text) == "Nice thing "
    assert one(features, a=text) == ": x Features y"
    assert one(features, a="none") == ""


def test_alerts(one):
    text = scoring.alert_text(a, F.lit(10.0), F.lit(100.0), F.lit(90.0), F.lit("u"))
    assert one(text, a="A long description") == "Deal Alert! Price=$10.00, Estimate=$100.00, Discount=$90.00 :A long des... u"
    assert one(scoring.notice_text(a, F.lit("u")), a="x" * 300) == "x" * 200 + "... u"


def test_retry_rules():
    assert hooks.pause("busy, try again in 2m7.25s or later", 4) == 127.75
    assert hooks.pause("Try again in 3s", 9) == 3.5
    assert [hooks.pause("no hint", n) for n in (1, 4, 5, 6, 500)] == [2.0, 16.0, 32.0, 60.0, 60.0]
    busy, broke = hooks.Retryable("slow down"), hooks.Retryable("Check your Billing page")
    assert [hooks.outcome(busy, n, 3, True) for n in (1, 2, 3)] == ["retry", "retry", "fail"]
    assert [hooks.outcome(broke, 1, 3, c) for c in (True, False)] == ["switch", "fail"]
    assert hooks.outcome(ValueError("slow down"), 1, 3, True) == "fail"
