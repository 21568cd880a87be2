import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import jq
from lodestone.functions import text as X
from lodestone.operators import metrics


def column(spark, values, f, kind="string"):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], f"t {kind}").select(f(F.col("t")).alias("x")).collect()]


@pytest.mark.parametrize(
    ("text", "width"),
    [("a\n  b\n    c", 2), ("a\n    b\n        c", 4), ("a\n        b", 8), ("a\n   b\n      c", 3), ("\tb\n\t\tc", None), ("a\n\tb\n  c", 2), ("a\nb", None), ("", None), ("   \n  x", 2), ("a\n      b\n    c", 2), (None, None)],
)
def test_indentation(spark, text, width):
    assert column(spark, [text], X.indentation) == [width]


def test_spaces_to_tabs(spark):
    cases = {"a\n    b\n        c": "a\n\tb\n\t\tc", "a\nb": "a\nb", "a\n  b\n   c": "a\n  b\n   c".replace("  b", "\t\tb").replace("   c", "\t\t\tc"), "\n    x  y\n": "\n\tx  y\n", None: None}
    assert column(spark, list(cases), X.spaces_to_tabs) == list(cases.values())
    assert column(spark, ["a\n     b"], lambda c: X.spaces_to_tabs(c, 4)) == ["a\n\t b"]


def test_has_space_indentation(spark):
    assert column(spark, ["  a", "a\n  b", "a b", "\ta", "", "x" * 5000 + "\n  y"], X.has_space_indentation) == [True, True, False, False, False, False]


def test_normalizers(spark):
    assert column(spark, ["  a  b\n\nc ", "", None], X.whitespace) == ["a b c", "", None]
    assert column(spark, ["__label__My  Label", " X ", "__label____label__y"], X.normalize_label) == ["my_label", "_x_", "__label__y"]
    assert column(spark, ["__label__a b __label__c"], X.unwrap_labels) == ["a b c"]
    assert column(spark, ["cafÃ© â€™s “q” ﬁn\x07\r\n"], X.plsfix) == ["café 's \"q\" fin\n"]
    assert column(spark, ["Été\n\n\n\nnaïve\tx  y", None], X.get_normalizer("potion")) == ["ete¶naive↦x y", None]
    assert column(spark, ["a\n    é\n"], X.get_normalizer("potion-code")) == ["a¶↦e¶"]
    with pytest.raises(ValueError, match="unknown"):
        X.get_normalizer("nothing")
    with pytest.raises(ValueError, match="already"):
        X.register_normalizer("whitespace")(lambda c: c)


def test_tokenizer_normalizer(spark):
    import public_tokenizers

    X.register_tokenizer_normalizers(public_tokenizers.path("word_bpe_49k.json"))
    assert column(spark, ["Hello wörld", None], X.get_normalizer("hyperfine")) == ["hello</w> world</w>", None]
    assert set(X.list_normalizers()) >= {"whitespace", "plsfix", "potion", "potion-code", "tokenizer", "ultrafine", "hyperfine", "hyperfine-code"}


def test_sizes():
    assert [X.byte_size(s) for s in ("10", "1K", "1.5 kb", "2MB", "1 G", "1T")] == [10, 1024, 1536, 2 << 20, 1 << 30, 1 << 40]
    assert X.pretty_size(1536) == "1.50 KB"
    assert X.pretty_size(0) == "0.00 B"
    for bad in ("", "x", "-1K", "1X"):
        with pytest.raises(ValueError):
            X.byte_size(bad)


ROWS = [(1, 2.5, "ab", True, None), (2, None, "", False, "z"), (3, -1.0, None, None, "q")]


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        (".a", [1, 2, 3]),
        ('if .b < 2 then "lo" else "hi" end', ["hi", "lo", "lo"]),
        ('if .c then 1 elif .d then 2 else 3 end', [1, 1, 3]),
        (".e // .c", ["ab", "z", "q"]),
        (".c | length", [2, 0, 0]),
        (".b + 1", [3.5, 1.0, 0.0]),
        ("[.a, 2] | max", [2.0, 2.0, 3.0]),
        ('"n\\(.a)-\\(.c)"', ["n1-ab", "n2-", "n3-null"]),
        (".missing", [None, None, None]),
        (".c < 5", [False, False, True]),
        (".a == 1.0", [True, False, False]),
        ("(.a * 2 - 1) / 2", [0.5, 1.5, 2.5]),
        ("null < false", [True] * 3),
        ('."a"', [1, 2, 3]),
    ],
)
def test_expressions(spark, expression, want):
    df = spark.createDataFrame(ROWS, "a long, b double, c string, d boolean, e string").orderBy("a")
    assert [r[0] for r in df.select(jq.compile_expression(expression, df)).collect()] == want


@pytest.mark.parametrize("expression", [".a | map(.x)", "input", ".a[", "if .a then 1 end", "reduce .a", ".a @ 1", "{a: 1"])
def test_what_is_outside_the_language_is_refused(spark, expression):
    df = spark.createDataFrame(ROWS, "a long, b double, c string, d boolean, e string")
    with pytest.raises(jq.UnsupportedExpression):
        jq.compile_expression(expression, df)


def test_field_or_expression():
    assert jq.field_or_expression("x", None, ".text") == ".x"
    assert jq.field_or_expression(None, None, ".text") == ".text"
    with pytest.raises(ValueError):
        jq.field_or_expression("x", ".y", ".text")


def test_p_values():
    # Two degrees of freedom and one have closed forms.
    assert metrics.two_sided_p(0.5, 4) == pytest.approx(0.5)
    r, n = 0.3, 3
    t = r / math.sqrt((1 - r * r) / (n - 2))
    assert metrics.two_sided_p(r, n) == pytest.approx(1 - 2 * math.atan(t) / math.pi)


def test_tokens_and_words_of_python(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert column(spark, ["Hello world", "", None], X.token_counts(path)) == [2, 0, 0]
    assert column(spark, ["Héllo\n\n\n\nWorld", None], X.decoded_normalizer(path)) == ["hello</w> world</w>", None]
    byte_level = public_tokenizers.path("byte_bpe_50k.json")
    assert column(spark, ["A\n\n\n\nb\tc"], X.decoded_normalizer(byte_level)) == ["a \\n \\n b \\t c"]
    df = spark.createDataFrame([([1, None], {"a": 1.5}, True)], "l array<int>, m map<string,double>, b boolean")
    row = df.select(*(X.py_str(F.col(c), df.schema[c].dataType.simpleString()).alias(c) for c in df.columns)).first()
    assert (row.l, row.m, row.b) == ("[1, None]", "{'a': 1.5}", "True")
    assert [X.pretty_length(n) for n in (7, 1500, 2_500_000)] == ["7", "1.50K", "2.50M"]
    assert [X.pretty_time(n) for n in (5.9, 61, 90_061)] == ["5s", "1m 1s", "1d 1h 1m 1s"]
