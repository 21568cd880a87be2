"""Text repair: what is damaged, what is not, and very long texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import repair as R
from lodestone.functions import text as X

PLAIN = [
    "plain ascii text, 100% fine & well -- (really)", "", "naïve café, garçon, über, señor, ¿qué?", "CAFÉ» dit-il, «À BIENTÔT»", "20 °C ± 2, £5, €10, §3, ½ © 2020 Acme™",
    "Ünïcödé wörds: æ ø å ß ÿ œ", "Привет, мир", "Ελληνικά κείμενα", "日本語のテキスト。", "한국어 텍스트", "עברית", "العربية", "emoji 🙂🚀", "São Paulo, Åre, Ångström, Île, Über, Ñandú", "BÖ» und Ü«", "x² + y³ ≠ √z", "l’homme… – oui — non •", "“un été’” ou çœ–",
]


def damaged(text, codec="cp1252"):
    """UTF-8 read with a one-byte code page; bytes it lacks become the control characters of their numbers."""
    out = []
    for b in text.encode():
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("text", PLAIN)
def test_clean_text_is_left_alone(text):
    assert R.reread(text) == text


@pytest.mark.parametrize("text", [t for t in PLAIN if not t.isascii()])
@pytest.mark.parametrize("codec", ["cp1252", "latin-1"])
def test_damage_is_undone(text, codec):
    once = damaged(text, codec)
    assert R.reread(once) == text
    assert R.reread(damaged(once, codec)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abc éèàüñçœ’–привет🙂"), max_size=30))
def test_damage_of_mixed_text(text):
    assert R.reread(text) == text
    assert R.reread(damaged(text)) == text


@given(st.text(max_size=40))
def test_any_text_can_be_repaired(text):
    R.repair(text)


def test_cut_and_retry():
    line = "abcdefghi\n"
    assert R.cut_and_repair(line * 10, 25) == (line * 3)[:-1]
    assert R.cut_and_repair("x" * 50, 25) == "x" * 25
    assert R.cut_and_repair("short", 25) == "short"
    long = "é" * (R.CUT + 10) + "\nrest"
    assert R.cut_and_repair(long) == "é" * (R.CUT + 10)
    seen = []

    def fix(t):
        seen.append(len(t))
        if len(t) > 12:
            raise ValueError("too much")
        return t.upper()

    assert R.cut_and_repair("y" * 100, 50, fix) == "Y" * 12 and seen == [50, 25, 12]

    def never(t):
        raise ValueError("no")

    assert R.cut_and_repair("z" * 100, 50, never) == "z"


def test_segments():
    assert R.segments("a  b\n\tc\r\n", True) == (["a b", "c", ""], ["\n\t", "\r\n", ""])
    assert R.segments(" a  b ", False) == ([" a  b "], [""])
    assert R.spelled("\n\t") == "\\ n \\ t"
    assert R.joined([["x", "y"], []], ["\n", ""]) == "x y \\ n"


def test_segment_normalizers(spark):
    import public_tokenizers

    X.register_tokenizer_normalizers(public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame([("Hello  wÃ¶rld\n\n\n\nNext\tend\n",), (None,), ("",)], "t string")
    fine = [r[0] for r in df.select(X.get_normalizer("hyperfine")(F.col("t"))).collect()]
    assert fine == ["hello</w> world</w> \\ n \\ n next</w> \\ t end</w> \\ n", None, ""]
    code = spark.createDataFrame([("if x:\n    go\n        on",)], "t string")
    assert code.select(X.get_normalizer("hyperfine-code")(F.col("t"))).first()[0] == "if</w> x</w> :</w> \\ n \\ t go</w> \\ n \\ t \\ t on</w>"
