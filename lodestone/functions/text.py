"""Text functions as Column expressions, and the registry of normalisers."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.repair import cut_and_repair, joined, segments

NORMALIZERS: dict[str, Callable[[Column], Column]] = {}
#: Tokens that chat templates reserve.
SPECIAL_TOKENS = ("<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|pad|>")


def register_normalizer(name: str) -> Callable:
    """Register a function from Column to Column; another function under a name that is taken is an error."""

    def add(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        if NORMALIZERS.get(name, f) is not f:
            raise ValueError(f"normaliser {name!r} is registered already")
        NORMALIZERS[name] = f
        return f

    return add


def get_normalizer(name: str) -> Callable[[Column], Column]:
    if name not in NORMALIZERS:
        raise ValueError(f"unknown normaliser {name!r}; known: {', '.join(sorted(NORMALIZERS))}")
    return NORMALIZERS[name]


def list_normalizers() -> list[str]:
    return sorted(NORMALIZERS)


@register_normalizer("whitespace")
def whitespace(c: Column) -> Column:
    """Runs of Unicode white space to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def truncate(c: Column, n: int | None) -> Column:
    """The first ``n`` code points."""
    return c if n is None else F.substring(c, 1, n)


def normalize_label(c: Column) -> Column:
    """Drop one leading __label__, white space runs to _, lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, "^__label__", ""), r"(?U)\s+", "_")))


def unwrap_labels(c: Column) -> Column:
    """A label marker inside a text would be read as a label: keep the word only."""
    return F.regexp_replace(c, r"\b__label__(\S+)\b", "$1")


def newlines_to_spaces(c: Column) -> Column:
    return F.translate(c, "\n\r", "  ")


def squeeze_newlines(c: Column) -> Column:
    """Three line feeds or more become two."""
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


@F.pandas_udf(T.StringType())
def repaired(s: pd.Series) -> pd.Series:
    """Cut after 2^20 characters at a line end; damaged UTF-8, curly quotes, ligatures, control characters, NFC."""
    return s.map(lambda t: None if t is None else cut_and_repair(t))


@register_normalizer("plsfix")
def plsfix(c: Column) -> Column:
    return repaired(c)


def strip_diacritics(c: Column) -> Column:
    """NFKD without combining marks."""
    return F.regexp_replace(nfkd(c), r"\p{Mn}", "")


def _spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " {2,}", " "))


@register_normalizer("potion")
def potion(c: Column) -> Column:
    t = strip_diacritics(F.lower(squeeze_newlines(repaired(c))))
    return _spaces(F.replace(F.replace(F.replace(t, F.lit("\n\n"), F.lit("¶")), F.lit("\n"), F.lit("·")), F.lit("\t"), F.lit("↦")))


def _tabbed(text: str) -> str:
    """:func:`spaces_to_tabs` in Python, for functions that are in Python anyway."""
    lines = text.split("\n")
    lead = [len(x) - len(x.lstrip(" ")) for x in lines]
    width = math.gcd(*(n for n, x in zip(lead, lines) if n and x.strip() and not x.lstrip(" ").startswith("\t")))
    return "\n".join("\t" * (n // width) + " " * (n % width) + x[n:] for n, x in zip(lead, lines)) if width else text


@F.pandas_udf(T.StringType())
def _plain_code(s: pd.Series) -> pd.Series:
    """Repaired, line feeds squeezed, without combining marks, indented by tabs."""
    def one(t: str) -> str:
        t = unicodedata.normalize("NFKD", re.sub("\n{3,}", "\n\n", cut_and_repair(t)))
        return _tabbed("".join(c for c in t if unicodedata.category(c) != "Mn"))

    return s.map(lambda t: None if t is None else one(t))


@register_normalizer("potion-code")
def potion_code(c: Column) -> Column:
    return F.replace(F.replace(_plain_code(c), F.lit("\n"), F.lit("¶")), F.lit("\t"), F.lit("↦"))


@register_normalizer("ascii")
def ascii_only(c: Column) -> Column:
    return F.regexp_replace(strip_diacritics(c), r"[^\x00-\x7F]", "")


def tokenizer_normalizer(path: str) -> Callable[[Column], Column]:
    """A normaliser that repairs a text and joins a local tokenizer's tokens with spaces; ``path`` must be readable on executors."""

    def tokens(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        kept = s.fillna("")
        out = [" ".join(e.tokens) for e in coder.encode_batch(kept.tolist(), add_special_tokens=False)]
        return pd.Series(out, index=s.index).where(s.notna(), None)

    udf = F.pandas_udf(tokens, T.StringType())
    return lambda c: udf(repaired(c))


def decoded_normalizer(path: str) -> Callable[[Column], Column]:
    """Each token decoded by itself, spaces between; lower case, without combining marks, separators as escapes."""

    def tokens(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)

        def one(t: str) -> str:
            t = re.sub("\n{3,}", "\n\n", t).lower()
            t = "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn")
            t = " ".join(coder.decode([i]) for i in coder.encode(t, add_special_tokens=False).ids)
            for c, said in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
                t = t.replace(c, said)
            return re.sub(" +", " ", t).strip()

        return s.map(lambda t: None if t is None else one(t))

    return F.pandas_udf(tokens, T.StringType())


def token_counts(path: str) -> Callable[[Column], Column]:
    """How many tokens of a local tokenizer a text has, without special ones; null: none."""

    def count(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        coder, out = Tokenizer.from_file(path), []
        kept = s.fillna("").tolist()
        for at in range(0, len(kept), 500):
            out += [len(e.ids) for e in coder.encode_batch(kept[at : at + 500], add_special_tokens=False)]
        return pd.Series(out, index=s.index, dtype="int64")

    return F.pandas_udf(count, T.LongType())


def segment_normalizer(path: str, code: bool = False) -> Callable[[Column], Column]:
    """Tokens segment by segment, the runs of tabs and line ends between them spelled out.

    Texts are repaired, without combining marks, and lower-cased with white space squeezed; of ``code``
    the case stays and indentation becomes tabs.
    """

    def tokens(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)

        def one(t: str) -> str:
            t = re.sub("\n{3,}", "\n\n", cut_and_repair(t))
            t = "".join(c for c in unicodedata.normalize("NFKD", t if code else t.lower()) if unicodedata.category(c) != "Mn")
            inner, after = segments(_tabbed(t) if code else t, squeeze=not code)
            return joined([e.tokens for e in coder.encode_batch(inner, add_special_tokens=False)], after)

        return s.map(lambda t: None if t is None else one(t))

    return F.pandas_udf(tokens, T.StringType())


def register_tokenizer_normalizers(path: str) -> None:
    """``tokenizer``, ``ultrafine``, ``hyperfine`` and ``hyperfine-code`` over a local tokenizer file."""
    NORMALIZERS["tokenizer"] = tokenizer_normalizer(path)
    NORMALIZERS["ultrafine"] = decoded_normalizer(path)
    NORMALIZERS["hyperfine"] = segment_normalizer(path)
    NORMALIZERS["hyperfine-code"] = segment_normalizer(path, code=True)


def has_space_indentation(c: Column, sample: int = 4096) -> Column:
    """Whether some line among the first ``sample`` characters begins with two spaces."""
    return F.startswith(c, F.lit("  ")) | F.contains(F.substring(c, 1, sample), F.lit("\n  "))


def indentation(c: Column) -> Column:
    """Greatest common divisor of the leading spaces of lines that are not blank and begin with spaces; null if none."""
    width = lambda x: F.length(x) - F.length(F.ltrim(x))
    lines = F.filter(F.split(c, "\n"), lambda x: (F.trim(F.regexp_replace(x, r"\s", " ")) != "") & ~F.rlike(x, F.lit(r"^ *\t")))
    widths = F.filter(F.transform(lines, width), lambda n: n > 0)
    gcd = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))), lambda s: s["a"])
    return F.nullif(F.aggregate(F.array_distinct(widths), F.lit(0), gcd), F.lit(0))


def spaces_to_tabs(c: Column, size: int | None = None) -> Column:
    """Leading spaces to tabs of ``size`` (found if not given) spaces; the remainder stays."""
    n = F.lit(size) if size else indentation(c)

    def line(x: Column, n: Column) -> Column:
        lead = F.length(x) - F.length(F.ltrim(x))
        return F.concat(F.repeat(F.lit("\t"), F.floor(lead / n).cast("int")), F.repeat(F.lit(" "), F.pmod(lead, n)), F.ltrim(x))

    # The width is bound once by a one-element array, not found again for each line.
    out = F.transform(F.array(n), lambda w: F.when(w.isNull(), c).otherwise(F.array_join(F.transform(F.split(c, "\n"), lambda x: line(x, w)), "\n")))
    return F.element_at(out, 1)


def sanitize_special_tokens(c: Column) -> Column:
    """Reserved tokens get spaces inside, so that no tokenizer reads them as such."""
    for t in SPECIAL_TOKENS:
        c = F.replace(c, F.lit(t), F.lit(" ".join(re.findall(r"<\||\w+|\|>", t))))
    return c


def remove_think(c: Column) -> Column:
    """From the first <think> to the last </think>; lone tags too."""
    return F.trim(F.replace(F.replace(F.regexp_replace(c, "(?s)<think>.*</think>", ""), F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit("")))


def strip_quotes(c: Column) -> Column:
    return F.trim(F.btrim(F.trim(c), F.lit('"')))


def character_list(c: Column) -> Column:
    """Comma-separated names, trimmed and sorted; one empty name is none."""
    return F.array_sort(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def truncate_at_line(c: Column, limit: int, reserve: int = 80) -> Column:
    """Cut at the last line feed before ``limit - reserve`` and say how much is left out."""
    head = F.substring(c, 1, limit - reserve)
    tail = F.length(F.substring_index(head, "\n", -1))
    kept = F.when(F.contains(head, F.lit("\n")), F.substring(head, F.lit(1), F.length(head) - tail - 1)).otherwise(head)
    left = F.length(c) - F.length(kept)
    rows = F.size(F.split(c, "\n")) - F.size(F.split(kept, "\n"))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(kept, F.lit("\n[truncated: "), left.cast("string"), F.lit(" characters, "), rows.cast("string"), F.lit(" lines]")))


@F.pandas_udf(T.StringType())
def _py_nested(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else str(json.loads(t)))


def py_str(c: Column, kind: str) -> Column:
    """A value as Python's str() writes it; of ``kind`` array, struct or map as its lists and dictionaries."""
    if kind == "boolean":
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if kind.startswith(("array", "struct", "map")):
        return _py_nested(F.to_json(c, {"ignoreNullFields": "false"}))
    return c.cast("string")


def byte_size(text: str) -> int:
    """``10``, ``1.5K``, ``2 GB``: units of 1024."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([KMGT]?)B?", text.strip(), re.I)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** " KMGT".index(m[2].upper() or " "))


def pretty_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024:
            return f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} PB"


def pretty_length(n: float) -> str:
    """A count in thousands, millions, and so on."""
    for unit in ("", "K", "M", "B"):
        if abs(n) < 1000:
            return f"{n:.2f}{unit}" if unit else f"{n:g}"
        n /= 1000
    return f"{n:.2f}T"


def pretty_time(seconds: float) -> str:
    """Days, hours, minutes and seconds, from the largest that is not 0."""
    whole, out = int(seconds), []
    for unit, size in (("d", 86_400), ("h", 3600), ("m", 60)):
        if whole >= size or out:
            out.append(f"{whole // size}{unit}")
            whole %= size
    return " ".join([*out, f"{whole}s"])
