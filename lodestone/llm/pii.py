r"""Personal data by fixed patterns, and more of it by bootstrapped contextual extraction.

DataFrame functions only. The fixed patterns find e-mail addresses, IP addresses, card numbers
(Luhn) and phone numbers, leftmost and non-overlapping for each kind. Those are the seeds. Number-like
and address-like strings that overlap no seed are candidates; a candidate and a seed
have lexical patterns: the two words before, and the word before with the word after (letters and digits;
punctuation between them does not count). Patterns and
instances (distinct values) form a graph which is scored in rounds:

    confidence of a pattern for a kind = sum of its instances' scores for the kind / its instances
    score of a candidate               = 1 - product of (1 - confidence) over its trusted patterns

Seeds keep the score 1. A pattern is trusted if the scores it gathers reach ``SUPPORT`` and its
confidence ``TRUST``. Candidates that end at ``ACCEPT`` or more, and have the kind's shape, are added.

A null text counts as empty and has no spans. Repeated rows and repeated or null ids keep their own
rows; an empty table gives an empty result; other columns are ignored. Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import let, texts, written

#: The four base kinds in their order. A match starts where a run of its first class
#: does (or where the last match ended): from within the run it would end alike. Possessive where
#: nothing that follows could need a character back, so long runs neither backtrack nor recurse.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NUMBER = r"[+(]{0,2}[0-9](?:[\x20().:-]{0,2}[0-9]){3,}+"
#: Begins and ends with a letter or digit, so punctuation around an address is no part of it.
ADDRESS = r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}\x20?(?:@|\(at\)|\[at\])\x20?[\p{L}\p{N}](?:[\p{L}\p{N}.-]{0,62}[\p{L}\p{N}])?"
ROUNDS = 3
SUPPORT = 3.0
TRUST = 0.6
ACCEPT = 0.8
CONTEXT = 40


def running(lengths: str) -> str:
    """SQL of the sums of all elements before each of ``lengths``; in two levels, so long arrays stay cheap."""
    chunks = f"transform(sequence(0, (size({lengths}) - 1) div 64), c -> aggregate(slice({lengths}, cast(c * 64 + 1 as int), 64), 0, (s, x) -> s + x))"
    firsts = f"aggregate({chunks}, struct(cast(array() as array<int>) as a, 0 as s), (acc, x) -> struct(concat(acc.a, array(acc.s)) as a, acc.s + x as s), acc -> acc.a)"
    each = f"transform({lengths}, (x, i) -> f[i div 64] + aggregate(slice({lengths}, cast(i div 64 * 64 + 1 as int), i % 64), 0, (s, y) -> s + y))"
    return f"if(size({lengths}) = 0, cast(array() as array<int>), {let(firsts, 'f', each)})"


def located(pattern: str, gate: str, context: bool = False) -> str:
    """SQL of all matches in column text: start, end, value (and the text around them)."""
    around = f", substring(z.p[i], -{CONTEXT}) as before, substring(z.p[i + 1], 1, {CONTEXT}) as after" if context else ""
    spans = f"transform(z.m, (x, i) -> struct(b[i] + length(z.p[i]) as start, b[i] + length(z.p[i]) + length(x) as end, x as value{around}))"
    lengths = "transform(z.m, (x, i) -> length(z.p[i]) + length(x))"
    found = let(lengths, "n", let(running("n"), "b", spans))
    pattern = pattern.replace("\\", "\\\\")
    both = f"struct(split(text, '{pattern}', -1) as p, regexp_extract_all(text, '{pattern}', 0) as m)"
    extra = ", before: string, after: string" if context else ""
    return f"if({gate}, {let(both, 'z', found)}, cast(array() as array<struct<start: int, end: int, value: string{extra}>>))"


_DIGITS = "length(regexp_replace(x.value, '[^0-9]', ''))"
_LUHN = """aggregate(sequence(1, length(d)), 0, (s, i) -> s + if(i % 2 = 1, cast(substring(d, -i, 1) as int),
    cast(substring(d, -i, 1) as int) * 2 - if(cast(substring(d, -i, 1) as int) > 4, 9, 0))) % 10 = 0"""
#: Whether a match of a kind's pattern counts.
VALID = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), o -> length(ltrim('0', o)) <= 3 and coalesce(try_cast(ltrim('0', o) as int), 0) <= 255)",
    "card": f"{_DIGITS} between 13 and 19 and exists(array(regexp_replace(x.value, '[^0-9]', '')), d -> {_LUHN})",
    "phone": f"{_DIGITS} between 9 and 15",
}
#: What a candidate must look like to be added under a kind.
SHAPE = {
    "email": "locate('@', value) > 0 or locate('(at)', value) > 0 or locate('[at]', value) > 0",
    "ip": r"value rlike '^[0-9]{1,3}([.:-][0-9]{1,3}){3}$'",
    "card": "length(regexp_replace(value, '[^0-9]', '')) between 13 and 19",
    "phone": "length(regexp_replace(value, '[^0-9]', '')) between 7 and 15",
}


_DIGIT, _AT = "text rlike '[0-9]'", "contains(text, '@')"
_GATE = {"email": _AT, "ip": _DIGIT, "card": _DIGIT, "phone": f"({_DIGIT} and contains(text, '+'))"}


def _patterns(x: str) -> str:
    """SQL of the lexical patterns of a span ``x`` (before, after)."""
    word = rf"regexp_extract({x}.before, '([\\p{{L}}\\p{{N}}]+)[^\\p{{L}}\\p{{N}}]*$', 1)"
    two = rf"regexp_extract({x}.before, '([\\p{{L}}\\p{{N}}]+[^\\p{{L}}\\p{{N}}]+[\\p{{L}}\\p{{N}}]+)[^\\p{{L}}\\p{{N}}]*$', 1)"
    after = rf"regexp_extract({x}.after, '^[^\\p{{L}}\\p{{N}}]*([\\p{{L}}\\p{{N}}]+)', 1)"
    both = rf"if({two} = '', null, concat('2 ', lower(regexp_replace({two}, '[^\\p{{L}}\\p{{N}}]+', ' '))))"
    around = f"if({word} = '' or {after} = '', null, concat('1 ', lower({word}), ' _ ', lower({after})))"
    return f"filter(array({both}, {around}), p -> p is not null)"


def base(docs: DataFrame) -> DataFrame:
    """``doc_id, text, base``: base has an array of valid spans for each kind, with what stands around them."""
    each = ", ".join(f"filter({located(p, _GATE[k], True)}, x -> {VALID[k]}) as {k}" for k, p in KINDS.items())
    return texts(docs).withColumn("base", F.expr(f"struct({each})"))


def candidates(df: DataFrame) -> DataFrame:
    """``doc_id``, the base spans by kind, and the array ``found`` of seeds (all base spans) and candidates."""
    odd = f"({_AT} or contains(text, '(at)') or contains(text, '[at]'))"
    overlap = " or ".join(f"exists(k.{k}, s -> s.start < x.end and x.start < s.end)" for k in KINDS)
    shaped = lambda kind: f"struct({kind} as kind, x.start as start, x.end as end, x.value as value, {_patterns('x')} as patterns)"
    loose = f"filter(concat({located(NUMBER, _DIGIT, True)}, {located(ADDRESS, odd, True)}), x -> not ({overlap}))"
    own = [f"transform(k.{k}, x -> {shaped(repr(k))})" for k in KINDS]
    unknown = shaped("cast(null as string)")
    df = df.withColumn("found", F.expr(let("base", "k", f"concat({', '.join(own)}, transform({loose}, x -> {unknown}))")))
    spans = lambda k: F.expr(f"transform(base.{k}, x -> struct(x.start as start, x.end as end))").alias(k)
    return df.select("doc_id", *(spans(k) for k in KINDS), "found")


def bootstrapped(found: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, trust: float = TRUST, accept: float = ACCEPT) -> DataFrame:
    """``row, kind, start, end`` of the spans that contexts add; ``found`` has row and the array found."""
    each = found.select("row", F.explode("found").alias("c")).select("row", "c.*")
    each = each.withColumn("key", F.when(F.col("value").rlike("[0-9]{2}"), F.regexp_replace("value", r"[^0-9.@A-Za-z]", "")).otherwise(F.lower("value")))
    each = written(each, "pii-candidates")
    # Copies of a passage are one instance under one pattern.
    edges = written(each.select(F.explode("patterns").alias("pattern"), "key", "kind").groupBy("pattern", "key").agg(F.max("kind").alias("kind")), "pii-edges")
    scores = None
    for _ in range(rounds):
        seen = edges
        if scores is not None:
            seen = edges.join(scores, "key", "left")
        worth = lambda k: F.when(F.col("kind").isNotNull(), (F.col("kind") == k).cast("double")).otherwise(F.coalesce(F.col(f"s_{k}"), F.lit(0.0)) if scores is not None else F.lit(0.0))
        patterns = seen.groupBy("pattern").agg(F.count("*").alias("n"), *(F.sum(worth(k)).alias(f"w_{k}") for k in KINDS))
        strong = lambda k: (F.col(f"w_{k}") >= support) & (F.col(f"w_{k}") >= trust * F.col("n"))
        any_strong = strong("email") | strong("ip") | strong("card") | strong("phone")
        trusted = written(patterns.where(any_strong).select("pattern", *(F.when(strong(k), F.least(F.col(f"w_{k}") / F.col("n"), F.lit(0.999))).otherwise(0.0).alias(f"c_{k}") for k in KINDS)), "pii-patterns")
        reached = edges.where("kind is null").join(trusted, "pattern")
        scores = written(reached.groupBy("key").agg(*((1 - F.exp(F.sum(F.log1p(-F.col(f"c_{k}"))))).alias(f"s_{k}") for k in KINDS)), "pii-scores")
    best = F.array_max(F.array(*(F.struct(F.when(F.expr(SHAPE[k]), F.col(f"s_{k}")).otherwise(0.0).alias("s"), F.lit(k).alias("k")) for k in KINDS)))
    return each.where("kind is null").join(scores, "key").withColumn("best", best).where(F.col("best.s") >= accept).select("row", F.col("best.k").alias("kind"), "start", "end")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row of ``docs``.

    ``spans`` lists the base spans and those added by context as kind:start:end, by kind and start.
    """
    rows = written(candidates(base(docs)).withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    added = bootstrapped(rows.select("row", "found")).groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    listed = lambda column, kind: F.expr(f"transform({column}, x -> concat('{kind}:', x.start, ':', x.end))")
    first = F.array_join(F.concat(*(listed(k, k) for k in KINDS)), ",")
    both = {k: F.expr(f"array_sort(concat({k}, transform(filter(coalesce(added, array()), x -> x.kind = '{k}'), x -> struct(x.start as start, x.end as end))))") for k in KINDS}
    out = rows.drop("found").join(added, "row", "left").withColumns({f"_{k}": c for k, c in both.items()})
    spans = F.array_join(F.concat(*(listed(f"_{k}", k) for k in KINDS)), ",")
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(first, 256).alias("base_sha256"), spans.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).alias("n_added"))
