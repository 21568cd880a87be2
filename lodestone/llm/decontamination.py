"""Benchmark decontamination by template canonicalisation, DataFrame functions only.

Numbers, the units after them and names (capitalised inside a sentence) become typed placeholders;
everything else is lower-cased letters and digits. Windows of ``WINDOW`` template tokens of the
documents are hash-joined with those of the benchmark items. Matches that lie on one diagonal
(document position minus item position) form an alignment, and an alignment counts only if its slots
are consistent: each value of the item stands for one value of the document (different ones may become equal).
A document is contaminated by an item when the windows of consistent alignments cover ``COVERAGE``
of the item's different windows. Windows with names are compared as plain words too, so a copy in another
case, where names do not show, is found. Slots that differ throughout mark a re-parameterised copy.

A null text counts as empty. Items with fewer than ``WINDOW`` tokens, or without a window that has
``LITERALS`` tokens that are not placeholders, identify nothing and never match. Repeated rows and
documents that share a doc_id count as one document; rows with a null doc_id too. Different texts under
one item id are looked for each; a null item id is no item. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import let, texts, written

WINDOW = 5
COVERAGE = 0.8
LITERALS = 2
#: Benchmark windows that are broadcast at most (about 100 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 200_000
#: A token that begins with SLOT is a placeholder: SLOT, its type, then the value.
SLOT = "\ue000"
#: Signs of money, shares and degrees, and the letters that stand for them in a unit's placeholder.
SIGNS, SPELT = "%$€£°", "\ue001\ue002\ue003\ue004\ue005"
#: Units of measure.
UNITS = "km/h|mph|kmh|km|cm|mm|nm|m|kg|mg|g|lbs|lb|oz|kilometers|kilometres|kilograms|meters|metres|miles|mile|feet|foot|inches|inch|yards|liters|litres|gallons|ml|l|hours|hour|hrs|hr|minutes|minute|mins|min|seconds|second|secs|sec|days|day|weeks|week|months|month|years|year|dollars|dollar|euros|euro|pounds|cents|usd|eur|gbp|percent|degrees|celsius|fahrenheit|watts|watt|kwh|kw|volts|amps|joules|newtons|pascals|moles|grams|gram|tons|tonnes"


def template(text: str) -> str:
    """SQL of the template tokens of column ``text``; placeholders keep their values."""
    sentence = r"(?=\\p{Lu})(?<=[\\p{Ll}\\p{N},;]\\s{1,8})(\\p{Lu}\\p{Ll}[\\p{L}]*)"
    named = f"regexp_replace({text}, '{sentence}', '{SLOT}m$1')"
    marked = rf"regexp_replace(regexp_replace(t, '(?<=[0-9])( ?)((?i:{UNITS}))(?![\\p{{L}}])', ' {SLOT}u$2'), '[0-9]+', ' {SLOT}n$0')"
    signs = f"regexp_replace({marked}, '(?<=[0-9]) ?([{SIGNS}])|([$€£])(?= ?{SLOT}n)', ' {SLOT}u$1$2')"
    # Signs would be split away as punctuation, so each becomes a letter of its own.
    spelt = f"translate({signs}, '{SIGNS}', '{SPELT}')"
    whole = let(named, "t", f"if(t rlike '[0-9]', {spelt}, t)")
    return rf"filter(split(lower({whole}), '[^\\p{{L}}\\p{{N}}\\ue000-\\ue005]+'), w -> w <> '')"


def windows(df: DataFrame, key: str) -> DataFrame:
    """``key, pos, h, slots, id, plain``: every window of the template tokens; slots (null: none) is the values by place.

    A window with names comes again as ``plain``, its names being lower-cased words: names that another
    case or place keeps from being placeholders match there. ``id`` is the window's first hash.
    """
    w = WINDOW
    slot, name = f"startswith(w, '{SLOT}')", f"startswith(w, '{SLOT}m')"
    part = f"slice(t, i + 1, {w})"
    hashed = lambda codes: f"xxhash64({', '.join(f'z.{codes}[i + {k}]' for k in range(w))})"
    values = f"if(z.s and exists({part}, w -> {slot}), transform({part}, w -> if({slot}, w, '')), null)"
    rest = f"transform({part}, w -> if({slot} and not {name}, w, ''))"
    places = f"if(size(t) < {w}, cast(array() as array<int>), sequence(0, size(t) - {w}))"
    each = f"transform({places}, i -> struct(i as pos, {hashed('h')} as h, {values} as slots, {hashed('h')} as id, false as plain))"
    again = f"transform(filter({places}, i -> exists({part}, w -> {name})), i -> struct(i as pos, {hashed('p')} as h, {rest} as slots, {hashed('h')} as id, true as plain))"
    plain = f"if(exists(t, w -> {name}), transform(t, w -> xxhash64(if({name}, substring(w, 3), if({slot}, substring(w, 1, 2), w)))), null)"
    coded = f"struct(transform(t, w -> xxhash64(if({slot}, substring(w, 1, 2), w))) as h, {plain} as p, exists(t, w -> {slot}) as s)"
    whole = let(template("text"), "t", let(coded, "z", f"if(z.p is null, {each}, concat({each}, {again}))"))
    return df.select(key, F.explode(F.expr(whole)).alias("x")).select(key, "x.*")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item, ipos, h, islots, id, n``: the items' windows that identify, n being the item's number of them.

    Different texts under one id are items of their own: ``item`` is the id and the text's hash.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("item_id is not null")
    items = items.select(F.struct("item_id", F.xxhash64("text").alias("of")).alias("item"), "text").distinct()
    every = written(windows(items, "item").withColumnsRenamed({"pos": "ipos", "slots": "islots"}), "items-windows")
    literal = F.when(F.col("islots").isNull(), WINDOW).otherwise(F.size(F.filter("islots", lambda s: s == "")))
    own = every.where(~F.col("plain") & (literal >= LITERALS))
    many = own.groupBy("item").agg(F.countDistinct("h").alias("n"))
    # A plain window stands for one that identifies, and counts as it.
    both = own.unionByName(every.where("plain").join(own.select("item", "ipos"), ["item", "ipos"], "left_semi"))
    return written(both.join(many, "item").select("item", "ipos", "h", "islots", F.col("id"), "n"), "items-counted")


def alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Matching windows gathered by document, item and diagonal: ``doc_id, item, n, hits, pairs, consistent``."""
    items = item_windows(benchmark)
    side = items
    if items.count() <= BROADCAST_WINDOWS:
        side = F.broadcast(items)
    matched = windows(texts(docs), "doc_id").select("doc_id", "pos", "h", "slots").join(side, "h")
    pair = F.when(F.col("slots").isNotNull(), F.arrays_zip(F.col("islots").alias("i"), F.col("slots").alias("d")))
    lines = (
        matched.withColumn("pairs", F.filter(pair, lambda p: p["i"] != ""))
        .groupBy("doc_id", "item", (F.col("pos") - F.col("ipos")).alias("diagonal"))
        .agg(F.first("n").alias("n"), F.collect_set("id").alias("hits"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    )
    distinct = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    # Different values of an item may become one value; one value never becomes two.
    one_each = distinct("i") == F.size("pairs")
    return lines.withColumn("consistent", one_each)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, covered, windows, reparameterised``: the items that each contaminated document has."""
    good = alignments(docs, benchmark).where("consistent")
    changed = F.exists("pairs", lambda p: p["i"] != p["d"])
    each = good.select("doc_id", "item", "n", changed.alias("changed"), F.explode("hits").alias("h"))
    pairs = each.groupBy("doc_id", "item", "n", "h").agg(F.min("changed").alias("changed")).groupBy("doc_id", "item", "n").agg(F.count("*").alias("covered"), F.max("changed").alias("reparameterised"))
    found = pairs.where(F.col("covered") >= coverage * F.col("n")).select("doc_id", "item.item_id", "covered", F.col("n").alias("windows"), "reparameterised")
    # Of different texts under one id the one that is covered most stands for it.
    best = F.max_by(F.struct("covered", "windows", "reparameterised"), F.struct(F.col("covered") / F.col("windows"), "covered", "reparameterised"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with all their columns, without the contaminated documents."""
    bad = written(contaminated(docs, benchmark, coverage).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_bad")), "left_anti")
