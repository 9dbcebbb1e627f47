"""Postal places: pairing the records that lie at one place, whatever way their addresses are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.reading import with_address
from linkwright.llm.splits import components
from linkwright.operators.storage import durable


def town_of_code(read: DataFrame) -> DataFrame:
    """(code, town): for each postal code the word that goes with it most, learned from the addresses.

    A town's name comes in most addresses of a code and in few others; a state's comes in many
    others. The word with the largest P(word | code) * P(code | word) is taken. Codes that occur a few
    times only, mistyped ones mostly, may point to a state that way; so a word counts as a town only
    if most of its addresses have a code that points to it, and codes then choose among towns.
    """
    words = read.filter("code <> ''").select("code", F.explode(F.array_distinct("rest")).alias("w"))
    both = durable(words.groupBy("code", "w").agg(F.count("*").alias("c")))
    by_word = both.groupBy("w").agg(F.sum("c").alias("nw"))
    scored = both.join(by_word, "w").withColumn("s", F.col("c") * F.col("c") / F.col("nw"))
    best = scored.groupBy("code").agg(F.max_by("w", F.struct("s", "w")).alias("town"))
    pointed = both.join(best, "code").groupBy("w").agg((F.sum(F.when(F.col("w") == F.col("town"), F.col("c"))) / F.sum("c")).alias("share"), F.sum("c").alias("n"))
    towns = pointed.filter("share > 0.5 and n > 1").select("w")
    return scored.join(towns, "w").groupBy("code").agg(F.max_by("w", F.struct("s", "w")).alias("town"))


def with_town(read: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """`read` (columns of `with_address`) with `town`: a known town's name among the other words,
    else the town of the postal code, else the known town that a word nearly spells, else ''."""
    codes = durable(town_of_code(learn_from if learn_from is not None else read))
    towns = codes.select("town").distinct()
    keyed = read.withColumn("__id", F.monotonically_increasing_id())
    words = keyed.select("__id", F.posexplode("rest").alias("at", "w"))
    exact = words.join(towns, words["w"] == towns["town"]).groupBy("__id").agg(F.min_by("town", "at").alias("__exact"))
    step = keyed.join(exact, "__id", "left").join(codes.withColumnRenamed("town", "__coded"), "code", "left")
    open_ = words.join(step.filter("__exact is null and __coded is null").select("__id"), "__id")
    near = None
    for cut in (lambda c: F.substring(c, 1, 2), lambda c: F.substring(c, -3, 3)):
        n = open_.withColumn("k", cut(F.col("w"))).join(towns.withColumn("k", cut(F.col("town"))), "k").select("__id", "town", F.levenshtein("w", "town").alias("d")).filter("d <= 2")
        near = n if near is None else near.unionByName(n)
    nearest = near.filter(F.length("town") >= 5).groupBy("__id").agg(F.min(F.struct("d", "town")).alias("m")).select("__id", F.col("m.town").alias("__near"))
    out = step.join(nearest, "__id", "left")
    return out.withColumn("town", F.coalesce("__exact", "__coded", "__near", F.lit(""))).drop("__id", "__exact", "__coded", "__near")


def _rarities(forms: DataFrame) -> DataFrame:
    """(word, weight): ln(N / forms with the word) over the words of all forms."""
    n = forms.count()
    words = forms.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    return words.select("word", F.log(F.lit(n + 1.0) / F.col("c")).alias("weight"))


def same_words(a: Column, b: Column) -> Column:
    """Two street words are one: they sound alike, or differ by two edits, one in words under six letters."""
    least = F.least(F.length(a), F.length(b))
    return (a == b) | (F.levenshtein(a, b) <= F.when(least >= 6, 2).when(least >= 4, 1).otherwise(0))


def places(df: DataFrame, key: str, address: str) -> DataFrame:
    """(key, place): every record whose address can be read, with the place it lies at.

    A place is a house number with its letter on a street (direction, kind) in a town. Repeated rows
    give one; a key sent with several writings of one place gives one, with several places one
    row each. Null, empty and unreadable addresses (no number or no street) give none. Only `key`
    and `address` are read.

    Equal readings are one form from the start, so a place with any number of records costs one
    form. Forms are blocked on their digits (number, letter, direction) plus one rare word: the
    street by sound with the town (without it only where one of the forms has no town), or the town with the street's beginning or end. Within a block, words that both
    have count by rarity; words left over must be near in spelling. A form then joins the most alike
    form that is more complete or more frequent; chains of these end at a place.
    """
    rows = df.select(df[key].cast("string").alias("id"), df[address].alias("__a")).filter("id is not null and __a is not null").distinct()
    read = durable(with_address(rows, "__a").drop("__a")).filter("number is not null")
    read = durable(with_town(read))
    part = ["number", "letter", "direction", "street", "street_sound", "kind", "town"]
    forms = read.groupBy(*part).agg(F.countDistinct("id").alias("n"))
    forms = forms.withColumn("form", F.concat_ws("|", "number", "letter", "direction", "street", "kind", "town"))
    forms = durable(forms.withColumn("words", F.filter(F.array("street", "kind", "town"), lambda w: w != "")))
    weights = _rarities(forms)
    rare = forms.select("form", F.explode("words").alias("word")).join(weights, "word").groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("weight"))
    full = forms.join(rare, "form")
    # More complete first, then more frequent; the form's text decides among equals.
    rank = F.struct((F.when(F.col("kind") != "", 2).otherwise(0) + F.when(F.col("town") != "", 1).otherwise(0)).alias("whole"), F.col("n").alias("n"), F.col("form").alias("form"))
    digits = F.concat_ws("/", "number", "letter", "direction")
    no_town, sound = F.col("town") == "", F.concat_ws("|", digits, F.lit("s"), "street_sound")
    # The street without a town is a key only where one of the two forms has none: else a street name of many towns would be one block.
    asks, answers = F.lit("any town"), F.lit("no town")
    in_town = [F.concat_ws("|", sound, "town"), F.concat_ws("|", digits, F.lit("b"), "town", F.substring("street", 1, 2)), F.concat_ws("|", digits, F.lit("e"), "town", F.substring("street", -3, 3))]
    left = F.when(no_town, F.array(F.concat_ws("|", sound, asks))).otherwise(F.array(F.concat_ws("|", sound, answers), *in_town))
    right = F.when(no_town, F.array(F.concat_ws("|", sound, asks), F.concat_ws("|", sound, answers))).otherwise(F.array(F.concat_ws("|", sound, asks), *in_town))
    ranked = durable(full.select("form", "street", "street_sound", "kind", "town", "words", "weight", rank.alias("rank"), left.alias("left"), right.alias("right")))
    a = ranked.withColumn("key", F.explode_outer("left")).drop("left", "right").alias("a")
    b = ranked.withColumn("key", F.explode_outer("right")).drop("left", "right").alias("b")
    both = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rank") < F.col("b.rank")))
    ok = both.filter(
        ((F.col("a.kind") == F.col("b.kind")) | (F.col("a.kind") == "") | (F.col("b.kind") == ""))
        & ((F.col("a.town") == F.col("b.town")) | (F.col("a.town") == "") | (F.col("b.town") == ""))
        & ((F.col("a.street_sound") == F.col("b.street_sound")) | same_words(F.col("a.street"), F.col("b.street")))
    )
    common = F.array_intersect("a.words", "b.words")
    zero = F.lit(0.0)
    overlap = F.aggregate(common, zero, lambda s, w: s + F.coalesce(F.element_at("a.weight", w), zero))
    spelled = F.when(F.col("a.street") == F.col("b.street"), zero).otherwise(
        F.least(F.element_at("a.weight", F.col("a.street")), F.element_at("b.weight", F.col("b.street"))) * (1 - F.levenshtein("a.street", "b.street") / F.greatest(F.length("a.street"), F.length("b.street")))
    )
    whole = F.least(*[F.aggregate(F.map_values(f"{x}.weight"), zero, lambda s, w: s + w) for x in "ab"])
    scored = ok.select(F.col("a.form").alias("form"), F.col("b.form").alias("to"), ((overlap + spelled) / whole).alias("score"), F.col("b.rank").alias("r")).filter("score >= 0.6")
    parent = scored.groupBy("form").agg(F.max_by("to", F.struct("score", "r")).alias("to"))
    linked = components(parent, "form", "to")
    of_form = forms.select("form", *part).join(linked.withColumnRenamed("node", "form"), "form", "left").select(*part, F.coalesce("root", "form").alias("place"))
    return read.join(of_form, part).select(F.col("id").alias(key), "place").distinct()


def pairs_within(members: DataFrame, key: str, group: str) -> DataFrame:
    """(entity_id_a, entity_id_b): every two different keys of one group, the smaller first."""
    a = members.select(F.col(key).alias("entity_id_a"), group)
    b = members.select(F.col(key).alias("entity_id_b"), group)
    return a.join(b, group).filter("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b").distinct()


def group_sizes(members: DataFrame, key: str, group: str) -> DataFrame:
    """(key, group, n_linked): every member with its group and how many others that has; no pair is made."""
    size = members.groupBy(group).agg((F.count("*") - 1).alias("n_linked"))
    return members.join(size, group).select(key, group, "n_linked")
