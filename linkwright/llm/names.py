"""Variant spellings of organisation names: noisy-channel attribution to frequent spellings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.llm.reading import plain as plain_column
from linkwright.llm.splits import components
from linkwright.llm.wording import DIRECTIONS, FAMILY, FORM_OF_KIND, FORMAL_NAME, LEGAL, distance, plain, sound, variant_cost
from linkwright.operators.storage import durable

#: A word in at least this share of the names (and this many) is a common word, not part of a proper name.
COMMON_SHARE, COMMON_LEAST = 0.008, 20
#: A word that goes with one of its companions in this share of its names has a partner; if the companions other than
#: partners and their variants come to less than that share of its names, the word is one organisation's.
PARTNER_SHARE, OTHERS_SHARE = 0.2, 0.1
#: A whole name in at least this share of the rows (and this many) is a general label if its house numbers
#: are that share of the different ones to be expected of unrelated rows (and this many).
LABEL_SHARE, LABEL_LEAST, LABEL_PLACES, LABEL_NUMBERS = 0.0005, 8, 0.75, 4

_DBA = re.compile(r"\b(?:d/b/a|dba|d\.b\.a\.?|doing business as|trading as|t/a)\b")
_FORMERLY = re.compile(r"\(?\s*\b(?:f[o0]rmerly|f/k/a|fka|earlier|previously)\b.*")
_TITLE = re.compile(r"^\W*(?:m/s|messrs)\b\.?")
_PRIVATE = re.compile(r"\(p\)|\bp\.?(?=\s*(?:ltd|limited)\b)")
_DOTS = re.compile(r"(?<=\b[a-z])\.\s?(?=[a-z]\b)")
_WORD = re.compile(r"[a-z0-9]+")
_DIGIT = str.maketrans("015", "ols")


def name_words(text: str | None) -> list[str]:
    """The words of a name in lower case: what follows `dba`, without a former name and title."""
    if not text:
        return []
    s = plain(text)
    m = list(_DBA.finditer(s))
    if m and s[m[-1].end() :].strip(" .,-"):
        s = s[m[-1].end() :]
    s = _FORMERLY.sub("", s)
    s = _TITLE.sub("", s)
    s = _PRIVATE.sub(" pvt ", s.replace("'n'", " and "))
    s = _DOTS.sub("", s).replace("'", "")
    return [w.translate(_DIGIT) if not w.isdigit() else w for w in _WORD.findall(s)]


class Reader:
    """Splits names into proper words and trade words, given the common words of the corpus."""

    def __init__(self, common: list[str]) -> None:
        """common: the most frequent first; a word that is a variant of one before stands for that."""
        self.canon: dict[str, str] = {}
        kept: list[str] = []
        for w in common:
            if w in LEGAL or w in FAMILY or w in FORMAL_NAME:
                continue
            costs = [(c, k) for k in kept if (c := variant_cost(w, k)) is not None]
            if costs:
                self.canon[w] = min(costs)[1]
            else:
                kept.append(w)
                self.canon[w] = w
        self.common = kept
        self.letters = [(k, set(k)) for k in kept]
        self.trade = lru_cache(maxsize=1 << 18)(self._trade)

    def _trade(self, word: str) -> str | None:
        """The common word that `word` abbreviates or misspells: the least cost, then the most frequent."""
        letters, costs = set(word), []
        for i, (k, own) in enumerate(self.letters):
            # with another first letter only a typo is possible, which changes few letters
            if word[0] != k[0] and (len(word) < 5 or abs(len(word) - len(k)) > 2 or len(letters - own) > 2 or len(own - letters) > 2):
                continue
            if (c := variant_cost(word, k)) is not None:
                costs.append((c, i))
        return self.common[min(costs)[1]] if costs else None

    def read(self, text: str | None) -> tuple[list[str], list[str], str]:
        """(proper words in order, trade words ascending, given name)."""
        words = name_words(text)
        proper, trade, given, unsure = [], [], "", []
        for w in words:
            if w in FAMILY or w in LEGAL:
                continue
            if w in self.canon:
                trade.append(self.canon[w])
            elif w in FORMAL_NAME:
                given = given or FORMAL_NAME[w]
            else:
                proper.append(w)
        if not trade and proper:
            for i in [len(proper) - 1, *range(len(proper) - 1)]:
                c = self.trade(proper[i]) if len(proper[i]) > 1 else None
                if c and len(proper) > 1:
                    trade.append(c)
                    unsure.append(proper.pop(i))
                    break
        elif trade:  # the second word of a trade, abbreviated
            for i, w in enumerate(proper):
                if len(proper) > 2 and len(w) > 1 and (c := self.trade(w)) and c not in trade:
                    trade.append(c)
                    proper.pop(i)
                    break
        long = [w for w in proper if len(w) > 1]
        if len(long) > 2:  # a given name that is no known one, or is misspelt: names of persons come first
            for w in long:
                if any(len(f) >= 5 and distance(w, f, 1) <= 1 for f in FORMAL_NAME):
                    given = given or w
                    proper.remove(w)
                    break
            else:
                given = given or long[0]
                proper.remove(long[0])
            long = [w for w in proper if len(w) > 1]
        if len(long) >= 2:
            proper = long  # initials next to two whole words abbreviate a given name
        elif len(long) == 1 and len(proper) > 2:
            given = given or proper[0]
            proper = [*long, proper[-1] if len(proper[-1]) == 1 else proper[1]]
        return proper, sorted(set(trade)), given


_READ = T.StructType([T.StructField("proper", T.ArrayType(T.StringType())), T.StructField("sounds", T.ArrayType(T.StringType())), T.StructField("trade", T.ArrayType(T.StringType())), T.StructField("given", T.StringType())])


def name_reader(common: list[str]):
    """Arrow UDF: a name -> (proper words, how they sound, trade words, given name)."""

    @F.pandas_udf(_READ)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        r = Reader(common)
        for names in batches:
            rows = []
            for n in names:
                p, t, g = r.read(n)
                rows.append((p, [sound(w) for w in p], t, g))
            yield pd.DataFrame(rows, columns=["proper", "sounds", "trade", "given"])

    return read.asNondeterministic()  # filters on the result stay above it: every name is read once


def key_of(name: Column) -> Column:
    """The name in lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def house_number(address: Column) -> Column:
    """The first number of an address that is no postal code, unit or sector; '' if there is none."""
    text = F.regexp_replace(F.lower(address), rf"\b(?<!pin )(?<!zip )(\d{{5,6}})\b(?=(?: [a-d])?,?(?: (?:{'|'.join(DIRECTIONS)})\b\.?)? [a-z0-9]+ (?:{'|'.join(sorted(FORM_OF_KIND, key=len, reverse=True))})\b)", "x$1")
    a = F.regexp_replace(text, r"\b(suite|ste|shop|office|unit|floor|fl|sector|sec)\b[ .\-]*(no[. ]*)?\d+|(?<![x\d])\d{5,}(-\d+)?|\b\d{3} \d{3}\b", " ")
    return F.regexp_extract(a, r"\d+", 0)


def general_labels(named: DataFrame) -> list[str]:
    """Names (as `key_of`) that unrelated businesses share; fewer than 1 / LABEL_SHARE.

    named: (k, house). A label is frequent and has as many different house numbers as so many rows drawn
    from all would have, whatever their number; an organisation, branches included, has fewer. A name with
    a trade word of many organisations beside a word of its own is an organisation's, however many its places.
    """
    named = durable(named.select("k", "house"))
    n = named.count()
    housed = F.coalesce("house", F.lit("")) != ""
    per = named.groupBy("k").agg(F.count("*").alias("n"), F.count_if(housed).alias("m"), F.countDistinct(F.when(housed, F.col("house"))).alias("places"))
    often = durable(per.filter((F.col("n") >= max(LABEL_LEAST, LABEL_SHARE * n)) & (F.col("places") >= LABEL_NUMBERS)))
    # What so many rows drawn from all would show, on a grid of row counts: every number adds its chance of being drawn.
    total = named.filter(housed).count()
    grid = [1.25**i for i in range(math.ceil(math.log(max(2, total), 1.25)) + 1)]
    share = F.col("c") / F.lit(float(max(1, total)))
    chances = named.filter(housed).groupBy("house").agg(F.count("*").alias("c")).agg(*[F.sum(1 - F.pow(1 - share, F.lit(m))).alias(f"m{i}") for i, m in enumerate(grid)]).collect()[0]
    shown = [chances[i] or 0.0 for i in range(len(grid))]
    found = sorted(r["k"] for r in often.select("k", "m", "places").collect() if r["places"] >= LABEL_PLACES * float(np.interp(r["m"], grid, shown)))  # fewer than 1 / LABEL_SHARE
    if not found:
        return found
    # trade words of the other names; shorter ones are mostly misspelt labels
    trade = set(common_words(named.filter(~F.col("k").isin(found) & (F.size(F.split("k", " ")) > 2)).select("k")))
    own = lambda k: [w for w in k.split() if len(w) > 2 and w not in LEGAL and w not in FAMILY]
    return [k for k in found if not trade & set(own(k)) or not set(own(k)) - trade]


def common_words(names: DataFrame) -> list[str]:
    """Trade words: in many of the names (column `k`), beside many others; the most frequent first.

    Their number is below words per name / COMMON_SHARE. A word that goes nearly always with the same
    few, misspelt or shortened ones included, is an organisation's own, however many records it has.
    """
    n = names.count()
    some = F.array_distinct(F.split("k", " "))
    words = names.select(F.explode(some).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    often = {r["w"]: r["c"] for r in words.filter((F.col("c") >= max(COMMON_LEAST, COMMON_SHARE * n)) & (F.length("w") > 2)).orderBy(F.desc("c"), "w").collect()}
    filler = LEGAL | FAMILY
    asked = [w for w in often if w not in filler]
    if not asked:
        return list(often)
    # former names and the names before `dba` are those of others
    k = F.regexp_replace(F.regexp_replace("k", r" (?:f[o0]rmerly|f k a|fka|earlier|previously) .*", ""), r"^.* (?:dba|d b a|doing business as|trading as|t a) (?=.)", "")
    ws = F.filter(F.array_distinct(F.split(k, " ")), lambda w: (F.length(w) > 2) & ~w.isin(*filler))
    each = names.select(ws.alias("ws")).select("ws", F.explode(F.array_intersect("ws", F.array(*[F.lit(w) for w in asked]))).alias("w"))
    beside = durable(each.select("w", F.explode(F.filter("ws", lambda v: v != F.col("w"))).alias("v")).groupBy("w", "v").agg(F.count("*").alias("c")))
    count = F.element_at(F.create_map(*[F.lit(x) for w in asked for x in (w, often[w])]), F.col("w"))
    partners: dict[str, list[str]] = {}
    for r in beside.filter(F.col("c") >= PARTNER_SHARE * count).select("w", "v").collect():  # few a word
        partners.setdefault(r["w"], []).append(r["v"])
    bound = F.col("w").isin(*partners) if partners else F.lit(False)

    @F.pandas_udf(T.BooleanType())
    def other(w: pd.Series, v: pd.Series) -> pd.Series:
        """Whether `v` is neither a partner of `w` nor a writing of one, nor of `w`."""
        near = lambda x, y: x == y or (len(x) > 3 and (distance(x, y, 2) <= 2 or x.startswith(y) or x.endswith(y))) or variant_cost(x, y) is not None
        return pd.Series([not any(near(y, x) for x in (*partners[a], a)) for a, y in zip(w, v)], dtype=bool)

    free = {r["w"]: r["c"] for r in beside.filter(bound).filter(other("w", "v")).groupBy("w").agg(F.sum("c").alias("c")).collect()}
    alone = {r["w"] for r in beside.select("w").distinct().collect()}
    return [w for w, c in often.items() if w in filler or (w in alone and (w not in partners or free.get(w, 0) >= OTHERS_SHARE * c))]


def unlabelled(spelled: DataFrame, labels: list[str]) -> DataFrame:
    """Rows of `spelled` (k, as `key_of`) that are neither a label nor a misspelt one, words swapped or not.

    A misspelt label still begins or ends like one; there are fewer labels than 1 / LABEL_SHARE.
    """
    ends = lambda c: F.array(F.substring(c, 1, 3), F.substring(c, -3, 3))
    one = F.filter(F.split(F.translate(plain_column(F.col("k")), "015", "ols"), " "), lambda w: ~w.isin(sorted(LEGAL)))
    forms = spelled.select("k", F.explode(F.array_distinct(F.array(F.array_join(one, ""), F.array_join(F.reverse(one), "")))).alias("f"))
    known = spelled.sparkSession.createDataFrame([(re.sub(r"\W", "", x),) for x in labels], "label string").distinct()
    asked = forms.select("k", "f", F.explode(ends(F.col("f"))).alias("e"))
    near = asked.join(F.broadcast(known.select("label", F.explode(ends(F.col("label"))).alias("e"))), "e")
    d = F.levenshtein("f", "label", 3)
    swapped = (d == 2) & (F.array_sort(F.split("f", "")) == F.array_sort(F.split("label", "")))
    hit = near.filter(d.between(0, 2) & ((F.length("label") >= 8) | (d <= 1) | swapped))
    return spelled.join(hit.select("k").distinct(), "k", "left_anti")


def read_names(df: DataFrame, key: str, name: str, address: str) -> DataFrame:
    """(id, given, proper, sounds, trade) of each distinct name of each key; labels and nameless rows are left out."""
    rows = df.select(df[key].cast("string").alias("id"), df[name].alias("name"), key_of(df[name]).alias("k"), house_number(df[address]).alias("house")).filter("id is not null and k <> ''").distinct()
    rows = durable(rows)
    labels = general_labels(rows)
    spelled = rows.select("k").distinct()
    own = unlabelled(spelled, labels) if labels else spelled
    kept = durable(rows.select("id", "name", "k").distinct().join(own, "k"))
    read = name_reader(common_words(kept))
    forms = kept.select("name").distinct().select("name", read("name").alias("r"))
    return kept.join(forms, "name").select("id", "r.*").filter(F.size("proper") > 0).distinct()


# First guesses of what a change of a name costs, in units of log likelihood, and the largest sum a candidate may have by them.
# The rates that decide are learned from the corpus (`learned_costs`).
EDIT, SOUND, INITIAL, NO_TRADE, MERGED, SWAPPED, GIVEN, MOST = 1.2, 0.7, 2.5, 2.0, 1.0, 0.3, 0.7, 6.5
#: What can happen to a name, each with its first guess; a pair of names is a count of each.
CHANGES = {"edit": EDIT, "sound": SOUND, "initial": INITIAL, "merged": MERGED, "swapped": SWAPPED, "no_trade": NO_TRADE, "given": GIVEN}
_KINDS = T.StructType([T.StructField(k, T.IntegerType()) for k in ("edit", "sound", "initial", "merged", "swapped")])


@F.pandas_udf(_KINDS)
def channel_changes(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """How often each change makes the canonical words `b` the words `a`, the likeliest way; -1 throughout if that can't be."""
    never = (float("inf"), (-1,) * 5)

    @lru_cache(maxsize=1 << 14)
    def word(a: str, b: str) -> tuple[float, tuple[int, ...]]:
        if a == b:
            return 0.0, (0, 0, 0, 0, 0)
        if len(a) == 1 or len(b) == 1:
            return (INITIAL, (0, 0, 1, 0, 0)) if a[0] == b[0] else never
        sa, sb = sound(a), sound(b)
        if sa == sb:
            return SOUND, (0, 1, 0, 0, 0)
        short = min(len(a), len(b))
        most = 2 if short >= 6 else 1 if short >= 4 else 0
        d, e = distance(a, b, most), distance(sa, sb, most)
        if min(d, e) > most:
            return never
        return (EDIT * d, (d, 0, 0, 0, 0)) if d <= e + 0.5 else (EDIT * e + SOUND, (e, 1, 0, 0, 0))

    def both(x, y, more: int | None = None):
        if x[0] == never[0] or y[0] == never[0]:
            return never
        n = [p + q for p, q in zip(x[1], y[1])]
        if more is not None:
            n[more] += 1
        return x[0] + y[0] + (list(CHANGES.values())[more] if more is not None else 0.0), tuple(n)

    none = (0.0, (0, 0, 0, 0, 0))

    def whole(a: list[str], b: list[str]):
        if len(a) == 1 and len(b) == 2 and len(a[0]) > 9:
            return min(both(word(a[0], b[0] + b[1]), none, 3), both(word(a[0], b[1] + b[0]), none, 3))
        if len(b) == 1 and len(a) == 2 and len(b[0]) > 9:
            return min(both(word(b[0], a[0] + a[1]), none, 3), both(word(b[0], a[1] + a[0]), none, 3))
        if len(a) != len(b):
            return never
        if len(a) == 2:
            best = min(both(word(a[0], b[0]), word(a[1], b[1])), both(word(a[0], b[1]), word(a[1], b[0]), 4))
            return best if best[1][2] < 2 else never  # two initials name nobody
        total = none
        for x, y in zip(a, b):
            total = both(total, word(x, y))
        return total

    for a, b in batches:
        yield pd.DataFrame([whole(list(x), list(y))[1] for x, y in zip(a, b)], columns=_KINDS.names)


def learned_costs(fit: DataFrame, rounds: int = 3) -> DataFrame:
    """(pattern, cost): the cost of each pattern of changes, learned from the candidate pairs `fit` (form, n, to, to_rank, pattern, guess).

    Each round attaches every form to its candidate of largest posterior (prior of the candidate, cost of
    the pattern) and counts what changes the attachments show, weighed by the records of the form; the rate of a pattern
    among them, smoothed by the first guess, gives its cost. Patterns are counts of seven changes, so there are some hundreds of them, whatever the data.
    """
    spark = fit.sparkSession
    costs = fit.groupBy("pattern").agg(F.first("guess").alias("cost"), F.count("*").alias("seen")).toPandas().sort_values("pattern", ignore_index=True)
    guess = np.exp(-costs["cost"].to_numpy(float))
    guess = guess / guess.sum() if len(guess) else guess
    for _ in range(rounds):
        table = spark.createDataFrame(costs[["pattern", "cost"]], "pattern int, cost double") if len(costs) else None
        if table is None:
            break
        best = fit.join(F.broadcast(table), "pattern").groupBy("form").agg(F.max_by(F.struct("pattern", "n"), F.struct((F.log(F.col("to_rank.n").cast("double")) - F.col("cost")).alias("p"), F.col("to_rank"))).alias("x"))
        held = {r["pattern"]: r["c"] for r in best.groupBy("x.pattern").agg(F.sum(F.col("x.n")).alias("c")).collect()}
        seen = np.array([held.get(p, 0) for p in costs["pattern"]], float)
        rate = (seen + 50 * guess) / (seen.sum() + 50)
        costs["cost"] = -np.log(rate)
    return costs


def organisations(df: DataFrame, key: str, name: str, address: str) -> DataFrame:
    """(key, organisation): every record with a proper name, and the organisation it names.

    Null and blank names, general labels and their misspellings name none. The same row again
    changes nothing; a key sent under several spellings keeps one row per organisation. Only
    the three columns are read.

    Spellings that read alike (proper words, trade) are one form, however many records bear it. A
    form's records are its prior, its candidates the forms that are more complete or more
    frequent and share a block: trade with a proper word, with the beginnings of both, or with
    both run together; without the trade only if the form has none. Each form is attached to the
    candidate with the largest posterior: log prior less the channel's cost for typos,
    initials, swapped or joined words and a missing trade. Chains of attachments end at a canonical form.
    """
    read = durable(read_names(df, key, name, address))
    text = F.concat(F.concat_ws(" ", F.array_sort("proper")), F.lit("|"), F.concat_ws(" ", "trade"))
    initial = F.exists("proper", lambda w: F.length(w) == 1)
    read = read.withColumn("form", F.when(initial, F.concat(text, F.lit("|"), F.col("given"))).otherwise(text))
    forms = read.groupBy("form").agg(F.countDistinct("id").alias("n"), F.max("given").alias("given"), F.min(F.struct("proper", "sounds", "trade")).alias("x")).select("form", "n", "given", "x.*")
    whole = F.when((F.size("proper") >= 2) & (F.size(F.filter("proper", lambda w: F.length(w) == 1)) == 0), 1).otherwise(0) + F.when(F.size("trade") > 0, 1).otherwise(0)
    forms = durable(forms.withColumn("rank", F.struct(whole.alias("whole"), F.col("n").alias("n"), F.col("form").alias("form"))))
    long = F.filter("sounds", lambda w: F.length(w) > 1)
    starts = F.concat_ws("+", F.array_sort(F.transform("sounds", lambda w: F.substring(w, 1, 2))))
    ends = F.concat_ws("+", F.array_sort(F.transform("sounds", lambda w: F.substring(w, -2, 2))))
    joined = F.transform(F.array(F.concat_ws("", "sounds"), F.concat_ws("", F.reverse("sounds"))), lambda w: F.regexp_replace(w, r"(.)\1+", "$1"))
    letters = F.concat(F.lit("i"), F.concat_ws("+", F.array_sort(F.transform("sounds", lambda w: F.substring(w, 1, 1)))))
    pieces = F.concat(F.transform(long, lambda w: F.concat(F.lit("w"), w)), F.array(F.concat(F.lit("s"), starts), F.concat(F.lit("e"), ends)), F.transform(joined, lambda w: F.concat(F.lit("j"), w)))
    by_trade = F.flatten(F.transform("trade", lambda t: F.transform(pieces, lambda p: F.concat(t, F.lit("|"), p))))
    loose = F.transform(F.concat(F.transform(long, lambda w: F.concat(F.lit("w"), w)), F.transform(joined, lambda w: F.concat(F.lit("j"), w))), lambda p: F.concat(F.lit("?|"), p))
    by_letters = F.transform("trade", lambda t: F.concat(t, F.lit("|"), letters))
    spelled = lambda order: F.array_join(order(F.col("sounds")), "")
    runs = F.struct(spelled(F.array_sort).alias("sorted"), spelled(lambda c: c).alias("run"), spelled(F.reverse).alias("back"), F.exists("sounds", lambda w: F.length(w) == 1).alias("initial")).alias("runs")
    side = forms.select("form", "n", "proper", runs, "trade", "given", "rank", by_trade.alias("own"), loose.alias("loose"), by_letters.alias("letters"))
    asks = F.when(F.size("trade") == 0, F.col("loose")).when(initial, F.concat("own", "letters")).otherwise(F.col("own"))
    hashed = lambda keys: F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))
    left = side.select("form", "n", "proper", "runs", F.size("trade").alias("nt"), "given", "rank", F.explode(hashed(asks)).alias("key"))
    right = side.select(F.col("form").alias("to"), F.col("proper").alias("to_proper"), F.col("runs").alias("to_runs"), F.col("given").alias("to_given"), F.col("rank").alias("to_rank"), F.explode(hashed(F.concat("own", "loose", "letters"))).alias("key"))
    # Names that are far apart in letters, whichever order, can't be variants; initials and joined words are looked at in any case.
    alike = F.lit(False)
    for x, y in (("sorted", "sorted"), ("run", "run"), ("back", "run")):
        alike = alike | F.levenshtein(f"runs.{x}", f"to_runs.{y}", 5).between(0, 5)
    short = F.col("runs.initial") | F.col("to_runs.initial")
    both = left.join(right, "key").filter((F.col("rank") < F.col("to_rank")) & (short | alike)).drop("key", "runs", "to_runs").dropDuplicates(["form", "to"])
    both = both.withColumn("ch", channel_changes("proper", "to_proper")).filter("ch.edit >= 0")
    person = F.when((F.length("given") < 2) | (F.length("to_given") < 2), F.when(F.substring("given", 1, 1) == F.substring("to_given", 1, 1), 0).otherwise(1)).when(F.col("given") != F.col("to_given"), 2).otherwise(0)
    both = both.select("form", "n", "to", "to_rank", "ch.*", F.when(F.col("nt") == 0, 1).otherwise(0).alias("no_trade"), person.alias("given"))
    guess = sum((F.col(k) * w for k, w in CHANGES.items()), F.lit(0.0))
    digits = sum((F.least(F.col(k), F.lit(7)) * 8**i for i, k in enumerate(CHANGES)), F.lit(0))
    fit = durable(both.select("form", "n", "to", "to_rank", digits.cast("int").alias("pattern"), guess.alias("guess")).filter(F.col("guess") <= MOST))
    costs = learned_costs(fit)
    if len(costs):
        fit = fit.join(F.broadcast(fit.sparkSession.createDataFrame(costs[["pattern", "cost"]], "pattern int, cost double")), "pattern")
    else:
        fit = fit.withColumn("cost", F.col("guess"))
    parent = fit.groupBy("form").agg(F.max_by("to", F.struct((F.log(F.col("to_rank.n").cast("double")) - F.col("cost")).alias("p"), F.col("to_rank"))).alias("to"))
    linked = components(parent, "form", "to")
    roots = forms.select("form").join(linked.withColumnRenamed("node", "form"), "form", "left").select("form", F.coalesce("root", "form").alias("organisation"))
    return read.select("id", "form").join(roots, "form").select(F.col("id").alias(key), "organisation").distinct()
