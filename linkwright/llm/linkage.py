"""Matching entities across sources without keys: votes of matching functions, a generative label model.

Each matching function votes on a candidate pair: 1 (for a match), -1 (against), 0 (no opinion). The
label model is a mixture of matches and others, in which votes depend on the class and on
one other vote (a dependency tree per class, chosen by mutual information). It is fitted by
expectation maximisation on the counts of vote patterns, without labels; their number is bounded
by 3 to the number of functions, whatever the data. The posterior of a pattern is its confidence.

Everything up to the counts of patterns is SQL: keys, joins and votes are Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations, permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.reading import given_name, plain, sounding, with_address, with_words
from linkwright.llm.wording import FORMAL_NAME
from linkwright.operators.storage import bloom_joins, durable, small_methods

#: The matching functions: of the organisation, then of the place.
NAME_VOTES, PLACE_VOTES = ["words", "near", "trade", "given"], ["place", "number", "direction", "street", "kind", "town", "code", "country"]
VOTES = [*NAME_VOTES, *PLACE_VOTES]
GROUPS = [list(range(len(NAME_VOTES))), list(range(len(NAME_VOTES), len(VOTES)))]
#: Votes against that hold by what a business and a place are: a word is missing, or a part of the address differs.
EXACT = tuple(VOTES.index(v) for v in ("near", "place", "number", "direction", "kind"))
#: A word in at least this share of the reference's distinct names (and this many) tells a trade.
TRADE_SHARE, TRADE_LEAST = 0.008, 20
#: How often a vote that holds by definition is against all the same.
SLIP = 1e-4
#: The reference rows of a key with more than this are joined in parts of about this size.
HOT_KEY = 64


class LabelModel:
    """Mixture over vote patterns with one binary latent per group of votes (one group by default).

    A match has all latents at 1. Votes of a group depend on the group's latent and on one other vote of
    the group (a tree of largest mutual information per class); the latents depend on each other through
    their joint prior. So agreement on names can't make up for two places, nor the other way round. An
    abstention says nothing, for its own vote as well as for the votes that depend on it.
    """

    def __init__(self, groups: list[list[int]] | None = None, exact: tuple[int, ...] = (), rounds: int = 90, smooth: float = 1.0) -> None:
        """exact: votes that by definition are hardly ever against where their latent is 1; that rate is set, not learned."""
        self.groups, self.exact, self.rounds, self.smooth = groups, exact, rounds, smooth

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        """patterns: one row per pattern with votes -1, 0, 1; counts: pairs with that pattern."""
        groups = self.groups = self.groups or [list(range(patterns.shape[1]))]
        v = patterns + 1
        # the first guess: votes for less votes against, in each group
        each = np.stack([1 / (1 + np.exp(-np.clip(patterns[:, g].sum(1) - 0.25 * len(g), -20, 20))) for g in groups])
        self._combos = np.array(np.meshgrid(*[[0, 1]] * len(groups), indexing="ij")).reshape(len(groups), -1).T
        post = np.stack([np.prod([each[g] if c else 1 - each[g] for g, c in enumerate(combo)], axis=0) for combo in self._combos], axis=1)
        self._trees = [[[-1] * len(g)] * 2 for g in groups]  # independent votes first
        for i in range(self.rounds):
            on = [post[:, self._combos[:, g] == 1].sum(1) for g in range(len(groups))]
            if i == self.rounds // 3:  # then correlations, learned from the classes found so far
                self._trees = [[self._tree(v[:, g], counts * (y if k else 1 - y)) for k in (0, 1)] for g, y in zip(groups, on)]
            self._estimate(v, counts, post, on)
            new = self._responsibilities(v)
            if i > self.rounds // 3 and np.abs(new - post).max() < 1e-6:
                break
            post = new
        return self

    def _tree(self, v: np.ndarray, w: np.ndarray) -> list[int]:
        """Parent of each vote in the tree of largest mutual information (-1: none)."""
        d, total = v.shape[1], w.sum() + 1e-9
        info = np.zeros((d, d))
        for a in range(d):
            for b in range(a):
                joint = np.zeros((3, 3))
                np.add.at(joint, (v[:, a], v[:, b]), w)
                joint = (joint + 1e-3) / (total + 9e-3)
                info[a, b] = info[b, a] = (joint * np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))).sum()
        parent, inside = [-1] * d, [0]
        while len(inside) < d:
            a, b = max(((a, b) for a in inside for b in range(d) if b not in inside), key=lambda x: info[x])
            parent[b] = a
            inside.append(b)
        return parent

    def _estimate(self, v: np.ndarray, counts: np.ndarray, post: np.ndarray, on: list[np.ndarray]) -> None:
        self.prior = np.log((post * counts[:, None]).sum(0) + 1.0)
        self.tables = []
        for g, y, trees in zip(self.groups, on, self._trees):
            self.tables.append([])
            for k in (0, 1):
                w, tables = counts * (y if k else 1 - y), []
                guess = np.array([1.0, 0.0, 9.0] if k else [6.0, 0.0, 4.0]) * self.smooth
                for x, p in zip(g, trees[k]):
                    alone = np.bincount(v[:, x], w, 3) + guess
                    alone[1] = 0
                    alone /= alone.sum()
                    t = np.zeros((3, 3))
                    if p >= 0:
                        np.add.at(t, (v[:, g[p]], v[:, x]), w)
                        t[1] = 0  # where the parent abstains, and where it is rare, a vote leans on its own rate
                        t[:, 1] = 0
                    t = t + 10 * self.smooth * alone
                    t = t / t.sum(1, keepdims=True)
                    if k and x in self.exact:
                        t[:, 0] = SLIP
                    t[:, 1] = 1
                    tables.append(np.log(t))
                self.tables[-1].append(tables)

    def _responsibilities(self, v: np.ndarray) -> np.ndarray:
        logs = np.tile(self.prior, (len(v), 1))
        for i, (g, trees, tables) in enumerate(zip(self.groups, self._trees, self.tables)):
            for k in (0, 1):
                s = sum(t[v[:, g[p]] if p >= 0 else 1, v[:, x]] for x, p, t in zip(g, trees[k], tables[k]))
                logs[:, self._combos[:, i] == k] += s[:, None]
        logs = np.exp(logs - logs.max(1, keepdims=True))
        return logs / logs.sum(1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that all latents are 1."""
        return self._responsibilities(patterns + 1)[:, -1]


def _close(a: Column, b: Column) -> Column:
    """Two words differ by typing only: two edits, one in words under six letters, none under four."""
    least = F.least(F.length(a), F.length(b))
    return F.levenshtein(a, b, 2).between(0, F.when(least >= 6, 2).when(least >= 4, 1).otherwise(0))


def _shortens(a: Column, b: Column) -> Column:
    """`a` begins like `b` and its letters come in `b` in that order: what is missing is all that differs."""
    return (F.length(a) >= 2) & (F.length(a) < F.length(b)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.levenshtein(a, b) == F.length(b) - F.length(a))


def _country(c: Column) -> Column:
    """US and India under one label each, other labels as they are; '' if there is none."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")
    return F.when(s.isin("us", "usa", "unitedstates"), "us").when(s.isin("in", "india", "ind"), "in").otherwise(s)


def trade_words(names: DataFrame) -> list[str]:
    """Words of many of the distinct names in column `name`: fewer than words per name / TRADE_SHARE.

    Names are counted once, so that an organisation of many branches doesn't make its own name common.
    """
    words = durable(with_words(names.select("name"), "name").select(F.col("words").alias("w")).distinct())
    n = words.count()
    per = words.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    return sorted(r["w"] for r in per.filter((F.col("c") >= max(TRADE_LEAST, TRADE_SHARE * n)) & (F.length("w") > 2)).select("w").collect() if r["w"] not in FORMAL_NAME)


def _own(df: DataFrame, trades: list[str]) -> DataFrame:
    """`df` with the words of column `name`: all (`words`), those of its own without trade and given name (`own`), and how these sound."""
    known = [*trades, *FORMAL_NAME]
    read = with_words(df, "name").withColumn("own", F.filter("words", lambda w: ~w.isin(known)))
    return read.withColumn("sounds", F.when(F.size("own") > 0, F.split(sounding(F.array_join("own", " ")), " ")).otherwise(F.array().cast("array<string>")))


def _sides(df: DataFrame, trades: list[str]) -> DataFrame:
    """Everything the matching functions look at: `_own`, `trade`, `given`, the fields of the address, the country."""
    read = with_address(_own(df, trades), "address")
    return read.select("*", F.filter("words", lambda w: w.isin(trades)).alias("trade"), given_name(F.col("words")).alias("given"), _country(F.col("country")).alias("land"))


def _ends(clean: bool) -> Column:
    """Beginnings of the words of a name, each with the first letter of another word, and the ends of two words:
    errors of typing leave one of these whole. A word that may be two asks without the letter, and clean ones answer to that too."""
    long = F.filter("sounds", lambda w: F.length(w) > 3)
    begin = lambda w, c: F.concat(F.lit("<"), F.substring(w, 1, 5), c)
    lone = long if clean else F.filter(long, lambda w: (F.length(w) > 9) | (F.size("sounds") == 1))
    others = lambda w: F.array_distinct(F.transform(F.filter("sounds", lambda v: v != w), lambda v: F.substring(v, 1, 1)))
    begins = F.flatten(F.transform(long, lambda w: F.transform(others(w), lambda c: begin(w, c))))
    ends = F.flatten(F.transform(long, lambda w: F.transform(F.filter(long, lambda v: v < w), lambda v: F.concat(F.lit(">"), F.least(F.substring(w, -4, 4), F.substring(v, -4, 4)), F.lit("+"), F.greatest(F.substring(w, -4, 4), F.substring(v, -4, 4))))))
    every = F.concat(begins, ends, F.flatten(F.transform(lone, lambda w: F.array(begin(w, F.lit("")), F.concat(F.lit(">"), F.substring(w, -5, 5))))))
    # the same, written out for the usual names, of two words or three: what is called for each word of an array is slow
    return F.when(_usual(2, clean), _written(2, clean, begin)).when(_usual(3, clean), _written(3, clean, begin)).otherwise(every)


def _usual(n: int, clean: bool) -> Column:
    """`sounds` has n words, each another; of hand-typed ones none that may be two."""
    words = [F.get("sounds", F.lit(i)) for i in range(n)]
    tests = [F.size("sounds") == n, *[v != w for v, w in combinations(words, 2)], *[F.length(w) < 10 for w in words if not clean]]
    return reduce(Column.__and__, tests)


def _written(n: int, clean: bool, begin: Callable[[Column, Column], Column]) -> Column:
    """What `_ends` makes of n such words; null stands for what a short word lacks."""
    words, long = [F.get("sounds", F.lit(i)) for i in range(n)], lambda w: F.length(w) > 3
    begins = [F.when(long(words[i]), begin(words[i], F.substring(words[j], 1, 1))) for i, j in permutations(range(n), 2)]
    tails = [(v, w, F.substring(v, -4, 4), F.substring(w, -4, 4)) for v, w in combinations(words, 2)]
    ends = [F.when(long(v) & long(w), F.concat(F.lit(">"), F.least(x, y), F.lit("+"), F.greatest(x, y))) for v, w, x, y in tails]
    lone = [F.when(long(w), k) for w in words for k in (begin(w, F.lit("")), F.concat(F.lit(">"), F.substring(w, -5, 5))) if clean]
    return F.array(*begins, *ends, *lone)


def _with_number(number: Column, words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(number, w))


def _named() -> Column:
    """Keys of names alone: a word with the first letter of another, and all run together."""
    long = F.filter("sounds", lambda w: F.length(w) > 1)
    pairs = F.flatten(F.transform(long, lambda w: F.transform(F.filter("sounds", lambda v: v != w), lambda v: F.xxhash64(F.lit("w"), w, F.substring(v, 1, 1)))))
    run = F.transform(F.array(F.concat_ws("", "sounds"), F.concat_ws("", F.reverse("sounds"))), lambda w: F.xxhash64(F.lit("j"), F.regexp_replace(w, r"(.)\1+", "$1")))
    return F.concat(pairs, run)


# The numbers of an address in group 1, but for those of suites and the like and split codes, where it is empty.
_NUMBERS = r"(?=[\dsuof])(?:(?<!\d)\d{5}-\d{4}(?!\d)|(?<!\d)\d{3} \d{3}(?!\d)|(?:sector|sec|shop|suite|ste|unit|office|floor|fl)[ .\-#]{0,2}(?:no[ .]*)?\d+|0*(\d{1,6})(?!\d|st|nd|rd|th))"


def _asked(df: DataFrame, trades: list[str]) -> DataFrame:
    """(h, k): the keys that each hand-typed row asks for. Numbers are those of the address but suites and the like.

    h: a hash of the row; should two rows share it, each is a candidate where the other is. A row with a number asks by it
    and the ends of its name's words, one without a name by number and code or number and word; a row without any number by its name.
    """
    read = _own(df.filter("name is not null or address is not null"), trades)
    read = read.withColumn("numbers", F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce("address", F.lit(""))), F.lit(_NUMBERS), F.lit(1)), lambda n: n != "")))
    # a house number of five digits and more is looked for where there is no shorter number
    read = read.withColumn("short", F.filter("numbers", lambda n: F.length(n) < 5))
    words = F.concat(F.filter("numbers", lambda n: F.length(n) > 4), F.filter(F.split(sounding(plain(F.col("address"))), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]")))
    numbered, named = F.size("numbers") > 0, F.transform(_named(), lambda k: k.cast("string"))
    asks = F.when(numbered & F.col("name").isNull(), words).when(numbered, _ends(False)).when(F.size("own") > 0, named)
    read = read.select(_row(), F.when(F.size("short") > 0, F.col("short")).otherwise(F.col("numbers")).alias("by"), F.array_distinct(asks).alias("asks"))
    # each number with each word: as rows, which are hashed by compiled code
    read = read.select("h", F.explode_outer("by").alias("n"), "asks").select("h", "n", F.explode_outer("asks").alias("w"))
    key = F.when(F.col("n").isNull(), F.col("w").cast("long")).otherwise(F.xxhash64("n", "w"))
    return read.filter("w is not null").select("h", key.alias("k"))


def _row() -> Column:
    return F.xxhash64("id", "name", "address", "country").alias("h")


def _candidates(answers: DataFrame, asks: DataFrame) -> DataFrame:
    """(h, arow, n) of all pairs of `answers` (arow, n, keys) and `asks` (h, k or keys) that share a key, each once.

    The clean rows of a key of more than HOT_KEY, which could make a block of any size, are divided into parts; a row that
    asks for it asks each part. No pair is lost by that.
    """
    # explode_outer: of explode a filter on the keys is inferred and pushed down, where all of them are computed twice
    left, right, on = durable(answers.select("arow", "n", F.explode_outer("keys").alias("k"))), asks if "k" in asks.columns else asks.select("h", F.explode_outer("keys").alias("k")), ["k"]
    hot = durable(left.groupBy("k").agg(F.count("*").alias("c")).filter(F.col("c") > HOT_KEY).select("k", F.ceil(F.col("c") / HOT_KEY).cast("int").alias("parts")))
    if not hot.isEmpty():
        parts, on = F.coalesce("parts", F.lit(1)), ["k", "part"]
        left = left.join(hot, "k", "left").select("arow", "n", "k", F.pmod(F.xxhash64("arow"), parts).cast("int").alias("part"))
        right = right.join(hot, "k", "left").select("h", "k", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return left.join(right, on).select("h", "arow", "n").distinct()


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def _voted(pairs: DataFrame) -> DataFrame:
    """`pairs` with `pattern`, the votes of the matching functions as digits to base 3, and `same_number`.

    Columns `a` (the clean side) and `b` (the hand-typed one) hold what `_sides` reads. What is looked at
    more than once is a column of its own.
    """
    c = F.col
    a_own, b_own, b_sounds = c("a.own"), c("b.own"), c("b.sounds")
    typed = lambda w, p: _close(w, p) | _close(sounding(w), sounding(p)) | ((F.length(w) > F.length(p) + 2) & (F.length(p) > 3) & w.contains(p))
    same = lambda x: c(f"a.{x}") == c(f"b.{x}")
    both = lambda x: (F.coalesce(c(f"a.{x}"), F.lit("")) != "") & (F.coalesce(c(f"b.{x}"), F.lit("")) != "")
    p = pairs.withColumns({
        "left": F.filter(a_own, lambda w, i: ~F.array_contains(b_sounds, F.get(c("a.sounds"), i))),
        "addressed": c("b.number").isNotNull() & c("a.number").isNotNull(),
        "same_number": F.coalesce(same("number") & same("letter"), F.lit(False)),
        "in_town": F.array_contains("b.rest", F.get("a.rest", F.lit(0))) | F.exists("b.rest", lambda w: _close(w, F.get("a.rest", F.lit(0)))),
    })
    p = p.withColumn("open", F.when(F.size("left") > 0, F.filter("left", lambda q: ~F.exists(b_own, lambda w: typed(w, q)))).otherwise(c("left")))
    runs = F.transform(F.array(F.array_join(a_own, ""), F.array_join(F.reverse(a_own), "")), sounding)
    joined = F.exists(b_own, lambda w: (F.length(w) > 9) & F.exists(runs, lambda r: F.levenshtein(r, sounding(w), 3).between(0, 3)))
    lost = F.exists("open", lambda q: ~F.exists(b_own, lambda w: (F.length(w) == 1) & (w == F.substring(q, 1, 1))))
    near = (F.size(a_own) > 0) & ((F.size("open") == 0) | ((F.size("open") < F.size(a_own)) & ~lost) | joined)
    has = F.size(b_own) > 0
    writes = lambda w, t: _shortens(w, t) | ((F.length(t) > 4) & _close(w, t)) | ((F.length(w) > 4) & (F.substring(w, 1, 5) == F.substring(t, 1, 5)))
    trade = F.arrays_overlap("a.trade", "b.words") | F.exists("a.trade", lambda t: F.exists("b.words", lambda w: writes(w, t)))
    given = same("given") | F.exists("b.words", lambda w: w == F.substring("a.given", 1, 1))
    elsewhere = F.exists("b.rest", lambda w: ~F.exists("a.rest", lambda v: _close(w, v)))
    at = c("addressed")
    p = p.withColumns({
        "words": _vote(has & (F.size("left") == 0) & (F.size(a_own) > 0), has),
        "near": _vote(near & has, has),
        "trade": _vote(trade, (F.size("a.trade") > 0) & (F.size("b.trade") > 0)),
        "given": _vote((c("a.given") != "") & given, both("given")),
        "number": _vote(at & c("same_number"), at),
        "direction": _vote(at & same("direction"), at),
        "street": _vote(at & (same("street_sound") | _close(c("a.street"), c("b.street"))), at),
        "kind": _vote(both("kind") & same("kind"), both("kind")),
        "town": _vote(at & c("in_town"), at & elsewhere & ~(both("code") & same("code"))),
        "code": _vote(both("code") & same("code"), both("code") & (F.levenshtein("a.code", "b.code") > 2)),
        "country": _vote(both("land") & same("land"), both("land")),
    })
    # the place as a whole: one part that differs makes another place
    p = p.withColumn("place", F.when(~at, 0).when(F.least("number", "direction", "street", "kind", "town") < 0, -1).otherwise(1))
    pattern = sum(((c(v) + 1) * 3**i for i, v in enumerate(VOTES)), F.lit(0))
    return p.select(*[x for x in pairs.columns if x not in ("a", "b")], "same_number", pattern.cast("int").alias("pattern"))


_SIDE = ["words", "own", "sounds", "trade", "given", "number", "letter", "direction", "street", "street_sound", "kind", "rest", "code", "land"]


def link(reference: DataFrame, records: DataFrame, key: str, name: str, address: str, country: str, *, only: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(reference key, `entity_id`, confidence): every record that is the same business at the same place.

    reference: the clean source, one row per business. only: keys of `reference` to look for (all
    by default); the others still count in deciding what a name or a place alone can tell. records: hand-typed, all
    columns nullable, rows repeated and sent again under other spellings: each distinct writing is
    judged, and the best confidence counts. Names without a word of their own match nothing.
    Column names of both tables may clash; they are never joined by name.

    Candidates share a number of the address and the beginning or end of a word of the name; only candidates are read in
    full. Records without a number are compared with the reference's distinct names. The label
    model decides: `least` is the smallest posterior returned. An exact check of what can be told follows: the house number must not differ; a record
    without an address takes the name with the largest posterior, if it is one name only and that of a single row;
    a record without a name matches where a single reference row lies at its place.
    """
    cols = [F.col(key).alias("id"), F.col(name).alias("name"), F.col(address).alias("address"), F.col(country).alias("country")]
    clean = reference.select(*cols).filter("id is not null").distinct()
    trades = trade_words(reference.select(*cols).filter("id is not null"))  # rows that are there twice change no word's share of the names
    with small_methods(reference.sparkSession):
        a = durable(_sides(clean, trades).select("id", *_SIDE).withColumn("arow", F.monotonically_increasing_id()))
    typed = records.select(*cols).filter("id is not null")
    mine = a.join(only.select(F.col(key).alias("id")).distinct(), "id", "left_semi") if only is not None else a
    # Each distinct name of the reference stands for its rows; n says how many these are.
    form = a.filter(F.size("own") > 0).groupBy(F.array_sort("own").alias("o"), F.array_sort("trade").alias("t"), "given").agg(F.count("*").alias("n"), F.min(F.struct("arow", "words", "own", "sounds")).alias("x")).select("n", "x.*")
    at_number = _with_number(F.col("number"), F.filter(F.array_distinct(F.concat(_ends(True), F.array("street_sound", "code"))), lambda w: F.length(w) > 0))
    answers = mine.filter("number is not null").select("arow", F.lit(0).cast("long").alias("n"), at_number.alias("keys"))
    answers = answers.unionByName(form.select("arow", "n", F.array_distinct(_named()).alias("keys")))
    with small_methods(reference.sparkSession):
        cand = durable(_candidates(answers, _asked(typed, trades))).filter("n >= 0")

    left = a.select("arow", F.struct(*_SIDE).alias("a"))
    # each row is read once, however many candidates it has; both joins are by h
    asked = _sides(typed.withColumn("h", _row()).join(cand, "h", "left_semi"), trades)
    held = asked.join(cand, "h").select("h", "arow", "n", F.col("id").alias("b_id"), F.struct(*_SIDE).alias("b")).join(left, "arow")
    held = held.withColumn("nameless", F.size("b.words") == 0)
    with bloom_joins(reference.sparkSession), small_methods(reference.sparkSession):
        voted = durable(_voted(held).withColumn("same_number", F.col("same_number") | (F.col("n") > 0)))
    seen = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()  # at most 3 ** len(VOTES) rows
    out = [F.col("id").alias(f"reference_{key}"), F.col("b_id").alias(key), "confidence"]
    if seen.empty:
        return a.limit(0).select("id", F.lit("").alias("b_id"), F.lit(0.0).alias("confidence")).select(*out)
    patterns = (seen["pattern"].to_numpy()[:, None] // 3 ** np.arange(len(VOTES)) % 3 - 1).astype(int)
    seen["confidence"] = LabelModel(GROUPS, exact=EXACT).fit(patterns, seen["n"].to_numpy(float)).posterior(patterns)
    rated = reference.sparkSession.createDataFrame(seen[["pattern", "confidence"]], "pattern int, confidence double")
    sure = voted.join(F.broadcast(rated), "pattern").filter((F.col("confidence") >= least) & F.col("same_number"))
    best = sure.filter("n > 0").groupBy("h", "b_id").agg(F.max(F.struct("confidence", "arow", "n")).alias("x"), F.max(F.struct("confidence", -F.col("arow"))).alias("y"))
    best = best.filter("x.arow = -y.col2 and x.n = 1").select(F.col("x.arow").alias("arow"), "b_id", "x.confidence")
    where = sure.filter("n = 0")
    alone = a.filter("number is not null").groupBy("number", "letter", "direction", "street_sound", "kind", F.get("rest", F.lit(0)).alias("town")).agg(F.count("*").alias("c"), F.min("arow").alias("arow")).filter("c = 1").select("arow")
    where = where.filter("not nameless").unionByName(where.filter("nameless").join(alone, "arow", "left_semi")).select("arow", "b_id", "confidence")
    found = where.unionByName(best).join(mine.select("arow", "id"), "arow")
    return found.groupBy("id", "b_id").agg(F.max("confidence").alias("confidence")).select(*out)
