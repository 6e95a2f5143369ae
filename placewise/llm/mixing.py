"""Mixing sources to target weights by iterative proportional fitting, in built-in functions only.

Documents fall into cells of source, language and topic. Raking starts from each cell's tokens and scales the cells so
that the token shares of each dimension in turn meet its target marginals, sweep after sweep, until all marginals hold
within TOLERANCE. A document's rate is its cell's
raked tokens, as a share of the token budget, over the cell's own tokens, so sampling documents at these rates gives the
target mix in expectation, and documents within a cell keep their natural proportions. A rate of 2.3 stands for two
copies and a third with probability 0.3.

Default targets are stated for each dimension by itself: shares of sources and languages to the power TEMPER, and shares of topics
mixed with equal ones (EVEN), which lifts rare values. Such marginals aren't those of any product of factors known beforehand, so the fit has to find the
factors. Where empty cells let no weights meet default targets, the sweeps' last weights stand (the last dimension's marginals hold);
targets that are given raise an error then.

Topics are learnt from the whole table, from which words go together. In all its different texts, words that
are neither rare nor everywhere in their language are counted, alone and in pairs. Pairs are counted by bits: of each block of texts a word has a
long for each 64 texts with a bit for each text that holds it, so a block makes a row for each pair of words whatever its texts. In each language TOPICS words of little lift among each other begin the topics, and all
others join the topics, of equally many words each, by their lift with those in them, in ROUNDS rounds; the first topics of all languages have one name, and so on. So topics don't
repeat languages, and cells of all languages and topics have documents. Every document is then on the topic that its words are of beyond
what is usual in its language (by standard deviations; of equal ones the first), and on OTHER if it has no such word. The model is an
entry for each of BUCKETS hashes of words, and a share for each language and topic.

The default budget is all tokens of the corpus. No document comes more than `repeats` times: a cell whose rate would
exceed that is held there, and the rest shares what the budget has left in the raked proportions. So a tiny cell that
targets lift a hundredfold takes nothing from the others. With repeats = 1 no document comes twice; give a budget below
all tokens then, since at that budget every rate would be 1.

Draws are hashes of seed, doc_id and text, so a task that runs again draws the same and repeated rows share their fate.
Texts are read twice, for the model and for the topics that it tells; of the first reading each different text's words are kept in the shared
folder, as hashes of two bytes, and of the second the rows with their topic and size. Documents meet their cell's rate
in a broadcast join while cells number at most BROADCAST_CELLS, else in a join that adaptive execution can split at hot
cells; no document moves in the first case. Per-cell sums are aggregated partially.

Defined results: a null source or language is a value of its own; a null or empty text has no words and counts one token,
so its cell has a rate; a text of any length counts whole; values that targets don't name get no tokens, and named values
without documents are left out with shares renormalised; an empty table gives no rows; other columns pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.llm._common import WORD, cut, fresh, let

DIMENSIONS = ("source", "lang", "topic")
#: Topics, hashes of words, words of a language that tell a topic, the texts that such a word may be in.
TOPICS = 6
BUCKETS = 4096
MODEL_WORDS = 200
LEAST_TEXTS, MOST_SHARE = 3, 0.5
ROUNDS = 5
#: Longs of a word in a block: texts of a block, by 64.
LANES = 4
OTHER = "other"
#: Default targets: shares of tokens to this power, then mixed with equal shares in this part.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
EVEN = {"topic": 0.5}
#: Values with less than so much of an equal share keep their own.
EVEN_FROM = 0.1
TOLERANCE = 1e-7
MAX_SWEEPS = 300
#: Sweeps for default targets: some tables have no weights that meet them.
DEFAULT_SWEEPS = 60
SWEEPS_TOGETHER = 3
BROADCAST_CELLS = 100_000
#: The most copies of a document.
REPEATS = 4.0

_NAMES = "abcdefghijklmnopqrstuvwxyz"[:TOPICS]


def _words(text: Column) -> Column:
    """Words of a text, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _bucket(word: Column) -> Column:
    return F.xxhash64(F.btrim(word, F.lit(".,;:!?"))).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def clusters(seen: Mapping[int, int], lift: Mapping[tuple[int, int], float]) -> dict[int, int]:
    """The topic of each word, of about equally many: seen has its texts, lift (ordered pairs) what is above or below 0 if words attract or avoid each other."""
    order = sorted(seen, key=lambda w: (-seen[w], w))
    of = lambda x, y: lift.get((min(x, y), max(x, y)), 0.0)
    begin: list[int] = order[:1]
    nearest = dict.fromkeys(order, -1e9)
    while begin and len(begin) < min(TOPICS, len(order)):
        for w in order:
            nearest[w] = max(nearest[w], of(w, begin[-1]))
        begin.append(min((w for w in order if w not in begin), key=lambda w: (nearest[w], -seen[w], w)))
    full = -(-len(order) // max(1, len(begin)))  # topics are of equal size, else the largest would draw in all words

    def joined(score: Callable[[int, int], float]) -> dict[int, int]:
        found: dict[int, int] = {}
        room = [full] * len(begin)
        for _, at, k in sorted((-round(score(w, k), 9), at, k) for at, w in enumerate(order) for k in range(len(begin))):
            if order[at] not in found and room[k]:
                found[order[at]] = k
                room[k] -= 1
        return found

    topic = joined(lambda w, k: 1e9 if w == begin[k] else of(w, begin[k]))
    for _ in range(ROUNDS):
        sums = {w: [0.0] * len(begin) for w in order}
        for (x, y), value in sorted(lift.items()):
            sums[x][topic[y]] += value
            sums[y][topic[x]] += value
        topic = joined(lambda w, k: sums[w][k])  # noqa: B023 - used at once
    return topic


@dataclass(frozen=True)
class Topics:
    letters: list[str]  # of each bucket: a topic's letter, or none
    usual: dict[str, list[float]]  # of each language: shares of topics among its words that tell one


def _pairs(sets: DataFrame, own: DataFrame) -> DataFrame:
    """(lang, x, y, count), x < y: the texts of sets (lang, held), as they are kept, that hold both of two own words (lang, w) of their language."""
    nth = F.monotonically_increasing_id()  # sets are kept in their order, so a task that runs again numbers them the same
    words = own.groupBy("lang").agg(F.collect_list("w").alias("words"))  # MODEL_WORDS at most
    texts = sets.select("lang", "held", nth.alias("nth")).join(F.broadcast(words), "lang").select("lang", "nth", F.explode(F.array_intersect("words", "held")).alias("w"))
    lane, bit = F.shiftright("nth", 6) % LANES, F.expr("shiftleft(1L, cast(nth & 63 as int))")
    marks = texts.groupBy("lang", F.floor(F.shiftright("nth", 6) / LANES).alias("block"), "w").agg(*(F.coalesce(F.bit_or(F.when(lane == k, bit)), F.lit(0).cast("long")).alias(f"bits{k}") for k in range(LANES)))
    blocks = marks.groupBy("lang", "block").agg(F.collect_list(F.struct("w", *(f"bits{k}" for k in range(LANES)))).alias("of"))
    both = blocks.select("lang", "of", F.explode("of").alias("x")).select("lang", "x", F.explode("of").alias("y")).where("x.w < y.w")
    count = sum((F.bit_count(F.col(f"x.bits{k}").bitwiseAND(F.col(f"y.bits{k}"))) for k in range(1, LANES)), F.bit_count(F.col("x.bits0").bitwiseAND(F.col("y.bits0"))))
    return both.groupBy("lang", F.col("x.w").alias("x"), F.col("y.w").alias("y")).agg(F.sum(count).alias("count"))


def learn_topics(docs: DataFrame) -> Topics:
    """The model of docs (text, lang)."""
    text, lang = F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit(""))
    held = F.array_distinct(F.transform(_words(text), lambda w: _bucket(w).cast("short")))
    once = docs.where(text.isNotNull()).select(F.xxhash64(F.lit(7), text).alias("h"), lang.alias("lang"), held.alias("held")).groupBy("h").agg(F.min("lang").alias("lang"), F.first("held").alias("held"))
    sets = cut(once.select("lang", "held").sortWithinPartitions("lang"))  # so that blocks are of one language, mostly
    texts = sets.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    counts = sets.select("lang", F.explode("held").alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).join(texts, "lang")
    first = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("n"), "lang")) == 1  # the language that has a word most
    telling = counts.withColumn("first", first).where(F.col("first") & (F.col("n") >= LEAST_TEXTS) & (F.col("n") <= F.greatest(F.lit(LEAST_TEXTS), MOST_SHARE * F.col("texts"))))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    own = cut(telling.withColumn("nth", nth).where(F.col("nth") <= MODEL_WORDS).select("lang", "w", "n", "texts"))
    pairs = _pairs(sets, own.select("lang", "w"))
    together: dict[str, dict[tuple[int, int], int]] = {}
    for r in pairs.collect():  # of each language MODEL_WORDS squared at most
        together.setdefault(r["lang"], {})[r["x"], r["y"]] = r["count"]
    words: dict[str, dict[int, tuple[int, int]]] = {}
    for r in own.collect():
        words.setdefault(r["lang"], {})[r["w"]] = (r["n"], r["texts"])
    letters, usual = [""] * BUCKETS, {}
    for name, of in sorted(words.items()):
        lift = {}
        for x, y in ((x, y) for x in of for y in of if x < y):
            expected = of[x][0] * of[y][0] / of[x][1]
            if expected >= 1:  # else too few texts tell
                lift[x, y] = math.log((together.get(name, {}).get((x, y), 0) + 0.5) / (expected + 0.5))
        topic = clusters({w: k for w, (k, _) in of.items()}, lift)
        total = sum(k for k, _ in of.values())
        usual[name] = [max(1e-3, sum(of[w][0] for w, t in topic.items() if t == k) / total) for k in range(TOPICS)]
        for w, k in topic.items():
            letters[w] = _NAMES[k]
    return Topics(letters, usual)


def topic(words: Column, lang: Column, model: Topics) -> Column:
    """The name of the topic that the words are of beyond what is usual in the language."""
    letters = F.split(F.lit(",".join(model.letters)), ",")
    told = F.array_join(F.transform(words, lambda w: F.get(letters, _bucket(w))), "")
    usual = F.lit([1.0 / TOPICS] * TOPICS)
    for name, shares in model.usual.items():
        usual = F.when(F.coalesce(lang.cast("string"), F.lit("")) == name, F.lit(shares)).otherwise(usual)

    def most(v: Column) -> Column:
        all_of = v["told"]
        n = F.length(all_of).cast("double")
        beyond = lambda x, i: ((n - F.length(F.replace(all_of, F.lit(x), F.lit(""))).cast("double")) - n * v["usual"][i]) / F.sqrt(n * v["usual"][i])
        scores = F.array(*(F.struct(F.round(beyond(x, i), 6).alias("beyond"), F.lit(-i).alias("at"), F.lit(f"topic_{x}").alias("name")) for i, x in enumerate(_NAMES)))
        return F.when(all_of == "", OTHER).otherwise(F.array_max(scores)["name"])

    return let(F.struct(told.alias("told"), usual.alias("usual")), most)


def features(doc_id: Column, text: Column, source: Column, lang: Column, model: Topics, seed: int) -> Column:
    """A struct of a document's cell, its tokens (words, one at least) and its draw from 0 to 1."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11).cast("double") / F.lit(float(1 << 53))
    made = lambda words: F.struct(
        source.cast("string").alias("source"), lang.cast("string").alias("lang"), topic(words, lang, model).alias("topic"), F.greatest(F.lit(1), F.size(words)).cast("double").alias("tokens"), draw.alias("draw")
    )
    return let(_words(whole), made)


def _with_targets(table: DataFrame, names: Sequence[str], targets: Mapping[str, Mapping[str, float]], temper: Mapping[str, float], even: Mapping[str, float]) -> DataFrame:
    """A column `to_<dimension>` for each: the target share of the row's value. Rows whose value a target leaves out go."""
    for d in names:
        if d in targets:
            pairs = [x for k, v in targets[d].items() for x in (F.lit(k), F.lit(float(v)))]
            wanted = F.coalesce(F.element_at(F.create_map(*pairs), F.col(d)), F.lit(0.0)) if pairs else F.lit(0.0)
            table = table.withColumn(f"to_{d}", wanted).where(F.col(f"to_{d}") > 0)
    table = cut(table)
    total = table.agg(F.sum("tokens")).first()[0]
    for d in names:
        if d not in targets:
            table = table.withColumn(f"to_{d}", F.pow(F.try_divide(F.sum("tokens").over(Window.partitionBy(d)), F.lit(total)), F.lit(temper.get(d, 1.0))))
    for d in names:
        values = table.groupBy(d).agg(F.max(f"to_{d}").alias("to"))
        whole, n = values.agg(F.sum("to"), F.count("to")).first()
        share = F.try_divide(f"to_{d}", F.lit(whole))
        mixed = 0.0 if d in targets else even.get(d, 0.0)
        if mixed and n:
            common = F.col("to") * n >= F.lit(whole * EVEN_FROM)
            mass, k = values.where(common).agg(F.sum("to") / F.lit(whole), F.count("to")).first()
            share = F.when(share * n >= EVEN_FROM, share * (1 - mixed) + mixed * mass / k).otherwise(share)
        table = table.withColumn(f"to_{d}", share)
    return table


def rake(table: DataFrame, names: Sequence[str] = DIMENSIONS, targets: Mapping[str, Mapping[str, float]] | None = None, temper: Mapping[str, float] = TEMPER, even: Mapping[str, float] = EVEN) -> DataFrame:
    """The rows of cells (names, tokens) with a target, and a column `weight`: the cell's raked share of all tokens."""
    if table.count() <= BROADCAST_CELLS:  # so few rows need no exchange between the steps of a sweep
        table = table.coalesce(1)
    fitted = cut(_with_targets(table, names, targets or {}, temper, even).withColumn("weight", F.col("tokens")))
    for _ in range(0, MAX_SWEEPS if targets else DEFAULT_SWEEPS, SWEEPS_TOGETHER):
        for _ in range(SWEEPS_TOGETHER):
            for d in names:
                fitted = fitted.withColumn("weight", F.try_divide(F.col("weight") * F.col(f"to_{d}"), F.sum("weight").over(Window.partitionBy(d))))
        fitted = cut(fitted)
        off = fitted.select(*(F.abs(F.sum("weight").over(Window.partitionBy(d)) / F.col(f"to_{d}") - 1).alias(d) for d in names)).agg(*(F.max(d) for d in names)).first()
        if max((x or 0.0 for x in off), default=0.0) <= TOLERANCE:
            return fitted.drop(*(f"to_{d}" for d in names))
    if not targets:
        return fitted.drop(*(f"to_{d}" for d in names))
    raise ValueError(f"no weights meet the targets: after {MAX_SWEEPS} sweeps the shares are off by up to {dict(zip(names, off, strict=True))}")


def rates(raked: DataFrame, budget: float | None = None, repeats: float = REPEATS) -> DataFrame:
    """A column `rate`: copies of each document of the cell that give `budget` tokens in the raked mix, `repeats` at most."""
    total, weight = raked.agg(F.sum("tokens"), F.sum("weight")).first()
    if not weight:
        return raked.withColumn("rate", F.lit(0.0))
    budget = total if budget is None else float(budget)
    factor, before = budget / weight, 0.0
    while factor > before * (1 + 1e-12):  # each round holds more cells, until none is added
        own = F.lit(factor) * F.try_divide("weight", "tokens")
        held, free = raked.agg(F.sum(F.when(own >= repeats, F.col("tokens") * repeats)), F.sum(F.when(own < repeats, F.col("weight")))).first()
        before, factor = factor, (budget - (held or 0.0)) / free if free else factor
    return raked.withColumn("rate", F.least(F.lit(float(repeats)), F.lit(factor) * F.try_divide("weight", "tokens")))


def copies(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float | None = None, repeats: float = REPEATS, seed: int = 42, keep_text: bool = True) -> DataFrame:
    """docs (doc_id, text, source, lang, any others) with a struct `mix` at the end: topic, tokens, rate, copies (0 or more).

    keep_text: whether the column text comes along.
    """
    own, mix = fresh(docs, "own"), fresh(docs, "mix")
    keyed = docs.withColumn(own, features(docs["doc_id"], docs["text"], docs["source"], docs["lang"], learn_topics(docs.select("text", "lang")), seed))
    keyed = cut(keyed if keep_text else keyed.drop("text"))
    names = [c for c in keyed.columns if c != own]
    table = keyed.select(*(F.col(f"{own}.{d}").alias(d) for d in DIMENSIONS), F.col(f"{own}.tokens").alias("tokens")).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    per_cell = cut(rates(rake(cut(table), DIMENSIONS, targets), budget, repeats).select(F.struct(*DIMENSIONS).alias("cell"), "rate"))
    if per_cell.count() <= BROADCAST_CELLS:
        per_cell = F.broadcast(per_cell)
    joined = keyed.join(per_cell, [keyed[own][d].eqNullSafe(F.col(f"cell.{d}")) for d in DIMENSIONS], "left")
    rate, draw = F.coalesce("rate", F.lit(0.0)), F.col(f"{own}.draw")
    # a rate that should be whole may be off in its last bits
    n = let(rate + F.lit(1e-9), lambda r: F.floor(r) + (draw < r - F.floor(r)).cast("long"))
    made = F.struct(F.col(f"{own}.topic").alias("topic"), F.col(f"{own}.tokens").cast("long").alias("tokens"), rate.alias("rate"), n.alias("copies"))
    return joined.select(*(keyed[c] for c in names), made.alias(mix))


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float | None = None, repeats: float = REPEATS, seed: int = 42) -> DataFrame:
    """The sampled documents, as often as they were drawn; columns as they were."""
    mixed = copies(docs, targets, budget, repeats, seed)
    n = mixed[mixed.columns[-1]]["copies"]
    return mixed.where(n > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), n)).alias(fresh(mixed, "copy"))).select(*docs.columns)
