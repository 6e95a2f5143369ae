"""Quality rules: a threshold table compiled into one projection.

Each rule names a metric, a comparison and a threshold. `verdict` compiles metrics and rules into a single
struct expression over the text column, made of built-in functions only, so the whole table of rules costs one
pass over the text and no shuffle. Metrics: lengths (words, characters in words), symbols, stop words, repeated lines,
lines that are list items, lines that trail off, and repeated five-word windows. Windows are compared by 64-bit hashes of
their words' hashes; two different windows of a text share one with chance 2 ** -64 for each pair.

Defined results: a null text counts as an empty one; texts with no words have ratios of zero and fail `few_words`;
texts of any length count whole, in memory in proportion to their length; repeated rows each get the same verdict; an empty
table gives no rows; other columns, whatever their names, pass through `keep`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.llm._common import WHITE, WORD, let

WINDOW = 5

#: Common function words of the four languages; a text of running prose in any of them holds many.
STOP_WORDS = tuple(
    """
    the of and to in a is that for it with as on be by at this from or are an was have not they which
    le la les de des du et en un une que qui dans pour par sur pas est au avec
    der die das und ist von mit den zu ein eine nicht auf im für dem sich auch
    el los las y del por con una para se no es al lo como su
    """.split()
)


@dataclass(frozen=True)
class Rule:
    """A document fails the rule if `metric op threshold` holds."""

    name: str
    metric: str
    op: str
    threshold: float


#: These decide `base_failed`.
BASE_RULES = (Rule("few_words", "n_words", "<", 10), Rule("repeated_words", "repeat_percent_words", ">", 20))

#: The method's own thresholds, on ratios. The stop-word ratio counts one more than found, so that short texts don't fail by chance.
RULES = (
    Rule("short_words", "chars_per_word", "<", 2.0),
    Rule("long_words", "chars_per_word", ">", 15.0),
    Rule("symbols", "symbols_per_word", ">", 0.3),
    Rule("few_stop_words", "stop_words_per_word", "<", 0.03),
    Rule("repeated_lines", "repeated_lines_per_line", ">", 0.5),
    Rule("list_lines", "list_lines_per_line", ">", 0.9),
    Rule("trailing_lines", "trailing_lines_per_line", ">", 0.5),
)

WHITE_CHARS = " \t\n\x0b\x0c\r"
#: What a list item begins with.
BULLETS = ("-", "*", "•", "‣", "▪", "●")

_OPS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def _repeated_words(words: Column) -> Column:
    """How many words stand in a window of WINDOW words that the text holds twice or more."""

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("at"))))

        def starts(s: Column) -> Column:
            again = F.filter(s, lambda e, i: (F.get(s, i - 1)["k"] == e["k"]) | (F.get(s, i + 1)["k"] == e["k"]))
            return F.sort_array(F.transform(again, lambda e: e["at"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.get(p, i + 1) - x))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(placed, lambda s: let(starts(s), total))

    def windows(h: Column) -> Column:
        heads = F.slice(h, 1, F.size(h) - (WINDOW - 1))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, WINDOW))))

    def counted(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(covered(keys))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), counted)))


def metrics(text: Column) -> Column:
    """A struct of the base counts and of the ratios that rules may name."""
    text = F.coalesce(text, F.lit(""))

    def from_parts(p: Column) -> Column:
        words, lines = p["words"], p["lines"]
        trails = lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(lines, lambda x: F.left(F.ltrim(x, F.lit(WHITE_CHARS)), F.lit(1)).isin(*BULLETS))).cast("long").alias("n_list_lines"),
            F.size(F.filter(lines, lambda x: trails(F.rtrim(x, F.lit(WHITE_CHARS))))).cast("long").alias("n_trailing_lines"),
        )

    def with_ratios(m: Column) -> Column:
        counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_list_lines", "n_trailing_lines"]
        per = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
        return F.struct(
            *(m[c].alias(c) for c in counts),
            per(m["word_chars"], m["n_words"]).alias("chars_per_word"),
            per(m["n_symbols"], m["n_words"]).alias("symbols_per_word"),
            per(m["n_stop_words"] + 1, m["n_words"]).alias("stop_words_per_word"),
            per(m["n_dup_lines"], m["n_lines"]).alias("repeated_lines_per_line"),
            per(m["n_list_lines"], m["n_lines"]).alias("list_lines_per_line"),
            per(m["n_trailing_lines"], m["n_lines"]).alias("trailing_lines_per_line"),
            per(100 * m["n_repeat_words"], m["n_words"]).alias("repeat_percent_words"),
        )

    has_word = rf"[^{WHITE}]"
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(has_word)).alias("lines"),
    )
    return let(parts, lambda p: let(from_parts(p), with_ratios))


def failed_rules(m: Column, rules: Sequence[Rule]) -> Column:
    """The names of the rules that the metrics struct fails, in the table's order."""
    return F.array_compact(F.array(*(F.when(_OPS[r.op](m[r.metric], F.lit(r.threshold)), F.lit(r.name)) for r in rules)))


def verdict(text: Column, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES) -> Column:
    """A struct: `m` (see metrics), `base_failed`, `failed` (names of failed rules, base ones first), `kept`."""

    def judge(m: Column) -> Column:
        return F.struct(m.alias("m"), failed_rules(m, base).alias("base"), failed_rules(m, rules).alias("own"))

    def decide(v: Column) -> Column:
        failed = F.concat(v["base"], v["own"])
        return F.struct(v["m"].alias("m"), (F.size(v["base"]) > 0).alias("base_failed"), failed.alias("failed"), (F.size(failed) == 0).alias("kept"))

    return let(metrics(text), lambda m: let(judge(m), decide))


def keep(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of docs that fail no rule, with their columns as they were."""
    return docs.where(verdict(docs[text], rules)["kept"])
