"""Text functions: tokens, set similarity, trigrams, labels, formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest texts kept, by use.
REVIEW_CHARS, BATCH_CHARS, VERIFIER_CHARS, GUARDRAIL_CHARS = 800, 350, 150, 120

#: White space of any kind, as characters and as the inside of a regular expression's class.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends (trim takes spaces only)."""
    return F.btrim(text, F.lit(WHITE))


def or_default(value: Column, default: object, empty: object = "") -> Column:
    """The default for null and for the type's empty value."""
    return F.coalesce(F.nullif(value, F.lit(empty)), F.lit(default))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once for each row: an expression named inside a lambda runs for every element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Lower-case words, split at white space of any kind."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[^{WHITE_CLASS}]+"), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def trigrams(text_words: Column, longer_than: int = 8) -> Column:
    """Strings of three neighbouring words, repeats included, that are longer than so many characters."""

    def of(w: Column) -> Column:
        heads = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        return F.transform(heads, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))

    return F.filter(let(text_words, of), lambda g: F.length(g) > longer_than)


def claim_aspect(claim: Column, aspect: Column | None = None) -> Column:
    """The stated aspect, else what stands before " - " in the claim, else the claim's first 35 characters."""
    own = F.when(F.contains(claim, F.lit(" - ")), F.substring_index(claim, " - ", 1)).otherwise(F.substring(claim, 1, 35))
    return own if aspect is None else F.coalesce(F.nullif(aspect, F.lit("")), own)


def slug(text: Column) -> Column:
    """Letters, digits, spaces, hyphens and underscores of a text, at most 30, as a file name."""
    kept = F.regexp_replace(text, r"[^\p{L}\p{N} _-]", "")
    return F.replace(strip(F.substring(kept, 1, 30)), F.lit(" "), F.lit("_"))


def ellipsis(text: Column, longest: int, kept: int) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, kept), F.lit("…"))).otherwise(text)


def joined(separator: str, *parts: Column) -> Column:
    """The parts that aren't blank."""
    return F.concat_ws(separator, *(F.nullif(p, F.lit("")) for p in parts))


def round_double(value: Column, digits: int) -> Column:
    """The double nearest to the value's exact binary expansion, rounded to so many decimals, halves to even: as Python's round.

    The value times a power of ten is taken without error, as a product and its rest (Dekker, 1971); the rest decides where
    the product looks like a tie. (round and bround go by a double's shortest decimal form: 2.675 is less than its form.)
    """
    scale = float(10**digits)
    part = lambda x: 134217729.0 * x - (134217729.0 * x - x)  # noqa: E731 - its upper 26 bits
    high, low = part(scale), scale - part(scale)

    def nearest(v: Column) -> Column:
        product, up = v["product"], v["high"]
        rest = ((up * high - product) + up * low + (v["size"] - up) * high) + (v["size"] - up) * low
        whole = F.floor(product).cast("double")
        beyond = product - whole - 0.5
        odd = whole % 2 == 1
        small = whole + ((beyond > 0) | ((beyond == 0) & ((rest > 0) | ((rest == 0) & odd)))).cast("double")
        large = product + F.when(odd & (F.abs(rest) == 0.5), F.signum(rest)).otherwise(0.0)  # the product is whole
        return F.when(product < float(1 << 52), small).otherwise(large) / scale

    size = F.abs(value)
    bound = let(F.struct(size.alias("size"), (size * scale).alias("product"), part(size).alias("high")), nearest)
    return F.when(F.isnan(value) | (size * scale >= float(1 << 53)), value).otherwise(F.when(value < 0, -bound).otherwise(bound)) + 0.0


def rounded(value: Column, digits: int) -> Column:
    """round_double of the value to nine decimals, which the order of summands doesn't change."""
    return let(value.cast("decimal(18,9)").cast("double"), lambda v: round_double(v, digits))


def percent(share: Column) -> Column:
    """A share as a whole percentage, halves to even."""
    return F.concat(F.bround(share.cast("decimal(18,9)") * 100, 0).cast("int").cast("string"), F.lit("%"))


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", rounded(value, 1))


def url_quote(text: Column) -> Column:
    """Percent-encoding with %20 for spaces and slashes as they are."""
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def json_object(raw: Column) -> Column:
    """The JSON object in an annotator's answer, as a string that parses; null if there is none.

    Drops thinking passages and code fences, then tries the text, its outermost braces, and last the text from
    its first brace with an open string, arrays and objects closed.
    """
    text = strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))
    fenced = strip(F.regexp_replace(F.split(text, "```")[1], r"^[json]+", ""))
    text = F.when(F.startswith(text, F.lit("```")), fenced).otherwise(text)
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    outer = F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), text.substr(first, last - first + 1))
    tail = F.when(first > 0, text.substr(first, F.length(text)))
    count = lambda c: F.length(tail) - F.length(F.replace(tail, F.lit(c), F.lit("")))
    closed = F.concat(
        tail, F.when(count('"') % 2 == 1, F.lit('"')).otherwise(F.lit("")),
        F.repeat(F.lit("]"), F.greatest(count("[") - count("]"), F.lit(0))), F.repeat(F.lit("}"), F.greatest(count("{") - count("}"), F.lit(0))),
    )
    parses = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(parses(text), parses(outer), parses(closed))
