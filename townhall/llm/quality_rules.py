"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Counts of a text are taken once, in the row that holds it: words, characters, symbols, stop words, lines and repeats.
A rule compares a count with a bound, or with a percentage of another count, in whole numbers. No row is
shuffled and no user function runs. Repeated windows are found by their hashes; only texts
in which two hashes are equal compare the windows themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall.llm.common import WORD, free_name

# Frequent function words of the four languages, as they stand inside and at the head of a sentence.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on with as he be at by this have from or an are not you",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le",
}
SYMBOLS = "#*$%&|<>"
WINDOW = 5  # words of a window that must not occur twice


@dataclass(frozen=True)
class Rule:
    """``least`` and ``most`` bound a count, or with ``per`` its percentage of that other count; a text with none of ``per`` passes."""

    name: str
    count: str
    per: str | None = None
    least: int | None = None
    most: int | None = None


# Base: both are part of the contract of the query. Others: bounds that clean prose of any length keeps.
BASE = (Rule("few_words", "n_words", least=10), Rule("repeated_windows", "n_repeat_words", "n_words", most=20))
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1200),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("words_without_letters", "n_bare_words", "n_words", most=30),
    Rule("stop_words", "n_stop_words", "n_words", least=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=30),
)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def stop_words() -> list[str]:
    """All listed words and their forms with a capital."""
    words = {w for text in STOP_WORDS.values() for w in text.split()}
    return sorted(words | {w[:1].upper() + w[1:] for w in words})


def _size(c: Column) -> Column:
    return F.size(c).cast("long")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window of ``width`` words that occurs twice or more in the list."""

    def windows(of: Column, at: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(of) - width), at)

    def named(hashes: Column) -> Column:
        return windows(hashes, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    def twice(found: Column) -> Column:
        """Structs (w, p) whose w occurs at another p, sorted."""
        near = lambda s, x, i: F.coalesce(F.get(s, i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False))
        return let(F.sort_array(found), lambda s: F.filter(s, lambda x, i: near(s, x, i)))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")

    def found(hashes: Column) -> Column:
        maybe = twice(F.transform(hashes, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
        exact = twice(F.transform(maybe, lambda x: F.struct(F.array_join(F.slice(words, x["p"] + 1, width), " ").alias("w"), x["p"].alias("p"))))
        return let(F.sort_array(F.transform(exact, lambda x: x["p"])), covered)

    none = F.lit(0).cast("long")
    some = lambda h: let(named(h), lambda n: F.when(F.size(F.array_distinct(n)) < F.size(n), found(n)).otherwise(none))
    return F.when(F.size(words) <= width, none).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), some))


def _line_counts(text: Column) -> Column:
    count = lambda lines, pattern: _size(F.filter(lines, lambda x: x.rlike(pattern)))
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda lines: F.struct(
        _size(lines).alias("n_lines"), (_size(lines) - _size(F.array_distinct(lines))).alias("n_dup_lines"),
        count(lines, r"^[\x20\x09]*[-*•]").alias("n_bullet_lines"), count(lines, r"(\.\.\.|…)[\x20\x09-\x0D]*$").alias("n_cut_lines")))


def counts(text: Column) -> Column:
    """A struct of all counts of a text, as whole numbers; a null text counts as an empty one."""
    stops = stop_words()
    bare = r"(?<=[\x20\x09-\x0D])[\x00-\x08\x0E-\x1F\x21-\x40\x5B-\x60\x7B-\x7F]+(?=[\x20\x09-\x0D])"

    def of(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
        by_word = let(words, lambda w: F.struct(
            _size(w).alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _size(F.filter(w, lambda x: x.isin(stops))).alias("n_stop_words"), repeated_words(w).alias("n_repeat_words")))
        symbols = F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long")
        return let(_line_counts(t), lambda x: let(by_word, lambda w: F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), symbols.alias("n_symbols"),
            (_size(F.split(F.concat(F.lit(" "), t, F.lit(" ")), bare)) - 1).alias("n_bare_words"), w["n_stop_words"].alias("n_stop_words"),
            x["n_lines"].alias("n_lines"), x["n_dup_lines"].alias("n_dup_lines"), x["n_bullet_lines"].alias("n_bullet_lines"),
            x["n_cut_lines"].alias("n_cut_lines"), w["n_repeat_words"].alias("n_repeat_words"))))

    return let(F.coalesce(text, F.lit("")), of)


def passes(found: Column, rule: Rule) -> Column:
    """Whether the counts keep a rule."""
    value, unit = found[rule.count], F.lit(1) if rule.per is None else found[rule.per]
    scale = 1 if rule.per is None else 100
    ok = F.lit(True)
    if rule.least is not None:
        ok &= value * scale >= unit * rule.least
    if rule.most is not None:
        ok &= value * scale <= unit * rule.most
    return ok


def failed(found: Column, rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that the counts break, in the order of the table."""
    return F.array_compact(F.array(*[F.when(~passes(found, r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """All rows and columns, and ``quality``: counts, base_failed, kept and the names of all broken rules.

    A text is kept if it breaks no rule of either table. A null, empty or wordless text has counts of
    zero and fails the base rule on words. Repeated rows and equal texts get equal values; a table with a column ``quality`` gets ``_quality``.
    Texts may have any length: a count needs memory in proportion to its text.
    """
    out, held = free_name(docs, "quality"), free_name(docs, "_counts")
    m = F.col(held)
    broken = reduce(lambda a, b: a | b, [~passes(m, r) for r in base], F.lit(False))
    keeps = reduce(lambda a, b: a & b, [passes(m, r) for r in rules], ~broken)
    measured = docs.withColumn(held, counts(F.col("text").cast("string")))
    return measured.withColumn(out, F.struct(
        m.alias("counts"), broken.alias("base_failed"), keeps.alias("kept"), failed(m, base + rules).alias("broken"))).drop(held)
