"""Operator 8: quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition under which a text goes, over measures that are computed where a rule needs them. Each rule's cost
(the time of a pass over a stored sample less that of a pass without a rule, the least of three) and selectivity (share rejected)
are estimated on that sample, and the rules are put in the order of rejections per cost. Nested CASE branches then stop at the first
rule that rejects. The order changes what is computed, never what is kept. ``kept_only`` filters by the cascade and computes no more than
that; ``judged`` also returns every measure, so there the order saves the comparisons alone.

Words are runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return; text lengths
count code points. Nulls: a null text counts as empty. Repeated rows give a row each. Empty tables give no row; a rule
order can be had from an empty sample too. Extra columns are ignored by ``measured`` and kept by ``kept_only``, whatever their names.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import stored

#: Passes over the sample for each rule.
TRIES = 3
#: Rows on which costs and selectivities are estimated, about.
SAMPLE_ROWS = 2000
_SPACE = "[\\x20\\x09-\\x0D]"
_TRIM = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words as an array; empty for none."""
    whole = F.trim(text, F.lit(_TRIM))
    return F.when(F.length(whole) == 0, F.array().cast("array<string>")).otherwise(F.split(whole, f"{_SPACE}+"))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"{_SPACE}+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")


def n_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.size(F.filter(F.split(text, "\n"), _has_word)).cast("long")


def _has_word(line: Column) -> Column:
    return F.length(F.trim(line, F.lit(_TRIM))) > 0


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""

    def repeated(lines: Column) -> Column:
        full = F.size(lines) - F.size(F.array_distinct(lines))
        return F.when(full == 0, F.lit(0)).otherwise(let(F.filter(lines, _has_word), lambda own: F.size(own) - F.size(F.array_distinct(own))))

    return let(F.split(text, "\n"), repeated).cast("long")


def n_repeat_words(own: Column, hashed: Column, n: int = 5) -> Column:
    """Words inside windows of five words that the text has twice or more; ``own`` is a column of words, ``hashed`` of their hashes.

    Hashes of windows that are all distinct prove that none is repeated; only other texts compare the windows themselves.
    """
    assert n == 5

    def shifted(x: Column, by: int) -> Column:
        return F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0)))

    def pair(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b)

    def hashes(h: Column) -> Column:
        two = F.zip_with(h, shifted(h, 1), pair)
        four = let(two, lambda x: F.zip_with(x, shifted(x, 2), pair))
        return F.slice(F.zip_with(four, shifted(h, 4), pair), 1, F.size(h) - 4)

    def covered(starts: Column) -> Column:
        step = F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, i: F.struct((i + n).alias("end"), (acc["n"] + i + n - F.greatest(i, acc["end"])).alias("n")))
        return step["n"]

    def exact() -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(own) - n), lambda i: F.struct(F.array_join(F.slice(own, i + 1, n), " ").alias("w"), i.alias("i")))

        def marks(ordered: Column) -> Column:
            def repeated(x: Column, j: Column) -> Column:
                before, after = F.get(ordered, j - 1)["w"], F.get(ordered, j + 1)["w"]
                return F.when((x["w"] == before) | (x["w"] == after), x["i"])

            return F.sort_array(F.filter(F.transform(ordered, repeated), lambda i: i.isNotNull()))

        return covered(let(F.sort_array(windows), marks))

    distinct = let(hashes(hashed), lambda w: F.size(F.array_distinct(w)) == F.size(w))
    return F.when(F.size(own) < n + 1, F.lit(0)).when(distinct, F.lit(0)).otherwise(exact()).cast("long")


def measured(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines``."""
    text = F.col("text")
    base = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = base.withColumn("_words", words(text)).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    return split.select("doc_id", F.size("_words").cast("long").alias("n_words"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(F.col("_words"), F.col("_hashes")).alias("n_repeat_words"), n_lines(text).alias("n_lines"))


@dataclass(frozen=True)
class Rule:
    """A text goes where ``rejects`` holds: over ``measured`` columns, or, as ``of_text``, over the text's own column."""

    name: str
    rejects: Column
    of_text: Callable[[Column], Column]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> list[Rule]:
    """The method's own rules."""
    n_words = lambda t: F.size(words(t))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words"), lambda t: 10 * n_symbols(t) > n_words(t)),
        Rule("dup_lines", 10 * F.col("n_dup_lines") > 4 * F.col("n_lines"), lambda t: 10 * n_dup_lines(t) > 4 * n_lines(t)),
        Rule("long_words", F.col("word_chars") > 12 * F.col("n_words"), lambda t: word_chars(t) > 12 * n_words(t)),
        Rule("short_words", F.col("word_chars") < 2 * F.col("n_words"), lambda t: word_chars(t) < 2 * n_words(t)),
    ]


def all_rules() -> list[Rule]:
    """The base rules, one by one, and the method's own."""

    def repeats(t: Column) -> Column:
        hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
        return let(words(t), lambda w: let(hashed(w), lambda h: 100 * n_repeat_words(w, h) > 20 * F.size(w)))

    base = [Rule("few_words", F.col("n_words") < 10, lambda t: F.size(words(t)) < 10), Rule("repeats", 100 * F.col("n_repeat_words") > 20 * F.col("n_words"), repeats)]
    return [*base, *rules()]


def ordered(documents: DataFrame, own: list[Rule], sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[Rule]:
    """The rules by rejections per cost, as estimated on about ``sample_rows`` rows."""
    texts = documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = min(1.0, sample_rows / max(1, texts.count()))
    sample = stored(texts.sample(fraction=share, seed=7) if share < 1 else texts, "sample")

    def passed(rejects: Column) -> tuple[float, float]:
        best, rate = math.inf, 0.0
        for _ in range(TRIES):
            began = time.perf_counter()
            rejected, n = sample.agg(F.count_if(rejects), F.count("*")).first()
            best, rate = min(best, time.perf_counter() - began), rejected / max(1, n)
        return rate, best

    _, empty = passed(F.length("text") < 0)
    found = [(passed(rule.of_text(F.col("text"))), rule) for rule in own]
    return [rule for _, rule in sorted(found, key=lambda x: (-x[0][0] / max(1e-4, x[0][1] - empty), x[1].name))]


def failed_rule(own: list[Rule]) -> Column:
    """The name of the first rule that rejects; null if none does."""
    name = F.lit(None).cast("string")
    for rule in reversed(own):
        name = F.when(rule.rejects, F.lit(rule.name)).otherwise(name)
    return name


def judged(documents: DataFrame) -> DataFrame:
    """A row a document: the measures, ``base_failed`` and ``kept``."""
    own = ordered(documents, rules())
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(failed_rule(own).isNull())
    found = measured(documents).withColumn("base_failed", base_failed()).withColumn("kept", verdict)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


def kept_only(documents: DataFrame, text_col: str = "text", own: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, as they are. The filter is one CASE in the cascade's order, and nothing else is computed."""
    own = ordered(documents, all_rules(), text_col=text_col) if own is None else own
    text, gone = F.coalesce(F.col(text_col), F.lit("")), F.lit(False)
    for rule in reversed(own):
        gone = F.when(rule.of_text(text), F.lit(True)).otherwise(gone)
    return documents.where(~gone)


ORACLE_SQL = """
with w as (
  select doc_id, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x : x <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x : regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents
), g as (
  select doc_id, text, words, lines,
         list_transform(range(1, greatest(len(words) - 3, 1)), lambda i : array_to_string(words[i:i + 4], ' ')) as grams
  from w
), p as (
  select doc_id, unnest(grams) as gram, generate_subscripts(grams, 1) as i from g
), r as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from p) where n > 1
), c as (
  select doc_id, count(distinct i + k) as n_repeat_words from r, range(0, 5) t(k) group by doc_id
), m as (
  select g.doc_id, cast(len(words) as bigint) as n_words,
         cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
         cast(len(lines) as bigint) as n_lines
  from g left join c on g.doc_id = c.doc_id
), f as (
  select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > n_words or 10 * n_dup_lines > 4 * n_lines
            or word_chars > 12 * n_words or word_chars < 2 * n_words) as kept, n_lines
from f
"""
