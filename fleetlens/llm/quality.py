"""Quality rules: a threshold table compiled into one projection (operator 9)."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common short words of English, French, German and Spanish, the stop words that running text has.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "a", "in", "that", "is", "it", "for", "on", "with", "as", "are", "was", "this", "at", "by", "or", "an", "from", "you", "not",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "est", "dans", "pour", "par", "sur", "au", "avec", "ne", "pas",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "im", "ein", "eine", "auf", "für", "nicht", "dem", "des", "sich", "er", "sie",
    "el", "los", "las", "y", "en", "se", "por", "con", "para", "una", "su", "al", "lo", "como", "es", "del", "no",
)

#: A row is (name, a measure or the ratio of two, least, most); None leaves an end open. A text whose measure is outside fails the rule.
Rule = tuple[str, str, float | None, float | None]
RULES: tuple[Rule, ...] = (
    ("word length", "word_chars / n_words", 1.5, 25.0),
    ("symbols a word", "n_symbols / n_words", None, 0.25),
    ("shouts a word", "n_shouts / n_words", None, 0.5),
    ("stop words", "n_stop_words", 1, None),
    ("repeated lines", "n_dup_lines / n_lines", None, 0.5),
    ("bullet lines", "n_bullets / n_lines", None, 0.9),
    ("cut lines", "n_cut_lines / n_lines", None, 0.5),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_stop_words", "n_bullets", "n_cut_lines")

_SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with MEASURES (long) of each whole text, all from built-in functions; columns of these names are replaced.

    n_words, word_chars: words are runs without white space, word_chars their code points. n_symbols: characters of #*$%&|<>.
    n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words in windows of WINDOW words that occur twice
    or more in the text, the first included. n_lines: lines with a word. n_shouts: exclamation marks. n_stop_words: words that are
    STOP_WORDS when lower-cased. n_bullets, n_cut_lines: lines that start with a bullet; that end in an ellipsis.
    A null text is an empty one, and all its measures are 0.
    """
    docs = docs.drop(*MEASURES)
    m = _measured(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select("*", m.alias("_m")).select(*docs.columns, "_m.*")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once wherever Spark moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _measured(text: Column) -> Column:
    """A struct of MEASURES."""
    words = F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda v: v.rlike(r"[^\x20\x09-\x0D]"))
    return _let(words, lambda w: _let(lines, lambda v: _counts(text, w, v)))


def _counts(text: Column, words: Column, lines: Column) -> Column:
    count = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.size(words) < WINDOW, 0).otherwise(_let(F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))), _repeated)),
        "n_lines": F.size(lines),
        "n_shouts": F.regexp_count(text, F.lit("!")),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))),
        "n_bullets": F.size(F.filter(lines, lambda v: v.rlike("^ *[-*•]"))),
        "n_cut_lines": F.size(F.filter(lines, lambda v: v.rlike("(\\.\\.\\.|…) *$"))),
    }
    return F.struct(*(c.cast("long").alias(n) for n, c in count.items()))


def _repeated(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more; windows are sorted only where one does."""
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(r: Column) -> Column:
        again = F.transform(r, lambda x, j: F.when(((j > 0) & (r[F.greatest(j - 1, F.lit(0))].h == x.h)) | ((j < F.size(r) - 1) & (r[F.least(j + 1, F.size(r) - 1)].h == x.h)), x.i))
        return F.sort_array(F.filter(again, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(WINDOW), p - a.last)).alias("n")), lambda a: a.n)

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(ranked, lambda r: covered(starts(r))))


def failed(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a struct of measures fails; a measure that is null (no words, no lines) fails none."""
    each = []
    for name, measure, least, most in rules:
        a, _, b = measure.partition(" / ")
        value = m[a] / F.nullif(m[b], F.lit(0)) if b else m[a]
        outside = [value < least] * (least is not None) + [value > most] * (most is not None)
        each.append(F.when(functools.reduce(operator.or_, outside), name))
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, least_words: int = 20, most_repeats: int = 30) -> DataFrame:
    """docs with MEASURES, base_failed, failed (names of the rules that it breaks) and kept.

    base_failed: fewer than least_words words, or more than most_repeats percent of them repeat in windows. kept is false if
    base_failed, else true when no rule of the table fails. The table is compiled into one projection without user functions,
    so a text is read once and nothing is shuffled. Null and empty texts fail the base. Each row is judged alone: repeated rows
    get equal results, null ids are kept, empty tables give no rows. Added names replace those in docs.
    """
    docs = docs.drop("base_failed", "failed", "kept")
    docs = docs.drop(*MEASURES)
    m = _measured(F.coalesce(F.col(text_col), F.lit("")))
    judged = _let(m, lambda x: F.struct(*(x[n].alias(n) for n in MEASURES), _base(x, least_words, most_repeats).alias("base_failed"), failed(x, rules).alias("failed")))
    judged = _let(judged, lambda x: F.struct(*(x[n].alias(n) for n in (*MEASURES, "base_failed", "failed")), (~x.base_failed & (F.size(x.failed) == 0)).alias("kept")))
    return docs.select("*", judged.alias("_m")).select(*docs.columns, "_m.*")


def _base(m: Column, least_words: int, most_repeats: int) -> Column:
    return (m.n_words < least_words) | (100 * m.n_repeat_words > most_repeats * m.n_words)


def _oracle() -> str:
    checks = " or ".join(
        f"({x})" for _, measure, least, most in RULES for x in (f"{_safe(measure)} < {least}" if least is not None else "", f"{_safe(measure)} > {most}" if most is not None else "") if x
    )
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from t),
p as (select r, unnest(range(1, len(words) - {WINDOW - 2})) as i, words from w where len(words) >= {WINDOW}),
g as (select r, i, count(*) over (partition by r, words[i:i + {WINDOW - 1}]) as c from p),
d as (select r, i, i - lag(i) over (partition by r order by i) as gap from g where c > 1),
k as (select r, sum(least({WINDOW}, coalesce(gap, {WINDOW}))) as n from d group by r),
m as (
  select doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(k.n, 0) as bigint) as n_repeat_words, len(lines) as n_lines,
    length(text) - length(replace(text, '!', '')) as n_shouts, len(list_filter(words, lambda x: lower(x) in ({stop}))) as n_stop_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*•]'))) as n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…) *$'))) as n_cut_lines
  from w left join k using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce({checks}, false) as kept from b
"""


def _safe(measure: str) -> str:
    a, _, b = measure.partition(" / ")
    return f"cast({a} as double) / nullif({b}, 0)" if b else a


ORACLE = _oracle()


def quality_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the five counts of the contract, base_failed and kept."""
    return quality_rules(docs.select("doc_id", "text"), **options).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
