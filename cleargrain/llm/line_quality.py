"""Line-first cleaning: lines that fail a rule go, then documents that lost too much text go.

Lines are what newlines separate. A line without words is neither judged nor removed. A line fails by

* punctuation: fewer than SHORT_LINE words and no closing mark at its end, or symbols above SYMBOL_PERCENT of its word
  characters;
* navigation: two or more separators, and at most ENTRY_WORDS words for each entry between them;
* boilerplate: fewer than BOILERPLATE_WORDS words and one of the phrases of page furniture.

A document is kept when it passes the base rules (MIN_WORDS words, at most REPEAT_PERCENT of them in repeated windows of
three words) and its failed lines hold at most LOST_PERCENT of its word characters.

Everything about a document is computed in its own row by functions on arrays: no shuffle, so hot sources and groups of
copies cost nothing extra, and nothing is held but one document. A null text has no words; rows are judged one by one,
so repeated ids and rows stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import ascii_lower, free_name

MIN_WORDS = 50
REPEAT_WINDOW = 3
REPEAT_PERCENT = 50
SHORT_LINE = 12
SYMBOL_PERCENT = 10
ENTRY_WORDS = 4
BOILERPLATE_WORDS = 30
LOST_PERCENT = 30

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
SEPARATORS = "[|»›•·]"
CLOSED = "[.!?:;…。！？\"'”’»)\\]]" + SPACE + "*\\z"
# Phrases of page furniture, in lower case.
PHRASES = [
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript",
    "forgot password", "lorem ipsum", "powered by", "privacy policy", "read more", "sign in", "sign up", "skip to content",
    "subscribe to", "terms of service", "terms of use", "use of cookies", "uses cookies",
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _count(text: Column, characters: str) -> Column:
    """How many characters of a class of single characters a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, characters, ""))


def _measured(line: Column) -> Column:
    """A line with its numbers of words and of characters in words; lambdas would work these out again at every use."""
    n_chars = F.length(F.regexp_replace(line, SPACE + "+", ""))
    return F.struct(line.alias("line"), F.size(words(line)).alias("n_words"), n_chars.alias("n_chars"))


def line_fails(measured: Column) -> Column:
    """Whether a measured line has words and fails one of the three rules."""
    line, n_words, n_chars = (measured[c] for c in ("line", "n_words", "n_chars"))
    separators = _count(line, SEPARATORS)
    open_end = (n_words < SHORT_LINE) & ~line.rlike(CLOSED)
    symbols = 100 * _count(line, SYMBOLS) > SYMBOL_PERCENT * n_chars
    navigation = (separators >= 2) & (n_words <= ENTRY_WORDS * (separators + 1))
    low = ascii_lower(line)
    boilerplate = (n_words < BOILERPLATE_WORDS) & reduce(Column.__or__, [low.contains(p) for p in PHRASES])
    return (n_chars > 0) & (open_end | symbols | navigation | boilerplate)


def _repeated_words(w: str) -> Column:
    """Words inside windows of REPEAT_WINDOW words that occur twice or more in the array column ``w``.

    The windows are sorted with their positions, those equal to a neighbour stay, and each adds the words by which it
    goes beyond the window before it.
    """
    parts = ", ".join(f"{w}[i + {j}]" for j in range(REPEAT_WINDOW))
    return F.expr(
        f"if(size({w}) < {REPEAT_WINDOW}, array(), sort_array(transform(sequence(0, size({w}) - {REPEAT_WINDOW}), i -> struct(concat_ws(' ', {parts}) as x, i as i))))"
    )


def _facts(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the struct column ``name`` of everything that the rules ask of column ``text``."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    taken = list(docs.columns)

    def fresh(wanted: str) -> str:
        taken.append(free_name(taken, wanted))
        return taken[-1]

    t, w, lines, bad, windows, at = (fresh(x) for x in ("__t", "__w", "__lines", "__bad", "__windows", "__at"))
    rows = docs.select(*columns, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t))
    rows = rows.select(*columns, t, words(F.col(t)).alias(w), F.transform(F.split(t, "\n", -1), _measured).alias(lines))
    rows = rows.select(*columns, t, w, lines, F.transform(lines, line_fails).alias(bad), _repeated_words(w).alias(windows))
    twin = f"coalesce(get({windows}, j - 1).x = v.x, false) or coalesce(get({windows}, j + 1).x = v.x, false)"
    rows = rows.select(*columns, t, w, lines, bad, F.expr(f"sort_array(transform(filter({windows}, (v, j) -> {twin}), v -> v.i))").alias(at))
    gone = F.filter(lines, lambda line, i: F.get(bad, i))
    spoken = F.filter(lines, lambda line: line["n_chars"] > 0)["line"]

    def chars(measured: Column | str) -> Column:
        return F.aggregate(measured, F.lit(0).cast("bigint"), lambda n, line: n + line["n_chars"])

    n_repeat = F.expr(
        f"aggregate({at}, named_struct('n', 0L, 'last', -{REPEAT_WINDOW}), (a, i) -> "
        f"named_struct('n', a.n + least({REPEAT_WINDOW}, i - a.last), 'last', i), a -> a.n)"
    )
    facts = F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        chars(lines).alias("word_chars"),
        _count(F.col(t), SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size(spoken) - F.size(F.array_distinct(spoken))).cast("bigint").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        F.size(gone).cast("bigint").alias("n_failed_lines"),
        chars(gone).alias("lost_chars"),
        F.array_join(F.filter(lines, lambda line, i: ~F.get(bad, i))["line"], "\n").alias("cleaned"),
    )
    # a generated column: filters on it stay above, where they would else repeat the work on arrays for every element
    return rows.select(*columns, F.explode(F.array(facts)).alias(name))


def _base_failed(facts: Column) -> Column:
    return (facts["n_words"] < MIN_WORDS) | (100 * facts["n_repeat_words"] > REPEAT_PERCENT * facts["n_words"])


def _kept(facts: Column) -> Column:
    return ~_base_failed(facts) & (100 * facts["lost_chars"] <= LOST_PERCENT * facts["word_chars"])


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``kept`` and the ``cleaned`` text."""
    rows = _facts(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "text", "facts")
    f = F.col("facts")
    return rows.select(
        "doc_id", *[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        _base_failed(f).alias("base_failed"), _kept(f).alias("kept"), *[f[c].alias(c) for c in ("n_failed_lines", "lost_chars", "cleaned")],
    )


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with all their columns; ``text`` is without the lines that failed."""
    name = free_name(docs.columns, "__facts")
    rows = _facts(docs, text, name).filter(_kept(F.col(name)))
    return rows.select(*[F.col(name)["cleaned"].alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
