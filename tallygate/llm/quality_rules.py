"""Rule bitmask ledger: every rule is evaluated once; policies and ablations only read its bits.

:func:`ledger` stores the measurements of each document and one long whose bits say which rules it
fails. A policy is a mask of the rules that count: :func:`apply_policy` keeps the documents of which it
has no bit, and :func:`ablations` tells from the counts of each bit pattern what each rule alone
decides, without looking at a text again. All of it is built-in column functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bit by bit: name and failing condition over the measurements. Bits keep their meaning; new rules are appended.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 25 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("upper_case", "100 * n_upper > 60 * word_chars"),
)
#: Versions of the policy: the rules that count.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(name for name, _ in RULES),
}
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def _windows(words: Column) -> Column:
    """64-bit hashes of the windows of WINDOW words, in order."""
    at = lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW)))
    return F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))


def _covered(starts: Column) -> Column:
    """How many words the windows at these ascending starts cover."""
    step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"), x.alias("last"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(starts, start, step, lambda acc: acc["n"])


def _repeats(hashes: Column) -> Column:
    """Words in windows that are found twice or more; sorted only if there is any."""

    def found(ordered: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        again = F.filter(ordered, lambda x, i: ((i > 0) & same(x, F.get(ordered, i - 1))) | same(x, F.get(ordered, i + 1)))
        return _covered(F.array_sort(F.transform(again, lambda x: x["i"])))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, found))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements (long) and ``failed`` (long, a bit for each of RULES) for every row of ``docs``.

    Words are runs of other than ASCII white space; lines end at newlines and count if they hold a word. A null
    or empty text has all measurements 0 and fails few_words. Null ids and repeated rows are kept; an empty
    table gives none; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_word = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            let(_windows(w), _repeats).cast("long").alias("n_repeat_words"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), by_word.alias("w"), by_line.alias("l"), _count(text, SYMBOLS).cast("long").alias("n_symbols"), _count(text, _UPPER).cast("long").alias("n_upper"))
    measured = measured.select("doc_id", "w.*", "l.*", "n_symbols", "n_upper")
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.select("doc_id", *MEASUREMENTS, failed.alias("failed"))


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in POLICIES[policy])


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: whether the document fails none of the policy's rules."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_alone, n_kept_without) of each of the policy's rules, from the ledger's bits.

    n_alone counts what the rule alone rejects, n_kept_without what the policy without it keeps. Documents
    are first counted by bit pattern, of which there are at most 2 to the number of rules.
    """
    own = F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long"))
    patterns = rows.groupBy(own.alias("bits")).agg(F.count("*").alias("n"))
    names = [name for name, _ in RULES]
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]))).alias("r")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    has, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return patterns.select("bits", "n", rules).select("bits", "n", "r.*").groupBy("rule").agg(n(has).alias("n_failed"), n(F.col("bits") == F.col("bit")).alias("n_alone"), n(rest == 0).alias("n_kept_without"))
