"""Quality rules as a bitmask ledger [native].

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule; policies are
versioned masks over these bits, so a new policy, or the ablation of a rule, needs no second look at the texts.

Defined results: a null or empty text has no words (all counts 0) and fails ``few_words``. Repeated rows are judged
alike, each on its own. An empty table gives an empty ledger. Extra columns are ignored by :func:`ledger`; clashing
names do no harm, since only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"
_SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Rules in the order of their bits; each says when a document fails. New rules are appended, never reordered.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("shouting", "10 * n_exclamations > 3 * n_words"),
    ("mostly_duplicate_lines", "2 * n_dup_lines > n_lines"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document. A version is never changed; ``v3`` keeps short texts that repeat
#: a line, which ``v2`` rejects.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "shouting"),
    "v3": ("few_words", "repeated_words", "symbols", "mostly_duplicate_lines", "short_words", "long_words", "shouting"),
}


def mask_of(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body and its lambdas read it."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, characters) -> Column:
    """How many of some ASCII characters a text holds."""
    total = F.lit(0)
    for c in characters:
        total = total + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return total.cast("long")


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, the first occurrence included.

    Windows are hashed and sorted with their positions, so equal windows become neighbours; the union of the repeated
    windows' words then follows from the sorted start positions.
    """

    def from_windows(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return _bound(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def covered(p: Column) -> Column:
        gap = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gap, F.lit(0), lambda total, x: total + x)

    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )

    return _bound(words, lambda w: _bound(F.sort_array(windows(w)), from_windows)).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, the measurements and ``failed``, the bits of the rules it fails."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    measured = (
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))
        .withColumn("words", F.filter(F.split("t", _SPACE_RUN), lambda w: w != ""))
        .withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            (F.char_length("t") - _count(F.col("t"), SPACES)).cast("long").alias("word_chars"),
            _count(F.col("t"), SYMBOLS).alias("n_symbols"),
            _count(F.col("t"), "!").alias("n_exclamations"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _repeated_words(F.col("words")).alias("n_repeat_words"),
        )
    )
    bits = F.lit(0)
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BITS[name])).otherwise(F.lit(0)))
    return measured.withColumn("failed", bits)


def with_verdict(rows: DataFrame, policy: str = "v3", into: str = "kept") -> DataFrame:
    """Apply a versioned policy: ``into`` is true when no rule of the policy failed."""
    return rows.withColumn(into, F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablation(rows: DataFrame, policy: str = "v3") -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone, and kept if it were left out.

    Runs on counts per distinct bit pattern (at most 2 ** rules of them), not on documents.
    """
    mask = mask_of(policy)
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).alias("bit")) for name in POLICIES[policy]))
    rule = patterns.select("bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rule.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = "v3", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their columns unchanged.

    The verdict is computed beside the row, so nothing is joined back and repeated ids are judged row by row.
    """
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    judged = with_verdict(ledger(carried, "row", "text"), policy)
    return judged.filter("kept").select("doc_id.*")
