"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; policies, which name the rules that reject, are applied to the bits later, and a rule's effect
under a policy (its ablation) is an aggregate over bits. DataFrame and SQL functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACES, words

#: Bit number, name and what fails a document; a rule's bit never changes its meaning.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "10 * n_symbols > n_words"),
    (3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    (4, "word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    (5, "shouting", "10 * n_upper > 4 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules that reject a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: bit for bit, name, _ in RULES}
        return sum(1 << bits[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(name for _, name, _ in RULES))

#: Texts of so many words take the slow path, as an index then needs over 24 bits.
_PACKED = 1 << 24


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df and, of each whole text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper (long).

    A null text counts as empty: all measures are 0. n_lines: \\n-split lines with a word; n_dup_lines:
    those equal to an earlier one; n_repeat_words: words in 3-word windows that occur twice or more in
    the text, the first occurrence included; n_upper: letters A-Z. Columns of df with such names give
    way, all others stay, whatever their names. Rows stay where they are: no shuffle, one row at a
    time, so that repeated rows and ties change nothing and an empty table gives an empty result.
    """
    kept = [c for c in df.columns if c not in MEASURES]
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc") if kept else F.lit(None).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.withColumn("_w", words("_t"))
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("bigint"),
            "word_chars": F.length(F.translate("_t", SPACES, "")).cast("bigint"),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("bigint"),
            "n_upper": (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint"),
            "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    df = df.withColumns({"n_lines": F.size("_l").cast("bigint"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint")}).drop("_l", "_t")
    window = "get(_w, {0}), get(_w, {0} + 1), get(_w, {0} + 2)"
    high = f"~{_PACKED - 1}L"
    # a hash's upper 40 bits with the window's place below them: sorting brings equal windows together
    df = df.withColumn("_p", F.expr(f"""if(n_words between 4 and {_PACKED - 1},
        sort_array(transform(sequence(0, n_words - 3), i -> (xxhash64({window.format('int(i)')}) & {high}) | i)), array())"""))
    df = df.withColumn("_c", F.expr(f"""if(n_words >= {_PACKED}, sequence(0, int(n_words - 3)),
        transform(filter(_p, (p, j) -> (p & {high}) = (get(_p, j - 1) & {high}) or (p & {high}) = (get(_p, j + 1) & {high})),
                  p -> int(p & {_PACKED - 1}L)))""")).drop("_p")
    # of the windows with a like one, the words themselves decide
    df = df.withColumn("_f", F.expr(f"sort_array(transform(_c, i -> struct(array({window.format('i')}) as g, i as i)))")).drop("_c", "_w")
    df = df.withColumn(
        "n_repeat_words",
        # adding the row number's zero bits keeps filters above: pushed below, they would copy every measure's expression
        F.expr("""bigint(size(array_distinct(flatten(transform(filter(_f, (s, j) -> s.g = get(_f, j - 1).g or s.g = get(_f, j + 1).g),
            s -> array(s.i, s.i + 1, s.i + 2)))))) + (monotonically_increasing_id() & 0L)"""),
    )
    return df.select(*[F.col("_doc").getField(c).alias(c) for c in kept], *MEASURES)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """measure(df) and failure_bits (long): bit b is set if the rule of bit b fails the document."""
    bits = F.monotonically_increasing_id().bitwiseAND(0)  # see n_repeat_words
    for bit, _, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << bit)).otherwise(0).cast("bigint"))
    return measure(df, text).withColumn("failure_bits", bits)


def passes(policy: Policy, bits: str = "failure_bits") -> Column:
    """Whether no rule of the policy failed."""
    return F.col(bits).bitwiseAND(policy.mask) == 0


def keep(df: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows of df that the policy keeps, with df's columns, whatever their names; nulls and repeats as in measure."""
    rows = ledger(df.select(F.struct("*").alias("_doc"), F.col(text).alias("_text")), "_text")
    return rows.filter(passes(policy)).select("_doc.*")


def ablation(ledger: DataFrame, policy: Policy) -> DataFrame:
    """A row per rule of the policy: rule, n_failed, and n_sole, the documents that the policy would keep without it.

    One aggregate over the bits, of fixed size; an empty ledger gives zeros.
    """
    kept = F.col("failure_bits").bitwiseAND(policy.mask)
    rules = [(bit, name) for bit, name, _ in RULES if name in policy.rules]
    sums = [F.count_if(cond).alias(f"{kind}{bit}") for bit, _ in rules for kind, cond in (("f", kept.bitwiseAND(1 << bit) != 0), ("s", kept == 1 << bit))]
    rows = ", ".join(f"'{name}', f{bit}, s{bit}" for bit, name in rules)
    return ledger.agg(*sums).selectExpr(f"stack({len(rules)}, {rows}) as (rule, n_failed, n_sole)")
