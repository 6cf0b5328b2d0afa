"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one long
whose bit *b* is set where rule *b* failed. A policy is a versioned mask over those bits, so
changing a policy, or asking what a rule costs, reads the ledger and never the texts again.

Main path: DataFrame functions only. All work is row-local: reading and writing are the only
data movement, and a document's cost is n log n in its own words.

Defined cases: a null or empty text has no words and fails ``few_words``; repeated rows get
one ledger row each; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, GAP, text_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Name and condition under which a document fails, by bit. Bits are never reassigned: a new
#: rule goes to the end and older ledgers stay readable.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
)
BIT = {name: 1 << b for b, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versioned policies: the bits of which any rejects a document.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"],
    "v2": BASE | BIT["symbols"] | BIT["word_length"] | BIT["repeated_lines"],
}
CURRENT = "v2"


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the measurements of every whole text.

    Windows of three words are compared by 64-bit hash within their own document only.
    """
    kept = [F.col(c) for c in keep]
    names = list(keep)
    text = text_of(text_col)
    bare = F.btrim(text, F.lit(BLANKS))
    d = docs.select(*kept, text.alias("_t"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP)).alias("_w"))
    d = d.select(
        *names,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("_l"),
        F.expr("CASE WHEN size(_w) >= 3 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) ELSE array() END").alias("_h"),
    )
    d = d.select(
        *names, "n_words", "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        # Equal windows stand side by side once sorted; most texts without any end here.
        F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h, i))) END").alias("_s"),
    )
    d = d.select(
        *names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
        F.expr("sort_array(transform(filter(_s, (x, k) -> (k > 0 AND _s[k - 1].h = x.h) OR (k + 1 < size(_s) AND _s[k + 1].h = x.h)), x -> x.i))").alias("_p"),
    )
    covered = F.expr("aggregate(transform(_p, (p, k) -> CASE WHEN k + 1 < size(_p) THEN least(3, _p[k + 1] - p) ELSE 3 END), 0L, (a, x) -> a + x)")
    repeats = F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")
    # A generator, as a filter on measurements would otherwise move below them and repeat their work.
    return d.select(*names, F.inline(F.array(F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", repeats, "n_lines"))))


def failure_bits() -> Column:
    return sum((F.when(F.expr(cond), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, (_, cond) in enumerate(RULES)), F.lit(0).cast("long"))


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the measurements, and ``failures``: the bits of the rules that failed."""
    return measure(docs, text_col, keep).withColumn("failures", failure_bits())


def passes(policy: str = CURRENT, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policies(book: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """The ledger with one boolean ``kept_<policy>`` for each policy."""
    return book.select("*", *[passes(p).alias(f"kept_{p}") for p in policies])


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """What each rule of a policy does: rule, n_docs, n_failed, n_only (it alone rejects), n_kept_without.

    Documents are first counted by failure pattern, of which there are at most two to the
    number of rules; the rest works on those patterns.
    """
    mask = POLICIES[policy]
    patterns = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask])
    rows = patterns.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & without, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(without, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def reject(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that a policy keeps, whole and with all their columns.

    ``measure`` carries the input's columns along, so no join back is needed. Input columns
    named like a measurement, or starting with ``_cj_``, are kept under their own name.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_cj_row"), F.col("text").alias("_cj_text"))
    kept = ledger(packed, "_cj_text", ("_cj_row",)).where(passes(policy))
    return kept.select(*[F.col(f"_cj_row.`{c}`").alias(c) for c in columns])
