"""Rule bitmask ledger: every quality rule is evaluated once, policies are applied to the stored bits.

`measured` computes the measurements of a text with built-in functions only; `ledger` adds one bit for each failed
rule; `apply_policy` and `ablation` work on the bits alone, so that a new policy version or an ablation never reads
a text again. Null texts are empty texts; a text without words fails `few_words`. Very long texts are measured whole.
Repeated rows, with or without doc_id, have a row in the ledger each. Columns of the input other than doc_id and text are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

#: name, and the SQL of its failure over the measurements; a rule's bit is its place in this list.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "100 * n_symbols > 60 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
]
BIT = {name: k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version's name and the rules that reject a document."""

    version: str
    rejecting: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in self.rejecting)


BASE = Policy("base", ("few_words", "repeated_windows"))
STANDARD = Policy("standard-1", tuple(BIT))
LENIENT = Policy("lenient-1", ("few_words", "repeated_windows", "repeated_lines"))


def let(value: Column, use) -> Column:
    """`use` over a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of three that the text has twice or more.

    Windows are sorted by their hash, so that equal ones stand side by side; the places of repeated windows, in
    order, each add the words up to the next one, three at most.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    places = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).__or__(F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"]))
    covered = lambda p: F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")))["n"]
    return F.when(n < 4, F.lit(0)).otherwise(let(F.sort_array(windows), lambda s: let(places(s), covered)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("t"))
    words = F.filter(F.split("t", BLANK_RUN), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    counted = base.select("doc_id", "t", words.alias("words"), lines.alias("lines"))
    return counted.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and `failed`, a long with one bit for each rule that the document fails."""
    bits = " | ".join(f"(CASE WHEN {sql} THEN {1 << k}L ELSE 0L END)" for k, (_, sql) in enumerate(RULES))
    return measured(docs).withColumn("failed", F.expr(bits))


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """Add policy (its version), kept, and the bits that rejected the document."""
    against = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    return book.withColumn("policy", F.lit(policy.version)).withColumn("rejected_by", against).withColumn("kept", against == 0)


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that it alone rejects, and that would be kept without it.

    One pass: rows are first counted by their bits, of which there are at most 2 to the number of rules.
    """
    return ablation_of_counts(book.groupBy("failed").agg(F.count(F.lit(1)).alias("n")), policy)


def ablation_of_counts(by_bits: DataFrame, policy: Policy) -> DataFrame:
    """The same from the number of documents of each set of bits (failed, n)."""
    names = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for r in policy.rejecting]))
    against = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    return (
        by_bits.select("failed", "n", names.alias("r"))
        .groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(against == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_by_it"),
            F.sum(F.when(against.bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without_it"),
        )
    )


def rule_report(docs: DataFrame) -> DataFrame:
    """The ledger's digest: measurements, base_failed, kept by the standing policy and by the lenient one."""
    book = apply_policy(ledger(docs), STANDARD)
    against = lambda policy: F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (against(BASE) != 0).alias("base_failed"), "kept", "failed", "policy", (against(LENIENT) == 0).alias("kept_lenient"))


def ablation_report(docs: DataFrame) -> DataFrame:
    """The ablations of both policies over one ledger."""
    bits = ledger(docs).groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    return ablation_of_counts(bits, STANDARD).union(ablation_of_counts(bits, LENIENT))


#: The same in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c >= 2),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
             + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * n_symbols > 60 * n_words THEN 4 ELSE 0 END)
             + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
             + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits % 4) <> 0 AS base_failed,
       bits = 0 AS kept, bits::BIGINT AS failed, 'standard-1' AS policy, (bits & 11) = 0 AS kept_lenient
FROM f
"""

ABLATION_ORACLE = f"""
WITH b AS (SELECT failed FROM ({ORACLE})),
p AS (SELECT * FROM (VALUES ('standard-1', 63), ('lenient-1', 11)) p(policy, mask)),
r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('many_symbols', 4), ('repeated_lines', 8), ('short_words', 16), ('long_words', 32)) r(rule, bit))
SELECT policy, rule, count(*) FILTER ((failed & bit) <> 0) AS failing, count(*) FILTER ((failed & mask) = bit) AS only_by_it,
       count(*) FILTER ((failed & mask & ~bit) = 0) AS kept_without_it
FROM b, p JOIN r ON (mask & bit) <> 0 GROUP BY policy, rule
"""
