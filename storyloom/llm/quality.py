"""Quality rules in a bitmask ledger (operator 4, native).

Every rule is evaluated once for each document. The ledger keeps the measurements and, in ``fail_bits``, a bit for each
failed rule. Policies are versioned masks over those bits, so a new policy, or an ablation of one, needs no second look
at the texts: verdicts and ablations are bitwise operations and aggregates on the ledger.

Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none. ``n_repeat_words`` counts words in windows of five words that
occur twice or more in the text; windows are compared by a 64-bit hash within their document. A very long text is one
row's work, linear in its words but for a sort where windows repeat. Null, empty and white texts have zero everywhere
and fail the rule on few words. Repeated rows get a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import SPACE, text_of

WINDOW = 5

#: Name and condition of failure, over the measurements. A rule's bit is its place; never reorder, only append.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    ("exclamations", "10 * n_exclamations > 5 * n_words"),
    ("word_length", "word_chars > 40 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails any rule of ``hard``, or more than ``allowed`` rules of ``soft``."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0

    def verdict(self, bits: Column) -> Column:
        mask = lambda names: reduce(lambda a, b: a | b, (BIT[n] for n in names), 0)
        return (bits.bitwiseAND(F.lit(mask(self.hard))) == 0) & (F.bit_count(bits.bitwiseAND(F.lit(mask(self.soft)))) <= self.allowed)


BASE = Policy("base", ("few_words", "repeated_windows"))
_MORE = ("symbols", "duplicate_lines", "exclamations", "word_length")
POLICIES = {p.version: p for p in (BASE, Policy("v1", BASE.hard + _MORE), Policy("v2", BASE.hard, _MORE, 1))}
PRODUCTION = "v1"


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements and fail_bits for each row of docs."""
    edge = "' \t\n\x0b\f\r'"
    d = docs.select("doc_id", text_of().alias("_text"))
    d = d.withColumn("_trimmed", F.expr(f"trim(BOTH {edge} FROM _text)"))
    d = d.withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", f"{SPACE}+")))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "doc_id",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - F.regexp_count("_text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_exclamations"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    word = lambda i: F.get("_words", i)
    d = d.withColumn(
        "_windows",
        F.when(F.col("n_words") < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*(word(i + k) for k in range(WINDOW))))
        ),
    ).drop("_words")
    # Only texts in which windows repeat are sorted; the others have a null here.
    d = d.withColumn("_sorted", F.when(F.size("_windows") != F.size(F.array_distinct("_windows")), F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda e, j: (F.get("_sorted", j)["h"] == e["h"])
    d = d.withColumn("_again", F.array_sort(F.transform(F.filter("_sorted", lambda e, j: F.coalesce(same(e, j - 1), F.lit(False)) | F.coalesce(same(e, j + 1), F.lit(False))), lambda e: e["i"])))
    covered = F.aggregate(F.transform("_again", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_again", j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_windows", "_sorted", "_again")
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(c), F.lit(BIT[n])).otherwise(F.lit(0)) for n, c in RULES))
    return d.withColumn("fail_bits", bits.cast("long"))


def judge(ledger_rows: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """The ledger with base_failed, and kept by a policy that adds to the base."""
    bits = F.col("fail_bits")
    base_failed = ~BASE.verdict(bits)
    return ledger_rows.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & POLICIES[version].verdict(bits)).withColumn("policy", F.lit(version))


def ablations(ledger_rows: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only its removal would admit. One row for each rule, from one aggregate."""
    return ablations_of(ledger_rows, [version]).drop("policy")


def ablations_of(ledger_rows: DataFrame, versions: list[str]) -> DataFrame:
    """The ablations of several policies, told by policy, from one aggregate over the ledger: rules are evaluated once for all of them."""
    sums, rows = [], []
    for v in versions:
        policy, bits = POLICIES[v], F.col("fail_bits")
        for n in policy.hard + policy.soft:
            without = Policy("", tuple(x for x in policy.hard if x != n), tuple(x for x in policy.soft if x != n), policy.allowed)
            failed, admitted = f"f_{v}_{n}", f"a_{v}_{n}"
            sums.append(F.count_if(bits.bitwiseAND(F.lit(BIT[n])) != 0).alias(failed))
            sums.append(F.count_if(~policy.verdict(bits) & without.verdict(bits)).alias(admitted))
            named = F.lit(v).alias("policy"), F.lit(n).alias("rule")
            rows.append(F.struct(*named, F.col(f"`{failed}`").alias("n_failed"), F.col(f"`{admitted}`").alias("n_admitted_without")))
    total = ledger_rows.agg(F.count("*").alias("n_docs"), *sums)
    return total.select("n_docs", F.explode(F.array(*rows)).alias("x")).select("x.*", "n_docs")


_LEDGER = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, words[i:i+4] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN c USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_exclamations > 5 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END) AS fail_bits
  FROM m)
"""
SQL = _LEDGER + r"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept,
       fail_bits::BIGINT AS fail_bits
FROM f
"""


def ablations_sql(version: str) -> str:
    """DuckDB SQL for ablations() of a policy: by rule, the documents that fail it, and those that only its removal would admit."""
    policy = POLICIES[version]

    def verdict(p: Policy) -> str:
        mask = lambda names: sum(BIT[n] for n in names)
        return f"(fail_bits & {mask(p.hard)}) = 0 AND bit_count(fail_bits & {mask(p.soft)}) <= {p.allowed}"

    rows = []
    for n in policy.hard + policy.soft:
        without = Policy("", tuple(x for x in policy.hard if x != n), tuple(x for x in policy.soft if x != n), policy.allowed)
        rows.append(f"SELECT '{n}' AS rule, count(*) FILTER ((fail_bits & {BIT[n]}) <> 0) AS n_failed, count(*) FILTER (NOT ({verdict(policy)}) AND {verdict(without)}) AS n_admitted_without, count(*) AS n_docs FROM f")
    return _LEDGER + " UNION ALL ".join(rows)
