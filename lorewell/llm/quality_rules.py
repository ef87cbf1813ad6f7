"""Quality rules as a bitmask ledger.

Every document is measured once, and every rule evaluated once on the measurements; the ledger holds the measurements and one
failure bit a rule.  What is kept is decided later, from the bits alone, by versioned policies (sets of rules), and what each
rule costs under a policy comes from counts by bit pattern: nothing is measured again.  A rule's bit never gets another meaning:
a new threshold is a new rule with the next bit, so that ledgers written by earlier versions stay readable.

Measuring is one pass without a shuffle; bits and verdicts are column expressions; an ablation sums at most one row for each
pattern that occurs, task and group.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, case kept; lines are divided by line feeds.  Nulls and edges: a null or
blank text has no words and fails ``few_words``; texts are measured whole, however long; repeated rows are measured one by one;
ids may be null or repeat; an empty table gives an empty ledger; further columns pass through where they are asked for in
``carry``, those whose names clash with a measurement's are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.packed import trim
from lorewell.llm.scratch import modest_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_letter_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition on the measurements."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule(3, "symbols", "10 * n_symbols > n_words"),
    Rule(4, "few_letters", "100 * n_letter_words < 80 * n_words"),
    Rule(5, "half_repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(6, "third_repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(7, "bullets", "100 * n_bullet_lines > 90 * n_lines"),
    Rule(8, "ellipses", "100 * n_ellipsis_lines > 30 * n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """Documents that fail none of ``rules`` are kept."""

    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in set(self.rules))


BASE = ("few_words", "repeated_words")
#: 1: the base rules alone; 2: with rules that prose in any language passes; 3: stricter about lines.
POLICIES = (
    Policy(1, BASE),
    Policy(2, (*BASE, "word_length", "symbols", "few_letters", "half_repeated_lines")),
    Policy(3, (*BASE, "word_length", "symbols", "few_letters", "half_repeated_lines", "third_repeated_lines", "bullets", "ellipses")),
)
CURRENT = POLICIES[1]


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by owner (owners ascend)."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(total[np.searchsorted(of, np.arange(n + 1))])


def _pair(left: np.ndarray, right: np.ndarray, right_kinds: int) -> np.ndarray:
    """One number for each different pair; exact: no hash stands for a value."""
    return pd.factorize(left.astype(np.int64) * max(right_kinds, 1) + right)[0].astype(np.int64)


def _occurrences(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Owners and numbers of the strings in lists, and the different strings by number."""
    coded = pc.list_flatten(lists).dictionary_encode()
    return np.asarray(pc.list_parent_indices(lists), np.int64), np.asarray(coded.indices, np.int64), coded.dictionary


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text (null: empty)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    out = {"n_symbols": np.asarray(pc.count_substring_regex(texts, "[#*$%&|<>]"), np.int64)}

    owner, word, different = _occurrences(pc.ascii_split_whitespace(texts))
    there = np.asarray(pc.greater(pc.binary_length(different), 0), bool)[word] if len(word) else np.zeros(0, bool)
    owner, word = owner[there], word[there]
    chars = np.asarray(pc.utf8_length(different), np.int64)
    lettered = np.asarray(pc.match_substring_regex(different, "\\pL"), bool)
    out |= {"n_words": np.bincount(owner, minlength=n), "word_chars": _sums(chars[word], owner, n), "n_letter_words": _sums(lettered[word], owner, n)}

    covered = np.zeros(len(word), bool)
    if len(word) > 2:
        first = _pair(owner, word, len(different))
        two = _pair(first[:-1], word[1:], len(different))
        three = _pair(two[:-1], word[2:], len(different))
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        times = np.bincount(three[inside], minlength=len(three))
        twice = inside[times[three[inside]] > 1]
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = _sums(covered, owner, n)

    owner, line, different = _occurrences(pc.split_pattern(texts, "\n"))
    worded = np.asarray(pc.match_substring_regex(different, "[^\\x20\\x09-\\x0D]"), bool)[line] if len(line) else np.zeros(0, bool)
    owner, line = owner[worded], line[worded]
    key = _pair(owner, line, len(different))
    new = np.zeros(len(key), bool)
    new[np.unique(key, return_index=True)[1]] = True
    bullet = np.asarray(pc.match_substring_regex(different, "^[\\x20\\x09-\\x0D]*[-*•]"), bool)
    dots = np.asarray(pc.match_substring_regex(different, "(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"), bool)
    out |= {"n_lines": np.bincount(owner, minlength=n), "n_dup_lines": _sums(~new, owner, n), "n_bullet_lines": _sums(bullet[line], owner, n), "n_ellipsis_lines": _sums(dots[line], owner, n)}
    return out


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """All failure bits in one number, from the measurements."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    out = F.lit(0).cast("long")
    for bit in bits:
        out = out.bitwiseOR(bit)
    return out


def ledger(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``carry``, the measurements and ``fails``, the failure bits, of every row."""
    modest_batches(docs.sparkSession)
    carry = tuple(c for c in carry if c not in MEASURES and c != "fails")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"{m} long" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(len(carry)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), *(pa.array(found[m], pa.int64()) for m in MEASURES)], [*carry, *MEASURES])
        trim()

    measured = docs.select(*[F.col(c) for c in carry], F.col(text_col).alias("__text")).mapInArrow(run, schema)
    return measured.withColumn("fails", fail_bits(rules))


def kept_by(policy: Policy, rules: tuple[Rule, ...] = RULES, fails: str = "fails") -> Column:
    return F.col(fails).bitwiseAND(F.lit(policy.mask(rules))) == 0


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, by: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule does under each policy, for each group ``by``: version, rule, n_docs, n_failed (documents with its bit),
    n_failed_alone (with no other bit of the policy), n_kept, n_kept_without (kept if the rule were taken out), and any_fails,
    all_fails: the bits set in some, and in all, documents of the group."""
    patterns = book.groupBy(*by, "fails").agg(F.count("*").alias("n"))
    cases = F.array(*[F.struct(F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"), F.lit(p.mask(rules)).cast("long").alias("mask")) for p in policies for r in rules if r.name in p.rules])
    each = patterns.select(*by, "fails", "n", F.explode(cases).alias("case")).select(*by, "fails", "n", "case.*")
    of_policy = F.col("fails").bitwiseAND(F.col("mask"))

    def counted(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    return each.groupBy(*by, "version", "rule").agg(
        F.sum("n").alias("n_docs"), counted(of_policy.bitwiseAND(F.col("bit")) != 0, "n_failed"), counted(of_policy == F.col("bit"), "n_failed_alone"),
        counted(of_policy == 0, "n_kept"), counted((of_policy == 0) | (of_policy == F.col("bit")), "n_kept_without"),
        F.bit_or("fails").alias("any_fails"), F.bit_and("fails").alias("all_fails"),
    )


def judge_documents(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """One row a document: doc_id, the base measurements, base_failed, kept, and the ledger's bits with the policy's version."""
    base = next(p for p in POLICIES if p.rules == BASE)
    both = Policy(policy.version, (*base.rules, *policy.rules))
    book = ledger(docs)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~kept_by(base)).alias("base_failed"), kept_by(both).alias("kept"), "fails", F.lit(policy.version).alias("policy"))
