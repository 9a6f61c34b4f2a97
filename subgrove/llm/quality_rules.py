"""A ledger of quality rules: every rule evaluated once per document, policies applied to the stored bits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .text import covered, mix, rolling, starts_within, tidy, word_hashes

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"


def _rules() -> dict[str, Column]:
    """What fails a rule, in terms of the measurements. A rule's bit is its place here; new rules go to the end."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "few_words": F.col("n_words") < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 10 * words,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 30 * lines,
        "short_words": F.col("word_chars") < 2 * F.col("n_words"),
        "long_words": F.col("word_chars") > 25 * words,
    }


RULES = ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words")
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version of what rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("v1", BASE + ("symbols", "duplicate_lines")), Policy("v2", RULES))}


def _measured(pdf: pd.DataFrame) -> pd.DataFrame:
    hashes, at = word_hashes(pdf["text"])
    windows, inside = rolling(hashes, 5), starts_within(at, 5)
    again = np.zeros(0, int)
    if len(windows):
        start = np.flatnonzero(inside)
        own = mix(windows[start] + mix(np.searchsorted(at, start, side="right").astype(np.uint64)))
        _, back, count = np.unique(own, return_inverse=True, return_counts=True)
        again = start[count[back] >= 2]
    repeated = np.r_[0, np.cumsum(covered(again, 5, len(hashes)))]
    rows = []
    for text in pdf["text"]:
        raw = text.encode() if text else b""
        lines = [x for x in raw.split(b"\n") if x.strip()]
        rows.append((len(raw.translate(None, _SPACE).decode()), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines))))
    out = pd.DataFrame(rows, columns=["word_chars", "n_symbols", "n_lines", "n_dup_lines"], dtype="int64")
    return out.assign(doc_id=pdf["doc_id"].array, n_words=np.diff(at), n_repeat_words=repeated[at[1:]] - repeated[at[:-1]])[["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]]


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, measurements, and failed, the bits of the rules that it fails.

    Words are runs of characters other than 0x20 and 0x09-0x0D. A null or empty text has none, and so fails
    few_words. Null ids and repeated rows are kept; very long texts are measured whole; an empty table gives no rows.
    One pass over the texts, no shuffle. Write it once (the query does): policies and ablations read the bits. Other columns are not read.
    """

    def measure(it):
        for pdf in X.pieces(it):
            yield _measured(pdf)
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(measure, schema)
    bits = [F.when(fails, F.lit(1 << RULES.index(name))).otherwise(F.lit(0)).cast("long") for name, fails in _rules().items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def judged(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with policy (its version), kept, and failed_alone: the bit of the rule without which the policy would keep the document, or 0."""
    failed = F.col("failed").bitwiseAND(F.lit(policy.mask))
    return rows.withColumns({"policy": F.lit(policy.version), "kept": failed == 0, "failed_alone": F.when(F.bit_count(failed) == 1, failed).otherwise(F.lit(0)).cast("long")})


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it.

    Documents are first counted by their failure bits, so at most 2 ** len(RULES) rows are shuffled a task.
    """
    counted = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.rules)))
    rule = counted.withColumn("r", each).select("bits", "n", "r.rule", "r.bit")
    has, alone, none = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit"), F.col("bits") == 0
    sums = {"n_failed": has, "n_failed_alone": alone, "n_kept": none, "n_kept_without": alone | none}
    return rule.groupBy("rule").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in sums.items()))
