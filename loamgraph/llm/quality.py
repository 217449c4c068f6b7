"""Statistics of each document's text, and whether it is natural prose.

All counts are vectorised regular-expression counts over the lines of a batch of
documents; nothing is shuffled. Fixed-threshold rules then give every document the
reasons for which it fails.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.letters import slices
from loamgraph.runtime import table

#: Rows up to which the list of common words is taken as a list of words at all.
MAX_COMMON_WORDS = 1_000_000

#: Counted per line: places, not whole matches.
LINE_COUNTS = {
    "letters": r"[\pL\pM]",
    "uncased": r"\p{Lo}",
    "digits": r"\pN",
    "blanks": r"\s",
    "words": r"\pL[\pL\pM'’\-]*",
    "semicolons": r";",
    "tokens": r"\S+",
    "alphabetic": r"[^\pL\s]*\pL\S*",
    "marks": r"#|…|\.\.\.",
    "symbols": r"[^\pL\pM\pN\s.,;:!?'’‘\"“”()\-–—…]",
}

#: Counted per line after a blank: words that begin in lower case.
LOWER_WORD = r"[^\pL\pN\pM'’\-]\p{Ll}"

#: Tested per line.
LINE_TESTS = {
    "ends_punctuated": r"[.!?…:;][\"'”’»)\]]*\s*$",
    "ends_ellipsis": r"(?:…|\.\.\.)\s*$",
    "bullet": r"^\s*(?:[•*·▪◦■●>]|[—–-]\s)",
    "numbered": r"^\s*(?:\(?[0-9]{1,4}[.)]\s|\p{Lu}[\pL0-9]{0,5}\.?\s+[0-9]{1,4}\s+\S+,\s+\S+\s*$)",
    "leaders": r"(?:\.\s?){4}|(?:\.{3})\s*\S*[0-9]",
    "columns": r"\t|\|.*\||\S {4,}\S.* {2,}\S",
    "has_lower": r"\p{Ll}",
}


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. Those of running lines, symbols and bullets decide on prose; the published ones are recorded, and decide alone in ``published``."""

    min_running_lines: float = 0.5
    max_symbols: float = 0.3  # of all marks that are not blank
    max_bullets: float = 0.9
    max_ellipses: float = 0.3
    min_words: int = 50
    max_words: int = 100_000
    min_mean_word: float = 3.0
    max_mean_word: float = 10.0
    min_common: float = 0.06
    # A line of a running sentence:
    line_letters: float = 0.72
    line_lower_words: float = 0.3
    capital_words: int = 4
    line_uncased: float = 0.5  # of its letters, in scripts without case ...
    uncased_letters: int = 8  # ... and as many of them
    # Published rules for web text (Rae et al. 2021, table A1):
    max_marks: float = 0.1  # hash signs and ellipses a word
    min_alphabetic: float = 0.8
    min_stop_words: int = 2  # different common words


#: Failing one of these makes a document other than natural prose.
STRUCTURAL = ("no_words", "few_running_lines", "symbols", "bullets")
#: The published rules, which ``published`` applies alone.
PUBLISHED = ("too_short", "too_long", "word_length", "marks", "bullets", "ellipses", "few_alphabetic", "few_stop_words")

_FIELDS = [
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_share", pa.float64()), ("digit_share", pa.float64()), ("n_lines", pa.int64()),
    ("punctuated_share", pa.float64()), ("bullet_share", pa.float64()), ("ellipsis_share", pa.float64()), ("common_share", pa.float64()), ("mark_ratio", pa.float64()), ("alphabetic_share", pa.float64()), ("n_stop_words", pa.int64()), ("running_share", pa.float64()), ("reasons", pa.string()), ("is_prose", pa.bool_()),
]
SCHEMA = "doc_id bigint, n_words bigint, mean_word_length double, symbol_share double, digit_share double, n_lines bigint, punctuated_share double, bullet_share double, ellipsis_share double, common_share double, mark_ratio double, alphabetic_share double, n_stop_words bigint, running_share double, reasons string, is_prose boolean"


def _number(a) -> np.ndarray:
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return a.to_numpy(zero_copy_only=False).astype(np.float64)


def _per_doc(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def line_statistics(lines: pa.Array) -> dict[str, np.ndarray]:
    out = {k: _number(pc.count_substring_regex(lines, p)) for k, p in LINE_COUNTS.items()}
    out |= {k: _number(pc.match_substring_regex(lines, p)) > 0 for k, p in LINE_TESTS.items()}
    out["lower_words"] = _number(pc.count_substring_regex(pc.binary_join_element_wise("", lines, " "), LOWER_WORD))
    out["length"] = _number(pc.utf8_length(lines))
    return out


def running_lines(s: dict[str, np.ndarray], rules: QualityRules) -> np.ndarray:
    """Lines that read as part of a sentence: mostly letters, no list or table marks, and words in lower case.

    Many words all in capitals will do, and so will many letters of a script that has no case.
    """
    solid = s["length"] - s["blanks"]
    plain = ~(s["bullet"] | s["numbered"] | s["leaders"] | s["columns"]) & (s["semicolons"] < 2)
    wordy = (s["words"] >= 1) & (s["letters"] >= rules.line_letters * solid)
    lower = s["lower_words"] >= np.maximum(1, rules.line_lower_words * s["words"])
    capitals = ~s["has_lower"] & (s["words"] >= rules.capital_words) & (s["digits"] == 0)
    uncased = s["uncased"] >= np.maximum(rules.uncased_letters, rules.line_uncased * s["letters"])
    return plain & wordy & (lower | capitals | uncased)


def _joined(fails: dict[str, np.ndarray]) -> list[str]:
    """The names that hold in each place, joined by comma; each combination is written once."""
    code = sum(np.asarray(v, np.int64) << i for i, v in enumerate(fails.values()))
    kinds, which = np.unique(code, return_inverse=True)
    text = np.array([",".join(k for i, k in enumerate(fails) if c >> i & 1) for c in kinds.tolist()], dtype=object)
    return text[which].tolist()


def text_statistics(ids: pa.Array, texts: pa.Array, common: pa.Array, rules: QualityRules) -> pa.RecordBatch:
    n = len(texts)
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    owner = np.repeat(np.arange(n), _number(pc.list_value_length(lists)).astype(int))
    lines = pc.list_flatten(lists)
    there = _number(pc.match_substring_regex(lines, r"\S")) > 0
    owner, lines = owner[there], lines.filter(pa.array(there))
    s = line_statistics(lines)
    per = lambda v: _per_doc(np.asarray(v, float), owner, n)
    n_lines, n_words, solid = per(np.ones(len(owner))), per(s["words"]), per(s["length"] - s["blanks"])

    # Words of all lines at once, for the share of common ones.
    lowered = pc.utf8_lower(lines)
    tokens = pc.split_pattern_regex(pc.replace_substring_regex(lowered, r"[^\pL\pM'’]+", " "), r"\s+")
    word_owner = np.repeat(owner, _number(pc.list_value_length(tokens)).astype(int))
    flat = pc.list_flatten(tokens)
    known = _number(pc.is_in(flat, value_set=common)) > 0
    filled = _number(pc.utf8_length(flat)) > 0
    common_share = _share(np.bincount(word_owner, weights=known & filled, minlength=n), np.bincount(word_owner, weights=filled, minlength=n))
    # Different common words of each document.
    which = flat.filter(pa.array(known)).dictionary_encode() if known.any() else None
    pairs = np.unique(word_owner[known].astype(np.int64) * (len(common) + 1) + which.indices.to_numpy(zero_copy_only=False)) // (len(common) + 1) if which is not None else np.zeros(0, np.int64)
    n_stop_words = np.bincount(pairs, minlength=n)

    values = {
        "n_words": n_words, "mean_word_length": _share(per(s["letters"]), n_words), "symbol_share": _share(per(s["symbols"]), solid), "digit_share": _share(per(s["digits"]), solid), "n_lines": n_lines,
        "punctuated_share": _share(per(s["ends_punctuated"]), n_lines), "bullet_share": _share(per(s["bullet"]), n_lines), "ellipsis_share": _share(per(s["ends_ellipsis"]), n_lines),
        "common_share": common_share, "mark_ratio": _share(per(s["marks"]), per(s["tokens"])), "alphabetic_share": _share(per(s["alphabetic"]), per(s["tokens"])), "n_stop_words": n_stop_words, "running_share": _share(per(running_lines(s, rules)), n_lines),
    }
    fails = {
        "no_words": n_words == 0,
        "few_running_lines": values["running_share"] < rules.min_running_lines,
        "symbols": values["symbol_share"] > rules.max_symbols,
        "bullets": values["bullet_share"] > rules.max_bullets,
        "ellipses": values["ellipsis_share"] > rules.max_ellipses,
        "too_short": n_words < rules.min_words,
        "too_long": n_words > rules.max_words,
        "word_length": (values["mean_word_length"] < rules.min_mean_word) | (values["mean_word_length"] > rules.max_mean_word),
        "few_common_words": common_share < rules.min_common,
        "marks": values["mark_ratio"] > rules.max_marks,
        "few_alphabetic": values["alphabetic_share"] < rules.min_alphabetic,
        "few_stop_words": n_stop_words < rules.min_stop_words,
    }
    reasons = _joined(fails)
    prose = ~np.logical_or.reduce([fails[k] for k in STRUCTURAL])
    columns = [ids.cast(pa.int64())] + [pa.array(values[k].astype(np.int64) if t == pa.int64() else values[k], t) for k, t in _FIELDS[1:-2]] + [pa.array(reasons, pa.string()), pa.array(prose)]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(_FIELDS))


def text_quality(documents: DataFrame, common_words: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The statistics, reasons and decision of every document; see ``SCHEMA``.

    Null and empty texts have no words and no lines and are not prose; a null id is
    kept; repeated rows are rows of their own; texts of any length are read whole.
    The common words of all languages count, as the language given may be wrong.
    """
    rows = common_words.where("length(word) > 0").select(F.lower("word").alias("word")).distinct().limit(MAX_COMMON_WORDS + 1).toPandas()["word"]
    if len(rows) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    shared = documents.sparkSession.sparkContext.broadcast(list(rows))

    def measure(batches):
        common = pa.array(shared.value, pa.string())
        for b in (x for whole in batches for x in slices(whole, 1)):
            yield text_statistics(b.column(0), b.column(1).cast(pa.string()), common, rules)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(measure, SCHEMA)


def published(quality: DataFrame) -> DataFrame:
    """(doc_id, passes, failed): every document by the published thresholds alone, and the rules it fails."""
    failed = F.array_intersect(F.split("reasons", ","), F.array(*[F.lit(r) for r in PUBLISHED]))
    return quality.select("doc_id", (F.size(failed) == 0).alias("passes"), F.array_join(failed, ",").alias("failed"))


def quality_of(spark, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_word"))
