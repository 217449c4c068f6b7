"""Queries of the text problems (p6 to p8) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.llm import leakage, packing, quality
from loamgraph.llm.quality import LINE_COUNTS, LINE_TESTS, LOWER_WORD
from loamgraph.runtime import table


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _names(flags: str) -> str:
    return ", ".join(f"case when {f} then '{f}' end" for f in flags.split())


_P8 = f"""
with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) l from documents),
counted as (
  select doc_id, length(l) length, {", ".join(f"len(regexp_extract_all(l, {_quoted(p)})) {k}" for k, p in LINE_COUNTS.items())}, len(regexp_extract_all(' ' || l, {_quoted(LOWER_WORD)})) lower_words,
    {", ".join(f"regexp_matches(l, {_quoted(p)}) {k}" for k, p in LINE_TESTS.items())}
  from lines where regexp_matches(l, '\\S')),
judged as (
  select *, not (bullet or numbered or leaders or columns) and semicolons < 2 and words >= 1 and letters >= 0.72 * (length - blanks)
    and (lower_words >= greatest(1, 0.3 * words) or (not has_lower and words >= 4 and digits = 0) or uncased >= greatest(8, 0.5 * letters)) running from counted),
per_doc as (
  select doc_id, sum(words)::bigint n_words, count(*)::bigint n_lines, sum(marks) / sum(tokens) mark_ratio, sum(alphabetic) / sum(tokens) alphabetic_share, avg(ends_ellipsis::int) ellipsis_share, avg(running::int) running_share, avg(ends_punctuated::int) punctuated_share, avg(bullet::int) bullet_share,
    case when sum(words) > 0 then sum(letters) / sum(words) else 0 end mean_word_length, sum(symbols) / sum(length - blanks) symbol_share
  from judged group by 1),
tokens as (
  select doc_id, unnest(string_split(trim(regexp_replace(lower(l), '[^\\pL\\pM''’]+', ' ', 'g')), ' ')) w from lines where regexp_matches(l, '\\S')),
common as (
  select doc_id, count(*) filter (w <> '') n, count(*) filter (w in (select lower(word) from common_word where length(word) > 0)) k, count(distinct w) filter (w in (select lower(word) from common_word where length(word) > 0)) n_stop_words from tokens group by 1),
every as (
  select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_lines, 0) n_lines, coalesce(running_share, 0.0) running_share, coalesce(punctuated_share, 0.0) punctuated_share,
    coalesce(bullet_share, 0.0) bullet_share, coalesce(mean_word_length, 0.0) mean_word_length, coalesce(symbol_share, 0.0) symbol_share,
    coalesce(mark_ratio, 0.0) mark_ratio, coalesce(alphabetic_share, 0.0) alphabetic_share, coalesce(ellipsis_share, 0.0) ellipsis_share, coalesce(n_stop_words, 0) n_stop_words, case when n > 0 then k / n else 0 end common_share
  from (select doc_id from documents) d left join per_doc using (doc_id) left join common using (doc_id)),
failed as (
  select doc_id, n_words = 0 no_words, running_share < 0.5 few_running_lines, symbol_share > 0.3 symbols, bullet_share > 0.9 bullets, ellipsis_share > 0.3 ellipses, n_words < 50 too_short, n_words > 100000 too_long,
    mean_word_length < 3 or mean_word_length > 10 word_length, common_share < 0.06 few_common_words, mark_ratio > 0.1 marks, alphabetic_share < 0.8 few_alphabetic, n_stop_words < 2 few_stop_words from every)
"""


def queries() -> dict:
    return {
        "p6_method": lambda s, d: packing.packed_of(s, d, across=False),
        "p6_found": lambda s, d: packing.oversize(packing.packed_of(s, d)),
        "p6_fill": lambda s, d: packing.fill(packing.packed_of(s, d), table(s, d, "container_spec")),
        "p6_method_fill": lambda s, d: packing.fill(packing.packed_of(s, d, across=False), table(s, d, "container_spec")),
        "p6_pieces": lambda s, d: packing.packed_of(s, d).groupBy("container_id", "doc_id").agg(F.max("pieces").alias("n_pieces"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")),
        "p7_found": lambda s, d: leakage.leaks_of(s, d).select("doc_id", "item_id"),
        "p7_items": lambda s, d: leakage.leaks_of(s, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("longest")),
        "p8_method": lambda s, d: quality.published(quality.quality_of(s, d)),
        "p8_found": lambda s, d: quality.quality_of(s, d).where(~F.col("is_prose")).select("doc_id"),
        "p8_statistics": lambda s, d: quality.quality_of(s, d).select("doc_id", "n_words", "n_lines", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_share", "punctuated_share", "bullet_share", "running_share")]),
        "p8_reasons": lambda s, d: quality.quality_of(s, d).groupBy("reasons", "is_prose").agg(F.count(F.lit(1)).alias("n_documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": "select container_id, doc_id from documents, container_spec where octet_length(encode(text)) + 1 > capacity_tokens",
        "p6_pieces": "select container_id, doc_id, (octet_length(encode(text)) + capacity_tokens) // capacity_tokens n_pieces, octet_length(encode(text)) + 1 tokens, (octet_length(encode(text)) + capacity_tokens) // capacity_tokens n_rows from documents, container_spec where text is not null",
        "p8_found": _P8 + "select doc_id from every where n_words = 0 or running_share < 0.5 or symbol_share > 0.3 or bullet_share > 0.9",
        "p8_method": _P8 + "select doc_id, failed = '' passes, failed from (select doc_id, concat_ws(',', " + _names("bullets ellipses too_short too_long word_length marks few_alphabetic few_stop_words") + ") failed from failed)",
        "p8_reasons": _P8 + "select reasons, not (no_words or few_running_lines or symbols or bullets) is_prose, count(*) n_documents from (select *, concat_ws(',', " + _names("no_words few_running_lines symbols bullets ellipses too_short too_long word_length few_common_words marks few_alphabetic few_stop_words") + ") reasons from failed) group by 1, 2",
        "p8_statistics": _P8 + "select doc_id, n_words, n_lines, round(mean_word_length, 6) mean_word_length, round(symbol_share, 6) symbol_share, round(punctuated_share, 6) punctuated_share, round(bullet_share, 6) bullet_share, round(running_share, 6) running_share from every",
    }
