"""End-to-end plans: documents to matrix, and the line-typing path."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import (
    batching, context, hierarchy, lines, output, reconcile, rowgen, rules, segments, typed,
)
from docloom.plans.staging import write_stage

_INFO = tuple(hierarchy.BLOCK_INFO.values())
_BLOCK = ["doc_id", "block_no"]


class MatrixRun(NamedTuple):
    """What a run gives: the matrix, and what a user needs to tell a partial one from a whole one."""

    rows: DataFrame
    #: one row per failed batch: file, block numbers, error
    failures: DataFrame
    #: per document: batches, failed ones, and whether its output is partial
    outcome: DataFrame
    #: responses that could not be read, ``(doc_id, batch_no, attempt, error)``; their blocks fell back
    invalid: DataFrame
    #: blocks with batch numbers and orientation, for debug output
    blocks: DataFrame


def document_blocks(documents: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """``(doc_id, doc_order, filename, text)`` to described blocks; one exchange."""
    annotated = segments.annotate_documents(documents)
    return context.classify_blocks(segments.build_blocks(lines.clean_text_lines(annotated, noise)))


def prepared_blocks(documents: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Blocks with rule orientation and batch numbers, written as a stage."""
    blocks = write_stage(document_blocks(documents), "blocks")
    oriented = rules.orient_blocks(blocks, rule_table)
    return write_stage(batching.pack_batches(oriented), "oriented")


def matrix(documents: DataFrame, rule_table: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Documents to the numbered, deduplicated matrix with row ids; see ``run_matrix`` for failures.

    ``responses(doc_id, batch_no, attempt, response)`` holds what a model answered for
    the residue blocks; without it those blocks take their deterministic fallback.  Where
    documents have a ``submission_id``, roots and row ids start anew in every submission;
    otherwise all documents are one.
    """
    return run_matrix(documents, rule_table, responses).rows


def run_matrix(documents: DataFrame, rule_table: DataFrame, responses: DataFrame | None = None) -> MatrixRun:
    """The matrix with its failures: a batch of which a block has no row fails as a whole, the others go on."""
    blocks = prepared_blocks(documents, rule_table)
    produced = write_stage(produced_rows(blocks, responses), "produced")
    errors = coverage_errors(blocks, produced)
    lost = blocks.join(errors, ["doc_id", "batch_no"], "left_semi").select(*_BLOCK)
    rows = reconcile.order_and_prune(produced.join(lost, _BLOCK, "left_anti"))
    tried = blocks.select("doc_id", "filename", "doc_order", "batch_no", "block_no")
    invalid = blocks.select("doc_id", "batch_no", F.lit(0).alias("attempt"), F.lit("").alias("error")).limit(0)
    return MatrixRun(
        finish(
            write_stage(rows, "rows"),
            documents.select("doc_id", "submission_id") if "submission_id" in documents.columns else None,
        ),
        output.failure_report(tried, errors),
        output.run_outcome(tried, errors),
        invalid if responses is None else reconcile.parse_responses(responses)[1],
        blocks,
    )


def coverage_errors(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """``(doc_id, batch_no, error)`` of the batches with blocks that no row answers; at most eight numbers each."""
    missing = reconcile.uncovered_blocks(blocks.select(*_BLOCK, "batch_no"), rows)
    numbers = F.transform(F.sort_array(F.collect_list("block_no")), lambda n: n.cast("string"))
    return missing.groupBy("doc_id", "batch_no").agg(F.concat(F.lit("uncovered_blocks: "), F.array_join(numbers, ", ")).alias("error"))


def batch_rows(blocks: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Rows of every block: deterministic, answered, or fallen back; block columns kept."""
    return reconcile.order_and_prune(produced_rows(blocks, responses))


def produced_rows(blocks: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """The same before rows without a description leave."""
    info = hierarchy.block_info(blocks)
    fallback = rowgen.block_to_rows(info, _INFO)
    if responses is None:
        return reconcile.fill_detected_item_inline(fallback)
    fallback = write_stage(fallback, "fallback")  # read by five branches
    residue = blocks.where(rowgen.needs_model(blocks))
    plain = ["doc_id", "doc_order", *hierarchy.ROW_COLUMNS]
    answers, _ = reconcile.parse_responses(responses)

    asked = residue.select("doc_id", "doc_order", "batch_no", "block_no", F.col("text").alias("b_text"))

    def attempt(n: int, request: DataFrame) -> DataFrame:
        mine = answers.where(F.col("attempt") == n)
        fixed = reconcile.repair_orders(mine, request.select("doc_id", "batch_no", "block_no"))
        known = fixed.join(request.drop("batch_no"), _BLOCK)
        return known.where(reconcile.grounded_flag(known)).select(*plain)

    first = attempt(1, asked)
    # the second request holds only what the first left open, so its positions count those
    second = attempt(2, reconcile.uncovered_blocks(asked, first))

    model_part = fallback.join(residue.select(*_BLOCK), _BLOCK, "left_semi").select(*plain)
    fixed_part = fallback.join(residue.select(*_BLOCK), _BLOCK, "left_anti").select(*plain)
    chosen = write_stage(reconcile.fallback_union(fixed_part.limit(0), first, second, model_part), "chosen")
    shown = F.coalesce(F.when(F.col("item_source") != "", F.col("item_source")), F.col("item"), F.lit(""))
    sources = residue.withColumn("b_descr", rowgen.source_text(F.col("text"), shown))
    guarded = reconcile.granularity_guard(chosen, sources, model_part)
    joined = hierarchy.with_block_info(fixed_part.unionByName(guarded), blocks)
    return reconcile.fill_detected_item_inline(joined)


def finish(rows: DataFrame, submissions: DataFrame | None = None) -> DataFrame:
    """Number, normalise, dedupe and id the rows of a corpus, or of each submission in it."""
    outlined = write_stage(hierarchy.outline_rows(rows), "outlined")
    stats = hierarchy.root_stats(outlined)
    if submissions is not None:
        stats = stats.join(submissions, "doc_id")
    scope = () if submissions is None else ("submission_id",)
    roots = hierarchy.cross_document_offset(stats, scope)
    numbered = hierarchy.apply_roots(outlined, roots.select("doc_id", F.col("root").alias("root_first"), "r"))
    unique = output.dedupe_keep_first(output.normalize_rows(numbered))
    if submissions is not None:
        unique = unique.join(submissions, "doc_id")
    return output.assign_row_ids(unique, position=("doc_id", *output.POSITION), scope=scope)


def typed_corpus(documents: DataFrame) -> DataFrame:
    """The line-typing path: heading markup, document type, line classes."""
    marked = documents.withColumn(
        "text",
        F.array_join(F.transform(T.split_lines(T.normalize_multiline(F.col("text"))), T.heading_markup), "\n"),
    )
    return typed.classify_documents(marked)
