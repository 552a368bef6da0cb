"""Exact duplicates by a distributed sort of the contents.

Texts are brought into one global order: the first characters of the normalised text, then its SHA-256, then the
identifier. Sampled splitters cut that order into ranges, each range is sorted (externally where it must spill), and
equal texts come to lie side by side. A walk over each sorted range compares neighbours in full; the first row of a
run has the smallest identifier. Because the identifier belongs to the order, a text with very many copies is cut
over as many ranges as its rows need; the first and last run of every range, at most two rows a range, are then
matched across ranges.

Defined results: a missing text is an empty one; missing identifiers come last in the order, so they stay only if all
of a group are missing; of rows with one identifier and equal texts exactly one stays; an empty table gives an empty
result; further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payouts.llm.common import SPACES, cut, fresh, text_of

#: Characters of the normalised text that lead the order. Bounds the splitters that Spark samples to the driver.
LEAD = 32


def _normal(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(texts, ""), pattern=SPACES, replacement=" ")


def _walk(identifier: str, text: str, digest: str, extra: list[str], keep_columns: list[str], heads_only: bool):
    """A walk over one sorted range that adds the columns of `extra`: first identifier of the run, its rows, whether
    the row is the run's first, whether the run touches an end of the range, and the number of the range.

    It holds the rows of the open run, without their texts, or only its first row if only first rows are asked for.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pending: list[tuple[pa.Table, np.ndarray]] = []
        size, first, first_id, last = 0, True, None, None

        def rows(chunk: pa.Table, head: np.ndarray, keep, count, edge: bool) -> list[pa.RecordBatch]:
            n = chunk.num_rows
            keep = keep if keep is not None else pa.nulls(n, chunk.schema.field(identifier).type)
            added = [keep, pa.array(np.broadcast_to(np.asarray(count, np.int64), n)), pa.array(head),
                     pa.array(np.full(n, edge)), pa.array(np.full(n, part, np.int32))]
            out = chunk.select(keep_columns)
            for name, column in zip(extra, added, strict=True):
                out = out.append_column(name, column)
            return out.combine_chunks().to_batches()

        def slim(chunk: pa.Table, head: np.ndarray) -> tuple[pa.Table, np.ndarray]:
            return (chunk.filter(pa.array(head)), head[head]) if heads_only else (chunk, head)

        def close(edge: bool) -> Iterator[pa.RecordBatch]:
            for chunk, head in pending:
                if chunk.num_rows:
                    keep = pa.repeat(pa.scalar(first_id, chunk.schema.field(identifier).type), chunk.num_rows)
                    yield from rows(chunk, head, keep, size, edge)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, texts = batch.column(digest), batch.column(text)
            same = np.zeros(batch.num_rows, bool)
            if batch.num_rows > 1:
                same[1:] = pc.equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            if (near := np.flatnonzero(same)).size:
                same[near] = pc.equal(_normal(texts.take(pa.array(near))), _normal(texts.take(pa.array(near - 1)))).to_numpy(zero_copy_only=False)
            if last is not None and last[0] == keys[0].as_py():
                same[0] = last[1] == _normal(texts[:1])[0].as_py()
            last = (keys[-1].as_py(), _normal(texts[-1:])[0].as_py())
            starts = np.flatnonzero(~same)
            whole = pa.Table.from_batches([batch])
            whole = whole.select(list(dict.fromkeys([*keep_columns, identifier])))
            begin, end = (int(starts[0]), int(starts[-1])) if starts.size else (batch.num_rows, batch.num_rows)
            if begin:
                pending.append(slim(whole.slice(0, begin), ~same[:begin]))
                size += begin
            if not starts.size:
                continue
            if size:
                yield from close(first)
                first = False
            if end > begin:
                head = ~same[begin:end]
                number = np.cumsum(head) - 1
                at = np.flatnonzero(head)
                counts = np.diff(np.append(at, end - begin))[number]
                chunk = whole.slice(begin, end - begin)
                keep = chunk.column(identifier).take(pa.array(at[number])).combine_chunks()
                edges = [(np.arange(end - begin) < (at[1] if at.size > 1 else end - begin), True)] if first else []
                edges.append((~edges[0][0], False) if edges else (np.ones(end - begin, bool), False))
                for mask, edge in edges:
                    mask = mask & head if heads_only else mask
                    if mask.any():
                        chosen = pa.array(mask)
                        yield from rows(chunk.filter(chosen), head[mask], keep.filter(chosen), counts[mask], edge)
                first = False
            first_id = whole.column(identifier)[end].as_py()
            pending, size = [slim(whole.slice(end), ~same[end:])], batch.num_rows - end
        if size:
            yield from close(True)

    return walk


def _sorted(frame: DataFrame, identifier: str, text: str, lead: str, digest: str, normal: str) -> DataFrame:
    content = frame.withColumn(normal, F.regexp_replace(text_of(text), SPACES, " "))
    keyed = content.withColumns({lead: F.substring(normal, 1, LEAD), digest: F.unhex(F.sha2(normal, 256))}).drop(normal)
    order = [F.col(lead), F.col(digest), F.col(identifier).asc_nulls_last()]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order)


def _walked(frame: DataFrame, identifier: str, text: str, keep_columns: list[str], heads_only: bool) -> tuple[DataFrame, list[str], str]:
    lead, digest, normal, *extra = fresh(frame, "lead", "digest", "normal", "keep", "size", "head", "edge", "part")
    ranged = _sorted(frame, identifier, text, lead, digest, normal)
    kind = frame.schema[identifier].dataType.simpleString()
    kinds = [kind, "bigint", "boolean", "boolean", "int"]
    schema = ", ".join([*(f"`{c}` {ranged.schema[c].dataType.simpleString()}" for c in [*keep_columns, digest]), *(f"`{c}` {k}" for c, k in zip(extra, kinds, strict=True))])
    walk = _walk(identifier, text, digest, extra, [*keep_columns, digest], heads_only)
    return ranged.mapInArrow(walk, schema), extra, digest


def exact_groups(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: its identifier, `keep_id`, `group_size`, `kept` and `text_sha256` of the normalised text."""
    rows, (keep, size, head, edge, part), digest = _walked(docs.select(identifier, text), identifier, text, [identifier], False)
    rows = cut(rows)
    ends = rows.filter(F.col(edge) & F.col(head)).groupBy(F.col(digest).alias("end_digest")).agg(
        F.min_by(keep, part).alias("end_keep"), F.sum(size).alias("end_size"), F.min(part).alias("end_part"))
    # Two rows a range at most, whatever the number of documents.
    joined = rows.join(F.broadcast(ends), F.when(F.col(edge), F.col(digest)) == F.col("end_digest"), "left")
    crossed = F.col("end_part").isNotNull()
    return joined.select(
        F.col(identifier),
        F.when(crossed, F.col("end_keep")).otherwise(F.col(keep)).alias("keep_id"),
        F.coalesce("end_size", size).alias("group_size"),
        (F.col(head) & (~crossed | (F.col("end_part") == F.col(part)))).alias("kept"),
        F.lower(F.hex(digest)).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    heads, (_, _, _, edge, part), digest = _walked(docs, identifier, text, docs.columns, True)
    heads = cut(heads)
    ends = heads.filter(edge).groupBy(F.col(digest).alias("end_digest")).agg(F.min(part).alias("end_part"))
    joined = heads.join(F.broadcast(ends), F.when(F.col(edge), F.col(digest)) == F.col("end_digest"), "left")
    return joined.filter(F.col("end_part").isNull() | (F.col("end_part") == F.col(part))).select(*(F.col(f"`{c}`") for c in docs.columns))
