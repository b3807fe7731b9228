"""Fill-in-the-middle: texts are cut into line units and rearranged by Arrow's own functions, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copytrail.llm.common import in_steps

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int, count: int = 4) -> list[Column]:
    """Numbers below 2**32 that depend on the seed and the id alone; a null id draws like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(units, parents, counts): the lines of all texts with their line ends, the row of each, and how many each row has."""
    pieces = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
    sizes = pc.list_value_length(pieces).to_numpy()
    last = np.zeros(len(flat), dtype=bool)
    last[np.cumsum(sizes) - 1] = True
    ended = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), "", "\n"), "")
    real = pc.or_(pa.array(~last), pc.not_equal(flat, ""))  # nothing follows a line end at a text's end
    parents = pc.filter(parent, real)
    return pc.filter(ended, real), parents, np.bincount(parents.to_numpy(), minlength=len(texts))


def joined(parts: pa.Array, parents: np.ndarray, rows: int) -> pa.Array:
    """The parts of each row as one text; a row without parts has the empty one."""
    offsets = np.zeros(rows + 1, dtype=np.int32)
    np.cumsum(np.bincount(parents, minlength=rows), out=offsets[1:])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), parts), "")


def cut(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """(unit counts, prefixes, middles, suffixes) of texts by two drawn numbers a row."""
    flat, parents, n = units(texts)
    a, b = first % (n + 1), second % (n + 1)
    row = parents.to_numpy()
    ordinal = np.arange(len(flat)) - (np.cumsum(n) - n)[row]
    role = (ordinal >= np.minimum(a, b)[row]).astype(np.int8) + (ordinal >= np.maximum(a, b)[row])
    return n, *(joined(pc.filter(flat, pa.array(role == r)), row[role == r], len(texts)) for r in range(3))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row for each row of docs (doc_id, text).

    A text of n lines is cut at two drawn places between lines. ``form`` is psm (prefix, suffix, middle, each behind its
    mark), spm (suffix first) for ``spm`` in a hundred, or plain: the text itself, for texts that are empty or hold one of
    the marks, and for all but ``rate`` in a hundred. Draws depend on seed and doc_id alone. Lengths are code points of
    prefix and middle, null for plain. A null text counts as empty; a null doc_id draws like an empty one and stays null;
    repeated rows come out repeated; other columns are ignored, whatever their names.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id").cast("long"), seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            texts = batch.column(1)
            n, prefix, middle, suffix = cut(texts, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            plain = pc.or_(batch.column(4), pc.equal(texts, ""))
            for mark in MARKS:
                plain = pc.or_(plain, pc.match_substring(texts, mark))
            form = pc.if_else(plain, "plain", pc.if_else(batch.column(5), "spm", "psm"))
            psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
            changed = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
            output = pc.if_else(plain, texts, pc.if_else(batch.column(5), changed, psm))
            none = pa.scalar(None, pa.int64())
            lengths = [pc.if_else(plain, none, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), form, *lengths, output],
                                             names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"),
                       (h3 % 100 >= rate).alias("skipped"), (h4 % 100 < spm).alias("spm"))
    return rows.mapInArrow(run, OUT)


def _after(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first such mark; nothing after, where there is none."""
    halves = pc.split_pattern(texts, mark, max_splits=1)
    last = pc.if_else(pc.greater(pc.list_value_length(halves), 1), 1, 0).to_numpy(zero_copy_only=False)
    flat, sizes = pc.list_flatten(halves), pc.list_value_length(halves).to_numpy()
    begins = np.cumsum(sizes) - sizes
    return flat.take(pa.array(begins)), pc.if_else(pa.array(last == 1), flat.take(pa.array(begins + last)), "")


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` of ``transform`` with ``restored``, the text rebuilt from ``output`` and ``form`` alone.

    Marks do not occur in texts that were rearranged, and none can arise where two pieces meet, so the first mark of each
    kind ends a piece. A null output is restored as null.
    """
    form, output = (rows.columns.index(c) for c in ("form", "output"))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "restored"), T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, output):
            outputs, forms = batch.column(output), batch.column(form)
            held = pc.fill_null(outputs, "")
            a_head, a_rest = _after(held, SUFFIX)  # psm: <P>prefix | suffix<M>middle
            a_suffix, a_middle = _after(a_rest, MIDDLE)
            b_head, b_rest = _after(held, PREFIX)  # spm: <S>suffix | prefix<M>middle
            b_prefix, b_middle = _after(b_rest, MIDDLE)
            skip = len(PREFIX)
            psm = pc.binary_join_element_wise(pc.utf8_slice_codeunits(a_head, skip), a_middle, a_suffix, "")
            spm = pc.binary_join_element_wise(b_prefix, b_middle, pc.utf8_slice_codeunits(b_head, skip), "")
            text = pc.if_else(pc.equal(forms, "plain"), outputs, pc.if_else(pc.equal(forms, "spm"), spm, psm))
            text = pc.if_else(pc.is_null(outputs), pa.scalar(None, pa.string()), text)
            own = {name: batch.column(i) for i, name in enumerate(batch.schema.names) if name != "restored"} | {"restored": text}
            yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))

    return rows.mapInArrow(run, schema)
