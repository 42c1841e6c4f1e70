"""Fill-in-the-middle: texts cut at two unit borders, their parts put into another order.

A unit is a run of separators with the word behind it, or separators at the text's end. A text is matched twice and
lazily: the first pass only counts its units; once both ranks are drawn from that number, the second advances an
iterator to the smaller and then to the larger rank and notes where each unit ends. Neither pass holds more than the
match at hand, so memory follows the text itself, however many units it has. Draws depend on the seed and the row's id
alone: a task that runs again, on another machine or over other splits, cuts alike. There is no shuffle.
"""

from __future__ import annotations

import re
from collections import deque
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.textscan import batches

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
# What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
DRAWS = 4
BATCH_BYTES = 2 << 20


def draws(row_id: Column, seed: int) -> Column:
    """Four numbers of 32 bits: the first groups of eight digits of the SHA-256 of seed and id. A null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(DRAWS)])


def count_units(text: str) -> int:
    """The first pass: how many units a text has."""
    n = count()
    deque(zip(UNIT.finditer(text), n, strict=False), maxlen=0)
    return next(n)


def borders(text: str, first: int, second: int) -> tuple[int, int]:
    """The second pass: where the ``first``-th and the ``second``-th unit end, ``first <= second``; rank 0 is the text's start."""
    matches = UNIT.finditer(text)
    a = next(islice(matches, first - 1, None)).end() if first else 0
    b = next(islice(matches, second - first - 1, None)).end() if second > first else a
    return a, b


def transform(text: str, drawn: list[int], sentinels: tuple[str, str, str], fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and output of one text."""
    n = count_units(text)
    p, s, m = sentinels
    if not text or drawn[2] % 100 >= fim_percent or any(x in text for x in sentinels):
        return n, "plain", None, None, text
    ranks = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = borders(text, *ranks)
    if drawn[3] % 100 < spm_percent:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def _check(sentinels: tuple[str, str, str]) -> None:
    """Outputs can be read back only if no sentinel can begin inside of another one."""
    for i, x in enumerate(sentinels):
        for j, y in enumerate(sentinels):
            if not x or (i != j and x in y) or any(x.endswith(y[:k]) for k in range(1, len(y))):
                raise ValueError(f"sentinels overlap: {x!r} and {y!r}")


def _task(sentinels: tuple[str, str, str], fim_percent: int, spm_percent: int):
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]

    def run(source):
        for batch in batches(source, ["text"], BATCH_BYTES):
            texts, drawn = batch.column("text"), batch.column("drawn").to_pylist()
            rows = [transform(texts[i].as_py() or "", drawn[i], sentinels, fim_percent, spm_percent) for i in range(batch.num_rows)]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            cols[-1] = cols[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *cols], ["row", *names])

    return run


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``: a row for each row of ``docs``.

    Of ``fim_percent`` in a hundred texts the output is ``spm`` (suffix, prefix, middle) for ``spm_percent`` in a hundred
    and ``psm`` (prefix, suffix, middle) for the others, each part behind its sentinel; all others are ``plain``, the text as it is,
    and so are empty texts and those that hold a sentinel. Null texts are empty. Rows that repeat an id are cut by the same draws,
    each text by itself; a null id has draws of its own. Prefix, middle and suffix may be empty. Other columns are
    ignored; no rows give no rows. Sentinels that overlap raise an error.
    """
    _check(sentinels)
    rows = docs.select(F.col(id_col).alias("row"), draws(F.col(id_col), seed).alias("drawn"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    got = rows.mapInArrow(_task(sentinels, fim_percent, spm_percent), f"row {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return got.withColumnRenamed("row", "doc_id")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of. In outputs that are not plain each sentinel stands once, so they part it."""
    p, s, m = (F.lit(x) for x in sentinels)
    part = F.split_part
    middle = part(output, m, F.lit(2))
    psm = F.concat(part(part(output, s, F.lit(1)), p, F.lit(2)), middle, part(part(output, s, F.lit(2)), m, F.lit(1)))
    spm = F.concat(part(part(output, p, F.lit(2)), m, F.lit(1)), middle, part(part(output, p, F.lit(1)), s, F.lit(2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
