"""Fill-in-the-middle: a text is cut at two places and its parts change order, with a mark before each.

The tokenizers library's Split pre-tokenizer, which nothing trains, cuts a text into matches that each stand alone and
tells where they begin and end, in code points. A first pass matches STEP code points at a time, a second one matches
single code points of those pieces only that hold a cut, and of the last one. The number of offsets gives the text's
length, and a cut's rank among them its place. (Single code points throughout cost 1.2 microseconds each, which is ten
times as much, and about 250 bytes of Python objects each, which no bounded worker has for a long text.)
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import id_and_text, map_batches, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points in a match of the first pass, and in a part of a long text that one call gets.
STEP, PART = 64, 1 << 20
PLAIN_FROM, SPM_BELOW = 90, 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"


@functools.cache
def _split(size: int):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex("(?m:.)" if size == 1 else f"(?m:.{{1,{size}}})"), behavior="isolated")


class Points:
    """Places of a text's code points, from the offsets of isolated matches."""

    def __init__(self, text: str) -> None:
        self._pieces = [piece for i in range(0, len(text), PART) for piece, _ in _split(STEP).pre_tokenize_str(text[i : i + PART])]
        self.n = STEP * (len(self._pieces) - 1) + len(_split(1).pre_tokenize_str(self._pieces[-1])) if self._pieces else 0

    def cut(self, rank: int) -> tuple[int, int]:
        """The piece that holds the cut before the code point of that rank, and the cut's offset in it."""
        piece, rest = divmod(rank, STEP)
        if not rest:
            return piece, 0
        offsets = [begin for _, (begin, _) in _split(1).pre_tokenize_str(self._pieces[piece])]
        return piece, offsets[rest] if rest < len(offsets) else len(self._pieces[piece])

    def slice(self, begin: tuple[int, int], end: tuple[int, int]) -> str:
        if begin[0] == end[0]:
            return self._pieces[begin[0]][begin[1] : end[1]] if begin[1] < end[1] else ""
        last = self._pieces[end[0]][: end[1]] if end[1] else ""
        return self._pieces[begin[0]][begin[1] :] + "".join(self._pieces[begin[0] + 1 : end[0]]) + last


def transform(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, output."""
    points = Points(text)
    n = points.n
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, end = points.cut(low), points.cut(high), points.cut(n)
    prefix, middle, suffix = points.slice((0, 0), a), points.slice(a, b), points.slice(b, end)
    if h4 % 100 < SPM_BELOW:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that transform() gave this output. Marks begin and end with characters that no other one of them has
    inside, so none arises where a part meets a mark, and the first find is the mark itself."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    i = output.index(second, len(first))
    j = output.index(MIDDLE, i + len(second))
    parts = {first: output[len(first) : i], second: output[i + len(second) : j]}
    return parts[PREFIX] + output[j + len(MIDDLE) :] + parts[SUFFIX]


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: doc_id, n, form, prefix_chars and middle_chars (null if plain), output, and the text restored from it.

    Cuts and form follow from the id alone, so a task that runs again gives the same rows. A null text counts as empty and
    stays plain. A null id counts as an empty number and stays null; rows that share an id share its numbers and are rows
    of their own. Other columns don't matter. Very long texts are split in parts of PART code points at a time.
    """
    small_batches(df.sparkSession)
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, *hashes = (batch.column(i).to_pylist() for i in range(1, 6))
        out = [transform(*row) for row in zip(texts, *hashes)]
        n, form, prefix, middle, output = zip(*out)
        restored = [restore(o, f) for o, f in zip(output, form)]
        columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string()), pa.array(restored, pa.string())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    return map_batches(id_and_text(df, id_col, text_col, *numbers), run, SCHEMA)
