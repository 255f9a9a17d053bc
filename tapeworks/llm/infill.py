"""Fill-in-middle: texts cut at two token boundaries and put together with sentinels around the parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_text

# Fixed values of the contract: the sentinels, a token, and the shares of the forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
TOKENS = regex.compile(r"([A-Za-z]+|[^A-Za-z])*")
PIECE = 1 << 20  # code points that one match covers; it keeps the end of each of its tokens
_OTHER = regex.compile(r"[^A-Za-z]")


def _pieces(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Runs of about ``size`` code points that end with a token; a longer word stays whole."""
    start = 0
    while start < len(text):
        stop = len(text)
        if stop - start > size:
            found = _OTHER.search(text, start + size)
            stop = found.end() if found else stop
        yield start, stop
        start = stop


def token_cuts(text: str, draws: tuple[int, int], size: int = PIECE) -> tuple[int, int, int]:
    """The number of tokens and where the prefix and the middle end, all from the ends that one match keeps.

    The match of a piece retains every repetition of its token group, so their count is n and their ends are the
    boundaries. A text longer than a piece is matched piece by piece, and once more where its cuts are.
    """
    if len(text) <= size:
        ends = TOKENS.fullmatch(text).ends(1)
        low, high = sorted(d % (len(ends) + 1) for d in draws)
        return len(ends), (ends[low - 1] if low else 0), (ends[high - 1] if high else 0)
    spans = [(a, b, len(TOKENS.fullmatch(text, a, b).ends(1))) for a, b in _pieces(text, size)]
    n = sum(count for _, _, count in spans)

    def end(k: int) -> int:
        for a, b, count in spans:
            if k <= count:
                return TOKENS.fullmatch(text, a, b).ends(1)[k - 1] if k else a
            k -= count
        return len(text)

    low, high = sorted(d % (n + 1) for d in draws)
    return n, end(low), end(high)


def draws(doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits that depend on the id alone; a missing id counts as an empty one."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def infilled(doc_id: int | None, text: str, size: int = PIECE) -> tuple[int, str, int | None, int | None, str]:
    """n, form, lengths of prefix and middle, output."""
    h = draws(doc_id)
    n, low, high = token_cuts(text, (h[0], h[1]), size)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h[3] % 100 < SPM_BELOW:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    for batch in batches:
        rows, size = [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            rows.append((doc_id.as_py(), *infilled(doc_id.as_py(), text.as_py())))
            size += len(rows[-1][-1])
            if size > PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.

    A text (a null one is empty) is n tokens: runs of ASCII letters, and every other code point alone. The id's hash draws
    the two token boundaries that end prefix and middle, and the form. A text stays as it is (``plain``, lengths null) if it
    is empty, holds a sentinel, or for a tenth of the ids. Rows that share a doc_id get the same draws, each its own result;
    a null id draws like an empty one and stays null. An empty table gives no row; other columns are ignored.

    No row needs another: there is no shuffle, and a task holds one text, its output and the token ends of a piece.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_fill, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text from an output and its form alone.

    Sentinels start with ``<`` and end with ``>``, so none can arise where a part meets one: the first of each kind is the one put in.
    """
    first, second = F.when(F.col(form) == "psm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX)), F.when(F.col(form) == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    body = F.substring(F.col(output), F.char_length(first) + 1, F.char_length(F.col(output)))
    at, last = F.instr(body, second), F.instr(body, F.lit(MIDDLE))
    one = F.substring(body, F.lit(1), at - 1)
    two = F.substring(body, at + F.char_length(second), last - at - F.char_length(second))
    middle = F.substring(body, last + len(MIDDLE), F.char_length(body))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
