"""Fill-in-middle: a text cut at two units, its parts put in another order between markers.

A text is stored as its maximal runs of white space and of other characters, with the
units that are complete at each run's end. The run that holds a cut is found by binary
search, and the place in it by arithmetic, so a cut needs no list of units.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)


class Runs(NamedTuple):
    """Ends of the class runs of a text in code points, units complete there, and characters a unit of the run."""

    ends: np.ndarray
    units: np.ndarray
    width: np.ndarray

    @property
    def n(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def offset(self, cut: int) -> int:
        """Code points before the end of unit ``cut``."""
        if cut <= 0:
            return 0
        run = int(np.searchsorted(self.units, cut))
        return int(self.ends[run] - (self.units[run] - cut) * self.width[run])


def runs(text: str, unit: str = "token") -> Runs:
    """The runs of ``text``. A token is a word with the white space before it, or white space
    at the end; a char is a code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return Runs(*(np.zeros(0, dtype=np.int64) for _ in range(3)))
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    ends = np.append(np.flatnonzero(space[1:] != space[:-1]) + 1, len(codes))
    if unit == "char":
        return Runs(ends, ends, np.ones(len(ends), dtype=np.int64))
    words = (~space[ends - 1]).astype(np.int64)
    words[-1] = 1
    return Runs(ends, np.cumsum(words), np.diff(ends, prepend=0))


def draws(key: str) -> list[int]:
    """The first four 8-digit groups of the hex sha256 of ``key`` as unsigned integers."""
    digest = hashlib.sha256(key.encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def cut(text: str, key: str, percent: int, spm_percent: int, unit: str) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text; see ``fill_in_middle``."""
    own = runs(text, unit)
    h = draws(key)
    if not text or any(m in text for m in MARKERS) or h[2] % 100 >= percent:
        return own.n, "plain", None, None, text
    a, b = sorted(own.offset(x % (own.n + 1)) for x in h[:2])
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return own.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return own.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 50, spm_percent: int = 80, seed: str = "42", unit: str = "token") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): a row for each row of ``docs``.

    n counts the units (``token`` or ``char``). The cuts, whether a text is cut at all
    (``percent`` of them) and which form it takes (``spm_percent`` of those) come from the
    sha256 of seed:doc_id, so a document has the same result in any run. A text that is
    empty or holds a marker stays plain, with null lengths. A null text is an empty one; a
    null id hashes as no digits; repeated rows repeat; an empty table gives no rows. Work
    is per row and linear in the text, a long one takes some 20 bytes a code point.
    """

    def rows(x: dict[str, list]) -> dict[str, list]:
        made = [cut(t, f"{seed}:{'' if i is None else i}", percent, spm_percent, unit) for i, t in zip(x["doc_id"], x["text"])]
        return {"doc_id": x["doc_id"], **{name: [m[k] for m in made] for k, name in enumerate(("n", "form", "prefix_chars", "middle_chars", "output"))}}

    return arrow_map(texts(docs, id_col, text_col), rows, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of: its parts split at the markers, in their first order."""
    parts = F.split(output, "|".join(MARKERS))
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(made: DataFrame) -> DataFrame:
    """The result of ``fill_in_middle`` with digests of the output and of the text rebuilt from it, in place of the output."""
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
