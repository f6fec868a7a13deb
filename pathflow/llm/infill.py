"""Fill-in-the-middle transformation of texts, and its reversal.

A text is a sequence of units: a run of ASCII letters, or one other code point.
Two cuts between units part it into prefix, middle and suffix, which are put
in another order behind sentinels.

The units are counted in one pass over the text's bytes, a block at a time,
which leaves a sparse index: every so many units a checkpoint of the unit's
byte and code-point offset.  A cut is then found by a binary search of the
checkpoints and a short scan from there, so a long text is neither kept as a
list of units nor counted twice.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, slices
from .shingles import text_bytes

_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122)
_FOLLOWS = (_BYTES & 0xC0) == 0x80  # a byte within a code point


@dataclass(frozen=True)
class Settings:
    """Sentinels, shares of the forms in per cent, seed of the draws, and the index's density."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain_percent: int = 10
    suffix_first_percent: int = 20
    seed: int = 1
    every: int = 1024  # units from one checkpoint to the next
    block: int = 1 << 18  # bytes that are looked at together

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _unit_starts(block: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte begins a unit, and whether it begins a code point."""
    letter, lead = _LETTER[block], ~_FOLLOWS[block]
    inside = letter.copy()
    inside[0] &= after_letter
    inside[1:] &= letter[:-1]
    return lead & ~inside, lead


@dataclass
class UnitIndex:
    """Numbers of units and code points of a text, and a checkpoint at every ``every``-th unit's first byte."""

    raw: np.ndarray
    every: int
    block: int
    units: list[int] = field(default_factory=list)
    bytes: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    n_units: int = 0
    n_chars: int = 0

    def __post_init__(self) -> None:
        for at in range(0, len(self.raw), self.block):
            part = self.raw[at : at + self.block]
            starts, lead = _unit_starts(part, at > 0 and bool(_LETTER[self.raw[at - 1]]))
            where = np.flatnonzero(starts)
            marks = np.arange(-self.n_units % self.every, len(where), self.every)
            if len(marks):
                places = where[marks]
                self.units += (marks + self.n_units).tolist()
                self.bytes += (places + at).tolist()
                self.chars += (np.cumsum(lead)[places] - 1 + self.n_chars).tolist()
            self.n_units += len(where)
            self.n_chars += int(np.count_nonzero(lead))

    def place(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset at which a unit begins; the end of the text for the number of units."""
        if unit >= self.n_units:
            return len(self.raw), self.n_chars
        k = bisect_right(self.units, unit) - 1
        left, at, chars = unit - self.units[k], self.bytes[k], self.chars[k]
        size = min(self.block, 4 * self.every)
        while True:
            starts, lead = _unit_starts(self.raw[at : at + size], at > self.bytes[k] and bool(_LETTER[self.raw[at - 1]]))
            where = np.flatnonzero(starts)
            if left < len(where):
                return at + int(where[left]), chars + int(np.count_nonzero(lead[: where[left]]))
            left, at, chars = left - len(where), at + size, chars + int(np.count_nonzero(lead))


def transform(raw: np.ndarray, draws: tuple[int, int, int, int], settings: Settings) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle (none for plain), and the output of a text's bytes."""
    index = UnitIndex(raw, settings.every, settings.block)
    n, text = index.n_units, raw.tobytes()
    p, s, m = (x.encode() for x in settings.sentinels)
    if not text or draws[2] % 100 >= 100 - settings.plain_percent or any(x in text for x in (p, s, m)):
        return n, "plain", None, None, text
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    (a, a_chars), (b, b_chars) = index.place(low), index.place(high)
    first, second, third = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < settings.suffix_first_percent:
        return n, "spm", a_chars, b_chars - a_chars, b"".join((s, third, p, first, m, second))
    return n, "psm", a_chars, b_chars - a_chars, b"".join((p, first, s, third, m, second))


def draws_of(key: Column, seed: int) -> list[Column]:
    """Four draws: the first 8-digit groups of the SHA-256 of seed, colon and the key's text, as unsigned numbers. A null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(df: DataFrame, *, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), settings: Settings = Settings()) -> DataFrame:
    """The columns ``keep``, then ``n, form, prefix_chars, middle_chars, output``.

    Null texts are empty; empty texts, texts that hold a sentinel, and a share
    of the others stay plain, with null numbers of code points.  The draws
    depend on the key alone, so repeated rows give equal results.  Columns are
    found by name; kept ones must not have the names of new ones.  No shuffle.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    if clash := {c.lower() for c in keep} & set(new):
        raise ValueError(f"columns {sorted(clash)} can't be kept beside new ones of the same name")
    held = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free_name(keep, "__text")), *[d.alias(free_name(keep, f"__draw{i}")) for i, d in enumerate(draws_of(F.col(f"`{key}`"), settings.seed))])
    kept = len(keep)
    schema = ", ".join([f"`{c}` {t}" for c, t in held.dtypes[:kept]] + ["n long, form string, prefix_chars long, middle_chars long, output string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, kept):
                raw, bounds = text_bytes(part.column(kept))
                draws = zip(*(part.column(kept + 1 + i).to_pylist() for i in range(4)), strict=True)
                rows = [transform(raw[a:b], d, settings) for a, b, d in zip(bounds[:-1], bounds[1:], draws, strict=True)]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *cols[:-1], cols[-1].view(pa.string())], names=[*keep, *new])

    return held.mapInArrow(run, schema)


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that an output was made from.  Every sentinel stands in it once unless it is plain."""
    p, s, m = settings.sentinels
    tail = F.substring_index(output, m, -1)
    between = lambda x, y: F.substring_index(F.substring_index(output, x, -1), y, 1)
    return F.when(form == "psm", F.concat(between(p, s), tail, between(s, m))).when(form == "spm", F.concat(between(p, m), tail, between(s, p))).otherwise(output)


#: The query in DuckDB's SQL.
SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents
), e AS (
    SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
             WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM d
), f AS (
    SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM e
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM f
"""
